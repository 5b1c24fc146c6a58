"""Reading the index tables of a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: The 13 export fields, in export order. Fixed values.
EXPORT_FIELDS = [
    "host",
    "catalog_source_url",
    "verification_status",
    "urn",
    "urn_publisher",
    "display_name",
    "media_type",
    "ref_url",
    "description",
    "version",
    "source",
    "tags",
    "representative_queries",
]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One table of a data folder as a Parquet scan."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


#: Drivers by the schemes under which an index may be kept in a database. Fixed values.
DATABASES = {"sqlite": "org.sqlite.JDBC", "sqlite3": "org.sqlite.JDBC", "mysql": "com.mysql.cj.jdbc.Driver", "postgres": "org.postgresql.Driver", "postgresql": "org.postgresql.Driver"}


def database_options(driver: str, address: str, name: str, parts: int = 32, bounds: tuple[int, int] | None = None) -> dict[str, str]:
    """Reader options for a table of an index kept in a database, read in ``parts`` ranges of its id (A1).

    SQLite allows one reader. ValueError for a driver that isn't known.
    """
    if driver not in DATABASES:
        raise ValueError(f"unsupported database {driver!r}: one of {', '.join(sorted(DATABASES))}")
    scheme = {"sqlite3": "sqlite", "postgres": "postgresql"}.get(driver, driver)
    out = {"url": address if address.startswith("jdbc:") else f"jdbc:{scheme}:{address}", "driver": DATABASES[driver], "dbtable": name}
    if bounds and scheme != "sqlite":
        out |= {"partitionColumn": "id", "lowerBound": str(bounds[0]), "upperBound": str(bounds[1]), "numPartitions": str(parts)}
    return out


def database_table(spark: SparkSession, driver: str, address: str, name: str) -> DataFrame:
    """One table of an index kept in a database; its id range is asked for first, so that it can be read in parts (A1)."""
    if driver.startswith("sqlite"):
        return spark.read.format("jdbc").options(**database_options(driver, address, name)).load()
    ends = spark.read.format("jdbc").options(**database_options(driver, address, f"(SELECT min(id) AS a, max(id) AS b FROM {name}) t")).load().first()
    return spark.read.format("jdbc").options(**database_options(driver, address, name, bounds=(ends[0] or 0, (ends[1] or 0) + 1))).load()
