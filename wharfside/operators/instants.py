"""Problem 3: written times of many notations and zones as UTC instants.

Method: distinct (text, zone, day order) triples form a dictionary; each is
parsed once, exhaustively, and the dictionary is a written table that later
runs extend; instants are joined back to the rows. Triples are counted before
they are shuffled, and the counts steer the join back, so that a value that
holds a third of all rows is neither parsed nor shuffled more than once.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wharfside.functions.instants import utc_micros
from wharfside.scratch import finished_tables, write_table
from wharfside.skew import join_unique

KEY = ["raw", "tz_name", "date_order"]


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        raw, tz, order = (b.column(i).to_pylist() for i in range(3))
        us = pa.array([utc_micros(*x) for x in zip(raw, tz, order, strict=True)], pa.int64())
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), us], names=[*KEY, "utc_us"])


def parse_dictionary(distinct: DataFrame) -> DataFrame:
    """Parse distinct (raw, tz_name, date_order) triples; utc_us is null where no single instant is named."""
    return distinct.select(*KEY).mapInArrow(_parse, "raw string, tz_name string, date_order string, utc_us bigint")


def instant_dictionary(values: DataFrame, path: str | None = None) -> DataFrame:
    """The dictionary (raw, tz_name, date_order, utc_us) of the triples in ``values``, which are distinct.

    With ``path`` the dictionary kept there is extended by the triples it
    lacks and only those are parsed; without, a new one is written into the
    shared folder. A kept dictionary is a folder of versions, each a table
    that is read only once it is complete; a run without new triples adds
    none. Runs side by side may both add a triple: its instant is the same in
    both, and it counts once.
    """
    if path is None:
        return write_table(parse_dictionary(values), "instants")
    spark = values.sparkSession
    versions = finished_tables(spark, path)
    if versions:
        values = values.join(_versions(spark, versions).select(*KEY), KEY, "left_anti")
    fresh = values
    if not versions or fresh.head(1):
        added = f"{path.rstrip('/')}/{uuid.uuid4().hex}"
        parse_dictionary(fresh).write.parquet(added)
        versions.append(added)
    return _versions(spark, versions)


def _versions(spark: SparkSession, paths: list[str]) -> DataFrame:
    read = spark.read.schema("raw string, tz_name string, date_order string, utc_us bigint").parquet(*paths)
    return read if len(paths) == 1 else read.groupBy(*KEY).agg(F.max("utc_us").alias("utc_us"))


def _first_us(year: int) -> int:
    return int(datetime(year, 1, 1, tzinfo=UTC).timestamp()) * 10**6


def host_suffix(url_col: str) -> F.Column:
    """The last two labels of the host of a URL, lower case; null without a host."""
    host = F.lower(F.regexp_extract(F.col(url_col), r"^\s*[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#\s]+)", 1))
    return F.nullif(F.substring_index(F.rtrim(host, F.lit(".")), ".", -2), F.lit(""))


def located_values(rows: DataFrame, catalogs: DataFrame, locales: DataFrame) -> DataFrame:
    """(row_id, raw, tz_name, date_order) of ``rows`` (row_id, catalog_id, raw): the locale of each row's catalog.

    Null and blank values are left out: they name no time. A row without catalog or locale gets ''
    for both. Locales are one row per host suffix and number far fewer than
    catalogs; the join with them is left to the optimizer.
    """
    rows = write_table(rows.filter(F.trim("raw") != "").withColumn("catalog_id", F.coalesce("catalog_id", F.lit(-1))), "values")
    lean = catalogs.select(F.col("id").alias("catalog_id"), host_suffix("source_url").alias("suffix")).dropDuplicates(["catalog_id"])
    one = locales.groupBy(F.lower("host_suffix").alias("suffix")).agg(F.min("tz_name").alias("tz_name"), F.min("date_order").alias("date_order"))
    used = rows.groupBy("catalog_id").agg(F.count(F.lit(1)).alias("n"))
    dim = used.join(lean, "catalog_id", "left").join(one, "suffix", "left")
    dim = dim.select("catalog_id", F.coalesce("tz_name", F.lit("")).alias("tz_name"), F.coalesce("date_order", F.lit("")).alias("date_order"), "n")
    return join_unique(rows, write_table(dim, "locales"), ["catalog_id"], "n").select("row_id", *KEY)


def normalise_instants(rows: DataFrame, catalogs: DataFrame, locales: DataFrame, path: str | None = None, years: tuple[int, int] | None = None) -> DataFrame:
    """(row_id, utc_us) of the rows (row_id, catalog_id, raw) whose text names exactly one instant.

    Repeated rows come out as often as they come in. Null, empty, blank and
    unreadable texts, of any length, give no row; empty tables give an empty
    result; other columns of the inputs are ignored. ``years`` (first, last)
    keeps only instants within these years, UTC; without it all are kept. See
    ``utc_micros`` for the rules.
    """
    located = write_table(located_values(rows, catalogs, locales), "located")
    counted = write_table(located.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n")), "triples")
    known = instant_dictionary(counted.select(*KEY), path)
    dated = known.filter("utc_us IS NOT NULL")
    if years:
        dated = dated.filter(F.col("utc_us").between(_first_us(years[0]), _first_us(years[1] + 1) - 1))
    dim = write_table(counted.join(dated, KEY), "dated")
    return join_unique(located, dim, KEY, "n").select("row_id", "utc_us")


def entry_instants(entries: DataFrame, catalogs: DataFrame, locales: DataFrame, path: str | None = None, years: tuple[int, int] | None = None) -> DataFrame:
    """(entry_id, utc_us) for catalog entries with a readable update time."""
    rows = entries.select(F.col("id").alias("row_id"), "catalog_id", F.col("entry_updated_at").alias("raw"))
    return normalise_instants(rows, catalogs, locales, path, years).withColumnRenamed("row_id", "entry_id")
