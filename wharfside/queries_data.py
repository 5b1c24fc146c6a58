"""Registered queries of the data-processing problems in the core: nested documents, times, packed fields, changes."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wharfside.functions.instants import RULES
from wharfside.operators import changes, instants, nested, packed, snapshots
from wharfside.scratch import scratch_root
from wharfside.tables import EXPORT_FIELDS, table

Query = Callable[[SparkSession, str], DataFrame]


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return nested.found(nested.flatten_catalogs(table(spark, d, "ard_catalogs"), texts=False))


def p2_entries(spark: SparkSession, d: str) -> DataFrame:
    return nested.entries(nested.flatten_catalogs(table(spark, d, "ard_catalogs")))


def p2_attestations(spark: SparkSession, d: str) -> DataFrame:
    return nested.attestations(nested.flatten_catalogs(table(spark, d, "ard_catalogs")))


def p2_unreadable(spark: SparkSession, d: str) -> DataFrame:
    return nested.unreadable(table(spark, d, "ard_catalogs"))


_UNREADABLE_SQL = """
SELECT id AS catalog_id, CASE WHEN raw_json IS NULL THEN 'null' WHEN NOT json_valid(raw_json) THEN 'not JSON' ELSE 'not an object' END AS reason
FROM ard_catalogs WHERE raw_json IS NULL OR NOT json_valid(raw_json) OR json_type(raw_json) <> 'OBJECT'
"""


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """The dictionary is kept in the shared folder; a second run parses only what it lacks. The years are those in which all cases lie."""
    tables = (table(spark, d, n) for n in ("catalog_entries", "ard_catalogs", "host_locales"))
    return instants.entry_instants(*tables, path=f"{scratch_root(spark)}/instant_dictionary-{RULES}", years=(2022, 2027))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return packed.split_fields(table(spark, d, "export_rows"), ["tags", "representative_queries"]).drop("error_flags")


def p4_flagged(spark: SparkSession, d: str) -> DataFrame:
    """Values whose quotes or brackets are malformed, with the kind of error."""
    return packed.split_fields(table(spark, d, "export_rows"), ["tags", "representative_queries"]).filter("error_flags <> 0")


def _export_changes(spark: SparkSession, d: str) -> DataFrame:
    """Through the store of this folder's snapshots, kept in the shared folder: snapshots that it holds already are only read."""
    return snapshots.export_changes(table(spark, d, "export_rows"), f"{scratch_root(spark)}/snapshots/{hashlib.md5(d.encode()).hexdigest()}")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    columns = ["table_name", "snapshot_id", "owner", "urn", "change_kind"]
    rows = _export_changes(spark, d).withColumn("table_name", F.lit("export_rows"))
    docs = changes.catalog_changes(table(spark, d, "ard_catalogs")).filter("urn IS NOT NULL").withColumn("table_name", F.lit("ard_catalogs"))
    return rows.select(*columns).unionByName(docs.select(*columns))


def p5_export_changes(spark: SparkSession, d: str) -> DataFrame:
    return _export_changes(spark, d).withColumn("changed_fields", F.coalesce("changed_fields", F.lit(0)))


_OTHERS = [c for c in EXPORT_FIELDS if c not in ("host", "urn")]
_P5_SQL = f"""
WITH latest AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY snapshot_no, host, urn ORDER BY delivered_at DESC, row_id DESC) AS rn FROM export_rows) WHERE rn = 1
), v AS (
  SELECT snapshot_no AS s, host AS owner, urn, {", ".join(f"coalesce({c}, '') AS {c}" for c in _OTHERS)} FROM latest
), span AS (SELECT min(s) AS low, max(s) AS high FROM v), j AS (
  SELECT coalesce(b.s, a.s + 1) AS snapshot_id, coalesce(b.owner, a.owner) AS owner, coalesce(b.urn, a.urn) AS urn,
    CASE WHEN a.s IS NULL THEN 'added' WHEN b.s IS NULL THEN 'removed' ELSE 'changed' END AS change_kind,
    CASE WHEN a.s IS NULL OR b.s IS NULL THEN 0 ELSE {" + ".join(f"CASE WHEN a.{c} <> b.{c} THEN {1 << i} ELSE 0 END" for i, c in enumerate(_OTHERS))} END AS changed_fields
  FROM v a FULL JOIN v b ON a.s + 1 = b.s AND a.owner = b.owner AND a.urn = b.urn
)
SELECT CAST(snapshot_id AS BIGINT) AS snapshot_id, owner, urn, change_kind, CAST(changed_fields AS BIGINT) AS changed_fields
FROM j, span WHERE snapshot_id > low AND snapshot_id <= high AND (change_kind <> 'changed' OR changed_fields > 0)
"""

QUERIES: dict[str, Query] = {
    "p2_found": p2_found,
    "p2_entries": p2_entries,
    "p2_attestations": p2_attestations,
    "p2_unreadable": p2_unreadable,
    "p3_found": p3_found,
    "p4_found": p4_found,
    "p4_flagged": p4_flagged,
    "p5_found": p5_found,
    "p5_export_changes": p5_export_changes,
}
ORACLES = {"p2_unreadable": _UNREADABLE_SQL, "p5_export_changes": _P5_SQL}
