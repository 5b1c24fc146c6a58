"""Registered queries of the training-data problems."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from wharfside.llm import mixing, packing, records, spam_pages
from wharfside.scratch import write_table
from wharfside.tables import table

Query = Callable[[SparkSession, str], DataFrame]


def _records(spark: SparkSession, d: str) -> DataFrame:
    return records.index_records(table(spark, d, "export_lines"), table(spark, d, "catalog_entries"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return records.record_copies(_records(spark, d))


def p1_records(spark: SparkSession, d: str) -> DataFrame:
    return records.distinct_records(_records(spark, d))


def p1_entry_records(spark: SparkSession, d: str) -> DataFrame:
    entries = records.column_records(table(spark, d, "catalog_entries"), "catalog_entries", "id", ["catalog_id"], records.ENTRY_FIELDS)
    return records.distinct_records(entries)


_PLAIN = ", ".join(f"regexp_replace(lower(coalesce({c}, '')), '[^\\p{{L}}\\p{{N}}]', '', 'g') AS {c}" for c in records.ENTRY_FIELDS)
_P1_SQL = f"""
WITH plain AS (SELECT id, catalog_id, {_PLAIN} FROM catalog_entries)
SELECT 'catalog_entries' AS table_name, min(id) AS first_id, count(*) AS copies FROM plain GROUP BY catalog_id, {", ".join(records.ENTRY_FIELDS)}
"""


def p6_pack(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack_texts(table(spark, d, "documents"), table(spark, d, "pack_capacities"))


def p6_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.container_fill(p6_pack(spark, d), table(spark, d, "pack_capacities"))


def p7_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix_sources(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    targets = table(spark, d, "mix_targets")
    plan = mixing.plan_mix(table(spark, d, "documents"), targets)
    assert plan is not None
    return mixing.mix_shares(write_table(plan.texts(), "mix"), targets).join(plan.report().select("mix_name", "steps", "residual"), "mix_name", "left")


def p7_invariants(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix_invariants(write_table(p7_mix(spark, d), "mix"), table(spark, d, "documents"), table(spark, d, "mix_targets"), within=0.005)


_P7_SQL = "SELECT DISTINCT mix_name, true AS shares_met, true AS limits_kept, true AS texts_once, true AS sources_named FROM mix_targets"


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return spam_pages.spam_pages(table(spark, d, "documents"), table(spark, d, "page_labels"))


def p8_scores(spark: SparkSession, d: str) -> DataFrame:
    documents = table(spark, d, "documents")
    return spam_pages.score_pages(documents, spam_pages.fit(spam_pages.labelled_pages(documents, table(spark, d, "page_labels"))))


QUERIES: dict[str, Query] = {
    "p1_found": p1_found,
    "p1_records": p1_records,
    "p1_entry_records": p1_entry_records,
    "p6_pack": p6_pack,
    "p6_fill": p6_fill,
    "p7_mix": p7_mix,
    "p7_shares": p7_shares,
    "p7_invariants": p7_invariants,
    "p8_found": p8_found,
    "p8_scores": p8_scores,
}
ORACLES = {"p1_entry_records": _P1_SQL, "p7_invariants": _P7_SQL}
