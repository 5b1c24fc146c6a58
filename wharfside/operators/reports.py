"""Counts and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wharfside.operators.export import group_count


def stats(domains: DataFrame, catalogs: DataFrame, entries: DataFrame) -> DataFrame:
    """(section, label, n): totals and breakdowns of domains by status, catalogs by verdict, entries by type.

    The total of a section is the sum of its breakdown, so each table is read once.
    """
    parts = []
    for section, df, column in (("domains", domains, "ard_status"), ("catalogs", catalogs, "verification_status"), ("entries", entries, "media_type")):
        parts.append(group_count(df, column).select(F.lit(section).alias("section"), "label", "n"))
    breakdown = parts[0].unionByName(parts[1]).unionByName(parts[2])
    rolled = breakdown.groupBy("section").agg(F.sum("n").alias("n")).select("section", F.lit("(total)").alias("label"), "n")
    return breakdown.unionByName(rolled)


def run_summary(frontier: DataFrame, probes: DataFrame, catalogs: DataFrame, since: Column) -> DataFrame:
    """One row: pages_fetched, hosts_probed, catalogs_found, catalogs_valid, errors since a time (E7, C8); one pass for each table."""
    late = lambda c: F.col(c) >= since
    work = frontier.agg(F.count_if((F.col("kind") == "page_fetch") & (F.col("status") == "done") & late("updated_at")).alias("pages_fetched"), F.count_if((F.col("status") == "failed") & late("updated_at")).alias("errors"))
    seen = probes.filter(late("probed_at")).agg(F.count_distinct("domain_id").alias("hosts_probed"))
    good = F.col("verification_status").isin("valid", "valid_with_warnings")
    docs = catalogs.agg(F.count_if(late("fetched_at")).alias("catalogs_found"), F.count_if(late("fetched_at") & good).alias("catalogs_valid"))
    return _one_row([work, seen, docs], ["pages_fetched", "hosts_probed", "catalogs_found", "catalogs_valid", "errors"])


def probe_summary(probes: DataFrame) -> DataFrame:
    """One row (hits, misses, errors)."""
    return probes.agg(*[F.count_if(F.col("outcome") == o).alias(n) for o, n in (("hit", "hits"), ("miss", "misses"), ("error", "errors"))])


def duplicate_groups(df: DataFrame, key: list[str]) -> DataFrame:
    """Keys that occur more than once, with their count."""
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def reverified(catalogs: DataFrame, domains: DataFrame, verified: DataFrame) -> DataFrame:
    """One row (reverified, invalid): catalogs without a domain count as re-verified though they are skipped."""
    own = catalogs.select(F.col("id").alias("catalog_id"), "domain_id").join(domains.select(F.col("id").alias("domain_id")), "domain_id", "left_semi")
    bad = own.join(verified.filter("verdict = 'invalid'").select("catalog_id"), "catalog_id", "left_semi")
    return _one_row([catalogs.agg(F.count(F.lit(1)).alias("reverified")), bad.agg(F.count(F.lit(1)).alias("invalid"))], ["reverified", "invalid"])


def _one_row(parts: list[DataFrame], columns: list[str]) -> DataFrame:
    """The single rows of ``parts`` side by side: each column has a value in one part only."""
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p, allowMissingColumns=True)
    return rows.agg(*[F.max(c).alias(c) for c in columns])
