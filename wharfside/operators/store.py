"""Keyed merges into the index tables and look-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from wharfside.skew import numbered


def upsert_domains(domains: DataFrame, found: DataFrame, now: Column) -> DataFrame:
    """Hosts that are absent become unprobed domains; of several sources the first by seq holds; present rows stay.

    ``found``: host, discovery_source, seq. New rows get their id by ``with_ids``.
    """
    first = found.filter("host IS NOT NULL").groupBy("host").agg(F.min_by("discovery_source", "seq").alias("discovery_source"), F.min("seq").alias("seq"))
    fresh = first.join(domains.select("host"), "host", "left_anti")
    fixed = {"ard_status": F.lit("unprobed"), "first_seen_at": now, "created_at": now, "updated_at": now}
    columns = [fixed.get(f.name, F.col(f.name) if f.name in ("host", "discovery_source") else F.lit(None)).cast(f.dataType).alias(f.name) for f in domains.schema.fields]
    return domains.unionByName(with_ids(fresh.select(*columns, "seq"), domains, ["seq", "host"]))


def with_ids(fresh: DataFrame, present: DataFrame, order: list[str]) -> DataFrame:
    """Consecutive ids after the highest present one, in ``order``, numbered in range parts."""
    top = present.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    ranked = numbered(fresh, order, "__rank", "ids")
    return ranked.withColumn("id", F.col("__rank") + F.lit(top)).select(*present.columns)


def record_probes(domains: DataFrame, probes: DataFrame) -> DataFrame:
    """last_probed_at of the domains in ``probes`` (domain_id, probed_at) moves to the latest probe; status stays."""
    last = probes.groupBy(F.col("domain_id").alias("id")).agg(F.max("probed_at").alias("__at"))
    return domains.join(last, "id", "left").withColumn("last_probed_at", F.coalesce("__at", "last_probed_at")).select(*domains.columns)


def update_status(domains: DataFrame, changes: DataFrame) -> DataFrame:
    """ard_status from ``changes`` (host, ard_status, seq): the last by seq wins."""
    last = changes.groupBy("host").agg(F.max_by("ard_status", "seq").alias("__s"))
    return domains.join(last, "host", "left").withColumn("ard_status", F.coalesce("__s", "ard_status")).select(*domains.columns)


def is_fresh(last_probed_at: Column, now: Column, hours: int = 168) -> Column:
    """Whether the last probe is less than ``hours`` old; false when never probed."""
    return F.coalesce(now - F.make_interval(hours=F.lit(hours)) < last_probed_at, F.lit(False))


def replace_checks(checks: DataFrame, entries: DataFrame, verified_ids: DataFrame, fresh: DataFrame) -> DataFrame:
    """Checks after a re-verification: those of the catalogs in ``verified_ids`` (id) and of all their entries go, ``fresh`` comes."""
    gone_entries = entries.join(verified_ids.select(F.col("id").alias("catalog_id")), "catalog_id", "left_semi").select(F.lit("entry").alias("subject_type"), F.col("id").alias("subject_id"))
    gone = verified_ids.select(F.lit("catalog").alias("subject_type"), F.col("id").alias("subject_id")).unionByName(gone_entries)
    return checks.join(gone, ["subject_type", "subject_id"], "left_anti").unionByName(fresh)


def failing_of_invalid(checks: DataFrame, catalogs: DataFrame, domains: DataFrame) -> DataFrame:
    """Failed catalog checks of invalid catalogs with host and URL."""
    bad = catalogs.filter("verification_status = 'invalid'").select(F.col("id").alias("subject_id"), "domain_id", "source_url")
    own = checks.filter("subject_type = 'catalog' AND NOT passed")
    return own.join(bad, "subject_id").join(domains.select(F.col("id").alias("domain_id"), "host"), "domain_id").select("host", "source_url", "check_id", "severity", "message")


def followups(entries: DataFrame, harvest: bool = True, artifacts: bool = True) -> DataFrame:
    """(entry_id, catalog_id, url, follow): what each entry with a pointer leads to (K8).

    Catalogs are followed by URL or embedded data; registries with a URL are
    harvested when that is on; any other entry with a URL (a registry while
    harvest is off too) is an artifact when those are fetched. Others give no row.
    """
    from wharfside.functions.media import media_kind, parse_media

    kind = media_kind(parse_media(F.col("media_type")))
    has_url = F.coalesce(F.col("ref_url") != "", F.lit(False))
    data = F.coalesce(F.col("has_embedded_data"), F.lit(False))
    follow = (
        F.when((kind == "catalog") & has_url, "catalog_fetch")
        .when((kind == "catalog") & data, "embedded_catalog")
        .when(kind == "catalog", F.lit(None))
        .when((kind == "registry") & has_url & F.lit(harvest), "registry_harvest")
        .when(has_url & F.lit(artifacts), "artifact_fetch")
    )
    return entries.select(F.col("id").alias("entry_id"), "catalog_id", F.coalesce("ref_url", F.lit("")).alias("url"), follow.alias("follow")).filter("follow IS NOT NULL")


def classify_fetch(status: Column, error: Column) -> Column:
    """Outcome of a failed or finished fetch: 4xx is a miss, any other failure an error, else ok (K5)."""
    return F.when((status >= 400) & (status < 500), "miss").when((status >= 500) | (F.coalesce(error, F.lit("")) != "") | (F.coalesce(status, F.lit(0)) == 0), "error").otherwise("ok")


def is_transient(status: Column, error: Column) -> Column:
    """429, 5xx, timeouts and DNS failures are worth another attempt."""
    return F.coalesce((status == 429) | (status >= 500), F.lit(False)) | F.coalesce(error.isin("timeout", "dns", "network"), F.lit(False))


class NotFound(LookupError):
    """No row has the key that was asked for."""


def look_up(df: DataFrame, **key: object) -> Row:
    """The row with these column values, of several the first by id; NotFound when there is none."""
    hit = df
    for c, v in key.items():
        hit = hit.filter(F.col(c) == F.lit(v))
    rows = hit.orderBy("id").head(1)
    if not rows:
        raise NotFound(", ".join(f"{c}={v!r}" for c, v in key.items()))
    return rows[0]


def of_keys(df: DataFrame, column: str, keys: DataFrame) -> DataFrame:
    """The rows whose ``column`` is among ``keys`` (one column); for lists of any length."""
    return df.join(keys.select(F.col(keys.columns[0]).alias(column)).distinct(), column, "left_semi").select(*df.columns)


def backoff_seconds(attempts: Column, first: float = 1.0, most: float = 30.0) -> Column:
    """How long a failed item waits before its next attempt: doubled each time, ``most`` at most."""
    return F.least(F.lit(most), F.lit(first) * F.pow(F.lit(2.0), F.greatest(attempts - 1, F.lit(0))))


def misplaced_checks(checks: DataFrame, entries: DataFrame) -> DataFrame:
    """Checks whose subject isn't there: they must be none before a catalog is saved."""
    return checks.filter("subject_type = 'entry'").join(entries.select(F.col("id").alias("subject_id")), "subject_id", "left_anti")
