"""Whole jobs over the index: crawl with its run record, seeding, direct probes, verification of one target and of all stored catalogs."""

from __future__ import annotations

import json
import os
from datetime import datetime
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wharfside import __version__
from wharfside.functions import hosts
from wharfside.operators import frontier as fr
from wharfside.operators import reports, store, verify
from wharfside.plans import crawl
from wharfside.scratch import write_table

RUNS = "id bigint, started_at timestamp, finished_at timestamp, status string, seeds string"
#: Bytes of a verification target that are read. Fixed value.
TARGET_BYTES = 5 << 20


def create_run(runs: DataFrame, seeds: list[str], now: datetime) -> tuple[DataFrame, int]:
    """``runs`` with a new running one, and its id."""
    number = (runs.agg(F.max("id")).first()[0] or 0) + 1
    return runs.unionByName(runs.sparkSession.createDataFrame([(number, now, None, "running", json.dumps(seeds))], RUNS)), number


def finish_run(runs: DataFrame, number: int, now: datetime, status: str = "done") -> DataFrame:
    """The run ends; LookupError when there is none of that number."""
    if not runs.filter(F.col("id") == number).head(1):
        raise LookupError(f"no run {number}")
    mine = F.col("id") == number
    return runs.withColumns({"finished_at": F.when(mine, F.lit(now)).otherwise(F.col("finished_at")), "status": F.when(mine, status).otherwise(F.col("status"))})


def run_crawl(runs: DataFrame, seeds: list[str], responses: DataFrame, now: datetime, cfg: crawl.Config, registry_pages: DataFrame | None = None) -> tuple[crawl.State, DataFrame, DataFrame]:
    """A crawl from ``seeds`` to its end: the last state, the runs with this one, and its summary in one row."""
    spark = responses.sparkSession
    runs, number = create_run(runs, seeds, now)
    state = crawl.start(spark, spark.createDataFrame([(s, i) for i, s in enumerate(seeds)], "raw string, ord bigint"), now)
    state = crawl.crawl(state, responses, now, cfg, registry_pages)
    summary = reports.run_summary(state["frontier"], state["probes"], state["catalogs"], F.lit(now)).withColumns({"run_id": F.lit(number).cast("long"), "seeded": F.lit(len(seeds)).cast("long")})
    return state, write_table(finish_run(runs, number, now), "runs"), summary


def run_seeder(domains: DataFrame, frontier: DataFrame, found: DataFrame, source: str, now: datetime) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Hosts of a seed source (host, ord) become domains and host probes: domains, frontier, and one row (added, skipped).

    A host counts as added when its probe is new or due again, else as skipped.
    """
    first = found.filter("host IS NOT NULL").groupBy("host").agg(F.min("ord").alias("seq"))
    at = F.lit(now)
    items = fr.items(first.select(F.lit("host_probe").alias("kind"), F.lit("").alias("url"), "host", F.lit(0).alias("depth"), F.lit(0).alias("priority"), F.lit(1).cast("long").alias("run_id"), "seq"))
    busy = frontier.filter(F.col("status").isin(fr.PENDING, fr.IN_FLIGHT)).select("dedup_key", F.lit(True).alias("busy"))
    told = items.join(busy, "dedup_key", "left").agg(F.count_if(F.col("busy").isNull()).alias("added"), F.count_if(F.col("busy").isNotNull()).alias("skipped"))
    grown = store.upsert_domains(domains, first.select("host", F.lit(source).alias("discovery_source"), "seq"), at)
    return grown, fr.enqueue(frontier, items, at), told


def direct_probe(domains: DataFrame, probed: DataFrame, responses: DataFrame, now: datetime) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Probe hosts (host) at once: domains with unknown hosts added, the probes, one row (hits, misses, errors).

    Catalogs aren't fetched and statuses stay.
    """
    at = F.lit(now)
    named = probed.select("host").distinct()
    known = write_table(store.upsert_domains(domains, named.select("host", F.lit("seed").alias("discovery_source"), F.xxhash64("host").alias("seq")), at), "domains")
    seen = crawl.probe(known.join(named, "host", "left_semi").select("id", "host"), responses.dropDuplicates(["url"]))
    rows = write_table(crawl.probe_rows(seen, known, at), "probes")
    return store.record_probes(known, rows), rows, reports.probe_summary(rows)


def verify_target(spark: SparkSession, target: str, responses: DataFrame | None = None) -> dict[str, Any]:
    """{source, verdict, checks} of a file, or of a URL among ``responses``; LookupError when it isn't there.

    A file has no serving domain; of a URL it is the host. At most TARGET_BYTES are read.
    """
    if "://" in target:
        row = responses.filter((F.col("url") == target) & crawl._http_ok()).select("body").head() if responses is not None else None
        if row is None:
            raise LookupError(f"no answer from {target}")
        body, domain = bytes(row.body or b""), hosts.url_host(F.lit(target))
    else:
        with open(target, "rb") as f:
            body, domain = f.read(TARGET_BYTES), F.lit("")
    one = spark.createDataFrame([(1, body[:TARGET_BYTES].decode("utf-8", "replace"))], "id bigint, raw_json string")
    got = verify.verify_documents(one, domain=domain).first()
    return {"source": target, "verdict": got.verdict, "checks": [c.asDict() for c in got.checks]}


def reverify(catalogs: DataFrame, entries: DataFrame, domains: DataFrame, checks: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Verify every stored catalog anew: catalogs with their verdicts, checks with the fresh ones, one row (reverified, invalid).

    A catalog whose domain is missing is skipped, though it is counted.
    """
    owned = catalogs.join(domains.select(F.col("id").alias("domain_id"), F.col("host").alias("__host")), "domain_id")
    verified = write_table(verify.verify_documents(owned, domain=F.col("__host")), "verified")
    fresh = verify.split_subjects(verify.check_rows(verified), entries.select("id", "catalog_id", "urn")).select(*checks.columns)
    verdicts = verified.select(F.col("catalog_id").alias("id"), F.col("verdict").alias("__v"))
    judged = catalogs.join(verdicts, "id", "left").withColumn("verification_status", F.coalesce("__v", "verification_status")).select(*catalogs.columns)
    return judged, store.replace_checks(checks, entries, verdicts.select("id"), fresh), reports.reverified(catalogs, domains, verified)


def entries_of_catalogs(catalogs: DataFrame, entries: DataFrame) -> DataFrame:
    """(catalog_id, entry): the entries of each catalog, those from registries too (D2). One row for each pair, so that no catalog grows into one row; catalogs without entries have a null."""
    return catalogs.select(F.col("id").alias("catalog_id")).join(entries.select("catalog_id", F.struct(*entries.columns).alias("entry")), "catalog_id", "left")


def info(config_path: str, storage_path: str, log_path: str = "") -> dict[str, Any]:
    """Version, paths, whether they exist and how large the storage is; nothing is opened."""
    root = Path(storage_path)
    sizes = [p.stat().st_size for p in ([root] if root.is_file() else root.rglob("*")) if p.is_file()] if root.exists() else []
    return {"version": __version__, "config": config_path, "config_exists": os.path.isfile(config_path), "storage": storage_path, "storage_exists": root.exists(), "storage_bytes": sum(sizes), "log": log_path}


def generate_index(spark: SparkSession, owners: int, entries: int) -> dict[str, DataFrame]:
    """Domains, catalogs and entries of the export's shape, as ranges: entry i is of catalog i % owners + 1 and of one of five types."""
    kinds = F.array(*[F.lit(t) for t in ("application/ai-skill", "application/mcp-server-card+json", "application/a2a-agent-card+json", "application/ai-catalog+json", "text/markdown")])
    i = F.col("id")
    domains = spark.range(1, owners + 1).select("id", F.concat(F.lit("host-"), i, F.lit(".example")).alias("host"))
    catalogs = spark.range(1, owners + 1).select("id", i.alias("domain_id"), F.concat(F.lit("https://host-"), i, F.lit(".example/catalog.json")).alias("source_url"), F.lit("valid").alias("verification_status"))
    host = F.concat(F.lit("host-"), i % owners + 1, F.lit(".example"))
    rows = spark.range(1, entries + 1).select(
        "id", (i % owners + 1).alias("catalog_id"), F.concat(F.lit("urn:air:"), host, F.lit(":gen:item-"), i).alias("urn"), host.alias("urn_publisher"), F.concat(F.lit("Item "), i).alias("display_name"),
        F.get(kinds, (i % 5).cast("int")).alias("media_type"), F.concat(F.lit("https://"), host, F.lit("/items/"), i).alias("ref_url"), F.concat(F.lit('An item & its "description" no. '), i).alias("description"),
        F.lit("1.0.0").alias("version"), F.lit("catalog").alias("source"), F.lit('["a","b"]').alias("tags"), F.lit("").alias("representative_queries"),
    )
    return {"domains": domains, "catalogs": catalogs, "entries": rows}
