"""The work frontier as a table of snapshots: every operator is a function of the present snapshot.

Columns used: id, run_id, kind, url, host, depth, priority, status, attempts,
last_error, dedup_key, host_shard, leased_until, worker_id, updated_at; others
are carried along.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wharfside.functions.hosts import dedup_key, fetch_host, host_shard
from wharfside.skew import numbered, rank_in_group

PENDING, IN_FLIGHT, DONE, FAILED = "pending", "in_flight", "done", "failed"
#: Seconds of a lease, attempts of a transient failure. Fixed values.
LEASE_SECONDS, ATTEMPTS = 600, 3
SCHEMA = (
    "id bigint, run_id bigint, kind string, url string, host string, depth int, priority int, status string, attempts int, last_error string, dedup_key string, "
    "host_shard int, parent_catalog_id bigint, registry_row_id bigint, artifact_entry_id bigint, leased_until timestamp, worker_id string, updated_at timestamp"
)
#: Columns that a new enqueue of a finished item takes over.
_ADOPTED = ["run_id", "depth", "priority", "parent_catalog_id", "registry_row_id", "artifact_entry_id"]


def items(found: DataFrame) -> DataFrame:
    """Work items (kind, url, host, depth, ...) with their key and shard; a host probe is keyed by host, others by URL."""
    natural = F.when(F.col("kind") == "host_probe", F.col("host")).otherwise(F.col("url"))
    return found.withColumn("dedup_key", dedup_key(F.col("kind"), natural)).withColumn("host_shard", host_shard(fetch_host(F.col("url"), F.col("host"))))


def _release(now: Column) -> dict[str, Column]:
    """Every way out of in_flight clears the lease."""
    return {"leased_until": F.lit(None).cast("timestamp"), "worker_id": F.lit(""), "updated_at": now}


def update(frontier: DataFrame, where: Column, changes: Mapping[str, Column]) -> DataFrame:
    """The snapshot with ``changes`` in the rows that meet ``where``; null counts as not met."""
    hit = F.coalesce(where, F.lit(False))
    return frontier.withColumns({c: F.when(hit, v).otherwise(F.col(c)) for c, v in changes.items()})


def _marked(frontier: DataFrame, ids: DataFrame) -> DataFrame:
    """``frontier`` with __hit for the rows whose id is in ``ids``."""
    return frontier.join(ids.select("id").distinct().withColumn("__hit", F.lit(True)), "id", "left")


def enqueue(frontier: DataFrame, incoming: DataFrame, now: Column, budget: int = -1) -> DataFrame:
    """Merge new items into the frontier.

    ``incoming`` has the item columns, dedup_key and seq, which orders it. Of
    several items of one key the first counts. A key that is new becomes a
    pending row; a done or failed one is pending again with no attempts and
    adopts run, depth, priority and provenance; a pending or in_flight one stays.
    With a ``budget`` of 0 or more, new keys are taken only while their host
    and kind have fewer rows (of any status); re-activation is free.
    """
    first = incoming.groupBy("dedup_key").agg(F.min_by(F.struct(*[c for c in incoming.columns if c != "dedup_key"]), "seq").alias("n")).select("dedup_key", "n.*")
    again = first.select("dedup_key", *[F.col(c).alias(f"__{c}") for c in _ADOPTED if c in first.columns]).withColumn("__in", F.lit(True))
    kept = frontier.join(again, "dedup_key", "left")
    finished = F.col("status").isin(DONE, FAILED) & F.col("__in")
    changes = {"status": F.lit(PENDING), "attempts": F.lit(0), "last_error": F.lit(""), **_release(now)}
    changes |= {c: F.col(f"__{c}") for c in _ADOPTED if c in first.columns and c in frontier.columns}
    kept = kept.withColumn("__finished", finished)
    kept = update(kept, F.col("__finished"), changes).select(*frontier.columns)
    fresh = first.join(frontier.select("dedup_key"), "dedup_key", "left_anti")
    if budget >= 0:
        used = frontier.groupBy("host", "kind").agg(F.count(F.lit(1)).alias("__used"))
        ranked = rank_in_group(fresh, ["host", "kind"], ["seq", "dedup_key"], "__rank", "budget").filter(F.col("__rank") <= budget).join(used, ["host", "kind"], "left")
        fresh = ranked.filter(F.col("__rank") + F.coalesce("__used", F.lit(0)) <= budget).drop("__rank", "__rank_size", "__used")
    return kept.unionByName(number(fresh_rows(fresh, frontier, now), frontier))


def fresh_rows(fresh: DataFrame, frontier: DataFrame, now: Column) -> DataFrame:
    """Rows of new items in the frontier's columns; seq is kept for numbering."""
    fixed = {"status": F.lit(PENDING), "attempts": F.lit(0), "last_error": F.lit(""), **_release(now)}
    columns = []
    for f in frontier.schema.fields:
        if f.name == "id":
            value = F.lit(None)
        elif f.name in fixed:
            value = fixed[f.name]
        elif f.name in fresh.columns:
            value = F.col(f.name)
        else:
            value = F.lit(0) if f.name == "priority" else F.lit(None)
        columns.append(value.cast(f.dataType).alias(f.name))
    return fresh.select(*columns, "seq")


def number(fresh: DataFrame, frontier: DataFrame) -> DataFrame:
    """Ids for new rows: their rank by seq after the highest id. Ranks are dealt out in range parts, not in one task."""
    top = frontier.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    ranked = numbered(fresh, ["seq", "dedup_key"], "__rank")
    return ranked.withColumn("id", F.col("__rank") + F.lit(top)).select(*frontier.columns)


def ready(frontier: DataFrame, shard: tuple[int, int] | None = None, only: DataFrame | None = None) -> DataFrame:
    """The pending items, of one part of the hosts (index, count) and among ``only`` (id) where given."""
    out = frontier.filter(F.col("status") == PENDING)
    if shard and shard[1] > 1:
        out = out.filter(F.col("host_shard") % shard[1] == shard[0])
    return out if only is None else out.join(only.select("id"), "id", "left_semi").select(*frontier.columns)


def dequeue(frontier: DataFrame, n: int, now: Column, worker: str = "", lease_seconds: int = LEASE_SECONDS, shard: tuple[int, int] | None = None, only: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(leased items, next snapshot): the first n pending items by priority (highest first) and id.

    ``shard`` (index, count) restricts to one part of the hosts; a count of 1
    or less doesn't. ``only`` (id) restricts to these items. A lease of 0 seconds or less has no end. n bounds what is broadcast.
    """
    taken = ready(frontier, shard, only).orderBy(F.col("priority").desc(), "id").limit(n)
    until = now + F.make_interval(secs=F.lit(lease_seconds)) if lease_seconds > 0 else F.lit(None).cast("timestamp")
    changes = {"status": F.lit(IN_FLIGHT), "leased_until": until, "worker_id": F.lit(worker), "updated_at": now}
    hit = frontier.join(F.broadcast(taken.select("id").withColumn("__hit", F.lit(True))), "id", "left")
    after = update(hit, F.col("__hit"), changes).select(*frontier.columns)
    return update(taken, F.lit(True), changes), after


def _mine(worker: str | None) -> Column:
    held = F.col("__hit") & (F.col("status") == IN_FLIGHT)
    return held if worker is None else held & (F.col("worker_id") == worker)


def complete(frontier: DataFrame, ids: DataFrame, now: Column, worker: str | None = None) -> DataFrame:
    """in_flight items of this worker to done; others stay."""
    return update(_marked(frontier, ids), _mine(worker), _release(now) | {"status": F.lit(DONE)}).select(*frontier.columns)


def fail(frontier: DataFrame, errors: DataFrame, now: Column, most: int = ATTEMPTS, worker: str | None = None) -> DataFrame:
    """Count an attempt of the items in ``errors`` (id, error, permanent): failed at ``most`` or when permanent, else pending again."""
    one = errors.groupBy("id").agg(F.max("error").alias("__error"), F.max("permanent").alias("__permanent")).withColumn("__hit", F.lit(True))
    tries = F.col("attempts") + 1
    over = (tries >= most) | F.coalesce("__permanent", F.lit(False))
    marked = frontier.join(one, "id", "left").withColumn("__mine", _mine(worker)).withColumn("__tries", tries)
    changes = _release(now) | {"attempts": F.col("__tries"), "last_error": F.col("__error"), "status": F.when(over, FAILED).otherwise(PENDING)}
    ordered = {c: changes[c] for c in ("status", "attempts", "last_error", "leased_until", "worker_id", "updated_at")}
    return update(marked, F.col("__mine"), ordered).select(*frontier.columns)


def requeue(frontier: DataFrame, ids: DataFrame, now: Column, worker: str | None = None) -> DataFrame:
    """in_flight items back to pending, attempts untouched."""
    return update(_marked(frontier, ids), _mine(worker), _release(now) | {"status": F.lit(PENDING)}).select(*frontier.columns)


def reclaim(frontier: DataFrame, now: Column, expired_only: bool = True) -> DataFrame:
    """in_flight items whose lease is over, or all of them, to pending."""
    where = F.col("status") == IN_FLIGHT
    if expired_only:
        where = where & (F.col("leased_until") < now)
    return update(frontier, where, _release(now) | {"status": F.lit(PENDING)})


def counts(frontier: DataFrame) -> DataFrame:
    """One row (pending, in_flight), of one snapshot."""
    return frontier.agg(F.count_if(F.col("status") == PENDING).alias("pending"), F.count_if(F.col("status") == IN_FLIGHT).alias("in_flight"))


def by_host_and_kind(frontier: DataFrame) -> DataFrame:
    """(host, kind, n) over all statuses."""
    return frontier.groupBy("host", "kind").agg(F.count(F.lit(1)).alias("n"))


def latest(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last row of each key by ``order``, combined before the shuffle."""
    rest = [c for c in df.columns if c not in key]
    return df.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("__l")).select(*key, "__l.*")


def ownership(frontier: DataFrame, ids: DataFrame, worker: str) -> DataFrame:
    """(id, outcome) of items that ``worker`` wants to close: 'held', 'lease_lost' or 'not_found' (C9)."""
    asked = ids.select("id").distinct()
    joined = asked.join(frontier.select("id", "status", "worker_id"), "id", "left")
    held = (F.col("status") == IN_FLIGHT) & (F.col("worker_id") == worker)
    return joined.select("id", F.when(F.col("status").isNull(), "not_found").when(held, "held").otherwise("lease_lost").alias("outcome"))


def due_times(items: DataFrame, now: Column, per_second: float = 1.0) -> DataFrame:
    """``items`` with not_before: fetches of one host follow each other at ``per_second``, the first at ``now`` (L3).

    A token bucket of one token written as a schedule; each item's turn is its
    rank within its host, dealt out in range parts, so a host with very many
    items is no task of its own.
    """
    ranked = rank_in_group(items.withColumn("__h", fetch_host(F.col("url"), F.col("host"))), ["__h"], ["id"], "__turn", "turns")
    wait = F.make_interval(secs=((F.col("__turn") - 1) / per_second).cast("decimal(18,6)"))
    return ranked.withColumn("not_before", now + wait).drop("__h", "__turn", "__turn_size")


def shared_hosts(frontier: DataFrame) -> DataFrame:
    """(host, workers): hosts whose items several workers hold or held."""
    return frontier.filter("worker_id <> ''").groupBy("host").agg(F.count_distinct("worker_id").alias("workers")).filter("workers > 1")
