"""Streams: fetched responses feeding crawl steps, and the event log."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from wharfside.plans import crawl
from wharfside.schemas import RESPONSES
from wharfside.scratch import write_table

#: Levels of the event log, lowest first. Fixed values.
LEVELS = ["debug", "info", "warn", "error"]


def arrived(spark: SparkSession, folder: str) -> DataFrame:
    """The responses of all files now in ``folder``; ``arrived`` orders them by the time of their file."""
    rows = spark.read.schema(RESPONSES).parquet(folder)
    return rows.select("*", F.struct("_metadata.file_modification_time", "_metadata.file_path").alias("arrived"))


def crawl_stream(
    spark: SparkSession, folder: str, checkpoint: str, state: crawl.State, cfg: crawl.Config, clock: Callable[[], datetime], keep: Callable[[crawl.State], None],
    registry_pages: Callable[[], DataFrame] | None = None,
) -> StreamingQuery:
    """Crawl steps for each batch of response files that arrives in ``folder``, over all files now there, until no pending item has an answer.

    Only items that can be answered are leased (``crawl.answerable``); the
    others stay pending for a later batch, in whatever order responses come.
    Of several responses of a URL the newest holds. ``registry_pages`` gives
    the pages known at a batch; without it registries stay pending. ``keep``
    gets every new state.

    A batch that is run again after a failure, or a query started with the
    state that ``keep`` last got, goes on from there: items closed in it
    aren't leased again, so nothing is stored twice.
    """
    held = {"state": state}

    def hold(new: crawl.State) -> None:
        held["state"] = new
        keep(new)

    def run(batch: DataFrame, _: int) -> None:
        answers = write_table(crawl.newest(arrived(batch.sparkSession, folder)), "answers")
        crawl.drain(held["state"], answers, clock, cfg, registry_pages() if registry_pages else None, hold)

    rows = spark.readStream.schema(RESPONSES).parquet(folder)
    return rows.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def probe_events(probes: DataFrame) -> DataFrame:
    """One event (ts, level, event, detail) for each miss or error of a probe."""
    return probes.filter("outcome <> 'hit'").select(
        F.col("probed_at").alias("ts"), F.when(F.col("outcome") == "error", "warn").otherwise("info").alias("level"), F.concat(F.lit("probe_"), F.col("outcome")).alias("event"),
        F.concat_ws(" ", "method", "url", F.nullif("error_detail", F.lit(""))).alias("detail"),
    )


def catalog_events(catalogs: DataFrame, summaries: DataFrame) -> DataFrame:
    """One event (ts, level, event, detail) for each verified catalog, with what failed (catalog_id, summary)."""
    told = catalogs.join(summaries.withColumnRenamed("catalog_id", "id"), "id", "left")
    bad = F.col("verification_status") == "invalid"
    return told.select(
        F.col("fetched_at").alias("ts"), F.when(bad, "warn").otherwise("info").alias("level"), F.lit("catalog_verified").alias("event"),
        F.concat_ws(" ", "source_url", "verification_status", F.nullif(F.coalesce("summary", F.lit("")), F.lit(""))).alias("detail"),
    )


def at_least(level: Column, least: str) -> Column:
    """Whether an event's level is ``least`` or higher; unknown levels count as info."""
    rank = F.array_position(F.array(*[F.lit(x) for x in LEVELS]), F.lower(level))
    return F.when(rank > 0, rank).otherwise(F.lit(2)) >= LEVELS.index(least) + 1


def append_events(events: DataFrame, path: str, least: str = "info") -> None:
    """Append events as JSON lines."""
    events.filter(at_least(F.col("level"), least)).write.mode("append").json(path)
