"""Joins and numbering that stay balanced when one key holds a third of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wharfside.scratch import write_table

#: A key is hot when it holds more than 1/HOT_PARTS of all rows, so there are never more hot keys than this.
HOT_PARTS = 1024
#: Below this many rows a key is never hot.
HOT_LEAST = 20_000


def join_unique(rows: DataFrame, dim: DataFrame, on: list[str], count: str) -> DataFrame:
    """Inner-join ``rows`` with ``dim``, which has one row per key and, in ``count``, the key's rows in ``rows``.

    Hot keys are at most HOT_PARTS, so their part of ``dim`` is broadcast and
    their rows never move; all others go through an ordinary shuffle join, in
    which no key can dominate a task. Both inputs are read more than once and
    should be written tables. Rows with a null in ``on`` find no partner.
    """
    total, most = dim.agg(F.sum(count), F.max(count)).first()
    limit = max((total or 0) // HOT_PARTS, HOT_LEAST)
    if (most or 0) <= limit:
        return rows.join(dim.drop(count), on)
    hot = F.broadcast(dim.filter(F.col(count) > limit).drop(count))
    cold = dim.filter(F.col(count) <= limit).drop(count)
    return rows.join(hot, on).unionByName(rows.join(hot.select(*on), on, "left_anti").join(cold, on))


def rank_in_group(rows: DataFrame, group: list[str], order: list[str], out: str = "rank", name: str = "ranked") -> DataFrame:
    """Number the rows of each group from 1 in ``order`` without putting a group into one task.

    Rows are range-partitioned by group and order; each part numbers its own
    share, and the part sizes (one row per part and group that part touches)
    give the offsets. Also adds ``<out>_size``, the group's number of rows. Nulls in group or order
    count as one value, first in order. ``order`` should be total.
    """
    part = write_table(
        rows.repartitionByRange(*[F.col(c) for c in [*group, *order]]).withColumn("__part", F.spark_partition_id()), name
    )
    sizes = part.groupBy(*group, "__part").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*group)
    # A group has at most one row here per range part, so this window is bounded by the number of parts.
    offsets = sizes.select(
        *[F.col(c).alias(f"__g{i}") for i, c in enumerate(group)],
        F.col("__part").alias("__p"),
        F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__off"),
        F.sum("__n").over(whole).alias(f"{out}_size"),
    )
    inside = Window.partitionBy(*group, "__part").orderBy(*order)
    same: Column = F.col("__part") == F.col("__p")
    for i, c in enumerate(group):
        same = same & F.col(c).eqNullSafe(F.col(f"__g{i}"))
    return (
        part.withColumn(out, F.row_number().over(inside).cast("long"))
        .join(offsets, same)
        .withColumn(out, F.col(out) + F.col("__off"))
        .drop("__part", "__p", "__off", *[f"__g{i}" for i in range(len(group))])
    )


def numbered(rows: DataFrame, order: list[str], out: str = "rank", name: str = "numbered") -> DataFrame:
    """Number all rows from 1 in ``order``, which should be total, with one shuffle.

    Rows are range-partitioned and sorted; each gets its place in its part in
    the stage that writes it. The parts' sizes, one number for each, then give
    every part its first number.
    """
    placed = rows.repartitionByRange(*[F.col(c) for c in order]).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
    part = write_table(placed, name)
    number = F.shiftright("__at", 33)
    sizes = sorted((r.p, r.n) for r in part.groupBy(number.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect())  # one row for each part
    first, starts = 1, []
    for p, n in sizes:
        starts.append((p, first))
        first += n
    # One row for each part of the shuffle: a proven bound for the broadcast.
    begins = F.broadcast(rows.sparkSession.createDataFrame(starts, "__p bigint, __first bigint"))
    place = F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    return part.join(begins, number == F.col("__p")).withColumn(out, F.col("__first") + place).drop("__at", "__p", "__first")
