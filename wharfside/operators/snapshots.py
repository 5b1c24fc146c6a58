"""Problem 5 over a kept table: full snapshots stored by key range, merged with their neighbours.

Method: the records of every snapshot are kept, whole, range-partitioned and
sorted by key, each snapshot in a partition of its own. Ranges are equal
intervals of the key's 64-bit hash, the same for all snapshots, so they need
no sampling and hold about the same number of keys. A range is a bucket of the
kept table: comparing snapshots reads the ranges where they lie, without a
shuffle, and streams through each in key order; neighbouring records of one
key are the two pointers, and their columns are compared themselves. A new
snapshot costs one shuffle of its own records and one pass over itself and its
predecessor, however long the history is.
"""

from __future__ import annotations

import hashlib
import time
import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wharfside.scratch import scratch_root
from wharfside.skew import HOT_LEAST
from wharfside.tables import EXPORT_FIELDS

#: Compared columns of the export. Fixed values.
COMPARED = [c for c in EXPORT_FIELDS if c not in ("host", "urn")]
#: Records of the first snapshot for each file of a new store, and the fewest files.
RECORDS_A_BUCKET, LEAST_BUCKETS = 4_000_000, 8
#: Key ranges in each file.
RANGES_A_BUCKET = 8
#: Keys looked at as possibly hot, and items the sketch that finds them keeps.
HOT_KEYS, SKETCH_ITEMS = 1024, 16_384
CHANGES = "snapshot_id bigint, owner string, urn string, change_kind string, changed_fields bigint"
_MANIFEST = "seq bigint, kept_as string, n bigint, mark string, buckets int, at double"
_SORT = ["range_no", "h", "owner", "urn"]


@dataclass
class Store:
    """A kept table of snapshots at ``path``; ``kept`` has of each snapshot number its version, size and mark."""

    spark: SparkSession
    path: str
    buckets: int = 0
    kept: dict[int, tuple[str, int, str]] = field(default_factory=dict)

    @property
    def name(self) -> str:
        return "wharfside_snapshots_" + hashlib.md5(f"{self.path}#{self.buckets}".encode()).hexdigest()[:16]

    def table(self) -> DataFrame:
        """The kept table, bucketed; made known to the session's catalog where it isn't yet."""
        place = f"{self.path}/records-{self.buckets}"
        _file_system(self.spark, place)[0].mkdirs(_file_system(self.spark, place)[1])
        if not self.spark.catalog.tableExists(self.name):
            columns = ", ".join(f"`{c}` {t}" for c, t in _columns())
            self.spark.sql(
                f"CREATE TABLE {self.name} ({columns}) USING parquet PARTITIONED BY (seq, kept_as) CLUSTERED BY (range_no) SORTED BY ({', '.join(_SORT)}) INTO {self.buckets} BUCKETS LOCATION '{place}'"
            )
        self.spark.sql(f"MSCK REPAIR TABLE {self.name}")
        return self.spark.table(self.name)


def _columns() -> list[tuple[str, str]]:
    return [("range_no", "int"), ("h", "bigint"), ("owner", "string"), ("urn", "string"), *[(c, "string") for c in COMPARED], ("seq", "bigint"), ("kept_as", "string")]


def _file_system(spark: SparkSession, path: str):  # noqa: ANN202
    """The file system of a path, and the path, as the cluster knows them."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def open_store(spark: SparkSession, path: str) -> Store:
    """The store at ``path``; empty where nothing is kept yet."""
    store = Store(spark, path.rstrip("/"))
    files, at = _file_system(spark, f"{path}/manifest")
    if files.exists(at):
        rows = spark.read.schema(_MANIFEST).json(f"{path}/manifest").filter("seq IS NOT NULL")
        for r in rows.groupBy("seq").agg(F.max_by(F.struct("kept_as", "n", "mark", "buckets"), "at").alias("m")).collect():  # one row for each snapshot
            store.kept[r.seq] = (r.m.kept_as, r.m.n, r.m.mark)
            store.buckets = r.m.buckets
    return store


def _key_hash() -> Column:
    return F.xxhash64("host", "urn")


def keep(store: Store, rows: DataFrame, only: list[int] | None = None) -> list[int]:
    """Keep the snapshots of ``rows`` (the export's columns) that the store lacks or that have changed since; their numbers.

    Of several rows of one key in one snapshot the latest delivered_at holds,
    of equal ones the highest row_id. Rows without snapshot number are in no
    snapshot. One pass tells which snapshots are new, by their number of rows
    and the sum of their rows' hashes, and which keys are hot; one shuffle
    brings the records to their ranges. Rows of hot keys are combined before it.
    """
    rows = rows.filter("snapshot_no IS NOT NULL")
    if only is not None:
        rows = rows.filter(F.col("snapshot_no").isin(only))
    mark = F.sum(F.xxhash64("row_id", "delivered_at").cast("decimal(38,0)")).cast("string")
    top = F.expr(f"approx_top_k(xxhash64(host, urn), {HOT_KEYS}, {SKETCH_ITEMS})")
    seen = rows.groupBy(F.col("snapshot_no").cast("long").alias("seq")).agg(F.count(F.lit(1)).alias("n"), mark.alias("mark"), top.alias("top")).collect()  # one row for each snapshot
    fresh = [r for r in seen if store.kept.get(r.seq, ("", -1, ""))[1:] != (r.n, r.mark)]
    if not fresh:
        return []
    if not store.buckets:
        store.buckets = max(LEAST_BUCKETS, -(-fresh[0].n // RECORDS_A_BUCKET))
    hot = sorted({x.item for r in fresh for x in r.top if x["count"] > HOT_LEAST})
    version = uuid.uuid4().hex
    values = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in COMPARED]
    lean = rows.filter(F.col("snapshot_no").isin([r.seq for r in fresh])).select(
        F.col("snapshot_no").cast("long").alias("seq"), _key_hash().alias("h"), F.col("host").alias("owner"), "urn", "delivered_at", "row_id", *values
    )
    if hot:
        is_hot = F.col("h").isin(hot)
        newest = F.max(F.struct("delivered_at", "row_id", *COMPARED)).alias("v")
        lean = lean.filter(~is_hot).unionByName(lean.filter(is_hot).groupBy("seq", "h", "owner", "urn").agg(newest).select("seq", "h", "owner", "urn", "v.*"))
    ranges = store.buckets * RANGES_A_BUCKET
    range_no = F.floor((F.shiftright("h", 32) + F.lit(2**31)) * F.lit(ranges) / F.lit(2**32)).cast("int")
    latest = Window.partitionBy("range_no", "seq", "h", "owner", "urn").orderBy(F.col("delivered_at").desc(), F.col("row_id").desc())
    placed = lean.withColumn("range_no", range_no).repartition(store.buckets, "range_no").withColumn("__n", F.row_number().over(latest)).filter("__n = 1")
    placed = placed.withColumn("kept_as", F.lit(version)).select(*[c for c, _ in _columns()])
    store.table()
    placed.write.mode("append").partitionBy("seq", "kept_as").bucketBy(store.buckets, "range_no").sortBy(*_SORT).saveAsTable(store.name)
    told = [(r.seq, version, r.n, r.mark, store.buckets, time.time()) for r in fresh]
    store.spark.createDataFrame(told, _MANIFEST).coalesce(1).write.mode("append").json(f"{store.path}/manifest")
    for seq, v, n, m, *_ in told:
        store.kept[seq] = (v, n, m)
    return sorted(r.seq for r in fresh)


def compare(store: Store, since: int | None = None, upto: int | None = None) -> DataFrame:
    """Typed changes (CHANGES) of the snapshots ``since`` to ``upto`` against their predecessors; by default of all kept ones but the first.

    Only the partitions of these snapshots and of the one before are read. A
    number that no row has between the first and the last is an empty
    snapshot. Keys are (owner, urn), exact, null being a key of its own. Bit i
    of changed_fields tells that the i-th compared column differs; it is null
    for added and removed records.
    """
    if not store.kept:
        return store.spark.createDataFrame([], CHANGES)
    first, last = min(store.kept), max(store.kept)
    low, high = max(first, (since if since is not None else first + 1) - 1), min(last, upto if upto is not None else last)
    wanted = F.lit(False)
    for seq, (version, *_) in store.kept.items():
        if low <= seq <= high:
            wanted = wanted | ((F.col("seq") == seq) & (F.col("kept_as") == version))
    key = Window.partitionBy(*_SORT).orderBy("seq")
    values = F.struct(*COMPARED)
    near = store.table().filter(wanted).select(
        *_SORT, "seq", values.alias("now"), F.lag("seq").over(key).alias("seq_before"), F.lead("seq").over(key).alias("seq_after"), F.lag(values).over(key).alias("before")
    )
    follows = F.col("seq_before") == F.col("seq") - 1
    mask = F.lit(0).cast("long")
    for i, c in enumerate(COMPARED):
        mask = mask + F.when(F.col(f"now.{c}") != F.col(f"before.{c}"), 1 << i).otherwise(0)
    near = near.withColumn("mask", F.when(follows, mask))
    change = lambda at, kind, fields: F.struct(at.alias("snapshot_id"), F.lit(kind).alias("change_kind"), fields.cast("long").alias("changed_fields"))
    none = F.lit(None)
    arrived = F.when((F.col("seq") > low) & ~F.coalesce(follows, F.lit(False)), change(F.col("seq"), "added", none)).when(F.col("mask") > 0, change(F.col("seq"), "changed", F.col("mask")))
    gone = F.when((F.col("seq") < high) & ~F.coalesce(F.col("seq_after") == F.col("seq") + 1, F.lit(False)), change(F.col("seq") + 1, "removed", none))
    return near.select("owner", "urn", F.explode(F.array_compact(F.array(arrived, gone))).alias("c")).select("c.snapshot_id", "owner", "urn", "c.change_kind", "c.changed_fields")


def export_changes(rows: DataFrame, path: str | None = None) -> DataFrame:
    """Changes between consecutive export snapshots of ``rows``, through the store at ``path`` or one of their own.

    An empty table gives no changes; extra columns are not read. See ``keep`` and ``compare``.
    """
    spark = rows.sparkSession
    store = open_store(spark, path or f"{scratch_root(spark)}/tables/snapshots-{uuid.uuid4().hex}")
    keep(store, rows)
    return compare(store)
