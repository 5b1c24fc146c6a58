"""Written intermediate tables.

Lineage is cut by writing Parquet into the folder that the cluster names in
``spark.checkpoint.dir``; every executor can read it again after another one
is lost. Only where that setting is absent (tests on one machine) a temporary
folder is used.
"""

from __future__ import annotations

import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

_LOCAL: list[str] = []
#: The folders of each table scan that this module has returned and that is still in use.
_WRITTEN: dict[int, tuple[weakref.ref, list[str]]] = {}


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of the session."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not _LOCAL:
        _LOCAL.append("file://" + tempfile.mkdtemp(prefix="wharfside-"))
    return _LOCAL[0]


def write_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once and return it as a scan of the written files."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/tables/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return _scan(spark, df.schema, [path])


def append_table(present: DataFrame, fresh: DataFrame, name: str) -> DataFrame:
    """A table with the rows of ``fresh``, which has its columns, written beside what it has: nothing is written twice.

    ``present`` comes from this function or ``write_table``; any other table is written once, whole.
    """
    spark = present.sparkSession
    if not (paths := _WRITTEN.get(id(present), (None, None))[1]) or _WRITTEN[id(present)][0]() is not present:
        return write_table(present.unionByName(fresh), name)
    path = f"{scratch_root(spark)}/tables/{name}-{uuid.uuid4().hex}"
    fresh.write.parquet(path)
    return _scan(spark, present.schema, [*paths, path])


def _scan(spark: SparkSession, schema: StructType, paths: list[str]) -> DataFrame:
    df = spark.read.schema(schema).parquet(*paths)
    _WRITTEN[id(df)] = (weakref.ref(df, lambda _, key=id(df): _WRITTEN.pop(key, None)), paths)
    return df


def finished_tables(spark: SparkSession, folder: str) -> list[str]:
    """Paths of the tables below ``folder`` whose writing has ended; none when there is no such folder."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(folder)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return []
    below = [s.getPath() for s in fs.listStatus(root) if s.isDirectory()]
    return sorted(p.toString() for p in below if fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))
