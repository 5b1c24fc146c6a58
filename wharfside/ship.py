"""Making the package importable on executors that don't have it on their path."""

from __future__ import annotations

import io
import os
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

from wharfside.scratch import scratch_root

_ROOT = Path(__file__).resolve().parent.parent
_SHIPPED: set[str] = set()


def on_path() -> bool:
    """Whether Python workers find the package by themselves: they start in the driver's folder and inherit PYTHONPATH."""
    paths = [Path.cwd(), *(Path(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p)]
    return any(p.resolve() == _ROOT for p in paths)


def ship(spark: SparkSession) -> None:
    """Give the executors the package once a session, as a zip in the shared folder, unless they find it anyway."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED or on_path():
        return
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted((_ROOT / "wharfside").rglob("*.py")):
            z.write(p, p.relative_to(_ROOT))
    path = f"{scratch_root(spark)}/wharfside-{app}.zip"
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target, True)
    try:
        out.write(data.getvalue())
    finally:
        out.close()
    spark.sparkContext.addPyFile(path)
    _SHIPPED.add(app)
