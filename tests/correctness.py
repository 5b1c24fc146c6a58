"""Compare registered queries with their SQL: python tests/correctness.py FOLDER [NAME...]"""

from __future__ import annotations

import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


def rows(frame) -> tuple[list[str], list[str], list[str]]:  # noqa: ANN001
    names = sorted(frame.columns)
    kinds = [str(frame[c].dtype) for c in names]
    return names, kinds, sorted(repr(tuple(None if v != v or v is None else v for v in r)) for r in frame[names].astype(object).itertuples(index=False, name=None))


def main(folder: str, only: list[str]) -> int:
    import duckdb
    from pyspark.sql import SparkSession

    import __spark_entry__ as e

    spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "8g").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    for p in Path(folder).iterdir():
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'" if p.is_file() else f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}/*.parquet'")
    bad = 0
    oracles = e.oracle_sql()
    for name, q in e.queries().items():
        if only and name not in only or not only and name not in oracles:
            continue
        try:
            got = rows(q(spark, folder).toPandas())
            if name not in oracles:
                print("ran ", name, len(got[2]))
                continue
            want = rows(con.sql(oracles[name]).df())
        except Exception as x:  # noqa: BLE001
            print("FAIL", name, str(x)[:600])
            bad += 1
            continue
        if got[0] != want[0] or got[2] != want[2]:
            bad += 1
            a, b = set(got[2]), set(want[2])
            print("DIFF", name, got[0], want[0], len(got[2]), len(want[2]), list(a - b)[:2], list(b - a)[:2])
        else:
            print("ok  ", name, len(got[2]), "" if got[1] == want[1] else f"types {got[1]} {want[1]}")
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1], sys.argv[2:]))
