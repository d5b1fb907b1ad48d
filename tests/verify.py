"""Compares queries with their SQL in DuckDB: python tests/verify.py [--sf DIR] [NAME...]. Prints one line for each query."""

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb

import __spark_entry__ as entry


def session(cores: str = "8"):
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master(f"local[{cores}]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def plain(x):
    if isinstance(x, (list, tuple)):
        return tuple(plain(y) for y in x)
    if isinstance(x, dict):
        return tuple(sorted((k, plain(v)) for k, v in x.items()))
    if isinstance(x, float):
        return round(x, 9)
    if hasattr(x, "asDict"):
        return plain(list(x))
    if x.__class__.__name__ == "Decimal":
        return float(x)
    return x


def compare(spark, con, base: str, name: str, sql: str | None) -> tuple[bool, str]:
    began = time.time()
    df = entry.queries()[name](spark, base)
    columns = sorted(df.columns)
    got = [tuple(plain(r[c]) for c in columns) for r in df.collect()]
    took = time.time() - began
    spark.catalog.clearCache()
    if sql is None:
        return True, f"{len(got)} rows, no SQL, {took:.1f} s"
    rel = con.sql(sql)
    names = rel.columns
    if sorted(names) != columns:
        return False, f"columns {columns} against {sorted(names)}"
    at = [names.index(c) for c in columns]
    want = [tuple(plain(r[i]) for i in at) for r in rel.fetchall()]
    from collections import Counter

    a, b = Counter(map(repr, got)), Counter(map(repr, want))
    if a == b:
        return True, f"{len(got)} rows equal, {took:.1f} s"
    return False, f"{len(got)} against {len(want)} rows; only here {list((a - b).items())[:3]}; only in SQL {list((b - a).items())[:3]}"


def connect(base: str):
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for f in sorted(os.listdir(base)):
        if f.endswith(".parquet"):
            path = f"{base}/{f}"
            con.sql(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


if __name__ == "__main__":
    args = sys.argv[1:]
    base = "/root/testdata/sf0.01"
    if args[:1] == ["--sf"]:
        base, args = args[1], args[2:]
    spark, con, sql = session(), connect(base), entry.oracle_sql()
    names = [n for n in entry.queries() if not args or any(n == a or n.startswith(a) for a in args)]
    bad = 0
    for n in names:
        try:
            ok, said = compare(spark, con, base, n, sql.get(n))
        except Exception as e:  # noqa: BLE001
            ok, said = False, f"{type(e).__name__}: {str(e)[:1500]}"
        bad += not ok
        print("ok  " if ok else "FAIL", n, said, flush=True)
    print(f"{len(names) - bad} of {len(names)} fine")
    sys.exit(bool(bad))
