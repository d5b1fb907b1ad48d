import datetime as dt

from pyspark.sql import functions as F

from crawlspan.operators import snapshots as S

SCANS = "scan_id long, project_id long, started_at timestamp_ntz"


def day(n):
    return dt.datetime(2025, 1, n)


def run(spark, records, scans):
    index = S.snapshot_index(spark.createDataFrame(scans, SCANS))
    rows = spark.createDataFrame(records, "record_key string, scan_id long, version int, text string, project_id string")
    rows = rows.select("record_key", "scan_id", "version", S.digest(F.col("text")).alias("value"), "project_id")
    found = S.snapshot_changes(rows, index, by=["record_key"])
    return sorted((r.project_id, r.scan_id, r.record_key, r.change) for r in found.collect())


def test_changes_gaps_and_ties(spark):
    scans = [(30, 1, day(1)), (10, 1, day(2)), (20, 1, day(3)), (40, 1, day(4)), (40, 1, day(4)), (99, 2, day(1))]
    records = [
        ("a", 30, 1, "x", "clash"), ("a", 10, 1, "x", None), ("a", 20, 1, "y", None), ("a", 40, 1, None, None),
        ("gap", 30, 1, "x", None), ("gap", 20, 1, "x", None),  # absent in 10, back in 20, absent in 40
        ("late", 40, 1, "old", None), ("late", 40, 2, "new", None), ("late", 20, 5, "new", None),
        ("null version", 30, None, "b", None), ("null version", 30, None, "a", None), ("null version", 10, 1, "b", None), ("null version", 20, 1, "b", None), ("null version", 40, 1, "b", None),
        (None, 10, 1, "x", None), ("stray", 77, 1, "x", None), ("other", 99, 1, "x", None), ("a", 10, 1, "x", None),
    ]
    assert run(spark, records, scans) == sorted([
        (1, 20, "a", "changed"), (1, 40, "a", "changed"), (1, 10, "gap", "removed"), (1, 20, "gap", "added"), (1, 40, "gap", "removed"), (1, 20, "late", "added"),
    ])


def test_snapshot_without_rows_removes_all(spark):
    assert run(spark, [("a", 1, 1, "x", None)], [(1, 1, day(1)), (2, 1, day(2)), (3, 1, day(3))]) == [(1, 2, "a", "removed")]


def test_empty(spark):
    assert run(spark, [], [(1, 1, day(1))]) == []
    assert run(spark, [("a", 1, 1, "x", None)], []) == []


def test_json_value(spark):
    pairs = [('{"a": 1, "b": [1, 2]}', '{"b":[1,2],"a":1}', True), ('{"a": 1}', '{"a": 2}', False), ('{"a": {"y": 1, "x": 2}}', '{"a":{"x":2,"y":1}}', True), ("oops", " oops ", True), ("[1,2]", "[2,1]", False), ("", "{}", False), ('"é"', '"\\u00e9"', True)]
    df = spark.createDataFrame(pairs, "a string, b string, same boolean")
    assert [r[0] for r in df.select((S.json_value(F.col("a")) == S.json_value(F.col("b"))) == F.col("same")).collect()] == [True] * len(pairs)
    assert spark.range(1).select(S.json_value(F.lit(None).cast("string"))).first()[0] is None
