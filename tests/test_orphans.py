import datetime as dt
import random

import numpy as np
import pyarrow as pa
import pytest

from crawlspan.operators import orphans as O


def at(month, day=1):
    return dt.datetime(2025, month, day)


def test_pack_round_trip():
    for positions in ([], [0], [65535], [1, 5, 9], list(range(0, 65536, 3)), list(range(65536))):
        a = np.array(positions, np.int64)
        assert np.flatnonzero(O.unpack(O.pack(a))).tolist() == positions


def test_reasons(spark):
    ref = "ref_id long, key long, created_at timestamp_ntz, period string, kind string"
    rows = [
        (1, 10, at(3), "x", "y"), (2, 10, at(1), "", ""), (3, 20, at(2), "", ""), (4, 30, at(2), "", ""), (5, None, at(2), "", ""), (6, 20, None, "", ""), (7, 10, None, "", ""),
        (8, 40, at(2, 1), "", ""), (9, 40, at(2, 20), "", ""), (3, 20, at(2), "", ""), (10, -5, at(2), "", ""), (11, 10**12, at(2), "", ""), (12, 50, at(2), "", ""), (13, 10, at(2, 10), "", ""),
    ]
    refs = spark.createDataFrame(rows, ref)
    parents = spark.createDataFrame([(10, at(2, 10)), (40, at(2, 10)), (50, None), (None, at(1)), (10, at(2, 15))], "key long, created_at timestamp_ntz")
    history = spark.createDataFrame([(30,), (None,), (10,)], "key long")
    got = {(r.ref_id, r.reason, r.period) for r in O.orphans([("t", "f", refs)], parents, history).collect()}
    assert got == {(2, "late", "2025-01"), (3, "missing", "2025-02"), (4, "deleted", "2025-02"), (6, "missing", None), (8, "late", "2025-02"), (10, "missing", "2025-02"), (11, "missing", "2025-02")}


def test_empty(spark):
    ref, par = "ref_id long, key long, created_at timestamp_ntz", "key long, created_at timestamp_ntz"
    some, none = spark.createDataFrame([(1, 1, at(1))], ref), spark.createDataFrame([], ref)
    parents, history = spark.createDataFrame([], par), spark.createDataFrame([], "key long")
    assert O.orphans([("a", "f", none)], parents, history).collect() == []
    assert [tuple(r) for r in O.orphans([("a", "f", none), ("b", "g", some)], parents, history).collect()] == [("b", "g", 1, "missing", "2025-01")]


@pytest.mark.parametrize("small", [False, True])
@pytest.mark.parametrize("text", [False, True])
def test_against_brute_force(spark, monkeypatch, small, text):
    """Keys of both types, more keys than a range of numbers has, and keys that hold most rows."""
    if small:
        monkeypatch.setattr(O, "ROWS_AT_ONCE", 50)
        monkeypatch.setattr(O.skew, "HOT_PARTS", 6)
    rnd = random.Random(7)
    name = (lambda k: None if k is None else f"k{k}é") if text else (lambda k: k)
    when = lambda: rnd.choice([None, *[at(m, d) for m in range(1, 7) for d in (1, 15)]])
    keys = lambda: rnd.choice([0, 1, 1, None, *range(40)])
    refs = [[(i, name(keys()), when()) for i in range(400)] for _ in range(2)]
    parents = [(name(k), when()) for k in range(0, 40, 2)] + [(name(4), at(1))]
    history = [(name(k),) for k in range(0, 40, 3)]
    kind = "string" if text else "long"
    got = O.orphans([(t, "f", spark.createDataFrame(r, f"ref_id long, key {kind}, created_at timestamp_ntz")) for t, r in zip("ab", refs, strict=True)], spark.createDataFrame(parents, f"key {kind}, created_at timestamp_ntz"), spark.createDataFrame(history, f"key {kind}"))
    born = {}
    for k, t in parents:
        born[k] = t if k not in born or born[k] is None else min(x for x in (born[k], t) if x is not None)
    want = set()
    for t, rows in zip("ab", refs, strict=True):
        for i, k, seen in rows:
            if k is None:
                continue
            late = k in born and seen is not None and born[k] is not None and born[k] > seen
            if k not in born or late:
                want.add((t, "f", i, "late" if late else "deleted" if (k,) in history else "missing", seen and seen.strftime("%Y-%m")))
    assert {tuple(r) for r in got.collect()} == want


def test_ranges_of_numbers():
    """More distinct keys than one range of numbers has, in one partition."""
    n = O.FULL + 10
    rows = pa.table({"kind": pa.array([0] * n + [O.PARENT] * n, pa.int32()), "period": pa.array([5] * n + [4] * n, pa.int32()), "key": pa.array([*range(n), *range(n)], pa.int64()), "n": pa.array([1] * n + [0] * n, pa.int64()), "born": pa.array([None] * 2 * n, pa.timestamp("us"))})
    keep = pa.array([not (k == O.PARENT and key in (3, O.FULL + 2)) for k, key in zip(rows["kind"].to_pylist(), rows["key"].to_pylist(), strict=True)])
    batches = rows.filter(keep).sort_by("key").to_batches(max_chunksize=1000)
    out = pa.Table.from_batches(O._orphaned(2)(iter(batches))).to_pylist()
    assert [(r["key"], r["reason"]) for r in out] == [(3, "missing"), (O.FULL + 2, "missing")]
