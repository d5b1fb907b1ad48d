import random
from collections import defaultdict

from pyspark.sql import functions as F

from crawlspan.llm import percentiles as P


def brute(values, permille):
    values = sorted(values)
    return values[max(1, (len(values) * permille + 999) // 1000) - 1]


def test_against_brute_force(spark):
    rnd = random.Random(1)
    rows = [(rnd.choice(["a", "b", None]), f"d{rnd.randrange(3)}", rnd.choice([None, 0, rnd.randrange(100), int(rnd.paretovariate(0.3)) % 2**40, -rnd.randrange(10**6)]), "clash") for _ in range(4000)]
    rows += [("ties", "d1", 7, "")] * 50 + [("one", "d1", -3, "")] + [("nulls", "d1", None, "")]
    df = spark.createDataFrame(rows, "g string, day string, x long, value string").repartition(7)
    by = defaultdict(list)
    for g, _, x, _ in rows:
        if x is not None:
            by[g].append(x)
    wanted = (0, 1, 500, 999, 1000)
    got = {(r.g, r.permille): (r.value, r.n) for r in P.bisect(P.unpivot(df, ["g"], ["x"]), ["g"], wanted).collect()}
    assert got == {(g, p): (brute(v, p), len(v)) for g, v in by.items() for p in wanted}
    for bits in (1, 5, 8):
        parts = P.partials(df, ["g"], F.col("day"), ["x"], bits)
        for r in P.combine(parts, ["g"], wanted, bits).collect():
            true = brute(by[r.g], r.permille)
            assert r.low <= true <= r.high and (r.high - r.low) * 2 ** (bits - 1) <= abs(true)


def test_empty(spark):
    df = spark.createDataFrame([], "g string, x int")
    assert P.bisect(P.unpivot(df, ["g"], ["x"]), ["g"]).collect() == []


def test_all_integers_and_all_group_types(spark):
    rnd = random.Random(3)
    ends = [-(2**63), 2**63 - 1, 2**62, -(2**62) - 1, 0, -1, 1]
    rows = [(rnd.choice([1, None]), rnd.choice([True, False, None]), rnd.choice(["x", "", None]), rnd.choice([*ends, rnd.randrange(-(2**63), 2**63)])) for _ in range(600)]
    df = spark.createDataFrame(rows, "a int, b boolean, c string, x long")
    by = defaultdict(list)
    for *g, x in rows:
        by[tuple(g)].append(x)
    wanted = (0, 10, 500, 990, 1000)
    values = P.unpivot(df, ["a", "b", "c"], ["x"])
    got = {(r.a, r.b, r.c, r.permille): r.value for r in P.bisect(values, ["a", "b", "c"], wanted).collect()}
    assert got == {(*g, p): brute(v, p) for g, v in by.items() for p in wanted}
    for r in P.combine(P.partials(df, ["b"], F.col("a"), ["x"]), ["b"], (0, 500, 1000)).collect():
        true = brute([x for g, v in by.items() if g[1] == r.b for x in v], r.permille)
        assert r.low <= true <= r.high


def test_more_intervals_than_are_broadcast(spark, monkeypatch):
    rnd = random.Random(4)
    rows = [(rnd.choice([0] * 6 + list(range(40)) + [None]), rnd.randrange(10**6)) for _ in range(3000)]
    values = P.unpivot(spark.createDataFrame(rows, "g long, x int"), ["g"], ["x"])
    plain = sorted(map(str, P.bisect(values, ["g"]).collect()))
    monkeypatch.setattr(P, "BROADCAST_MOST", 3)
    monkeypatch.setattr(P.skew, "HOT_PARTS", 8)
    assert sorted(map(str, P.bisect(values, ["g"]).collect())) == plain
