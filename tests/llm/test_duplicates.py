import random

import pytest

from crawlspan.llm import duplicates as D

SCHEMA = "pid long, g long, t string, m string, copies string"
OPTIONS = {"group": "g", "first": "t", "second": "m", "id": "pid"}


@pytest.mark.parametrize("hot", [False, True])
def test_copies(spark, monkeypatch, hot):
    if hot:
        monkeypatch.setattr(D.skew, "HOT_PARTS", 3)
    rows = [
        (5, 1, "Café  Chair", "Nice & new"), (3, 1, "CAFÉ chair!", "nice &amp; NEW"), (9, 1, "nice-new", "c&#97;f&eacute;­ chair"), (4, 1, "Cafe chair", "nice new"), (2, 2, "café chair", "nice new"),
        (6, 1, None, "nice new"), (7, 1, "...", "nice new"), (8, 1, "", ""), (10, None, "a", "b"), (11, None, "B", "A"), (5, 1, "Café  Chair", "Nice & new"), (None, 1, "café chair", "nice new"), (12, 1, "x" * 100_000, "straße"), (13, 1, "X" * 100_000, "STRASSE"),
    ]
    df = spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA)
    assert {tuple(r) for r in D.copies(df, **OPTIONS).collect()} == {(3, 5), (3, 9), (10, 11), (12, 13)}
    got = {r.pid: (r.g, r.copies) for r in D.collapse(df, **OPTIONS).collect()}
    assert got == {3: (1, 4), 4: (1, 1), 2: (2, 1), 10: (None, 2), 12: (1, 2)}
    assert D.copies(df.limit(0), **OPTIONS).collect() == [] and D.collapse(df.limit(0), **OPTIONS).collect() == []


def test_one_hot_group(spark, monkeypatch):
    monkeypatch.setattr(D.skew, "HOT_PARTS", 10)
    rnd = random.Random(2)
    rows = [(i, 1, rnd.choice(["A b", "a-B", "a  b."]), "c", "") for i in range(1000)] + [(i, 1, f"t{i // 2}", "d", "") for i in range(1000, 1400)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(6)
    got = [tuple(r) for r in D.copies(df, **OPTIONS).collect()]
    assert sorted(got) == sorted([(0, i) for i in range(1, 1000)] + [(i, i + 1) for i in range(1000, 1400, 2)])
    assert sorted(r.copies for r in D.collapse(df, **OPTIONS).collect()) == [2] * 200 + [1000]


def test_hot_copies_are_salted(spark, capsys):
    rows = [(i, 1, "Oak lamp", "A lamp") for i in range(20, 8, -1)] + [(i, 1, "Pan", f"{i // 2}") for i in range(30, 34)]
    found = D.copies(spark.createDataFrame(rows, "i long, g int, t string, m string"), group="g", first="t", second="m", id="i")
    found.explain()
    assert "xxhash64" in capsys.readouterr().out
    assert {tuple(r) for r in found.collect()} == {(9, i) for i in range(10, 21)} | {(30, 31), (32, 33)}
