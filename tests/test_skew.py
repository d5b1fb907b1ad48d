import pytest

from crawlspan.operators import skew


@pytest.mark.parametrize("parts", [1, 3, 1000])
def test_same_as_a_plain_join(spark, monkeypatch, parts):
    monkeypatch.setattr(skew, "HOT_PARTS", parts)
    rows = spark.createDataFrame([(i % 3 if i < 300 else i, i) for i in range(400)], "k long, v long")
    keyed = rows.groupBy("k").count().withColumnRenamed("count", "n").filter("k < 350").selectExpr("k", "n", "k * 2 AS x")
    got = sorted(map(tuple, skew.joined(rows, keyed, ["k"], count="n", total=400).select("k", "v", "x").collect()))
    assert got == sorted((i % 3 if i < 300 else i, i, 2 * (i % 3 if i < 300 else i)) for i in range(350))
    assert skew.joined(rows, keyed, ["k"], count="n", total=400, how="left_semi").count() == 350
    assert skew.joined(rows.limit(0), keyed.limit(0), ["k"], count="n", total=0).collect() == []


def test_hot_keys_are_found_by_share_alone(spark):
    rows = spark.createDataFrame([(0, i) for i in range(5)] + [(i, i) for i in range(1, 5)], "k long, v long")
    keyed = rows.groupBy("k").count()
    hot_rows, hot, cold_rows, rest = skew.parted(rows, keyed, ["k"], count="count", total=9_000)
    assert (hot_rows.count(), hot.count(), cold_rows.count(), rest.count()) == (0, 0, 9, 5)
    hot_rows, hot, cold_rows, rest = skew.parted(rows, keyed, ["k"], count="count", total=2_500)
    assert (hot_rows.count(), hot.count(), cold_rows.count(), rest.count()) == (5, 1, 4, 4)
