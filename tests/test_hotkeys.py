import random
from collections import defaultdict

import pytest

from crawlspan.operators import hotkeys

SCHEMA = "link_id long, source_page_id long, project_id long, destination_url string, is_followed boolean, k string, h string"
OPTIONS = {"value": "destination_url", "row_id": "link_id", "flag": "is_followed"}


def expected(rows):
    out = defaultdict(lambda: [0, set(), set(), set()])
    for link, source, project, url, followed, *_ in rows:
        for field, key in (("source_page_id", source), ("project_id", project)):
            if key is not None:
                x = out[field, key]
                x[0] += 1
                x[1].add((url, link))
                x[2] |= {url} - {None}
                if followed:
                    x[3].add((url, link))
    return {k: (a, len(b), len(c), len(d)) for k, (a, b, c, d) in out.items()}


@pytest.mark.parametrize("chunk", [3, 50, 10**6])
def test_against_brute_force(spark, chunk):
    rnd = random.Random(chunk)
    rows = []
    for i in range(3000):
        source = rnd.choice([7] * 6 + [None, *range(20)])
        rows.append((rnd.choice([i, i - 1]), source, rnd.choice([1, 1, 1, 2, None]), rnd.choice([None, "u" * 3000, *(f"u{j}" for j in range(40))]), rnd.choice([True, False, None]), "clash", "clash"))
    # A row id belongs to one row: repeats are exact.
    rows = list({r[0]: r for r in rows}.values())
    rows += rnd.choices(rows, k=300)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = {(r.key_field, r.key_value): (r.rows, r.links, r.distinct_values, r.flagged) for r in hotkeys.per_key(df, ["source_page_id", "project_id"], chunk_rows=chunk, **OPTIONS).collect()}
    assert got == expected(rows)
    hot = {tuple(r) for r in hotkeys.hot_keys(df, ["source_page_id", "project_id"], chunk_rows=chunk, **OPTIONS).collect()}
    assert hot == {k for k, v in expected(rows).items() if v[0] * 100 >= 2 * len(rows)}


def test_empty_and_null_only(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert hotkeys.per_key(df, ["project_id"], **OPTIONS).collect() == []
    assert hotkeys.hot_keys(df, ["project_id"], **OPTIONS).collect() == []
    df = spark.createDataFrame([(1, None, None, "u", True, "", "")], SCHEMA)
    assert hotkeys.per_key(df, ["project_id", "source_page_id"], **OPTIONS).collect() == []
