import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from crawlspan.operators import nested

VALUES = st.recursive(st.none() | st.booleans() | st.integers() | st.floats(allow_nan=False, allow_infinity=False) | st.text(st.characters(exclude_categories=["Cs"]), max_size=8), lambda c: st.lists(c, max_size=4) | st.dictionaries(st.text(st.characters(exclude_categories=["Cs"]), max_size=5), c, max_size=4), max_leaves=20)


def brute(value):
    out, todo = set(), [(value, "$", "")]
    while todo:
        v, path, parent = todo.pop()
        if isinstance(v, dict):
            out.add((path, parent))
            todo += [(x, f"{path}|{k}", path) for k, x in v.items()]
        elif isinstance(v, list):
            todo += [(x, f"{path}|{i}", parent) for i, x in enumerate(v)]
    return out


@settings(max_examples=300, deadline=None)
@given(VALUES, st.sampled_from([None, 1]), st.booleans())
def test_objects_equal_brute_force(value, indent, ascii_):
    found = nested.triples(json.dumps(value, indent=indent, ensure_ascii=ascii_))
    assert {(t[0], t[1]) for t in found if t[5] == "object"} == brute(value)


@settings(max_examples=300, deadline=None)
@given(st.text('{}[]:,"\\ 01.-eEtrufalsn\n', max_size=14))
def test_validity_equals_the_standard_parser(text):
    def refuse(x):
        raise ValueError(x)

    try:
        json.loads(text, parse_constant=refuse)
        valid = True
    except ValueError:
        valid = False
    assert (nested.triples(text) is not None) == valid


@pytest.mark.parametrize("text", ["", " ", "null x", '{"a":1,}', "[1 2]", '{"a":NaN}', "01", "'x'", '{"a":"\t"}', "﻿{}", "{}{}"])
def test_not_json(text):
    assert nested.triples(text) is None


def test_scalars_and_depth():
    assert nested.triples('{"a":[1,{"c":["x",[2]]}],"t":true}') == [
        ("$", "", "$", None, None, "object", None), ("$", None, "$", "a|0", 0, "number", "1"), ("$|a|1", "$", "$|a|*", None, None, "object", None), ("$|a|1", None, "$|a|*", "c|0", 0, "string", "x"),
        ("$|a|1", None, "$|a|*", "c|1|0", 0, "number", "2"), ("$", None, "$", "t", None, "word", "true"),
    ]
    assert nested.triples("[" * 50_000 + "]" * 50_000) == []
    assert len(nested.triples('{"a":' * 300 + "1" + "}" * 300)) == 301


def test_tables(spark):
    texts = [("s", 1, "$", '{"offers": [{"price": 1, "tags": ["x"], "parent": "p"}, {}], "a": {"offers": 3}}', "clash"), ("s", 2, "$", None, ""), ("s", 3, "$", "{", ""), ("s", 4, "$", '{"offers": [{"price": "1"}, {"price": 2, "price": 3}]}', "")]
    df = spark.createDataFrame(texts, "source string, row_id long, root string, text string, node string")
    found = nested.objects(df)
    rows = {tuple(r) for r in nested.flat_table(found, "s", "$|offers|*", keys=["price", "tags|0", "parent"]).collect()}
    assert rows == {("s", 1, "$|offers|0", "$", "1", "x", "p"), ("s", 1, "$|offers|1", "$", None, None, None), ("s", 4, "$|offers|0", "$", "1", None, None), ("s", 4, "$|offers|1", "$", "3", None, None)}
    every = nested.flat_table(found, "s", "$|offers", "family")
    assert every.columns == ["source", "row_id", "node", "parent", "key_parent", "price", "tags"] and every.count() == 4 and [r.tags for r in every.collect() if r.tags] == [["x"]]
    assert nested.flat_table(found, "s", "none").collect() == [] and nested.flat_table(found.unionAll(found), "s", "$|offers|*").count() == 4
    assert nested.json_nodes(df).count() == 7
    assert nested.json_nodes(df.unionAll(df)).count() == 7
    assert nested.json_nodes(df.limit(0)).count() == 0


def test_all_tables_hold_every_value(spark):
    texts = [
        {"@type": "Product", "offers": [{"price": 1.5}, {"price": "2", "seller": {"name": None}}], "tags": ["a", [True]], "none": {}}, {"offers": {"price": "null", "price2": 3}, "reviews": [{"stars": 5}]}, [{"categories": {"content": {"checks": [{"id": "title"}]}, "media": {"checks": [{"id": "alt"}]}}}], 7,
    ]
    rows = [("s", i, "$|0", json.dumps(t)) for i, t in enumerate(texts)] + [("s", 4, "$|0", '{"k": 1, "k": 2}'), ("s", 5, "$|0", '{"cut": ')]
    found = nested.objects(spark.createDataFrame(rows, "source string, row_id long, root string, text string")).collect()
    assert {r.family for r in found if r.row_id == 0} == {"$", "$|offers", "$|offers|seller", "$|none"} and {r.family for r in found if r.row_id == 1} == {"$", "$|offers", "$|reviews"}
    got = {(r.row_id, r.table_path, r.node, r.parent): {k: (v.kind, v.value) for k, v in r["values"].items()} for r in found}
    assert len(got) == len(found) and got == {
        (0, "$", "$|0", ""): {"@type": ("string", "Product"), "tags|0": ("string", "a"), "tags|1|0": ("word", "true")}, (0, "$|offers|*", "$|0|offers|0", "$|0"): {"price": ("number", "1.5")},
        (0, "$|offers|*", "$|0|offers|1", "$|0"): {"price": ("string", "2")}, (0, "$|offers|*|seller", "$|0|offers|1|seller", "$|0|offers|1"): {"name": ("word", "null")}, (0, "$|none", "$|0|none", "$|0"): {},
        (1, "$", "$|0", ""): {}, (1, "$|offers", "$|0|offers", "$|0"): {"price": ("string", "null"), "price2": ("number", "3")}, (1, "$|reviews|*", "$|0|reviews|0", "$|0"): {"stars": ("number", "5")},
        (2, "$|*", "$|0|0", ""): {}, (2, "$|*|categories", "$|0|0|categories", "$|0|0"): {}, (2, "$|*|categories|content", "$|0|0|categories|content", "$|0|0|categories"): {}, (2, "$|*|categories|media", "$|0|0|categories|media", "$|0|0|categories"): {},
        (2, "$|*|categories|content|checks|*", "$|0|0|categories|content|checks|0", "$|0|0|categories|content"): {"id": ("string", "title")}, (2, "$|*|categories|media|checks|*", "$|0|0|categories|media|checks|0", "$|0|0|categories|media"): {"id": ("string", "alt")},
        (4, "$", "$|0", ""): {"k": ("number", "2")},
    }


def test_tables_are_written(spark, tmp_path):
    rows = [("s", 1, "$", '{"A": 1, "a": 2, "offers": [{"price": 1}]}'), ("s", 2, "$", '{"offers": {"price": "2", "": true}}'), ("t", 1, "$", "{}")]
    found = nested.objects(spark.createDataFrame(rows, "source string, row_id long, root string, text string"))
    tables = nested.flat_tables(found, str(tmp_path))
    assert [(a, b) for a, b, _ in tables] == [("s", "$"), ("s", "$|offers"), ("t", "$")]
    back = [spark.read.parquet(p) for _, _, p in tables]
    assert back[0].columns[4:] == ["A", "key_a"] and {tuple(r)[4:] for r in back[0].collect()} == {("1", "2"), (None, None)}
    assert {(r.row_id, r.parent, r.price) for r in back[1].collect()} == {(1, "$", "1"), (2, "$", "2")} and back[2].count() == 1


def test_arrays_keep_their_order(spark):
    rows = [("s", 1, "$", json.dumps({"a": list(range(12)), "b": "x"})), ("s", 2, "$", '{"a": "one", "b": [[1, 2], [3]]}'), ("s", 3, "$", '{"a": []}')]
    found = nested.objects(spark.createDataFrame(rows, "source string, row_id long, root string, text string"))
    got = {r.row_id: (r.a, r.b) for r in nested.flat_table(found, "s", "$").collect()}
    assert got == {1: ([str(i) for i in range(12)], ["x"]), 2: (["one"], ["1", "2", "3"]), 3: (None, None)}
