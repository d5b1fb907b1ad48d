import random

import numpy as np
import pytest

from crawlspan.llm import leakage as L

OPTIONS = {"id": "k", "text": "t", "item": "i", "item_text": "x"}


def brute(docs, items):
    out = set()
    for k, t, *_ in docs:
        words = [w.casefold() for w in L.WORD.findall(t or "")]
        for i, x, *_ in items:
            own = [w.casefold() for w in L.WORD.findall(x or "")]
            n = min(12, len(own))
            grams = {tuple(own[j : j + n]) for j in range(len(own) - n + 1)} if n else set()
            if any(tuple(words[j : j + n]) in grams for j in range(len(words) - n + 1)):
                out.add((k, i))
    return out


def test_index_counts_and_locates():
    rnd = np.random.default_rng(4)
    runs = [rnd.integers(1, 5, rnd.integers(1, 40)) for _ in range(60)] + [np.ones(200, np.int64)]
    text = np.concatenate([np.r_[r, 0] for r in runs])
    index = L.FmIndex(text, 4)
    for n in (1, 2, 3, 6):
        phrases = rnd.integers(1, 5, (50, n))
        low, high = index.search(phrases)
        for p, a, b in zip(phrases, low, high, strict=True):
            want = [i for i in range(len(text) - n + 1) if (text[i : i + n] == p).all()]
            assert sorted(index.locate(np.arange(a, b)).tolist()) == want


@pytest.mark.parametrize("shard", [50, 10**6])
def test_against_brute_force(spark, monkeypatch, shard):
    monkeypatch.setattr(L, "SHARD_WORDS", shard)
    rnd = random.Random(shard)
    vocabulary = [f"w{i}" for i in range(12)]
    items = [(i, " ".join(rnd.choices(vocabulary, k=rnd.choice([3, 11, 12, 30]))), "c") for i in range(15)] + [(50, "", "c"), (51, None, "c"), (52, "?!", "c"), (53, "Straße İx", "c")]
    docs = [(k, " ".join(rnd.choices(vocabulary + ["other"], k=60)), "c") for k in range(40)]
    docs += [(100 + i, f"Before, {x.upper().replace(' ', ' -- ')}; after", "c") for i, x, _ in items if x] + [(200, None, "c"), (201, "", "c"), (202, "word " * 50_000 + (items[3][1]), "c"), (203, "STRASSE i̇x", "c"), (7, docs[7][1], "c")]
    corpus, tests = spark.createDataFrame(docs, "k long, t string, item_id string").repartition(3), spark.createDataFrame(items, "i long, x string, doc_id string")
    found = L.leaks(corpus, tests, **OPTIONS)
    assert {(r.doc_id, r.item_id) for r in found.collect()} == brute(docs, items)
    spans = L.merged_spans(found).collect()
    assert all(r.first < r.last for r in spans)
    assert L.leaks(corpus.limit(0), tests, **OPTIONS).collect() == [] and L.leaks(corpus, tests.limit(0), **OPTIONS).collect() == []


def test_blocks(spark, monkeypatch):
    monkeypatch.setattr(L, "BLOCK_CHARS", 10)
    corpus = spark.createDataFrame([(1, "one two three four"), (2, "five six")], "k long, t string")
    items = spark.createDataFrame([(1, "two three"), (2, "five six"), (3, "seven")], "i long, x string")
    assert {(r.doc_id, r.item_id) for r in L.leaks(corpus, items, **OPTIONS).collect()} == {(1, 1), (2, 2)}


def test_spans_merge(spark):
    rows = spark.createDataFrame([(1, 1, [(0, 12), (20, 30)]), (1, 2, [(5, 20)]), (2, 1, [(3, 4)]), (1, 3, [(40, 41)])], "doc_id int, item_id int, spans array<struct<first:int,last:int>>")
    assert {tuple(r) for r in L.merged_spans(rows).collect()} == {(1, 0, 30), (1, 40, 41), (2, 3, 4)}


def test_blocks_are_bounded(spark, monkeypatch):
    """Items of any size pass the driver in blocks; phrases are formed a bounded number at once."""
    monkeypatch.setattr(L, "BLOCK_CHARS", 6_000)
    monkeypatch.setattr(L, "PHRASES", 7)
    items = spark.createDataFrame([(i, " ".join(f"w{i * 50 + j}" for j in range(100))) for i in range(60)], "i long, x string")
    blocks, vocabulary, least = L.item_blocks(items, "i", "x")
    assert len(blocks) == 6 and max(len(b.value[2]) for b in blocks) == 1000 and len(vocabulary) == 59 * 50 + 100 and least == 12
    corpus = spark.createDataFrame([(1, " ".join(f"w{j}" for j in range(130, 142))), (2, " ".join(f"w{j}" for j in range(130, 141)))], "k long, t string")
    assert {(r.doc_id, r.item_id) for r in L.leaks(corpus, items, **OPTIONS).collect()} == {(1, 1), (1, 2)}
