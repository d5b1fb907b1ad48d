import random

import public_tokenizers as P
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from crawlspan.llm import tokens as T

PATH = P.path("byte_bpe_50k.tiktoken")
RANKS = T.load_ranks(PATH)
THEIRS = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})
OURS = T.Encoder(RANKS, P.PATTERN)


@settings(max_examples=300, deadline=None)
@given(st.text(st.characters(exclude_categories=["Cs"]), max_size=200))
def test_equals_library(text):
    assert OURS.encode(text) == THEIRS.encode_ordinary(text)


def test_long_words_and_both_merges():
    rnd = random.Random(3)
    for word in ("a" * 30_000, "ab" * 5000, "é" * 3000, "".join(rnd.choice("abcdefgh") for _ in range(20_000)), "日本語" * 2000):
        assert OURS.encode(word) == THEIRS.encode_ordinary(word)
    for _ in range(300):
        raw = "".join(rnd.choice("etaoinsh é日") for _ in range(rnd.randrange(1, 60))).encode()
        assert T.merge_short(raw, RANKS) == T.merge_long(raw, RANKS)


def test_frame(spark):
    rows = [(1, "Hello <|endoftext|>", "c"), (2, "", "c"), (3, None, "c"), (1, "Hello <|endoftext|>", "c"), (4, " \r\n\t", "c")]
    df = spark.createDataFrame(rows, "k long, t string, ids string")
    args = {"id": "k", "text": "t", "vocabulary": PATH, "pattern": P.PATTERN}
    got = sorted((r.k, r.ids) for r in T.token_ids(df, **args).collect())
    assert got == sorted((k, THEIRS.encode_ordinary(t) if t else []) for k, t, _ in rows)
    assert all(THEIRS.decode(ids) == (t or "") for (k, ids), (_, t, _) in zip(got, sorted(rows, key=lambda r: r[0]), strict=True) if k != 1)
    assert T.token_ids(df.limit(0), **args).collect() == []
