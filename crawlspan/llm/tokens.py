"""Token ids of a whole corpus by a byte-level BPE vocabulary.

A text is cut by the vocabulary's pattern; each piece is looked up whole, then in a cache of pieces already merged, and merged
only if it is new. Merging holds a contiguous array of part boundaries and one of the ranks of adjacent parts, scans the ranks
for the minimum, deletes that boundary and refreshes the two neighbouring ranks, until no pair has a rank. A scan costs the
length of the piece, so pieces beyond `SHORT` bytes keep their ranks in a heap instead and links between their parts, with the
same result. Every document is handled where it is read: no shuffle, no state beyond the vocabulary and the bounded cache.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes up to which a piece's ranks are scanned.
SHORT = 96
#: Pieces whose ids a worker remembers (of SHORT bytes at most, so some 100 MB).
CACHE = 400_000
#: Characters of text that are turned into one batch of results.
BATCH_CHARS = 4_000_000
NONE = 1 << 60


def load_ranks(path: str) -> dict[bytes, int]:
    """Ranks by token of a file with a base64 token and its rank in each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def merge_short(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one short piece that isn't a token itself."""
    get = ranks.get
    bounds = list(range(len(piece) + 1))
    pair = [get(piece[i : i + 2], NONE) for i in range(len(piece) - 1)]  # pair[i]: rank of the parts i and i + 1 together
    while pair:
        least = min(pair)
        if least == NONE:
            break
        i = pair.index(least)
        del bounds[i + 1], pair[i]
        if i < len(pair):
            pair[i] = get(piece[bounds[i] : bounds[i + 2]], NONE)
        if i > 0:
            pair[i - 1] = get(piece[bounds[i - 1] : bounds[i + 1]], NONE)
    return [ranks[piece[a:b]] for a, b in zip(bounds, bounds[1:], strict=False)]


def merge_long(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same for pieces of any length, in n log n."""
    n, get = len(piece), ranks.get
    end = list(range(1, n + 1))  # the part that begins at i ends at end[i]; 0 where none begins
    begin = list(range(-1, n))  # the part before that at i begins at begin[i]
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := get(piece[i : i + 2], NONE)) < NONE]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        middle = end[i]
        if not middle or middle >= n or end[middle] != stop:
            continue  # one of the two has been merged since
        end[i], end[middle] = stop, 0
        if stop < n:
            begin[stop] = i
            if (r := get(piece[i : end[stop]], NONE)) < NONE:
                heapq.heappush(heap, (r, i, end[stop]))
        if i > 0 and (r := get(piece[begin[i] : stop], NONE)) < NONE:
            heapq.heappush(heap, (r, begin[i], stop))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return out


class Encoder:
    """Ids of texts by one vocabulary."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.ranks, self.find, self.cache = ranks, regex.compile(pattern).findall, {}

    def piece(self, word: str) -> list[int]:
        raw = word.encode()
        if (rank := self.ranks.get(raw)) is not None:
            ids = [rank]
        else:
            ids = merge_short(raw, self.ranks) if len(raw) <= SHORT else merge_long(raw, self.ranks)
        if len(raw) <= SHORT:
            if len(self.cache) >= CACHE:
                self.cache.clear()
            self.cache[word] = ids
        return ids

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        known = self.cache.get
        for word in self.find(text):
            out += known(word) or self.piece(word)
        return out


@lru_cache(maxsize=2)
def _encoder(path: str, pattern: str) -> Encoder:
    return Encoder(load_ranks(path), pattern)


def token_ids(texts: DataFrame, *, id: str, text: str, vocabulary: str, pattern: str) -> DataFrame:
    """(id, ids): the token ids of each text; null and empty texts have no ids, which is an empty list.

    `vocabulary` is the path of the rank file, which every executor must be able to read. One row for each input row, repeated
    ones included.
    """

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(vocabulary, pattern).encode
        keys: list = []
        lists: list[list[int]] = []
        chars = 0
        kind = None

        def write() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(keys, kind), pa.array(lists, pa.list_(pa.int32()))], names=["_id", "ids"])

        for b in batches:
            kind = b.schema.field(0).type
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                keys.append(k)
                lists.append(encode(t) if t else [])
                chars += len(t or "")
                if chars >= BATCH_CHARS:
                    yield write()
                    keys, lists, chars = [], [], 0
        if keys:
            yield write()

    kind = texts.schema[id].dataType.simpleString()
    return texts.select(F.col(id).alias("_id"), F.col(text).alias("_text")).mapInArrow(of, f"_id {kind}, ids array<int>").withColumnRenamed("_id", id)
