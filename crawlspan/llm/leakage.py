"""Held-out items that occur, fully or partly, in a corpus.

Each shard of the corpus gets an FM-index over word ids: the Burrows-Wheeler transform of its words, held as a wavelet matrix
whose prefix counts answer rank queries. All phrases of all items (every run of PHRASE words; all words of a shorter item) are
searched backwards at once, word by word; occurrences are located by walking back to sampled suffix positions; and the spans of
one document are merged. A phrase can't hold a word that no item has, so a shard's text is first reduced, without any loss, to
the runs of item words that are long enough for a phrase; a document lies in one shard as a whole.

Nothing is shuffled but the few rows found, and the corpus is read and indexed once: each shard's index is searched for all blocks of
items before the next shard is read. Items are cut into words on the executors and pass through the driver block by block, as 8
bytes a word; phrases are formed only where they are searched, a bounded number at once. A worker holds 8 bytes for each
word of all items besides its shard. Words are compared by 64 bits of hash.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

PHRASE = 12
#: Words of candidate runs that are indexed at once, and every how many of them one suffix position is kept.
SHARD_WORDS = 1_000_000
SAMPLE = 16
#: Characters of items in one block.
BLOCK_CHARS = 20_000_000
#: Distinct spellings whose word id a worker remembers, and phrases that are searched at once.
SPELLINGS = 500_000
PHRASES = 200_000

WORD = re.compile(r"[^\W_]+")


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Suffix array by prefix doubling; `text` must end every run with a symbol of its own, so doubling ends at the longest run."""
    n = len(text)
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    step = 1
    while True:
        second = np.full(n, -1, np.int64)
        second[:-step or None] = rank[step:] if step < n else second[:0]
        key = rank * (n + 1) + second + 1
        order = np.argsort(key, kind="stable")
        new = np.empty(n, np.int64)
        new[order] = np.cumsum(np.r_[0, key[order][1:] != key[order][:-1]])
        rank = new
        if rank[order[-1]] == n - 1 or step >= n:
            return order
        step *= 2


class FmIndex:
    """Backward search and locating over runs of symbols from 1; 0 ends a run."""

    def __init__(self, text: np.ndarray, symbols: int, sample: int = SAMPLE):
        n = len(text)
        ends = np.flatnonzero(text == 0)
        distinct = text.astype(np.int64) + len(ends)
        distinct[ends] = np.arange(len(ends))
        order = suffix_order(distinct)
        self.bwt = text[order - 1]  # the first suffix is preceded by the last end
        counts = np.bincount(text, minlength=symbols + 1)
        self.first = np.r_[0, np.cumsum(counts)]
        # Sampled positions: every sample-th one, and every start of a run, so that no walk leaves its run.
        kept = (np.arange(n) % sample == 0) | (text == 0)
        kept[0] = True
        kept[ends[ends + 1 < n] + 1] = True
        self.sampled = kept[order]
        self.rank_sampled = np.r_[0, np.cumsum(self.sampled)]
        self.positions = order[self.sampled]
        # The wavelet matrix: for each bit from the highest, how many ones stand before each place; zeros go first.
        self.bits = max(1, int(symbols).bit_length())
        self.ones, self.zeros = [], []
        now = self.bwt.astype(np.int64)
        for b in range(self.bits - 1, -1, -1):
            one = (now >> b) & 1 == 1
            self.ones.append(np.r_[0, np.cumsum(one)].astype(np.int32))
            self.zeros.append(int(n - one.sum()))
            now = np.r_[now[~one], now[one]]
        every = np.arange(symbols + 1)
        self.block = self._descend(every, np.zeros(symbols + 1, np.int64))

    def _descend(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for level, b in enumerate(range(self.bits - 1, -1, -1)):
            ones = self.ones[level][at]
            at = np.where((symbol >> b) & 1 == 1, self.zeros[level] + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How many of `symbol` the transform has before place `at`."""
        return self._descend(symbol, at) - self.block[symbol]

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows [low, high) of the suffixes that begin with each phrase; one phrase in each row of the array."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), len(self.bwt), np.int64)
        for j in range(phrases.shape[1] - 1, -1, -1):
            live = np.flatnonzero(low < high)
            if not len(live):
                break
            s = phrases[live, j]
            low[live], high[live] = self.first[s] + self.rank(s, low[live]), self.first[s] + self.rank(s, high[live])
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffixes: back to the nearest sampled one, counting the steps."""
        rows, out = rows.copy(), np.zeros(len(rows), np.int64)
        live, steps = np.arange(len(rows)), 0
        while len(live):
            here = self.sampled[rows[live]]
            done = live[here]
            out[done] = self.positions[self.rank_sampled[rows[done]]] + steps
            live = live[~here]
            s = self.bwt[rows[live]].astype(np.int64)
            rows[live] = self.first[s] + self.rank(s, rows[live])
            steps += 1
        return out


def word_hash(word: str) -> int:
    return int.from_bytes(hashlib.blake2b(word.casefold().encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def _phrases(block: tuple[np.ndarray, np.ndarray, np.ndarray], size: int = PHRASE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(phrases, their items) of a block, by length, at most PHRASES at once. block: item of each run, where runs begin (and
    the last ends), symbols; -1 is a symbol that the shard lacks, and no phrase holds one."""
    owners, bounds, symbols = block
    lengths = np.diff(bounds)
    lacking = np.r_[0, np.cumsum(symbols < 0)]
    for n in np.unique(np.minimum(lengths, size)).tolist():
        if n == 0:
            continue
        runs = np.flatnonzero(np.minimum(lengths, size) == n)
        counts = lengths[runs] - n + 1
        first = np.repeat(bounds[runs], counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        owner = np.repeat(owners[runs], counts)
        whole = lacking[first + n] == lacking[first]
        first, owner = first[whole], owner[whole]
        for at in range(0, len(first), PHRASES):
            yield symbols[first[at : at + PHRASES, None] + np.arange(n)], owner[at : at + PHRASES]


def _search(blocks, vocabulary: np.ndarray, shard: list[tuple]) -> Iterator[tuple[int, int, int, int]]:
    """(document's place in the shard, item, first word, word after the last) of every occurrence. shard: (place, offset, run)."""
    lengths = np.array([len(run) + 1 for _, _, run in shard])
    starts = np.r_[0, np.cumsum(lengths)[:-1]]
    text = np.zeros(int(lengths.sum()), np.int64)
    for at, (_, _, run) in zip(starts, shard, strict=True):
        text[at : at + len(run)] = run
    own = np.unique(text[text > 0])  # the shard's words, numbered from 1
    text[text > 0] = np.searchsorted(own, text[text > 0]) + 1
    index = FmIndex(text, len(own))
    hashes = vocabulary[own - 1]
    for block in blocks:
        owners, bounds, words = block.value
        at = np.minimum(np.searchsorted(hashes, words), len(hashes) - 1)
        for array, owner in _phrases((owners, bounds, np.where(hashes[at] == words, at + 1, -1))):
            low, high = index.search(array)
            hits = np.flatnonzero(high > low)
            sizes = (high - low)[hits]
            rows = np.repeat(low[hits], sizes) + np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            positions = index.locate(rows)
            runs = np.searchsorted(starts, positions, "right") - 1
            for item, r, place in zip(np.repeat(owner[hits], sizes).tolist(), runs.tolist(), positions.tolist(), strict=True):
                first = shard[r][1] + place - int(starts[r])
                yield shard[r][0], item, first, first + array.shape[1]


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


class _Spellings(dict):
    """Places from 1 in the vocabulary of words as they are spelt; 0 for those that no item has."""

    def __init__(self, vocabulary: np.ndarray):
        super().__init__()
        self.vocabulary = vocabulary

    def __missing__(self, word: str) -> int:
        if len(self) >= SPELLINGS:
            self.clear()
        h = word_hash(word)
        at = int(np.searchsorted(self.vocabulary, h))
        self[word] = found = at + 1 if at < len(self.vocabulary) and self.vocabulary[at] == h else 0
        return found


def _item_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        words = [np.array([word_hash(w) for w in WORD.findall(t)], np.int64).tobytes() for t in b.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(words, pa.binary())], names=["item", "words"])


def item_blocks(items: DataFrame, item: str, item_text: str) -> tuple[list, np.ndarray, int]:
    """Broadcasts of the items' words in blocks of BLOCK_CHARS (at a word for six characters), their vocabulary, sorted, and the
    shortest phrase. The driver holds one block and the vocabulary."""
    spark = items.sparkSession
    blocks, vocabulary, least = [], np.array([], np.int64), PHRASE
    held: list[tuple[int, np.ndarray]] = []

    def close():
        nonlocal vocabulary, held
        if held:
            words = np.concatenate([w for _, w in held])
            blocks.append(spark.sparkContext.broadcast((np.array([i for i, _ in held], np.int64), np.r_[0, np.cumsum([len(w) for _, w in held])], words)))
            vocabulary, held = np.union1d(vocabulary, words), []

    n = 0
    rows = items.select(F.col(item).cast("long").alias("item"), item_text).dropna().mapInArrow(_item_words, "item long, words binary").filter("length(words) > 0")
    for row in rows.toLocalIterator():
        words = np.frombuffer(row["words"], np.int64)
        held.append((row["item"], words))
        least, n = min(least, len(words)), n + len(words)
        if n * 6 >= BLOCK_CHARS:
            close()
            n = 0
    close()
    return blocks, vocabulary, least


def leaks(corpus: DataFrame, items: DataFrame, *, id: str, text: str, item: str, item_text: str) -> DataFrame:
    """(doc_id, item_id, spans): each document with each item of which it has a phrase, and the merged word spans [from, to).

    Words are the longest runs of letters and digits without regard to case. Texts that are null or without words have and give
    no phrase. Repeated rows of a document give a row each; items that repeat an id are taken together. Empty tables give an empty
    result; other columns are ignored.
    """
    spark = corpus.sparkSession
    schema = f"doc_id {corpus.schema[id].dataType.simpleString()}, item_id long, spans array<struct<first:int,last:int>>"
    out_types = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))

    blocks, words, least = item_blocks(items, item, item_text)
    if not blocks:
        return spark.createDataFrame([], schema)
    sent = spark.sparkContext.broadcast(words)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = sent.value
        ids = _Spellings(vocabulary)
        docs: list = []
        shard: list[tuple] = []
        kind, held = None, 0

        def flush() -> Iterator[pa.RecordBatch]:
            spans: dict[tuple[int, int], list[tuple[int, int]]] = {}
            for place, item_id, a, b in _search(blocks, vocabulary, shard) if shard else ():
                spans.setdefault((place, item_id), []).append((a, b))
            if spans:
                lists = [[{"first": a, "last": b} for a, b in _merged(v)] for v in spans.values()]
                yield pa.RecordBatch.from_arrays([pa.array([docs[p] for p, _ in spans], kind), pa.array([i for _, i in spans], pa.int64()), pa.array(lists, out_types)], names=["doc_id", "item_id", "spans"])

        for b in batches:
            kind = b.schema.field(0).type
            for doc, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                found = np.fromiter((ids[w] for w in WORD.findall(t)), np.int64)
                edges = np.flatnonzero(np.diff(np.r_[False, found > 0, False]))
                runs = [(a, z) for a, z in edges.reshape(-1, 2).tolist() if z - a >= least]
                if runs:
                    docs.append(doc)
                    shard.extend((len(docs) - 1, a, found[a:z]) for a, z in runs)
                    held += sum(z - a for a, z in runs)
                if held >= SHARD_WORDS:
                    yield from flush()
                    docs, shard, held = [], [], 0
        yield from flush()

    texts = corpus.select(F.col(id).alias("_id"), F.col(text).alias("_text")).filter("_text IS NOT NULL")
    return texts.mapInArrow(of, schema)


def merged_spans(found: DataFrame) -> DataFrame:
    """(doc_id, first, last): the word spans [first, last) to remove from each document, over all items, merged where they meet."""
    spans = found.select("doc_id", F.explode("spans").alias("s")).select("doc_id", "s.first", "s.last").distinct()
    by = W.partitionBy("doc_id").orderBy("first", "last")
    reach = F.max("last").over(by.rowsBetween(W.unboundedPreceding, -1))
    island = spans.withColumn("_new", (reach.isNull() | (F.col("first") > reach)).cast("int")).withColumn("_at", F.sum("_new").over(by))
    return island.groupBy("doc_id", "_at").agg(F.min("first").alias("first"), F.max("last").alias("last")).drop("_at")
