"""Per-key results where a few keys hold most rows.

Exact offset chunking. The rows are range-partitioned and sorted by (field, key, value, row id), which splits a key of any
size over as many partitions as it needs. Each partition reports how many rows of its first and its last key it holds; prefix
sums over the partitions (one small row each) give the number of every row within its key, exactly. Rows number c*C to
(c+1)*C-1 of a key are its chunk c, where C is a fixed share of all rows, so that keys are cut alike at every size; every chunk
gives one state with its counts and its first and last row, and states are merged in order: what continues over a boundary is
counted once. No task ever holds more than one partition, whatever the keys hold.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlspan.sources.tables import spread

#: Chunks that all rows make up. A key of R of N rows has R / N * CHUNKS states at most and as many more as partitions it touches.
CHUNKS = 1000

EDGE = pa.schema([("run", pa.int32()), ("last", pa.bool_()), ("f", pa.int8()), ("k", pa.int64()), ("n", pa.int64())])
STATE = pa.schema(
    [("f", pa.int8()), ("k", pa.int64()), ("whole", pa.bool_()), ("start", pa.int64()), ("rows", pa.int64()), ("links", pa.int64()), ("followed", pa.int64()), ("dests", pa.int64())]
    + [(f"{at}_{x}", pa.int64()) for at in ("first", "last") for x in "hcl"] + [("first_w", pa.int64())]
)
SORTED = ("f", "k", "h", "c", "l")


def keyed_rows(rows: DataFrame, fields: list[str], *, value: str, row_id: str, flag: str) -> DataFrame:
    """(f, k, h, c, l, w): a row for each row and each of its non-null keys; f is the field's position in `fields`.

    h and c are 64 and 32 bits of hash of `value` (c = -1: null); l is the row id, w the flag as 0 or 1.
    """
    keys = F.explode(F.array(*[F.struct(F.lit(i).cast("byte").alias("f"), F.col(x).cast("long").alias("k")) for i, x in enumerate(fields)]))
    return (
        rows.select(keys.alias("_x"), F.xxhash64(value).alias("h"), F.coalesce(F.crc32(F.col(value).cast("binary")), F.lit(-1)).cast("long").alias("c"),
                    F.coalesce(F.col(row_id).cast("long"), F.lit(-(2**63))).alias("l"), F.coalesce(F.col(flag), F.lit(False)).cast("byte").alias("w"))
        .select("_x.f", "_x.k", "h", "c", "l", "w")
        .filter(F.col("k").isNotNull())
    )


def _columns(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, np.ndarray]]:
    for b in batches:
        if b.num_rows:
            yield {name: b.column(i).to_numpy(zero_copy_only=False) for i, name in enumerate(b.schema.names)}


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of one sorted partition: how many rows its first and its last key have in it. One row if they are the same key."""
    run, first, last, n_first, n_last = 0, None, None, 0, 0
    for x in _columns(batches):
        run, f, k = int(x["run"][0]), x["f"], x["k"]
        first = first or (int(f[0]), int(k[0]))
        end = (int(f[-1]), int(k[-1]))
        n_first += int(((f == first[0]) & (k == first[1])).sum())
        n = int(((f == end[0]) & (k == end[1])).sum())
        n_last, last = (n_last + n if end == last else n), end
    if first is not None:
        out = [(run, False, *first, n_first)] + ([(run, True, *last, n_last)] if last != first else [])
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), EDGE.types, strict=True)], schema=EDGE)


def _offsets(edges: list[tuple]) -> dict[int, tuple[int, bool, bool]]:
    """For each partition: rows of its first key before it, whether that key began earlier, whether its last key goes on."""
    by_run: dict[int, dict[bool, tuple]] = {}
    for run, last, f, k, n in edges:
        by_run.setdefault(run, {})[last] = (f, k, n)
    out, key, held = {}, None, 0
    runs = sorted(by_run)
    for i, run in enumerate(runs):
        f, k, n = by_run[run][False]
        before = held if (f, k) == key else 0
        tail = by_run[run].get(True)
        key, held = ((tail[0], tail[1]), tail[2]) if tail else ((f, k), before + n)
        goes_on = i + 1 < len(runs) and by_run[runs[i + 1]][False][:2] == key
        out[run] = (before, before > 0, goes_on)
    return out


def _states(offsets: dict[int, tuple[int, bool, bool]], chunk: int):
    """The function that turns one sorted partition into states. The last state of a batch stays open for the next one."""
    names = STATE.names

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, before, head, began, goes_on = 0, None, None, None, False, False

        def write(s: dict[str, np.ndarray], following: tuple | None) -> pa.RecordBatch:
            """following: the key of the state after these, to tell whether their key has other states."""
            f, k = s["f"], s["k"]
            more = s["start"] > 0
            if began:
                more |= (f == head[0]) & (k == head[1])
            if len(k):
                more[:-1] |= (f[1:] == f[:-1]) & (k[1:] == k[:-1])
                more[-1] |= following == (int(f[-1]), int(k[-1]))
            return pa.RecordBatch.from_arrays([pa.array(~more if n == "whole" else s[n], t) for n, t in zip(names, STATE.types, strict=True)], schema=STATE)

        for x in _columns(batches):
            f, k, h, c, link, w = (x[n].astype(np.int64) for n in ("f", "k", "h", "c", "l", "w"))
            n, at = len(k), np.arange(len(k))
            if before is None:
                (number, began, goes_on), head = offsets[int(x["run"][0])], (int(f[0]), int(k[0]))
            same_key, same_value, same_row = np.empty(n, bool), np.empty(n, bool), np.empty(n, bool)
            same_key[1:] = (k[1:] == k[:-1]) & (f[1:] == f[:-1])
            same_value[1:] = same_key[1:] & (h[1:] == h[:-1]) & (c[1:] == c[:-1])
            same_row[1:] = same_value[1:] & (link[1:] == link[:-1])
            same_key[0] = before is not None and before[:2] == (f[0], k[0])
            same_value[0] = same_key[0] and before[2:4] == (h[0], c[0])
            same_row[0] = same_value[0] and before[4] == link[0]
            # The number of each row in its key. The partition's first key, and one that the last batch ended in, go on from there.
            starts = np.flatnonzero(~same_key)
            base = np.zeros(n, np.int64)
            base[starts] = starts
            numbers = at - np.maximum.accumulate(base)
            up_to = (starts[1] if len(starts) > 1 else n) if before is None else (starts[0] if len(starts) else n)
            numbers[:up_to] = number + at[:up_to]
            # A chunk's own first row counts as new in it; merging takes it back where it repeats the row before.
            fresh = ~same_key | (numbers % chunk == 0)
            bounds = np.union1d([0], np.flatnonzero(fresh))
            new_row, new_value = ~same_row | fresh, (~same_value | fresh) & (c != -1)
            sums = [np.add.reduceat(v.astype(np.int64), bounds) for v in (new_row, new_row & (w == 1), new_value)]
            ends = np.r_[bounds[1:], n] - 1
            s = {"f": f[bounds], "k": k[bounds], "start": numbers[bounds], "rows": ends - bounds + 1, "links": sums[0], "followed": sums[1], "dests": sums[2], "first_w": w[bounds]}
            s |= {f"first_{m}": v[bounds] for m, v in (("h", h), ("c", c), ("l", link))} | {f"last_{m}": v[ends] for m, v in (("h", h), ("c", c), ("l", link))}
            if held is not None:
                if fresh[0]:
                    s = {m: np.r_[held[m], v] for m, v in s.items()}
                else:
                    for m in s:
                        if m in ("rows", "links", "followed", "dests"):
                            s[m][0] += held[m][0]
                        elif not m.startswith("last"):
                            s[m][0] = held[m][0]
            held = {m: v[-1:].copy() for m, v in s.items()}
            before, number = tuple(int(v[-1]) for v in (f, k, h, c, link)), int(numbers[-1]) + 1
            if len(s["k"]) > 1:
                yield write({m: v[:-1] for m, v in s.items()}, before[:2])
        if held is not None:
            yield write(held, before[:2] if goes_on else None)

    return of


def per_key(rows: DataFrame, fields: list[str], *, value: str, row_id: str, flag: str, chunk_rows: int | None = None) -> DataFrame:
    """(key_field, key_value, rows, links, distinct_values, flagged): one row for each non-null value of each field.

    rows: rows with the key, repeats included. links: distinct (value, row id), so exact repeats count once.
    distinct_values: distinct non-null values. flagged: links whose flag is true (null is false). Keys that are null give no
    row; an empty table gives an empty result; other columns are ignored. Values are compared by 96 bits of hash.
    """
    spark = rows.sparkSession
    parts = spread(spark)
    run = (
        keyed_rows(rows, fields, value=value, row_id=row_id, flag=flag)
        .repartitionByRange(parts, *SORTED)
        .sortWithinPartitions(*SORTED)
        .withColumn("run", F.spark_partition_id())
        .persist(StorageLevel.DISK_ONLY)
    )
    ddl = lambda s: ", ".join(f"{x.name} {({'int8': 'byte', 'int32': 'int', 'int64': 'long', 'bool': 'boolean'})[str(x.type)]}" for x in s)
    edges = run.select("run", "f", "k").mapInArrow(_edges, ddl(EDGE)).collect()  # two rows for each partition
    chunk_rows = chunk_rows or max(1, -(-run.count() // CHUNKS))
    states = run.mapInArrow(_states(_offsets([tuple(e) for e in edges]), chunk_rows), ddl(STATE))
    same = lambda *xs: F.coalesce(F.expr(" AND ".join(f"first_{x} = lag(last_{x}) OVER (PARTITION BY f, k ORDER BY start)" for x in xs)), F.lit(False))
    split = states.filter(~F.col("whole")).withColumns({"_value": same("h", "c") & (F.col("first_c") != -1), "_row": same("h", "c", "l")})
    merged = split.groupBy("f", "k").agg(
        F.sum("rows").alias("rows"), F.sum(F.col("links") - F.col("_row").cast("long")).alias("links"),
        F.sum(F.col("followed") - F.when(F.col("_row"), F.col("first_w")).otherwise(0)).alias("followed"),
        F.sum(F.col("dests") - F.col("_value").cast("long")).alias("dests"),
    )
    out = states.filter("whole").select("f", "k", "rows", "links", "followed", "dests").unionByName(merged)
    name = F.element_at(F.array(*[F.lit(x) for x in fields]), F.col("f").cast("int") + 1)
    return out.select(name.alias("key_field"), F.col("k").alias("key_value"), "rows", "links", F.col("dests").alias("distinct_values"), F.col("followed").alias("flagged"))


def hot_keys(rows: DataFrame, fields: list[str], *, value: str, row_id: str, flag: str, percent: int = 2, chunk_rows: int | None = None) -> DataFrame:
    """(key_field, key_value) of each key that holds at least `percent` % of all rows, rows with null keys and repeats included."""
    total = rows.count()
    return per_key(rows, fields, value=value, row_id=row_id, flag=flag, chunk_rows=chunk_rows).filter(F.col("rows") * 100 >= F.lit(total) * percent).select("key_field", "key_value")
