"""References to records that do not exist, or did not yet.

References are first counted by column, period and key, with partial counts of every input partition, so a key costs the same
however many rows hold it. These counts, the parents with the time of their creation, and the keys known from history are brought together
by key and sorted. Each partition's keys are its dictionary: a key's number is its place among them, whatever its type. Numbers fall
into ranges of 65,536; in each, every column and period has a compressed bitmap of the keys referred to, and every period one of
the parents created in it. Reference AND-NOT parent leaves the bits of orphans, which the dictionary decodes.

What survives is joined back to the referring rows. Keys that hold many rows, orphans or not, are hot (`operators.skew`): their rows stay where
they lie; all others are shuffled. The counts are written to the shared checkpoint folder once, and read from there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlspan.operators import skew
from crawlspan.sources.tables import checkpoint_dir, spread

RANGE_BITS = 16
FULL = 1 << RANGE_BITS
#: Positions from which a container is a bit field of 8 KB and no longer a list of 2 bytes each.
LIST_MOST = 4096
#: Rows that are turned into containers at once; only memory depends on it.
ROWS_AT_ONCE = 500_000
#: Containers that aren't references: parents by the period of their creation, and keys known from history.
PARENT, HISTORY = -1, -2
NO_PERIOD = -1
REASONS = ("missing", "deleted", "late")


def pack(positions: np.ndarray) -> bytes:
    """A container of sorted distinct positions below 65,536."""
    if len(positions) < LIST_MOST:
        return positions.astype("<u2").tobytes()
    field = np.zeros(FULL, bool)
    field[positions] = True
    return np.packbits(field).tobytes()


def unpack(bits: bytes) -> np.ndarray:
    """The container as a field of 65,536 booleans."""
    if len(bits) == FULL // 8:
        return np.unpackbits(np.frombuffer(bits, np.uint8)).astype(bool)
    field = np.zeros(FULL, bool)
    field[np.frombuffer(bits, "<u2")] = True
    return field


def _and_not(kind: np.ndarray, period: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One range of numbers: (row, parent's row or -1, reason) of each reference whose key has no parent before its period. Rows are distinct."""
    order = np.lexsort((low, period, kind))
    kind, period, low = kind[order], period[order], low[order]
    cut = np.flatnonzero(np.r_[True, (kind[1:] != kind[:-1]) | (period[1:] != period[:-1])])
    rows = {(int(kind[a]), int(period[a])): (a, b) for a, b in zip(cut, np.r_[cut[1:], len(low)], strict=True)}
    bitmaps = {k: pack(low[a:b]) for k, (a, b) in rows.items()}
    born = sorted(p for k, p in bitmaps if k == PARENT)
    every, on_time, upto = np.zeros(FULL, bool), np.zeros(FULL, bool), 0
    parent = np.full(FULL, -1, np.int64)
    for p in born:
        every |= unpack(bitmaps[PARENT, p])
        a, b = rows[PARENT, p]
        parent[low[a:b]] = order[a:b]
    history = unpack(bitmaps[HISTORY, NO_PERIOD]) if (HISTORY, NO_PERIOD) in bitmaps else np.zeros(FULL, bool)
    found = []
    for p, k in sorted((p, k) for k, p in bitmaps if k >= 0):
        while upto < len(born) and born[upto] < p:
            on_time |= unpack(bitmaps[PARENT, born[upto]])
            upto += 1
        # Without a time nothing can be late.
        left = np.flatnonzero(unpack(bitmaps[k, p]) & ~(every if p == NO_PERIOD else on_time))
        if len(left):
            a, b = rows[k, p]
            found.append((order[a + np.searchsorted(low[a:b], left)], parent[left], np.where(every[left], 2, np.where(history[left], 1, 0))))
    return tuple(np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3


def _orphaned(hot: int):
    """The function that turns a partition sorted by key (kind, period, key, n, born) into the references left, and all hot ones."""

    def result(rows: pa.Table) -> pa.RecordBatch:
        key = rows.column("key").combine_chunks()
        new = np.r_[True, ~np.asarray(pa.compute.equal(key[1:], key[:-1]).to_numpy(zero_copy_only=False), bool)] if len(key) > 1 else np.array([True])
        number = np.cumsum(new) - 1  # the dictionary's number of each row's key
        kind, period, n = (rows.column(c).to_numpy() for c in ("kind", "period", "n"))
        taken, parents, reasons = [], [], []
        for at in range(0, int(number[-1]) + 1, FULL):
            a, b = np.searchsorted(number, [at, at + FULL])
            row, parent, reason = _and_not(kind[a:b], period[a:b], number[a:b] - at)
            taken.append(row + a)
            parents.append(np.where(parent < 0, -1, parent + a))
            reasons.append(reason)
        taken, parents, reasons = np.concatenate(taken), np.concatenate(parents), np.concatenate(reasons)
        named = np.array(REASONS, object)[reasons]
        other = np.setdiff1d(np.flatnonzero((kind >= 0) & (n >= hot)), taken)  # hot keys that are no orphans
        index = pa.array(np.r_[taken, other])
        born = rows.column("born").combine_chunks().take(pa.array(np.r_[parents, np.full(len(other), -1)], mask=np.r_[parents, np.full(len(other), -1)] < 0))
        own = rows.select(["kind", "period", "key", "n"]).take(index).combine_chunks()
        columns = [own.column(i).combine_chunks() for i in range(4)]
        return pa.RecordBatch.from_arrays([*columns, pa.array([*named, *[None] * len(other)], pa.string()), born], names=["kind", "period", "key", "n", "reason", "born"])

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n = 0
        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            n += b.num_rows
            if n >= ROWS_AT_ONCE:
                rows = pa.Table.from_batches(held)
                key = rows.column("key").combine_chunks()
                # The last key may go on in the next batch. Its rows are as many as columns and periods.
                same = np.asarray(pa.compute.equal(key, key[-1]).to_numpy(zero_copy_only=False), bool)
                cut = len(same) - (int(np.argmin(same[::-1])) if not same.all() else len(same))
                if cut:
                    yield result(rows.slice(0, cut))
                held = rows.slice(cut).combine_chunks().to_batches()
                n = rows.num_rows - cut
        if held:
            yield result(pa.Table.from_batches(held))

    return of


def month_code(column: str):
    """Months since year 0, or NO_PERIOD."""
    return F.coalesce(F.year(column) * 12 + F.month(column) - 1, F.lit(NO_PERIOD))


def orphans(references: list[tuple[str, str, DataFrame]], parents: DataFrame, history: DataFrame) -> DataFrame:
    """(ref_table, ref_field, ref_id, reason, period): each reference whose parent is missing, deleted or later than itself.

    references: (table, field, frame of ref_id, key, created_at). parents: frame of key, created_at; of repeated parents the
    earliest counts. history: frame of key. Keys are of one type, integers or texts. Null keys are no references. period is the
    month of the reference as yyyy-MM, null where its time is null, in which case it is never late; nor is a reference to a parent
    without a time. reason is `deleted` if the key has no parent but a history, `missing` if neither, `late` if the parent came
    after the reference. Repeated rows count once. Empty tables give no rows (references) or make every reference an orphan (parents).
    """
    spark = parents.sparkSession
    checkpoint_dir(spark)
    refs = [df.select(F.lit(i).alias("kind"), month_code("created_at").alias("period"), "ref_id", "key", "created_at").filter("key IS NOT NULL") for i, (_, _, df) in enumerate(references)]
    rows = refs[0]
    for r in refs[1:]:
        rows = rows.unionByName(r)
    on = ["kind", "period", "key"]
    counts = rows.groupBy(*on).agg(F.count("*").alias("n")).checkpoint()
    total = counts.agg(F.sum("n")).first()[0] or 0
    born = parents.filter("key IS NOT NULL").groupBy("key").agg(F.min("created_at").alias("born"))
    time = parents.schema["created_at"].dataType
    none, zero = F.lit(None).cast(time).alias("born"), F.lit(0).cast("long").alias("n")
    tagged = (
        counts.select(*on, "n", none).unionByName(born.select(F.lit(PARENT).alias("kind"), month_code("born").alias("period"), "key", zero, "born"))
        .unionByName(history.filter("key IS NOT NULL").select(F.lit(HISTORY).alias("kind"), F.lit(NO_PERIOD).alias("period"), "key", zero, none).distinct())
    )
    hot_least = max(1, -(-total // skew.HOT_PARTS))
    schema = f"kind int, period int, key {rows.schema['key'].dataType.simpleString()}, n long, reason string, born {time.simpleString()}"
    left = tagged.repartition(spread(spark, 1), "key").sortWithinPartitions("key").mapInArrow(_orphaned(hot_least), schema).checkpoint()
    hot = F.broadcast(left.filter(F.col("n") >= hot_least))
    cold_rows = rows.join(hot.select(*on), on, "left_anti")
    met = rows.join(hot.filter("reason IS NOT NULL").drop("n"), on).unionByName(cold_rows.join(left.filter(F.col("n") < hot_least).drop("n"), on))
    names = F.array(*[F.struct(F.lit(t).alias("t"), F.lit(f).alias("f")) for t, f, _ in references])
    return (
        met.filter("reason != 'late' OR born > created_at")
        .select(
            F.element_at(names, F.col("kind") + 1)["t"].alias("ref_table"), F.element_at(names, F.col("kind") + 1)["f"].alias("ref_field"), "ref_id", "reason",
            F.date_format("created_at", "yyyy-MM").alias("period"),
        )
        .distinct()
    )


def page_references(links: DataFrame, issues: DataFrame, backlinks: DataFrame) -> list[tuple[str, str, DataFrame]]:
    """The reference columns of the audit tables."""
    one = lambda df, i, k: df.select(F.col(i).alias("ref_id"), F.col(k).alias("key"), "created_at")
    return [
        ("page_links", "destination_page_id", one(links, "link_id", "destination_page_id")),
        ("page_links", "source_page_id", one(links, "link_id", "source_page_id")),
        ("issues", "page_id", one(issues, "issue_id", "page_id")),
        ("backlinks", "page_id", one(backlinks, "backlink_id", "page_id")),
    ]
