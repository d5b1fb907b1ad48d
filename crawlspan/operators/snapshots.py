"""What changed between full snapshots of a table.

Every record is brought to one row per snapshot, a window over each key is ordered by the snapshot's index within its
series, and neighbouring rows are compared: a differing hash is a change, a gap in the index a removal followed by an
addition. Two shuffles: one that thins each (key, snapshot) to its latest row, with map-side partial aggregation, so that
any number of repeats of one key arrives as one row per input partition; and one that brings a key's snapshots together,
of which there are never more than the series has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def snapshot_index(scans: DataFrame, *, series: str = "project_id", snapshot: str = "scan_id", order: str = "started_at") -> DataFrame:
    """(series, snapshot, idx, next_snapshot): each snapshot's position from 0 in its series, and its successor.

    Null order values come first, ties are broken by the snapshot id, repeated rows of a snapshot count once.
    """
    w = W.partitionBy(series).orderBy(F.col(order).asc_nulls_first(), snapshot)
    return (
        scans.filter(F.col(snapshot).isNotNull())
        .groupBy(series, snapshot)
        .agg(F.min(order).alias(order))
        .select(series, snapshot, (F.row_number().over(w) - 1).alias("idx"), F.lead(snapshot).over(w).alias("next_snapshot"))
    )


def digest(*parts: Column) -> Column:
    """16 bytes that stand for a tuple of texts in which null is a value of its own."""
    return F.unhex(F.md5(F.to_json(F.array(*[F.coalesce(F.concat(F.lit("="), p.cast("string")), F.lit("-")) for p in parts]))))


def json_value(text: Column) -> Column:
    """A text for each JSON value: keys sorted, no spacing. What isn't valid JSON (or repeats a key) stands as it is, trimmed."""
    return F.coalesce(F.to_json(F.try_parse_json(text)), F.trim(text))


def snapshot_changes(records: DataFrame, index: DataFrame, *, by: list[str], series: str = "project_id", snapshot: str = "scan_id") -> DataFrame:
    """One row (*by, series, snapshot, change) for each record that differs from the series' preceding snapshot.

    records: columns `by` (what identifies a record within a series), `snapshot`, `version` (of several rows of a record in
    one snapshot the one with the largest counts, null being the smallest, ties going to the larger value) and `value`
    (binary). Records with a null in `by`, and rows of a snapshot not in `index`, don't count. A series' first snapshot gives
    no rows. Empty inputs give an empty result. Other columns are ignored.
    """
    known = index.select(F.col(series).alias("_series"), F.col(snapshot).alias("_snap"), "idx", "next_snapshot")
    rows = records.select(*by, F.col(snapshot).alias("_snap"), "version", "value").dropna(subset=by).join(known, "_snap")
    latest = rows.groupBy("_series", *by, "idx", "_snap", "next_snapshot").agg(F.max(F.struct("version", "value")).alias("_last"))
    w = W.partitionBy("_series", *by).orderBy("idx")
    seen = latest.select(
        "_series", *by, "idx", "_snap", "next_snapshot", F.col("_last.value").alias("_now"),
        F.lag("idx").over(w).alias("_before"), F.lag("_last.value").over(w).alias("_was"), F.lead("idx").over(w).alias("_after"),
    )
    here = F.when((F.col("idx") > 0) & (F.col("_before").isNull() | (F.col("_before") < F.col("idx") - 1)), F.lit("added")).when(
        (F.col("_before") == F.col("idx") - 1) & ~F.col("_now").eqNullSafe(F.col("_was")), F.lit("changed")
    )
    gone = F.when(F.col("next_snapshot").isNotNull() & (F.col("_after").isNull() | (F.col("_after") > F.col("idx") + 1)), F.lit("removed"))
    events = F.array(F.struct(F.col("_snap").alias("at"), here.alias("change")), F.struct(F.col("next_snapshot").alias("at"), gone.alias("change")))
    return (
        seen.select("_series", *by, F.explode(F.filter(events, lambda e: e["change"].isNotNull())).alias("_e"))
        .select(*by, F.col("_series").alias(series), F.col("_e.at").alias(snapshot), F.col("_e.change").alias("change"))
    )


def completed(scans: DataFrame) -> DataFrame:
    """The scans that are snapshots."""
    return scans.filter((F.col("scan_type") == "seo") & (F.col("status") == "completed"))


def page_records(history: DataFrame, pages: DataFrame) -> DataFrame:
    """The pages of every snapshot; their value is the content hash without regard to letter case."""
    both = history.select("scan_id", "page_id", "content_hash", F.col("recorded_at").alias("version")).unionByName(
        pages.select("scan_id", "page_id", "content_hash", F.col("scanned_at").alias("version"))
    )
    return both.select(F.lit("page").alias("entity"), F.col("page_id").cast("string").alias("record_key"), "scan_id", "version", digest(F.lower("content_hash")).alias("value"))


def issue_records(issues: DataFrame) -> DataFrame:
    """The issues of every snapshot; their value is severity, is_fixed, dismissed and the JSON value of details."""
    value = digest(F.col("severity"), F.col("is_fixed"), F.col("dismissed"), json_value(F.col("details")))
    return issues.select(F.lit("issue").alias("entity"), F.col("fingerprint").alias("record_key"), "scan_id", F.col("updated_at").alias("version"), value.alias("value"))
