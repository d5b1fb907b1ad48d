"""Joins of rows with a table of one row for each key, where a few keys may hold most rows.

The table knows how many rows hold each key, from partial counts of every input partition added up. A key with at least
1/HOT_PARTS of the rows is hot. There can't be more than HOT_PARTS of them, which bounds what is broadcast whatever the data;
hot rows stay where they lie, so they are spread over as many tasks as they fill. All other rows are shuffled on the key, of which none has
more than 1/HOT_PARTS of them. Nothing depends on the size of the input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOT_PARTS = 1000


def parted(rows: DataFrame, keyed: DataFrame, on: list[str], *, count: str, total: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Rows and keys of the hot ones (keys to be broadcast), then those of the rest. `rows` is read twice. Keys are not null."""
    hot = F.broadcast(keyed.filter(F.col(count) * HOT_PARTS >= total))
    rest = keyed.filter(F.col(count) * HOT_PARTS < total)
    return rows.join(hot.select(*on), on, "left_semi"), hot, rows.join(hot.select(*on), on, "left_anti"), rest


def joined(rows: DataFrame, keyed: DataFrame, on: list[str], *, count: str, total: int, how: str = "inner") -> DataFrame:
    """`rows` joined with `keyed` on columns that are never null; how is `inner` or `left_semi`. Empty tables give no rows."""
    _, hot, cold_rows, rest = parted(rows, keyed, on, count=count, total=total)
    return rows.join(hot.drop(count), on, how).unionByName(cold_rows.join(rest.drop(count), on, how))
