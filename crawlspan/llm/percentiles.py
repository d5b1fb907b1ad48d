"""Percentiles of very large numeric columns, per group, by exact bisection.

A group and percentile has an interval of values that must hold its rank. The first pass counts the rows of each dyadic interval,
the values that share their sign and FIRST leading bits. Each further pass counts the rows below the midpoints of all open intervals
and keeps the half in which the rank lies; `LEVELS` halvings are done in one pass by counting the 2**LEVELS equal parts of an
interval. Percentiles that still share an interval share its counts. Only (group, part, count) is shuffled, after map-side partial
aggregation, so a group of any size costs a few rows for each input partition. Passes: one, and one for each LEVELS bits that
the widest interval has left; values of 17 bits take 2, any 64-bit integers 8 at most.

Values are 64-bit integers, all of them, so an interval of one value is the exact percentile: the smallest value with at least
ceil(n * permille / 1000) of the group's n non-null values not above it (the smallest value for 0).

Partial results of a day (or partition) are counts of dyadic cells that keep the `bits` leading bits of a value. They add up
over days; bisecting the sum gives the cell of the percentile, whose bounds are the error bound: the true percentile lies in
[low, high] and high - low < |value| / 2**(bits - 1).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StringType

from crawlspan.operators import skew
from crawlspan.sources.tables import checkpoint_dir

PERMILLE = (500, 900, 950, 990)
FIRST, LEVELS = 8, 9
#: Open intervals up to which they are broadcast to the counting pass (some 100 bytes each). Above, those of hot groups still are, so
#: that no group's rows meet in one task; the rest are joined by shuffle.
BROADCAST_MOST = 100_000
SMALLEST = -(2**63)


def unpivot(df: DataFrame, groups: list[str], columns: list[str], more: list[str] | None = None) -> DataFrame:
    """(*groups, *more, metric, v, n): a row of weight 1 for each non-null value of each column."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("long").alias("v")) for c in columns]))
    return df.select(*groups, *(more or []), pairs.alias("_x")).select(*groups, *(more or []), "_x.metric", "_x.v", F.lit(1).cast("long").alias("n")).filter("v IS NOT NULL")


def bits_of(x: Column) -> Column:
    """Bits of a non-negative integer; 0 has none."""
    return F.when(x == 0, F.lit(0)).otherwise(F.length(F.bin(x)))


def _plain(g: Column, kind: DataType) -> Column:
    """A group's value without nulls, so that joins need no null-safe comparison; a flag beside it tells them apart."""
    name = kind.simpleString()
    if isinstance(kind, StringType):
        return F.coalesce(g, F.lit(""))
    if name in ("tinyint", "smallint", "int", "bigint", "float", "double", "boolean") or name.startswith("decimal"):
        return F.coalesce(g, F.lit(0).cast(kind))
    return F.coalesce(g.cast("string") if name in ("date", "timestamp", "timestamp_ntz", "binary") else F.to_json(F.array(g)), F.lit(""))


shift_right = lambda x, n: F.call_function("shiftright", x, n)
shift_left = lambda x, n: F.call_function("shiftleft", x, n)


def bisect(values: DataFrame, groups: list[str], permille: tuple[int, ...] = PERMILLE, levels: int = LEVELS) -> DataFrame:
    """(*groups, permille, value, n): percentiles of `v`, each row counting `n` times (positive).

    Null values don't count, a group without any gives no row; null is a group of its own.
    """
    checkpoint_dir(values.sparkSession)
    shown, plain, empty = ([f"_{x}{i}" for i in range(len(groups))] for x in "gpz")
    on = [*plain, *empty]
    kinds = [values.schema[g].dataType for g in groups]
    rows = values.filter("v IS NOT NULL").select(*[_plain(F.col(g), k).alias(x) for g, k, x in zip(groups, kinds, plain, strict=True)], *[F.col(g).isNull().alias(x) for g, x in zip(groups, empty, strict=True)], *[F.col(g).alias(x) for g, x in zip(groups, shown, strict=True)], "v", "n")
    size = F.when(F.col("v") < 0, F.bitwise_not("v")).otherwise(F.col("v"))  # no overflow, as an absolute value would have
    bits = F.greatest(bits_of(size) - FIRST, F.lit(0))
    low = shift_left(shift_right(size, bits), bits)
    low = F.when(F.col("v") < 0, F.bitwise_not(low + (shift_left(F.lit(1).cast("long"), bits) - 1))).otherwise(low)
    keys = [*on, *shown]
    cells = rows.groupBy(*keys, low.alias("lo"), bits.alias("bits")).agg(F.sum("n").alias("held"))
    group = W.partitionBy(*keys)
    cells = cells.withColumns({"_n": F.sum("held").over(group), "below": F.sum("held").over(group.orderBy("lo")) - F.col("held")})
    wanted = F.array(*[F.struct(F.lit(p).alias("permille"), F.greatest(F.lit(1), F.ceil(F.col("_n") * p / 1000)).cast("long").alias("rank")) for p in permille])
    held = F.filter(wanted, lambda t: (t["rank"] > F.col("below")) & (t["rank"] <= F.col("below") + F.col("held")))
    state = cells.select(*keys, "_n", "lo", "bits", "below", held.alias("targets")).filter(F.size("targets") > 0).checkpoint()
    rows = rows.select(*on, "v", "n")
    done = state.filter("bits = 0")
    wide, opened = state.agg(F.coalesce(F.max("bits"), F.lit(0)), F.count(F.when(F.col("bits") > 0, 1))).first()
    while wide > 0:
        step = -(-wide // -(-wide // levels))  # halvings spread evenly over the passes that are needed
        shift = F.greatest(F.col("bits") - step, F.lit(0))
        open_ = state.filter("bits > 0")
        # Intervals of one group are disjoint: a row lies in at most one of them.
        lists = open_.groupBy(*on).agg(F.collect_list(F.struct("lo", "bits", shift.alias("shift"))).alias("_open"), F.max("_n").alias("_n"))
        inside = lambda i: (F.col("v") >= i["lo"]) & (F.col("v") <= i["lo"] + (shift_left(F.lit(1).cast("long"), i["bits"]) - 1))
        if opened <= BROADCAST_MOST:
            met = rows.join(F.broadcast(lists.drop("_n")), on)
        else:
            met = skew.joined(rows, lists, on, count="_n", total=lists.agg(F.sum("_n")).first()[0])
        met = met.select(*on, "n", "v", F.get(F.filter("_open", inside), 0).alias("_i")).filter("_i IS NOT NULL")
        counts = met.groupBy(*on, F.col("_i.lo").alias("lo"), shift_right(F.col("v") - F.col("_i.lo"), F.col("_i.shift")).alias("part")).agg(F.sum("n").alias("held"))
        before = F.sum("held").over(W.partitionBy(*on, "lo").orderBy("part")) - F.col("held")
        counts = counts.select(*on, "lo", "part", "held", before.alias("before"))
        start = F.col("below") + F.col("before")
        here = F.filter("targets", lambda t: (t["rank"] > start) & (t["rank"] <= start + F.col("held")))
        state = (
            open_.withColumn("shift", shift).join(counts, [*on, "lo"]).withColumn("targets", here).filter(F.size("targets") > 0)
            .select(*keys, "_n", (F.col("lo") + shift_left(F.col("part"), F.col("shift"))).alias("lo"), F.col("shift").alias("bits"), start.alias("below"), "targets")
        ).checkpoint()
        done = done.unionByName(state.filter("bits = 0"))
        wide, opened = state.agg(F.coalesce(F.max("bits"), F.lit(0)), F.count(F.when(F.col("bits") > 0, 1))).first()
    flat = done.select(*shown, "_n", F.col("lo").alias("value"), F.explode("targets").alias("t"))
    return flat.select(*[F.col(x).alias(g) for x, g in zip(shown, groups, strict=True)], F.col("t.permille").alias("permille"), "value", F.col("_n").alias("n"))


def cell(v: Column, bits: int) -> Column:
    """The value nearest to 0 of v's dyadic cell: its `bits` leading bits, the rest 0; the sign is kept. -2**63 is its own cell."""
    size = F.abs(F.when(v != SMALLEST, v).otherwise(F.lit(0).cast("long")))
    drop = F.greatest(bits_of(size) - bits, F.lit(0))
    kept = shift_left(shift_right(size, drop), drop)
    return F.when(v == SMALLEST, v).when(v < 0, -kept).otherwise(kept)


def partials(df: DataFrame, groups: list[str], part: Column, columns: list[str], bits: int = 8) -> DataFrame:
    """(*groups, part, metric, v, n): counts by cell of each part, to be kept and added up later. Null values don't count."""
    rows = unpivot(df.withColumn("part", part), groups, columns, ["part"])
    return rows.groupBy(*groups, "part", "metric", cell(F.col("v"), bits).alias("v")).agg(F.sum("n").alias("n"))


def combine(parts: DataFrame, groups: list[str], permille: tuple[int, ...] = PERMILLE, bits: int = 8) -> DataFrame:
    """(*groups, metric, permille, low, high, n) of any union of partial results made with the same `bits`."""
    keys = [*groups, "metric"]
    found = bisect(parts.groupBy(*keys, "v").agg(F.sum("n").alias("n")), keys, permille)
    # The smallest integer has no absolute value; it is the only one of its cell.
    size = F.abs(F.when(F.col("value") != SMALLEST, F.col("value")).otherwise(F.lit(0).cast("long")))
    last = shift_left(F.lit(1).cast("long"), F.greatest(bits_of(size) - bits, F.lit(0))) - 1
    low, high = F.when(F.col("value") < 0, F.col("value") - last).otherwise(F.col("value")), F.when(F.col("value") < 0, F.col("value")).otherwise(F.col("value") + last)
    return found.select(*keys, "permille", low.alias("low"), high.alias("high"), "n")
