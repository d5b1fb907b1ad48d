"""Records that are the same but for formatting: one record for each content, with the number of its copies.

A record's canonical key is a hash of its group and its two texts, each reduced to letters and digits, in sorted order. Keys
are counted exactly: partial counts of every input partition, added up. Keys that hold at least 1/HOT_PARTS of the rows are
hot (`operators.skew`), whatever the size of the table. Hot rows are aggregated in two levels over salted keys and meet their
representative where they lie; all others take one shuffle on the key. The representative is the smallest identifier.

The keyed rows are written to the shared checkpoint folder once, when a function is called, and read from there.
"""

from __future__ import annotations

import html
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from crawlspan.operators import skew
from crawlspan.sources.tables import checkpoint_dir

#: Parts of a hot key's rows.
SALTS = 64

#: Texts that need decoding in Python: a character reference, or a character that may have a canonically equivalent form.
#: The rest (Latin up to U+02FF, punctuation, the euro sign) is its own composed form.
DECODE = r"&|[^\x{0}-\x{2FF}\x{2002}-\x{2027}\x{2030}-\x{205E}\x{20AC}]"


@F.pandas_udf(StringType())
def decoded(texts: pd.Series) -> pd.Series:
    """Character references resolved once, then the composed canonical form. Nulls stay null."""
    return texts.map(lambda t: unicodedata.normalize("NFC", html.unescape(t)).encode("utf-8", "replace").decode(), na_action="ignore")


def canonical(text: Column) -> Column:
    """The letters and digits of a text in sequence, without regard to case; empty if it has none, null if it is null.

    Cases are compared after full case folding, so that sharp s equals ss. Marks that don't compose with a letter are neither
    letters nor digits.
    """
    plain = F.coalesce(decoded(F.when(text.rlike(DECODE), text)), text)
    # With the capital sharp s written out, which also keeps the optimizer from taking lower(upper(x)) for lower(x).
    return F.lower(F.replace(F.upper(F.regexp_replace(plain, r"[^\p{L}\p{N}]+", "")), F.lit("ẞ"), F.lit("SS")))


def keyed(records: DataFrame, *, group: str, first: str, second: str) -> DataFrame:
    """The records with a binary column `_key`; those of which a text has no letter or digit are left out."""
    a, b = F.col("_a"), F.col("_b")
    rows = records.withColumns({"_a": canonical(F.col(first)), "_b": canonical(F.col(second))}).filter("_a != '' AND _b != ''")
    of = F.concat_ws("|", F.coalesce(F.col(group).cast("string"), F.lit("-")), F.least(a, b), F.greatest(a, b))
    return rows.withColumn("_key", F.unhex(F.md5(of))).drop("_a", "_b")


def _parted(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows, written down, of the hot keys and of the rest."""
    checkpoint_dir(rows.sparkSession)
    rows = rows.checkpoint()
    counts = rows.groupBy("_key").agg(F.count("*").alias("_n")).filter("_n > 1")
    hot_rows, _, rest_rows, _ = skew.parted(rows, counts, ["_key"], count="_n", total=rows.count())
    return hot_rows, rest_rows


def _salted(rows: DataFrame, least: Column) -> DataFrame:
    """(_key, _r, _n): of each hot key the smallest value, named _r, and the number of rows, in two levels."""
    salted = rows.groupBy("_key", F.pmod(F.xxhash64("_id"), F.lit(SALTS)).alias("_salt")).agg(least, F.count("*").alias("_n"))
    return salted.groupBy("_key").agg(F.min("_r").alias("_r"), F.sum("_n").alias("_n"))


def copies(records: DataFrame, *, group: str, first: str, second: str, id: str) -> DataFrame:
    """(a, b): for each copy b the smallest identifier a of its content, a itself left out.

    Records with a null identifier or a text without letters and digits (null and empty ones too) have no copies. Null is a
    group of its own. Repeated rows give their identifier once. Empty tables give an empty result; other columns are ignored.
    """
    rows = keyed(records.select(group, first, second, F.col(id).alias("_id")).filter("_id IS NOT NULL"), group=group, first=first, second=second)
    hot_rows, rest_rows = _parted(rows.select("_key", "_id"))
    hot = _salted(hot_rows, F.min("_id").alias("_r")).select("_key", F.col("_r").alias("_rep"))
    rest = rest_rows.groupBy("_key").agg(F.count("*").alias("_n"), F.min("_id").alias("_rep")).filter("_n > 1").drop("_n")
    pairs = hot_rows.join(F.broadcast(hot), "_key").select("_rep", "_id").unionByName(rest_rows.join(rest, "_key").select("_rep", "_id"))
    return pairs.filter("_rep != _id").select(F.col("_rep").alias("a"), F.col("_id").alias("b")).distinct()


def collapse(records: DataFrame, *, group: str, first: str, second: str, id: str) -> DataFrame:
    """(group, id, first, second, copies): one record for each content, the one with the smallest id, and how many rows it stands for.

    As in `copies`, records without a letter or digit in both texts, or without an id, are left out. Of repeated rows of the
    representative the smallest texts are shown.
    """
    rows = keyed(records.select(group, F.col(id).alias("_id"), F.col(first).alias("_first"), F.col(second).alias("_second")).filter("_id IS NOT NULL"), group=group, first="_first", second="_second")
    hot_rows, rest_rows = _parted(rows)
    least = F.min(F.struct("_id", "_first", "_second", group)).alias("_r")
    both = _salted(hot_rows, least).unionByName(rest_rows.groupBy("_key").agg(least, F.count("*").alias("_n")))
    return both.select(F.col(f"_r.{group}").alias(group), F.col("_r._id").alias(id), F.col("_r._first").alias(first), F.col("_r._second").alias(second), F.col("_n").alias("copies"))
