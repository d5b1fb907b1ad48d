"""Text statistics as columns, and the keywords of a text as an aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Words that are no keywords.
STOP_WORDS = (
    "the and for are but not you all can had her was one our out has its let say she too use that with this have from they been said each make like long look many some than them then what when will "
    "more into over such take also back came come just only very well your were which about after being could every first found great their there these those under where while would other still between "
    "should through"
).split()

#: White space as text functions take it, no-break space and byte order mark included.
SPACE = r"[\s\x{00A0}\x{FEFF}]"


def words(text: Column) -> Column:
    return F.filter(F.split(text, f"{SPACE}+"), lambda w: w != "")


def content_hash(text: Column) -> Column:
    """SHA-256 of the text's letters and digits in lower case, single-spaced."""
    return F.sha2(F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}\s]", ""), r"\s+", " ")), 256)


def syllables(word: Column) -> Column:
    """Vowel groups of the word's letters a-z, less a silent e at its end; 1 at least."""
    w = F.regexp_replace(F.lower(word), "[^a-z]", "")
    groups = F.size(F.regexp_extract_all(w, F.lit("[aeiouy]+"), F.lit(0)))
    n = F.when(groups == 0, 1).otherwise(groups) - F.when(w.endswith("e"), 1).otherwise(0) + F.when(w.rlike("[^aeiouy]le$"), 1).otherwise(0)
    return F.when(F.length(w) <= 3, 1).otherwise(F.greatest(F.lit(1), n))


def readability(text: Column) -> Column:
    """Reading ease from 0 (hard) to 100 by sentence length and syllables; 0 for a text without words. Null gives null."""
    sentences = F.size(F.filter(F.split(text, "[.!?]+"), lambda s: F.regexp_replace(s, SPACE, "") != ""))
    found = words(text)
    n = F.size(found)
    spoken = F.aggregate(found, F.lit(0), lambda a, w: a + syllables(w))
    score = F.lit(206.835) - F.lit(1.015) * (n / sentences) - F.lit(84.6) * (spoken / n)
    return F.when(text.isNull(), None).when((n == 0) | (sentences == 0), F.lit(0)).otherwise(F.greatest(F.lit(0), F.least(F.lit(100), F.floor(score + 0.5)))).cast("int")


def keywords(texts: DataFrame, id: str, text: str, top: int = 10) -> DataFrame:
    """(id, word, count, rank): each text's most frequent words of four letters and more, ties by first occurrence.

    Counting shuffles (text, word) pairs after map-side aggregation; ranking holds the distinct words of one text at a time.
    """
    found = texts.select(id, F.posexplode(F.regexp_extract_all(F.lower(text), F.lit(r"\p{L}{4,}"), F.lit(0))).alias("at", "word")).filter(~F.col("word").isin(STOP_WORDS))
    counted = found.groupBy(id, "word").agg(F.count("*").alias("count"), F.min("at").alias("at"))
    ranked = counted.withColumn("rank", F.row_number().over(W.partitionBy(id).orderBy(F.desc("count"), "at")))
    return ranked.filter(F.col("rank") <= top).select(id, "word", "count", "rank")
