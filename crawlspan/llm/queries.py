"""The queries of the llm problems over the audit tables and the corpus, and their SQL."""

from __future__ import annotations

import secrets

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crawlspan.llm import duplicates, leakage, percentiles, pii, residue, tokens
from crawlspan.sources.tables import evenly, read

TIMINGS = ["load_time_ms", "first_byte_time_ms"]


def p1_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Exact percentiles of the two timings by project."""
    rows = percentiles.unpivot(read(spark, d, "pages", "project_id", *TIMINGS), ["project_id"], TIMINGS)
    return percentiles.bisect(rows, ["project_id", "metric"])


def p1_from_days(spark: SparkSession, d: str) -> DataFrame:
    """The same from partial results of each day, combined: the bounds between which the percentile lies."""
    days = percentiles.partials(read(spark, d, "pages", "project_id", "scanned_at", *TIMINGS), ["project_id"], F.to_date("scanned_at"), TIMINGS)
    return percentiles.combine(days, ["project_id"])


PAIR = {"group": "project_id", "first": "title", "second": "meta_description", "id": "page_id"}


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Pages of a project that repeat title and description in other formatting."""
    return duplicates.copies(read(spark, d, "pages", *PAIR.values()), **PAIR).select(F.col("a").alias("page_id_a"), F.col("b").alias("page_id_b"))


def p3_collapsed(spark: SparkSession, d: str) -> DataFrame:
    """One page for each distinct content of a project, with its number of copies."""
    return duplicates.collapse(read(spark, d, "pages", *PAIR.values()), **PAIR)


TITLE = {"id": "page_id", "title": "title", "url": "url", "words": "word_count", "status": "http_status", "description": "meta_description", "headings": "h1s"}


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Pages whose title is residue, filler, an error or block message, or a script notice."""
    return residue.residue(evenly(read(spark, d, "pages", *TITLE.values())), **TITLE).select("page_id")


def p6_by_reason(spark: SparkSession, d: str) -> DataFrame:
    """How many pages each detector excludes."""
    return residue.residue(evenly(read(spark, d, "pages", *TITLE.values())), **TITLE).groupBy("reason").agg(F.count("*").alias("pages"))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    """Token ids of every document."""
    import public_tokenizers

    return tokens.token_ids(evenly(read(spark, d, "documents", "doc_id", "text")), id="doc_id", text="text", vocabulary=public_tokenizers.path("byte_bpe_50k.tiktoken"), pattern=public_tokenizers.PATTERN)


def _leaks(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaks(evenly(read(spark, d, "documents", "doc_id", "text")), read(spark, d, "benchmark"), id="doc_id", text="text", item="item_id", item_text="text")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents that contain test items, with the items."""
    return _leaks(spark, d).select("doc_id", "item_id").distinct()


def p9_spans(spark: SparkSession, d: str) -> DataFrame:
    """The word spans to remove from each document."""
    return leakage.merged_spans(_leaks(spark, d))


TEXT = {"id": "doc_id", "text": "text"}


def _key(spark: SparkSession) -> str:
    """The session's secret for surrogates; without one, a new one, so that surrogates agree within this query only."""
    return spark.conf.get("spark.crawlspan.surrogates.key", None) or secrets.token_hex(32)


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    """Personal information in the documents, as it is written."""
    return pii.entities(evenly(read(spark, d, "documents", "doc_id", "text")), read(spark, d, "name_list"), **TEXT, key=_key(spark))


def p10_texts(spark: SparkSession, d: str) -> DataFrame:
    """The documents with typed placeholders, and with keyed surrogates, in the place of personal information."""
    return pii.redacted(evenly(read(spark, d, "documents", "doc_id", "text")), read(spark, d, "name_list"), **TEXT, key=_key(spark))


QUERIES = {f.__name__: f for f in (p1_percentiles, p1_from_days, p3_found, p3_collapsed, p6_found, p6_by_reason, p8_ids, p9_found, p9_spans, p10_found, p10_texts)}

_GRAMS = """
WITH i AS (SELECT item_id, regexp_extract_all(replace(lower(text), 'ß', 'ss'), '[\\p{L}\\p{N}]+') AS w FROM benchmark WHERE text IS NOT NULL),
p AS (SELECT DISTINCT item_id, least(12, len(w)) AS n, array_to_string(w[s : s + least(12, len(w)) - 1], ' ') AS phrase FROM (SELECT *, unnest(range(1, greatest(1, len(w) - 11) + 1)) AS s FROM i WHERE len(w) > 0)),
d AS (SELECT doc_id, regexp_extract_all(replace(lower(text), 'ß', 'ss'), '[\\p{L}\\p{N}]+') AS w FROM documents WHERE text IS NOT NULL),
g AS (SELECT doc_id, n, s, array_to_string(w[s : s + n - 1], ' ') AS phrase FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, (SELECT DISTINCT n FROM p) WHERE len(w) >= n)),
hit AS (SELECT DISTINCT doc_id, item_id, s - 1 AS a, s - 1 + n AS b FROM g JOIN p USING (n, phrase))
"""
_RANKED = """
WITH v AS (
  SELECT project_id, 'load_time_ms' AS metric, load_time_ms AS v FROM pages WHERE load_time_ms IS NOT NULL
  UNION ALL SELECT project_id, 'first_byte_time_ms', first_byte_time_ms FROM pages WHERE first_byte_time_ms IS NOT NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY project_id, metric ORDER BY v) AS rank, count(*) OVER (PARTITION BY project_id, metric) AS n FROM v),
p AS (SELECT unnest([500, 900, 950, 990]) AS permille),
f AS (SELECT project_id, metric, permille, v AS value, n FROM r, p WHERE rank = greatest(1, (n * permille + 999) // 1000))
"""
SQL = {
    "p9_found": _GRAMS + "SELECT DISTINCT doc_id, item_id FROM hit",
    "p9_spans": _GRAMS
    + """, o AS (SELECT DISTINCT doc_id, a, b FROM hit), r AS (SELECT *, max(b) OVER (PARTITION BY doc_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM o),
    k AS (SELECT *, sum(CASE WHEN reach IS NULL OR a > reach THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY a, b) AS island FROM r) SELECT doc_id, min(a) AS first, max(b) AS last FROM k GROUP BY doc_id, island""",
    "p1_percentiles": _RANKED + "SELECT project_id, metric, permille, value, n FROM f",
    "p1_from_days": _RANKED
    + """, c AS (SELECT *, greatest(0, CASE WHEN value = 0 THEN 0 ELSE length(bin(abs(value))) END - 8) AS s FROM f)
    SELECT project_id, metric, permille, CASE WHEN value < 0 THEN -(((-value >> s) << s) + (1 << s) - 1) ELSE (value >> s) << s END AS low,
      CASE WHEN value < 0 THEN -((-value >> s) << s) ELSE ((value >> s) << s) + (1 << s) - 1 END AS high, n FROM c""",
}
