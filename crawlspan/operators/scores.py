"""Roll-up of page signals to a site's scores. One aggregation per site, from counts that add up over partitions.

Four categories, seven signals of machine readability, images from the pages' facts, blocked and empty crawls, and failing addresses.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

def rounded(x: Column) -> Column:
    """Half up, kept between 0 and 100."""
    return F.least(F.lit(100), F.greatest(F.lit(0), F.floor(x + 0.5))).cast("int")


#: Addresses kept for each failing check.
AFFECTED = 50
FILLED = r"[^\s\p{Z}\x{FEFF}]"

# The conditions of a whole report, its checks by category, and those that count for a single page.
CONDITIONS = {
    "http_ok": lambda: F.col("http_status").between(200, 299), "indexable": lambda: F.col("is_indexable"), "fast": lambda: F.coalesce("load_time_ms", F.lit(0)) <= 3000, "title": lambda: F.col("title").rlike(FILLED),
    "meta_description": lambda: F.col("meta_description").rlike(FILLED), "word_count": lambda: F.col("word_count") >= 300, "h1": lambda: F.size("h1s") > 0, "schema_types": lambda: F.size("schema_types") > 0,
    "structured_data": lambda: F.size("structured_data") > 0, "open_graph": lambda: F.col("og_count") > 0,
}
REPORT = {
    "technical": {n: n for n in ("http_ok", "indexable", "fast")}, "content": {n: n for n in ("title", "meta_description", "word_count", "h1")},
    "aeo": {f"aeo_{n}": n for n in ("schema_types", "structured_data", "open_graph", "meta_description", "title", "h1", "word_count")},
}
PAGE_AEO = ("aeo_schema_types", "aeo_structured_data", "aeo_open_graph")


def _checked(pages: DataFrame, crawls: DataFrame) -> DataFrame:
    """Pages of crawls that weren't blocked, with `_checks`: an array of (category, check, passed, total)."""
    held = lambda c: F.coalesce(CONDITIONS[c](), F.lit(False)).cast("long")
    images = F.greatest(F.coalesce("image_count", F.lit(0)), F.lit(0)).cast("long")
    one = lambda category, check, passed, total: F.struct(F.lit(category).alias("category"), F.lit(check).alias("check"), passed.alias("passed"), total.alias("total"))
    checks = [one(k, n, held(c), F.lit(1).cast("long")) for k, s in REPORT.items() for n, c in s.items()]
    alt = one("media", "img_alt", images - F.least(images, F.greatest(F.coalesce("images_without_alt", F.lit(0)), F.lit(0)).cast("long")), images)
    open_ = crawls.filter("NOT coalesce(blocked, false)").select("project_id").distinct()
    return pages.join(open_, "project_id", "left_semi").select("project_id", "page_id", "url", F.array(*checks, alt).alias("_checks"))


def report_checks(pages: DataFrame, crawls: DataFrame) -> DataFrame:
    """(project_id, category, check, status, passed, total, affected_urls): every check of every crawl that reached pages.

    pages: the columns of pages with og_count, image_count and images_without_alt of their facts. crawls: (project_id, blocked).
    status is `na` where nothing was there to check; affected_urls has up to AFFECTED failing pages, smallest page_id first.
    """
    keys = ["project_id", "category", "check"]
    rows = _checked(pages, crawls).select("project_id", "page_id", "url", F.explode("_checks").alias("_c")).select("project_id", "page_id", "url", "_c.*")
    counts = rows.groupBy(*keys).agg(F.sum("passed").alias("passed"), F.sum("total").alias("total"))
    first = rows.filter("passed < total AND url IS NOT NULL").withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy("page_id", "url"))).filter(F.col("_n") <= AFFECTED)
    urls = first.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", "url"))), lambda x: x["url"]).alias("affected_urls"))
    status = F.when(F.col("total") == 0, "na").when(F.col("passed") == F.col("total"), "pass").otherwise("fail")
    return counts.join(urls, keys, "left").select(*keys, status.alias("status"), "passed", "total", F.coalesce("affected_urls", F.array().cast("array<string>")).alias("affected_urls"))


def report_scores(pages: DataFrame, crawls: DataFrame) -> DataFrame:
    """(project_id, pages, technical, content, media, aeo, overall, blocked): a row for each crawl. Blocked and empty crawls have 0 everywhere."""
    rows = _checked(pages, crawls).select("project_id", F.explode("_checks").alias("_c")).select("project_id", "_c.*")
    counts = rows.groupBy("project_id", "category", "check").agg(F.sum("passed").alias("passed"), F.sum("total").alias("total"), F.count("*").alias("pages"))
    rate = F.when(F.col("total") == 0, F.lit(100.0)).otherwise(F.col("passed") / F.col("total") * 100)
    parts = ("technical", "content", "media", "aeo")
    means = counts.groupBy("project_id").agg(F.max("pages").alias("pages"), *[F.avg(F.when(F.col("category") == k, rate)).alias(k) for k in parts])
    overall = sum((F.col(k) for k in parts), F.lit(0.0)) / len(parts)
    all_ = crawls.groupBy("project_id").agg(F.max(F.coalesce("blocked", F.lit(False))).alias("blocked")).join(means, "project_id", "left")
    none = lambda x: F.coalesce(x, F.lit(0))
    return all_.select("project_id", none(F.col("pages")).alias("pages"), *[none(rounded(F.col(k))).alias(k) for k in parts], none(rounded(overall)).alias("overall"), "blocked")


def report_pages(pages: DataFrame, crawls: DataFrame) -> DataFrame:
    """(project_id, page_id, score, checks): the share of a page's applicable checks that pass, in percent; pages of blocked crawls have no row."""
    single = lambda x: (x["total"] > 0) & ((x["category"] != "aeo") | x["check"].isin(*PAGE_AEO))
    rows = _checked(pages, crawls).withColumn("_checks", F.filter("_checks", single))
    score = rounded(F.size(F.filter("_checks", lambda x: x["passed"] == x["total"])) / F.size("_checks") * 100)
    status = lambda x: F.struct(x["check"].alias("check"), F.when(x["passed"] == x["total"], "pass").otherwise("fail").alias("status"), x["passed"].alias("passed"), x["total"].alias("total"))
    return rows.select("project_id", "page_id", score.alias("score"), F.transform("_checks", status).alias("checks"))
