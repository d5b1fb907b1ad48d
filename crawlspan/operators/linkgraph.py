"""Joins and aggregations over pages and links: duplicates, resolution, degrees, orphans, removed pages.

Group keys may be hot: results per member are joined back from an aggregate (which has map-side partial aggregation) and never
collected; in that join the rows of hot keys stay where they lie (`skew`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from crawlspan.operators import skew


def repeated_values(pages: DataFrame, value: Column, issue: str) -> DataFrame:
    """(project_id, page_id, issue_type, others): pages of a project that share a non-null value with others."""
    rows = pages.select("project_id", "page_id", value.alias("_v")).filter("_v IS NOT NULL AND project_id IS NOT NULL")
    sizes = rows.groupBy("project_id", "_v").agg(F.count("*").alias("_n")).filter("_n > 1").withColumn("others", F.col("_n") - 1)
    met = skew.joined(rows, sizes, ["project_id", "_v"], count="_n", total=rows.count())
    return met.select("project_id", "page_id", F.lit(issue).alias("issue_type"), "others")


def filled(text: str) -> Column:
    """The trimmed text, null if nothing is left."""
    return F.nullif(F.trim(text), F.lit(""))


def url_variants(pages: DataFrame) -> DataFrame:
    """(project_id, variant, page_id, http_status): each page under its address, in lower case, with and without the last slash.

    Of pages that share a variant the one with the largest page_id stands.
    """
    bare = F.regexp_replace("url", "/$", "")
    forms = F.array_distinct(F.array(F.col("url"), F.lower("url"), bare, F.concat(bare, F.lit("/")), F.lower(bare), F.lower(F.concat(bare, F.lit("/")))))
    return pages.select("project_id", "page_id", "http_status", F.explode(forms).alias("variant")).groupBy("project_id", "variant").agg(F.max(F.struct("page_id", "http_status")).alias("_p")).select("project_id", "variant", "_p.page_id", "_p.http_status")


def resolved(links: DataFrame, pages: DataFrame) -> DataFrame:
    """Internal links with the page they lead to and whether it answers with an error; both null if no page has that address."""
    inner = links.filter("link_type = 'internal'").select("link_id", "project_id", "source_page_id", F.lower("destination_url").alias("variant")).dropDuplicates(["link_id"])
    known = url_variants(pages).withColumnRenamed("page_id", "resolved_page_id")
    return inner.join(known, ["project_id", "variant"], "left").select("link_id", "source_page_id", "resolved_page_id", (F.col("http_status") >= 400).alias("broken"))


def deduplicated(links: DataFrame) -> DataFrame:
    """The first link (smallest link_id) of each source page and destination."""
    w = W.partitionBy("source_page_id", "destination_url").orderBy("link_id", "created_at")
    return links.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def degrees(links: DataFrame, pages: DataFrame) -> DataFrame:
    """(page_id, inlinks, unique_inlinks, outlinks, unique_outlinks) of every page, repeats of a link counted once."""
    once = links.select("link_id", "source_page_id", "destination_page_id", "destination_url").dropDuplicates(["link_id"])
    out = once.groupBy(F.col("source_page_id").alias("page_id")).agg(F.count("*").alias("outlinks"), F.countDistinct("destination_url").alias("unique_outlinks"))
    into = once.filter("destination_page_id IS NOT NULL").groupBy(F.col("destination_page_id").alias("page_id")).agg(F.count("*").alias("inlinks"), F.countDistinct("source_page_id").alias("unique_inlinks"))
    rows = pages.select("page_id").join(into, "page_id", "left").join(out, "page_id", "left")
    return rows.select("page_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("inlinks", "unique_inlinks", "outlinks", "unique_outlinks")])


def unlinked(links: DataFrame, pages: DataFrame) -> DataFrame:
    """(project_id, page_id): pages below the start page that no link leads to."""
    goals = links.select(F.col("destination_page_id").alias("page_id")).filter("page_id IS NOT NULL")
    return pages.filter("depth != 0").select("project_id", "page_id").join(goals, "page_id", "left_anti").select("project_id", "page_id")


def removed_pages(before: DataFrame, now: DataFrame, completed: bool = True) -> DataFrame:
    """(project_id, url): pages of an earlier crawl that the current one lacks; none unless the current crawl was completed."""
    gone = before.select("project_id", "url").distinct().join(now.select("project_id", "url"), ["project_id", "url"], "left_anti")
    return gone if completed else gone.limit(0)


def without_pages(gone: DataFrame, links: DataFrame) -> DataFrame:
    """The links that neither come from nor lead to the pages gone."""
    keys = gone.select("page_id").distinct()
    left = links.join(keys, links["source_page_id"] == keys["page_id"], "left_anti")
    return left.join(keys, left["destination_page_id"] == keys["page_id"], "left_anti")


def health(links: DataFrame, statuses: DataFrame, most: int | None = None) -> DataFrame:
    """External links with the status of their destination: broken from 400 on, and 0 (no answer) too; unknown stays null.

    `most`, if given, probes only that many destinations, those first seen, as a live probe must.
    """
    out = links.filter("link_type = 'external'")
    goals = out.groupBy("destination_url").agg(F.min("link_id").alias("_first"))
    if most is not None:
        goals = goals.orderBy("_first").limit(most)
    known = goals.join(statuses.select(F.col("url").alias("destination_url"), "status"), "destination_url").select("destination_url", "status")
    return out.join(known, "destination_url", "left").select("link_id", "destination_url", "status", ((F.col("status") >= 400) | (F.col("status") == 0)).alias("broken"))


def www_preference(links: DataFrame, url: str = "destination_url") -> DataFrame:
    """(project_id, www): `www` or `bare` if at least 70 % of five or more internal links say so, else `unknown`."""
    from crawlspan.functions.urls import host

    rows = links.filter("link_type = 'internal'").groupBy("project_id").agg(F.count("*").alias("_n"), F.count(F.when(host(F.col(url)).startswith("www."), 1)).alias("_w"))
    share = F.col("_w") / F.col("_n")
    return rows.select("project_id", F.when(F.col("_n") < 5, "unknown").when(share >= 0.7, "www").when(share <= 0.3, "bare").otherwise("unknown").alias("www"))


def first_results(results: DataFrame, order: str = "seq") -> DataFrame:
    """Crawl results without those of other schemes; of addresses that differ in letter case or blanks only the first by `order`."""
    http = results.filter(F.col("url").rlike("(?i)^https?://"))
    first = http.groupBy(F.lower(F.trim("url")).alias("_k")).agg(F.min(order).alias("_first"))
    return http.withColumn("_k", F.lower(F.trim("url"))).join(first, "_k").filter(F.col(order) == F.col("_first")).drop("_k", "_first")


def bogus_pages(pages: DataFrame) -> DataFrame:
    """Pages whose address is none of the web, or is another scheme's mangled into one."""
    return pages.filter(~F.coalesce(F.col("url").rlike("(?i)^https?://"), F.lit(False)) | F.col("url").rlike("(?i)^https?://(mailto|tel|javascript|sms|ftp):"))


def link_rows(results: DataFrame, pages: DataFrame, statuses: DataFrame | None = None) -> DataFrame:
    """(project_id, source_page_id, destination_page_id, destination_url, anchor_text, link_type, rel_attributes, is_followed, http_status,
    is_broken): the rows of page_links that crawled pages give, one for each page and destination, internal links first.

    results: (project_id, page_id, url, http_status, links), links as of `html.links`. pages: all known pages, (project_id, page_id, url).
    A link to a page of this crawl has its status; one to a known page that wasn't crawled counts as 200; an unknown one has none.
    statuses: (url, status, private) of probed external addresses: broken from 400 on, or 0 for no answer; a private one stays unknown.
    """
    flat = results.select("project_id", F.col("page_id").alias("source_page_id"), F.posexplode("links").alias("at", "l")).filter(F.col("l.url").rlike("(?i)^https?://"))
    rows = flat.select("project_id", "source_page_id", F.when(F.col("l.internal"), "internal").otherwise("external").alias("link_type"), "at", F.col("l.url").alias("destination_url"), F.col("l.anchor_text").alias("anchor_text"), F.col("l.rel").alias("rel_attributes"))
    # The first of a page's links to one destination, found by an aggregate that combines map-side.
    rest = F.struct(F.when(F.col("link_type") == "internal", 0).otherwise(1).alias("o"), "at", "link_type", "anchor_text", "rel_attributes")
    rows = rows.groupBy("project_id", "source_page_id", "destination_url").agg(F.min(rest).alias("f")).select("project_id", "source_page_id", "destination_url", "f.link_type", "f.anchor_text", "f.rel_attributes")
    known = url_variants(pages.withColumn("http_status", F.lit(None).cast("int"))).select("project_id", F.col("variant").alias("destination_url"), F.col("page_id").alias("exact_id"))
    low = known.withColumnsRenamed({"destination_url": "_low", "exact_id": "low_id"})
    crawled = results.groupBy("project_id", F.col("url").alias("destination_url")).agg(F.min("http_status").alias("seen_status"), F.lit(True).alias("seen"))
    inner = rows.filter("link_type = 'internal'").join(known, ["project_id", "destination_url"], "left").withColumn("_low", F.lower("destination_url")).join(low, ["project_id", "_low"], "left").drop("_low").join(crawled, ["project_id", "destination_url"], "left")
    goal = F.coalesce("exact_id", "low_id")
    status = F.when(goal.isNotNull(), F.when(F.col("seen"), F.col("seen_status")).otherwise(F.lit(200)))
    inner = inner.select("project_id", "source_page_id", goal.alias("destination_page_id"), "destination_url", "anchor_text", "link_type", "rel_attributes", status.alias("http_status"), F.coalesce(status >= 400, F.lit(False)).alias("is_broken"))
    outer = rows.filter("link_type = 'external'")
    if statuses is None:
        outer = outer.withColumns({"http_status": F.lit(None).cast("int"), "is_broken": F.lit(False)})
    else:
        probed = statuses.groupBy(F.col("url").alias("destination_url")).agg(F.min("status").alias("status"), F.max("private").alias("private"))
        private = F.coalesce("private", F.lit(False))
        outer = outer.join(probed, "destination_url", "left").withColumns({"http_status": F.when(~private, F.col("status")), "is_broken": F.coalesce(~private & ((F.col("status") >= 400) | (F.col("status") == 0)), F.lit(False))})
    both = inner.unionByName(outer.withColumn("destination_page_id", F.lit(None).cast(pages.schema["page_id"].dataType)).select(*inner.columns))
    return both.withColumn("is_followed", ~F.coalesce(F.array_contains("rel_attributes", "nofollow"), F.lit(False)))


def broken_internal(links: DataFrame) -> DataFrame:
    """(project_id, page_id, destination_url, http_status, fingerprint): an issue of the source page for each broken internal link."""
    rows = links.filter("link_type = 'internal' AND is_broken").select("project_id", F.col("source_page_id").alias("page_id"), "destination_url", "http_status").distinct()
    return rows.withColumn("fingerprint", F.concat(F.col("page_id").cast("string"), F.lit(":broken_internal_link:"), F.col("destination_url")))


def page_ids(rows: DataFrame, pages: DataFrame) -> DataFrame:
    """Rows with the page that has their address in their project; rows without one are dropped."""
    return rows.join(pages.select("project_id", "url", "page_id").distinct(), ["project_id", "url"])


def link_totals(results: DataFrame) -> DataFrame:
    """(project_id, links): links of all kinds on a crawl's pages."""
    return results.groupBy("project_id").agg(F.sum(F.size(F.coalesce("links", F.array().cast(results.schema["links"].dataType)))).alias("links"))


def homepages(pages: DataFrame) -> DataFrame:
    """(project_id, page_id): a page at depth 0 of each project, the smallest."""
    return pages.filter("depth = 0").groupBy("project_id").agg(F.min("page_id").alias("page_id"))


def cascade(gone: DataFrame, links: DataFrame, issues: DataFrame, backlinks: DataFrame, pages: DataFrame) -> dict[str, DataFrame]:
    """What is left of each table once pages are gone: links from or to them, their issues and backlinks, the pages themselves."""
    keys = gone.select("page_id").filter("page_id IS NOT NULL").distinct()
    rest = lambda df: df.join(keys, "page_id", "left_anti")
    return {"page_links": without_pages(gone, links), "issues": rest(issues), "backlinks": rest(backlinks), "pages": rest(pages)}
