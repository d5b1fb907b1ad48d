"""Links from other sites: found in external pages, and merged into the kept ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from crawlspan.functions import urls as U
from crawlspan.functions.html import without_tags

#: External pages that are looked at for a project, as live probes must be bounded.
PROBED = 100


def targets(links: DataFrame, most: int = PROBED) -> DataFrame:
    """(project_id, url): the external addresses that a project links to, those first seen, `most` of them. One row a distinct address is ranked."""
    first = links.filter("link_type = 'external'").groupBy("project_id", F.col("destination_url").alias("url")).agg(F.min("link_id").alias("_at"))
    return first.withColumn("_r", F.row_number().over(W.partitionBy("project_id").orderBy("_at", "url"))).filter(F.col("_r") <= most).select("project_id", "url")


def page_forms(pages: DataFrame) -> DataFrame:
    """(project_id, target, page_id): each page under its address with and without the last slash; of pages that share one the largest page_id."""
    bare = F.regexp_replace("url", "/$", "")
    forms = F.array_distinct(F.array(F.col("url"), bare, F.when(F.col("url").endswith("/"), F.col("url")).otherwise(F.concat(F.col("url"), F.lit("/")))))
    return pages.select("project_id", "page_id", F.explode(forms).alias("target")).groupBy("project_id", "target").agg(F.max("page_id").alias("page_id"))


def find(external: DataFrame, projects: DataFrame, pages: DataFrame) -> DataFrame:
    """(project_id, source_url, source_domain, target, page_id, anchor_text, is_followed): the links of external pages to projects.

    external: (project_id, url, status, content_type, html), pages that were fetched for a project. projects: (project_id, url).
    Only answered HTML pages of other sites count; hosts are compared without www. anchor_text is null if it is empty.
    """
    own = projects.select("project_id", U.bare_host(F.col("url")).alias("domain"))
    read = external.filter("status BETWEEN 200 AND 299 AND contains(content_type, 'text/html')").select("project_id", F.col("url").alias("source_url"), "html").join(own, "project_id").withColumn("source_domain", U.bare_host(F.col("source_url")))
    tags = F.explode(F.regexp_extract_all("html", F.lit(r"(?is)<a\s[^>]*?href\s*=\s*[\"'][^\"']+[\"'][^>]*>.*?</a>"), F.lit(0)))
    links = read.filter("source_domain != '' AND source_domain != domain").select("project_id", "domain", "source_url", "source_domain", tags.alias("tag"))
    href = F.regexp_extract("tag", r"(?i)^<a\s[^>]*?href\s*=\s*[\"']([^\"']+)[\"']", 1)
    # A browser writes an origin with a slash.
    goal = U.let(U.absolute(href, F.col("source_url")), lambda u: F.when(u.rlike(r"(?i)^[a-z][a-z0-9+.-]*://[^/?#]+$"), F.concat(u, F.lit("/"))).otherwise(u))
    found = links.withColumn("target", goal).filter(U.bare_host(F.col("target")) == F.col("domain"))
    rows = found.select(
        "project_id", "source_url", "source_domain", "target", F.nullif(without_tags(F.regexp_replace("tag", r"(?is)^<a\s[^>]*>|</a>$", "")), F.lit("")).alias("anchor_text"), (~F.col("tag").rlike(r"(?i)rel\s*=\s*[\"'][^\"']*nofollow[^\"']*[\"']")).alias("is_followed")
    )
    return rows.join(page_forms(pages), ["project_id", "target"], "left").select("project_id", "source_url", "source_domain", "target", "page_id", "anchor_text", "is_followed")


def reconcile(kept: DataFrame, found: DataFrame, at, complete: bool = True) -> DataFrame:
    """(project_id, source_url, page_id, anchor_text, is_followed, created_at, last_seen_at): the backlinks after a search.

    One row for each project and source; of several found the first by page, anchor. What was kept and is found again keeps its
    created_at. What isn't found again is dropped, but only if the search was complete. kept has the same columns.
    """
    keys = ["project_id", "source_url"]
    order = W.partitionBy(*keys).orderBy(F.col("page_id").asc_nulls_last(), F.col("anchor_text").asc_nulls_last(), F.col("is_followed").desc())
    now = found.withColumn("_r", F.row_number().over(order)).filter("_r = 1").select(*keys, "page_id", "anchor_text", "is_followed")
    before = kept.groupBy(*keys).agg(F.min("created_at").alias("_created"), F.max(F.struct("last_seen_at", "page_id", "anchor_text", "is_followed")).alias("_k"))
    new = now.join(before.select(*keys, "_created"), keys, "left").select(*keys, "page_id", "anchor_text", "is_followed", F.coalesce("_created", at).alias("created_at"), at.alias("last_seen_at"))
    if complete:
        return new
    old = before.join(now.select(*keys), keys, "left_anti").select(*keys, "_k.page_id", "_k.anchor_text", "_k.is_followed", F.col("_created").alias("created_at"), "_k.last_seen_at")
    return new.unionByName(old)
