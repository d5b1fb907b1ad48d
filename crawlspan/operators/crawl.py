"""Iterative operators: the crawl frontier over a link graph, and chains of redirects.

Each round is a join and an anti join; its result is cut off from its lineage by a checkpoint in the shared folder, so that
neither plans nor recovery grow with the rounds, and a lost executor costs one round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from crawlspan.sources.tables import checkpoint_dir


def frontier(seeds: DataFrame, edges: DataFrame, max_depth: int = 5, max_pages: int | None = None) -> DataFrame:
    """(key, depth): what a breadth-first crawl reaches. seeds: key. edges: src, dst. `max_pages` ends it, nearest keys first."""
    checkpoint_dir(seeds.sparkSession)
    links = edges.select("src", "dst").dropna().distinct().checkpoint()
    seen = seeds.select("key").dropna().distinct().withColumn("depth", F.lit(0)).checkpoint()
    last = seen
    for depth in range(1, max_depth + 1):
        found = last.join(links, last["key"] == links["src"]).select(F.col("dst").alias("key")).distinct().join(seen, "key", "left_anti").withColumn("depth", F.lit(depth)).checkpoint()
        if found.isEmpty():
            break
        seen, last = seen.unionByName(found), found
        if max_pages is not None and seen.count() >= max_pages:
            break
    return seen.orderBy("depth", "key").limit(max_pages) if max_pages is not None else seen


def redirect_chains(hops: DataFrame, most: int = 10, flagged: bool = False) -> DataFrame:
    """(start, final, hops, loops): where each redirecting address ends after at most `most` hops. With `flagged`, also `cut`: whether it goes
    on from there, so that final isn't final, and of several targets of an address the smallest counts."""
    checkpoint_dir(hops.sparkSession)
    step = hops.select("from_url", "to_url").dropna().groupBy("from_url").agg(F.min("to_url").alias("to_url")).checkpoint()
    rows = step.select(F.col("from_url").alias("start"), F.col("to_url").alias("final"), F.array("from_url", "to_url").alias("path"), (F.col("from_url") == F.col("to_url")).alias("loops"))
    done = None
    for _ in range(most - 1):
        rows = rows.join(step.withColumnsRenamed({"from_url": "final", "to_url": "next"}), "final", "left").checkpoint()
        ended = rows.filter("next IS NULL OR loops").select("start", "final", "path", "loops")
        done = ended if done is None else done.unionByName(ended)
        rows = rows.filter("next IS NOT NULL AND NOT loops").select("start", F.col("next").alias("final"), F.concat("path", F.array("next")).alias("path"), F.array_contains("path", F.col("next")).alias("loops"))
    found = rows.select("start", "final", "path", "loops") if done is None else done.unionByName(rows.select("start", "final", "path", "loops"))
    found = found.select("start", "final", (F.size("path") - 1).alias("hops"), "loops")
    if not flagged:
        return found
    goes_on = step.select(F.col("from_url").alias("final"), F.lit(True).alias("_on"))
    return found.join(goes_on, "final", "left").select("start", "final", "hops", "loops", (F.coalesce("_on", F.lit(False)) & ~F.col("loops")).alias("cut"))


def seeds(start: DataFrame, custom: DataFrame, listed: DataFrame, max_depth: int = 5) -> DataFrame:
    """(project_id, url, depth): where a crawl begins: the start (0), custom addresses (1), sitemap entries at the depth of their path, as far as allowed.

    All are frames of (project_id, url). An address that several name is taken at its smallest depth; null and excluded ones never.
    """
    from crawlspan.functions import urls as U

    url = U.normalize(F.col("url"))
    at = lambda df, depth: df.select("project_id", url.alias("url"), depth.alias("depth"))
    rows = at(start, F.lit(0)).unionByName(at(custom, F.lit(1))).unionByName(at(listed, U.path_depth(F.col("url"))).filter(F.col("depth") <= max_depth))
    rows = rows.filter(F.col("url").isNotNull() & (~U.is_excluded(F.col("url")) | (F.col("depth") == 0)))
    return rows.groupBy("project_id", "url").agg(F.min("depth").alias("depth"))


def enqueued(links: DataFrame, seen: DataFrame) -> DataFrame:
    """(project_id, url, parent_seq, priority, at): the links of a round that a crawl takes up, in the place where each is first met.

    links: (project_id, parent_seq, depth, at, href, page_url). seen: (project_id, url). Addresses are cleaned; what is excluded or seen is left out.
    Order of the queue: parent_seq, priority (descending), at.
    """
    from crawlspan.functions import urls as U

    rows = links.withColumn("url", U.cleaned(F.col("href"), F.col("page_url"))).filter(F.col("url").isNotNull()).filter(~U.is_excluded(F.col("url")))
    rows = rows.withColumn("priority", U.crawl_priority(F.col("url"), F.col("depth")).cast("int"))
    first = rows.groupBy("project_id", "url").agg(F.min(F.struct("parent_seq", (-F.col("priority")).alias("p"), "at")).alias("q"))
    return first.join(seen.select("project_id", "url").distinct(), ["project_id", "url"], "left_anti").select("project_id", "url", "q.parent_seq", (-F.col("q.p")).alias("priority"), "q.at")


def next_batch(queue: DataFrame, size: int) -> DataFrame:
    """The first `size` addresses of each project's queue."""
    w = W.partitionBy("project_id").orderBy("parent_seq", F.desc("priority"), "at", "url")
    return queue.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= size).drop("_r")


def kept_results(tries: DataFrame, retries: int = 2) -> DataFrame:
    """Of the tries at each address (project_id, url, attempt, status, blocked) the one that counts, and whether it is kept.

    A try with a server error, 429 or no answer (0) is made again, up to `retries` times; errors are kept then, but not what had no answer or
    was blocked. state is `kept`, `dropped` or `retry`.
    """
    last = tries.groupBy("project_id", "url").agg(F.max(F.struct("attempt", "status", "blocked")).alias("t")).select("project_id", "url", "t.attempt", "t.status", "t.blocked")
    again = (F.col("status") >= 500) | F.col("status").isin(429, 0)
    blocked = F.coalesce("blocked", F.lit(False))
    state = F.when(blocked, "dropped").when(again & (F.col("attempt") <= retries), "retry").when(F.col("status") == 0, "dropped").otherwise("kept")
    return last.withColumn("state", state)


def progress(scans: DataFrame) -> DataFrame:
    """Scans (scan_id, scanned, queued) with an estimate of all pages and a percentage, 95 at most."""
    estimate = F.greatest(F.lit(1.5) * F.col("scanned"), (F.col("queued") + F.col("scanned")).cast("double"))
    return scans.withColumns({"estimated": estimate, "percent": F.least(F.lit(95), F.floor(F.lit(100) * F.col("scanned") / F.greatest(F.lit(1.0), estimate) + 0.5)).cast("int")})


def completed(scans: DataFrame) -> DataFrame:
    """Scans (scan_id, scanned, queued, max_pages, seconds, timeout) with `completed`: whether the queue ran empty. A null timeout is its default."""
    limit = F.coalesce("timeout", F.greatest(F.lit(300), F.col("max_pages") * 2))
    return scans.withColumns({"timeout": limit, "completed": (F.col("queued") == 0) & (F.col("scanned") <= F.col("max_pages")) & (F.col("seconds") <= limit)})


def block_verdicts(results: DataFrame, own_ip: str | None = None) -> DataFrame:
    """(project_id, blocked_pages, total_pages, egress_ip): crawls that a site blocked: its homepage, or half of what was tried.

    results: (project_id, homepage, blocked, error). The address is the one that an error names, else `own_ip`.
    """
    no = F.lit(False)
    blocked = F.coalesce("blocked", no)
    ip = F.nullif(F.regexp_extract("error", r"(?i)blocked IP (\d{1,3}(?:\.\d{1,3}){3})", 1), F.lit(""))
    rows = results.groupBy("project_id").agg(F.count(F.when(blocked, 1)).alias("blocked_pages"), F.count("*").alias("total_pages"), F.max(blocked & F.coalesce("homepage", no)).alias("_home"), F.min(F.when(blocked, ip)).alias("_ip"))
    return rows.filter((F.col("blocked_pages") > 0) & (F.col("_home") | (F.col("blocked_pages") * 2 >= F.col("total_pages")))).select("project_id", "blocked_pages", "total_pages", F.coalesce("_ip", F.lit(own_ip)).alias("egress_ip"))
