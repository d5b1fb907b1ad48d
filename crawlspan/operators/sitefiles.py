"""robots.txt, llms.txt and sitemaps: their lines and entries as rows, and what follows from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from crawlspan.functions.urls import sitemap_key
from crawlspan.sources.tables import checkpoint_dir

# Agents of answer engines.
AGENTS = (
    "GPTBot", "ChatGPT-User", "ClaudeBot", "Claude-Web", "PerplexityBot", "Google-Extended", "Amazonbot", "Bytespider", "CCBot", "cohere-ai", "Diffbot", "FacebookBot", "ImagesiftBot", "Omgilibot", "YouBot",
)


def _robots_lines(files: DataFrame) -> DataFrame:
    """(site, at, field, value, agent): the lines of (site, content) that count, each with the agent whose line stands last before it.

    Lines are trimmed; those that are blank or begin with # don't count, but a # within a line belongs to its value. A file's lines are
    ordered in one task, as a file is one record.
    """
    lines = files.select("site", F.posexplode(F.split("content", r"\n")).alias("at", "line")).withColumn("line", F.regexp_replace("line", r"^\s+|\s+$", "")).filter("line != '' AND NOT startswith(line, '#')")
    field = F.lower(F.regexp_extract("line", r"(?i)^(sitemap|user-agent|disallow|allow):", 1))
    pairs = lines.select("site", "at", field.alias("field"), F.regexp_replace(F.regexp_extract("line", "^[^:]*:(.*)$", 1), r"^\s+|\s+$", "").alias("value")).filter("field != ''")
    w = W.partitionBy("site").orderBy("at").rowsBetween(W.unboundedPreceding, W.currentRow)
    return pairs.withColumn("agent", F.last(F.when(F.col("field") == "user-agent", F.col("value")), ignorenulls=True).over(w))


def robots_agents(files: DataFrame) -> DataFrame:
    """(site, agent, at, allow, disallow): each agent as it is written, where it is first named, and the values of its rules in order."""
    lines = _robots_lines(files).filter("agent IS NOT NULL AND agent != ''")
    mine = lambda f: F.transform(F.array_sort(F.collect_list(F.when((F.col("field") == f) & (F.col("value") != ""), F.struct("at", "value")))), lambda x: x["value"])
    return lines.groupBy("site", "agent").agg(F.min(F.when(F.col("field") == "user-agent", F.col("at"))).alias("at"), mine("allow").alias("allow"), mine("disallow").alias("disallow"))


def robots_rules(files: DataFrame) -> DataFrame:
    """(site, agent, kind, value, at): the rules of (site, content); kind is `allow`, `disallow` or `sitemap` (which has no agent)."""
    rules = _robots_lines(files).filter("field != 'user-agent' AND value != ''").filter((F.col("field") == "sitemap") | (F.coalesce("agent", F.lit("")) != ""))
    return rules.select("site", F.when(F.col("field") != "sitemap", F.col("agent")).alias("agent"), F.col("field").alias("kind"), "value", "at")


def agent_verdicts(files: DataFrame) -> DataFrame:
    """(site, agent, verdict): `blocked` or `allowed` for agents of answer engines; an agent that no line names and none blocks has no row.

    Agents are taken in the order in which a file first names them, up to the agent itself: one of all agents that stands before it
    blocks it, whatever its own rules say. A root that is also allowed isn't blocked.
    """
    found = robots_agents(files).withColumn("shut", F.array_contains("disallow", "/") & ~F.array_contains("allow", "/"))
    every = found.filter("agent = '*'").groupBy("site").agg(F.min("at").alias("all_at"), F.max_by("shut", -F.col("at")).alias("all_shut"))
    own = found.filter("agent != '*'").groupBy("site", F.lower("agent").alias("low")).agg(F.min("at").alias("at"), F.max_by("shut", -F.col("at")).alias("shut"))
    agents = files.select("site").distinct().select("site", F.explode(F.array(*[F.lit(a) for a in AGENTS])).alias("name")).withColumn("low", F.lower("name"))
    rows = agents.join(own, ["site", "low"], "left").join(every, "site", "left")
    blocked = F.coalesce("shut", F.lit(False)) | (F.coalesce("all_shut", F.lit(False)) & (F.col("at").isNull() | (F.col("all_at") < F.col("at"))))
    return rows.select("site", F.col("name").alias("agent"), F.when(blocked, "blocked").when(F.col("at").isNotNull(), "allowed").alias("verdict")).filter("verdict IS NOT NULL")


def blocked_agents(files: DataFrame) -> DataFrame:
    """(site, agent): agents of answer engines that may not read a site."""
    return agent_verdicts(files).filter("verdict = 'blocked'").select("site", "agent")


def blocked_paths(files: DataFrame) -> DataFrame:
    """(site, agent, paths): what each agent may not read; agents without such rules have no row."""
    return robots_agents(files).filter(F.size("disallow") > 0).select("site", "agent", F.col("disallow").alias("paths"))


def llms_fields(files: DataFrame) -> DataFrame:
    """(site, field, value): the `field: value` lines of (site, content), fields in lower case; the last of a field counts."""
    lines = files.select("site", F.posexplode(F.split("content", r"\r?\n")).alias("at", "line")).filter("locate(':', line) > 1")
    pairs = lines.select("site", "at", F.lower(F.trim(F.regexp_extract("line", "^([^:]+):", 1))).alias("field"), F.trim(F.regexp_extract("line", "^[^:]+:(.*)$", 1)).alias("value"))
    return pairs.groupBy("site", "field").agg(F.max_by("value", "at").alias("value"))


#: Characters of llms.txt that are read at most, and that are kept.
LLMS_MOST, LLMS_KEPT = 100_000, 5_000


def llms_file(responses: DataFrame) -> DataFrame:
    """(site, exists, content): of (site, status, content_type, content): whether it is a text that isn't blank or too long, and its beginning."""
    good = F.col("status").between(200, 299) & F.startswith(F.lower("content_type"), F.lit("text/")) & F.col("content").rlike(r"\S") & (F.length("content") <= LLMS_MOST)
    good = F.coalesce(good, F.lit(False))
    return responses.select("site", good.alias("exists"), F.when(good, F.substring("content", 1, LLMS_KEPT)).alias("content"))


def exists(responses: DataFrame) -> DataFrame:
    """(site, kind, exists) of probes (site, kind, status): answered with success; no answer is none."""
    return responses.select("site", "kind", F.coalesce(F.col("status").between(200, 299), F.lit(False)).alias("exists"))


#: Sitemaps below an index that are read for a site, and how deep indexes may lie.
SUB_MOST, DEPTH_MOST = 50, 3


def sitemap_tree(roots: DataFrame, files: DataFrame, most: int = SUB_MOST, depth: int = DEPTH_MOST) -> DataFrame:
    """(site, url, level, number, status, content): the root sitemaps and what their indexes lead to, breadth first.

    roots: (site, url). files: (url, status, content), what an address answers; addresses that aren't there give no row and don't count.
    An address is taken once, by its sitemap key. Up to `most` sitemaps below the root are taken, numbered from 1 in the order
    of the queue; `number` 0 is the root. Indexes on level `depth` aren't followed. Each level is a join with the files, cut off by a checkpoint.
    """
    checkpoint_dir(files.sparkSession)
    files = files.groupBy(sitemap_key(F.col("url")).alias("k")).agg(F.min(F.struct("url", "status", "content")).alias("f")).filter("k IS NOT NULL").select("k", "f.status", "f.content")
    level = roots.groupBy("site").agg(F.min("url").alias("url")).select("site", "url", sitemap_key(F.col("url")).alias("k"), F.array(F.lit(0)).alias("way")).join(files, "k").withColumn("level", F.lit(0)).checkpoint()
    found = level
    for n in range(1, depth + 1):
        ways = level.filter("status BETWEEN 200 AND 299 AND contains(content, '<sitemapindex')").select("site", "way", F.posexplode(locs("content")).alias("at", "url"))
        ways = ways.select("site", "url", sitemap_key(F.col("url")).alias("k"), F.concat("way", F.array("at")).alias("way")).filter("k IS NOT NULL")
        first = ways.groupBy("site", "k").agg(F.min(F.struct("way", "url")).alias("x")).select("site", "k", "x.way", "x.url").join(found.select("site", "k"), ["site", "k"], "left_anti")
        level = first.join(files, "k").select("k", "site", "url", "way", "status", "content").withColumn("level", F.lit(n)).checkpoint()
        found = found.unionByName(level)
    numbered = found.withColumn("number", F.row_number().over(W.partitionBy("site").orderBy("level", "way")) - 1)
    return numbered.filter(F.col("number") <= most).select("site", "url", "level", "number", "status", "content")


def locs(content: str) -> Column:
    """The http addresses that XML lists, in order."""
    found = F.coalesce(F.regexp_extract_all(F.col(content), F.lit(r"(?i)<loc>[ \t]*([^<\r\n]+?)[ \t]*</loc>"), F.lit(1)), F.array().cast("array<string>"))
    return F.filter(found, lambda u: u.rlike("(?i)^https?://"))


def sitemap_validation(tree: DataFrame, roots: DataFrame, most: int = SUB_MOST, depth: int = DEPTH_MOST) -> DataFrame:
    """(site, found, valid, url_count, has_lastmod, sub_sitemaps, errors) of each root, from `sitemap_tree` with one sitemap more than `most`.

    valid: it lists pages and nothing went wrong so far; that it lists none or has no dates is added to the errors afterwards.
    """
    is_map = F.contains("content", F.lit("<urlset")) | F.contains("content", F.lit("<sitemapindex"))
    is_index = F.contains("content", F.lit("<sitemapindex"))
    ok = F.coalesce(F.col("status").between(200, 299), F.lit(False))
    within = F.col("number") <= most
    error = (
        F.when((F.col("number") == 0) & ~ok, F.concat(F.lit("Sitemap returned HTTP "), F.col("status").cast("string"))).when((F.col("number") == 0) & ~is_map, F.lit("Sitemap does not contain valid XML urlset or sitemapindex"))
        .when(~within, F.lit(f"Sitemap index lists more than {most} sub-sitemaps; only the first {most} were scanned")).when(~ok, F.concat(F.lit("Sub-sitemap "), F.col("url"), F.lit(" returned HTTP "), F.col("status").cast("string")))
        .when((F.col("number") > 0) & is_index & (F.col("level") >= depth), F.concat(F.lit(f"Sitemap nesting exceeds {depth} levels; "), F.col("url"), F.lit(" not fully traversed")))
    )
    read = ok & within & ((F.col("number") > 0) | is_map)
    # The first sitemap beyond the bound only says that there are more.
    rows = tree.filter(F.col("number") <= most + 1).withColumns({"_error": error, "_read": read, "_lists": read & ~is_index, "_dated": read & F.contains("content", F.lit("<lastmod>"))})
    listed = rows.filter("_lists").select("site", F.explode(locs("content")).alias("u")).groupBy("site").agg(F.countDistinct("u").alias("url_count"))
    errors = F.transform(F.array_sort(F.collect_list(F.when(F.col("_error").isNotNull(), F.struct("number", F.col("_error").alias("e"))))), lambda x: x["e"])
    state = rows.groupBy("site").agg(
        errors.alias("e"), F.max("_dated").alias("has_lastmod"), F.count(F.when(within & (F.col("number") > 0), 1)).alias("sub_sitemaps"), F.max(F.when(F.col("number") == 0, ok)).alias("found"), F.max(F.when(F.col("number") == 0, F.col("_read"))).alias("_readable")
    )
    rows = roots.select("site").distinct().join(state, "site", "left").join(listed, "site", "left")
    n, e = F.coalesce("url_count", F.lit(0)), F.coalesce("e", F.array(F.lit("Sitemap returned no answer")))
    readable = F.coalesce("_readable", F.lit(False))
    later = F.filter(F.array(F.when(readable & (n == 0), F.lit("Sitemap contains no URLs")), F.when(readable & ~F.col("has_lastmod"), F.lit("Sitemap is missing <lastmod> dates"))), lambda x: x.isNotNull())
    no = F.lit(False)
    return rows.select("site", F.coalesce("found", no).alias("found"), (readable & (n > 0) & (F.size(e) == 0)).alias("valid"), n.alias("url_count"), F.coalesce("has_lastmod", no).alias("has_lastmod"), F.coalesce("sub_sitemaps", F.lit(0)).alias("sub_sitemaps"), F.concat(e, later).alias("errors"))


#: Pages that may be missing from a sitemap before it is an issue, and how many of them are shown.
UNLISTED_LEAST, UNLISTED_SHOWN = 5, 10


def site_issues(homepages: DataFrame, llms: DataFrame, robots: DataFrame, verdicts: DataFrame, maps: DataFrame, unlisted: DataFrame) -> DataFrame:
    """(site, page_id, issue_type, severity, description): the issues of a whole site, at its homepage; a site without one has none.

    homepages: (site, page_id). llms, robots: (site, exists), where they were looked for. verdicts: of `agent_verdicts`. maps: of
    `sitemap_validation`. unlisted: (site, url), crawled pages that no sitemap has.
    """
    order = F.array(*[F.lit(a) for a in AGENTS])
    shut = verdicts.filter("verdict = 'blocked'").groupBy("site").agg(F.array_sort(F.collect_set(F.struct(F.array_position(order, F.col("agent")).alias("at"), "agent"))).alias("shut"))
    away = unlisted.groupBy("site").agg(F.count("*").alias("away"))
    rows = homepages.groupBy("site").agg(F.min("page_id").alias("page_id"))
    for name, df in (("llms", llms), ("robots", robots)):
        rows = rows.join(df.groupBy("site").agg(F.max("exists").alias(f"has_{name}")), "site", "left")
    rows = rows.join(shut, "site", "left").join(away, "site", "left").join(maps, "site", "left")
    n = F.size("shut")
    one = lambda name, severity, cond, text: F.when(cond, F.struct(F.lit(name).alias("issue_type"), F.lit(severity).alias("severity"), text.alias("description")))
    say = F.lit
    found = F.array(
        one("missing_llms_txt", "low", ~F.col("has_llms"), say("No llms.txt file found. This file helps AI models understand your site.")),
        one("missing_robots_txt", "medium", ~F.col("has_robots"), say("No robots.txt file found. This file controls how search engines crawl your site.")),
        one("ai_bots_blocked", "low", n > 0, F.concat(n.cast("string"), say(" AI bot(s) blocked in robots.txt: "), F.array_join(F.transform("shut", lambda x: x["agent"]), ", "))),
        one("missing_sitemap", "medium", ~F.col("found"), say("No XML sitemap found at /sitemap.xml. Sitemaps help search engines discover your pages.")),
        one("invalid_sitemap", "medium", F.col("found") & ~F.col("valid"), F.concat(say("XML sitemap has "), F.size("errors").cast("string"), say(" error(s): "), F.array_join("errors", "; "))),
        one("sitemap_missing_lastmod", "low", F.col("found") & ~F.col("has_lastmod"), say("Sitemap is missing <lastmod> dates. These help search engines know when to re-crawl pages.")),
        one("pages_not_in_sitemap", "low", F.col("away") > UNLISTED_LEAST, F.concat(F.col("away").cast("string"), say(" crawled pages are not in the sitemap"))),
    )
    return rows.select("site", "page_id", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("i")).select("site", "page_id", "i.issue_type", "i.severity", "i.description")


def sitemap_entries(files: DataFrame) -> DataFrame:
    """(site, loc): the http addresses that the XML of (site, content) lists."""
    locs = F.explode(F.regexp_extract_all("content", F.lit(r"(?i)<loc>\s*([^<\s]+)\s*</loc>"), F.lit(1)))
    return files.select("site", locs.alias("loc")).filter(F.col("loc").rlike("(?i)^https?://"))


def sitemap_difference(entries: DataFrame, pages: DataFrame) -> DataFrame:
    """(site, url, side): entries that no answering page has, and answering pages that no entry has. pages: site, url, status."""
    listed = entries.select("site", F.col("loc").alias("url"), sitemap_key(F.col("loc")).alias("k"))
    crawled = pages.filter("status >= 200 AND status < 400").select("site", "url", sitemap_key(F.col("url")).alias("k"))
    # Both sides in one aggregation on the key: the smallest address of each side, and where the other side has none.
    rows = listed.withColumn("s", F.lit("only_in_sitemap")).unionByName(crawled.withColumn("s", F.lit("not_in_sitemap"))).filter("k IS NOT NULL")
    sides = rows.groupBy("site", "k").agg(F.min(F.when(F.col("s") == "only_in_sitemap", F.col("url"))).alias("a"), F.min(F.when(F.col("s") == "not_in_sitemap", F.col("url"))).alias("b"))
    return sides.filter("a IS NULL OR b IS NULL").select("site", F.coalesce("a", "b").alias("url"), F.when(F.col("b").isNull(), "only_in_sitemap").otherwise("not_in_sitemap").alias("side"))
