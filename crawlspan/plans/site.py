"""Queries of the crawl and site-audit operators over the audit tables, and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crawlspan.functions import html as H
from crawlspan.functions import text as T
from crawlspan.functions import urls as U
from crawlspan.operators import crawl, linkgraph, merge, pagefacts, scores, sitefiles, snapshots
from crawlspan.sources.rendered import html_sql, rendered
from crawlspan.sources.tables import checkpoint_dir, evenly, read
from crawlspan.streaming import logs

QUERIES = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# --- DuckDB texts for what several queries share
Q = "[\"'']"


def att(tag: str, name: str) -> str:
    return f"regexp_extract({tag}, '(?i)[\\s\"'']{name}={Q}([^\"'']*){Q}', 1)"


def having(tags: str, cond: str) -> str:
    return f"list_filter({tags}, lambda t: {cond})"


PART = "'^\\s*([A-Za-z][A-Za-z0-9+.\\-]*)://([^/?#\\s]+)([^?#]*)(\\?[^#]*)?(#.*)?$'"
part = lambda u, n: f"coalesce(regexp_extract({u}, {PART}, {n}), '')"
d_host = lambda u: f"lower(regexp_extract({part(u, 2)}, '^([^@]*@)?([^:]*)', 2))"
d_bare = lambda u: f"regexp_replace({d_host(u)}, '^www\\.', '')"
d_path = lambda u: f"CASE WHEN {part(u, 3)} = '' THEN '/' ELSE {part(u, 3)} END"
TRACK = ", ".join(f"'{t}'" for t in U.TRACKING)


def d_normal(u: str) -> str:
    """Canonical form of an absolute address."""
    p = f"({d_path(u)})"
    kept = f"list_filter(string_split(substr({part(u, 4)}, 2), '&'), lambda x: x <> '' AND regexp_extract(x, '^([^=]*)', 1) NOT IN ({TRACK}))"
    return (
        f"CASE WHEN regexp_matches(trim({u}), '(?i)^https?://') AND regexp_matches({u}, {PART}) AND NOT contains({part(u, 2)}, '@') THEN 'https://' || lower({part(u, 2)}) || "
        f"CASE WHEN length({p}) > 1 AND ends_with({p}, '/') THEN substr({p}, 1, length({p}) - 1) ELSE {p} END || CASE WHEN len({kept}) > 0 THEN '?' || array_to_string({kept}, '&') ELSE '' END END"
    )


d_inside = lambda a, b: f"({d_bare(a)} <> '' AND {d_bare(b)} <> '' AND ({d_bare(a)} = {d_bare(b)} OR ends_with({d_bare(a)}, '.' || {d_bare(b)}) OR ends_with({d_bare(b)}, '.' || {d_bare(a)})))"
VISIBLE = "trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\\b[^>]*>.*?</script>', ' ', 'g'), '(?is)<style\\b[^>]*>.*?</style>', ' ', 'g'), '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g'))"
SPLIT = "list_filter(regexp_split_to_array({x}, '[\\s\\x{{00A0}}\\x{{FEFF}}]+'), lambda w: w <> '')"
RAW = (
    f"WITH r AS (SELECT *, {html_sql('duckdb')} AS html FROM pages), t AS (SELECT *, regexp_extract_all(html, '(?i)<meta\\b[^>]*>') AS metas, regexp_extract_all(html, '(?i)<link\\b[^>]*>') AS lnks, "
    f"regexp_extract_all(html, '(?i)<img\\b[^>]*>') AS imgs, regexp_extract_all(html, '(?i)<script\\b[^>]*>') AS scripts FROM r)"
)
PAYMENT = ", ".join(f"'{t}'" for t in H.PAYMENT_TITLES)


def d_clean(t: str) -> str:
    for name, sign in H.REFERENCES:
        t = "replace({}, '{}', '{}')".format(t, name, sign.replace("'", "''"))
    t = f"trim({t}, ' ')"
    for s in H.SUFFIXES:
        t = f"regexp_replace({t}, '(?i)\\s*[|–—]\\s*{s}.*$', '')"
    return f"trim(regexp_replace({t}, '\\s+', ' ', 'g'), ' ')"


OWN = "regexp_extract(html, '(?i)<title[^>]*>([^\\n\\r]*?)</title>', 1)"
OG = f"regexp_extract(html, '(?i)<meta[^>]*property={Q}og:title{Q}[^>]*content={Q}([^\"'']*){Q}', 1)"
FIRST = "trim(regexp_replace(regexp_extract(html, '(?i)<h1[^>]*>([^\\n\\r]*?)</h1>', 1), '<[^>]+>', '', 'g'))"
fits = lambda t: f"(length({t}) >= 2 AND lower(trim({t})) NOT IN ({PAYMENT}))"
TITLE = f"CASE WHEN {fits(OWN)} THEN {d_clean(OWN)} WHEN {fits(OG)} THEN {d_clean(OG)} WHEN {fits(FIRST)} THEN {d_clean(FIRST)} ELSE {OWN} END"
DESCRIPTION = f"{att(having('metas', 'lower(' + att('t', 'name') + chr(41) + chr(61) + chr(39) + 'description' + chr(39)) + '[1]', 'content')}"
heads = lambda n: f"list_filter(list_transform(regexp_extract_all(html, '(?is)<h{n}\\b[^>]*>(.*?)</h{n}>', 1), lambda h: trim(regexp_replace(h, '<[^>]+>', '', 'g'))), lambda h: h <> '')"
prefixed = lambda p: f"len(list_distinct(list_filter(list_transform(metas, lambda t: regexp_extract(t, '(?i)(?:property|name)={Q}{p}:([^\"'']*){Q}', 1)), lambda x: x <> '')))"
CANON = att(having("lnks", f"regexp_matches(t, '(?i)rel={Q}canonical{Q}[^>]*href=')") + "[1]", "href")
HINTS = f"(len({having('lnks', 'lower(' + att('t', 'rel') + ') IN (' + chr(39) + 'preconnect' + chr(39) + ',' + chr(39) + 'preload' + chr(39) + ') AND ' + att('t', 'href') + ' <> ' + chr(39) * 2)}))"
LANG = "nullif(regexp_extract(html, '(?i)<html[^>]*\\slang=[\"'']([^\"'']+)[\"'']', 1), '')"
LANDMARKS = " + ".join(f"CAST(regexp_matches(html, '(?i)<{n}[\\s>]') AS INT)" for n in H.LANDMARKS)
MIXED = H.MIXED.replace("'", "''")
META = f"""SELECT page_id, project_id, url, http_status, word_count, size_bytes, load_time_ms, is_indexable, {TITLE} AS page_title, {DESCRIPTION} AS description, len({heads(1)}) AS h1_count,
  CASE WHEN canonical_url IS NULL THEN NULL ELSE {CANON} END AS canonical,
  len({having('metas', f"regexp_matches(t, '(?i)name={Q}robots{Q}[^>]*content=') AND contains(lower({att('t', 'content')}), 'noindex')")}) > 0 AS noindex,
  {prefixed('og')} AS og_count, {prefixed('twitter')} AS twitter_count, coalesce(len(schema_types), 0) AS schema_count,
  len({having('metas', f"lower({att('t', 'name')}) = 'viewport'")}) > 0 AS viewport, starts_with(url, 'https://') AND regexp_matches(html, '(?i){MIXED}') AS mixed_content,
  {LANG} AS lang, {LANDMARKS} AS landmark_count, regexp_matches(html, '(?i)href={Q}#[^"'']*{Q}[^>]*>[^<]*(skip|jump to)') AS skip_link, {HINTS} AS hint_count, regexp_matches(html, '(?i){H.CONSENT}') AS consent,
  page_id % 6 = 0 AS contact_form, len(list_filter(scripts, lambda t: {att('t', 'src')} <> '')) AS js_count, len({having('lnks', f"lower({att('t', 'rel')}) = 'stylesheet' AND {att('t', 'href')} <> ''")}) AS css_count,
  len({having('imgs', f"NOT (regexp_matches(t, 'width={Q}?[0-9]') AND regexp_matches(t, 'height={Q}?[0-9]'))")}) AS shifting_images FROM t"""
FACTS = ["page_title", "description", "h1_count", "canonical", "noindex", "og_count", "twitter_count", "schema_count", "viewport", "mixed_content", "lang", "landmark_count", "skip_link", "hint_count", "consent", "contact_form", "js_count", "css_count", "shifting_images"]


def _pages(spark: SparkSession, d: str) -> DataFrame:
    return rendered(evenly(read(spark, d, "pages")))


@query(RAW + f", m AS ({META}) SELECT page_id, {', '.join(FACTS)} FROM m")
def page_facts(spark: SparkSession, d: str) -> DataFrame:
    return pagefacts.facts(_pages(spark, d)).select("page_id", *FACTS)


@query(f"WITH r AS (SELECT *, {html_sql('duckdb')} AS html FROM pages), v AS (SELECT page_id, {VISIBLE} AS x FROM r) SELECT page_id, length(x) AS text_length, len({SPLIT.format(x='x')}) AS words FROM v")
def page_text(spark: SparkSession, d: str) -> DataFrame:
    return _pages(spark, d).select("page_id", F.length(H.visible_text(F.col("html"))).alias("text_length"), H.word_count(F.col("html")).alias("words"))


@query(
    f"""WITH r AS (SELECT *, {html_sql('duckdb')} AS html FROM pages), p AS (SELECT page_id, list_filter([{', '.join(f'CASE WHEN len({heads(n)}) > 0 THEN {n} END' for n in range(1, 7))}], lambda n: n IS NOT NULL) AS l FROM r),
    g AS (SELECT page_id, list_filter(list_transform(range(1, len(l)), lambda i: CASE WHEN l[i + 1] - l[i] > 1 THEN 'h' || l[i] || '-h' || l[i + 1] END), lambda x: x IS NOT NULL) AS x FROM p)
    SELECT page_id, array_to_string(x, ',') AS gaps FROM g"""
)
def heading_hierarchy(spark: SparkSession, d: str) -> DataFrame:
    return _pages(spark, d).select("page_id", F.array_join(H.heading_gaps(H.headings(F.col("html"))), ",").alias("gaps"))


_FOLDER = f"regexp_replace({d_path('url')}, '[^/]*$', '')"
_BASE = "'https://' || lower(" + part("url", 2) + ")"


@query(
    f"""WITH p AS (SELECT * FROM pages WHERE regexp_matches(url, {PART})), l AS (
      SELECT page_id, CASE WHEN page_id % 3 = 0 THEN NULL END AS x, {_BASE} || '/item/' || (page_id % 50) || '?b=2' AS goal, 'Read more' AS anchor_text, '' AS rel, true AS internal FROM p
      UNION ALL SELECT page_id, NULL, {_BASE} || regexp_replace({_FOLDER}, '[^/]+/$', '') || 'up/page', 'Up', 'nofollow,noopener', true FROM p
      UNION ALL SELECT page_id, NULL, 'https://other.test/x', 'here', '', false FROM p WHERE page_id % 3 = 2)
    SELECT page_id, goal, anchor_text, rel, internal FROM l"""
)
def link_extract(spark: SparkSession, d: str) -> DataFrame:
    rows = _pages(spark, d).select("page_id", F.explode_outer(H.links(F.col("html"), F.col("url"))).alias("l")).filter("l IS NOT NULL")
    return rows.select("page_id", F.col("l.url").alias("goal"), "l.anchor_text", F.array_join("l.rel", ",").alias("rel"), "l.internal")


@query(
    f"""WITH p AS (SELECT page_id, url FROM pages WHERE regexp_matches(url, {PART})), o AS (SELECT page_id, regexp_extract(url, '^\\s*([A-Za-z]+://[^/?#]+)', 1) AS o, {_FOLDER} AS f FROM p)
    SELECT page_id, o || '/a.jpg' AS src, 'A' AS alt, 10 AS width, 20 AS height, '' AS loading, 'jpeg' AS format FROM o WHERE page_id % 4 = 0
    UNION ALL SELECT page_id, o || f || 'b.webp', '', 0, 0, 'lazy', 'webp' FROM o WHERE page_id % 2 = 1"""
)
def image_extract(spark: SparkSession, d: str) -> DataFrame:
    return _pages(spark, d).select("page_id", F.explode_outer(H.images(H.tags_of(F.col("html"), "img"), F.col("url"))).alias("i")).filter("i IS NOT NULL").select("page_id", "i.src", "i.alt", "i.width", "i.height", "i.loading", "i.format")


@query(
    f"""WITH u AS (SELECT DISTINCT url FROM page_history UNION SELECT DISTINCT destination_url FROM page_links), k AS (SELECT url, {d_normal('url')} AS normal FROM u WHERE url IS NOT NULL) SELECT * FROM k"""
)
def url_normalize(spark: SparkSession, d: str) -> DataFrame:
    u = read(spark, d, "page_history", "url").union(read(spark, d, "page_links", "destination_url")).dropna().distinct()
    return u.select("url", U.normalize(F.col("url"), F.lit("https://base.test/")).alias("normal"))


_FILE_END = "|".join(U.FILES)


@query(
    f"""WITH u AS (SELECT DISTINCT url FROM page_history UNION SELECT DISTINCT url FROM pages), x AS (SELECT url, regexp_matches(url, {PART}) AS ok, {d_path('url')} AS p, {part('url', 4)} AS q, {part('url', 3)} AS raw FROM u WHERE url IS NOT NULL),
    y AS (SELECT *, len(list_filter(string_split(raw, '/'), lambda s: s <> '')) AS depth, len(list_filter(string_split(substr(q, 2), '&'), lambda s: s <> '')) AS n, regexp_matches(url, '(?i){U.PRODUCT}') AS product, regexp_matches(url, '(?i){U.CATEGORY}') AS category FROM x)
    SELECT url, depth, product, category, regexp_matches(CASE WHEN ok THEN p ELSE url END, '(?i)/({'|'.join(U.UTILITY)})(/|$|\\?|#)') AS utility,
      ok AND (regexp_matches(lower(p), '\\.({_FILE_END})$') OR regexp_matches(lower(p), '{'|'.join(U.MACHINERY + U.SIGN_IN)}') OR regexp_matches(q, '(?i)[?&]({'|'.join(U.LISTINGS)})=')) AS excluded,
      greatest(1, 10 - 1 + CASE WHEN product THEN 5 WHEN category THEN 3 ELSE 0 END + CASE WHEN depth <= 1 THEN 2 ELSE 0 END - CASE WHEN n > 3 THEN 2 ELSE 0 END) AS priority,
      CASE WHEN ok THEN array_to_string(list_filter([CASE WHEN regexp_matches(p, '[A-Z]') THEN 'uppercase' END, CASE WHEN contains(p, '_') THEN 'underscore' END, CASE WHEN length(url) > 115 THEN 'long' END, CASE WHEN q <> '' THEN 'parameters' END], lambda i: i IS NOT NULL), ',') ELSE '' END AS issues FROM y"""
)
def url_classify(spark: SparkSession, d: str) -> DataFrame:
    u, url = read(spark, d, "page_history", "url").union(read(spark, d, "pages", "url")).dropna().distinct(), F.col("url")
    return u.select("url", U.path_depth(url).alias("depth"), U.is_product(url).alias("product"), U.is_category(url).alias("category"), U.is_utility(url).alias("utility"), U.is_excluded(url).alias("excluded"), U.crawl_priority(url, F.lit(1)).alias("priority"), F.array_join(U.url_issues(url), ",").alias("issues"))


@query(
    f"""WITH c AS (SELECT project_id, count(*) AS n, count(*) FILTER (starts_with({d_host('destination_url')}, 'www.')) AS w FROM page_links WHERE link_type = 'internal' GROUP BY 1)
    SELECT project_id, CASE WHEN n < 5 THEN 'unknown' WHEN w / n >= 0.7 THEN 'www' WHEN w / n <= 0.3 THEN 'bare' ELSE 'unknown' END AS www FROM c"""
)
def www_preference(spark: SparkSession, d: str) -> DataFrame:
    return linkgraph.www_preference(read(spark, d, "page_links"))


@query(
    f"""WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '\\p{{L}}{{4,}}')) AS word, generate_subscripts(regexp_extract_all(lower(text), '\\p{{L}}{{4,}}'), 1) AS pos FROM documents),
    c AS (SELECT doc_id, word, count(*) AS count, min(pos) AS pos FROM w WHERE word NOT IN ({', '.join(f"'{x}'" for x in T.STOP_WORDS)}) GROUP BY 1, 2),
    k AS (SELECT doc_id, word, count, row_number() OVER (PARTITION BY doc_id ORDER BY count DESC, pos) AS rank FROM c) SELECT * FROM k WHERE rank <= 10"""
)
def keywords_top10(spark: SparkSession, d: str) -> DataFrame:
    return T.keywords(read(spark, d, "documents", "doc_id", "text"), "doc_id", "text")


_SENTENCES = "len(list_filter(regexp_split_to_array(text, '[.!?]+'), lambda s: regexp_replace(s, '[\\s\\x{00A0}\\x{FEFF}]', '', 'g') <> ''))"
_SYLLABLES = """list_sum(list_transform(list_transform(ws, lambda w: regexp_replace(lower(w), '[^a-z]', '', 'g')), lambda w: CASE WHEN length(w) <= 3 THEN 1 ELSE greatest(1, CASE WHEN len(regexp_extract_all(w, '[aeiouy]+')) = 0 THEN 1 ELSE len(regexp_extract_all(w, '[aeiouy]+')) END
  - CASE WHEN ends_with(w, 'e') THEN 1 ELSE 0 END + CASE WHEN regexp_matches(w, '[^aeiouy]le$') THEN 1 ELSE 0 END) END))"""


@query(
    f"""WITH w AS (SELECT doc_id, text, {SPLIT.format(x='text')} AS ws, {_SENTENCES} AS ns FROM documents), s AS (SELECT *, {_SYLLABLES} AS ny FROM w)
    SELECT doc_id, CAST(CASE WHEN text IS NULL THEN NULL WHEN len(ws) = 0 OR ns = 0 THEN 0 ELSE greatest(0, least(100, floor(206.835::DOUBLE - 1.015::DOUBLE * (len(ws) / ns) - 84.6::DOUBLE * (ny / len(ws)) + 0.5))) END AS INT) AS readability,
      sha256(trim(regexp_replace(regexp_replace(lower(text), '[^\\p{{L}}\\p{{N}}\\s]', '', 'g'), '\\s+', ' ', 'g'))) AS content_hash FROM s"""
)
def text_measures(spark: SparkSession, d: str) -> DataFrame:
    return evenly(read(spark, d, "documents", "doc_id", "text")).select("doc_id", T.readability(F.col("text")).alias("readability"), T.content_hash(F.col("text")).alias("content_hash"))


_SELF = "CASE WHEN canonical IS NULL THEN false WHEN regexp_matches(canonical, {P}) AND regexp_matches(url, {P}) THEN {form_c} = {form_u} ELSE canonical = url END"
_form = lambda u: f"lower(lower({part(u, 1)}) || {d_host(u)} || regexp_replace({d_path(u)}, '/+$', '') || {part(u, 4)})"
_UTILITY = "|".join(U.UTILITY)
# The conditions of all issues, written down apart from those of the operator. A page of the rendering has one image (a JPEG with a text on every fourth, a WebP
# without on odd ones), one alternate link without a default (every ninth), and generic link texts.
_trimmed = lambda c: f"length(trim({c}, ' '))"
_CONDITIONS = [
    ("server_error", "critical", "http_status >= 500 AND http_status < 600"), ("not_found", "critical", "http_status = 404"), ("missing_title", "high", "coalesce(trim(page_title, ' '), '') = ''"), ("missing_meta_description", "high", "coalesce(trim(description, ' '), '') = ''"),
    ("missing_h1", "high", "h1_count = 0"), ("multiple_h1", "high", "h1_count >= 2"), ("title_too_long", "medium", f"{_trimmed('page_title')} > 60"), ("title_too_short", "medium", f"{_trimmed('page_title')} >= 1 AND {_trimmed('page_title')} < 10"),
    ("meta_description_too_long", "medium", f"{_trimmed('description')} > 160"), ("meta_description_too_short", "medium", f"{_trimmed('description')} >= 1 AND {_trimmed('description')} < 50"),
    ("thin_content", "medium", f"word_count < 300 AND NOT noindex AND NOT regexp_matches(CASE WHEN ok THEN {d_path('url')} ELSE url END, '(?i)/({_UTILITY})(/|$|\\?|#)')"), ("missing_canonical", "medium", "canonical IS NULL OR canonical = ''"), ("noindex", "medium", "noindex"),
    ("missing_open_graph", "medium", "og_count = 0"), ("missing_twitter_card", "low", "twitter_count = 0"), ("missing_structured_data", "low", "schema_count = 0"), ("large_page_size", "low", "size_bytes > 3 * 1024 * 1024"), ("slow_page", "low", "load_time_ms > 3000"),
    ("missing_image_alt", "low", "page_id % 2 = 1"), ("heading_hierarchy_invalid", "medium", "page_id % 5 = 1 AND h1_count > 0"), ("missing_viewport_meta", "medium", "NOT viewport"), ("mixed_content", "high", "mixed_content"),
    ("url_structure_issues", "low", f"ok AND (regexp_matches({d_path('url')}, '[A-Z_]') OR length(url) > 115 OR {part('url', 4)} <> '')"), ("canonical_mismatch", "medium", "canonical IS NOT NULL AND NOT self"), ("non_modern_image_format", "low", "page_id % 4 = 0"),
    ("hreflang_issues", "medium", "page_id % 9 = 0"), ("non_descriptive_anchor_text", "low", "ok"), ("canonical_not_self", "medium", "canonical IS NOT NULL AND NOT self AND http_status >= 200 AND http_status < 400"), ("missing_html_lang", "medium", "home AND lang IS NULL"),
    ("no_aria_landmarks", "low", "home AND landmark_count < 2"), ("missing_skip_nav", "low", "home AND NOT skip_link"),
]
_ISSUES = (
    RAW + f", m AS ({META}), n AS (SELECT *, regexp_matches(url, {PART}) AS ok, len(list_filter(string_split({part('url', 3)}, '/'), lambda s: s <> '')) = 0 AS home, "
    + _SELF.format(P=PART, form_c=_form("canonical"), form_u=_form("url")) + " AS self FROM m), x AS (" + " UNION ALL ".join(f"SELECT project_id, page_id, '{t}' AS issue_type, '{s}' AS severity FROM n WHERE {c}" for t, s, c in _CONDITIONS) + ")"
)


@query(_ISSUES + " SELECT project_id, page_id, issue_type, severity FROM x")
def page_issues(spark: SparkSession, d: str) -> DataFrame:
    return pagefacts.issues(pagefacts.facts(_pages(spark, d)))


@query(_ISSUES + " SELECT issue_type, severity, count(*) AS pages FROM x GROUP BY 1, 2")
def issues_by_type_all(spark: SparkSession, d: str) -> DataFrame:
    """How many pages meet each of all rules."""
    return pagefacts.issues(pagefacts.facts(_pages(spark, d))).groupBy("issue_type", "severity").agg(F.count("*").alias("pages"))


_repeats = lambda v, name, more="": f"SELECT project_id, page_id, '{name}' AS issue_type, n - 1 AS others FROM (SELECT project_id, page_id, {v} AS v, count(*) OVER (PARTITION BY project_id, {v}) AS n FROM pages WHERE {v} IS NOT NULL {more}) WHERE n > 1"


@query(_repeats("nullif(trim(title), '')", "duplicate_title") + " UNION ALL " + _repeats("nullif(trim(meta_description), '')", "duplicate_meta_description") + " UNION ALL " + _repeats("content_hash", "duplicate_content", "AND word_count >= 50"))
def duplicate_values(spark: SparkSession, d: str) -> DataFrame:
    p = read(spark, d, "pages", "project_id", "page_id", "title", "meta_description", "content_hash", "word_count")
    return (
        linkgraph.repeated_values(p, linkgraph.filled("title"), "duplicate_title").unionByName(linkgraph.repeated_values(p, linkgraph.filled("meta_description"), "duplicate_meta_description"))
        .unionByName(linkgraph.repeated_values(p.filter("word_count >= 50"), F.col("content_hash"), "duplicate_content"))
    )


@query(
    """WITH f AS (SELECT project_id, page_id, http_status, unnest([url, lower(url), regexp_replace(url, '/$', ''), regexp_replace(url, '/$', '') || '/', lower(regexp_replace(url, '/$', '')), lower(regexp_replace(url, '/$', '') || '/')]) AS variant FROM pages),
    v AS (SELECT project_id, variant, page_id, http_status FROM f QUALIFY row_number() OVER (PARTITION BY project_id, variant ORDER BY page_id DESC) = 1),
    l AS (SELECT DISTINCT ON (link_id) link_id, project_id, source_page_id, lower(destination_url) AS variant FROM page_links WHERE link_type = 'internal')
    SELECT link_id, source_page_id, v.page_id AS resolved_page_id, http_status >= 400 AS broken FROM l LEFT JOIN v USING (project_id, variant)"""
)
def link_resolution(spark: SparkSession, d: str) -> DataFrame:
    return linkgraph.resolved(read(spark, d, "page_links"), read(spark, d, "pages"))


@query(
    """WITH l AS (SELECT DISTINCT link_id, source_page_id, destination_page_id, destination_url FROM page_links),
    o AS (SELECT source_page_id AS page_id, count(*) AS a, count(DISTINCT destination_url) AS b FROM l GROUP BY 1), i AS (SELECT destination_page_id AS page_id, count(*) AS a, count(DISTINCT source_page_id) AS b FROM l GROUP BY 1)
    SELECT p.page_id, coalesce(i.a, 0) AS inlinks, coalesce(i.b, 0) AS unique_inlinks, coalesce(o.a, 0) AS outlinks, coalesce(o.b, 0) AS unique_outlinks FROM pages p LEFT JOIN i USING (page_id) LEFT JOIN o USING (page_id)"""
)
def link_degrees(spark: SparkSession, d: str) -> DataFrame:
    return linkgraph.degrees(read(spark, d, "page_links"), read(spark, d, "pages"))


@query("SELECT project_id, page_id FROM pages WHERE depth <> 0 AND page_id NOT IN (SELECT destination_page_id FROM page_links WHERE destination_page_id IS NOT NULL)")
def orphan_pages(spark: SparkSession, d: str) -> DataFrame:
    return linkgraph.unlinked(read(spark, d, "page_links"), read(spark, d, "pages"))


@query("SELECT source_page_id, count(*) AS links, count(*) FILTER (link_type = 'internal' AND is_broken) AS broken FROM (SELECT * FROM page_links QUALIFY row_number() OVER (PARTITION BY source_page_id, destination_url ORDER BY link_id, created_at) = 1) GROUP BY 1")
def broken_links(spark: SparkSession, d: str) -> DataFrame:
    return linkgraph.deduplicated(read(spark, d, "page_links")).groupBy("source_page_id").agg(F.count("*").alias("links"), F.count(F.when((F.col("link_type") == "internal") & F.col("is_broken"), 1)).alias("broken"))


@query("SELECT DISTINCT project_id, url FROM page_history h WHERE NOT EXISTS (SELECT 1 FROM pages p WHERE p.project_id = h.project_id AND p.url = h.url)")
def removed_pages(spark: SparkSession, d: str) -> DataFrame:
    return linkgraph.removed_pages(read(spark, d, "page_history"), read(spark, d, "pages"))


@query("WITH g AS (SELECT page_id FROM pages WHERE http_status = 404) SELECT link_id, source_page_id, destination_page_id FROM page_links WHERE coalesce(source_page_id NOT IN (SELECT page_id FROM g), true) AND coalesce(destination_page_id NOT IN (SELECT page_id FROM g), true)")
def cascade_delete(spark: SparkSession, d: str) -> DataFrame:
    return linkgraph.without_pages(read(spark, d, "pages").filter("http_status = 404"), read(spark, d, "page_links")).select("link_id", "source_page_id", "destination_page_id")


def _report(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Pages with the facts that scores need, and each project's latest completed scan with its blocked sign."""
    p = rendered(evenly(read(spark, d, "pages")))
    found = pagefacts.facts(p).select("page_id", "og_count", "image_count", "images_without_alt")
    scans = snapshots.completed(read(spark, d, "scans")).groupBy("project_id").agg(F.max_by("scan_id", F.struct("started_at", "scan_id")).alias("scan_id"))
    blocked = read(spark, d, "scan_scores", "scan_id", "blocked").groupBy("scan_id").agg(F.max("blocked").alias("blocked"))
    return read(spark, d, "pages").join(found, "page_id"), scans.join(blocked, "scan_id", "left").select("project_id", "blocked")


_FILLED = "'[^\\s\\p{Z}\\x{FEFF}]'"
# One row a page with each check as 0 or 1. A page of the rendering has Open Graph tags if its id is a multiple of 4, one image if it is that or odd, and no text on it
# if it is odd.
_SCORED = f"""WITH s AS (SELECT project_id, arg_max(scan_id, struct_pack(a := started_at, b := scan_id)) AS scan_id FROM scans WHERE scan_type = 'seo' AND status = 'completed' GROUP BY 1), b AS (SELECT scan_id, max(blocked) AS blocked FROM scan_scores GROUP BY 1),
  crawls AS (SELECT project_id, coalesce(blocked, false) AS blocked FROM s LEFT JOIN b USING (scan_id)),
  f AS (SELECT p.project_id, page_id, url, CAST(coalesce(http_status >= 200 AND http_status < 300, false) AS INT) AS http_ok, CAST(coalesce(is_indexable, false) AS INT) AS indexable, CAST(coalesce(load_time_ms, 0) <= 3000 AS INT) AS fast,
    CAST(coalesce(regexp_matches(title, {_FILLED}), false) AS INT) AS title, CAST(coalesce(regexp_matches(meta_description, {_FILLED}), false) AS INT) AS meta_description, CAST(coalesce(word_count >= 300, false) AS INT) AS word_count, CAST(coalesce(len(h1s) > 0, false) AS INT) AS h1,
    CAST(coalesce(len(schema_types) > 0, false) AS INT) AS schema_types, CAST(coalesce(len(structured_data) > 0, false) AS INT) AS structured_data, CAST(page_id % 4 = 0 AS INT) AS open_graph, CAST(page_id % 4 = 0 OR page_id % 2 = 1 AS INT) AS images, CAST(page_id % 4 = 0 AS INT) AS alts
    FROM pages p JOIN crawls c ON p.project_id = c.project_id AND NOT c.blocked)"""
_CHECKS = [("technical", n, n) for n in ("http_ok", "indexable", "fast")] + [("content", n, n) for n in ("title", "meta_description", "word_count", "h1")] + [("aeo", f"aeo_{n}", n) for n in ("schema_types", "structured_data", "open_graph", "meta_description", "title", "h1", "word_count")]
_rounded = lambda x: f"CAST(least(100, greatest(0, floor({x} + 0.5))) AS INT)"


@query(
    _SCORED
    + """, n AS (SELECT project_id, count(*) AS pages, (avg(http_ok) + avg(indexable) + avg(fast)) / 3 * 100 AS technical, (avg(title) + avg(meta_description) + avg(word_count) + avg(h1)) / 4 * 100 AS content, CASE WHEN sum(images) = 0 THEN 100 ELSE sum(alts) / sum(images) * 100 END AS media,
      (avg(schema_types) + avg(structured_data) + avg(open_graph) + avg(meta_description) + avg(title) + avg(h1) + avg(word_count)) / 7 * 100 AS aeo FROM f GROUP BY 1)"""
    + f" SELECT c.project_id, coalesce(pages, 0) AS pages, {', '.join(f'coalesce({_rounded(k)}, 0) AS {k}' for k in ('technical', 'content', 'media', 'aeo'))}, coalesce({_rounded('(technical + content + media + aeo) / 4')}, 0) AS overall, c.blocked FROM crawls c LEFT JOIN n USING (project_id)"
)
def report_scores(spark: SparkSession, d: str) -> DataFrame:
    """The four category scores and the overall score of every project's latest scan."""
    return scores.report_scores(*_report(spark, d))


@query(
    _SCORED + ", r AS (" + " UNION ALL ".join(f"SELECT project_id, page_id, url, '{k}' AS category, '{n}' AS \"check\", {c} AS passed, 1 AS total FROM f" for k, n, c in _CHECKS) + " UNION ALL SELECT project_id, page_id, url, 'media', 'img_alt', alts, images FROM f),"
    " g AS (SELECT project_id, category, \"check\", sum(passed) AS passed, sum(total) AS total, list(url ORDER BY page_id, url) FILTER (passed < total AND url IS NOT NULL) AS bad FROM r GROUP BY ALL)"
    " SELECT project_id, category, \"check\", CASE WHEN total = 0 THEN 'na' WHEN passed = total THEN 'pass' ELSE 'fail' END AS status, CAST(passed AS BIGINT) AS passed, CAST(total AS BIGINT) AS total, coalesce(array_to_string(bad[1:50], ' '), '') AS affected_urls FROM g"
)
def report_checks(spark: SparkSession, d: str) -> DataFrame:
    """Every check behind these scores with the addresses that fail it."""
    return scores.report_checks(*_report(spark, d)).withColumn("affected_urls", F.array_join("affected_urls", " "))


_PAGE_CHECKS = [c for _, n, c in _CHECKS if not n.startswith("aeo_") or n in ("aeo_schema_types", "aeo_structured_data", "aeo_open_graph")]


@query(
    _SCORED
    + f" SELECT project_id, page_id, {_rounded('(' + ' + '.join(_PAGE_CHECKS) + f' + alts)::DOUBLE / ({len(_PAGE_CHECKS)} + images) * 100')} AS score, {len(_PAGE_CHECKS)} + images AS applicable, "
    + f"array_to_string(list_filter([{', '.join(f'CASE WHEN {c} = 0 THEN {chr(39)}{n}{chr(39)} END' for _, n, c in _CHECKS if c in _PAGE_CHECKS and (not n.startswith('aeo_') or c in ('schema_types', 'structured_data', 'open_graph')))}, CASE WHEN alts < images THEN 'img_alt' END], lambda x: x IS NOT NULL), ' ') AS failed FROM f"
)
def report_pages(spark: SparkSession, d: str) -> DataFrame:
    """Every page's score, the number of checks that apply to it, and those that it fails."""
    found = scores.report_pages(*_report(spark, d))
    return found.select("project_id", "page_id", "score", F.size("checks").alias("applicable"), F.array_join(F.transform(F.filter("checks", lambda x: x["status"] == "fail"), lambda x: x["check"]), " ").alias("failed"))


@query(
    """WITH t AS (SELECT doc_id, text FROM documents WHERE source = 'llms_txt' AND text IS NOT NULL), l AS (SELECT doc_id, unnest(regexp_split_to_array(text, '\\r?\\n')) AS line, generate_subscripts(regexp_split_to_array(text, '\\r?\\n'), 1) AS pos FROM t),
    p AS (SELECT doc_id, lower(trim(regexp_extract(line, '^([^:]+):', 1))) AS field, trim(regexp_extract(line, '^[^:]+:(.*)$', 1)) AS value, pos FROM l WHERE strpos(line, ':') > 1)
    SELECT doc_id AS site, field, arg_max(value, pos) AS value FROM p GROUP BY 1, 2"""
)
def llms_fields(spark: SparkSession, d: str) -> DataFrame:
    texts = read(spark, d, "documents", "doc_id", "text", "source").filter("source = 'llms_txt' AND text IS NOT NULL")
    return sitefiles.llms_fields(texts.select(F.col("doc_id").alias("site"), F.col("text").alias("content")))


_key = lambda u: f"lower(lower({part(u, 1)}) || '://' || {d_host(u)} || CASE WHEN regexp_replace({d_path(u)}, '/+$', '') = '' THEN '/' ELSE regexp_replace({d_path(u)}, '/+$', '') END)"


@query(
    f"""WITH e AS (SELECT project_id AS site, url, {_key('url')} AS k FROM page_history WHERE regexp_matches(url, {PART})), p AS (SELECT project_id AS site, url, {_key('url')} AS k FROM pages WHERE http_status >= 200 AND http_status < 400 AND regexp_matches(url, {PART}))
    SELECT site, min(url) AS url, 'only_in_sitemap' AS side FROM e WHERE (site, k) NOT IN (SELECT site, k FROM p) GROUP BY site, k UNION ALL SELECT site, min(url), 'not_in_sitemap' FROM p WHERE (site, k) NOT IN (SELECT site, k FROM e) GROUP BY site, k"""
)
def sitemap_difference(spark: SparkSession, d: str) -> DataFrame:
    """The pages of history stand for sitemap entries."""
    files = read(spark, d, "page_history", "project_id", "url").select(F.col("project_id").alias("site"), F.concat(F.lit("<url><loc>"), "url", F.lit("</loc></url>")).alias("content"))
    pages = read(spark, d, "pages", "project_id", "url", "http_status").select(F.col("project_id").alias("site"), "url", F.col("http_status").alias("status"))
    return sitefiles.sitemap_difference(sitefiles.sitemap_entries(files), pages)


def _crawl_graph(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    seeds = read(spark, d, "pages", "page_id", "depth").filter("depth = 0").select(F.col("page_id").alias("key"))
    return seeds, read(spark, d, "page_links", "source_page_id", "destination_page_id").toDF("src", "dst")


@query(
    """WITH RECURSIVE e AS (SELECT DISTINCT source_page_id AS src, destination_page_id AS dst FROM page_links WHERE source_page_id IS NOT NULL AND destination_page_id IS NOT NULL),
    b AS (SELECT page_id AS key, 0 AS depth FROM pages WHERE depth = 0 UNION SELECT dst, b.depth + 1 FROM b JOIN e ON b.key = e.src WHERE b.depth < 5) SELECT key, min(depth) AS depth FROM b GROUP BY 1"""
)
def crawl_frontier(spark: SparkSession, d: str) -> DataFrame:
    """What a crawl reaches from the start pages, to the default depth."""
    return crawl.frontier(*_crawl_graph(spark, d))


@query("SELECT * FROM (VALUES ('/a', '/d', 3, false), ('/b', '/d', 2, false), ('/c', '/d', 1, false), ('/x', '/x', 2, true), ('/y', '/y', 2, true), ('/s', '/s', 1, true)) AS t(start, final, hops, loops)")
def redirect_chains(spark: SparkSession, d: str) -> DataFrame:
    return crawl.redirect_chains(spark.createDataFrame([("/a", "/b"), ("/b", "/c"), ("/c", "/d"), ("/x", "/y"), ("/y", "/x"), ("/s", "/s")], "from_url string, to_url string"))


@query(
    """WITH s AS (SELECT project_id, scan_id, max(started_at) AS a, max(completed_at) AS z FROM scans WHERE scan_type = 'seo' AND status = 'completed' GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY a DESC NULLS LAST, scan_id DESC) AS back FROM s),
    last AS (SELECT project_id, scan_id, coalesce(z, a) AS t FROM r WHERE back = 1), i AS (SELECT r.project_id, back, i.* EXCLUDE (project_id) FROM issues i JOIN r USING (scan_id) WHERE fingerprint IS NOT NULL),
    k AS (SELECT * FROM i WHERE back = 2 QUALIFY row_number() OVER (PARTITION BY project_id, fingerprint ORDER BY updated_at DESC NULLS LAST, page_id DESC NULLS LAST, is_fixed DESC NULLS LAST, seen_count DESC NULLS LAST, created_at DESC NULLS LAST, fixed_at DESC NULLS LAST) = 1),
    n AS (SELECT project_id, fingerprint, max(page_id) AS page_id FROM i WHERE back = 1 GROUP BY 1, 2), c AS (SELECT DISTINCT page_id FROM pages WHERE scan_id IN (SELECT scan_id FROM last)),
    j AS (SELECT coalesce(k.project_id, n.project_id) AS project_id, coalesce(n.page_id, k.page_id) AS page_id, coalesce(k.fingerprint, n.fingerprint) AS fingerprint, k.is_fixed, k.seen_count, k.created_at, k.fixed_at,
      CASE WHEN k.fingerprint IS NOT NULL AND n.fingerprint IS NOT NULL THEN 'persisting' WHEN n.fingerprint IS NOT NULL THEN 'new' WHEN NOT coalesce(k.is_fixed, false) AND c.page_id IS NOT NULL THEN 'resolved' ELSE 'untouched' END AS state
      FROM k FULL JOIN n ON k.project_id = n.project_id AND k.fingerprint = n.fingerprint LEFT JOIN c ON k.page_id = c.page_id)
    SELECT project_id, page_id, fingerprint, CASE WHEN state IN ('persisting', 'new') THEN false WHEN state = 'resolved' THEN true ELSE is_fixed END AS is_fixed, CASE state WHEN 'persisting' THEN coalesce(seen_count, 1) + 1 WHEN 'new' THEN 1 ELSE seen_count END AS seen_count,
      coalesce(created_at, t) AS created_at, CASE WHEN state IN ('persisting', 'new') THEN NULL WHEN state = 'resolved' THEN t ELSE fixed_at END AS fixed_at, state, scan_id FROM j JOIN last USING (project_id)"""
)
def issue_reconcile(spark: SparkSession, d: str) -> DataFrame:
    """Every issue of each project's last two completed scans with its state."""
    return merge.reconcile_last(read(spark, d, "issues"), snapshots.completed(read(spark, d, "scans")), read(spark, d, "pages", "scan_id", "page_id"))


@query(
    """WITH b AS (SELECT scan_id, max(started_at) AS a FROM scans GROUP BY 1),
    h AS (SELECT h.* FROM page_history h LEFT JOIN b USING (scan_id) QUALIFY row_number() OVER (PARTITION BY project_id, page_id ORDER BY a DESC NULLS LAST, scan_id DESC NULLS LAST, recorded_at DESC NULLS LAST, url DESC NULLS LAST, http_status DESC NULLS LAST, word_count DESC NULLS LAST, content_hash DESC NULLS LAST) = 1)
    SELECT scan_id, project_id, page_id, url, http_status, word_count, content_hash, scanned_at AS recorded_at FROM pages UNION ALL SELECT scan_id, project_id, page_id, url, http_status, word_count, content_hash, recorded_at FROM h WHERE (project_id, page_id) NOT IN (SELECT project_id, page_id FROM pages)"""
)
def page_upsert(spark: SparkSession, d: str) -> DataFrame:
    """All pages over the latest row of each page of the history."""
    kept = merge.latest_pages(read(spark, d, "page_history"), read(spark, d, "scans"))
    return merge.upsert(kept, read(spark, d, "pages").withColumn("recorded_at", F.col("scanned_at")).select(*kept.columns), ["project_id", "page_id"])


@query("SELECT scan_id, count(*) FILTER (severity = 'critical') AS critical, count(*) FILTER (severity = 'high') AS high, count(*) FILTER (severity = 'medium') AS medium, count(*) FILTER (coalesce(severity, 'low') = 'low') AS low FROM (SELECT DISTINCT scan_id, issue_id, severity FROM issues) GROUP BY 1")
def scan_snapshot(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "issues", "scan_id", "issue_id", "severity").distinct().withColumn("severity", F.coalesce("severity", F.lit("low")))
    return rows.groupBy("scan_id").agg(*[F.count(F.when(F.col("severity") == s, 1)).alias(s) for s in ("critical", "high", "medium", "low")])


@query("SELECT DISTINCT CAST(o_orderdate AS DATE) AS day, CAST(date_trunc('month', o_orderdate) + INTERVAL 1 MONTH AS DATE) + CAST(day(o_orderdate) - 1 AS INT) AS next FROM orders")
def next_scan(spark: SparkSession, d: str) -> DataFrame:
    day = F.to_date("o_orderdate")
    return read(spark, d, "orders", "o_orderdate").select(day.alias("day"), merge.next_month(day).alias("next")).distinct()


@query("SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS events FROM events GROUP BY 1, 2")
def scan_log_stream(spark: SparkSession, d: str) -> DataFrame:
    """The events as a stream of files through the windowed count into the sink, then read back. All folders are below the shared one."""
    base = f"{checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    spark.read.parquet(f"{d}/events.parquet").write.parquet(f"{base}/in")
    stream = logs.windowed_counts(logs.read_stream(spark, f"{base}/in"), "ts", ["event_type"])
    logs.sink(stream, f"{base}/out", f"{base}/state", every=None, mode="update").awaitTermination()
    return logs.latest(spark.read.parquet(f"{base}/out"), ["window_start", "event_type"]).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))
