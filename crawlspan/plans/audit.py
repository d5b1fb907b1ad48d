"""Queries of address checks, platforms, link rows, backlinks, site files, crawl details and site analyses over the audit tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crawlspan.functions import dom
from crawlspan.functions import html as H
from crawlspan.functions import text as T
from crawlspan.functions import urls as U
from crawlspan.operators import audit, backlinks, crawl, issuerows, linkgraph, merge, pagefacts, sitefiles
from crawlspan.operators.snapshots import completed
from crawlspan.plans.problems import WALK
from crawlspan.plans.site import PART, d_bare, d_host, d_normal, d_path, part
from crawlspan.sources.rendered import html_sql, rendered
from crawlspan.sources.tables import evenly, read

QUERIES = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_LINKED = "SELECT DISTINCT url FROM page_history WHERE url IS NOT NULL UNION SELECT DISTINCT destination_url FROM page_links WHERE destination_url IS NOT NULL"
_NON_HTTP = "|".join(U.NON_HTTP)


@query(
    f"""WITH u AS ({_LINKED}), x AS (SELECT url, CASE WHEN contains(url, '://') THEN url ELSE 'https://' || url END AS f, {d_host('url')} AS h FROM u)
    SELECT url, CASE WHEN url <> '' AND regexp_matches(f, {PART}) THEN lower({part('f', 1)}) || '://' || lower({part('f', 2)}) || CASE WHEN length({d_path('f')}) > 1 AND ends_with({d_path('f')}, '/') THEN substr({d_path('f')}, 1, length({d_path('f')}) - 1) ELSE {d_path('f')} END || {part('f', 4)} END AS basic,
      CASE WHEN trim(url) IN ('', '#') OR regexp_matches(lower(trim(url)), '^({_NON_HTTP}):') OR regexp_matches(trim(url), '(?i)^https?://(mailto|tel|javascript|sms|ftp):') OR length(trim(url)) > 2000 THEN NULL ELSE {d_normal('url')} END AS cleaned,
      regexp_matches(lower(url), '{'|'.join(d.replace('.', '[.]') for d in U.JS_HEAVY)}') AS js_heavy,
      CASE WHEN h = '' OR length(url) % 3 <> 1 THEN false WHEN regexp_matches(h, '^[0-9.]+$') THEN NOT regexp_matches(h, '^(10|127|0)[.]|^192[.]168[.]|^169[.]254[.]|^172[.](1[6-9]|2[0-9]|3[01])[.]') ELSE true END AS public,
      h = 'mirmark-market.test' OR ends_with(h, '.mirmark-market.test') AS same_site,
      CASE WHEN trim(url) = '' OR length(trim(url)) > 300 OR regexp_matches(trim(url), '\\s') THEN NULL WHEN regexp_matches(trim(url), '^https?://') THEN CASE WHEN h = 'mirmark-market.test' OR ends_with(h, '.mirmark-market.test') THEN trim(url) END WHEN starts_with(trim(url), '/') THEN trim(url) ELSE '/' || trim(url) END AS setting,
      CASE regexp_extract(regexp_extract(lower(url), '^([^?#]*)', 1), '[.](webp|avif|svg|png|jpg|jpeg|gif|bmp|ico)$', 1) WHEN '' THEN 'unknown' WHEN 'jpg' THEN 'jpeg' ELSE regexp_extract(regexp_extract(lower(url), '^([^?#]*)', 1), '[.](webp|avif|svg|png|jpg|jpeg|gif|bmp|ico)$', 1) END AS format FROM x"""
)
def url_checks(spark: SparkSession, d: str) -> DataFrame:
    """Basic form, cleaning, builders, public hosts, sites, settings and image formats of all addresses. A third of the hosts resolve publicly."""
    u, url = read(spark, d, "page_history", "url").union(read(spark, d, "page_links", "destination_url")).dropna().distinct(), F.col("url")
    addresses = F.when(F.length(url) % 3 == 1, F.array(F.lit("8.8.8.8"))).when(F.length(url) % 3 == 2, F.array(F.lit("8.8.8.8"), F.lit("10.1.2.3"))).otherwise(F.array().cast("array<string>"))
    # An address that is an IP is judged by itself; the condition on the length keeps both sides alike.
    return u.select(
        "url", U.normalize_basic(url).alias("basic"), U.cleaned(url).alias("cleaned"), U.is_js_heavy(url).alias("js_heavy"), (U.is_public(url, addresses) & (F.length(url) % 3 == 1)).alias("public"), U.is_same_site(U.host(url), F.lit("mirmark-market.test")).alias("same_site"),
        U.as_path(url, F.lit("www.mirmark-market.test")).alias("setting"), U.guessed_format(url).alias("format"),
    )


@query(
    f"""WITH c AS (SELECT project_id, count(*) AS n, count(*) FILTER (starts_with({d_host('destination_url')}, 'www.')) AS w FROM page_links WHERE link_type = 'internal' GROUP BY 1)
    SELECT p.project_id, CASE WHEN p.project_id % 7 = 0 THEN 'www' WHEN p.project_id % 4 = 0 THEN 'bare' WHEN p.project_id % 4 < 3 THEN 'www' WHEN n >= 5 AND w / n >= 0.7 THEN 'www' WHEN n >= 5 AND w / n <= 0.3 THEN 'bare' WHEN starts_with({d_host('p.url')}, 'www.') THEN 'www' ELSE 'bare' END AS www
    FROM projects p LEFT JOIN c USING (project_id)"""
)
def www_choice(spark: SparkSession, d: str) -> DataFrame:
    """The www preference of every project, by setting, probes (by project: moved to bare, moved to www, both stay, no answer), links, address."""
    p = read(spark, d, "projects", "project_id", "url").join(linkgraph.www_preference(read(spark, d, "page_links", "project_id", "destination_url", "link_type")), "project_id", "left").withColumn("domain", U.bare_host(F.col("url")))
    at = lambda prefix: F.concat(F.lit(f"https://{prefix}"), "domain", F.lit("/"))
    probe = lambda final, status, moved: F.struct(final.alias("final"), F.lit(status).alias("status"), F.lit(moved).alias("redirected"))
    k = F.col("project_id") % 4
    www = F.when(k == 0, probe(at(""), 200, True)).when(k == 1, probe(at("www."), 200, False)).when(k == 2, probe(at("www."), 200, False))
    bare = F.when(k == 0, probe(at(""), 200, False)).when(k == 1, probe(at("www."), 200, True)).when(k == 2, probe(at(""), 404, False))
    return p.select("project_id", U.www_choice(F.when(F.col("project_id") % 7 == 0, "www"), U.www_by_redirects(F.col("domain"), www, bare), F.col("www"), F.col("url")).alias("www"))


_ASSET = "CASE page_id % 5 WHEN 1 THEN 'wp-content/themes/a' WHEN 2 THEN 'cdn.shopify.com/s' WHEN 3 THEN 'assets' WHEN 4 THEN 'gatsby-chunk' ELSE '_next/static' END"
_BODY = "regexp_extract(html, '(?is)<body[^>]*>(.{0,500})', 1)"


def _platform_pages(spark: SparkSession, d: str) -> DataFrame:
    """Pages with markup of five platforms and response headers, by page_id."""
    p = rendered(evenly(read(spark, d, "pages"))).withColumn("html", F.expr(f"replace(html, '_next/static', {_ASSET})"))
    headers = F.expr(
        "CASE page_id % 6 WHEN 0 THEN map('x-powered-by', 'Shopify', 'x-frame-options', 'DENY') WHEN 1 THEN map('server', 'Squarespace', 'strict-transport-security', 'max-age=1', 'x-robots-tag', 'NoIndex') "
        "WHEN 2 THEN map('via', '1.1 Varnish', 'x-cache', 'HIT') WHEN 3 THEN map('set-cookie', 'a=_shopify_y', 'referrer-policy', '') WHEN 4 THEN map('x-generator', 'Drupal 10', 'powered-by', '') ELSE map('server', 'nginx') END"
    )
    return p.withColumn("headers", headers)


@query(
    f"""WITH r AS (SELECT *, replace({html_sql('duckdb')}, '_next/static', {_ASSET}) AS html FROM pages), x AS (SELECT *, trim(regexp_replace(regexp_replace(regexp_replace({_BODY}, '(?is)<script.*?</script>', '', 'g'), '<[^>]+>', '', 'g'), '^\\s+|\\s+$', '', 'g'), ' ') AS b FROM r)
    SELECT page_id, CASE page_id % 6 WHEN 0 THEN 'shopify' WHEN 1 THEN 'squarespace' WHEN 2 THEN 'varnish-cdn' WHEN 3 THEN 'shopify' WHEN 4 THEN 'drupal' END AS by_headers,
      CASE page_id % 5 WHEN 0 THEN 'nextjs' WHEN 1 THEN 'wordpress' WHEN 2 THEN 'shopify' WHEN 4 THEN 'gatsby' ELSE CASE WHEN length(b) < 20 THEN 'spa-generic' END END AS by_markup,
      coalesce(CASE page_id % 5 WHEN 2 THEN true WHEN 3 THEN length(b) < 20 END, false) AS needs_browser, CASE page_id % 6 WHEN 0 THEN 1 WHEN 1 THEN 1 ELSE 0 END AS secured, strlen(html) AS html_bytes,
      NOT coalesce(is_indexable, false) OR page_id % 6 = 1 AS noindex, title IS NULL OR length(title) < 3 AS poor, CASE WHEN coalesce(len(schema_types), 0) > 0 THEN 'server' ELSE 'none' END AS schema_source FROM x"""
)
def page_platform(spark: SparkSession, d: str) -> DataFrame:
    """Platform by headers and by markup, security headers, bytes, robots and whether a browser should look again."""
    p, h = _platform_pages(spark, d), F.col("html")
    found = H.platform_of_html(h)
    return p.select(
        "page_id", H.platform_of_headers(F.col("headers")).alias("by_headers"), found.alias("by_markup"), H.needs_browser(found).alias("needs_browser"), F.size(H.security_headers(F.col("headers"))).alias("secured"), F.octet_length(h).cast("long").alias("html_bytes"),
        H.robots_with_header(H.tags_of(h, "meta"), F.try_element_at("headers", F.lit("x-robots-tag")), "noindex").alias("noindex"), H.is_poor(F.col("title"), F.lit("text/plain"), F.lit(0), F.lit(0)).alias("poor"), H.schema_source(F.col("schema_types")).alias("schema_source"),
    )


@query(
    """WITH b AS (SELECT page_id, unnest(structured_data) AS x FROM pages), v AS (SELECT page_id, CAST(x AS JSON) AS x FROM b WHERE json_valid(x)),
    n AS (SELECT page_id, x AS node FROM v UNION ALL SELECT page_id, unnest(CAST(json_extract(x, '$."@graph"') AS JSON[])) FROM v WHERE json_type(x, '$."@graph"') = 'ARRAY' UNION ALL SELECT page_id, json_extract(x, '$[0]') FROM v WHERE json_type(x) = 'ARRAY'),
    t AS (SELECT page_id, node ->> '$."@type"' AS t FROM n WHERE json_type(node, '$."@type"') = 'VARCHAR' UNION ALL SELECT page_id, unnest(CAST(json_extract(node, '$."@type"') AS VARCHAR[])) FROM n WHERE json_type(node, '$."@type"') = 'ARRAY')
    SELECT page_id, array_to_string(list_sort(list(DISTINCT t)), ',') AS types FROM t WHERE t IS NOT NULL GROUP BY 1"""
)
def page_schema_types(spark: SparkSession, d: str) -> DataFrame:
    """The types that the JSON-LD blocks of every page declare."""
    p = evenly(read(spark, d, "pages", "page_id", "structured_data")).filter(F.size("structured_data") > 0)
    return p.select("page_id", F.array_join(F.array_sort(H.ld_types(F.col("structured_data"))), ",").alias("types")).filter("types != ''")


@query(
    f"""SELECT page_id, CASE WHEN page_id % 7 = 0 THEN NULL ELSE 'en' END AS lang, CASE WHEN page_id % 6 = 0 THEN 2 ELSE 0 END AS missing_labels, array_to_string(list_filter([CASE WHEN page_id % 3 = 0 THEN 'nav' END, CASE WHEN page_id % 4 = 1 THEN 'main' END], lambda x: x IS NOT NULL), ',') AS landmarks,
      page_id % 3 = 0 AS skip_link, 0 AS tabindex_misuse, page_id % 7 = 1 AS consent FROM pages"""
)
def page_static(spark: SparkSession, d: str) -> DataFrame:
    """Facts of every page that need its tree."""
    found = dom.static_facts(rendered(evenly(read(spark, d, "pages"))))
    return found.select("page_id", "lang", "missing_labels", F.array_join("landmarks", ",").alias("landmarks"), "skip_link", "tabindex_misuse", "consent")


def _known_pages(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "page_history", "project_id", "page_id", "url").unionByName(read(spark, d, "pages", "project_id", "page_id", "url")).distinct()


_FOLDER = f"regexp_replace({d_path('url')}, '[^/]*$', '')"
_BASE = "'https://' || lower(" + part("url", 2) + ")"
_LINKS = f"""p AS (SELECT project_id, page_id, url, http_status FROM pages WHERE regexp_matches(url, {PART})),
    l AS (SELECT project_id, page_id, {_BASE} || '/item/' || (page_id % 50) || '?b=2' AS goal, 'Read more' AS anchor_text, true AS internal, true AS followed FROM p
      UNION ALL SELECT project_id, page_id, {_BASE} || regexp_replace({_FOLDER}, '[^/]+/$', '') || 'up/page', 'Up', true, false FROM p
      UNION ALL SELECT project_id, page_id, 'https://other.test/x', 'here', false, true FROM p WHERE page_id % 3 = 2)"""


@query(
    f"""WITH {_LINKS}, k AS (SELECT DISTINCT project_id, page_id, url FROM page_history UNION SELECT DISTINCT project_id, page_id, url FROM pages),
    f AS (SELECT project_id, page_id, unnest([url, lower(url), regexp_replace(url, '/$', ''), regexp_replace(url, '/$', '') || '/', lower(regexp_replace(url, '/$', '')), lower(regexp_replace(url, '/$', '') || '/')]) AS variant FROM k),
    v AS (SELECT project_id, variant, max(page_id) AS id FROM f GROUP BY 1, 2), c AS (SELECT project_id, url, min(http_status) AS status FROM pages GROUP BY 1, 2),
    j AS (SELECT l.*, coalesce(a.id, b.id) AS dest, c.url IS NOT NULL AS seen, c.status FROM l LEFT JOIN v a ON l.project_id = a.project_id AND l.goal = a.variant LEFT JOIN v b ON l.project_id = b.project_id AND lower(l.goal) = b.variant LEFT JOIN c ON l.project_id = c.project_id AND l.goal = c.url),
    s AS (SELECT *, CASE WHEN internal AND dest IS NOT NULL THEN CASE WHEN seen THEN status ELSE 200 END WHEN NOT internal THEN 404 END AS http_status FROM j)
    SELECT project_id, page_id AS source_page_id, CASE WHEN internal THEN dest END AS destination_page_id, goal AS destination_url, anchor_text, CASE WHEN internal THEN 'internal' ELSE 'external' END AS link_type, followed AS is_followed, http_status, coalesce(http_status >= 400, false) AS is_broken FROM s"""
)
def link_rows(spark: SparkSession, d: str) -> DataFrame:
    """The rows of page_links that the pages' markup gives, with the pages they lead to and the health of external ones."""
    found = rendered(evenly(read(spark, d, "pages"))).select("project_id", "page_id", "url", "http_status", H.links(F.col("html"), F.col("url")).alias("links"))
    statuses = spark.createDataFrame([("https://other.test/x", 404, False)], "url string, status int, private boolean")
    return linkgraph.link_rows(found, _known_pages(spark, d), statuses).drop("rel_attributes")


@query(f"WITH {_LINKS} SELECT p.project_id, count(l.goal) AS links FROM pages p LEFT JOIN l ON p.page_id = l.page_id GROUP BY 1")
def link_totals(spark: SparkSession, d: str) -> DataFrame:
    found = rendered(evenly(read(spark, d, "pages"))).select("project_id", H.links(F.col("html"), F.col("url")).alias("links"))
    return linkgraph.link_totals(found).select("project_id", F.coalesce("links", F.lit(0)).alias("links"))


@query(
    """WITH s AS (SELECT destination_url, max(http_status) AS status FROM page_links WHERE link_type = 'external' AND http_status IS NOT NULL GROUP BY 1)
    SELECT l.link_id, l.destination_url, s.status, (s.status >= 400 OR s.status = 0) AS broken FROM page_links l LEFT JOIN s USING (destination_url) WHERE l.link_type = 'external'"""
)
def external_health(spark: SparkSession, d: str) -> DataFrame:
    """External links with the status of their destination, as probed."""
    links = read(spark, d, "page_links", "link_id", "destination_url", "link_type", "http_status")
    return linkgraph.health(links, links.filter("link_type = 'external' AND http_status IS NOT NULL").groupBy(F.col("destination_url").alias("url")).agg(F.max("http_status").alias("status")))


@query("SELECT DISTINCT project_id, source_page_id AS page_id, destination_url, http_status, CAST(source_page_id AS VARCHAR) || ':broken_internal_link:' || destination_url AS fingerprint FROM page_links WHERE link_type = 'internal' AND is_broken")
def broken_internal(spark: SparkSession, d: str) -> DataFrame:
    return linkgraph.broken_internal(read(spark, d, "page_links", "project_id", "source_page_id", "destination_url", "http_status", "link_type", "is_broken"))


@query("SELECT page_id, url FROM pages WHERE regexp_matches(url, '(?i)^https?://') QUALIFY row_number() OVER (PARTITION BY lower(trim(url)) ORDER BY page_id) = 1")
def first_results(spark: SparkSession, d: str) -> DataFrame:
    return linkgraph.first_results(read(spark, d, "pages", "page_id", "url"), "page_id").select("page_id", "url")


@query("SELECT DISTINCT page_id, url FROM page_history WHERE NOT coalesce(regexp_matches(url, '(?i)^https?://'), false) OR regexp_matches(url, '(?i)^https?://(mailto|tel|javascript|sms|ftp):')")
def bogus_pages(spark: SparkSession, d: str) -> DataFrame:
    return linkgraph.bogus_pages(read(spark, d, "page_history", "page_id", "url")).distinct()


@query(
    """WITH g AS (SELECT page_id FROM pages WHERE http_status = 404)
    SELECT 'page_links' AS name, count(*) AS rows FROM page_links WHERE coalesce(source_page_id NOT IN (SELECT page_id FROM g), true) AND coalesce(destination_page_id NOT IN (SELECT page_id FROM g), true)
    UNION ALL SELECT 'issues', count(*) FROM issues WHERE coalesce(page_id NOT IN (SELECT page_id FROM g), true) UNION ALL SELECT 'backlinks', count(*) FROM backlinks WHERE coalesce(page_id NOT IN (SELECT page_id FROM g), true)
    UNION ALL SELECT 'pages', count(*) FROM pages WHERE coalesce(page_id NOT IN (SELECT page_id FROM g), true)"""
)
def cascade_tables(spark: SparkSession, d: str) -> DataFrame:
    """Rows of each table that are left once the pages not found are gone."""
    left = linkgraph.cascade(read(spark, d, "pages").filter("http_status = 404"), *[read(spark, d, t) for t in ("page_links", "issues", "backlinks", "pages")])
    counts = [df.agg(F.count("*").alias("rows")).select(F.lit(n).alias("name"), "rows") for n, df in left.items()]
    return counts[0].unionByName(counts[1]).unionByName(counts[2]).unionByName(counts[3])


@query("SELECT project_id, min(page_id) AS page_id FROM pages WHERE depth = 0 GROUP BY 1")
def homepages(spark: SparkSession, d: str) -> DataFrame:
    return linkgraph.homepages(read(spark, d, "pages", "project_id", "page_id", "depth"))


def _external(spark: SparkSession, d: str) -> DataFrame:
    """External pages with the anchors that the backlinks tell of."""
    b = read(spark, d, "backlinks").drop("project_id").join(read(spark, d, "pages", "page_id", "project_id", F.col("url").alias("goal")), "page_id")
    tag = F.concat(F.lit('<p><a class="x" href="'), "goal", F.when(F.coalesce("is_followed", F.lit(True)), '" rel="noopener">').otherwise('" rel="ugc nofollow"><b>'), F.coalesce("anchor_text", F.lit("")), F.lit("</b></a> <a href='/inner'>own</a></p>"))
    return b.groupBy("project_id", F.col("source_url").alias("url")).agg(F.array_join(F.array_sort(F.collect_list(tag)), "").alias("html")).withColumns({"status": F.lit(200), "content_type": F.lit("text/html; charset=utf-8")})


@query(
    f"""WITH b AS (SELECT p.project_id, b.source_url, CASE WHEN regexp_matches(p.url, '(?i)^[a-z][a-z0-9+.-]*://[^/?#]+$') THEN p.url || '/' ELSE p.url END AS target, b.anchor_text, coalesce(b.is_followed, true) AS f FROM backlinks b JOIN pages p USING (page_id)),
    g AS (SELECT project_id, page_id, unnest(list_distinct([url, regexp_replace(url, '/$', ''), CASE WHEN ends_with(url, '/') THEN url ELSE url || '/' END])) AS target FROM pages), k AS (SELECT project_id, target, max(page_id) AS page_id FROM g GROUP BY 1, 2)
    SELECT b.project_id, source_url, {d_bare('source_url')} AS source_domain, b.target, k.page_id, nullif(trim(coalesce(anchor_text, ''), ' '), '') AS anchor_text, f AS is_followed FROM b JOIN projects r USING (project_id) LEFT JOIN k ON b.project_id = k.project_id AND b.target = k.target
    WHERE {d_bare('source_url')} <> '' AND {d_bare('source_url')} <> {d_bare('r.url')} AND {d_bare('b.target')} = {d_bare('r.url')}"""
)
def backlinks_found(spark: SparkSession, d: str) -> DataFrame:
    """The links of external pages to projects."""
    return backlinks.find(_external(spark, d), read(spark, d, "projects", "project_id", "url"), read(spark, d, "pages", "project_id", "page_id", "url"))


@query(
    f"""WITH f AS ({SQL['backlinks_found']}), n AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY project_id, source_url ORDER BY page_id NULLS LAST, anchor_text NULLS LAST, is_followed DESC) = 1), c AS (SELECT project_id, source_url, min(created_at) AS c FROM backlinks GROUP BY 1, 2)
    SELECT n.project_id, n.source_url, page_id, anchor_text, is_followed, coalesce(c, TIMESTAMP '2026-01-01') AS created_at, TIMESTAMP '2026-01-01' AS last_seen_at FROM n LEFT JOIN c ON n.project_id = c.project_id AND n.source_url = c.source_url"""
)
def backlinks_kept(spark: SparkSession, d: str) -> DataFrame:
    """The backlinks of every project after the search."""
    kept = read(spark, d, "backlinks").select("project_id", "source_url", "page_id", "anchor_text", "is_followed", "created_at", "last_seen_at")
    return backlinks.reconcile(kept, backlinks_found(spark, d), F.lit("2026-01-01").cast("timestamp_ntz"))


@query("SELECT project_id, url FROM (SELECT project_id, destination_url AS url, min(link_id) AS k FROM page_links WHERE link_type = 'external' GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY project_id ORDER BY k, url) <= 100")
def backlink_targets(spark: SparkSession, d: str) -> DataFrame:
    """The external addresses that are looked at for each project."""
    return backlinks.targets(read(spark, d, "page_links", "project_id", "link_id", "destination_url", "link_type"))


_CLEAN = f"CASE WHEN trim(u) IN ('', '#') OR regexp_matches(lower(trim(u)), '^({_NON_HTTP}):') OR regexp_matches(trim(u), '(?i)^https?://(mailto|tel|javascript|sms|ftp):') OR length(trim(u)) > 2000 THEN NULL ELSE {d_normal('u')} END"
_SHUT = f"(regexp_matches(lower({d_path('url')}), '\\.({'|'.join(U.FILES)})$') OR regexp_matches(lower({d_path('url')}), '{'|'.join(U.MACHINERY + U.SIGN_IN)}') OR regexp_matches({part('url', 4)}, '(?i)[?&]({'|'.join(U.LISTINGS)})='))"
_PRIORITY = f"""greatest(1, 10 - depth + CASE WHEN regexp_matches(url, '(?i){U.PRODUCT}') THEN 5 WHEN regexp_matches(url, '(?i){U.CATEGORY}') THEN 3 ELSE 0 END + CASE WHEN len(list_filter(string_split({part('url', 3)}, '/'), lambda s: s <> '')) <= 1 THEN 2 ELSE 0 END
    - CASE WHEN len(list_filter(string_split(substr({part('url', 4)}, 2), '&'), lambda s: s <> '')) > 3 THEN 2 ELSE 0 END)"""


@query(
    f"""WITH l AS (SELECT l.project_id, l.source_page_id AS parent_seq, p.depth + 1 AS depth, l.link_id AS "at", l.destination_url AS u FROM page_links l JOIN pages p ON l.source_page_id = p.page_id), c AS (SELECT *, {_CLEAN} AS url FROM l),
    q AS (SELECT *, {_PRIORITY} AS priority FROM c WHERE url IS NOT NULL AND NOT {_SHUT}), s AS (SELECT project_id, url FROM pages)
    SELECT project_id, url, parent_seq, CAST(priority AS INT) AS priority, "at" FROM q WHERE (project_id, url) NOT IN (SELECT project_id, url FROM s) QUALIFY row_number() OVER (PARTITION BY project_id, url ORDER BY parent_seq, priority DESC, "at") = 1"""
)
def crawl_queue(spark: SparkSession, d: str) -> DataFrame:
    """What a next round of every crawl takes up, with the place in the queue."""
    p = read(spark, d, "pages", "page_id", "project_id", "url", "depth")
    links = read(spark, d, "page_links", "project_id", "source_page_id", "link_id", "destination_url").join(p.select(F.col("page_id").alias("source_page_id"), (F.col("depth") + 1).alias("depth"), F.col("url").alias("page_url")), "source_page_id")
    return crawl.enqueued(links.select("project_id", F.col("source_page_id").alias("parent_seq"), "depth", F.col("link_id").alias("at"), F.col("destination_url").alias("href"), "page_url"), p)


@query(
    f"""WITH a AS (SELECT project_id, {d_normal('url')} AS url, 0 AS depth FROM projects UNION ALL
      SELECT project_id, {d_normal('url')}, len(list_filter(string_split({part('url', 3)}, '/'), lambda s: s <> '')) FROM (SELECT DISTINCT project_id, url FROM page_history))
    SELECT project_id, url, CAST(min(depth) AS INT) AS depth FROM a WHERE url IS NOT NULL AND depth <= 5 AND (depth = 0 OR NOT {_SHUT}) GROUP BY 1, 2"""
)
def crawl_seeds(spark: SparkSession, d: str) -> DataFrame:
    """Where the crawl of every project begins: its address, and the pages of its history as sitemap entries."""
    start, listed = read(spark, d, "projects", "project_id", "url"), read(spark, d, "page_history", "project_id", "url").distinct()
    return crawl.seeds(start, start.limit(0), listed)


@query(
    "SELECT scan_id, greatest(1.5 * pages_scanned, pages_scanned + scan_id % 50)::DOUBLE AS estimated, CAST(least(95, floor(100 * pages_scanned / greatest(1.0, greatest(1.5 * pages_scanned, pages_scanned + scan_id % 50))::DOUBLE + 0.5)) AS INT) AS percent FROM scans WHERE pages_scanned IS NOT NULL"
)
def scan_progress(spark: SparkSession, d: str) -> DataFrame:
    """The progress that each scan would report."""
    s = read(spark, d, "scans", "scan_id", "pages_scanned").filter("pages_scanned IS NOT NULL").select("scan_id", F.col("pages_scanned").alias("scanned"), (F.col("scan_id") % 50).alias("queued"))
    return crawl.progress(s).select("scan_id", F.col("estimated").cast("double").alias("estimated"), "percent")


@query(
    """WITH r AS (SELECT project_id, coalesce(http_status = 403, false) AS b, depth = 0 AS h, page_id FROM pages), g AS (SELECT project_id, count(*) FILTER (b) AS blocked_pages, count(*) AS total_pages, bool_or(b AND coalesce(h, false)) AS home FROM r GROUP BY 1)
    SELECT project_id, blocked_pages, total_pages, '192.0.2.7' AS egress_ip FROM g WHERE blocked_pages > 0 AND (home OR blocked_pages * 2 >= total_pages)"""
)
def blocked_crawls(spark: SparkSession, d: str) -> DataFrame:
    """Projects whose latest crawl was blocked."""
    p = read(spark, d, "pages", "project_id", "http_status", "depth")
    return crawl.block_verdicts(p.select("project_id", (F.col("depth") == 0).alias("homepage"), (F.col("http_status") == 403).alias("blocked"), F.lit("blocked IP 192.0.2.7").alias("error")))


_FILE = """CASE project_id % 5 WHEN 0 THEN 'User-agent: *' || chr(10) || 'Disallow: /' || chr(10) || 'User-agent: GPTBot' || chr(10) || 'Allow: /' || chr(10) || 'Sitemap: ' || url || 'sitemap.xml'
    WHEN 1 THEN '# none' || chr(13) || chr(10) || 'User-agent: ccbot' || chr(13) || chr(10) || 'Disallow: / # all' || chr(10) || 'User-agent: *' || chr(10) || '  disallow: /p' || project_id || chr(10) || 'Allow:' WHEN 2 THEN 'Disallow: /x' || chr(10) || 'User-agent: GPTBot' || chr(10) || 'User-agent: CCBot' || chr(10) || 'Disallow: /' || chr(10) || 'User-agent: *' || chr(10) || 'Disallow: /'
    WHEN 3 THEN 'User-agent: *' || chr(10) || 'User-agent: GPTBot' || chr(10) || 'Allow: /' || chr(10) || 'User-agent: *' || chr(10) || 'Disallow: /' ELSE '' END"""
_ROBOTS = f"""WITH f AS (SELECT project_id AS site, {_FILE} AS content FROM projects), l AS (SELECT site, unnest(string_split(content, chr(10))) AS raw, generate_subscripts(string_split(content, chr(10)), 1) - 1 AS pos FROM f),
    t AS (SELECT site, pos, trim(raw, ' ' || chr(13) || chr(9)) AS line FROM l), k AS (SELECT site, pos, lower(regexp_extract(line, '(?i)^(sitemap|user-agent|disallow|allow):', 1)) AS field, trim(regexp_extract(line, '^[^:]*:(.*)$', 1)) AS value FROM t WHERE line <> '' AND NOT starts_with(line, '#')),
    o AS (SELECT *, last_value(CASE WHEN field = 'user-agent' THEN value END IGNORE NULLS) OVER (PARTITION BY site ORDER BY pos) AS agent FROM k WHERE field <> ''),
    a AS (SELECT site, agent, min(pos) FILTER (field = 'user-agent') AS pos, bool_or(field = 'disallow' AND value = '/') AND NOT bool_or(field = 'allow' AND value = '/') AS shut, list(value ORDER BY pos) FILTER (field = 'disallow' AND value <> '') AS paths FROM o WHERE agent <> '' GROUP BY 1, 2)"""
_AGENTS = ", ".join(f"'{a}'" for a in sitefiles.AGENTS)


def _robots(spark: SparkSession, d: str) -> DataFrame:
    """A robots file of each project."""
    return read(spark, d, "projects", "project_id", "url").select(F.col("project_id").alias("site"), F.expr(_FILE).alias("content"))


@query(_ROBOTS + " SELECT site, CASE WHEN field <> 'sitemap' THEN agent END AS agent, field AS kind, value, pos AS at FROM o WHERE field <> 'user-agent' AND value <> '' AND (field = 'sitemap' OR coalesce(agent, '') <> '')")
def robots_rules(spark: SparkSession, d: str) -> DataFrame:
    """The rules of every project's robots file."""
    return sitefiles.robots_rules(_robots(spark, d)).withColumn("at", F.col("at").cast("long"))


@query(
    _ROBOTS
    + f""", n AS (SELECT site, unnest([{_AGENTS}]) AS name FROM f), w AS (SELECT n.site, n.name, s.pos, s.shut, e.pos AS all_pos, e.shut AS all_shut FROM n LEFT JOIN a s ON n.site = s.site AND lower(s.agent) = lower(n.name) LEFT JOIN a e ON n.site = e.site AND e.agent = '*')
    SELECT site, name AS agent, CASE WHEN coalesce(shut, false) OR (coalesce(all_shut, false) AND (pos IS NULL OR all_pos < pos)) THEN 'blocked' ELSE 'allowed' END AS verdict FROM w WHERE coalesce(shut, false) OR (coalesce(all_shut, false) AND (pos IS NULL OR all_pos < pos)) OR pos IS NOT NULL"""
)
def agent_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """Which agents of answer engines may read each project's site."""
    return sitefiles.agent_verdicts(_robots(spark, d))


@query(_ROBOTS + " SELECT site, agent FROM (SELECT n.site, n.name AS agent, s.shut, s.pos, e.shut AS all_shut, e.pos AS all_pos FROM (SELECT site, unnest([" + _AGENTS + "]) AS name FROM f) n LEFT JOIN a s ON n.site = s.site AND lower(s.agent) = lower(n.name) LEFT JOIN a e ON n.site = e.site AND e.agent = '*') WHERE coalesce(shut, false) OR (coalesce(all_shut, false) AND (pos IS NULL OR all_pos < pos))")
def blocked_agents(spark: SparkSession, d: str) -> DataFrame:
    return sitefiles.blocked_agents(_robots(spark, d))


@query(_ROBOTS + " SELECT site, agent, array_to_string(paths, ' ') AS paths FROM a WHERE len(paths) > 0")
def blocked_paths(spark: SparkSession, d: str) -> DataFrame:
    return sitefiles.blocked_paths(_robots(spark, d)).withColumn("paths", F.array_join("paths", " "))


def _maps(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Sitemap roots of all projects and their files: an index with a map of the history's addresses for two thirds of them, which is broken or
    undated for some; the others answer 404."""
    p = read(spark, d, "projects", "project_id", "url").select("project_id", F.concat("url", F.lit("sitemap.xml")).alias("root"), F.concat("url", F.lit("pages.xml")).alias("sub"))
    roots = p.select(F.col("project_id").alias("site"), F.col("root").alias("url"))
    k = F.col("project_id") % 6
    index = F.when(k == 4, F.lit("<html></html>")).otherwise(F.concat(F.lit("<sitemapindex><loc>"), "sub", F.lit("</loc><loc>"), "root", F.lit("</loc></sitemapindex>")))
    top = p.select(F.col("root").alias("url"), F.when(k < 2, 404).otherwise(200).alias("status"), index.alias("content"))
    urls = read(spark, d, "page_history", "project_id", "url").distinct().groupBy("project_id").agg(F.array_join(F.array_sort(F.collect_list(F.concat(F.lit("<url><loc>"), "url", F.lit("</loc></url>")))), "").alias("x"))
    below = p.join(urls, "project_id", "left").select(F.col("sub").alias("url"), F.when(k == 3, 500).otherwise(200).alias("status"), F.concat(F.lit("<urlset>"), F.when(k == 5, "<lastmod>2025</lastmod>").otherwise(""), F.coalesce("x", F.lit("")), F.lit("</urlset>")).alias("content"))
    return roots, top.unionByName(below)


@query(
    f"""WITH u AS (SELECT project_id, count(DISTINCT url) FILTER (regexp_matches(url, '(?i)^https?://[^<]+$')) AS n FROM page_history GROUP BY 1), p AS (SELECT project_id AS site, project_id % 6 AS k, coalesce(n, 0) AS n, url FROM projects LEFT JOIN u USING (project_id))
    SELECT site, k >= 2 AS found, k IN (2, 5) AND n > 0 AS valid, CASE WHEN k IN (2, 5) THEN n ELSE 0 END AS url_count, k = 5 AS has_lastmod, CASE WHEN k IN (2, 3, 5) THEN 1 ELSE 0 END AS sub_sitemaps,
      array_to_string(list_filter([CASE WHEN k < 2 THEN 'Sitemap returned HTTP 404' WHEN k = 4 THEN 'Sitemap does not contain valid XML urlset or sitemapindex' WHEN k = 3 THEN 'Sub-sitemap ' || url || 'pages.xml returned HTTP 500' END,
        CASE WHEN k = 3 OR (k IN (2, 5) AND n = 0) THEN 'Sitemap contains no URLs' END, CASE WHEN k IN (2, 3) THEN 'Sitemap is missing <lastmod> dates' END], lambda x: x IS NOT NULL), '; ') AS errors FROM p"""
)
def sitemap_checks(spark: SparkSession, d: str) -> DataFrame:
    """The state of every project's sitemap, with those that its index lists."""
    roots, files = _maps(spark, d)
    tree = sitefiles.sitemap_tree(roots, files, most=sitefiles.SUB_MOST + 1)
    return sitefiles.sitemap_validation(tree, roots).withColumn("errors", F.array_join("errors", "; "))


@query()
def site_issues(spark: SparkSession, d: str) -> DataFrame:
    """The issues of whole sites, at their homepages."""
    roots, files = _maps(spark, d)
    maps = sitefiles.sitemap_validation(sitefiles.sitemap_tree(roots, files, most=sitefiles.SUB_MOST + 1), roots)
    robots = _robots(spark, d)
    homes = linkgraph.homepages(read(spark, d, "pages", "project_id", "page_id", "depth")).withColumnRenamed("project_id", "site")
    probes = robots.select("site", F.lit("robots").alias("kind"), F.when(F.col("content") != "", 200).otherwise(404).alias("status"))
    llms = sitefiles.llms_file(robots.select("site", F.when(F.col("site") % 2 == 0, 200).otherwise(404).alias("status"), F.lit("text/plain").alias("content_type"), F.lit("title: x").alias("content")))
    away = sitefiles.sitemap_difference(sitefiles.sitemap_entries(read(spark, d, "page_history", "project_id", "url").select(F.col("project_id").alias("site"), F.concat(F.lit("<loc>"), "url", F.lit("</loc>")).alias("content"))), read(spark, d, "pages", "project_id", "url", "http_status").select(F.col("project_id").alias("site"), "url", F.col("http_status").alias("status")))
    return sitefiles.site_issues(homes, llms.select("site", "exists"), sitefiles.exists(probes).select("site", "exists"), sitefiles.agent_verdicts(robots), maps, away.filter("side = 'not_in_sitemap'").select("site", "url"))


def _records(spark: SparkSession, d: str) -> DataFrame:
    """Page records for the analyses; a page's place in the crawl is its id, its platform that of its markup."""
    p = _platform_pages(spark, d).withColumns({"seq": F.col("page_id"), "platform": H.platform_of_html(F.col("html")), "script_gap": F.lit(None).cast("int"), "missing_labels": F.when(F.col("page_id") % 6 == 0, 2).otherwise(0)})
    return pagefacts.records(p).join(read(spark, d, "pages", "page_id", "first_byte_time_ms"), "page_id")


@query(
    f"""WITH p AS (SELECT *, page_id % 4 = 0 AS sized, CASE WHEN page_id % 8 = 0 THEN 1 ELSE 0 END AS hint, CASE WHEN page_id % 2 = 1 THEN 1 ELSE 0 END AS shifting FROM pages),
    a AS (SELECT project_id, coalesce(avg(load_time_ms) FILTER (load_time_ms > 0), 0) AS l, coalesce(avg(first_byte_time_ms) FILTER (first_byte_time_ms > 0), 0) AS f, coalesce(avg(size_bytes) FILTER (size_bytes > 0), 0) AS b, sum(shifting) AS c, max(hint) AS h FROM p GROUP BY 1)
    SELECT project_id, CAST(greatest(0, 100 - CASE WHEN l > 5000 THEN 30 WHEN l > 3000 THEN 15 ELSE 0 END - CASE WHEN f > 1000 THEN 15 ELSE 0 END - CASE WHEN b / 1048576 > 3 THEN 20 WHEN b / 1048576 > 1.5 THEN 10 ELSE 0 END - CASE WHEN c > 5 THEN 10 ELSE 0 END - CASE WHEN h > 0 THEN 0 ELSE 5 END) AS INT) AS score,
      CAST(round(l, 3) AS DOUBLE) AS avg_load_ms, CAST(round(f, 3) AS DOUBLE) AS avg_first_byte_ms, CAST(c AS BIGINT) AS shifting_images FROM a"""
)
def audit_performance(spark: SparkSession, d: str) -> DataFrame:
    """Speed of every project's site."""
    found = audit.performance(_records(spark, d))
    return found.select("project_id", "score", F.round("avg_load_ms", 3).alias("avg_load_ms"), F.round("avg_first_byte_ms", 3).alias("avg_first_byte_ms"), "shifting_images")


_FIRST = "(SELECT * FROM pages QUALIFY row_number() OVER (PARTITION BY project_id ORDER BY page_id) <= 10)"


@query(
    f"""WITH g AS (SELECT project_id, count(*) FILTER (page_id % 5 = 0) AS next, count(*) FILTER (page_id % 5 = 2) AS shop, count(*) FILTER (page_id % 5 = 1) AS wp FROM {_FIRST} GROUP BY 1)
    SELECT project_id, CASE WHEN next > 0 THEN 'Next.js' END AS framework, CASE WHEN shop > 0 THEN 'Shopify' WHEN wp > 0 THEN 'WordPress' END AS cms FROM g"""
)
def audit_tech(spark: SparkSession, d: str) -> DataFrame:
    """Technology of every project's site; no library or analytics occurs in the tables."""
    return audit.tech_stack(_records(spark, d)).select("project_id", "framework", "cms")


_TYPE = """CASE WHEN bool_or(regexp_matches(lower(url), '/products|/shop|/cart')) THEN 'ecommerce' WHEN bool_or(contains(lower(url), '/pricing')) THEN 'saas' WHEN count(*) FILTER (regexp_matches(lower(url), '/blog/|/articles/|/posts/')) >= 3 THEN 'blog'
    WHEN bool_or(regexp_matches(lower(url), '/portfolio|/projects')) OR (bool_or(contains(lower(url), '/work')) AND NOT bool_or(contains(lower(url), '/how-we-work'))) THEN 'portfolio' ELSE 'business' END"""


@query(f"SELECT project_id, {_TYPE} AS site_type FROM pages GROUP BY 1")
def audit_site_types(spark: SparkSession, d: str) -> DataFrame:
    return audit.site_types(read(spark, d, "pages", "project_id", "url"))


@query(f"SELECT project_id, false AS uses_jquery, bool_or(page_id % 5 = 0 OR regexp_matches(lower(url), 'react|vue|_next/|nuxt')) AS modern, CASE WHEN bool_or(page_id % 5 = 0 OR regexp_matches(lower(url), 'react|vue|_next/|nuxt')) THEN 100 ELSE 85 END AS score FROM pages GROUP BY 1")
def audit_modernization(spark: SparkSession, d: str) -> DataFrame:
    return audit.modernization(_records(spark, d))


@query()
def audit_completeness(spark: SparkSession, d: str) -> DataFrame:
    """Which expected pages every project's site has."""
    return audit.completeness(_records(spark, d))


@query("SELECT project_id, coalesce(bool_or(http_status BETWEEN 200 AND 299 AND (coalesce(word_count, 0) >= 50 OR coalesce(regexp_matches(title, '[^\\s\\p{Z}\\x{FEFF}]'), false))), false) AS sufficient FROM pages GROUP BY 1")
def audit_sufficient(spark: SparkSession, d: str) -> DataFrame:
    return audit.sufficient(read(spark, d, "pages", "project_id", "http_status", "word_count", "title"))


@query()
def audit_overall(spark: SparkSession, d: str) -> DataFrame:
    """All scores of every project's site."""
    r = _records(spark, d).persist()
    sites = read(spark, d, "projects", "project_id", "url").withColumns({"has_robots": F.col("project_id") % 5 < 4, "has_sitemap": F.col("project_id") % 6 > 1})
    scores = {"modernization": audit.modernization(r), "performance": audit.performance(r), "completeness": audit.completeness(r), "design": audit.design(r), "standards": audit.standards(r, sites)}
    return audit.overall(scores, audit.sufficient(r))


@query()
def page_issue_rows(spark: SparkSession, d: str) -> DataFrame:
    """Every issue of every page with description and details."""
    p = _platform_pages(spark, d)
    text = F.concat_ws(". ", "title", "meta_description")
    p = p.withColumns({"readability": T.readability(text), "top_keyword": F.get(F.regexp_extract_all(F.lower("meta_description"), F.lit(r"\p{L}{4,}"), F.lit(0)), 0)})
    found = dom.static_facts(p).select("page_id", "missing_labels", "tabindex_misuse", F.col("words").alias("rendered_words"))
    return issuerows.issue_rows(pagefacts.records(p.withColumn("plain_words", H.word_count(F.col("html"))).join(found, "page_id")))


@query(
    """WITH i AS (SELECT scan_id, count(*) FILTER (s = 'critical') AS critical, count(*) FILTER (s = 'high') AS high, count(*) FILTER (s = 'medium') AS medium, count(*) FILTER (s = 'low') AS low FROM (SELECT DISTINCT scan_id, issue_id, coalesce(severity, 'low') AS s FROM issues) GROUP BY 1),
    p AS (SELECT scan_id, count(*) AS pages, count(*) FILTER (is_indexable) AS indexable FROM pages WHERE starts_with(url, 'http') GROUP BY 1), b AS (SELECT p.scan_id, count(*) AS broken_links FROM (SELECT DISTINCT link_id, source_page_id FROM page_links WHERE is_broken) l JOIN pages p ON l.source_page_id = p.page_id GROUP BY 1),
    o AS (SELECT scan_id, arg_max(overall, scan_score_id) AS score FROM scan_scores GROUP BY 1)
    SELECT s.scan_id, s.project_id, coalesce(critical, 0) AS critical, coalesce(high, 0) AS high, coalesce(medium, 0) AS medium, coalesce(low, 0) AS low, coalesce(pages, 0) AS pages, coalesce(indexable, 0) AS indexable, coalesce(broken_links, 0) AS broken_links, CAST(least(100, greatest(0, score)) AS INT) AS score
    FROM (SELECT DISTINCT scan_id, project_id FROM scans) s LEFT JOIN i USING (scan_id) LEFT JOIN p USING (scan_id) LEFT JOIN b USING (scan_id) LEFT JOIN o USING (scan_id)"""
)
def scan_snapshots(spark: SparkSession, d: str) -> DataFrame:
    """The whole snapshot of every scan."""
    return merge.snapshots(*[read(spark, d, t) for t in ("scans", "issues", "pages", "page_links", "scan_scores")])


@query(
    """WITH l AS (SELECT project_id, arg_max(scan_id, struct_pack(a := coalesce(completed_at, started_at), b := scan_id)) AS scan_id FROM scans WHERE scan_type = 'seo' AND status = 'completed' GROUP BY 1)
    SELECT project_id, scan_id FROM l WHERE scan_id NOT IN (SELECT scan_id FROM scan_scores)"""
)
def unscored_scans(spark: SparkSession, d: str) -> DataFrame:
    """The latest completed scans that wait for their score."""
    return merge.unscored(completed(read(spark, d, "scans")), read(spark, d, "scan_scores", "scan_id"))


@query(
    """SELECT page_id, coalesce(http_status, 0) AS http_status, coalesce(title, '') AS title, coalesce(word_count, 0) AS word_count, coalesce(is_indexable, true) AS is_indexable, coalesce(load_time_ms, 0) AS load_time_ms, coalesce(len(h1s), 0) AS h1s, coalesce(len(structured_data), 0) AS blocks FROM pages"""
)
def page_defaults(spark: SparkSession, d: str) -> DataFrame:
    """Stored rows as records."""
    p = merge.defaulted(read(spark, d, "pages", "page_id", "http_status", "title", "word_count", "is_indexable", "load_time_ms", "h1s", "structured_data"))
    return p.select("page_id", "http_status", "title", "word_count", "is_indexable", "load_time_ms", F.size("h1s").cast("long").alias("h1s"), F.size("structured_data").cast("long").alias("blocks"))


@query(
    """WITH s AS (SELECT DISTINCT source_page_id FROM page_links WHERE is_broken) SELECT l.link_id, l.source_page_id, CASE WHEN s.source_page_id IS NOT NULL THEN 'new' ELSE 'kept' END AS version FROM page_links l LEFT JOIN s USING (source_page_id)"""
)
def links_replaced(spark: SparkSession, d: str) -> DataFrame:
    """The links of sources with a broken link written anew over the kept ones."""
    links = read(spark, d, "page_links", "link_id", "source_page_id", "is_broken")
    new = links.join(links.filter("is_broken").select("source_page_id").distinct(), "source_page_id", "left_semi").select("link_id", "source_page_id", F.lit("new").alias("version"))
    return merge.replaced(links.select("link_id", "source_page_id", F.lit("kept").alias("version")), new, ["source_page_id"])


@query("SELECT l.project_id, l.link_id, p.page_id FROM page_links l JOIN (SELECT DISTINCT project_id, url, page_id FROM pages) p ON l.project_id = p.project_id AND l.destination_url = p.url")
def page_id_lookup(spark: SparkSession, d: str) -> DataFrame:
    """The pages that links name by their exact address."""
    return linkgraph.page_ids(read(spark, d, "page_links", "project_id", "link_id", F.col("destination_url").alias("url")), read(spark, d, "pages", "project_id", "url", "page_id")).select("project_id", "link_id", "page_id")


_TRUE = "(p.type IN ('OBJECT', 'ARRAY') OR (p.type = 'VARCHAR' AND p.v <> '') OR (p.type = 'BOOLEAN' AND p.v = 'true') OR (p.type NOT IN ('OBJECT', 'ARRAY', 'VARCHAR', 'BOOLEAN', 'NULL') AND CAST(p.v AS DOUBLE) <> 0))"
_lacks = lambda name, *keys: f"NOT EXISTS (SELECT 1 FROM props p WHERE p.row_id = t.row_id AND p.node = t.node AND p.kp IN ({', '.join(repr(k) for k in keys)}) AND {_TRUE})"
_empty = lambda key: f"NOT EXISTS (SELECT 1 FROM walk w WHERE w.source = 'structured_data' AND w.row_id = t.row_id AND w.owner = t.node AND w.kp = '{key}|0')"
_has = lambda n: f"list_contains(types, '{n}')"
_NEEDS = (
    [(f"CASE WHEN {_has('LocalBusiness')} THEN 'LocalBusiness' ELSE 'Organization' END", f"({_has('Organization')} OR {_has('LocalBusiness')})", k) for k in ("name", "url")]
    + [(f"CASE WHEN {_has('NewsArticle')} THEN 'NewsArticle' WHEN {_has('BlogPosting')} THEN 'BlogPosting' ELSE 'Article' END", f"({_has('Article')} OR {_has('BlogPosting')} OR {_has('NewsArticle')})", k) for k in ("headline", "datePublished", "author", "image")]
    + [("'Product'", _has("Product"), k) for k in ("name", "image")] + [("'WebSite'", _has("WebSite"), "name")]
)


@query(
    WALK
    + """, nodes AS (SELECT DISTINCT row_id, node FROM walk WHERE source = 'structured_data' AND type = 'OBJECT' AND regexp_matches(tab, '^[$]([|][*]|[|]@graph([|][*])+)*$')),
    props AS (SELECT row_id, owner AS node, kp, type, atom ->> '$' AS v FROM walk WHERE source = 'structured_data' AND owner <> '' AND NOT contains(kp, '|')),
    own AS (SELECT n.row_id, n.node, coalesce(list(DISTINCT kp) FILTER (kp IS NOT NULL AND kp <> '@context'), []) AS keys, bool_or(kp = '@graph' AND type = 'ARRAY') AS graph FROM nodes n LEFT JOIN props p ON n.row_id = p.row_id AND n.node = p.node GROUP BY ALL),
    kinds AS (SELECT row_id, owner AS node, list(atom ->> '$') AS types FROM walk WHERE source = 'structured_data' AND type = 'VARCHAR' AND regexp_matches(kp, '^@type([|][0-9]+)?$') GROUP BY 1, 2),
    t AS (SELECT o.row_id, o.node, coalesce(types, []) AS types FROM own o LEFT JOIN kinds k ON o.row_id = k.row_id AND o.node = k.node WHERE NOT (coalesce(graph, false) AND keys = ['@graph']) AND keys <> ['@id']), x AS ("""
    + " UNION ALL ".join(
        ["SELECT row_id, 'Missing @type property' AS problem FROM t WHERE len(types) = 0", f"SELECT row_id, 'Product: missing \"offers\" or \"price\"' FROM t WHERE {_has('Product')} AND {_lacks('Product', 'offers', 'price')}"]
        + [f"SELECT row_id, {name} || ': missing \"{k}\"' FROM t WHERE {cond} AND {_lacks(name, k)}" for name, cond, k in _NEEDS]
        + [f"SELECT row_id, '{n}: missing or empty {k}' FROM t WHERE {_has(n)} AND {_empty(k)}" for n, k in (("BreadcrumbList", "itemListElement"), ("FAQPage", "mainEntity"))]
    )
    + ") SELECT row_id AS page_id, problem, count(*) AS nodes FROM x GROUP BY 1, 2"
)
def json_ld_problems(spark: SparkSession, d: str) -> DataFrame:
    """What the JSON-LD nodes of every page lack, and on how many nodes."""
    p = evenly(read(spark, d, "pages", "page_id", "structured_data")).filter(F.size("structured_data") > 0)
    return p.select("page_id", F.explode(issuerows.ld_problems(F.col("structured_data"))).alias("problem")).groupBy("page_id", "problem").agg(F.count("*").alias("nodes"))
