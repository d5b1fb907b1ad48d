"""Site analyses, site files, link rows, backlinks and crawl details on small tables with known results."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from crawlspan.functions import html as H
from crawlspan.functions import urls as U
from crawlspan.operators import audit, backlinks, crawl, linkgraph, sitefiles

LINK = "array<struct<href:string,url:string,anchor_text:string,rel:array<string>,internal:boolean>>"
PAGE = f"project_id int, seq int, url string, http_status int, title string, word_count int, load_time_ms int, first_byte_time_ms int, size_bytes long, script_srcs array<string>, stylesheet_hrefs array<string>, tags string, platform string, links {LINK}, h1s array<string>, h2s array<string>, schema_types array<string>, shifting_images int, hint_count int, script_gap int, favicon string, viewport boolean, lang string, missing_labels int, landmark_count int, skip_link boolean, consent boolean"
NAMES = [x.split()[0] for x in PAGE.replace("struct<href:string,url:string,anchor_text:string,rel:array<string>,internal:boolean>", "x").split(", ")]


def pages(spark, *rows):
    base = {"project_id": 1, "url": "https://a.test/", "http_status": 200}
    return spark.createDataFrame([tuple({**base, "seq": i, **r}.get(n) for n in NAMES) for i, r in enumerate(rows)], PAGE)


def link(url, text="x", internal=False, rel=()):
    return (url, url, text, list(rel), internal)


def one(df):
    return {k: v for k, v in df.collect()[0].asDict(recursive=True).items() if k != "project_id"}


@pytest.mark.parametrize(
    ("rows", "framework", "cms", "libraries", "analytics"),
    [
        ([{"script_srcs": ["/_next/static/chunks/main.js"]}], "Next.js", None, [], []), ([{"script_srcs": ["/wp-content/themes/x/app.js"]}], None, "WordPress", [], []), ([{"script_srcs": ["https://code.test/jquery-3.js"]}], None, None, ["jQuery"], []), ([{"script_srcs": ["/js/app.js"]}], None, None, [], []),
        ([{"links": [link("https://b.test/_next/react")]}], None, None, [], []), ([{"platform": "wix"}, {"platform": "wordpress"}, {"platform": "ghost"}], None, "WordPress", [], []), ([{"platform": "drupal"}, {"platform": "ghost"}], None, "Drupal", [], []), ([{"platform": "wordpress"}, {"platform": "shopify"}], None, "Shopify", [], []),
        ([{"tags": "shopify"}] * 3, None, None, [], []), ([{"tags": "shopify"}] * 4, None, "Shopify", [], []), ([{"stylesheet_hrefs": ["/Tailwind.css"]}, {"script_srcs": ["/jQuery.js", "https://x/gtag/js?id=GTM-1"]}], None, None, ["Tailwind CSS", "jQuery"], ["Google Analytics", "Google Tag Manager"]),
        ([{}] * 10 + [{"script_srcs": ["/react.js"]}], None, None, [], []), ([{"script_srcs": ["/React.js"]}, {"script_srcs": ["/vue.js"]}], "React", None, [], []),
    ],
)
def test_tech(spark, rows, framework, cms, libraries, analytics):
    assert one(audit.tech_stack(pages(spark, *rows))) == {"framework": framework, "cms": cms, "libraries": libraries, "analytics": analytics}


def test_design(spark):
    got = one(audit.design(pages(spark, {"stylesheet_hrefs": ["https://fonts.googleapis.com/css2?family=Inter:wght@400&family=Roboto+Mono&display=swap", "https://use.typekit.net/x.css", "/fonts.googleapis.com?family=No"]}, {"links": [link("https://www.instagram.com/x"), link("https://m.x.com/y"), link("https://twitter.com/y"), link("https://notx.com/"), link("https://facebook.com/", internal=True)]})))
    assert got == {"score": 100, "fonts": ["Inter", "Roboto Mono", "Adobe Fonts"], "social": ["instagram", "X (Twitter)"]}
    assert one(audit.design(pages(spark, {"title": "Follow us on instagram"}))) == {"score": 90, "fonts": [], "social": []}


def test_speed_and_standards(spark):
    slow = pages(spark, *[{"url": f"https://a.test/{i}", "load_time_ms": t, "first_byte_time_ms": 2000, "size_bytes": 2_000_000, "shifting_images": 3, "script_gap": 60} for i, t in enumerate((9000, 0, 7000, 7000, None, 100, 6000, 8000))])
    got = one(audit.performance(slow))
    assert got["score"] == 100 - 30 - 15 - 10 - 10 - 5 - 10 and got["shifting_images"] == 24 and abs(got["avg_load_ms"] - 37_100 / 6) < 1e-9
    assert [(s["url"][-1], s["load_ms"]) for s in got["slowest"]] == [("0", 9000), ("7", 8000), ("2", 7000), ("3", 7000), ("6", 6000)]
    assert one(audit.performance(pages(spark, {"hint_count": 1}))) == {"score": 100, "avg_load_ms": 0.0, "avg_first_byte_ms": 0.0, "avg_bytes": 0.0, "shifting_images": 0, "slowest": []}
    sites = spark.createDataFrame([(1, "http://a.test/", True, None)], "project_id int, url string, has_robots boolean, has_sitemap boolean")
    got = one(audit.standards(pages(spark, {"url": "https://a.test/x", "missing_labels": 2}, {"landmark_count": 1, "skip_link": False, "viewport": True}), sites))
    assert got["score"] == 100 - 30 - 5 - 10 - 10 - 5 - 5 - 3 and (got["robots"], got["sitemap"], got["landmarks"]) == (True, False, 1)
    assert one(audit.standards(pages(spark, {"url": "https://a.test/x", "favicon": "/f", "lang": "en", "viewport": True}), sites.withColumn("has_sitemap", F.lit(True))))["score"] == 70
    assert one(audit.modernization(pages(spark, {"script_srcs": ["/jquery.js"]})))["score"] == 65 and one(audit.modernization(pages(spark, {"script_srcs": ["/JQUERY.js", "/nuxt.js"]})))["score"] == 100


def test_completeness(spark):
    paths = [{"url": f"https://a.test/{p}", "seq": i} for i, p in enumerate(("", "Company/info", "shop/x", "pages/contact"))]
    got = one(audit.completeness(pages(spark, *paths, {"seq": 9, "h2s": ["Our Legal Notice"], "links": [link("https://a.test/dp", "Data protection", True)], "url": "https://a.test/z"})))
    assert got["site_type"] == "ecommerce" and got["missing"] == ["cart", "shipping", "returns"] and got["score"] == 100 - 24
    assert got["found"] == ["about (found as /Company/info)", "contact (found as /pages/contact)", "products (found as /shop/x)", 'privacy (nav link "Data protection" → /dp)', "terms (heading match on /z)"]
    got = one(audit.completeness(pages(spark, {"schema_types": ["ContactPage"]}, {"url": "https://a.test/launch"}), {"about": "/launch"}))
    assert got["found"] == ["about (found as /launch)", "contact (schema match on /)"] and got["missing"] == ["privacy", "terms", "services", "team"] and got["score"] == 68
    for urls, kind in ((["/pricing"], "saas"), (["/blog/1", "/articles/2", "/posts/3"], "blog"), (["/work"], "portfolio"), (["/work", "/how-we-work"], "business"), (["/x"], "business")):
        assert one(audit.site_types(pages(spark, *[{"url": f"https://a.test{u}"} for u in urls])))["site_type"] == kind


@pytest.mark.parametrize(("row", "want"), [({"word_count": 0, "title": None}, False), ({"title": "  "}, False), ({"http_status": 403, "title": "t", "word_count": 900}, False), ({"title": "t"}, True), ({"word_count": 400}, True)])
def test_sufficient_and_overall(spark, row, want):
    p = pages(spark, row)
    assert one(audit.sufficient(p)) == {"sufficient": want}
    scores = {n: spark.createDataFrame([(1, s)], "project_id int, score int") for n, s in zip(audit.WEIGHTS, (85, 95, 20, 90, 52), strict=True)}
    got = one(audit.overall(scores, audit.sufficient(p)))
    assert got["overall"] == (67 if want else 0) and got["design"] == (90 if want else 0)  # 12.75 + 23.75 + 4 + 13.5 + 13 = 67
    assert one(audit.overall(scores, audit.sufficient(p), spark.createDataFrame([(1, True)], "project_id int, blocked boolean")))["overall"] == 0


def test_sitemaps(spark):
    loc = lambda *us: "".join(f"<loc>{u}</loc>" for u in us)
    index, urls = (lambda *us: "<sitemapindex>" + loc(*us) + "</sitemapindex>"), (lambda *us: "<urlset>" + loc(*us) + "</urlset>")
    r = "https://{}.test/sitemap.xml".format
    files = [
        (r("a"), 200, index("https://a.test/1.xml", "https://a.test/2.xml", r("a"), "https://a.test/gone.xml")), ("https://a.test/1.xml", 200, urls("https://a.test/p", "https://a.test/q") + "<lastmod>"), ("https://a.test/2.xml", 200, index("https://a.test/1.xml", "https://a.test/3.xml")), ("https://a.test/3.xml", 200, urls("https://a.test/q")),
        (r("b"), 200, index("https://b.test/1")), ("https://b.test/1", 200, index("https://b.test/2")), ("https://b.test/2", 200, index("https://b.test/3")), ("https://b.test/3", 200, index("https://b.test/4")), ("https://b.test/4", 200, urls("https://b.test/x")), (r("c"), 200, urls()), (r("d"), 500, None), (r("e"), 200, index(*[f"https://e.test/{i}" for i in range(4)])),
    ] + [(f"https://e.test/{i}", 200, urls(f"https://e.test/p{i}")) for i in range(4)]
    roots = spark.createDataFrame([(s, r(s)) for s in "abcdef"], "site string, url string")
    df = spark.createDataFrame(files, "url string, status int, content string")
    tree = sitefiles.sitemap_tree(roots, df, most=3)
    assert [(x.url, x.level) for x in tree.filter("site = 'a'").orderBy("number").collect()] == [(r("a"), 0), ("https://a.test/1.xml", 1), ("https://a.test/2.xml", 1), ("https://a.test/3.xml", 2)]
    got = {x.site: (x.found, x.valid, x.url_count, x.has_lastmod, x.sub_sitemaps, x.errors) for x in sitefiles.sitemap_validation(sitefiles.sitemap_tree(roots, df, most=4), roots, most=3).collect()}
    undated = "Sitemap is missing <lastmod> dates"
    assert got == {
        "a": (True, True, 2, True, 3, []), "b": (True, False, 0, False, 3, ["Sitemap nesting exceeds 3 levels; https://b.test/3 not fully traversed", "Sitemap contains no URLs", undated]), "c": (True, False, 0, False, 0, ["Sitemap contains no URLs", undated]),
        "d": (False, False, 0, False, 0, ["Sitemap returned HTTP 500"]), "e": (True, False, 3, False, 3, ["Sitemap index lists more than 3 sub-sitemaps; only the first 3 were scanned", undated]), "f": (False, False, 0, False, 0, ["Sitemap returned no answer"]),
    }
    homes = spark.createDataFrame([("a", 7), ("d", 9), ("d", 8)], "site string, page_id int")
    text = spark.createDataFrame([("a", True), ("d", False)], "site string, exists boolean")
    verdicts = spark.createDataFrame([("a", "CCBot", "blocked"), ("a", "GPTBot", "blocked"), ("a", "YouBot", "allowed")], "site string, agent string, verdict string")
    away = spark.createDataFrame([("a", f"/{i}") for i in range(6)] + [("d", "/")], "site string, url string")
    maps = sitefiles.sitemap_validation(tree, roots, most=3)
    got = {(x.site, x.page_id, x.issue_type, x.severity): x.description for x in sitefiles.site_issues(homes, text, text, verdicts, maps, away).collect()}
    assert set(got) == {("a", 7, "ai_bots_blocked", "low"), ("a", 7, "pages_not_in_sitemap", "low"), ("d", 8, "missing_llms_txt", "low"), ("d", 8, "missing_robots_txt", "medium"), ("d", 8, "missing_sitemap", "medium")}
    assert got["a", 7, "ai_bots_blocked", "low"] == "2 AI bot(s) blocked in robots.txt: GPTBot, CCBot" and got["a", 7, "pages_not_in_sitemap", "low"] == "6 crawled pages are not in the sitemap"


def test_robots_in_order(spark):
    files = [("a", "User-agent: *\nUser-agent: GPTBot\nAllow: /\nUser-agent: *\nDisallow: /"), ("b", "User-agent: CCBot\nDisallow: / # all\nUser-agent:\nDisallow: /\n#User-agent: x\nSitemap: /s.xml"), ("c", "User-agent: gptbot\nDisallow: /\nAllow: /\nUser-agent: *\nDisallow: /a\r\nDisallow: /b")]
    df = spark.createDataFrame(files, "site string, content string")
    got = {(r.site, r.agent): r.verdict for r in sitefiles.agent_verdicts(df).collect()}
    assert got["a", "GPTBot"] == "blocked" and len([1 for s, _ in got if s == "a"]) == 15 and {k: v for k, v in got.items() if k[0] != "a"} == {("b", "CCBot"): "allowed", ("c", "GPTBot"): "allowed"}
    assert {(r.site, r.agent, tuple(r.paths)) for r in sitefiles.blocked_paths(df).collect()} == {("a", "*", ("/",)), ("b", "CCBot", ("/ # all",)), ("c", "gptbot", ("/",)), ("c", "*", ("/a", "/b"))}
    llms = spark.createDataFrame([("a", 200, "text/plain", "x" * 6000), ("b", 200, "text/html", " \n"), ("c", 200, "application/json", "x"), ("d", 404, "text/plain", "x"), ("e", None, None, None), ("f", 200, "TEXT/plain", "y" * 100_001)], "site string, status int, content_type string, content string")
    assert {r.site: (r.exists, len(r.content or "")) for r in sitefiles.llms_file(llms).collect()} == {"a": (True, 5000), "b": (False, 0), "c": (False, 0), "d": (False, 0), "e": (False, 0), "f": (False, 0)}


def test_link_rows(spark):
    links = [link("https://a.test/X", "first", True), link("https://a.test/X", "second", True), link("https://a.test/gone", "g", True, ["nofollow"]), link("https://b.test/", "b"), link("https://b.test/", "b2"), link("https://c.test/", "c"), link("https://a.test/old", "o", True), link("ftp://x", "f", True)]
    results = spark.createDataFrame([(1, 5, "https://a.test/", 200, links), (1, 6, "https://a.test/x/", 404, [])], f"project_id int, page_id int, url string, http_status int, links {LINK}")
    known = spark.createDataFrame([(1, 5, "https://a.test/"), (1, 6, "https://a.test/x/"), (1, 7, "https://a.test/old")], "project_id int, page_id int, url string")
    status = spark.createDataFrame([("https://b.test/", 0, False), ("https://c.test/", 500, True)], "url string, status int, private boolean")
    got = {r.destination_url: (r.destination_page_id, r.anchor_text, r.link_type, r.is_followed, r.http_status, r.is_broken) for r in linkgraph.link_rows(results, known, status).collect()}
    assert got == {
        "https://a.test/X": (6, "first", "internal", True, 200, False), "https://a.test/gone": (None, "g", "internal", False, None, False), "https://b.test/": (None, "b", "external", True, 0, True), "https://c.test/": (None, "c", "external", True, None, False), "https://a.test/old": (7, "o", "internal", True, 200, False),
    }
    assert {r.destination_url: r.is_broken for r in linkgraph.link_rows(results, known).collect()}["https://b.test/"] is False and linkgraph.link_rows(results.limit(0), known).count() == 0
    assert [r.links for r in linkgraph.link_totals(results).collect()] == [8]
    odd = spark.createDataFrame([(1, "mailto:a"), (2, "https://tel:1"), (3, None), (4, "HTTP://a"), (5, " http://A"), (6, "http://a ")], "seq int, url string")
    assert {r.seq for r in linkgraph.bogus_pages(odd).collect()} == {1, 2, 3, 5} and {r.seq for r in linkgraph.first_results(odd).collect()} == {2, 4}
    rows = spark.createDataFrame([(1, 5, "/x", 404, "internal", True), (1, 5, "/x", 404, "internal", True), (1, 5, "/y", 200, "internal", False), (1, 5, "/z", 404, "external", True)], "project_id int, source_page_id int, destination_url string, http_status int, link_type string, is_broken boolean")
    assert [(r.page_id, r.fingerprint) for r in linkgraph.broken_internal(rows).collect()] == [(5, "5:broken_internal_link:/x")]


def test_backlinks(spark):
    body = '<a href="//www.a.test/x/" rel=\'NoFollow\'><i></i> </a><A class=y href = "https://a.test"> Home <b>page</b></A><a href="/own">o</a><a href="https://sub.a.test/">s</a>'
    external = spark.createDataFrame([(1, "https://www.ext.test/p", 200, "text/html", body), (1, "https://a.test/in", 200, "text/html", body), (1, "https://ext2.test/", 404, "text/html", body), (1, "https://ext3.test/", 200, "image/png", body), (1, "bad", 200, "text/html", body)], "project_id int, url string, status int, content_type string, html string")
    projects = spark.createDataFrame([(1, "https://www.a.test/")], "project_id int, url string")
    own = spark.createDataFrame([(1, 3, "https://a.test/"), (1, 4, "https://www.a.test/x")], "project_id int, page_id int, url string")
    found = backlinks.find(external, projects, own)
    assert {(r.source_url, r.source_domain, r.target, r.page_id, r.anchor_text, r.is_followed) for r in found.collect()} == {("https://www.ext.test/p", "ext.test", "https://www.a.test/x/", 4, None, False), ("https://www.ext.test/p", "ext.test", "https://a.test/", 3, "Home page", True)}
    t = [dt.datetime(2025, 1, d) for d in (1, 2, 3)]
    kept = spark.createDataFrame([(1, "https://www.ext.test/p", 9, "old", True, t[0], t[1]), (1, "https://lost.test/", 9, "l", True, t[0], t[1])], "project_id int, source_url string, page_id int, anchor_text string, is_followed boolean, created_at timestamp_ntz, last_seen_at timestamp_ntz")
    after = lambda c: {r.source_url: (r.page_id, r.anchor_text, r.created_at, r.last_seen_at) for r in backlinks.reconcile(kept, found, F.lit(t[2]).cast("timestamp_ntz"), c).collect()}
    assert after(True) == {"https://www.ext.test/p": (3, "Home page", t[0], t[2])} and after(False) == after(True) | {"https://lost.test/": (9, "l", t[0], t[1])}


def test_crawl_details(spark):
    site = lambda *us: spark.createDataFrame([(1, u) for u in us], "project_id int, url string")
    got = {r.url: r.depth for r in crawl.seeds(site("http://a.test"), site("a.test/x/", None), site("https://a.test/x", "https://a.test/1/2/3/4/5/6", "https://a.test/q/r", "https://a.test/a.pdf")).collect()}
    assert got == {"https://a.test/": 0, "https://a.test/x": 1, "https://a.test/q/r": 2}
    rows = [(1, 5, 1, 0, "/plain", "https://a.test/"), (1, 5, 1, 1, "/product/1", "https://a.test/"), (1, 4, 1, 7, "/plain", "https://a.test/"), (1, 5, 1, 2, "#", "https://a.test/"), (1, 5, 1, 3, "/seen", "https://a.test/"), (1, 5, 1, 4, "/login", "https://a.test/")]
    queue = crawl.enqueued(spark.createDataFrame(rows, "project_id int, parent_seq int, depth int, at int, href string, page_url string"), site("https://a.test/seen"))
    assert {(r.url, r.parent_seq, r.priority, r.at) for r in queue.collect()} == {("https://a.test/plain", 4, 11, 7), ("https://a.test/product/1", 5, 14, 1)} and [r.url for r in crawl.next_batch(queue, 1).collect()] == ["https://a.test/plain"]
    tries = [(1, "a", 1, 503, False), (1, "a", 2, 200, False), (1, "b", 3, 503, None), (1, "c", 3, 0, None), (1, "d", 1, 429, None), (1, "e", 1, 200, True), (1, "f", 1, 404, None)]
    assert {r.url: r.state for r in crawl.kept_results(spark.createDataFrame(tries, "project_id int, url string, attempt int, status int, blocked boolean")).collect()} == {"a": "kept", "b": "kept", "c": "dropped", "d": "retry", "e": "dropped", "f": "kept"}
    scans = spark.createDataFrame([(1, 0, 1, 100, 10, None), (2, 50, 0, 100, 299, None), (3, 50, 10, 400, 900, None), (4, 40, 0, 40, 700, 600)], "scan_id int, scanned int, queued int, max_pages int, seconds int, timeout int")
    assert {r.scan_id: (r.estimated, r.percent) for r in crawl.progress(scans).collect()} == {1: (1.0, 0), 2: (75.0, 67), 3: (75.0, 67), 4: (60.0, 67)}
    assert {r.scan_id: (r.timeout, r.completed) for r in crawl.completed(scans).collect()} == {1: (300, False), 2: (300, True), 3: (800, False), 4: (600, False)}
    seen = spark.createDataFrame([(1, True, True, "Blocked (blocked IP 203.0.113.9)"), (1, False, False, None), (1, False, False, None), (2, True, False, None), (2, False, True, "x"), (3, True, False, None), (3, False, False, None), (3, False, True, "x"), (4, True, False, None)], "project_id int, homepage boolean, blocked boolean, error string")
    assert {tuple(r) for r in crawl.block_verdicts(seen, "192.0.2.1").collect()} == {(1, 1, 3, "203.0.113.9"), (2, 1, 2, "192.0.2.1")}
    hops = spark.createDataFrame([(f"/{i}", f"/{i + 1}") for i in range(14)], "from_url string, to_url string")
    assert {r.start: (r.final, r.cut) for r in crawl.redirect_chains(hops, flagged=True).collect() if r.start in ("/0", "/4", "/9")} == {"/0": ("/10", True), "/4": ("/14", False), "/9": ("/14", False)}


def test_markup(spark):
    get = lambda c: spark.range(1).select(c.alias("x")).first()[0]
    headers = lambda **h: F.create_map(*[F.lit(x) for kv in h.items() for x in (kv[0].replace("_", "-"), kv[1])])
    for h, want in (({"x_shopid": "1", "server": "wix"}, "shopify"), ({"x_powered_by": "Next.js"}, "nextjs"), ({"powered_by": "WP Engine"}, "wordpress"), ({"via": "varnish"}, None), ({"link": "<https://CDN.shopify.com>"}, None), ({"server": "Magento"}, "magento"), ({"x_nuxt_cache": ""}, None)):
        assert get(H.platform_of_headers(headers(**h))) == want
    for t, want in (('<DIV ID="root"></DIV><script src=bundle.js>', "react-spa"), ("mage/ requirejs-config", "magento"), ("mage/", None), ("<body><script>x</script> <p>short</p>", "spa-generic"), ("<body>" + "long enough text " * 3, None), (None, None), ("x" * 50_000 + "wp-content/", None)):
        assert get(H.platform_of_html(F.lit(t).cast("string"))) == want
    blocks = ['{"@type": "A", "@graph": [{"@type": ["B", 7, "A"]}, {"@id": "x"}]}', '[{"@type": "C"}, {"@type": "D"}]', "{bad", "7"]
    assert get(H.ld_types(F.array(*[F.lit(b) for b in blocks]))) == ["A", "B", "C"]
    assert get(H.script_share(F.lit(10), F.lit(20))) == 50 and get(H.script_share(F.lit(80), F.lit(100))) is None and get(H.script_share(F.lit(None), F.lit(0))) is None
    assert get(H.schema_source(F.array(F.lit("a")), F.array(F.lit("b")))) == "both" and get(H.schema_source(F.lit(None).cast("array<string>"), F.array(F.lit("b")))) == "client" and get(H.challenge_ip(F.lit("x ipc:192.0.2.44;"))) == "192.0.2.44"
    tags = '<link rel="alternate" hreflang="de" href="/de"><link href="/fr" rel="alternate" hreflang="fr"><link hreflang="x" rel="alternate" href="/x"><link rel="alternate" href="/no" hreflang="no">'
    assert [tuple(x) for x in get(H.hreflang_ordered(F.lit(tags)))] == [("de", "/de"), ("x", "/x"), ("fr", "/fr")]
    assert get(H.hints_ordered(F.lit('<link href="/b" rel="preload"><link rel="preload" href="/a">'), "preload")) == ["/a", "/b"]
    assert get(U.normalize_basic(F.lit("A.test/x/#f"))) == "https://a.test/x" and get(U.normalize_basic(F.lit("http://a.test/x//?q"))) == "http://a.test/x/?q" and get(U.normalize_basic(F.lit(""))) is None
    assert [get(U.is_public(F.lit(u), F.array(*map(F.lit, ips)).cast("array<string>"))) for u, ips in (("http://192.168.1.1/", ["8.8.8.8"]), ("http://8.8.8.8/", []), ("http://[::1]/", []), ("https://a.test/", ["8.8.8.8", "10.0.0.1"]), ("https://a.test/", []), ("bad", ["8.8.8.8"]))] == [False, True, False, False, False, False]
    assert [get(U.as_path(F.lit(v), F.lit("www.a.test"))) for v in (" x ", "/x", "a b", "https://b.a.test/x", "https://b.test/", "", "y" * 301)] == ["/x", "/x", None, "https://b.a.test/x", None, None, None] and get(U.as_path(F.lit("https://a.test/"))) is None
    assert get(U.guessed_format(F.lit("/A.JPG?x.png"))) == "jpeg" and get(U.guessed_format(F.lit("a.tiff"))) == "unknown"
