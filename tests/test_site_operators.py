from pyspark.sql import functions as F

from crawlspan.operators import crawl, linkgraph, merge, pagefacts, scores, sitefiles


def test_rules_hold_and_fail(spark):
    """Each rule fires on one of two pages and not on the other; null facts fire nothing but what null means."""
    bad = {"http_status": 404, "page_title": "T" * 70, "description": " ", "h1_count": 0, "word_count": 3, "noindex": False, "utility": False, "og_count": 0, "viewport": False, "load_time_ms": 9000}
    names = ["page_id", "project_id", "http_status", "word_count", "size_bytes", "load_time_ms", "page_title", "description", "h1_count", "utility", "canonical", "noindex", "og_count", "twitter_count", "schema_count", "heading_gaps", "viewport", "mixed_content", "url_issue_count", "shifting_images", "lang", "landmark_count", "skip_link", "hint_count", "homepage", "canonical_self", "image_count", "images_without_alt", "lazy_images", "old_images", "hreflang_count", "hreflang_default", "generic_anchors", "internal_links", "external_links"]
    kind = lambda n: "boolean" if n in ("utility", "noindex", "viewport", "mixed_content", "skip_link", "homepage", "canonical_self") else "string" if n in ("page_title", "description", "canonical", "lang") else "int"
    df = spark.createDataFrame([tuple({"page_id": 1, **bad}.get(n) for n in names), tuple({"page_id": 2}.get(n) for n in names)], ", ".join(f"{n} {kind(n)}" for n in names))
    got = {(r.page_id, r.issue_type) for r in pagefacts.issues(df).collect()}
    assert {t for p, t in got if p == 1} == {"not_found", "title_too_long", "missing_meta_description", "missing_h1", "thin_content", "missing_canonical", "missing_open_graph", "missing_viewport_meta", "slow_page"}
    assert {t for p, t in got if p == 2} == {"missing_title", "missing_meta_description", "missing_canonical"}


def test_frontier_and_redirects(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (9, 1), (None, 5), (1, None), (1, 2)], "src long, dst long")
    seeds = spark.createDataFrame([(1,), (1,), (None,)], "key long")
    assert {tuple(r) for r in crawl.frontier(seeds, edges).collect()} == {(1, 0), (2, 1), (3, 2), (4, 3)}
    assert [tuple(r) for r in crawl.frontier(seeds, edges, max_pages=2).collect()] == [(1, 0), (2, 1)]
    assert crawl.frontier(seeds.limit(0), edges).count() == 0
    hops = spark.createDataFrame([(f"/{i}", f"/{i + 1}") for i in range(14)] + [("/14", "/14")], "from_url string, to_url string")
    got = {r.start: (r.final, r.hops, r.loops) for r in crawl.redirect_chains(hops).collect()}
    assert got["/12"] == ("/14", 3, True) and got["/0"] == ("/10", 10, False) and got["/14"] == ("/14", 1, True)


def test_reconcile_twice(spark):
    schema = "project_id int, page_id int, fingerprint string, is_fixed boolean, seen_count int, created_at string, fixed_at string"
    kept = spark.createDataFrame([(1, 1, "a", False, 2, "t0", None), (1, 2, "b", False, None, "t0", None), (1, 3, "c", False, 1, "t0", None), (1, 1, "d", True, 1, "t0", "t0"), (1, 1, None, False, 1, "t0", None)], schema)
    now = spark.createDataFrame([(1, 1, "a"), (1, 1, "a"), (1, 1, "d"), (1, 5, "n"), (1, 1, None)], "project_id int, page_id int, fingerprint string")
    crawled = spark.createDataFrame([(1,), (2,), (5,), (1,)], "page_id int")
    first = merge.reconcile(kept, now, crawled, F.lit("t1"))
    got = {r.fingerprint: (r.state, r.is_fixed, r.seen_count, r.created_at, r.fixed_at) for r in first.collect()}
    assert got == {"a": ("persisting", False, 3, "t0", None), "b": ("resolved", True, None, "t0", "t1"), "c": ("untouched", False, 1, "t0", None), "d": ("persisting", False, 2, "t0", None), "n": ("new", False, 1, "t1", None)}
    again = {r.fingerprint: r.seen_count for r in merge.reconcile(first.drop("state"), now, crawled, F.lit("t2")).collect()}
    assert again == {"a": 4, "b": None, "c": 1, "d": 3, "n": 2}


def test_upsert(spark):
    kept, new = spark.createDataFrame([(1, "a", 10), (2, "b", 20), (None, "n", 30)], "k int, v string, c int"), spark.createDataFrame([(2, "B", 99), (3, "C", 99), (None, "N", 99)], "k int, v string, c int")
    assert {tuple(r) for r in merge.upsert(kept, new, ["k"], preserve=("c",)).collect()} == {(1, "a", 10), (2, "B", 20), (None, "N", 30), (3, "C", 99)}


def test_next_month(spark):
    days = spark.sql("SELECT explode(array(date'2025-01-31', date'2024-01-30', date'2025-12-15')) AS d")
    assert [str(r[0]) for r in days.select(merge.next_month(F.col("d"))).collect()] == ["2025-03-03", "2024-03-01", "2026-01-15"]


def test_site_files(spark):
    files = spark.createDataFrame([("a", "User-agent: *\nDisallow: /\nUser-agent: GPTBot\nAllow: /"), ("b", "User-agent: GPTBot\nAllow: /\nUser-agent: *\nDisallow: /"), ("c", None), ("d", "")], "site string, content string")
    got = {}
    for r in sitefiles.blocked_agents(files).collect():
        got.setdefault(r.site, set()).add(r.agent)
    assert len(got["a"]) == 15 and got["b"] == set(sitefiles.AGENTS) - {"GPTBot"} and set(got) == {"a", "b"}
    text = spark.createDataFrame([("a", "Title: x\n: none\nTitle: y: z\nplain")], "site string, content string")
    assert [tuple(r) for r in sitefiles.llms_fields(text).collect()] == [("a", "title", "y: z")]
    maps = spark.createDataFrame([("a", "<loc> https://a.test/x/ </loc><loc>ftp://no</loc><loc>https://a.test/y?q</loc>")], "site string, content string")
    pages = spark.createDataFrame([("a", "https://A.test/x", 200), ("a", "https://a.test/z", 200), ("a", "https://a.test/y", 404)], "site string, url string, status int")
    assert {tuple(r) for r in sitefiles.sitemap_difference(sitefiles.sitemap_entries(maps), pages).collect()} == {("a", "https://a.test/y?q", "only_in_sitemap"), ("a", "https://a.test/z", "not_in_sitemap")}


def test_links(spark):
    links = spark.createDataFrame([(1, 1, 1, "https://a.test/X/", 2, "internal"), (1, 1, 1, "https://a.test/X/", 2, "internal"), (2, 1, 1, "https://a.test/x", None, "internal"), (3, 1, 2, "https://b.test/", None, "external"), (4, 1, None, None, None, "external")], "link_id long, project_id int, source_page_id long, destination_url string, destination_page_id long, link_type string")
    pages = spark.createDataFrame([(1, 1, "https://a.test/", 0, 200), (2, 1, "https://a.test/x", 1, 404), (3, 1, "https://a.test/q", 1, 200), (4, 1, None, 0, None)], "page_id long, project_id int, url string, depth int, http_status int")
    assert {tuple(r) for r in linkgraph.resolved(links, pages).collect()} == {(1, 1, 2, True), (2, 1, 2, True)}
    assert [tuple(r) for r in linkgraph.unlinked(links, pages).collect()] == [(1, 3)]
    assert {r.page_id: (r.inlinks, r.outlinks) for r in linkgraph.degrees(links, pages).collect()} == {1: (0, 2), 2: (1, 1), 3: (0, 0), 4: (0, 0)}
    status = spark.createDataFrame([("https://b.test/", 0)], "url string, status int")
    assert {(r.link_id, r.status, r.broken) for r in linkgraph.health(links, status).collect()} == {(3, 0, True), (4, None, None)}
    assert {r.link_id for r in linkgraph.without_pages(pages.filter("page_id = 2"), links).collect()} == {2, 4}


def test_whole_report(spark):
    """The numbers of the reference's own tests: an empty page has 67, 0, 100, 0 and 42, a full one 100."""
    schema = "page_id int, project_id int, url string, http_status int, is_indexable boolean, load_time_ms int, title string, meta_description string, word_count int, h1s array<string>, schema_types array<string>, structured_data array<string>, og_count int, image_count int, images_without_alt int"
    full = lambda i, p, title="t", images=(1, 0): (i, p, f"/{i}", 200, True, 500, title, "d", 800, ["h"], ["A"], ["{}"], 1, *images)
    empty = lambda i, p: (i, p, f"/{i}", 200, True, 0, None, "\t\u00a0", 0, [], [], None, 0, 0, 0)
    pages = spark.createDataFrame([full(1, 1), empty(2, 2)[:4] + (False,) + empty(2, 2)[5:], full(3, 3), full(4, 3, None, (4, 1)), full(5, 4)], schema)
    crawls = spark.createDataFrame([(1, False), (2, None), (3, False), (4, True), (5, False)], "project_id int, blocked boolean")
    got = {r.project_id: (r.pages, r.technical, r.content, r.media, r.aeo, r.overall, r.blocked) for r in scores.report_scores(pages, crawls).collect()}
    assert got == {1: (1, 100, 100, 100, 100, 100, False), 2: (1, 33 + 34, 0, 100, 0, 42, False), 3: (2, 100, 88, 80, 93, 90, False), 4: (0, 0, 0, 0, 0, 0, True), 5: (0, 0, 0, 0, 0, 0, False)}
    checks = {(r.project_id, r.category, r.check): (r.status, r.passed, r.total, r.affected_urls) for r in scores.report_checks(pages, crawls).collect()}
    assert len(checks) == 3 * 15 and checks[2, "media", "img_alt"] == ("na", 0, 0, []) and checks[3, "content", "title"] == ("fail", 1, 2, ["/4"]) and checks[3, "media", "img_alt"] == ("fail", 4, 5, ["/4"]) and checks[1, "aeo", "aeo_open_graph"] == ("pass", 1, 1, [])
    assert {r.page_id: (r.score, len(r.checks)) for r in scores.report_pages(pages, crawls).collect()} == {1: (100, 11), 2: (20, 10), 3: (100, 11), 4: (82, 11)}


def test_reconcile_last_scans(spark):
    scans = spark.createDataFrame([(9, 1, "t1", "t1e"), (4, 1, "t2", "t2e"), (7, 1, "t3", None), (7, 1, "t3", "t3e"), (8, 2, "t1", None)], "scan_id int, project_id int, started_at string, completed_at string")
    schema = "issue_id int, project_id int, scan_id int, page_id int, fingerprint string, is_fixed boolean, seen_count int, created_at string, fixed_at string, updated_at string"
    row = lambda i, scan, page, f, seen=1, at="u1", fixed=False: (i, 1, scan, page, f, fixed, seen, "t0", None, at)
    issues = spark.createDataFrame(
        [row(1, 9, 1, "old"), row(2, 4, 1, "a", 2), row(3, 4, 1, "a", 5, "u2"), row(3, 4, 1, "a", 5, "u2"), row(6, 4, 1, "gone"), row(9, 4, 3, "away"), row(12, 4, 1, None), row(15, 7, 1, "a", 6), row(18, 7, 5, "n"), row(21, 6, 5, "stray"), (24, 2, 8, 6, "first", False, 1, "t0", None, "u1")], schema,
    )
    pages = spark.createDataFrame([(7, 1), (7, 5), (9, 3), (8, 6)], "scan_id int, page_id int")
    got = {(r.project_id, r.fingerprint): (r.scan_id, r.state, r.is_fixed, r.seen_count, r.created_at, r.fixed_at) for r in merge.reconcile_last(issues, scans, pages).collect()}
    assert got == {
        (1, "a"): (7, "persisting", False, 6, "t0", None), (1, "gone"): (7, "resolved", True, 1, "t0", "t3e"), (1, "away"): (7, "untouched", False, 1, "t0", None), (1, "n"): (7, "new", False, 1, "t3e", None), (2, "first"): (8, "new", False, 1, "t1", None),
    }


def test_latest_pages(spark):
    scans = spark.createDataFrame([(9, "t1"), (4, "t2")], "scan_id int, started_at string")
    history = spark.createDataFrame([(9, 1, 1, "late", "r9"), (4, 1, 1, "x", "r2"), (4, 1, 1, "y", "r3"), (4, 1, 1, "y", "r3"), (9, 1, 3, None, None), (5, 1, 6, "z", "r1")], "scan_id int, project_id int, page_id int, url string, recorded_at string")
    assert {tuple(r) for r in merge.latest_pages(history, scans).collect()} == {(4, 1, 1, "y", "r3"), (9, 1, 3, None, None), (5, 1, 6, "z", "r1")}


def test_issues_of_all_rules_are_counted(spark, tmp_path):
    """The registered counts over pages on disk, against the facts taken row by row in Python."""
    from crawlspan.plans import site
    from crawlspan.sources.rendered import rendered

    schema = (
        "page_id long, project_id long, scan_id long, url string, title string, meta_description string, h1s array<string>, http_status int, depth int, word_count int, is_indexable boolean, canonical_url string, content_type string, size_bytes long, load_time_ms int, "
        "first_byte_time_ms int, structured_data array<string>, schema_types array<string>, content_hash string, created_at timestamp_ntz, scanned_at timestamp_ntz"
    )
    rows = [(i, 1, 1, f"https://mill-shop.test/{'Bad_Path/' if i % 2 else ''}{i if i % 5 else ''}", "t" * (i * 3), "d" * (i * 8), ["h"] * (i % 3), (200, 404, 503)[i % 3], 1, i * 40, i % 4 > 0, "https://other.test/" if i % 3 else None, "text/html", i * 300_000, i * 300, 1, [], [], None, None, None) for i in range(40)]
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/pages.parquet")
    want = {}
    for r in pagefacts.facts(rendered(spark.read.parquet(f"{tmp_path}/pages.parquet"))).selectExpr("*", *[f"coalesce({c}, false) AS `is {t}`" for t, _, c in pagefacts.RULES]).collect():
        for t, severity, _ in pagefacts.RULES:
            want[t, severity] = want.get((t, severity), 0) + r[f"is {t}"]
    got = {(r.issue_type, r.severity): r.pages for r in site.issues_by_type_all(spark, str(tmp_path)).collect()}
    assert got == {k: n for k, n in want.items() if n} and {"thin_content", "missing_image_alt", "heading_hierarchy_invalid", "url_structure_issues", "canonical_mismatch", "hreflang_issues"} <= {t for t, _ in got}


def test_frontier_reaches_the_default_depth(spark, tmp_path):
    from crawlspan.plans import site

    spark.createDataFrame([(i, 0 if i == 0 else 1) for i in range(9)], "page_id long, depth int").write.parquet(f"{tmp_path}/pages.parquet")
    spark.createDataFrame([(i, i + 1) for i in range(8)] + [(0, 2)], "source_page_id long, destination_page_id long").write.parquet(f"{tmp_path}/page_links.parquet")
    assert {tuple(r) for r in site.crawl_frontier(spark, str(tmp_path)).collect()} == {(0, 0), (1, 1), (2, 1), (3, 2), (4, 3), (5, 4), (6, 5)}


def test_merging(spark, tmp_path):
    get = lambda a, b: spark.range(1).select(merge.json_merged(F.lit(a).cast("string"), F.lit(b).cast("string"))).first()[0]
    assert get('{"b": 1, "a": {"x": [1, "y"]}}', '{"b": null, "c\\"d": "e"}') == '{"a":{"x":[1,"y"]},"b":null,"c\\"d":"e"}' and get("[1]", None) == "{}" and get(None, '{"a": 1}') == '{"a":1}'
    kept = spark.createDataFrame([(1, 10, "old"), (1, 11, "old"), (2, 20, "old"), (None, 30, "old")], "src int, l int, v string")
    new = spark.createDataFrame([(1, 12, "new"), (None, 31, "new")], "src int, l int, v string")
    assert {(r.l, r.v) for r in merge.replaced(kept, new, ["src"]).collect()} == {(12, "new"), (20, "old"), (31, "new")}
    path = f"{tmp_path}/links"
    merge.write_replacing(spark, kept, path, ["src"])
    for _ in range(2):
        merge.write_replacing(spark, new, path, ["src"])
    assert {(r.l, r.v) for r in spark.read.parquet(path).collect()} == {(12, "new"), (20, "old"), (31, "new")}
    pages = spark.createDataFrame([(1, "Just a moment", 9, 50, None), (2, "t", 9, 50, ["e"])], "page_id int, title string, word_count int, content_length int, errors array<string>")
    got = {r.page_id: (r.title, r.word_count, r.content_length, r.errors) for r in merge.blanked(pages, F.col("page_id") == 1, F.lit("192.0.2.1")).collect()}
    assert got == {1: (None, 0, 0, ["Blocked by bot protection / WAF challenge page (blocked IP 192.0.2.1)"]), 2: ("t", 9, 50, ["e"])}
    plain = spark.createDataFrame([("a", 200, None, 10, True), ("b", 200, "t", 10, False), ("c", 200, None, 10, True), ("d", 200, None, 90, True)], "url string, status int, title string, words int, poor boolean")
    seen = spark.createDataFrame([("a", 200, "A", 40), ("b", 200, "B", 40), ("c", 500, "C", 40), ("d", 301, "D", 100)], "url string, status int, title string, words int")
    assert {r.url: (r.scan_method, r.title, r.script_gap) for r in merge.better(plain, seen).collect()} == {"a": ("headless", "A", 75), "b": ("http", "t", None), "c": ("http", None, None), "d": ("headless", "D", None)}
