import json

import pytest

from crawlspan.functions import dom
from crawlspan.operators import issuerows, pagefacts

PAGE = """<html><head><title>Bad</title><meta name="description" content="short"><link rel="alternate" hreflang="english" href="https://a.test/other"><link rel="canonical" href="https://a.test/elsewhere"></head>
<body><h2>Two</h2><h4>Four</h4><img src="/a.jpg"><img src="b.png" alt=" "><img src="c.gif" alt="c"><img src="d.webp" alt="d"><a href="/x">Read more</a><img src="http://cdn.test/e.jpg" alt="e"></body></html>"""
SCHEMA = "page_id long, project_id long, scan_id long, url string, http_status int, word_count int, size_bytes long, load_time_ms int, title string, schema_types array<string>, structured_data array<string>, html string, headers map<string,string>, redirect_chain array<string>, readability int, top_keyword string, missing_labels int, tabindex_misuse int, plain_words int, rendered_words int, image_sizes map<string,bigint>"


def test_rows_with_texts(spark):
    ld = ['{"@graph": [{"@type": "Product", "name": "x"}, {"@id": "#a"}], "@context": "c"}', '{"name": "y"}', "{bad", '[{"@type": ["Thing", "FAQPage"], "mainEntity": []}]']
    bad = (1, 2, 3, "https://a.test/A_b?q=1", 503, 120, 4_500_000, 3_456, "Bad", ["Product"], ld, PAGE, {"x-frame-options": "DENY"}, ["/1", "/2", "/1"], 12, "Kettle", 2, 1, 10, 40, {"https://a.test/a.jpg": 300_000})
    good = (2, 2, 3, "https://a.test/plain", 200, 900, 1, 1, None, None, None, None, None, None, None, None, None, None, None, None, None)
    rows = issuerows.issue_rows(pagefacts.records(spark.createDataFrame([bad, good], SCHEMA))).collect()
    got = {r.issue_type: (r.severity, r.description, json.loads(r.details)) for r in rows if r.page_id == 1}
    want = {
        "server_error": "Page returned HTTP 503 server error", "missing_h1": "Page is missing an H1 heading tag", "title_too_short": "Title tag is too short (3 characters, recommended min 10)", "meta_description_too_short": "Meta description is too short (5 characters, recommended min 50)",
        "thin_content": "Page has thin content (120 words, recommended min 300)", "missing_open_graph": "Page is missing Open Graph meta tags", "missing_twitter_card": "Page is missing Twitter Card meta tags", "large_page_size": "Page size is 4.29 MB (recommended max 3 MB)",
        "slow_page": "Page load time is 3.46s (recommended max 3s)", "missing_image_alt": "2 image(s) missing alt text", "heading_hierarchy_invalid": "Heading hierarchy is invalid: Heading level skipped: H2 to H4 (missing H3)",
        "missing_viewport_meta": "Page is missing a viewport meta tag, which is critical for mobile rendering and mobile SEO", "mixed_content": "Page loads HTTP resources on an HTTPS page, causing mixed content warnings and potential security issues",
        "url_structure_issues": "URL has 3 structural issue(s): URL contains uppercase letters; URL contains underscores instead of hyphens; URL contains dynamic query parameters", "canonical_mismatch": "Canonical URL does not match the page URL (canonical points to https://a.test/elsewhere)",
        "missing_image_lazy_loading": "None of the 5 images use lazy loading", "non_modern_image_format": "4 of 5 images use legacy formats (not WebP, AVIF, or SVG)", "missing_image_dimensions": "5 images lack explicit width/height attributes — causes Cumulative Layout Shift",
        "non_descriptive_anchor_text": '1 link(s) use non-descriptive anchor text (e.g. "click here", "read more")', "oversized_images": "1 image(s) exceed 200 KB", "missing_security_headers": "Missing security headers: HSTS (Strict-Transport-Security), X-Content-Type-Options",
        "redirect_chain": "Redirect chain has 3 hops, wasting crawl budget and slowing page load", "redirect_loop": "Redirect loop detected — URL redirects back to itself", "poor_readability": "Content readability is very low (Flesch score: 12/100). Aim for 60-70 for web content.",
        "keyword_not_in_title": 'Top keyword "Kettle" does not appear in the page title', "hreflang_issues": "Missing self-referencing hreflang tag. Missing x-default hreflang tag. Invalid language codes: english", "missing_form_labels": "2 form input(s) missing associated labels",
        "tabindex_misuse": "1 element(s) have positive tabindex values — disrupts natural tab order", "js_rendering_dependency": "75% of content is only visible with JavaScript (10 → 40 words)",
        "invalid_structured_data": 'Structured data has 4 issue(s): Product: missing "offers" or "price"; Product: missing "image"; Missing @type property (+1 more)',
    }
    assert {t: d for t, (_, d, _) in got.items()} == want
    assert got["redirect_loop"][0] == "critical" and got["oversized_images"][2]["images"] == [{"src": "https://a.test/a.jpg", "size_kb": 293, "format": "jpeg"}] and got["non_modern_image_format"][2]["format_breakdown"] == {"jpeg": 2, "png": 1, "gif": 1, "webp": 1}
    assert {r.fingerprint for r in rows if r.issue_type == "slow_page"} == {"1:slow_page:"} and {r.scan_id for r in rows} == {3}
    assert not {r.issue_type for r in rows if r.page_id == 2} & {"missing_security_headers", "redirect_chain", "keyword_not_in_title", "js_rendering_dependency", "hreflang_issues", "invalid_structured_data", "oversized_images"}


@pytest.mark.parametrize(
    ("blocks", "want"),
    [
        (['{"@type": "Organization"}'], ['Organization: missing "name"', 'Organization: missing "url"']), (['{"@type": ["Organization", "LocalBusiness"], "name": "n"}'], ['LocalBusiness: missing "url"']), (['{"@graph": [], "name": "n"}'], ["Missing @type property"]),
        (['{"@graph": [{"@graph": [{"@type": "WebSite"}]}]}'], ['WebSite: missing "name"']), (['{"@type": "Product", "name": "a", "price": 0, "image": "i"}'], ['Product: missing "offers" or "price"']), (['"text"', "7", "null", "[]", "{}"], ["Missing @type property"]), (['{"@type": "BreadcrumbList", "itemListElement": {}}'], ["BreadcrumbList: missing or empty itemListElement"]),
        (['{"@type": "NewsArticle", "headline": "h", "datePublished": "d", "author": {}, "image": []}', None], []),
    ],
)
def test_nodes(blocks, want):
    assert issuerows.node_problems(blocks) == want


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ('<input id="a"><label for="a">x</label><label><input></label><input aria-label="z"><input type="submit"><textarea></textarea>', {"missing_labels": 1}), ('<p tabindex="0"><p tabindex=" 2"><p tabindex="-1"><p tabindex="x">', {"tabindex_misuse": 1}),
        ('<nav><div role="main"></div><nav></nav><section role="banner"></section></nav>', {"landmarks": ["nav", "main", "section"]}), ('<a href="#c"> Jump to <b>content</b></a>', {"skip_link": True}), ('<a href="/c">skip</a>', {"skip_link": False}), ('<div id="OneTrust-x">', {"consent": True}),
        ("<body>one <b>two</b>three<script>x y</script><style>a b</style><noscript>c</noscript> four &amp; five</body>", {"words": 6}), ('<title> </title><meta property="og:title" content="OG"><h1>H</h1>', {"title": "OG"}), ("<h1>Only <i>one</i></h1>", {"title": "Only one"}),
        ('<meta name="twitter:description" content="T"><html LANG=fr>', {"description": "T", "lang": "fr"}), ("", {"title": None, "words": 0, "landmarks": []}), ("<a <b <<< </x> &#xZZ; <!-- <p tabindex=3> -->", {"tabindex_misuse": 0}), ("<p>" * 5_000 + "deep", {"words": 1}),
    ],
)
def test_static_dom(html, want):
    got = dom.read(html)
    assert {k: got[k] for k in want} == want


def test_static_dom_frame(spark):
    df = spark.createDataFrame([(1, "<p>a b</p>", "c"), (2, None, "c")], "page_id long, html string, words string")
    assert {(r.page_id, r.words, r.title) for r in dom.static_facts(df).collect()} == {(1, 2, None), (2, 0, None)} and dom.static_facts(df.limit(0)).collect() == []
