import pytest
from pyspark.sql import functions as F

from crawlspan.functions import html as H
from crawlspan.functions import text as T
from crawlspan.functions import urls as U


def one(spark, column, **values):
    """The column's value over one row of texts."""
    names = list(values) or ["_"]
    return spark.createDataFrame([tuple(values.values()) or ("",)], ", ".join(f"{n} string" for n in names)).select(column).first()[0]


@pytest.mark.parametrize(
    ("url", "want"),
    [
        ("HTTP://WWW.Site.Test/a/?utm_source=x&b=2&ref=q#top", "https://www.site.test/a?b=2"), ("//cdn.test/x/", "https://cdn.test/x"), ("/p/", "https://base.test/p"), ("sub/../q", "https://base.test/d/q"), ("../../..", "https://base.test/"),
        ("site.test", "https://site.test/"), ("mailto:a@b.test", None), ("https://u:p@site.test/", None), ("", None), (None, None), ("?z=1", "https://base.test/d/e?z=1"), ("https://site.test?gclid=1", "https://site.test/"), ("javascript:void(0)", None), ("https://" + "a" * 3000 + ".test/", "https://" + "a" * 3000 + ".test/"),
    ],
)
def test_normalize(spark, url, want):
    assert one(spark, U.normalize(F.col("u"), F.lit("https://base.test/d/e")), u=url) == want


def test_url_predicates(spark):
    u = F.col("u")
    for f, url, want in [
        (U.is_utility, "https://a.test/login", True), (U.is_utility, "https://a.test/logins", False), (U.is_utility, "/cart?x", True), (U.is_product, "https://a.test/item/1", True), (U.is_category, "https://a.test/shop", True),
        (U.path_depth, "https://a.test/a//b/", 2), (U.path_depth, "nonsense", 0), (U.is_excluded, "https://a.test/x.PDF", True), (U.is_excluded, "https://a.test/x?sort=1", True), (U.is_excluded, "nonsense", False), (U.is_excluded, None, False),
        (U.image_format, "https://a.test/a.JPG?x", "jpeg"), (U.image_format, "https://a.test/a", ""), (U.sitemap_key, "https://A.test:8080/x/?q=1", "https://a.test/x"), (U.url_issues, "https://a.test/A_b?c", ["uppercase", "underscore", "parameters"]), (U.url_issues, "bad", []), (U.cleaned, "https://tel:123", None), (U.cleaned, "#", None),
        (U.is_private_ip, "172.20.0.1", True), (U.is_private_ip, "172.40.0.1", False), (U.is_private_ip, "fd00::1", True),
    ]:
        assert one(spark, f(u), u=url) == want, (f.__name__, url)
    assert one(spark, U.is_internal(F.lit("https://shop.a.test/"), F.lit("https://www.a.test/"))) is True
    assert one(spark, U.is_internal(F.lit("https://xa.test/"), F.lit("https://a.test/"))) is False
    assert one(spark, U.same_page(F.lit("https://a.test/x/"), F.lit("HTTPS://A.test/x"))) is True
    assert one(spark, U.same_page(F.lit(None).cast("string"), F.lit("https://a.test"))) is False
    assert one(spark, U.crawl_priority(F.lit("https://a.test/item/1?a=1&b=2&c=3&d=4"), F.lit(2))) == 11
    assert one(spark, U.is_excluded(F.lit("https://a.test/Private/x"), custom=("/private",))) is True


PAGE = """<html lang="de"><head><title> A &amp; B | Shop today </title><meta content="first" name="description"><meta property="og:type" content="x"><meta property="og:type" content="y">
<meta name="viewport" content="w"><META NAME="robots" CONTENT="NoIndex"><link rel="canonical" href="https://a.test/x"><link rel="icon" href="/f.ico"><link hreflang="x-default" rel="alternate" href="/d">
<script>if (a < b) { "<h1>no</h1>" }</script><script type="application/ld+json">{"@type":"X"}</script><script type="application/ld+json">{oops</script></head>
<body><h1>One</h1><h1> </h1><h3>Three</h3><p>Some <b>text</b></p><a href="/in" rel="a  b">In</a><a href="tel:1">t</a><a href='https://b.test/'></a><img src="x.png"><img src="y.webp" width="3" height=4 alt="Y">
<form><input type="email"><textarea></textarea></form><a href="#m">Skip this</a></body></html>"""


def test_page(spark):
    h, u = F.col("h"), F.lit("https://a.test/dir/p")
    metas, linked, imgs = H.tags_of(h, "meta"), H.tags_of(h, "link"), H.tags_of(h, "img")
    got = lambda c: one(spark, c, h=PAGE)
    assert got(H.title(h)) == "A & B"
    assert got(H.meta(metas, "description")) == "first" and got(H.meta(metas, "author")) is None
    assert got(H.prefixed_meta(metas, "og")) == {"type": "y"}
    assert got(H.has_viewport(metas)) and got(H.robots(metas, "noindex")) and not got(H.robots(metas, "nofollow"))
    assert got(H.canonical(linked)) == "https://a.test/x" and got(H.favicon(linked, u)) == "https://a.test/f.ico"
    assert [tuple(x) for x in got(H.hreflang(linked))] == [("x-default", "/d")]
    assert [tuple(x) for x in got(H.headings(h))][-2:] == [(1, "One"), (3, "Three")] and got(H.heading_gaps(H.headings(h))) == ["h1-h3"]
    assert [(x.url, x.anchor_text, x.rel, x.internal) for x in got(H.links(h, u))] == [("https://a.test/in", "In", ["a", "b"], True), ("https://b.test/", "https://b.test/", [], False)]
    assert [(x.src, x.alt, x.width, x.height, x.format) for x in got(H.images(imgs, u))] == [("https://a.test/dir/x.png", "", 0, 0, "png"), ("https://a.test/dir/y.webp", "Y", 3, 4, "webp")]
    assert got(H.shifting_images(imgs)) == 1 and got(H.json_ld(h)) == ['{"@type":"X"}'] and got(H.has_contact_form(h)) and got(H.has_skip_link(h)) and got(H.language(h)) == "de"
    assert "no" not in got(H.visible_text(h)).split() and got(H.visible_text(h)).endswith("Skip this")
    for c in (H.title(h), H.headings(h), H.links(h, u), H.visible_text(h), H.images(imgs, u)):
        assert one(spark, c, h="") in ("", [])
        assert one(spark, c, h=None) in (None, [])


def test_challenge(spark):
    assert one(spark, H.is_challenge(F.lit("Just a moment..."), F.lit("")))
    assert one(spark, H.is_challenge(F.lit("x"), F.lit('<meta http-equiv="refresh" content="0;/captcha">')))
    assert not one(spark, H.is_challenge(F.lit(None).cast("string"), F.lit("<p>fine</p>")))


def test_text(spark):
    t = F.col("t")
    assert [one(spark, T.syllables(F.lit(w))) for w in ("a", "table", "make", "rhythm", "queue", "Áá")] == [1, 2, 1, 1, 1, 1]
    assert one(spark, T.readability(t), t="The cat sat.") == 100 and one(spark, T.readability(t), t=" . ") == 0 and one(spark, T.readability(t), t=None) is None
    assert one(spark, T.content_hash(t), t="Hello,  World!") == one(spark, T.content_hash(t), t="hello world")
    assert one(spark, F.size(T.words(t)), t=" a b \n c ") == 3
    rows = spark.createDataFrame([(1, "Beta alpha beta the alpha with gamma", "x"), (2, None, "x"), (3, "", "x")], "id int, t string, word string")
    assert [tuple(r) for r in T.keywords(rows, "id", "t", 2).orderBy("rank").collect()] == [(1, "beta", 2, 1), (1, "alpha", 2, 2)]
