"""Analyses of a crawled site: technology, completeness, modernity, speed, design, standards, and their overall score.

Every analysis is an aggregation by site over page records (`pagefacts.records`) that combines map-side. What only looks at the first pages
of a crawl ranks them with a limit that is applied before the shuffle, so a site of any size sends a few rows for each partition.
`seq` is a page's place in the crawl. Scores stay between 0 and 100. Sites without pages give no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from crawlspan.functions import urls as U

SITE = "project_id"
#: Pages that technology and design are looked for on.
TECH_PAGES, DESIGN_PAGES, FONTS_MOST, SLOWEST = 10, 5, 8, 5
# Platforms that are named as content systems, libraries and analytics with the texts of their addresses.
SYSTEMS = ("squarespace", "wix", "webflow", "ghost", "drupal", "joomla", "bigcommerce")
LIBRARIES = (("jQuery", "scripts", ("jquery",)), ("Bootstrap", "all", ("bootstrap",)), ("Tailwind CSS", "all", ("tailwind",)))
ANALYTICS = (("Google Analytics", "scripts", ("google-analytics", "gtag")), ("Google Tag Manager", "scripts", ("gtm", "googletagmanager")))
# What the pages of a site are called, and which are expected of each type of site.
ALIASES = {
    "blog": ("blog", "articles", "posts", "news"), "about": ("about", "about-us", "aboutus", "our-story", "who-we-are", "company"), "contact": ("contact", "contact-us", "contactus", "get-in-touch", "reach-us", "page/contact", "pages/contact", "support"),
    "services": ("services", "what-we-do", "solutions", "offerings"), "team": ("team", "our-team", "people", "leadership", "about/team"), "returns": ("returns", "refund-policy", "refund", "policies/refund-policy", "policies/refund", "return-policy"),
    "shipping": ("shipping", "shipping-policy", "delivery", "policies/shipping-policy", "policies/shipping"), "products": ("products", "shop", "store", "collections"), "cart": ("cart", "basket", "checkout"), "pricing": ("pricing", "plans", "packages"),
    "features": ("features", "capabilities", "platform"), "documentation": ("docs", "documentation", "help", "knowledge-base", "faq"), "portfolio": ("portfolio", "work", "projects", "case-studies"), "archive": ("archive", "archives"), "categories": ("categories", "topics", "tags"),
    "privacy": ("privacy", "privacy-policy", "privacypolicy", "data-privacy", "privacy-statement", "policies/privacy-policy", "policies/privacy"), "terms": ("terms", "terms-of-service", "terms-and-conditions", "tos", "terms-of-use", "termsofservice", "policies/terms-of-service"),
}
BASE = ("about", "contact", "privacy", "terms")
EXPECTED = {"ecommerce": ("products", "cart", "shipping", "returns"), "saas": ("pricing", "features", "documentation"), "blog": ("blog", "archive", "categories"), "portfolio": ("portfolio", "services"), "business": ("services", "team")}
ESSENTIAL = ("about", "contact")
# Link texts, headings and schema types that stand for a page that no address names.
HINTS = {
    "contact": (r"\b(contact|get in touch|reach out|reach us|send.{0,5}message|talk to us|write to us|enquir|inquir|let'?s talk|let'?s chat|book a call|schedule a call)\b", r"\b(contact|get in touch|reach out|send.{0,5}message|talk to us|write to us|enquir|inquir|drop.{0,5}(a )?line|let'?s (talk|chat|connect))\b", "contactpage"),
    "privacy": (r"\b(privacy|privacy policy|data privacy|data protection)\b", r"\b(privacy|data (privacy|protection)|personal (data|information))\b", None),
    "terms": (r"\b(terms|terms of (service|use)|terms (and|&) conditions|legal)\b", r"\b(terms of (service|use)|terms (and|&) conditions|legal (notice|terms))\b", None),
}
# Hosts of social networks and their names.
SOCIAL = (("facebook.com", "facebook"), ("twitter.com", "X (Twitter)"), ("x.com", "X (Twitter)"), ("linkedin.com", "linkedin"), ("instagram.com", "instagram"), ("youtube.com", "youtube"), ("tiktok.com", "tiktok"), ("pinterest.com", "pinterest"))
# The weights of the overall score.
WEIGHTS = {"modernization": 0.15, "performance": 0.25, "completeness": 0.2, "design": 0.15, "standards": 0.25}
EMPTY = "array<string>"


def first_pages(pages: DataFrame, most: int) -> DataFrame:
    return pages.withColumn("_r", F.row_number().over(W.partitionBy(SITE).orderBy("seq"))).filter(F.col("_r") <= most).drop("_r")


def _texts(c: str) -> Column:
    return F.coalesce(F.col(c), F.array().cast(EMPTY))


def _any(texts: Column, *parts: str) -> Column:
    return F.exists(texts, lambda s: s.rlike("|".join(p.replace(".", r"\.") for p in parts)))


def _addresses() -> dict[str, Column]:
    """Script addresses as they are, with the page's own; those in lower case; and those and the style sheets in lower case."""
    own = F.concat(_texts("script_srcs"), F.array("url"))
    low = lambda xs: F.transform(xs, lambda s: F.lower(s))
    return {"as_is": own, "scripts": low(own), "all": low(F.concat(own, _texts("stylesheet_hrefs")))}


def sorted_names(pairs: Column) -> Column:
    """Names of (at, order, name) in that order, without nulls."""
    return F.transform(F.array_sort(F.filter(pairs, lambda x: x["at"].isNotNull())), lambda x: x["name"])


def tech_stack(pages: DataFrame) -> DataFrame:
    """(project_id, framework, cms, libraries, analytics): what the first pages' addresses, tags and platforms say; null is none found.

    Needs url, seq, script_srcs, stylesheet_hrefs, tags (open graph and card texts), platform. Libraries are in the order in which they are seen.
    """
    a = _addresses()
    platform = F.lower(F.coalesce("platform", F.lit("")))
    ten = lambda c: F.when(F.coalesce(c, F.lit(False)), 10).otherwise(0)
    shopify = ten(_any(a["all"], "cdn.shopify.com")) + ten(F.contains(F.lower("url"), F.lit("myshopify.com"))) + F.when(F.contains(F.lower("tags"), F.lit("shopify")), 3).otherwise(0) + ten(platform == "shopify")
    rows = first_pages(pages, TECH_PAGES).select(
        SITE, "seq", (ten(_any(a["all"], "_next/static", "/__next")) + ten(_any(a["as_is"], "_next/", "next-"))).alias("next"), ten(_any(a["scripts"], "react")).alias("react"), _any(a["scripts"], "vue").alias("vue"), shopify.alias("shopify"),
        ((platform == "wordpress") | _any(a["all"], "wp-content", "wp-includes")).alias("wordpress"), F.when(platform.isin(*SYSTEMS), platform).alias("system"),
        *[_any(a[where], *parts).alias(name) for name, where, parts in LIBRARIES + ANALYTICS],
    )
    seen = lambda names: F.array(*[F.struct(F.min(F.when(F.col(f"`{n}`"), F.col("seq"))).alias("at"), F.lit(i).alias("order"), F.lit(n).alias("name")) for i, (n, _, _) in enumerate(names)])
    found = rows.groupBy(SITE).agg(
        F.sum("next").alias("next"), F.sum("react").alias("react"), F.max("vue").alias("vue"), F.sum("shopify").alias("shopify"), F.max("wordpress").alias("wordpress"), F.min_by("system", F.when(F.col("system").isNotNull(), F.col("seq"))).alias("system"),
        seen(LIBRARIES).alias("libraries"), seen(ANALYTICS).alias("analytics"),
    )
    framework = F.when(F.col("next") >= 10, "Next.js").when(F.col("react") >= 10, "React").when(F.col("vue"), "Vue.js")
    cms = F.when(F.col("shopify") >= 10, F.lit("Shopify")).when(F.col("wordpress"), F.lit("WordPress")).otherwise(F.initcap("system"))
    return found.select(SITE, framework.alias("framework"), cms.alias("cms"), sorted_names(F.col("libraries")).alias("libraries"), sorted_names(F.col("analytics")).alias("analytics"))


def site_types(pages: DataFrame) -> DataFrame:
    """(project_id, site_type): by the paths that occur; needs url."""
    low = F.lower("url")
    has = lambda *parts: F.coalesce(F.max(low.rlike("|".join(parts))), F.lit(False))
    posts = F.count(F.when(low.rlike("/blog/|/articles/|/posts/"), 1))
    kind = (
        F.when(has("/products", "/shop", "/cart"), "ecommerce").when(has("/pricing"), "saas").when(posts >= 3, "blog")
        .when(has("/portfolio", "/projects") | (has("/work") & ~has("/how-we-work")), "portfolio").otherwise("business")
    )
    return pages.groupBy(SITE).agg(kind.alias("site_type"))


def completeness(pages: DataFrame, custom: dict[str, str] | None = None) -> DataFrame:
    """(project_id, site_type, score, found, missing): which expected pages a site has. found says as what.

    A page counts by a name of it anywhere in a path, at the first page of the crawl that has one; `custom` gives own paths. Contact, privacy
    and terms also count by link texts, then headings, then schema types. Needs url, seq, links, h1s, h2s, schema_types.
    """
    names = dict(ALIASES)
    for key, path in (custom or {}).items():
        if alias := path.lstrip("/").lower():
            names[key] = (alias, *names.get(key, (key,)))
    wanted = F.explode(F.array(*[F.struct(F.lit(t).alias("site_type"), F.lit(i).alias("at"), F.lit(k).alias("key")) for t, more in EXPECTED.items() for i, k in enumerate(BASE + more)]))
    expected = site_types(pages).join(pages.sparkSession.range(1).select(wanted.alias("e")).select("e.*"), "site_type")
    path = F.lower(U.path(F.col("url")))
    keys = F.filter(F.array(*[F.when(_contains_any(path, aliases), F.lit(k)) for k, aliases in names.items()]), lambda x: x.isNotNull())
    by_path = pages.select(SITE, "seq", U.path(F.col("url")).alias("path"), F.explode(keys).alias("key")).groupBy(SITE, "key").agg(F.min(F.struct("seq", "path")).alias("p")).select(SITE, "key", F.col("p.path").alias("path"))
    clues = []
    for key, (anchor, heading, schema) in HINTS.items():
        fits = lambda p: (lambda t: F.coalesce(t.rlike(f"(?i){p}"), F.lit(False)))
        link = F.get(F.filter("links", lambda x: x["internal"] & fits(anchor)(x["anchor_text"])), 0)
        titled = F.exists(F.concat(_texts("h1s"), _texts("h2s")), fits(heading))
        typed = F.exists(_texts("schema_types"), fits(schema)) if schema else F.lit(False)
        said = F.when(link.isNotNull(), F.concat(F.lit('nav link "'), link["anchor_text"], F.lit('" → '), U.path(link["url"])))
        here = lambda text: F.concat(F.lit(f"{text} match on "), U.path(F.col("url")))
        rank = lambda c, r, text: F.when(c, F.struct(F.lit(key).alias("key"), F.lit(r).alias("rank"), F.col("seq").alias("seq"), text.alias("text")))
        clues += [rank(link.isNotNull(), 0, said), rank(titled, 1, here("heading")), rank(typed, 2, here("schema"))]
    smart = pages.select(SITE, F.explode(F.filter(F.array(*clues), lambda x: x.isNotNull())).alias("c")).groupBy(SITE, "c.key").agg(F.min("c").alias("c")).select(SITE, "key", F.col("c.text").alias("clue"))
    rows = expected.join(by_path, [SITE, "key"], "left").join(smart, [SITE, "key"], "left")
    told = F.when(F.col("path").isNotNull(), F.concat("key", F.lit(" (found as "), "path", F.lit(")"))).when(F.col("clue").isNotNull(), F.concat("key", F.lit(" ("), "clue", F.lit(")")))
    # Those found by their path come first, then those by clues, each in the order expected.
    found = F.when(told.isNotNull(), F.struct(F.col("path").isNull().alias("late"), "at", told.alias("text")))
    texts = lambda c: F.transform(F.array_sort(F.collect_list(c)), lambda x: x["text"])
    missing = F.when(told.isNull(), F.struct("at", F.col("key").alias("text")))
    lost = F.sum(F.when(told.isNotNull(), 0).when(F.col("key").isin(*ESSENTIAL), 15).otherwise(8))
    return rows.groupBy(SITE, "site_type").agg(F.greatest(F.lit(0), F.lit(100) - lost).cast("int").alias("score"), texts(found).alias("found"), texts(missing).alias("missing"))


def _contains_any(text: Column, parts: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | F.contains(text, F.lit(p))
    return out


def modernization(pages: DataFrame) -> DataFrame:
    """(project_id, score, uses_jquery, modern): needs url, script_srcs, stylesheet_hrefs."""
    a = _addresses()
    rows = pages.groupBy(SITE).agg(F.max(_any(a["as_is"], "jquery")).alias("uses_jquery"), F.max(_any(a["all"], "react", "vue", "_next/", "nuxt")).alias("modern"))
    score = F.lit(100) - F.when(F.col("uses_jquery"), 20).otherwise(0) + F.when(F.col("modern"), 10).otherwise(-15)
    return rows.select(SITE, F.least(F.lit(100), score).cast("int").alias("score"), "uses_jquery", "modern")


def performance(pages: DataFrame) -> DataFrame:
    """(project_id, score, avg_load_ms, avg_first_byte_ms, avg_bytes, shifting_images, slowest): averages of positive values, 0 if there are none.

    Needs url, load_time_ms, first_byte_time_ms, size_bytes, shifting_images, hint_count, script_gap (percent of words that only scripts bring).
    slowest: up to SLOWEST (url, load_ms), slowest first, the smaller address first among equals.
    """
    mean = lambda c: F.coalesce(F.avg(F.when(F.col(c) > 0, F.col(c))), F.lit(0.0))
    rows = pages.groupBy(SITE).agg(
        mean("load_time_ms").alias("avg_load_ms"), mean("first_byte_time_ms").alias("avg_first_byte_ms"), mean("size_bytes").alias("avg_bytes"), F.coalesce(F.sum("shifting_images"), F.lit(0)).cast("long").alias("shifting_images"),
        F.coalesce(F.max(F.col("hint_count") > 0), F.lit(False)).alias("_hints"), F.coalesce(F.max(F.col("script_gap") > 50), F.lit(False)).alias("_gap"),
    )
    less = lambda *cases: _cases(cases)
    mb = F.col("avg_bytes") / (1024 * 1024)
    score = F.lit(100) - less((F.col("avg_load_ms") > 5000, 30), (F.col("avg_load_ms") > 3000, 15)) - less((F.col("avg_first_byte_ms") > 1000, 15)) - less((mb > 3, 20), (mb > 1.5, 10)) - less((F.col("shifting_images") > 5, 10)) - less((~F.col("_hints"), 5)) - less((F.col("_gap"), 10))
    order = W.partitionBy(SITE).orderBy(F.desc("load_time_ms"), "url")
    slow = pages.filter("load_time_ms > 0").select(SITE, "url", "load_time_ms").withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= SLOWEST)
    slow = slow.groupBy(SITE).agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", "url", "load_time_ms"))), lambda x: F.struct(x["url"].alias("url"), x["load_time_ms"].alias("load_ms"))).alias("slowest"))
    none = F.array().cast("array<struct<url:string,load_ms:int>>")
    return rows.join(slow, SITE, "left").select(SITE, F.greatest(F.lit(0), score).cast("int").alias("score"), "avg_load_ms", "avg_first_byte_ms", "avg_bytes", "shifting_images", F.coalesce("slowest", none).alias("slowest"))


def _cases(cases) -> Column:
    out = F.when(F.coalesce(cases[0][0], F.lit(False)), cases[0][1])
    for c, n in cases[1:]:
        out = out.when(F.coalesce(c, F.lit(False)), n)
    return out.otherwise(0)


def design(pages: DataFrame) -> DataFrame:
    """(project_id, score, fonts, social): web fonts and social networks that the first pages name, in the order in which they are seen.

    Needs url, seq, stylesheet_hrefs, script_srcs, links. Fonts are the families of font addresses, FONTS_MOST at most.
    """
    rows = first_pages(pages, DESIGN_PAGES)
    assets = rows.select(SITE, "seq", F.posexplode(F.concat(_texts("stylesheet_hrefs"), _texts("script_srcs"))).alias("at", "href"))
    low = F.lower("href")
    params = F.filter(F.split(F.regexp_extract("href", r"\?([^#]*)", 1), "&"), lambda p: p.startswith("family="))
    # A plus sign is a blank in a parameter; so is one that was escaped.
    family = lambda p: F.trim(F.regexp_replace(F.regexp_extract(F.try_url_decode(F.substring(p, F.lit(8), F.length(p))), "^([^:]*)", 1), r"\+", " "))
    fonts = F.when(low.rlike(r"fonts\.googleapis\.com|fonts\.gstatic\.com"), F.when(U.is_url(F.col("href")), F.transform(params, family)).otherwise(F.array().cast(EMPTY))).when(low.rlike(r"use\.typekit\.net|fonts\.adobe\.com"), F.array(F.lit("Adobe Fonts"))).otherwise(F.array().cast(EMPTY))
    fonts = assets.select(SITE, "seq", "at", F.posexplode(fonts).alias("n", "name")).filter("name != ''").groupBy(SITE, "name").agg(F.min(F.struct("seq", "at", "n")).alias("first"))
    fonts = fonts.groupBy(SITE).agg(F.slice(F.transform(F.array_sort(F.collect_list(F.struct("first", "name"))), lambda x: x["name"]), 1, FONTS_MOST).alias("fonts"))
    links = rows.select(SITE, "seq", F.posexplode(F.filter("links", lambda x: ~x["internal"])).alias("at", "l")).withColumn("host", U.bare_host(F.col("l.url")))
    named = F.filter(F.array(*[F.when((F.col("host") == d) | F.col("host").endswith(f".{d}"), F.struct(F.lit(i).alias("o"), F.lit(n).alias("name"))) for i, (d, n) in enumerate(SOCIAL)]), lambda x: x.isNotNull())
    social = links.select(SITE, "seq", "at", F.explode(named).alias("s")).groupBy(SITE, "s.name").agg(F.min(F.struct("seq", "at", "s.o")).alias("first"))
    social = social.groupBy(SITE).agg(F.transform(F.array_sort(F.collect_list(F.struct("first", "name"))), lambda x: x["name"]).alias("social"))
    sites = pages.select(SITE).distinct().join(fonts, SITE, "left").join(social, SITE, "left")
    none = F.array().cast(EMPTY)
    return sites.select(SITE, F.when(F.size("social") > 0, 100).otherwise(90).alias("score"), F.coalesce("fonts", none).alias("fonts"), F.coalesce("social", none).alias("social"))


def standards(pages: DataFrame, sites: DataFrame) -> DataFrame:
    """(project_id, score, https, favicon, viewport, robots, sitemap, html_lang, missing_labels, landmarks, skip_link, consent).

    sites: (project_id, url, has_robots, has_sitemap), the base address and what it answers. Needs url, seq, favicon, viewport, lang,
    missing_labels, landmark_count, skip_link, consent. landmarks and skip_link are those of the first page whose path is the root, null without one.
    """
    flag = lambda c: F.coalesce(F.max(c), F.lit(False))
    root = F.min(F.when(U.path(F.col("url")) == "/", F.struct("seq", "landmark_count", "skip_link")))
    rows = pages.groupBy(SITE).agg(
        flag(F.col("favicon").isNotNull()).alias("favicon"), flag(F.col("viewport")).alias("viewport"), flag(F.col("lang").isNotNull()).alias("html_lang"), F.coalesce(F.sum("missing_labels"), F.lit(0)).cast("long").alias("missing_labels"),
        root.alias("root"), flag(F.col("consent")).alias("consent"),
    )
    sites = sites.groupBy(SITE).agg(F.min("url").alias("base"), flag(F.col("has_robots")).alias("robots"), flag(F.col("has_sitemap")).alias("sitemap"))
    rows = rows.join(sites, SITE, "left").withColumns({"https": F.coalesce(F.col("base").startswith("https://"), F.lit(False)), "robots": F.coalesce("robots", F.lit(False)), "sitemap": F.coalesce("sitemap", F.lit(False)), "landmarks": F.col("root.landmark_count"), "skip_link": F.col("root.skip_link")})
    lost = sum(
        (_cases([(c, n)]) for c, n in ((~F.col("https"), 30), (~F.col("favicon"), 5), (~F.col("viewport"), 20), (~F.col("robots"), 5), (~F.col("sitemap"), 10), (~F.col("html_lang"), 10), (F.col("missing_labels") > 0, 5), (F.col("landmarks") < 2, 5), (~F.col("skip_link"), 3))),
        F.lit(0),
    )
    return rows.select(SITE, F.greatest(F.lit(0), F.lit(100) - lost).cast("int").alias("score"), "https", "favicon", "viewport", "robots", "sitemap", "html_lang", "missing_labels", "landmarks", "skip_link", "consent")


def sufficient(pages: DataFrame) -> DataFrame:
    """(project_id, sufficient): whether any answered page has 50 words or a title."""
    has = F.col("http_status").between(200, 299) & ((F.coalesce("word_count", F.lit(0)) >= 50) | F.coalesce(F.col("title").rlike(r"[^\s\p{Z}\x{FEFF}]"), F.lit(False)))
    return pages.groupBy(SITE).agg(F.coalesce(F.max(has), F.lit(False)).alias("sufficient"))


def overall(scores: dict[str, DataFrame], enough: DataFrame, blocked: DataFrame | None = None) -> DataFrame:
    """(project_id, modernization, performance, completeness, design, standards, overall, sufficient, blocked): the scores of a site.

    scores: of each analysis by name, with project_id and score. All are 0 where a site has too little content or was blocked.
    """
    rows = enough
    for name, df in scores.items():
        rows = rows.join(df.select(SITE, F.col("score").alias(name)), SITE, "left")
    rows = rows.join(blocked.groupBy(SITE).agg(F.max("blocked").alias("blocked")), SITE, "left") if blocked is not None else rows.withColumn("blocked", F.lit(False))
    rows = rows.withColumn("blocked", F.coalesce("blocked", F.lit(False)))
    good = F.col("sufficient") & ~F.col("blocked")
    whole = sum((F.col(n) * F.lit(w).cast("decimal(3,2)") for n, w in WEIGHTS.items()), F.lit(0).cast("decimal(9,2)"))
    return rows.select(SITE, *[F.when(good, F.col(n)).otherwise(0).alias(n) for n in WEIGHTS], F.when(good, F.floor(whole + F.lit(0.5).cast("decimal(2,1)"))).otherwise(0).cast("int").alias("overall"), "sufficient", "blocked")
