"""Facts of a page from its raw HTML, as columns.

The tags that matter are cut out once (`tags_of`); an attribute is read from its tag, so the order of attributes doesn't
matter except where it is part of the rule. A null page gives nulls and empty lists.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from crawlspan.functions import urls
from crawlspan.functions.text import words

# Titles that belong to payment forms.
PAYMENT_TITLES = ("american express", "visa", "mastercard", "paypal", "apple pay", "google pay", "stripe", "shop pay", "klarna", "afterpay", "sezzle")
# Character references that titles are freed of, in this order.
REFERENCES = (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "))
# Advertising that follows a bar or dash at the end of a title.
SUFFIXES = (r"(official\s+)?(site|website|home|shop|store|online)", r"(buy|order|get|shop)\s+", r"(free shipping|fast delivery)")
# Titles and markers of pages that check for robots.
CHALLENGE_TITLES = ("one moment, please", "just a moment", "attention required", "access denied", "please wait", "checking your browser", "verify you are human", "security check", "ddos protection")
CHALLENGE_MARKS = (
    "cf-browser-verification", "challenge-platform", "cf-turnstile", "__cf_chl_opt", "cf-challenge-running", "cdn-cgi/challenge-platform", "managed-challenge",
    "/.well-known/sgcaptcha", "sgcaptcha", "sucuri_cloudproxy", "_incapsula_resource", "incident_id", "distil_r_captcha",
)
# Tags and attributes that may load over plain http.
MIXED = r"<(img|script|iframe|video|audio|source|embed)[^>]*src=[\"']http://|<link[^>]*href=[\"']http://|<object[^>]*data=[\"']http://"
# Signs of a cookie notice.
CONSENT = r"cookie[-_]?(banner|consent|notice|policy|popup)|gdpr|onetrust|cookiebot|cc-banner"
LANDMARKS = ("nav", "main", "header", "footer", "aside")


def tags_of(html: Column, name: str) -> Column:
    """All opening tags of that name."""
    return F.coalesce(F.regexp_extract_all(html, F.lit(rf"(?i)<{name}\b[^>]*>"), F.lit(0)), F.array().cast("array<string>"))


def attribute(tag: Column, name: str) -> Column:
    """An attribute's value, empty if it is missing."""
    return F.regexp_extract(tag, rf"(?i)[\s\"']{name}=[\"']([^\"']*)[\"']", 1)


def elements(html: Column, name: str) -> Column:
    """Contents of all elements of that name."""
    return F.coalesce(F.regexp_extract_all(html, F.lit(rf"(?is)<{name}\b[^>]*>(.*?)</{name}>"), F.lit(1)), F.array().cast("array<string>"))


def without_tags(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, "<[^>]+>", ""))


def visible_text(html: Column) -> Column:
    """The page's text: no scripts, styles and tags, single-spaced."""
    kept = F.regexp_replace(F.regexp_replace(html, r"(?is)<script\b[^>]*>.*?</script>", " "), r"(?is)<style\b[^>]*>.*?</style>", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(kept, "<[^>]+>", " "), r"\s+", " "))


def word_count(html: Column) -> Column:
    return F.size(words(visible_text(html)))


def clean_title(title: Column) -> Column:
    t = title
    for name, sign in REFERENCES:
        t = F.replace(t, F.lit(name), F.lit(sign))
    t = F.trim(t)
    for s in SUFFIXES:
        t = F.regexp_replace(t, rf"(?i)\s*[|–—]\s*{s}.*$", "")
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def title(html: Column) -> Column:
    """The first title that fits of: title element, og:title, first heading; else the title element as it is, or empty."""
    fits = lambda t: (F.length(t) >= 2) & ~F.lower(F.trim(t)).isin(*PAYMENT_TITLES)
    own = F.regexp_extract(html, "(?i)<title[^>]*>([^\n\r]*?)</title>", 1)
    og = F.regexp_extract(html, "(?i)<meta[^>]*property=[\"']og:title[\"'][^>]*content=[\"']([^\"']*)[\"']", 1)
    h1 = without_tags(F.regexp_extract(html, "(?i)<h1[^>]*>([^\n\r]*?)</h1>", 1))
    return F.when(fits(own), clean_title(own)).when(fits(og), clean_title(og)).when(fits(h1), clean_title(h1)).otherwise(own)


def meta(metas: Column, name: str) -> Column:
    """Content of the first meta tag of that name, null if there is none."""
    return F.get(F.transform(F.filter(metas, lambda t: F.lower(attribute(t, "name")) == name), lambda t: attribute(t, "content")), 0)


def prefixed_meta(metas: Column, prefix: str) -> Column:
    """Map of meta contents by what follows `prefix:` in property or name; the last of a name wins."""
    name = lambda t: F.regexp_extract(t, rf"(?i)(?:property|name)=[\"']{prefix}:([^\"']*)[\"']", 1)
    named = F.filter(F.transform(metas, lambda t: F.struct(name(t).alias("n"), attribute(t, "content").alias("c"))), lambda x: x["n"] != "")
    last = lambda xs: F.transform(F.array_distinct(xs["n"]), lambda n: F.struct(n, F.element_at(F.filter(xs, lambda x: x["n"] == n), -1)["c"]))
    return F.map_from_entries(urls.let(named, last))


def canonical(linked: Column) -> Column:
    """Address of the canonical link; as crawlers do, only if rel stands before href."""
    found = F.filter(linked, lambda t: t.rlike("(?i)rel=[\"']canonical[\"'][^>]*href="))
    return F.get(F.transform(found, lambda t: attribute(t, "href")), 0)


def robots(metas: Column, word: str) -> Column:
    """Whether the robots tag (name before content) holds a word."""
    return F.exists(metas, lambda t: t.rlike("(?i)name=[\"']robots[\"'][^>]*content=") & F.contains(F.lower(attribute(t, "content")), F.lit(word)))


def favicon(linked: Column, url: Column) -> Column:
    found = F.filter(linked, lambda t: F.contains(F.lower(attribute(t, "rel")), F.lit("icon")) & (attribute(t, "href") != ""))
    return urls.let(F.get(F.transform(found, lambda t: attribute(t, "href")), 0), lambda raw: F.coalesce(urls.normalize(raw, url), raw))


def headings(html: Column) -> Column:
    """Array of (level, text) of all headings with text, in order."""
    whole = F.coalesce(F.regexp_extract_all(html, F.lit(r"(?is)<h([1-6])\b[^>]*>.*?</h\1>"), F.lit(0)), F.array().cast("array<string>"))
    return F.filter(F.transform(whole, lambda h: F.struct(F.substring(h, 3, 1).cast("int").alias("level"), without_tags(h).alias("text"))), lambda x: x["text"] != "")


def heading_gaps(found: Column) -> Column:
    """Texts such as `h2-h4` for each level that is skipped among those of the headings."""
    gap = lambda a, b: F.when(b - a > 1, F.concat(F.lit("h"), a, F.lit("-h"), b))
    return F.filter(urls.let(F.array_sort(F.array_distinct(found["level"])), lambda p: F.zip_with(p, F.slice(p, 2, 6), gap)), lambda x: x.isNotNull())


def links(html: Column, url: Column) -> Column:
    """Array of (href, url, anchor_text, rel, internal): every link that leads to a page, in order."""
    whole = F.coalesce(F.regexp_extract_all(html, F.lit(r"(?is)<a\s[^>]*href=[\"'][^\"']*[\"'][^>]*>.*?</a>"), F.lit(0)), F.array().cast("array<string>"))

    def one(x: Column, b: Column) -> Column:
        goal = F.when((x["href"] != "") & ~x["href"].startswith("#") & ~urls.is_non_http(x["href"]), urls.normalize_against(x["href"], b))
        return F.struct(x["href"].alias("href"), goal.alias("url"), F.when(x["text"] == "", x["href"]).otherwise(x["text"]).alias("anchor_text"), x["rel"].alias("rel"))

    opening = lambda a: F.regexp_extract(a, "(?is)^(<a[^>]*>)", 1)
    read = F.transform(whole, lambda a: F.struct(attribute(opening(a), "href").alias("href"), without_tags(a).alias("text"), F.filter(F.split(attribute(opening(a), "rel"), " "), lambda r: r != "").alias("rel")))
    led = lambda b: F.filter(F.transform(read, lambda x: one(x, b)), lambda x: x["url"].isNotNull())
    return urls.let(urls.base_parts(url), lambda b: F.transform(led(b), lambda x: x.withField("internal", urls.let(urls.bare_host(x["url"]), lambda h: urls._related(h, b["host"])))))


def images(imgs: Column, url: Column) -> Column:
    """Array of (src, alt, width, height, loading, format, srcset) of every image with a source."""

    found = F.transform(F.filter(imgs, lambda t: attribute(t, "src") != ""), lambda t: F.struct(t.alias("tag"), urls.absolute(attribute(t, "src"), url).alias("src")))
    size = lambda t, n: F.coalesce(F.regexp_extract(t, f"(?i){n}=[\"']?([0-9]+)", 1).try_cast("int"), F.lit(0)).alias(n)
    return F.transform(
        found, lambda x: F.struct(x["src"].alias("src"), attribute(x["tag"], "alt").alias("alt"), size(x["tag"], "width"), size(x["tag"], "height"), F.lower(attribute(x["tag"], "loading")).alias("loading"), urls.image_format(x["src"]).alias("format"), srcset(x["tag"]).alias("srcset"))
    )


def shifting_images(imgs: Column) -> Column:
    """How many images lack a numeric width or height."""
    return F.size(F.filter(imgs, lambda t: ~(t.rlike("width=[\"']?[0-9]") & t.rlike("height=[\"']?[0-9]"))))


def json_ld(html: Column) -> Column:
    """The texts of JSON-LD blocks that are JSON."""
    found = F.coalesce(F.regexp_extract_all(html, F.lit(r"(?is)<script[^>]*type=[\"']application/ld\+json[\"'][^>]*>(.*?)</script>"), F.lit(1)), F.array().cast("array<string>"))
    return F.filter(found, lambda t: F.try_parse_json(t).isNotNull())


def sources(scripts: Column) -> Column:
    return F.filter(F.transform(scripts, lambda t: attribute(t, "src")), lambda s: s != "")


def stylesheets(linked: Column) -> Column:
    return F.filter(F.transform(F.filter(linked, lambda t: F.lower(attribute(t, "rel")) == "stylesheet"), lambda t: attribute(t, "href")), lambda s: s != "")


def hinted(linked: Column, rel: str) -> Column:
    """Targets of resource hints of that kind."""
    return F.filter(F.transform(F.filter(linked, lambda t: F.lower(attribute(t, "rel")) == rel), lambda t: attribute(t, "href")), lambda s: s != "")


def hreflang(linked: Column) -> Column:
    found = F.filter(linked, lambda t: (F.lower(attribute(t, "rel")) == "alternate") & (attribute(t, "hreflang") != ""))
    return F.transform(found, lambda t: F.struct(attribute(t, "hreflang").alias("lang"), attribute(t, "href").alias("url")))


def has_viewport(metas: Column) -> Column:
    return F.exists(metas, lambda t: F.lower(attribute(t, "name")) == "viewport")


def has_mixed_content(html: Column, url: Column) -> Column:
    return url.startswith("https://") & html.rlike(f"(?i){MIXED}")


def has_contact_form(html: Column) -> Column:
    mail = "type=[\"']email[\"']|name=[\"'][^\"']*email[^\"']*[\"']|autocomplete=[\"']email[\"']"
    more = "<textarea|type=[\"']tel[\"']|name=[\"'][^\"']*(phone|name)[^\"']*[\"']|autocomplete=[\"']name[\"']"
    return F.exists(elements(html, "form"), lambda f: F.lower(f).rlike(mail) & F.lower(f).rlike(more))


def language(html: Column) -> Column:
    found = F.regexp_extract(html, r"(?i)<html[^>]*\slang=[\"']([^\"']+)[\"']", 1)
    return F.when(found != "", found)


def landmarks(html: Column) -> Column:
    return F.filter(F.array(*[F.when(html.rlike(rf"(?i)<{n}[\s>]"), F.lit(n)) for n in LANDMARKS]), lambda x: x.isNotNull())


def has_skip_link(html: Column) -> Column:
    return html.rlike("(?i)href=[\"']#[^\"']*[\"'][^>]*>[^<]*(skip|jump to)")


def has_consent(html: Column) -> Column:
    return html.rlike(f"(?i){CONSENT}")


def is_challenge(title_: Column, html: Column) -> Column:
    low = F.lower(html)
    named = F.lower(title_).rlike("|".join(CHALLENGE_TITLES))
    small = (F.length(html) < 1500) & low.rlike("http-equiv=[\"']?refresh") & low.rlike(r"captcha|challenge|\.well-known")
    return F.coalesce(named, F.lit(False)) | F.coalesce(low.rlike("|".join(m.replace(".", r"\.") for m in CHALLENGE_MARKS)) | small, F.lit(False))


# Headers of a response that concern security.
SECURITY_HEADERS = ("content-security-policy", "strict-transport-security", "x-frame-options", "x-content-type-options", "referrer-policy", "permissions-policy")
# Platforms whose pages need a browser.
NEED_BROWSER = ("shopify", "squarespace", "wix", "webflow", "bigcommerce", "magento", "nuxt")
# Signs of platforms in response headers; the first that holds counts. A sign is (header, text it contains), all of a row
# must hold; an empty text asks for the header alone. `powered` stands for powered-by or x-powered-by.
HEADER_SIGNS = (
    ("shopify", [("powered", "shopify")]), ("shopify", [("x-shopid", "")]), ("shopify", [("x-shardid", "")]), ("squarespace", [("powered", "squarespace")]), ("squarespace", [("server", "squarespace")]),
    ("wix", [("x-wix-request-id", "")]), ("wix", [("server", "wix")]), ("webflow", [("powered", "webflow")]), ("webflow", [("server", "webflow")]), ("bigcommerce", [("powered", "bigcommerce")]), ("bigcommerce", [("x-bc-store-version", "")]),
    ("magento", [("server", "magento")]), ("magento", [("x-magento-vary", "")]), ("wordpress", [("powered", "wp engine")]), ("wordpress", [("powered", "wordpress")]), ("drupal", [("x-drupal-cache", "")]), ("drupal", [("x-generator", "drupal")]),
    ("varnish-cdn", [("via", "varnish"), ("x-cache", "")]), ("nextjs", [("powered", "next.js")]), ("nuxt", [("powered", "nuxt")]), ("nuxt", [("x-nuxt-cache", "")]), ("shopify", [("link", "cdn.shopify.com")]), ("shopify", [("set-cookie", "_shopify_")]),
)
# Signs of platforms in the page; the first row of which all texts occur counts.
HTML_SIGNS = (
    ("nuxt", ['<div id="app"></div>']), ("nuxt", ['<div id="__nuxt">']), ("nextjs", ['<div id="__next">']), ("nextjs", ["_next/static"]), ("react-spa", ['<div id="root"></div>', "bundle.js"]), ("angular", ["<app-root"]), ("angular", ["ng-version="]),
    ("shopify", ["shopify.com/s/"]), ("shopify", ["cdn.shopify.com"]), ("shopify", ["shopify-section"]), ("shopify", ["data-shopify"]), ("shopify", ["shopify.loadfeatures"]), ("squarespace", ["squarespace.com"]), ("squarespace", ["data-squarespace-cacheversion"]),
    ("squarespace", ["sqs-block"]), ("squarespace", ["sqsp-"]), ("wix", ["static.wixstatic.com"]), ("wix", ["wix-dropdown"]), ("wix", ["x-wix-"]), ("wix", ["corvid-by-wix"]), ("webflow", ["webflow.com"]), ("webflow", ["data-wf-"]), ("webflow", ["w-nav"]),
    ("bigcommerce", ["bigcommerce.com"]), ("bigcommerce", ["data-content-region"]), ("magento", ["requirejs-config", "mage/"]), ("magento", ["magento"]), ("magento", ["data-mage-init"]), ("wordpress", ["wp-content/"]), ("wordpress", ["wp-includes/"]),
    ("gatsby", ["___gatsby"]), ("gatsby", ["gatsby-"]),
)
#: Characters of a page in which platforms are looked for, of the body's beginning, and the text that it must have.
PLATFORM_CHARS, BODY_CHARS, BODY_TEXT = 50_000, 500, 20


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def platform_of_headers(headers: Column) -> Column:
    """The platform that response headers (a map with lower-case names) tell of, or null."""
    get = lambda n: F.try_element_at(headers, F.lit(n))
    value = lambda n: F.coalesce(F.nullif(get("powered-by"), F.lit("")), get("x-powered-by")) if n == "powered" else get(n)
    holds = lambda n, text: (F.contains(F.lower(value(n)) if n not in ("link", "set-cookie") else value(n), F.lit(text)) if text else value(n) != "")
    out = F.when(F.lit(False), F.lit(""))
    for name, signs in HEADER_SIGNS:
        out = out.when(F.coalesce(_all([holds(n, t) for n, t in signs]), F.lit(False)), F.lit(name))
    return out


def platform_of_html(html: Column) -> Column:
    """The platform that a page's markup tells of; `spa-generic` if its body begins almost without text; or null."""
    def found(low: Column) -> Column:
        out = F.when(F.lit(False), F.lit(""))
        for name, texts in HTML_SIGNS:
            out = out.when(_all([F.contains(low, F.lit(t)) for t in texts]), F.lit(name))
        return out

    body = F.regexp_extract(html, rf"(?is)<body[^>]*>(.{{0,{BODY_CHARS}}})", 1)
    text = F.regexp_replace(F.regexp_replace(F.regexp_replace(body, "(?is)<script.*?</script>", ""), "<[^>]+>", ""), r"^\s+|\s+$", "")
    return F.coalesce(urls.let(F.lower(F.substring(html, 1, PLATFORM_CHARS)), found), F.when(html.rlike("(?i)<body[^>]*>") & (F.length(text) < BODY_TEXT), F.lit("spa-generic")))


def needs_browser(platform: Column) -> Column:
    return F.coalesce(platform.isin(*NEED_BROWSER) | platform.endswith("-spa") | (platform == "spa-generic"), F.lit(False))


def security_headers(headers: Column) -> Column:
    """Those of SECURITY_HEADERS that have a value."""
    return F.map_filter(headers, lambda k, v: k.isin(*SECURITY_HEADERS) & (v != ""))


def robots_with_header(metas: Column, header: Column, word: str) -> Column:
    """`robots`, or the same word in the X-Robots-Tag header."""
    return robots(metas, word) | F.coalesce(F.contains(F.lower(header), F.lit(word)), F.lit(False))


def challenge_ip(html: Column) -> Column:
    """The address that a challenge page says it blocked, or null."""
    return F.nullif(F.regexp_extract(html, r"ipc:(\d{1,3}(?:\.\d{1,3}){3})", 1), F.lit(""))


def is_poor(title_: Column, content_type: Column, length: Column, words_: Column) -> Column:
    """Whether a page must be looked at with a browser: no real title, or an HTML page almost without text."""
    bare = F.contains(content_type, F.lit("text/html")) & (length < 500) & (words_ < 5)
    return title_.isNull() | (F.length(title_) < 3) | F.coalesce(bare, F.lit(False))


def schema_source(served: Column, rendered: Column | None = None) -> Column:
    """Where a page's schema types (arrays) come from: `server`, `client`, `both` or `none`."""
    s, r = F.coalesce(F.size(served) > 0, F.lit(False)), F.coalesce(F.size(rendered) > 0, F.lit(False)) if rendered is not None else F.lit(False)
    if rendered is None:
        return F.when(s, F.lit("server")).otherwise(F.lit("none"))
    return F.when(s & r, F.lit("both")).when(s, F.lit("server")).when(r, F.lit("client")).otherwise(F.lit("none"))


def script_share(plain_words: Column, rendered_words: Column) -> Column:
    """How many percent of a page's words only scripts bring, rounded half up; null if it is 20 or less."""
    gap = F.when(rendered_words > 0, F.floor((rendered_words - F.coalesce(plain_words, F.lit(0))) / rendered_words * 100 + 0.5)).otherwise(F.lit(0)).cast("int")
    return F.when(gap > 20, gap)


def ld_types(blocks: Column) -> Column:
    """The distinct types of JSON-LD blocks in order: of the block, of each member of its @graph, of the first of an array."""
    parts = lambda v, p: F.coalesce(F.try_variant_get(v, f"{p}['@type']", "array<variant>"), F.array(F.try_variant_get(v, f"{p}['@type']", "variant")))
    # What isn't a text is no type.
    names = lambda v, p: F.transform(F.filter(parts(v, p), lambda x: F.schema_of_variant(x) == "STRING"), lambda x: F.try_variant_get(x, "$", "string"))
    kept = lambda v: F.concat(
        names(v, "$"), F.coalesce(F.flatten(F.transform(F.try_variant_get(v, "$['@graph']", "array<variant>"), lambda m: names(m, "$"))), F.array().cast("array<string>")), names(v, "$[0]")
    )
    return F.array_distinct(F.filter(F.flatten(F.transform(F.transform(blocks, F.try_parse_json), kept)), lambda x: x.isNotNull()))


def hreflang_ordered(html: Column) -> Column:
    """Array of (lang, url) of the alternate links in the three orders of attributes that crawlers read, one order after the other."""
    q = "[\"']"
    v = f"{q}([^\"']*){q}"

    def pairs(pattern: str, lang: int, url: int) -> Column:
        found = F.coalesce(F.regexp_extract_all(html, F.lit(f"(?i)<link[^>]*{pattern}[^>]*>"), F.lit(0)), F.array().cast("array<string>"))
        one = lambda t, n: F.regexp_extract(t, f"(?i)<link[^>]*{pattern}[^>]*>", n)
        return F.transform(found, lambda t: F.struct(one(t, lang).alias("lang"), one(t, url).alias("url")))

    alternate = f"rel={q}alternate{q}"
    return F.concat(pairs(f"{alternate}[^>]*hreflang={v}[^>]*href={v}", 1, 2), pairs(f"hreflang={v}[^>]*{alternate}[^>]*href={v}", 1, 2), pairs(f"href={v}[^>]*{alternate}[^>]*hreflang={v}", 2, 1))


def hints_ordered(html: Column, rel: str) -> Column:
    """Targets of resource hints: of tags with rel before href, then of those with href before rel."""
    q = "[\"']"
    found = lambda p: F.coalesce(F.regexp_extract_all(html, F.lit(f"(?i)<link[^>]*{p}"), F.lit(1)), F.array().cast("array<string>"))
    return F.concat(found(f"rel={q}{rel}{q}[^>]*href={q}([^\"']+){q}"), found(f"href={q}([^\"']+){q}[^>]*rel={q}{rel}{q}"))


def srcset(tag: Column) -> Column:
    return F.nullif(attribute(tag, "srcset"), F.lit(""))
