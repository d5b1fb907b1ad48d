"""URL functions, all of them columns over columns.

A URL is taken apart once by one pattern; everything else works on the parts. Texts that the pattern doesn't take are no URLs:
functions that give a URL then give null, tests give false. Null in, null out.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

PARTS = r"^\s*([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#\s]+)([^?#]*)(\?[^#]*)?(#.*)?$"

# Schemes of addresses that aren't pages.
NON_HTTP = ("mailto", "tel", "javascript", "data", "ftp", "ftps", "blob", "file", "sms", "geo", "whatsapp", "skype", "viber", "callto")
# Query parameters that only track.
TRACKING = ("utm_source", "utm_medium", "utm_campaign", "utm_content", "utm_term", "fbclid", "gclid", "msclkid", "ref", "_ga", "mc_cid", "mc_eid")
# Path segments of pages that rightly hold little text.
UTILITY = (
    "login", "log-in", "logout", "log-out", "signin", "sign-in", "signout", "sign-out", "register", "signup", "sign-up", "account", "my-account", "password", "forgot-password", "reset-password",
    "cart", "basket", "checkout", "wishlist", "auth", "2fa", "verify", "verification",
)
# Endings of files that aren't pages.
FILES = (
    "jpg", "jpeg", "png", "gif", "svg", "webp", "ico", "bmp", "tiff", "pdf", "doc", "docx", "xls", "xlsx", "ppt", "pptx", "zip", "rar", "tar", "gz", "mp3", "mp4", "avi", "mov", "wmv", "flv", "wav", "ogg",
    "txt", "md", "xml", "json", "csv", "yaml", "yml", "css", "js", "woff", "woff2", "ttf", "eot", "map",
)
# Paths of a site's machinery, words and parameters of pages not to crawl.
MACHINERY = ("/wp-admin/", "/wp-includes/", "/wp-content/plugins/", "/admin/", "/ajax/", "/api/")
SIGN_IN = ("login", "logout", "register", "signin", "signup")
LISTINGS = ("search", "filter", "sort")
# Signs of product pages and of category pages.
PRODUCT = r"/products?/|/item/|/shop/|/store/|/catalog/|/buy/|/p/|/product-|/sku-"
CATEGORY = r"/categories?/|/collections?/|/browse/|/section/|/department/|/catalog/|/shop$|/store$"
# Image endings whose format has another name.
FORMATS = {"jpg": "jpeg", "tif": "tiff"}


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once, however often the body names it; also within the lambdas of array functions."""
    return F.get(F.transform(F.array(value), body), 0)


def _part(url: Column, n: int) -> Column:
    return F.regexp_extract(url, PARTS, n)


def scheme(url: Column) -> Column:
    return F.lower(_part(url, 1))


def host(url: Column) -> Column:
    """Host in lower case without user, port; empty if it isn't a URL."""
    return F.lower(F.regexp_extract(_part(url, 2), r"^(?:[^@]*@)?(\[[^\]]*\]|[^:]*)", 1))


def bare_host(url: Column) -> Column:
    return F.regexp_replace(host(url), r"^www\.", "")


def path(url: Column) -> Column:
    """The path, `/` if it is empty."""
    p = _part(url, 3)
    return F.when(p == "", F.lit("/")).otherwise(p)


def query(url: Column) -> Column:
    """The query with its question mark, or an empty text."""
    return _part(url, 4)


def is_url(url: Column) -> Column:
    return F.coalesce(url.rlike(PARTS), F.lit(False))


def is_non_http(url: Column) -> Column:
    return F.lower(F.trim(url)).rlike("^(" + "|".join(NON_HTTP) + "):")


def is_private_ip(ip: Column) -> Column:
    """Addresses of private, loopback, link-local and unspecified ranges, of both versions."""
    v4 = ip.rlike(r"^(10|127|0)\.|^192\.168\.|^169\.254\.|^172\.(1[6-9]|2[0-9]|3[01])\.")
    return v4 | F.lower(ip).rlike(r"^(::1|::)$|^f[cd]|^fe80")


def is_utility(url: Column) -> Column:
    where = F.when(is_url(url), path(url)).otherwise(url)
    return where.rlike("(?i)/(" + "|".join(UTILITY) + r")(/|$|\?|#)")


def path_depth(url: Column) -> Column:
    return F.size(F.filter(F.split(_part(url, 3), "/"), lambda s: s != ""))


def is_product(url: Column) -> Column:
    return url.rlike(f"(?i){PRODUCT}")


def is_category(url: Column) -> Column:
    return url.rlike(f"(?i){CATEGORY}")


def parameters(url: Column) -> Column:
    """The query's `name=value` texts in order."""
    return F.filter(F.split(F.substring(query(url), 2, 1 << 30), "&"), lambda p: p != "")


def crawl_priority(url: Column, depth: Column) -> Column:
    kind = F.when(is_product(url), 5).when(is_category(url), 3).otherwise(0)
    return F.greatest(F.lit(1), F.lit(10) - depth + kind + F.when(path_depth(url) <= 1, 2).otherwise(0) - F.when(F.size(parameters(url)) > 3, 2).otherwise(0))


def is_excluded(url: Column, custom: tuple[str, ...] = (), audit: bool = False) -> Column:
    """Whether a crawl leaves the address out; `custom` are texts that excluded addresses contain, in any case."""
    p = F.lower(path(url))
    out = p.rlike(r"\.(" + "|".join(FILES) + ")$") | p.rlike("|".join(MACHINERY))
    if not audit:
        out = out | p.rlike("|".join(SIGN_IN)) | query(url).rlike("(?i)[?&](" + "|".join(LISTINGS) + ")=")
    out = is_url(url) & out
    for c in custom:
        out = out | F.contains(F.lower(url), F.lit(c.lower()))
    return F.coalesce(out, F.lit(False))


def is_internal(url: Column, base: Column) -> Column:
    """Same host, or one a subdomain of the other, www aside."""
    return let(F.struct(bare_host(url).alias("a"), bare_host(base).alias("b")), lambda h: _related(h["a"], h["b"]))


def _related(a: Column, b: Column) -> Column:
    return (a != "") & (b != "") & ((a == b) | a.endswith(F.concat(F.lit("."), b)) | b.endswith(F.concat(F.lit("."), a)))


def without_dots(path_: Column) -> Column:
    """A path with its `.` and `..` segments resolved."""
    steps = F.aggregate(
        F.split(path_, "/"), F.array().cast("array<string>"),
        lambda done, s: F.when(s == "..", F.when(F.size(done) > 1, F.slice(done, F.lit(1), F.size(done) - 1)).otherwise(done)).when(s == ".", done).otherwise(F.concat(done, F.array(s))),
    )
    ends = path_.rlike(r"/\.{1,2}$")
    return F.when(path_.rlike(r"(^|/)\.{1,2}(/|$)"), F.concat(F.array_join(steps, "/"), F.when(ends, F.lit("/")).otherwise(F.lit("")))).otherwise(path_)


def base_parts(base: Column) -> Column:
    """What references are resolved against: origin, folder, path, query and bare host of an address."""
    return F.struct(
        F.concat(scheme(base), F.lit("://"), _part(base, 2)).alias("origin"), F.regexp_replace(path(base), "[^/]*$", "").alias("folder"), path(base).alias("path"), query(base).alias("query"), bare_host(base).alias("host")
    )


def _against(u: Column, b: Column) -> Column:
    """A trimmed reference resolved against base parts."""
    joined = F.regexp_extract(u, "^([^?#]*)", 1)
    rest = F.substring(u, F.length(joined) + 1, F.length(u))
    return (
        F.when(u.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), u).when(u.startswith("//"), F.concat(F.lit("https:"), u))
        .when(u.startswith("/"), F.concat(b["origin"], without_dots(joined), rest)).when(u.startswith("?"), F.concat(b["origin"], b["path"], u)).when(u.startswith("#"), F.concat(b["origin"], b["path"], b["query"], u))
        .otherwise(F.concat(b["origin"], without_dots(F.concat(b["folder"], joined)), rest))
    )


def absolute(url: Column, base: Column) -> Column:
    """A reference resolved against a base address."""
    return let(F.struct(F.trim(url).alias("u"), base_parts(base).alias("b")), lambda x: _against(x["u"], x["b"]))


def normalize_against(url: Column, b: Column | None, www: Column | None = None) -> Column:
    """`normalize` with the base already taken apart by `base_parts`."""
    bare_domain = lambda u: F.contains(u, F.lit(".")) & ~F.contains(u, F.lit("/")) & ~u.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:")
    goal = lambda u: F.when(bare_domain(u), F.concat(F.lit("https://"), u)).otherwise(
        _against(u, b) if b is not None else F.when(u.startswith("//"), F.concat(F.lit("https:"), u)).when(u.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), u)
    )

    def joined(x: Column) -> Column:
        name = x["name"]
        if www is not None:
            bare = F.regexp_replace(name, r"^www\.", "")
            name = F.when(www, F.concat(F.lit("www."), bare)).when(~www, bare).otherwise(name)
        p = x["path"]
        p = F.when((F.length(p) > 1) & p.endswith("/"), F.substring(p, F.lit(1), F.length(p) - 1)).otherwise(p)
        asked = F.when(F.size(x["kept"]) > 0, F.concat(F.lit("?"), F.array_join(x["kept"], "&"))).otherwise(F.lit(""))
        return F.when(x["fit"] & ~F.contains(x["name"], F.lit("@")), F.concat(F.lit("https://"), name, p, asked))

    taken = lambda u: F.struct(
        F.lower(_part(u, 2)).alias("name"), path(u).alias("path"), F.filter(parameters(u), lambda x: ~F.regexp_extract(x, "^([^=]*)", 1).isin(*TRACKING)).alias("kept"), (u.rlike("(?i)^https?://") & is_url(u)).alias("fit")
    )
    return let(F.nullif(F.trim(url), F.lit("")), lambda t: let(goal(t), lambda u: let(taken(u), joined)))


def normalize(url: Column, base: Column | None = None, www: Column | None = None) -> Column:
    """The canonical form of an address: https, lower-case host, no fragment, no tracking parameters, no slash at the end.

    A text with a point and no slash is a bare domain; other relative texts are resolved against `base`. `www` (true, false or
    null for no preference) sets or drops the prefix. Null for empty texts, other schemes and addresses with credentials.
    """
    return normalize_against(url, None, www) if base is None else let(base_parts(base), lambda b: normalize_against(url, b, www))


def cleaned(url: Column, base: Column | None = None) -> Column:
    """`normalize`, or null for what no link should lead to: fragments, other schemes, mangled or very long addresses."""
    t = F.trim(url)
    bad = (t == "") | (t == "#") | is_non_http(t) | t.rlike("(?i)^https?://(mailto|tel|javascript|sms|ftp):") | (F.length(t) > 2000)
    return F.when(~bad, normalize(t, base))


def url_issues(url: Column) -> Column:
    """What is wrong with the form of an address, as texts in fixed order."""
    found = F.array(
        F.when(path(url).rlike("[A-Z]"), F.lit("uppercase")), F.when(F.contains(path(url), F.lit("_")), F.lit("underscore")),
        F.when(F.length(url) > 115, F.lit("long")), F.when(query(url) != "", F.lit("parameters")),
    )
    return F.when(is_url(url), F.filter(found, lambda x: x.isNotNull())).otherwise(F.array().cast("array<string>"))


def same_page(a: Column, b: Column) -> Column:
    """Whether two addresses name one page: scheme, host, path without slashes at its end, query, in any case. Null is no page."""
    form = lambda u: F.lower(F.concat(scheme(u), host(u), F.regexp_replace(path(u), "/+$", ""), query(u)))
    return F.when(a.isNull(), F.lit(False)).when(is_url(a) & is_url(b), form(a) == form(b)).otherwise(a == b)


def sitemap_key(url: Column) -> Column:
    """What sitemap entries and pages are matched on: scheme, host and path without slashes at its end, in lower case."""
    p = F.regexp_replace(path(url), "/+$", "")
    return F.when(is_url(url), F.lower(F.concat(scheme(url), F.lit("://"), host(url), F.when(p == "", F.lit("/")).otherwise(p))))


def image_format(url: Column) -> Column:
    """Format by the ending of the path, empty if there is none."""
    ending = F.regexp_extract(F.lower(path(url)), r"\.([a-z0-9]+)$", 1)
    for short, long in FORMATS.items():
        ending = F.when(ending == short, F.lit(long)).otherwise(ending)
    return F.when(is_url(url), ending).otherwise(F.lit(""))


# Domains of builders whose pages are made by scripts.
JS_HEAVY = (
    "shopify.com", "shopifypreview.com", "myshopify.com", "squarespace.com", "squarespace-cdn.com", "wix.com", "wixsite.com", "wixstatic.com", "webflow.io", "webflow.com", "bigcommerce.com", "mybigcommerce.com", "magento.com", "magento.cloud",
    "volusion.com", "3dcart.com", "shift4shop.com", "ecwid.com", "weebly.com", "godaddysites.com", "duda.co", "dudaone.com", "framer.app", "framer.website", "carrd.co", "bubble.io", "softr.io", "gatsbyjs.io", "vercel.app", "netlify.app", "cargo.site",
)
# Image endings that are recognised by the source alone.
GUESSED = ("webp", "avif", "svg", "png", "jpg", "jpeg", "gif", "bmp", "ico")


def normalize_basic(url: Column) -> Column:
    """The address with https if it names no scheme, without fragment and without one slash at the end of its path. Null if it is no URL."""
    full = F.when(F.contains(url, F.lit("://")), url).otherwise(F.concat(F.lit("https://"), url))
    p = path(full)
    p = F.when((F.length(p) > 1) & p.endswith("/"), F.substring(p, F.lit(1), F.length(p) - 1)).otherwise(p)
    return F.when((url != "") & is_url(full), F.concat(scheme(full), F.lit("://"), F.lower(_part(full, 2)), p, query(full)))


def is_public(url: Column, addresses: Column) -> Column:
    """Whether an address may be fetched: its host is a public IP, or all of the host's `addresses` (an array) are, of which there must be one."""
    h = F.regexp_replace(host(url), r"^\[|\]$", "")
    literal = h.rlike(r"^[0-9.]+$") | F.contains(h, F.lit(":"))
    known = (F.size(addresses) > 0) & F.forall(addresses, lambda a: ~is_private_ip(a))
    return F.coalesce(F.when(h == "", F.lit(False)).when(literal, ~is_private_ip(h)).otherwise(known), F.lit(False))


def is_same_site(target: Column, base: Column) -> Column:
    """Whether a host is the base host, www aside, or below it."""
    t, b = F.lower(target), F.regexp_replace(F.lower(base), r"^www\.", "")
    return (t == b) | t.endswith(F.concat(F.lit("."), b))


def is_safe_sitemap(url: Column, base: Column, addresses: Column) -> Column:
    return F.coalesce(is_internal(url, base), F.lit(False)) | is_public(url, addresses)


def as_path(value: Column, base_host: Column | None = None) -> Column:
    """A setting as a path: trimmed, of 300 characters at most, without blanks, with a slash before it. A whole address stays if it is
    on the site of `base_host`, and is refused without one. Null for what is refused."""
    t = F.trim(value)
    same = F.coalesce(is_same_site(host(t), base_host), F.lit(False)) & is_url(t) if base_host is not None else F.lit(False)
    good = (t != "") & (F.length(t) <= 300) & ~t.rlike(r"\s")
    return F.when(good & t.rlike("^https?://"), F.when(same, t)).when(good, F.when(t.startswith("/"), t).otherwise(F.concat(F.lit("/"), t)))


def is_js_heavy(url: Column) -> Column:
    return F.lower(url).rlike("|".join(d.replace(".", r"\.") for d in JS_HEAVY))


def guessed_format(src: Column) -> Column:
    """Image format by the ending of a source, absolute or not; `unknown` for others."""
    bare = F.regexp_extract(F.lower(src), r"^([^?#]*)", 1)
    ending = F.regexp_extract(bare, r"\.(" + "|".join(GUESSED) + ")$", 1)
    return F.when(ending == "jpg", F.lit("jpeg")).when(ending != "", ending).otherwise(F.lit("unknown"))


def www_by_redirects(domain: Column, www: Column, bare: Column) -> Column:
    """`www`, `bare` or `unknown` by probes of both forms of a domain (without www.), structs of final, status, redirected; null is no answer."""
    at = lambda p, name: F.contains(p["final"], F.concat(F.lit("//"), name))
    still = ~www["redirected"] & ~bare["redirected"]
    found = (
        F.when(www.isNull() | bare.isNull(), F.lit("unknown")).when(at(www, domain) & ~F.contains(www["final"], F.lit("//www.")), F.lit("bare")).when(at(bare, F.concat(F.lit("www."), domain)), F.lit("www"))
        .when(still & (www["status"] == 200) & (bare["status"] != 200), F.lit("www")).when(still & (bare["status"] == 200) & (www["status"] != 200), F.lit("bare"))
    )
    return F.coalesce(found, F.lit("unknown"))


def www_choice(locked: Column, redirects: Column, links: Column, base: Column) -> Column:
    """The preference that counts: a setting, then what redirects say, then links, then the form of the base address."""
    known = lambda x: F.nullif(x, F.lit("unknown"))
    return F.coalesce(known(locked), known(redirects), known(links), F.when(host(base).startswith("www."), F.lit("www")).otherwise(F.lit("bare")))
