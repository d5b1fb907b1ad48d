"""Issues of pages as rows with description and details: the conditions of `pagefacts.RULES` and those that need more than a page's markup.

One pass over each page, no shuffle: an array of all issues that hold, exploded. Details are JSON texts; lists in them are cut to what is shown, which is part
of the rule.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from crawlspan.functions import html as H
from crawlspan.functions import urls as U
from crawlspan.operators.pagefacts import GENERIC_ANCHORS, RULES

#: Entries of lists that details show.
SHOWN, IMAGES_SHOWN, PROBLEMS_SHOWN = 10, 5, 3
# The properties that each type of a JSON-LD node must have; of names joined by a bar one is enough, one with [] is an array
# that isn't empty. Of types in one group the last that a node has gives the name.
NEEDED = (
    (("Organization", "LocalBusiness"), ("name", "url")), (("Article", "BlogPosting", "NewsArticle"), ("headline", "datePublished", "author", "image")), (("Product",), ("name", "offers|price", "image")),
    (("BreadcrumbList",), ("itemListElement[]",)), (("FAQPage",), ("mainEntity[]",)), (("WebSite",), ("name",)),
)
# Headers whose absence is an issue, with their labels.
MUST_HEADERS = (("strict-transport-security", "HSTS (Strict-Transport-Security)"), ("x-content-type-options", "X-Content-Type-Options"))
LANG_CODE = "^[a-zA-Z]{2,3}(-[a-zA-Z]{2,8})*$"


def _nodes(entry, out: list[dict]) -> None:
    """The nodes of a block that must say their type: members of arrays and graphs, and whatever isn't just a reference or a wrapper."""
    todo = [entry]
    while todo:
        x = todo.pop()
        if isinstance(x, list):
            todo += reversed(x)
        elif isinstance(x, dict):
            keys = [k for k in x if k != "@context"]
            graph = x.get("@graph")
            own = not (isinstance(graph, list) and keys == ["@graph"]) and keys != ["@id"]
            if isinstance(graph, list):
                todo += [_Node(x)] if own else []
                todo += reversed(graph)
            elif own:
                out.append(x)
        elif isinstance(x, _Node):
            out.append(x.value)


class _Node:
    """A wrapper with a graph and keys of its own, which comes after its members."""

    def __init__(self, value: dict):
        self.value = value


def node_problems(texts: list[str | None]) -> list[str]:
    """What the JSON-LD nodes of a page's blocks lack. Blocks that aren't JSON are left out."""
    nodes: list[dict] = []
    for t in texts:
        try:
            _nodes(json.loads(t), nodes)
        except (ValueError, TypeError, RecursionError):
            continue
    out = []
    for node in nodes:
        kinds = node.get("@type")
        types = [x for x in kinds if isinstance(x, str)] if isinstance(kinds, list) else [kinds] if isinstance(kinds, str) else []
        if not types:
            out.append("Missing @type property")
        for group, needed in NEEDED:
            name = next((g for g in reversed(group) if g in types), None)
            for need in needed if name else ():
                given = [node.get(k) for k in need.removesuffix("[]").split("|")]
                if need.endswith("[]"):
                    if not (isinstance(given[0], list) and given[0]):
                        out.append(f"{name}: missing or empty {need[:-2]}")
                elif not any(x is not None and x is not False and x != "" and x != 0 for x in given):
                    out.append(f"{name}: missing " + " or ".join(f'"{k}"' for k in need.split("|")))
    return out


@F.pandas_udf(ArrayType(StringType()))
def ld_problems(blocks: pd.Series) -> pd.Series:
    return blocks.map(lambda b: node_problems(list(b)), na_action="ignore")


def _details(**parts: Column) -> Column:
    return F.to_json(F.struct(*[c.alias(n) for n, c in parts.items()]))


def _say(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def described(found: DataFrame) -> dict[str, tuple[Column, Column]]:
    """Description and details of the issues of `pagefacts.RULES` by type."""
    c, u = F.col, F.col("url")
    n = lambda name: F.length(F.trim(name))
    no_alt = F.filter("images", lambda i: F.trim(i["alt"]) == "")
    formats = F.transform("images", lambda i: i["format"])
    histogram = F.map_from_entries(F.transform(F.array_distinct(formats), lambda f: F.struct(f, F.size(F.filter(formats, lambda x: x == f)))))
    generic = F.filter("links", lambda x: F.lower(F.trim(x["anchor_text"])).isin(*GENERIC_ANCHORS))
    plain = lambda text, **more: (F.lit(text), _details(url=u, **more))
    length = lambda what, name, way, least: (_say(f"{what} is too {way} (", n(name), f" characters, recommended {least})"), _details(url=u, text=c(name), length=n(name)))
    skipped = F.transform("gaps", lambda g: F.concat(F.lit("Heading level skipped: H"), F.substring(g, 2, 1), F.lit(" to H"), F.substring(g, 5, 1), F.lit(" (missing "), F.array_join(F.transform(F.sequence(F.substring(g, 2, 1).cast("int") + 1, F.substring(g, 5, 1).cast("int") - 1), lambda x: F.concat(F.lit("H"), x.cast("string"))), ", "), F.lit(")")))
    wrong = F.transform("url_issues", lambda x: F.when(x == "uppercase", F.lit("URL contains uppercase letters")).when(x == "underscore", F.lit("URL contains underscores instead of hyphens")).when(x == "parameters", F.lit("URL contains dynamic query parameters")).otherwise(_say("URL is excessively long (", F.length(u), " characters, recommended max 115)")))
    two = lambda x: F.format_string("%.2f", x.cast("double"))
    return {
        "server_error": (_say("Page returned HTTP ", c("http_status"), " server error"), _details(status_code=c("http_status"), url=u)), "not_found": plain("Page returned HTTP 404 Not Found"), "missing_title": plain("Page is missing a title tag"),
        "missing_meta_description": plain("Page is missing a meta description"), "missing_h1": plain("Page is missing an H1 heading tag"), "multiple_h1": (_say("Page has ", c("h1_count"), " H1 tags (should have exactly one)"), _details(url=u, h1s=c("h1s"), count=c("h1_count"))),
        "title_too_long": length("Title tag", "page_title", "long", "max 60"), "title_too_short": length("Title tag", "page_title", "short", "min 10"), "meta_description_too_long": length("Meta description", "description", "long", "max 160"), "meta_description_too_short": length("Meta description", "description", "short", "min 50"),
        "thin_content": (_say("Page has thin content (", c("word_count"), " words, recommended min 300)"), _details(url=u, word_count=c("word_count"))), "missing_canonical": plain("Page is missing a canonical URL"), "noindex": plain("Page is blocked from indexing by robots noindex directive"), "missing_open_graph": plain("Page is missing Open Graph meta tags"),
        "missing_twitter_card": plain("Page is missing Twitter Card meta tags"), "missing_structured_data": plain("Page has no structured data / schema markup"), "large_page_size": (_say("Page size is ", two(c("size_bytes") / 1048576), " MB (recommended max 3 MB)"), _details(url=u, size_bytes=c("size_bytes"), size_mb=two(c("size_bytes") / 1048576))),
        "slow_page": (_say("Page load time is ", two(c("load_time_ms") / 1000), "s (recommended max 3s)"), _details(url=u, load_time_ms=c("load_time_ms"))),
        "missing_image_alt": (_say(F.size(no_alt), " image(s) missing alt text"), _details(url=u, count=F.size(no_alt), images=F.transform(F.slice(no_alt, 1, SHOWN), lambda i: i["src"]))),
        "heading_hierarchy_invalid": (_say("Heading hierarchy is invalid: ", F.array_join(skipped, "; ")), _details(url=u, issues=skipped)), "missing_viewport_meta": plain("Page is missing a viewport meta tag, which is critical for mobile rendering and mobile SEO"),
        "mixed_content": plain("Page loads HTTP resources on an HTTPS page, causing mixed content warnings and potential security issues"),
        "url_structure_issues": (_say("URL has ", F.size(wrong), " structural issue(s): ", F.array_join(wrong, "; ")), _details(url=u, issues=wrong)),
        "canonical_mismatch": (_say("Canonical URL does not match the page URL (canonical points to ", c("canonical"), ")"), _details(url=u, canonical_url=c("canonical"))),
        "missing_image_lazy_loading": (_say("None of the ", c("image_count"), " images use lazy loading"), _details(url=u, image_count=c("image_count"))),
        "non_modern_image_format": (_say(c("old_images"), " of ", c("image_count"), " images use legacy formats (not WebP, AVIF, or SVG)"), _details(url=u, format_breakdown=histogram, non_modern_count=c("old_images"), total_images=c("image_count"))),
        "non_descriptive_anchor_text": (_say(F.size(generic), ' link(s) use non-descriptive anchor text (e.g. "click here", "read more")'), _details(url=u, links=F.transform(F.slice(generic, 1, SHOWN), lambda x: F.struct(x["anchor_text"].alias("anchor"), x["url"].alias("destination"))))),
        "canonical_not_self": (_say("Page has a canonical URL pointing to a different page: ", c("canonical")), _details(url=u, canonical_url=c("canonical"))),
        "missing_image_dimensions": (_say(c("shifting_images"), " images lack explicit width/height attributes — causes Cumulative Layout Shift"), _details(url=u, count=c("shifting_images"))), "missing_html_lang": plain("Missing lang attribute on <html> tag — hurts accessibility and SEO"),
        "no_aria_landmarks": (_say("Homepage has only ", c("landmark_count"), " ARIA landmark(s) — should have at least nav, main, header, footer"), _details(url=u, landmarks=c("landmarks"))),
        "missing_skip_nav": plain("No skip navigation link found — keyboard users cannot bypass repetitive navigation"), "no_resource_hints": plain("No preconnect or preload resource hints found despite multiple external resources", external_link_count=c("external_links")),
    }


def issue_rows(found: DataFrame) -> DataFrame:
    """(project_id, page_id, scan_id, issue_type, severity, description, details, fingerprint): a row for each issue of each page.

    found: `pagefacts.records`, and where known scan_id, title, headers (a map), redirect_chain (an array of addresses), readability, top_keyword,
    missing_labels, tabindex_misuse, plain_words and rendered_words, image_sizes (a map of bytes by source). Columns that are missing or null fire nothing.
    """
    types = {
        "scan_id": "long", "headers": "map<string,string>", "redirect_chain": "array<string>", "readability": "int", "top_keyword": "string", "missing_labels": "int", "tabindex_misuse": "int", "plain_words": "int", "rendered_words": "int", "image_sizes": "map<string,bigint>",
    }
    found = found.withColumns({n: F.lit(None).cast(t) for n, t in types.items() if n not in found.columns})
    found = found.withColumn("_ld", ld_problems(F.when(F.size("structured_data") > 0, F.col("structured_data"))))
    c, u = F.col, F.col("url")
    size = lambda i: F.try_element_at(c("image_sizes"), i["src"])
    big = F.filter("images", lambda i: size(i) > 200_000)
    lacking = F.filter(F.array(*[F.when(F.coalesce(F.try_element_at("headers", F.lit(h)), F.lit("")) == "", F.lit(label)) for h, label in MUST_HEADERS]), lambda x: x.isNotNull())
    hops = F.size("redirect_chain")
    gap = H.script_share(c("plain_words"), c("rendered_words"))
    bare = lambda a: F.regexp_replace(U.path(a), "/+$", "")
    odd = F.filter("hreflang", lambda t: (t["lang"] != "x-default") & ~t["lang"].rlike(LANG_CODE))
    langs = F.filter(
        F.array(
            F.when(~F.exists("hreflang", lambda t: U.is_url(t["url"]) & (bare(t["url"]) == bare(u))), F.lit("Missing self-referencing hreflang tag")), F.when(~F.exists("hreflang", lambda t: t["lang"] == "x-default"), F.lit("Missing x-default hreflang tag")),
            F.when(F.size(odd) > 0, _say("Invalid language codes: ", F.array_join(F.transform(odd, lambda t: t["lang"]), ", "))),
        ),
        lambda x: x.isNotNull(),
    )
    ld = F.size("_ld")
    more = {
        "invalid_structured_data": ("medium", ld > 0, _say("Structured data has ", ld, " issue(s): ", F.array_join(F.slice("_ld", 1, PROBLEMS_SHOWN), "; "), F.when(ld > PROBLEMS_SHOWN, _say(" (+", ld - PROBLEMS_SHOWN, " more)")).otherwise(F.lit(""))), _details(url=u, schema_types=c("schema_types"), issues=c("_ld"))),
        "oversized_images": ("medium", F.size(big) > 0, _say(F.size(big), " image(s) exceed 200 KB"), _details(url=u, images=F.transform(F.slice(big, 1, IMAGES_SHOWN), lambda i: F.struct(i["src"].alias("src"), F.floor(size(i) / 1024 + 0.5).alias("size_kb"), i["format"].alias("format"))))),
        "missing_security_headers": ("low", c("headers").isNotNull() & (F.size(lacking) > 0), _say("Missing security headers: ", F.array_join(lacking, ", ")), _details(url=u, missing_headers=lacking)),
        "redirect_chain": ("high", hops >= 3, _say("Redirect chain has ", hops, " hops, wasting crawl budget and slowing page load"), _details(url=u, chain=c("redirect_chain"), hop_count=hops)),
        "poor_readability": ("low", (c("readability") < 30) & (c("word_count") > 100), _say("Content readability is very low (Flesch score: ", c("readability"), "/100). Aim for 60-70 for web content."), _details(url=u, readability_score=c("readability"), word_count=c("word_count"))),
        "keyword_not_in_title": ("low", (F.trim("page_title") != "") & ~F.contains(F.lower("page_title"), F.lower("top_keyword")), _say('Top keyword "', c("top_keyword"), '" does not appear in the page title'), _details(url=u, top_keyword=c("top_keyword"), title=c("page_title"))),
        "hreflang_issues": ("medium", (F.size("hreflang") > 0) & (F.size(langs) > 0), F.array_join(langs, ". "), _details(url=u, issues=langs, tags=c("hreflang"))),
        "redirect_loop": ("critical", F.size(F.array_distinct("redirect_chain")) < hops, _say("Redirect loop detected — URL redirects back to itself"), _details(url=u, chain=c("redirect_chain"))),
        "missing_form_labels": ("medium", c("missing_labels") > 0, _say(c("missing_labels"), " form input(s) missing associated labels"), _details(url=u, count=c("missing_labels"))),
        "tabindex_misuse": ("low", c("tabindex_misuse") > 0, _say(c("tabindex_misuse"), " element(s) have positive tabindex values — disrupts natural tab order"), _details(url=u, count=c("tabindex_misuse"))),
        "js_rendering_dependency": ("high", gap > 50, _say(gap, "% of content is only visible with JavaScript (", c("plain_words"), " → ", c("rendered_words"), " words)"), _details(url=u, http_word_count=c("plain_words"), headless_word_count=c("rendered_words"), delta_percent=gap)),
    }
    texts = described(found)
    rules = {t: (s, F.expr(cond), *texts[t]) for t, s, cond in RULES if t != "hreflang_issues"} | more
    hits = F.array(*[F.when(F.coalesce(cond, F.lit(False)), F.struct(F.lit(t).alias("issue_type"), F.lit(s).alias("severity"), d.alias("description"), x.alias("details"))) for t, (s, cond, d, x) in rules.items()])
    rows = found.select("project_id", "page_id", "scan_id", F.explode_outer(F.filter(hits, lambda x: x.isNotNull())).alias("_i")).filter("_i IS NOT NULL").select("project_id", "page_id", "scan_id", "_i.*")
    return rows.withColumn("fingerprint", F.concat_ws(":", F.col("page_id").cast("string"), "issue_type", F.lit("")))
