"""Facts and issues of pages. One pass over each page, no shuffle; the HTML is read for the facts and not carried on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlspan.functions import html as H
from crawlspan.functions import urls as U

# Anchor texts that say nothing.
GENERIC_ANCHORS = ("click here", "read more", "learn more", "here", "more", "link", "this")

# Each issue with its severity and the condition on a page's facts. Conditions that are null don't hold.
RULES = (
    ("server_error", "critical", "http_status BETWEEN 500 AND 599"),
    ("not_found", "critical", "http_status = 404"),
    ("missing_title", "high", "trim(coalesce(page_title, '')) = ''"),
    ("missing_meta_description", "high", "trim(coalesce(description, '')) = ''"),
    ("missing_h1", "high", "h1_count = 0"),
    ("multiple_h1", "high", "h1_count > 1"),
    ("title_too_long", "medium", "length(trim(page_title)) > 60"),
    ("title_too_short", "medium", "length(trim(page_title)) BETWEEN 1 AND 9"),
    ("meta_description_too_long", "medium", "length(trim(description)) > 160"),
    ("meta_description_too_short", "medium", "length(trim(description)) BETWEEN 1 AND 49"),
    ("thin_content", "medium", "word_count < 300 AND NOT noindex AND NOT utility"),
    ("missing_canonical", "medium", "coalesce(canonical, '') = ''"),
    ("noindex", "medium", "noindex"),
    ("missing_open_graph", "medium", "og_count = 0"),
    ("missing_twitter_card", "low", "twitter_count = 0"),
    ("missing_structured_data", "low", "schema_count = 0"),
    ("large_page_size", "low", "size_bytes > 3145728"),
    ("slow_page", "low", "load_time_ms > 3000"),
    ("missing_image_alt", "low", "images_without_alt > 0"),
    ("heading_hierarchy_invalid", "medium", "heading_gaps > 0"),
    ("missing_viewport_meta", "medium", "NOT viewport"),
    ("mixed_content", "high", "mixed_content"),
    ("url_structure_issues", "low", "url_issue_count > 0"),
    ("canonical_mismatch", "medium", "canonical IS NOT NULL AND NOT canonical_self"),
    ("missing_image_lazy_loading", "low", "image_count > 3 AND lazy_images = 0"),
    ("non_modern_image_format", "low", "image_count > 0 AND old_images * 2 > image_count"),
    ("hreflang_issues", "medium", "hreflang_count > 0 AND hreflang_default = 0"),
    ("non_descriptive_anchor_text", "low", "generic_anchors > 0"),
    ("canonical_not_self", "medium", "canonical IS NOT NULL AND NOT canonical_self AND http_status >= 200 AND http_status < 400"),
    ("missing_image_dimensions", "medium", "shifting_images > 3"),
    ("missing_html_lang", "medium", "homepage AND lang IS NULL"),
    ("no_aria_landmarks", "low", "homepage AND landmark_count < 2"),
    ("missing_skip_nav", "low", "homepage AND NOT skip_link"),
    ("no_resource_hints", "low", "homepage AND hint_count = 0 AND external_links > 3"),
)


#: Columns that other sources than the markup give, which records keep where pages have them.
CARRIED = ("scan_id", "headers", "redirect_chain", "readability", "top_keyword", "missing_labels", "tabindex_misuse", "plain_words", "rendered_words", "image_sizes", "depth", "platform", "script_gap", "seq")
LISTS = ("links", "images", "hreflang", "gaps", "url_issues", "landmarks", "script_srcs", "stylesheet_hrefs", "h1s", "h2s", "tags", "schema_types", "title", "structured_data")


def facts(pages: DataFrame) -> DataFrame:
    """One row of facts for each page with html; a null page gives a row whose facts are null or 0."""
    return records(pages).drop(*LISTS, *CARRIED)


def records(pages: DataFrame) -> DataFrame:
    """The facts with the lists behind them: links, images, hreflang, gaps, url_issues, landmarks, script_srcs, stylesheet_hrefs, h1s, h2s."""
    # The tags are cut out in a projection of their own, and each kind once.
    tagged = pages.withColumns({"_metas": H.tags_of(F.col("html"), "meta"), "_linked": H.tags_of(F.col("html"), "link"), "_imgs": H.tags_of(F.col("html"), "img"), "_scripts": H.tags_of(F.col("html"), "script"), "_headings": H.headings(F.col("html"))})
    h, u, metas, linked, imgs, heads = F.col("html"), F.col("url"), F.col("_metas"), F.col("_linked"), F.col("_imgs"), F.col("_headings")
    base = tagged.select(
        "page_id", "project_id", "url", "http_status", "word_count", "size_bytes", "load_time_ms", H.title(h).alias("page_title"), H.meta(metas, "description").alias("description"), F.size(F.filter(heads, lambda x: x["level"] == 1)).alias("h1_count"),
        U.is_utility(u).alias("utility"), H.canonical(linked).alias("canonical"), H.robots(metas, "noindex").alias("noindex"), F.size(F.map_keys(H.prefixed_meta(metas, "og"))).alias("og_count"), F.size(F.map_keys(H.prefixed_meta(metas, "twitter"))).alias("twitter_count"),
        F.size(F.coalesce("schema_types", F.array().cast("array<string>"))).alias("schema_count"), H.heading_gaps(heads).alias("gaps"), H.has_viewport(metas).alias("viewport"), H.has_mixed_content(h, u).alias("mixed_content"),
        U.url_issues(u).alias("url_issues"), H.links(h, u).alias("links"), H.images(imgs, u).alias("images"), H.shifting_images(imgs).alias("shifting_images"), H.hreflang_ordered(h).alias("hreflang"), H.language(h).alias("lang"),
        H.landmarks(h).alias("landmarks"), H.has_skip_link(h).alias("skip_link"), (F.size(H.hinted(linked, "preconnect")) + F.size(H.hinted(linked, "preload"))).alias("hint_count"), (U.path_depth(u) == 0).alias("homepage"),
        H.has_consent(h).alias("consent"), H.has_contact_form(h).alias("contact_form"), H.sources(F.col("_scripts")).alias("script_srcs"), H.stylesheets(linked).alias("stylesheet_hrefs"), F.size(H.json_ld(h)).alias("json_ld_count"), H.favicon(linked, u).alias("favicon"),
        *[F.transform(F.filter(heads, lambda x, n=n: x["level"] == n), lambda x: x["text"]).alias(f"h{n}s") for n in (1, 2)], F.concat(*[F.coalesce(F.to_json(H.prefixed_meta(metas, p)), F.lit("")) for p in ("og", "twitter")]).alias("tags"),
        F.coalesce("schema_types", F.array().cast("array<string>")).alias("schema_types"), F.coalesce("structured_data", F.array().cast("array<string>")).alias("structured_data"), F.col("title"),
        *[n for n in CARRIED if n in pages.columns],
    )
    count = lambda c, f: F.size(F.filter(c, f))
    return base.withColumns(
        {
            "heading_gaps": F.size("gaps"), "url_issue_count": F.size("url_issues"), "landmark_count": F.size("landmarks"), "js_count": F.size("script_srcs"), "css_count": F.size("stylesheet_hrefs"),
            "canonical_self": U.same_page(F.col("canonical"), u), "image_count": F.size("images"), "images_without_alt": count("images", lambda i: F.trim(i["alt"]) == ""), "lazy_images": count("images", lambda i: i["loading"] == "lazy"),
            "old_images": count("images", lambda i: ~i["format"].isin("webp", "avif", "svg")), "hreflang_count": F.size("hreflang"), "hreflang_default": count("hreflang", lambda t: t["lang"] == "x-default"),
            "generic_anchors": count("links", lambda x: F.lower(F.trim(x["anchor_text"])).isin(*GENERIC_ANCHORS)), "internal_links": count("links", lambda x: x["internal"]), "external_links": count("links", lambda x: ~x["internal"]),
        }
    )


def issues(found: DataFrame) -> DataFrame:
    """(project_id, page_id, issue_type, severity): a row for each rule that a page's facts meet."""
    hits = F.array(*[F.when(F.expr(f"coalesce({cond}, false)"), F.struct(F.lit(t).alias("issue_type"), F.lit(s).alias("severity"))) for t, s, cond in RULES])
    # An outer explode: for an inner one the optimizer adds a filter that computes all facts a second time.
    return found.select("project_id", "page_id", F.explode_outer(F.filter(hits, lambda x: x.isNotNull())).alias("_i")).filter("_i IS NOT NULL").select("project_id", "page_id", "_i.issue_type", "_i.severity")
