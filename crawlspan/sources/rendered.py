"""Raw pages. Where a table of pages has no HTML, it is rendered from the columns it has, with tags that vary by page_id.

The rendering is one SQL expression that Spark and other engines read alike, so that both see the same pages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

EACH = {
    "spark": "coalesce(array_join(transform({column}, x -> concat('{before}', coalesce(x, ''), '{after}')), ''), '')",
    "duckdb": "coalesce(array_to_string(list_transform({column}, lambda x: concat('{before}', coalesce(x, ''), '{after}')), ''), '')",
}


def html_sql(dialect: str = "spark") -> str:
    """The expression that renders a row of pages."""
    each = lambda column, before, after: EACH[dialect].format(column=column, before=before, after=after)
    when = lambda n, k, then: f"CASE WHEN page_id % {n} = {k} THEN {then} ELSE '' END"
    text = lambda c: f"coalesce({c}, '')"
    parts = [
        "'<html'", "CASE WHEN page_id % 7 = 0 THEN '' ELSE ' lang=\"en\"' END", "'><head><title>'", text("title"), "'</title>'",
        when(3, 0, f"concat('<meta name=\"description\" content=\"', {text('meta_description')}, '\">')"), when(3, 1, f"concat('<meta content=\"', {text('meta_description')}, '\" name=\"description\">')"),
        "CASE WHEN canonical_url IS NULL THEN '' ELSE concat('<link rel=\"canonical\" href=\"', canonical_url, '\">') END", "CASE WHEN is_indexable THEN '' ELSE '<meta name=\"robots\" content=\"NOINDEX, nofollow\">' END",
        when(4, 0, f"concat('<meta property=\"og:title\" content=\"', {text('title')}, '\"><meta property=\"og:type\" content=\"article\">')"), when(5, 0, "'<meta name=\"twitter:card\" content=\"summary\">'"), when(6, 1, "'<meta name=\"viewport\" content=\"width=device-width\">'"),
        when(2, 0, "'<link rel=\"shortcut icon\" href=\"/favicon.ico\">'"), "'<link rel=\"stylesheet\" href=\"/main.css\"><script src=\"/_next/static/a.js\"></script><script>var a = 1 < 2;</script><style>p { color: red }</style>'",
        when(8, 0, "'<link rel=\"preconnect\" href=\"https://cdn.test\">'"), when(9, 0, "'<link rel=\"alternate\" hreflang=\"de\" href=\"/de\">'"), when(10, 0, "'<script src=\"http://cdn.test/b.js\"></script>'"),
        each("structured_data", '<script type="application/ld+json">', "</script>"), "'</head><body>'", when(3, 0, "'<nav><a href=\"#top\">Skip to content</a></nav>'"), when(4, 1, "'<main>'"), each("h1s", "<h1>", "</h1>"),
        when(5, 0, "'<h2>Details</h2>'"), when(5, 1, "'<h4>Deep</h4>'"), f"concat('<p>', {text('meta_description')}, '</p>')", "concat('<a href=\"/item/', CAST(page_id % 50 AS STRING), '?utm_source=x&b=2\">Read more</a>')",
        "'<a href=\"../up/./page/\" rel=\"nofollow noopener\"><b>Up</b></a><a href=\"mailto:info@site.test\">Mail</a>'", when(3, 2, "'<a href=\"https://other.test/x#part\">here</a>'"), when(4, 0, "'<img src=\"/a.jpg\" alt=\"A\" width=\"10\" height=\"20\">'"),
        when(2, 1, "'<img src=\"b.webp\" loading=\"lazy\">'"), when(6, 0, "'<form><input type=\"email\"><textarea></textarea></form>'"), when(7, 1, "'<div class=\"cookie-banner\">ok</div>'"), "'</body></html>'",
    ]
    sql = "concat(" + ", ".join(parts) + ")"
    return sql.replace("AS STRING", "AS VARCHAR") if dialect == "duckdb" else sql


def rendered(pages: DataFrame) -> DataFrame:
    """The pages with a column `html`."""
    return pages.selectExpr("*", f"{html_sql()} AS html")
