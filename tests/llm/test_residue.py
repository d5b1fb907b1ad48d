import os

import pytest

from crawlspan.llm import residue as R

OPTIONS = {"id": "i", "title": "t", "url": "u", "words": "w", "status": "s"}
YES = [
    "{{title}}", "Buy {{product.name}} online | Mill Shop", "%PRODUCT% in %CITY%", "<%= @title %>", "{0} - {1}", "[Your Title Here]", "__PAGE_TITLE__", ":product_title: · Mill Shop", "undefined", "[object Object]: Mill Shop", "NaN items", "%s", "Lorem ipsum dolor sit amet",
    "  xxxxx\n", "Untitled Document", "Hello world!", "TODO: title", "Insert headline here", "Titre de la page", "404 Not Found", "Mill Shop - 503 Service Temporarily Unavailable", "Oops! That page can’t be found", "PÁGINA NO ENCONTRADA", "La page 504 n’existe plus", "Fatal error: Call to a member function on null",
    "Just a moment...", "Please enable JavaScript to continue", "Checking your browser before accessing Mill Shop", "schakel javascript in", "JavaScript ist deaktiviert", "Cannot GET /item/4",
]
NO = [
    None, "", "  ", "-", "...", "How to Design a 404 Page That Keeps Visitors", "Mustache Templates: When to Write {{name}} or {{{name}}}", "Using %s and %d in Printf Strings", "What Lorem Ipsum Means and Where It Comes From", "Null Hypotheses for Busy Readers", "Page Not Found Messages That Made Us Smile",
    "JavaScript Required Reading: Ten Books", "Sample Pages From Our Autumn Catalogue", "Untitled: An Exhibition of Nameless Prints", "500 Errors in Handwriting and What They Teach", "Oak Kettle for Small Kitchens | Mill Shop", "100 % Wool & 50 % Off", "Mill Shop", "Just a Moment of Calm: Evening Tea Rituals", "Oak lamp " * 6_000,
]


@pytest.mark.parametrize("words", [20, 900, None])
def test_titles(spark, words):
    rows = [(i, t, f"https://mill-shop.test/item/oak-kettle-{i}", words if t in YES else (words or 900) + 500, 404, "clash") for i, t in enumerate(YES + NO)]
    df = spark.createDataFrame(rows, "i long, t string, u string, w int, s int, reason string")
    got = {r.i for r in R.residue(df.unionAll(df.limit(5)), **OPTIONS).collect()}
    assert [t for i, t in enumerate(YES) if i not in got] == [] and [NO[i - len(YES)] for i in got if i >= len(YES)] == []
    assert R.residue(df.limit(0), **OPTIONS).collect() == []


def test_host_evidence(spark):
    schema = "i long, t string, u string, w int, s int"
    rows = [(i, "Geht gerade nicht", f"https://shop-{i % 4}.test/item/oak-lamp-{i}", 12, 200) for i in range(8)]
    rows += [(i, "Oak Lamp", f"https://shop-{i % 4}.test/item/oak-lamp-{i}", 12, 200) for i in range(8, 16)]
    rows += [(i, "Unsere Lampen", f"https://shop-{i % 4}.test/item/oak-{i}", 12 if i % 2 else 400, 200) for i in range(16, 24)]
    rows += [(24, "Unsere Lampen", None, None, None)]
    got = {(r.i, r.reason) for r in R.residue(spark.createDataFrame(rows, schema), **OPTIONS).collect()}
    assert got == {(i, "repeated") for i in range(8)}


LONG = [
    "Folding Bicycle Pannier in Natural Dyes in {{city}} | Mirmark Market", "Sturdy Garden Bench Made to Order in Sotoverde | %SITENAME%", "Amber Drying Rack for Wet Climates in Gillsford | {{site.name}}", "How to Use {{product.name}} on Long Winter Walks", "Writing Desk with Ten-Year Guarantee in <%= city %>",
    "Portable Log Basket for Gardeners' Sheds, <city>", "Velvet Soup Ladle for Tea & Coffee in Sotoverde – $brand", "Lacquered Tent Pegs for Gardeners' Sheds in [location]", "Slate Knitting Kit with Lifetime Repair in undefined", "Copper Boot Tray with Soft Close, undefined", "Buy Your undefined Online with Free Returns", "Kettles and NaN Other Offers for Small Kitchens",
]
ABOUT = [
    "Mustache Templates: When to Write {{name}} or {{{name}}}", "Using %s and %d in Printf Strings", "Why Your Newsletter Opens with “Dear {{name}}”", "Undefined Behaviour in Old Firmware", "Null Hypotheses for Busy Readers", "Why undefined Is Not null in JavaScript Code: Checking for undefined", "What the <title> Tag Does for a Shop",
    "A Kettle for $30 and 20 % Off", "Second to None: Our Oldest Kettles", "Gifts for Nan and Grandad by Local Makers",
]


def test_placeholders_in_long_titles(spark):
    rows = [(i, t, f"https://mill-shop.test/item/oak-kettle-{i}", 900, 200) for i, t in enumerate(LONG + ABOUT)]
    got = {r.i for r in R.residue(spark.createDataFrame(rows, "i long, t string, u string, w int, s int"), **OPTIONS).collect()}
    assert [t for i, t in enumerate(LONG) if i not in got] == [] and [ABOUT[i - len(LONG)] for i in got if i >= len(LONG)] == []


def test_evidence_without_lists(spark, monkeypatch):
    """Messages that no list has are found by what speaks against their pages, and nothing else is."""
    for name in ("FILLER", "ERRORS", "NOTICES"):
        monkeypatch.setattr(R, name, ("(?!)",))
    monkeypatch.setattr(R, "MENTIONS", "(?!)")
    body = {"description": "d", "headings": "h"}
    schema = "i long, t string, u string, w int, s int, d string, h array<string>"
    goods = ("oak-lamp", "copper-kettle", "wool-blanket", "garden-bench")
    rows = [(i, t, f"https://shop-{i % 5}.test/item/{goods[i % 4]}-{i}", w, 200, "Meet the makers", [t, t[:6]]) for i, (t, w) in enumerate([("Hier klemmt etwas", 12), ("Zuzka 404 nenalezena", 60), ("Zuzka 500 nenalezena", 60)] * 10)]
    unseen = {r[0] for r in rows}
    rows += [(i, t, f"https://shop-{i % 5}.test/item/{goods[i % 4]}-{i}", w, 200, d, [t]) for i, (t, w, d) in enumerate([("Copper Kettle", 12, "x"), ("Why errors matter to us all", 900, "x"), ("Meet the makers", 40, "Come and meet the makers")] * 10, 100)]
    got = R.residue(spark.createDataFrame(rows, schema), **OPTIONS, **body).collect()
    assert {r.i for r in got} == unseen and {r.reason for r in got} == {"repeated"}


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="no test tables")
def test_recall_with_all_lists_hidden(spark, monkeypatch):
    from crawlspan.llm.queries import TITLE

    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet").select(*TITLE.values()).repartition(4)
    all_ = {r.page_id for r in R.residue(pages, **TITLE).collect()}
    for name in ("FILLER", "ERRORS", "NOTICES"):
        monkeypatch.setattr(R, name, ("(?!)",))
    monkeypatch.setattr(R, "MENTIONS", "(?!)")
    alone = {r.page_id for r in R.residue(pages, **TITLE).collect()}
    assert alone <= all_ and len(alone) >= 0.9 * len(all_)
