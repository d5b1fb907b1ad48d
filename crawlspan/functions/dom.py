"""Facts of a page that need its tree and not single tags, from static HTML: labels of form fields, roles, tab order, text
without hidden parts. What only a layout tells (places and sizes) is left out.

The tree is never built: one pass of the standard parser over each page keeps the open elements. Pages are handled in Arrow batches
where they lie.
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Landmark elements and roles, fields that need no label, elements that have no end, and words of consent notices.
ELEMENTS = ("nav", "main", "header", "footer", "aside")
ROLES = ("navigation", "main", "banner", "contentinfo", "complementary")
UNLABELLED = ("hidden", "submit", "button")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CONSENT = ("cookie", "consent", "gdpr", "onetrust", "cc-banner")
UNSEEN = frozenset(("script", "style", "noscript"))

SCHEMA = "title string, description string, lang string, words int, missing_labels int, landmarks array<string>, skip_link boolean, tabindex_misuse int, consent boolean"


class Reader(HTMLParser):
    """One page's facts."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[str] = []
        self.lang, self.consent, self.tab, self.skip = None, False, 0, False
        self.landmarks: list[str] = []
        self.fields: list[tuple[str | None, bool]] = []  # id, and whether it has a label of its own
        self.labelled: set[str] = set()
        self.metas: dict[str, str] = {}
        self.texts: dict[str, list[str]] = {"title": [], "h1": []}
        self.first: dict[str, str] = {}
        self.words = 0
        self.rest = ""
        self.anchor: list[str] | None = None

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        a = {k: v or "" for k, v in reversed(attrs)}  # the first of a repeated attribute counts
        self._flush()
        if tag == "html" and a.get("lang"):
            self.lang = self.lang or a["lang"]
        if tag == "meta":
            self.metas.setdefault((a.get("property") or a.get("name") or "").lower(), a.get("content", ""))
        if tag in ELEMENTS or a.get("role") in ROLES:
            name = a.get("role", "") if tag == "div" else tag
            if name not in self.landmarks:
                self.landmarks.append(name)
        number = a.get("tabindex", "").strip()
        if number.lstrip("+").isdigit() and int(number.lstrip("+")) > 0:
            self.tab += 1
        marks = f"{a.get('class', '')} {a.get('id', '')}".lower()
        self.consent = self.consent or any(w in marks for w in CONSENT)
        if tag == "label" and a.get("for"):
            self.labelled.add(a["for"])
        if tag in ("input", "select", "textarea") and not (tag == "input" and a.get("type", "").lower() in UNLABELLED):
            self.fields.append((a.get("id") or None, "label" in self.open or bool(a.get("aria-label") or a.get("aria-labelledby"))))
        if tag == "a":
            self.anchor = [] if a.get("href", "").startswith("#") else None
        if tag not in VOID:
            self.open.append(tag)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        self._flush()
        if tag == "a" and self.anchor is not None:
            text = "".join(self.anchor).lower()
            self.skip = self.skip or "skip" in text or "jump to" in text
            self.anchor = None
        if tag in self.open:
            while self.open.pop() != tag:
                pass
        if tag in self.texts and tag not in self.first and "".join(self.texts[tag]).strip():
            self.first[tag] = " ".join("".join(self.texts[tag]).split())

    def handle_data(self, data: str) -> None:
        here = self.open[-1] if self.open else ""
        for tag in ("title", "h1"):
            if tag in self.open and tag not in self.first:
                self.texts[tag].append(data)
        if self.anchor is not None:
            self.anchor.append(data)
        if here not in UNSEEN and not UNSEEN & set(self.open) and "head" not in self.open and here != "title":
            self.rest += data

    def _flush(self) -> None:
        """Elements part words."""
        if self.rest:
            self.words += len(self.rest.split())
            self.rest = ""

    def facts(self) -> dict:
        self._flush()
        get = lambda *names: next((self.metas[n] for n in names if self.metas.get(n, "").strip()), None)
        title = next((t for t in (self.first.get("title"), get("og:title"), get("twitter:title"), self.first.get("h1")) if t and len(t) >= 2), self.first.get("title"))
        missing = sum(1 for i, own in self.fields if not own and i not in self.labelled)
        return {
            "title": title, "description": get("description", "og:description", "twitter:description"), "lang": self.lang, "words": self.words, "missing_labels": missing,
            "landmarks": self.landmarks, "skip_link": self.skip, "tabindex_misuse": self.tab, "consent": self.consent,
        }


def read(html: str) -> dict:
    reader = Reader()
    reader.feed(html)
    reader.close()
    return reader.facts()


def static_facts(pages: DataFrame, id: str = "page_id", html: str = "html") -> DataFrame:
    """(id, title, description, lang, words, missing_labels, landmarks, skip_link, tabindex_misuse, consent): a row for each page.

    The title is the first of at least two characters of: title element, og:title, twitter:title, first h1; the description that of the
    meta tag, og: or twitter:. Words of scripts, styles, noscript and the head don't count. A null page has null facts, 0 and empty lists.
    """
    types = {"words": pa.int32(), "missing_labels": pa.int32(), "tabindex_misuse": pa.int32(), "landmarks": pa.list_(pa.string()), "skip_link": pa.bool_(), "consent": pa.bool_()}
    names = [x.split()[0] for x in SCHEMA.split(", ")]

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [read(h or "") for h in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array([r[n] for r in rows], types.get(n, pa.string())) for n in names]], names=["_id", *names])

    kind = pages.schema[id].dataType.simpleString()
    return pages.select(F.col(id).alias("_id"), F.col(html).alias("_html")).mapInArrow(of, f"_id {kind}, {SCHEMA}").withColumnRenamed("_id", id)
