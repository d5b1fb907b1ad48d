"""Deeply nested JSON to related flat tables.

A record's text is read token by token, in one pass and without recursion, into path-value-ordinal triples. A path whose array
positions are replaced by `*` names the table of an object: objects below one repeated ancestor share it; without the `*` it names
the table's family, in which single and listed objects of one kind meet. Every object knows its node (its path with positions), its
parent's node and its row. A record's triples are grouped and pivoted to one row for each object while they are read (`objects`), so
nothing is shuffled for it; `flat_table` then gives any table or family with a column for each of its keys, and `flat_tables` writes
all of them, both with keys found in the data.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OBJECT = "source string, row_id long, node string, parent string, table_path string, family string, `values` map<string, struct<kind: string, value: string>>"
#: Keys that a table's pivot may have as columns; more are refused, as they then are data and not names.
KEYS_MOST = 5_000
#: Triples whose objects make one batch that goes back to the JVM.
BATCH = 20_000

TOKEN = re.compile(
    r"[ \t\n\r]*(?:([{}\[\],:])"
    r'|("[^"\\\x00-\x1f]*(?:\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4})[^"\\\x00-\x1f]*)*")'
    r"|(-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?)|(true|false|null))"
)
END = re.compile(r"[ \t\n\r]*\Z")


def _string(token: str) -> str:
    """The text that a JSON string stands for; halves of surrogate pairs become U+FFFD."""
    if "\\" not in token:
        return token[1:-1]
    text = json.loads(token)
    return text.encode("utf-8", "replace").decode() if re.search("[\ud800-\udfff]", text) else text


def triples(text: str, root: str = "$") -> list[tuple] | None:
    """(node, parent, table, key, ordinal, kind, value) for each object (kind `object`) and each scalar, or None if not JSON.

    An object's own row has its node, the nearest enclosing object's node and its table; key, ordinal and value are null. A
    scalar's row has the node of the object that it belongs to, key (nested arrays add their positions) and ordinal, its
    position in the innermost array (null outside arrays); strings have their text as value, others their JSON text. A scalar
    outside any object has the root as node. A repeated key gives its values again.
    """
    out: list[tuple] = []
    # Steps of the current path and of its table; a frame is an open object or array: is it an object, its position so far,
    # and what it is or is in: node, table, and number of steps. Paths are joined only where a row needs them.
    steps, tables, stack = [root], ["$"], []
    pos, wanted = 0, "value"
    owner, owned, depth, ordinal = "", "$", 1, None
    match = TOKEN.match
    while True:
        if wanted == "after" and not stack:
            return out if END.match(text, pos) else None
        m = match(text, pos)
        if m is None:
            return None
        pos, which = m.end(), m.lastindex
        token = m.group(which)
        if wanted in ("value", "value or ]"):
            if which == 1:
                if token == "{":
                    path, table = "|".join(steps), "|".join(tables)
                    out.append((path, owner, table, None, None, "object", None))
                    owner, owned, depth = path, table, len(steps)
                    stack.append((True, [0], owner, owned, depth))
                    wanted = "key or }"
                    continue
                if token == "[":
                    stack.append((False, [0], owner, owned, depth))
                    steps.append("0")
                    tables.append("*")
                    ordinal, wanted = 0, "value or ]"
                    continue
                if token != "]" or wanted == "value":
                    return None
                stack.pop()
                steps.pop()
                tables.pop()
            else:
                kind = ("", "", "string", "number", "word")[which]
                out.append((owner or root, None, owned, "|".join(steps[depth:]), ordinal, kind, _string(token) if which == 2 else token))
            wanted = "after"
        elif wanted == "after":
            if which != 1:
                return None
            is_object, at, owner, owned, depth = stack[-1]
            if token == ",":
                if is_object:
                    steps.pop()
                    tables.pop()
                    wanted = "key"
                else:
                    at[0] += 1
                    ordinal, wanted = at[0], "value"
                    steps[-1] = str(ordinal)
            elif token == ("}" if is_object else "]"):
                stack.pop()
                steps.pop()
                tables.pop()
            else:
                return None
        else:  # a key, or the end of an empty object
            if which == 1 and token == "}" and wanted == "key or }":
                stack.pop()
                wanted = "after"
                continue
            if which != 2:
                return None
            key = _string(token)
            m = match(text, pos)
            if m is None or m.group(1) != ":":
                return None
            pos, ordinal, wanted = m.end(), None, "value"
            steps.append(key)
            tables.append(key)


def _pivot(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each text's triples, grouped by the object that they belong to and pivoted to a map of its keys."""
    kept = pa.struct([("kind", pa.string()), ("value", pa.string())])
    types = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.map_(pa.string(), kept)]
    names = ["source", "row_id", "node", "parent", "table_path", "family", "values"]
    families: dict[str, str] = {}
    held: list[tuple] = []
    n = 0

    def write() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names=names)

    for b in batches:
        for source, row_id, root, text in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
            found = triples(text, root) or ()
            values: dict[str, dict[str, tuple[str, str]]] = {}
            for node, _, _, key, _, kind, value in found:
                if kind == "object":
                    values.setdefault(node, {})
                else:
                    own = values.setdefault(node, {})
                    old = own.get(key)
                    if old is None or (value, kind) > old:
                        own[key] = (value, kind)
            for node, parent, table, _, _, kind, _ in found:
                if kind == "object":
                    if len(families) > 10_000:
                        families.clear()
                    family = families.get(table) or families.setdefault(table, "|".join(x for x in table.split("|") if x != "*"))
                    pairs = values.pop(node, None)
                    if pairs is not None:  # a repeated key may give an object's node twice
                        held.append((source, row_id, node, parent, table, family, [(k, {"kind": kind_, "value": v}) for k, (v, kind_) in sorted(pairs.items())]))
                        n += 1 + len(pairs)
            if n >= BATCH:
                yield write()
                held.clear()
                n = 0
    if held:
        yield write()


def objects(texts: DataFrame) -> DataFrame:
    """(source, row_id, node, parent, table_path, family, values) of every object of (source, row_id, root, text).

    `values` has the kind and text of all its scalars; an empty object has an empty map, scalars outside any object are in no
    row. Of a repeated key the largest text counts. Null texts and texts that aren't JSON as a whole, or hold no object, give nothing.
    A text that stands in several rows gives its objects as often.
    """
    rows = texts.select("source", F.col("row_id").cast("long").alias("row_id"), "root", "text").filter("contains(text, '{')")
    return rows.mapInArrow(_pivot, OBJECT)


POSITIONS = r"([|][0-9]+)+$"


def table_keys(found: DataFrame, by: str = "table_path") -> DataFrame:
    """(source, table, keys): of each table (or `family`) the (key, listed) that its objects have, in order; listed: an array of scalars
    in some object. Aggregated map-side."""
    keys = found.select("source", F.col(by).alias("table"), F.explode_outer(F.map_keys("values")).alias("key")).distinct()
    named = keys.groupBy("source", "table", F.regexp_replace("key", POSITIONS, "").alias("name")).agg(F.max(F.col("key").rlike(POSITIONS)).alias("listed"))
    pairs = F.filter(F.array_sort(F.collect_list(F.struct(F.col("name").alias("key"), "listed"))), lambda x: x["key"].isNotNull())
    return named.groupBy("source", "table").agg(pairs.alias("keys"))


def _listed(name: str) -> Column:
    """The texts of `name`, one or an array of them at any depth, in order; null if there are none."""
    mine = F.filter(F.map_entries("values"), lambda e: F.regexp_replace(e["key"], POSITIONS, "") == name)
    at = lambda k: F.transform(F.filter(F.split(F.substring(k, F.lit(len(name) + 1), F.length(k)), "[|]"), lambda x: x != ""), lambda x: x.cast("int"))
    texts = F.transform(F.array_sort(F.transform(mine, lambda e: F.struct(at(e["key"]).alias("at"), e["value"]["value"].alias("v")))), lambda x: x["v"])
    return F.when(F.size(texts) > 0, texts)


def flat_table(found: DataFrame, source: str, name: str, by: str = "table_path", keys: list | None = None) -> DataFrame:
    """The flat table (or family) `name`: source, row_id, node, parent and a column for each key, null where an object lacks it.

    Keys are found in the data unless given (as texts, or with a flag as in `table_keys`). A column has the scalar's text, or, where
    any object has an array of scalars under the key, the array of their texts. Columns are named like the keys, with `key_`
    before those that clash with the four of the object or, but for letter case, with an earlier one.
    """
    own = found.filter((F.col("source") == source) & (F.col(by) == name))
    if keys is None:
        rows = table_keys(own, by).select(F.slice("keys", 1, KEYS_MOST + 1)).collect()
        keys = rows[0][0] if rows else []
        if len(keys) > KEYS_MOST:
            raise ValueError(f"{name} has more than {KEYS_MOST} keys; take its `values`")
    used, columns = {"source", "row_id", "node", "parent"}, []
    for k, listed in ((x, False) if isinstance(x, str) else x for x in keys):
        label = k
        while label.lower() in used:
            label = f"key_{label}"
        used.add(label.lower())
        columns.append((_listed(k) if listed else F.try_element_at("values", F.lit(k))["value"]).alias(label))
    return own.select("source", "row_id", "node", "parent", *columns).distinct()


def flat_tables(found: DataFrame, folder: str, by: str = "family") -> list[tuple[str, str, str]]:
    """Writes every table (or family) as Parquet below `folder`; (source, table, path) of each. There are as many as kinds of objects."""
    found = found.persist()
    try:
        out = []
        for r in table_keys(found, by).orderBy("source", "table").toLocalIterator():
            path = f"{folder}/{r['source']}/{len(out):05d}"
            flat_table(found, r["source"], r["table"], by, r["keys"]).write.mode("overwrite").parquet(path)
            out.append((r["source"], r["table"], path))
        return out
    finally:
        found.unpersist()


def json_nodes(texts: DataFrame) -> DataFrame:
    """The objects as distinct (source, row_id, node, parent)."""
    return objects(texts).select("source", "row_id", "node", "parent").distinct()


def page_texts(pages: DataFrame, scores: DataFrame) -> DataFrame:
    """The JSON texts of the audit tables: each block of structured_data, and each report."""
    blocks = pages.select(F.col("page_id").alias("row_id"), F.posexplode("structured_data").alias("at", "text"))
    return blocks.select(F.lit("structured_data").alias("source"), "row_id", F.concat(F.lit("$|"), F.col("at").cast("string")).alias("root"), "text").unionByName(
        scores.select(F.lit("report").alias("source"), F.col("scan_score_id").alias("row_id"), F.lit("$").alias("root"), F.col("report").alias("text"))
    )
