"""Merging new results into kept tables: upsert, and the reconciliation of issues over scans. Both are one full outer join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def upsert(kept: DataFrame, new: DataFrame, keys: list[str], preserve: tuple[str, ...] = ()) -> DataFrame:
    """The rows of `new`, and those of `kept` that it doesn't replace; of both, columns in `preserve` stay as they were. Null-safe keys."""
    columns = kept.columns
    a, b = kept.alias("a"), new.alias("b")
    on = None
    for k in keys:
        same = F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
        on = same if on is None else on & same
    rows = a.withColumn("_a", F.lit(True)).join(b.withColumn("_b", F.lit(True)), on, "full_outer")
    old, fresh = lambda c: F.col(f"a.{c}"), lambda c: F.col(f"b.{c}")
    pick = lambda c: F.when(F.col("_b").isNull() | (F.lit(c in preserve) & F.col("_a").isNotNull()), old(c)).otherwise(fresh(c)).alias(c)
    return rows.select(*[pick(c) for c in columns])


def reconcile(kept: DataFrame, now: DataFrame, crawled: DataFrame, at: Column) -> DataFrame:
    """Issues after a scan. kept: project_id, page_id, fingerprint, is_fixed, seen_count, created_at, fixed_at. now: project_id,
    page_id, fingerprint. crawled: page_id.

    state is `new`, `persisting` (seen once more, open again), `resolved` (absent now though its page was crawled) or
    `untouched`. Null fingerprints are dropped; repeats of one count once.
    """
    a = kept.filter("fingerprint IS NOT NULL").dropDuplicates(["project_id", "fingerprint"]).alias("a")
    b = now.filter("fingerprint IS NOT NULL").groupBy("project_id", "fingerprint").agg(F.max("page_id").alias("page_id")).alias("b")
    seen = crawled.select(F.col("page_id").alias("_crawled")).distinct()
    rows = a.join(b, (F.col("a.project_id") == F.col("b.project_id")) & (F.col("a.fingerprint") == F.col("b.fingerprint")), "full_outer").join(seen, F.col("a.page_id") == F.col("_crawled"), "left")
    was, is_ = F.col("a.fingerprint").isNotNull(), F.col("b.fingerprint").isNotNull()
    solved = was & ~is_ & ~F.coalesce(F.col("a.is_fixed"), F.lit(False)) & F.col("_crawled").isNotNull()
    return rows.select(
        F.coalesce("a.project_id", "b.project_id").alias("project_id"), F.coalesce("b.page_id", "a.page_id").alias("page_id"), F.coalesce("a.fingerprint", "b.fingerprint").alias("fingerprint"),
        F.when(is_, False).when(solved, True).otherwise(F.col("a.is_fixed")).alias("is_fixed"), F.when(was & is_, F.coalesce("a.seen_count", F.lit(1)) + 1).when(is_, 1).otherwise(F.col("a.seen_count")).alias("seen_count"),
        F.coalesce("a.created_at", at).alias("created_at"), F.when(is_, None).when(solved, at).otherwise(F.col("a.fixed_at")).alias("fixed_at"),
        F.when(was & is_, "persisting").when(is_, "new").when(solved, "resolved").otherwise("untouched").alias("state"),
    )


def reconcile_last(issues: DataFrame, scans: DataFrame, pages: DataFrame) -> DataFrame:
    """The issues of each project's last scan reconciled with those of the scan before: the rows of `reconcile`, and scan_id.

    scans: the scans that count, with project_id, scan_id, started_at and completed_at. pages: (scan_id, page_id) that were crawled. Of
    several rows of an issue in the earlier scan the one updated last counts. New issues are created, and resolved ones fixed, when the
    last scan ended, or began if its end isn't known. A project's only scan gives new issues.
    """
    w = Window.partitionBy("project_id").orderBy(F.col("started_at").desc_nulls_last(), F.col("scan_id").desc())
    index = scans.groupBy("project_id", "scan_id").agg(F.max("started_at").alias("started_at"), F.max("completed_at").alias("completed_at")).withColumn("_back", F.row_number().over(w))
    last = index.filter("_back = 1").select("project_id", "scan_id", F.coalesce("completed_at", "started_at").alias("_at"))
    of = lambda back: issues.drop("project_id").join(index.filter(F.col("_back") == back).select("project_id", "scan_id"), "scan_id").filter("fingerprint IS NOT NULL")
    state = ["page_id", "is_fixed", "seen_count", "created_at", "fixed_at"]
    kept = of(2).groupBy("project_id", "fingerprint").agg(F.max(F.struct("updated_at", *state)).alias("_r")).select("project_id", "fingerprint", *[f"_r.{c}" for c in state])
    crawled = pages.join(last.select("scan_id"), "scan_id", "left_semi").select("page_id")
    found = reconcile(kept, of(1), crawled, F.lit(None).cast(issues.schema["created_at"].dataType)).join(last, "project_id")
    return found.withColumns({"created_at": F.coalesce("created_at", "_at"), "fixed_at": F.when(F.col("state") == "resolved", F.col("_at")).otherwise(F.col("fixed_at"))}).drop("_at")


def latest_pages(history: DataFrame, scans: DataFrame) -> DataFrame:
    """The row of each page's latest scan in the history, however late it was recorded; of several in one scan the one recorded last."""
    began = scans.groupBy("scan_id").agg(F.max("started_at").alias("_began"))
    rows = history.join(began, "scan_id", "left").select("project_id", "page_id", F.struct("_began", F.col("scan_id").alias("_scan"), "recorded_at", *[F.col(c).alias(f"_{c}") for c in history.columns]).alias("_r"))
    return rows.groupBy("project_id", "page_id").agg(F.max("_r").alias("_r")).select(*[F.col(f"_r._{c}").alias(c) for c in history.columns])


def next_month(day: Column) -> Column:
    """A month later by the calendar's count of days: the 31st of January gives the 2nd or 3rd of March."""
    return F.date_add(F.add_months(F.trunc(day, "month"), 1), F.dayofmonth(day) - 1)


def json_merged(old: Column, new: Column) -> Column:
    """Two JSON objects as one, in which a key of the right one wins; keys in order. What isn't a JSON object counts as an empty one."""
    parsed = lambda c: F.coalesce(F.try_variant_get(F.try_parse_json(c), "$", "map<string,variant>"), F.create_map().cast("map<string,variant>"))
    pairs = lambda c: F.map_entries(parsed(c))
    kept = F.filter(pairs(old), lambda e: ~F.array_contains(F.map_keys(parsed(new)), e["key"]))
    every = F.concat(kept, pairs(new))
    names = F.array_sort(F.transform(every, lambda e: e["key"]))
    # Values are variants, which have no order, so they are looked up by their sorted names.
    quoted = lambda n: F.substring(F.to_json(F.array(n)), F.lit(2), F.length(F.to_json(F.array(n))) - 2)
    texts = F.transform(names, lambda n: F.concat(quoted(n), F.lit(":"), F.to_json(F.get(F.filter(every, lambda e: e["key"] == n), 0)["value"])))
    return F.concat(F.lit("{"), F.array_join(texts, ","), F.lit("}"))


def replaced(kept: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of `new`, and those of `kept` whose keys `new` has nowhere: what a partial crawl writes over the rows of the sources it saw."""
    on = [kept[k].eqNullSafe(F.col(f"_n_{k}")) for k in keys]
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    return kept.join(new.select(*[F.col(k).alias(f"_n_{k}") for k in keys]).distinct(), cond, "left_anti").select(*new.columns).unionByName(new)


def snapshots(scans: DataFrame, issues: DataFrame, pages: DataFrame, links: DataFrame, scores: DataFrame) -> DataFrame:
    """(scan_id, project_id, critical, high, medium, low, pages, indexable, broken_links, score): the state of each scan.

    Issues count for their own scan, repeats of an id once, a null severity as low, unknown ones not at all. Pages count by their scan, those of web
    addresses only; links by the scan of their source page. A score is kept between 0 and 100, null without one.
    """
    kinds = ("critical", "high", "medium", "low")
    found = issues.select("scan_id", "issue_id", F.coalesce("severity", F.lit("low")).alias("severity")).distinct().groupBy("scan_id").agg(*[F.count(F.when(F.col("severity") == k, 1)).alias(k) for k in kinds])
    web = pages.filter(F.col("url").like("http%"))
    counts = web.groupBy("scan_id").agg(F.count("*").alias("pages"), F.count(F.when(F.col("is_indexable"), 1)).alias("indexable"))
    broken = links.filter("is_broken").select("link_id", "source_page_id").distinct().join(pages.select(F.col("page_id").alias("source_page_id"), "scan_id"), "source_page_id").groupBy("scan_id").agg(F.count("*").alias("broken_links"))
    best = scores.groupBy("scan_id").agg(F.max_by("overall", "scan_score_id").alias("score"))
    rows = scans.select("scan_id", "project_id").distinct().join(found, "scan_id", "left").join(counts, "scan_id", "left").join(broken, "scan_id", "left").join(best, "scan_id", "left")
    return rows.select("scan_id", "project_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in (*kinds, "pages", "indexable", "broken_links")], F.least(F.lit(100), F.greatest(F.lit(0), F.col("score"))).alias("score"))


def unscored(scans: DataFrame, scores: DataFrame) -> DataFrame:
    """(project_id, scan_id): each project's latest completed scan, if it has no score yet."""
    last = scans.groupBy("project_id").agg(F.max_by("scan_id", F.struct(F.coalesce("completed_at", "started_at"), "scan_id")).alias("scan_id"))
    return last.join(scores.select("scan_id").distinct(), "scan_id", "left_anti").select("project_id", "scan_id")


# What a page record has where nothing was seen.
DEFAULTS = {"http_status": 0, "depth": 0, "title": "", "meta_description": "", "content_length": 0, "word_count": 0, "size_bytes": 0, "load_time_ms": 0, "first_byte_time_ms": 0, "is_indexable": True, "js_count": 0, "css_count": 0}
EMPTY_LISTS = ("h1s", "h2s", "structured_data", "schema_types", "images", "internal_links", "external_links", "errors", "script_srcs", "stylesheet_hrefs")


def defaulted(pages: DataFrame) -> DataFrame:
    """Page records without nulls where a record has a default: stored rows as records."""
    types = dict(pages.dtypes)
    filled = {n: F.coalesce(F.col(n), F.lit(v).cast(types[n])) for n, v in DEFAULTS.items() if n in types}
    filled |= {n: F.coalesce(F.col(n), F.array().cast(types[n])) for n in EMPTY_LISTS if n in types}
    return pages.withColumns(filled) if filled else pages


def blanked(pages: DataFrame, challenged: Column, ip: Column) -> DataFrame:
    """Records of challenge pages without the challenge's own text: title null, words and length 0, and an error that says so, with the address blocked."""
    said = F.concat(F.lit("Blocked by bot protection / WAF challenge page"), F.coalesce(F.concat(F.lit(" (blocked IP "), ip, F.lit(")")), F.lit("")))
    hit = F.coalesce(challenged, F.lit(False))
    new = {"title": F.when(~hit, F.col("title")), "word_count": F.when(hit, 0).otherwise(F.col("word_count")), "content_length": F.when(hit, 0).otherwise(F.col("content_length"))}
    errors = F.coalesce("errors", F.array().cast("array<string>"))
    return pages.withColumns(new | {"errors": F.when(hit, F.concat(errors, F.array(said))).otherwise(errors)})


def better(plain: DataFrame, rendered: DataFrame) -> DataFrame:
    """Of records by plain request and by browser (url, status, title, words, poor) the one that counts, and the percent of words only scripts bring.

    A browser's record counts if the plain one is poor and it answered with a title.
    """
    a, b = plain.alias("a"), rendered.alias("b")
    usable = F.coalesce(F.col("a.poor") & F.col("b.status").between(200, 399) & (F.length("b.title") > 0), F.lit(False))
    gap = F.when(F.col("b.words") > 0, F.floor((F.col("b.words") - F.coalesce("a.words", F.lit(0))) / F.col("b.words") * 100 + 0.5)).otherwise(0).cast("int")
    pick = lambda c: F.when(usable, F.col(f"b.{c}")).otherwise(F.col(f"a.{c}")).alias(c)
    return a.join(b, F.col("a.url") == F.col("b.url"), "left").select("a.url", F.when(usable, "headless").otherwise("http").alias("scan_method"), pick("status"), pick("title"), pick("words"), F.when(usable & (gap > 20), gap).alias("script_gap"))


def write_replacing(spark: SparkSession, new: DataFrame, path: str, keys: list[str]) -> None:
    """Writes `new` over the rows of the Parquet table at `path` that have its keys. The table's next version is written beside it and then takes
    its place in one rename, so that readers and repeated writes see a whole one."""
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    rows = replaced(spark.read.parquet(path), new, keys) if fs.exists(target) else new
    rows.write.mode("overwrite").parquet(f"{path}.next")
    if fs.exists(target):
        fs.delete(target, True)
    fs.rename(jvm.org.apache.hadoop.fs.Path(f"{path}.next"), target)
