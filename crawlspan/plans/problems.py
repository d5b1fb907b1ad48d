"""The queries of the general data problems (p2, p4, p5, p7) over the audit tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crawlspan.operators import hotkeys, nested, orphans, snapshots
from crawlspan.sources.tables import read


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Pages and issues that differ from the project's preceding completed SEO scan."""
    index = snapshots.snapshot_index(snapshots.completed(read(spark, d, "scans")))
    records = snapshots.page_records(read(spark, d, "page_history"), read(spark, d, "pages")).unionByName(snapshots.issue_records(read(spark, d, "issues")))
    found = snapshots.snapshot_changes(records, index, by=["entity", "record_key"])
    return found.select("entity", "project_id", "scan_id", "record_key", "change")


def p2_changes_by_scan(spark: SparkSession, d: str) -> DataFrame:
    """How many records each snapshot added, removed and changed."""
    return p2_found(spark, d).groupBy("entity", "project_id", "scan_id", "change").agg(F.count("*").alias("records"))


LINKS = {"value": "destination_url", "row_id": "link_id", "flag": "is_followed"}
LINK_KEYS = ["source_page_id", "project_id"]
LINK_COLUMNS = [*LINK_KEYS, *LINKS.values()]


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Source pages and projects that hold at least 2 % of the rows of page_links."""
    return hotkeys.hot_keys(read(spark, d, "page_links", *LINK_COLUMNS), LINK_KEYS, **LINKS)


def p4_link_results(spark: SparkSession, d: str) -> DataFrame:
    """Rows, links, distinct destinations and followed links of every source page and project."""
    return hotkeys.per_key(read(spark, d, "page_links", *LINK_COLUMNS), LINK_KEYS, **LINKS)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """References to pages that don't exist, no longer exist or came later."""
    refs = orphans.page_references(read(spark, d, "page_links"), read(spark, d, "issues"), read(spark, d, "backlinks"))
    parents = read(spark, d, "pages").select(F.col("page_id").alias("key"), "created_at")
    return orphans.orphans(refs, parents, read(spark, d, "page_history").select(F.col("page_id").alias("key")))


def p5_orphans_by_month(spark: SparkSession, d: str) -> DataFrame:
    """Orphan references counted per table, column, reason and month."""
    return p5_found(spark, d).groupBy("ref_table", "ref_field", "reason", "period").agg(F.count("*").alias("refs"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Every JSON object of structured_data and report with its parent."""
    return _objects(spark, d).select("source", "row_id", "node", "parent").distinct()


def _objects(spark: SparkSession, d: str) -> DataFrame:
    return nested.objects(nested.page_texts(read(spark, d, "pages", "page_id", "structured_data"), read(spark, d, "scan_scores", "scan_score_id", "report")))


def p7_tables(spark: SparkSession, d: str) -> DataFrame:
    """The flat tables that the records give, with their objects, distinct rows and keys."""
    found = _objects(spark, d).select("source", "row_id", "node", "table_path", F.map_keys("values").alias("k")).distinct()
    counts = found.groupBy("source", "table_path").agg(F.countDistinct("row_id", "node").alias("objects"), F.countDistinct("row_id").alias("records"))
    keys = found.select("source", "table_path", F.explode("k").alias("k")).distinct().groupBy("source", "table_path").agg(F.count("*").alias("keys"))
    return counts.join(keys, ["source", "table_path"], "left").select("source", "table_path", "objects", "records", F.coalesce("keys", F.lit(0)).alias("keys"))


def p7_offers(spark: SparkSession, d: str) -> DataFrame:
    """The flat table of offers, single and listed, with the keys that the data have."""
    return nested.flat_table(_objects(spark, d), "structured_data", "$|offers", "family")


def p7_checks(spark: SparkSession, d: str) -> DataFrame:
    """The flat tables of the checks of all categories in the reports, in one."""
    found = _objects(spark, d).filter("source = 'report' AND family RLIKE '^[$][|]categories[|][^|]+[|]checks$'")
    return nested.flat_table(found.withColumn("family", F.lit("checks")), "report", "checks", "family").withColumn("affectedUrls", F.array_join("affectedUrls", " "))


def p7_values(spark: SparkSession, d: str) -> DataFrame:
    """The flat tables of all paths, with every key and value of every object."""
    return _objects(spark, d).select("source", "table_path", "row_id", "node", "parent", "values")


QUERIES = {f.__name__: f for f in (p2_found, p2_changes_by_scan, p4_found, p4_link_results, p5_found, p5_orphans_by_month, p7_found, p7_tables, p7_offers, p7_checks, p7_values)}

_P2 = """
WITH snaps AS (
  SELECT scan_id, project_id, row_number() OVER (PARTITION BY project_id ORDER BY started_at, scan_id) - 1 AS idx,
         lead(scan_id) OVER (PARTITION BY project_id ORDER BY started_at, scan_id) AS nxt
  FROM scans WHERE scan_type = 'seo' AND status = 'completed'),
raw AS (
  SELECT 'page' AS entity, CAST(page_id AS VARCHAR) AS record_key, scan_id, recorded_at AS version, coalesce('=' || lower(content_hash), '-') AS value FROM page_history
  UNION ALL SELECT 'page', CAST(page_id AS VARCHAR), scan_id, scanned_at, coalesce('=' || lower(content_hash), '-') FROM pages
  UNION ALL SELECT 'issue', fingerprint, scan_id, updated_at,
    coalesce('=' || severity, '-') || '/' || coalesce(CAST(is_fixed AS VARCHAR), '-') || '/' || coalesce(CAST(dismissed AS VARCHAR), '-') || '/' ||
    coalesce(CASE WHEN json_valid(details) AND json_type(details) = 'OBJECT'
      THEN '=' || CAST(list_sort(list_transform(json_keys(details), lambda k: k || '=' || CAST(json_extract(details, '$."' || k || '"') AS VARCHAR))) AS VARCHAR)
      ELSE '=' || details END, '-')
  FROM issues WHERE fingerprint IS NOT NULL),
latest AS (
  SELECT entity, s.project_id, record_key, idx, s.scan_id, nxt, value FROM raw r JOIN snaps s ON r.scan_id = s.scan_id
  QUALIFY row_number() OVER (PARTITION BY entity, s.project_id, record_key, idx ORDER BY version DESC NULLS LAST, value DESC) = 1),
seen AS (
  SELECT *, lag(idx) OVER w AS before, lag(value) OVER w AS was, lead(idx) OVER w AS after
  FROM latest WINDOW w AS (PARTITION BY entity, project_id, record_key ORDER BY idx)),
changes AS (
  SELECT entity, project_id, scan_id, record_key, 'added' AS change FROM seen WHERE idx > 0 AND (before IS NULL OR before < idx - 1)
  UNION ALL SELECT entity, project_id, scan_id, record_key, 'changed' FROM seen WHERE before = idx - 1 AND was <> value
  UNION ALL SELECT entity, project_id, nxt, record_key, 'removed' FROM seen WHERE nxt IS NOT NULL AND (after IS NULL OR after > idx + 1))
"""
_P4 = """
WITH keyed AS (
  SELECT 'source_page_id' AS key_field, source_page_id AS key_value, * FROM page_links
  UNION ALL SELECT 'project_id', project_id, * FROM page_links)
"""
_P5 = """
WITH refs AS (
  SELECT 'page_links' AS ref_table, 'destination_page_id' AS ref_field, link_id AS ref_id, destination_page_id AS key, created_at AS seen FROM page_links
  UNION ALL SELECT 'page_links', 'source_page_id', link_id, source_page_id, created_at FROM page_links
  UNION ALL SELECT 'issues', 'page_id', issue_id, page_id, created_at FROM issues
  UNION ALL SELECT 'backlinks', 'page_id', backlink_id, page_id, created_at FROM backlinks),
found AS (
  SELECT DISTINCT ref_table, ref_field, ref_id,
    CASE WHEN p.page_id IS NOT NULL THEN 'late' WHEN key IN (SELECT page_id FROM page_history WHERE page_id IS NOT NULL) THEN 'deleted' ELSE 'missing' END AS reason,
    strftime(seen, '%Y-%m') AS period
  FROM refs LEFT JOIN pages p ON refs.key = p.page_id
  WHERE key IS NOT NULL AND (p.page_id IS NULL OR p.created_at > seen))
"""
WALK = """
WITH RECURSIVE texts AS (
  SELECT DISTINCT 'structured_data' AS source, page_id AS row_id, '$|' || (generate_subscripts(structured_data, 1) - 1) AS base, unnest(structured_data) AS x FROM pages
  UNION ALL SELECT DISTINCT 'report', scan_score_id, '$', report FROM scan_scores),
j AS (SELECT source, row_id, base, t.id, t.parent AS up, t.key, t.type, t.atom FROM (SELECT * FROM texts WHERE json_valid(x)), json_tree(x) AS t),
walk AS (
  SELECT source, row_id, base, id, type, atom, base AS node, '$' AS tab, '' AS owner, '$' AS owned, '' AS kp FROM j WHERE up IS NULL
  UNION ALL
  SELECT j.source, j.row_id, j.base, j.id, j.type, j.atom, w.node || '|' || j.key, w.tab || '|' || CASE WHEN w.type = 'ARRAY' THEN '*' ELSE j.key END,
    CASE WHEN w.type = 'OBJECT' THEN w.node ELSE w.owner END, CASE WHEN w.type = 'OBJECT' THEN w.tab ELSE w.owned END, CASE WHEN w.type = 'OBJECT' THEN j.key ELSE w.kp || '|' || j.key END
  FROM walk w JOIN j ON j.source = w.source AND j.row_id = w.row_id AND j.base = w.base AND j.up = w.id),
objects AS (SELECT DISTINCT source, row_id, node, owner AS parent, tab FROM walk WHERE type = 'OBJECT'),
vals AS (SELECT source, row_id, owner AS node, kp, regexp_replace(kp, '([|][0-9]+)+$', '') AS k, atom ->> '$' AS v, id FROM walk WHERE type NOT IN ('OBJECT', 'ARRAY') AND owner <> '')
"""
SQL = {
    "p7_found": WALK + "SELECT source, row_id, node, parent FROM objects",
    "p7_tables": WALK
    + """SELECT o.source, o.tab AS table_path, count(DISTINCT (o.row_id, o.node)) AS objects, count(DISTINCT o.row_id) AS records, count(DISTINCT kp) AS keys
    FROM objects o LEFT JOIN vals v ON o.source = v.source AND o.row_id = v.row_id AND o.node = v.node GROUP BY ALL""",
    "p7_offers": WALK
    + """SELECT o.source, o.row_id, o.node, o.parent, max(v) FILTER (k = '@type') AS "@type", max(v) FILTER (k = 'price') AS price, max(v) FILTER (k = 'priceCurrency') AS "priceCurrency"
    FROM objects o LEFT JOIN vals v ON o.source = v.source AND o.row_id = v.row_id AND o.node = v.node WHERE o.source = 'structured_data' AND replace(tab, '|*', '') = '$|offers' GROUP BY ALL""",
    "p7_checks": WALK
    + """SELECT o.source, o.row_id, o.node, o.parent, array_to_string(list(v ORDER BY v.id) FILTER (k = 'affectedUrls'), ' ') AS "affectedUrls", max(v) FILTER (k = 'id') AS id, max(v) FILTER (k = 'label') AS label,
      max(v) FILTER (k = 'passed') AS passed, max(v) FILTER (k = 'status') AS status, max(v) FILTER (k = 'total') AS total
    FROM objects o LEFT JOIN vals v ON o.source = v.source AND o.row_id = v.row_id AND o.node = v.node WHERE o.source = 'report' AND regexp_matches(replace(tab, '|*', ''), '^[$][|]categories[|][^|]+[|]checks$') GROUP BY ALL""",
    "p2_found": _P2 + "SELECT entity, project_id, scan_id, record_key, change FROM changes",
    "p2_changes_by_scan": _P2 + "SELECT entity, project_id, scan_id, change, count(*) AS records FROM changes GROUP BY ALL",
    "p4_found": _P4 + "SELECT key_field, key_value FROM keyed WHERE key_value IS NOT NULL GROUP BY ALL HAVING count(*) * 100 >= (SELECT count(*) FROM page_links) * 2",
    "p4_link_results": _P4
    + """SELECT key_field, key_value, count(*) AS rows, count(DISTINCT (coalesce(destination_url, '-'), link_id)) AS links, count(DISTINCT destination_url) AS distinct_values,
    count(DISTINCT CASE WHEN is_followed THEN (coalesce(destination_url, '-'), link_id) END) AS flagged FROM keyed WHERE key_value IS NOT NULL GROUP BY ALL""",
    "p5_found": _P5 + "SELECT * FROM found",
    "p5_orphans_by_month": _P5 + "SELECT ref_table, ref_field, reason, period, count(*) AS refs FROM found GROUP BY ALL",
}
