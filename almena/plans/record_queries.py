"""Queries over raw records and snapshots (problems 1 and 3)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from almena.operators.parse_errors import REASONS, edit_counts, parse_records, profile
from almena.operators.snapshots import snapshot_changes
from almena.session import table

WATCHED = ["status_code", "canonical", "is_indexable"]


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records that fail to parse, once each."""
    parsed = parse_records(table(spark, sf_dir, "dataset_record"), table(spark, sf_dir, "dataset"))
    return parsed.filter("NOT ok").select("record_id").distinct()


def p1_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records, loaded records and reasons per dataset."""
    return profile(parse_records(table(spark, sf_dir, "dataset_record"), table(spark, sf_dir, "dataset")))


def p1_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edits that state why records fail, per dataset and reason."""
    return edit_counts(parse_records(table(spark, sf_dir, "dataset_record"), table(spark, sf_dir, "dataset")))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """URLs added, removed or changed in each run that has a base run."""
    return snapshot_changes(table(spark, sf_dir, "crawled_page"), table(spark, sf_dir, "crawl_run"), WATCHED)


def p3_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of changes per run and kind."""
    return p3_found(spark, sf_dir).groupBy("crawl_run_id", "change_kind").agg(F.count("*").alias("urls"))


_P3_ROWS = """
WITH page AS (
  SELECT crawl_run_id, url, status_code, canonical, is_indexable FROM (
    SELECT *, row_number() OVER (PARTITION BY crawl_run_id, url ORDER BY fetched_at DESC, status_code DESC, canonical DESC, is_indexable DESC) AS rn
    FROM crawled_page) WHERE rn = 1),
run AS (SELECT crawl_run_id, base_run_id FROM crawl_run WHERE base_run_id IS NOT NULL),
now AS (SELECT r.crawl_run_id, p.url, p.status_code, p.canonical, p.is_indexable FROM run r JOIN page p ON p.crawl_run_id = r.crawl_run_id),
old AS (SELECT r.crawl_run_id, p.url, p.status_code, p.canonical, p.is_indexable FROM run r JOIN page p ON p.crawl_run_id = r.base_run_id),
change AS (
  SELECT coalesce(n.crawl_run_id, o.crawl_run_id) AS crawl_run_id, coalesce(n.url, o.url) AS url,
    CASE WHEN o.crawl_run_id IS NULL THEN 'added' WHEN n.crawl_run_id IS NULL THEN 'removed'
      WHEN n.status_code IS DISTINCT FROM o.status_code OR n.canonical IS DISTINCT FROM o.canonical OR n.is_indexable IS DISTINCT FROM o.is_indexable THEN 'changed' END AS change_kind
  FROM now n FULL JOIN old o ON n.crawl_run_id = o.crawl_run_id AND n.url = o.url)
"""

# The strict grammar for a one-character separator: cells quoted or not, then each cell without its quotes.
_P1 = r"""
WITH d AS (SELECT dataset_id, any_value(sep) AS sep, any_value(column_types) AS kinds, any_value(max_cell_length) AS longest FROM dataset GROUP BY 1),
r AS (SELECT DISTINCT record_id, dataset_id, raw FROM dataset_record WHERE trim(raw, ' ') <> ''),
j AS (SELECT r.*, d.sep, d.kinds, d.longest, '[^"' || CASE WHEN sep IN ('\', ']', '^', '-') THEN '\' || sep ELSE sep END || ']' AS plain, CASE WHEN sep IN ('|', '.', '*', '+', '?', '\', '^', '$') THEN '\' || sep ELSE sep END AS cut, '[^' || CASE WHEN sep IN ('\', ']', '^', '-') THEN '\' || sep ELSE sep END || ']' AS other FROM r JOIN d USING (dataset_id)),
g AS (SELECT *, '("(?:[^"]|"")*"|' || plain || other || '*)?' AS cell FROM j),
v AS (SELECT *, regexp_full_match(raw, cell || '(?:' || cut || cell || ')*') AS whole FROM g),
c AS (SELECT record_id, dataset_id, kinds, longest, whole, CASE WHEN whole THEN list_transform(regexp_extract_all(sep || raw, cut || cell, 1), lambda x: CASE WHEN x[1:1] = '"' THEN replace(x[2:-2], '""', '"') ELSE x END) END AS cells FROM v),
u AS (SELECT *, list_filter(range(1, least(len(cells), len(kinds)) + 1), lambda i: length(cells[i]) > longest) AS long, list_filter(range(1, least(len(cells), len(kinds)) + 1), lambda i: trim(cells[i], chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(160)) <> '' AND NOT CASE kinds[i]
    WHEN 'number' THEN regexp_full_match(trim(cells[i]), '-?[0-9]+([.,][0-9]+)?')
    WHEN 'boolean' THEN lower(trim(cells[i])) IN ('true', 'false', 'sí', 'si', 'no', 'yes')
    WHEN 'url' THEN regexp_full_match(trim(cells[i]), '(?i)https?://\S*')
    WHEN 'email' THEN regexp_full_match(trim(cells[i]), '[^@\s]+@[^@\s]+\.[^@\s]+')
    WHEN 'date' THEN regexp_full_match(trim(cells[i]), '[0-9]{4}-[0-9]{2}-[0-9]{2}') AND try_cast(trim(cells[i]) AS DATE) IS NOT NULL
    ELSE true END) AS wrong FROM c),
k AS (SELECT record_id, dataset_id, CASE WHEN NOT whole OR len(cells) <> len(kinds) THEN 'structure' WHEN len(long) > 0 AND (len(wrong) = 0 OR long[1] <= wrong[1]) THEN 'cell_too_long' WHEN len(wrong) > 0 THEN 'invalid_value' END AS reason FROM u)
"""

QUERIES = {"p1_found": p1_found, "p1_profile": p1_profile, "p1_edits": p1_edits, "p3_found": p3_found, "p3_counts": p3_counts}
SQL = {
    "p1_found": _P1 + "SELECT DISTINCT record_id FROM k WHERE reason IS NOT NULL",
    "p1_profile": _P1 + "SELECT dataset_id, count(*) AS records, count(*) FILTER (WHERE reason IS NULL) AS loaded, " + "count(*) FILTER (WHERE reason = 'structure') AS structure, " + ", ".join(f"count(*) FILTER (WHERE reason = '{r}') AS {r}" for r in REASONS[2:]) + " FROM k GROUP BY 1",
    "p3_found": _P3_ROWS + "SELECT crawl_run_id, url, change_kind FROM change WHERE change_kind IS NOT NULL",
    "p3_counts": _P3_ROWS + "SELECT crawl_run_id, change_kind, count(*) AS urls FROM change WHERE change_kind IS NOT NULL GROUP BY 1, 2",
}
