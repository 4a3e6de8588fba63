"""The driver's queries: one per operator, with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import golden_queries as golden
from . import reference_queries as reference
from .common import table
from .operators import orphans, snapshots
from .sqltext import sql_month, sql_norm, sql_stem, sql_trim

Query = Callable[[SparkSession, str], DataFrame]

P1_SQL = f"""
WITH refs AS (
  SELECT 'notes' AS tbl, vault, strftime(make_timestamp(mtime_ms * 1000), '%Y-%m') AS ym, note_id AS row_id, unnest(out_links) AS raw
  FROM notes
  UNION ALL
  SELECT 'edits', vault, {sql_month("ts")}, edit_id, path FROM edits),
r AS (
  SELECT DISTINCT tbl, vault, ym, row_id, {sql_trim("raw")} AS target, {sql_norm("raw")} AS name
  FROM refs WHERE raw IS NOT NULL AND (tbl = 'edits' OR {sql_trim("raw")} <> '')),
n AS (
  SELECT vault, {sql_norm("path")} AS path, {sql_norm("title")} AS title,
         list_transform(aliases, lambda a: {sql_norm("a")}) AS aliases,
         {sql_month("added")} AS from_ym, {sql_month("removed")} AS to_ym
  FROM notes),
names AS (
  SELECT 'path' AS kind, vault, path AS name, from_ym, to_ym FROM n
  UNION SELECT 'stem', vault, {sql_trim(sql_stem("path"))}, from_ym, to_ym FROM n
  UNION SELECT 'title', vault, title, from_ym, to_ym FROM n
  UNION SELECT 'title', vault, unnest(aliases), from_ym, to_ym FROM n),
probes AS (
  SELECT *, 'path' AS kind, name AS probe FROM r
  UNION ALL SELECT *, 'path', name || '.md' FROM r WHERE tbl = 'notes'
  UNION ALL SELECT *, 'stem', {sql_trim(sql_stem("name"))} FROM r WHERE tbl = 'notes'
  UNION ALL SELECT *, 'title', name FROM r WHERE tbl = 'notes'),
found AS (
  SELECT DISTINCT p.tbl, p.ym, p.row_id, p.target
  FROM probes p JOIN names n ON n.kind = p.kind AND n.vault = p.vault AND n.name = p.probe
   AND n.from_ym <= p.ym AND (n.to_ym IS NULL OR n.to_ym > p.ym))
SELECT DISTINCT tbl, ym, row_id, target FROM r
EXCEPT SELECT tbl, ym, row_id, target FROM found"""

P1_REPORT_SQL = f"""
WITH refs AS (
  SELECT 'notes' AS tbl, vault, strftime(make_timestamp(mtime_ms * 1000), '%Y-%m') AS ym, unnest(out_links) AS raw FROM notes
  UNION ALL
  SELECT 'edits', vault, {sql_month("ts")}, path FROM edits),
r AS (
  SELECT tbl, vault, ym, {sql_norm("raw")} AS name, count(*) AS n_refs
  FROM refs WHERE raw IS NOT NULL AND (tbl = 'edits' OR {sql_trim("raw")} <> '') GROUP BY ALL),
n AS (
  SELECT vault, {sql_norm("path")} AS path, {sql_norm("title")} AS title,
         list_transform(aliases, lambda a: {sql_norm("a")}) AS aliases,
         {sql_month("added")} AS from_ym, {sql_month("removed")} AS to_ym
  FROM notes),
names AS (
  SELECT 'path' AS kind, vault, path AS name, from_ym, to_ym FROM n
  UNION SELECT 'stem', vault, {sql_trim(sql_stem("path"))}, from_ym, to_ym FROM n
  UNION SELECT 'title', vault, title, from_ym, to_ym FROM n
  UNION SELECT 'title', vault, unnest(aliases), from_ym, to_ym FROM n),
probes AS (
  SELECT *, 'path' AS kind, name AS probe FROM r
  UNION ALL SELECT *, 'path', name || '.md' FROM r WHERE tbl = 'notes'
  UNION ALL SELECT *, 'stem', {sql_trim(sql_stem("name"))} FROM r WHERE tbl = 'notes'
  UNION ALL SELECT *, 'title', name FROM r WHERE tbl = 'notes'),
found AS (
  SELECT DISTINCT p.tbl, p.vault, p.ym, p.name
  FROM probes p JOIN names n ON n.kind = p.kind AND n.vault = p.vault AND n.name = p.probe
   AND n.from_ym <= p.ym AND (n.to_ym IS NULL OR n.to_ym > p.ym))
SELECT r.tbl, r.ym, sum(n_refs)::BIGINT AS n_refs, coalesce(sum(n_refs) FILTER (f.name IS NULL), 0)::BIGINT AS n_orphans,
       count(*) AS n_targets, count(*) FILTER (f.name IS NULL) AS n_orphan_targets
FROM r LEFT JOIN found f ON f.tbl = r.tbl AND f.vault IS NOT DISTINCT FROM r.vault AND f.ym IS NOT DISTINCT FROM r.ym AND f.name = r.name
GROUP BY r.tbl, r.ym"""

P4_SQL = """
WITH held AS (
  SELECT vault, snap, path, mtime_ms, size FROM files
  QUALIFY row_number() OVER (PARTITION BY vault, snap, path ORDER BY loaded_at DESC NULLS LAST) = 1),
snaps AS (
  SELECT vault, snap, lag(snap) OVER (PARTITION BY vault ORDER BY snap) AS before FROM (SELECT DISTINCT vault, snap FROM files)),
cur AS (SELECT h.* FROM held h JOIN snaps s USING (vault, snap) WHERE s.before IS NOT NULL),
old AS (SELECT s.snap AS now, h.* FROM held h JOIN snaps s ON s.vault = h.vault AND s.before = h.snap)
SELECT coalesce(c.vault, o.vault) AS vault, coalesce(c.snap, o.now) AS snap, coalesce(c.path, o.path) AS path,
       CASE WHEN o.path IS NULL THEN 'added' WHEN c.path IS NULL THEN 'removed' ELSE 'changed' END AS change_kind
FROM cur c FULL JOIN old o ON o.vault = c.vault AND o.now = c.snap AND o.path = c.path
WHERE o.path IS NULL OR c.path IS NULL OR c.mtime_ms IS DISTINCT FROM o.mtime_ms OR c.size IS DISTINCT FROM o.size"""

P4_SUMMARY_SQL = f"""
SELECT vault, snap, count(*) FILTER (change_kind = 'added') AS added, count(*) FILTER (change_kind = 'removed') AS removed,
       count(*) FILTER (change_kind = 'changed') AS changed
FROM ({P4_SQL}) GROUP BY vault, snap"""


def _on(f: Callable[..., DataFrame], *names: str) -> Query:
    return lambda spark, d: f(*(table(spark, d, n) for n in names))


QUERIES: dict[str, Query] = {
    "p1_found": _on(orphans.orphan_references, "notes", "edits"),
    "p1_report": _on(orphans.orphan_report, "notes", "edits"),
    "p4_found": _on(snapshots.snapshot_changes, "files"),
    "p4_summary": _on(snapshots.snapshot_summary, "files"),
} | reference.QUERIES | golden.QUERIES
ORACLE: dict[str, str] = {"p1_found": P1_SQL, "p1_report": P1_REPORT_SQL, "p4_found": P4_SQL, "p4_summary": P4_SUMMARY_SQL} | reference.ORACLE | golden.ORACLE
