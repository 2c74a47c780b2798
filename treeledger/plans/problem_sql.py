"""DuckDB text of the core problem queries."""

from __future__ import annotations

from treeledger.functions.paths import normal_hash_sql, resolve_sql

P1 = f"""
WITH now AS (SELECT DISTINCT {resolve_sql('path')} AS k FROM files WHERE path IS NOT NULL),
past AS (SELECT {resolve_sql('path')} AS k, epoch_ms(min(taken_at)) AS first_at FROM file_snapshots WHERE path IS NOT NULL GROUP BY 1),
todo AS (SELECT id AS k, min(created_at) AS first_at FROM tasks WHERE id IS NOT NULL GROUP BY 1),
edges AS (SELECT {resolve_sql('source')} AS a, {resolve_sql('target')} AS b, indexed_at AS t,
  (target NOT LIKE '%:%' AND (target LIKE '%/%' OR contains(target, '\\'))) AS internal FROM imports),
refs AS (SELECT 'source' AS f, a AS k, a, b, t FROM edges WHERE a IS NOT NULL
  UNION ALL SELECT 'target', b, a, b, t FROM edges WHERE internal),
one AS (
  SELECT 'imports' AS ref_table, f AS ref_field, a AS key_a, b AS key_b, strftime(make_timestamp(t * 1000), '%Y-%m') AS period_month,
    CASE WHEN now.k IS NULL AND past.k IS NOT NULL THEN 'deleted' WHEN now.k IS NULL THEN 'missing' WHEN past.first_at > t THEN 'late' END AS reason
  FROM refs LEFT JOIN now ON now.k = refs.k LEFT JOIN past ON past.k = refs.k
  UNION ALL
  SELECT 'task_files', 'task_id', task_id, {resolve_sql('file_path')}, strftime(make_timestamp(explored_at * 1000), '%Y-%m'),
    CASE WHEN todo.k IS NULL THEN 'missing' WHEN todo.first_at > explored_at THEN 'late' END
  FROM task_files LEFT JOIN todo ON todo.k = task_id WHERE task_id IS NOT NULL)
SELECT DISTINCT * FROM one WHERE reason IS NOT NULL
"""

P5_ROWS = f"""
WITH r AS (SELECT snapshot_no, {resolve_sql('path')} AS path, {normal_hash_sql('hash')} AS hash, last_checked FROM file_snapshots),
kept AS (SELECT snapshot_no, path, string_split(path, '/')[1] AS project, hash FROM r WHERE path <> ''
  QUALIFY row_number() OVER (PARTITION BY snapshot_no, path ORDER BY last_checked DESC NULLS LAST, hash DESC NULLS LAST) = 1),
d AS (SELECT project, snapshot_no, lead(snapshot_no) OVER (PARTITION BY project ORDER BY snapshot_no) AS next_no FROM (SELECT DISTINCT project, snapshot_no FROM kept)),
pairs AS (SELECT k.project, d.next_no AS snapshot_no, k.path, k.hash FROM kept k JOIN d USING (project, snapshot_no) WHERE d.next_no IS NOT NULL),
laters AS (SELECT k.project, k.snapshot_no, k.path, k.hash FROM kept k WHERE EXISTS (SELECT 1 FROM d WHERE d.project = k.project AND d.next_no = k.snapshot_no)),
changes AS (SELECT coalesce(l.project, p.project) AS project, coalesce(l.snapshot_no, p.snapshot_no) AS snapshot_no, coalesce(l.path, p.path) AS path,
  CASE WHEN p.path IS NULL THEN 'added' WHEN l.path IS NULL THEN 'deleted' WHEN p.hash IS DISTINCT FROM l.hash THEN 'changed' END AS change_kind
  FROM laters l FULL JOIN pairs p ON p.snapshot_no = l.snapshot_no AND p.path = l.path)
"""

PROBLEM_SQL = {
    "p1_found": P1,
    "p1_rates": f"SELECT ref_table, ref_field, period_month, reason, count(*) AS n_broken FROM ({P1}) GROUP BY ALL",
    "p5_found": P5_ROWS + "SELECT snapshot_no, path, change_kind FROM changes WHERE change_kind IS NOT NULL",
    "p5_counts": P5_ROWS + "SELECT project, snapshot_no, change_kind, count(*) AS n_paths FROM changes WHERE change_kind IS NOT NULL GROUP BY ALL",
}
