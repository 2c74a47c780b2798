"""DuckDB texts of the catalogue queries."""

from __future__ import annotations

from treeledger.functions.paths import normal_hash_sql, resolve_sql
from treeledger.functions.text import file_type_relevance_sql, identifier_tokens_sql, term_quality_sql
from treeledger.operators.catalogue import BINARY_EXTENSIONS, INDEXABLE_EXTENSIONS, SKIPPED_SEGMENTS
from treeledger.operators.ranking import WEIGHTS
from treeledger.operators.search import FIELD_WEIGHTS
from treeledger.plans.source_sql import VERSIONS, import_refs_sql, outline_names_sql, summaries_sql

DAY = 86_400_000


def _list(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


F = f"""f AS (SELECT * FROM (SELECT {resolve_sql('path')} AS path, {normal_hash_sql('hash')} AS hash, last_checked, summary FROM files) WHERE path <> ''
  QUALIFY row_number() OVER (PARTITION BY path ORDER BY last_checked DESC NULLS LAST, hash DESC NULLS LAST) = 1)"""
NOW = "now AS (SELECT max(last_checked) AS t FROM files)"
LAST = f"""lastd AS (SELECT path, hash FROM (SELECT {resolve_sql('path')} AS path, {normal_hash_sql('hash')} AS hash, snapshot_no, last_checked FROM file_snapshots) WHERE path <> ''
  QUALIFY row_number() OVER (PARTITION BY path ORDER BY snapshot_no DESC NULLS LAST, last_checked DESC NULLS LAST, hash DESC NULLS LAST) = 1)"""
E = f"""e AS (SELECT DISTINCT {resolve_sql('source')} AS src, {resolve_sql('target')} AS dst FROM imports
  WHERE source IS NOT NULL AND target NOT LIKE '%:%' AND (target LIKE '%/%' OR contains(target, '\\')))"""
EV = f"""one AS (SELECT * FROM telemetry WHERE id IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY id ORDER BY timestamp DESC NULLS LAST, file_path DESC NULLS LAST, event_type DESC NULLS LAST, tokens_estimated DESC NULLS LAST, metadata_json DESC NULLS LAST) = 1
  UNION ALL SELECT * FROM telemetry WHERE id IS NULL),
ev AS (SELECT id, timestamp, lower(regexp_replace(event_type, '^\\s+|\\s+$', '', 'g')) AS event_type, nullif({resolve_sql('file_path')}, '') AS file_path, tokens_estimated, metadata_json FROM one)"""
SRC = f"""src AS (SELECT path, contents FROM (SELECT {resolve_sql('path')} AS path, contents, mtime FROM source_files) WHERE path <> ''
  QUALIFY row_number() OVER (PARTITION BY path ORDER BY mtime DESC NULLS LAST, contents DESC NULLS LAST) = 1)"""
TF = f"""tf AS (SELECT task_id, file_path, status, notes, explored_at FROM (SELECT task_id, {resolve_sql('file_path')} AS file_path, status, notes, explored_at FROM task_files WHERE task_id IS NOT NULL AND file_path IS NOT NULL)
  QUALIFY row_number() OVER (PARTITION BY task_id, file_path ORDER BY explored_at DESC NULLS LAST, status DESC NULLS LAST, notes DESC NULLS LAST) = 1)"""
TK = """tk AS (SELECT * FROM tasks WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY updated_at DESC NULLS LAST, name DESC NULLS LAST, state DESC NULLS LAST, created_at DESC NULLS LAST, session_id DESC NULLS LAST) = 1)"""
DEG = "ends AS (SELECT src AS node, 1 AS o, 0 AS i FROM e UNION ALL SELECT dst, 0, 1 FROM e), deg AS (SELECT node, CAST(sum(o) AS BIGINT) AS n_out, CAST(sum(i) AS BIGINT) AS n_in, CAST(sum(o) + sum(i) AS BIGINT) AS degree FROM ends GROUP BY node)"
COMPARED = f"""both_ AS (SELECT coalesce(s.path, c.path) AS path, c.last_checked,
  CASE WHEN c.path IS NULL THEN 'added' WHEN s.path IS NULL THEN 'deleted' WHEN s.hash IS NULL OR s.hash IS DISTINCT FROM c.hash THEN 'changed' ELSE 'unchanged' END AS status
  FROM lastd s FULL JOIN f c ON s.path = c.path)"""
TOTALS = """SELECT count(*) AS total_events, count(*) FILTER (event_type = 'cache_hit') AS cache_hits, count(*) FILTER (event_type = 'cache_miss') AS cache_misses,
  CAST(coalesce(sum(tokens_estimated) FILTER (event_type IN ('cache_hit', 'summary_served')), 0) AS BIGINT) AS tokens_saved,
  CASE WHEN count(*) FILTER (event_type IN ('cache_hit', 'cache_miss')) > 0 THEN count(*) FILTER (event_type = 'cache_hit') / count(*) FILTER (event_type IN ('cache_hit', 'cache_miss')) ELSE 0.0 END AS hit_ratio FROM ev"""
KINDED = "kinded AS (SELECT CASE WHEN event_type IN ('cache_hit', 'cache_miss', 'invalidation', 'force_reread', 'summary_served', 'search_miss') THEN event_type ELSE 'other' END AS kind FROM ev)"
DIR = "CASE WHEN contains({0}, '/') THEN regexp_replace({0}, '/[^/]*$', '') ELSE '.' END"
STARTS = "starts AS (SELECT path AS node FROM f WHERE starts_with(summary.purpose, 'entry point'))"
QUERY_JSON = "CASE WHEN json_valid(metadata_json) AND json_type(metadata_json, '$.{0}') = 'VARCHAR' THEN json_extract_string(metadata_json, '$.{0}') END"


BACK = "back AS (SELECT dst AS src, src AS dst FROM e)"


def _walk(start: str, edges: str, depth: int | None, name: str = "walk") -> str:
    if depth is not None and name != "walk":
        return _walk(start, edges, depth).replace("walk", name)
    if depth is None:
        return f"walk AS (SELECT DISTINCT dst AS node FROM {edges} JOIN {start} s ON src = s.node UNION SELECT dst FROM walk JOIN {edges} ON src = node)"
    return f"walk AS (SELECT DISTINCT dst AS node, 1 AS depth FROM {edges} JOIN {start} s ON src = s.node UNION SELECT dst, depth + 1 FROM walk JOIN {edges} ON src = node WHERE depth < {depth})"


def _search(query: str) -> str:
    terms = query.lower().split()
    fields = {"purpose": "coalesce(summary.purpose, '')", "exports": "coalesce(array_to_string(summary.exports, ' '), '')", "declarations": "coalesce(array_to_string(summary.topLevelDeclarations, ' '), '')", "path": "path"}
    tokens = {n: identifier_tokens_sql("regexp_replace(path, '\\.[^./]*$', '')" if n == "path" else c) for n, c in fields.items()}
    score = " + ".join(f"{w} * {term_quality_sql(t, f't_{n}', f'r_{n}')}" for t in terms for n, w in FIELD_WEIGHTS.items())
    columns = ", ".join(f"{c} AS r_{n}, {tokens[n]} AS t_{n}" for n, c in fields.items())
    return f"WITH {F}, k AS (SELECT path, summary, {columns} FROM f WHERE summary IS NOT NULL) SELECT path, r_purpose AS purpose, CAST({score} AS DOUBLE) AS score FROM k WHERE {score} > 0"


ALL_EXT = "regexp_extract(path, '(\\.[^.]*)$', 1)"

TEXTS = "texts AS (SELECT path AS key, path, contents FROM src WHERE contents IS NOT NULL)"
SUMMARIES = f"{SRC}, {TEXTS}, {summaries_sql('texts')}"

CATALOGUE_SQL = {
    "scan_files": f"""WITH {F} SELECT path, lower({ALL_EXT}) IN {_list(INDEXABLE_EXTENSIONS)} AS indexable FROM f
WHERE NOT list_has_any(string_split(path, '/'), {list(SKIPPED_SEGMENTS)}) AND lower({ALL_EXT}) NOT IN {_list(BINARY_EXTENSIONS)}
  AND (ends_with(path, '.ts') OR ends_with(path, '.js') OR starts_with(path, '/src/') OR path = '/src') AND NOT (starts_with(path, '/tests/') OR path = '/tests')""",
    "path_scope": f"WITH {F} SELECT path, {ALL_EXT} AS extension FROM f WHERE path = 'commons-hub-0/src' OR starts_with(path, 'commons-hub-0/src/')",
    "stale_files": f"WITH {F}, {NOW} SELECT path, last_checked FROM f, now WHERE last_checked < t - {30 * DAY}",
    "file_freshness": f"""WITH {F}, {NOW}, {LAST}, j AS (SELECT coalesce(f.path, lastd.path) AS path, last_checked, summary,
  CASE WHEN lastd.path IS NULL THEN 'deleted' WHEN f.path IS NULL THEN 'new' WHEN f.hash = lastd.hash AND summary IS NOT NULL THEN 'hit' WHEN f.hash = lastd.hash THEN 'pending' ELSE 'stale' END AS status
  FROM f FULL JOIN lastd ON f.path = lastd.path)
SELECT path, status, CASE WHEN status = 'hit' THEN CAST(floor((t - last_checked) / 1000) AS BIGINT) END AS age_seconds,
  CASE WHEN status = 'hit' THEN coalesce(summary.confidence = 'low', false) END AS suggest_full_read FROM j, now""",
    "capped_exports": f"WITH {F} SELECT path, summary.exports[1:1] AS exports, CASE WHEN len(summary.exports) > 1 THEN CAST(len(summary.exports) AS INTEGER) END AS exports_truncated FROM f WHERE summary IS NOT NULL",
    "entry_points": f"WITH {F} SELECT path, summary.purpose AS purpose FROM f WHERE starts_with(summary.purpose, 'entry point')",
    "change_detection": f"WITH {F}, {LAST}, {COMPARED} SELECT path, status FROM both_",
    "changes_since": f"WITH {F}, {LAST}, {NOW}, {COMPARED} SELECT path, status FROM both_, now WHERE status NOT IN ('changed', 'deleted') OR last_checked >= t - {20 * DAY}",
    "duplicate_contents": f"WITH {SRC} SELECT sha256(contents) AS hash, count(*) AS n_paths FROM src WHERE contents IS NOT NULL GROUP BY 1 HAVING count(*) > 1",
    "source_tokens": f"WITH {SRC} SELECT path, sha256(contents) AS hash, CAST(ceil(length(contents) / 4) AS BIGINT) AS tokens, CAST(CASE WHEN contents = '' THEN 0 ELSE len(string_split(contents, chr(10))) END AS INTEGER) AS lines FROM src WHERE contents IS NOT NULL",
    "upsert_files": f"""WITH {F}, {LAST} SELECT coalesce(n.path, f.path) AS path, CASE WHEN n.path IS NULL THEN f.hash ELSE n.hash END AS hash, CASE WHEN n.path IS NULL THEN f.last_checked ELSE 0 END AS last_checked,
  CASE WHEN n.path IS NULL THEN f.summary IS NOT NULL ELSE coalesce(f.hash = n.hash, false) AND f.summary IS NOT NULL END AS has_summary FROM f FULL JOIN lastd n ON f.path = n.path""",
    "touched_files": f"WITH {F}, {LAST} SELECT f.path, CASE WHEN n.path IS NULL THEN last_checked ELSE 1 END AS last_checked FROM f LEFT JOIN lastd n ON f.path = n.path",
    "last_edges": f"""SELECT source, target, import_type, indexed_at, CAST(len(specifiers) AS INTEGER) AS n_specifiers FROM (SELECT {resolve_sql('source')} AS source, {resolve_sql('target')} AS target, specifiers, import_type, indexed_at FROM imports WHERE source IS NOT NULL AND target IS NOT NULL)
QUALIFY row_number() OVER (PARTITION BY source, target, import_type ORDER BY indexed_at DESC NULLS LAST, specifiers DESC NULLS LAST) = 1""",
    "pruned_edges": f"WITH {E}, {F} SELECT src, dst FROM e WHERE src IN (SELECT path FROM f) AND dst IN (SELECT path FROM f)",
    "orphan_sources": f"WITH {E}, {F} SELECT src, dst FROM e WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.path = src)",
    "deleted_entries": f"WITH {E}, {F}, {LAST}, gone AS (SELECT path FROM f WHERE path NOT IN (SELECT path FROM lastd)) SELECT src, dst FROM e WHERE src NOT IN (SELECT path FROM gone)",
    "retained_events": f"WITH {EV} SELECT id, timestamp FROM ev WHERE timestamp >= (SELECT max(timestamp) FROM telemetry) - {30 * DAY}",
    "events_jsonl": f"""WITH {EV} SELECT id, '{{"timestamp":' || coalesce(CAST(timestamp AS VARCHAR), 'null') || ',"event_type":' || coalesce(CAST(to_json(event_type) AS VARCHAR), 'null') || ',"file_path":' || coalesce(CAST(to_json(file_path) AS VARCHAR), 'null')
  || ',"tokens_estimated":' || coalesce(CAST(tokens_estimated AS VARCHAR), 'null') || ',"metadata":' || coalesce(CAST(to_json(metadata_json) AS VARCHAR), 'null') || '}}' AS line FROM ev""",
    "event_log": f"WITH {EV} SELECT id, timestamp, metadata_json FROM ev WHERE event_type = 'search_miss' AND timestamp >= (SELECT max(timestamp) FROM telemetry) - {60 * DAY}",
    "latest_events": f"WITH {EV} SELECT CAST(row_number() OVER (ORDER BY timestamp DESC, id) AS INTEGER) AS place, id, timestamp, event_type FROM ev WHERE id IS NOT NULL AND timestamp IS NOT NULL ORDER BY timestamp DESC, id LIMIT 100",
    "report_by_type": f"WITH {EV} SELECT event_type, count(*) AS n_events FROM ev GROUP BY 1",
    "report_totals": f"WITH {EV} {TOTALS}",
    "report_last_hours": f"WITH {EV} {TOTALS} WHERE timestamp >= (SELECT max(timestamp) FROM telemetry) - {48 * 3_600_000}",
    "report_top_files": f"WITH {EV} SELECT file_path, count(*) AS n_events, CAST(sum(coalesce(tokens_estimated, 0)) AS BIGINT) AS tokens, max(timestamp) AS last_at FROM ev WHERE file_path IS NOT NULL GROUP BY 1 ORDER BY n_events DESC, last_at DESC, file_path LIMIT 10",
    "report_file_use": f"WITH {EV} SELECT file_path, count(*) AS n_events, CAST(sum(coalesce(tokens_estimated, 0)) AS BIGINT) AS tokens, max(timestamp) AS last_at FROM ev WHERE file_path IS NOT NULL GROUP BY 1",
    "report_missed": f"WITH {EV}, q AS (SELECT {QUERY_JSON.format('query')} AS query FROM ev WHERE event_type = 'search_miss') SELECT query, count(*) AS n_missed FROM q WHERE query IS NOT NULL GROUP BY 1",
    "report_sessions": f"""WITH {EV}, q AS (SELECT *, {QUERY_JSON.format('session')} AS session FROM ev) SELECT session, count(*) AS n_events, CAST(coalesce(sum(tokens_estimated) FILTER (event_type IN ('cache_hit', 'summary_served')), 0) AS BIGINT) AS tokens_saved, min(timestamp) AS started_at, max(timestamp) AS ended_at
  FROM q WHERE session IS NOT NULL GROUP BY 1""",
    "age_histogram": f"""WITH {F}, {NOW}, a AS (SELECT CASE WHEN (t - last_checked) / {DAY} < 1 THEN '<1 day' WHEN (t - last_checked) / {DAY} < 7 THEN '1-7 days' WHEN (t - last_checked) / {DAY} < 30 THEN '7-30 days' ELSE '>30 days' END AS age FROM f, now)
SELECT l.age, count(a.age) AS n_files FROM (VALUES ('<1 day'), ('1-7 days'), ('7-30 days'), ('>30 days')) l(age) LEFT JOIN a ON a.age = l.age GROUP BY 1""",
    "token_report": f"""WITH {EV}, {KINDED}, files AS (SELECT file_path AS item, count(*) AS n, sum(coalesce(tokens_estimated, 0)) AS tokens, max(timestamp) AS last_at FROM ev WHERE file_path IS NOT NULL GROUP BY 1),
misses AS (SELECT {QUERY_JSON.format('query')} AS item, count(*) AS n FROM ev WHERE event_type = 'search_miss' GROUP BY 1), t AS ({TOTALS}),
parts AS (SELECT 'totals' AS part, u.item, u.n, CAST(NULL AS HUGEINT) AS tokens, CAST(NULL AS DOUBLE) AS ratio FROM t, LATERAL (VALUES ('total_events', total_events), ('cache_hits', cache_hits), ('cache_misses', cache_misses), ('tokens_saved', tokens_saved)) u(item, n)
  UNION ALL SELECT 'totals', 'hit_ratio', NULL, NULL, hit_ratio FROM t
  UNION ALL SELECT 'kinds', kind, count(*), NULL, NULL FROM kinded GROUP BY kind
  UNION ALL (SELECT 'top_files', item, n, tokens, NULL FROM files ORDER BY n DESC, last_at DESC, item LIMIT 10)
  UNION ALL (SELECT 'top_missed', item, n, NULL, NULL FROM misses WHERE item IS NOT NULL ORDER BY n DESC, item LIMIT 10))
SELECT part, item, CAST(n AS BIGINT) AS n, CAST(tokens AS BIGINT) AS tokens, ratio FROM parts""",
    "language_breakdown": f"WITH {F} SELECT string_split(path, '/')[1] AS project, CASE WHEN regexp_extract(string_split(path, '/')[-1], '[^.](\\.[^.]*)$', 1) = '' THEN '(no extension)' ELSE regexp_extract(string_split(path, '/')[-1], '[^.](\\.[^.]*)$', 1) END AS extension, count(*) AS n_files FROM f GROUP BY 1, 2",
    "folder_counts": f"""WITH {F}, p AS (SELECT path, {DIR.format('path')} AS own, string_split(path, '/') AS parts FROM f),
x AS (SELECT own, array_to_string(parts[1:n], '/') AS folder, n FROM p, LATERAL (SELECT unnest(range(1, len(parts))) AS n))
SELECT folder, CAST(min(n) AS INTEGER) AS depth, count(*) FILTER (own = folder) AS n_own, count(*) AS n_files FROM x GROUP BY 1""",
    "folder_counts_shallow": f"""WITH {F}, p AS (SELECT path, {DIR.format('path')} AS own, string_split(path, '/') AS parts FROM f WHERE len(string_split(path, '/')) <= 3),
x AS (SELECT own, array_to_string(parts[1:n], '/') AS folder, n FROM p, LATERAL (SELECT unnest(range(1, len(parts))) AS n))
SELECT folder, CAST(min(n) AS INTEGER) AS depth, count(*) FILTER (own = folder) AS n_own, count(*) AS n_files FROM x GROUP BY 1""",
    "import_edges": f"WITH {E} SELECT src, dst FROM e",
    "node_degrees": f"WITH {E}, {DEG} SELECT node, n_out, n_in, degree FROM deg",
    "most_connected": f"WITH {E}, {DEG} SELECT node, degree FROM deg ORDER BY degree DESC, node LIMIT 10",
    "node_centrality": f"WITH {E}, {DEG} SELECT node, round(ln(1 + degree) / ln(1 + max(degree) OVER ()), 9) AS centrality FROM deg",
    "symbol_edges": f"""SELECT DISTINCT unnest(specifiers) AS symbol, {resolve_sql('source')} AS source, {resolve_sql('target')} AS target, import_type FROM imports
WHERE source IS NOT NULL AND target NOT LIKE '%:%' AND (target LIKE '%/%' OR contains(target, '\\'))""",
    "symbol_usage": f"""WITH u AS (SELECT DISTINCT unnest(specifiers) AS symbol, {resolve_sql('source')} AS source, {resolve_sql('target')} AS target, import_type FROM imports
WHERE source IS NOT NULL AND target NOT LIKE '%:%' AND (target LIKE '%/%' OR contains(target, '\\'))) SELECT symbol, count(*) AS n_edges, count(DISTINCT source) AS n_sources FROM u WHERE symbol IS NOT NULL GROUP BY 1""",
    "reach_two": f"WITH RECURSIVE {F}, {E}, {STARTS}, {_walk('starts', 'e', 2)} SELECT node, min(depth) AS depth FROM walk WHERE node NOT IN (SELECT node FROM starts) GROUP BY node",
    "reach_all": f"WITH RECURSIVE {F}, {E}, {STARTS}, {_walk('starts', 'e', None)} SELECT node FROM walk WHERE node NOT IN (SELECT node FROM starts)",
    "dependents_all": f"WITH RECURSIVE {F}, {E}, b AS (SELECT dst AS src, src AS dst FROM e), starts AS (SELECT path AS node FROM f WHERE contains(path, '/config/')), {_walk('starts', 'b', None)} SELECT node FROM walk WHERE node NOT IN (SELECT node FROM starts)",
    "proximity": f"""WITH RECURSIVE {E}, u AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e), starts AS (SELECT DISTINCT {resolve_sql('file_path')} AS node FROM task_files WHERE status = 'flagged' AND file_path IS NOT NULL),
h1 AS (SELECT DISTINCT dst AS node FROM u JOIN starts ON src = node), h2 AS (SELECT DISTINCT dst AS node FROM u JOIN h1 ON src = node), {BACK}, {_walk('starts', 'e', 3)}, {_walk('starts', 'back', 3, 'rewalk')},
s AS (SELECT node, CAST(1 AS DOUBLE) AS p FROM h1 UNION ALL SELECT node, 0.5 FROM h2 WHERE node NOT IN (SELECT node FROM starts)
  UNION ALL SELECT node, 0.25 FROM walk WHERE node NOT IN (SELECT node FROM starts) UNION ALL SELECT node, 0.25 FROM rewalk WHERE node NOT IN (SELECT node FROM starts))
SELECT node, CAST(max(p) AS DOUBLE) AS proximity FROM s GROUP BY node""",
    "related_files": f"""WITH {E}, {F}, {DEG}, hub AS (SELECT node FROM deg ORDER BY degree DESC, node LIMIT 1),
o1 AS (SELECT DISTINCT dst AS node FROM e JOIN hub ON src = node), i1 AS (SELECT DISTINCT src AS node FROM e JOIN hub ON dst = node),
o2 AS (SELECT DISTINCT dst AS node FROM e JOIN o1 ON src = node), i2 AS (SELECT DISTINCT src AS node FROM e JOIN i1 ON dst = node),
r AS (SELECT node, 1 AS k FROM o1 UNION ALL SELECT node, 2 FROM i1 UNION ALL SELECT node, 3 FROM o2 UNION ALL SELECT node, 3 FROM i2
  UNION ALL SELECT path, 4 FROM f, hub WHERE {DIR.format('path')} = {DIR.format('hub.node')})
SELECT node AS path, ['imports', 'imported-by', 'transitive-dependency', 'same-directory'][min(k)] AS relationship FROM r WHERE node <> (SELECT node FROM hub) GROUP BY node""",
    "rank_composite": f"""WITH r AS (SELECT {resolve_sql('query_file')} AS query_file, {resolve_sql('path')} AS path, CASE WHEN NOT isnan(score) THEN score END AS score, signals, ranked_at FROM ranked_files WHERE query_file IS NOT NULL AND path IS NOT NULL),
one AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY query_file, path ORDER BY ranked_at DESC NULLS LAST, score DESC NULLS LAST) = 1)
SELECT query_file, path, score, round({' + '.join(f'coalesce(signals.{n}, 0.0) * CAST({w} AS DOUBLE)' for n, w in WEIGHTS.items())}, 9) AS composite FROM one""",
    "rank_signals": f"""WITH {F}, {NOW}, t AS (SELECT {DIR.format('p')} AS folder, max(CASE WHEN status = 'flagged' THEN 1.0 ELSE 0.7 END) AS own FROM (SELECT {resolve_sql('file_path')} AS p, status FROM task_files WHERE file_path IS NOT NULL) GROUP BY 1),
up AS (SELECT DISTINCT {DIR.format('folder')} AS parent FROM t), c AS (SELECT path, last_checked, {DIR.format('path')} AS folder, {DIR.format(DIR.format('path').join('()'))} AS parent FROM f)
SELECT path, round(CASE WHEN last_checked IS NULL THEN 0.5 WHEN t - last_checked <= 0 THEN 1.0 ELSE pow(2.0, -(floor((t - last_checked) / 60000) * 60000) / {7 * DAY}.0) END, 9) AS recency,
  CAST({file_type_relevance_sql('path')} AS DOUBLE) AS file_type, CAST(coalesce(own, CASE WHEN up.parent IS NOT NULL THEN 0.4 END, 0.1) AS DOUBLE) AS task_context
FROM c CROSS JOIN now LEFT JOIN t USING (folder) LEFT JOIN up USING (parent)""",
    "search_purpose": _search("test fold graph entry") + " ORDER BY score DESC, path LIMIT 20",
    "search_scores": _search("source batch id"),
    "frontier_files": f"WITH {F} SELECT path FROM f WHERE path NOT IN (SELECT {resolve_sql('file_path')} FROM task_files WHERE task_id IS NOT NULL AND file_path IS NOT NULL)",
    "task_summaries": f"""WITH {TK}, {TF} SELECT tk.id AS task_id, tk.name, count(tf.file_path) AS n_files, count(*) FILTER (tf.status = 'flagged') AS n_flagged, min(explored_at) AS first_at, max(explored_at) AS last_at
FROM tk LEFT JOIN tf ON tf.task_id = tk.id GROUP BY 1, 2""",
    "sessions": f"WITH {TK} SELECT session_id, count(*) AS n_tasks, min(created_at) AS started_at, max(updated_at) AS ended_at FROM tk WHERE session_id IS NOT NULL GROUP BY 1",
    "session_unchecked": f"WITH {TK}, {F}, s AS (SELECT session_id, min(created_at) AS started_at FROM tk WHERE session_id IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1) SELECT path, last_checked FROM f, s WHERE last_checked < started_at",
    "garbage_counts": f"""WITH {F}, {NOW}, {LAST}, {E}, {EV}, {TK}, lft AS (SELECT * FROM f WHERE path IN (SELECT path FROM lastd)), kept AS (SELECT lft.* FROM lft, now WHERE NOT coalesce(last_checked < t - {30 * DAY}, false))
SELECT 'deleted_files' AS category, count(*) AS n FROM f WHERE path NOT IN (SELECT path FROM lastd)
UNION ALL SELECT 'stale_files', count(*) FROM lft, now WHERE last_checked < t - {30 * DAY}
UNION ALL SELECT 'orphan_edges', count(*) FROM e WHERE src NOT IN (SELECT path FROM kept)
UNION ALL SELECT 'old_events', count(*) FROM ev, now WHERE timestamp < t - {90 * DAY}
UNION ALL SELECT 'old_tasks', count(*) FROM tk, now WHERE state IN ('completed', 'archived') AND updated_at < t - {30 * DAY}""",
    "graph_summary": f"""WITH {E}, {DEG}, top AS (SELECT node FROM deg ORDER BY degree DESC, node LIMIT 50)
SELECT (SELECT count(*) FROM deg) AS total_files, (SELECT count(*) FROM e) AS total_edges, (SELECT count(*) FROM top) AS shown_files, (SELECT count(*) FROM e JOIN top ON src = node) AS shown_edges, (SELECT count(*) FROM deg) > 50 AS truncated""",
    "graph_adjacency": f"WITH {E}, {DEG}, top AS (SELECT node FROM deg ORDER BY degree DESC, node LIMIT 50) SELECT src AS source, dst AS target FROM e JOIN top ON src = node",
    "regex_summaries": f'WITH {SUMMARIES} SELECT path, purpose, exports, imports, "lineCount", confidence, declarations FROM sums',
    "summary_savings": f"""WITH {SUMMARIES}, j AS (SELECT string_split(path, '/')[1] AS project, contents, CAST(to_json(struct_pack(purpose := purpose, exports := exports, imports := imports, "lineCount" := "lineCount", "topLevelDeclarations" := declarations, confidence := confidence)) AS VARCHAR) AS s FROM sums)
SELECT project, count(*) AS n_files, CAST(sum(greatest(0, CAST(ceil(length(contents) / 4) AS BIGINT) - CAST(ceil(length(s) / 4) AS BIGINT))) AS BIGINT) AS tokens_saved FROM j GROUP BY 1""",
    "diff_classes": f"WITH {VERSIONS} SELECT path, mtime, n_added, n_removed, structural, n_added <> n_removed AS lines_changed FROM p JOIN d USING (key)",
    "smart_summaries": f"""WITH {VERSIONS}, w AS (SELECT p.*, coalesce(NOT structural AND n_added + n_removed > 0, false) AS partial FROM p LEFT JOIN d USING (key)),
read AS (SELECT key, path, CASE WHEN partial THEN before ELSE contents END AS contents FROM w), {summaries_sql('read')}
SELECT w.path, w.mtime, CASE WHEN partial THEN 'diff-partial' ELSE 'full' END AS summary_source, purpose, CAST(CASE WHEN w.contents = '' THEN 0 ELSE len(string_split(w.contents, chr(10))) END AS INTEGER) AS "lineCount", confidence,
  CAST(len(exports) AS INTEGER) AS n_exports, CAST(len(imports) AS INTEGER) AS n_imports, CAST(len(declarations) AS INTEGER) AS n_declarations FROM w JOIN sums USING (key)""",
    "import_refs": import_refs_sql(SRC, F),
    "outline_names": outline_names_sql(SRC),
    "stream_type_counts": "SELECT lower(regexp_replace(event_type, '^\\s+|\\s+$', '', 'g')) AS event_type, count(*) AS n_events FROM telemetry GROUP BY 1",
    "ordered_paths": f"WITH {F} SELECT path, CAST(row_number() OVER (ORDER BY path) AS INTEGER) AS place FROM f ORDER BY path LIMIT 100",
    "known_paths": f"WITH {F} SELECT path FROM f UNION SELECT {resolve_sql('path')} FROM source_files WHERE {resolve_sql('path')} <> ''",
    "safe_paths": """WITH p AS (SELECT DISTINCT path, list_filter(string_split(replace(path, '\\', '/'), '/'), lambda s: s NOT IN ('', '.')) AS seg FROM files WHERE path IS NOT NULL)
SELECT path, NOT starts_with(path, '/') AND coalesce(list_min(list_transform(range(1, len(seg) + 1), lambda n: list_sum(list_transform(seg[1:n], lambda s: CASE WHEN s = '..' THEN -1 ELSE 1 END)))), 0) >= 0 AS inside FROM p""",
    "shown_files": f"WITH {F} SELECT path FROM f WHERE NOT (string_split(path, '/')[-1] = '.gitkeep' AND coalesce(hash = sha256(''), false))",
    "settled_sources": f"""WITH {F}, m AS (SELECT {resolve_sql('path')} AS path, max(mtime) AS mtime FROM source_files WHERE {resolve_sql('path')} <> '' GROUP BY 1)
SELECT m.path, coalesce(mtime < last_checked - 2000, false) AS settled FROM m LEFT JOIN f ON f.path = m.path""",
    "index_counters": f"""WITH {F}, {LAST} SELECT CASE WHEN lastd.path IS NULL THEN 'deleted' WHEN f.path IS NULL THEN 'new' WHEN f.hash = lastd.hash AND summary IS NOT NULL THEN 'hit' WHEN f.hash = lastd.hash THEN 'pending' ELSE 'stale' END AS status, count(*) AS n_files
  FROM f FULL JOIN lastd ON f.path = lastd.path GROUP BY 1""",
    "batch_counters": f"""WITH {E}, {F}, a AS (SELECT DISTINCT dst AS path FROM e) SELECT count(*) FILTER (f.path IS NOT NULL AND summary IS NOT NULL) AS n_hits, count(*) FILTER (f.path IS NOT NULL AND summary IS NULL) AS n_misses,
  count(*) FILTER (f.path IS NULL) AS n_errors FROM a LEFT JOIN f ON f.path = a.path""",
    "cleared_summaries": f"WITH {F} SELECT path, hash, last_checked, true AS cleared FROM f",
    "removed_node": f"WITH {E}, {DEG}, hub AS (SELECT node FROM deg ORDER BY degree DESC, node LIMIT 1) SELECT src, dst FROM e WHERE src <> (SELECT node FROM hub) AND dst <> (SELECT node FROM hub)",
    "sampled_events": f"WITH {EV} SELECT id, timestamp, event_type FROM ev WHERE id IS NOT NULL AND CAST('0x' || substr(md5(CAST(id AS VARCHAR)), 1, 8) AS BIGINT) < {int(0.1 * (1 << 32))}",
    "session_totals": f"WITH {TK}, {EV}, st AS (SELECT min(created_at) AS began FROM tk WHERE session_id IS NOT NULL GROUP BY session_id ORDER BY 1 DESC LIMIT 1) {TOTALS} WHERE timestamp >= (SELECT began FROM st)",
    "formatted_counts": f"WITH {EV}, c AS (SELECT event_type, count(*) AS n FROM ev GROUP BY 1) SELECT event_type, format('{{:,}}', n) AS shown, format('{{:.1f}}', round(n * 100 / sum(n) OVER (), 1)) || '%' AS share FROM c",
    "hub_neighbourhood": f"""WITH RECURSIVE {E}, {DEG}, {BACK}, starts AS (SELECT node FROM deg ORDER BY degree DESC, node LIMIT 1), {_walk('starts', 'e', 2)}, {_walk('starts', 'back', 2, 'rewalk')}
SELECT DISTINCT 'dependencies' AS direction, node FROM walk WHERE node NOT IN (SELECT node FROM starts) UNION ALL SELECT DISTINCT 'dependents', node FROM rewalk WHERE node NOT IN (SELECT node FROM starts)""",
    "candidate_centrality": f"WITH {E}, {F}, {DEG}, {STARTS} SELECT node, degree, round(ln(1 + degree) / ln(1 + max(degree) OVER ()), 9) AS centrality FROM deg WHERE node IN (SELECT node FROM starts)",
    "related_ranked": f"""WITH RECURSIVE {E}, {F}, {NOW}, {DEG}, {BACK}, u AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e), starts AS (SELECT node FROM deg ORDER BY degree DESC, node LIMIT 1),
o1 AS (SELECT DISTINCT dst AS node FROM e JOIN starts ON src = node), i1 AS (SELECT DISTINCT src AS node FROM e JOIN starts ON dst = node),
r AS (SELECT node, CAST(1 AS DOUBLE) AS k FROM o1 UNION ALL SELECT node, 1.0 FROM i1 UNION ALL SELECT dst, 0.5 FROM e JOIN o1 ON src = node UNION ALL SELECT src, 0.5 FROM e JOIN i1 ON dst = node
  UNION ALL SELECT path, 0.25 FROM f, starts WHERE {DIR.format('path')} = {DIR.format('starts.node')}),
c AS (SELECT node, CAST(max(k) AS DOUBLE) AS relationship FROM r WHERE node <> (SELECT node FROM starts) GROUP BY 1),
h1 AS (SELECT DISTINCT dst AS node FROM u JOIN starts ON src = node), h2 AS (SELECT DISTINCT dst AS node FROM u JOIN h1 ON src = node), {_walk('starts', 'e', 3)}, {_walk('starts', 'back', 3, 'rewalk')},
near AS (SELECT node, max(p) AS p FROM (SELECT node, CAST(1 AS DOUBLE) AS p FROM h1 UNION ALL SELECT node, 0.5 FROM h2 UNION ALL SELECT node, 0.25 FROM walk UNION ALL SELECT node, 0.25 FROM rewalk) GROUP BY 1)
SELECT c.node AS path, c.relationship, round({WEIGHTS['relationship']} * c.relationship + {WEIGHTS['dependencyProximity']} * coalesce(near.p, 0)
  + {WEIGHTS['recency']} * CASE WHEN last_checked IS NULL THEN 0.5 WHEN t - last_checked <= 0 THEN 1.0 ELSE pow(2.0, -(floor((t - last_checked) / 60000) * 60000) / {7 * DAY}.0) END
  + {WEIGHTS['fileTypeRelevance']} * {file_type_relevance_sql('c.node')} + {WEIGHTS['taskContextRelevance']} * 0.1 + {WEIGHTS['centrality']} * coalesce(CAST(ln(1 + degree) AS DOUBLE) / ln(1 + max(degree) OVER ()), 0), 9) AS score
FROM c CROSS JOIN now LEFT JOIN near ON near.node = c.node LEFT JOIN f ON f.path = c.node LEFT JOIN deg ON deg.node = c.node""",
    "served_lines": f"WITH hits AS ({_search('test fold graph entry')} ORDER BY score DESC, path LIMIT 20), {F} SELECT count(*) AS n_results, CAST(round(avg(summary.lineCount) * 10) AS BIGINT) AS tokens FROM hits JOIN f ON f.path = hits.path",
    "latest_sessions": f"WITH {TK}, s AS (SELECT session_id, count(*) AS n_tasks, min(created_at) AS started_at, max(updated_at) AS ended_at FROM tk WHERE session_id IS NOT NULL GROUP BY 1) SELECT *, CAST(row_number() OVER (ORDER BY started_at DESC, session_id) AS INTEGER) AS place FROM s ORDER BY place LIMIT 10",
    "latest_tasks": f"WITH {TK} SELECT CAST(row_number() OVER (ORDER BY updated_at DESC, id) AS INTEGER) AS place, id, name, updated_at FROM tk WHERE state = 'active' ORDER BY place LIMIT 10",
    "activated_tasks": f"""WITH {TK}, {TF}, m AS (SELECT task_id, min(explored_at) AS marked FROM tf GROUP BY 1)
SELECT id, name, CASE WHEN state = 'created' AND task_id IS NOT NULL THEN 'active' ELSE state END AS state, created_at, CASE WHEN state = 'created' AND task_id IS NOT NULL THEN greatest(updated_at, marked) ELSE updated_at END AS updated_at, session_id FROM tk LEFT JOIN m ON task_id = id""",
    "task_files_left": f"WITH {TK}, {TF} SELECT task_id, file_path, status, explored_at FROM tf WHERE task_id NOT IN (SELECT id FROM tk WHERE state IN ('completed', 'archived'))",
    "explored_files": f"""WITH {TF}, l AS (SELECT task_id FROM tf GROUP BY 1 ORDER BY count(*) DESC, task_id LIMIT 1)
SELECT file_path, status, notes, explored_at FROM tf JOIN l USING (task_id)""",
    "generation_actions": f"""WITH {TK}, g AS (SELECT id, ['ast:', 'regex:', 'Ast:', ''][CAST(created_at % 4 + 1 AS INTEGER)] || CAST(updated_at % 5 AS VARCHAR) AS tag FROM tk),
n AS (SELECT *, TRY_CAST(nullif(regexp_extract(tag, '^[a-z]+:([0-9]+)$', 1), '') AS INTEGER) AS v FROM g)
SELECT id, tag, CASE WHEN v > 3 THEN 'block' WHEN tag = 'regex:3' THEN 'keep' WHEN tag IS NULL OR tag IN ('regex:1', 'regex:2') THEN 'retag' ELSE 'clear' END AS regex_action,
  CASE WHEN v > 3 THEN 'block' WHEN tag = 'ast:3' THEN 'keep' ELSE 'clear' END AS ast_action FROM n""",
    "iso_times": "SELECT doc_id, strftime(updated_at, '%Y-%m-%dT%H:%M:%S.%gZ') AS iso, epoch_ms(updated_at) AS ms FROM documents",
    "first_sentences": """WITH l AS (SELECT doc_id, trim(regexp_replace(string_split(replace(text, chr(13), ''), chr(10))[1], '\\s+', ' ', 'g'), ' ') AS line FROM documents WHERE text IS NOT NULL)
SELECT doc_id, CASE WHEN regexp_matches(line, '\\.\\s') THEN regexp_extract(line, '^(.*?\\.)\\s', 1) ELSE line END AS sentence FROM l""",
    "invalidated": f"WITH {F} SELECT CAST(0 AS BIGINT) AS timestamp, 'invalidation' AS event_type, path AS file_path FROM f WHERE contains(path, '/tests/')",
}
