"""Queries of this subpackage by name, and their DuckDB texts."""

from __future__ import annotations

from treeledger.functions.paths import resolve_sql
from treeledger.llm.frequent import p3_found, p3_top
from treeledger.llm.leakage import p7_found, p7_items
from treeledger.llm.parsing import p4_errors, p4_found, p4_rates
from treeledger.llm.sentences import p8_found, p8_lengths
from treeledger.llm.tokens import p6_ids, p6_roundtrip
from treeledger.llm.topn import p2_found

_EVENTS = f"""
WITH one AS (SELECT * FROM telemetry WHERE id IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY id ORDER BY timestamp DESC NULLS LAST, file_path DESC NULLS LAST, event_type DESC NULLS LAST) = 1
  UNION ALL SELECT * FROM telemetry WHERE id IS NULL),
v AS (SELECT 'file_path' AS field_name, {resolve_sql('file_path')} AS item_value FROM one
  UNION ALL SELECT 'event_type', lower(regexp_replace(event_type, '^\\s+|\\s+$', '', 'g')) FROM one),
c AS (SELECT field_name, item_value, count(*) AS n_events, CAST(sum(count(*)) OVER (PARTITION BY field_name) AS BIGINT) AS n_total
  FROM v WHERE item_value <> '' GROUP BY 1, 2)
"""

LLM_QUERIES = {
    "p2_found": p2_found, "p3_found": p3_found, "p3_top": p3_top, "p4_found": p4_found, "p4_errors": p4_errors, "p4_rates": p4_rates,
    "p6_ids": p6_ids, "p6_roundtrip": p6_roundtrip, "p7_found": p7_found, "p7_items": p7_items,
    "p8_found": p8_found, "p8_lengths": p8_lengths,
}

LLM_ORACLES = {
    "p2_found": f"""
WITH r AS (SELECT {resolve_sql('query_file')} AS query_file, {resolve_sql('path')} AS path, score, ranked_at FROM ranked_files
  WHERE query_file IS NOT NULL AND path IS NOT NULL AND score IS NOT NULL AND NOT isnan(score)),
one AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY query_file, path ORDER BY ranked_at DESC NULLS LAST, score DESC) = 1)
SELECT query_file, path, CAST(row_number() OVER (PARTITION BY query_file ORDER BY score DESC, path) AS INTEGER) AS rank_no
FROM one QUALIFY rank_no <= 10
""",
    "p3_found": _EVENTS + "SELECT field_name, item_value FROM c WHERE n_events >= 0.005 * n_total",
    "p3_top": _EVENTS + "SELECT field_name, item_value, n_events, n_total FROM c QUALIFY row_number() OVER (PARTITION BY field_name ORDER BY n_events DESC, item_value) <= 20",
}
