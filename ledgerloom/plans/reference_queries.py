"""Registered queries on references between tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerloom.operators.references import LEDGER_REFERENCES, orphan_references, orphan_report
from ledgerloom.operators.scratch import Scratch
from ledgerloom.sources.tables import read_table


def _orphans(spark: SparkSession, folder: str) -> DataFrame:
    names = dict.fromkeys([r.table for r in LEDGER_REFERENCES] + [r.parent for r in LEDGER_REFERENCES])
    return orphan_references({n: read_table(spark, folder, n) for n in names}, read_table(spark, folder, "retracted_ids"), scratch=Scratch(spark))


def _report(spark: SparkSession, folder: str) -> DataFrame:
    return orphan_report(_orphans(spark, folder))


_ORPHANS_SQL = """
WITH refs AS (
  SELECT 'source_ledger' AS ref_table, 'repost_of' AS ref_field, 'source_ledger' AS parent_table, id AS record_id, repost_of AS raw, loaded_at FROM source_ledger
  UNION ALL SELECT 'source_ledger', 'query_ids', 'query_log', id, unnest(query_ids), loaded_at FROM source_ledger
  UNION ALL SELECT 'query_log', 'included_source_ids', 'source_ledger', id, unnest(included_source_ids), loaded_at FROM query_log
  UNION ALL SELECT 'signal_catalog', 'support_citations', 'source_ledger', id, unnest(support_citations), loaded_at FROM signal_catalog
), child AS (
  SELECT ref_table, ref_field, parent_table, record_id, lower(regexp_replace(raw, '^[\\s\\p{Z}]+|[\\s\\p{Z}]+$', '', 'g')) AS target_id, min(loaded_at) AS first_load
  FROM refs WHERE regexp_replace(raw, '[\\s\\p{Z}]+', '', 'g') <> '' GROUP BY ALL
), parent AS (
  SELECT 'source_ledger' AS parent_table, lower(trim(id)) AS target_id, min(loaded_at) AS first_load FROM source_ledger GROUP BY ALL
  UNION ALL SELECT 'query_log', lower(trim(id)), min(loaded_at) FROM query_log GROUP BY ALL
), gone AS (SELECT DISTINCT table_name AS parent_table, lower(trim(id)) AS target_id FROM retracted_ids)
SELECT ref_table, ref_field, record_id, target_id,
  CASE WHEN p.target_id IS NOT NULL THEN 'late' WHEN g.target_id IS NOT NULL THEN 'deleted' ELSE 'missing' END AS reason,
  strftime(c.first_load, '%Y-%m') AS period
FROM child c LEFT JOIN parent p USING (parent_table, target_id) LEFT JOIN gone g USING (parent_table, target_id)
WHERE p.target_id IS NULL OR strftime(p.first_load, '%Y-%m') > strftime(c.first_load, '%Y-%m')
"""

QUERIES = {"p3_found": _orphans, "p3_report": _report}
SQL = {
    "p3_found": _ORPHANS_SQL,
    "p3_report": f"SELECT ref_table, ref_field, reason, period, count(*) AS n_references, count(DISTINCT target_id) AS n_targets FROM ({_ORPHANS_SQL}) GROUP BY ALL",
}
