"""Dangling references of the retrieval tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..operators.references import report_by_period, retrieval_references
from ..sources.tables import read_table


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    """One row for each dangling reference."""
    return retrieval_references(*(read_table(spark, sf, t) for t in ("documents", "passages", "queries", "qrels", "tombstones")))


def p1_report(spark: SparkSession, sf: str) -> DataFrame:
    """Dangling references by table, field, month and state."""
    return report_by_period(p1_found(spark, sf))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p1_report)}


_FOUND = """
WITH gone AS (SELECT DISTINCT target_table, lower(trim(target_key)) AS key FROM tombstones),
target AS (
  SELECT 'documents' AS target_table, CAST(doc_id AS VARCHAR) AS key, min(ingested_at) AS t FROM documents GROUP BY 1, 2
  UNION ALL SELECT 'passages', lower(trim(passage_id)), min(ingested_at) FROM passages GROUP BY 1, 2
  UNION ALL SELECT 'queries', lower(trim(query_id)), min(created_at) FROM queries GROUP BY 1, 2),
ref AS (
  SELECT 'passages' AS ref_table, 'doc_id' AS ref_field, passage_id AS ref_key, 'documents' AS target_table,
         lower(trim(doc_id)) AS key, ingested_at AS t
  FROM passages QUALIFY row_number() OVER (PARTITION BY passage_id ORDER BY ingested_at NULLS LAST, doc_id) = 1
  UNION ALL SELECT 'qrels', 'query_id', CAST(qrel_id AS VARCHAR), 'queries', lower(trim(query_id)), judged_at FROM qrels
  UNION ALL SELECT 'qrels', 'passage_id', CAST(qrel_id AS VARCHAR), 'passages', lower(trim(passage_id)), judged_at FROM qrels)
SELECT ref_table, ref_field, ref_key,
       CASE WHEN g.key IS NOT NULL THEN 'deleted' WHEN x.key IS NULL THEN 'missing' ELSE 'late' END AS state,
       coalesce(strftime(r.t, '%Y-%m'), 'unknown') AS ref_month
FROM ref r LEFT JOIN gone g ON g.target_table = r.target_table AND g.key = r.key
     LEFT JOIN target x ON x.target_table = r.target_table AND x.key = r.key
WHERE r.key <> '' AND (g.key IS NOT NULL OR x.key IS NULL OR x.t > r.t)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": _FOUND,
        "p1_report": f"SELECT ref_table, ref_field, ref_month, state, count(*) AS n_references FROM ({_FOUND}) GROUP BY ALL",
    }
