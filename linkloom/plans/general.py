"""Queries of the general data operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from linkloom.operators import hotkeys, incremental
from linkloom.runtime import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hotkeys.heavy_keys(table(spark, sf_dir, "edges"))


def p1_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges and content links of every source and target."""
    return hotkeys.key_counts(table(spark, sf_dir, "edges"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incremental.p5_found(spark, sf_dir)


QUERIES = {"p1_found": p1_found, "p1_counts": p1_counts, "p5_found": p5_found}

_EDGES = """
WITH e AS (SELECT id, max(source_id) s, max(target_id) t, max(CAST(link_type IN ('wikilink', 'markdown') AS BIGINT)) c FROM edges WHERE id IS NOT NULL GROUP BY id),
k AS (SELECT 'source' AS key_role, s AS node_id, c FROM e UNION ALL SELECT 'target', t, c FROM e),
g AS (SELECT key_role, node_id, count(*) n, CAST(coalesce(sum(c), 0) AS BIGINT) c FROM k WHERE node_id IS NOT NULL GROUP BY ALL)
"""
SQL = {
    "p1_found": _EDGES + "SELECT key_role, node_id FROM g WHERE n * 100 >= (SELECT count(*) FROM e)",
    "p1_counts": _EDGES + "SELECT key_role, node_id, n AS n_edges, c AS n_content FROM g",
    "p5_found": """
WITH n AS (SELECT id, path, mtime FROM nodes WHERE type IN ('note', 'asset') AND id IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY id ORDER BY seen_at DESC NULLS LAST, path DESC NULLS LAST, mtime DESC NULLS LAST) = 1),
l AS (SELECT path, mtime FROM run_log WHERE path IS NOT NULL AND run_id IN (SELECT run_id FROM index_runs WHERE status = 'ok')
  QUALIFY row_number() OVER (PARTITION BY path ORDER BY run_id DESC, logged_at DESC NULLS LAST, mtime DESC NULLS LAST) = 1)
SELECT id AS node_id FROM n LEFT JOIN l ON n.path = l.path AND n.mtime = l.mtime WHERE l.path IS NULL
""",
}
