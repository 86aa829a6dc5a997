"""DuckDB reference SQL for the `ranked` adapter (shared CTEs)."""

RANKED_CTE = """
g AS (
  SELECT l_orderkey AS qid, l_linenumber AS context_id,
         MAX(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS label,
         MAX(l_extendedprice) AS s_price, MAX(l_quantity) AS s_qty, MAX(l_discount) AS s_disc
  FROM lineitem GROUP BY l_orderkey, l_linenumber),
raw AS (
  SELECT qid, context_id, 'embedding_baseline' AS method, CAST(s_price AS DOUBLE) AS score FROM g
  UNION ALL SELECT qid, context_id, 'bce', CAST(s_qty AS DOUBLE) FROM g
  UNION ALL SELECT qid, context_id, 'lightweight_ml', CAST(s_disc AS DOUBLE) FROM g),
scores AS (
  SELECT qid, context_id, score,
         CAST(ROW_NUMBER() OVER (PARTITION BY method, qid
              ORDER BY CASE WHEN isnan(score) THEN NULL ELSE score END DESC NULLS LAST, context_id) AS INTEGER) AS rank,
         method, 0.0 AS latency_ms
  FROM raw)"""
