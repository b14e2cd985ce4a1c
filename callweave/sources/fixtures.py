"""A pair of call graphs derived from the driver's tables, in SQL that Spark and DuckDB both run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callweave.sources.callgraph import neighbour_lists

TABLES = ("region", "nation", "supplier", "part", "customer", "lineitem")
#: Functions of both graphs.
NODES = """SELECT CAST(row_number() OVER (ORDER BY kind, k) - 1 AS BIGINT) AS idx, kind, k, nm FROM (
  SELECT 0 AS kind, CAST(r_regionkey AS BIGINT) AS k, r_name AS nm FROM {region}
  UNION ALL SELECT 1, CAST(n_nationkey AS BIGINT), n_name FROM {nation}
  UNION ALL SELECT 2, s_suppkey, replace(s_name, '#', '::') FROM {supplier}
  UNION ALL SELECT 3, p_partkey, replace(p_name, ' ', '::') || '_' || CAST(p_partkey AS STRING) FROM {part}
  UNION ALL SELECT 4, c_custkey, replace(c_name, '#', '::') FROM {customer}) t"""
#: Calls (src, dst), of kinds and keys.
CALLS = """SELECT DISTINCT a.idx AS src, b.idx AS dst FROM (
  SELECT 0 AS ak, CAST(n_regionkey AS BIGINT) AS a, 1 AS bk, CAST(n_nationkey AS BIGINT) AS b FROM {nation}
  UNION ALL SELECT 1, CAST(s_nationkey AS BIGINT), 2, s_suppkey FROM {supplier}
  UNION ALL SELECT 1, CAST(c_nationkey AS BIGINT), 4, c_custkey FROM {customer}
  UNION ALL SELECT 2, l_suppkey, 3, l_partkey FROM {lineitem}) x
JOIN {n} a ON a.kind = x.ak AND a.k = x.a JOIN {n} b ON b.kind = x.bk AND b.k = x.b"""
G1 = "SELECT idx, nm AS base_name, replace(replace(nm, '::', '__'), '__', '_') AS name FROM {n}"
G2 = """SELECT n.idx, CASE
    WHEN (kind = 2 AND k % 2 = 0) OR (kind = 1 AND k % 5 = 2) OR (kind = 3 AND k % 11 = 5) OR (kind = 4 AND k % 30 = 0)
      THEN 'FUN_' || lpad(CAST(n.idx AS STRING), 8, '0')
    WHEN kind IN (2, 3) AND k % 7 = 3 THEN g1.name || 'x' ELSE g1.name END AS name
  FROM {n} n JOIN {g1} g1 ON g1.idx = n.idx"""
G2_CALLS = "SELECT src, dst FROM {e} WHERE (src * 31 + dst) % 17 <> 0"


def derived_graphs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """g1 (reference) and g2 (base) with their neighbour lists."""
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES}
    use = lambda sql, **more: spark.sql(sql, **{k: v for k, v in (tables | more).items() if f"{{{k}}}" in sql})
    n = use(NODES).persist()
    e = use(CALLS, n=n).persist()
    g1 = use(G1, n=n)
    g2 = use(G2, n=n, g1=g1).withColumn("base_name", F.col("name"))
    order = ["idx", "name", "base_name", "callees", "callers"]
    return neighbour_lists(g1, e).select(order), neighbour_lists(g2, use(G2_CALLS, e=e)).select(order)
