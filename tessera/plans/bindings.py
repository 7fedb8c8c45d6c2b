"""The given tables as a code graph. The same expressions serve the queries and the SQL that states their results."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession

from tessera.storage import read

_NODE_COLUMNS = ("id", "name", "kind", "file_path", "line_start", "is_exported", "complexity", "repository_id", "language", "seq")

#: For each table one expression a column of ``_NODE_COLUMNS``.
_NODES = {
    "region": ("'region:' || r_regionkey", "r_name", "'namespace'", "'regions.ts'", "r_regionkey + 1", "TRUE", "1", "'repo0'", "'typescript'", "CAST(r_regionkey AS BIGINT)"),
    "nation": ("'nation:' || n_nationkey", "n_name", "'class'", "'world/r' || n_regionkey || '/nations.py'", "n_nationkey + 1", "n_nationkey % 2 = 0", "n_nationkey % 7", "'repo' || (n_nationkey % 3)", "'python'", "CAST(1000 + n_nationkey AS BIGINT)"),
    "supplier": ("'supplier:' || s_suppkey", "s_name", "'method'", "'world/n' || s_nationkey || '/suppliers.go'", "CAST(s_suppkey AS INT)", "FALSE", "CAST(s_suppkey % 31 AS INT)", "'repo' || (s_suppkey % 3)", "'go'", "10000000 + s_suppkey"),
    "customer": ("'customer:' || c_custkey", "c_name", "'function'", "'world/n' || c_nationkey || '/' || lower(substr(c_mktsegment, 1, 3)) || '.ts'", "CAST(c_custkey AS INT)", "c_custkey % 7 = 0", "CAST(c_custkey % 23 AS INT)", "'repo' || (c_custkey % 3)", "'typescript'", "1000000000 + c_custkey"),
    "orders": ("'orders:' || o_orderkey", "'Order' || o_orderkey", "'variable'", "'orders/' || substr(o_orderpriority, 1, 1) || '.rs'", "CAST(o_orderkey % 1000 AS INT) + 1", "o_orderstatus = 'F'", "CAST(NULL AS INT)", "'repo' || (o_orderkey % 3)", "'rust'", "1000000000000 + o_orderkey"),
}
_EDGE_COLUMNS = ("source_id", "target_id", "kind", "confidence", "seq")
_EDGES = {
    "nation": ("'nation:' || n_nationkey", "'region:' || n_regionkey", "'extends'", "CAST(1.0 AS DOUBLE)", "CAST(n_nationkey AS BIGINT)"),
    "supplier": ("'supplier:' || s_suppkey", "'nation:' || s_nationkey", "'imports'", "CAST(1.0 AS DOUBLE)", "10000000 + s_suppkey"),
    "customer": ("'customer:' || c_custkey", "'nation:' || c_nationkey", "'calls'", "CAST(0.9 AS DOUBLE)", "1000000000 + c_custkey"),
    "orders": ("'orders:' || o_orderkey", "'customer:' || o_custkey", "'calls'", "CAST(50 + o_orderkey % 50 AS DOUBLE) / 100", "1000000000000 + o_orderkey"),
}


def _bound(spark: SparkSession, sf_dir: str, columns: tuple[str, ...], tables: dict[str, tuple[str, ...]]) -> DataFrame:
    return reduce(DataFrame.unionByName, [read(spark, sf_dir, t).selectExpr(*[f"{e} AS {c}" for c, e in zip(columns, exprs, strict=True)]) for t, exprs in tables.items()])


def _sql(columns: tuple[str, ...], tables: dict[str, tuple[str, ...]]) -> str:
    return " UNION ALL ".join(f"SELECT {', '.join(f'{e} AS {c}' for c, e in zip(columns, exprs, strict=True))} FROM {t}" for t, exprs in tables.items())


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bound(spark, sf_dir, _NODE_COLUMNS, _NODES).selectExpr("*", "repository_id || '.' || name AS qualified_name", "line_start + 9 AS line_end", "CAST(NULL AS STRING) AS visibility")


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bound(spark, sf_dir, _EDGE_COLUMNS, _EDGES)


def event_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cyclic graph with self loops: what each user does next."""
    read(spark, sf_dir, "events").createOrReplaceTempView("__events")
    return spark.sql(EVENT_EDGES_SQL.replace("FROM events", "FROM __events"))


GRAPH_SQL = f"""nodes AS (SELECT *, repository_id || '.' || name AS qualified_name, line_start + 9 AS line_end FROM ({_sql(_NODE_COLUMNS, _NODES)})),
edges AS ({_sql(_EDGE_COLUMNS, _EDGES)})"""
EVENT_EDGES_SQL = """SELECT event_type AS source_id, next_type AS target_id, 'calls' AS kind, CAST(1.0 AS DOUBLE) AS confidence, min(event_id) AS seq
FROM (SELECT event_id, event_type, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next_type FROM events)
WHERE next_type IS NOT NULL GROUP BY event_type, next_type"""
