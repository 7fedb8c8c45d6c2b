"""A graph as JSON lines: nodes and edges, one object a line, written and read in parallel."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.merge import valid_edges
from tessera.schema import EDGES, NODES


def save(nodes: DataFrame, edges: DataFrame, folder: str) -> None:
    nodes.write.mode("overwrite").json(f"{folder}/nodes")
    edges.write.mode("overwrite").json(f"{folder}/edges")


def load(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and the edges whose both ends exist."""
    nodes = spark.read.schema(NODES).json(f"{folder}/nodes")
    return nodes, valid_edges(spark.read.schema(EDGES).json(f"{folder}/edges"), nodes)


def as_json(rows: DataFrame) -> DataFrame:
    """One JSON object a row."""
    return rows.select(F.to_json(F.struct(*[F.col(c) for c in rows.columns])).alias("json"))
