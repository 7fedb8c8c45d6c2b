"""Upserts, deletes and snapshot differences: each gives the new table, to be written beside the old and swapped in."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.graph import induced


def upsert(stored: DataFrame, changes: DataFrame, key: str = "id", preserve: tuple[str, ...] = ()) -> DataFrame:
    """Rows of ``changes`` replace stored rows of their key or join them; columns of ``preserve`` keep a stored value.

    ``changes`` has each key once (see :func:`newest`).
    """
    old, new = stored.alias("o"), changes.alias("n")
    both = old.join(new, F.col(f"o.{key}") == F.col(f"n.{key}"), "full_outer")
    is_new = F.col(f"n.{key}").isNotNull()
    known = F.col(f"o.{key}").isNotNull()
    cols = [F.when(known & is_new & F.lit(c in preserve), F.col(f"o.{c}")).when(is_new, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in stored.columns]
    return both.select(*cols)


def newest(changes: DataFrame, key: str = "id", order: str = "seq") -> DataFrame:
    """Of rows with one key, the one of the largest ``order``."""
    last = F.max_by(F.struct(*[F.col(c) for c in changes.columns]), F.col(order)).alias("last")
    return changes.groupBy(key).agg(last).select("last.*")


def upsert_vectors(stored: DataFrame, changes: DataFrame, key: str = "id", vector: str = "embedding") -> DataFrame:
    """Vectors of another dimension than the stored ones replace the whole table; else they are upserted."""
    dims = [df.where(F.col(vector).isNotNull()).select(F.size(vector).alias("d")).first() for df in (stored, changes)]
    if dims[0] is not None and dims[1] is not None and dims[0][0] != dims[1][0]:
        return changes.select(*stored.columns)
    return upsert(stored, changes.select(*stored.columns), key)


def delete_nodes(nodes: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes without those of ``gone`` (column id), and edges without any that touched them."""
    ids = gone.select("id").distinct()
    kept = edges.join(ids.withColumnRenamed("id", "source_id"), "source_id", "left_anti").join(ids.withColumnRenamed("id", "target_id"), "target_id", "left_anti")
    return nodes.join(ids, "id", "left_anti"), kept.select(*edges.columns)


def delete_file(nodes: DataFrame, edges: DataFrame, path: str) -> tuple[DataFrame, DataFrame]:
    return delete_nodes(nodes, edges, nodes.where(F.col("file_path") == path))


def delete_repository(tables: dict[str, DataFrame], repository_id: str) -> dict[str, DataFrame]:
    """Every table without the rows of one repository; edges go with their nodes, whichever repository they name."""
    nodes, edges = delete_nodes(tables["nodes"], tables["edges"], tables["nodes"].where(F.col("repository_id") == repository_id))
    out = {n: df.where(F.col("id" if n == "repositories" else "repository_id") != repository_id) for n, df in tables.items() if n not in ("nodes", "edges")}
    return out | {"nodes": nodes, "edges": edges}


def valid_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose both ends exist."""
    return induced(nodes, edges).select(*edges.columns)


def snapshot_diff(current: DataFrame, stored: DataFrame, key: str = "path", marks: tuple[str, ...] = ("hash", "mtime")) -> DataFrame:
    """(key, change): added, changed, unchanged or removed. Unchanged means indexed, and equal in every mark."""
    cur, old = current.alias("c"), stored.alias("s")
    same = F.coalesce(F.col("s.status") == "indexed", F.lit(False)) if "status" in stored.columns else F.lit(True)
    for m in marks:
        same = same & F.col(f"c.{m}").eqNullSafe(F.col(f"s.{m}"))
    change = F.when(F.col(f"s.{key}").isNull(), "added").when(F.col(f"c.{key}").isNull(), "removed").when(same, "unchanged").otherwise("changed")
    return cur.join(old, F.col(f"c.{key}") == F.col(f"s.{key}"), "full_outer").select(F.coalesce(f"c.{key}", f"s.{key}").alias(key), change.alias("change"))
