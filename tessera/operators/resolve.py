"""References become edges: one equi-join for all files, so no second pass for forward references is needed."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.graph import directory
from tessera.schema import edge_id

# What may follow the path of an import.
IMPORT_SUFFIXES = ("", ".ts", ".tsx", ".js", ".jsx", "/index.ts", "/index.tsx", "/index.js")


def _edge(kind: Column, confidence: float) -> list[Column]:
    return [edge_id(F.col("source_id"), F.col("target_id"), kind).alias("id"), F.col("source_id"), F.col("target_id"), kind.alias("kind"), F.lit(confidence).alias("confidence"), F.col("repository_id")]


def call_edges(calls: DataFrame, nodes: DataFrame) -> DataFrame:
    """``calls``: (caller_id, callee_name, repository_id). Every symbol of that name in the repository is a target."""
    named = nodes.select(F.col("id").alias("target_id"), F.col("name").alias("callee_name"), "repository_id")
    return calls.withColumnRenamed("caller_id", "source_id").distinct().join(named, ["callee_name", "repository_id"]).select(*_edge(F.lit("calls"), 0.9))


def inheritance_edges(parents: DataFrame, nodes: DataFrame) -> DataFrame:
    """``parents``: (child_id, parent_name, kind, repository_id), kind extends or implements."""
    named = nodes.select(F.col("id").alias("target_id"), F.col("name").alias("parent_name"), "repository_id")
    return parents.withColumnRenamed("child_id", "source_id").distinct().join(named, ["parent_name", "repository_id"]).select(*_edge(F.col("kind"), 1.0))


def normal_path(path: Column) -> Column:
    """``a/./b`` and ``a/../b`` resolved, back slashes as slashes; what would leave the root stays there."""
    parts = F.filter(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), lambda p: (p != "") & (p != "."))
    empty = F.array().cast("array<string>")
    return F.array_join(F.aggregate(parts, empty, lambda acc, p: F.when(p == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(p)))), "/")


def first_symbols(nodes: DataFrame) -> DataFrame:
    """(file_path, repository_id, source_id): a file's first function, class or method, else its first node."""
    ranked = F.struct((~F.col("kind").isin("function", "class", "method")).alias("other"), "seq", "id")
    return nodes.groupBy("file_path", "repository_id").agg(F.min(ranked)["id"].alias("source_id"))


def target_base(file_path: Column, source: Column) -> Column:
    """A relative source as a path, without what may follow it."""
    return normal_path(F.concat_ws("/", directory(file_path), source))


def target_paths(file_path: Column, source: Column) -> Column:
    """The paths that a relative source can stand for."""
    return with_suffixes(target_base(file_path, source))


def with_suffixes(base: Column) -> Column:
    return F.transform(F.array(*[F.lit(s) for s in IMPORT_SUFFIXES]), lambda s: F.concat(base, s))


def names_of_path(path: Column) -> Column:
    """The ways in which an import can name a file: with and without its ending."""
    return F.array_distinct(F.array(path, F.regexp_replace(path, r"\.(ts|tsx|js|jsx)$", "")))


def import_edges(imports: DataFrame, nodes: DataFrame) -> DataFrame:
    """``imports``: (file_path, source, imported, repository_id). Only relative sources resolve.

    The path test becomes a second join key: each import names the few paths that its source can stand for. The
    importing symbol is that of :func:`first_symbols`. Imports are made distinct before their paths are listed, so the
    table that a task holds for it has a row an import, not one a path.
    """
    based = imports.where(F.col("source").startswith(".")).select("file_path", "imported", "repository_id", target_base(F.col("file_path"), F.col("source")).alias("base")).distinct()
    wanted = based.select("file_path", "imported", "repository_id", F.explode(with_suffixes(F.col("base"))).alias("target_path"))
    placed = nodes.select(F.col("id").alias("target_id"), F.col("name").alias("imported"), "repository_id", F.col("file_path").alias("own_path"))
    targets = placed.select("target_id", "imported", "repository_id", "own_path", F.explode(names_of_path(F.col("own_path"))).alias("target_path"))
    found = wanted.join(targets, ["imported", "repository_id", "target_path"]).where("own_path <> file_path")
    return found.join(first_symbols(nodes), ["file_path", "repository_id"]).select(*_edge(F.lit("imports"), 1.0)).dropDuplicates(["id"])


def resolve(nodes: DataFrame, calls: DataFrame, imports: DataFrame, parents: DataFrame) -> DataFrame:
    """All edges of the references, each id once."""
    found = reduce(DataFrame.unionByName, [call_edges(calls, nodes), inheritance_edges(parents, nodes), import_edges(imports, nodes)])
    return found.dropDuplicates(["id"])
