"""Record types of the code graph, and the rules that make their ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NODES = (
    "id string, name string, qualified_name string, kind string, file_path string, line_start int, line_end int, "
    "visibility string, is_exported boolean, docstring string, complexity int, repository_id string, language string, seq long"
)
EDGES = "id string, source_id string, target_id string, kind string, confidence double, repository_id string, seq long"
FILES = "path string, repository_id string, hash string, mtime long, size long, language string, status string"
REPOSITORIES = "id string, path string, name string, is_watched boolean, created_at timestamp"
CHUNKS = "id string, node_id string, file_path string, repository_id string, content string, start_line int, end_line int, language string, symbol_context string, embedding array<float>"

# The closed domains of the data model.
NODE_KINDS = ("function", "method", "class", "interface", "type", "variable", "constant", "import", "export", "module", "namespace")
EDGE_KINDS = ("calls", "imports", "extends", "implements", "contains", "references", "called_by", "imported_by", "extended_by", "implemented_by", "contained_by", "referenced_by")
VISIBILITIES = ("public", "private", "protected", "internal")
FILE_STATUSES = ("pending", "indexing", "indexed", "error")


def short_hash(*parts: Column) -> Column:
    """The first 16 hex digits of the SHA-256 of the parts, joined by colons."""
    return F.substring(F.sha2(F.concat_ws(":", *[p.cast("string") for p in parts]), 256), 1, 16)


def node_id(file_path: Column, qualified_name: Column, line_start: Column) -> Column:
    return short_hash(file_path, qualified_name, line_start)


def edge_id(source_id: Column, target_id: Column, kind: Column) -> Column:
    return short_hash(source_id, target_id, kind)


def chunk_id(node: Column, part: Column) -> Column:
    """``part`` is null for a node that is one chunk."""
    return F.when(part.isNull(), short_hash(node)).otherwise(short_hash(node, part))


def one_edge_per_pair(edges):
    """Of edges with one source and target, the first: the graph keeps one edge for each pair."""
    first = F.min_by(F.struct(*[F.col(c) for c in edges.columns]), F.struct("seq", "id")).alias("first")
    return edges.groupBy("source_id", "target_id").agg(first).select("first.*")
