"""Point lookups, filters and pages over nodes, edges, files and repositories.

Filters are plain predicates, so Catalyst pushes them into the scan. Whatever the data model orders by insertion is
ordered by the column ``seq``.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SYMBOL_COLUMNS = ("id", "name", "qualified_name", "kind", "file_path", "line_start", "line_end", "is_exported", "repository_id", "language")


@dataclass(frozen=True)
class NodeFilter:
    """Conjunction of optional tests. ``sql_style`` picks LIKE-like substring tests over name and qualified name;
    otherwise ``file_path`` is a case-sensitive substring and ``name_pattern`` a case-insensitive regex on the name."""

    kind: str | None = None
    language: str | None = None
    repository_id: str | None = None
    file_path: str | None = None
    visibility: str | None = None
    name_pattern: str | None = None
    sql_style: bool = False

    def column(self) -> Column:
        tests = [F.col(c) == v for c in ("kind", "language", "repository_id", "visibility") if (v := getattr(self, c)) is not None]
        if self.file_path is not None:
            tests.append(F.col("file_path").ilike(f"%{self.file_path}%") if self.sql_style else F.col("file_path").contains(self.file_path))
        if self.name_pattern is not None:
            if self.sql_style:
                like = f"%{self.name_pattern}%"
                tests.append(F.col("name").ilike(like) | F.col("qualified_name").ilike(like))
            else:
                tests.append(name_matches(self.name_pattern))
        out = F.lit(True)
        for t in tests:
            out = out & t
        return out


def name_matches(pattern: str) -> Column:
    """A regex anywhere in the name, whatever the case; a broken regex matches nothing."""
    try:
        re.compile(pattern)
    except re.error:
        return F.lit(False)
    return F.col("name").rlike(f"(?i){pattern}")


def page(df: DataFrame, order: list[Column], limit: int = 10, offset: int = 0) -> DataFrame:
    """Rows ``offset`` to ``offset + limit`` in the order given; the sort keeps no more than these in each task."""
    if not 1 <= limit <= 100 or offset < 0:
        raise ValueError("limit must be 1 to 100 and offset 0 or more")
    return df.orderBy(*order).offset(offset).limit(limit)


def page_info(df: DataFrame, limit: int, offset: int) -> DataFrame:
    """One row: total, limit, offset, has_more."""
    return df.agg(F.count(F.lit(1)).alias("total")).select("total", F.lit(limit).alias("limit"), F.lit(offset).alias("offset"), (F.col("total") > limit + offset).alias("has_more"))


def by_key(table: DataFrame, **key: object) -> DataFrame:
    """Rows with exactly these values: a repository by id or path, a file by path and repository, a node or edge by id."""
    if not key:
        raise ValueError("a key needs a column")
    out = table
    for column, value in key.items():
        out = out.where(F.col(column).eqNullSafe(F.lit(value)))
    return out


def find_symbol(nodes: DataFrame, pattern: str, kind: str | None = None, limit: int = 10, offset: int = 0) -> DataFrame:
    found = nodes.where(NodeFilter(kind=kind, name_pattern=pattern).column())
    return page(found, [F.col("seq")], limit, offset).select(*SYMBOL_COLUMNS)


def first_by_name(nodes: DataFrame, name: str, kind: str | None = None) -> DataFrame:
    """One row at most: the first node of this name."""
    own = nodes.where(NodeFilter(kind=kind).column() & (F.col("name") == name))
    return own.orderBy("seq", "id").limit(1)


def _neighbours(nodes: DataFrame, edges: DataFrame, ids: DataFrame, kinds: tuple[str, ...] | None, here: str, there: str) -> DataFrame:
    own = edges.where(F.col("kind").isin(*kinds)) if kinds else edges
    near = own.join(ids.select(F.col("id").alias(here)), here, "left_semi").groupBy(there).agg(F.min("seq").alias("edge_seq"))
    return nodes.join(near, nodes["id"] == near[there]).select(*[nodes[c] for c in nodes.columns], "edge_seq")


def callers(nodes: DataFrame, edges: DataFrame, ids: DataFrame, kinds: tuple[str, ...] | None = ("calls",)) -> DataFrame:
    """Nodes with an edge of these kinds to a node of ``ids`` (column id), each once."""
    return _neighbours(nodes, edges, ids, kinds, "target_id", "source_id")


def callees(nodes: DataFrame, edges: DataFrame, ids: DataFrame, kinds: tuple[str, ...] | None = ("calls",)) -> DataFrame:
    return _neighbours(nodes, edges, ids, kinds, "source_id", "target_id")


def find_callers(nodes: DataFrame, edges: DataFrame, name: str, limit: int = 10, offset: int = 0) -> DataFrame:
    """Callers of the first node of this name, in the order of the nodes."""
    return page(callers(nodes, edges, first_by_name(nodes, name).select("id")), [F.col("seq")], limit, offset).select(*SYMBOL_COLUMNS)


def find_callees(nodes: DataFrame, edges: DataFrame, name: str, limit: int = 10, offset: int = 0) -> DataFrame:
    return page(callees(nodes, edges, first_by_name(nodes, name).select("id")), [F.col("seq")], limit, offset).select(*SYMBOL_COLUMNS)


def list_files(files: DataFrame, repository_id: str, status: str | None = None) -> DataFrame:
    own = files.where(F.col("repository_id") == repository_id)
    return (own.where(F.col("status") == status) if status else own).orderBy("path")


def with_languages(repositories: DataFrame, nodes: DataFrame) -> DataFrame:
    """Each repository with its nodes by language, as a map: one aggregate for all repositories."""
    counts = nodes.groupBy("repository_id", "language").agg(F.count(F.lit(1)).alias("n"))
    maps = counts.groupBy("repository_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("language", "n")))).alias("languages"), F.sum("n").alias("node_count"))
    return repositories.join(maps, repositories["id"] == maps["repository_id"], "left").drop(maps["repository_id"])


def list_repositories(repositories: DataFrame, nodes: DataFrame, watched: list[str]) -> DataFrame:
    """Newest first, with a status; a watched path that is the repository's or a prefix of it counts."""
    path, is_watched = F.col("path"), F.lit(False)
    for w in watched:
        is_watched = is_watched | (path == w) | path.startswith(w)
    n = F.coalesce("node_count", F.lit(0))
    status = F.when(n == 0, "empty").when(is_watched, "indexed, watching").otherwise("indexed")
    return with_languages(repositories, nodes).withColumn("node_count", n).withColumn("status", status).orderBy(F.desc("created_at"), "id")


def repository_at(repositories: DataFrame, path: str) -> DataFrame:
    """The repository of this path, or of a path that ends with it."""
    return repositories.where((F.col("path") == path) | F.col("path").endswith(path))


def node_details(nodes: DataFrame, edges: DataFrame, node: str, repository_id: str, most: int = 20) -> DataFrame:
    """One row for the node, if it is of this repository, with its first callers and callees and their numbers."""
    kinds = ("calls", "imports", "extends", "implements", "references")
    own = nodes.where((F.col("id") == node) & (F.col("repository_id") == repository_id))
    out = own.select(*SYMBOL_COLUMNS)
    for name, near in (("callers", callers), ("callees", callees)):
        found = near(nodes, edges, own.select("id"), kinds)
        first = found.orderBy("seq").limit(most).agg(F.array_sort(F.collect_list(F.struct("seq", "id"))).alias("x"))
        out = out.crossJoin(F.broadcast(first.select(F.transform("x", lambda s: s["id"]).alias(name)))).crossJoin(F.broadcast(found.agg(F.count(F.lit(1)).alias(f"{name}_total"))))
    return out


def edges_of(edges: DataFrame, source_id: str | None = None, target_id: str | None = None, kinds: tuple[str, ...] | None = None) -> DataFrame:
    """Edges with these ends and kinds; what is not given is not tested."""
    own = edges
    for column, value in (("source_id", source_id), ("target_id", target_id)):
        own = own.where(F.col(column) == value) if value is not None else own
    return own.where(F.col("kind").isin(*kinds)) if kinds else own


def pattern(nodes: DataFrame, edges: DataFrame, source: NodeFilter, kinds: tuple[str, ...] | None, target: NodeFilter) -> DataFrame:
    """(source, kind, target): pairs of nodes that pass the two filters, with an edge of these kinds between them."""
    ends = [nodes.where(f.column()).select(F.col("id").alias(f"{end}_id"), F.col("name").alias(end)) for end, f in (("source", source), ("target", target))]
    return edges_of(edges, kinds=kinds).join(ends[0], "source_id").join(ends[1], "target_id").select("source", "kind", "target")
