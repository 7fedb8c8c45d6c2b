"""Graph queries over nodes and edges as DataFrames.

Reach and shortest path are loops over a frontier: each round joins the frontier with the edges, drops what was
visited by an anti join, and writes the new frontier to the shared folder, which ends the lineage. A frontier grows
with the graph, so no side is forced to be broadcast; AQE picks the join from the frontier's size.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.storage import settle

#: Tables of visited nodes that a search unites before it writes them as one.
MERGED = 16


def reach(edges: DataFrame, seeds: DataFrame, max_depth: int, reverse: bool = True) -> DataFrame:
    """(id, depth): every node within ``max_depth`` steps of the seeds (column id), which have depth 0."""
    here, there = ("target_id", "source_id") if reverse else ("source_id", "target_id")
    steps = edges.select(F.col(here).alias("id"), F.col(there).alias("next"))
    levels = [settle(seeds.select("id").where("id is not null").distinct().withColumn("depth", F.lit(0)), "frontier")]
    for depth in range(1, max_depth + 1):
        visited = reduce(DataFrame.unionByName, levels).select("id")
        found = levels[-1].select("id").join(steps, "id").select(F.col("next").alias("id")).distinct()
        level = settle(found.join(visited, "id", "left_anti").withColumn("depth", F.lit(depth)), "frontier")
        if level.isEmpty():
            break
        levels.append(level)
    return reduce(DataFrame.unionByName, levels)


def impact_radius(nodes: DataFrame, edges: DataFrame, seed: DataFrame, max_depth: int = 10) -> DataFrame:
    """What a change of the seed affects: each node that reaches it, with its depth; the seed itself has depth 0."""
    if not 1 <= max_depth <= 20:
        raise ValueError("max_depth must be 1 to 20")
    return nodes.join(reach(edges, seed, max_depth), "id").select("id", "name", "kind", "file_path", "depth")


def impact_summary(affected: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: nodes, files, depth, and the mean confidence of all edges into affected nodes (1.0 without any)."""
    into = edges.join(affected.select(F.col("id").alias("target_id")), "target_id", "left_semi").agg(F.avg("confidence").alias("c"))
    counts = affected.agg(F.count(F.lit(1)).alias("n_nodes"), F.count_distinct("file_path").alias("n_files"), F.max("depth").alias("depth"))
    return counts.crossJoin(F.broadcast(into)).select("n_nodes", "n_files", "depth", F.coalesce("c", F.lit(1.0)).alias("confidence"))


def shortest_paths(edges: DataFrame, source: str, targets: list[str]) -> DataFrame:
    """(target, step, id) along a shortest directed path to each target that can be reached, from step 0.

    One search serves all targets and ends when they are found or nothing new is. Of equally short paths, each node
    is reached from its parent of the smallest id. Paths have no greatest length: what was visited is kept in a few
    tables, since the latest ones are merged as they come.
    """
    spark = edges.sparkSession
    steps = edges.select(F.col("source_id").alias("id"), F.col("target_id").alias("next"))
    levels = [settle(spark.createDataFrame([(source, None)], "id string, parent string"), "frontier")]
    visited, open_targets, places = [levels[0].select("id")], set(targets) - {source}, {source: 0} if source in targets else {}
    while open_targets:
        found = levels[-1].select("id").join(steps, "id").groupBy(F.col("next").alias("id")).agg(F.min("id").alias("parent"))
        level = settle(found.join(reduce(DataFrame.unionByName, visited), "id", "left_anti"), "frontier")
        n, hits = level.agg(F.count(F.lit(1)), F.collect_list(F.when(F.col("id").isin(*open_targets), F.col("id")))).first()
        if not n:
            break
        places |= dict.fromkeys(hits, len(levels))
        open_targets -= set(hits)
        levels.append(level)
        visited.append(level.select("id"))
        if len(visited) > MERGED:
            visited = [settle(reduce(DataFrame.unionByName, visited), "visited")]
    rows, at = [(t, last, t) for t, last in places.items()], {t: t for t in places}
    for k in range(len(levels) - 1, 0, -1):  # one row a target and level
        asked = {at[t] for t, last in places.items() if last >= k}
        up = dict(levels[k].where(F.col("id").isin(*asked)).select("id", "parent").collect()) if asked else {}
        for t, last in places.items():
            if last >= k:
                at[t] = up[at[t]]
                rows.append((t, k - 1, at[t]))
    return spark.createDataFrame(rows, "target string, step int, id string")


def shortest_path(edges: DataFrame, source: str, target: str) -> DataFrame:
    """(step, id) along a shortest directed path, from step 0; without a path no rows."""
    return shortest_paths(edges, source, [target]).select("step", "id")


def path_summary(path: DataFrame) -> DataFrame:
    """One row: whether there is a path, and how many edges it has (0 without one)."""
    return path.agg((F.count(F.lit(1)) > 0).alias("found"), F.greatest(F.count(F.lit(1)) - 1, F.lit(0)).alias("length"))


def degrees(edges: DataFrame) -> DataFrame:
    """(id, degree, in_degree): a self loop counts twice in the degree."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("source_id").alias("id"), F.lit(0).alias("into")), F.struct(F.col("target_id").alias("id"), F.lit(1).alias("into")))).alias("e"))
    return ends.groupBy(F.col("e.id").alias("id")).agg(F.count(F.lit(1)).alias("degree"), F.sum(F.col("e.into").cast("long")).alias("in_degree"))


def dead_code(nodes: DataFrame, edges: DataFrame, repository_id: str | None = None) -> DataFrame:
    """Functions, methods and classes that are not exported and that no edge leads to; a self loop does."""
    own = nodes.where(F.col("kind").isin("function", "method", "class") & ~F.coalesce("is_exported", F.lit(False)))
    if repository_id is not None:
        own = own.where(F.col("repository_id") == repository_id)
    return own.join(edges.select(F.col("target_id").alias("id")), "id", "left_anti")


def directory(path: Column) -> Column:
    """What stands before the last slash; a dot without one."""
    return F.when(path.contains("/"), F.regexp_extract(path, r"^(.*)/[^/]*$", 1)).otherwise(".")


def entry_points(nodes: DataFrame, repository_id: str) -> DataFrame:
    return nodes.where((F.col("repository_id") == repository_id) & F.col("is_exported") & F.col("kind").isin("function", "class"))


def modules(nodes: DataFrame, repository_id: str, top_symbols: int = 5) -> DataFrame:
    """(module, n_nodes, top_symbols): nodes by directory, with the names of the first few."""
    own = nodes.where(F.col("repository_id") == repository_id).select(directory(F.col("file_path")).alias("module"), "seq", "name")
    counts = own.groupBy("module").agg(F.count(F.lit(1)).alias("n_nodes"))
    # the first few of each module are found before any list is made
    first = own.withColumn("at", F.row_number().over(Window.partitionBy("module").orderBy("seq"))).where(F.col("at") <= top_symbols)
    lists = first.groupBy("module").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "name"))), lambda x: x["name"]).alias("top_symbols"))
    return counts.join(lists, "module")


def key_abstractions(nodes: DataFrame, edges: DataFrame, repository_id: str, top: int = 20) -> DataFrame:
    """Classes and interfaces among the repository's ``top`` nodes of the highest degree in the whole graph."""
    own = nodes.where(F.col("repository_id") == repository_id).join(degrees(edges).select("id", "degree"), "id", "left")
    best = own.withColumn("degree", F.coalesce("degree", F.lit(0))).orderBy(F.desc("degree"), "seq").limit(top)
    return best.where(F.col("kind").isin("class", "interface"))


def package_structure(nodes: DataFrame, repository_id: str) -> DataFrame:
    own = nodes.where(F.col("repository_id") == repository_id)
    return own.groupBy(directory(F.col("file_path")).alias("package")).agg(F.count(F.lit(1)).alias("n_nodes"))


def graph_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: nodes, edges, files, languages as a map, and the memory a resident graph of this size would take."""
    by = nodes.groupBy("language").agg(F.count(F.lit(1)).alias("n")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("language", "n")))).alias("languages"))
    head = nodes.agg(F.count(F.lit(1)).alias("n_nodes"), F.count_distinct("file_path").alias("n_files"))
    out = head.crossJoin(F.broadcast(edges.agg(F.count(F.lit(1)).alias("n_edges")))).crossJoin(F.broadcast(by))
    return out.withColumn("memory_bytes", F.ceil((200 * F.col("n_nodes") + 100 * F.col("n_edges")) * 1.2))


def induced(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges whose both ends are among ``nodes``."""
    ids = nodes.select("id")
    return edges.join(ids.withColumnRenamed("id", "source_id"), "source_id", "left_semi").join(ids.withColumnRenamed("id", "target_id"), "target_id", "left_semi")


def graph_view(nodes: DataFrame, edges: DataFrame, kind: str | None = None, max_nodes: int = 1000) -> tuple[DataFrame, DataFrame]:
    """The first ``max_nodes`` nodes with a display size, and the edges among them."""
    if not 1 <= max_nodes <= 10_000:
        raise ValueError("max_nodes must be 1 to 10000")
    own = nodes.where(F.col("kind") == kind) if kind else nodes
    shown = own.orderBy("seq").limit(max_nodes)
    size = F.when(F.col("kind") == "class", 10).when(F.col("kind") == "function", 6).otherwise(4)
    return shown.select("id", "name", "kind", "file_path", size.alias("size")), induced(shown, edges)


def view_totals(nodes: DataFrame, kind: str | None = None, max_nodes: int = 1000) -> DataFrame:
    """One row: all nodes of the kind, how many a view shows, and whether it leaves some out."""
    own = nodes.where(F.col("kind") == kind) if kind else nodes
    n = own.agg(F.count(F.lit(1)).alias("total"))
    return n.select("total", F.least("total", F.lit(max_nodes)).alias("shown"), (F.col("total") > max_nodes).alias("truncated"))


def complex_functions(nodes: DataFrame, limit: int = 10, offset: int = 0) -> DataFrame:
    own = nodes.where(F.col("kind").isin("function", "method") & F.col("complexity").isNotNull())
    return own.orderBy(F.desc("complexity"), "seq").offset(offset).limit(limit)


def complexity_rating(complexity: Column) -> Column:
    value = F.coalesce(F.when(complexity != 0, complexity), F.lit(1))
    return F.when(value <= 5, "simple").when(value <= 10, "moderate").when(value <= 20, "complex").otherwise("very complex")
