"""Queries over the graph that the given tables form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import aggregate, graph, layout, linking, lookup, resolve
from tessera.plans.bindings import EVENT_EDGES_SQL, GRAPH_SQL, edges, event_edges, nodes
from tessera.storage import read, scratch, settle

_SYMBOL = "id, name, qualified_name, kind, file_path, line_start, line_end, is_exported, repository_id, language"
_HEAD = f"WITH RECURSIVE {GRAPH_SQL}"


def _seed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.first_by_name(nodes(spark, sf_dir), "ASIA").select("id")


def find_symbol(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.find_symbol(nodes(spark, sf_dir), "customer#0+1[0-9]$", "function", 20)


def nodes_like(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = lookup.NodeFilter(kind="method", name_pattern="SUPPLIER", file_path="/N1", sql_style=True)
    return nodes(spark, sf_dir).where(own.column()).select("id", "name", "file_path")


def nodes_matching(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = lookup.NodeFilter(language="typescript", file_path="world/n1/", name_pattern="#.*[05]$")
    return nodes(spark, sf_dir).where(own.column()).select("id", "name", "file_path")


def nodes_in_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nodes(spark, sf_dir).where("file_path = 'world/n3/suppliers.go'").select("id", "name", "line_start")


def exported_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nodes(spark, sf_dir).where("is_exported AND kind = 'class'").select("id", "name")


def find_callers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.find_callers(nodes(spark, sf_dir), edges(spark, sf_dir), "NATION_3", 50)


def find_callees(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = nodes(spark, sf_dir).where("kind = 'function'").agg(F.min("name")).first()[0]
    return lookup.find_callees(nodes(spark, sf_dir), edges(spark, sf_dir), name, 50)


def callers_of_every_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = nodes(spark, sf_dir)
    return lookup.callers(n, edges(spark, sf_dir), n.where("name = 'NATION_3'").select("id"), None).select("id", "name", "kind")


def impact_radius(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.impact_radius(nodes(spark, sf_dir), edges(spark, sf_dir), _seed(spark, sf_dir), 10)


def impact_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = edges(spark, sf_dir)
    out = graph.impact_summary(graph.impact_radius(nodes(spark, sf_dir), e, _seed(spark, sf_dir), 2), e)
    return out.withColumn("confidence", F.round("confidence", 6))


def reach_cyclic(spark: SparkSession, sf_dir: str) -> DataFrame:
    seed = spark.createDataFrame([("signup",)], "id string")
    return graph.reach(event_edges(spark, sf_dir), seed, 5, reverse=False)


def shortest_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = edges(spark, sf_dir).where("source_id LIKE 'orders:%'").agg(F.min_by("source_id", "seq")).first()[0]
    region = nodes(spark, sf_dir).where("kind = 'namespace'").select("id").collect()  # five rows
    return graph.shortest_paths(edges(spark, sf_dir), first, [r[0] for r in region]).select("step", "id")


_CHAIN = "SELECT dense_rank() OVER (ORDER BY c_nationkey, k) AS place FROM (SELECT DISTINCT c_nationkey, c_custkey % 3 AS k FROM customer)"


def longest_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The path through all groups of customers, each with an edge to the next: longer than any bound one would set."""
    read(spark, sf_dir, "customer").createOrReplaceTempView("__customer")
    places = spark.sql(_CHAIN.replace("FROM customer", "FROM __customer")).repartition(1)
    chain = settle(places.selectExpr("'g' || place AS source_id", "'g' || (place + 1) AS target_id"), "chain")
    return graph.path_summary(graph.shortest_path(chain, "g1", f"g{chain.count() + 1}"))


def edge_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = lookup.pattern(nodes(spark, sf_dir), edges(spark, sf_dir), lookup.NodeFilter(kind="function", language="typescript"), ("calls",), lookup.NodeFilter(kind="class", name_pattern="^NATION_[0-9]$"))
    return own.groupBy("kind", "target").agg(F.count(F.lit(1)).alias("n"))


def edges_into(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.edges_of(edges(spark, sf_dir), target_id="nation:3", kinds=("calls", "imports")).select("source_id", "kind")


def node_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lookup.node_details(nodes(spark, sf_dir), edges(spark, sf_dir), "nation:3", "repo0", 5)
    return found.select("id", "name", F.array_join("callers", ",").alias("callers"), F.array_join("callees", ",").alias("callees"), "callers_total", "callees_total")


def call_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = read(spark, sf_dir, "orders").selectExpr("'orders:' || o_orderkey AS caller_id", "'Customer#' || lpad(CAST(o_custkey AS STRING), 9, '0') AS callee_name", "'repo' || (o_custkey % 3) AS repository_id")
    return resolve.call_edges(calls, nodes(spark, sf_dir)).select("id", "source_id", "target_id", "confidence")


def relinked_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edges of ``call_edges``, put together from three batches: at first customers have other names, then their
    files change, some before and some after the files that call them."""
    path = scratch(spark, "linked")
    calls = read(spark, sf_dir, "orders").selectExpr("'orders/' || substr(o_orderpriority, 1, 1) || '.rs' AS file_path", "'repo' || (o_custkey % 3) AS repository_id", "'orders:' || o_orderkey AS source_id", "'calls' AS kind", "CAST(0.9 AS DOUBLE) AS confidence", "'Customer#' || lpad(CAST(o_custkey AS STRING), 9, '0') AS name", "CAST(NULL AS ARRAY<STRING>) AS target_paths")
    called = nodes(spark, sf_dir).where("kind = 'function'")
    early, late = F.col("file_path").rlike("(bui|mac)[.]ts"), F.col("file_path") >= "orders/3"
    old = called.where(early).withColumn("name", F.concat(F.lit("old "), "name"))
    first, more = F.col("file_path").contains("/bui.") | ~early, F.col("file_path").contains("/mac.")
    batches = [(old, calls.where(~late)), (called.where(first), calls.where(late)), (called.where(more), calls.limit(0))]
    for number, (own, refs) in enumerate(batches):
        linking.apply(spark, path, number, own.select("repository_id", "file_path").union(refs.select("repository_id", "file_path")), own, refs)
    return linking.current(spark, path)[1].select("id", "source_id", "target_id", "confidence")


def graph_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places after all rounds; their sums are exact, so they are the same on each run."""
    return layout.places(nodes(spark, sf_dir), edges(spark, sf_dir))


def inheritance_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    parents = read(spark, sf_dir, "nation").selectExpr("'nation:' || n_nationkey AS child_id", "CASE WHEN n_regionkey % 2 = 0 THEN 'ASIA' ELSE 'EUROPE' END AS parent_name", "CASE WHEN n_nationkey % 2 = 0 THEN 'extends' ELSE 'implements' END AS kind", "'repo0' AS repository_id")
    return resolve.inheritance_edges(parents, nodes(spark, sf_dir)).select("id", "source_id", "target_id", "kind")


def import_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    imports = read(spark, sf_dir, "customer").selectExpr("'world/n' || c_nationkey || '/bui.ts' AS file_path", "'../n' || c_nationkey || '/./' || lower(substr(c_mktsegment, 1, 3)) AS source", "c_name AS imported", "'repo' || (c_custkey % 3) AS repository_id")
    return resolve.import_edges(imports, nodes(spark, sf_dir)).select("source_id", "target_id")


def view_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.view_totals(nodes(spark, sf_dir), "function", 100)


def degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.degrees(edges(spark, sf_dir))


def degrees_cyclic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.degrees(event_edges(spark, sf_dir))


def dead_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.dead_code(nodes(spark, sf_dir), edges(spark, sf_dir), "repo1").select("id", "name", "kind")


def entry_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.entry_points(nodes(spark, sf_dir), "repo0").select("id", "name", "kind")


def modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.modules(nodes(spark, sf_dir), "repo0").withColumn("top_symbols", F.array_join("top_symbols", ","))


def key_abstractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.key_abstractions(nodes(spark, sf_dir), edges(spark, sf_dir), "repo0").select("id", "name", "degree")


def package_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.package_structure(nodes(spark, sf_dir), "repo2")


def graph_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = graph.graph_stats(nodes(spark, sf_dir), edges(spark, sf_dir))
    pairs = F.transform(F.array_sort(F.map_entries("languages")), lambda e: F.concat_ws(":", e["key"], e["value"].cast("string")))
    return found.withColumn("languages", F.array_join(pairs, ","))


def language_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregate.language_counts(nodes(spark, sf_dir))


def languages_of_repositories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregate.languages_of_repositories(nodes(spark, sf_dir))


def graph_view_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, e = nodes(spark, sf_dir), edges(spark, sf_dir)
    return graph.graph_view(n, e, None, 300)[1].select("source_id", "target_id", "kind")


def complex_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.complex_functions(nodes(spark, sf_dir), 25).select("id", "complexity", graph.complexity_rating(F.col("complexity")).alias("rating"))


def node_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.page(nodes(spark, sf_dir).where("kind = 'function'"), [F.col("seq")], 15, 30).select("id", "name")


def page_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.page_info(nodes(spark, sf_dir).where("kind = 'function'"), 15, 30)


_REACH = "reach(id, depth) AS (SELECT id, 0 FROM (SELECT id FROM nodes WHERE name = 'ASIA' ORDER BY seq LIMIT 1) UNION SELECT e.source_id, r.depth + 1 FROM reach r JOIN edges e ON e.target_id = r.id WHERE r.depth < {depth})"

QUERIES = {
    "find_symbol": (find_symbol, f"{_HEAD} SELECT {_SYMBOL} FROM nodes WHERE kind = 'function' AND regexp_matches(name, '(?i)customer#0+1[0-9]$') ORDER BY seq LIMIT 20"),
    "nodes_like": (nodes_like, f"{_HEAD} SELECT id, name, file_path FROM nodes WHERE kind = 'method' AND file_path ILIKE '%/N1%' AND (name ILIKE '%SUPPLIER%' OR qualified_name ILIKE '%SUPPLIER%')"),
    "nodes_matching": (nodes_matching, f"{_HEAD} SELECT id, name, file_path FROM nodes WHERE language = 'typescript' AND contains(file_path, 'world/n1/') AND regexp_matches(name, '(?i)#.*[05]$')"),
    "nodes_in_file": (nodes_in_file, f"{_HEAD} SELECT id, name, line_start FROM nodes WHERE file_path = 'world/n3/suppliers.go'"),
    "exported_nodes": (exported_nodes, f"{_HEAD} SELECT id, name FROM nodes WHERE is_exported AND kind = 'class'"),
    "find_callers": (find_callers, f"{_HEAD} SELECT {_SYMBOL} FROM nodes WHERE id IN (SELECT source_id FROM edges WHERE kind = 'calls' AND target_id = (SELECT id FROM nodes WHERE name = 'NATION_3' ORDER BY seq LIMIT 1)) ORDER BY seq LIMIT 50"),
    "find_callees": (find_callees, f"{_HEAD} SELECT {_SYMBOL} FROM nodes WHERE id IN (SELECT target_id FROM edges WHERE kind = 'calls' AND source_id = (SELECT id FROM nodes WHERE name = (SELECT min(name) FROM nodes WHERE kind = 'function') ORDER BY seq LIMIT 1)) ORDER BY seq LIMIT 50"),
    "callers_of_every_kind": (callers_of_every_kind, f"{_HEAD} SELECT id, name, kind FROM nodes WHERE id IN (SELECT source_id FROM edges WHERE target_id IN (SELECT id FROM nodes WHERE name = 'NATION_3'))"),
    "impact_radius": (impact_radius, f"{_HEAD}, {_REACH.format(depth=10)} SELECT n.id, name, kind, file_path, min(depth) AS depth FROM reach r JOIN nodes n ON n.id = r.id GROUP BY n.id, name, kind, file_path"),
    "impact_summary": (impact_summary, f"{_HEAD}, {_REACH.format(depth=2)}, hit AS (SELECT id, min(depth) AS depth FROM reach GROUP BY id) SELECT count(*) AS n_nodes, count(DISTINCT file_path) AS n_files, max(depth) AS depth, round((SELECT coalesce(avg(confidence), 1.0) FROM edges WHERE target_id IN (SELECT id FROM hit)), 6) AS confidence FROM hit JOIN nodes USING (id)"),
    "reach_cyclic": (reach_cyclic, f"WITH RECURSIVE edges AS ({EVENT_EDGES_SQL}), reach(id, depth) AS (SELECT 'signup', 0 UNION SELECT e.target_id, r.depth + 1 FROM reach r JOIN edges e ON e.source_id = r.id WHERE r.depth < 5) SELECT id, min(depth) AS depth FROM reach GROUP BY id"),
    "shortest_path": (shortest_path, f"{_HEAD}, start AS (SELECT source_id AS id FROM edges WHERE source_id LIKE 'orders:%' ORDER BY seq LIMIT 1), walk(step, id) AS (SELECT 0, id FROM start UNION ALL SELECT step + 1, e.target_id FROM walk w JOIN edges e ON e.source_id = w.id) SELECT step, id FROM walk"),
    "longest_chain": (longest_chain, f"SELECT true AS found, count(*) AS length FROM ({_CHAIN})"),
    "edge_patterns": (edge_patterns, f"{_HEAD} SELECT e.kind, t.name AS target, count(*) AS n FROM edges e JOIN nodes s ON s.id = e.source_id JOIN nodes t ON t.id = e.target_id WHERE e.kind = 'calls' AND s.kind = 'function' AND s.language = 'typescript' AND t.kind = 'class' AND regexp_matches(t.name, '(?i)^NATION_[0-9]$') GROUP BY 1, 2"),
    "edges_into": (edges_into, f"{_HEAD} SELECT source_id, kind FROM edges WHERE target_id = 'nation:3' AND kind IN ('calls', 'imports')"),
    "node_details": (node_details, f"{_HEAD}, near AS (SELECT 'callers' AS side, n.id, n.seq FROM nodes n WHERE id IN (SELECT source_id FROM edges WHERE target_id = 'nation:3') UNION ALL SELECT 'callees', n.id, n.seq FROM nodes n WHERE id IN (SELECT target_id FROM edges WHERE source_id = 'nation:3')), placed AS (SELECT *, row_number() OVER (PARTITION BY side ORDER BY seq) AS place FROM near) SELECT id, name, (SELECT string_agg(id, ',' ORDER BY seq) FROM placed WHERE side = 'callers' AND place <= 5) AS callers, (SELECT string_agg(id, ',' ORDER BY seq) FROM placed WHERE side = 'callees' AND place <= 5) AS callees, (SELECT count(*) FROM near WHERE side = 'callers') AS callers_total, (SELECT count(*) FROM near WHERE side = 'callees') AS callees_total FROM nodes WHERE id = 'nation:3' AND repository_id = 'repo0'"),
    "call_edges": (call_edges, f"{_HEAD}, calls AS (SELECT DISTINCT 'orders:' || o_orderkey AS source_id, 'Customer#' || lpad(CAST(o_custkey AS VARCHAR), 9, '0') AS callee, 'repo' || (o_custkey % 3) AS repository_id FROM orders) SELECT substr(sha256(source_id || ':' || n.id || ':calls'), 1, 16) AS id, source_id, n.id AS target_id, CAST(0.9 AS DOUBLE) AS confidence FROM calls c JOIN nodes n ON n.name = c.callee AND n.repository_id = c.repository_id"),
    "relinked_edges": (relinked_edges, f"{_HEAD}, calls AS (SELECT DISTINCT 'orders:' || o_orderkey AS source_id, 'Customer#' || lpad(CAST(o_custkey AS VARCHAR), 9, '0') AS callee, 'repo' || (o_custkey % 3) AS repository_id FROM orders) SELECT substr(sha256(source_id || ':' || n.id || ':calls'), 1, 16) AS id, source_id, n.id AS target_id, CAST(0.9 AS DOUBLE) AS confidence FROM calls c JOIN nodes n ON n.name = c.callee AND n.repository_id = c.repository_id"),
    "graph_layout": (graph_layout, None),
    "inheritance_edges": (inheritance_edges, f"{_HEAD}, p AS (SELECT 'nation:' || n_nationkey AS source_id, CASE WHEN n_regionkey % 2 = 0 THEN 'ASIA' ELSE 'EUROPE' END AS parent, CASE WHEN n_nationkey % 2 = 0 THEN 'extends' ELSE 'implements' END AS kind FROM nation) SELECT substr(sha256(source_id || ':' || n.id || ':' || p.kind), 1, 16) AS id, source_id, n.id AS target_id, p.kind FROM p JOIN nodes n ON n.name = p.parent AND n.repository_id = 'repo0'"),
    "import_edges": (import_edges, f"{_HEAD}, firsts AS (SELECT file_path, repository_id, arg_min(id, seq) AS source_id FROM nodes WHERE kind = 'function' GROUP BY 1, 2) SELECT DISTINCT f.source_id, n.id AS target_id FROM nodes n JOIN firsts f ON f.repository_id = n.repository_id AND f.file_path = regexp_replace(n.file_path, '[^/]*$', 'bui.ts') WHERE n.kind = 'function' AND n.file_path <> f.file_path"),
    "view_totals": (view_totals, f"{_HEAD} SELECT count(*) AS total, least(count(*), 100) AS shown, count(*) > 100 AS truncated FROM nodes WHERE kind = 'function'"),
    "degrees": (degrees, f"{_HEAD} SELECT id, count(*) AS degree, CAST(sum(into_) AS BIGINT) AS in_degree FROM (SELECT source_id AS id, 0 AS into_ FROM edges UNION ALL SELECT target_id, 1 FROM edges) GROUP BY id"),
    "degrees_cyclic": (degrees_cyclic, f"WITH edges AS ({EVENT_EDGES_SQL}) SELECT id, count(*) AS degree, CAST(sum(into_) AS BIGINT) AS in_degree FROM (SELECT source_id AS id, 0 AS into_ FROM edges UNION ALL SELECT target_id, 1 FROM edges) GROUP BY id"),
    "dead_code": (dead_code, f"{_HEAD} SELECT id, name, kind FROM nodes WHERE kind IN ('function', 'method', 'class') AND NOT is_exported AND repository_id = 'repo1' AND id NOT IN (SELECT target_id FROM edges)"),
    "entry_points": (entry_points, f"{_HEAD} SELECT id, name, kind FROM nodes WHERE repository_id = 'repo0' AND is_exported AND kind IN ('function', 'class')"),
    "modules": (modules, f"{_HEAD} SELECT module, count(*) AS n_nodes, string_agg(name, ',' ORDER BY place) FILTER (WHERE place <= 5) AS top_symbols FROM (SELECT *, row_number() OVER (PARTITION BY module ORDER BY seq) AS place FROM (SELECT *, CASE WHEN contains(file_path, '/') THEN regexp_extract(file_path, '^(.*)/[^/]*$', 1) ELSE '.' END AS module FROM nodes WHERE repository_id = 'repo0')) GROUP BY module"),
    "key_abstractions": (key_abstractions, f"{_HEAD}, deg AS (SELECT id, count(*) AS degree FROM (SELECT source_id AS id FROM edges UNION ALL SELECT target_id FROM edges) GROUP BY id) SELECT id, name, degree FROM (SELECT n.id, name, kind, coalesce(degree, 0) AS degree FROM nodes n LEFT JOIN deg ON deg.id = n.id WHERE repository_id = 'repo0' ORDER BY coalesce(degree, 0) DESC, seq LIMIT 20) WHERE kind IN ('class', 'interface')"),
    "package_structure": (package_structure, f"{_HEAD} SELECT CASE WHEN contains(file_path, '/') THEN regexp_extract(file_path, '^(.*)/[^/]*$', 1) ELSE '.' END AS package, count(*) AS n_nodes FROM nodes WHERE repository_id = 'repo2' GROUP BY 1"),
    "graph_stats": (graph_stats, f"{_HEAD} SELECT n_nodes, n_files, n_edges, CAST(ceil((200 * n_nodes + 100 * n_edges) * 1.2) AS BIGINT) AS memory_bytes, (SELECT string_agg(language || ':' || n, ',' ORDER BY language) FROM (SELECT language, count(*) AS n FROM nodes GROUP BY language)) AS languages FROM (SELECT count(*) AS n_nodes, count(DISTINCT file_path) AS n_files FROM nodes), (SELECT count(*) AS n_edges FROM edges)"),
    "language_counts": (language_counts, f"{_HEAD} SELECT language, count(*) AS n FROM nodes GROUP BY language"),
    "languages_of_repositories": (languages_of_repositories, f"{_HEAD} SELECT repository_id, language, count(*) AS n FROM nodes GROUP BY repository_id, language"),
    "graph_view_edges": (graph_view_edges, f"{_HEAD}, shown AS (SELECT id FROM nodes ORDER BY seq LIMIT 300) SELECT source_id, target_id, kind FROM edges WHERE source_id IN (SELECT id FROM shown) AND target_id IN (SELECT id FROM shown)"),
    "complex_functions": (complex_functions, f"{_HEAD} SELECT id, complexity, CASE WHEN complexity <= 5 THEN 'simple' WHEN complexity <= 10 THEN 'moderate' WHEN complexity <= 20 THEN 'complex' ELSE 'very complex' END AS rating FROM nodes WHERE kind IN ('function', 'method') AND complexity IS NOT NULL ORDER BY complexity DESC, seq LIMIT 25"),
    "node_page": (node_page, f"{_HEAD} SELECT id, name FROM nodes WHERE kind = 'function' ORDER BY seq LIMIT 15 OFFSET 30"),
    "page_info": (page_info, f"{_HEAD} SELECT count(*) AS total, 15 AS \"limit\", 30 AS \"offset\", count(*) > 45 AS has_more FROM nodes WHERE kind = 'function'"),
}
