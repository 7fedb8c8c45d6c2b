"""Graph operators on small hand-made graphs."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tessera.operators import aggregate, graph, lookup, merge, resolve
from tessera.schema import EDGES, NODES, edge_id, node_id, one_edge_per_pair


def nodes_of(spark, *rows):
    """Rows of (id, name, kind, file_path, is_exported)."""
    full = [(i, n, n, k, p, 1, 10, None, x, None, None, "r", "typescript", s) for s, (i, n, k, p, x) in enumerate(rows)]
    return spark.createDataFrame(full, NODES)


def edges_of(spark, *pairs, kind="calls", confidence=1.0):
    return spark.createDataFrame([(f"{a}-{b}-{s}", a, b, kind, confidence, "r", s) for s, (a, b) in enumerate(pairs)], EDGES)


@pytest.fixture(scope="module")
def four(spark):
    return nodes_of(spark, *[(str(i), f"n{i}", "function", f"f{i}.ts", False) for i in range(1, 5)])


def ids(df):
    return {r["id"] for r in df.select("id").collect()}


def test_callers_and_callees(spark, four):
    edges = edges_of(spark, ("1", "3"), ("2", "3"), ("3", "4"), ("3", "3"))
    three = spark.createDataFrame([("3",)], "id string")
    assert ids(lookup.callers(four, edges, three)) == {"1", "2", "3"}
    assert ids(lookup.callees(four, edges, three)) == {"3", "4"}
    assert ids(lookup.find_callers(four, edges, "n3", limit=2)) == {"1", "2"}
    assert lookup.find_callers(four, edges, "nobody").count() == 0
    assert lookup.callers(four, edges.withColumn("kind", F.lit("imports")), three).count() == 0


def test_kind_filter_and_broken_regex(spark):
    nodes = nodes_of(spark, ("1", "Auth", "class", "a.ts", True), ("2", "Auth", "function", "b.ts", False))
    assert ids(lookup.find_symbol(nodes, "auth", "class")) == {"1"}
    assert lookup.find_symbol(nodes, "(").count() == 0
    with pytest.raises(ValueError):
        lookup.find_symbol(nodes, "a", limit=0)


def test_impact(spark, four):
    edges = edges_of(spark, ("2", "1"), ("3", "2"), ("4", "3"), ("1", "1"))
    seed = spark.createDataFrame([("1",)], "id string")
    hit = graph.impact_radius(four, edges, seed)
    assert {(r["id"], r["depth"]) for r in hit.collect()} == {("1", 0), ("2", 1), ("3", 2), ("4", 3)}
    assert tuple(graph.impact_summary(hit, edges).first()) == (4, 4, 3, 1.0)
    near = graph.impact_radius(four, edges, seed, 1)
    assert ids(near) == {"1", "2"}
    # the edge from beyond the depth bound counts too: 4 -> 3 does not, 3 -> 2 does
    weak = edges.withColumn("confidence", F.when(F.col("source_id") == "3", 0.1).otherwise(1.0))
    assert graph.impact_summary(near, weak).first()["confidence"] == pytest.approx((1 + 1 + 0.1) / 3)
    with pytest.raises(ValueError):
        graph.impact_radius(four, edges, seed, 0)


def test_shortest_path(spark):
    edges = edges_of(spark, ("1", "2"), ("2", "3"), ("3", "4"), ("1", "4"), ("4", "1"))
    path = lambda a, b: [r["id"] for r in graph.shortest_path(edges, a, b).orderBy("step").collect()]
    assert path("1", "4") == ["1", "4"]
    assert path("2", "1") == ["2", "3", "4", "1"]
    assert path("1", "1") == ["1"]
    assert path("1", "9") == [] and path("9", "1") == []


def test_paths_of_any_length_and_to_several_targets(spark, monkeypatch):
    monkeypatch.setattr(graph, "MERGED", 3)
    chain = edges_of(spark, *[(f"c{k}", f"c{k + 1}") for k in range(60)], ("c5", "x"), ("c9", "x"), ("a", "b"))
    out = graph.shortest_paths(chain, "c0", ["c60", "x", "b", "c0"]).collect()
    by = {t: [r["id"] for r in sorted(out, key=lambda r: r["step"]) if r["target"] == t] for t in ("c60", "x", "b", "c0")}
    assert by == {"c60": [f"c{k}" for k in range(61)], "x": [*[f"c{k}" for k in range(6)], "x"], "b": [], "c0": ["c0"]}
    assert tuple(graph.path_summary(graph.shortest_path(chain, "c0", "x")).first()) == (True, 6)
    assert tuple(graph.path_summary(graph.shortest_path(chain, "c0", "b")).first()) == (False, 0)


def test_dead_code_degrees_and_stats(spark):
    nodes = nodes_of(spark, ("1", "unused", "function", "a.ts", False), ("2", "api", "function", "a.ts", True), ("3", "used", "function", "b.ts", False), ("4", "loop", "method", "b.ts", False), ("5", "T", "type", "b.ts", False))
    edges = edges_of(spark, ("2", "3"), ("4", "4"))
    assert ids(graph.dead_code(nodes, edges)) == {"1"}
    assert {(r["id"], r["degree"], r["in_degree"]) for r in graph.degrees(edges).collect()} == {("2", 1, 0), ("3", 1, 1), ("4", 2, 1)}
    stats = graph.graph_stats(nodes, edges).first()
    assert (stats["n_nodes"], stats["n_files"], stats["n_edges"], stats["languages"], stats["memory_bytes"]) == (5, 2, 2, {"typescript": 5}, 1440)
    details = lookup.node_details(nodes, edges, "3", "r").first()
    assert details["callers"] == ["2"] and details["callers_total"] == 1 and details["callees"] == []
    assert lookup.node_details(nodes, edges, "3", "other").count() == 0


def test_one_edge_for_each_pair_and_ids(spark):
    edges = edges_of(spark, ("1", "2"), ("1", "2"), ("2", "1"))
    assert {r["id"] for r in one_edge_per_pair(edges).collect()} == {"1-2-0", "2-1-2"}
    row = spark.range(1).select(node_id(F.lit("a.ts"), F.lit("A.b"), F.lit(3)).alias("n"), edge_id(F.lit("x"), F.lit("y"), F.lit("calls")).alias("e")).first()
    import hashlib

    assert row["n"] == hashlib.sha256(b"a.ts:A.b:3").hexdigest()[:16] and row["e"] == hashlib.sha256(b"x:y:calls").hexdigest()[:16]


def test_resolution(spark):
    nodes = nodes_of(spark, ("m", "main", "function", "src/app/main.ts", False), ("h", "helper", "function", "src/lib/util.ts", True), ("i", "helper", "function", "src/lib/index.ts", True), ("b", "Base", "class", "src/base.ts", True), ("d", "Child", "class", "src/app/child.ts", True))
    calls = spark.createDataFrame([("m", "helper", "r"), ("m", "helper", "r"), ("m", "gone", "r"), ("m", "helper", "other")], "caller_id string, callee_name string, repository_id string")
    imports = spark.createDataFrame([("src/app/main.ts", "../lib/util", "helper", "r"), ("src/app/main.ts", "../lib", "helper", "r"), ("src/app/main.ts", "lodash", "helper", "r"), ("src/app/main.ts", "./main", "main", "r")], "file_path string, source string, imported string, repository_id string")
    parents = spark.createDataFrame([("d", "Base", "extends", "r")], "child_id string, parent_name string, kind string, repository_id string")
    found = {(r["source_id"], r["target_id"], r["kind"], r["confidence"]) for r in resolve.resolve(nodes, calls, imports, parents).collect()}
    assert found == {("m", "h", "calls", 0.9), ("m", "i", "calls", 0.9), ("m", "h", "imports", 1.0), ("m", "i", "imports", 1.0), ("d", "b", "extends", 1.0)}
    paths = spark.range(1).select(*[resolve.normal_path(F.lit(p)).alias(f"p{k}") for k, p in enumerate(["a/./b", "a/../b", "../b", "a\\b\\..\\c"])]).first()
    assert list(paths) == ["a/b", "b", "b", "a/c"]


def test_maintenance(spark, four):
    edges = edges_of(spark, ("1", "2"), ("2", "3"), ("4", "1"))
    left_nodes, left_edges = merge.delete_file(four, edges, "f1.ts")
    assert ids(left_nodes) == {"2", "3", "4"} and [tuple(r)[1:3] for r in left_edges.collect()] == [("2", "3")]
    tables = {"nodes": four, "edges": edges, "files": spark.createDataFrame([("f", "r", "h", 1, 1, "x", "indexed")], "path string, repository_id string, hash string, mtime long, size long, language string, status string")}
    assert {n: df.count() for n, df in merge.delete_repository(tables, "r").items()} == {"nodes": 0, "edges": 0, "files": 0}
    assert merge.valid_edges(edges_of(spark, ("1", "9"), ("1", "2")), four).count() == 1
    vectors = lambda *rows: spark.createDataFrame(list(rows), "id string, embedding array<float>")
    assert ids(merge.upsert_vectors(vectors(("a", [1.0, 2.0])), vectors(("b", [1.0, 2.0])))) == {"a", "b"}
    assert ids(merge.upsert_vectors(vectors(("a", [1.0, 2.0])), vectors(("b", [1.0])))) == {"b"}


def test_limits_and_debounce(spark):
    start = F.lit("2024-01-01").cast("timestamp")
    at = lambda ms: (start + F.make_dt_interval(secs=F.lit(ms / 1000))).alias("ts")
    change = lambda path, ms, kind, seq: spark.range(1).select(F.lit(path).alias("path"), at(ms), F.lit(kind).alias("change"), F.lit(seq).alias("seq"))
    feed = change("a", 0, "change", 0)
    for row in (("a", 100, "change", 1), ("a", 150, "change", 2), ("b", 0, "change", 3), ("b", 50, "unlink", 4), ("a", 900, "change", 5)):
        feed = feed.unionByName(change(*row))
    out = aggregate.debounced(feed, F.expr("INTERVAL '0.2' SECOND")).select("path", "change", (F.unix_millis("ts") % 1000).alias("ms")).collect()
    assert {tuple(r) for r in out} == {("a", "change", 150), ("a", "change", 900), ("b", "unlink", 50)}
