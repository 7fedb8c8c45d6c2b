"""Streams that run to the end of what there is."""

from __future__ import annotations

import datetime as dt
import json

from pyspark.sql import functions as F

from tessera.operators import resolve
from tessera.schema import EDGES, NODES
from tessera.streaming import feeds


def _drop(folder, name, rows):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(json.dumps(r) for r in rows))


def _run(df, name, mode="append"):
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return df.sparkSession.table(name).collect()


def _at(seconds):
    return (dt.datetime(2024, 1, 1) + dt.timedelta(seconds=seconds)).isoformat()


def test_debounce_gives_the_last_change_of_a_burst(spark, tmp_path):
    rows = [{"ts": _at(s), "seq": k, "path": p, "change": c} for k, (p, s, c) in enumerate([("a", 0, "add"), ("a", 0.1, "change"), ("b", 0, "change"), ("b", 0.05, "unlink"), ("a", 5, "change")])]
    _drop(tmp_path / "feed", "1.json", rows)
    _drop(tmp_path / "feed", "2.json", [{"ts": _at(100), "seq": 9, "path": "z", "change": "add"}])
    out = _run(feeds.debounce(feeds.change_feed(spark, str(tmp_path / "feed"))), "debounced")
    assert {(r["path"], r["change"], r["ts"].second) for r in out if r["path"] != "z"} == {("a", "change", 0), ("b", "unlink", 0), ("a", "change", 5)}


def test_rolling_metrics(spark, tmp_path):
    rows = [{"ts": _at(s), "tool": "find", "duration": d, "error": e, "ip": "x"} for s, d, e in [(1, 10.0, False), (2, 30.0, True)]]
    _drop(tmp_path / "req", "1.json", rows)
    out = _run(feeds.rolling_metrics(feeds.change_feed(spark, str(tmp_path / "req"), feeds.REQUESTS), "60 seconds", "60 seconds"), "rolled", "complete")
    assert [(r["tool"], r["n"], r["avg_duration"], r["error_rate"]) for r in out] == [("find", 2, 20.0, 0.5)]


def test_rate_limit_counts_from_the_first_request(spark, tmp_path):
    rows = [{"ts": _at(30 + 5 * k), "tool": "t", "duration": 1.0, "error": False, "ip": "x"} for k in range(14)] + [{"ts": _at(0), "ip": "y"}]
    _drop(tmp_path / "req", "1.json", rows)
    out = _run(feeds.rate_limit(feeds.change_feed(spark, str(tmp_path / "req"), feeds.REQUESTS)), "limited")
    allowed = [r["allowed"] for r in sorted((r for r in out if r["ip"] == "x"), key=lambda r: r["ts"])]
    assert allowed == [True] * 10 + [False] * 2 + [True] * 2
    assert [r["allowed"] for r in out if r["ip"] == "y"] == [True]


def test_maintenance_replaces_changed_files(spark, tmp_path):
    node = lambda i, f: (i, i, i, "function", f, 1, 2, None, False, None, None, "r", "go", 1)
    start = spark.createDataFrame([node("a", "a.go"), node("b", "b.go"), node("c", "c.go")], NODES), spark.createDataFrame([("1", "a", "b", "calls", 0.9, "r", 1), ("2", "c", "b", "calls", 0.9, "r", 2)], EDGES)

    def parse(changed):
        paths = [r["path"] for r in changed.collect()]
        nodes = spark.createDataFrame([node("b", p) for p in paths if p == "b.go"] + [node("d", p) for p in paths if p == "b.go"], NODES)
        calls = spark.createDataFrame([("b", "d", "r")] if "b.go" in paths else [], "caller_id string, callee_name string, repository_id string")
        return nodes, resolve.call_edges(calls, nodes).withColumn("seq", F.lit(5).cast("long"))

    _drop(tmp_path / "feed", "1.json", [{"ts": _at(0), "seq": 1, "path": "b.go", "change": "change"}, {"ts": _at(1), "seq": 2, "path": "c.go", "change": "change"}, {"ts": _at(2), "seq": 3, "path": "c.go", "change": "unlink"}])
    feeds.maintain(feeds.change_feed(spark, str(tmp_path / "feed")), lambda n: str(tmp_path / f"batch{n}"), parse, str(tmp_path / "ckpt"), start).awaitTermination()
    nodes, edges = (spark.read.parquet(str(tmp_path / "batch0" / t)) for t in ("nodes", "edges"))
    assert {r["id"] for r in nodes.collect()} == {"a", "b", "d"}
    assert {(r["source_id"], r["target_id"]) for r in edges.collect()} == {("a", "b"), ("b", "d")}


def test_a_batch_writes_only_its_changes(spark, tmp_path):
    node = lambda i, f: (i, i, i, "function", f, 1, 2, None, False, None, None, "r", "go", 1)

    def parse(changed):
        rows = [tuple(r) for r in changed.select("path", "content_hash").collect()]
        # a file's version names its nodes; each file calls a node of b.go
        nodes = spark.createDataFrame([node(f"{p[0]}{v}", p) for p, v in rows], NODES)
        edges = spark.createDataFrame([(p, f"{p[0]}{v}-b1", f"{p[0]}{v}", "b1", "calls", 0.9, "r", 1) for p, v in rows], "file_path string, id string, source_id string, target_id string, kind string, confidence double, repository_id string, seq long")
        return nodes, edges

    change = lambda seq, path, kind, version: {"ts": _at(seq), "seq": seq, "path": path, "change": kind, "content_hash": version}
    run = lambda to="graph": feeds.append_changes(feeds.change_feed(spark, str(tmp_path / "feed")), str(tmp_path / to), parse, str(tmp_path / "ckpt")).awaitTermination()
    graph = lambda to="graph": tuple({r[c] for r in df.collect()} for df, c in zip(feeds.current_graph(spark, str(tmp_path / to)), ("id", "source_id"), strict=True))
    _drop(tmp_path / "feed", "1.json", [change(1, "a.go", "add", "1"), change(2, "b.go", "add", "1"), change(3, "c.go", "add", "1")])
    run()
    assert graph() == ({"a1", "b1", "c1"}, {"a1", "b1", "c1"})
    _drop(tmp_path / "feed", "2.json", [change(4, "a.go", "change", "2"), change(5, "c.go", "unlink", None)])
    run()
    assert graph() == ({"a2", "b1"}, {"a2", "b1"})
    assert spark.read.parquet(str(tmp_path / "graph" / "nodes" / "batch=1")).count() == 1
    assert feeds.compact_changes(spark, str(tmp_path / "graph"), str(tmp_path / "merged")) == 1
    assert graph("merged") == graph() and spark.read.parquet(str(tmp_path / "merged" / "nodes")).count() == 2
    _drop(tmp_path / "feed", "3.json", [change(6, "b.go", "change", "2")])
    run("merged")
    assert graph("merged") == ({"a2", "b2"}, set())
