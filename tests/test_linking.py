"""A stored graph that follows changing files, against resolving all files anew."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import linking, resolve
from tessera.schema import NODES
from tessera.snapshots import SnapshotLog, Writer

CALLS, IMPORTS, PARENTS = "caller_id string, callee_name string, repository_id string", "file_path string, source string, imported string, repository_id string", "child_id string, parent_name string, kind string, repository_id string"
NAMES = ["run", "stop", "parse", "load", "Base", "Tool"]


def _file(rnd, repo, path):
    """A made-up file: symbols, and what they call, import and extend."""
    own = [(f"{repo}/{path}#{n}", n, n, "class" if n[0].isupper() else "function", path, k + 1, k + 2, None, False, None, None, repo, "typescript", k) for k, n in enumerate(rnd.sample(NAMES, rnd.randrange(0, 4)))]
    calls = [(o[0], rnd.choice(NAMES), repo) for o in own if o[3] == "function" for _ in range(rnd.randrange(3))]
    imports = [(path, rnd.choice(["./a", "./b.ts", "../src/c", "./gone", "react"]), rnd.choice(NAMES), repo) for _ in range(rnd.randrange(3))]
    parents = [(o[0], rnd.choice(["Base", "Tool", "Missing"]), rnd.choice(["extends", "implements"]), repo) for o in own if o[3] == "class"]
    return own, calls, imports, parents


def _tables(spark, files):
    whole = [[row for f in files for row in f[k]] for k in range(4)]
    return [spark.createDataFrame(rows, schema) for rows, schema in zip(whole, (NODES, CALLS, IMPORTS, PARENTS), strict=True)]


def _expected(spark, world):
    return {tuple(r) for r in resolve.resolve(*(t for t in _tables(spark, list(world.values())))).select("id", "source_id", "target_id", "kind", "confidence").collect()}


def _take_in(spark, root, batch, changed):
    nodes, calls, imports, parents = _tables(spark, [f for f in changed.values() if f is not None])
    touched = spark.createDataFrame(list(changed), "repository_id string, file_path string")
    return linking.apply(spark, root, batch, touched, nodes, linking.references(nodes, calls, imports, parents))


def _edges(spark, root):
    return {tuple(r) for r in linking.current(spark, root)[1].select("id", "source_id", "target_id", "kind", "confidence").collect()}


@pytest.mark.parametrize("seed", [1, 2])
def test_edges_after_any_batches_are_those_of_all_files(spark, tmp_path, seed):
    rnd, root, world = random.Random(seed), str(tmp_path), {}
    keys = [(r, f"src/{p}.ts") for r in ("r1", "r2") for p in "abcde"]
    for batch in range(5):
        changed = {k: None if k in world and rnd.random() < 0.25 else _file(rnd, *k) for k in rnd.sample(keys, rnd.randrange(1, 7))}
        world = {k: f for k, f in (world | changed).items() if f is not None}
        _take_in(spark, root, batch, changed)
        assert _edges(spark, root) == _expected(spark, world), batch
        if batch == 2:
            linking.compact(spark, root)
            assert _edges(spark, root) == _expected(spark, world)
    assert {r["id"] for r in linking.current(spark, root)[0].collect()} == {n[0] for f in world.values() for n in f[0]}
    assert _take_in(spark, root, 4, {keys[0]: None}) == SnapshotLog(spark, root).latest() and _edges(spark, root) == _expected(spark, world)


def test_a_batch_reads_the_buckets_of_its_names(spark, tmp_path):
    rnd = random.Random(5)
    _take_in(spark, str(tmp_path), 0, {("r", f"src/{k}.ts"): _file(rnd, "r", f"src/{k}.ts") for k in range(12)})
    log = SnapshotLog(spark, str(tmp_path))
    only = spark.createDataFrame([("run",)], "name string").select(F.pmod(F.xxhash64("name"), F.lit(linking.BUCKETS)).cast("int").alias("bucket"))
    read = linking.stored(log, log.manifest(), "nodes", only)
    assert {r["name"] for r in read.collect()} == {"run"}
    assert "PartitionFilters: [isnotnull(bucket" in read._jdf.queryExecution().executedPlan().toString().replace("#", " #").replace("bucket #", "bucket").split("DataFilters")[0] or read.select(F.input_file_name()).distinct().count() == 1


def test_a_killed_batch_changes_nothing_and_another_writer_is_refused(spark, tmp_path, monkeypatch):
    rnd, root = random.Random(7), str(tmp_path)
    world = {("r", f"src/{k}.ts"): _file(rnd, "r", f"src/{k}.ts") for k in "abc"}
    _take_in(spark, root, 0, world)
    before = _edges(spark, root)
    with monkeypatch.context() as broken:
        append = Writer.append
        broken.setattr(Writer, "append", lambda self, table, *a, **k: (_ for _ in ()).throw(RuntimeError("killed")) if table == "edges" else append(self, table, *a, **k))
        with pytest.raises(RuntimeError):
            _take_in(spark, root, 1, {("r", "src/a.ts"): None})
    assert _edges(spark, root) == before
    _take_in(spark, root, 1, {("r", "src/a.ts"): None})
    del world[("r", "src/a.ts")]
    assert _edges(spark, root) == _expected(spark, world)


def test_a_stream_of_changes_is_followed(spark, tmp_path):
    rnd, root, feed = random.Random(9), str(tmp_path / "graph"), tmp_path / "feed"
    versions = {(path, v): _file(rnd, "r", path) for path in ("src/a.ts", "src/b.ts", "src/c.ts") for v in ("1", "2")}

    def parse(changed):
        nodes, calls, imports, parents = _tables(spark, [versions[r["path"], r["content_hash"]] for r in changed.collect()])
        return nodes, linking.references(nodes, calls, imports, parents)

    def drop(name, *rows):
        feed.mkdir(exist_ok=True)
        (feed / name).write_text("\n".join(json.dumps({"repository_id": "r", "path": p, "seq": s, "change": c, "content_hash": h}) for p, s, c, h in rows))

    def run():
        stream = spark.readStream.schema("repository_id string, path string, seq long, change string, content_hash string").json(str(feed))
        linking.follow(stream, root, parse, str(tmp_path / "ckpt")).awaitTermination()
        return _edges(spark, root)

    drop("1.json", ("src/a.ts", 1, "add", "1"), ("src/b.ts", 2, "add", "1"), ("src/c.ts", 3, "add", "1"))
    assert run() == _expected(spark, {p: versions[p, "1"] for p in ("src/a.ts", "src/b.ts", "src/c.ts")})
    drop("2.json", ("src/a.ts", 4, "change", "1"), ("src/a.ts", 5, "change", "2"), ("src/c.ts", 6, "unlink", None))
    assert run() == _expected(spark, {"a": versions["src/a.ts", "2"], "b": versions["src/b.ts", "1"]})
