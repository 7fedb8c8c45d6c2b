"""Exact search of many queries against one query at a time, and the index's recall against all rows."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from tessera.operators import search, vector_index
from tessera.snapshots import SnapshotLog

DATA = "/root/testdata/sf0.01/embeddings.parquet"
pytestmark = pytest.mark.skipif(not os.path.exists(DATA), reason="needs the driver's tables")


@pytest.fixture(scope="module")
def vectors(spark):
    return spark.read.parquet(DATA).select("vec_id", "embedding")


def _found(df):
    out: dict = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["id"], r["distance"]))
    return out


def test_many_queries_at_once_find_what_each_finds_alone(spark, vectors, monkeypatch):
    monkeypatch.setattr(vector_index, "ROWS", 70)
    monkeypatch.setattr(vector_index, "QUERIES", 2)
    odd = spark.createDataFrame([(900, None), (901, [1.0, 2.0]), (902, [None] + [0.1] * 63), (903, [])], "vec_id long, embedding array<float>")
    copies = vectors.where("vec_id = 7").select(F.explode(F.expr("sequence(1000L, 1030L)")).alias("vec_id"), "embedding")
    table = vectors.unionByName(odd).unionByName(copies)
    got = _found(vector_index.exact_nearest(vectors.where("vec_id IN (7, 100, 200)"), table, "vec_id", "embedding", 12))
    assert set(got) == {7, 100, 200}
    for q, found in got.items():
        query = vectors.where(F.col("vec_id") == q).first()["embedding"]
        alone = search.semantic_search(table.where(~F.exists("embedding", F.isnull)), "vec_id", "embedding", query, 12).collect()
        assert found == [(r["id"], r["distance"]) for r in alone]
    assert [i for i, _ in got[7]] == [7, *range(1000, 1011)]


def test_the_index_finds_nine_in_ten_and_reads_its_cells_only(spark, vectors, tmp_path):
    path = str(tmp_path / "index")
    probes = vector_index.build(vectors.where("vec_id < 450"), "vec_id", "embedding", path)
    vector_index.add(vectors.where("vec_id >= 450"), "vec_id", "embedding", path, 1)
    vector_index.add(vectors.where("vec_id >= 450"), "vec_id", "embedding", path, 1)  # counts once
    rows = SnapshotLog(spark, path).read("rows")
    assert rows.count() == vectors.count() and rows.select("id").distinct().count() == vectors.count()
    queries = vectors.where("vec_id % 20 = 0")
    exact, got = _found(vector_index.exact_nearest(queries, vectors, "vec_id", "embedding")), _found(vector_index.nearest(spark, path, queries, "vec_id", "embedding"))
    hits = sum(len({i for i, _ in own} & {i for i, _ in exact[q]}) for q, own in got.items())
    assert hits >= 0.9 * sum(map(len, exact.values())) and 1 <= probes <= 22
    assert all(d == dict(exact[q]).get(i, d) for q, own in got.items() for i, d in own)
    whole = _found(vector_index.nearest(spark, path, queries, "vec_id", "embedding", probes=10_000))
    assert whole == exact
    one = vector_index.nearest(spark, path, queries.limit(1), "vec_id", "embedding", probes=1)
    plan = one._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(folder" in plan or "PartitionFilters: [(folder" in plan or "PartitionFilters: [folder" in plan


def test_small_and_empty_inputs(spark, vectors, tmp_path):
    assert vector_index.exact_nearest(vectors.limit(0), vectors, "vec_id", "embedding").count() == 0
    assert vector_index.build(vectors.where("vec_id = 3"), "vec_id", "embedding", str(tmp_path / "one")) == 1
    assert [r["id"] for r in vector_index.nearest(spark, str(tmp_path / "one"), vectors.where("vec_id = 4"), "vec_id", "embedding").collect()] == [3]
    with pytest.raises(ValueError):
        vector_index.build(vectors.limit(0), "vec_id", "embedding", str(tmp_path / "none"))


def test_the_query_over_all_tables_finds_nine_in_ten(spark):
    from tessera.plans import search_queries

    folder = os.path.dirname(DATA)
    exact, got = ({(r["query_id"], r["vec_id"]) for r in q(spark, folder).collect()} for q in (search_queries.exact_neighbours, search_queries.indexed_neighbours))
    assert len(exact) == 20 * 5 and len(got & exact) >= 0.9 * len(exact)
