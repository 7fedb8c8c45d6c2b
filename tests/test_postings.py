"""Words and their places: put together in the task that reads a text."""

from __future__ import annotations

import re
from collections import defaultdict

from pyspark.sql import functions as F

from tessera.operators import search

TEXTS = [(1, "b a b"), (2, "a"), (2, "c a a"), (None, "a z"), (3, None), (4, " ... "), (5, "Éa a\U00010400b")]


def test_places_and_counts_match_brute_force(spark, monkeypatch):
    docs = spark.createDataFrame(TEXTS, "id long, text string").coalesce(1)
    split = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    places = [(i, w, [k for k, x in enumerate(split(t)) if x == w]) for i, t in TEXTS for w in set(split(t))]
    for most in (1, 2, search.SLICE_TOKENS):
        monkeypatch.setattr(search, "SLICE_TOKENS", most)
        got = search.word_positions(docs.select("id", search.tokens(F.col("text")).alias("words"))).collect()
        assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, places))
    figures = defaultdict(lambda: [set(), 0, 0])
    for i, w, at in places:
        figures[w][0].update([i] if i is not None else [])
        figures[w][1:] = figures[w][1] + len(at), max(figures[w][2], at[-1])
    counts = {r["token"]: [r["n_docs"], r["n"], r["last_position"]] for r in search.posting_counts(docs, "id", "text").collect()}
    assert counts == {w: [len(ids), n, last] for w, (ids, n, last) in figures.items()}
    assert search.posting_counts(docs.limit(0), "id", "text").count() == 0


def test_counts_shuffle_no_list_of_places(spark):
    docs = spark.createDataFrame([(1, "a b")], "id long, text string")
    plan = search.posting_counts(docs, "id", "text")._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan and plan.count("Exchange") == 1


def test_an_index_places_words_where_it_reads_them(spark, tmp_path, monkeypatch):
    from tessera.operators import text_index
    from tessera.snapshots import SnapshotLog

    texts = [(1, "a a a b", "b"), (2, None, None), (3, "b a a", "a a a a"), (4, "x", None)]
    docs = spark.createDataFrame(texts, "id long, title string, body string").coalesce(1)
    staged, stage = [], text_index._stage_postings
    monkeypatch.setattr(text_index, "_stage_postings", lambda writer, postings, *more, **named: (staged.append(postings), stage(writer, postings, *more, **named)))
    for most in (1, 3, search.SLICE_TOKENS):
        monkeypatch.setattr(search, "SLICE_TOKENS", most)
        path = str(tmp_path / f"index{most}")
        text_index.add_batch(docs, "id", ["title", "body"], path, 0)
        lengths = {r["id"]: r["length"] for r in text_index.current(spark, path).collect()}
        assert lengths == {1: 5, 2: 0, 3: 7, 4: 1}
        stored = {(r["word"], r["field"], r["id"]): r["positions"] for r in SnapshotLog(spark, path).read("postings").where("word <> ''").collect()}
        assert stored == {("a", "title", 1): [0, 1, 2], ("b", "title", 1): [3], ("b", "body", 1): [0], ("b", "title", 3): [0], ("a", "title", 3): [1, 2], ("a", "body", 3): [0, 1, 2, 3], ("x", "title", 4): [0]}
        for phrase in ("a a", "a a a b", "b", "b a", "a", "b b"):
            given = [[(r["id"], round(r["rank"], 9)) for r in found.collect()] for found in (text_index.phrase_search(spark, path, phrase), search.exact_search(docs, "id", ["title", "body"], phrase))]
            assert given[0] == given[1]
    plan = staged[0]._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Exchange" not in plan and "Generate" not in plan


def test_an_index_stores_one_row_for_a_word_of_many_texts(spark, tmp_path):
    from tessera.operators import text_index
    from tessera.snapshots import SnapshotLog, Writer

    path, docs = str(tmp_path / "index"), spark.range(1000).selectExpr("id", "IF(id % 2 = 0, 'a b a', 'b') AS text").coalesce(1)
    text_index.add_batch(docs, "id", ["text"], path, 0)
    log = SnapshotLog(spark, path)
    files = spark.read.parquet(*[f"{path}/{f}" for f in log.manifest()["tables"]["postings"]["folders"]])
    assert sorted(r["word"] for r in files.collect()) == ["", "a", "b"]
    read = lambda: sorted(map(tuple, log.read("postings").where("word <> ''").select("word", "id", "positions", "batch").collect()))
    first = sorted([("a", k, [0, 2], 0) for k in range(0, 1000, 2)] + [("b", k, [1] if k % 2 == 0 else [0], 0) for k in range(1000)])
    assert read() == first
    # rows that were stored one by one are read beside packed ones
    writer = Writer(log, log.manifest())
    text_index._stage_postings(writer, spark.createDataFrame([("c", "text", 7, [3], 1)], "word string, field string, id long, positions array<int>, batch int"), 8)
    writer.commit("index", 1)
    assert read() == [*first, ("c", 7, [3], 1)]
    text_index.compact(spark, path)
    assert [r["id"] for r in text_index.phrase_search(spark, path, "b a", 5).collect()] == [0, 2, 4, 6, 8]
