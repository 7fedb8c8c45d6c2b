"""The pipeline on a small corpus whose every decision is known, and on tables without rows."""

from __future__ import annotations

import random

import corpus_pipeline
from tests.llm.fixtures import VOCABULARY, documents, empty
from tests.llm.test_exact import ITEM


def _prose(rnd: random.Random, n: int = 60) -> str:
    return " ".join(rnd.choice(["time", "house", "river", "walks", "under", "bright", "seven", "garden", "slow", "letters"]) + rnd.choice(["", "s", "ly", "ed"]) for _ in range(n))


def test_stages_take_effect(spark, tmp_path):
    rnd = random.Random(6)
    clean = [(i, _prose(rnd)) for i in range(30)]
    data = [*clean, (100, "too short"), (101, "again and " * 100), (102, clean[3][1]), (103, clean[4][1].upper()), (104, f"{_prose(rnd)} {ITEM} {_prose(rnd)}"), (105, f"{_prose(rnd)} password = abcdefghijkl9 {_prose(rnd)}"), (106, None), (None, _prose(rnd)), (107, clean[5][1]), (107, clean[5][1])]
    docs = documents(spark, data)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1) for i, _ in clean], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_duplicates", "decontamination", "secret_scan", "byte_bpe"]
    left, seen = docs, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        left = corpus_pipeline.settle(stage(spark, left, str(tmp_path)), name)
        assert left.columns == docs.columns
        seen[name] = sorted((r["doc_id"] for r in left.select("doc_id").collect()), key=lambda i: (i is None, i))
    kept = [i for i, _ in clean]
    assert seen["quality_rules"] == [*kept, 102, 103, 104, 105, 107, 107, None]
    assert seen["near_duplicates"] == [*kept, 104, 105, None]
    assert seen["decontamination"] == [*kept, 105, None] == seen["secret_scan"]
    masked = left.where("doc_id = 105").first()
    assert "[REDACTED]" in masked["text"] and "abcdefghijkl9" not in masked["text"] and masked["n_chars"] == len(masked["text"])
    assert left.where("doc_id = 0").first()["text"] == clean[0][1]
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r["doc_id"] for r in out), key=lambda i: (i is None, i)) == seen["secret_scan"]
    assert all(r["n_tokens"] > 0 for r in out)


def test_empty_tables(spark, tmp_path):
    empty(spark).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    assert VOCABULARY
