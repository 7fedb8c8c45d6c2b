"""Embeddings by content: what is sent, what is sent again, and how many requests are on their way."""

from __future__ import annotations

import os
import time
import uuid

import pytest
from pyspark.sql import functions as F

from tessera.operators import embedding_store as store


def _sent(folder):
    return sorted((folder / f).read_text() for f in os.listdir(folder) if f.startswith("sent-"))


def _chunks(spark, *contents):
    return spark.createDataFrame([(i, c) for i, c in enumerate(contents)], "id long, content string")


def test_a_content_is_sent_once(spark, tmp_path):
    calls, root = tmp_path / "calls", str(tmp_path / "store")
    first = _chunks(spark, "a", "bb", "a", None, "ccc")

    def provider(texts, where=str(calls)):
        for t in texts:
            with open(f"{where}/sent-{uuid.uuid4().hex}", "w") as out:
                out.write(t)
        return [[float(len(t)), 1.0] for t in texts]

    calls.mkdir()
    assert store.fill(first, root, provider, "m") == 4 and _sent(calls) == ["", "a", "bb", "ccc"]
    assert store.fill(first, root, provider, "m") == 0 and len(_sent(calls)) == 4
    assert store.fill(_chunks(spark, "dddd", "a"), root, provider, "m") == 1 and len(_sent(calls)) == 5
    assert store.fill(_chunks(spark, "a"), root, provider, "other model") == 1
    got = store.embedded(spark, _chunks(spark, "a", "dddd", "unknown", None), root, "m").orderBy("id").collect()
    assert [r["embedding"] for r in got] == [[1.0, 1.0], [4.0, 1.0], None, [0.0, 1.0]]
    assert store.embedded(spark, first, str(tmp_path / "none"), "m").where("embedding IS NULL").count() == 5


def test_a_killed_run_resends_only_what_was_not_written(spark, tmp_path):
    calls, root = tmp_path / "calls", str(tmp_path / "store")
    calls.mkdir()
    texts = [f"text {i}" for i in range(40)]
    waves = spark.createDataFrame([(t,) for t in texts], "content string").select("content", F.pmod(F.xxhash64(F.sha2("content", 256)), F.lit(4)).alias("wave"))
    last = waves.where("wave = 2").first()["content"]

    def provider(texts, where=str(calls), fails_on=last):
        if fails_on in texts and not os.path.exists(f"{where}/mended"):
            raise RuntimeError("killed")
        for t in texts:
            with open(f"{where}/sent-{uuid.uuid4().hex}", "w") as out:
                out.write(t)
        return [[float(len(t))] for t in texts]

    with pytest.raises(Exception, match="killed"):
        store.fill(_chunks(spark, *texts), root, provider, "m", wave=10)
    written = {r["content"] for r in waves.where("wave < 2").collect()}
    assert store.embedded(spark, _chunks(spark, *texts), root, "m").where("embedding IS NOT NULL").count() == len(written)
    (calls / "mended").write_text("")
    before = _sent(calls)
    assert store.fill(_chunks(spark, *texts), root, provider, "m", wave=10) == 40 - len(written)
    again = sorted(_sent(calls))
    for t in before:
        again.remove(t)
    assert set(again).isdisjoint(written) and sorted(again) == sorted(set(texts) - written)


def test_requests_on_their_way_are_bounded(spark, tmp_path):
    seen = tmp_path / "seen"
    seen.mkdir()

    def provider(texts, where=str(seen)):
        mine = f"{where}/now-{uuid.uuid4().hex}"
        open(mine, "w").close()
        time.sleep(0.05)
        open(f"{where}/most-{sum(f.startswith('now-') for f in os.listdir(where))}", "w").close()
        os.remove(mine)
        return [[1.0] for _ in texts]

    chunks = _chunks(spark, *[f"t{i}" for i in range(60)]).coalesce(1)
    one = store._embedded(chunks.select(F.col("content").alias("hash"), "content").coalesce(1), provider, 3, 4, 0)
    assert one.count() == 60
    most = {int(f.split("-")[1]) for f in os.listdir(seen) if f.startswith("most-")}
    assert max(most) == 3


def test_pauses_follow_what_the_provider_asks_for():
    pauses, answers = [], [store.RetryLater(7.0), TimeoutError(), store.RetryLater(900.0), None]

    def provider(texts):
        answer = answers.pop(0)
        if answer is not None:
            raise answer
        return [[1.0] for _ in texts]

    assert store.asked(provider, ["x"], 3, pauses.append) == [[1.0]] and pauses == [7.0, 2.0, 60.0]
    answers[:] = [TimeoutError()] * 3
    with pytest.raises(TimeoutError):
        store.asked(provider, ["x"], 2, pauses.append)
    with pytest.raises(ValueError):
        store.asked(lambda texts: [], ["x"])
