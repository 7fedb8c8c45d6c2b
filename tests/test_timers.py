"""Streams with timers against their batch twins, on events that come in disorder, in pieces and with a restart."""

from __future__ import annotations

import datetime as dt
import json
import os
import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import aggregate
from tessera.streaming import feeds

EVENTS = "/root/testdata/sf0.001/events.parquet"
HOUR = 3_600_000
pytestmark = pytest.mark.skipif(not os.path.exists(EVENTS), reason="needs the driver's tables")


def _pieces(rows, folder, disorder_ms, parts, columns):
    """Rows in ``parts`` files, out of order by up to ``disorder_ms``, and a last one that moves the watermark on."""
    rnd = random.Random(3)
    rows = sorted(rows, key=lambda r: r["ms"] + rnd.randrange(disorder_ms))
    last = {"at": "2030-01-01T00:00:00+00:00", "key": 10**9, "seq": 10**9, "change": "change"}
    step = -(-len(rows) // parts)
    for k, own in enumerate([*[rows[i : i + step] for i in range(0, len(rows), step)], [last]]):
        target = folder / f"{k}.json"
        target.write_text("\n".join(json.dumps({c: r[n] for c, n in columns.items()}) for r in own))
        os.utime(target, (1_700_000_000 + 10 * k,) * 2)
        yield target


def _rows(spark, n=400):
    own = spark.read.parquet(EVENTS).selectExpr("user_id % 9 AS key", "unix_millis(CAST(ts AS TIMESTAMP)) AS ms", "event_id AS seq", "CASE WHEN event_type = 'error' THEN 'unlink' ELSE 'change' END AS change")
    stamp = lambda ms: dt.datetime.fromtimestamp(ms / 1000, dt.timezone.utc).isoformat()
    return [r.asDict() | {"at": stamp(r["ms"])} for r in own.orderBy("ms").limit(n).collect()]


def _run_in_two(spark, feed, build, waiting, tmp_path):
    """The stream over the first files, then, from its checkpoint, over those that come later."""
    for later in (False, True):
        if later:
            for at, target in waiting:
                at.rename(target)
        stream = spark.readStream.schema("ts timestamp, seq long, path long, change string").option("maxFilesPerTrigger", 2).json(str(feed))
        query = build(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ckpt")).trigger(availableNow=True).start()
        query.awaitTermination()
    return spark.read.parquet(str(tmp_path / "out"))


def _fed(spark, tmp_path, rows):
    feed, held = tmp_path / "feed", tmp_path / "held"
    feed.mkdir()
    held.mkdir()
    files = list(_pieces(rows, feed, 6 * HOUR, 5, {"ts": "at", "seq": "seq", "path": "key", "change": "change"}))
    waiting = []
    for f in files[3:]:
        f.rename(held / f.name)
        waiting.append((held / f.name, f))
    return feed, waiting


@pytest.fixture
def rows(spark):
    return _rows(spark)


def test_a_debounced_stream_equals_the_batch(spark, tmp_path, rows):
    feed, waiting = _fed(spark, tmp_path, rows)
    out = _run_in_two(spark, feed, lambda s: feeds.debounce(s, 2 * HOUR, "6 hours"), waiting, tmp_path)
    batch = spark.createDataFrame([(r["key"], r["at"], r["seq"], r["change"]) for r in rows], "path long, ts string, seq long, change string").withColumn("ts", F.col("ts").cast("timestamp"))
    expected = aggregate.debounced(batch, F.expr("INTERVAL 2 HOURS"))
    got = sorted(map(tuple, out.where("path < 100").collect()))
    assert got == sorted(map(tuple, expected.collect()))
    assert 20 < len(got) < len(rows) and {r[2] for r in got} == {"change", "unlink"}


def test_a_delete_comes_out_at_once(spark, tmp_path):
    (tmp_path / "feed").mkdir()
    (tmp_path / "feed" / "1.json").write_text("\n".join(json.dumps({"ts": f"2024-01-01T00:00:0{s}", "seq": s, "path": 1, "change": c}) for s, c in [(0, "change"), (1, "unlink"), (2, "change")]))
    out = _run_in_two(spark, tmp_path / "feed", lambda s: feeds.debounce(s, 5000, "10 seconds"), [], tmp_path)
    assert [r["change"] for r in out.collect()] == ["unlink"]  # what waits behind it is not settled yet


def test_requests_in_disorder_are_judged_in_order(spark, tmp_path, rows):
    feed, waiting = _fed(spark, tmp_path, rows)
    out = _run_in_two(spark, feed, lambda s: feeds.ordered_rate_limit(s.withColumnRenamed("path", "ip"), 12 * 3600, 2, "6 hours"), waiting, tmp_path)
    batch = spark.createDataFrame([(r["key"], r["at"]) for r in rows], "ip long, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    got = sorted(map(tuple, out.where("ip < 100").collect()))
    assert got == sorted(map(tuple, aggregate.limited(batch, "ip", 12 * 3600, 2).collect()))
    assert {r[2] for r in got} == {True, False}
