"""Feeds as Structured Streaming: file changes, incremental maintenance, rolling metrics and rate limits."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tessera.operators.merge import delete_nodes, newest, upsert, valid_edges
from tessera.streaming.timers import debounce, ordered_rate_limit

__all__ = ["append_changes", "change_feed", "compact_changes", "current_graph", "debounce", "maintain", "ordered_rate_limit", "rate_limit", "rolling_metrics"]

CHANGES = "ts timestamp, seq long, path string, change string, content_hash string"
REQUESTS = "ts timestamp, tool string, duration double, error boolean, ip string"


def change_feed(spark: SparkSession, folder: str, schema: str = CHANGES) -> DataFrame:
    """A stream of JSON change records dropped into a folder."""
    return spark.readStream.schema(schema).json(folder)


def rolling_metrics(requests: DataFrame, length: str = "60 seconds", step: str = "10 seconds", late: str = "10 seconds") -> DataFrame:
    """Number, mean duration and error rate of the requests of each tool in sliding windows."""
    by = requests.withWatermark("ts", late).groupBy(F.window("ts", length, step).alias("w"), "tool")
    out = by.agg(F.count(F.lit(1)).alias("n"), F.avg("duration").alias("avg_duration"), F.avg(F.col("error").cast("double")).alias("error_rate"))
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "tool", "n", "avg_duration", "error_rate")


def rate_limit(requests: DataFrame, seconds: int = 60, most: int = 10, late: str = "60 seconds") -> DataFrame:
    """(ip, ts, allowed), at once: a fixed window begins at a key's first request and lets ``most`` through.

    Requests count in the order they come in, and by time within a micro-batch; :func:`ordered_rate_limit` waits until
    their order is settled. State is two numbers a key, dropped once the watermark is past its window. Requests later than ``late`` are not
    judged. Time is that of the requests alone, so a feed that is read again gives the same answers.
    """
    window = seconds * 1_000_000

    def judge(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        began, n = state.get if state.exists else (0, 0)
        rows = pd.concat(list(batches)).sort_values("us", kind="stable")
        allowed = []
        for at in rows["us"].tolist():
            if n == 0 or at - began >= window:
                began, n = at, 0
            n += 1
            allowed.append(n <= most)
        state.update((began, n))
        state.setTimeoutTimestamp(max((began + window) // 1000, state.getCurrentWatermarkMs()) + 1)
        yield pd.DataFrame({"ip": key[0], "ts": rows["ts"].to_numpy(), "allowed": allowed})

    timed = requests.withWatermark("ts", late).select("ip", "ts", F.unix_micros("ts").alias("us"))
    return timed.groupBy("ip").applyInPandasWithState(judge, "ip string, ts timestamp, allowed boolean", "began long, n long", "append", GroupStateTimeout.EventTimeTimeout)


def maintain(changes: DataFrame, nodes_at: Callable[[int], str], parse: Callable[[DataFrame], tuple[DataFrame, DataFrame]], checkpoint: str, start: tuple[DataFrame, DataFrame]) -> StreamingQuery:
    """Keeps node and edge tables current: each micro-batch replaces the nodes of its changed files.

    ``parse`` gives the new nodes and edges of changed paths; ``nodes_at`` names a batch's folder, which is
    overwritten as a whole, so a batch that is tried again gives the same tables. A batch reads what the one before
    wrote, ``start`` before the first.
    """

    def one(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        stored = start if number == 0 else tuple(spark.read.parquet(f"{nodes_at(number - 1)}/{t}") for t in ("nodes", "edges"))
        last = newest(batch, "path", "seq").persist()
        touched = last.select(F.col("path").alias("file_path"))
        gone = stored[0].join(touched, "file_path", "left_semi")
        nodes, edges = parse(last.where("change <> 'unlink'"))
        kept_nodes, _ = delete_nodes(stored[0], stored[1], gone)
        new_nodes = upsert(kept_nodes, nodes.select(*stored[0].columns))
        # edges into a changed file stay where their ends are still there
        ends = new_nodes.select("id")
        own = stored[1].join(gone.select(F.col("id").alias("source_id")), "source_id", "left_anti").select(*stored[1].columns)
        all_edges = upsert(own, edges.select(*stored[1].columns))
        whole = all_edges.join(ends.withColumnRenamed("id", "source_id"), "source_id", "left_semi").join(ends.withColumnRenamed("id", "target_id"), "target_id", "left_semi").select(*stored[1].columns)
        new_nodes.write.mode("overwrite").parquet(f"{nodes_at(number)}/nodes")
        whole.write.mode("overwrite").parquet(f"{nodes_at(number)}/edges")
        last.unpersist()

    return changes.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def append_changes(changes: DataFrame, path: str, parse: Callable[[DataFrame], tuple[DataFrame, DataFrame]], checkpoint: str) -> StreamingQuery:
    """Like :func:`maintain`, but a micro-batch writes only what it changed: the versions of its files and their nodes
    and edges, in a folder of its own. :func:`current_graph` gives the tables.

    A batch costs as much as its changes, whatever the tables hold. One that was interrupted is written again as a
    whole when the stream resumes from ``checkpoint``. ``parse`` gives edges with a ``file_path``: that of the file
    that states them.
    """

    def one(batch: DataFrame, number: int) -> None:
        last = newest(batch, "path", "seq").persist()
        nodes, edges = parse(last.where("change <> 'unlink'"))
        nodes.write.mode("overwrite").parquet(f"{path}/nodes/batch={number}")
        edges.write.mode("overwrite").parquet(f"{path}/edges/batch={number}")
        last.select(F.col("path").alias("file_path")).write.mode("overwrite").parquet(f"{path}/files/batch={number}")
        last.unpersist()

    return changes.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _newest_versions(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    newest_files = spark.read.parquet(f"{path}/files").groupBy("file_path").agg(F.max("batch").alias("batch"))
    return tuple(spark.read.parquet(f"{path}/{t}").join(newest_files, ["file_path", "batch"], "left_semi").drop("batch") for t in ("nodes", "edges"))


def current_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of the newest version of each file; an edge needs both its ends."""
    nodes, edges = _newest_versions(spark, path)
    return nodes, valid_edges(edges, nodes)


def compact_changes(spark: SparkSession, path: str, into: str) -> int:
    """Writes what :func:`append_changes` has gathered anew below ``into``, as one batch of the newest versions only,
    and gives its number: the largest so far, so a stream with the same checkpoint goes on there.

    Run it between two runs of the stream. Edges whose other end is missing are kept: it may come with a later batch.
    """
    last = spark.read.parquet(f"{path}/files").agg(F.max("batch")).first()[0]
    nodes, edges = _newest_versions(spark, path)
    nodes.write.mode("overwrite").parquet(f"{into}/nodes/batch={last}")
    edges.write.mode("overwrite").parquet(f"{into}/edges/batch={last}")
    nodes.select("file_path").union(edges.select("file_path")).distinct().write.mode("overwrite").parquet(f"{into}/files/batch={last}")
    return last
