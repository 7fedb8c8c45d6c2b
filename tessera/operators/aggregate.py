"""Counts, roll-ups and rolling figures."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(table, n): one aggregate a table, in one plan."""
    return reduce(DataFrame.unionByName, [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table"), "n") for name, df in tables.items()])


def language_counts(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("language").agg(F.count(F.lit(1)).alias("n"))


def languages_of_repositories(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("repository_id", "language").agg(F.count(F.lit(1)).alias("n"))


def summed_languages(maps: DataFrame, column: str = "languages") -> DataFrame:
    """Sum of language maps over all rows."""
    return maps.select(F.explode(column).alias("language", "n")).groupBy("language").agg(F.sum("n").alias("n"))


def status_counts(files: DataFrame) -> DataFrame:
    return files.agg(*[F.count_if(F.col("status") == s).alias(f"files_{s}") for s in ("pending", "indexing", "indexed", "error")])


def rolling(requests: DataFrame, by: list[str], seconds: int = 60) -> DataFrame:
    """Each request with the number, mean duration and error rate of those of its group in the trailing seconds.

    Time is cut into buckets of that length, and each request also goes to the next bucket, as context only: a frequent
    group is many tasks' work. A trailing range is then the start of its own bucket and the end of the one before. Both
    are running sums, one from each side, with context in order of when it leaves the range, so work does not grow with
    the number of requests in a range, and nothing is subtracted. Requests without a time are a range of their own.
    """
    length = int(seconds * 1_000_000)
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    copy = F.explode(F.when(at.isNull(), F.array(F.lit(0))).otherwise(F.array(F.lit(0), F.lit(1))))
    copies = requests.withColumn("__copy", copy).withColumns({"__bucket": at - F.pmod(at, F.lit(length)) + F.col("__copy") * length, "__key": at + F.col("__copy") * length})
    parts = Window.partitionBy(*by, "__bucket")
    sides = [(0, parts.orderBy("__key")), (1, parts.orderBy(F.desc("__key")))]

    def both(agg: Callable[[Column], Column], value: Column) -> Column:
        head, tail = (F.coalesce(agg(F.when(F.col("__copy") == k, value)).over(w.rangeBetween(Window.unboundedPreceding, Window.currentRow)), F.lit(0)) for k, w in sides)
        return head + tail

    mean = lambda value: F.try_divide(both(F.sum, value), both(F.count, value))
    counted = copies.withColumns({"n": both(F.count, F.lit(1)), "avg_duration": mean(F.col("duration")), "error_rate": mean(F.col("error").cast("double"))})
    return counted.where("__copy = 0").drop("__copy", "__bucket", "__key")


def queue_stats(tasks: DataFrame, most_tries: int = 3) -> DataFrame:
    """One row for tasks (status, tries): how many wait, run, are done, or failed for good."""
    failed = (F.col("status") == "failed") & (F.col("tries") >= most_tries)
    waits = (F.col("status") == "pending") | ((F.col("status") == "failed") & ~failed)
    return tasks.agg(F.count_if(waits).alias("pending"), F.count_if(F.col("status") == "running").alias("running"), F.count_if(F.col("status") == "done").alias("done"), F.count_if(failed).alias("failed"), F.count(F.lit(1)).alias("total"))


def top_overlap(candidate: DataFrame, baseline: DataFrame, top: int) -> DataFrame:
    """(scenario, overlap): of the first ``top`` names of each scenario (name, place), the share that both have."""
    first = [df.where(F.col("place") <= top).select("scenario", "name").distinct() for df in (candidate, baseline)]
    counts = first[1].groupBy("scenario").agg(F.count(F.lit(1)).alias("n"))
    both = first[0].join(first[1], ["scenario", "name"]).groupBy("scenario").agg(F.count(F.lit(1)).alias("shared"))
    return counts.join(both, "scenario", "left").select("scenario", (F.coalesce("shared", F.lit(0)) / F.col("n")).alias("overlap"))


def over_limit(requests: DataFrame, key: str = "ip", seconds: int = 60, most: int = 10) -> DataFrame:
    """(key, window_start, n): fixed windows with more than ``most`` requests. Windows are aligned to the clock here;
    the stateful stream lets them begin at a key's first request."""
    counts = requests.groupBy(key, F.window("ts", f"{seconds} seconds").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return counts.where(F.col("n") > most).select(key, F.col("w.start").alias("window_start"), "n")


def debounced(changes: DataFrame, quiet: Column) -> DataFrame:
    """(path, ts, change): what a debounced feed gives. A change counts once no other follows it within the quiet
    time; a delete counts at once and takes back the change that waits."""
    ahead = Window.partitionBy("path").orderBy("ts", "seq")
    following = changes.withColumn("next_ts", F.lead("ts").over(ahead))
    settled = (F.col("change") == "unlink") | F.col("next_ts").isNull() | (F.col("next_ts") - F.col("ts") >= quiet)
    return following.where(settled).select("path", "ts", "change")


def payload_sizes(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """Bytes, and tokens as a quarter of them, rounded up."""
    size = F.octet_length(column)
    return payloads.agg(F.sum(size).alias("bytes"), F.sum(F.ceil(size / 4)).alias("tokens"))


def new_names(candidate: DataFrame, baseline: DataFrame) -> DataFrame:
    """Names per scenario that only the candidate has."""
    return candidate.join(baseline, ["scenario", "name"], "left_anti").select("scenario", "name").distinct()


def limited(requests: DataFrame, key: str = "ip", seconds: int = 60, most: int = 10) -> DataFrame:
    """(key, ts, allowed) of requests (key, ts): a fixed window begins at a key's first request, the next at its first
    request after that, and each lets ``most`` requests through. Requests without a time are left out.

    Where a window begins depends on all windows before it, so each key's requests are gone through in order of time:
    one shuffle by key, one sort that may spill, and a pass that holds a batch of rows and three values.
    """
    window = 1_000_000 * seconds
    kind = requests.schema[key].dataType.simpleString()

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, began, n = object(), 0, 0
        for batch in batches:
            allowed = []
            for own, us in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if own != current or us - began >= window:
                    current, began, n = own, us, 0
                n += 1
                allowed.append(n <= most)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(allowed, pa.bool_())], ["key", "us", "allowed"])

    timed = requests.where("ts IS NOT NULL").select(F.col(key).alias("key"), F.unix_micros("ts").alias("us"))
    judged = timed.repartition("key").sortWithinPartitions("key", "us").mapInArrow(judge, f"key {kind}, us long, allowed boolean")
    return judged.select(F.col("key").alias(key), F.timestamp_micros("us").alias("ts"), "allowed")


def waiting_tokens(tasks: DataFrame, text_col: str = "content", most_tries: int = 3) -> DataFrame:
    """One row for tasks (status, tries, content): an estimate of the tokens that are still to be sent, a quarter of
    the characters of each text, rounded up."""
    waits = (F.col("status") == "pending") | ((F.col("status") == "failed") & (F.col("tries") < most_tries))
    return tasks.where(waits).agg(F.count(F.lit(1)).alias("waiting"), F.coalesce(F.sum(F.ceil(F.length(text_col) / 4)), F.lit(0)).alias("tokens"))


def stats(nodes: DataFrame, edges: DataFrame, files: DataFrame, repositories: DataFrame) -> DataFrame:
    """(figure, n): rows of each table, files of each status, nodes of each language, watched repositories."""
    counts = table_counts({"nodes": nodes, "edges": edges, "files": files, "repositories": repositories}).select(F.col("table").alias("figure"), "n")
    by = lambda df, column, name: df.groupBy(column).agg(F.count(F.lit(1)).alias("n")).select(F.concat(F.lit(f"{name}:"), column).alias("figure"), "n")
    watched = repositories.agg(F.count_if("is_watched").alias("n")).select(F.lit("watched").alias("figure"), "n")
    return reduce(DataFrame.unionByName, [counts, by(files, "status", "files"), by(nodes, "language", "language"), watched])


def payload_deltas(candidate: DataFrame, baseline: DataFrame) -> DataFrame:
    """(scenario, bytes, tokens, bytes_delta, tokens_delta, bytes_percent) of payloads (scenario, payload): what the
    candidate sends, and how that differs from the baseline; null where one of them lacks the scenario."""
    size = F.octet_length("payload")
    sums = [df.groupBy("scenario").agg(F.sum(size).alias(f"{p}bytes"), F.sum(F.ceil(size / 4)).alias(f"{p}tokens")) for df, p in ((candidate, ""), (baseline, "b_"))]
    both = sums[0].join(sums[1], "scenario", "full_outer")
    delta = lambda c: (F.col(c) - F.col(f"b_{c}")).alias(f"{c}_delta")
    percent = F.round(F.try_divide(100.0 * (F.col("bytes") - F.col("b_bytes")), F.col("b_bytes")), 3).alias("bytes_percent")
    return both.select("scenario", "bytes", "tokens", delta("bytes"), delta("tokens"), percent)
