"""A store of embeddings by content: what was embedded once is never sent again.

Vectors are keyed by model and the content's SHA-256, so a chunk that moves, or that many files share, costs nothing.
What is missing is sent in waves, and each wave is a commit of its own (:mod:`tessera.snapshots`): a run that dies
loses the wave it was in, and the next run goes on from there. Within a task several requests are on their way at a
time, never more than ``in_flight``; a provider that is asked too often says when it may be asked again.
"""

from __future__ import annotations

import math
import time
from collections import deque
from collections.abc import Callable, Iterator
from concurrent.futures import Future, ThreadPoolExecutor

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.snapshots import SnapshotLog

Provider = Callable[[list[str]], list[list[float]]]
#: Texts of a request, requests of a task at a time, texts of a wave, tries after the first, longest pause in seconds.
REQUEST, IN_FLIGHT, WAVE, RETRIES, LONGEST = 64, 4, 1 << 20, 3, 60.0


class RetryLater(Exception):
    """A provider's answer that it is busy; ``seconds`` is what it asks to be given, if it says so."""

    def __init__(self, seconds: float | None = None):
        super().__init__(seconds)
        self.seconds = seconds


def content_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def asked(provider: Provider, texts: list[str], retries: int = RETRIES, pause: Callable[[float], None] = time.sleep) -> list[list[float]]:
    """The provider's vectors, tried again after answers and errors that may pass: after the time that it names, else
    after pauses that double, a minute at most."""
    for attempt in range(retries + 1):
        try:
            vectors = provider(texts)
        except (RetryLater, TimeoutError, ConnectionError) as busy:
            if attempt == retries:
                raise
            pause(min(LONGEST, named) if (named := getattr(busy, "seconds", None)) is not None else min(2.0**attempt, LONGEST))
            continue
        if len(vectors) != len(texts):
            raise ValueError(f"{len(vectors)} vectors for {len(texts)} texts")
        return vectors
    raise AssertionError


def _embedded(missing: DataFrame, provider: Provider, in_flight: int, request: int, retries: int) -> DataFrame:
    """(hash, embedding) of (hash, content). A task holds the texts of ``in_flight`` requests and one batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: deque[tuple[pa.Array, Future]] = deque()

        def done() -> pa.RecordBatch:
            hashes, answer = waiting.popleft()
            return pa.RecordBatch.from_arrays([hashes, pa.array(answer.result(), pa.list_(pa.float32()))], ["hash", "embedding"])

        with ThreadPoolExecutor(in_flight) as pool:
            for batch in batches:
                for lo in range(0, len(batch), request):
                    part = batch.slice(lo, request)
                    waiting.append((part.column(0), pool.submit(asked, provider, part.column(1).to_pylist(), retries)))
                    if len(waiting) == in_flight:
                        yield done()
            while waiting:
                yield done()

    return missing.mapInArrow(run, "hash string, embedding array<float>")


def fill(chunks: DataFrame, root: str, provider: Provider, model: str, text_col: str = "content", wave: int = WAVE, in_flight: int = IN_FLIGHT, request: int = REQUEST, retries: int = RETRIES) -> int:
    """Embeds the contents that the store lacks and gives their number. Null counts as empty.

    The list of what is missing is staged beside the vectors and never published; ``SnapshotLog.expire`` removes it."""
    log = SnapshotLog(chunks.sparkSession, root)
    contents = chunks.select(F.coalesce(F.col(text_col), F.lit("")).alias("content")).withColumn("hash", content_hash(F.col("content")))
    known = log.read("vectors")
    if known is not None:
        contents = contents.join(known.where(F.col("model") == model).select("hash"), "hash", "left_anti")
    # what is missing is written before anything is sent, so that every wave sees the same
    staged = log.begin().append("missing", contents.groupBy("hash").agg(F.first("content").alias("content"))).staged("missing")
    n = staged.count()
    waves = math.ceil(n / wave)
    for k in range(waves):
        own = staged.where(F.pmod(F.xxhash64("hash"), F.lit(waves)) == k).select("hash", "content")
        log.begin().append("vectors", _embedded(own, provider, in_flight, request, retries).select(F.lit(model).alias("model"), "hash", "embedding")).commit()
    return n


def embedded(spark: SparkSession, chunks: DataFrame, root: str, model: str, text_col: str = "content") -> DataFrame:
    """``chunks`` with ``embedding``, null where the store has none."""
    known = SnapshotLog(spark, root).read("vectors")
    columns = [*chunks.columns, "embedding"]
    if known is None:
        return chunks.withColumn("embedding", F.lit(None).cast("array<float>"))
    own = known.where(F.col("model") == model).select(F.col("hash").alias("__hash"), "embedding").dropDuplicates(["__hash"])
    return chunks.withColumn("__hash", content_hash(F.coalesce(F.col(text_col), F.lit("")))).join(own, "__hash", "left").select(*columns)
