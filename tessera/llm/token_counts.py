"""Token counts (operator 1): rollups that are maintained by signed deltas.

A store keeps, below one folder of shared storage,

``state/batch=N/bucket=B``  what batch N counted: one row for each document and tokenizer version that it touched,
                            with what it replaced, by buckets of ids and sorted by id;
``compact/batch=N/bucket=B`` the state after batch N, one row for each document and tokenizer version that lives;
``deltas/batch=N``          what batch N adds to the totals: one row for each source, language and tokenizer version;
``commits/batch=N``         written last: batch N counts once this is there; ``compacted/batch=N`` likewise.

A batch has inserts, deletes and revised texts. An insert adds a document's counts; a delete subtracts the counts
that the state holds for it; a revision does both. Totals are the sums of the deltas of all committed batches, so
they never need a recount of what did not change. A batch reads the state of its own buckets and range of ids only,
semi-joined with its ids, and never the texts of earlier batches; ``compact`` folds the state's history, and
COMPACT_EVERY batches call it once, so that what a batch reads does not grow with their number.

Commits are idempotent: a batch that is already committed is not applied again, and an attempt that died half-way is
overwritten as a whole, since readers pass over batches without a commit. Batches come in the order of their numbers;
one that is not committed and is smaller than one that is raises an error.

Defined results: a null text counts no tokens; texts of any length are counted whole; null sources and languages are
groups of their own; a delete of an unknown document changes nothing; an insert of a known document is a revision;
repeated rows of one document in a batch count once, the one with the largest ``seq`` (then the longest text); a null
id is a document like any other; an empty batch commits an empty delta; other columns are not read. Groups that no
document is left of are not listed.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import textblocks as tb
from tessera.llm.bpe import codec
from tessera.llm.tables import settle

GROUP = ("source", "lang", "tokenizer")
MEASURES = ("n_docs", "n_tokens", "n_chars")

_VALUES = ("source", "lang", "alive", "n_tokens", "n_chars")
_STATE = "doc_id {id}, tokenizer string, source string, lang string, alive boolean, n_tokens long, n_chars long, old_source string, old_lang string, old_alive boolean, old_n_tokens long, old_n_chars long, batch long, bucket int"
#: Buckets of ids, and batches after which the state is compacted.
BUCKETS, COMPACT_EVERY = 16, 16
_DELTA = "source string, lang string, tokenizer string, n_docs long, n_tokens long, n_chars long, batch long"

Counter = Callable[[pa.Array], np.ndarray]


def count_words(texts: pa.Array) -> np.ndarray:
    """Words ``[^\\x20\\x09-\\x0D]+`` of each text."""
    data, off = tb.utf8(texts)
    starts, _ = tb.spans(tb.NOT_SPACE[data], off)
    return np.diff(np.searchsorted(starts, off))


def count_bpe(vocabulary: str) -> Counter:
    """Counts the ids of a byte-level BPE vocabulary."""
    return lambda texts: np.array([len(p) // 4 for p in codec(vocabulary).encode([t or "" for t in texts.to_pylist()])], dtype=np.int64)


class Rollup:
    """The store at ``path``. ``tokenizers`` maps the name of a tokenizer version to what counts its tokens."""

    def __init__(self, spark: SparkSession, path: str, tokenizers: dict[str, Counter], id_type: str = "bigint", buckets: int = BUCKETS):
        self.spark, self.path, self.tokenizers, self.buckets = spark, path.rstrip("/"), tokenizers, buckets
        self.state_schema = _STATE.format(id=id_type)

    def _exists(self, path: str) -> bool:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at)

    def _numbers(self, what: str) -> list[int]:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{what}")
        fs = at.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(at):
            return []
        return sorted(int(s.getPath().getName().split("=")[1]) for s in fs.listStatus(at) if s.getPath().getName().startswith("batch="))

    def committed(self) -> list[int]:
        """Numbers of the batches that count."""
        return self._numbers("commits")

    def _read(self, paths: list[str], schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _history(self) -> DataFrame:
        """The rows of the last compacted state and of the batches after it; ``bucket`` is a folder."""
        base = max(self._numbers("compacted"), default=None)
        later = [self._read([path], self.state_schema) for path in self._folders("state", [b for b in self.committed() if base is None or b > base])]
        folded = [] if base is None else [self._read([path], self.state_schema) for path in self._folders("compact", [base])]
        return functools.reduce(DataFrame.unionByName, folded + later, self.spark.createDataFrame([], self.state_schema))

    def _folders(self, what: str, batches: list[int]) -> list[str]:
        return [p for b in batches if self._exists(p := f"{self.path}/{what}/batch={b}")]

    def _bucket(self, ids: Column) -> Column:
        return F.pmod(F.xxhash64(ids), F.lit(self.buckets)).cast("int")

    def _write(self, rows: DataFrame, path: str) -> None:
        rows.sortWithinPartitions("bucket", "doc_id").write.mode("overwrite").partitionBy("bucket").parquet(path)

    def counted(self, rows: DataFrame) -> DataFrame:
        """``rows`` (doc_id, source, lang, op, text) once for each tokenizer, with n_tokens and n_chars, without text."""
        tokenizers = self.tokenizers
        kept = [F.col(c) for c in ("doc_id", "source", "lang", "op")]

        def fn(ids: pa.Array, texts: pa.Array) -> pa.RecordBatch:
            counts = {name: count(texts) for name, count in tokenizers.items()}
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1) * len(counts), pa.int32()), pa.array(np.stack(list(counts.values()), axis=1).ravel()))
            return pa.RecordBatch.from_arrays([ids, lists], ["id", "counts"])

        key = F.struct(*kept, F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_chars"))
        kind = rows.select(key.alias("k")).schema["k"].dataType.simpleString()
        done = tb.map_texts(rows, "text", key, fn, f"id {kind}, counts array<long>")
        one = F.posexplode("counts").alias("at", "n_tokens")
        names = F.array(*[F.lit(n) for n in tokenizers])
        return done.select("id.*", one).withColumn("tokenizer", F.get(names, F.col("at"))).drop("at")

    def current(self, touched: DataFrame | None = None) -> DataFrame:
        """What the last batch that touched it says of each document and tokenizer, deleted ones included; with
        ``touched`` of the ids in its column ``doc_id`` only."""
        history = self._history()
        if touched is not None:
            history = self.held_for(touched, history)
        newest = F.max(F.struct("batch", *_VALUES)).alias("x")
        return history.groupBy("doc_id", "tokenizer").agg(newest).select("doc_id", "tokenizer", *[F.col(f"x.{c}").alias(c) for c in _VALUES], "x.batch")

    def held_for(self, touched: DataFrame, history: DataFrame | None = None) -> DataFrame:
        """The state's rows of the ids of ``touched``: only folders of their buckets, and within these only the range
        of their ids, are read."""
        history = self._history() if history is None else history
        few = touched.agg(F.collect_set(self._bucket(F.col("doc_id"))).alias("buckets"), F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.max(F.col("doc_id").isNull()).alias("none")).first()
        if not few["buckets"]:
            return history.limit(0)
        within = F.lit(few["none"]) & F.col("doc_id").isNull()
        if few["lo"] is not None:
            within |= F.col("doc_id").between(few["lo"], few["hi"])
        ids = touched.select(F.col("doc_id").alias("own_id")).distinct()
        return history.where(F.col("bucket").isin(few["buckets"]) & within).join(ids, F.col("doc_id").eqNullSafe(F.col("own_id")), "left_semi")

    def compact(self) -> None:
        """Writes the state after the last batch as one table; later batches read that instead of the history."""
        if not (done := self.committed()):
            return
        alive = self.current().where("alive").withColumns({f"old_{c}": F.lit(None).cast(t) for c, t in zip(_VALUES, ("string", "string", "boolean", "long", "long"), strict=True)})
        self._write(alive.withColumn("bucket", self._bucket(F.col("doc_id"))), f"{self.path}/compact/batch={done[-1]}")
        self.spark.range(1).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/compacted/batch={done[-1]}")

    def apply(self, batch: int, changes: DataFrame) -> bool:
        """Applies and commits one batch; False if it was committed before.

        ``changes``: op (insert, delete or revise), doc_id, source, lang, text and, optionally, seq. Other columns are
        not read.
        """
        if self._exists(f"{self.path}/commits/batch={batch}"):
            return False
        done = self.committed()
        if done and batch < done[-1]:
            raise ValueError(f"batch {batch} comes after batch {done[-1]}")
        seq: Column = F.col("seq") if "seq" in changes.columns else F.lit(0)
        rows = changes.select("op", "doc_id", F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"), seq.alias("seq"))
        counted = self.counted(rows.withColumn("op", F.struct("op", "seq"))).select("*", F.col("op.seq").alias("seq"), F.col("op.op").alias("kind"))
        # texts are gone before anything is shuffled
        last = F.max(F.struct("seq", "n_chars", "n_tokens", "source", "lang", "kind")).alias("x")
        new = counted.groupBy("doc_id", "tokenizer").agg(last).select("doc_id", "tokenizer", F.col("x.source").alias("source"), F.col("x.lang").alias("lang"), (F.col("x.kind") != "delete").alias("alive"), F.col("x.n_tokens").alias("n_tokens"), F.col("x.n_chars").alias("n_chars"))
        if done:
            new = settle(new, "counted")
            held = self.current(new).select(F.col("doc_id").alias("h_id"), F.col("tokenizer").alias("h_tokenizer"), *[F.col(c).alias(f"old_{c}") for c in _VALUES])
            both = new.join(held, F.col("doc_id").eqNullSafe(F.col("h_id")) & (F.col("tokenizer") == F.col("h_tokenizer")), "left").drop("h_id", "h_tokenizer")
        else:
            both = new.withColumns({f"old_{c}": F.lit(None).cast(t) for c, t in zip(_VALUES, ("string", "string", "boolean", "long", "long"), strict=True)})
        known = both.where("alive or old_alive").withColumns({"batch": F.lit(batch).cast("long"), "bucket": self._bucket(F.col("doc_id"))})
        self._write(known, state := f"{self.path}/state/batch={batch}")
        both = self._read([state], self.state_schema)
        add = F.struct("source", "lang", F.lit(1).alias("sign"), "n_tokens", "n_chars")
        take = F.struct(F.col("old_source").alias("source"), F.col("old_lang").alias("lang"), F.lit(-1).alias("sign"), F.col("old_n_tokens").alias("n_tokens"), F.col("old_n_chars").alias("n_chars"))
        signed = both.select("tokenizer", F.explode(F.filter(F.array(F.when(F.col("alive"), add), F.when(F.col("old_alive"), take)), lambda x: x.isNotNull())).alias("x"))
        delta = signed.groupBy(F.col("x.source").alias("source"), F.col("x.lang").alias("lang"), "tokenizer").agg(F.sum(F.col("x.sign").cast("long")).alias("n_docs"), F.sum(F.col("x.sign") * F.col("x.n_tokens")).alias("n_tokens"), F.sum(F.col("x.sign") * F.col("x.n_chars")).alias("n_chars"))
        delta.withColumn("batch", F.lit(batch).cast("long")).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/deltas/batch={batch}")
        self.spark.range(1).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/commits/batch={batch}")
        if (len(done) + 1) % COMPACT_EVERY == 0:
            self.compact()
        return True

    def totals(self, by: Sequence[str] = GROUP) -> DataFrame:
        """Totals by any of source, lang and tokenizer over all committed batches."""
        sums = [F.sum(m).alias(m) for m in MEASURES]
        return self._read([f"{self.path}/deltas/batch={b}" for b in self.committed()], _DELTA).groupBy(*by).agg(*sums).where("n_docs <> 0")


def distinct_lines(text: Column) -> Column:
    """A text with each line once, the first of its copies."""
    return F.array_join(F.array_distinct(F.split(text, "\n")), "\n")
