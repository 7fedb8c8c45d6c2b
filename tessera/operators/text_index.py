"""A stored inverted index that changes keep up, and phrase search that reads only the postings of its words.

The index is a snapshot log (:mod:`tessera.snapshots`). A batch adds postings, words and document versions, and all
three are published by one commit: a batch that dies half-way leaves searches on the snapshot before, and a batch that
is tried again after its commit changes nothing. The newest version of a document counts; a deleted one has a version
without a length. The places of a word are put together in the task that reads a text, in one stored row for
all texts at hand there, and the empty word stands for the document: its place is the length. Postings are cut into
buckets by word, and by a salt of the first of these documents so that a word of every document is many tasks' work;
within a file they are sorted by word, so a search reads a few row groups of a few buckets. Words are kept without diacritics. Stems are stored once for each word of a batch, and a search looks up the words of its stems.
:func:`compact` makes one batch of all.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.stem import stems
from tessera.operators.search import best, clamped, packed_positions, tokens
from tessera.snapshots import SnapshotLog, Writer

#: Folders of postings by word, and the least number of tasks that write one of them.
BUCKETS, SALTS = 64, 8
#: Characters of text whose postings one task writes; a batch of more is dealt over more salts.
TASK_CHARS = 1 << 27
#: How readers see a word's stored list: a row for each id, with its places, which are between its offset and the next.
PACKED = ("transform(ids, (x, i) -> named_struct('id', x, 'positions', slice(places, offsets[i] + 1, offsets[i + 1] - offsets[i])))", ["ids", "offsets", "places"])
_STREAM = "index"


def _bucket(word: Column) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(BUCKETS)).cast("int")


def _salt(doc: Column, salts: int) -> Column:
    return F.pmod(F.xxhash64(doc), F.lit(salts)).cast("int")


def _salts(chars: int | None) -> int:
    return max(SALTS, math.ceil((chars or 0) / (BUCKETS * TASK_CHARS)))


def _postings(docs: DataFrame, fields: list[str]) -> DataFrame:
    """(word, field, ids, offsets, places): each word of some rows of ``docs`` (id, then the words of each field) once a
    field, with the rows' ids and its places in each, in order (see PACKED); of the empty word a row's place is the
    number of its words in all fields.

    Rows' words meet in the task that reads them, as many at a time as ``search.SLICE_TOKENS`` allows, so neither words
    nor places nor single postings are shuffled, sorted or stored one by one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, held = batch.column(0), batch.columns[1:]
            if not len(ids):
                continue
            totals = sum(pc.fill_null(pc.list_value_length(h), 0).to_numpy(zero_copy_only=False).astype(np.int64) for h in held)
            one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
            numbered = pa.array(np.arange(len(ids) + 1, dtype=np.int32))
            yield _named("", pa.array([""], pa.string()), one(ids), one(numbered), one(pa.array(totals.astype(np.int32))))
            for field, h in zip(fields, held, strict=True):
                for part in packed_positions(ids, h):
                    yield _named(field, *part)

    kind = docs.schema["id"].dataType.simpleString()
    return docs.mapInArrow(run, f"word string, field string, ids array<{kind}>, offsets array<int>, places array<int>")


def _named(field: str, words: pa.Array, *lists: pa.ListArray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([words, pa.repeat(pa.scalar(field, pa.string()), len(words)), *lists], ["word", "field", "ids", "offsets", "places"])


def _stage_postings(writer: Writer, postings: DataFrame, salts: int, replace: bool = False) -> None:
    """``postings``: (word, field, batch) and either (id, positions) or (ids, offsets, places)."""
    stage, packed = writer.replace if replace else writer.append, "ids" in postings.columns
    salt = _salt(F.col("ids")[0] if packed else F.col("id"), salts)
    dealt = postings.withColumns({"bucket": _bucket(F.col("word")), "salt": salt}).repartition("bucket", "salt")
    stage("postings", dealt.drop("salt").sortWithinPartitions("bucket", "word"), ("bucket",), PACKED if packed else None)


def add_batch(docs: DataFrame, id_col: str, text_cols: list[str], path: str, batch: int, deleted: DataFrame | None = None) -> None:
    """Writes new and changed documents, and the ids in ``deleted`` (id), as batch ``batch``; numbers must grow.

    A document without text has length 0; one that is both changed and deleted stays. Ids come once a batch. Texts are
    split once: words and lengths are read back from the postings.
    """
    log = SnapshotLog(docs.sparkSession, path)
    manifest = log.manifest()
    if log.committed(_STREAM, batch, manifest):
        return
    writer = Writer(log, manifest)
    number = F.lit(batch).alias("batch")
    chars = docs.agg(F.sum(sum([F.coalesce(F.length(F.col(c)), F.lit(0)) for c in text_cols], F.lit(0)).cast("long"))).first()[0]
    held = [tokens(F.col(c), fold=True).alias(f"words{k}") for k, c in enumerate(text_cols)]
    _stage_postings(writer, _postings(docs.select(F.col(id_col).alias("id"), *held), text_cols).select("*", number), _salts(chars))

    stored = writer.staged("postings")
    versions = stored.where((F.col("bucket") == _bucket(F.lit(""))) & (F.col("word") == "")).select("id", F.col("positions")[0].alias("length"))
    if deleted is not None:
        gone = deleted.select("id").join(versions.select("id"), "id", "left_anti")
        versions = versions.unionByName(gone.select("id", F.lit(None).cast("int").alias("length")))
    writer.append("versions", versions.select("id", "length", number))

    words = writer.staged("postings", unpack=False).select("word").where("word <> ''").distinct()
    writer.append("words", words.select("word", stems(F.array("word"))[0].alias("stem")).sortWithinPartitions("stem"))
    writer.commit(_STREAM, batch)


def current(spark: SparkSession, path: str, manifest: dict | None = None) -> DataFrame:
    """(id, length, batch): the newest version of each document that is not deleted."""
    versions = SnapshotLog(spark, path).read("versions", manifest=manifest)
    newest = versions.groupBy("id").agg(F.max_by(F.struct("length", "batch"), "batch").alias("v"))
    return newest.select("id", "v.length", "v.batch").where("length IS NOT NULL")


def compact(spark: SparkSession, path: str, into: str | None = None) -> int:
    """Writes the index anew as one batch of the newest versions only, and gives that batch's number: the largest so
    far, so further batches go on from it.

    Without ``into`` that is the next snapshot of ``path``, refused if a batch is added meanwhile; searches go on
    reading the one before until then, and ``SnapshotLog.expire`` removes it. With ``into`` it is an index of its own.
    """
    log = SnapshotLog(spark, path)
    manifest = log.manifest()
    last = manifest["batches"][_STREAM]
    target = log if into is None else SnapshotLog(spark, into)
    writer = Writer(target, manifest if into is None else target.manifest())
    live = current(spark, path, manifest)
    number = F.lit(last).alias("batch")
    writer.replace("versions", live.select("id", "length", number))
    stored = log.read("postings", manifest=manifest).join(live.select("id", "batch"), ["id", "batch"], "left_semi")
    _stage_postings(writer, stored.select("word", "field", "id", "positions", number), SALTS, replace=True)
    kept = log.read("words", manifest=manifest).distinct().join(stored.select("word").distinct(), "word", "left_semi")
    writer.replace("words", kept.sortWithinPartitions("stem"))
    writer.commit(*(() if into is None else (_STREAM, last)))
    return last


def phrase_search(spark: SparkSession, path: str, phrase: str, limit: int = 20, offset: int = 0, stem: bool = True, fields: list[str] | None = None) -> DataFrame:
    """(id, rank, score), as ``search.exact_search`` gives for the documents that the index holds now."""
    log = SnapshotLog(spark, path)
    manifest = log.manifest()  # one snapshot for the whole search
    live = current(spark, path, manifest)
    said = tokens(F.lit(phrase), fold=True)
    wanted = spark.range(1).select((stems(said) if stem else said).alias("t")).first()["t"]
    kind = live.schema["id"].dataType.simpleString()
    nothing = spark.createDataFrame([], f"id {kind}, rank double, score double")
    if not wanted:
        return nothing
    limit, offset = clamped(limit, offset)
    slots = spark.createDataFrame(list(enumerate(wanted)), "slot int, wanted string")
    if stem:
        # a stem has as many words as suffixes can be put to it: a few dozen
        listed = log.read("words", manifest=manifest).where(F.col("stem").isin(*wanted)).select("word", "stem").distinct()
        slots = slots.join(F.broadcast(listed), F.col("wanted") == F.col("stem")).select("slot", "word")
    else:
        slots = slots.select("slot", F.col("wanted").alias("word"))
    slots = slots.withColumn("bucket", _bucket(F.col("word")))
    rows = slots.select("word", "bucket").distinct().collect()
    if not rows:
        return nothing
    postings = log.read("postings", manifest=manifest).where(F.col("bucket").isin(*{r["bucket"] for r in rows}) & F.col("word").isin(*[r["word"] for r in rows]))
    if fields is not None:
        postings = postings.where(F.col("field").isin(*fields))
    own = postings.drop("bucket").join(F.broadcast(slots.drop("bucket")), "word")
    shifted = own.select("id", "batch", "field", F.transform("positions", lambda at: at - F.col("slot")).alias("starts"))
    # a slot's word is at a place once, so the phrase begins where as many slots agree as there are
    starts = shifted.groupBy("id", "batch", "field").agg(F.array_sort(F.flatten(F.collect_list("starts"))).alias("s"))
    whole = starts.select("id", "batch", F.size(F.filter("s", lambda x, i: F.get("s", i + len(wanted) - 1) == x)).alias("n")).where("n > 0")
    found = whole.groupBy("id", "batch").agg(F.sum("n").alias("tf")).join(live, ["id", "batch"]).select("id", "length", "tf")
    total, average = live.agg(F.count(F.lit(1)), F.avg("length")).first()
    n = found.count()
    return best(found, n, total, average, limit, offset) if n else nothing
