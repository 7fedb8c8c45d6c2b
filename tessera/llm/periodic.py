"""Periodic run detection (operator 12): every maximal stretch of words that repeats itself with some period.

The array of a text's word numbers is compared with itself shifted by each lag up to ``n / MIN_EXPONENT``; a stretch
of equal places of a lag that is long enough is a run with that period. All texts of a batch share one array, longest
first, with a number of its own between two of them, so one comparison serves every text that is long enough for the
lag. Word numbers are exact (no hashes), and so are the runs.

A stretch at lag q whose smallest period p is shorter has a p that divides q, and spans the very same words at lag p;
so of stretches with the same ends the smallest lag is the run's period.

Work grows with the square of a text's words. Texts of more than LONG_BYTES are therefore cut into ranges of LAGS
lags: their word numbers go to as many tasks as they have ranges, wherever these run, and the stretches meet again by
text. All other texts are done where they are read, without a shuffle.

Defined results: a null text counts as empty and has no run; texts and words of any length are read whole; of runs
alike in every respect there is one; repeated rows are judged one by one; an empty table gives an empty result; other
columns, whatever their names, never reach the scan; a null id is passed through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import textblocks as tb
from tessera.llm.tables import settle

#: A run has at least so many words, and at least so many times its period (2 or more).
MIN_LENGTH, MIN_EXPONENT = 12, 2
#: Texts of more bytes are dealt out by ranges of lags, LAGS in each.
LONG_BYTES, LAGS = 1 << 16, 1 << 12

RUN = "struct<start:bigint,length:bigint,period:bigint>"
SCHEMA = f"n_words long, runs array<{RUN}>, collapsed string"
_ALL = np.uint64(0x0101010101010101)


def _stretches(equal: np.ndarray, need: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the stretches of at least ``need`` true places."""
    # a stretch of 15 or more covers eight places that begin at a multiple of eight
    if need >= 15 and not (equal[: len(equal) // 8 * 8].view(np.uint64) == _ALL).any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edges = np.flatnonzero(equal[1:] != equal[:-1]) + 1
    edges = np.concatenate(([0] if equal[0] else [], edges, [len(equal)] if equal[-1] else [])).astype(np.int64)
    starts, ends = edges[::2], edges[1::2]
    fit = ends - starts >= need
    return starts[fit], ends[fit]


def scan(words: np.ndarray, bounds: np.ndarray, lags: tuple[int, int] | None = None, min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> tuple[np.ndarray, ...]:
    """(text, start, length, period) of the runs of each text, by text, start and period.

    ``words`` holds the word numbers of all texts, ``bounds`` the places between them. ``lags`` is the range of
    periods that is looked at, its end excluded; without it, all.
    """
    size = np.diff(bounds)
    order = np.argsort(-size, kind="stable")
    order = order[size[order] >= max(min_length, 1)]
    if not len(order):
        return (np.zeros(0, np.int64),) * 4
    # the longest first, and behind each a number that no word has
    at = np.concatenate(([0], np.cumsum(size[order] + 1)))
    line = np.empty(at[-1], dtype=np.int32)
    for k, text in enumerate(order):
        line[at[k] : at[k + 1] - 1] = words[bounds[text] : bounds[text + 1]]
    line[at[1:] - 1] = -1 - np.arange(len(order))
    equal = np.empty(len(line), dtype=bool)
    first, last = lags or (1, int(size[order[0]]) // min_exponent + 1)
    shrinking = -size[order]
    starts, ends, periods = [], [], []
    for q in range(first, min(last, int(size[order[0]]) // min_exponent + 1)):
        whole = at[np.searchsorted(shrinking, -min_exponent * q, "right")]
        same = np.equal(line[: whole - q], line[q:whole], out=equal[: whole - q])
        s, e = _stretches(same, max(min_length - q, (min_exponent - 1) * q))
        if len(s):
            starts.append(s)
            ends.append(e + q)
            periods.append(np.full(len(s), q))
    if not starts:
        return (np.zeros(0, np.int64),) * 4
    s, e, p = (np.concatenate(x).astype(np.int64) for x in (starts, ends, periods))
    _, once = np.unique(s * (len(line) + 1) + e, return_index=True)  # the first is that of the smallest lag
    s, e, p = s[once], e[once], p[once]
    slot = np.searchsorted(at, s, "right") - 1
    text, begin = order[slot], s - at[slot]
    by = np.lexsort((p, begin, text))
    return text[by], begin[by], (e - s)[by], p[by]


def _uncovered(n: int, first: np.ndarray, length: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Which of n words no run covers beyond its first period."""
    steps = np.zeros(n + 1, dtype=np.int32)
    np.add.at(steps, first + period, 1)
    np.add.at(steps, first + length, -1)
    return np.cumsum(steps[:-1]) == 0


def _numbered(texts: pa.Array) -> tuple[np.ndarray, ...]:
    """Bytes, offsets, starts and ends of words, bounds by text, and word numbers."""
    data, off = tb.utf8(texts)
    starts, ends = tb.spans(tb.NOT_SPACE[data], off)
    return data, off, starts, ends, np.searchsorted(starts, off), tb.exact_ids(data, starts, ends)


def _runs_column(counts: np.ndarray, start: np.ndarray, length: np.ndarray, period: np.ndarray) -> pa.Array:
    fields = [pa.array(x, pa.int64()) for x in (start, length, period)]
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int32()), pa.StructArray.from_arrays(fields, ["start", "length", "period"]))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT, long_bytes: int = LONG_BYTES, lags: int = LAGS) -> DataFrame:
    """Per row: id, n_words, runs (by start and period), and ``collapsed``: the words that no run covers beyond its
    first period, joined by one space."""
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    is_long = F.octet_length("text") > long_bytes
    kind = rows.schema["id"].dataType.simpleString()

    def fn(ids: pa.Array, texts: pa.Array) -> pa.RecordBatch:
        data, off, starts, ends, bounds, words = _numbered(texts)
        text, start, length, period = scan(words, bounds, None, min_length, min_exponent)
        free = _uncovered(len(words), bounds[text] + start, length, period)
        runs = _runs_column(np.bincount(text, minlength=len(ids)), start, length, period)
        return pa.RecordBatch.from_arrays([ids, pa.array(np.diff(bounds), pa.int64()), runs, tb.joined(data, off, starts, ends, free)], ["id", "n_words", "runs", "collapsed"])

    short = tb.map_texts(rows.where(~is_long), "text", "id", fn, f"id {kind}, {SCHEMA}")
    return short.unionByName(_by_ranges(settle(rows.where(is_long).withColumn("row", F.monotonically_increasing_id()), "long-texts"), kind, min_length, min_exponent, lags))


def _by_ranges(texts: DataFrame, kind: str, min_length: int, min_exponent: int, lags: int) -> DataFrame:
    """The same for long texts (id, text, row): one task's work is a range of a text's lags."""

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                words = _numbered(batch.column(1).slice(k, 1))[-1]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, 1), pa.array([len(words)], pa.int64()), pa.array([words.astype("<i4").tobytes()])], ["row", "n", "words"])

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, lo, words in zip(*(batch.column(c).to_pylist() for c in ("row", "lo", "words")), strict=True):
                line = np.frombuffer(words, "<i4")
                _, start, length, period = scan(line, np.array([0, len(line)]), (lo, lo + lags), min_length, min_exponent)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(start), row), pa.int64()), *[pa.array(x, pa.int64()) for x in (start, length, period)]], ["row", "start", "length", "period"])

    numbered = texts.select("row", "text").mapInArrow(number, "row long, n long, words binary")
    ranged = numbered.withColumn("lo", F.explode(F.sequence(F.lit(1).cast("long"), F.greatest(F.lit(1), F.expr(f"n div {min_exponent}")), F.lit(lags).cast("long"))))
    tasks = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = ranged.select("row", "lo", "words").repartition(tasks, "row", "lo").mapInArrow(part, "row long, start long, length long, period long")
    # a stretch that several lags give belongs to the smallest, which may be another range's
    once = found.groupBy("row", "start", "length").agg(F.min("period").alias("period"))
    lists = once.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "period", "length"))).alias("found"))
    ordered = F.transform("found", lambda r: F.struct(r["start"], r["length"], r["period"])).cast(f"array<{RUN}>")
    whole = texts.join(lists.select("row", ordered.alias("runs")), "row", "left").select("id", "text", F.coalesce("runs", F.array().cast(f"array<{RUN}>")).alias("runs"))

    def collapse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                one = batch.slice(k, 1)
                data, off = tb.utf8(one.column(1))
                starts, ends = tb.spans(tb.NOT_SPACE[data], off)
                start, length, period = (x.to_numpy() for x in one.column(2).flatten().flatten())
                free = _uncovered(len(starts), start, length, period)
                yield pa.RecordBatch.from_arrays([one.column(0), pa.array([len(starts)], pa.int64()), one.column(2), tb.joined(data, off, starts, ends, free)], ["id", "n_words", "runs", "collapsed"])

    return whole.mapInArrow(collapse, f"id {kind}, {SCHEMA}")
