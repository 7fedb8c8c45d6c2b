"""Quality rules (operator 5): plain counts of a text, and a hashed n-gram log-likelihood ratio.

The ratio compares two multinomials over hashed byte n-grams: one counted over trusted target texts, one over the
whole raw corpus. A text's score is the sum of ``log p_target - log p_raw`` over its n-grams, divided by their
number. Every text is judged by one fixed threshold; nothing is sampled.

The raw multinomial counts every row, the target every row of a trusted id: texts meet the trusted ids in a join.
Weights are rounded to multiples of 2**-20 and summed as integers, so a score depends on neither the order nor the
batching of rows.

Defined results: a null text counts as empty; an empty text has zero counts, score 0.0 and fails the base rules;
a text or word of any length is read whole; a score equal to the threshold is kept; repeated rows are judged one by
one; an empty table gives an empty result; other columns, whatever their names, pass through; without any target text the target is
the raw corpus itself, so every score is 0.0 and only the base rules decide.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import textblocks as tb

#: Hash buckets of the multinomials. The counts that reach the driver are at most this many rows.
BUCKETS = 1 << 16
#: Bytes of an n-gram.
NGRAM = 4
#: The target counts as many n-grams more, spread as in the raw corpus: with few trusted texts, an n-gram that they
#: lack says little, and scores draw near 0.
PRIOR = 100_000
#: Texts whose mean log-likelihood ratio lies below this go.
THRESHOLD = -0.3
#: Base rules: fewest words, and the largest percentage of words in repeated windows of WINDOW words.
MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 20, 30, 8

_UNIT = 1 << 20
_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(b"#*$%&|<>")] = True

BASE_SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def _has_twin(row: np.ndarray, words: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Which of the windows that begin at words ``at`` are, word for word, also another of these, in the same text."""
    whole = np.column_stack([row, *[words[at + j] for j in range(WINDOW)]])
    order = np.lexsort(whole.T)
    same = (whole[order[1:]] == whole[order[:-1]]).all(axis=1)
    twin = np.zeros(len(at), dtype=bool)
    twin[order[1:][same]] = True
    twin[order[:-1][same]] = True
    return twin


def base_counts(texts: pa.Array) -> dict[str, np.ndarray]:
    """The counts of the base rules, one entry per text. Hashes only pick the windows that are compared word for word.

    n_words; word_chars: code points in words; n_symbols: characters of ``#*$%&|<>``; n_dup_lines: lines with a word
    that equal an earlier line; n_repeat_words: words in windows of WINDOW words that the text has twice or more.
    """
    data, off = tb.utf8(texts)
    n = len(off) - 1
    in_word = tb.NOT_SPACE[data]
    starts, ends = tb.spans(in_word, off)
    bounds = np.searchsorted(starts, off)
    row = np.repeat(np.arange(n, dtype=np.int64), np.diff(bounds))

    words = tb.exact_ids(data, starts, ends)
    repeated = np.zeros(len(words), dtype=bool)
    at = np.flatnonzero(tb.first_windows(bounds, WINDOW, len(words)))
    keys = tb.mix64(tb.window_hashes(words.astype(np.uint64), WINDOW)[at] ^ tb.mix64(row[at].astype(np.uint64)))
    ordered = np.sort(keys)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if len(twice):
        at = at[twice[np.minimum(np.searchsorted(twice, keys), len(twice) - 1)] == keys]
        repeated = tb.covered(at[_has_twin(row[at], words, at)], WINDOW, len(words))

    lines_from, lines_to = tb.spans(data != 0x0A, off)
    worded = np.searchsorted(starts, lines_from) < np.searchsorted(starts, lines_to)
    lines = tb.exact_ids(data, lines_from, lines_to)[worded].astype(np.int64)
    line_bounds = np.searchsorted(lines_from[worded], off)
    line_row = np.repeat(np.arange(n, dtype=np.int64), np.diff(line_bounds))
    line_keys = line_row * (1 + lines.max(initial=0)) + lines
    _, first = np.unique(line_keys, return_index=True)
    later = np.ones(len(line_keys), dtype=bool)
    later[first] = False

    return {
        "n_words": np.diff(bounds).astype(np.int64),
        "word_chars": tb.per_row(in_word & ((data & 0xC0) != 0x80), off),
        "n_symbols": tb.per_row(_SYMBOL[data], off),
        "n_dup_lines": tb.per_row(later, line_bounds),
        "n_repeat_words": tb.per_row(repeated, bounds),
    }


def base_failed(counts: dict[str, np.ndarray]) -> np.ndarray:
    n_words = counts["n_words"]
    return (n_words < MIN_WORDS) | (100 * counts["n_repeat_words"] > MAX_REPEAT_PERCENT * n_words)


def _ngrams(texts: pa.Array, buckets: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of every byte n-gram that stays within its text, and bounds by text."""
    data, off = tb.utf8(texts)
    if len(data) < n:
        return np.zeros(0, np.uint32), np.zeros(len(off), np.int64)
    size = len(data) - n + 1
    code = np.zeros(size, dtype=np.uint32)
    for j in range(n):
        code = code * np.uint32(0x01000193) + data[j : j + size]
    code = (code * np.uint32(0x9E3779B1)) >> np.uint32(32 - buckets.bit_length() + 1)
    at = np.flatnonzero(tb.first_windows(off, n, len(data)))
    return code[at], np.searchsorted(at, off)


def ngram_counts(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS, n: int = NGRAM) -> DataFrame:
    """(bucket, raw, target): n-grams by bucket over all rows, and over the rows whose id is in ``target``.

    All trusted ids count, however many: texts and trusted ids meet in one shuffle by id, in which only the ids are
    held. Every task sums what it reads before its sums are shuffled, so at most ``buckets`` rows leave a task, and a
    hot source or group of copies weighs no more than any other rows.
    """
    trusted = target.select(F.col(f"`{target.columns[0]}`").alias("__id")).distinct().withColumn("__trusted", F.lit(True))
    marked = docs.select(F.col(f"`{id_col}`").alias("__id"), F.col(f"`{text_col}`").alias("__text")).join(trusted.hint("shuffle_hash"), "__id", "left")

    def run(batches):
        sums = np.zeros((2, buckets), dtype=np.int64)
        for batch in batches:
            _, offsets = tb.utf8(batch.column(1))
            known = batch.column(0).to_numpy(zero_copy_only=False)
            for lo, hi in tb.row_slices(offsets):
                code, bounds = _ngrams(batch.column(1).slice(lo, hi - lo), buckets, n)
                sums[0] += np.bincount(code, minlength=buckets)
                own = np.repeat(known[lo:hi], np.diff(bounds))
                if own.any():
                    sums[1] += np.bincount(code[own], minlength=buckets)
        at = np.flatnonzero(sums[0])
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sums[0][at]), pa.array(sums[1][at])], ["bucket", "raw", "target"])

    parts = marked.select(F.coalesce("__trusted", F.lit(False)), "__text").mapInArrow(run, "bucket long, raw long, target long")
    return parts.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))


def weights(counts: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """``log p_target - log p_raw`` by bucket in units of 2**-20; ``counts`` has at most ``buckets`` rows."""
    sums = np.zeros((2, buckets))
    for bucket, raw, target in counts.collect():
        sums[:, bucket] = raw, target
    if not sums[1].any():
        return np.zeros(buckets, dtype=np.int64)
    own, target, n_target = sums[0] / sums[0].sum(), sums[1], sums[1].sum()
    ratio = np.divide(target + PRIOR * own, (n_target + PRIOR) * own, out=np.ones(buckets), where=own > 0)
    return np.rint(np.log(ratio) * _UNIT).astype(np.int64)


def judge(docs: DataFrame, weight: np.ndarray, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, n: int = NGRAM, keep_row: bool = False) -> DataFrame:
    """Per row: id, the base counts, llr (score), base_failed, kept. With ``keep_row`` also the input row."""
    shared, buckets = docs.sparkSession.sparkContext.broadcast(weight), len(weight)

    def fn(ids: pa.Array, texts: pa.Array) -> pa.RecordBatch:
        counts = base_counts(texts)
        code, bounds = _ngrams(texts, buckets, n)
        sums = tb.per_row(shared.value[code], bounds)
        llr = sums / (_UNIT * np.maximum(1, np.diff(bounds)).astype(np.float64))
        failed = base_failed(counts)
        cols = {"id": ids, **counts, "llr": llr, "base_failed": failed, "kept": ~failed & (llr >= threshold)}
        return pa.RecordBatch.from_arrays([pa.array(c) if isinstance(c, np.ndarray) else c for c in cols.values()], list(cols))

    id_type = docs.schema[id_col].dataType.simpleString()
    return tb.map_texts(docs, text_col, id_col, fn, f"id {id_type}, {BASE_SCHEMA}, llr double, base_failed boolean, kept boolean", keep_row)


def quality_rules(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, keep_row: bool = False) -> DataFrame:
    """Judges every row of ``docs``; the first column of ``target`` lists the ids of trusted texts."""
    return judge(docs, weights(ngram_counts(docs, target, id_col, text_col)), id_col, text_col, threshold, keep_row=keep_row)
