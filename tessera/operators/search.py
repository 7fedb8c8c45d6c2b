"""Ranked retrieval: BM25 over text, exact nearest vectors, and their fusion by reciprocal ranks."""

from __future__ import annotations

import hashlib
import math
import time
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.fold import folded
from tessera.functions.stem import forms, stems

K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
RRF = 60


def _lowered(text: Column, fold: bool) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    return folded(low) if fold else low


def tokens(text: Column, fold: bool = False) -> Column:
    """Lower-cased runs of letters and digits, with ``fold`` without diacritics; everything else splits, camel case
    does not."""
    return F.regexp_extract_all(_lowered(text, fold), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


#: Tokens that :func:`word_positions` and :func:`packed_positions` sort at once.
SLICE_TOKENS = 1 << 21


def word_positions(docs: DataFrame) -> DataFrame:
    """(id, word, positions): each word of each row of ``docs`` (id, words) once, with its places from 0 in order.

    A row's words meet in the task that reads it, so neither words nor places are shuffled or hashed one by one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from sliced_positions(batch.column(0), batch.column(1))

    kind = docs.schema["id"].dataType.simpleString()
    return docs.select("id", "words").mapInArrow(run, f"id {kind}, word string, positions array<int>")


def slices(words: pa.ListArray) -> Iterator[tuple[int, int]]:
    """(first row, number of rows) of slices of SLICE_TOKENS words at most unless one row has more."""
    ends = np.cumsum(pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False))
    lo = 0
    while lo < len(ends):
        before = ends[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, before + SLICE_TOKENS, side="right")))
        yield lo, hi - lo
        lo = hi


def sliced_positions(ids: pa.Array, words: pa.ListArray) -> Iterator[pa.RecordBatch]:
    """(id, word, positions) of an Arrow batch, in slices."""
    for lo, n in slices(words):
        yield _positions(ids.slice(lo, n), words.slice(lo, n))


def _flat(words: pa.ListArray) -> tuple[np.ndarray, np.ndarray, pa.DictionaryArray]:
    """The row and the place of every word, and the words."""
    sizes = pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes), words.flatten().dictionary_encode()


def _starts(*keys: np.ndarray) -> np.ndarray:
    """Where a run of equal keys begins, and the end."""
    n = len(keys[0])
    differ = np.zeros(max(0, n - 1), bool)
    for key in keys:
        differ |= key[1:] != key[:-1]
    return np.r_[np.flatnonzero(np.r_[n > 0, differ]), n].astype(np.int32) if n else np.zeros(1, np.int32)


def _positions(ids: pa.Array, words: pa.ListArray) -> pa.RecordBatch:
    row, at, coded = _flat(words)
    key = row * max(1, len(coded.dictionary)) + coded.indices.to_numpy()
    order = np.argsort(key, kind="stable")  # places stay in order
    starts = _starts(key[order])
    first = pa.array(order[starts[:-1]])
    places = pa.ListArray.from_arrays(pa.array(starts), pa.array(at[order].astype(np.int32)))
    return pa.RecordBatch.from_arrays([ids.take(pa.array(row).take(first)), coded.dictionary.take(coded.indices.take(first)), places], ["id", "word", "positions"])


def packed_positions(ids: pa.Array, words: pa.ListArray) -> Iterator[tuple[pa.Array, pa.ListArray, pa.ListArray, pa.ListArray]]:
    """(words, ids, offsets, places) of each slice of an Arrow batch: a word comes once a slice, with the ids of its
    rows in their order, all its places, and where in these each row's begin, and the end."""
    for lo, n in slices(words):
        row, at, coded = _flat(words.slice(lo, n))
        # a word's number and its place in the slice are one number, so a plain sort keeps places in order
        key = np.sort((coded.indices.to_numpy().astype(np.int64) << 32) | np.arange(len(row)))
        word, order = key >> 32, key & 0xFFFFFFFF
        row = row[order]
        starts = _starts(word, row)
        first = _starts(word[starts[:-1]])
        # a word's offsets are those of its rows and the first of the next word's
        owner, begun = np.arange(len(first) - 1), starts[first]
        ends = np.insert(starts[:-1], first[1:], begun[1:]) - np.repeat(begun[:-1], np.diff(first) + 1)
        lists = lambda offsets, values: pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), values)
        held = ids.slice(lo, n).take(pa.array(row[starts[:-1]]))
        yield coded.dictionary, lists(first, held), lists(first + np.r_[owner, len(owner)], pa.array(ends.astype(np.int32))), lists(begun, pa.array(at[order].astype(np.int32)))


def postings(docs: DataFrame, id_col: str, text_col: str, fold: bool = False) -> DataFrame:
    """The inverted index: (token, id, tf, positions), one row for each token of each document."""
    placed = docs.select(F.col(id_col).alias("id"), F.posexplode(tokens(F.col(text_col), fold)).alias("position", "token"))
    return placed.groupBy("token", "id").agg(F.count(F.lit(1)).alias("tf"), F.array_sort(F.collect_list("position")).alias("positions"))


def posting_counts(docs: DataFrame, id_col: str, text_col: str, fold: bool = False) -> DataFrame:
    """(token, n_docs, n, last_position): how many ids have a token, how often it comes, and its last place.

    Rows are counted by token alone, which leaves little to shuffle; what rows of one id count too often is taken off
    again, from rows of repeated ids only. A missing id counts for no document.
    """
    own = docs.select(F.col(id_col).alias("id"), tokens(F.col(text_col), fold).alias("words"))
    seen = F.col("id").isNotNull().cast("long")
    counted = word_positions(own).select("word", seen.alias("n_docs"), F.size("positions").cast("long").alias("n"), F.element_at("positions", -1).alias("last"))
    repeated = docs.select(F.col(id_col).alias("id")).where("id IS NOT NULL").groupBy("id").agg(F.count(F.lit(1)).alias("k")).where("k > 1")
    if not repeated.isEmpty():
        twice = word_positions(own.join(repeated, "id", "left_semi")).groupBy("id", "word").agg(F.count(F.lit(1)).alias("k"))
        counted = counted.unionByName(twice.select("word", (1 - F.col("k")).alias("n_docs"), F.lit(0).cast("long").alias("n"), F.lit(None).cast("int").alias("last")))
    return counted.groupBy(F.col("word").alias("token")).agg(F.sum("n_docs").alias("n_docs"), F.sum("n").alias("n"), F.max("last").alias("last_position"))


def _bm25(tf: Column, n: Column, total: Column, length: Column, average: Column) -> Column:
    idf = F.greatest(F.log((total - n + 0.5) / (n + 0.5)), F.lit(LEAST_IDF))
    return idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / average))


def _matches(spaced: Column, stemmed: list[str], stem: bool) -> Column:
    """How often a phrase is in tokens between single spaces: a space that the phrase and a space follow is one
    occurrence. With ``stem``, words that begin as the stems do are found first, and only they are stemmed."""
    if not stem:
        return F.regexp_count(spaced, F.lit(f" (?={' '.join(stemmed)} )"))
    found = F.regexp_extract_all(spaced, F.lit(f" (?=({' '.join(forms(w) for w in stemmed)}) )"), F.lit(1))
    return F.size(F.filter(found, lambda m: stems(F.split(m, " ")) == F.array(*[F.lit(w) for w in stemmed])))


def exact_search(docs: DataFrame, id_col: str, text_cols: list[str], phrase: str, limit: int = 20, offset: int = 0, stem: bool = True, fields: list[str] | None = None, fold: bool = True) -> DataFrame:
    """(id, rank, score): documents with the whole query as one phrase, the best first.

    Words agree if their stems do, or, without ``stem``, if they are equal; diacritics make no difference unless
    ``fold`` is off. ``fields`` are the columns of ``text_cols``
    to search, all by default; lengths are always those of all. One pass gives the corpus figures and one the matches;
    the phrase is counted within a row, so no postings are shuffled. ``score`` is 1 / (1 + rank) as callers know it; it
    falls as relevance grows, rows come best first.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    limit, offset = clamped(limit, offset)
    found, n, total, average = _phrase_matches(docs, id_col, text_cols, phrase, stem, fields, fold)
    if not n:
        return docs.sparkSession.createDataFrame([], f"id {kind}, rank double, score double")
    return best(found, n, total, average, limit, offset)


def clamped(limit: int, offset: int) -> tuple[int, int]:
    """A search's limit of 1 to 100, 20 where it is less, and an offset of 0 at least."""
    return (20 if limit < 1 else min(limit, 100)), max(0, offset)


def _phrase_matches(docs: DataFrame, id_col: str, text_cols: list[str], phrase: str, stem: bool, fields: list[str] | None, fold: bool) -> tuple[DataFrame | None, int, int, float]:
    """(id, length, tf) of the documents that have the phrase, their number, that of all, and the mean length."""
    said = tokens(F.lit(phrase), fold)
    wanted = docs.sparkSession.range(1).select((stems(said) if stem else said).alias("t")).first()["t"]
    if not wanted:
        return None, 0, 0, 0.0
    spaced = {c: F.concat(F.lit(" "), F.regexp_replace(_lowered(F.col(c), fold), r"[^\p{L}\p{N}]+", " "), F.lit(" ")) for c in text_cols}
    tf = [_matches(spaced[c], wanted, stem) for c in (text_cols if fields is None else fields)]
    length = [F.regexp_count(t, F.lit(r"[\p{L}\p{N}]+")) for t in spaced.values()]
    found = docs.select(F.col(id_col).alias("id"), sum(length[1:], length[0]).alias("length"), sum(tf[1:], tf[0]).alias("tf"))
    total, average, n = found.agg(F.count(F.lit(1)), F.avg("length"), F.sum((F.col("tf") > 0).cast("long"))).first()
    return found.where("tf > 0"), n or 0, total, average


def envelope(docs: DataFrame, id_col: str, text_cols: list[str], phrase: str, limit: int = 20, offset: int = 0, stem: bool = True, fields: list[str] | None = None, fold: bool = True) -> DataFrame:
    """One row for a page of :func:`exact_search`: total, limit, offset, has_more.

    As callers know it, one row more than the page is looked for, and ``total`` is what has been seen by then, plus
    one if there is more: exact on the last page, a lower bound before.
    """
    limit, offset = clamped(limit, offset)
    n = _phrase_matches(docs, id_col, text_cols, phrase, stem, fields, fold)[1]
    seen = min(max(0, n - offset), limit + 1)
    more = seen > limit
    return docs.sparkSession.createDataFrame([(offset + seen + more, limit, offset, more)], "total long, limit int, offset int, has_more boolean")


def found_nodes(found: DataFrame, nodes: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Search results (id, rank) with columns of their nodes; what has no node any more is left out. A page of results
    is at most a few hundred rows, so it goes to the nodes, not they to it."""
    return nodes.join(F.broadcast(found.select("id", "rank")), "id").select("id", "rank", *columns)


def best(found: DataFrame, n: int, total: int, average: float, limit: int, offset: int) -> DataFrame:
    """(id, rank, score) of matches (id, length, tf), the best first."""
    ranked = found.select("id", _bm25(F.col("tf"), F.lit(n), F.lit(total), F.col("length"), F.lit(average)).alias("rank"))
    return ranked.orderBy(F.desc("rank"), "id").offset(offset).limit(limit).select("id", "rank", (1 / (1 + F.col("rank"))).alias("score"))


def index_search(index: DataFrame, lengths: DataFrame, terms: list[str], limit: int = 20) -> DataFrame:
    """(id, rank) from an inverted index (see :func:`postings`) and the lengths of its documents (id, length): sums
    over the terms. Only postings of the terms are read where the index is stored by token."""
    own = index.where(F.col("token").isin(*terms))
    total, average = lengths.agg(F.count(F.lit(1)), F.avg("length")).first()
    df = own.groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    scored = own.join(F.broadcast(df), "token").join(lengths, "id")  # at most one row of df a term
    return scored.groupBy("id").agg(F.sum(_bm25(F.col("tf"), F.col("n"), F.lit(total), F.col("length"), F.lit(average))).alias("rank")).orderBy(F.desc("rank"), "id").limit(limit)


def squared_l2(vector: Column, query: list[float]) -> Column:
    """The squared distance as double."""
    given = F.array(*[F.lit(float(x)) for x in query])
    return F.aggregate(F.zip_with(vector, given, lambda a, b: (a.cast("double") - b) * (a.cast("double") - b)), F.lit(0.0), lambda s, x: s + x)


def semantic_search(vectors: DataFrame, id_col: str, vector_col: str, query: list[float], limit: int = 20, offset: int = 0) -> DataFrame:
    """(id, distance, score): the exact nearest vectors, nearest first; score is 1 / (1 + distance)."""
    own = vectors.where(F.size(vector_col) == len(query)).select(F.col(id_col).alias("id"), squared_l2(F.col(vector_col), query).alias("distance"))
    return own.orderBy("distance", "id").offset(offset).limit(limit).select("id", "distance", F.least(F.lit(1.0), 1 / (1 + F.col("distance"))).alias("score"))


def reciprocal_ranks(symbolic: DataFrame | None, vector: DataFrame | None, limit: int = 20, offset: int = 0) -> DataFrame:
    """(id, score) from two ranked legs (id, place from 1), each of at most a few hundred rows.

    An id that comes twice counts once, by its last place, in the symbolic leg, and adds up in the vector leg. A leg
    that is missing adds nothing.
    """
    legs = []
    if symbolic is not None:
        legs.append(symbolic.groupBy("id").agg(F.max("place").alias("place")).select("id", (1 / (RRF + F.col("place"))).alias("s")))
    if vector is not None:
        legs.append(vector.groupBy("id").agg(F.sum(1 / (RRF + F.col("place"))).alias("s")))
    if not legs:
        raise ValueError("a search needs one leg at least")
    both = legs[0] if len(legs) == 1 else legs[0].unionByName(legs[1])
    return both.groupBy("id").agg(F.sum("s").alias("score")).orderBy(F.desc("score"), "id").offset(offset).limit(limit)


def placed(leg: DataFrame, *order: Column) -> DataFrame:
    """(id, place): places of a leg that is already cut to its best rows."""


    return leg.select("id", F.row_number().over(Window.orderBy(*order)).alias("place"))


def hybrid_search(docs: DataFrame, id_col: str, text_cols: list[str], phrase: str, vectors: DataFrame, vector_id: str, vector_col: str, query: list[float], limit: int = 20, offset: int = 0, stem: bool = True) -> DataFrame:
    """Both legs give twice the limit; the fused list is paged."""
    text = placed(exact_search(docs, id_col, text_cols, phrase, 2 * limit, stem=stem), F.desc("rank"), F.col("id"))
    near = placed(semantic_search(vectors, vector_id, vector_col, query, 2 * limit), F.col("distance"), F.col("id"))
    return reciprocal_ranks(text, near, limit, offset)


def hashed_vector(text: str, dim: int = 64) -> list[float]:
    """An offline stand-in for an embedding service: signed hashed words, of length 1."""
    out = [0.0] * dim
    for word in text.lower().split():
        h = int.from_bytes(hashlib.sha256(word.encode()).digest()[:8], "little")
        out[h % dim] += 1.0 if h >> 63 else -1.0
    norm = math.sqrt(sum(x * x for x in out)) or 1.0
    return [x / norm for x in out]


def embed(chunks: DataFrame, provider: Callable[[list[str]], list[list[float]]] | None = None, text_col: str = "content", retries: int = 3, retryable: tuple[type[Exception], ...] = (TimeoutError, ConnectionError)) -> DataFrame:
    """``chunks`` with ``embedding``: a provider is called once an Arrow batch, and again after errors that may pass,
    with pauses that double up to a minute."""

    def vectors(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:


        call = provider or (lambda texts: [hashed_vector(t) for t in texts])
        for batch in batches:
            for attempt in range(retries + 1):
                try:
                    yield pd.Series(call(batch.fillna("").tolist()))
                    break
                except retryable:
                    if attempt == retries:
                        raise
                    time.sleep(min(2**attempt, 60))

    vectors.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return chunks.withColumn("embedding", F.pandas_udf(vectors, "array<float>")(F.col(text_col)))
