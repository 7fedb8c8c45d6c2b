"""Toxicity (operator 6) by non-negative positive-unlabelled learning.

Confirmed toxic texts are the positives; every other text is unlabelled, whatever its label says. A linear logistic
classifier over the presence of words is fitted in numpy to the class-prior-corrected risk

    prior * mean_P loss(+) + max(0, mean_U loss(-) - prior * mean_P loss(-))

whose second term, the risk on the negatives, may not fall below zero: a step that would take it there goes the other
way. Features are lower-cased words, as 64-bit hashes, or byte n-grams within words and at their edges, packed whole
(``features``: "words", "ngrams"). Words are the default: forms of a toxic stem are told from harmless ones that share
its n-grams.

The features are the ones whose texts are, by the class prior and their shares of the two kinds, toxic in at least
LEAST_PURE of the cases, with a log-likelihood ratio of SURE or more: what differs by chance would let the length of a
text decide. The fit takes
bounded numbers of rows and features; ``most_positive``, ``most_unlabelled`` and ``n_features`` of ``train`` say how
many, and beyond them the rows of the smallest hashed ids and the features of the largest ratios are taken. Scoring
reads every text as a whole.

Ids whose CRC-32 (of the id as text) leaves 0 modulo FOLDS are held out: neither their labels nor their texts are
learned from. Defined results: a null or empty text has no feature and gets the score of the intercept; a null id
counts as held out; repeated rows are scored one by one; features of equal ratios are taken in the order of their
codes; a text of any length is read whole; other columns, whatever their names, are not read; without any positive
every score is 0.0; an empty table gives an empty result. Label, language, source and id are no inputs of a score.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import textblocks as tb
from tessera.llm.tables import bounded_keys

FOLDS = 5
#: Bounds of the fit unless ``train`` is told others, and positives that a feature is in at least.
MOST_POSITIVE, MOST_UNLABELLED, N_FEATURES, LEAST_SEEN = 6_000, 12_000, 2_000, 3
#: Share of a feature's texts that must be toxic by the class prior, and how sure it is that the feature says anything
#: (twice the log-likelihood ratio).
LEAST_PURE, SURE = 0.45, 8.0
#: Bytes of the n-grams.
SIZES = (4, 5)
STEPS, RATE, PENALTY = 400, 0.1, 1e-5


@dataclass(frozen=True)
class Model:
    #: Sorted features, their weights, the intercept, and what kind of features they are.
    grams: np.ndarray
    weights: np.ndarray
    intercept: float
    features: str = "words"


def held_out(id_col: Column, folds: int = FOLDS) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % folds == 0, F.lit(True))


def grams_of(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each size: the n-gram at every byte, which of them count, and the offsets of the texts.

    Texts are lower-cased, what is no letter or digit is a space, and an n-gram has a space at its ends at most. An
    n-gram is its bytes as one integer, with its size above them.
    """
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts, "")
    space = pa.scalar(" ", texts.type)
    data, off = tb.utf8(pc.binary_join_element_wise(space, pc.utf8_lower(texts), space, pa.scalar("", texts.type)))
    inner = tb.ALNUM[data]
    data = np.where(inner, data, 0x20).astype(np.uint64)
    for n in SIZES:
        size = len(data) - n + 1
        if size <= 0:
            continue
        code = np.full(size, n, dtype=np.uint64)
        for j in range(n):
            code = (code << np.uint64(8)) | data[j : j + size]
        good = tb.first_windows(off, n, len(data))
        for j in range(1, n - 1):
            good &= inner[j : j + size]
        yield code, good, off


def words_of(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The hash of every word, which of them count (all), and the bounds of the texts. A word is a run of letters and
    digits; a letter of a script without spaces is a word of its own."""
    data, off = tb.utf8(pc.utf8_lower(texts))
    starts, ends = tb.token_spans(data, off)
    yield tb.span_hashes(data, starts, ends), np.ones(len(starts), dtype=bool), np.searchsorted(starts, off)


EXTRACTORS: dict[str, Callable[[pa.Array], Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]]] = {"words": words_of, "ngrams": grams_of}


def _distinct(row: np.ndarray, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each pair of row and n-gram once, by row."""
    order = np.lexsort((grams, row))
    row, grams = row[order], grams[order]
    new = np.concatenate(([True], (row[1:] != row[:-1]) | (grams[1:] != grams[:-1]))) if len(row) else np.zeros(0, bool)
    return row[new], grams[new]


class _Finder:
    """Positions of known features: a small table of hashes turns almost all others away."""

    BITS = 22

    def __init__(self, grams: np.ndarray, features: str = "words"):
        self.grams, self.table, self.extract = grams, np.zeros(1 << self.BITS, dtype=bool), EXTRACTORS[features]
        self.table[self._slot(grams)] = True

    def _slot(self, grams: np.ndarray) -> np.ndarray:
        return (grams * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.BITS)

    def present(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(row, position in the sorted features) once for each that a text has, by row."""
        rows, places = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for code, good, off in self.extract(texts):
            at = np.flatnonzero(self.table[self._slot(code)] & good)
            place = np.minimum(np.searchsorted(self.grams, code[at]), len(self.grams) - 1)
            hit = self.grams[place] == code[at]
            rows.append(np.searchsorted(off, at[hit], "right") - 1)
            places.append(place[hit])
        pairs = np.unique(np.concatenate(rows) * len(self.grams) + np.concatenate(places))
        return pairs // len(self.grams), pairs % len(self.grams)


def fit_nnpu(rows: tuple[np.ndarray, np.ndarray], features: tuple[np.ndarray, np.ndarray], sizes: tuple[int, int], n_features: int, prior: float, steps: int = STEPS, rate: float = RATE, penalty: float = PENALTY) -> tuple[np.ndarray, float]:
    """Weights and intercept by full-batch Adam, averaged over the second half of the steps; ``rows`` and ``features`` list the ones of the positives, then of the
    unlabelled texts, and ``sizes`` says how many texts each has."""
    theta = np.zeros(n_features + 1)
    theta[-1] = np.log(prior / (1 - prior))
    m, v, mean = np.zeros_like(theta), np.zeros_like(theta), np.zeros_like(theta)
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -40, 40)))

    def outputs(k: int) -> np.ndarray:
        return np.bincount(rows[k], theta[features[k]], sizes[k]) + theta[-1]

    def pull(k: int, slope: np.ndarray) -> np.ndarray:
        return np.append(np.bincount(features[k], slope[rows[k]], n_features), slope.sum())

    for t in range(1, steps + 1):
        z_p, z_u = outputs(0), outputs(1)
        s_p, s_u = sigmoid(z_p), sigmoid(z_u)
        negative = np.logaddexp(0, z_u).mean() - prior * np.logaddexp(0, z_p).mean()
        d_negative = pull(1, s_u / sizes[1]) - pull(0, prior * s_p / sizes[0])
        grad = pull(0, prior * (s_p - 1) / sizes[0]) + d_negative if negative >= 0 else -d_negative
        grad[:-1] += penalty * theta[:-1]
        m = 0.9 * m + 0.1 * grad
        v = 0.999 * v + 0.001 * grad**2
        theta -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        if t > steps // 2:
            mean += theta / (steps - steps // 2)
    return mean[:-1], float(mean[-1])


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", folds: int = FOLDS, most_positive: int = MOST_POSITIVE, most_unlabelled: int = MOST_UNLABELLED, n_features: int = N_FEATURES, features: str = "words") -> Model | None:
    """The classifier; ``labels`` has ``id_col`` and ``label_col`` (1: toxic). None without any positive."""
    spark = docs.sparkSession
    ids, text = F.col(f"`{id_col}`"), F.col(f"`{text_col}`")
    known = labels.where(~held_out(ids, folds) & F.col(f"`{label_col}`").isNotNull())
    n, positive = known.agg(F.count(F.lit(1)), F.sum((F.col(f"`{label_col}`") == 1).cast("long"))).first()
    if not positive:
        return None
    prior = min(0.5, positive / n)
    open_docs = docs.where(~held_out(ids, folds)).select(F.xxhash64(ids).alias("key"), text.cast("string").alias("text"))
    chosen = spark.createDataFrame([(int(k),) for k in bounded_keys(known.where(F.col(f"`{label_col}`") == 1).select(id_col), most_positive)], "key long")
    share = min(1.0, most_unlabelled / max(1, docs.count() * (folds - 1) / folds))
    sampled = (F.col("key") <= int(-(2**63) + share * (2**64 - 1))) if share < 1 else F.lit(True)
    marked = open_docs.join(F.broadcast(chosen.withColumn("positive", F.lit(True))), "key", "left").select(F.coalesce("positive", F.lit(False)).alias("positive"), sampled.alias("sampled"), "text").where("positive or sampled")

    def counted(batches):
        for batch in batches:
            _, offsets = tb.utf8(batch.column(2))
            for lo, hi in tb.row_slices(offsets):
                part = batch.slice(lo, hi - lo)
                for code, good, off in EXTRACTORS[features](part.column(2)):
                    at = np.flatnonzero(good)
                    row, grams = _distinct(np.searchsorted(off, at, "right") - 1, code[at])
                    found, place = np.unique(grams, return_inverse=True)
                    n = [np.bincount(place, part.column(k).to_numpy(zero_copy_only=False)[row], len(found)).astype(np.int64) for k in range(2)]
                    yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n[0]), pa.array(n[1])], ["gram", "p", "u"])

    n_p, n_u = marked.agg(F.sum(F.col("positive").cast("long")), F.sum(F.col("sampled").cast("long"))).first()
    if not n_p or not n_u:
        return None
    seen = marked.mapInArrow(counted, "gram long, p long, u long").groupBy("gram").agg(F.sum("p").alias("p"), F.sum("u").alias("u"))
    common = seen.where((F.col("p") >= LEAST_SEEN) & (prior * F.col("p") / n_p >= LEAST_PURE * F.col("u") / n_u))
    both = (F.col("p") + F.col("u")) / (n_p + n_u)
    part = lambda k, expected: F.when(k > 0, k * F.log(k / expected)).otherwise(0.0)
    ratio = 2 * sum(part(F.col(c), n * both) + part(n - F.col(c), n * (1 - both)) for c, n in (("p", n_p), ("u", n_u)))
    top = common.select("gram", ratio.alias("ratio")).where(F.col("ratio") >= SURE).orderBy(F.desc("ratio"), "gram").limit(n_features).collect()
    if not top:
        return None
    grams = np.sort(np.array([r[0] for r in top], dtype=np.int64).view(np.uint64))
    shared, state = spark.sparkContext.broadcast(grams), {}

    def present(batches):
        for batch in batches:
            if "finder" not in state:
                state["finder"] = _Finder(shared.value, features)
            row, at = state["finder"].present(batch.column(2))
            bounds = np.searchsorted(row, np.arange(batch.num_rows + 1))
            packed = [at[lo:hi].astype("<u4").tobytes() for lo, hi in zip(bounds[:-1], bounds[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(packed, pa.binary())], ["positive", "sampled", "grams"])

    sample = marked.mapInArrow(present, "positive boolean, sampled boolean, grams binary").collect()
    parts = []
    for take in ("positive", "sampled"):
        own = sorted(r["grams"] for r in sample if r[take])
        sizes = [len(w) // 4 for w in own]
        parts.append((np.repeat(np.arange(len(own)), sizes), np.frombuffer(b"".join(own), "<u4").astype(np.int64), len(own)))
    if not all(p[2] for p in parts):
        return None
    weights, intercept = fit_nnpu(*[tuple(p[k] for p in parts) for k in range(3)], len(grams), prior)
    return Model(grams, weights, intercept, features)


def score(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", folds: int = FOLDS) -> DataFrame:
    """(id, held_out, score, predicted) of every row."""
    shared, state = docs.sparkSession.sparkContext.broadcast(model), {}

    def fn(ids: pa.Array, texts: pa.Array) -> pa.RecordBatch:
        if (m := shared.value) is None:
            scores = np.zeros(len(texts))
        else:
            if "finder" not in state:
                state["finder"] = _Finder(m.grams, m.features)
            row, at = state["finder"].present(texts)
            scores = 1 / (1 + np.exp(-np.clip(np.bincount(row, m.weights[at], len(texts)) + m.intercept, -40, 40)))
        return pa.RecordBatch.from_arrays([ids, pa.array(scores)], ["id", "score"])

    done = tb.map_texts(docs, text_col, id_col, fn, f"id {docs.schema[id_col].dataType.simpleString()}, score double")
    return done.select("id", held_out(F.col("id"), folds).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
