"""Language identification (operator 10) by rank-order n-gram profiles.

A profile lists the TOP most frequent character n-grams of one to LONGEST letters, in order; words are bounded by one
mark on either side, everything but letters only bounds. A text's own list is compared with each language's: the
out-of-place distance sums how far each of its n-grams stands from its place in the profile, or TOP where the profile
lacks it. The nearest language wins, ties go to the name that sorts first.

Profiles are counted over all training rows: those of known language whose id's CRC-32 does not leave 1 modulo FOLDS.
Language, source and id are no inputs of a prediction.

Defined results: ``und`` and score 0.0 for a null text, a text without a letter, or without any profile; a null id
counts as held out; a text of any length is read whole; of equally near languages the one that sorts first is given;
repeated rows are judged one by one; an empty table gives an empty result; other columns, whatever their names, are
not read.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm import textblocks as tb

FOLDS, TOP, LONGEST = 3, 300, 3
UNKNOWN = "und"
_EDGE = 0x20


def held_out(id_col: Column, folds: int = FOLDS) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % folds == 1, F.lit(True))


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Which code points are letters."""
    out = np.zeros(0x110000, dtype=bool)
    out[[i for i in range(0x110000) if chr(i).isalpha()]] = True
    return out


def ngram_lists(texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each text its n-grams, each packed into one integer of 21 bits a code point, and how often it has them."""
    low = [(t or "").lower() for t in texts]
    codes = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), "<u4")
    bounds = np.concatenate(([0], np.cumsum([len(t) for t in low])))
    letter = _letters()[codes] if len(codes) else np.zeros(0, bool)
    alphabet, dense = np.unique(np.where(letter, codes, _EDGE), return_inverse=True)
    bits = max(1, int(len(alphabet)).bit_length())
    kind = np.int32 if bits * LONGEST < 31 else np.int64
    back = np.concatenate(([0], alphabet)).astype(np.int64)
    edge = int(np.searchsorted(alphabet, _EDGE)) + 1 if _EDGE in alphabet else 0
    out = []
    for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
        own = letter[lo:hi]
        if not own.any():
            out.append((np.zeros(0, np.int64), np.zeros(0, np.int64)))
            continue
        # one edge before the first letter and one after each word
        keep = own | np.concatenate(([False], own[:-1]))
        mark = edge or len(alphabet) + 1
        c = np.concatenate(([mark], (dense[lo:hi][keep] + 1), [mark] if own[-1] else [])).astype(kind)
        grams, key = [], np.zeros(len(c), dtype=kind)
        for n in range(1, LONGEST + 1):
            key = (key[: len(c) - n + 1] << bits) | c[n - 1 :]
            grams.append(key[c != mark] if n == 1 else key)
        found, count = np.unique(np.concatenate(grams), return_counts=True)
        wide, exact, ones = found.astype(np.int64), np.zeros(len(found), np.int64), (1 << bits) - 1
        table = back if edge else np.append(back, _EDGE)
        for n in range(LONGEST - 1, -1, -1):
            exact = (exact << 21) | table[(wide >> (bits * n)) & ones]
        out.append((exact, count))
    return out


def ranked(grams: np.ndarray, counts: np.ndarray, top: int) -> np.ndarray:
    """The ``top`` most frequent n-grams, most frequent first, ties by n-gram."""
    return grams[np.lexsort((grams, -counts))[:top]]


def profiles(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = FOLDS, top: int = TOP) -> dict[str, np.ndarray]:
    """The n-grams of each language in order; ``top`` rows a language reach the driver."""
    rows = docs.where(~held_out(F.col(f"`{id_col}`"), folds) & F.col(f"`{lang_col}`").isNotNull()).select(F.col(f"`{lang_col}`").cast("string").alias("lang"), F.col(f"`{text_col}`").cast("string").alias("text"))

    def run(batches):
        for batch in batches:
            _, offsets = tb.utf8(batch.column(1))
            for lo, hi in tb.row_slices(offsets, 8 * tb.BLOCK_BYTES):
                langs = np.array(batch.column(0).slice(lo, hi - lo).to_pylist())
                lists = ngram_lists(batch.column(1).slice(lo, hi - lo).to_pylist())
                for lang in sorted(set(langs.tolist())):
                    own = [lists[i] for i in np.flatnonzero(langs == lang)]
                    grams, at = np.unique(np.concatenate([g for g, _ in own]), return_inverse=True)
                    counts = np.bincount(at, np.concatenate([c for _, c in own]), len(grams)).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams), pa.string()), pa.array(grams), pa.array(counts)], ["lang", "gram", "n"])

    counted = rows.mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    found: dict[str, list[tuple[int, int]]] = {}
    for lang, gram, at in counted.withColumn("at", place).where(F.col("at") <= top).select("lang", "gram", "at").collect():
        found.setdefault(lang, []).append((at, gram))
    return {lang: np.array([g for _, g in sorted(own)], dtype=np.int64) for lang, own in sorted(found.items())}


def identify(docs: DataFrame, known: dict[str, np.ndarray], id_col: str = "doc_id", text_col: str = "text", folds: int = FOLDS, top: int = TOP) -> DataFrame:
    """(id, held_out, lang_pred, score) of every row; the score is 1 less the distance as a share of its maximum."""
    names = sorted(known)
    grams = np.unique(np.concatenate([known[n] for n in names])) if names else np.zeros(0, np.int64)
    places = np.full((len(names), len(grams)), -1, dtype=np.int64)
    for k, n in enumerate(names):
        places[k, np.searchsorted(grams, known[n])] = np.arange(len(known[n]))
    shared = docs.sparkSession.sparkContext.broadcast((names, grams, places))

    def fn(ids: pa.Array, texts: pa.Array) -> pa.RecordBatch:
        names, grams, places = shared.value
        langs, scores = [], []
        for own, counts in ngram_lists(texts.to_pylist()):
            if not len(own) or not names:
                langs.append(UNKNOWN)
                scores.append(0.0)
                continue
            order = ranked(own, counts, top)
            at = np.minimum(np.searchsorted(grams, order), len(grams) - 1)
            place = np.where(grams[at] == order, places[:, at], -1)
            away = np.where(place < 0, top, np.abs(place - np.arange(len(order)))).sum(axis=1)
            best = int(np.argmin(away))
            langs.append(names[best])
            scores.append(1 - float(away[best]) / (top * len(order)))
        return pa.RecordBatch.from_arrays([ids, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["id", "lang_pred", "score"])

    done = tb.map_texts(docs, text_col, id_col, fn, f"id {docs.schema[id_col].dataType.simpleString()}, lang_pred string, score double")
    return done.select("id", held_out(F.col("id"), folds).alias("held_out"), "lang_pred", "score")
