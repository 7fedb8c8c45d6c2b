"""Benchmark decontamination (operator 2) with spaced-seed hashing.

Tokens are runs of Unicode letters and digits, lower-cased; a letter of a script written without spaces, such as Han,
kana or Thai, is with its marks a token of its own. Punctuation and symbols of any script part tokens. A mask selects some positions of a short span and ignores the
others; the hash of the selected tokens is a seed. Two texts that agree but for a few substituted tokens still share
seeds whose ignored positions fall on the substitutions. The work goes in four steps:

1. seeds of all benchmark items; a Bloom filter of them, of bounded size, goes to every task;
2. one pass over the corpus: positions whose seed passes the filter are kept with the tokens around them;
3. these few seeds are joined with the benchmark's by hash, which names item and alignment;
4. each alignment is verified: a window of WINDOW tokens must agree in all but MOST_SUBSTITUTED of them.

The two spaced masks together hit every window of 13 tokens with any two substituted, and of 10 to 12 tokens with
any one. Items of 5 to 9 tokens must occur whole and unchanged. Within other text, shorter ones are no evidence of a
leak; with ``with_short_lines`` they are found where a line of a text has their tokens and no other. ``window_of`` states
this for every length. The filter's size has an upper bound; a larger benchmark makes it pass more positions on to
the join, never fewer.

Defined results: null or empty texts have no tokens and no overlap; repeated rows of an id count once; copies of an
item are items of their own; texts and items of any length are read whole; of several alignments the one with the
most equal tokens counts; empty tables give an empty result; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import textblocks as tb
from tessera.llm.tables import settle

#: Positions that each mask selects; the others are ignored.
MASKS = ((0, 1, 3, 5, 6, 7), (0, 1, 4, 5, 8, 9))
WINDOW, MOST_SUBSTITUTED, SHORTEST = 13, 2, 5
#: Tokens kept on either side of a hit.
AROUND = 32
#: Bits of the filter: at least BITS_PER_SEED for each seed, at most 2**25 (4 MB).
BITS_PER_SEED, LEAST_BITS, MOST_BITS, PROBES = 64, 1 << 20, 1 << 25, 3

_C = (np.arange(1, 64, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)) | np.uint64(1)


def window_of(n: int) -> tuple[int, int]:
    """Length of the window that must agree for an item of n tokens, and how many may be substituted."""
    length = min(WINDOW, n)
    return length, MOST_SUBSTITUTED if length == WINDOW else 1 if length >= 10 else 0


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of all texts and bounds by text."""
    data, off = tb.utf8(pc.utf8_lower(texts))
    starts, ends = tb.token_spans(data, off)
    return tb.span_hashes(data, starts, ends), np.searchsorted(starts, off)


def seeds(toks: np.ndarray, mask: tuple[int, ...]) -> np.ndarray:
    """The seed at every position where the mask fits; seeds of different masks never meet but by chance."""
    size = len(toks) - mask[-1]
    if size <= 0:
        return np.zeros(0, np.uint64)
    key = np.uint64(sum(1 << p for p in mask))
    total = np.full(size, key, dtype=np.uint64)
    for j, p in enumerate(mask):
        total += toks[p : p + size] * _C[j]
    return tb.mix64(total)


def short_lines(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """First token and number of tokens of every line that has some, but fewer than SHORTEST."""
    data, off = tb.utf8(pc.utf8_lower(texts))
    starts, _ = tb.token_spans(data, off)
    row = np.searchsorted(off, starts, "right")
    line = np.searchsorted(np.flatnonzero(data == 0x0A), starts)
    first = np.flatnonzero(np.concatenate(([True], (np.diff(row) > 0) | (np.diff(line) > 0)))) if len(starts) else np.zeros(0, np.int64)
    size = np.diff(np.append(first, len(starts)))
    return first[size < SHORTEST], size[size < SHORTEST]


def _probes(hashes: np.ndarray, bits: int) -> list[np.ndarray]:
    step = (hashes >> np.uint64(32)) | np.uint64(1)
    return [((hashes + np.uint64(k) * step) & np.uint64(bits - 1)).astype(np.int64) for k in range(PROBES)]


def benchmark_seeds(items: DataFrame, id_col: str, text_col: str, shortest: int = SHORTEST) -> DataFrame:
    """(item_id, tokens, hash, q): one row for every seed of every item; tokens are packed 64-bit hashes."""

    def fn(ids: pa.Array, texts: pa.Array) -> pa.RecordBatch:
        toks, bounds = tokens(texts)
        rows: list[tuple] = []
        for r, (lo, hi) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
            own, n = toks[lo:hi], hi - lo
            if n < shortest:
                continue
            for mask in MASKS if n > max(m[-1] for m in MASKS) else (tuple(range(n)),):
                rows += [(r, own.tobytes(), h, q) for q, h in enumerate(seeds(own, mask).view(np.int64).tolist())]
        at, packed, hashes, q = zip(*rows, strict=True) if rows else ((), (), (), ())
        return pa.RecordBatch.from_arrays([ids.take(pa.array(at, pa.int64())), pa.array(packed, pa.binary()), pa.array(hashes, pa.int64()), pa.array(q, pa.int32())], ["item_id", "tokens", "hash", "q"])

    return tb.map_texts(items, text_col, id_col, fn, f"item_id {items.schema[id_col].dataType.simpleString()}, tokens binary, hash long, q int")


def seed_filter(bench: DataFrame) -> tuple[np.ndarray, list[int]]:
    """The Bloom filter of the benchmark's seeds as an array of bits, and the lengths of items searched whole."""
    whole = F.length("tokens") / 8
    n, short = bench.agg(F.approx_count_distinct("hash"), F.collect_set(F.when(whole <= max(m[-1] for m in MASKS), whole.cast("int")))).first()
    bits = int(min(MOST_BITS, max(LEAST_BITS, 1 << int(n * BITS_PER_SEED).bit_length())))
    step = F.shiftrightunsigned("hash", 32).bitwiseOR(F.lit(1))
    at = F.explode(F.array(*[(F.col("hash") + k * step).bitwiseAND(F.lit(bits - 1)) for k in range(PROBES)]))
    words = bench.select(at.alias("at")).groupBy(F.expr("at div 64").alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(at % 64 as int)))").alias("bits"))
    packed = np.zeros(bits // 64, dtype=np.int64)
    for word, value in words.collect():  # at most bits / 64 rows
        packed[word] = value
    return packed.view(np.uint8), sorted(short)


def _neighbourhoods(docs: DataFrame, id_col: str, text_col: str, packed: np.ndarray, short: list[int]) -> DataFrame:
    """(id, tokens, at, hash): stretches of a text around seeds that pass the filter."""
    shared, bits = docs.sparkSession.sparkContext.broadcast(packed), len(packed) * 8
    masks = (*MASKS, *(tuple(range(n)) for n in short if n >= SHORTEST))
    lines = [n for n in short if n < SHORTEST]
    state: dict[str, np.ndarray] = {}

    def fn(ids: pa.Array, texts: pa.Array) -> pa.RecordBatch | None:
        if "bits" not in state:
            state["bits"] = np.unpackbits(shared.value, bitorder="little").view(bool)
        toks, bounds = tokens(texts)
        found_at, found = [], []
        for mask in masks:
            h = seeds(toks, mask)
            first, *more = _probes(h, bits)
            at = np.flatnonzero(state["bits"][first])
            for probe in more:
                at = at[state["bits"][probe[at]]]
            at = at[tb.first_windows(bounds, mask[-1] + 1, len(toks))[at]]
            found_at.append(at)
            found.append(h[at])
        at, hashes = np.concatenate(found_at), np.concatenate(found)
        whole: list[tuple] = []
        if lines:
            first, size = short_lines(texts)
            for n in lines:
                for a in first[size == n].tolist():
                    own = toks[a : a + n]
                    h = seeds(own, tuple(range(n)))
                    if all(state["bits"][p[0]] for p in _probes(h, bits)):
                        r = int(np.searchsorted(bounds, a, "right")) - 1
                        whole.append((r, int(a - bounds[r]), own.tobytes(), [0], h.view(np.int64).tolist()))
        if not len(at) and not whole:
            return None
        order = np.argsort(at, kind="stable")
        at, hashes = at[order], hashes[order]
        row = np.searchsorted(bounds, at, "right") - 1
        new = np.flatnonzero(np.concatenate(([True], (np.diff(row) > 0) | (np.diff(at) > 2 * AROUND)))) if len(at) else at
        out: list[tuple] = whole
        for lo, hi in zip(new, np.append(new, len(at))[1:], strict=True):
            r = row[lo]
            a, b = max(bounds[r], at[lo] - AROUND), min(bounds[r + 1], at[hi - 1] + AROUND)
            out.append((r, int(a - bounds[r]), toks[a:b].tobytes(), (at[lo:hi] - a).tolist(), hashes[lo:hi].view(np.int64).tolist()))
        rows, start, stretch, pos, hs = zip(*out, strict=True)
        return pa.RecordBatch.from_arrays([ids.take(pa.array(rows, pa.int64())), pa.array(start, pa.int64()), pa.array(stretch, pa.binary()), pa.array(pos, pa.list_(pa.int32())), pa.array(hs, pa.list_(pa.int64()))], ["id", "start", "stretch", "at", "hash"])

    return tb.map_texts(docs, text_col, id_col, fn, f"id {docs.schema[id_col].dataType.simpleString()}, start long, stretch binary, at array<int>, hash array<long>")


def agreement(own: np.ndarray, item: np.ndarray, diagonal: int) -> tuple[int, int, int] | None:
    """Start and end in ``own`` of what the windows that agree cover on this diagonal, and the equal tokens there."""
    length, most = window_of(len(item))
    lo, hi = max(0, diagonal), min(len(own), len(item) + diagonal)
    if hi - lo < length:
        return None
    equal = own[lo:hi] == item[lo - diagonal : hi - diagonal]
    sums = np.concatenate(([0], np.cumsum(equal)))
    good = np.flatnonzero(sums[length:] - sums[:-length] >= length - most)
    if not len(good):
        return None
    return lo + int(good[0]), lo + int(good[-1]) + length, int(equal[tb.covered(good, length, hi - lo)].sum())


def overlaps(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", with_short_lines: bool = False) -> DataFrame:
    """(id, item_id, first_token, last_token, n_equal): verified overlaps, one row for each text and item.

    first_token and last_token (exclusive) bound the overlaps in the text; n_equal is the most tokens that agree on
    one alignment.
    """
    bench = settle(benchmark_seeds(items, item_id_col, item_text_col, 1 if with_short_lines else SHORTEST).distinct(), "benchmark-seeds")
    near = settle(_neighbourhoods(docs, id_col, text_col, *seed_filter(bench)), "seed-hits")
    stretch = near.select(F.xxhash64("id", "start", "stretch").alias("s"), "id", "start", "stretch", "at", "hash")
    hits = stretch.select("s", F.explode(F.arrays_zip("at", "hash")).alias("z")).select("s", "z.at", "z.hash")
    named = hits.join(bench.select("hash", "q", F.xxhash64("item_id", "tokens").alias("i")), "hash").select("s", "i", (F.col("at") - F.col("q")).alias("diagonal")).distinct()
    whole = bench.select(F.xxhash64("item_id", "tokens").alias("i"), "item_id", "tokens").distinct()
    pairs = named.join(whole, "i").join(stretch.select("s", "id", "start", "stretch").distinct(), "s").select("id", "start", "stretch", "item_id", "tokens", "diagonal")

    def verify(batches):
        for batch in batches:
            at, got = [], []
            for k, (own, item, d) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("stretch", "tokens", "diagonal")), strict=True)):
                if (x := agreement(np.frombuffer(own, np.uint64), np.frombuffer(item, np.uint64), d)) is not None:
                    at.append(k)
                    got.append(x)
            pick, start = pa.array(at, pa.int64()), batch.column("start").to_numpy()
            lo, hi, n = (np.array([g[j] for g in got], dtype=np.int64) for j in range(3))
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pick), batch.column("item_id").take(pick), pa.array(lo + start[at]), pa.array(hi + start[at]), pa.array(n)], ["id", "item_id", "lo", "hi", "n"])

    kinds = pairs.schema
    done = pairs.mapInArrow(verify, f"id {kinds['id'].dataType.simpleString()}, item_id {kinds['item_id'].dataType.simpleString()}, lo long, hi long, n long")
    return done.groupBy("id", "item_id").agg(F.min("lo").alias("first_token"), F.max("hi").alias("last_token"), F.max("n").alias("n_equal"))
