"""Vectorised text primitives shared by the operators that work over Arrow batches.

An Arrow string column is already one contiguous UTF-8 byte buffer plus offsets, so words, lines, n-grams and
their 64-bit hashes are found with whole-array numpy operations; nothing loops over words in Python.

Hashes are polynomial hashes modulo 2**64 over a fixed random byte table, finished with a bit mixer; such hashes can be
alike for long spans of a certain form, so spans of more than LONG_SPAN bytes have keyed BLAKE2 hashes. Two different
words of a corpus of 10**9 distinct ones share a hash with a chance near 3 %, so operators that need exactness
compare the texts behind equal hashes.
"""

from __future__ import annotations

import functools
import hashlib
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of text that one numpy pass works on; a longer text is a pass of its own.
BLOCK_BYTES = 1 << 18
ROW = "__row"
#: Longest span whose hash is a polynomial.
LONG_SPAN = 64
_KEY = b"spans"

_U = np.uint64
_B = _U(0x9E3779B97F4A7C15)
_D = _U(0xD1342543DE82EF95)


def _inverse(odd: np.uint64) -> np.uint64:
    return _U(pow(int(odd), -1, 1 << 64))


class _Powers:
    """Powers of an odd number and of its inverse modulo 2**64, grown on demand."""

    def __init__(self, base: np.uint64):
        self.base, self.inv = base, _inverse(base)
        self.up = np.ones(1, dtype=_U)
        self.down = np.ones(1, dtype=_U)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            grow = lambda b: np.concatenate(([_U(1)], np.full(size - 1, b, dtype=_U))).cumprod(dtype=_U)
            self.up, self.down = grow(self.base), grow(self.inv)
        return self.up[:n], self.down[:n]


_BYTE_POWERS, _WORD_POWERS = _Powers(_B), _Powers(_D)
_BYTE_VALUES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.int64).astype(_U)

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: True for the bytes of words ``[^\x20\x09-\x0D]+``.
NOT_SPACE = ~_SPACE
#: True for letters, digits and every byte of a character beyond ASCII.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
#: Scripts written without spaces between words: Thai, Lao, Myanmar, Khmer, Tai, Javanese, Han, kana, Bopomofo and Yi.
UNSPACED = (
    (0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x1950, 0x19FF), (0x1A20, 0x1AAF), (0x3005, 0x3007), (0x3021, 0x302F), (0x3031, 0x312F),
    (0x31A0, 0x31BF), (0x31F0, 0x31FF), (0x3400, 0x4DBF), (0x4E00, 0xA4CF), (0xA980, 0xA9FF), (0xAA60, 0xAADF), (0xF900, 0xFAFF), (0xFF66, 0xFF9F),
    (0x16FE0, 0x18DFF), (0x1AFF0, 0x1B2FF), (0x20000, 0x3FFFF),
)
LOWER_ASCII = np.arange(256, dtype=np.uint8)
LOWER_ASCII[0x41:0x5B] += 0x20


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective bit mixer of unsigned 64-bit integers."""
    x = x ^ (x >> _U(30))
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, one after the other, and the offsets between them; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()) if not pa.types.is_large_string(texts.type) else texts
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    off = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[off[0] : off[-1]], off - off[0]


def row_slices(offsets: np.ndarray, most: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most ``most`` bytes of text, or of a single row."""
    at, n = 0, len(offsets) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield at, min(to, n)
        at = min(to, n)


def spans(mask: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of True that do not cross an offset."""
    n = len(mask)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inner = offsets[(offsets > 0) & (offsets < n)]
    before = np.concatenate(([False], mask[:-1]))
    before[inner] = False
    after = np.concatenate((mask[1:], [False]))
    after[inner - 1] = False
    return np.flatnonzero(mask & ~before), np.flatnonzero(mask & ~after) + 1


@functools.cache
def _kinds() -> np.ndarray:
    """By code point: 1 for letters, digits and marks, 2 for those of unspaced scripts, 3 for marks of these, else 0."""
    kinds = np.zeros(0x110000, dtype=np.uint8)
    spaced = np.ones(len(kinds), dtype=bool)
    for lo, hi in UNSPACED:
        spaced[lo : hi + 1] = False
    for c in range(0x80, 0x40000):
        major = unicodedata.category(chr(c))[0]
        if major in "LNM" and not 0xFE00 <= c <= 0xFE0F:
            kinds[c] = 1 if spaced[c] else 3 if major == "M" else 2
    return kinds


def token_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of runs of Unicode letters and digits; of an unspaced script each letter, with its marks, is a run."""
    mask = ALNUM[data]
    lead = np.flatnonzero(data >= 0xC0)
    if not len(lead):
        return spans(mask, offsets)
    first = data[lead]
    size = 2 + (first >= 0xE0) + (first >= 0xF0).astype(np.int64)
    point = (first & (0xFF >> (size + 1))).astype(np.int64)
    for j in range(1, 4):
        more = size > j
        point[more] = (point[more] << 6) | (data[lead[more] + j] & 0x3F)
    kind = _kinds()[point]
    for j in range(4):
        other = lead[(size > j) & (kind == 0)]
        mask[other + j] = False
    # an unspaced letter begins a run, and what follows it or its mark begins one too, but a mark
    after = (lead + size)[kind >= 2]
    marks = lead[kind == 3]
    return spans(mask, np.concatenate((offsets, lead[kind == 2], after[~np.isin(after, marks)])))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the byte spans (sorted by start); equal bytes hash alike wherever they stand."""
    out = np.empty(len(starts), dtype=_U)
    at = 0
    while at < len(starts):
        base = starts[at]
        to = max(at + 1, int(np.searchsorted(starts, base + BLOCK_BYTES)))
        s, e = starts[at:to] - base, ends[at:to] - base
        size = int(e.max()) + 1
        up, down = _BYTE_POWERS.upto(size)
        sums = np.zeros(size, dtype=_U)
        np.cumsum(_BYTE_VALUES[data[base : base + size - 1]] * up[:-1], out=sums[1:])
        out[at:to] = mix64((sums[e] - sums[s]) * down[s] + (e - s).astype(_U))
        at = to
    for k in np.flatnonzero(ends - starts > LONG_SPAN).tolist():
        out[k] = int.from_bytes(hashlib.blake2b(data[starts[k] : ends[k]].tobytes(), digest_size=8, key=_KEY).digest(), "little")
    return out


def exact_ids(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Small numbers of the byte spans (sorted, not overlapping): two spans have the same number if and only if their
    bytes are the same. Unlike hashes, these need no comparison behind them; they hold within one call only."""
    inside = np.zeros(len(data) + 1, dtype=np.int8)
    inside[starts] += 1
    inside[ends] -= 1
    packed = data[np.cumsum(inside[:-1], dtype=np.int8).view(bool)]
    offsets = np.concatenate(([0], np.cumsum(ends - starts, dtype=np.int64)))
    spans_ = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(packed))])
    return spans_.dictionary_encode().indices.to_numpy()


def joined(data: np.ndarray, off: np.ndarray, starts: np.ndarray, ends: np.ndarray, kept: np.ndarray) -> pa.Array:
    """The kept words of each text, joined by one space. ``starts`` and ``ends`` are those of the texts' words."""
    at = np.flatnonzero(kept)
    row = np.searchsorted(off, starts[at], "right")
    gap = ends[at[:-1]][row[:-1] == row[1:]]  # behind a word that is not its text's last stands white space
    inside = np.zeros(len(data) + 1, dtype=np.int8)
    inside[starts[at]] += 1
    inside[ends[at]] -= 1
    mask = np.cumsum(inside[:-1], dtype=np.int8).view(bool)
    mask[gap] = True
    spaced = data.copy()
    spaced[gap] = 0x20
    offsets = np.concatenate(([0], np.cumsum(mask, dtype=np.int64)))[off]
    return pa.Array.from_buffers(pa.large_string(), len(off) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(spaced[mask]))]).cast(pa.string())


def window_hashes(tokens: np.ndarray, k: int) -> np.ndarray:
    """Hashes of every k consecutive tokens: entry i covers tokens i to i + k - 1."""
    n = len(tokens)
    if n < k:
        return np.zeros(0, dtype=_U)
    up, down = _WORD_POWERS.upto(n + 1)
    sums = np.zeros(n + 1, dtype=_U)
    np.cumsum(tokens * up[:n], out=sums[1:])
    return mix64((sums[k:] - sums[:-k]) * down[: n - k + 1])


def per_row(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of ``flags`` between successive bounds."""
    sums = np.zeros(len(flags) + 1, dtype=np.int64)
    np.cumsum(flags, out=sums[1:])
    return sums[bounds[1:]] - sums[bounds[:-1]]


def first_windows(bounds: np.ndarray, k: int, n: int) -> np.ndarray:
    """Which of the windows of k tokens stay within one row."""
    ok = np.ones(max(0, n - k + 1), dtype=bool)
    for back in range(1, k):
        edge = bounds[1:-1] - back
        ok[edge[(edge >= 0) & (edge < len(ok))]] = False
    return ok


def covered(starts: np.ndarray, k: int, n: int) -> np.ndarray:
    """Which of n tokens lie in a window of k tokens that begins at one of ``starts``."""
    steps = np.zeros(n + 1, dtype=np.int32)
    np.add.at(steps, starts, 1)
    np.add.at(steps, starts + k, -1)
    return np.cumsum(steps[:-1]) > 0


def map_texts(docs: DataFrame, text: str | Column, id_col: str | Column, fn: Callable[[pa.Array, pa.Array], pa.RecordBatch | None], schema: str, keep_row: bool = False) -> DataFrame:
    """Runs ``fn(ids, texts)`` over Arrow slices of bounded size.

    ``fn`` returns a batch with the columns of ``schema``. With ``keep_row`` it returns one row per text, and each
    also carries the whole input row in the struct column ``__row``; else just what ``fn`` returns. The input's
    other columns never reach ``fn``, so their names cannot clash.
    """
    col = lambda c: F.col(f"`{c}`") if isinstance(c, str) else c
    cols = [col(id_col).alias("__id"), col(text).cast("string").alias("__text")]
    if keep_row:
        cols.append(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(ROW))
    packed = docs.select(*cols)
    out_schema = schema if not keep_row else f"{ROW} {packed.schema[ROW].dataType.simpleString()}, {schema}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, offsets = utf8(batch.column("__text"))
            for lo, hi in row_slices(offsets):
                part = batch.slice(lo, hi - lo)
                out = fn(part.column("__id"), part.column("__text"))
                if out is None:
                    continue
                if keep_row:
                    out = pa.RecordBatch.from_arrays([part.column(ROW), *out.columns], [ROW, *out.schema.names])
                yield out

    return packed.mapInArrow(run, out_schema)
