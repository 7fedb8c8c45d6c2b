"""Byte-level BPE encoding and decoding (operator 4) with the tokenizers library over Arrow batches.

A text is cut into the matches of the vocabulary's split pattern. Each distinct piece is encoded once a task by the
library (no special tokens: their strings are ordinary text) and kept in a bounded cache; a text's ids are the
joined ids of its pieces, which is what encoding the whole text gives, since merges never cross a piece. New pieces go
to the library many at a time, as the words of one text, and the bytes that ids stand for say where a piece's ids end.

The vocabulary writes each byte as one printable character. Decoding maps the characters of each id's entry back
through that byte table, so an id that holds only part of a multi-byte character gives back exactly its bytes, and
the parts join to the character again.

Defined results: a null text counts as empty and gives no ids; a text or piece of any length is encoded whole; of
equal pairs the leftmost merges first, as the ranks say; repeated rows are encoded one by one; an empty table
gives an empty result; other columns of the input are not read.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from tokenizers import Tokenizer, pre_tokenizers

from tessera.llm import textblocks as tb

#: The split pattern; its classes are letters, numbers and the white space of Unicode, which is what Rust's ``\\s`` is.
_SPLIT = "'s|'t|'re|'ve|'m|'ll|'d| ?[{L}]+| ?[{N}]+| ?[^{S}{L}{N}]+|[{S}]+(?![^{S}])|[{S}]+"
_CLASSES = {"L": r"\p{L}", "N": r"\p{N}", "S": r"\p{White_Space}"}
#: Characters that the re module finds in a class by one look into a table.
_TABLE_CHARS = 0x10000
#: Distinct pieces in each of the two generations that a task keeps: the younger one becomes the older once it is full,
#: and a piece that is met again moves back, so common pieces stay.
CACHE_PIECES = 200_000
#: Pieces that the library encodes in one call; its result takes far more memory than the ids.
ENCODE_PIECES = 4_096


def byte_table() -> dict[str, int]:
    """The vocabulary's character for each byte: printable ones stand for themselves, the rest follow from U+0100."""
    plain = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b <= 0xFF]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


@lru_cache(maxsize=1)
def splitters() -> tuple[re.Pattern, regex.Pattern]:
    """The split pattern for texts of the first 65,536 characters and for all texts.

    The first is the faster one; it lists the characters that the other's classes have.
    """
    chars = "".join(map(chr, range(_TABLE_CHARS)))
    listed = {k: "".join(f"{re.escape(m[0][0])}-{re.escape(m[0][-1])}" for m in regex.finditer(f"{c}+", chars)) for k, c in _CLASSES.items()}
    return re.compile(_SPLIT.format(**listed)), regex.compile(_SPLIT.format(**_CLASSES))


class Codec:
    """Encoder and decoder of one vocabulary file in one task."""

    def __init__(self, vocabulary: str):
        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.tokenizer.encode_special_tokens = True
        if isinstance(self.tokenizer.pre_tokenizer, pre_tokenizers.ByteLevel):
            self.tokenizer.pre_tokenizer.use_regex = False  # what it gets is cut
        self.near, self.any = (p.findall for p in splitters())
        table = byte_table()
        vocab = self.tokenizer.get_vocab(with_added_tokens=False)
        self.bytes_of: list[bytes] = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            self.bytes_of[i] = bytes(map(table.__getitem__, token)) if all(c in table for c in token) else token.encode()
        self.sizes = np.array(list(map(len, self.bytes_of)), dtype=np.int64)
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def pieces(self, text: str) -> list[str]:
        """The matches of the split pattern."""
        return (self.near if len(text.encode("utf-16-le", "surrogatepass")) == 2 * len(text) else self.any)(text)

    def encode_pieces(self, pieces: list[str]) -> list[bytes]:
        """Ids of each piece, from one call of the library."""
        ids = np.array(self.tokenizer.encode_batch_fast([pieces], is_pretokenized=True, add_special_tokens=False)[0].ids, dtype="<u4")
        ends, own = np.cumsum(self.sizes[ids]), np.cumsum([len(p.encode()) for p in pieces])
        last = np.searchsorted(ends, own)
        if len(ids) != last[-1] + 1 or (ends[last] != own).any():  # a vocabulary that writes other bytes than the piece's
            return [np.array(e.ids, dtype="<u4").tobytes() for e in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]
        packed, to = ids.tobytes(), [0, *(4 * last + 4).tolist()]
        return [packed[a:b] for a, b in zip(to, to[1:], strict=False)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        cut = [self.pieces(t) for t in texts]
        distinct = set().union(*cut)
        absent = distinct.difference(self.cache)
        if len(self.cache) + len(absent) > CACHE_PIECES:
            self.cache, self.older, absent = {}, self.cache, distinct
        known = list(filter(self.older.__contains__, absent))
        self.cache.update(zip(known, map(self.older.__getitem__, known), strict=True))
        new = list(absent.difference(known))
        for at in range(0, len(new), ENCODE_PIECES):
            some = new[at : at + ENCODE_PIECES]
            self.cache.update(zip(some, self.encode_pieces(some), strict=True))
        ids = self.cache.__getitem__
        return [b"".join(map(ids, c)) for c in cut]

    def decode(self, packed: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(packed, dtype="<u4").tolist()))

    def offsets(self, text: str, packed: bytes) -> np.ndarray:
        """Start and end of each id in code points of the text, as two columns.

        An id that holds part of a character spans the whole of it, so neighbours that share one overlap there.
        """
        data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
        ends = np.cumsum([len(self.bytes_of[i]) for i in np.frombuffer(packed, dtype="<u4").tolist()], dtype=np.int64)
        chars = np.cumsum((data & 0xC0) != 0x80)  # of each byte: the number of its character, from 1
        starts = np.concatenate(([0], ends[:-1]))
        return np.stack((chars[starts] - 1, chars[ends - 1]), axis=1) if len(ends) else np.zeros((0, 2), np.int64)


@lru_cache(maxsize=2)
def codec(vocabulary: str) -> Codec:
    return Codec(vocabulary)


def encode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", keep_row: bool = False) -> DataFrame:
    """id, n_tokens, ids (binary: little-endian unsigned 32-bit) of every text.

    ``vocabulary`` is the path of a tokenizers file that every executor has.
    """

    def fn(ids: pa.Array, texts: pa.Array) -> pa.RecordBatch:
        packed = codec(vocabulary).encode([t or "" for t in texts.to_pylist()])
        return pa.RecordBatch.from_arrays([ids, pa.array([len(p) // 4 for p in packed], pa.int64()), pa.array(packed, pa.binary())], ["id", "n_tokens", "ids"])

    return tb.map_texts(docs, text_col, id_col, fn, f"id {docs.schema[id_col].dataType.simpleString()}, n_tokens long, ids binary", keep_row)


def round_trip(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", with_offsets: bool = False) -> DataFrame:
    """id, n_tokens, ids, decoded (binary: the bytes that the ids stand for) of every text.

    ``with_offsets`` adds ``starts`` and ``ends``, the code points each id spans.
    """

    def fn(ids: pa.Array, texts: pa.Array) -> pa.RecordBatch:
        own, c = [t or "" for t in texts.to_pylist()], codec(vocabulary)
        packed = c.encode(own)
        cols = {"id": ids, "n_tokens": pa.array([len(p) // 4 for p in packed], pa.int64()), "ids": pa.array(packed, pa.binary()), "decoded": pa.array(map(c.decode, packed), pa.binary())}
        if with_offsets:
            at = [c.offsets(t, p) for t, p in zip(own, packed, strict=True)]
            cols |= {n: pa.array([a[:, k].tolist() for a in at], pa.list_(pa.int64())) for k, n in enumerate(("starts", "ends"))}
        return pa.RecordBatch.from_arrays(list(cols.values()), list(cols))

    schema = f"id {docs.schema[id_col].dataType.simpleString()}, n_tokens long, ids binary, decoded binary"
    return tb.map_texts(docs, text_col, id_col, fn, schema + ", starts array<long>, ends array<long>" * with_offsets)


def decode(encoded: DataFrame, vocabulary: str, ids_col: str = "ids", id_col: str = "id") -> DataFrame:
    """id, decoded (binary) of packed ids; null ids give null."""

    def run(batches):
        for batch in batches:
            c = codec(vocabulary)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([None if p is None else c.decode(p) for p in batch.column(1).to_pylist()], pa.binary())], ["id", "decoded"])

    return encoded.select(id_col, ids_col).mapInArrow(run, f"id {encoded.schema[id_col].dataType.simpleString()}, decoded binary")
