"""Spelling variant grouping (operator 13): words one edit apart, and the common form that a rare one stands for.

The words of the corpus are counted with sums in each task before anything is shuffled. The frequent enough ones, in
order, are cut into shards, and each becomes a compact trie: nodes in order of depth, so that a node's children are
neighbours, and three small integers a node. Shards are broadcast, as many at a time as fit ROUND_BYTES, and every
word's distance-one Levenshtein automaton is intersected with every one of them, depth first: along the word's own
path, whatever leaves it by one inserted, deleted or replaced character is followed to its end before the path goes
on. An edit that could be made in several places (one letter of a pair) is made in one of them only, so a neighbour
comes up once. Each task reduces what it finds to one row a word and shard: the number of neighbours and the best form.

A form has at least RATIO times its word's occurrences, so chains of forms are short (their length is the logarithm of
the largest count), and pointer doubling finds their ends in a few joins. The vocabulary is no key of the corpus's
size, and nothing but shards of bounded size ever reaches the driver.

Defined results: a null text has no words; texts and words of any length are read whole (a shard holds SHARD_WORDS
words and SHARD_CHARS characters at most, or one word); ties between forms go to the smallest in code-point order;
repeated rows count once each; an empty table gives an empty result; a null id is an id like any other, but no letter
is deleted for it; other columns, whatever their names, never reach the count.
"""

from __future__ import annotations

import functools
import math
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import textblocks as tb
from tessera.llm.tables import settle

#: Words have at least so many characters and occurrences; a form has at least RATIO times its word's.
MIN_CHARS, MIN_COUNT, RATIO = 6, 5, 5
#: Most words, and characters, of one trie.
SHARD_WORDS, SHARD_CHARS = 250_000, 1 << 22
#: Most bytes of tries that are broadcast at a time, or one trie.
ROUND_BYTES = 1 << 26
#: Words whose automata walk a trie together, and words of one task at least.
BLOCK_WORDS, TASK_WORDS = 2_048, 4_096
#: Bytes of text whose words are counted together.
TEXT_BYTES = 1 << 21

_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True

Slip = Callable[[list, list[bytes]], tuple[np.ndarray, list[bytes]]]


def deleted_letter(every: int) -> Slip:
    """Slips of the pen to be planted: of (id, word) with crc32 h of ``id:word`` divisible by ``every``, the word loses
    its character ``h % length``. Gives the places of such words and what they become."""

    def slip(ids: list, words: list[bytes]) -> tuple[np.ndarray, list[bytes]]:
        heads = {i: zlib.crc32(f"{i}:".encode()) for i in set(ids)}
        crc = zlib.crc32
        h = np.fromiter((crc(w, heads[i]) for i, w in zip(ids, words, strict=True)), np.int64, len(words))
        known = np.fromiter((i is not None for i in ids), bool, len(ids))
        at = np.flatnonzero(known & (h % every == 0))
        new = []
        for k in at.tolist():
            word = words[k].decode()
            gone = int(h[k]) % len(word)
            new.append((word[:gone] + word[gone + 1 :]).encode())
        return at, new

    return slip


def _letter_runs(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of A-Z, a-z and U+00C0 to U+00FF: those are all behind the byte C3."""
    latin = data == 0xC3
    mask = _LETTER[data] | latin
    mask[1:] |= latin[:-1]
    return tb.spans(mask, off)


def count_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT, slip: Slip | None = None) -> DataFrame:
    """(word, n): runs of letters, A-Z lower-cased, of at least ``min_chars`` characters and ``min_count`` occurrences.

    ``slip`` may replace the words of a document, by shorter ones only.
    """
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))

    def count(ids: pa.Array, texts: pa.Array) -> pa.RecordBatch:
        data, off = tb.utf8(texts)
        data = tb.LOWER_ASCII[data]
        starts, ends = _letter_runs(data, off)
        chars = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
        long = chars[ends] - chars[starts] >= min_chars
        starts, ends = starts[long], ends[long]
        if not len(starts):
            return pa.RecordBatch.from_arrays([pa.array([], pa.string()), pa.array([], pa.int64())], ["word", "n"])
        numbers = tb.exact_ids(data, starts, ends)
        _, first = np.unique(numbers, return_index=True)
        raw = data.tobytes()
        words = [raw[s:e] for s, e in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]
        n = np.bincount(numbers)
        more: list[bytes] = []
        more_n = np.zeros(0, np.int64)
        if slip is not None:
            row = np.searchsorted(off, starts, "right") - 1
            pairs, times = np.unique(row * len(words) + numbers, return_counts=True)
            own, word = np.divmod(pairs, len(words))
            named = ids.to_pylist()
            at, more = slip([named[r] for r in own.tolist()], [words[w] for w in word.tolist()])
            np.subtract.at(n, word[at], times[at])
            kept = np.fromiter((len(w.decode()) >= min_chars for w in more), bool, len(more))
            more, more_n = [w for w, k in zip(more, kept, strict=True) if k], times[at][kept]
        n = np.concatenate((n, more_n))
        there = np.flatnonzero(n)
        return pa.RecordBatch.from_arrays([pa.array(words + more, pa.binary()).cast(pa.string()).take(pa.array(there)), pa.array(n[there], pa.int64())], ["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, offsets = tb.utf8(batch.column(1))
            for lo, hi in tb.row_slices(offsets, TEXT_BYTES):
                yield count(batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo))

    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


class Trie:
    """The words of a shard in code-point order. Node 0 is the root; the others come by depth, then in order of words,
    so the children of node v are the nodes from ``first[v]`` to ``first[v + 1]``, by label.

    ``label`` is the character that leads to a node, ``ends`` the number of the word that ends there, or -1.
    """

    def __init__(self, label: np.ndarray, first: np.ndarray, ends: np.ndarray):
        self.label, self.first, self.ends = label, first, ends
        children = np.diff(first)
        parent = np.repeat(np.arange(len(children), dtype=np.int64), children)
        self.keys = (parent << 32) | label[1:]
        # a bit for each label that a child has, modulo 64: what it lacks need not be looked up
        self.bits = np.zeros(len(children), dtype=np.uint64)
        inner = np.flatnonzero(children)
        if len(inner):
            self.bits[inner] = np.bitwise_or.reduceat(np.uint64(1) << (label[1:] & 63).astype(np.uint64), first[inner] - 1)

    @classmethod
    def of(cls, codes: np.ndarray, off: np.ndarray) -> Trie:
        """``codes`` has the code points of all words, ``off`` the places between the words."""
        size = np.diff(off)
        node = np.zeros(len(size), dtype=np.int64)
        alive = np.arange(len(size))
        parents, labels, stops = [], [np.zeros(1, np.uint32)], [np.array([-1], np.int32)]
        depth, n = 0, 1
        while len(alive := alive[size[alive] > depth]):
            above, label = node[alive], codes[off[alive] + depth]
            new = np.ones(len(alive), dtype=bool)
            new[1:] = (above[1:] != above[:-1]) | (label[1:] != label[:-1])
            own = np.cumsum(new) - 1
            stop = np.full(own[-1] + 1, -1, dtype=np.int32)
            last = size[alive] == depth + 1
            stop[own[last]] = alive[last]
            parents.append(above[new])
            labels.append(label[new])
            stops.append(stop)
            node[alive] = n + own
            n, depth = n + len(stop), depth + 1
        parent = np.concatenate(parents) if parents else np.zeros(0, np.int64)
        first = np.searchsorted(parent, np.arange(n + 1)) + 1
        return cls(np.concatenate(labels), first.astype(np.int32), np.concatenate(stops))

    def _follow(self, codes: np.ndarray, word: np.ndarray, at: np.ndarray, node: np.ndarray, found: list) -> None:
        """Automata whose edit is spent: the rest of the word (from place ``at`` of ``codes`` on) has to match."""
        while len(word):
            char = codes[at]
            done = (char == 0) & (self.ends[node] >= 0)
            if done.any():
                found.append((word[done], self.ends[node[done]]))
            may = np.flatnonzero((char != 0) & ((self.bits[node] >> (char & 63).astype(np.uint64)) & np.uint64(1)).astype(bool))
            if not len(may):
                return
            key = (node[may].astype(np.int64) << 32) | char[may]
            place = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[place] == key
            may = may[hit]
            word, at, node = word[may], at[may] + 1, place[hit] + 1

    def neighbours(self, codes: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(word, number of a word here) for every pair that is one edit apart.

        Word k begins at ``begin[k]`` of ``codes``, and two zeros follow it.
        """
        found: list[tuple[np.ndarray, np.ndarray]] = []
        word, node, depth = np.arange(len(begin)), np.zeros(len(begin), dtype=np.int64), 0
        while len(word):
            at = begin[word] + depth
            char = codes[at]
            # without this character; of equal ones in a row, the last
            gone = np.flatnonzero((char != 0) & (codes[at + (char != 0)] != char))
            self._follow(codes, word[gone], at[gone] + 1, node[gone], found)
            size = self.first[node + 1] - self.first[node]
            own = np.repeat(np.arange(len(word)), size)
            child = np.arange(len(own)) - np.repeat(np.cumsum(size) - size, size) + self.first[node[own]]
            same = self.label[child] == char[own]
            path, other, child_other = own[same], own[~same], child[~same]
            # another character in its place, unless the word is at its end; another one before it
            instead = np.flatnonzero(char[other] != 0)
            self._follow(codes, word[other[instead]], at[other[instead]] + 1, child_other[instead], found)
            self._follow(codes, word[other], at[other], child_other, found)
            word, node, depth = word[path], child[same], depth + 1
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate([w for w, _ in found]), np.concatenate([e for _, e in found]).astype(np.int64)


def _codes(words: list[str], pad: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all words, ``pad`` zeros behind each, and the places where words begin (and the end of all)."""
    codes = np.frombuffer(("\0" * pad).join([*words, ""]).encode("utf-32-le"), np.uint32)
    size = np.fromiter(map(len, words), np.int64, len(words)) + pad
    return codes, np.concatenate(([0], np.cumsum(size)))


def shards(words: DataFrame, shard_words: int = SHARD_WORDS, shard_chars: int = SHARD_CHARS) -> DataFrame:
    """(label, first, ends, n, words): the tries of the words (word, n), as bytes; ``words`` are lines."""
    parts = max(1, math.ceil(words.count() / shard_words))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def one(own: list[str], n: list[int]) -> pa.RecordBatch:
            trie = Trie.of(*_codes(own))
            arrays = [trie.label.astype("<u4"), trie.first.astype("<i4"), trie.ends.astype("<i4"), np.array(n, "<i8")]
            return pa.RecordBatch.from_arrays([*[pa.array([a.tobytes()], pa.binary()) for a in arrays], pa.array(["\n".join(own).encode()], pa.binary())], ["label", "first", "ends", "n", "words"])

        own, n, chars = [], [], 0
        for batch in batches:
            for word, times in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if own and (len(own) == shard_words or chars + len(word) > shard_chars):
                    yield one(own, n)
                    own, n, chars = [], [], 0
                own.append(word)
                n.append(times)
                chars += len(word)
        if own:
            yield one(own, n)

    ordered = words.select("word", "n").repartitionByRange(parts, "word").sortWithinPartitions("word")
    return ordered.mapInArrow(build, "label binary, first binary, ends binary, n binary, words binary")


@functools.lru_cache(maxsize=1)
def _loaded(shared) -> list[tuple[Trie, np.ndarray, list[str]]]:
    """The tries of a broadcast, put together once a Python process."""
    return [(Trie(np.frombuffer(label, "<u4"), np.frombuffer(first, "<i4"), np.frombuffer(ends, "<i4")), np.frombuffer(n, "<i8"), words.decode().split("\n")) for label, first, ends, n, words in shared.value]


def _met(words: DataFrame, tries: list[tuple[bytes, ...]], tasks: int) -> DataFrame:
    """(word, n_near, best): for each word with neighbours in a trie, their number and the most frequent of them."""
    shared = words.sparkSession.sparkContext.broadcast(tries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _loaded(shared)
        for batch in batches:
            for lo in range(0, len(batch), BLOCK_WORDS):
                own = batch.column(0).slice(lo, BLOCK_WORDS)
                codes, begin = _codes(own.to_pylist(), 2)
                for trie, n, named in known:
                    word, near = trie.neighbours(codes, begin[:-1])
                    if not len(word):
                        continue
                    by = np.lexsort((near, -n[near], word))
                    word, near = word[by], near[by]
                    first = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
                    best = pa.StructArray.from_arrays([pa.array(-n[near[first]], pa.int64()), pa.array([named[k] for k in near[first].tolist()], pa.string())], ["less", "form"])
                    yield pa.RecordBatch.from_arrays([own.take(pa.array(word[first])), pa.array(np.diff(np.append(first, len(word))), pa.int64()), best], ["word", "n_near", "best"])

    found = words.select("word").repartition(tasks, "word").mapInArrow(run, "word string, n_near long, best struct<less:bigint,form:string>")
    done = settle(found, "near-words")
    shared.unpersist()
    return done


def variants(counted: DataFrame, ratio: int = RATIO, shard_words: int = SHARD_WORDS, round_bytes: int = ROUND_BYTES) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of the words (word, n), each once.

    n_near: words one inserted, deleted or replaced character away; form: the most frequent of them if it has at
    least ``ratio`` times the word's occurrences, form_n its occurrences, else null; root: the end of the chain of forms.
    """
    if ratio < 2:
        raise ValueError("ratio must be 2 or more, so that chains of forms end")
    words = settle(counted, "words")
    n_words, most = words.agg(F.count(F.lit(1)), F.max("n")).first()
    tasks = max(int(words.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(n_words / (16 * TASK_WORDS)))
    tries = settle(shards(words, shard_words).withColumn("shard", F.monotonically_increasing_id()), "tries")
    sizes = tries.select("shard", (F.octet_length("label") + F.octet_length("first") + F.octet_length("ends") + F.octet_length("n") + F.octet_length("words")).alias("size")).orderBy("shard").collect()
    rounds: list[list[int]] = []
    held = 0
    for shard, size in sizes:
        if not rounds or held + size > round_bytes:
            rounds.append([])
            held = 0
        rounds[-1].append(shard)
        held += size
    parts = [_met(words, [tuple(map(bytes, r)) for r in tries.where(F.col("shard").isin(own)).select("label", "first", "ends", "n", "words").collect()], tasks) for own in rounds]
    schema = "word string, n_near long, best struct<less:bigint,form:string>"
    near = functools.reduce(DataFrame.unionByName, parts) if parts else words.sparkSession.createDataFrame([], schema)
    best = near.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min("best").alias("best"))
    form_n = F.when(-F.col("best.less") >= ratio * F.col("n"), -F.col("best.less"))
    formed = settle(words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(form_n.isNotNull(), F.col("best.form")).alias("form"), form_n.alias("form_n")), "forms")
    # a form is ``ratio`` times as frequent as its word: so many steps a chain has at most, and half of them are left each time
    steps = max(1, math.ceil(math.log(max(most or 1, 1), ratio))) + 1
    up = formed.where("form is not null").select("word", F.col("form").alias("root"))
    for _ in range(math.ceil(math.log2(steps))):
        up = settle(up.join(up.select(F.col("word").alias("root"), F.col("root").alias("further")), "root", "left").select("word", F.coalesce("further", "root").alias("root")), "roots")
    return formed.join(up, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
