"""Substring dedup (operator 7) with repeated-phrase automata.

A window is WINDOW consecutive words. A word goes if some window over it also starts in a document of a smaller id.
The work goes in four steps; the first two only nominate, by hashes, and the last two compare words:

1. *Candidates.* Of each window, the least of its ANCHOR-word hashes is its anchor, which two equal windows share.
   Anchors are about a quarter as many as windows. Their 32-bit prints, packed by shard, are shuffled; a print that
   two texts have marks its anchors, and one bit an anchor goes back to the texts.
2. *Passages.* Runs of windows with marked anchors are cut where the least KEY-word hash of the window moves. Each
   piece is a passage of WINDOW words or a few more; equal windows always lie in passages of one key. A key that a
   sample finds to have over CROWDED passages, as of a line that many texts go on from in their own way, is worked
   on by window: each of its windows is a passage, keyed by the hash of all its words, so equal ones still meet.
3. *Confirmed phrases.* Passages meet by key, and word by word: a passage that documents of several ids have, or that
   shares windows with others of its key, is a phrase, with the smallest id that has each of its windows.
4. *Automata.* The phrases are dealt to the texts that they were nominated for. Each slice of texts is a shard: its
   phrases, PHRASES at a time, are compiled into an Aho-Corasick automaton over words, and every open text of the
   slice is streamed through it, whole. Where a phrase occurs, the words of those of its windows go that a smaller id
   has. A nomination by a hash that two passages share occurs nowhere, so it removes nothing.

Copies are combined before every shuffle that could gather them: a passage travels once a task with the smallest id
it was seen with, so a group of copies that holds a third of all rows is not one task's work. Texts are written in
buckets of their rows, so they are shuffled once.

Defined results: a null text has no words; a text or word of any length is read whole; documents with fewer than
WINDOW words lose none; a null id counts as larger than any other, and 2**63 - 1 as null; ids are integers; rows of
one id never take words from each other, however often the id repeats; an empty table gives an empty result; other
columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import textblocks as tb
from tessera.llm.tables import settle

WINDOW = 13
#: Words of the hashes that pick anchors (step 1) and keys (step 2).
ANCHOR, KEY = 8, 5
#: Characters of all texts for each shard of prints, and the least number of shards.
CHARS_PER_SHARD, LEAST_SHARDS = 48_000_000, 8
#: Passages gathered before an automaton is compiled, and phrases that one automaton holds at most.
PASSAGES, PHRASES = 6_000, 40_000
#: Occurrences whose words are marked together, but for those of one text.
HITS = 100_000
#: Distinct passages beyond which a key is divided, estimated from one text in SAMPLE and all of over LONG words.
CROWDED, SAMPLE, LONG = 1_000, 8, 4_000
#: Slots in which crowded keys are remembered, a bit each: what reaches the driver and every task is 1 MB at most.
CROWDED_SLOTS = 1 << 23

_LAST = np.iinfo(np.int64).max


def _least(tokens: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of k words at every word, and for each window the place of the least within it, the first of equals."""
    grams = tb.window_hashes(tokens, k)
    n = len(tokens) - WINDOW + 1
    if n <= 0:
        return grams, np.zeros(0, np.int64)
    best, place = grams[:n].copy(), np.arange(n)
    for j in range(1, WINDOW - k + 1):
        other = grams[j : j + n]
        less = other < best
        np.copyto(best, other, where=less)
        np.copyto(place, np.arange(j, j + n), where=less)
    return grams, place


class _Block:
    """The words of a slice of texts, and the anchor of every window."""

    def __init__(self, texts: pa.Array):
        self.data, self.off = tb.utf8(texts)
        self.starts, self.ends = tb.spans(tb.NOT_SPACE[self.data], self.off)
        self.bounds = np.searchsorted(self.starts, self.off)
        self.tokens = tb.span_hashes(self.data, self.starts, self.ends)
        self.whole = tb.first_windows(self.bounds, WINDOW, len(self.tokens))
        grams, self.anchor_of = _least(self.tokens, ANCHOR)
        self.anchors = np.unique(self.anchor_of[self.whole])
        self.prints = grams[self.anchors]

    def shards(self, n: int) -> np.ndarray:
        return (((self.prints >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)).astype(np.int64)

    def words(self, row: int) -> list[bytes]:
        return self.data[self.off[row] : self.off[row + 1]].tobytes().split()


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(row, id, text): ``row`` and id name a row by its content, id is what decides."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    return docs.select(F.xxhash64(F.col(f"`{id_col}`"), text).alias("row"), F.col(f"`{id_col}`").cast("long").alias("id"), text.alias("text"))


def _packed_prints(rows: DataFrame, shards: int) -> DataFrame:
    """(shard, prints, rows, ids, sizes): the prints of a slice of texts in one shard, text by text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, offsets = tb.utf8(batch.column(2))
            for lo, hi in tb.row_slices(offsets, 8 * tb.BLOCK_BYTES):
                names, ids = (batch.column(k).slice(lo, hi - lo).to_numpy() for k in range(2))
                block = _Block(batch.column(2).slice(lo, hi - lo))
                shard, text = block.shards(shards), np.searchsorted(block.bounds, block.anchors, "right") - 1
                order = np.argsort(shard, kind="stable")
                cuts = np.searchsorted(shard[order], np.arange(shards + 1))
                out: list[tuple[int, bytes, bytes, bytes, bytes]] = []
                for s in np.flatnonzero(np.diff(cuts)):
                    own = order[cuts[s] : cuts[s + 1]]
                    who, sizes = np.unique(text[own], return_counts=True)
                    out.append((int(s), block.prints[own].astype("<u4").tobytes(), names[who].astype("<i8").tobytes(), ids[who].astype("<i8").tobytes(), sizes.astype("<u4").tobytes()))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int32(), *[pa.binary()] * 4), strict=True)], ["shard", "prints", "rows", "ids", "sizes"])

    return rows.select("row", "id", "text").mapInArrow(run, "shard int, prints binary, rows binary, ids binary, sizes binary")


def _marks_of(table: pa.Table) -> pa.Table:
    """(row, id, shard, bits) for the texts of one shard with a print that another text has, one bit a print."""
    join = lambda c, t: np.frombuffer(b"".join(table.column(c).to_pylist()), t)
    prints, rows, ids, sizes = join("prints", "<u4"), join("rows", "<i8"), join("ids", "<i8"), join("sizes", "<u4").astype(np.int64)
    text = np.repeat(np.arange(len(rows), dtype=np.int32), sizes)
    order = np.argsort(prints, kind="stable")
    first = np.flatnonzero(np.concatenate(([True], prints[order][1:] != prints[order][:-1])))
    held = text[order]
    shared = np.minimum.reduceat(held, first) != np.maximum.reduceat(held, first)
    marked = np.zeros(len(prints), dtype=bool)
    marked[order] = np.repeat(shared, np.diff(np.append(first, len(prints))))
    width = (sizes + 7) // 8
    begin = np.cumsum(sizes) - sizes
    place = np.arange(len(prints)) - np.repeat(begin, sizes) + np.repeat((np.cumsum(width) - width) * 8, sizes)
    bits = np.zeros(int(width.sum()) * 8, dtype=bool)
    bits[place] = marked
    offsets = np.concatenate(([0], np.cumsum(width))).astype(np.int32)
    packed = pa.BinaryArray.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(np.packbits(bits))])
    some = np.flatnonzero(np.add.reduceat(marked, begin) > 0)
    shard = pa.array(np.full(len(some), table.column("shard")[0].as_py(), dtype=np.int32))
    return pa.table({"row": pa.array(rows[some]), "id": pa.array(ids[some]), "shard": shard, "bits": packed.take(pa.array(some))})


def _marked_texts(rows: DataFrame, shards: int) -> DataFrame:
    """(row, id, n_words, kept, text, candidates): texts without a marked anchor are done and have no ``candidates``;
    of the others that is one bit a word, set where a candidate window starts."""
    marks = _packed_prints(rows, shards).groupBy("shard").applyInArrow(_marks_of, "row long, id long, shard int, bits binary")
    by_row = marks.groupBy(F.col("row").alias("m_row"), F.col("id").alias("m_id")).agg(F.collect_set(F.struct("shard", "bits")).alias("marks"))
    joined = rows.join(by_row, (F.col("row") == F.col("m_row")) & (F.col("id") == F.col("m_id")), "left").select("row", "id", "text", "marks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, offsets = tb.utf8(batch.column(2))
            for lo, hi in tb.row_slices(offsets, 8 * tb.BLOCK_BYTES):
                part = batch.slice(lo, hi - lo)
                block = _Block(part.column(2))
                shard = block.shards(shards)
                of_text = np.searchsorted(block.anchors, block.bounds)
                marked = np.zeros(len(block.tokens), dtype=bool)
                for r, marks in enumerate(part.column(3).to_pylist()):
                    if marks is None:
                        continue
                    a, b = of_text[r], of_text[r + 1]
                    for m in marks:
                        own = a + np.flatnonzero(shard[a:b] == m["shard"])
                        marked[block.anchors[own]] |= np.unpackbits(np.frombuffer(m["bits"], np.uint8), count=len(own)).view(bool)
                window = np.zeros(len(block.tokens), dtype=bool)
                window[: len(block.whole)] = block.whole & marked[block.anchor_of]
                open_texts = tb.per_row(window, block.bounds) > 0
                cols: dict[str, list] = {"kept": [], "text": [], "candidates": []}
                for r, is_open in enumerate(open_texts):
                    words = b" ".join(block.words(r))
                    cols["kept"].append(None if is_open else words.decode())
                    cols["text"].append(words.decode() if is_open else None)
                    cols["candidates"].append(np.packbits(window[block.bounds[r] : block.bounds[r + 1]]).tobytes() if is_open else None)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(np.diff(block.bounds)), pa.array(cols["kept"], pa.string()), pa.array(cols["text"], pa.string()), pa.array(cols["candidates"], pa.binary())], ["row", "id", "n_words", "kept", "text", "candidates"])

    return joined.mapInArrow(run, "row long, id long, n_words long, kept string, text string, candidates binary")


def _crowded(texts: DataFrame) -> np.ndarray:
    """A bit for each slot of keys, CROWDED_SLOTS of them, that is set if a key of about CROWDED distinct passages or
    more is in it. Other keys of such a slot are divided too, which changes no result."""
    none = np.zeros(CROWDED_SLOTS // 8, np.uint8)
    some = lambda part, weight: _passages(part, none).select("key", F.xxhash64("passage").alias("p"), F.lit(weight).alias("w"))
    seen = some(texts.where(F.col("n_words") > LONG), 1).unionByName(some(texts.where((F.col("n_words") <= LONG) & (F.pmod("row", F.lit(SAMPLE)) == 0)), SAMPLE))
    n = seen.groupBy("key", "p").agg(F.max("w").alias("w")).groupBy("key").agg(F.sum("w").alias("n"))
    slot = n.where(F.col("n") > CROWDED).select(F.col("key").bitwiseAND(F.lit(CROWDED_SLOTS - 1)).alias("slot"))
    words = slot.groupBy(F.expr("slot div 64").alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(slot % 64 as int)))").alias("bits"))
    packed = np.zeros(CROWDED_SLOTS // 64, dtype=np.int64)
    for word, bits in words.collect():  # at most CROWDED_SLOTS / 64 rows
        packed[word] = bits
    return packed.view(np.uint8)


def _passages(texts: DataFrame, crowded: np.ndarray) -> DataFrame:
    """(row, id, at, key, passage): the passages of each text and the word that each starts at; of keys in
    ``crowded`` slots the windows, with keys of their own."""
    shared = texts.sparkSession.sparkContext.broadcast(crowded)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, offsets = tb.utf8(batch.column(2))
            for lo, hi in tb.row_slices(offsets):
                part = batch.slice(lo, hi - lo)
                data, off = tb.utf8(part.column(2))
                starts, ends = tb.spans(tb.NOT_SPACE[data], off)
                bounds = np.searchsorted(starts, off)
                tokens = tb.span_hashes(data, starts, ends)
                grams, place = _least(tokens, KEY)
                window = np.concatenate([np.unpackbits(np.frombuffer(c, np.uint8), count=b - a).view(bool) for c, a, b in zip(part.column(3).to_pylist(), bounds[:-1], bounds[1:], strict=True)])[: len(place)]
                at = np.flatnonzero(window)
                keys = grams[place[at]].view(np.int64)
                slot = keys & (CROWDED_SLOTS - 1)
                divided = (shared.value[slot >> 3] >> (slot & 7)) & 1 == 1
                keys[divided] = tb.window_hashes(tokens, WINDOW)[at[divided]].view(np.int64)
                new = np.flatnonzero(divided | np.concatenate(([True], (np.diff(at) > 1) | (place[at[1:]] != place[at[:-1]]))))
                first, last = at[new], at[np.append(new[1:], len(at)) - 1] + WINDOW - 1
                text = np.searchsorted(bounds, first, "right") - 1
                raw = data.tobytes()
                found = [raw[a:b] for a, b in zip(starts[first].tolist(), ends[last].tolist(), strict=True)]
                pick = pa.array(text)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pick), part.column(1).take(pick), pa.array((first - bounds[text]).astype(np.int32)), pa.array(keys[new]), pa.array(found, pa.binary()).cast(pa.string())], ["row", "id", "at", "key", "passage"])

    return texts.select("row", "id", "text", "candidates").mapInArrow(run, "row long, id long, at int, key long, passage string")


def _automata(phrases: list[tuple[int, ...]]) -> Iterator[tuple[int, ahocorasick.Automaton]]:
    """Automata of PHRASES phrases at most, one after the other, each with the number of its first phrase."""
    for lo in range(0, len(phrases), PHRASES):
        automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
        for n, phrase in enumerate(phrases[lo : lo + PHRASES], lo):
            automaton.add_word(phrase, n)
        automaton.make_automaton()
        yield lo, automaton


def smallest_ids(keys: list[int], passages: list[bytes], ids: list[int]) -> list[np.ndarray]:
    """For each distinct passage, the smallest id that has the window at each of its words.

    The windows of a key's passages are streamed through automata of the same windows; a key with one passage has no
    other to share windows with.
    """
    alone: dict[int, int] = {}
    for k in keys:
        alone[k] = alone.get(k, 0) + 1
    number: dict[bytes, int] = {}
    texts = [() if alone[k] == 1 else tuple(number.setdefault(w, len(number)) for w in p.split(b" ")) for k, p in zip(keys, passages, strict=True)]
    out = [np.full(p.count(b" ") + 2 - WINDOW, i, dtype=np.int64) for p, i in zip(passages, ids, strict=True)]
    phrases = list({t[i : i + WINDOW]: None for t in texts for i in range(len(t) - WINDOW + 1)})
    for _, automaton in _automata(phrases):
        least: dict[int, int] = {}
        hits = [list(automaton.iter(t)) if t else [] for t in texts]
        for s, own in enumerate(hits):
            for _, n in own:
                if ids[s] < least.get(n, _LAST + 1):
                    least[n] = ids[s]
        for s, own in enumerate(hits):
            for end, n in own:
                out[s][end - WINDOW + 1] = least[n]
    return out


def _located(passages: DataFrame) -> DataFrame:
    """(passage_id, passage, least, smallest): each confirmed phrase with the packed smallest ids of its windows."""
    seen = passages.groupBy("key", "passage").agg(F.min("id").alias("lo"), F.max("id").alias("hi"))
    shards = seen.repartition("key").sortWithinPartitions("key").select("key", "passage", "lo", "hi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(part: pa.Table) -> pa.RecordBatch:
            keys, texts, lo, hi = (part.column(k) for k in range(4))
            ids = lo.to_numpy()
            least = smallest_ids(keys.to_pylist(), [p.encode() for p in texts.to_pylist()], ids.tolist())
            several = hi.to_numpy() != ids
            keep = [k for k, m in enumerate(least) if several[k] or (m < ids[k]).any()]
            return pa.RecordBatch.from_arrays([texts.take(pa.array(keep, pa.int64())).combine_chunks(), pa.array([least[k].astype("<i8").tobytes() for k in keep], pa.binary()), pa.array([int(least[k].min()) for k in keep], pa.int64())], ["passage", "least", "smallest"])

        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) < PASSAGES:
                continue
            table = pa.Table.from_batches(held)
            keys = table.column(0).to_numpy()
            at, whole = 0, int(np.searchsorted(keys, keys[-1]))
            while whole - at >= PASSAGES:  # whole keys only
                to = int(np.searchsorted(keys, keys[at + PASSAGES - 1], "right"))
                to = min(to, whole)
                yield done(table.slice(at, to - at))
                at = to
            held = table.slice(at).combine_chunks().to_batches()
        if held:
            yield done(pa.Table.from_batches(held))

    return shards.mapInArrow(run, "passage string, least binary, smallest long").select(F.xxhash64("passage").alias("passage_id"), "*")


def _nominated(passages: DataFrame, located: DataFrame) -> DataFrame:
    """(row, id, phrases): for each text the confirmed phrases that it may have and that a smaller id has."""
    asked = passages.select("row", "id", F.xxhash64("passage").alias("passage_id"))
    found = asked.join(located, "passage_id").where(F.col("smallest") < F.col("id"))
    return found.groupBy("row", "id").agg(F.collect_set(F.struct("passage", "least")).alias("phrases"))


def _cut(texts: list[str], ids: list[int], phrases: list[list[dict] | None]) -> list[np.ndarray]:
    """Which words of each text go: all texts are streamed through the automata of all their phrases."""
    number: dict[str, int] = {}  # from 1; 0 is any word that no phrase has
    known: dict[str, bytes] = {p["passage"]: p["least"] for own in phrases for p in own or ()}
    every = [tuple(number.setdefault(w, len(number) + 1) for w in p.split(" ")) for p in known]
    least = np.frombuffer(b"".join(known.values()), "<i8")
    windows = np.fromiter((len(x) // 8 for x in known.values()), np.int64, len(known))
    first = np.cumsum(windows) - windows
    length = np.fromiter(map(len, every), np.int64, len(every))
    words = [tuple(number.get(w, 0) for w in t.split(" ")) if t else () for t in texts]
    # the texts' words one after the other; a window's end lies at most on the place behind its text's last word
    begin = np.concatenate(([0], np.cumsum([len(w) + 1 for w in words])))
    steps = np.zeros(begin[-1] + 1, dtype=np.int64)
    own_id = np.array(ids, dtype=np.int64)

    def mark(hits: list[tuple[int, int]], text: np.ndarray) -> None:
        end, n = np.array(hits, dtype=np.int64).T
        size = windows[n]
        hit = np.repeat(np.arange(len(n)), size)
        nth = np.arange(len(hit)) - np.repeat(np.cumsum(size) - size, size)
        goes = least[first[n][hit] + nth] < own_id[text][hit]
        at = (begin[text] + end - length[n] + 1)[hit[goes]] + nth[goes]
        np.add.at(steps, at, 1)
        np.subtract.at(steps, at + WINDOW, 1)

    for _, automaton in _automata(every):
        hits: list[tuple[int, int]] = []
        counts: list[tuple[int, int]] = []
        for s, own in enumerate(words):
            before = len(hits)
            hits.extend(automaton.iter(own) if own else ())
            counts.append((s, len(hits) - before))
            if len(hits) > HITS:
                mark(hits, np.repeat(*np.array(counts).T))
                hits, counts = [], []
        if hits:
            mark(hits, np.repeat(*np.array(counts).T))
    covered = np.cumsum(steps) > 0
    return [covered[a : a + len(w)] for a, w in zip(begin.tolist(), words, strict=False)]


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_removed, kept) of every row; ``kept`` is the words that stay, joined by one space."""
    rows = _keyed(docs, id_col, text_col).withColumn("id", F.coalesce("id", F.lit(_LAST)))
    chars = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    shards = int(max(LEAST_SHARDS, chars // CHARS_PER_SHARD))
    texts = settle(_marked_texts(rows, shards), "marked-texts", ["row", "id"])
    open_texts = texts.where("candidates is not null")
    passages = _passages(open_texts, _crowded(open_texts))
    located = settle(_located(passages), "located")
    phrases = _nominated(passages, located).select(F.col("row").alias("p_row"), F.col("id").alias("p_id"), "phrases")
    cut = open_texts.select("row", "id", "n_words", "text").join(phrases, (F.col("row") == F.col("p_row")) & (F.col("id") == F.col("p_id")), "left").select("id", "n_words", "text", "phrases")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, offsets = tb.utf8(batch.column(2))
            for lo, hi in tb.row_slices(offsets, 4 * tb.BLOCK_BYTES):
                part = batch.slice(lo, hi - lo)
                whole = part.column(2).to_pylist()
                removed, kept = [], []
                for text, out in zip(whole, _cut(whole, part.column(0).to_pylist(), part.column(3).to_pylist()), strict=True):
                    removed.append(int(out.sum()))
                    kept.append(" ".join([w for w, gone in zip(text.split(" "), out.tolist(), strict=True) if not gone]) if removed[-1] else text)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], ["id", "n_words", "n_removed", "kept"])

    done = cut.mapInArrow(run, "id long, n_words long, n_removed long, kept string")
    whole = texts.where("candidates is null").select("id", "n_words", F.lit(0).cast("long").alias("n_removed"), "kept")
    return whole.unionByName(done).withColumn("id", F.when(F.col("id") != _LAST, F.col("id")))
