"""SimHash near-duplicates (operator 8) with BK-trees over sharded fingerprints.

A fingerprint has 64 bits; a bit is 1 if more than half of the text's shingle hashes have it. Fingerprints within
RADIUS bits link, and linked texts form components.

Search is over distinct fingerprints. Four blocks of 16 bits and, in the 48 bits that are left, four blocks of 12
give 16 keys of 28 bits. Two fingerprints that differ in three bits at most share one of these keys: some block is
untouched, and of the rest some smaller block is too. So each key is a shard, and a BK-tree of each shard, children
keyed by their distance to the parent, is searched along the edges within the radius only. A tree is built where its
shard's rows meet; a broadcast of all trees would grow with the corpus. A shard gives the links of a spanning forest,
not all its pairs, and components over all shards follow by star contraction.

Defined results: a null or empty text has no word and the fingerprint zero; a text of fewer words than a shingle has
one shingle of all its words; a text of any length is read whole; repeated rows each give a row; ids that are null
never name a component unless it has no other; an empty table gives an empty result; other columns, whatever their
names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from tessera.llm import textblocks as tb
from tessera.llm.graphs import connected_components
from tessera.llm.tables import settle

SHINGLE, SEED, RADIUS = 3, 42, 3
#: Shingles whose bits are counted at once, and the size of a shard from which whole arrays beat single steps.
_CHUNK, _MANY = 1 << 15, 24
#: Rows to drop that are still broadcast (16 bytes each).
FEW = 250_000


def fingerprint_array(texts: pa.Array, k: int = SHINGLE) -> np.ndarray:
    """The fingerprints of all texts, as signed 64-bit integers."""
    data, off = tb.utf8(texts)
    n = len(off) - 1
    data = tb.LOWER_ASCII[data]
    starts, ends = tb.spans(tb.NOT_SPACE[data], off)
    bounds = np.searchsorted(starts, off)
    # words joined by one space: each word's bytes and one byte after it, unless its text ends there
    keep = tb.NOT_SPACE[data]
    after = ends[ends < len(data)]
    keep[after[~np.isin(after, off)]] = True
    place = np.concatenate(([0], np.cumsum(keep)))
    joined = data[keep]
    joined[~tb.NOT_SPACE[joined]] = 0x20
    joined = joined.tobytes()
    words = np.diff(bounds)
    shingles = np.where(words >= k, words - k + 1, np.minimum(words, 1))
    row = np.repeat(np.arange(n), shingles)
    first = np.arange(len(row)) - np.repeat(np.cumsum(shingles) - shingles, shingles) + bounds[:-1][row]
    last = np.minimum(first + k, bounds[1:][row]) - 1
    lo, hi = place[starts[first]].tolist(), place[ends[last]].tolist()
    counts = np.zeros((n, 64), dtype=np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, len(row), _CHUNK):
        own = row[at : at + _CHUNK]
        hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(lo[at : at + _CHUNK], hi[at : at + _CHUNK], strict=True)], dtype="<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        begin = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
        counts[own[begin]] += np.add.reduceat(bits, begin, axis=0, dtype=np.int32)
    ones = 2 * counts > shingles[:, None]
    return np.packbits(ones, axis=1, bitorder="little").view("<i8").ravel()


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: Column | None = None) -> DataFrame:
    """(id, fp) of every row; ``id`` is ``keep`` where that is given."""

    def fn(ids: pa.Array, texts: pa.Array) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([ids, pa.array(fingerprint_array(texts))], ["id", "fp"])

    key = keep if keep is not None else F.col(f"`{id_col}`")
    kind = docs.select(key.alias("k")).schema["k"].dataType.simpleString()
    return tb.map_texts(docs, text_col, key, fn, f"id {kind}, fp long")


def shard_keys(fp: Column) -> Column:
    """The 16 shards of a fingerprint: any two within RADIUS bits share one of them."""
    keys = []
    for b in range(4):
        block = F.shiftrightunsigned(fp, 16 * b).bitwiseAND(F.lit(0xFFFF))
        low = fp.bitwiseAND(F.lit((1 << 16 * b) - 1))
        high = F.shiftleft(F.shiftrightunsigned(F.shiftrightunsigned(fp, 16 * b), 16), 16 * b)
        rest = low.bitwiseOR(high)
        for c in range(4):
            part = F.shiftrightunsigned(rest, 12 * c).bitwiseAND(F.lit(0xFFF))
            keys.append(F.lit((4 * b + c) << 28).bitwiseOR(F.shiftleft(block, 12)).bitwiseOR(part))
    return F.array(*keys)


class _Forest:
    """Union-find over the members of one shard."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def root(self, i: int) -> int:
        while (j := self.up[i]) != i:
            self.up[i] = i = self.up[j]
        return int(i)

    def join(self, members: list[int] | np.ndarray) -> None:
        roots = {self.root(int(i)) for i in members}
        least = min(roots)
        for r in roots:
            self.up[r] = least

    def join_many(self, members: np.ndarray) -> None:
        roots = self.up[members]
        while (deeper := self.up[roots] != roots).any():
            roots = np.where(deeper, self.up[roots], roots)
        self.up[roots] = self.up[members] = roots.min()

    def labels(self) -> np.ndarray:
        while (up := self.up[self.up]).tolist() != self.up.tolist():
            self.up = up
        return self.up


def _tree_few(fps: list[int], radius: int, forest: _Forest) -> None:
    """Inserts one fingerprint after the other into a BK-tree, and joins it with those found within the radius."""
    children: list[dict[int, int]] = [{}]
    for i in range(1, len(fps)):
        stack, near, own = [0], [i], fps[i]
        while stack:
            j = stack.pop()
            d = (own ^ fps[j]).bit_count()
            if d <= radius:
                near.append(j)
            stack += [c for edge, c in children[j].items() if d - radius <= edge <= d + radius]
        if len(near) > 1:
            forest.join(near)
        at = 0
        while (d := (own ^ fps[at]).bit_count()) in children[at]:
            at = children[at][d]
        children[at][d] = i
        children.append({})


def _tree_many(fps: np.ndarray, radius: int, forest: _Forest) -> None:
    """The same tree, built and searched by whole arrays: each node meets all queries that come its way at once.

    A branch whose nodes and queries are already one component is not followed, since it can join nothing.
    """
    stack = [(np.arange(len(fps)), np.arange(len(fps)))]
    while stack:
        nodes, asked = stack.pop()
        d_nodes = np.bitwise_count(fps[nodes[1:]] ^ fps[nodes[0]])
        d_asked = np.bitwise_count(fps[asked] ^ fps[nodes[0]])
        near = asked[d_asked <= radius]
        if len(near):
            forest.join_many(np.append(near, nodes[0]))
        for edge in np.unique(d_nodes):
            below = nodes[1:][d_nodes == edge]
            going = asked[(d_asked + radius >= edge) & (d_asked <= edge + radius)]
            if len(going):
                both = forest.up[np.append(below, going)]
                if (both != both[0]).any():
                    stack.append((below, going))


def tree_links(fps: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """For each of the distinct fingerprints of a shard (unsigned), the position of its component's first member."""
    forest = _Forest(len(fps))
    if len(fps) < _MANY:
        _tree_few(fps.tolist(), radius, forest)
    else:
        _tree_many(fps, radius, forest)
    return forest.labels()


def links(distinct: DataFrame) -> DataFrame:
    """(a, b): a spanning forest of the links among the distinct fingerprints in column ``fp``."""
    keyed = distinct.select("fp", F.explode(shard_keys(F.col("fp"))).alias("key"))
    shards = keyed.repartition("key").sortWithinPartitions("key", "fp").select("key", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept_key, kept_fp = np.zeros(0, np.int64), np.zeros(0, np.uint64)

        def done(keys: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
            a, b = [], []
            begin = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
            end = np.append(begin[1:], len(keys))
            for lo, hi in zip(begin[end - begin > 1], end[end - begin > 1], strict=True):
                own = fps[lo:hi]
                first = tree_links(own)
                linked = np.flatnonzero(first != np.arange(len(own)))
                a.append(own[linked])
                b.append(own[first[linked]])
            flat = [pa.array((np.concatenate(x) if x else np.zeros(0, np.uint64)).view(np.int64)) for x in (a, b)]
            return pa.RecordBatch.from_arrays(flat, ["a", "b"])

        for batch in batches:
            keys = np.append(kept_key, batch.column(0).to_numpy())
            fps = np.append(kept_fp, batch.column(1).to_numpy().view(np.uint64))
            whole = int(np.searchsorted(keys, keys[-1])) if len(keys) else 0
            if whole:
                yield done(keys[:whole], fps[:whole])
            kept_key, kept_fp = keys[whole:], fps[whole:]
        if len(kept_key):
            yield done(kept_key, kept_fp)

    return shards.mapInArrow(run, "a long, b long").distinct()


def components(marks: DataFrame) -> DataFrame:
    """(fp, root, first_id) for the distinct fingerprints of ``marks`` (id, fp): component and its smallest id."""
    distinct = settle(marks.groupBy("fp").agg(F.min("id").alias("own_id")), "fingerprints")
    found = settle(connected_components(links(distinct.select("fp"))), "components")
    placed = distinct.join(found, distinct["fp"] == found["node"], "left").select("fp", F.coalesce("root", "fp").alias("root"), "own_id", F.col("root").isNotNull().alias("linked"))
    least = placed.where("linked").groupBy("root").agg(F.min("own_id").alias("least"))
    return placed.join(least, "root", "left").select("fp", "root", F.when(F.col("linked"), F.col("least")).otherwise(F.col("own_id")).alias("first_id"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp, root, first_id) of every row: its fingerprint, its component, and the component's smallest id."""
    marks = settle(fingerprints(docs, id_col, text_col), "marks")
    return marks.join(components(marks), "fp")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each component: that of the smallest id (null last), then the smallest row hash.

    What is decided over fingerprints and 128-bit row hashes is the rows to drop, and which repeated rows stay once.
    Up to FEW of these go to every task and the texts stay where they are; more of them are joined by shuffle.
    """
    maps = {f.name for f in docs.schema.fields if isinstance(f.dataType, MapType)}  # which have no hash of their own
    plain = [F.to_json(F.col(f"`{c}`")) if c in maps else F.col(f"`{c}`") for c in docs.columns]
    row = F.struct(F.xxhash64(*plain).alias("a"), F.xxhash64(F.lit("second"), *plain).alias("b"))
    name = F.struct(F.col(f"`{id_col}`").isNull().alias("none"), F.col(f"`{id_col}`").alias("id"), row.alias("row"))
    marks = settle(fingerprints(docs, id_col, text_col, name), "marks")
    placed = marks.join(components(marks.select(F.col("id.id").alias("id"), "fp")).select("fp", "root"), "fp")
    stay = placed.groupBy("root").agg(F.min("id").alias("id")).select("id.row.a", "id.row.b", F.lit(True).alias("stays"))
    rows = marks.groupBy(F.col("id.row.a").alias("a"), F.col("id.row.b").alias("b")).agg((F.count(F.lit(1)) > 1).alias("again"))
    special = settle(rows.join(stay, ["a", "b"], "left").where("stays is null or again").select("a", "b", F.col("stays").isNotNull().alias("once")), "dropped-rows")
    held = special if special.count() > FEW else F.broadcast(special)
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), row.alias("key"))
    same = (F.col("key.a") == F.col("a")) & (F.col("key.b") == F.col("b"))
    whole = keyed.join(held.select("a", "b"), same, "left_anti").select("row.*")
    once = keyed.join(held.where("once"), same).groupBy("a", "b").agg(F.first("row").alias("row")).select("row.*")
    return whole.unionByName(once)
