"""Exact top-k search (operator 11): every query row against every candidate row, term at a time.

Rows are sparse: a term is a component's number, its weight the component. A block of candidates is turned into
postings, for each term the candidates that have it and their weights. A block of queries has a dense array of
scores, one for each candidate; term after term, each query that has the term scatters its weight times the postings'
into its array. Partition selection keeps the k best of each array, and Spark merges them over the blocks.

Queries and candidates meet in tiles of a grid: QUERIES by CANDIDATES rows at most, so a task holds a bounded number
of rows whatever the table holds. Each candidate is shuffled once for every QUERIES queries, each query once for every
CANDIDATES candidates, and no side is broadcast. A common vector is no key and lands in as many tiles as any others.
The work is the product of both sides, as it has to be for an exhaustive search; a tile's result is k rows a query.

Scores are exact integers, of as many bits as the largest sum in a tile can need; one beyond 64 bits counts as the
nearest 64-bit integer.

Defined results: rows whose vector is null or holds a null or non-finite component, or one that is not finite when
scaled, take no part, nor do rows without an id; a vector without components scores 0 with all; vectors of different
lengths are multiplied over the components that both have; repeated rows are rows of their own, and a query meets
every row but itself, so it may meet another of its own id; ties go to the smaller id; an empty table, or one without
queries, gives an empty result; other columns, whatever their names, never reach the search.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tessera.llm.tables import settle

#: Most rows of either side in a tile. Candidates are dealt to more blocks than that needs, LEAST rows in each at
#: least, where there would be fewer tiles than the session has partitions.
QUERIES, CANDIDATES, LEAST = 4_096, 32_768, 2_048
#: Scores that one dense array holds at a time.
SCORES = 1 << 18
#: Kinds of integers, and the sums that they hold for sure; Python's hold the rest.
KINDS = ((np.int32, 2.0**30), (np.int64, 2.0**62))


def _sparse(vectors: pa.ChunkedArray, scale: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, term, weight) of the non-zero weights ``floor(scale * x)``."""
    lists = vectors.combine_chunks()
    x = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    size = np.diff(lists.offsets.to_numpy())
    row = np.repeat(np.arange(len(size)), size)
    term = np.arange(len(x)) - np.repeat(np.cumsum(size) - size, size)
    weight = np.floor(scale * x)
    at = np.flatnonzero(weight)
    return row[at], term[at], weight[at]


def _by_term(row: np.ndarray, term: np.ndarray, weight: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    order = np.argsort(term, kind="stable")
    known, first = np.unique(term[order], return_index=True)
    return {int(t): (row[p], weight[p]) for t, p in zip(known, np.split(order, first[1:]), strict=True)} if len(known) else {}


def _whole(weight: np.ndarray, kind: type) -> np.ndarray:
    if kind is not object:
        return weight.astype(kind)
    out = np.empty(len(weight), dtype=object)
    out[:] = [int(w) for w in weight]
    return out


def scores(queries: tuple[np.ndarray, ...], n_queries: int, postings: dict[int, tuple[np.ndarray, np.ndarray]], n: int, kind: type) -> np.ndarray:
    """The dense scores of some queries, (row, term, weight), with n candidates: term at a time, every posting scattered."""
    dense = np.zeros((n_queries, n), dtype=kind)
    for term, (own, weight) in _by_term(*queries).items():
        if term in postings:
            rows, weights = postings[term]
            if len(rows) == n:  # every candidate has the term
                dense[own] += weight[:, None] * weights
            else:
                dense[own[:, None], rows] += weight[:, None] * weights
    return dense


def select(dense: np.ndarray, k: int) -> np.ndarray:
    """Of each row of ``dense`` the places of its k largest values, at least; of equal ones those of the smallest place."""
    n = dense.shape[1]
    if n <= k:
        return np.broadcast_to(np.arange(n), dense.shape)
    least = np.partition(dense, n - k, axis=1)[:, n - k]
    above, level = dense > least[:, None], dense == least[:, None]
    level &= np.cumsum(level, axis=1) <= (k - above.sum(axis=1))[:, None]
    return np.nonzero(above | level)[1].reshape(len(dense), k)


def _tile(queries: pa.Table, candidates: pa.Table, k: int, scale: float) -> pa.Table:
    ids, rows = candidates["id"].to_numpy(), candidates["row"].to_numpy()
    by = np.lexsort((rows, ids))  # of equal scores the smallest id comes first
    candidates, ids, rows = candidates.take(pa.array(by)), ids[by], rows[by]
    own = queries["query_row"].to_numpy()
    q_sparse, c_sparse = _sparse(queries["query"], scale), _sparse(candidates["vector"], scale)
    largest = math.prod(float(np.abs(x[2]).max(initial=0)) for x in (q_sparse, c_sparse)) * (1 + c_sparse[1].max(initial=0))
    kind = next((kind for kind, most in KINDS if largest < most), object)
    postings = _by_term(c_sparse[0], c_sparse[1], _whole(c_sparse[2], kind))
    weights = _whole(q_sparse[2], kind)
    bounds = np.searchsorted(q_sparse[0], np.arange(len(own) + 1))
    step = max(1, SCORES // max(1, len(ids)))
    found = []
    for lo in range(0, len(own), step):
        hi = min(lo + step, len(own))
        part = slice(bounds[lo], bounds[hi])
        dense = scores((q_sparse[0][part] - lo, q_sparse[1][part], weights[part]), hi - lo, postings, len(ids), kind)
        if kind is object:
            dense = np.clip(dense, -(2**63), 2**63 - 1).astype(np.int64)
        places = select(dense, k + 1)  # one more than k, since the query itself may be among them
        query = np.repeat(np.arange(lo, hi), places.shape[1])
        places = places.ravel()
        other = rows[places] != own[query]
        found.append((query[other], places[other], dense[query - lo, places][other].astype(np.int64)))
    query, places, value = (np.concatenate([x[c] for x in found]) for c in range(3))
    return pa.table({"query_row": own[query], "query_id": queries["query_id"].to_numpy()[query], "vec_id": ids[places], "score": value})


def search(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 256.0, queries: int = QUERIES, candidates: int = CANDIDATES) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best rows for each row that ``is_query`` holds for, itself left out."""
    vector = F.col(f"`{vector_col}`").cast("array<double>")
    usable = F.forall(vector, lambda x: F.coalesce(~F.isnan(x * scale) & (F.abs(x * scale) < float("inf")), F.lit(False)))
    rows = vectors.where(F.col(f"`{id_col}`").isNotNull() & F.coalesce(usable, F.lit(False)))
    kept = rows.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{id_col}`").alias("id"), F.col(f"`{vector_col}`").alias("vector"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    table = settle(kept, "vectors")
    n, asking = table.agg(F.count(F.lit(1)), F.count_if("asks")).first()
    tasks = int(table.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    high = max(1, math.ceil(asking / queries))
    wide = max(1, math.ceil(n / candidates), min(math.ceil(tasks / high), math.ceil(n / LEAST)))
    place = lambda parts, salt: F.pmod(F.xxhash64("row", F.lit(salt)), F.lit(parts))
    every = lambda parts: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long")))
    left = table.where("asks").select(F.col("row").alias("query_row"), F.col("id").alias("query_id"), F.col("vector").alias("query"), place(high, 1).alias("i"), every(wide).alias("j"))
    right = table.select("row", "id", "vector", place(wide, 2).alias("j"), every(high).alias("i"))
    key = table.schema["id"].dataType.simpleString()
    tiles = left.groupBy("i", "j").cogroup(right.groupBy("i", "j"))

    schema = pa.schema([("query_row", pa.int64()), ("query_id", ids := to_arrow_type(table.schema["id"].dataType)), ("vec_id", ids), ("score", pa.int64())])

    def meet(q: pa.Table, c: pa.Table) -> pa.Table:
        return _tile(q, c, k, scale).cast(schema) if len(q) and len(c) else schema.empty_table()

    best = tiles.applyInArrow(meet, f"query_row long, query_id {key}, vec_id {key}, score long")
    ranked = Window.partitionBy("query_row").orderBy(F.col("score").desc(), "vec_id")
    return best.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
