"""Nearest vectors of many queries at once: exactly, in tiles, and through a stored inverted-file index.

Both meet queries and rows in groups, each cut into tiles of a bounded number of rows on either side, so a group that
holds most rows is many tasks' work and a task holds a tile. Exact search has one group. The index has one for each
cell: centres come from k-means over a bounded sample, every row is stored with the cell of its nearest centre, and a
query meets the rows of the cells whose centres are nearest to it. Distances are exact in both, so the index can miss
a neighbour but never misplace one. How many cells a query has to look at for a wanted recall is measured when the
index is built, on a sample of queries against all rows, and stored with it.

The index is a snapshot log (:mod:`tessera.snapshots`): building or adding is one commit. Cells lie in folders, so a
search reads those it needs. Vectors of another length than the index's, null ones and those with a null take no part.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tessera.snapshots import SnapshotLog, Writer

#: Most rows of a tile: queries, and what they are compared with. Distances that a task holds at a time.
QUERIES, ROWS, DISTANCES = 4_096, 32_768, 1 << 19
#: Rows that centres are fitted on, most centres, and folders that cells are dealt to; all at most.
SAMPLE, CELLS, FOLDERS = 50_000, 16_384, 1_024
#: Queries that the number of cells is measured on, and the share of their nearest rows that has to be found.
MEASURED, RECALL, NEAREST = 100, 0.95, 20
#: Rows of a file.
FILE_ROWS = 1 << 20
_STREAM = "vectors"


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    lists = column.combine_chunks()
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(lists), -1)


def _best(queries: pa.Table, rows: pa.Table, k: int) -> pa.Table:
    """The k nearest rows of each query in a tile. Squares are summed in the order of the components, as
    ``search.squared_l2`` does, so that distances are the same to the last bit."""
    rows = rows.take(pa.array(np.argsort(rows["id"].to_numpy(), kind="stable")))  # of equal distances the smallest id
    asked, held = _matrix(queries["query"]), np.ascontiguousarray(_matrix(rows["vector"]).T)
    n = held.shape[1]
    own, at, found = [], [], []
    step = max(1, DISTANCES // n)
    for lo in range(0, len(asked), step):
        part = asked[lo : lo + step]
        dense = np.zeros((len(part), n))
        for d, component in enumerate(held):
            gap = component - part[:, d, None]
            gap *= gap
            dense += gap
        if n > k:
            least = np.partition(dense, k - 1, axis=1)[:, k - 1]
            below, level = dense < least[:, None], dense == least[:, None]
            level &= np.cumsum(level, axis=1) <= (k - below.sum(axis=1))[:, None]
            place = np.nonzero(below | level)[1]
        else:
            place = np.tile(np.arange(n), len(part))
        query = np.repeat(np.arange(len(part)), min(n, k))
        own.append(query + lo)
        at.append(place)
        found.append(dense[query, place])
    own, at = pa.array(np.concatenate(own)), pa.array(np.concatenate(at))
    return pa.table({"query_id": queries["query_id"].take(own), "id": rows["id"].take(at), "distance": np.concatenate(found)})


def grouped_nearest(queries: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, id, distance): of each query (query_id, query, cell) the k nearest of the rows (id, vector,
    cell) of its cells; a query may come once for each of several cells. Ties go to the smaller id."""
    asked = queries.groupBy("cell").agg(F.count(F.lit(1)).alias("n_queries"))
    held = rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n_rows"))
    # one row a cell; how many tiles a cell is cut into
    grid = asked.join(held, "cell").select("cell", F.ceil(F.col("n_queries") / QUERIES).alias("high"), F.ceil(F.col("n_rows") / ROWS).alias("wide"))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    left = queries.join(grid, "cell").select("query_id", "query", "cell", F.pmod(F.xxhash64("query_id", F.lit(1)), "high").alias("i"), every(F.col("wide")).alias("j"))
    right = rows.join(grid, "cell").select("id", "vector", F.col("cell").alias("own_cell"), every(F.col("high")).alias("own_i"), F.pmod(F.xxhash64("id", F.lit(2)), "wide").alias("own_j"))
    kinds = [queries.schema["query_id"].dataType, rows.schema["id"].dataType]
    schema = pa.schema([("query_id", to_arrow_type(kinds[0])), ("id", to_arrow_type(kinds[1])), ("distance", pa.float64())])

    def meet(q: pa.Table, r: pa.Table) -> pa.Table:
        return _best(q, r, k).cast(schema) if len(q) and len(r) else schema.empty_table()

    met = left.groupBy("cell", "i", "j").cogroup(right.groupBy("own_cell", "own_i", "own_j"))
    best = met.applyInArrow(meet, f"query_id {kinds[0].simpleString()}, id {kinds[1].simpleString()}, distance double")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "id"))
    return best.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "id", "distance")


def _usable(vectors: DataFrame, id_col: str, vector_col: str, dim: int) -> DataFrame:
    """(id, vector) of the vectors of ``dim`` components, none of them null."""
    vector = F.col(vector_col)
    return vectors.where((F.size(vector) == dim) & ~F.exists(vector, F.isnull) & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), vector.cast("array<double>").alias("vector"))


def exact_nearest(queries: DataFrame, vectors: DataFrame, id_col: str, vector_col: str, k: int = NEAREST) -> DataFrame:
    """(query_id, rank, id, distance): the k nearest vectors of each query, itself among them. Both tables have the
    same columns; the length of vectors is that of the first usable query."""
    first = queries.where(F.size(vector_col) > 0).select(F.size(vector_col)).first()
    dim = first[0] if first else 0
    asked = _usable(queries, id_col, vector_col, dim).select(F.col("id").alias("query_id"), F.col("vector").alias("query"), F.lit(0).alias("cell"))
    return grouped_nearest(asked, _usable(vectors, id_col, vector_col, dim).withColumn("cell", F.lit(0)), k)


def _centres(rows: DataFrame, n: int, cells: int, seed: int) -> np.ndarray:
    """Centres of ``cells`` cells, fitted on at most about SAMPLE rows, those of the smallest hashes."""
    part = rows.where(F.xxhash64("id") < int(-(2**63) + 2**64 * (SAMPLE / n))) if n > SAMPLE else rows
    features = part.select(array_to_vector("vector").alias("features")).repartition(max(1, math.ceil(min(n, SAMPLE) / 4096))).persist()
    try:
        return np.array(KMeans(k=cells, seed=seed, maxIter=10, initSteps=2).fit(features).clusterCenters())
    finally:
        features.unpersist()


def _nearest_cells(table: DataFrame, vector: str, centres: np.ndarray, probes: int) -> DataFrame:
    """``table`` with ``cells``: the ``probes`` cells of the nearest centres of each row, nearest first."""
    shared = table.sparkSession.sparkContext.broadcast(centres)
    n = min(probes, len(centres))

    def run(batches):
        known = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            own = _matrix(pa.chunked_array([batch.column(vector)]))
            cells = np.empty((len(own), n), dtype=np.int32)
            for lo in range(0, len(own), 1024):
                gaps = (known**2).sum(axis=1) - 2 * own[lo : lo + 1024] @ known.T
                cells[lo : lo + 1024] = np.argsort(gaps, axis=1, kind="stable")[:, :n] if n > 1 else np.argmin(np.where(np.isnan(gaps), np.inf, gaps), axis=1)[:, None]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(pa.array(np.arange(0, cells.size + 1, n), pa.int32()), pa.array(cells.ravel()))], [*batch.schema.names, "cells"])

    return table.mapInArrow(run, ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in table.schema] + ["cells array<int>"]))


def _stage(writer: Writer, rows: DataFrame, centres: np.ndarray, n: int) -> Writer:
    """Rows by cell: in folders of neighbouring numbers, sorted by cell within a file, and a large folder in many."""
    per = math.ceil(len(centres) / FOLDERS)
    placed = _nearest_cells(rows, "vector", centres, 1).select("id", "vector", F.col("cells")[0].alias("cell"))
    salts = max(1, math.ceil(n / FILE_ROWS))
    dealt = placed.withColumns({"folder": F.expr(f"cell div {per}").cast("int"), "salt": F.pmod(F.xxhash64("id"), F.lit(salts))}).repartition("folder", "salt")
    return writer.append("rows", dealt.drop("salt").sortWithinPartitions("folder", "cell"), ("folder",))


def build(vectors: DataFrame, id_col: str, vector_col: str, path: str, cells: int | None = None, recall: float = RECALL, seed: int = 7) -> int:
    """Builds the index below ``path`` and gives the number of cells that a query looks at.

    There are about as many cells as the square root of the rows, CELLS at most.
    """
    spark = vectors.sparkSession
    log = SnapshotLog(spark, path)
    if log.latest() is not None:
        raise ValueError(f"there is an index at {path}")
    first = vectors.where(F.size(vector_col) > 0).select(F.size(vector_col)).first()
    if first is None:
        raise ValueError("an index needs a vector")
    rows = _usable(vectors, id_col, vector_col, first[0])
    n = rows.count()
    centres = _centres(rows, n, max(2, min(CELLS, cells or math.isqrt(n), n)), seed) if n > 1 else np.array([rows.first()["vector"]])
    writer = _stage(log.begin(), rows, centres, n)
    stored = writer.staged("rows")
    sample = stored.where(F.xxhash64("id", F.lit(seed)) < int(-(2**63) + 2**64 * min(0.999, MEASURED / n))).select("id", "vector")
    probes = _measured(sample, stored, centres, recall)
    made = spark.createDataFrame([(k, c.tolist(), probes) for k, c in enumerate(centres)], "cell int, centre array<double>, probes int")
    writer.append("centres", made.coalesce(1)).commit(_STREAM, 0)
    return probes


def _measured(sample: DataFrame, stored: DataFrame, centres: np.ndarray, recall: float) -> int:
    """The least number of cells in which the sample finds that share of its nearest rows (some MEASURED queries)."""
    asked = sample.select(F.col("id").alias("query_id"), F.col("vector").alias("query"))
    nearest = grouped_nearest(asked.withColumn("cell", F.lit(0)), stored.select("id", "vector", F.lit(0).alias("cell")), NEAREST)
    of = nearest.join(stored.select("id", "cell"), "id").select("query_id", "cell")
    ranked = _nearest_cells(asked, "query", centres, len(centres)).select("query_id", F.posexplode("cells").alias("place", "cell"))
    places = np.sort([r[0] for r in of.join(ranked, ["query_id", "cell"]).select("place").collect()])  # MEASURED x NEAREST
    return 1 + int(places[math.ceil(recall * len(places)) - 1]) if len(places) else 1


def add(vectors: DataFrame, id_col: str, vector_col: str, path: str, batch: int) -> int:
    """Adds rows of new ids as batch ``batch`` (from 1) to an index and gives the snapshot's number."""
    log = SnapshotLog(vectors.sparkSession, path)
    manifest = log.manifest()
    if log.committed(_STREAM, batch, manifest):
        return manifest["number"]
    centres, _ = _stored(log, manifest)
    rows = _usable(vectors, id_col, vector_col, centres.shape[1])
    return _stage(Writer(log, manifest), rows, centres, rows.count()).commit(_STREAM, batch)


def _stored(log: SnapshotLog, manifest: dict) -> tuple[np.ndarray, int]:
    rows = log.read("centres", manifest=manifest).orderBy("cell").collect()  # CELLS at most
    return np.array([r["centre"] for r in rows]), rows[0]["probes"]


def nearest(spark: SparkSession, path: str, queries: DataFrame, id_col: str, vector_col: str, k: int = NEAREST, probes: int | None = None) -> DataFrame:
    """(query_id, rank, id, distance) for each query: the k nearest rows of the ``probes`` cells nearest to it, as many
    as were measured unless told otherwise."""
    log = SnapshotLog(spark, path)
    manifest = log.manifest()
    centres, measured = _stored(log, manifest)
    asked = _usable(queries, id_col, vector_col, centres.shape[1]).select(F.col("id").alias("query_id"), F.col("vector").alias("query"))
    exploded = _nearest_cells(asked, "query", centres, probes or measured).select("query_id", "query", F.explode("cells").alias("cell"))
    wanted = [r["cell"] for r in exploded.select("cell").distinct().collect()]  # CELLS at most
    per = math.ceil(len(centres) / FOLDERS)
    rows = log.read("rows", manifest=manifest)
    if len(wanted) < len(centres):
        rows = rows.where(F.col("folder").isin(*sorted({c // per for c in wanted})) & F.col("cell").isin(*sorted(wanted)) if wanted else F.lit(False))
    return grouped_nearest(exploded, rows.select("id", "vector", "cell"), k)
