"""A stored graph whose edges follow the files that change, whichever side of an edge changed.

:func:`references` puts calls, inheritance and imports into one form: a symbol that names another. References are
stored whether or not they resolve, in buckets of the name, and so are nodes. When a batch of files changes, three
joins by name give the new edges: its references with all nodes, its nodes with the references of files that did not
change, so that links into a changed file are made anew, and both with each other. A batch reads the buckets of the
names that it holds and no others.

Nothing is rewritten. Every row carries the version of the file it came from, an edge those of both its files, and
the newest version of each file says which rows count. A reference that found nothing stays stored and is met by the
batch that brings its name. All tables of a batch are published by one commit (:mod:`tessera.snapshots`), so a batch
that dies half-way changes nothing, and one that is tried again after its commit is passed over. After any order of
batches the edges are those that ``resolve.resolve`` gives for all files as they are.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from tessera.operators import resolve
from tessera.operators.merge import newest
from tessera.schema import edge_id
from tessera.snapshots import SnapshotLog, Writer

REFERENCES = "file_path string, repository_id string, source_id string, kind string, confidence double, name string, target_paths array<string>"
#: Folders that names are dealt to.
BUCKETS = 64
_STREAM = "changes"
_FILE = ["repository_id", "file_path"]


def references(nodes: DataFrame, calls: DataFrame, imports: DataFrame, parents: DataFrame) -> DataFrame:
    """REFERENCES of the given files; all arguments as for ``resolve.resolve``, and of the same files.

    ``target_paths`` is null where any symbol of the name is meant.
    """
    of = nodes.select(F.col("id").alias("source_id"), "file_path")
    anywhere = F.lit(None).cast("array<string>").alias("target_paths")
    own = ["file_path", "repository_id", "source_id", "kind", "confidence", "name", "target_paths"]
    called = calls.select(F.col("caller_id").alias("source_id"), "repository_id", F.lit("calls").alias("kind"), F.lit(0.9).alias("confidence"), F.col("callee_name").alias("name"), anywhere).join(of, "source_id")
    inherited = parents.select(F.col("child_id").alias("source_id"), "repository_id", "kind", F.lit(1.0).alias("confidence"), F.col("parent_name").alias("name"), anywhere).join(of, "source_id")
    relative = imports.where(F.col("source").startswith("."))
    imported = relative.select("file_path", "repository_id", F.lit("imports").alias("kind"), F.lit(1.0).alias("confidence"), F.col("imported").alias("name"), resolve.target_paths(F.col("file_path"), F.col("source")).alias("target_paths")).join(resolve.first_symbols(nodes), ["file_path", "repository_id"])
    return called.select(*own).unionByName(inherited.select(*own)).unionByName(imported.select(*own)).distinct()


def link(refs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges of references and nodes, with both files and their versions (column ``version`` of either)."""
    named = nodes.select(F.col("id").alias("target_id"), "name", "repository_id", F.col("file_path").alias("target_file"), F.col("version").alias("target_version"))
    both = refs.withColumnsRenamed({"file_path": "source_file", "version": "source_version"}).join(named, ["name", "repository_id"])
    meant = F.col("target_paths").isNull() | (F.arrays_overlap("target_paths", resolve.names_of_path(F.col("target_file"))) & (F.col("source_file") != F.col("target_file")))
    made = both.where(meant).withColumn("id", edge_id(F.col("source_id"), F.col("target_id"), F.col("kind")))
    return made.select("id", "source_id", "target_id", "kind", "confidence", "repository_id", "source_file", "source_version", "target_file", "target_version").distinct()


def _bucketed(rows: DataFrame, version: int) -> DataFrame:
    return rows.withColumns({"version": F.lit(version), "bucket": F.pmod(F.xxhash64("name"), F.lit(BUCKETS)).cast("int")})


def stored(log: SnapshotLog, manifest: dict, table: str, names: DataFrame) -> DataFrame | None:
    """The stored rows of a table in the buckets of ``names`` (bucket)."""
    rows = log.read(table, manifest=manifest)
    if rows is None:
        return None
    buckets = [r["bucket"] for r in names.select("bucket").distinct().collect()]  # BUCKETS at most
    return rows.where(F.col("bucket").isin(*buckets)) if buckets else rows.where(F.lit(False))


def _versions(log: SnapshotLog, manifest: dict) -> DataFrame | None:
    """(repository_id, file_path, version): the newest of each file."""
    files = log.read("files", manifest=manifest)
    return None if files is None else files.groupBy(*_FILE).agg(F.max("version").alias("version"))


def apply(spark: SparkSession, root: str, batch: int, files: DataFrame, nodes: DataFrame, refs: DataFrame) -> int:
    """Takes in a batch and gives the number of the snapshot that has it; numbers of batches must grow.

    ``files`` (repository_id, file_path) are all files that were added, changed or removed; ``nodes`` and ``refs``
    hold what those have now, so nothing of the removed ones.
    """
    log = SnapshotLog(spark, root)
    manifest = log.manifest()
    if log.committed(_STREAM, batch, manifest):
        return manifest["number"]
    touched = files.select(*_FILE).distinct()
    # one batch at a time: what this one links to must not change before it is published
    writer = Writer(log, manifest).requires("files")
    writer.append("files", touched.withColumn("version", F.lit(batch)))
    writer.append("nodes", _bucketed(nodes, batch).repartition("bucket"), ("bucket",))
    writer.append("refs", _bucketed(refs, batch).repartition("bucket"), ("bucket",))
    new_nodes, new_refs = writer.staged("nodes"), writer.staged("refs")
    edges = link(new_refs.drop("bucket"), new_nodes)
    known = _versions(log, manifest)
    if known is not None:
        unchanged = known.join(touched, _FILE, "left_anti")
        old_nodes = stored(log, manifest, "nodes", new_refs).join(unchanged, [*_FILE, "version"], "left_semi")
        old_refs = stored(log, manifest, "refs", new_nodes).join(unchanged, [*_FILE, "version"], "left_semi")
        edges = edges.unionByName(link(new_refs.drop("bucket"), old_nodes)).unionByName(link(old_refs.drop("bucket"), new_nodes))
    return writer.append("edges", edges).commit(_STREAM, batch)


def current(spark: SparkSession, root: str, number: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of a snapshot, the last one unless told otherwise."""
    log = SnapshotLog(spark, root)
    manifest = log.manifest(number)
    known = _versions(log, manifest)
    end = lambda side: known.select("repository_id", F.col("file_path").alias(f"{side}_file"), F.col("version").alias(f"{side}_version"))
    nodes = log.read("nodes", manifest=manifest).join(known, [*_FILE, "version"], "left_semi").drop("version", "bucket")
    edges = log.read("edges", manifest=manifest)
    for side in ("source", "target"):
        edges = edges.join(end(side), ["repository_id", f"{side}_file", f"{side}_version"], "left_semi")
    return nodes, edges.select("id", "source_id", "target_id", "kind", "confidence", "repository_id").dropDuplicates(["id"])


def compact(spark: SparkSession, root: str) -> int:
    """The next snapshot: the same rows without those of old versions. Refused if a batch comes in meanwhile."""
    log = SnapshotLog(spark, root)
    manifest = log.manifest()
    known = _versions(log, manifest)
    writer = Writer(log, manifest).replace("files", known)
    for table in ("nodes", "refs"):
        live = log.read(table, manifest=manifest).join(known, [*_FILE, "version"], "left_semi")
        writer.replace(table, live.select(*log.read(table, manifest=manifest).columns).repartition("bucket"), ("bucket",))
    edges = log.read("edges", manifest=manifest)
    for side in ("source", "target"):
        edges = edges.join(known.withColumnsRenamed({"file_path": f"{side}_file", "version": f"{side}_version"}), ["repository_id", f"{side}_file", f"{side}_version"], "left_semi")
    return writer.replace("edges", edges.select(*log.read("edges", manifest=manifest).columns).distinct()).commit()


def follow(changes: DataFrame, root: str, parse: Callable[[DataFrame], tuple[DataFrame, DataFrame]], checkpoint: str) -> StreamingQuery:
    """Keeps the stored graph current with a stream of changes (repository_id, path, seq, change).

    ``parse`` gives the nodes and REFERENCES of changed files. A micro-batch that was interrupted is taken in again
    when the stream resumes, and once only.
    """

    def one(batch: DataFrame, number: int) -> None:
        keyed = batch.withColumn("key", F.struct("repository_id", "path"))
        last = newest(keyed, "key", "seq").drop("key").persist()
        try:
            nodes, refs = parse(last.where("change <> 'unlink'"))
            apply(batch.sparkSession, root, number, last.select("repository_id", F.col("path").alias("file_path")), nodes, refs)
        finally:
            last.unpersist()

    return changes.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
