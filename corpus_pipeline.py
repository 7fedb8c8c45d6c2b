"""A curation pipeline over ``documents``; each stage reads the Parquet table that the one before wrote.

Every stage but the last returns the columns of ``documents``: rejected documents go, one document of each
near-duplicate group stays, documents that overlap the benchmark go, secrets are masked. The last stage encodes what
is left. Every stage takes null texts and ids, empty and very long texts, ties and repeated rows as its operator's
docstring states: a null text fails the quality rules; of repeated rows and of copies one stays; other columns,
whatever their names, pass through untouched; a table without rows gives a result without rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, decontaminate, quality, secrets, simhash
from tessera.llm.registry import vocabulary_path
from tessera.llm.tables import read, settle
from tessera.llm.textblocks import ROW

#: Texts to drop that are still broadcast (32 bytes each).
FEW = 250_000


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: documents that the rules reject go."""
    target = read(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return quality.quality_rules(docs, target, keep_row=True).where("kept").select(f"{ROW}.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: the document of the smallest id of each component stays."""
    return simhash.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: documents that overlap a benchmark item go. They are known by their text, since ids may be null.

    Up to FEW hashes of such texts go to every task, and the other texts stay where they are; more are joined by shuffle.
    """
    mark = F.unhex(F.sha2(F.col("text"), 256))
    leaks = decontaminate.overlaps(docs.select(mark.alias("mark"), "text"), read(spark, sf_dir, "benchmark"), id_col="mark", with_short_lines=True)
    gone = settle(leaks.select("id").distinct(), "leaks")
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), mark.alias("mark"))
    return keyed.join(gone if gone.count() > FEW else F.broadcast(gone), F.col("mark") == F.col("id"), "left_anti").select("row.*")


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: secrets are masked, and n_chars says how long the text is now."""
    clean = secrets.redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns) if "n_chars" in docs.columns else clean


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: the ids of every text, and a proof that they decode to it."""
    done = bpe.round_trip(docs, vocabulary_path())
    return done.select(F.col("id").alias("doc_id"), "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secret_scan", secret_scan),
    ("byte_bpe", byte_bpe),
]

#: A learned threshold, a graph's components and an encoding: SQL cannot express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over all of ``documents``."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
