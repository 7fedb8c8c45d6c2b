"""Search by words and by vector at once, over stored indexes only: neither texts nor all vectors are read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import text_index, vector_index
from tessera.operators.search import placed, reciprocal_ranks


def stored_search(spark: SparkSession, text_path: str | None, phrase: str, vector_path: str | None, query: list[float], limit: int = 20, offset: int = 0, stem: bool = True, probes: int | None = None) -> DataFrame:
    """(id, score) as ``search.hybrid_search`` gives, from an index of texts (:mod:`tessera.operators.text_index`) and
    one of vectors (:mod:`tessera.operators.vector_index`) of the same ids. Both legs give twice the limit; an index
    that is not given adds nothing. Without ``probes`` the vector leg may miss what its index may miss."""
    words = near = None
    if text_path is not None:
        words = placed(text_index.phrase_search(spark, text_path, phrase, 2 * limit, stem=stem), F.desc("rank"), F.col("id"))
    if vector_path is not None:
        asked = spark.createDataFrame([(0, [float(x) for x in query])], "query int, vector array<double>")
        near = vector_index.nearest(spark, vector_path, asked, "query", "vector", 2 * limit, probes).select("id", F.col("rank").alias("place"))
    return reciprocal_ranks(words, near, limit, offset)
