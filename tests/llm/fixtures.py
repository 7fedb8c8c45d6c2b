"""Documents with the cases that every operator has to survive."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VOCABULARY = ["ab", "Cd", "é", "the", "zz", "😀", "x#", "12", "of"]


def rows(seed: int = 1, n: int = 60) -> list[tuple[int | None, str | None]]:
    """(id, text): nulls, empty and blank texts, copies, near copies, repeated rows and one long text."""
    rnd = random.Random(seed)
    base = [" ".join(rnd.choice(VOCABULARY) for _ in range(50)) for _ in range(4)]
    out: list[tuple[int | None, str | None]] = [(None, base[0]), (None, None), (1, None), (2, ""), (3, " \t\n"), (4, base[1]), (4, base[1]), (4, base[2])]
    for i in range(5, n):
        kind = rnd.randrange(5)
        if kind == 0:
            text = rnd.choice(base)
        elif kind == 1:
            words = rnd.choice(base).split()
            words[rnd.randrange(len(words))] = "CHANGED"
            text = "\n".join([" ".join(words[:25]), " ".join(words[25:])])
        elif kind == 2:
            text = "\n".join(rnd.choice(["a b c", "line two", "", "d  e\tf"]) for _ in range(rnd.randrange(12)))
        else:
            text = " ".join(rnd.choice(VOCABULARY) for _ in range(rnd.randrange(90)))
        out.append((i, text))
    out.append((n, " ".join(rnd.choice(VOCABULARY) for _ in range(40_000))))
    return out


#: Names that operators use for their own columns.
CLASHING = ("id", "kept", "row", "fp", "root", "spans", "score", "host", "rule", "path", "key", "n_words", "tokens", "hash", "at", "seq")


def documents(spark: SparkSession, data: list[tuple[int | None, str | None]]) -> DataFrame:
    """As ``documents``, with further columns whose names clash with those that operators make."""
    df = spark.createDataFrame(data, "doc_id long, text string")
    df = df.withColumns({"lang": F.lit("en"), "source": F.lit("src"), "n_chars": F.length("text").cast("long")})
    return df.withColumns({c: F.lit(f"own {c}") for c in CLASHING}).withColumn("tags", F.create_map(F.lit("a"), F.lit("b")))


def empty(spark: SparkSession) -> DataFrame:
    return documents(spark, []).limit(0)
