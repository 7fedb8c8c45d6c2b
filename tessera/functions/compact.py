"""The compact response: short keys, no empty or internal fields, shared values once."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Short keys, and fields that a compact response leaves out.
SHORT_KEYS = {
    "results": "r", "callers": "r", "callees": "r", "name": "n", "qualifiedName": "qn", "kind": "k", "filePath": "fp",
    "lineStart": "ls", "lineEnd": "le", "repositoryId": "rid", "language": "lang", "nodeId": "nid", "score": "s",
    "isExported": "x", "complexity": "cx", "total": "t", "hasMore": "m", "symbol": "sym", "affectedNodes": "nodes",
    "affectedFiles": "files", "entryPoints": "entry", "modules": "mods", "keyAbstractions": "abs", "searchType": "st",
}
LEFT_OUT = ("id", "visibility", "limit", "offset", "columnStart", "columnEnd")
HOISTED = ("repositoryId", "language")


def camel(name: str) -> str:
    head, *rest = name.split("_")
    return head + "".join(p.capitalize() for p in rest)


def compact_rows(rows: DataFrame, without: tuple[str, ...] = ()) -> Column:
    """One JSON object a row with short keys; null fields are left out."""
    fields = [F.col(c).alias(SHORT_KEYS.get(camel(c), camel(c))) for c in rows.columns if camel(c) not in LEFT_OUT and camel(c) not in without]
    return F.to_json(F.struct(*fields))


def hoisted(rows: DataFrame) -> DataFrame:
    """One row with the fields that have one same value in all rows, null where they differ or one is missing."""
    snake = {"repositoryId": "repository_id", "language": "language"}
    cols = []
    for name in HOISTED:
        if (c := snake[name]) in rows.columns:
            same = (F.min(c) == F.max(c)) & (F.count(c) == F.count(F.lit(1)))
            cols.append(F.when(same, F.min(c)).alias(SHORT_KEYS[name]))
    return rows.agg(*cols)


def compact_page(page: DataFrame, total: int, has_more: bool, order: str = "seq") -> DataFrame:
    """One row, ``payload``: the envelope of a page of at most a hundred rows."""
    shared = hoisted(page).first().asDict()
    gone = tuple(k for k in HOISTED if shared.get(SHORT_KEYS[k]) is not None)
    rows = page.select(F.struct(F.col(order).alias("o"), compact_rows(page.drop(order), gone).alias("j")).alias("x")) if order in page.columns else page.select(F.struct(F.monotonically_increasing_id().alias("o"), compact_rows(page, gone).alias("j")).alias("x"))
    body = rows.agg(F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["j"]), ","), F.lit("]")).alias("r"))
    head = F.to_json(F.struct(*[F.lit(shared[SHORT_KEYS[k]]).alias(SHORT_KEYS[k]) for k in gone], F.lit(total).alias("t"), F.lit(has_more).alias("m")))
    return body.select(F.concat(F.lit('{"r":'), F.col("r"), F.lit(","), F.substring(head, 2, 1 << 30)).alias("payload"))


def full_page(page: DataFrame, total: int, limit: int, offset: int, order: str = "seq") -> str:
    """The full response: every field under its long name, indented by two blanks. A page has a hundred rows at most."""
    if not 1 <= limit <= 100:
        raise ValueError("limit must be 1 to 100")
    ordered = page.orderBy(order).drop(order) if order in page.columns else page
    results = [{camel(c): v for c, v in r.asDict(recursive=True).items()} for r in ordered.limit(limit).collect()]
    envelope = {"results": results, "total": total, "limit": limit, "offset": offset, "hasMore": offset + len(results) < total}
    return json.dumps(envelope, indent=2, ensure_ascii=False, default=str)
