"""Exact search, periodic runs and spelling variants against versions that follow the definition word by word."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import periodic, registry, spelling, topk
from tests.llm.fixtures import documents, empty

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


# -- exact top-k search ----------------------------------------------------------------------------------------------


def _vectors(seed: int = 3, n: int = 330) -> list[tuple]:
    """(vec_id, embedding): sparse and dense rows, copies, ties, repeated ids, empty, null and broken vectors."""
    rnd = random.Random(seed)
    hot = [rnd.uniform(-1, 1) for _ in range(6)]
    out: list[tuple] = [(0, hot), (0, hot), (50, []), (100, None), (150, [0.1, None]), (200, [1.0, float("nan")]), (250, [float("inf"), 1.0]), (None, hot), (300, [1e308] * 6), (1, [-0.001] * 6), (2, [0.5])]
    for i in range(3, n):
        kind = rnd.randrange(4)
        out.append((i, hot if kind == 0 else [rnd.choice([0.0, 0.25, -0.5, 0.003]) for _ in range(6)] if kind == 1 else [rnd.uniform(-1, 1) for _ in range(rnd.choice([6, 6, 4]))]))
    return out


def _best(rows: list[tuple], every: int, k: int) -> list[tuple]:
    def whole(v):
        if v is None or any(x is None or not math.isfinite(x) or not math.isfinite(256 * x) for x in v):
            return None
        return [math.floor(256 * x) for x in v]

    known = [(i, w) for i, v in rows if i is not None and (w := whole(v)) is not None]
    out = []
    for a, (i, q) in enumerate(known):
        if i % every == 0:
            scored = sorted((-max(-(2**63), min(2**63 - 1, sum(x * y for x, y in zip(q, c)))), j) for b, (j, c) in enumerate(known) if b != a)  # noqa: B905
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scored[:k])]
    return sorted(out)


def _as_table(spark, rows, tmp_path):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    df.withColumns({"score": F.lit("own"), "rank": F.lit(1), "row": F.lit(2), "label": F.lit(1)}).write.parquet(str(tmp_path / "embeddings.parquet"))
    return str(tmp_path)


def test_topk_query_matches_brute_force(spark, tmp_path):
    rows = _vectors()
    got = registry.op11_exact_topk(spark, _as_table(spark, rows, tmp_path))
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted(map(tuple, got.collect())) == _best(rows, 50, 5)


def test_topk_in_small_tiles_and_with_large_numbers(spark, tmp_path):
    rows = [(i, v) for i, v in _vectors(4) if v is None or None in v or not any(abs(x) > 1e300 for x in v if x is not None)]
    got = topk.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 10 == 0, queries=5, candidates=40)
    assert sorted(map(tuple, got.collect())) == _best(rows, 10, 5)
    large = [(i, [x * 10.0**m for x in v]) for i, (v, m) in enumerate(zip([[1.0, -2.0, 3.0], [4.0, 5.0, -6.0], [0.0, 7.0, 1.0]] * 4, [3, 6, 7, 8, 9, 12, 2, 0, 5, 30, 31, 1], strict=True))]
    got = topk.search(spark.createDataFrame(large, "vec_id long, embedding array<double>"), F.col("vec_id") % 2 == 0)
    assert sorted(map(tuple, got.collect())) == _best(large, 2, 5)


def test_topk_of_few_or_no_rows(spark):
    frame = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert topk.search(frame([]), F.col("vec_id") % 50 == 0).count() == 0
    assert topk.search(frame([(50, [1.0])]), F.col("vec_id") % 50 == 0).count() == 0
    assert [tuple(r) for r in topk.search(frame([(50, [1.0]), (7, [2.0])]), F.col("vec_id") % 50 == 0).collect()] == [(50, 1, 7, 131072)]


def test_select_takes_the_first_of_equal_scores():
    dense = np.array([[1, 5, 5, 5, 0], [2, 2, 2, 2, 2]])
    assert [sorted(r.tolist()) for r in topk.select(dense, 2)] == [[1, 2], [0, 1]]


# -- periodic runs ---------------------------------------------------------------------------------------------------


def _runs(words: list[str], min_length: int = 12) -> list[tuple[int, int, int]]:
    """(start, length, period), by the definition: smallest period, long enough, not to be extended."""
    n, out = len(words), []
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            whole = words[i : i + length]
            if length >= max(min_length, 2 * q) and not any(whole[p:] == whole[:-p] for p in range(1, q)):
                out.append((i, length, q))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def _planted(doc_id: int | None, text: str | None) -> list[str]:
    words = WORD.findall(text or "")
    n = len(words)
    if doc_id is None or not n:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def _digest(doc_id: int | None, text: str | None) -> tuple:
    words = _planted(doc_id, text)
    runs = _runs(words)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    top = min(((-length, s, q) for s, length, q in runs), default=None)
    figures = (top[1], -top[0], top[2], 1000 * -top[0] // top[2]) if top else (None,) * 4
    said = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    return (doc_id, len(runs), *figures, _sha(said), _sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def _texts(seed: int = 5, n: int = 150) -> list[tuple[int | None, str | None]]:
    rnd = random.Random(seed)
    out: list[tuple[int | None, str | None]] = [(None, "a b " * 9), (None, None), (0, None), (1, ""), (2, " \n\t"), (3, "x " * 11), (4, "x " * 12), (4, "x " * 12), (5, "x y\tz\n" * 40), (6, "ab cd " * 6 + "ab"), (7, "é 😀 " * 7)]
    for i in range(8, n):
        words = [rnd.choice("ab" if i % 3 else "abcdefgh") + rnd.choice(["", "", "é"]) for _ in range(rnd.randrange(1, 90))]
        for _ in range(rnd.randrange(3)):
            at, p = rnd.randrange(len(words)), rnd.randrange(1, 30)
            words[at:at] = words[at : at + p] * rnd.randrange(1, 5)
        out.append((i, rnd.choice([" ", "\n", "  "]).join(words) + rnd.choice(["", " "])))
    return out


def test_periodic_query_matches_brute_force(spark, tmp_path):
    rows = _texts()
    documents(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = registry.op12_periodic_runs(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    order = lambda r: tuple(str(x) for x in r)
    assert sorted(map(tuple, got.collect()), key=order) == sorted((_digest(i, t) for i, t in rows), key=order)
    assert sum(zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows if i is not None) > 5


def test_ranges_of_lags_give_what_one_scan_gives(spark):
    rows = _texts(6)
    docs = documents(spark, rows)
    whole = sorted(map(str, periodic.find(docs).collect()))
    assert sorted(map(str, periodic.find(docs, long_bytes=60, lags=7).collect())) == whole
    assert {(r["id"], tuple(map(tuple, r["runs"]))) for r in periodic.find(docs, long_bytes=0, lags=3).collect()} == {(i, tuple(_runs(WORD.findall(t or "")))) for i, t in rows}
    assert periodic.find(empty(spark)).count() == 0


def test_a_long_text_with_a_long_period(spark):
    rnd = random.Random(1)
    part = [f"w{rnd.randrange(4000)}" for _ in range(9_000)]
    words = ["head"] * 3 + part + part + part[:500] + ["tail"]
    found = periodic.find(spark.createDataFrame([(1, " ".join(words))], "doc_id long, text string")).first()
    assert [tuple(r) for r in found["runs"]] == [(3, 18_500, 9_000)] and found["collapsed"] == " ".join(["head"] * 3 + part + ["tail"])


# -- spelling variants -----------------------------------------------------------------------------------------------


def _counted(rows: list[tuple[int | None, str | None]], every: int) -> dict[str, int]:
    n = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            if i is not None and (h := zlib.crc32(f"{i}:{word}".encode())) % every == 0:
                gone = h % len(word)
                word = word[:gone] + word[gone + 1 :]
            n[word] += 1
    return {w: k for w, k in n.items() if len(w) >= 6 and k >= 5}


def _near(a: str, b: str) -> bool:
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(a) + 1 == len(b) and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def _variants(n: dict[str, int]) -> list[tuple]:
    near = {w: sorted((-n[v], v) for v in n if _near(w, v)) for w in n}
    form = {w: own[0][1] if own and -own[0][0] >= 5 * n[w] else None for w, own in near.items()}
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return sorted(out)


def _spelled(seed: int = 7, n: int = 400) -> list[tuple[int | None, str | None]]:
    rnd = random.Random(seed)
    base = ["letter", "leetter", "letters", "Ärmelé", "ärmelé", "better", "battery", "aaaaaa", "aaaaaaa", "aaabaaa", "straße", "x" * 300, "x" * 301]
    slips = [w[:i] + c + w[i + d :] for w in base for i in range(0, min(len(w), 9)) for c, d in (("", 1), ("q", 1), ("é", 0), (w[i], 0))]
    out: list[tuple[int | None, str | None]] = [(None, "letter " * 9), (None, None), (1, None), (2, ""), (3, "12 ; \n"), (4, "Letter,LETTER"), (4, "Letter,LETTER")]
    for i in range(5, n):
        words = [rnd.choice(base[: 1 + i % len(base)] if rnd.random() < 0.9 else slips) for _ in range(rnd.randrange(60))]
        out.append((i, rnd.choice([" ", "-", "\n9"]).join(w.upper() if rnd.random() < 0.1 and w.isascii() else w for w in words)))
    return out


def test_spelling_query_matches_brute_force(spark, tmp_path):
    rows = _spelled()
    documents(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = registry.op13_spelling_variants(spark, str(tmp_path))
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    expected = _variants(_counted(rows, 199))
    assert sorted(map(tuple, got.collect())) == expected
    assert len(expected) > 60 and any(r[1] for r in expected) and _counted(rows, 199) != _counted(rows, 10**12)


@pytest.mark.parametrize("seed", [1, 2])
def test_many_small_tries_give_the_same(spark, seed):
    rnd = random.Random(seed)
    n = {}
    while len(n) < 300:
        n["".join(rnd.choice("abé") for _ in range(rnd.randrange(6, 9)))] = 5 ** rnd.randrange(1, 7) + rnd.randrange(3)
    counted = spark.createDataFrame(list(n.items()), "word string, n long")
    expected = _variants(n)
    assert sorted(map(tuple, spelling.variants(counted, shard_words=23, round_bytes=4000).collect())) == expected
    assert any(r[1] != r[2] for r in expected if r[1])


def test_spelling_of_nothing(spark):
    assert spelling.variants(spelling.count_words(empty(spark))).count() == 0
    assert spelling.variants(spelling.count_words(spark.createDataFrame([(1, "alpha1 of to")], "doc_id long, text string"))).count() == 0
