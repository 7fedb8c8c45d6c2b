"""Operators that learn: held-out accuracy, brute-force distances, and defined results without anything to learn."""

from __future__ import annotations

import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

from tessera.llm import language, toxicity
from tests.llm.fixtures import documents, empty, rows

SYLLABLES = {"en": "the and ing ere ough", "de": "sch ung ein ich öß", "fr": "eau que oui éaux on"}


def _text(rnd: random.Random, lang: str, n: int) -> str:
    parts = SYLLABLES[lang].split()
    return " ".join("".join(rnd.choice(parts) for _ in range(rnd.randint(1, 3))) for _ in range(n))


def test_language_held_out_accuracy_and_defined_results(spark):
    rnd = random.Random(4)
    data = [(i, _text(rnd, (lang := rnd.choice(list(SYLLABLES))), 30), lang) for i in range(240)]
    docs = spark.createDataFrame(data + [(500, None, "en"), (501, "12 !! \n", "en"), (502, "", None), (None, "the and ing", None)], "doc_id long, text string, lang string")
    known = language.profiles(docs)
    assert sorted(known) == sorted(SYLLABLES)
    out = {r["id"]: r for r in language.identify(docs, known).collect()}
    truth = {i: lang for i, _, lang in data}
    held = [i for i in truth if out[i]["held_out"]]
    assert len(held) > 40 and all(out[i]["lang_pred"] == truth[i] for i in held)
    assert [out[i]["lang_pred"] for i in (500, 501, 502)] == ["und"] * 3 and out[500]["score"] == 0.0
    assert out[None]["held_out"] and out[None]["lang_pred"] == "en"
    assert all(0 <= r["score"] <= 1 for r in out.values())
    assert language.identify(empty(spark), known).count() == 0
    assert {r["lang_pred"] for r in language.identify(docs, {}).collect()} == {"und"}
    clash = documents(spark, rows(n=20))
    assert language.identify(clash, language.profiles(clash)).count() == len(rows(n=20))


def test_ngrams_and_ranks_match_brute_force():
    texts = ["ab, ABC d", "é中 é", "x" * 50, None, "9", "İstanbul ǅ"]
    for text, (grams, counts) in zip(texts, language.ngram_lists(texts), strict=True):
        low = (text or "").lower()
        words = "".join(c if c.isalpha() else " " for c in low).split()
        own: dict[str, int] = {}
        if words:
            joined = " " + " ".join(words) + " "
            for n in (1, 2, 3):
                for i in range(len(joined) - n + 1):
                    if (g := joined[i : i + n]) != " ":
                        own[g] = own.get(g, 0) + 1
        packed = {sum(ord(c) << 21 * (len(g) - 1 - k) for k, c in enumerate(g)): n for g, n in own.items()}
        assert dict(zip(grams.tolist(), counts.tolist(), strict=True)) == packed
    assert language.ranked(np.array([5, 3, 9]), np.array([1, 1, 7]), 2).tolist() == [9, 3]


def test_out_of_place_distances_match_brute_force(spark):
    rnd = random.Random(6)
    mixed = [(i, " ".join(_text(rnd, rnd.choice(list(SYLLABLES)), 4) for _ in range(rnd.randrange(1, 5))), rnd.choice([*SYLLABLES, None])) for i in range(120)]
    data = [*mixed, (200, "q" * 3_000_000, None), (201, "the " * 50_000, None), (202, None, None), (203, "…", None), (204, mixed[0][1], "en"), (204, mixed[0][1], "en")]
    top = 40

    def grams(text):
        words = "".join(c if c.isalpha() else " " for c in (text or "").lower()).split()
        joined = " " + " ".join(words) + " " if words else ""
        return Counter(g for n in (1, 2, 3) for i in range(len(joined) - n + 1) if (g := joined[i : i + n]) != " ")

    def order(counts):
        return [g for g, _ in sorted(counts.items(), key=lambda x: (-x[1], [0] * (3 - len(x[0])) + [ord(c) for c in x[0]]))[:top]]

    totals: dict[str, Counter] = {}
    for i, text, lang in data:
        if lang and zlib.crc32(str(i).encode()) % 3 != 1:
            totals.setdefault(lang, Counter()).update(grams(text))
    known = {lang: order(c) for lang, c in totals.items()}
    expected = []
    for i, text, _ in data:
        own = order(grams(text))
        away = {lang: sum(abs(p.index(g) - k) if g in p else top for k, g in enumerate(own)) for lang, p in known.items()}
        best = min(sorted(away), key=away.get)
        expected.append((i, zlib.crc32(str(i).encode()) % 3 == 1, best if own else "und", round(1 - away[best] / (top * len(own)), 9) if own else 0.0))
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string")
    out = language.identify(docs, language.profiles(docs, top=top), top=top).collect()
    assert sorted((r["id"], r["held_out"], r["lang_pred"], round(r["score"], 9)) for r in out) == sorted(expected)


def test_toxicity_held_out_and_defined_results(spark):
    rnd = random.Random(8)
    bad = ["grzblat", "grzbling", "vortunk"]
    data, labels = [], []
    for i in range(900):
        words = _text(rnd, "en", 30).split()
        if toxic := rnd.random() < 0.2:
            for _ in range(4):
                words[rnd.randrange(30)] = rnd.choice(bad)
        data.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    docs, known = documents(spark, [*data, (2000, None), (2001, ""), (None, "grzblat")]), spark.createDataFrame([*labels, (None, 1), (3000, None)], "doc_id long, toxic int")
    model = toxicity.train(docs, known)
    out = {r["id"]: r for r in toxicity.score(docs, model).collect()}
    held = [(i, t) for i, t in labels if out[i]["held_out"]]
    assert len(held) > 100 and sum(out[i]["predicted"] == t for i, t in held) / len(held) > 0.97
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in out.values())
    assert out[2000]["score"] == out[2001]["score"] < 0.5 and out[None]["held_out"]
    assert toxicity.train(docs, known.where("toxic = 0")) is None
    assert {r["score"] for r in toxicity.score(docs, None).collect()} == {0.0}
    assert toxicity.train(empty(spark), known) is None and toxicity.score(empty(spark), model).count() == 0


def test_the_corrected_risk_does_not_go_below_zero():
    rnd = np.random.default_rng(1)
    rows = tuple(np.repeat(np.arange(n), 3) for n in (40, 200))
    features = tuple(rnd.integers(0, 20, 3 * n) for n in (40, 200))
    weights, intercept = toxicity.fit_nnpu(rows, features, (40, 200), 20, 0.3, steps=400, penalty=0.0)
    z = [np.bincount(r, weights[f], n) + intercept for r, f, n in zip(rows, features, (40, 200), strict=True)]
    negative = np.logaddexp(0, z[1]).mean() - 0.3 * np.logaddexp(0, z[0]).mean()
    assert negative > -0.05


def test_the_fit_matches_a_plain_one_and_words_are_whole():
    rnd = np.random.default_rng(2)
    x = [(rnd.random((n, 6)) < 0.4).astype(float) for n in (30, 80)]
    prior, steps = 0.25, 60
    sparse = [np.nonzero(m) for m in x]
    weights, intercept = toxicity.fit_nnpu(tuple(s[0] for s in sparse), tuple(s[1] for s in sparse), (30, 80), 6, prior, steps=steps, rate=0.05, penalty=1e-3)
    theta = [0.0] * 6 + [float(np.log(prior / (1 - prior)))]
    m, v, mean, clamped = [0.0] * 7, [0.0] * 7, [0.0] * 7, 0
    sigmoid = lambda z: 1 / (1 + np.exp(-z))
    for t in range(1, steps + 1):
        z = [[sum(a * b for a, b in zip(row, theta)) + theta[6] for row in part] for part in x]
        loss = lambda part: sum(np.log(1 + np.exp(s)) for s in part) / len(part)
        negative = loss(z[1]) - prior * loss(z[0])
        clamped += negative < 0
        for j in range(7):
            own = lambda row, j=j: row[j] if j < 6 else 1.0
            rise = sum(sigmoid(s) * own(r) for s, r in zip(z[1], x[1])) / 80 - prior * sum(sigmoid(s) * own(r) for s, r in zip(z[0], x[0])) / 30
            pull = prior * sum((sigmoid(s) - 1) * own(r) for s, r in zip(z[0], x[0])) / 30
            g = (pull + rise if negative >= 0 else -rise) + (1e-3 * theta[j] if j < 6 else 0)
            m[j], v[j] = 0.9 * m[j] + 0.1 * g, 0.999 * v[j] + 0.001 * g * g
            theta[j] -= 0.05 * (m[j] / (1 - 0.9**t)) / ((v[j] / (1 - 0.999**t)) ** 0.5 + 1e-8)
            if t > steps // 2:
                mean[j] += theta[j] / (steps - steps // 2)
    assert np.allclose([*weights, intercept], mean, atol=1e-6)
    (code, good, off), = toxicity.words_of(pa.array(["Ab cd, ab", None, "", "é CD"]))
    assert off.tolist() == [0, 3, 3, 3, 5] and good.all() and code[0] == code[2] and code[1] == code[4] and len(set(code.tolist())) == 3


def test_bounds_and_features_are_parameters(spark):
    data = [(i, f"w{i % 7} {'grzblat' if i % 3 == 0 else 'calm'} w{i % 11}") for i in range(400)]
    docs, known = documents(spark, data), spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(400)], "doc_id long, toxic int")
    for features in ("words", "ngrams"):
        model = toxicity.train(docs, known, most_positive=60, most_unlabelled=200, n_features=3, features=features)
        assert model.features == features and 0 < len(model.grams) <= 3
        out = {r["id"]: r["predicted"] for r in toxicity.score(docs, model).collect()}
        assert sum(out[i] == int(i % 3 == 0) for i in out) / len(out) > 0.97


def test_ngrams_of_toxicity_stay_within_words_and_texts():
    found = set()
    for code, good, _ in toxicity.grams_of(pa.array(["abcd ef", "Gh", None])):
        for c in code[good].tolist():
            n = 4 if c >> 32 == 4 else 5
            found.add(bytes(c >> 8 * (n - 1 - j) & 255 for j in range(n)))
    assert found == {b" abc", b"abcd", b"bcd ", b" ef ", b" gh ", b" abcd", b"abcd "}
