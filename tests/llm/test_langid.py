"""Language ID against a plain version, with more languages than are listed, and with labels that are mostly copies."""

import collections
import math
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from prepbank.llm import langid


def test_every_language_is_learned(spark):
    rng = np.random.default_rng(3)
    rows = []
    for lang in range(70):
        words = ["".join(chr(97 + int(c)) for c in rng.integers(0, 26, 5)) for _ in range(15)]
        for i in range(9 if lang < 40 else 6):
            rows.append((len(rows), " ".join(rng.choice(words, 40)), f"x{lang}", i))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, i int").repartition(4)
    model = langid.fit(docs, F.col("i") > 0)
    assert {x for langs in model.families.values() for x in langs} == {f"x{i}" for i in range(70)}
    assert len(model.machines) < 70 * 69 / 4
    right = collections.Counter(lang == model.predict(text)[0] for _, text, lang, i in rows if i == 0)
    assert right[True] >= 68


def made(langs, texts, seed=4):
    rng = np.random.default_rng(seed)
    rows = []
    for lang in langs:
        words = ["".join(chr(97 + int(c)) for c in rng.integers(0, 26, 4)) for _ in range(12)]
        rows += [(" ".join(rng.choice(words, 30)), lang) for _ in range(texts)]
    return [(i, *r) for i, r in enumerate(rows)]


def test_labels_that_are_mostly_copies_are_learned(spark):
    """Ten thousand copies of one text are one text, wherever its hash lies; two such labels among one of many texts."""
    rows = made(["en"], 300)
    texts = {"xa": "blim blam blom blum zork", "xb": "trik trak truk vip vop vup"}
    for at, (lang, text) in enumerate(texts.items()):
        rows += [(10_000 * (at + 1) + i, text, lang) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").repartition(4)
    one = langid.identify(docs.where("lang <> 'xb'"), F.lit(True), ).groupBy("lang_pred").count().collect()
    assert {r["lang_pred"]: r["count"] for r in one} == {"en": 300, "xa": 3000}
    both = langid.identify(docs, F.lit(True)).groupBy("lang_pred").count().collect()
    assert {r["lang_pred"]: r["count"] for r in both} == {"en": 300, "xa": 3000, "xb": 3000}
    sample = langid.labelled_sample(docs.select("lang", "text"), 100)
    assert {r["lang"]: r["count"] for r in sample.groupBy("lang").count().collect()} == {"en": 100, "xa": 1, "xb": 1}


def test_documents_stay_where_nothing_is_learned(spark):
    docs = spark.createDataFrame([(1, "words here", None), (2, "12 34", None), (3, None, None), (4, "é", None)], "doc_id bigint, text string, lang string")
    model = langid.fit(docs, F.lit(True))
    assert sorted(r["doc_id"] for r in langid.drop_unknown(docs, model).collect()) == [1, 4]


def test_a_low_score_lets_a_document_go(spark):
    rows = made(["en", "fr"], 60)
    docs = spark.createDataFrame([*rows, (900, "qqq xxx qqq zzz", None)], "doc_id bigint, text string, lang string")
    model = langid.fit(docs, F.lit(True))
    scores = {i: model.predict(t)[1] for i, t, _ in [*rows, (900, "qqq xxx qqq zzz", None)]}
    least = (scores[900] + min(s for i, s in scores.items() if i != 900)) / 2
    assert scores[900] < least
    assert sorted(r["doc_id"] for r in langid.drop_unknown(docs, model, least=least).collect()) == [i for i, _, _ in rows]


def features_by_hand(text):
    """Shares of hashed pairs and triples of letters, by dictionaries and Python's whole numbers."""
    letters, last = [0], 0
    for ch in text.lower():
        code = ord(ch) if ch.isalpha() else 0
        if code or last:
            letters.append(code)
        last = code
    if last:
        letters.append(0)
    out = [0.0] * (langid.PAIRS + langid.TRIPLES)
    full = 2**64
    for at, size, places in ((0, 2, langid.PAIRS), (langid.PAIRS, 3, langid.TRIPLES)):
        grams = [letters[i : i + size] for i in range(len(letters) - size + 1)]
        for g in grams:
            if size == 2:
                h = (g[0] * 0x9E3779B1 + g[1]) * 0x85EBCA77C2B2AE63 % full
            else:
                h = ((g[0] * 0x9E3779B1 + g[1]) * 0xC2B2AE3D + g[2]) * 0x9E3779B97F4A7C15 % full
            out[at + (h >> 40) % places] += 1 / len(grams) / 2
    return [math.sqrt(x) for x in out]


def machine_by_hand(x, y):
    """The minimum of the same objective by Newton steps."""
    x = np.hstack([np.array(x), np.ones((len(x), 1))])
    y = np.array(y, float)
    share = np.where(y > 0, 0.5 / (y > 0).sum(), 0.5 / (y < 0).sum())
    w = np.zeros(x.shape[1])
    for _ in range(50):
        short = np.maximum(0, 1 - y * (x @ w))
        active = x[short > 0]
        gradient = w - 2 * langid.COST * ((share * short * y) @ x)
        hessian = np.eye(len(w)) + 2 * langid.COST * (active.T * share[short > 0]) @ active
        w = w - np.linalg.solve(hessian, gradient)
        if np.linalg.norm(gradient) < 1e-12:
            break
    return w


@pytest.mark.parametrize("langs", [["en", "de", "fr", "es"], ["en", "de", "nl", "fr", "x1", "x2", "x3"]])
def test_families_and_duels_by_hand(spark, langs):
    """Prediction and score of every document by a plain version of features, machines, families and duels."""
    rows = made(langs, 25, seed=6)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").repartition(3)
    learn = F.col("doc_id") % 4 != 2
    got = {r["doc_id"]: r for r in langid.identify(docs, learn).collect()}
    x = {i: features_by_hand(t) for i, t, _ in rows}
    assert langid.features(rows[0][1]) == pytest.approx(x[0])
    model = langid.fit(docs, learn)
    families = model.families
    assert sorted(f for fs in families.values() for f in fs) == sorted(langs)
    assert all(len({langid.family(f) for f in fs}) == 1 for fs in families.values())
    known = [(i, lang) for i, _, lang in rows if i % 4 != 2]
    of = {lang: f for f, fs in families.items() for lang in fs}

    def winner(names, label, i):
        if len(names) == 1:
            return names[0], math.inf
        wins, sums, least = collections.Counter(), collections.Counter(), {}
        for a, b in combinations(sorted(names), 2):
            if (a, b) not in machines:
                chosen = [(j, label(lang)) for j, lang in known if label(lang) in (a, b)]
                machines[a, b] = machine_by_hand([x[j] for j, _ in chosen], [1 if f == a else -1 for _, f in chosen])
            margin = float(np.append(x[i], 1) @ machines[a, b])
            for name, m in ((a, margin), (b, -margin)):
                wins[name] += m > 0
                sums[name] += m
                least[name] = min(least.get(name, math.inf), m)
        best = max(sorted(names), key=lambda n: (wins[n], sums[n]))
        return best, least[best]

    machines = {}
    for i, _, _ in rows:
        chosen, first = winner(list(families), lambda lang: of[lang], i)
        lang, second = winner(families[chosen], lambda lang: lang, i)
        margin = min(first, second)
        assert got[i]["lang_pred"] == lang
        assert got[i]["score"] == pytest.approx(1 / (1 + math.exp(-langid.SLOPE * margin)) if margin < math.inf else 1.0, abs=1e-4)
