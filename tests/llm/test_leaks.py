"""Leaks: block-max WAND against a table of all runs."""

import random

from almena.llm import leaks
from almena.llm.leaks import find_leaks
from almena.llm.words import words

DOC, ITEM = "doc_id long, text string, item_id string", "item_id long, text string, doc_id string"


def brute(docs, items, run=12):
    index = {}
    for i, t in items:
        w = words(t or "")
        for k in range(len(w) - run + 1):
            index.setdefault(tuple(w[k : k + run]), set()).add(i)
    return {(d, i) for d, t in docs if t for w in [words(t)] for k in range(len(w) - run + 1) for i in index.get(tuple(w[k : k + run]), ())}


def data():
    rng = random.Random(7)
    v = ["la", "de", "the", "Año", "ruta"] * 6 + [f"w{i}" for i in range(80)]
    items = [(i, " ".join(rng.choice(v) for _ in range(rng.choice([8, 12, 30, 60])))) for i in range(60)] + [(60, None), (61, ""), (62, "la " * 40)]
    docs = []
    for d in range(250):
        w = [rng.choice(v) for _ in range(rng.randrange(0, 80))]
        for _ in range(rng.randrange(3)):
            src = words(rng.choice(items)[1] or "")
            a = rng.randrange(max(1, len(src)))
            cut = src[a : a + rng.choice([10, 11, 12, 13, 40])]
            w[len(w) // 2 : len(w) // 2] = [x.upper() if rng.random() < 0.2 else x for x in cut]
        docs.append((d, rng.choice([" ", "\n", ", ", " — ", " "]).join(w)))
    return docs + [(900, None), (901, ""), (902, "la " * 100_000)], items


def test_against_all_runs(spark, monkeypatch):
    docs, items = data()
    want = brute(docs, items)
    assert len(want) > 30
    d, i = spark.createDataFrame([(*x, "z") for x in docs + docs[:9]], DOC), spark.createDataFrame([(*x, "z") for x in items + items[:3]], ITEM)
    for at_once, most in ((2_000_000, 4_000_000), (50, 90)):
        monkeypatch.setattr(leaks, "WORDS_AT_ONCE", at_once)
        got = [tuple(r) for r in find_leaks(d, i, most=most).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_empty(spark):
    docs, items = data()
    d, i = spark.createDataFrame([(*x, "z") for x in docs[:5]], DOC), spark.createDataFrame([(*x, "z") for x in items[:5]], ITEM)
    assert find_leaks(d, i.limit(0)).count() == 0 and find_leaks(d.limit(0), i).count() == 0
    assert find_leaks(d, i.filter("item_id = 61")).count() == 0


def test_folding():
    assert words("ÁRBOL-niño éx 12º") == ["arbol", "nino", "ex", "12"]
