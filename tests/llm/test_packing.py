"""Packing: capacity, whole items, little waste; exact token counts."""

import os
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from almena.llm.packing import count_tokens, pack, plan_containers
from almena.llm.tokens import TOKENIZER, load_encoding, token_counter

needs_vocabulary = pytest.mark.skipif(not os.path.exists(TOKENIZER), reason="no vocabulary file here")


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 40), min_size=1))
def test_plan_uses_every_item_once(counts):
    used = {}
    for times, contents in plan_containers(counts, 64):
        assert times > 0 and sum(s * n for s, n in contents.items()) <= 64
        for s, n in contents.items():
            used[s] = used.get(s, 0) + n * times
    assert used == counts
    total = sum(s * n for s, n in counts.items())
    assert sum(t for t, _ in plan_containers(counts, 64)) <= 2 * -(-total // 64) + 1


def test_exact_complements_are_found():
    assert {tuple(sorted(c.items())) for _, c in plan_containers({60: 2, 40: 2}, 100)} == {((40, 1), (60, 1))}
    assert [t for t, c in plan_containers({50: 1, 20: 1, 30: 1}, 100)] == [1]
    assert [t for t, c in plan_containers({40: 1, 10: 1, 20: 1, 30: 1}, 100)] == [1]
    assert plan_containers({}, 100) == []


def test_pack(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice([7, 7, 7, 300, 777, 1500, 2048, 5000, 0, 4096])) for i in range(2000)] + [(None, 5)]
    got = pack(spark.createDataFrame(rows, "doc_id long, n_tokens long")).toPandas()
    filled = got[got.container_id.notna()]
    sums = filled.groupby("container_id").n_tokens.sum()
    assert sums.max() <= 2048 and sorted(sums.index) == list(range(len(sums)))
    per = got.groupby("doc_id", dropna=False).n_tokens.sum()
    assert all(per[i] == n for i, n in rows if i is not None)
    parts = got.groupby("doc_id").size()
    assert all(parts[i] == max(1, -(-n // 2048)) for i, n in rows if i is not None)
    assert len(sums) <= np.ceil(sum(n for _, n in rows) / 2048) * 1.05 + 1
    assert got[got.n_tokens == 0].container_id.isna().all()
    assert pack(spark.createDataFrame([], "doc_id long, n_tokens long")).count() == 0


@needs_vocabulary
@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab é1.,'\n\t\r   🙂-\x1c", max_size=40))
def test_counts_are_exact(text):
    assert token_counter()(text) == len(load_once().encode_ordinary(text))


def load_once(store={}):
    if "e" not in store:
        store["e"] = load_encoding(TOKENIZER)
    return store["e"]


@needs_vocabulary
def test_count_tokens(spark):
    rows = [(1, "hola mundo"), (1, "hola mundo"), (2, None), (3, ""), (4, "palabra " * 50_000)]
    got = {r.doc_id: r.n_tokens for r in count_tokens(spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n_tokens int")).collect()}
    assert got == {1: len(load_once().encode_ordinary("hola mundo")), 2: 0, 3: 0, 4: len(load_once().encode_ordinary("palabra " * 50_000))}
