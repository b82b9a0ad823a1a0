"""Queries over small tables against brute force."""

import datetime as dt
import itertools
import random

import numpy as np

import __spark_entry__ as entry
from almena.operators import graph


def write(spark, folder, name, rows, kinds):
    spark.createDataFrame(rows, kinds).write.parquet(f"{folder}/{name}.parquet")


LINE = "l_partkey long, l_suppkey long, l_linenumber int"


def test_pagerank_of_single_parts_runs_40_rounds(spark, tmp_path):
    rng = np.random.default_rng(7)
    lines = [(int(p), int(s), int(n)) for p, s, n in zip(rng.choice([1, 2, 3, 501, 502, 1001], 40), rng.integers(1, 9, 40), rng.integers(1, 3, 40))]
    write(spark, tmp_path, "lineitem", lines, LINE)
    edges = {(f"s{s}", f"p{p}") for p, s, _ in lines} | {(f"p{p}", f"s{s}") for p, s, n in lines if n == 1}
    ids = sorted({x for e in edges for x in e})
    out = {i: [b for a, b in edges if a == i] for i in ids}
    rank = dict.fromkeys(ids, 1 / len(ids))
    for _ in range(40):
        held = sum(rank[i] for i in ids if not out[i])
        new = dict.fromkeys(ids, 0.15 / len(ids) + 0.85 * held / len(ids))
        for i in ids:
            for j in out[i]:
                new[j] += 0.85 * rank[i] / len(out[i])
        rank = new
    got = {r.id: r["rank"] for r in entry.queries()["g1_pagerank"](spark, str(tmp_path)).collect()}
    assert {"p1", "p501", "p1001"} <= set(got) == set(ids)
    assert all(abs(got[i] - rank[i]) < 1e-9 for i in ids)


def test_conflicts_at_a_tenth_and_their_pairs(spark, tmp_path):
    jan, feb = dt.datetime(2000, 1, 5), dt.datetime(2000, 2, 5)
    rows = [
        (1, 10, 5.0, 4500.0, 0.0, jan), (1, 11, 9.0, 4500.0, 0.0, jan), (1, 12, 1.0, 900.0, 0.0, jan),  # 450, 450, 90 of 990: the last is under a tenth
        (1, 10, 3.0, 2000.0, 0.0, feb), (1, 11, 1.0, 1000.0, 0.0, feb), (501, 12, 1.0, 8000.0, 0.0, jan),  # 501 is not 1
        (2, 10, 1.0, 200.0, 0.0, jan), (2, 11, 1.0, 90.0, 0.0, jan),  # under 30 in all
    ]
    write(spark, tmp_path, "lineitem", rows, "l_partkey long, l_suppkey long, l_quantity double, l_extendedprice double, l_discount double, l_shipdate timestamp")
    run = entry.queries()
    got = {tuple(r) for r in run["r14_conflicts"](spark, str(tmp_path)).collect()}
    assert got == {("1 2000-01", 990, 15, 2, 11, 10, 45, "high"), ("1 2000-02", 300, 4, 2, 10, 11, 33, "high")}
    assert [tuple(r) for r in run["r14_pairs"](spark, str(tmp_path)).collect()] == [(10, 11, 2, 1290)]


def test_page_vectors_hold_the_whole_text(spark, tmp_path):
    body = "granite quarry blasting permit"
    rows = [(20, "Alpha", body), (21, None, body + " review"), (22, "Alpha", "velvet curtain"), (23, "Omega", None), (24, "Other", "copper kettle")]
    write(spark, tmp_path, "page_markdown", rows, "page_id long, title string, markdown string")
    vectors, n = {}, len(rows)
    words = {i: [w[:-1] if len(w) > 4 and w.endswith("s") else w for w in f"{t or ''} {m or ''}".lower().split()] for i, t, m in rows}
    df = {w: sum(w in x for x in words.values()) for x in words.values() for w in x}
    for i, x in words.items():
        raw = {w: (1 + np.log(x.count(w))) * np.log((n + 1) / (df[w] + 1)) for w in x}
        norm = np.sqrt(sum(v * v for v in raw.values()))
        vectors[i] = {w: v / norm for w, v in raw.items()}
    cosine = {i: sum(v * vectors[i].get(w, 0) for w, v in vectors[20].items()) for i in vectors if i != 20}
    near = [c for c in cosine.values() if c >= 0.2]
    run = entry.queries()
    assert [(r["query"], r.similar, r.best) for r in run["j17_similar_pages"](spark, str(tmp_path)).collect()] == [(20, len(near), round(float(max(near)), 5))]
    assert max(cosine, key=cosine.get) == 21  # the page without a title
    top = {(r.page_id, r.term) for r in run["x8_top_terms"](spark, str(tmp_path)).collect()}
    assert {i for i, _ in top} == {20, 21, 22, 23, 24} and (22, "velvet") in top and (21, "review") in top


def test_near_duplicates_against_all_pairs(spark, tmp_path):
    rng = random.Random(3)
    fixed = [f"f{i}" for i in range(30)]
    texts = {}
    for base in range(6):
        words = [f"w{rng.randrange(400)}" for _ in range(70)] + fixed
        for _ in range(7):
            w = list(words)
            for _ in range(rng.randrange(6)):
                w[rng.randrange(100)] = f"x{rng.randrange(1000)}"
            texts[len(texts) + 1] = " ".join(w)
    texts |= {50: texts[1], 51: "two words", 52: "Two, words!", 53: "words two", 54: "", 55: None}
    write(spark, tmp_path, "documents", list(texts.items()), "doc_id long, text string")
    sets = {}
    for i, t in texts.items():
        w = (t or "").lower().replace(",", "").replace("!", "").split()
        sets[i] = {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set()
    jaccard = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b]) if sets[a] | sets[b] else 0
    near = {i: {i} for i in texts}
    for a, b in itertools.combinations(texts, 2):
        if jaccard(a, b) >= 0.8:
            near[a].add(b)
            near[b].add(a)
    group = {i: i for i in texts}
    for _ in texts:
        group = {i: min(group[j] for j in near[i]) for i in texts}
    want = {i: (min(j for j in texts if j == i or sets[i] and sets[j] == sets[i]), group[i], len(near[i]) - 1) for i in texts}
    run = entry.queries()
    got = {r.doc_id: (r["class"], r.group, r.links) for r in run["x6_bands"](spark, str(tmp_path)).collect()}
    assert got == want and any(n > 1 for _, _, n in want.values()) and got[50][0] == 1 and got[52][0] == 51 and got[53] == (53, 53, 0)
    assert all(r.documents > 1 for r in run["r15_near_duplicates"](spark, str(tmp_path)).collect())


def test_daily_series_go_on_over_new_year(spark, tmp_path):
    first = dt.datetime(1999, 12, 10)
    clicks = [i * i % 5 for i in range(39)]
    clicks[0] = clicks[38] = 1  # the series begins and ends with a click
    write(spark, tmp_path, "orders", [(first + dt.timedelta(days=i, hours=3), 500.0) for i, n in enumerate(clicks) for _ in range(n)], "o_orderdate timestamp, o_totalprice double")
    run = entry.queries()
    rolling = [r.rolling for r in run["w5_rolling"](spark, str(tmp_path)).orderBy("date").collect()]
    assert rolling == [round(sum(clicks[max(0, i - 6) : i + 1]) / min(7, i + 1), 6) for i in range(39)]
    sums = [sum(clicks[39 - 7 * (b + 1) : 39 - 7 * b]) for b in range(5)]  # the four days left over stand at the start
    got = [(r.block, r.clicks, r.change) for r in run["w6_weekly_noise"](spark, str(tmp_path)).orderBy("block").collect()]
    assert got == [(b, sums[b], round((sums[b] - sums[b + 1]) / sums[b + 1], 6) if b < 4 else None) for b in range(5)]


def test_deep_nodes_and_long_chains(spark):
    chain = [(f"n{i}", f"n{i + 1}") for i in range(54)]
    e = spark.createDataFrame(chain, "src string, dst string")
    assert {r.id: r.depth for r in graph.depths(e, spark.createDataFrame([("n0",)], "id string")).collect()} == {f"n{i}": i for i in range(55)}
    loops = [("tail", "x"), ("x", "y"), ("y", "z"), ("z", "x"), ("own", "own")]
    got = {r.src: (r.target, r.hops, r.loop) for r in graph.redirect_ends(spark.createDataFrame(chain + loops, "src string, dst string")).collect()}
    assert all(got[f"n{i}"] == ("n54", 54 - i, False) for i in range(54))
    assert all(got[s][1:] == (None, True) for s in ("tail", "x", "y", "z", "own")) and len(got) == 59
    assert graph.redirect_ends(spark.createDataFrame([], "src string, dst string")).count() == 0
