"""Relational, graph, similarity, crawl and streaming operators on planted data."""

import datetime as dt
import itertools
import math
import random

from pyspark.sql import functions as F

from almena.functions.text import to_words
from almena.operators import crawl, graph, relational, similarity
from almena.streaming.log_stream import hits_per_window, run_to_table, stream_entries, visits

D = dt.date


def test_top_and_latest(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 3, "y"), ("b", 2, "z"), ("a", None, "n")], "k string, v int, w string")
    assert {tuple(r) for r in relational.latest(df, ["k"], "v").select("k", "v", "w").collect()} == {("a", 3, "y"), ("b", 2, "z")}
    assert {r.w for r in relational.top_per(df, ["k"], 1, F.desc_nulls_last("v")).collect()} == {"y", "z"}
    assert [r.v for r in relational.top(df.filter("v > 0"), 2, F.desc("v"), F.col("k")).collect()] == [3, 2]


def test_as_of(spark):
    days = spark.createDataFrame([("a", D(2026, 1, 1)), ("a", D(2026, 1, 20)), ("a", D(2026, 2, 1)), ("b", D(2026, 1, 1)), ("c", D(2026, 1, 1)), ("c", D(2026, 1, 3))], "k string, day date")
    got = {r.k: r.reference_day for r in relational.as_of_gap(days, ["k"], "day", 21).collect()}
    assert got == {"a": D(2026, 1, 1), "b": None, "c": D(2026, 1, 1)}
    assert {r.k: r.reference_day for r in relational.as_of_gap(days, ["k"], "day", 21, False).collect()}["c"] is None


def test_intervals_and_calendar(spark):
    points = spark.createDataFrame([(D(2026, 1, d),) for d in range(1, 31)], "day date")
    spans = spark.createDataFrame([("x", D(2026, 1, 3), D(2026, 1, 20)), ("y", D(2026, 1, 20), D(2026, 1, 20))], "name string, a date, b date")
    assert {r["name"]: r["count"] for r in relational.within_intervals(points, spans, "day", "a", "b").groupBy("name").count().collect()} == {"x": 18, "y": 1}
    gaps = spark.createDataFrame([("k", D(2026, 1, 1), 5), ("k", D(2026, 1, 4), 7)], "k string, day date, v int")
    assert [r.v for r in relational.every_day(gaps, ["k"], "day", ["v"]).orderBy("day").collect()] == [5, 0, 0, 7]
    months = spark.range(1).select(relational.complete_months(F.lit(D(2026, 10, 16)), 3).alias("a"), relational.complete_months(F.lit(D(2026, 9, 30)), 2).alias("b")).first()
    assert months.a == [D(2026, 9, 1), D(2026, 8, 1), D(2026, 7, 1)] and months.b == [D(2026, 9, 1), D(2026, 8, 1)]


def test_states_streaks_profiles(spark):
    found = spark.createDataFrame([("a",), ("b",), ("c",)], "issue string")
    stored = spark.createDataFrame([("b", True), ("c", False), ("d", True), ("e", False)], "issue string, open boolean")
    assert {tuple(r) for r in relational.state_changes(found, stored, "issue").collect()} == {("a", "new"), ("b", "open"), ("c", "reopened"), ("d", "resolved")}
    series = spark.createDataFrame([("p", m, v) for m, v in enumerate([9, 5, 7, 6, 4, 2])] + [("q", 0, 1), ("q", 1, 2)], "k string, m int, v int")
    assert {r.k: r.streak for r in relational.falling_streak(series, ["k"], "m", "v").collect()} == {"p": 3, "q": 0}
    data = spark.createDataFrame([("1,5", "sí", "https://x", "2026-01-01", ""), ("2", "no", "https://y", "2026-01-02", None)], "a string, b string, c string, d string, e string")
    assert {r.column: r.type for r in relational.profile_columns(data).collect()} == {"a": "number", "b": "boolean", "c": "url", "d": "date", "e": "text"}
    tree = relational.folder_tree(spark.createDataFrame([("/a/b",), ("/a/",), ("/",)], "p string"), F.col("p"), {"n": F.count("*")})
    assert {r.folder: r.n for r in tree.collect()} == {"/": 3, "/a/": 2}


def test_pagerank_and_depths(spark):
    edges = [("/", "a"), ("a", "/"), ("b", "/"), ("a", "b"), ("/", "/"), ("a", "b")]
    nodes = [("/",), ("a",), ("b",), ("orphan",)]
    e, n = spark.createDataFrame(edges, "src string, dst string"), spark.createDataFrame(nodes, "id string")
    rows = {r.id: r for r in graph.pagerank(n, e).collect()}
    assert abs(sum(r["rank"] for r in rows.values()) - 1) < 1e-9 and rows["/"].score == 100 and rows["orphan"].score < rows["a"].score
    again = {r.id: r["rank"] for r in graph.pagerank(n.repartition(7), e.repartition(5)).collect()}
    assert all(abs(again[k] - rows[k]["rank"]) < 1e-9 for k in again)
    assert graph.pagerank(n.limit(0), e.limit(0)).count() == 0
    assert {r.id: r.depth for r in graph.depths(e, spark.createDataFrame([("b",)], "id string")).collect()} == {"b": 0, "/": 1, "a": 2}


def test_components_against_union_find(spark):
    random.seed(2)
    edges = [(random.randrange(60), random.randrange(60)) for _ in range(40)] + [(i, i + 1) for i in range(100, 160)]
    parent = {}
    find = lambda x: x if parent.setdefault(x, x) == x else find(parent[x])
    for a, b in edges:
        if a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    got = {r.id: r.component for r in graph.components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    low = {}
    for x in got:
        low[find(x)] = min(low.get(find(x), x), x)
    assert got == {x: low[find(x)] for x in got}


def test_redirect_ends(spark):
    r = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("x", "y"), ("y", "x"), (None, "q")], "src string, dst string")
    assert {(x.src, x.target, x.hops, x.loop) for x in graph.redirect_ends(r).collect() if not x.loop} == {("a", "d", 3, False), ("b", "d", 2, False), ("c", "d", 1, False)}
    assert {x.src for x in graph.redirect_ends(r).collect() if x.loop} == {"x", "y"}


def test_tfidf_and_cosine(spark):
    docs = spark.createDataFrame([(1, "sillas ergonomicas para oficina"), (2, "silla ergonomica barata"), (3, "recetas faciles de cocina"), (4, None)], "id long, t string")
    v = similarity.tfidf(docs, "id", "t").cache()
    assert all(abs(r["s"] - 1) < 1e-9 for r in v.groupBy("id").agg(F.sum(F.col("weight") * F.col("weight")).alias("s")).collect())
    got = {r.id: r.cosine for r in similarity.cosine_to_queries(v, v.filter("id = 1"), "id", 0.01).collect()}
    assert set(got) == {2}


def test_signatures(spark):
    base = [f"w{i}" for i in range(200)]
    texts = [(1, " ".join(base)), (2, " ".join(base[:195] + ["x"] * 5)), (3, " ".join(f"v{i}" for i in range(200))), (4, ""), (5, None)]
    words = spark.createDataFrame(texts, "id long, t string").select("id", to_words(F.col("t")).alias("w"))
    h = {r.id: r.h for r in words.select("id", similarity.simhash(F.col("w")).alias("h")).collect()}
    far = lambda a, b: bin((h[a] ^ h[b]) & (2**64 - 1)).count("1")
    assert far(1, 2) < 12 < 15 < far(1, 3)
    m = similarity.minhash(words, "id", "w")
    s = {r.id: r.signature for r in m.collect()}
    same = sum(a == b for a, b in zip(s[1], s[2])) / 64
    sets = [{tuple(t.split()[i : i + 5]) for i in range(196)} for _, t in texts[:2]]
    exact = len(sets[0] & sets[1]) / len(sets[0] | sets[1])
    assert abs(same - exact) < 0.15 and s[4] is None and s[5] is None
    b = similarity.banded(m, "id").groupBy("band", "bucket").agg(F.collect_set("id").alias("ids")).filter("size(ids) > 1").collect()
    assert b and all(set(x.ids) == {1, 2} for x in b)


FIELDS = "crawl_run_id long, url string, final_url string, status_code int, response_time_ms int, title string, canonical string, h1 string, is_indexable boolean, indexability_reason string, word_count int, inlinks int, blocked_by_robots boolean, schema_types array<string>, fetched_at timestamp"


def page(run, url, **kw):
    base = dict(final_url=url, status_code=200, response_time_ms=100, title="T", canonical=url, h1="H", is_indexable=True, indexability_reason=None, word_count=400, inlinks=1, blocked_by_robots=False, schema_types=["Article"], fetched_at=dt.datetime(2026, 1, run))
    base.update(kw)
    return (run, url, *base.values())


def test_differences_and_alerts(spark):
    before = [page(1, u) for u in "abcdfg"] + [page(1, "e", status_code=500, is_indexable=False, indexability_reason="status 500"), page(1, "h")]
    after = [
        page(2, "a", is_indexable=False, indexability_reason="noindex"), page(2, "b", is_indexable=False, indexability_reason="canonicalised", canonical="z"), page(2, "c", status_code=404, is_indexable=False, indexability_reason="status 404"),
        page(2, "d", word_count=100, schema_types=None, title="U"), page(2, "e"), page(2, "new"), page(2, "f", status_code=0, blocked_by_robots=True, is_indexable=False, indexability_reason="blocked"),
        page(2, "h", final_url="i", status_code=301, is_indexable=False, indexability_reason="redirect"), page(2, "h", status_code=500, fetched_at=dt.datetime(2025, 1, 1)),
    ]
    view = crawl.page_view(spark.createDataFrame(before + after, FIELDS)).cache()
    runs = lambda status: spark.createDataFrame([(1, None, "completed"), (2, 1, status)], "crawl_run_id long, base_run_id long, run_status string")
    got = {}
    for r in crawl.differences(view, runs("completed")).collect():
        got.setdefault(r.url, set()).add(r.change)
    assert got == {
        "a": {"NOINDEX_ADDED"}, "b": {"BECAME_NON_INDEXABLE", "CANONICAL_CHANGED"}, "c": {"PAGE_BROKEN"}, "d": {"CONTENT_SHRUNK", "SCHEMA_REMOVED", "TITLE_CHANGED"}, "e": {"BECAME_INDEXABLE", "PAGE_RECOVERED"}, "new": {"PAGE_ADDED"},
        "g": {"PAGE_REMOVED"}, "f": {"ROBOTS_BLOCKED_NEW"}, "h": {"STATUS_CHANGED", "BECAME_NON_INDEXABLE", "REDIRECT_ADDED"},
    }
    cut = crawl.differences(view, runs("cancelled"))
    assert cut.filter("change = 'PAGE_REMOVED'").isEmpty()
    alerts = {r.alert: r.urls for r in crawl.alerts(crawl.differences(view, runs("completed")), view).collect()}
    assert alerts["NOINDEX_ADDED"] == 1 and alerts["BECAME_NON_INDEXABLE"] == 2 and "MASS_TITLE_CHANGE" not in alerts


def test_audit_and_explorer(spark):
    pages = [page(1, "https://a.example/x", title="Same"), page(1, "https://a.example/y", title="same "), page(1, "https://a.example/z?p=1", title="", canonical="https://b.example/"), page(1, "https://a.example/e", status_code=503, is_indexable=False), page(1, "https://a.example/t", title=None, word_count=10, schema_types=None, h1=None, response_time_ms=2000)]
    view = crawl.page_view(spark.createDataFrame(pages, FIELDS)).cache()
    hits = {(r.code, r.url[-1]) for r in crawl.audit(view).collect()}
    assert {("TITLE_DUPLICATE", "x"), ("TITLE_DUPLICATE", "y"), ("HTTP_5XX", "e"), ("CANONICAL_CROSS_HOST", "1"), ("PARAMETER_URLS_INDEXABLE", "1"), ("TITLE_MISSING", "1"), ("TITLE_MISSING", "t"), ("CONTENT_THIN", "t"), ("SLOW_RESPONSE", "t"), ("H1_MISSING", "t"), ("SCHEMA_MISSING", "t")} <= hits
    counts = {r["filter"]: r.pages for r in crawl.explorer_counts(view).collect()}
    assert counts["titles_missing"] == 2 and counts["response_5xx"] == 1 and counts["internal_all"] == 5
    assert [r.url[-1] for r in crawl.explorer(view, "internal_html", search="same", sort="title").collect()] == ["x", "y"]
    assert crawl.custom_search(view, "title", "regex", "[Ss]ame").count() == 2 and crawl.custom_search(view, "title", "not_contains", "Same").count() == 4
    assert crawl.audit(view.limit(0)).isEmpty() and crawl.explorer_counts(view.limit(0)).isEmpty()


def test_streams(spark, tmp_path):
    t = dt.datetime(2026, 1, 1, 10)
    rows = [(i, "s", "GPTBot" if i % 2 else None, t + dt.timedelta(minutes=17 * i), 10) for i in range(40)]
    df = spark.createDataFrame(rows + rows[:5], "log_id long, site_id string, bot_name string, ts timestamp_ntz, size_bytes long")
    df.write.parquet(str(tmp_path / "log"))
    out = run_to_table(hits_per_window(stream_entries(spark, str(tmp_path / "log")), "1 hour"), "t").collect()
    assert sum(r.hits for r in out) == 40
    want = {}
    for _, _, bot, when, _ in rows:
        k = (when.replace(minute=0), bot)
        want[k] = want.get(k, 0) + 1
    assert {(r.begin, r.bot_name): r.hits for r in out} == want
    batch = visits(df.withColumn("ts", F.col("ts").cast("timestamp")), "20 minutes")
    assert batch.filter("bot_name = 'GPTBot'").count() == 20


def test_jaccard_estimate_is_close_on_random_sets(spark):
    random.seed(5)
    rows = [(i, [f"w{random.randrange(40)}" for _ in range(60)]) for i in range(6)]
    s = {r.id: r.signature for r in similarity.minhash(spark.createDataFrame(rows, "id long, w array<string>"), "id", "w", size=256, k=1).collect()}
    for (i, a), (j, b) in itertools.combinations(rows, 2):
        exact = len(set(a) & set(b)) / len(set(a) | set(b))
        assert math.isclose(sum(x == y for x, y in zip(s[i], s[j])) / 256, exact, abs_tol=0.15)


def test_cosine_totals_are_those_of_the_vectors(spark, monkeypatch):
    """Blocks, passes, terms looked up and joined vectors give the totals of the pairs; no pairs are exchanged."""
    rng = random.Random(5)
    names = ["".join(rng.choices("bcdfgmnrt", k=6)) for _ in range(300)]
    rows = [(i, " ".join(rng.choice(names[: rng.choice([20, 300])]) for _ in range(rng.randrange(40)))) for i in range(90)] + [(90, None), (91, "alone"), (None, names[0])]
    docs = spark.createDataFrame(rows, "id long, t string")
    v = similarity.tfidf(docs, "id", "t").cache()
    pairs = similarity.cosine_to_queries(v, v.filter("id % 3 = 0"), "id", 0.2)
    want = {r["query"]: (r.n, round(r.best, 9)) for r in pairs.groupBy("query").agg(F.count("*").alias("n"), F.max("cosine").alias("best")).collect()}
    for more in ({}, {"AT_ONCE": 7, "QUERIES_AT_ONCE": 10}, {"DENSE": 2}, {"VOCABULARY": 5}):
        with monkeypatch.context() as m:
            for name, value in more.items():
                m.setattr(similarity, name, value)
            got = {r["query"]: (r.similar, round(r.best, 9)) for r in similarity.cosine_totals(docs, "id", "t", F.col("id") % 3 == 0, 0.2).collect()}
        assert got == want and len(want) > 20
    assert similarity.cosine_totals(docs.filter("id < 0"), "id", "t", F.col("id") % 3 == 0, 0.2).count() == 0


def test_sharing_pairs_meet_on_choices(spark):
    rng = random.Random(2)
    sets = {i: sorted(rng.sample([f"b{n:02}" for n in range(14)], rng.choice([3, 7, 8, 9, 10, 10]))) for i in range(120)} | {500: [f"b{n:02}" for n in range(8)], 501: [f"b{n:02}" for n in range(8)], 502: [], 503: None}
    df = spark.createDataFrame([*sets.items(), (None, sets[500])], "k long, v array<string>")
    shared = {(a, b): len(set(sets[a] or ()) & set(sets[b] or ())) for a, b in itertools.combinations(sorted(sets), 2)}
    got = [tuple(r) for r in relational.sharing_pairs(df, "k", "v", 10, 8).collect()]
    assert len(got) == len(set(got)) and set(got) == {(a, b, n) for (a, b), n in shared.items() if n >= 8} and (500, 501, 8) in got
    many = df.select(F.size(relational._choices(F.array_sort("v"), 10, 8)).alias("n"), F.size("v").alias("of")).distinct().collect()
    assert {r.of: r.n for r in many if (r.of or 0) > 7} == {8: 1, 9: 9, 10: 45} and all(r.n == 0 for r in many if r.of is not None and r.of < 8)


def test_near_duplicates_in_small_blocks_send_few_rows(spark, monkeypatch):
    """Many chunks, tasks and blocks, and joins instead of broadcasts, give the pairs of all texts; sequences that occur once are not sent."""
    rng = random.Random(4)
    texts = []
    for _ in range(8):
        base = [f"w{rng.randrange(500)}" for _ in range(rng.choice([3, 40, 90]))]
        for _ in range(6):
            w = list(base)
            for _ in range(rng.randrange(4)):
                w[rng.randrange(len(w))] = f"x{rng.randrange(9)}"
            texts.append(w)
    texts += [texts[0], [], None, ["only"]]
    df = spark.createDataFrame([(f"u{i:03}", w) for i, w in enumerate(texts)], "url string, w array<string>")
    sets = {f"u{i:03}": {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} for i, w in enumerate(texts) if w}
    near = {(a, b) for a, b in itertools.combinations(sorted(sets), 2) if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.7}
    links = {f"u{i:03}": sum(f"u{i:03}" in p for p in near) for i in range(len(texts))}
    for more in ({}, {"RARITY_SLOTS": 64, "CHUNK": 16}, {"COUNTED_AT_ONCE": 50, "MET_AT_ONCE": 20, "PAIRS_AT_ONCE": 5}, {"BROADCAST_KEYS": 0, "BROADCAST_SKETCHES": 0}):
        with monkeypatch.context() as m:
            for name, value in more.items():
                m.setattr(similarity, name, value)
            assert {r.url: r.links for r in similarity.near_duplicates(df, "url", "w", 0.7).collect()} == links
    alone = spark.createDataFrame([(i, [f"{i}a{j}" for j in range(50)]) for i in range(40)], "id long, w array<string>")
    packed = similarity.packed_sets(alone, "id", "w").cache()
    assert similarity._rarity(packed.filter("chunk IS NOT NULL").select("chunk", "packed")).max() == 0 and packed.filter("size = 46").count() == 40
