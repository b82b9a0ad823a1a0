"""Search, traffic, results-page and link reports on planted rows."""

import datetime as dt

from pyspark.sql import functions as F

from almena.operators import search as s

ROWS = "site_id string, query string, page string, clicks long, impressions long, position double"


def test_conflicts(spark):
    rows = [
        ("s", "Mesa  plegable", "/mesas", 20, 300, 4.0), ("s", "mesa plegáble", "/mesa-1", 5, 180, 9.0), ("s", "mesa plegable", "/blog", 0, 20, 30.0), ("s", "mesas", "/mesas", 9, 100, 3.0), ("s", "mesas", "/mesa-1", 1, 30, 18.0),
        ("s", "solo", "/mesas", 1, 500, 1.0), ("s", "poco", "/a", 1, 12, 1.0), ("s", "poco", "/b", 1, 12, 1.0),
    ]
    found, pairs = s.conflicts(spark.createDataFrame(rows, ROWS))
    got = {r["query"]: (r.impressions, r.clicks, r.pages, r.winner, r.runner_up, r.share, r.severity) for r in found.collect()}
    assert got == {"mesa plegable": (500, 25, 2, "/mesas", "/mesa-1", 36, "high"), "mesas": (130, 10, 2, "/mesas", "/mesa-1", 23, "medium")}
    assert [tuple(r) for r in pairs.collect()] == [("/mesa-1", "/mesas", 2, 630)]


def test_declining(spark):
    months = [f"{y}-{m:02d}" for y in (2025, 2026) for m in range(1, 13)][:15]
    clicks = {"/falls": [100] * 9 + [120, 110, 100, 90, 60, 30], "/season": [50, 40, 30] + [100] * 9 + [50, 40, 30], "/flat": [100] * 15, "/few": [9] * 12 + [1] * 3}
    rows = [(p, m, c, c * 10, 5.0 if i < 12 or p != "/falls" else 8.0) for p, series in clicks.items() for i, (m, c) in enumerate(zip(months, series))]
    df = spark.createDataFrame(rows, "page string, month string, clicks long, impressions long, position double")
    got = {r.page: r for r in s.declining(df).collect()}
    assert set(got) == {"/falls", "/season"}
    f = got["/falls"]
    assert (f.before, f.after, f.lost, f["drop"], f.streak, f.seasonal, f.year_ago, f.reasons) == (330, 180, 150, 45, 5, False, 300, ["position"])
    assert got["/season"].seasonal and got["/season"].reasons == ["demand"] and s.declining(df.filter("month < '2025-04'")).count() == 0
    two = spark.createDataFrame([("https://a.example/x", m, 50, 100, 1.0) for m in months] + [("https://a.example/x/", m, 50 if i < 12 else 0, 100, 1.0) for i, m in enumerate(months)], df.schema)
    assert [(r.before, r.after) for r in s.declining(two).collect()] == [(300, 150)]


def test_topics(spark):
    rows = [("s", q, p, c, i, pos) for q, p, c, i, pos in (
        ("recetas de arroz", "/arroz", 50, 900, 3.0), ("receta arroz fácil", "/arroz", 9, 200, 6.0), ("arroz recetas rápidas", "/arroz", 1, 100, 5.0), ("sillas oficina", "/a", 5, 300, 8.0), ("silla de oficina barata", "/b", 1, 290, 9.0), ("curso yoga", "/y", 0, 200, 45.0), ("nada", "/z", 0, 3, 1.0),
    )]
    got = {r.topic: (r.queries, r.target, r.target_share, r.status, r.pages) for r in s.topics(spark.createDataFrame(rows, ROWS)).collect()}
    assert got == {"recetas de arroz": (3, "/arroz", 100, "clear", 1), "sillas oficina": (2, "/a", 51, "scattered", 2), "curso yoga": (1, "/y", 100, "no_strong_page", 1)}
    assert s.topic_tokens("¿Cómo hacer las mejores TÁPAS de los martes?") == ["hacer", "tapa", "mart"] and s.topics(spark.createDataFrame([], ROWS)).count() == 0


VISITS = "page string, source string, sessions long, users long, engaged_sessions long, engagement_sec double, key_events double, revenue double"


def test_visits(spark):
    assert [r.e for r in spark.createDataFrame([("chatgpt.com",), (" Chat.OpenAI.com ",), ("www.perplexity.ai",), ("notyou.com",), ("you.com",), ("google",), (None,)], "x string").select(s.engine_of(F.col("x")).alias("e")).collect()] == ["ChatGPT", "ChatGPT", "Perplexity", None, "You.com", None, None]
    rows = spark.createDataFrame([("/guia", "google", 100, 80, 15, 900.0, 2.0, 10.5), ("guia2", "google", 10, 9, 1, 5.0, 0.0, 0.0), ("https://o.example/x", "bing", 50, 40, 30, 100.0, 1.0, 0.0)], VISITS)
    search = spark.createDataFrame([("https://o.example/guia/", 7, 70, 3.26)], "page string, clicks long, impressions long, position double")
    pages = s.landing_pages(rows, "https://o.example", search, spark.createDataFrame([("https://o.example/guia", "Guía")], "url string, title string"))
    by = {r.page: r for r in pages.collect()}
    g = by["/guia"]
    assert (g.url, g.engagement_rate, g.engagement_sec, g.conversion_rate, g.clicks, g.position, g.title) == ("https://o.example/guia", 15.0, 9, 2.0, 7, 3.3, "Guía") and by["guia2"].url == "https://o.example/guia2" and by["guia2"].clicks is None
    assert [r.page for r in s.low_engagement(pages).collect()] == ["/guia"]
    ai = spark.createDataFrame([("/a", "chatgpt.com", 5, 5, 5, 5.0, 0.0, 0.0), ("/a", "claude.ai", 9, 5, 4, 5.0, 1.0, 0.0), ("/a", "chat.openai.com", 1, 1, 0, 0.0, 0.0, 0.0), ("/b", "odd", 1, 1, 1, 1.0, 1.0, 1.0)], VISITS)
    assert {r.page: (r.sessions, r.engines) for r in s.engine_pages(ai).collect()} == {"/a": (15, ["Claude:9", "ChatGPT:6"]), "/b": (1, ["odd:1"])}


def test_results_pages(spark):
    d = dt.date
    snaps = spark.createDataFrame([("k", d(2026, 1, 1), 3, ["ads"]), ("k", d(2026, 1, 20), 3, ["ads", "videos"]), ("k", d(2026, 2, 12), 4, ["ai_overview", "videos"]), ("one", d(2026, 2, 1), None, None), ("near", d(2026, 2, 1), 1, []), ("near", d(2026, 2, 9), 1, ["ads"])], "keyword string, date date, position int, features array<string>")
    got = {r.keyword: (r.last_date, r.reference_date, r.added, r.removed) for r in s.serp_changes(snaps).collect()}
    assert got == {"k": (d(2026, 2, 12), d(2026, 1, 20), ["ai_overview"], ["ads"]), "one": (d(2026, 2, 1), None, [], []), "near": (d(2026, 2, 9), d(2026, 2, 1), ["ads"], [])}
    days = [("K ", d(2026, 2, 28) - dt.timedelta(i), 5 if i < 28 else 10, 100, 3.0) for i in range(56)] + [("near", d(2026, 2, 28) - dt.timedelta(i), 1 if i < 28 else 9, 100, 9.0 if i < 28 else 2.0) for i in range(56)]
    why = {r.keyword: (r.click_change, r.cause) for r in s.serp_insights(s.serp_changes(snaps), spark.createDataFrame(days, "query string, date date, clicks long, impressions long, position double")).collect()}
    assert why == {"k": (-50, "new_blocks"), "one": (None, None), "near": (-89, "position")}
    share = {r.feature: r.share for r in s.feature_share(s.serp_changes(snaps), snaps).collect()}
    assert share == {"ads": 33, "ai_overview": 33, "videos": 33}


def test_gaps(spark):
    urls = lambda k, us: [(k, i, u) for i, u in enumerate(us, 1)]
    shared = ["https://c1.example/g", "https://x.example/1", "https://x.example/2", "https://x.example/3"]
    rows = urls("uno", shared) + urls("dos", shared[1:] + ["https://blog.c1.example/h"]) + urls("tres", ["https://me.example/a", "https://c2.example/b"]) + urls("cuatro", ["https://c2.example/b", "https://me.example/a"]) + urls("cinco", ["https://z.example/"]) + urls("seis", ["https://sub.me.example/"])
    search = spark.createDataFrame([("DOS", 12.0, 5)], "query string, position double, impressions long")
    found = s.gaps(spark.createDataFrame(rows, "keyword string, position int, url string"), "me.example", ["c1.example", "c2.example"], search)
    got = {r.keyword: (r.kind, r.score, r.own_position, r.competitors) for r in found.collect()}
    assert got == {"uno": ("missing", 10, None, {"c1.example": 1}), "dos": ("weak", 7, None, {"c1.example": 4}), "tres": ("win", 9, 1, {"c2.example": 2}), "cuatro": ("weak", 10, 2, {"c2.example": 1}), "cinco": ("none", 0, None, None), "seis": ("win", 0, 1, None)}
    assert {(r.keyword, r.lead) for r in s.gap_clusters(found).collect()} == {("cuatro", "cuatro"), ("uno", "uno"), ("dos", "uno")}
    assert {r.domain: (r.top10, r.gaps, r.position) for r in s.competitor_summary(found).collect()} == {"c1.example": (2, 2, 2.5), "c2.example": (2, 1, 1.5)}


LINKS = "source_url string, source_domain string, target_url string, anchor string, status string, rel string, target_status int, target_hops int, spam int"


def test_backlinks(spark):
    rows = spark.createDataFrame([("https://cheap-pills-a-b.xyz/", None, 200), ("https://foro1234.example/p", "leer casino aquí", 3), ("https://ok.example", "betis", None), ("no url", None, None)], "u string, a string, n int")
    assert [r.x for r in rows.select(s.spam_score(F.col("u"), F.col("a"), F.col("n")).alias("x")).collect()] == [100, 55, 0, 0]
    links = spark.createDataFrame([
        ("https://a.example/1", "a.example", "https://me.example/x/", "Hola", "live", "follow", 404, 0, 0), ("https://a.example/2", "a.example", "https://me.example/x", "hola", "live", "nofollow,ugc", 404, 0, 50), ("https://b.example/", "b.example", "https://me.example/", None, "live", "follow", 200, 1, 0), ("https://c.example/", "c.example", None, "z", "lost", None, None, None, 40),
    ], LINKS)
    assert s.backlink_totals(links).first().asDict() == {"links": 4, "domains": 3, "live": 3, "lost": 1, "follow": 2, "nofollow": 1, "sponsored": 0, "ugc": 1, "to_broken": 2, "to_redirect": 1, "suspicious": 2}
    assert [tuple(r) for r in s.rescue(links).collect()] == [("https://me.example/x", 2, 1, 1)] and {r.anchor: r.links for r in s.backlink_anchors(links).collect()} == {"hola": 2, "(empty)": 1}
    assert {r.source_domain: (r.links, r.live, r.follow, r.spam) for r in s.backlink_domains(links).collect()} == {"a.example": (2, 2, 1, 50), "b.example": (1, 1, 1, 0), "c.example": (1, 0, 0, 40)}
    crawl = spark.createDataFrame([("https://me.example/x", 301)], "url string, status_code int")
    assert {r.source_url[-1]: r.target_status for r in s.target_status(links, crawl).collect()} == {"1": 301, "2": 301, "/": None}


def test_consolidation(spark):
    pairs = spark.createDataFrame([("/b", "/a", "conflict"), ("/a", "/b", "text"), ("/c", "/long", "text"), ("/x", "/yy", "text")], "page_a string, page_b string, source string")
    stats = spark.createDataFrame([("/a", 1, 9), ("/b", 2, 0), ("/c", 0, 1), ("/long", 0, 3)], "page string, clicks int, inlinks int")
    assert {(r.page_a, r.page_b, tuple(r.sources), r.keep) for r in s.consolidation(pairs, stats).collect()} == {("/a", "/b", ("conflict", "text"), "/b"), ("/c", "/long", ("text",), "/long"), ("/x", "/yy", ("text",), "/x")}
    assert spark.range(1).select(s.title_similarity(F.lit("Mesa plegable roja"), F.lit("mesas: plegable, ROJA")).alias("x")).first().x == 0.5
