"""Hashes, differences of lines, exports, selectors, hints, the CSV of changes."""

import random

from pyspark.sql import functions as F

from almena.functions.hashing import fmix32, fnv1a, line_changes, line_diff
from almena.sources import dom, exports, sinks


def test_hashes(spark):
    # published test values of FNV-1a; fmix32 leaves 0 and is a bijection
    df = spark.createDataFrame([("",), ("a",), ("foobar",), (None,)], "t string").select(fnv1a(F.col("t")).alias("h"))
    assert [r.h for r in df.collect()] == [0x811C9DC5, 0xE40C292C, 0xBF9CF968, None]
    mixed = [r.m for r in spark.createDataFrame([(0,), (1,), (0xFFFFFFFF,), (None,)], "h long").select(fmix32(F.col("h")).alias("m")).collect()]
    assert mixed == [0, 0x514E28B7, 0x81F16F39, None]


def test_line_changes(spark):
    assert line_changes(["a", "b", "c"], ["a", "x", "c"]) == [("same", "a"), ("removed", "b"), ("added", "x"), ("same", "c")]
    rng = random.Random(1)
    for _ in range(60):
        a, b = ([rng.choice("abc") for _ in range(rng.randrange(9))] for _ in range(2))
        got = line_changes(a, b)
        assert [x for c, x in got if c != "added"] == a and [x for c, x in got if c != "removed"] == b
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        assert sum(c == "same" for c, _ in got) == best[-1][-1]
    rows = line_diff(spark.createDataFrame([(1, "a\nb", "a"), (2, None, "x"), (3, None, None)], "id int, b string, a string"), "id", "b", "a").collect()
    assert [(r.id, r.change, r.line) for r in rows] == [(1, "same", "a"), (1, "removed", "b"), (2, "added", "x")]


def test_exports(spark):
    s = spark.createDataFrame([("i1", '{"rows":[{"keys":["q","/p"],"clicks":3,"impressions":9,"ctr":0.333,"position":2.5},{"keys":["r"],"clicks":1,"impressions":2}]}'), ("i2", "{}"), ("i3", None)], "import_id string, json string")
    assert [tuple(r) for r in exports.search_export(s, ["query", "page"]).collect()] == [("i1", "q", "/p", 3, 9, 0.333, 2.5), ("i1", "r", None, 1, 2, None, None)]
    v = spark.createDataFrame([('{"dimensionHeaders":[{"name":"landingPage"}],"metricHeaders":[{"name":"users"},{"name":"sessions"}],"rows":[{"dimensionValues":[{"value":"/a"}],"metricValues":[{"value":"2"},{"value":"5"}]}]}',)], "json string")
    assert exports.visit_export(v, {"page": "landingPage", "sessions": "sessions:number", "revenue": "totalRevenue:number"}).first().asDict() == {"page": "/a", "sessions": 5.0, "revenue": None}
    known = spark.createDataFrame([(f"2026-{m:02d}-01",) for m in range(1, 10)], "m string").select(F.col("m").cast("date").alias("month"))
    assert [str(r.month) for r in exports.months_to_fetch(known, "2026-10-16", 10).collect()] == ["2026-09-01", "2026-08-01", "2025-12-01"]


PAGE = '<title>T</title><body><div id="x" class="a b"><p class="c">uno</p><p>dos <a href="/q" rel="nofollow me">tres</a></p></div><p class="c">$1,200 MXN al +52 55 1234 5678 o a ana@b.example</p><h2>¿Uno?</h2><h2>¿Dos?</h2></body>'


def test_selectors_and_hints(spark):
    root = dom.parse(PAGE)
    texts = lambda s: [dom.clean(n.text()) for n in dom.select(root, s)]
    assert texts(".c") == ["uno", "$1,200 MXN al +52 55 1234 5678 o a ana@b.example"] and texts("div#x.a p.c, h2") == ["uno", "¿Uno?", "¿Dos?"] and texts("div a[rel~=me]") == texts('a[href^="/q"]') == ["tres"] and texts("body h1") == []
    df = spark.createDataFrame([("https://a.example/shop/x", PAGE), ("https://a.example/", None)], "url string, html string")
    assert dom.extracted(df, "a", attribute="href").first()["values"] == ["/q"] and dom.extracted(df, pattern=r"<h2>(.)", most=1).first().asDict() == {"url": "https://a.example/shop/x", "values": ["¿"], "found": 2}
    got = {r.url: (r.type, r.properties) for r in dom.schema_hints(df).collect()}
    assert got["https://a.example/shop/x"] == ("FAQPage", {"name": "T", "url": "https://a.example/shop/x", "price": "1,200", "telephone": "+52 55 1234 5678", "email": "ana@b.example"}) and got["https://a.example/"][0] == "WebSite"


def test_diff_csv(spark, tmp_path):
    sinks.write_diff_csv(spark.createDataFrame([("=u", ["a", "b"], 'say "x"'), ("v", None, None)], "url string, urls array<string>, note string"), str(tmp_path / "d"))
    text = next((tmp_path / "d").glob("part-*")).read_bytes().decode()
    assert text == '﻿url,urls,note\n"\'=u","a | b","say ""x"""\n"v","",""\n'
