"""Readers and writers on small files."""

import datetime as dt
import gzip
import hashlib

import pytest
from pyspark.sql import functions as F

from almena.sources import files, logs, sinks

DESKTOP = '198.51.100.40 - - [29/Feb/2028:23:59:07 -0330] "GET /tienda/botas?talla=41&apikey=k9&pagina=2 HTTP/2.0" 206 731 "https://www.perplexity.ai/" "Mozilla/5.0 (compatible; Googlebot/2.1)" 1.5'
PERSON = '2001:db8::9 ident maria [01/Jul/2027:06:00:00 +0545] "POST /buscar HTTP/1.1" 503 - "-" "curl/8.6"'


def test_log_lines(spark):
    broken = "from 192.0.2.77 and fe80:1:2::3 asked ?user=eva&x=1"
    rows = logs.parse_lines(spark.createDataFrame([(x,) for x in (DESKTOP, PERSON, broken, "  ", PERSON.replace("Jul", "Xul"))], "value string"), "s").collect()
    a, b, c, d, e = rows
    assert a.ok and a.ts == dt.datetime(2028, 3, 1, 3, 29, 7) and a.path == "/tienda/botas" and a.url == "/tienda/botas?talla=41&apikey=%5BREDACTED%5D&pagina=2"
    assert (a.response_ms, a.size_bytes, a.status_code, a.protocol, a.bot_name) == (1500, 731, 206, "HTTP/2.0", "Googlebot Desktop")
    assert b.ok and b.ts == dt.datetime(2027, 7, 1, 0, 15) and b.method == "POST" and b.size_bytes == 0 and b.response_ms is None and b.ip_hash != a.ip_hash
    assert c.ok is False and c.sample == "from [ip] and [ip] asked ?user=[REDACTED]&x=1" and d.ok is None and e.ok is False


def test_gzip_by_content(spark, tmp_path):
    (tmp_path / "plain.log").write_text(DESKTOP + "\r\n" + PERSON + "\n")
    (tmp_path / "packed.txt").write_bytes(gzip.compress((DESKTOP + "\n").encode()) + gzip.compress(PERSON.encode()))
    assert logs.read_log(spark, str(tmp_path), "s").filter("ok").count() == 4
    sums = logs.file_checksums(spark, str(tmp_path))
    assert logs.new_files(sums, sums.limit(1)).count() == 1
    assert {r.checksum for r in sums.collect()} == {hashlib.sha256(f.read_bytes()).hexdigest() for f in tmp_path.iterdir()}


def test_limits_of_files(spark, tmp_path):
    (tmp_path / "a.gz.log").write_bytes(gzip.compress(b"x" * 5000))
    with pytest.raises(Exception, match="holds more than 1000 bytes"):
        logs.read_lines(spark, str(tmp_path), 1000).count()
    (tmp_path / "b.log").write_text("y" * (logs.LONGEST_LINE + 1))
    with pytest.raises(Exception, match="more than 1048576 bytes"):
        logs.read_lines(spark, str(tmp_path / "b.log")).collect()


def test_synthetic(spark):
    lines = logs.synthetic_lines(spark, 2000)
    parsed = logs.parse_lines(lines, "s")
    assert parsed.filter("ok").count() == 2000 and parsed.select("status_code").distinct().count() == 4
    assert lines.exceptAll(logs.synthetic_lines(spark, 2000)).isEmpty()


def test_sitemaps(spark):
    xml = '<urlset><url><loc><![CDATA[https://a.example/x?a=1&b=2]]></loc><lastmod>2026-01-02T03:04:05Z</lastmod></url><url><loc>https://a.example/y?a=1&amp;b=2</loc></url><url><loc></loc></url></urlset>'
    index = "<sitemapindex><sitemap><loc>https://a.example/s.xml</loc></sitemap></sitemapindex>"
    rows = files.parse_sitemaps(spark.createDataFrame([(xml,), (index,), (None,)], "content string")).collect()
    assert [(r.url, r.lastmod, r.is_index) for r in rows] == [("https://a.example/x?a=1&b=2", dt.date(2026, 1, 2), False), ("https://a.example/y?a=1&b=2", None, False), ("https://a.example/s.xml", None, True)]


def test_robots(spark):
    robots = spark.createDataFrame([("a", "User-agent: *\nDisallow: /private\nAllow: /private/open$\nDisallow: /*.pdf\n\nUser-agent: GPTBot\nDisallow: /\nSitemap: https://a.example/s.xml"), ("b", "User-agent: *\nAllow: /\n\nUser-agent: bing\nDisallow: /x\nAllow: /x"), ("c", None)], "host string, content string")
    rules = files.robots_rules(robots, site="host").cache()
    paths = spark.createDataFrame([(s, p) for s in "abc" for p in ("/", "/private/x", "/private/open", "/private/open/x", "/a.pdf", "/x")], "site string, path string")
    got = {(r.site, r.path): r.allowed for r in files.robots_allowed(paths, rules, "Bingbot").collect()}
    assert {k[1]: v for k, v in got.items() if k[0] == "a"} == {"/": True, "/private/x": False, "/private/open": True, "/private/open/x": False, "/a.pdf": False, "/x": True}
    assert all(v for k, v in got.items() if k[0] != "a")  # a tie allows, and so does a site without rules
    assert {r.site for r in files.robots_allowed(paths, rules, "GPTBot").filter("NOT allowed").collect()} == {"a"}
    access = {(r.site, r.agent): r.allowed for r in files.agent_access(rules).collect()}
    assert len(access) == 22 and not access["a", "GPTBot"] and access["a", "ClaudeBot"] and access["b", "GPTBot"]
    assert rules.filter("sitemap IS NOT NULL").count() == 1
    alone = files.robots_rules(robots.filter("host = 'a'"))
    assert {r.path: r.allowed for r in files.robots_allowed(paths.select("path"), alone, "Bingbot").collect()}["/a.pdf"] is False


def test_link_lists():
    assert files.link_columns(["Referring page URL", "Target URL", "Anchor"]) == {"source": "Referring page URL", "target": "Target URL", "anchor": "Anchor", "tool": "ahrefs"}
    assert files.link_columns(["SourceURL", "TargetURL", "AnchorText"])["tool"] == "majestic"
    assert files.link_columns(["Página que enlaza", "Página de destino"]) == {"source": "Página que enlaza", "target": "Página de destino", "anchor": None, "tool": "gsc"}
    assert files.link_columns(["nada"])["source"] is None


def test_lenient_csv(spark, tmp_path):
    (tmp_path / "x.csv").write_text("a,b,c\n 1 , 2\n,,\n3,4,5\n")
    assert [tuple(r) for r in files.read_csv(spark, str(tmp_path / "x.csv"), lenient=True).collect()] == [("1", "2", None), ("3", "4", "5")]
    with pytest.raises(ValueError):
        files.read_csv(spark, str(tmp_path / "x.csv"), max_rows=1, lenient=True)
    with pytest.raises(Exception, match="more than 0 characters"):
        files.read_csv(spark, str(tmp_path / "x.csv"), max_cell=0, lenient=True).collect()


def test_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text('city;price\n"Ma""rlow\nick";"1,5"\n')
    assert [tuple(r) for r in files.read_csv(spark, str(tmp_path / "a.csv")).collect()] == [('Ma"rlow\nick', "1,5")]
    (tmp_path / "b.csv").write_text("a,A\n1,2\n")
    with pytest.raises(ValueError):
        files.read_csv(spark, str(tmp_path / "b.csv"))
    (tmp_path / "l.csv").write_text("Referring page URL,Target URL,Anchor\nhttps://x.example/1,https://me.example/,a\nhttps://x.example/1,https://me.example/,b\nhttps://me.example/2,https://me.example/,c\n")
    assert files.read_backlinks(spark, str(tmp_path / "l.csv"), "me.example").count() == 1


def test_json_sources(spark):
    serp = spark.createDataFrame([('{"organic":[{"position":1,"link":"https://x.example/"},{"position":2,"link":"https://www.me.example/p"}],"ai_overview":{"references":[{"link":"https://me.example/"}]}}',), ("{}",), ("broken",)], "json string")
    a, b, c = files.parse_results_pages(serp, "me.example").collect()
    assert a.position == 2 and a.features == ["ai_overview"] and a.ai_cites_us and b.position is None and b.ai_cites_us is None and c.position is None
    speed = spark.createDataFrame([('{"categories":{"performance":{"score":0.925}},"audits":{"largest-contentful-paint":{"numericValue":2100.5}}}',), ("x",)], "json string")
    a, b = files.parse_speed_results(speed).collect()
    assert a.score == 93 and a.lcp_ms == 2100.5 and a.cls is None and b.score is None
    crux = spark.createDataFrame([('{"collectionPeriods":[{"lastDate":{"year":2026,"month":1,"day":4}},{"lastDate":{"year":2026,"month":1,"day":11}}],"metrics":{"lcp":{"percentilesTimeseries":{"p75s":[2000,null]}}}}',)], "json string")
    assert [(r.metric, str(r.date), r.p75) for r in files.parse_field_history(crux).collect()] == [("lcp", "2026-01-04", 2000.0), ("lcp", "2026-01-11", None)]
    page = spark.createDataFrame([("u", '<script type="application/ld+json">{"@graph":[{"@type":"Organization","founder":{"@type":"Person"}}]}</script><script type="application/ld+json">{bad</script>'), ("v", None)], "url string, html string")
    assert [(r.url, r.type) for r in files.json_ld_nodes(page).collect()] == [("u", "Organization"), ("u", "Person"), ("u", None)]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("=x", ["a", "b"], 1)], "t string, l array<string>, n int")
    sinks.write_csv(df, str(tmp_path / "out"))
    assert [tuple(r) for r in spark.read.csv(str(tmp_path / "out"), header=True).collect()] == [("'=x", "a | b", "1")]
    sinks.write_table(df, str(tmp_path / "t"), ["n"])
    assert spark.read.parquet(str(tmp_path / "t")).count() == 1
    pairs = spark.createDataFrame([("/a.b", "/c")], "s string, t string")
    assert sinks.redirect_rules(pairs, F.col("s"), F.col("t")).first()[0] == "Redirect 301 /a.b /c" and sinks.redirect_rules(pairs, F.col("s"), F.col("t"), "nginx").first()[0] == "rewrite ^/a\\.b$ /c permanent;"
    assert sinks.snapshot_json(pairs).first()[0] == '{"s":"/a.b","t":"/c"}'
    assert sinks.disavow_lines(spark.createDataFrame([("x",), ("x",)], "source_domain string")).count() == 1
