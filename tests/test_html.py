"""Fields and links of small pages."""

from pyspark.sql import functions as F

from almena.functions import web
from almena.sources import html

PAGE = """<html lang="es"><head><title> A  <b>b</b> </title><meta content='Desc' name="Description"><link href="/c" rel=canonical><meta name=robots content=noindex><!-- <h1>no</h1> --></head>
<body><script>var x = "<h1>no</h1>";</script><h1>Uno</h1><h2>x</h2><h2>y</h2><img src=a.png><img src=b.png alt=""><a href="../z?q=1#f" rel="nofollow x">Enlace <b>fuerte</b></a><a href='mailto:a@b.c'>m</a><a>no</a><a href="https://O.example:443/p">o</a></body></html>"""


def test_head_fields(spark):
    a, b = html.head_fields(spark.createDataFrame([("u", PAGE), ("v", None)], "url string, html string")).orderBy("url").collect()
    assert (a.title, a.title_count, a.description, a.canonical, a.robots, a.lang) == ("A b", 1, "Desc", "/c", "noindex", "es")
    assert (a.h1, a.h1_count, a.h2, a.images, a.images_missing_alt, a.links) == ("Uno", 1, ["x", "y"], 2, 1, 3)
    assert b.title is None and b.h1_count == 0 and b.words == 0


def test_links(spark):
    pages = spark.createDataFrame([("https://s.example/a/b/", PAGE), ("https://s.example/other", PAGE), ("x", None)], "url string, html string")
    links = html.link_rows(pages).cache()
    assert {(r.target_url, r.anchor, r.nofollow) for r in links.filter("source_url LIKE '%/a/b/'").collect()} == {("https://s.example/a/z?q=1", "Enlace fuerte", True), ("https://o.example/p", "o", False)}
    assert {r.url: r.inlinks for r in html.inlinks(links).collect()}["https://o.example/p"] == 2
    crawled = spark.createDataFrame([("https://o.example/p", 404)], "url string, status_code int")
    assert html.broken_links(links, crawled).count() == 2


def test_ratings(spark):
    row = spark.range(1).select(
        web.resource_kind(F.lit("/a/B.PNG?v=1")).alias("a"), web.resource_kind(F.lit("/a/")).alias("b"), web.vital_rating(F.lit("LCP"), F.lit(2600.0)).alias("c"), web.vital_rating(F.lit("x"), F.lit(1.0)).alias("d"), web.score_grade(F.lit(85)).alias("e")
    ).first()
    assert tuple(row) == ("image", "page", "improve", None, "B")
