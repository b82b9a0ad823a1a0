"""Links, orphans, suggestions, redirects, rendering, duplicates and generated pages on planted sites."""

from pyspark.sql import functions as F

from almena.functions.text import to_words
from almena.operators import architecture as a

O = "https://s.example"  # noqa: E741
PAGES = "url string, final_url string, title string, status_code int, is_indexable boolean, depth int"
LINKS = "source_url string, target_url string, nofollow boolean"


def site(spark):
    pages = spark.createDataFrame([(O + "/", None, "Inicio", 200, True, 0), (O + "/a", None, "A", 200, True, 1), (O + "/b/", O + "/bb", "B", 200, True, 2), (O + "/lone", None, "L", 200, True, 5), (O + "/no", None, "N", 200, False, 1), (O + "/gone", None, None, 404, False, 1)], PAGES)
    links = spark.createDataFrame([(O + "/", O + "/a", False), (O + "/", O + "/a#x", False), (O + "/a", O + "/bb", False), (O + "/a/", O + "/", False), (O + "/b", O + "/", False), (O + "/a", O + "/lone", True), (O + "/", O + "/no", False), (O + "/", O + "/", False)], LINKS)
    search = spark.createDataFrame([(O + "/lone/", 0, 40), (O + "/a", 9, 100), (O + "/old", 1, 7), (O + "/none", 0, 0)], "page string, clicks long, impressions long")
    return pages, links, search


def test_link_report_and_orphans(spark):
    pages, links, search = site(spark)
    assert {(r.src[17:], r.dst[17:]) for r in a.link_edges(pages, links).collect()} == {("/", "/a"), ("/a", "/b/"), ("/a", "/"), ("/b/", "/")}
    report = a.link_report(pages, links, search)
    by = {r.url[17:]: r for r in report.collect()}
    assert by["/"].link_score == 100 and by["/lone"].inlinks == 0 and by["/lone"].link_score < by["/a"].link_score and by["/a"].outlinks == 2 and by["/lone"].deep and not by["/a"].deep
    assert by["/a"].impressions == 100 and by["/lone"].impressions == 40 and by["/b/"].impressions is None
    sitemap = spark.createDataFrame([(O + "/a",), (O + "/hidden",), (O + "/old",)], "url string")
    got = {r.key[17:]: (r.in_crawl, r.sources, r.impressions) for r in a.orphans(report, pages, sitemap, search).collect()}
    assert got == {"/lone": (True, ["no_links"], 40), "/hidden": (False, ["sitemap"], 0), "/old": (False, ["search", "sitemap"], 7)}


def test_phrases_and_links():
    assert a.anchor_candidates("Botas de montaña | Tienda - Guía completa", "Botas de Montana", ["comprar botas", "x"]) == ["comprar botas", "Botas de Montana", "Guía completa"]
    assert a.find_phrase(["nada", "Las mejores BOTAS  de montaña del año"], ["botas de montana"])[1:] == ("BOTAS  de montaña", "Las mejores [[BOTAS  de montaña]] del año")
    assert a.find_phrase(["botasde montaña", "cabotas de montañas"], ["botas de montana"]) is None
    html = '<!-- botas de piel --><h2>Botas de piel</h2><p><a href="/x">botas de piel</a> y <code>botas de piel</code>, unas Botas de Piel.</p>'
    assert a.insert_link(html, "botas de piel", '/b"') == html.replace("unas Botas de Piel", 'unas <a href="/b&quot;">Botas de Piel</a>')
    assert a.insert_link("<h1>botas de piel</h1>", "botas de piel", "/b") is None and a.insert_link("", "x y", "/") is None


def test_suggestions(spark):
    rows = [
        (O + "/guia", "Guía de postura sentada", "Postura sentada", ["Una buena postura sentada cuida la espalda y el cuello durante toda la jornada laboral."]),
        (O + "/blog", "Ergonomía en casa", "Ergonomía", ["Cuidar la espalda y el cuello exige una POSTURA sentada correcta durante la jornada laboral."]),
        (O + "/linked", "Sillas y postura", "Sillas", ["La postura sentada cuida la espalda, y esta silla también cuida el cuello en la jornada."]), (O + "/other", "Recetas de arroz", "Arroz", ["El arroz con verduras se cocina despacio y con poca agua en una cazuela."]),
    ]
    pages = spark.createDataFrame(rows, "url string, title string, h1 string, paragraphs array<string>")
    links = spark.createDataFrame([(O + "/linked", O + "/guia/")], "source_url string, target_url string")
    targets = spark.createDataFrame([(O + "/guia", ["postura sentada correcta"]), (O + "/missing", None)], "url string, queries array<string>")
    got = a.link_suggestions(pages, links, targets).collect()
    assert [(r.target_url, r.source_url, r.anchor) for r in got] == [(O + "/guia", O + "/blog", "POSTURA sentada correcta")] and got[0].similarity > 8


def test_redirects(spark):
    live = spark.createDataFrame([(O + "/", "Inicio"), (O + "/blog/", "Blog"), (O + "/blog/botas-montana", "Botas de montaña"), (O + "/zapatos/rojos", "Zapatos rojos de fiesta"), (O + "/precios", "Tarifas")], "url string, title string")
    broken = spark.createDataFrame([(O + "/blog/botas-de-montana.html", None), (O + "/tienda/oferta-77", "Zapatos rojos de fiesta baratos"), (O + "/blog/xyzzy", None), (O + "/qqq", None), (O + "/viejo", None), (O + "/%zz", None)], "url string, old_title string")
    alike = spark.createDataFrame([(O + "/viejo", O + "/precios", 0.9)], "url string, live_url string, cosine double")
    got = {r.from_url[17:]: (r.to_url[17:], r.confidence, r.reason) for r in a.redirect_map(broken, live, O + "/", alike).collect()}
    assert got == {"/blog/botas-de-montana.html": ("/blog/botas-montana", "high", "words"), "/tienda/oferta-77": ("/zapatos/rojos", "low", "words"), "/blog/xyzzy": ("/blog/", "low", "folder"), "/qqq": ("/", "low", "home"), "/viejo": ("/precios", "high", "text"), "/%zz": ("/", "low", "home")}
    whole = a.broken_urls(crawl=spark.createDataFrame([(O + "/x", 3)], "url string, inlinks int"), logs=spark.createDataFrame([(O + "/x/", 9)], "url string, bot_hits int")).first()
    assert (whole.sources, whole.inlinks, whole.bot_hits, whole.backlinks) == (["crawl", "logs"], 3, 9, 0)


def test_rendering(spark):
    df = spark.createDataFrame(
        [("u", "T", "H", None, None, 200, " T ", "", None, None, 40, ["x"], ["e"]), ("v", "T", "H", None, None, 0, "T", "H", None, None, 0, None, None), ("w", "T", "H", None, None, 9, None, None, None, None, None, None, None)],
        "url string, title string, h1 string, canonical string, robots_meta string, word_count int, raw_title string, raw_h1 string, raw_canonical string, raw_robots_meta string, raw_word_count int, js_only_links array<string>, js_errors array<string>",
    )
    report = a.render_report(df)
    assert [(r.url, r.text_loss, r.changed, r.js_only_links) for r in report.orderBy("url").collect()] == [("u", 80, ["h1"], 1), ("v", 0, [], 0)]
    assert tuple(a.render_totals(report).first()) == (2, 40.0, 1, 1, 1, 1, 1)
    d = spark.range(1).select(a.link_differences(F.array(F.lit("b"), F.lit("a")), F.array(F.lit("a"), F.lit("c"))).alias("d")).first().d
    assert (d.js_only, d.raw_only) == (["b"], ["c"])


def test_duplicates(spark):
    base = " ".join(f"palabra{i}" for i in range(120))
    rows = [("/a", base), ("/copia", base), ("/casi", base + " mas final"), ("/lejos", " ".join(f"otra{i}" for i in range(120))), ("/corta", "cinco palabras de nada mas"), ("/corta2", "cinco palabras de nada mas"), ("/x", base.replace("palabra7 ", "cambio "))]
    texts = spark.createDataFrame(rows, "url string, t string").select("url", to_words(F.col("t")).alias("words"))
    info = spark.createDataFrame([("/a", 1, 5, 3, None, True), ("/copia", 9, 9, 1, None, True), ("/casi", 0, 0, 0, "/copia", True), ("/x", 0, 0, 0, None, False), ("/corta", 0, 0, 0, None, True)], "url string, clicks int, impressions int, inlinks int, canonical string, is_indexable boolean")
    got = {(r.kind, r.keeper, r.url, r.status) for r in a.duplicate_groups(texts, info).collect()}
    assert got == {("exact", "/copia", "/a", "open"), ("near", "/copia", "/casi", "resolved"), ("near", "/copia", "/x", "resolved")}
    assert {r.url for r in a.thin_pages(texts, info).collect()} == {"/a", "/copia", "/casi", "/corta"}


def test_generated(spark):
    rows = spark.createDataFrame([(1, {"ciudad": "León", "precio": "$5 & más"}), (2, {"ciudad": "León"}), (3, {"precio": "1"})], "row_no int, data map<string,string>")
    templates = spark.createDataFrame([(7, "{{ciudad}} desde {{ precio }}", "<p>{{ciudad}}: {{precio}}</p>", "servicio-{{ciudad}}")], "template_id int, title_template string, body_template string, slug_template string")
    got = {r.slug: r for r in a.generated(rows, templates).collect()}
    assert set(got) == {"servicio-leon", "servicio"} and got["servicio-leon"].row_no == 1 and got["servicio-leon"].content == "<p>León: $5 &amp; más</p>" and got["servicio-leon"].missing == [] and got["servicio"].missing == ["ciudad"]
    assert {r.slug for r in a.generated(rows, templates, spark.createDataFrame([("servicio",)], "slug string")).collect()} == {"servicio-leon"}
