"""Page, agent and trust checks, llms.txt, readability, key phrases on planted pages."""

from pyspark.sql import functions as F

from almena.operators import readiness as r

GOOD = """<html><head><meta name="author" content="Ana"><script type="application/ld+json">{"@type":"Article","datePublished":"2026-01-01"}</script></head><body><nav><p>Un menú con muchas palabras que no cuentan para nada aquí.</p></nav><main><h1>T</h1>
<p>""" + "palabra " * 30 + """.</p><h2>¿Cuánto cuesta?</h2><p>Cuesta $120 o 15% menos desde 2024.</p><h2>How it works</h2><ul><li>a<li>b<li>c</ul><p>""" + "texto " * 300 + """</p><a href="https://x.example/a">x</a><a href="https://www.y.example/">y</a><a href="https://facebook.com/z">z</a></main></body></html>"""


def test_page_checks(spark):
    assert r.page_checks(GOOD, "https://me.example/") == dict.fromkeys(r.PAGE_CHECKS, 1.0)
    bare = r.page_checks(None, None)
    assert {k for k, v in bare.items() if v} == {"snippet"} and r.page_checks(GOOD, "x", raw_words=100)["no_js"] == 0.0 and r.page_checks(GOOD, "x", robots_tag="max-snippet:0")["snippet"] == 0.0
    half = r.page_checks("<h1>a</h1><p>" + "uno " * 12 + "</p><h2>Qué es</h2><script type='application/ld+json'>{\"@type\":\"Thing\"}</script>", "x")
    assert half["direct_answer"] == half["question_headings"] == half["headings"] == half["schema"] == 0.5
    assert sum(r.PAGE_CHECKS.values()) == 100
    checks = r.page_readiness(spark.createDataFrame([("https://me.example/a", GOOD), ("https://me.example/b", None)], "url string, html string"))
    scores = r.weighted(checks, r.PAGE_CHECKS, "url")
    assert {x.url[-1]: (x.score, x.grade) for x in scores.collect()} == {"a": (100, "excellent"), "b": (5, "poor")}
    failing = {x.check: (x.failing, x.cost) for x in r.failing_checks(checks, r.PAGE_CHECKS).collect()}
    assert failing["schema"] == (1, 15) and failing["snippet"] == (0, 0) and {x.grade: x.pages for x in r.grade_counts(scores).collect()} == {"excellent": 1, "poor": 1}


def test_agents(spark):
    rows = [
        ("a", 0, 0, [([("email", "mail", "Correo"), ("text", "nombre", "Nombre")], "Enviar")], [], [], ["$5"], True, [("Comprar", True)]), ("b", 2, 4, [([("text", "correo", "Correo"), ("text", "x", None)], "Ir")], [(None, False, "Cerrar")], ["reCAPTCHA"], [], False, [("Cotiza", False)]),
        ("c", 9, 0, [], [(None, False, None)], [], [], False, []), ("d", 0, 0, [([("text", "q", "Q")], " ")], [("dialog", False, "OK")], [], ["1"], False, []),
    ]
    facts = spark.createDataFrame(rows, r.AGENT_FACTS)
    got = {}
    for x in r.agent_checks(facts).collect():
        got.setdefault(x.url, {})[x.check] = x.score
    assert set(got["a"].values()) == {1.0} and list(got["b"].values()) == [0.5, 0.0, 0.5, 0.5, 0.5, 0.0, 0.5] and list(got["c"].values()) == [0.0, 1.0, None, 0.0, 1.0, None, 0.0] and got["d"]["form_labels"] == 0.0 and got["d"]["no_blocking_overlay"] == 1.0
    assert {x.url: x.score for x in r.weighted(r.agent_checks(facts), r.AGENT_CHECKS, "url").collect()}["c"] == 36
    assert {x.task: x.status for x in r.agent_tasks(r.agent_checks(facts)).collect()} == {"read": "blocked", "contact": "blocked", "buy": "blocked"} and {x.status for x in r.agent_tasks(r.agent_checks(facts.filter("url = 'a'"))).collect()} == {"ok"}


def test_trust(spark):
    org = spark.createDataFrame([("s", "l", "d", "c", ["1", "2", "3"]), ("t", None, "d", " ", []), ("u", None, None, None, None)], "site_id string, logo string, description string, contact string, same_as array<string>")
    authors = spark.createDataFrame([("s", "https://s.example/ana/", "i", "b" * 80, ["x"]), ("t", "https://t.example/x", None, "corta", [])], "site_id string, url string, image string, description string, same_as array<string>")
    pages = spark.createDataFrame(
        [("s", "https://s.example/", 0, True, False, None, None, None, 2), ("s", "https://s.example/ana", 1, True, False, None, None, None, None), ("s", "https://s.example/nosotros", 1, True, False, None, None, None, None), ("s", "https://s.example/contacto", 1, True, False, None, None, None, None), ("s", "https://s.example/privacidad", 1, True, False, None, None, None, None), ("s", "https://s.example/blog/a", 2, True, True, True, True, True, None), ("t", "https://t.example/", 0, True, True, True, False, False, 0), ("t", "https://t.example/contact", 1, False, True, False, False, False, None), ("t", "https://t.example/b", 1, True, True, False, False, False, None)],
        "site_id string, url string, depth int, plain boolean, article boolean, has_author boolean, has_date boolean, has_entities boolean, org_schema int",
    )
    got = {}
    for x in r.trust_checks(org, authors, pages).collect():
        got.setdefault(x.site_id, {})[x.check] = x.score
    assert set(got["s"]) == set(r.TRUST_CHECKS) and set(got["s"].values()) == {1.0}
    assert got["t"] == {"org_profile": 0.5, "org_profiles_elsewhere": 0.0, "org_schema": 0.5, "about": 0.0, "contact": 0.0, "legal": 0.0, "authors": 1.0, "author_profiles": 0.0, "author_pages": 0.0, "article_author": 0.5, "article_date": 0.0, "article_entities": 0.0}
    assert got["u"]["authors"] == 0.0 and got["u"]["author_profiles"] is None and got["u"]["article_author"] == 0.5
    assert {x.site_id: x.score for x in r.weighted(r.trust_checks(org, authors, pages), r.TRUST_CHECKS, "site_id").collect()}["s"] == 100


def test_llms(spark):
    rows = [("s", "Mi sitio", f"https://s.example{p}", t, d, w) for p, t, d, w in (("/", "Inicio", "Qué es.", 9), ("/a", "Página [A]", None, 5), ("/blog/x", "X", "dos\n líneas", 3), ("/blog/y", "", "", 4), ("/solo/z", "Z", None, 6), ("/tag/q", "Q", None, 1))]
    text = r.llms_txt(spark.createDataFrame(rows, "site string, name string, url string, title string, description string, priority int"), "site").first()
    want = "# Mi sitio\n\n> Qué es.\n\n## Main pages\n\n- [Z](https://s.example/solo/z)\n- [Página \\[A\\]](https://s.example/a)\n\n## Blog\n\n- [https://s.example/blog/y](https://s.example/blog/y)\n- [X](https://s.example/blog/x): dos líneas\n\n## Optional\n\n- [Q](https://s.example/tag/q)\n"
    assert text.text == want and text.links == 5
    bad = "intro\n# A\n# B\n### c\n- [ok](https://s.example/a/)\n- [gone](https://s.example/gone)\n## S\n- [out](https://o.example/)\n* [rel](/x)\n- no link\n- [moved](https://www.s.example/m)\n- [new](https://s.example/n)"
    files = spark.createDataFrame([("good", want, "text/plain; charset=utf-8"), ("bad", bad, "text/html")], "site string, text string, content_type string")
    pages = spark.createDataFrame([("https://s.example/a", 200, True), ("https://s.example/gone", 404, False), ("https://www.s.example/m", 301, False)] + [(f"https://s.example{p}", 200, True) for p in ("/solo/z", "/blog/x", "/blog/y", "/tag/q")], "url string, status_code int, is_indexable boolean")
    links = {x.label: (x.status, x.section) for x in r.llms_links(files.filter("site = 'bad'"), pages, "site", "s.example").collect()}
    assert links == {"ok": ("ok", ""), "gone": ("broken", ""), "out": ("external", "S"), "rel": ("invalid", "S"), "moved": ("non_indexable", "S"), "new": ("not_crawled", "S")}
    checks = {}
    for x in r.llms_checks(files, pages, "site", "s.example").collect():
        checks.setdefault(x.site, {})[x.check] = x.passed
    assert len(checks["good"]) == 9 and all(checks["good"].values()) and {k for k, v in checks["bad"].items() if v} == {"sections", "size"}


def test_readability(spark):
    assert [r.syllables(w) for w in ("casa", "león", "ciudad", "país", "y", "123", "aéreo", "guía")] == [2, 2, 2, 2, 1, 0, 4, 2]
    assert r.sentences("¿Vienes? Sí… ¡Claro! «No» fin") == ["Vienes?", "Sí…", "Claro!", "No» fin"] and r.runs(list("aabbbbaaa")) == ["b", "a"]
    html = "<h1>T</h1><p>" + "El gato come pan. " * 15 + "Sin embargo, la casa fue construida ayer. Además llueve.</p><h2>S</h2><p>" + "larga " * 30 + ".</p>"
    m = r.reading(html)
    assert m["sentences"] == 18 and m["repeated_starts"] == ["el"] and round(m["linking"]) == 11 and round(m["passive"]) == 6 and round(m["long_sentences"]) == 6 and m["subheadings"] == 1 and m["longest_section"] == 70
    n = m["words"]
    assert abs(m["reading_ease"] - (206.84 - 60 * m["syllables"] / n - 102 * 18 / n)) < 1e-9
    got = {x.url: x.rating for x in r.readability(spark.createDataFrame([("a", html), ("b", None), ("c", "corto")], "url string, html string")).collect()}
    assert got == {"a": "good", "b": "too_short", "c": "too_short"} and r.reading(None)["reading_ease"] is None


def test_keyphrases(spark):
    text = "Las botas de montaña duran. " + "Otra frase sin nada de eso. " * 40
    rows = [(1, "Botas de Montaña", "Botas de montana baratas y buenas hoy", "Las mejores botas de montaña", "botas-de-montana", text, "Unas botas de montaña"), (2, "", None, None, None, None, None)]
    df = spark.createDataFrame(rows, "id int, keyphrase string, title string, description string, slug string, text string, intro string")
    got = {}
    for x in r.keyphrase_checks(df, "id").collect():
        got.setdefault(x.id, {})[x.check] = x.rating
    assert got[1] == {"phrase_length": "good", "title": "good", "description": "good", "slug": "good", "intro": "good", "density": "bad", "length": "ok", "title_length": "good", "description_length": "ok"}
    assert got[2]["phrase_length"] == "bad" and got[2]["length"] == "bad" and df.select(F.col("id")).count() == 2
