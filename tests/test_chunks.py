"""Blocks, chunks with all flags, main text and fields of HTML pages."""

from almena.operators.chunks import FLAGS, blocks, chunk, flag_counts, html_blocks, html_chunks, html_markdown, only_rendered, tokens
from almena.sources.dom import extract, link_presence, main_text, page_fields, paragraphs

PAGE = """<html lang="es"><head><title> Botas </title><link rel="canonical" href="/botas"><meta name="description" content="D"><script type="application/ld+json">{"@graph":[{"@type":["Product","Thing"]}]}</script><script type="application/ld+json">{x</script></head>
<body><nav><a href="/">Inicio</a></nav><main><h1>Botas <b>altas</b></h1><p>Uno <a href="/x?a=1#f">enlace</a> y <em>dos</em><p>Otro<ul><li>a<li>b<ol><li>c</ol></ul>
<table><tr><th>k<th>v<tr><td>a|b<td>2</table><pre> x
 y </pre><blockquote>cita</blockquote><figure><img alt="foto"><figcaption>pie</figcaption></figure><img src="i.png"><dl><dt>t<dd>d</dl><div>suelto <span><p>dentro</p></span></div><aside>no</aside></main><footer>pie</footer></body></html>"""


def test_blocks():
    found = blocks(PAGE, "https://a.example/dir/p")
    assert [b["kind"] for b in found] == ["heading", "paragraph", "paragraph", "list", "table", "code", "quote", "image", "list", "paragraph", "paragraph"]
    md = [b["md"] for b in found]
    assert md[0] == "# Botas altas" and md[1] == "Uno [enlace](https://a.example/x?a=1#f) y *dos*" and md[3] == "- a\n- b\n  1. c"
    assert md[4] == "| k | v |\n| --- | --- |\n| a\\|b | 2 |" and md[5] == "```\nx\n y\n```" and md[7] == "![foto] pie" and md[8] == "- **t**\n  d" and md[9:] == ["suelto", "dentro"]
    assert blocks(None, None) == [] and blocks("", "x") == []


def test_chunks_with_all_flags():
    raw = "<main><h1>T</h1><p>" + "Palabra corta aqui. " * 30 + "</p></main>"
    html = (
        "<main><p>" + "Una frase sin titulo de tamano medio. " * 12 + "</p><p>" + "Otra frase que no cabe ya en el mismo trozo. " * 12 + "</p><h2>Lista</h2><ul>" + "".join(f"<li>punto numero {i} de la lista</li>" for i in range(60)) + "</ul>"
        "<h2>Tabla</h2><table>" + "".join(f"<tr><td>fila {i}</td><td>valor de la fila</td></tr>" for i in range(60)) + "</table><h2>Largo</h2><p>" + "Esta es una frase bastante larga para partir. " * 40 + "</p><h2>Precio</h2><p>Cuesta $1,200 al mes.</p></main>"
    )
    found = blocks(html, None)
    js = only_rendered(found, blocks(raw, None))
    got = chunk(found, js, 128)
    assert {f for c in got for f in c["flags"]} == set(FLAGS)
    assert all(c["tokens"] <= 140 for c in got) and [c["chunk_no"] for c in got] == list(range(len(got)))
    assert got[-1]["headings"] == ["Precio"] and set(got[-1]["flags"]) == {"js_only", "key_data_js", "tiny"}
    assert got[1]["flags"].count("no_context") == 1 and "no_context" not in got[0]["flags"]
    words = lambda t: [w for w in t.replace("|", " ").replace("-", " ").split()]
    assert words(" ".join(c["md"] for c in got)) == words(" ".join(b["md"] for b in found))  # nothing is lost


def test_headings_open_chunks():
    html = "<main><h1>A</h1><p>" + "x " * 300 + "</p><h2>B</h2><p>y</p><h3>C</h3><p>z</p><h2>D</h2><p>w</p></main>"
    got = chunk(blocks(html, None), limit=512)
    assert [c["headings"] for c in got] == [["A"], ["A", "D"]] and got[1]["md"].startswith("## B") and got[1]["flags"] == ["tiny"]
    assert chunk([], None) == [] and tokens("") == 1


def test_tables_of_pages(spark):
    df = spark.createDataFrame([("https://a.example/p", PAGE, None, 1), ("https://a.example/q", None, PAGE, 2), ("https://a.example/r", "", "", 3)], "url string, html string, sent string, md int")
    assert html_blocks(df).groupBy("url").count().collect()[0][1] == 11
    m = {r.url[-1]: r for r in html_markdown(df).collect()}
    assert m["p"].title == "Botas" and m["p"].markdown.startswith("# Botas altas\n\nUno [enlace]") and m["p"].images_without_alt == 1 and m["q"].markdown == "" and m["q"].title is None
    c = html_chunks(df, raw="sent")
    assert {(r.url[-1], tuple(r.flags)) for r in c.collect()} == {("p", ())} or c.filter("url LIKE '%p'").first().flags in (["tiny"], [])
    assert {r.flag for r in flag_counts(c).collect()} == set(FLAGS)
    assert html_chunks(df.limit(0)).count() == 0


def test_fields_and_main_text(spark):
    f = extract("https://www.a.example/dir/p", PAGE)
    assert (f["title"], f["canonical"], f["meta_description"], f["lang"], f["h1"], f["schema_types"], f["schema_errors"]) == ("Botas", "https://www.a.example/botas", "D", "es", "Botas altas", ["Product", "Thing"], 1)
    assert f["internal_links"] == ["https://www.a.example/", "https://www.a.example/x?a=1"] and f["external_links"] == [] and f["images_missing_alt"] == 1 and f["tables"] == 1 and f["lists"] == 2
    assert main_text(PAGE).startswith("Botas altas Uno enlace y dos Otro a b c k v") and "Inicio" not in main_text(PAGE) and main_text(None) == ""
    assert paragraphs("<main><p>" + "largo " * 9 + "<a>fuera</a></p><p>corto</p></main>") == [("largo " * 9).strip()]
    row = page_fields(spark.createDataFrame([("u", None), ("https://a.example/", PAGE)], "url string, html string")).orderBy("url").collect()
    assert row[0].title == "Botas" and row[1].title is None and row[1].word_count == 0 and row[1].og.title is None


def test_links_to_a_site(spark):
    page = '<meta name="robots" content="nofollow"><a href="https://x.example">x</a><a href="https://blog.me.example/a/">Uno</a><a rel="sponsored ugc" href="//me.example/b?q=1"><img alt="f"></a>'
    df = spark.createDataFrame([("https://x.example/p", page), ("https://x.example/q", None)], "url string, html string")
    a, b = link_presence(df, "www.me.example").orderBy("url").collect()
    assert (a.found, a.href, a.rel, a.anchor, a.outlinks, a.site_links) == (True, "https://blog.me.example/a/", "nofollow", "Uno", 2, 2) and not b.found
    c = link_presence(df, "me.example", target="https://me.example/b?q=1").orderBy("url").first()
    assert (c.rel, c.anchor) == ("sponsored,ugc", "[image: f]") and not link_presence(df, "me.example", target="https://me.example/z").first().found
