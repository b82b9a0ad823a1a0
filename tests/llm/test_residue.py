"""Residue: placeholders by syntax and slot, filler and notices by the learned model."""

import random

from almena.llm.residue import NOTICE, NOTICE_CUES, PASSAGE, PLACEHOLDER_MARK, find_residue, fit, forms, marks, passages, read_units, template_slots, trusted_kind

SCHEMA = "page_id long, title string, meta_description string, content string, reason string"
TEMPLATE = "template_id long, title_template string, body_template string"


def ordinary(rng, n):
    w = "el la de en que y para con un se quedaba tienda fichas aviso opcion plantilla visita listado enlace catalogo pagina equipo agencia tabla orden consulta semana informe marca precio ficha".split()
    return " ".join(f"<p>{' '.join(rng.choice(w) for _ in range(rng.randrange(6, 25))).capitalize()}.</p>" for _ in range(n))


def test_pages(spark):
    rng = random.Random(6)
    good = [(i, f"Servicio {i}", "Texto", f"<h1>Servicio {i}</h1>{ordinary(rng, 6)}", "x") for i in range(300)]
    good += [(400 + i, "t", "d", f"<p>Quitamos el lorem ipsum que quedaba en {i} fichas de la tienda.</p>{ordinary(rng, 6)}", "x") for i in range(6)]
    kept = [(1000, "JavaScript en tiendas", None, f"<p>En la plantilla, <code>{{{{ciudad}}}}</code> se cambia.</p>{ordinary(rng, 5)}", "x"), (1001, "t", "d", f"<p>The scope was undefined at first.</p>{ordinary(rng, 5)}", "x"), (1002, "t", "d", f"<p>El aviso «404 not found» salía.</p>{ordinary(rng, 5)}", "x"), (1003, None, None, None, "x"), (1004, "", "", "", "x"), (1005, "t", "d", f"<p>Quitamos el lorem ipsum que quedaba en 9 fichas de la tienda.</p>{ordinary(rng, 6)}", "x"), (1006, "t", "d", f"<p>Precio [IVA incluido] para 9; la opción {{A, B}} es libre.</p>{ordinary(rng, 6)}", "x")]
    bad = [(2000, "Precio en {{ciudad}}", "d", ordinary(rng, 5), "x"), (2001, "t", "${precio}: x", ordinary(rng, 5), "x"), (2002, "t", "d", "<p>404 Not Found</p>", "x"), (2003, "t", "d", "<h1>t</h1><p>Please enable JavaScript to view this page.</p>", "x"), (2004, "t", "d", f"{ordinary(rng, 3)}<p>Lorem ipsum dolor amet nulla magna aliqua tempor.</p>{ordinary(rng, 3)}", "x"), (2005, "t", "d", f"{ordinary(rng, 3)}<p>Texto de relleno, cambiar antes de publicar.</p>", "x"), (2006, "t", "d", f"<h1>Servicio en null</h1>{ordinary(rng, 4)}", "x"), (2007, "t", "d", "<noscript>Su navegador tiene desactivado JS.</noscript>", "x"), (2008, "t", "d", f"{ordinary(rng, 4)}<p>xxxx xxxx xxxx xxxx</p>", "x"), (2009, "t", "d", f"<p>NaN</p>{ordinary(rng, 4)}", "x")]
    templates = spark.createDataFrame([(1, "{{servicio}} en {{ciudad}} | M", "<h1>{{servicio}} en {{ciudad}}</h1><p>Desde {{precio}} pesos.</p>")], TEMPLATE)
    found = [r.page_id for r in find_residue(spark.createDataFrame(good + kept + bad + bad[:2], SCHEMA), templates).collect()]
    assert len(found) == len(set(found)) and set(found) == {b[0] for b in bad}
    assert find_residue(spark.createDataFrame([], SCHEMA), templates).count() == 0


def labels(text, names, slots):
    return [label for label, _ in marks(text, "block", names, slots)]


def test_cues_label_marks(spark):
    names, slots = template_slots(spark.createDataFrame([(1, None, "<p>Desde {{precio}} pesos</p>")], TEMPLATE))
    assert names == {"precio"} and slots == {("desde", "pesos")}
    for text in ("{{x}}", "{{ X }}", "{{{x}}}", "{{SERVICIO | M", "${x}", "<%= x %>", "{% x %}", "[[x]]", "%ciudad%", "__ciudad__", "#ciudad#", "[precio]", "{x}", "de #N/A", "NaN", "Desde null pesos", "[object Object]"):
        assert PLACEHOLDER_MARK in labels(text, names, slots), text
    for text in ("37% de 12%", "[IVA incluido]", "{A, B}", "was undefined at first", "# uno # dos", "a __ b", "C# y F#", "5 % y 6 %"):
        assert PLACEHOLDER_MARK not in labels(text, names, slots), text


def test_scores_find_what_no_cue_knows(spark):
    """A message and a notice of any length that hold no cue are found by words learned from others; without the fit they are not."""
    rng = random.Random(2)
    good = [(i, f"t {i}", "d", f"<h1>t</h1>{ordinary(rng, 5)}", "x") for i in range(400)]
    cued = [(1000 + i, "t", "d", f"<p>Error interno, vuelva a intentarlo luego o avise a soporte, folio {i}</p>", "x") for i in range(40)]
    near = (2000, "t", "d", "<p>Fallo: vuelva a intentarlo luego o avise a soporte</p>", "x")
    long = (2001, "t", "d", "<p>" + "Error interno, vuelva a intentarlo luego o avise a soporte. " * 6 + "</p>", "x")
    templates = spark.createDataFrame([(1, "{{servicio}}", "<p>{{precio}}</p>")], TEMPLATE)
    for page in (near, long):
        assert trusted_kind(passages(*page[1:4])[-1]) == -1
    assert not NOTICE_CUES.search(near[3])
    pages = spark.createDataFrame(good + cued + [near, long], SCHEMA)
    assert {r.page_id for r in find_residue(pages, templates).collect()} == {p[0] for p in cued} | {2000, 2001}
    assert {r.page_id for r in find_residue(spark.createDataFrame(good + [near], SCHEMA), templates).collect()} == set()


def test_fit_is_the_same_however_units_are_spread(spark):
    rng = random.Random(4)
    pages = [(i, "t", "d", ordinary(rng, 3), "x") for i in range(60)] + [(100 + i, "t", "d", f"<p>404 Not Found {i}</p>", "x") for i in range(9)]
    templates = spark.createDataFrame([(1, "{{a}}", "{{b}}")], TEMPLATE)
    df = spark.createDataFrame(pages, SCHEMA)
    one, other = (fit(read_units(df.repartition(n), templates)) for n in (1, 5))
    assert abs(one.logs - other.logs).max() < 1e-4 and abs(one.prior - other.prior).max() < 1e-9
    assert one.prior[PASSAGE].argmax() == 2 and one.prior[PASSAGE, NOTICE] > fit(read_units(df.limit(0), templates)).prior[PASSAGE, NOTICE] - 9


def test_forms():
    same, plain = passages(None, None, "<p>xxxx xxxx xxxx</p>")[0], passages(None, None, "<p>uno</p><p>dos</p>")[0]
    assert forms(same).count("<same>") == 4 and "<sole>" in forms(same) and "<sole>" not in forms(plain)
