"""Truncation: kinds of endings, hazards of lengths, shares per source."""

import random

from pyspark.sql import functions as F

from almena.llm.truncation import ending_kind, find_truncated, length_limits, truncation_report

SCHEMA = "doc_id long, text string, source string, truncated string"
WHOLE = {
    "Todo bien.": "sentence", "¿Sí?": "sentence", "(Fue útil, dijo.)": "sentence", "«Fin del caso.»": "sentence", "Bien dicho. [1]": "sentence", "Bien. 🙂": "sentence", "Fin.\n\n": "sentence", "a\n```\nx\n```": "code", "x.\n## Fin": "heading",
    "x.\n| a | b |\n| 1 | 2 |": "table", "x.\n- uno (/a)\n- dos (/b)": "list", "x.\nhttps://a.example/b": "address", "x.\nTags: a, b": "tags", "x.\n— la agencia, Drevania": "signature", "x.\nSaludos,\nLindero": "signature", "": "empty", "  ": "empty",
}
CUT = {
    "La agencia pas": "open", "La agencia pasó las imágenes a…": "mark", "we compared this with...": "mark", "la lista [...]": "mark", "se d […]": "mark", "visit Read more": "mark", "a\n```\nx": "open_code", "the sam &nbs": "broken_markup", "páginas p <a href=\"/": "broken_markup",
    "de [demora](https://itz": "broken_markup", "x.\n| a | b": "open_table", "x.\n- uno (/a)\n- dos que fal": "open_list", "x.\n- uno (/a)\n- dos (/serv": "open_list", "Todo bien. Si ": "open", "fue así,": "open",
}


def test_endings(spark):
    cases = [*WHOLE.items(), *CUT.items()]
    rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "i int, t string").select("i", ending_kind(F.col("t")).alias("k")).collect()
    assert {cases[r.i]: r.k for r in rows} == {c: c[1] for c in cases}


def corpus():
    rng = random.Random(3)
    rows = []
    for i in range(1500):
        source = "limited" if i % 3 else "free"
        text = " ".join("La agencia rehízo el mapa del sitio." for _ in range(rng.randrange(1, 60)))[: 10**6]
        text += " " + "x" * rng.randrange(30) + "."
        if source == "limited" and len(text) > 600:
            text = text[:600]
        rows.append((i, text, source, "z"))
    return rows


def test_limits_and_report(spark):
    rows = corpus() + [(9000, "x.\n## Fin " + "a" * 590, "limited", "z"), (9001, None, None, "z"), (9002, "", "free", "z"), (9003, "palabra " * 100_000, None, "z")]
    df = spark.createDataFrame(rows + rows[:20], SCHEMA)
    verdicts = find_truncated(df).cache()
    assert verdicts.count() == len(rows)
    limits = {(r.source, r.n_chars) for r in length_limits(verdicts.select("source", "n_chars")).collect()}
    assert ("limited", 600) in limits and all(s == "limited" for s, _ in limits)
    by = {r.doc_id: r for r in verdicts.collect()}
    assert by[9000].ending == "heading" and by[9000].truncated and by[9000].at_limit
    assert not by[9001].truncated and not by[9002].truncated and by[9003].truncated
    open_at_600 = [i for i, t, s, _ in rows if t and len(t) == 600 and not t.endswith(".")]
    assert open_at_600 and all(by[i].truncated for i in open_at_600)
    assert all(by[i].cause == "limit" for i in open_at_600) and by[9003].cause == "transfer" and by[9000].cause == "limit" and by[9001].cause is None
    report = {r.source: r for r in truncation_report(verdicts).collect()}
    assert report["free"].truncated == 0 and report["limited"].share == round(report["limited"].truncated / report["limited"].documents, 6)
    assert find_truncated(df.limit(0)).count() == 0


def test_hazards_decide(spark):
    """A heading is an ending like any other, but not at a length where texts of its source are cut."""
    rows = [r for r in corpus() if r[2] == "limited"] + [(9000, "x.\n## Fin " + "a" * 590, "limited", "z"), (9004, "x.\n## Fin " + "a" * 600, "limited", "z")]
    by = {r.doc_id: r.truncated for r in find_truncated(spark.createDataFrame(rows, SCHEMA)).filter("doc_id >= 9000").collect()}
    off = {r.doc_id: r.truncated for r in find_truncated(spark.createDataFrame(rows, SCHEMA), fdr=-1.0).filter("doc_id >= 9000").collect()}
    assert by == {9000: True, 9004: False} and off == {9000: False, 9004: False}


def test_exposure(spark):
    """Expected hits follow the texts that reach each neighbouring length, counted one by one."""
    sizes = [5, 5, 5, 5, 5, 5, 3, 8, 8, 9, 20, 21, 40]
    found = {r.n_chars: r.expected for r in length_limits(spark.createDataFrame([("s", n) for n in sizes], "source string, n_chars int"), 4, 1.0).collect()}
    for n in set(sizes) & set(found):
        near = [m for m in range(max(1, n - 4), n + 5) if m != n]
        exposed, ends = sum(sum(s >= m for s in sizes) for m in near), sum(s in near for s in sizes)
        assert abs(found[n] - (ends + 1) / max(1, exposed) * sum(s >= n for s in sizes)) < 1e-9
