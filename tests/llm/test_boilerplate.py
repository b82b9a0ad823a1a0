"""Site style tree: furniture of a planted site goes, bodies stay."""

import random

from almena.llm.boilerplate import KINDS, fallen_nodes, furniture_lines, page_bodies, page_lines, read_page

SCHEMA = "page_id long, site_id string, url string, title string, markdown string, line_no int"
WORDS = "norte luz mapa rojo campo ruta vela puente sierra barco nube trigo plaza monte faro".split()


def sentence(rng):
    return " ".join(rng.choice(WORDS) for _ in range(9)).capitalize() + f" {rng.randrange(9999)}."


def site(name, n, rng, first):
    rows = []
    for i in range(n):
        title = f"{rng.choice(WORDS)} {first + i}"
        head = ["Skip to content", f"- [Home](https://{name}-x.example/home)", f"- [Shop](https://{name}-x.example/shop)", "", f"Home > Notes > {title}", ""]
        body = [f"# {title}", "", sentence(rng) + " " + sentence(rng), "", "## Key points", "", f"- {rng.choice(WORDS)} (/p/{i}-{rng.randrange(999)})", "", "```", "Sitemap: /x", "```", "", "> " + sentence(rng), "", sentence(rng)]
        tail = ["", "Related posts", f"- [{rng.choice(WORDS)} {i}](https://{name}-x.example/a/{i})", f"Tags: {rng.choice(WORDS)}, {rng.choice(WORDS)}", f"© 2026 {name.capitalize()}. All rights reserved.", "Privacy"]
        lines = head + body + tail
        gone = {k + 1 for k, x in enumerate(lines) if x and (k < len(head) or k >= len(head) + len(body))}
        rows.append(((first + i, name, f"https://{name}-x.example/p/{i}", title if i % 9 else None, "\n".join(lines), 7), gone))
    return rows


def test_planted_site(spark):
    rng = random.Random(4)
    rows = site("alfa", 40, rng, 0) + site("beta", 40, rng, 100) + site("gama", 3, rng, 200)
    data = [r for r, _ in rows]
    df = spark.createDataFrame(data + data[:7] + [(900, "alfa", None, None, None, 1), (901, None, None, "t", "", 1), (902, None, "u", None, "Only a line of its own, nothing else.", 1)], SCHEMA)
    found = {}
    for r in furniture_lines(df).collect():
        assert r.line_no not in found.setdefault(r.page_id, set())
        found[r.page_id].add(r.line_no)
    for (page, *_), gone in rows:
        assert found.get(page, set()) == gone, page
    assert 902 not in found
    bodies = {r.page_id: r for r in page_bodies(df).collect()}
    assert len(bodies) == len(rows) + 3 and bodies[900].body == "" and bodies[900].body_words == 0
    assert bodies[1].body.startswith("# ") and "Privacy" not in bodies[1].body and bodies[1].body_words == len(bodies[1].body.split())


def test_empty_and_long(spark):
    assert furniture_lines(spark.createDataFrame([], SCHEMA)).count() == 0
    long = "palabra " * 200_000 + "."
    assert furniture_lines(spark.createDataFrame([(1, "s", "https://s.example/", None, long + "\n" + long, 1)], SCHEMA)).count() == 0


def test_lines():
    kinds = [(x.no, KINDS[x.kind]) for x in read_page("Título\n\n- [a](https://x/a)\n- [a](https://x/a): texto\n\n| a |\n> b\nTags: a, b\n← antes", "título", "x")]
    assert kinds == [(1, "title"), (3, "link"), (4, "body"), (6, "body"), (7, "body"), (8, "label"), (9, "arrow")]


def test_few_pages(spark):
    """Six pages are enough to tell what all have from what one has."""
    rng = random.Random(5)
    rows = site("alfa", 6, rng, 0)
    found = {(r.page_id, r.line_no) for r in furniture_lines(spark.createDataFrame([r for r, _ in rows], SCHEMA)).collect()}
    everywhere = {(page[0], n) for page, gone in rows for n in gone if page[4].split("\n")[n - 1].startswith(("Skip", "- [Home", "- [Shop", "©", "Privacy", "Related"))}
    assert everywhere <= found and all(n in gone for page, gone in rows for p, n in found if p == page[0])


def test_fallen_nodes_are_bounded(spark):
    """Headings that lead to links, each on few of many pages, do not fall, so what falls stays as large as a page."""
    rng = random.Random(6)
    data = [(i, "s", "https://s.example/", "t", f"# t\n\nTopic {i // 3}x\n\n## Part {i // 3} {WORDS[i % 15]}\n[a](https://s.example/{i})\n\n{sentence(rng)}", 1) for i in range(900)]
    _, nodes, _ = fallen_nodes(page_lines(spark.createDataFrame(data, SCHEMA)))
    assert len(nodes) < 30
