"""Pieces: exact cover, limits, overlaps, boundaries, headings, and independence of the ranges."""

import random

import pytest

from almena.llm.splitting import split_files, split_items

SCHEMA = "item_id long, headings array<string>, md string, tokens int, max_tokens int, overlap_tokens int, piece_no string"


def markdown(rng, n):
    out = []
    while sum(map(len, out)) < n:
        kind = rng.randrange(6)
        text = " ".join("".join(rng.choice("abcdefghñé") for _ in range(rng.randrange(2, 9))) for _ in range(rng.randrange(5, 60)))
        out.append({0: f"## {text[:30]}\n\n", 1: "".join(f"- {text[:40]}\n" for _ in range(9)) + "\n", 2: "```\n# no heading\n" + text + "\n```\n\n", 3: "".join(f"| {text[:20]} | 1 |\n" for _ in range(7)) + "\n"}.get(kind, text.capitalize() + ". " + text + "?\n\n"))
    return "".join(out)


def items():
    rng = random.Random(3)
    rows = [(i, ["T"], markdown(rng, rng.choice([300, 3000, 20_000])), None, rng.choice([64, 128, 256]), rng.choice([0, 10, 30]), "x") for i in range(12)]
    rows.append((50, None, "x" * 9000, 1, 100, 20, "x"))
    rows.append((51, [None, "H"], "日本語の文。" * 900, 1, 64, 5, "x"))
    rows.append((52, [], "é" * 3000, 1, 50, None, "x"))
    rows.append((53, ["a"], None, None, 50, 5, "x"))
    rows.append((54, ["a"], "", None, 50, 5, "x"))
    rows.append((55, ["a"], "no limit " * 99, None, None, 5, "x"))
    rows.append((56, ["a"], "word " * 5000, None, 10, 90, "x"))
    return rows


@pytest.mark.parametrize("size", [500, 4000, 1 << 20])
def test_pieces(spark, size):
    rows = items()
    found = {}
    for r in split_items(spark.createDataFrame(rows + rows[:3], SCHEMA), size).collect():
        found.setdefault(r.item_id, []).append(r)
    assert set(found) == {r[0] for r in rows}
    for key, headings, md, _, most, overlap, _ in rows:
        md, pieces = md or "", sorted(found[key], key=lambda p: p.piece_no)
        assert [p.piece_no for p in pieces] == list(range(1, len(pieces) + 1)) and {p.n_pieces for p in pieces} == {len(pieces)}
        assert (len(pieces) > 1) == (most is not None and -(-len(md) // 4) > most)
        assert all(p.md == md[p.begin : p.finish] and p.headings[: len([h for h in headings or [] if h])] == [h for h in headings or [] if h] for p in pieces)
        assert pieces[0].begin == 0 and pieces[-1].finish == len(md)
        for a, b in zip(pieces, pieces[1:]):
            assert a.begin < b.begin <= a.finish < b.finish and a.finish - b.begin <= 4 * min(overlap or 0, most // 2) + 20
        assert len(pieces) == 1 or all(p.tokens <= most for p in pieces)


def test_same_pieces_for_any_ranges(spark):
    df = spark.createDataFrame(items(), SCHEMA)
    runs = [sorted(map(tuple, split_items(df, size).select("item_id", "begin", "finish").collect())) for size in (700, 5000, 1 << 20)]
    assert runs[0] == runs[1] == runs[2]


def test_natural_boundaries_and_headings(spark):
    md = "# A\n\n" + "One sentence here. " * 12 + "\n\n## B\n\n" + "Another one there. " * 12 + "\n\n# C\n\nEnd.\n"
    rows = split_items(spark.createDataFrame([(1, ["Doc"], md, None, 64, 0, "x")], SCHEMA)).orderBy("piece_no").collect()
    assert rows[1].md.startswith("## B") and rows[1].headings == ["Doc", "A", "B"] and rows[0].headings == ["Doc", "A"]


def test_characters_are_not_torn(spark):
    rows = split_items(spark.createDataFrame([(52, [], "é" * 3000, 1, 50, 0, "x")], SCHEMA)).collect()
    assert all(not r.md.startswith("́") for r in rows)


def test_empty(spark):
    assert split_items(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("size", [300, 5000])
def test_files_are_read_by_byte_ranges(spark, tmp_path, size):
    """Files split by byte ranges give the pieces that their text gives as an item."""
    texts = {f"f{r[0]}.md": r[2] for r in items()[:6]} | {"long.md": "日本語の文。é" * 900, "one.md": "x" * 9000, "empty.md": ""}
    for name, text in texts.items():
        (tmp_path / name).write_bytes(text.encode())
    rows = [(i, [], text, None, 64, 10, "x") for i, text in enumerate(texts.values())]
    want = {(list(texts)[r.item_id], r.piece_no, r.begin, r.finish, r.md, tuple(r.headings), r.n_pieces) for r in split_items(spark.createDataFrame(rows, SCHEMA)).collect()}
    got = [(r.path.rsplit("/", 1)[-1], r.piece_no, r.begin, r.finish, r.md, tuple(r.headings), r.n_pieces) for r in split_files(spark, str(tmp_path), 64, 10, size).collect()]
    short = {x[0] for x in want if x[6] == 1}
    assert len(got) == len(set(got)) and {x for x in got if x[0] not in short} == {x for x in want if x[0] not in short}
    assert {x[0]: x[4] for x in got if x[0] in short} == {n: texts[n] for n in short if texts[n]}


def test_same_pieces_for_odd_texts(spark):
    """Long lines without any boundary, code blocks without an end and blanks of all kinds, whatever the ranges."""
    rng = random.Random(8)
    parts = ["x" * 700, "```\n", "\n\n", "a b. ", "文。文", "\t", "# h\n", "~~~\n", " " * 90, "- i\n", "é", "\r\n", "word " * 40]
    rows = [(i, [], "".join(rng.choice(parts) for _ in range(120)), None, rng.choice([16, 33, 100]), rng.choice([0, 5, 60]), "x") for i in range(25)]
    df = spark.createDataFrame(rows, SCHEMA)
    runs = [sorted(map(tuple, split_items(df, size).select("item_id", "piece_no", "begin", "finish", "n_pieces").collect())) for size in (400, 3000, 1 << 20)]
    assert runs[0] == runs[1] == runs[2]
