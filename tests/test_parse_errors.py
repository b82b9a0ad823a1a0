"""Minimum-cost record parsing: the strict grammar, reasons, edits, typed loading."""

import datetime as dt
import itertools
import string

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from almena.operators.parse_errors import loaded, parse_record, parse_records, profile, rejected, repair, strict_cells, suits, typed_dataset

KINDS = ["text", "number", "date"]


def reason(raw, sep=",", kinds=KINDS, longest=20):
    return parse_record(raw, sep, kinds, longest)[4]


def test_fitting_records_cost_nothing():
    for raw in ("a,1,2026-01-02", '"a, b",-1.5,', '"say ""x""","2,5",2024-02-29', ' a ,  7 , 2026-01-02 ', ",,"):
        ok, cost, cells, edits, why = parse_record(raw, ",", KINDS, 20)
        assert (ok, cost, edits, why) == (True, 0, [], None) and len(cells) == 3
    assert parse_record('say "x",1,', ",", KINDS, 20)[0]  # a quote inside a cell is plain text


def test_reasons():
    assert reason('"a,1,2026-01-02') == "broken_quoting"
    assert reason('"a"b,1,') == "broken_quoting"
    assert reason('a, "1",') == "invalid_value"
    assert reason("a,1") == "cell_count"
    assert reason("a,1,,,") == "cell_count"
    assert reason("a" * 21 + ",1,") == "cell_too_long"
    assert reason("a,1.2.3,") == "invalid_value"
    assert reason("a,1,2025-02-29") == "invalid_value"
    assert parse_record("a", ",", None, None)[4] == "unknown_dataset"


def test_blank_is_no_record():
    for raw in (None, "", "   "):
        assert parse_record(raw, ",", KINDS, 20)[0] is None
    assert reason("\t\t", "\t") is None  # three empty cells


def test_types():
    assert suits("sí", "boolean") and suits(" NO ", "boolean") and not suits("maybe", "boolean")
    assert suits("HTTPS://x", "url") and not suits("https://x y", "url") and not suits("ftp://x", "url")
    assert suits("a@b.c", "email") and not suits("a@b", "email") and not suits("a@@b.c", "email") and not suits("a@.c", "email") and not suits("@b.c", "email")
    assert suits("-1", "number") and suits("1,5", "number") and not suits("+1", "number") and not suits("1,234.5", "number") and not suits("٣", "number")


def test_edits_say_what_is_wrong():
    cost, cells, edits, why = parse_record('"a,1,2026-01-02', ",", KINDS, 20)[1:]
    assert cost == 1 and why == "broken_quoting" and edits[0].split("@")[0] in ("insert_quote", "delete_quote") and len(cells) == 3
    assert repair("a,b,1,2026-01-02", ",", 3)[0::2] == (1, ["delete_delimiter@1"]) and reason("a,b,1,2026-01-02") == "cell_count"
    assert repair("a,2026-01-02", ",", 3)[0] == 1 and repair('"a"b', ",", 2) == (1, ["a", "b"], ["insert_delimiter@1"])
    assert repair("," * 1000, ",", 3)[0] == 2 and repair("a" + ",a" * 600 + "\"", ",", 700)[0] == 99  # no bound on the number of delimiters
    assert reason('x,"' + "a,b" * 400 + ",1") == "broken_quoting"


def cheapest(raw, width):
    """Fewest insertions and deletions of quotes and delimiters, by breadth-first search over texts."""
    seen, level, cost = {raw}, [raw], 0
    while not any((c := strict_cells(r, ",")) is not None and len(c) == width for r in level):
        near = {r[:i] + t + r[i:] for r in level for i in range(len(r) + 1) for t in '",'} | {r[:i] + r[i + 1 :] for r in level for i in range(len(r)) if r[i] in '",'}
        level, cost = list(near - seen), cost + 1
        seen |= near
    return cost


@pytest.mark.parametrize("width", [1, 2, 3])
def test_cost_is_the_smallest_of_all(width):
    for n in range(6):
        for raw in map("".join, itertools.product('",a', repeat=n)):
            cost, cells, edits = repair(raw, ",", width)
            assert cost == cheapest(raw, width) == len(edits) and len(cells) == width, raw


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=string.ascii_letters + ' ,;"\n', max_size=12), min_size=1, max_size=5))
def test_round_trip(cells):
    raw = ",".join('"' + c.replace('"', '""') + '"' for c in cells)
    assert strict_cells(raw, ",") == cells


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet='ab,"', max_size=12))
def test_cost_is_zero_exactly_for_the_strict_grammar(raw):
    cells = strict_cells(raw, ",")
    strict = cells is not None and len(cells) == 2
    assert (repair(raw, ",", 2)[0] == 0) == strict


def test_tables(spark):
    datasets = spark.createDataFrame([(1, ",", ["n", "n", "d"], KINDS, 20, "x"), (2, ";", ["a"], ["text"], None, "y")], "dataset_id long, sep string, column_names array<string>, column_types array<string>, max_cell_length int, cells string")
    rows = [(1, 1, 1, "a,1,2026-01-02"), (1, 1, 1, "a,1,2026-01-02"), (2, 1, 2, "a,x,"), (3, 1, 3, "  "), (4, 9, 1, "z"), (5, 2, 1, "ok" * 5000), (6, 1, 4, None)]
    records = spark.createDataFrame([(*r, "extra") for r in rows], "record_id long, dataset_id long, line_no int, raw string, reason string")
    parsed = parse_records(records, datasets)
    assert {r.record_id for r in loaded(parsed).collect()} == {1, 5}
    assert {(r.record_id, r.reason) for r in rejected(parsed).collect()} == {(2, "invalid_value"), (4, "unknown_dataset")}
    typed = typed_dataset(parsed, 1, ["n", "n", "d"], KINDS).collect()
    assert [tuple(r) for r in typed] == [(1, 1, "a", 1.0, dt.date(2026, 1, 2))]
    assert {r.dataset_id: r.records for r in profile(parsed).collect()} == {1: 2, 9: 1, 2: 1}
    assert parse_records(records.limit(0), datasets.limit(0)).count() == 0
