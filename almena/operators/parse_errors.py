"""Rows that fail to parse: minimum-cost error parse of raw CSV records.

A record is parsed by dynamic programming over its quotes and delimiters, each of
which may be inserted or deleted at cost 1. The states are those of the strict
grammar (at the start of a cell, in a plain cell, in a quoted cell, after a quote in a
quoted cell) with the number of the cell; text between quotes and delimiters is one
step, for an edit inside it is never cheaper than one at its end. A path of cost 0 is
the strict grammar: it loads if every cell suits its type and length. Otherwise the
edits of a cheapest path state the reason, or, at cost 0, the cells that do not suit.

The path of cost 0 is deterministic and is walked first in one scan; the cost
table is only filled for the records that leave it. There is no bound on the number
of quotes, delimiters or cells.
"""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# What each column type accepts (cells are trimmed first).
NUMBER = re.compile(r"-?[0-9]+(?:[.,][0-9]+)?\Z")
BOOLEAN = frozenset({"true", "false", "sí", "si", "no", "yes"})
URL = re.compile(r"https?://\S*\Z", re.IGNORECASE)
DATE = re.compile(r"([0-9]{4})-([0-9]{2})-([0-9]{2})\Z")


def _is_date(cell: str) -> bool:
    m = DATE.match(cell)
    if not m:
        return False
    try:
        dt.date(int(m[1]), int(m[2]), int(m[3]))
    except ValueError:
        return False
    return True


def _is_email(cell: str) -> bool:
    before, at, after = cell.partition("@")
    return bool(at and before and "@" not in after and "." in after[1:-1] and not re.search(r"\s", cell))


def suits(cell: str, kind: str | None) -> bool:
    """Whether a cell suits its column type; an empty cell suits every type."""
    cell = cell.strip()
    if not cell or kind is None or kind == "text":
        return True
    if kind == "number":
        return NUMBER.match(cell) is not None
    if kind == "boolean":
        return cell.lower() in BOOLEAN
    if kind == "url":
        return URL.match(cell) is not None
    if kind == "email":
        return _is_email(cell)
    if kind == "date":
        return _is_date(cell)
    return True


def _close_of(raw: str, start: int) -> int:
    """Index of the quote that closes a cell opened at ``start``, or -1."""
    at = start + 1
    while True:
        at = raw.find('"', at)
        if at < 0 or raw[at + 1 : at + 2] != '"':
            return at
        at += 2


def strict_cells(raw: str, sep: str) -> list[str] | None:
    """The zero-cost path: unquoted cells, or None where the quoting is broken."""
    if '"' not in raw:
        return raw.split(sep)
    cells, at, end = [], 0, len(raw)
    while True:
        if raw[at : at + 1] == '"':
            close = _close_of(raw, at)
            if close < 0:
                return None
            cells.append(raw[at + 1 : close].replace('""', '"'))
            at = close + 1
            if at == end:
                return cells
            if not raw.startswith(sep, at):
                return None
        else:
            to = raw.find(sep, at)
            if to < 0:
                cells.append(raw[at:])
                return cells
            cells.append(raw[at:to])
            at = to
        at += len(sep)


def _cell_problems(cell: str, kind: str | None, longest: float) -> list[str]:
    out = []
    if len(cell) > longest:
        out.append("too_long")
    if not suits(cell, kind):
        out.append(f"invalid_{kind}")
    return out


REASONS = ("broken_quoting", "cell_count", "cell_too_long", "invalid_value", "unknown_dataset")
# States of the grammar: at the start of a cell, in a plain cell, in a quoted cell, after a quote in a quoted cell.
START, PLAIN, QUOTED, CLOSED = range(4)
_FAR = 1 << 60
# Cost of an edit of each kind: of as many edits, those with fewer quotes are cheaper.
_EDIT = 1 << 30


def _tokens(raw: str, sep: str) -> list[str]:
    """Quotes, delimiters and the texts between them."""
    return [t for t in re.split(f"({re.escape(sep)}|\")", raw) if t]


def _next(state: int, token: str, sep: str) -> tuple[int, int] | None:
    """State after a token and by how many cells it moves on; None where the grammar has no way."""
    if token == sep:
        return (QUOTED, 0) if state == QUOTED else (START, 1)
    if token == '"':
        return (QUOTED if state in (START, CLOSED) else CLOSED if state == QUOTED else PLAIN), 0
    return None if state == CLOSED else (PLAIN if state == START else state, 0)


def repair(raw: str, sep: str, width: int) -> tuple[int, list[str], list[str]]:
    """Minimum-cost parse into ``width`` cells: cost, cells, edits (as operation@cell).

    Of paths with as few edits, those with fewer edits of quotes are preferred, then one
    that takes a token to a deletion, a deletion to an insertion, and the first found.
    """
    tokens = _tokens(raw, sep)
    price = {sep: _EDIT, '"': _EDIT + 1}
    inserts = [(a, t, *step) for a in range(4) for t in ('"', sep) if (step := _next(a, t, sep)) and step != (a, 0)]
    cost = [_FAR] * (4 * width)  # by cell and state
    cost[START] = 0
    back: list[dict[int, tuple[int, str]]] = [{}]  # per token: how each state was entered before it, by insertion

    def insert(ways: dict[int, tuple[int, str]]) -> None:
        """What insertions at this place add: cell by cell, for a delimiter leads only onwards and quotes pass through at most two states."""
        for cell in range(width):
            for _ in range(2):
                for a, t, b, on in inserts:
                    source, target = 4 * cell + a, 4 * (cell + on) + b
                    if cell + on < width and cost[source] + price[t] < cost[target]:
                        cost[target] = cost[source] + price[t]
                        ways[target] = source, t

    insert(back[0])
    taken: list[list[tuple[int, bool] | None]] = []
    for token in tokens:
        new: list[int] = [_FAR] * (4 * width)
        came: list[tuple[int, bool] | None] = [None] * (4 * width)
        for source, c in enumerate(cost):
            if c < _FAR:
                step = _next(source & 3, token, sep)
                if step and (source >> 2) + step[1] < width:
                    target = source + step[0] - (source & 3) + 4 * step[1]
                    if c < new[target]:
                        new[target], came[target] = c, (source, True)
        if token in price:
            for source, c in enumerate(cost):
                if c + price[token] < new[source]:
                    new[source], came[source] = c + price[token], (source, False)
        cost = new
        taken.append(came)
        back.append({})
        insert(back[-1])
    at = min((4 * (width - 1) + state for state in (START, PLAIN, CLOSED)), key=cost.__getitem__)
    total = cost[at] // _EDIT
    made: list[tuple[str, str, int]] = []  # what was done to each token, last first: take, delete or insert; the token; the cell
    for i in range(len(tokens), -1, -1):
        while at in back[i]:
            source, t = back[i][at]
            made.append(("insert", t, source >> 2))
            at = source
        if i:
            source, whole = taken[i - 1][at]
            made.append(("take" if whole else "delete", tokens[i - 1], source >> 2))
            at = source
    made.reverse()
    name = {sep: "delimiter", '"': "quote"}
    edits = [f"{what}_{name[t]}@{cell + 1}" for what, t, cell in made if what != "take"]
    return total, strict_cells("".join(t for what, t, _ in made if what != "delete"), sep), edits


def parse_record(raw: str | None, sep: str | None, kinds: list[str | None] | None, longest: float | None) -> tuple[bool | None, int, list[str] | None, list[str], str | None]:
    """One record: ok (None: blank, no record), cost, cells, edits, reason.

    ok True has cost 0, no edits and no reason. The cost is the smallest number of quotes
    and delimiters to insert or delete; cells that do not suit follow the edits. Reasons:
    unknown_dataset; broken_quoting (the edits mend a quote), cell_count (they mend
    delimiters only); without edits cell_too_long or invalid_value, by the first such cell.
    """
    if raw is None or not raw.strip(" "):
        return None, 0, None, [], None
    if kinds is None:
        return False, 0, None, [], "unknown_dataset"
    sep = sep or ","
    limit = float("inf") if longest is None else longest
    cost, cells, edits = 0, strict_cells(raw, sep), []
    if cells is None or len(cells) != len(kinds):
        cost, cells, edits = repair(raw, sep, len(kinds))
    wrong = [f"{p}@{i + 1}" for i, (c, k) in enumerate(zip(cells, kinds)) for p in _cell_problems(c, k, limit)]
    if not edits and not wrong:
        return True, 0, cells, [], None
    if any("quote" in e for e in edits):
        reason = "broken_quoting"
    elif edits:
        reason = "cell_count"
    else:
        reason = "cell_too_long" if wrong[0].startswith("too_long") else "invalid_value"
    return False, cost, cells, edits + wrong, reason


_PARSED = T.StructType(
    [
        T.StructField("record_id", T.LongType()),
        T.StructField("dataset_id", T.LongType()),
        T.StructField("line_no", T.IntegerType()),
        T.StructField("ok", T.BooleanType()),
        T.StructField("edit_cost", T.IntegerType()),
        T.StructField("cells", T.ArrayType(T.StringType())),
        T.StructField("edits", T.ArrayType(T.StringType())),
        T.StructField("reason", T.StringType()),
    ]
)


def _parse_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    kinds_of: dict[str, list[str]] = {}
    for pdf in batches:
        out = []
        for raw, sep, kinds, longest in zip(pdf["raw"], pdf["sep"], pdf["kinds"], pdf["longest"]):
            if kinds is not None and kinds not in kinds_of:
                kinds_of[kinds] = kinds.split("\x1f")
            out.append(parse_record(raw, sep, None if kinds is None else kinds_of[kinds], None if pd.isna(longest) else longest))
        ok, cost, cells, edits, reason = zip(*out) if out else ((), (), (), (), ())
        yield pd.DataFrame(
            {
                "record_id": pdf["record_id"], "dataset_id": pdf["dataset_id"], "line_no": pdf["line_no"],
                "ok": pd.Series(ok, dtype=object, index=pdf.index), "edit_cost": pd.Series(cost, dtype="int32", index=pdf.index), "cells": pd.Series(cells, dtype=object, index=pdf.index),
                "edits": pd.Series(edits, dtype=object, index=pdf.index), "reason": pd.Series(reason, dtype=object, index=pdf.index),
            }
        )


def parse_records(records: DataFrame, datasets: DataFrame) -> DataFrame:
    """Parse every raw record by the layout of its dataset.

    Result: record_id, dataset_id, line_no, ok, edit_cost, cells, edits, reason; one
    row per input row (repeated rows give repeated results). ``ok`` is null for a
    blank or null record, true for a record that loads, false with a reason
    otherwise; a record whose dataset is unknown has reason ``unknown_dataset``.
    Other columns of the inputs are ignored, so their names cannot clash.
    """
    layout = datasets.dropDuplicates(["dataset_id"]).select(
        F.col("dataset_id").alias("_layout_id"),
        F.col("sep"),
        F.array_join("column_types", "\x1f", "text").alias("kinds"),
        F.col("max_cell_length").cast("double").alias("longest"),
    )
    raw = records.select(F.col("record_id").cast("long"), F.col("dataset_id").cast("long"), F.col("line_no").cast("int"), "raw")
    joined = raw.join(layout, raw["dataset_id"] == layout["_layout_id"], "left").drop("_layout_id")
    return joined.mapInPandas(_parse_batches, _PARSED)


def loaded(parsed: DataFrame) -> DataFrame:
    """The records that fit, once each."""
    return parsed.filter("ok").select("record_id", "dataset_id", "line_no", "cells").dropDuplicates(["record_id"])


def rejected(parsed: DataFrame) -> DataFrame:
    """The records that do not fit, once each, with cost, edits and reason."""
    return parsed.filter("NOT ok").select("record_id", "dataset_id", "line_no", "edit_cost", "edits", "reason").dropDuplicates(["record_id"])


def _typed(cell: Column, kind: str) -> Column:
    value = F.when(F.trim(cell) != "", F.trim(cell))
    if kind == "number":
        return F.translate(value, ",", ".").try_cast("double")
    if kind == "boolean":
        return F.when(value.isNotNull(), F.lower(value).isin("true", "sí", "si", "yes"))
    if kind == "date":
        return value.try_cast("date")
    return value if kind in ("url", "email") else cell


def typed_dataset(parsed: DataFrame, dataset_id: int, names: list[str], kinds: list[str]) -> DataFrame:
    """Records of one dataset as typed columns: number double, boolean, date, else string; empty cells are null."""
    rows = loaded(parsed.filter(F.col("dataset_id") == dataset_id))
    seen: dict[str, int] = {}
    columns = []
    for i, (name, kind) in enumerate(zip(names, kinds)):
        seen[name] = seen.get(name, 0) + 1
        columns.append(_typed(F.get("cells", F.lit(i)), kind).alias(name if seen[name] == 1 else f"{name}_{seen[name]}"))
    return rows.select("record_id", "line_no", *columns)


def profile(parsed: DataFrame) -> DataFrame:
    """Per dataset: records, records that load, and those that do not: structure (quotes or delimiters to mend), cell_too_long, invalid_value, unknown_dataset."""
    structure = F.col("reason").isin("broken_quoting", "cell_count")
    return (
        parsed.filter(F.col("ok").isNotNull()).select("record_id", "dataset_id", "ok", "reason").distinct()
        .groupBy("dataset_id")
        .agg(F.count("*").alias("records"), F.count_if("ok").alias("loaded"), F.count_if(structure).alias("structure"), *(F.count_if(F.col("reason") == r).alias(r) for r in REASONS[2:]))
    )


def edit_counts(parsed: DataFrame) -> DataFrame:
    """Per dataset, reason and operation (insert or delete, quote or delimiter; the cell aside): records that need it and how often."""
    once = rejected(parsed).select("record_id", "dataset_id", "reason", F.explode("edits").alias("_e"))
    each = once.select("record_id", "dataset_id", "reason", F.substring_index("_e", "@", 1).alias("operation"))
    return each.groupBy("dataset_id", "reason", "operation").agg(F.countDistinct("record_id").alias("records"), F.count("*").alias("times"))
