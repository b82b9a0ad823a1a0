"""32-bit hashes and differences of lines."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_PRIME, _START = np.uint64(0x01000193), np.uint64(0x811C9DC5)
_LOW = np.uint64(0xFFFFFFFF)


def fnv1a(text: Column) -> Column:
    """FNV-1a of the UTF-8 bytes of a text as an unsigned 32-bit number; null for null."""

    def one(value: str | None) -> int | None:
        if value is None:
            return None
        h = int(_START)
        for b in value.encode():
            h = (h ^ b) * 0x01000193 & 0xFFFFFFFF
        return h

    @F.pandas_udf("long")
    def run(values: pd.Series) -> pd.Series:
        return pd.Series([one(v) for v in values], dtype="Int64")

    return run(text)


def fmix32(value: Column, seed: int = 0) -> Column:
    """The finishing steps of 32-bit Murmur3 over an unsigned 32-bit number xored with a seed; null for null."""

    @F.pandas_udf("long")
    def run(values: pd.Series) -> pd.Series:
        h = values.fillna(0).to_numpy(dtype=np.int64).astype(np.uint64) & _LOW ^ np.uint64(seed)
        for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
            h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor) & _LOW
        return pd.Series((h ^ (h >> np.uint64(16))).astype(np.int64)).astype("Int64").mask(values.isna().to_numpy())

    return run(value)


def line_changes(before: list[str], after: list[str]) -> list[tuple[str, str]]:
    """A shortest list of changes from lines to lines: (same, removed or added, line), removals before additions.

    Equal ends are taken off first; the table of longest common parts covers the rest.
    """
    a, b = 0, 0
    while a < min(len(before), len(after)) and before[a] == after[a]:
        a += 1
    while b < min(len(before), len(after)) - a and before[-1 - b] == after[-1 - b]:
        b += 1
    x, y = before[a : len(before) - b], after[a : len(after) - b]
    common = np.zeros((len(x) + 1, len(y) + 1), dtype=np.int32)
    for i in range(len(x) - 1, -1, -1):
        for j in range(len(y) - 1, -1, -1):
            common[i, j] = common[i + 1, j + 1] + 1 if x[i] == y[j] else max(common[i + 1, j], common[i, j + 1])
    out = [("same", line) for line in before[:a]]
    i = j = 0
    while i < len(x) or j < len(y):
        if i < len(x) and j < len(y) and x[i] == y[j]:
            out.append(("same", x[i]))
            i, j = i + 1, j + 1
        elif i < len(x) and (j == len(y) or common[i + 1, j] >= common[i, j + 1]):
            out.append(("removed", x[i]))
            i += 1
        else:
            out.append(("added", y[j]))
            j += 1
    return out + [("same", line) for line in before[len(before) - b :]]


def line_diff(rows: DataFrame, key: str, before: str, after: str) -> DataFrame:
    """Changes of lines between two texts of each row: key, no, change, line; null is a text without lines."""
    kind = dict(rows.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lines = lambda t: [] if t is None else t.split("\n")
        for pdf in batches:
            out = [(k, n, *c) for k, x, y in zip(pdf["_k"], pdf["_b"], pdf["_a"]) for n, c in enumerate(line_changes(lines(x), lines(y)), 1)]
            yield pd.DataFrame(out, columns=[key, "no", "change", "line"])

    return rows.select(F.col(key).alias("_k"), F.col(before).alias("_b"), F.col(after).alias("_a")).mapInPandas(run, f"{key} {kind}, no int, change string, line string")
