"""Filling fixed-capacity containers: exact-complement hashing over length counts, then best fit.

Only the number of items of each length matters for the plan, and lengths are at
most the capacity: the plan is made on the driver from at most ``capacity``
counts, however many documents there are. For each length from the longest down,
an index of single, pair and triple sums of the available lengths is asked for
combinations that fill the gap exactly; each is used as often as its counts
allow. What is left goes by best fit. Documents then find their container from
their rank among those of equal length; ranks are counted per length and salt, so
no length, however common, gathers in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from almena.llm.tokens import TOKENIZER, token_counter
from almena.session import cut_lineage, parallelism

CAPACITY = 2048

Pattern = tuple[int, dict[int, int]]  # times used, how many of each length


def _exact_fill(gap: int, left: np.ndarray) -> dict[int, int] | None:
    """One, two or three available lengths that sum to ``gap``: the longest single, then pairs, then triples."""
    if left[gap] > 0:
        return {gap: 1}
    have = left[: gap + 1] > 0

    def pair(total: int) -> tuple[int, int] | None:
        if total < 2:
            return None
        upto = total // 2
        both = have[1 : upto + 1] & have[total - 1 : total - upto - 1 : -1]
        for a in np.flatnonzero(both)[::-1][:2]:
            a = int(a) + 1
            if a != total - a or left[a] >= 2:
                return a, total - a
        return None

    def counts(*sizes: int) -> dict[int, int] | None:
        out: dict[int, int] = {}
        for s in sizes:
            out[s] = out.get(s, 0) + 1
        return out if all(left[s] >= n for s, n in out.items()) else None

    if (two := pair(gap)) and (found := counts(*two)):
        return found
    for a in np.flatnonzero(have[: gap - 1])[::-1]:
        a = int(a)
        if a and (two := pair(gap - a)) and (found := counts(a, *two)):
            return found
    return None


def plan_containers(counts: dict[int, int], capacity: int = CAPACITY) -> list[Pattern]:
    """Container patterns for the given number of items of each length (1 to ``capacity``)."""
    left = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in counts.items():
        left[length] += n
    patterns: list[Pattern] = []
    residual: dict[int, int] = {}
    for length in range(capacity, 0, -1):
        while left[length] > 0:
            gap = capacity - length
            if gap == 0:
                patterns.append((int(left[length]), {length: 1}))
                left[length] = 0
                break
            left[length] -= 1
            fill = _exact_fill(gap, left)
            left[length] += 1
            if fill is None:
                residual[length] = int(left[length])
                left[length] = 0
                break
            each = dict(fill)
            each[length] = each.get(length, 0) + 1
            times = min(int(left[s]) // n for s, n in each.items())
            patterns.append((times, each))
            for s, n in each.items():
                left[s] -= n * times
    return patterns + _best_fit(residual, capacity)


def _best_fit(residual: dict[int, int], capacity: int) -> list[Pattern]:
    """Best fit, longest first, with equal containers handled together: gap -> [[times, contents]]."""
    open_: dict[int, list[list]] = {}
    gaps = np.zeros(capacity + 1, dtype=bool)

    def put(gap: int, times: int, contents: dict[int, int]) -> None:
        open_.setdefault(gap, []).append([times, contents])
        gaps[gap] = True

    for length in sorted(residual, reverse=True):
        n = residual[length]
        while n:
            fitting = np.flatnonzero(gaps[length:])
            if len(fitting):
                gap = int(fitting[0]) + length
                group = open_[gap][-1]
                take = min(n, group[0])
                put(gap - length, take, {**group[1], length: group[1].get(length, 0) + 1})
                group[0] -= take
                if not group[0]:
                    open_[gap].pop()
                    gaps[gap] = bool(open_[gap])
                n -= take
            else:
                each = capacity // length
                if n >= each:
                    put(capacity - each * length, n // each, {length: each})
                    n -= n // each * each
                else:
                    put(capacity - n * length, 1, {length: n})
                    n = 0
    return [(times, contents) for groups in open_.values() for times, contents in groups]


def _places(patterns: list[Pattern]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per length: first rank, items per container and first container of each pattern that uses it."""
    rows: dict[int, list[tuple[int, int, int]]] = {}
    used: dict[int, int] = {}
    container = 0
    for times, contents in patterns:
        for length, each in contents.items():
            rows.setdefault(length, []).append((used.get(length, 0), each, container))
            used[length] = used.get(length, 0) + each * times
        container += times
    return {length: tuple(np.array(x, dtype=np.int64) for x in zip(*r)) for length, r in rows.items()}


def count_tokens(documents: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """Tokens of each document: doc_id, n_tokens; a null text has 0, repeated rows count once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = token_counter(tokenizer)
        for batch in batches:
            n = [count(x) if x else 0 for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64())], names=["doc_id", "n_tokens"])

    counted = documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_tokens long")
    return counted.groupBy("doc_id").agg(F.max("n_tokens").alias("n_tokens"))


def pack(lengths: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """A container for each document: doc_id, part, first_token, n_tokens, container_id.

    ``lengths`` holds doc_id and n_tokens. A document above the capacity is cut into
    full parts, which fill a container each, and a rest; no other is split. A document
    without tokens has one row with a null container. Repeated rows of one document
    must have been removed; a null doc_id is a document.
    """
    salts = parallelism(lengths.sparkSession)
    full = F.floor(F.col("n_tokens") / capacity).cast("long")
    parts = F.when(F.col("n_tokens") % capacity == 0, F.greatest(full, F.lit(1))).otherwise(full + 1)
    items = cut_lineage(
        lengths.select("doc_id", "n_tokens", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("part"))
        .select("doc_id", "part", (F.col("part") * capacity).alias("first_token"), F.least(F.lit(capacity), F.col("n_tokens") - F.col("part") * capacity).cast("int").alias("n_tokens"))
        .withColumn("salt", F.pmod(F.xxhash64("doc_id", "part"), F.lit(salts)).cast("int"))
    )
    counts = items.filter("n_tokens > 0").groupBy("n_tokens", "salt").agg(F.count("*").alias("n"))
    before = Window.partitionBy("n_tokens").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(F.col("n_tokens").alias("_l"), F.col("salt").alias("_s"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_start"))
    histogram = {r["n_tokens"]: r["n"] for r in counts.groupBy("n_tokens").agg(F.sum("n").alias("n")).collect()}  # at most ``capacity`` rows
    places = _places(plan_containers(histogram, capacity))

    @F.pandas_udf("long")
    def container(length: pd.Series, rank: pd.Series) -> pd.Series:
        out = np.full(len(length), -1, dtype=np.int64)
        sizes, ranks = length.to_numpy(), rank.to_numpy()
        for size in np.unique(sizes):
            at = np.flatnonzero(sizes == size)
            first, each, base = places[int(size)]
            i = np.searchsorted(first, ranks[at], side="right") - 1
            out[at] = base[i] + (ranks[at] - first[i]) // each[i]
        return pd.Series(out)

    within = Window.partitionBy("n_tokens", "salt").orderBy("doc_id", "part")
    ranked = items.filter("n_tokens > 0").withColumn("_rank", F.row_number().over(within) - 1)
    placed = ranked.join(starts, (F.col("n_tokens") == F.col("_l")) & (F.col("salt") == F.col("_s")))
    filled = placed.select("doc_id", "part", "first_token", "n_tokens", container("n_tokens", F.col("_rank") + F.col("_start")).alias("container_id"))
    empty = items.filter("n_tokens = 0").select("doc_id", "part", "first_token", "n_tokens", F.lit(None).cast("long").alias("container_id"))
    return filled.unionByName(empty)
