"""Percentiles of very large columns: distributed multi-select over mergeable value counts.

A period is summed up by its value counts: group, value, number of times. Counts of
days or imports are joined by adding them, and values may be rounded to a grid of
known relative error first, so that the counts stay small; without rounding results
are exact order statistics. Multi-select then finds the wanted ranks of all groups at
once: every partition proposes the local median of what is still possible, the
weighted median of the proposals becomes the pivot, values are counted below, at and
above it, the ranges ruled out are discarded, and so on until each rank is found. The
values of a group are spread over all partitions by value, so a hot group is no
heavier than the rest. One pass counts for the pivot and proposes medians for both
ranges that may remain.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from almena.session import cut_lineage

#: The searches under way are sent to all tasks up to this number, and joined beyond it.
BROADCAST_SEARCHES = 100_000
#: Once a search has at most this many distinct values left, they are gathered and ranked: a bound on what one task gets.
FEW = 1_024


def rounded(value: Column, rel_error: float) -> Column:
    """The value on a logarithmic grid: off by at most ``rel_error`` of itself (0: as it is)."""
    if not rel_error:
        return value.cast("double")
    base = (1 + rel_error) / (1 - rel_error)
    step = F.ceil(F.log(F.abs(value)) / np.log(base))
    middle = F.signum(value) * F.pow(F.lit(base), step) * (2 / (1 + base))
    return F.when(value == 0, F.lit(0.0)).otherwise(middle).cast("double")


def value_counts(rows: DataFrame, dims: dict[str, Column], value: str, record: str, rel_error: float = 0.0, period: Column | None = None) -> DataFrame:
    """Value counts per dimension: [period,] dim, key, value, n.

    ``dims`` names the groupings, each on its own; a null key is a group of its own. Null
    and NaN values are ignored. Rows that repeat a record count once; a row without
    record id counts as its own record.
    """
    names = list(dims)
    flat = rows.filter(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).select(
        F.col(record).alias("_record"), rounded(F.col(value), rel_error).alias("value"), *([period.alias("period")] if period is not None else []), *(dims[d].cast("string").alias(f"_k{i}") for i, d in enumerate(names))
    )
    once = flat.groupBy(*flat.columns).agg(F.count("*").alias("_n")).withColumn("_n", F.when(F.col("_record").isNull(), F.col("_n")).otherwise(1))
    keys = F.explode(F.array(*(F.struct(F.lit(d).alias("dim"), F.col(f"_k{i}").alias("key")) for i, d in enumerate(names)))).alias("_g")
    lead = ["period"] if period is not None else []
    return once.select(*lead, keys, "value", "_n").groupBy(*lead, "_g.dim", "_g.key", "value").agg(F.sum("_n").alias("n"))


def joined_counts(*counts: DataFrame) -> DataFrame:
    """Counts of several periods or files as those of all together: dim, key, value, n."""
    whole = counts[0].select("dim", "key", "value", "n")
    for more in counts[1:]:
        whole = whole.unionByName(more.select("dim", "key", "value", "n"))
    return whole.groupBy("dim", "key", "value").agg(F.sum("n").alias("n"))


def _chunks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sorted values and running counts of each group within a batch."""
    for pdf in batches:
        if not len(pdf):
            continue
        pdf = pdf.sort_values(["gid", "value"])
        gid, value, n = pdf["gid"].to_numpy(), pdf["value"].to_numpy(), pdf["n"].to_numpy()
        cuts = np.flatnonzero(gid[1:] != gid[:-1]) + 1
        at = np.concatenate(([0], cuts, [len(gid)]))
        yield pd.DataFrame(
            {"gid": gid[at[:-1]], "vals": [value[a:b] for a, b in zip(at, at[1:])], "upto": [np.cumsum(n[a:b]) for a, b in zip(at, at[1:])]}
        )


def _local(vals: np.ndarray, upto: np.ndarray, a: int, b: int) -> tuple[int, float]:
    """Number and median of the chunk's values from position a up to b."""
    before = upto[a - 1] if a else 0
    total = int((upto[b - 1] if b else 0) - before) if b > a else 0
    if total <= 0:
        return 0, float("nan")
    return total, float(vals[np.searchsorted(upto, before + (total + 1) // 2)])


def _propose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Per chunk and search: how many lie below, at and above the pivot, the medians of both sides and their numbers of values."""
    for pdf in batches:
        out = []
        for gid, vals, upto, searches in zip(pdf["gid"], pdf["vals"], pdf["upto"], pdf["searches"]):
            for s in searches:
                a, b = np.searchsorted(vals, s["lo"], "right"), np.searchsorted(vals, s["hi"], "left")
                i, j = np.searchsorted(vals, s["pivot"], "left"), np.searchsorted(vals, s["pivot"], "right")
                i, j = min(max(i, a), b), min(max(j, a), b)
                below, low = _local(vals, upto, a, i)
                same, _ = _local(vals, upto, i, j)
                above, high = _local(vals, upto, j, b)
                out.append((gid, s["p"], below, same, above, low, high, i - a, b - j))
        yield pd.DataFrame(out, columns=["gid", "p", "below", "same", "above", "low", "high", "lows", "highs"])


def _remaining(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Per chunk and search: the values that are still possible, with their numbers."""
    for pdf in batches:
        out = []
        for gid, vals, upto, searches in zip(pdf["gid"], pdf["vals"], pdf["upto"], pdf["searches"]):
            each = np.diff(upto, prepend=0)
            for s in searches:
                a, b = np.searchsorted(vals, s["lo"], "right"), np.searchsorted(vals, s["hi"], "left")
                out += [(gid, s["p"], float(v), int(n)) for v, n in zip(vals[a:b], each[a:b])]
        yield pd.DataFrame(out, columns=["gid", "p", "value", "n"])


def _weighted_median(medians: str, weight: str) -> Column:
    """Weighted median of the proposals gathered in a group (one per chunk)."""
    return F.expr(
        f"""(aggregate(
              array_sort(collect_list(CASE WHEN {weight} > 0 THEN struct({medians} AS v, {weight} AS w) END)),
              struct(CAST(0 AS BIGINT) AS seen, CAST(NULL AS DOUBLE) AS v),
              (s, x) -> IF(s.seen * 2 < sum({weight}), struct(s.seen + x.w AS seen, x.v AS v), s))).v"""
    )


def multi_select(counts: DataFrame, shares: dict[str, float]) -> DataFrame:
    """Order statistics of every group: dim, key, n and one column per wanted share.

    A share p is the value of rank ceil(p n) among the n values of the group: exact for
    the given counts. Groups without values do not appear. ``counts`` holds dim, key,
    value and n > 0, each value of a group once.
    """
    spark = counts.sparkSession
    gid = F.concat_ws("\x1f", "dim", F.when(F.col("key").isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), F.col("key"))))
    keyed = counts.select(gid.alias("gid"), "value", "n").repartition(F.col("gid"), F.col("value")).sortWithinPartitions("gid", "value")
    chunks = cut_lineage(keyed.mapInPandas(_chunks, "gid string, vals array<double>, upto array<bigint>"))
    wanted = F.explode(F.array(*(F.struct(F.lit(c).alias("p"), F.lit(float(p)).alias("share")) for c, p in shares.items())))
    inf = float("inf")
    sizes = chunks.groupBy("gid").agg(F.sum(F.element_at("upto", -1)).alias("n"), F.sum(F.size("vals")).alias("open"))
    state = cut_lineage(
        sizes.select("gid", "n", "open", wanted.alias("w")).select(
            "gid", "n", "w.p", F.greatest(F.lit(1), F.ceil(F.col("w.share") * F.col("n") - 1e-9)).alias("k"),
            F.lit(-inf).alias("lo"), F.lit(inf).alias("hi"), F.lit(-inf).alias("pivot"), "open", F.lit(None).cast("double").alias("answer"),
        )
    )

    def with_searches(which: str) -> DataFrame:
        searches = state.filter(which).groupBy("gid").agg(F.collect_list(F.struct("p", "lo", "hi", "pivot")).alias("searches"))
        return chunks.join(F.broadcast(searches) if number <= BROADCAST_SEARCHES else searches, "gid")

    wide = f"answer IS NULL AND open > {FEW}"
    number = state.filter(wide).count()
    while number:
        counted = (
            with_searches(wide)
            .mapInPandas(_propose, "gid string, p string, below bigint, same bigint, above bigint, low double, high double, lows bigint, highs bigint")
            .groupBy("gid", "p")
            .agg(*(F.sum(c).alias(c) for c in ("below", "same", "lows", "highs")), _weighted_median("low", "below").alias("low"), _weighted_median("high", "above").alias("high"))
        )
        still = F.col("below").isNull()  # found, or left to the last pass
        left, here = F.col("k") <= F.col("below"), F.col("k") <= F.col("below") + F.col("same")
        state = cut_lineage(
            state.join(counted, ["gid", "p"], "left").select(
                "gid", "n", "p",
                F.when(still | left | here, F.col("k")).otherwise(F.col("k") - F.col("below") - F.col("same")).alias("k"),
                F.when(still | left | here, F.col("lo")).otherwise(F.col("pivot")).alias("lo"),
                F.when(~still & left, F.col("pivot")).otherwise(F.col("hi")).alias("hi"),
                F.when(still, F.col("pivot")).when(left, F.col("low")).otherwise(F.col("high")).alias("pivot"),
                F.when(still, F.col("open")).when(left, F.col("lows")).otherwise(F.col("highs")).alias("open"),
                F.when(still, F.col("answer")).when(~left & here, F.col("pivot")).alias("answer"),
            )
        )
        number = state.filter(wide).count()
    number = state.filter("answer IS NULL").count()
    if number:
        rest = with_searches("answer IS NULL").mapInPandas(_remaining, "gid string, p string, value double, n bigint")
        upto = rest.withColumn("upto", F.sum("n").over(Window.partitionBy("gid", "p").orderBy("value")))
        last = upto.join(state.select("gid", "p", "k"), ["gid", "p"]).filter("upto >= k").groupBy("gid", "p").agg(F.min("value").alias("_last"))
        state = state.join(last, ["gid", "p"], "left").withColumn("answer", F.coalesce("answer", "_last"))
    found = state.groupBy("gid", "n").agg(*(F.max(F.when(F.col("p") == c, F.col("answer"))).alias(c) for c in shares))
    tail = F.substring_index("gid", "\x1f", 1)
    rest = F.expr("substring(gid, length(substring_index(gid, '\x1f', 1)) + 2)")
    return found.select(tail.alias("dim"), F.when(rest.startswith("1"), F.expr("substring(gid, length(substring_index(gid, '\x1f', 1)) + 3)")).alias("key"), "n", *shares)


SHARES = {"p50": 0.5, "p90": 0.9, "p99": 0.99}


def response_times(entries: DataFrame, rel_error: float = 0.0) -> DataFrame:
    """Median, p90 and p99 of response_ms per bot_name, site_id and day: dim, key, n, p50, p90, p99, max_rel_error."""
    dims = {"bot_name": F.col("bot_name"), "site_id": F.col("site_id"), "day": F.to_date("ts")}
    counts = value_counts(entries, dims, "response_ms", "log_id", rel_error)
    return multi_select(counts, SHARES).withColumn("max_rel_error", F.lit(float(rel_error)))
