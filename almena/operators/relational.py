"""Reusable relational operators: top-k, latest rows, as-of and interval joins, calendars, roll-ups, profiles."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from almena.functions.url import prefixes
from almena.session import cut_lineage


def top(df: DataFrame, n: int, *order: Column) -> DataFrame:
    """The first ``n`` rows by an order that must be total (end it with a key)."""
    return df.orderBy(*order).limit(n)


def top_per(df: DataFrame, by: list[str], n: int, *order: Column) -> DataFrame:
    """The first ``n`` rows per group; groups are cut before they are gathered."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("_n") <= n).drop("_n")


def latest(df: DataFrame, by: list[str], *order: str) -> DataFrame:
    """The row of each key that is last by ``order`` (null is earliest); combined before the exchange."""
    rest = [c for c in df.columns if c not in by and c not in order]
    packed = F.max_by(F.struct(*order, *rest), F.struct(*order, *(F.hash(c) for c in rest)) if rest else F.struct(*order)).alias("_row")
    return df.groupBy(*by).agg(packed).select(*by, "_row.*")


def previous_of(df: DataFrame, by: list[str], at: str, key: str) -> DataFrame:
    """As-of join with the nearest earlier row of the same group: previous_<key>, previous_<at>."""
    w = Window.partitionBy(*by).orderBy(at, key)
    return df.withColumn(f"previous_{key}", F.lag(key).over(w)).withColumn(f"previous_{at}", F.lag(at).over(w))


def as_of_gap(df: DataFrame, by: list[str], day: str, days: int, else_oldest: bool = True) -> DataFrame:
    """Each group's last row with the latest one at least ``days`` before it, or else the oldest: last_<day>, reference_<day>."""
    last = df.groupBy(*by).agg(F.max(day).alias("_last"), F.min(day).alias("_first"))
    old = df.join(last, by).groupBy(*by, "_last", "_first").agg(F.max(F.when(F.datediff("_last", day) >= days, F.col(day))).alias("_ref"))
    reference = F.coalesce("_ref", F.when(F.col("_first") < F.col("_last"), F.col("_first"))) if else_oldest else F.col("_ref")
    return old.select(*by, F.col("_last").alias(f"last_{day}"), reference.alias(f"reference_{day}"))


def within_intervals(points: DataFrame, intervals: DataFrame, day: str, begin: str, end: str) -> DataFrame:
    """Points in closed intervals of days: the intervals are cut into weeks, so that the join has an equal key."""
    weeks = intervals.withColumn("_week", F.explode(F.sequence(F.date_trunc("week", begin).cast("date"), F.date_trunc("week", end).cast("date"), F.expr("interval 7 days"))))
    at = points.withColumn("_week", F.date_trunc("week", day).cast("date"))
    return at.join(weeks, "_week").filter(F.col(day).between(F.col(begin), F.col(end))).drop("_week")


def every_day(df: DataFrame, by: list[str], day: str, values: list[str]) -> DataFrame:
    """Each group's days from its first to its last, missing ones with 0."""
    ends = df.groupBy(*by).agg(F.min(day).alias("_a"), F.max(day).alias("_b")) if by else df.agg(F.min(day).alias("_a"), F.max(day).alias("_b"))
    days = ends.select(*by, F.explode(F.sequence("_a", "_b")).alias(day))
    return days.join(df, [*by, day], "left").select(*by, day, *(F.coalesce(v, F.lit(0)).alias(v) for v in values))


def complete_months(today: Column, n: int) -> Column:
    """First days of the last ``n`` complete months, newest first; a month counts on its last day."""
    whole = F.when(today == F.last_day(today), F.trunc(today, "month")).otherwise(F.add_months(F.trunc(today, "month"), -1))
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.add_months(whole, -i))


def folder_tree(df: DataFrame, path: Column, measures: dict[str, Column]) -> DataFrame:
    """Measures for every folder and all above it: folder and the measures, aggregated over what lies below."""
    return df.select("*", F.explode(prefixes(path)).alias("folder")).groupBy("folder").agg(*(m.alias(n) for n, m in measures.items()))


def union_tagged(parts: dict[str, DataFrame], key: str) -> DataFrame:
    """Keys of several frames with the sorted names of those they come from."""
    tagged = [df.select(key).distinct().withColumn("source", F.lit(name)) for name, df in parts.items()]
    whole = reduce(DataFrame.unionByName, tagged)
    return whole.groupBy(key).agg(F.array_sort(F.collect_set("source")).alias("sources"))


def profile_columns(df: DataFrame) -> DataFrame:
    """Per column: its type by content (number, boolean, url, email, date, text), rows, empty, distinct."""
    texts = df.select(*(F.col(f"`{c}`").cast("string").alias(c) for c in df.columns))
    long = texts.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.trim(F.col(f"`{c}`")).alias("value")) for c in df.columns))).alias("_s")).select("_s.*")
    filled = F.coalesce(F.col("value"), F.lit("")) != ""
    every = lambda pattern: F.coalesce(F.bool_and(F.when(filled, F.col("value").rlike(pattern))), F.lit(False))
    grouped = long.groupBy("column").agg(
        F.count("*").alias("n_rows"), F.count_if(~filled).alias("empty"), F.countDistinct(F.when(filled, F.col("value"))).alias("distinct_values"),
        every(r"^-?[0-9]+([.,][0-9]+)?$").alias("_n"), every(r"(?i)^(true|false|s[ií]|no|yes)$").alias("_b"), every(r"(?i)^https?://\S+$").alias("_u"), every(r"^[^@\s]+@[^@\s]+\.[^@\s]+$").alias("_e"), every(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$").alias("_d"),
    )
    kind = F.when(F.col("_n"), "number").when(F.col("_b"), "boolean").when(F.col("_u"), "url").when(F.col("_e"), "email").when(F.col("_d"), "date").otherwise("text")
    return grouped.select("column", kind.alias("type"), "n_rows", "empty", "distinct_values")


def column_samples(df: DataFrame, n: int = 3) -> DataFrame:
    """The ``n`` smallest distinct values of each column as text, and whether the column is a key (filled and without repeats): column, samples, is_key."""
    total = df.agg(F.count("*").alias("_rows"))
    long = df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.trim(F.col(f"`{c}`").cast("string")).alias("value")) for c in df.columns))).alias("_s")).select("_s.*")
    each = long.filter(F.coalesce("value", F.lit("")) != "").groupBy("column", "value").agg(F.count("*").alias("_n"))
    placed = each.withColumn("_k", F.row_number().over(Window.partitionBy("column").orderBy("value"))).filter(F.col("_k") <= n)
    first = placed.groupBy("column").agg(F.array_sort(F.collect_list("value")).alias("samples"))
    distinct = each.groupBy("column").agg(F.count("*").alias("_d"))
    every = df.sparkSession.createDataFrame([(c,) for c in df.columns], "column string")
    j = every.join(distinct, "column", "left").join(first, "column", "left").crossJoin(F.broadcast(total))
    return j.select("column", F.coalesce("samples", F.array().cast("array<string>")).alias("samples"), ((F.coalesce("_d", F.lit(0)) == F.col("_rows")) & (F.col("_rows") > 0)).alias("is_key"))


def repeated_rows(df: DataFrame, key: str) -> DataFrame:
    """Rows equal to another in all columns but the key, after the first by the key: key, first."""
    rest = [c for c in df.columns if c != key]
    same = Window.partitionBy(*(F.col(f"`{c}`") for c in rest))
    return df.withColumn("first", F.min(key).over(same)).filter(F.col(key) != F.col("first")).select(key, "first")


def state_changes(detected: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """Full outer comparison of detected keys with stored ones: key and new, open, reopened or resolved.

    ``stored`` holds the key and ``open``. Keys that are closed and not detected stay out.
    """
    a = detected.select(F.col(key), F.lit(True).alias("_seen")).distinct()
    both = a.join(stored.select(F.col(key), F.col("open").alias("_open"), F.lit(True).alias("_known")), key, "full")
    seen, known, was = F.coalesce("_seen", F.lit(False)), F.coalesce("_known", F.lit(False)), F.coalesce("_open", F.lit(False))
    state = F.when(seen & ~known, "new").when(seen & was, "open").when(seen, "reopened").when(was, "resolved")
    return both.select(key, state.alias("state")).filter("state IS NOT NULL")


def falling_streak(df: DataFrame, by: list[str], order: str, value: str) -> DataFrame:
    """Number of drops in a row that end at each group's last row: by, streak."""
    w = Window.partitionBy(*by).orderBy(order)
    steps = df.withColumn("_drop", F.coalesce(F.col(value) < F.lag(value).over(w), F.lit(False)))
    back = Window.partitionBy(*by).orderBy(F.col(order).desc())
    run = steps.withColumn("_breaks", F.sum(F.when(F.col("_drop"), 0).otherwise(1)).over(back))
    return run.groupBy(*by).agg(F.count_if(F.col("_drop") & (F.col("_breaks") == 0)).alias("streak"))


def _choices(values: Column, most: int, least: int) -> Column:
    """All choices of ``least`` of the ``values``, an array in a fixed order, as hashes; none of fewer or more than ``most`` values."""
    of = lambda n: F.array(*(F.xxhash64(*(F.get(values, F.lit(i)) for i in kept)) for kept in combinations(range(n), least)))
    out = F.array().cast("array<bigint>")
    for n in range(least, most + 1):
        out = F.when(F.size(values) == n, of(n)).otherwise(out)
    return out


def sharing_pairs(sets: DataFrame, key: str, column: str, most: int, least: int) -> DataFrame:
    """Pairs of keys whose sets of at most ``most`` values share at least ``least``: a < b, shared.

    Such sets have some choice of ``least`` values in common and meet there, not on single
    values; equal sets are one class. ``sets`` has a row for each key.
    """
    owned = cut_lineage(sets.filter(F.col(key).isNotNull() & F.size(column).between(least, most)).select(F.col(key).alias("_k"), F.array_sort(column).alias("_v")))
    members = cut_lineage(owned.withColumn("_c", F.min("_k").over(Window.partitionBy("_v"))).select("_k", "_c", "_v"))
    classes = members.filter("_k = _c").select("_c", "_v", F.explode(_choices(F.col("_v"), most, least)).alias("_h"))
    side = lambda x: classes.select("_h", F.col("_c").alias(f"_c{x}"), F.col("_v").alias(f"_v{x}"))
    alike = side("a").hint("merge").join(side("b"), "_h").filter("_ca < _cb").groupBy("_ca", "_cb").agg(F.first(F.size(F.array_intersect("_va", "_vb"))).alias("shared")).filter(F.col("shared") >= least)
    of = lambda x: members.select(F.col("_c").alias(f"_c{x}"), F.col("_k").alias(f"_k{x}"))
    across = alike.join(of("a"), "_ca").join(of("b"), "_cb").select(F.least("_ka", "_kb").alias("a"), F.greatest("_ka", "_kb").alias("b"), "shared")
    same = members.select("_c", F.col("_k").alias("a"), F.size("_v").alias("shared")).join(members.select("_c", F.col("_k").alias("b")), "_c").filter("a < b").select("a", "b", "shared")
    return across.unionByName(same)
