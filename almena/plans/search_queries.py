"""Search and traffic reports on the order tables: queries, pages, months, channels, days, experiments.

Stand-ins: a line item is a row of a search export (query: part modulo 500, page:
supplier, clicks: quantity, impressions: price over 10, position: 1 + 100 times the
discount); orders are days and months of a page (customer modulo 200); events are
observations of prompts and measurements of URLs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from almena.functions.stats import ratio_effect, relative_change, welch_p
from almena.functions.text import ratio, round_up
from almena.operators import search
from almena.operators.relational import every_day, falling_streak, sharing_pairs, top_per, within_intervals
from almena.session import table


def search_rows(spark: SparkSession, sf_dir: str, query: Column | None = None) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        (F.col("l_partkey") % 500 if query is None else query).alias("query"), F.col("l_suppkey").alias("page"), F.col("l_quantity").cast("long").alias("clicks"),
        F.floor(F.col("l_extendedprice") / 10).cast("long").alias("impressions"), (1 + F.col("l_discount") * 100).alias("position"),
    )


def days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy(F.to_date("o_orderdate").alias("date")).agg(F.count("*").alias("clicks"), F.sum(F.floor(F.col("o_totalprice") / 100).cast("long")).alias("impressions"))


def months(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy((F.col("o_custkey") % 200).alias("page"), F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(F.count("*").alias("clicks"))


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last observation per prompt, engine and day: score 5 for a mention, 2 more for a high place."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("prompt"), F.col("event_type").alias("engine"), F.to_date("ts").alias("date"), F.when(F.col("value") > 100, 5).when(F.col("value") > 50, 2).otherwise(0).alias("score"), "event_id")
    return e.groupBy("prompt", "engine", "date").agg(F.max_by("score", "event_id").alias("score"))


_weighted = lambda: round_up(F.sum(F.col("position") * F.col("impressions")) / F.sum("impressions"), 4)


def r13_totals(spark, sf_dir):
    """Clicks, impressions, rate and weighted position in all."""
    r = search_rows(spark, sf_dir)
    return r.agg(F.sum("clicks").alias("clicks"), F.sum("impressions").alias("impressions"), round_up(F.sum("clicks") / F.sum("impressions"), 6).alias("ctr"), _weighted().alias("position"), F.countDistinct("query").alias("queries"), F.countDistinct("page").alias("pages"))


def _by_query(spark, sf_dir):
    pages = search_rows(spark, sf_dir).groupBy("query", "page").agg(F.sum("clicks").alias("clicks"), F.sum("impressions").alias("impressions"), F.sum(F.col("position") * F.col("impressions")).alias("_w"))
    return pages.groupBy("query").agg(F.sum("clicks").alias("clicks"), F.sum("impressions").alias("impressions"), round_up(F.sum("_w") / F.sum("impressions"), 4).alias("position"), F.count("*").alias("pages"), F.max_by("page", F.struct("impressions", "page")).alias("top_page"))


def r13_top_queries(spark, sf_dir):
    """The 100 queries with most clicks, their pages and the page with most impressions."""
    return _by_query(spark, sf_dir).orderBy(F.desc("clicks"), "query").limit(100)


def r13_opportunities(spark, sf_dir):
    """Queries in places 4 to 15 with enough impressions."""
    return _by_query(spark, sf_dir).filter((F.col("position").between(4, 15)) & (F.col("impressions") >= 50)).select("query", "impressions", "position")


def r13_low_ctr(spark, sf_dir):
    """Pages in the first ten places whose rate is under the floor of their place."""
    p = search_rows(spark, sf_dir).groupBy("page").agg(F.sum("clicks").alias("clicks"), F.sum("impressions").alias("impressions"), _weighted().alias("position"))
    floor = F.when(F.col("position") <= 3, 0.05).when(F.col("position") <= 6, 0.025).otherwise(0.01)
    return p.filter((F.col("impressions") >= 100) & (F.col("position") <= 10) & (ratio(F.col("clicks"), F.col("impressions")) < floor))


def _monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a search export with part and month as the query."""
    return search_rows(spark, sf_dir, F.concat_ws(" ", "l_partkey", F.date_format("l_shipdate", "yyyy-MM")))


def r14_conflicts(spark, sf_dir):
    """Queries (part and month) for which several pages hold a tenth of the impressions or more: winner, runner-up, share, severity."""
    return search.conflicts(_monthly(spark, sf_dir))[0]


def r14_pairs(spark, sf_dir):
    """Pairs of pages that compete for two queries or more."""
    return search.conflicts(_monthly(spark, sf_dir))[1]


def page_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages (customers modulo 200) by month: clicks (price over 1,000), impressions (price over 100) and position (1 to 20 by order)."""
    o = table(spark, sf_dir, "orders")
    return o.select(
        (F.col("o_custkey") % 200).cast("string").alias("page"), F.date_format("o_orderdate", "yyyy-MM").alias("month"), F.floor(F.col("o_totalprice") / 1000).cast("long").alias("clicks"), F.floor(F.col("o_totalprice") / 100).cast("long").alias("impressions"), (1 + F.col("o_orderkey") % 20).cast("double").alias("position"),
    )


def r16_declining(spark, sf_dir):
    """Pages whose last three months lost a fifth or more of 30 clicks or more against the three before: places, last year, season, streak, reasons."""
    return search.declining(page_months(spark, sf_dir))


def r17_part_topics(spark, sf_dir):
    """Names of parts as queries, in topics for each kind of part: topics by status."""
    r = search_rows(spark, sf_dir, F.col("l_partkey")).join(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("query"), "p_name", "p_brand"), "query")
    return search.topics(r.select(F.col("p_brand").alias("site_id"), F.col("p_name").alias("query"), "page", "clicks", "impressions", "position"), most=500).groupBy("site_id", "status").agg(F.count("*").alias("topics"), F.sum("queries").alias("queries"))


def a22_measures(spark, sf_dir):
    """Six measures of visits and their ratios per country, orders being visits."""
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    rows = o.select(
        F.col("c_nationkey").alias("page"), F.lit(1).alias("sessions"), (F.col("o_custkey") % 2).alias("users"), F.when(F.col("o_orderstatus") == "F", 1).otherwise(0).alias("engaged_sessions"), (F.col("o_orderkey") % 100).alias("engagement_sec"), F.when(F.col("o_orderpriority") == "1-URGENT", 1).otherwise(0).alias("key_events"), F.round("o_totalprice", 0).cast("long").alias("revenue"),
    )
    return rows.groupBy("page").agg(*search.measures())


def m5_noise(spark, sf_dir):
    """Threshold of the site's usual week-to-week noise: twice the deviation of the changes before the last week, 0.15 at least."""
    w = w6_weekly_noise(spark, sf_dir).filter("block > 0")
    return w.agg(F.round(F.greatest(F.lit(0.15), 2 * F.coalesce(F.stddev_samp("change"), F.lit(0.0))), 5).alias("threshold"), F.count("change").alias("weeks"))


def u5_shared_brands(spark, sf_dir):
    """Pairs of suppliers that share eight or more of their ten brands of largest quantity."""
    line = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    sold = line.groupBy("l_suppkey", "p_brand").agg(F.sum("l_quantity").alias("n"))
    top = top_per(sold, ["l_suppkey"], 10, F.desc("n"), F.col("p_brand")).groupBy("l_suppkey").agg(F.collect_set("p_brand").alias("own"))
    return sharing_pairs(top, "l_suppkey", "own", 10, 8)


def w7_streaks(spark, sf_dir):
    """Months of falling clicks in a row up to the last month of each page."""
    return falling_streak(months(spark, sf_dir), ["page"], "month", "clicks")


def a20_monthly(spark, sf_dir):
    """Clicks per page with the first and last month as columns by quarter."""
    m = months(spark, sf_dir).withColumn("quarter", F.concat(F.lit("q"), F.quarter(F.to_date(F.concat("month", F.lit("-01")))).cast("string")))
    return m.groupBy("page").pivot("quarter", ["q1", "q2", "q3", "q4"]).agg(F.sum("clicks"))


def r22_channels(spark, sf_dir):
    """Sessions, revenue and share per channel."""
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    g = o.groupBy(F.col("c_mktsegment").alias("channel")).agg(F.count("*").alias("sessions"), F.round(F.sum("o_totalprice"), 2).alias("revenue"))
    return g.withColumn("share", round_up(F.col("sessions") / F.sum("sessions").over(Window.partitionBy()), 4))


def r22_days(spark, sf_dir):
    """Sessions per day, a column per channel."""
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    names = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
    g = o.groupBy(F.to_date("o_orderdate").alias("date"))
    return g.agg(F.count("*").alias("sessions"), *(F.count_if(F.col("c_mktsegment") == n).alias(n.lower()) for n in names))


def w3_trends(spark, sf_dir):
    """Observations against the one before of the same prompt and engine: better, worse, same, first."""
    o = observations(spark, sf_dir)
    step = F.col("score") - F.lag("score").over(Window.partitionBy("prompt", "engine").orderBy("date"))
    return o.withColumn("trend", F.when(step.isNull(), "first").when(step > 0, "better").when(step < 0, "worse").otherwise("same")).groupBy("engine", "trend").agg(F.count("*").alias("n"))


def a31_weekly(spark, sf_dir):
    """Mean score per week (from Monday) and engine, and over all."""
    o = observations(spark, sf_dir).withColumn("week", F.to_date(F.date_trunc("week", "date")))
    return o.rollup("week", "engine").agg(round_up(F.avg("score"), 6).alias("score"), F.grouping("engine").cast("int").alias("all_engines"), F.count("*").alias("n")).filter("week IS NOT NULL")


def a28_medians(spark, sf_dir):
    """Median value per day and kind of event."""
    return table(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("date"), "event_type").agg(F.round(F.percentile("value", 0.5), 6).alias("median"))


def a29_noise(spark, sf_dir):
    """Mean and sample deviation of events per user, 0 with one value."""
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.round(F.avg("value"), 4).alias("mean"), F.round(F.coalesce(F.stddev_samp("value"), F.lit(0.0)), 4).alias("deviation"))


def w4_deltas(spark, sf_dir):
    """Last against previous value of each user and kind of event."""
    w = Window.partitionBy("user_id", "event_type").orderBy(F.desc("ts"), F.desc("event_id"))
    e = table(spark, sf_dir, "events").withColumn("n", F.row_number().over(w)).withColumn("before", F.lead("value").over(w)).filter("n = 1")
    return e.select("user_id", "event_type", F.round(F.col("value") - F.col("before"), 6).alias("delta"))


def w5_rolling(spark, sf_dir):
    """Clicks per day with the mean of the last seven rows of the series, days without clicks counting 0."""
    d = every_day(days(spark, sf_dir), [], "date", ["clicks"])  # a row a day
    return d.select("date", "clicks", F.round(F.avg("clicks").over(Window.partitionBy().orderBy("date").rowsBetween(-6, 0)), 6).alias("rolling"))


def w6_weekly_noise(spark, sf_dir):
    """Blocks of seven days counted from the end of the series, each with its change against the block before."""
    d = every_day(days(spark, sf_dir), [], "date", ["clicks"])
    block = F.floor(F.datediff("_last", "date") / 7).cast("long").alias("block")
    b = d.crossJoin(F.broadcast(d.agg(F.max("date").alias("_last")))).groupBy(block).agg(F.max("date").alias("last_day"), F.sum("clicks").alias("clicks"), F.count("*").alias("n")).filter("n = 7")
    w = Window.partitionBy().orderBy(F.desc("block"))  # a row a week
    return b.select("block", "last_day", "clicks", F.round(relative_change(F.lag("clicks").over(w), F.col("clicks")), 6).alias("change"))


def a30_last_28(spark, sf_dir):
    """Last 28 days against the 28 before, from the last day with data."""
    d = days(spark, sf_dir)
    age = F.datediff("_last", "date")
    return d.crossJoin(F.broadcast(d.agg(F.max("date").alias("_last")))).agg(*(F.sum(F.when(age.between(a, a + 27), F.col(c)).otherwise(0)).alias(f"{c}_{n}") for c in ("clicks", "impressions") for n, a in (("now", 0), ("before", 28))))


def j13_in_intervals(spark, sf_dir):
    """Orders that fall in the first ten days of a quarter, per quarter."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("day"))
    q = o.select(F.trunc("day", "quarter").alias("begin")).distinct().withColumn("end", F.date_add("begin", 9))
    return within_intervals(o, q, "day", "begin", "end").groupBy("begin").agg(F.count("*").alias("orders"))


def r29_experiment(spark, sf_dir):
    """Effect of a change half way through the days: even customers against odd ones, 28 days before and after."""
    o = table(spark, sf_dir, "orders").groupBy(F.to_date("o_orderdate").alias("date"), (F.col("o_custkey") % 2 == 0).alias("test")).agg(F.count("*").alias("clicks"))
    span = o.agg(F.min("date").alias("_a"), F.max("date").alias("_b")).select(F.expr("date_add(_a, cast(floor(datediff(_b, _a) / 2) as int))").alias("change"))
    gap = F.datediff("date", "change")
    side = o.crossJoin(F.broadcast(span)).filter(gap.between(-28, -1) | gap.between(1, 28)).withColumn("after", gap > 0)
    of = lambda test, after: F.when((F.col("test") == test) & (F.col("after") == after), F.col("clicks"))
    stats = side.agg(*(f(of(t, a)).alias(f"{n}_{'t' if t else 'c'}{'a' if a else 'b'}") for n, f in (("m", F.avg), ("v", F.var_samp), ("n", F.count), ("s", F.sum)) for t in (True, False) for a in (True, False)))
    c = F.col
    effect = ratio_effect(c("s_tb").cast("double"), c("s_ta").cast("double"), c("s_cb").cast("double"), c("s_ca").cast("double"))
    return stats.select(F.round(effect, 6).alias("effect"), F.round(welch_p(c("m_tb"), c("v_tb"), c("n_tb"), c("m_ta"), c("v_ta"), c("n_ta")), 5).alias("p_value"))


_R = "WITH r AS (SELECT l_partkey % 500 AS query, l_suppkey AS page, CAST(l_quantity AS BIGINT) AS clicks, CAST(floor(l_extendedprice / 10) AS BIGINT) AS impressions, 1 + l_discount * 100 AS position FROM lineitem)\n"


def _up(x: str, d: int = 4) -> str:
    return f"floor(({x}) * {10**d}.0 + 0.5) / {10**d}.0"


_W = _up("sum(position * impressions) / sum(impressions)")
_Q = _R + ", g AS (SELECT query, page, sum(clicks) AS clicks, sum(impressions) AS impressions, sum(position * impressions) AS w FROM r GROUP BY 1, 2), q AS (SELECT query, CAST(sum(clicks) AS BIGINT) AS clicks, CAST(sum(impressions) AS BIGINT) AS impressions, " + _up("sum(w) / sum(impressions)") + " AS position, count(*) AS pages, arg_max(page, impressions * 100000 + page) AS top_page FROM g GROUP BY 1)\n"
_C = (
    "WITH r AS (SELECT l_partkey || ' ' || strftime(l_shipdate, '%Y-%m') AS query, l_suppkey AS page, CAST(l_quantity AS BIGINT) AS clicks, CAST(floor(l_extendedprice / 10) AS BIGINT) AS impressions, 1 + l_discount * 100 AS position FROM lineitem), "
    "g AS (SELECT query, page, sum(clicks) AS clicks, sum(impressions) AS impressions, sum(position * impressions) AS w FROM r GROUP BY 1, 2), t AS (SELECT *, sum(impressions) OVER (PARTITION BY query) AS total, sum(clicks) OVER (PARTITION BY query) AS all_clicks FROM g), "
    "s AS (SELECT query, page, total, all_clicks, floor(impressions / total * 100 + 0.5) AS share, floor(w / impressions * 10 + 0.5) / 10 AS position, row_number() OVER (PARTITION BY query ORDER BY clicks DESC, impressions DESC, page) AS n FROM t WHERE total >= 30 AND impressions >= 0.1 * total AND impressions >= 5), "
    "c AS (SELECT query, CAST(max(total) AS BIGINT) AS impressions, CAST(max(all_clicks) AS BIGINT) AS clicks, CAST(count(*) AS INTEGER) AS pages, max(page) FILTER (WHERE n = 1) AS winner, max(page) FILTER (WHERE n = 2) AS runner_up, CAST(max(share) FILTER (WHERE n = 2) AS BIGINT) AS share, "
    "abs(max(position) FILTER (WHERE n = 1) - max(position) FILTER (WHERE n = 2)) AS apart, min(position) AS best FROM s GROUP BY 1 HAVING count(*) > 1)\n"
)
_D = "WITH d AS (SELECT CAST(o_orderdate AS DATE) AS date, count(*) AS clicks, CAST(sum(floor(o_totalprice / 100)) AS BIGINT) AS impressions FROM orders GROUP BY 1)\n"
_F = _D + ", f AS (SELECT CAST(x.generate_series AS DATE) AS date, coalesce(d.clicks, 0) AS clicks FROM generate_series((SELECT min(date) FROM d), (SELECT max(date) FROM d), INTERVAL 1 DAY) x LEFT JOIN d ON d.date = CAST(x.generate_series AS DATE))\n"
_WEEKS = (
    _F + ", n AS (SELECT date, clicks, CAST(floor((row_number() OVER (ORDER BY date DESC) - 1) / 7) AS BIGINT) AS block FROM f), b AS (SELECT block, max(date) AS last_day, CAST(sum(clicks) AS BIGINT) AS clicks FROM n GROUP BY 1 HAVING count(*) = 7), l AS (SELECT *, lag(clicks) OVER (ORDER BY block DESC) AS before FROM b), "
    "p AS (SELECT block, last_day, clicks, CASE WHEN before = 0 THEN CASE WHEN clicks = 0 THEN 0 ELSE 1 END ELSE (clicks - before) / before END AS change FROM l)\n"
)
_M = "WITH m AS (SELECT o_custkey % 200 AS page, strftime(o_orderdate, '%Y-%m') AS month, count(*) AS clicks FROM orders GROUP BY 1, 2)\n"
_O = "WITH o AS (SELECT user_id AS prompt, event_type AS engine, CAST(ts AS DATE) AS date, arg_max(CASE WHEN value > 100 THEN 5 WHEN value > 50 THEN 2 ELSE 0 END, event_id) AS score FROM events GROUP BY 1, 2, 3)\n"

QUERIES = {f.__name__: f for f in (
    r13_totals, r13_top_queries, r13_opportunities, r13_low_ctr, r14_conflicts, r14_pairs, r16_declining, r17_part_topics, a22_measures, m5_noise, u5_shared_brands, w7_streaks, a20_monthly, r22_channels, r22_days, w3_trends, a31_weekly, a28_medians, a29_noise, w4_deltas, w5_rolling, w6_weekly_noise, a30_last_28, j13_in_intervals, r29_experiment,
)}
SQL = {
    "r13_totals": _R + f"SELECT CAST(sum(clicks) AS BIGINT) AS clicks, CAST(sum(impressions) AS BIGINT) AS impressions, {_up('sum(clicks) / sum(impressions)', 6)} AS ctr, {_W} AS position, count(DISTINCT query) AS queries, count(DISTINCT page) AS pages FROM r",
    "r13_top_queries": _Q + "SELECT * FROM q ORDER BY clicks DESC, query LIMIT 100",
    "r13_opportunities": _Q + "SELECT query, impressions, position FROM q WHERE position BETWEEN 4 AND 15 AND impressions >= 50",
    "r13_low_ctr": _R + f", p AS (SELECT page, CAST(sum(clicks) AS BIGINT) AS clicks, CAST(sum(impressions) AS BIGINT) AS impressions, {_W} AS position FROM r GROUP BY 1) SELECT * FROM p WHERE impressions >= 100 AND position <= 10 AND clicks / impressions < CASE WHEN position <= 3 THEN 0.05 WHEN position <= 6 THEN 0.025 ELSE 0.01 END",
    "r14_conflicts": _C + "SELECT query, impressions, clicks, pages, winner, runner_up, share, CASE WHEN share >= 30 AND apart <= 10 AND best <= 20 THEN 'high' WHEN share >= 20 THEN 'medium' ELSE 'low' END AS severity FROM c",
    "r14_pairs": _C + "SELECT x.page AS page_a, y.page AS page_b, count(*) AS queries, CAST(sum(x.total) AS BIGINT) AS impressions FROM s x JOIN s y ON x.query = y.query AND x.page < y.page GROUP BY 1, 2 HAVING count(*) > 1",
    "r16_declining": """
WITH m AS (SELECT CAST(o_custkey % 200 AS VARCHAR) AS page, strftime(o_orderdate, '%Y-%m') AS month, CAST(sum(floor(o_totalprice / 1000)) AS BIGINT) AS clicks, CAST(sum(floor(o_totalprice / 100)) AS BIGINT) AS impressions, sum((1 + o_orderkey % 20) * floor(o_totalprice / 100)) AS w FROM orders GROUP BY 1, 2),
known AS (SELECT month, row_number() OVER (ORDER BY month DESC) AS back, (CAST(month[1:4] AS INTEGER) + 1) || month[5:7] AS next_year FROM (SELECT DISTINCT month FROM m)),
has_year AS (SELECT count(*) = 3 AS yes FROM known a JOIN known b ON a.next_year = b.month AND b.back <= 3),
s AS (SELECT page, CAST(coalesce(sum(clicks) FILTER (WHERE k.back BETWEEN 4 AND 6), 0) AS BIGINT) AS before, CAST(coalesce(sum(clicks) FILTER (WHERE k.back <= 3), 0) AS BIGINT) AS after, CAST(coalesce(sum(clicks) FILTER (WHERE k.next_year IN (SELECT month FROM known WHERE back <= 3)), 0) AS BIGINT) AS y,
  coalesce(sum(impressions) FILTER (WHERE k.back BETWEEN 4 AND 6), 0) AS ib, coalesce(sum(impressions) FILTER (WHERE k.back <= 3), 0) AS ia, sum(w) FILTER (WHERE k.back BETWEEN 4 AND 6) AS wb, sum(w) FILTER (WHERE k.back <= 3) AS wa FROM m JOIN known k USING (month) GROUP BY 1),
grid AS (SELECT p.page, k.month, k.back, coalesce(m.clicks, 0) AS clicks FROM (SELECT DISTINCT page FROM m) p CROSS JOIN known k LEFT JOIN m ON m.page = p.page AND m.month = k.month),
fall AS (SELECT page, back, coalesce(clicks < lag(clicks) OVER (PARTITION BY page ORDER BY month), false) AS down FROM grid),
streak AS (SELECT page, coalesce(min(back) FILTER (WHERE NOT down), 1) - 1 AS streak FROM fall GROUP BY 1),
j AS (SELECT s.*, streak, has_year.yes, CASE WHEN ib > 0 THEN wb / ib END AS pb, CASE WHEN ia > 0 THEN wa / ia END AS pa, CASE WHEN ib > 0 THEN before / ib ELSE 0 END AS cb, CASE WHEN ia > 0 THEN after / ia ELSE 0 END AS ca FROM s JOIN streak USING (page), has_year WHERE before >= 30 AND (before - after) / before >= 0.2),
r AS (SELECT *, list_filter([CASE WHEN pa - pb >= 2 THEN 'position' END, CASE WHEN ib > 0 AND ib - ia >= 0.2 * ib AND NOT coalesce(pa - pb >= 2, false) THEN 'demand' END, CASE WHEN cb > 0 AND cb - ca >= 0.2 * cb AND ia >= 0.8 * ib THEN 'click_rate' END], lambda x: x IS NOT NULL) AS why FROM j)
SELECT page, before, after, before - after AS lost, CAST(floor((before - after) / before * 100 + 0.5) AS INTEGER) AS drop, floor(pb * 10 + 0.5) / 10 AS position_before, floor(pa * 10 + 0.5) / 10 AS position_after, CASE WHEN yes THEN y END AS year_ago, yes AND y > 0 AND after >= 0.9 * y AS seasonal, CAST(streak AS INTEGER) AS streak, CASE WHEN len(why) = 0 THEN ['unknown'] ELSE why END AS reasons FROM r""",
    "a22_measures": "WITH v AS (SELECT c_nationkey AS page, count(*) AS s, sum(o_custkey % 2) AS u, count(*) FILTER (WHERE o_orderstatus = 'F') AS e, sum(o_orderkey % 100) AS t, count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS k, sum(CAST(round(o_totalprice) AS BIGINT)) AS r FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1) "
    "SELECT page, s AS sessions, CAST(u AS BIGINT) AS users, floor(e / s * 100 * 10 + 0.5) / 10 AS engagement_rate, CAST(floor(t / s + 0.5) AS BIGINT) AS engagement_sec, CAST(k AS DOUBLE) AS key_events, floor(k / s * 100 * 100 + 0.5) / 100 AS conversion_rate, CAST(r AS DOUBLE) AS revenue FROM v",
    "u5_shared_brands": "WITH q AS (SELECT l_suppkey, p_brand, row_number() OVER (PARTITION BY l_suppkey ORDER BY sum(l_quantity) DESC, p_brand) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2), t AS (SELECT * FROM q WHERE n <= 10) SELECT x.l_suppkey AS a, y.l_suppkey AS b, CAST(count(*) AS INTEGER) AS shared FROM t x JOIN t y ON x.p_brand = y.p_brand AND x.l_suppkey < y.l_suppkey GROUP BY 1, 2 HAVING count(*) >= 8",
    "w7_streaks": _M + ", s AS (SELECT *, coalesce(clicks < lag(clicks) OVER (PARTITION BY page ORDER BY month), false) AS down FROM m), b AS (SELECT *, sum(CASE WHEN down THEN 0 ELSE 1 END) OVER (PARTITION BY page ORDER BY month DESC) AS breaks FROM s) SELECT page, count(*) FILTER (WHERE down AND breaks = 0) AS streak FROM b GROUP BY 1",
    "a20_monthly": _M + "SELECT page, " + ", ".join(f"CAST(sum(clicks) FILTER (WHERE quarter(CAST(month || '-01' AS DATE)) = {i}) AS BIGINT) AS q{i}" for i in (1, 2, 3, 4)) + " FROM m GROUP BY 1",
    "r22_channels": "WITH g AS (SELECT c_mktsegment AS channel, count(*) AS sessions, round(sum(o_totalprice), 2) AS revenue FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1) SELECT *, " + _up("sessions / sum(sessions) OVER ()") + " AS share FROM g",
    "r22_days": "SELECT CAST(o_orderdate AS DATE) AS date, count(*) AS sessions, " + ", ".join(f"count(*) FILTER (WHERE c_mktsegment = '{n}') AS {n.lower()}" for n in ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")) + " FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1",
    "w3_trends": _O + ", s AS (SELECT engine, score - lag(score) OVER (PARTITION BY prompt, engine ORDER BY date) AS step FROM o) SELECT engine, CASE WHEN step IS NULL THEN 'first' WHEN step > 0 THEN 'better' WHEN step < 0 THEN 'worse' ELSE 'same' END AS trend, count(*) AS n FROM s GROUP BY 1, 2",
    "a31_weekly": _O + ", w AS (SELECT CAST(date_trunc('week', date) AS DATE) AS week, engine, score FROM o) SELECT week, engine, " + _up("avg(score)", 6) + " AS score, CAST(grouping(engine) AS INTEGER) AS all_engines, count(*) AS n FROM w GROUP BY GROUPING SETS ((week, engine), (week))",
    "a28_medians": "SELECT CAST(ts AS DATE) AS date, event_type, round(median(value), 6) AS median FROM events GROUP BY 1, 2",
    "a29_noise": "SELECT user_id, round(avg(value), 4) AS mean, round(coalesce(stddev_samp(value), 0), 4) AS deviation FROM events GROUP BY 1",
    "w4_deltas": "SELECT user_id, event_type, round(value - before, 6) AS delta FROM (SELECT *, row_number() OVER w AS n, lead(value) OVER w AS before FROM events WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC)) WHERE n = 1",
    "w5_rolling": _F + "SELECT date, clicks, round(avg(clicks) OVER (ORDER BY date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), 6) AS rolling FROM f",
    "w6_weekly_noise": _WEEKS + "SELECT block, last_day, clicks, round(change, 6) AS change FROM p",
    "m5_noise": _WEEKS + "SELECT round(greatest(0.15, 2 * coalesce(stddev_samp(round(change, 6)), 0)), 5) AS threshold, count(change) AS weeks FROM p WHERE block > 0",
    "a30_last_28": _D + ", a AS (SELECT *, (SELECT max(date) FROM d) - date AS age FROM d) SELECT " + ", ".join(f"CAST(sum(CASE WHEN age BETWEEN {a} AND {a + 27} THEN {c} ELSE 0 END) AS BIGINT) AS {c}_{n}" for c in ("clicks", "impressions") for n, a in (("now", 0), ("before", 28))) + " FROM a",
    "j13_in_intervals": "WITH o AS (SELECT CAST(o_orderdate AS DATE) AS day FROM orders), q AS (SELECT DISTINCT CAST(date_trunc('quarter', day) AS DATE) AS begin FROM o) SELECT begin, count(*) AS orders FROM o JOIN q ON day BETWEEN begin AND begin + 9 GROUP BY 1",
    "r29_experiment": "WITH o AS (SELECT CAST(o_orderdate AS DATE) AS date, o_custkey % 2 = 0 AS test, count(*) AS clicks FROM orders GROUP BY 1, 2), k AS (SELECT min(date) + CAST(floor((max(date) - min(date)) / 2) AS INTEGER) AS change FROM o), s AS (SELECT test, date > change AS after, clicks FROM o, k WHERE date <> change AND date BETWEEN change - 28 AND change + 28), "
    "z AS (SELECT sum(clicks) FILTER (WHERE test AND after) AS ta, sum(clicks) FILTER (WHERE test AND NOT after) AS tb, sum(clicks) FILTER (WHERE NOT test AND after) AS ca, sum(clicks) FILTER (WHERE NOT test AND NOT after) AS cb, abs(avg(clicks) FILTER (WHERE test AND NOT after) - avg(clicks) FILTER (WHERE test AND after)) / sqrt(var_samp(clicks) FILTER (WHERE test AND NOT after) / count(*) FILTER (WHERE test AND NOT after) + var_samp(clicks) FILTER (WHERE test AND after) / count(*) FILTER (WHERE test AND after)) / sqrt(2) AS x FROM s), "
    "y AS (SELECT *, 1 / (1 + 0.3275911 * x) AS t FROM z) SELECT round((ta / tb) / (ca / cb) - 1, 6) AS effect, round(((((1.061405429 * t - 1.453152027) * t + 1.421413741) * t - 0.284496736) * t + 0.254829592) * t * exp(-x * x), 5) AS p_value FROM y",
}
