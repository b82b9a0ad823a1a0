"""Monitoring: weekly changes against noise, crawls and vitals against their last, experiments, speed reports, bundles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from almena.functions.stats import ratio_effect, relative_change, welch_p
from almena.functions.text import round_up
from almena.functions.web import score_grade
from almena.operators.relational import every_day

_NEWS = ("area", "insight", "tone", "subject", "before", "after")


def _news(df: DataFrame, area: str, insight: Column, tone: Column, subject: Column, before: Column, after: Column) -> DataFrame:
    return df.select(F.lit(area).alias("area"), insight.alias("insight"), tone.alias("tone"), subject.cast("string").alias("subject"), before.cast("double").alias("before"), after.cast("double").alias("after")).filter("insight IS NOT NULL")


def weekly_changes(days: DataFrame) -> DataFrame:
    """Blocks of seven days counted from the last: block (0 the last), clicks, impressions, position."""
    n = F.row_number().over(Window.partitionBy().orderBy(F.desc("date")))  # a row a day
    rows = days.withColumn("block", F.floor((n - 1) / 7).cast("int"))
    g = rows.groupBy("block").agg(F.sum("clicks").alias("clicks"), F.sum("impressions").alias("impressions"), F.try_divide(F.sum(F.col("position") * F.col("impressions")), F.sum("impressions")).alias("position"), F.count("*").alias("_n"))
    return g.filter("_n = 7").drop("_n")


def search_news(days: DataFrame, least: float = 0.15) -> DataFrame:
    """The last seven days of a series (date, clicks, impressions, position) against the seven before: what leaves the site's usual noise.

    Noise is twice the deviation of the week-to-week changes before the last week, at least ``least``.
    """
    w = weekly_changes(days)
    order = Window.partitionBy().orderBy(F.desc("block"))
    steps = w.select("block", *(relative_change(F.lag(c).over(order), F.col(c)).alias(f"_{c}") for c in ("clicks", "impressions")))
    noise = steps.filter("block > 0").agg(*(F.greatest(F.lit(least), 2 * F.coalesce(F.stddev_samp(f"_{c}"), F.lit(0.0))).alias(f"n_{c}") for c in ("clicks", "impressions")))
    pick = lambda c, b: F.max(F.when(F.col("block") == b, F.col(c)))
    last = w.agg(*(pick(c, b).alias(f"{c}_{b}") for c in ("clicks", "impressions", "position") for b in (0, 1))).crossJoin(F.broadcast(noise))
    parts = []
    for c, floor in (("clicks", 30), ("impressions", 300)):
        change = relative_change(F.col(f"{c}_1"), F.col(f"{c}_0"))
        moved = (F.col(f"{c}_1") >= floor) & (F.abs(change) >= F.col(f"n_{c}"))
        parts.append(_news(last, "search", F.when(moved, c), F.when(change < 0, "bad").otherwise("good"), F.lit("site"), F.col(f"{c}_1"), F.col(f"{c}_0")))
    shift = F.col("position_0") - F.col("position_1")
    parts.append(_news(last, "search", F.when((F.abs(shift) >= 1) & (F.col("impressions_1") >= 300), "position"), F.when(shift > 0, "warn").otherwise("good"), F.lit("site"), round_up(F.col("position_1"), 1), round_up(F.col("position_0"), 1)))
    return reduce(DataFrame.unionByName, parts)


def crawl_news(runs: DataFrame) -> DataFrame:
    """Each site's last full crawl against the one before: indexable pages, errors, speed.

    ``runs`` holds site_id, started_at, indexable, errors_4xx, errors_5xx, mean_ms, partial; pages are
    compared only if neither crawl was partial.
    """
    n = F.row_number().over(Window.partitionBy("site_id").orderBy(F.desc("started_at")))
    fields = ("indexable", "errors_4xx", "errors_5xx", "mean_ms", "partial")
    pick = lambda c, k: F.max(F.when(F.col("_n") == k, F.col(c)))
    j = runs.withColumn("_n", n).filter("_n <= 2").groupBy("site_id").agg(*(pick(c, k).alias(f"{c}_{k}") for c in fields for k in (1, 2)), F.count("*").alias("_c")).filter("_c = 2")
    whole = ~(F.col("partial_1") | F.col("partial_2"))
    c = F.col
    drop, step = c("indexable_2") - c("indexable_1"), F.greatest(F.lit(5.0), c("indexable_2") * 0.05)
    rules = [
        ("indexable", whole & (drop >= step), "indexable_lost", "bad"), ("indexable", whole & (-drop >= step), "indexable_gained", "info"), ("errors_5xx", c("errors_5xx_1") > c("errors_5xx_2"), "server_errors", "bad"), ("errors_4xx", c("errors_4xx_1") - c("errors_4xx_2") >= 3, "client_errors", "warn"),
        ("errors_4xx", c("errors_4xx_2") - c("errors_4xx_1") >= 3, "client_errors_fixed", "good"), ("mean_ms", (c("mean_ms_2") > 0) & (c("mean_ms_1") > 300) & (relative_change(c("mean_ms_2"), c("mean_ms_1")) >= 0.5), "slower", "warn"),
    ]
    parts = [_news(j, "crawl", F.when(rule, name), F.lit(tone), c("site_id"), c(f"{field}_2"), c(f"{field}_1")) for field, rule, name, tone in rules]
    parts.append(_news(j, "crawl", F.when(~whole, "partial"), F.lit("info"), c("site_id"), F.lit(None), F.lit(None)))
    return reduce(DataFrame.unionByName, parts)


def vitals_news(measured: DataFrame) -> DataFrame:
    """Each page and device's last measurement against the one before: largest paint, shift, response, score.

    ``measured`` holds url, strategy, created_at, score, lab_lcp, field_lcp, field_inp, lab_cls, field_cls. Values of
    real users are preferred to those of the laboratory.
    """
    n = F.row_number().over(Window.partitionBy("url", "strategy").orderBy(F.desc("created_at")))
    v = measured.withColumn("lcp", F.coalesce("field_lcp", "lab_lcp")).withColumn("cls", F.coalesce("field_cls", "lab_cls")).withColumn("_n", n).filter("_n <= 2")
    pick = lambda c, k: F.max(F.when(F.col("_n") == k, F.col(c)))
    j = v.groupBy("url", "strategy").agg(*(pick(c, k).alias(f"{c}_{k}") for c in ("lcp", "cls", "field_inp", "score") for k in (1, 2)))
    c, who = F.col, F.concat_ws("|", "url", "strategy")
    worse = (c("lcp_1") - c("lcp_2") >= 300) & (relative_change(c("lcp_2"), c("lcp_1")) >= 0.2)
    better = (c("lcp_2") - c("lcp_1") >= 300) & (relative_change(c("lcp_1"), c("lcp_2")) >= 0.2)
    rules = [
        ("lcp", worse, "lcp_worse", "bad"), ("lcp", better, "lcp_better", "good"), ("cls", (c("cls_1") - c("cls_2") >= 0.05 - 1e-9) & (c("cls_1") > 0.1), "cls_worse", "warn"), ("field_inp", (c("field_inp_1") - c("field_inp_2") >= 50) & (c("field_inp_1") > 200), "inp_worse", "warn"),
        ("score", (c("score_2") - c("score_1") >= 10) & ~F.coalesce(worse, F.lit(False)), "score_worse", "warn"),
    ]
    return reduce(DataFrame.unionByName, [_news(j, "vitals", F.when(rule, name), F.lit(tone), who, c(f"{field}_2"), c(f"{field}_1")) for field, rule, name, tone in rules])


def with_events(news: DataFrame, events: DataFrame, begin: Column, end: Column) -> DataFrame:
    """News with the labels of events (date, label) between two days: adds related. Events are few; they are gathered once."""
    from almena.operators.relational import within_intervals

    keyed = news.withColumns({"_b": begin, "_e": end}).withColumn("_id", F.xxhash64(*_NEWS))
    hits = within_intervals(events, keyed.select("_id", "_b", "_e"), "date", "_b", "_e").groupBy("_id").agg(F.array_sort(F.collect_set(F.concat(F.col("date").cast("string"), F.lit(" "), F.col("label")))).alias("related"))
    return keyed.join(hits, "_id", "left").select(*_NEWS, F.coalesce("related", F.array().cast("array<string>")).alias("related"))


def ranked(news: DataFrame) -> DataFrame:
    """News with what is bad first, then warnings, good ones and the rest."""
    tone = F.when(F.col("tone") == "bad", 0).when(F.col("tone") == "warn", 1).when(F.col("tone") == "good", 2).otherwise(3)
    return news.orderBy(tone, "area", "insight", "subject")


# ------------------------------------------------------------------ experiments
def experiment(days: DataFrame, window: int = 28) -> DataFrame:
    """Effect of a change on test pages against a control: one row for each experiment.

    ``days`` holds experiment, change_date, date, test_clicks, control_clicks, test_impressions,
    control_impressions, test_position, control_position; missing days count as none. The day of the change belongs to
    neither period. Result: experiment, days_after, effect (clicks), effect_impressions, effect_ctr, effect_position, p_value (of the
    test's daily share; from seven days after on), verdict (waiting, low_data, positive, negative, inconclusive).
    """
    values = [f"{s}_{m}" for s in ("test", "control") for m in ("clicks", "impressions", "weight")]
    rows = days.groupBy("experiment", "change_date", "date").agg(
        *(F.sum(f"{s}_{m}").alias(f"{s}_{m}") for s in ("test", "control") for m in ("clicks", "impressions")), *(F.sum(F.coalesce(F.col(f"{s}_position") * F.col(f"{s}_impressions"), F.lit(0.0))).alias(f"{s}_weight") for s in ("test", "control"))
    )
    last = rows.groupBy("experiment", "change_date").agg(F.max("date").alias("_last"))
    ends = last.select("experiment", "change_date", F.least(F.date_add("change_date", window), "_last").alias("_end"))
    every = ends.select("experiment", "change_date", F.explode(F.sequence(F.date_sub("change_date", window), F.greatest("_end", F.date_sub("change_date", 1)))).alias("date"))
    filled = every.join(rows, ["experiment", "change_date", "date"], "left").fillna(0, values).withColumn("_gap", F.datediff("date", "change_date")).filter("_gap <> 0")
    share = F.try_divide(F.col("test_clicks").cast("double"), (F.col("test_clicks") + F.col("control_clicks")).cast("double"))
    side = {"b": F.col("_gap") < 0, "a": F.col("_gap") > 0}
    g = filled.withColumn("_s", share).groupBy("experiment").agg(
        *(F.sum(F.when(w, F.col(v))).alias(f"{v}_{k}") for v in values for k, w in side.items()), *(F.count_if(w).alias(f"days_{k}") for k, w in side.items()),
        *(f(F.when(w, F.col("_s"))).alias(f"{n}_{k}") for n, f in (("m", F.avg), ("v", F.var_samp), ("n", F.count)) for k, w in side.items()),
    )
    c = F.col
    per = lambda v, k: F.try_divide(c(f"{v}_{k}").cast("double"), F.nullif(c(f"days_{k}"), F.lit(0)).cast("double"))
    did = lambda m: ratio_effect(per(f"test_{m}", "b"), per(f"test_{m}", "a"), per(f"control_{m}", "b"), per(f"control_{m}", "a"))
    div = lambda a, b: F.try_divide(c(a).cast("double"), c(b).cast("double"))
    ctr = ratio_effect(*(div(f"{s}_clicks_{k}", f"{s}_impressions_{k}") for s in ("test", "control") for k in ("b", "a")))
    pos = {(s, k): div(f"{s}_weight_{k}", f"{s}_impressions_{k}") for s in ("test", "control") for k in ("b", "a")}
    p = F.when(c("days_a") >= 7, welch_p(c("m_b"), c("v_b"), c("n_b"), c("m_a"), c("v_a"), c("n_a")))
    effect = did("clicks")
    low = (F.coalesce("test_clicks_b", F.lit(0)) < 30) & (F.coalesce("test_clicks_a", F.lit(0)) < 30)
    verdict = F.when(c("days_a") < 7, "waiting").when(low, "low_data").when((p < 0.05) & (effect > 0), "positive").when((p < 0.05) & (effect < 0), "negative").otherwise("inconclusive")
    return g.select(
        "experiment", c("days_a").cast("int").alias("days_after"), F.round(effect, 6).alias("effect"), F.round(did("impressions"), 6).alias("effect_impressions"), F.round(ctr, 6).alias("effect_ctr"),
        F.round(pos["test", "a"] - pos["test", "b"] - (pos["control", "a"] - pos["control", "b"]), 4).alias("effect_position"), F.round(p, 5).alias("p_value"), verdict.alias("verdict"),
    )


def experiment_series(days: DataFrame, window: int = 28) -> DataFrame:
    """Clicks of the last seven days of test and control, in per cent of their daily mean before the change: experiment, date, test, control."""
    flat = days.groupBy("experiment", "change_date", "date").agg(F.sum("test_clicks").alias("t"), F.sum("control_clicks").alias("c"))
    near = flat.filter(F.col("date").between(F.date_sub("change_date", window), F.date_add("change_date", window)))
    full = every_day(near.select("experiment", "date", "t", "c"), ["experiment"], "date", ["t", "c"]).join(near.select("experiment", "change_date").distinct(), "experiment")
    before = full.filter("date < change_date").groupBy("experiment").agg(F.avg("t").alias("_t"), F.avg("c").alias("_c"))
    roll = Window.partitionBy("experiment").orderBy("date").rowsBetween(-6, 0)
    pct = lambda x: round_up(F.try_divide(F.avg(x).over(roll), F.nullif(F.col(f"_{x}"), F.lit(0.0))) * 100, 1)
    return full.join(before, "experiment").select("experiment", "date", pct("t").alias("test"), pct("c").alias("control"))


# ------------------------------------------------------------------ speed
def audit_impact(lcp: Column, tbt: Column, cls: Column, score: Column) -> Column:
    """How much an audit could save: high, medium, low, least."""
    at = lambda a, b, c: (lcp >= a) | (tbt >= b) | (cls >= c)
    return F.when(at(1000, 600, 0.1), "high").when(at(500, 300, 0.05), "medium").when(at(150, 100, 0.01) | (F.coalesce(score, F.lit(1.0)) < 0.5), "low").otherwise("least")


_AUDITS = "struct<id:string,score:double,scoreDisplayMode:string,metricSavings:map<string,double>>"
_RUN = f"categories struct<performance:struct<score:double,auditRefs:array<struct<id:string,`group`:string>>>>, audits map<string,{_AUDITS}>"
_REQUESTS = "audits struct<`network-requests`:struct<details:struct<items:array<struct<url:string,resourceType:string,mimeType:string,transferSize:long,networkEndTime:double>>>>>"


def speed_report(runs: DataFrame, key: str, json: str = "json") -> DataFrame:
    """Grade of speed results: key, performance, structure (mean of the scored audits that are no metrics), value (70 to 30), letter, issues by impact."""
    r = runs.select(F.col(key), F.from_json(json, _RUN).alias("_r"))
    refs = F.filter("_r.categories.performance.auditRefs", lambda x: ~F.coalesce(x["group"], F.lit("")).isin("metrics", "hidden"))
    audits = F.filter(F.transform(refs, lambda x: F.try_element_at("_r.audits", x["id"])), lambda a: a["score"].isNotNull() & a["scoreDisplayMode"].isin("metricSavings", "numeric", "binary"))
    shown = r.select(key, F.col("_r.categories.performance.score").alias("_p"), F.coalesce(audits, F.array().cast(f"array<{_AUDITS}>")).alias("_a"))
    mean = F.when(F.size("_a") > 0, F.aggregate("_a", F.lit(0.0), lambda s, x: s + x["score"]) / F.size("_a"))
    save = lambda a, k: F.coalesce(F.try_element_at(a["metricSavings"], F.lit(k)), F.lit(0.0))
    issues = F.array_sort(F.transform(F.filter("_a", lambda x: x["score"] < 0.9), lambda x: F.concat_ws(":", audit_impact(F.greatest(save(x, "LCP"), save(x, "FCP")), save(x, "TBT"), save(x, "CLS"), x["score"]), x["id"])))
    s = shown.select(key, round_up(F.col("_p") * 100).cast("int").alias("performance"), round_up(mean * 100).cast("int").alias("structure"), issues.alias("issues"))
    value = F.when(F.col("performance").isNotNull() & F.col("structure").isNotNull(), round_up(F.col("performance") * 0.7 + F.col("structure") * 0.3).cast("int")).otherwise(F.col("performance"))
    return s.withColumn("value", value).withColumn("letter", score_grade(F.col("value")))


# Kinds of resources by what a browser calls them.
_WEIGHT = {"Document": "html", "Script": "js", "Stylesheet": "css", "Image": "image", "Media": "video", "Font": "font", "XHR": "data", "Fetch": "data", "EventSource": "data", "WebSocket": "data"}


def page_weight(runs: DataFrame, key: str, json: str = "json") -> DataFrame:
    """Bytes and requests of each run by kind of resource: key, kind, bytes, requests, fully_loaded_ms."""
    items = runs.select(F.col(key), F.explode(F.from_json(json, _REQUESTS)["audits"]["network-requests"]["details"]["items"]).alias("_i"))
    own = F.try_element_at(F.create_map(*(F.lit(x) for p in _WEIGHT.items() for x in p)), F.col("_i.resourceType"))
    mime = F.coalesce("_i.mimeType", F.lit(""))
    kind = F.coalesce(own, F.when(mime.rlike("^(video|audio)/"), "video").when(mime.startswith("image/"), "image").otherwise("other"))
    return items.groupBy(key, kind.alias("kind")).agg(F.coalesce(F.sum("_i.transferSize"), F.lit(0)).cast("long").alias("bytes"), F.count("*").alias("requests"), F.max("_i.networkEndTime").alias("fully_loaded_ms"))


def field_values(rows: DataFrame, json: str = "json", key: str = "url") -> DataFrame:
    """Real users' 75th percentiles: those of the page, else those of its site: key, scope (url, origin), metric, p75. Shifts come in hundredths."""
    part = "struct<metrics:map<string,struct<percentile:double,category:string>>,origin_fallback:boolean>"
    r = rows.select(F.col(key), F.from_json(json, f"loadingExperience {part}, originLoadingExperience {part}").alias("_r"))
    own = F.coalesce(F.size("_r.loadingExperience.metrics"), F.lit(0)) > 0
    real = own & ~F.coalesce("_r.loadingExperience.origin_fallback", F.lit(False))
    metrics = F.when(real, F.col("_r.loadingExperience.metrics")).otherwise(F.coalesce("_r.originLoadingExperience.metrics", "_r.loadingExperience.metrics"))
    flat = r.select(key, F.when(real, "url").otherwise("origin").alias("scope"), F.explode(metrics).alias("metric", "_m"))
    return flat.select(key, "scope", "metric", F.when(F.col("metric").contains("LAYOUT_SHIFT"), F.col("_m.percentile") / 100).otherwise(F.col("_m.percentile")).alias("p75"))


def tiers(parts: list[DataFrame], key: str, most: int) -> DataFrame:
    """Candidates of several tiers, the first tiers first, each key once: key, tier, at most ``most``. Each part holds the key and weight."""
    rows = reduce(DataFrame.unionByName, [p.select(key, F.col("weight").cast("double").alias("weight"), F.lit(i).alias("tier")) for i, p in enumerate(parts, 1)])
    best = rows.groupBy(key).agg(F.min(F.struct("tier", (-F.col("weight")).alias("w"))).alias("_b"))
    return best.select(key, F.col("_b.tier").alias("tier"), (-F.col("_b.w")).alias("weight")).orderBy("tier", F.desc("weight"), key).limit(most)


def bundle(parts: dict[str, DataFrame]) -> DataFrame:
    """Several small reports as one frozen row of JSON: json. Rows of a part are in the order of their JSON."""
    packed = [df.select(F.to_json(F.struct("*")).alias("_j")).agg(F.lit(name).alias("_n"), F.concat(F.lit("["), F.array_join(F.array_sort(F.collect_list("_j")), ","), F.lit("]")).alias("_t")) for name, df in parts.items()]
    rows = reduce(DataFrame.unionByName, packed)
    entry = F.concat(F.lit('"'), F.col("_n"), F.lit('":'), F.col("_t"))
    return rows.agg(F.concat(F.lit("{"), F.array_join(F.array_sort(F.collect_list(entry)), ","), F.lit("}")).alias("json"))
