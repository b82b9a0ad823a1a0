"""Monitoring, experiments, speed reports and bundles on planted series."""

import datetime as dt
import json

from pyspark.sql import functions as F

from almena.functions.web import vital_rating
from almena.operators import monitor as m

D = dt.date


def news(df):
    return {(r.insight, r.tone, r.subject) for r in df.collect()}


def test_search_news(spark):
    days = [(D(2026, 1, 1) + dt.timedelta(i), (100 if i < 49 else 60) + i % 3, 1000, 5.0 if i < 49 else 6.5) for i in range(56)]
    df = spark.createDataFrame(days, "date date, clicks long, impressions long, position double")
    assert news(m.search_news(df)) == {("clicks", "bad", "site"), ("position", "warn", "site")}
    noisy = spark.createDataFrame([(d, c * (1 + (i // 7) % 2), n, 5.0) for i, (d, c, n, _) in enumerate(days)], df.schema)
    assert ("clicks", "bad", "site") not in news(m.search_news(noisy)) and news(m.search_news(df.filter("date < '2026-01-10'"))) == set()


def test_crawl_and_vitals(spark):
    t = dt.datetime(2026, 1, 1)
    rows = [("s", t, 100, 5, 0, 200.0, False), ("s", t + dt.timedelta(1), 88, 9, 2, 400.0, False), ("p", t, 100, 9, 0, 100.0, True), ("p", t + dt.timedelta(1), 10, 2, 0, 100.0, False), ("one", t, 1, 1, 1, 1.0, False)]
    df = spark.createDataFrame(rows, "site_id string, started_at timestamp, indexable int, errors_4xx int, errors_5xx int, mean_ms double, partial boolean")
    assert news(m.crawl_news(df)) == {("indexable_lost", "bad", "s"), ("server_errors", "bad", "s"), ("client_errors", "warn", "s"), ("slower", "warn", "s"), ("client_errors_fixed", "good", "p"), ("partial", "info", "p")}
    v = spark.createDataFrame(
        [("/a", "mobile", t, 90, 2100.0, None, None, 0.05, None), ("/a", "mobile", t + dt.timedelta(1), 70, 3400.0, None, None, 0.2, None), ("/b", "desktop", t, 90, 9.0, 3000.0, 150.0, 0.0, 0.0), ("/b", "desktop", t + dt.timedelta(1), 75, 9.0, 2000.0, 260.0, 0.0, 0.0)],
        "url string, strategy string, created_at timestamp, score int, lab_lcp double, field_lcp double, field_inp double, lab_cls double, field_cls double",
    )
    assert news(m.vitals_news(v)) == {("lcp_worse", "bad", "/a|mobile"), ("cls_worse", "warn", "/a|mobile"), ("lcp_better", "good", "/b|desktop"), ("inp_worse", "warn", "/b|desktop"), ("score_worse", "warn", "/b|desktop")}
    events = spark.createDataFrame([(D(2026, 1, 2), "deploy"), (D(2026, 3, 1), "later")], "date date, label string")
    got = m.with_events(m.crawl_news(df), events, F.lit("2026-01-01").cast("date"), F.lit("2026-01-07").cast("date"))
    assert {tuple(r.related) for r in got.collect()} == {("2026-01-02 deploy",)} and m.ranked(got).first().tone == "bad"


def test_experiments(spark):
    start, change = D(2026, 1, 1), D(2026, 2, 1)
    rows = []
    for name, gain, scale in (("up", 2.0, 20), ("flat", 1.0, 20), ("few", 2.0, 0)):
        for i in range(60):
            d = start + dt.timedelta(i)
            rows.append((name, change, d, int(scale * (gain if d > change else 1)) + i % 3, 60 + i % 5, 200, 600, 5.0 if d < change else 4.0, 7.0))
    rows += [("new", D(2026, 3, 1), start + dt.timedelta(i), 50, 50, 100, 100, 1.0, 1.0) for i in range(60)]
    schema = "experiment string, change_date date, date date, test_clicks long, control_clicks long, test_impressions long, control_impressions long, test_position double, control_position double"
    got = {r.experiment: r for r in m.experiment(spark.createDataFrame(rows, schema)).collect()}
    assert {k: r.verdict for k, r in got.items()} == {"up": "positive", "flat": "inconclusive", "few": "low_data", "new": "waiting"}
    assert got["up"].days_after == 28 and 0.8 < got["up"].effect < 1.1 and got["up"].effect_position == -1.0 and got["up"].p_value == 0 and got["new"].p_value is None and got["new"].days_after == 0
    series = m.experiment_series(spark.createDataFrame(rows, schema)).filter("experiment = 'up'").orderBy("date").collect()
    assert len(series) == 57 and 180 < series[-1].test < 200 and 95 < series[-1].control < 105


def test_speed(spark):
    audits = {"a": {"id": "a", "score": 0.5, "scoreDisplayMode": "metricSavings", "metricSavings": {"LCP": 1200}}, "b": {"id": "b", "score": 1, "scoreDisplayMode": "binary"}, "m": {"id": "m", "score": 0.1, "scoreDisplayMode": "numeric"}, "network-requests": {"details": {"items": [{"url": "u", "resourceType": "Script", "transferSize": 10, "networkEndTime": 5.5}, {"url": "v", "resourceType": "Other", "mimeType": "image/png", "transferSize": 7}, {"url": "w", "mimeType": "x/y"}]}}}
    run = json.dumps({"categories": {"performance": {"score": 0.925, "auditRefs": [{"id": "a"}, {"id": "b"}, {"id": "m", "group": "metrics"}, {"id": "missing"}]}}, "audits": audits})
    df = spark.createDataFrame([(1, run), (2, "{}"), (3, None)], "id int, json string")
    got = {r.id: r for r in m.speed_report(df, "id").collect()}
    assert (got[1].performance, got[1].structure, got[1].value, got[1].letter, got[1].issues) == (93, 75, 88, "B", ["high:a"]) and got[2].value is None and got[2].letter is None and got[3].issues == []
    assert {r.kind: (r.bytes, r.requests) for r in m.page_weight(df, "id").collect()} == {"js": (10, 1), "image": (7, 1), "other": (0, 1)}
    r = spark.range(1).select(*(vital_rating(F.lit(k), F.lit(v)).alias(f"x{i}") for i, (k, v) in enumerate([("LCP", 2500.0), ("cls", 0.2), ("inp", 501.0), ("zz", 1.0), ("lcp", None)]))).first()
    assert tuple(r) == ("good", "improve", "poor", None, None)
    field = [("u", '{"loadingExperience":{"metrics":{"CUMULATIVE_LAYOUT_SHIFT_SCORE":{"percentile":12}}}}'), ("v", '{"loadingExperience":{"origin_fallback":true,"metrics":{"LCP":{"percentile":1}}},"originLoadingExperience":{"metrics":{"LCP":{"percentile":2}}}}'), ("w", "x")]
    assert {(x.url, x.scope, x.p75) for x in m.field_values(spark.createDataFrame(field, "url string, json string")).collect()} == {("u", "url", 0.12), ("v", "origin", 2.0)}


def test_tiers_and_bundle(spark):
    a, b = spark.createDataFrame([("x", 1), ("y", 5)], "url string, weight int"), spark.createDataFrame([("y", 99), ("z", 2), ("w", 3)], "url string, weight int")
    assert [(r.url, r.tier) for r in m.tiers([a, b], "url", 3).collect()] == [("y", 1), ("x", 1), ("w", 2)]
    assert json.loads(m.bundle({"a": a, "none": b.limit(0)}).first().json) == {"a": [{"url": "x", "weight": 1}, {"url": "y", "weight": 5}], "none": []}
