"""Multi-select against sorting; joined counts; bounded error."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from almena.llm import percentiles as P

SCHEMA = "log_id long, import_id long, site_id string, ts timestamp, bot_name string, response_ms int, n string, key string"


def rows(n=3000):
    rng = random.Random(9)
    return [(i, i % 7, rng.choice(["hot", "hot", "hot", "a", "b"]), dt.datetime(2026, 1, 1 + i % 5), rng.choice([None, "G", "B"]), None if rng.random() < 0.1 else int(rng.lognormvariate(5, 2)), "x", "y") for i in range(n)]


def exact(data, at, p):
    groups = {}
    for r in data:
        if r[5] is not None:
            groups.setdefault(at(r), []).append(r[5])
    return {k: sorted(v)[max(1, math.ceil(p * len(v) - 1e-9)) - 1] for k, v in groups.items()}


@pytest.mark.parametrize("few", [4, 1024])
def test_against_sorting(spark, monkeypatch, few):
    monkeypatch.setattr(P, "FEW", few)
    data = rows()
    got = P.response_times(spark.createDataFrame(data + data[:200], SCHEMA)).collect()
    for dim, at in (("bot_name", lambda r: r[4]), ("site_id", lambda r: r[2]), ("day", lambda r: str(r[3].date()))):
        for c, p in P.SHARES.items():
            assert {r.key: r[c] for r in got if r.dim == dim} == exact(data, at, p)
    assert sum(r.n for r in got if r.dim == "day") == sum(r[5] is not None for r in data)


def test_days_join_to_longer_periods(spark):
    data = rows(800)
    df = spark.createDataFrame(data, SCHEMA)
    dims = {"site_id": F.col("site_id")}
    daily = P.value_counts(df, dims, "response_ms", "log_id", period=F.to_date("ts")).cache()
    parts = [daily.filter(F.col("period") == f"2026-01-0{d}") for d in range(1, 6)]
    whole = P.multi_select(P.joined_counts(*parts), {"p": 0.75})
    assert {r.key: r.p for r in whole.collect()} == exact(data, lambda r: r[2], 0.75)


@pytest.mark.parametrize("error", [0.01, 0.1])
def test_error_is_bounded(spark, error):
    data = rows(800)
    got = P.response_times(spark.createDataFrame(data, SCHEMA), error).filter("dim = 'site_id'").collect()
    for c, p in P.SHARES.items():
        want = exact(data, lambda r: r[2], p)
        assert all(abs(r[c] - want[r.key]) <= error * want[r.key] + 1e-9 and r.max_rel_error == error for r in got)


def test_edges(spark):
    assert P.response_times(spark.createDataFrame([], SCHEMA)).count() == 0
    same = [(i, 1, "s", dt.datetime(2026, 1, 1), None, 7, "x", "y") for i in range(50)] + [(None, 1, "s", dt.datetime(2026, 1, 1), None, 9, "x", "y")] * 60
    r = P.response_times(spark.createDataFrame(same, SCHEMA)).filter("dim = 'site_id'").first()
    assert (r.n, r.p50, r.p99) == (110, 9.0, 9.0)
    c = spark.createDataFrame([("d", "k", float(v), 1) for v in range(-50, 51)], "dim string, key string, value double, n long")
    assert P.multi_select(c, {"a": 0.0, "b": 0.5, "c": 1.0}).select("a", "b", "c").first() == (-50.0, 0.0, 50.0)
