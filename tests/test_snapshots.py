"""Snapshot changes by validity intervals, against comparison of pairs."""

import datetime as dt

import pytest

from almena.operators.snapshots import chain_places, snapshot_changes

PAGE = "crawl_run_id long, url string, status_code int, canonical string, is_indexable boolean, fetched_at timestamp, key string"
RUN = "crawl_run_id long, base_run_id long, place string"
T0 = dt.datetime(2026, 1, 1)


def brute(pages, runs):
    at = {}
    for run, url, status, canonical, ok, when, _ in pages:
        if (run, url) not in at or when > at[run, url][0]:
            at[run, url] = (when, (status, canonical, ok))
    out = set()
    for run, base, _ in runs:
        if base is None or base == run:
            continue
        a, b = ({u: v[1] for (r, u), v in at.items() if r == x} for x in (run, base))
        out |= {(run, u, "added") for u in a.keys() - b.keys()} | {(run, u, "removed") for u in b.keys() - a.keys()} | {(run, u, "changed") for u in a.keys() & b.keys() if a[u] != b[u]}
    return out


@pytest.mark.parametrize("links", [
    {1: None, 2: 1, 3: 2, 4: 3}, {1: None, 2: 1, 3: 1, 4: 1, 5: 3, 6: 5}, {1: 2, 2: 1, 3: 1}, {1: 7, 2: 1, 3: 3}, {i: i - 1 if i > 1 else None for i in range(1, 20)},
])
def test_against_pairs(spark, links):
    pages = []
    for run in {*links, *(b for b in links.values() if b)} - {7}:
        for u in range(12):
            if (run * 7 + u * 5) % 4:
                pages.append((run, f"u{u}", 200 + (run * u) % 3, None if u % 3 == 0 and run % 2 else f"c{u % 2}", (run + u) % 5 > 0 if u % 2 else None, T0, "x"))
                pages.append((run, f"u{u}", 500, "late", False, T0 - dt.timedelta(hours=1), "x"))
    runs = [(r, b, "x") for r, b in links.items()]
    found = snapshot_changes(spark.createDataFrame(pages, PAGE), spark.createDataFrame(runs + runs[:1], RUN), ["status_code", "canonical", "is_indexable"])
    rows = [tuple(r) for r in found.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == brute(pages, runs)


def test_empty(spark):
    assert snapshot_changes(spark.createDataFrame([], PAGE), spark.createDataFrame([], RUN), ["status_code"]).count() == 0
    assert chain_places(spark.createDataFrame([(1, None, "x"), (None, 1, "x")], RUN)).count() == 0
