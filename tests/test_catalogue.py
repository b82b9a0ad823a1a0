"""The catalogue: names, and a few queries against their SQL where the test tables are at hand."""

import os

import pytest

import __spark_entry__ as entry
from almena.plans import catalogue

SF = "/root/testdata/sf0.001"


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(catalogue.SQL) <= set(catalogue.QUERIES)
    assert catalogue.FLAGSHIP in catalogue.QUERIES


def test_the_first_query_of_problem_7_is_its_own():
    assert next(n for n in entry.queries() if n.startswith("p7_")) == "p7_percentiles"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
@pytest.mark.parametrize("name", ["r1_bot_hits_by_day", "r1_crawl_waste", "r4_issue_counts", "r11_differences", "r14_conflicts", "w5_rolling", "p3_found", "g3_depths"])
def test_against_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    db = duckdb.connect()
    for file in os.listdir(SF):
        db.execute(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM '{SF}/{file}'")
    df = catalogue.QUERIES[name](spark, SF)
    order = sorted(df.columns)
    got = df.select(*order).toPandas().astype(str).values.tolist()
    want = db.execute(f"SELECT {', '.join(order)} FROM ({catalogue.SQL[name]})").df().astype(str).values.tolist()
    assert len(got) == len(want) and sorted(map(str, got)) == sorted(map(str, want))
