"""Streams: batches written once, progress and stopping, suppression of repeated alerts as a stream and at once."""

import datetime as dt

from pyspark.sql import functions as F

from almena.streaming.log_stream import Progress, hits_per_window, run_to_table, stream_entries, suppress_stream, unsuppressed

T = dt.datetime(2026, 1, 1)


def entries(spark, folder, name, rows):
    spark.createDataFrame(rows, "log_id long, ts timestamp, bot_name string, size_bytes long").coalesce(1).write.mode("append").parquet(f"{folder}/{name}")


def test_several_batches_and_progress(spark, tmp_path):
    rows = [(i, T + dt.timedelta(hours=i % 40), "a" if i % 3 else None, 10) for i in range(60)]
    for part in (rows[:30], rows[20:]):  # ten rows come twice
        entries(spark, tmp_path, "in", part)
    seen = Progress(spark)
    daily = run_to_table(hits_per_window(stream_entries(spark, str(tmp_path / "in"))), "t", listener=seen)
    want = {(r[1].date(), r[2]): 0 for r in rows}
    for _, ts, bot, _ in rows:
        want[ts.date(), bot] += 1
    assert {(r.begin.date(), r.bot_name): r.hits for r in daily.collect()} == want


def test_later_runs_go_on(spark, tmp_path):
    base = str(tmp_path / "state")
    entries(spark, tmp_path, "in", [(1, T, "a", 1), (2, T, "b", 1)])
    first = run_to_table(stream_entries(spark, str(tmp_path / "in")).select("log_id", "bot_name"), "r", "append", base)
    assert {r.log_id for r in first.collect()} == {1, 2}
    entries(spark, tmp_path, "in", [(3, T, "a", 1), (1, T, "a", 1)])
    again = run_to_table(stream_entries(spark, str(tmp_path / "in")).select("log_id", "bot_name"), "r", "append", base)
    assert sorted(r.log_id for r in again.collect()) == [1, 2, 3] and again.columns == ["log_id", "bot_name"]


def test_suppression(spark, tmp_path):
    rows = [("s", "x", T + dt.timedelta(d)) for d in (0, 8, 14, 15, 27, 28, 60)] + [("s", "y", T + dt.timedelta(3))] * 2 + [("t", "x", T)]
    kept = {("s", "x", T + dt.timedelta(d)) for d in (0, 14, 28, 60)} | {("s", "y", T + dt.timedelta(3)), ("t", "x", T)}
    df = spark.createDataFrame(rows, "site_id string, signature string, at timestamp")
    assert {tuple(r) for r in unsuppressed(df).collect()} == kept
    df.coalesce(1).write.parquet(str(tmp_path / "alerts"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "alerts"))
    out = run_to_table(suppress_stream(stream), "alerts", "append")
    assert {tuple(r) for r in out.select("site_id", "signature", F.col("at")).collect()} == kept
