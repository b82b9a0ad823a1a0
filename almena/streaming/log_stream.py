"""Continuous log ingestion: deduplicated entries, windowed hits with late data, session lengths."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from almena.session import ensure_checkpoint_dir
from almena.sources.logs import parse_lines

#: How long after its time an entry may still arrive.
LATENESS = "7 days"


def stream_lines(spark: SparkSession, path: str, salt: str, files_per_batch: int = 100) -> DataFrame:
    """A stream of parsed log lines from files that arrive in a folder."""
    return parse_lines(spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(path), salt).filter("ok")


def stream_entries(spark: SparkSession, path: str) -> DataFrame:
    """A stream of log entries in Parquet, with UTC times that watermarks accept, repeated rows once."""
    schema = spark.read.parquet(path).schema
    rows = spark.readStream.schema(schema).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))
    return rows.withWatermark("ts", LATENESS).dropDuplicatesWithinWatermark(["log_id"])


def hits_per_window(entries: DataFrame, window: str = "1 day", slide: str | None = None) -> DataFrame:
    """Hits and bytes per window and crawler; late entries count until the watermark has passed."""
    w = F.window("ts", window, slide) if slide else F.window("ts", window)
    return entries.groupBy(w.alias("w"), "bot_name").agg(F.count("*").alias("hits"), F.sum("size_bytes").alias("bytes")).select(F.col("w.start").alias("begin"), F.col("w.end").alias("end"), "bot_name", "hits", "bytes")


def visits(entries: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """Visits of each crawler to each site: a visit ends after a gap without requests."""
    return entries.groupBy(F.session_window("ts", gap).alias("w"), "site_id", "bot_name").agg(F.count("*").alias("hits")).select("site_id", "bot_name", F.col("w.start").alias("begin"), F.col("w.end").alias("end"), "hits")


def run_to_table(result: DataFrame, name: str, mode: str = "complete", base: str | None = None, listener: StreamingQueryListener | None = None) -> DataFrame:
    """Run a streaming result over all that is there into a table in the shared folder, and read it.

    A batch that is repeated after a failure writes the same rows once: each batch has a
    folder of its own, named by its number, which it overwrites (complete results
    have one folder for all). With the same ``base`` a later call goes on from where
    this one ended.
    """
    spark = result.sparkSession
    ensure_checkpoint_dir(spark)
    base = base or f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/stream-{name}-{uuid.uuid4().hex}"
    table = f"{base}/table"

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(table if mode == "complete" else f"{table}/batch={batch_id}")

    if listener:
        spark.streams.addListener(listener)
    try:
        query = result.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).foreachBatch(write).start()
        query.awaitTermination()
    finally:
        if listener:
            spark.streams.removeListener(listener)
    found = spark.read.parquet(table)
    return found.drop("batch") if mode != "complete" else found


class Progress(StreamingQueryListener):
    """Rows read and batches done of the queries it listens to; ``stop_after`` rows it stops a query."""

    def __init__(self, spark: SparkSession, stop_after: int | None = None):
        self.spark, self.stop_after, self.rows, self.batches, self.ended = spark, stop_after, 0, 0, 0

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        self.rows += event.progress.numInputRows
        self.batches += 1
        if self.stop_after is not None and self.rows >= self.stop_after and (query := self.spark.streams.get(str(event.progress.id))):
            query.stop()

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        self.ended += 1


def unsuppressed(alerts: DataFrame, days: int = 14) -> DataFrame:
    """Alerts (site_id, signature, at) without those that repeat one that was kept less than ``days`` before.

    Kept are the first of a signature and each that comes ``days`` or more after the last
    kept one. The times of a signature are folded in order, day by day, in one row.
    """
    times = alerts.groupBy("site_id", "signature").agg(F.array_sort(F.collect_set("at")).alias("_t"))
    kept = F.aggregate(
        "_t", F.array().cast("array<timestamp>"),
        lambda out, t: F.when((F.size(out) == 0) | (t >= F.try_element_at(out, F.lit(-1)) + F.expr(f"INTERVAL {days} DAYS")), F.concat(out, F.array(t))).otherwise(out),
    )
    return times.select("site_id", "signature", F.explode(kept).alias("at"))


def suppress_stream(alerts: DataFrame, days: int = 14) -> DataFrame:
    """The same for a stream of alerts: the last kept time of each signature is its state, which ends ``days`` after it."""
    schema = "site_id string, signature string, at timestamp"

    def keep(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        out = []
        for at in sorted(t for pdf in batches for t in pdf["at"]):
            if last is None or (at - pd.Timestamp(last, unit="us")).days >= days:
                out.append((*key, at))
                last = int(at.value // 1000)
        state.update((last,))
        state.setTimeoutTimestamp(max(last // 1000 + days * 86_400_000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["site_id", "signature", "at"])

    return alerts.withWatermark("at", LATENESS).groupBy("site_id", "signature").applyInPandasWithState(keep, schema, "last long", "append", GroupStateTimeout.EventTimeTimeout)
