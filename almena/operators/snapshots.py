"""What changed between full snapshots: gaps and islands over key and row hash.

Runs that follow one another (each names the run it is compared with) form
chains, and every run has a place in its chain. Per chain and key, consecutive
places with the same row hash are one island: a validity interval. Interval
starts without a neighbour are additions, ends without a neighbour removals, and
two intervals that touch are a change. The keys of one chain are spread over the
cluster by (chain, key), so one exchange serves deduplication, intervals and
events.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from almena.session import cut_lineage


def chain_places(runs: DataFrame, run: str = "crawl_run_id", base: str = "base_run_id") -> DataFrame:
    """Places of runs in chains: chain_id, place, run_id, is_run.

    The base of a run stands one place before it. Where several runs share a base,
    the first by id continues the chain and each other one starts a chain of its own
    whose place 0 is the base again. A run without base starts a chain. Runs whose
    bases form a circle are compared pair by pair, each in its own chain.
    Found by pointer doubling: as many joins of this small table as the logarithm of
    the longest chain. Rows with a null run, and a run given as its own base, are
    ignored; of repeated runs the smallest base counts.
    """
    clean = (
        runs.select(F.col(run).cast("long").alias("run_id"), F.col(base).cast("long").alias("base_id"))
        .filter(F.col("run_id").isNotNull())
        .groupBy("run_id").agg(F.min("base_id").alias("base_id"))
        .withColumn("base_id", F.when(F.col("base_id") != F.col("run_id"), F.col("base_id")))
    )
    links = clean.filter("base_id IS NOT NULL").withColumn("nth", F.row_number().over(Window.partitionBy("base_id").orderBy("run_id")))
    # a link is (run, previous node); a later child of a base follows a copy of the base, written as a negative id of its own chain
    state = cut_lineage(
        links.select("run_id", "base_id", F.when(F.col("nth") == 1, F.col("base_id")).alias("up"), F.lit(1).cast("long").alias("hops"), (F.col("nth") > 1).alias("own"))
    )
    total = state.count()
    rounds = max(1, total.bit_length() + 1)
    ending = "done"
    state = state.withColumn(ending, F.lit(False))
    for _ in range(rounds):
        over = state.select(F.col("run_id").alias("_r"), F.col("up").alias("_up"), F.col("hops").alias("_hops"), F.col("own").alias("_own"), F.col("done").alias("_done"))
        step = state.join(over, (state["up"] == over["_r"]) & ~state["done"], "left")
        state = cut_lineage(
            step.select(
                "run_id", "base_id",
                F.when(F.col("_r").isNull() | F.col("_own"), F.col("up")).otherwise(F.col("_up")).alias("up"),
                F.when(F.col("_r").isNull(), F.col("hops")).when(F.col("_own"), F.col("hops") + F.lit(0)).otherwise(F.col("hops") + F.col("_hops")).alias("hops"),
                "own",
                (F.col("done") | F.col("own") | F.col("_r").isNull() | F.col("_own") | F.col("_done")).alias("done"),
            )
        )
        if state.filter("NOT done").isEmpty():
            break
    # an "own" run stands at place 1 of the chain named by itself; what hangs below it starts at place 2
    circle = ~F.col("done")
    head_own = state.filter("own").select(F.col("run_id").alias("_h"))
    placed = state.join(head_own, state["up"] == head_own["_h"], "left").select(
        "run_id", "base_id", (F.col("own") | circle).alias("alone"),
        F.when(F.col("own") | circle, -F.col("run_id") - 1).when(F.col("_h").isNotNull(), -F.col("up") - 1).otherwise(F.col("up")).alias("chain_id"),
        F.when(F.col("own") | circle, F.lit(1)).when(F.col("_h").isNotNull(), F.col("hops") + 1).otherwise(F.col("hops")).cast("int").alias("place"),
    )
    heads = placed.filter("NOT alone AND place = 1").select("chain_id", F.lit(0).alias("place"), F.col("base_id").alias("run_id"), F.lit(False).alias("is_run"))
    copies = placed.filter("alone").select("chain_id", F.lit(0).alias("place"), F.col("base_id").alias("run_id"), F.lit(False).alias("is_run"))
    return placed.select("chain_id", "place", "run_id", F.lit(True).alias("is_run")).unionByName(heads).unionByName(copies)


def row_hash(columns: list[str]) -> Column:
    """Hash of a row in which null differs from every value and from nulls elsewhere."""
    return F.xxhash64(*(x for c in columns for x in (F.col(c).isNull(), F.col(c))))


def validity_intervals(
    pages: DataFrame, places: DataFrame, watched: list[str], run: str = "crawl_run_id", key: str = "url", order: str = "fetched_at"
) -> DataFrame:
    """Validity intervals: chain_id, key, first, last, hash, one row per island.

    Of several rows of a key in one run the one with the latest ``order`` counts (null
    is earliest; of equal times the largest watched values). Rows with a null run are
    dropped; a null key is a key like any other.
    """
    where = places.select("chain_id", "place", F.col("run_id").alias("_run"))
    rows = pages.select(F.col(run).cast("long").alias("_run_of"), F.col(key).alias("key"), F.col(order).alias("_at"), *(F.col(c).alias(f"_w_{i}") for i, c in enumerate(watched)))
    names = [f"_w_{i}" for i in range(len(watched))]
    spread = (
        rows.join(where, rows["_run_of"] == where["_run"])
        .select("chain_id", "place", "key", F.struct("_at", *names).alias("_row"))
        .repartition(F.col("chain_id"), F.col("key"))
    )
    state = spread.groupBy("chain_id", "key", "place").agg(F.max("_row").alias("_row")).select("chain_id", "key", "place", "_row.*").withColumn("hash", row_hash(names))
    by_key = Window.partitionBy("chain_id", "key").orderBy("place")
    starts = ~((F.lag("place").over(by_key) == F.col("place") - 1) & (F.lag("hash").over(by_key) == F.col("hash")))
    islands = state.select("chain_id", "key", "place", "hash", F.coalesce(starts, F.lit(True)).cast("int").alias("_new"))
    numbered = islands.withColumn("_island", F.sum("_new").over(by_key))
    return numbered.groupBy("chain_id", "key", "_island").agg(F.min("place").alias("first"), F.max("place").alias("last"), F.first("hash").alias("hash")).drop("_island")


def change_events(intervals: DataFrame, places: DataFrame) -> DataFrame:
    """Change events of validity intervals: run_id, key, change_kind (added, removed, changed).

    An interval that starts after place 0 with no interval right before it is an
    addition in the run of its start; one that ends before the last place of its chain
    with none right after it is a removal in the run after its end; one that starts
    where another has just ended is a change.
    """
    by_key = Window.partitionBy("chain_id", "key").orderBy("first")
    at_start = F.when(F.col("first") > 0, F.when(F.lag("last").over(by_key) == F.col("first") - 1, F.lit("changed")).otherwise(F.lit("added")))
    gone = F.coalesce(F.lead("first").over(by_key) != F.col("last") + 1, F.lit(True))
    events = (
        intervals.select("chain_id", "key", "first", "last", at_start.alias("_start"), gone.alias("_gone"))
        .select(
            "chain_id", "key",
            F.explode(F.array(
                F.struct(F.col("first").alias("place"), F.col("_start").alias("change_kind")),
                F.struct((F.col("last") + 1).alias("place"), F.when(F.col("_gone"), F.lit("removed")).alias("change_kind")),
            )).alias("_event"),
        )
        .select("chain_id", "key", "_event.place", "_event.change_kind")
        .filter("change_kind IS NOT NULL")
    )
    runs = places.filter("is_run").select("chain_id", "place", "run_id")
    return events.join(runs, ["chain_id", "place"]).select("run_id", "key", "change_kind")


def snapshot_changes(pages: DataFrame, runs: DataFrame, watched: list[str]) -> DataFrame:
    """Added, removed and changed keys of every run that has a base: crawl_run_id, url, change_kind."""
    places = cut_lineage(chain_places(runs))
    intervals = validity_intervals(pages, places, watched)
    return change_events(intervals, places).withColumnsRenamed({"run_id": "crawl_run_id", "key": "url"})
