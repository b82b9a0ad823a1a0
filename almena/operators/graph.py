"""Link graphs by joins: PageRank, connected components, depth from a start."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from almena.session import cut_lineage, parallelism


def clean_edges(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """Distinct edges without loops and nulls."""
    return edges.select(F.col(src).alias("src"), F.col(dst).alias("dst")).filter("src IS NOT NULL AND dst IS NOT NULL AND src <> dst").distinct()


def pagerank(nodes: DataFrame, edges: DataFrame, damping: float = 0.85, iterations: int = 40) -> DataFrame:
    """PageRank of each node: id, rank (ranks sum to 1), score (0 to 100 on a logarithmic scale).

    ``nodes`` holds id, ``edges`` src and dst among them. What nodes without links hold is
    spread over all. Edges stay partitioned by source between rounds; a hub's
    incoming links are added up before the exchange.
    """
    ids = nodes.select("id").distinct()
    links = clean_edges(edges)
    degree = links.groupBy("src").agg(F.count("*").alias("_out"))
    parts = parallelism(ids.sparkSession)
    weighted = cut_lineage(links.join(degree, "src").select("src", "dst", (1 / F.col("_out")).alias("_share")).repartition(parts, "src"))
    n = ids.count()
    if not n:
        return ids.select("id", F.lit(0.0).alias("rank"), F.lit(0.0).alias("score"))
    state = cut_lineage(ids.join(degree, ids["id"] == degree["src"], "left").select("id", F.col("_out").isNull().alias("_sink"), F.lit(1.0 / n).alias("rank")).repartition(parts, "id"))
    for _ in range(iterations):  # a round uses the ranks three times, so they are written once each round
        held = state.agg(F.coalesce(F.sum(F.when(F.col("_sink"), F.col("rank"))), F.lit(0.0)).alias("_held"))
        flow = weighted.join(state.select(F.col("id").alias("src"), "rank"), "src").groupBy("dst").agg(F.sum(F.col("rank") * F.col("_share")).alias("_in"))
        state = cut_lineage(
            state.join(flow, state["id"] == flow["dst"], "left").crossJoin(F.broadcast(held))
            .select("id", "_sink", ((1 - damping) / n + damping * (F.coalesce("_in", F.lit(0.0)) + F.col("_held") / n)).alias("rank"))
        )
    most = state.agg(F.max("rank").alias("_max"))
    score = F.floor(F.log(1 + F.col("rank") * n) / F.log(1 + F.col("_max") * n) * 100 + 0.5)
    return state.crossJoin(F.broadcast(most)).select("id", "rank", score.cast("int").alias("score"))


def components(edges: DataFrame) -> DataFrame:
    """Connected components of an undirected graph: id, component (the smallest id in it)."""
    links = clean_edges(edges)
    both = cut_lineage(links.unionByName(links.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct())
    labels = cut_lineage(both.select(F.col("src").alias("id")).distinct().withColumn("component", F.col("id")))
    while True:
        near = both.join(labels, both["dst"] == labels["id"]).groupBy("src").agg(F.min("component").alias("_low"))
        hooked = labels.join(near, labels["id"] == near["src"], "left").select("id", F.least("component", F.coalesce("_low", "component")).alias("component"), F.col("component").alias("_was"))
        ahead = labels.select(F.col("id").alias("_at"), F.col("component").alias("_further"))
        step = cut_lineage(hooked.join(ahead, hooked["component"] == ahead["_at"], "left").select("id", F.least("component", F.coalesce("_further", "component")).alias("component"), "_was"))
        moved = not step.filter("component < _was").isEmpty()
        labels = step.select("id", "component")
        if not moved:
            return labels


def depths(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """Fewest links from the starts to each node that can be reached, however far: id, depth."""
    links = cut_lineage(clean_edges(edges))
    known = cut_lineage(starts.select("id").distinct().withColumn("depth", F.lit(0)))
    edge, depth = known, 0
    while True:
        depth += 1
        found = edge.join(links, edge["id"] == links["src"]).select(F.col("dst").alias("id")).distinct().join(known, "id", "left_anti").withColumn("depth", F.lit(depth))
        edge = cut_lineage(found)
        if edge.isEmpty():
            return known
        known = known.unionByName(edge)
        if depth % 20 == 0:  # else the plan grows with the depth
            known = cut_lineage(known)


def redirect_ends(redirects: DataFrame) -> DataFrame:
    """Where chains of redirects (src, dst) end: src, target, hops, loop. Followed by doubling.

    A chain that ends has no more hops than there are sources; one that goes on beyond
    them runs into a loop: loop is true, hops null and target some page on the way.
    """
    base = cut_lineage(redirects.filter("src IS NOT NULL AND dst IS NOT NULL").groupBy("src").agg(F.min("dst").alias("target")))
    state = base.withColumn("hops", F.lit(1).cast("long"))
    reach, sources = 1, base.count()
    while reach <= sources:
        further = state.select(F.col("src").alias("_s"), F.col("target").alias("_t"), F.col("hops").alias("_h"))
        step = cut_lineage(state.join(further, state["target"] == further["_s"], "left").select("src", F.coalesce("_t", "target").alias("target"), (F.col("hops") + F.coalesce("_h", F.lit(0))).alias("hops"), F.col("_t").isNotNull().alias("_moved")))
        state = step.drop("_moved")
        reach *= 2
        if step.filter("_moved").isEmpty():
            break
    still = base.select(F.col("src").alias("_n"))
    return state.join(still, state["target"] == still["_n"], "left").select("src", "target", F.when(F.col("_n").isNotNull(), F.lit(None)).otherwise(F.col("hops")).cast("int").alias("hops"), F.col("_n").isNotNull().alias("loop"))
