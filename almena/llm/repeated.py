"""Repeated rows of large texts, removed without an exchange of all texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from almena.session import cut_lineage

#: Repeated keys up to this number are told to all tasks.
BROADCAST_KEYS = 500_000


def once(rows: DataFrame, key: str) -> DataFrame:
    """One row for each key: only the rows of keys that are repeated are exchanged, and those few keys are told to all tasks up to a measured number."""
    repeated = cut_lineage(rows.groupBy(key).agg(F.count("*").alias("_n")).filter("_n > 1").select(F.col(key).alias("_key")))
    if repeated.count() > BROADCAST_KEYS:
        return rows.dropDuplicates([key])
    match = rows[key].eqNullSafe(repeated["_key"])
    return rows.join(F.broadcast(repeated), match, "left_anti").unionByName(rows.join(F.broadcast(repeated), match, "left_semi").dropDuplicates([key]))
