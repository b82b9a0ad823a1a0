"""Exports of search and visit interfaces: paged JSON answers as rows, and which months are to be fetched again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from almena.operators.relational import complete_months

_SEARCH = "rows array<struct<keys:array<string>,clicks:double,impressions:double,ctr:double,position:double>>"
_VISITS = "dimensionHeaders array<struct<name:string>>, metricHeaders array<struct<name:string>>, rows array<struct<dimensionValues:array<struct<value:string>>,metricValues:array<struct<value:string>>>>"


def search_export(answers: DataFrame, dimensions: list[str], json: str = "json") -> DataFrame:
    """Rows of answers of a search interface: the dimensions by name, clicks, impressions, ctr, position; each other column is kept."""
    rest = [c for c in answers.columns if c != json]
    r = answers.select(*rest, F.explode(F.from_json(json, _SEARCH)["rows"]).alias("_r"))
    return r.select(*rest, *(F.get("_r.keys", F.lit(i)).alias(d) for i, d in enumerate(dimensions)), F.col("_r.clicks").cast("long").alias("clicks"), F.col("_r.impressions").cast("long").alias("impressions"), F.col("_r.ctr").alias("ctr"), F.col("_r.position").alias("position"))


def visit_export(answers: DataFrame, fields: dict[str, str], json: str = "json") -> DataFrame:
    """Rows of answers of a visit interface: ``fields`` names the columns for its dimensions and measures, whatever their order; measures are numbers.

    A field that an answer lacks is null.
    """
    rest = [c for c in answers.columns if c != json]
    a = answers.select(*rest, F.from_json(json, _VISITS).alias("_a")).select("*", F.explode("_a.rows").alias("_r"))

    def at(headers: str, values: str, name: str) -> Column:
        place = F.array_position(F.transform(f"_a.{headers}", lambda h: h["name"]), name)
        return F.when(place > 0, F.get(F.transform(f"_r.{values}", lambda v: v["value"]), (place - 1).cast("int")))

    return a.select(*rest, *(F.coalesce(at("dimensionHeaders", "dimensionValues", f), F.lit(None).cast("string")).alias(c) if kind == "text" else at("metricHeaders", "metricValues", f).try_cast("double").alias(c) for c, (f, kind) in {c: f.split(":") if ":" in f else (f, "text") for c, f in fields.items()}.items()))


def months_to_fetch(known: DataFrame, today: str, n: int = 16, again: int = 2) -> DataFrame:
    """Complete months up to ``today`` that are missing or among the newest ``again``: month (first day), newest first. ``known`` holds month."""
    every = known.sparkSession.range(1).select(F.posexplode(complete_months(F.lit(today).cast("date"), n)).alias("_i", "month"))
    missing = every.join(known.select("month").distinct().withColumn("_k", F.lit(True)), "month", "left")
    return missing.filter(F.col("_k").isNull() | (F.col("_i") < again)).orderBy(F.desc("month")).select("month")
