"""Sinks: guarded CSV, JSON snapshots, text exports, retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from almena.functions.text import csv_guard


def guarded(df: DataFrame) -> DataFrame:
    """Text columns made safe for spreadsheets, arrays joined by bars."""
    columns = []
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        if kind.startswith("array"):
            c = F.array_join(c.cast("array<string>"), " | ")
        columns.append((csv_guard(c) if kind == "string" or kind.startswith("array") else c).alias(name))
    return df.select(*columns)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """CSV with header and doubled quotes, safe to open in a spreadsheet."""
    guarded(df).write.mode(mode).csv(path, header=True, quote='"', escape='"')


def write_diff_csv(changes: DataFrame, path: str) -> None:
    """Changes of crawls as one guarded CSV for people: with a byte order mark, lists joined by bars, in order of their columns."""
    safe = guarded(changes)
    head = F.lit("\ufeff" + ",".join(safe.columns))
    cell = lambda c: F.concat(F.lit('"'), F.replace(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")), F.lit('"'), F.lit('""')), F.lit('"'))
    lines = safe.select(F.lit(1).alias("_o"), F.concat_ws(",", *(cell(c) for c in safe.columns)).alias("value"))
    first = changes.sparkSession.range(1).select(F.lit(0).alias("_o"), head.alias("value"))
    first.unionByName(lines).repartition(1).sortWithinPartitions("_o", "value").select("value").write.mode("overwrite").text(path)


def write_table(df: DataFrame, path: str, by: list[str] | None = None, mode: str = "overwrite") -> None:
    """Parquet, partitioned by the given columns."""
    writer = df.write.mode(mode)
    (writer.partitionBy(*by) if by else writer).parquet(path)


def snapshot_json(df: DataFrame) -> DataFrame:
    """Rows as one JSON column."""
    return df.select(F.to_json(F.struct("*")).alias("json"))


def redirect_rules(pairs: DataFrame, source: Column, target: Column, server: str = "apache") -> DataFrame:
    """Redirects as configuration lines of a server (apache or nginx)."""
    line = F.concat(F.lit("Redirect 301 "), source, F.lit(" "), target) if server == "apache" else F.concat(F.lit("rewrite ^"), F.regexp_replace(source, r"([.\\+*?\[\]^$(){}|])", r"\\$1"), F.lit("$ "), target, F.lit(" permanent;"))
    return pairs.select(line.alias("value"))


def disavow_lines(links: DataFrame, domain: str = "source_domain") -> DataFrame:
    """Domains as lines of a disavow file, once each."""
    return links.select(F.concat(F.lit("domain:"), domain).alias("value")).distinct()


def newest(df: DataFrame, by: str, order: str, keep: int, tie: str) -> DataFrame:
    """The newest ``keep`` rows per group; what is not among them may be dropped."""
    at = Window.partitionBy(by).orderBy(F.col(order).desc(), F.col(tie).desc())
    return df.withColumn("_n", F.row_number().over(at)).filter(F.col("_n") <= keep).drop("_n")


def expired(df: DataFrame, by: str, order: str, keep: int, tie: str) -> DataFrame:
    """The rows that ``newest`` leaves out."""
    at = Window.partitionBy(by).orderBy(F.col(order).desc(), F.col(tie).desc())
    return df.withColumn("_n", F.row_number().over(at)).filter(F.col("_n") > keep).drop("_n")
