"""Sitemaps, robots files, datasets, link lists, search and speed exports as DataFrames."""

from __future__ import annotations

import csv
import re
import unicodedata
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from almena.functions.url import domain_of, owns

_ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")]


def _unescape(text: Column) -> Column:
    text = F.regexp_replace(text, r"(?s)^\s*<!\[CDATA\[(.*?)\]\]>\s*$", "$1")
    for entity, raw in _ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(raw))
    return F.trim(text)


def parse_sitemaps(xml: DataFrame, content: str = "content") -> DataFrame:
    """Entries of sitemap files: url, lastmod, is_index. Entries without a place are left out."""
    found = xml.select(
        F.explode(F.regexp_extract_all(F.col(content), F.lit(r"(?is)<(?:\w+:)?(url|sitemap)\b[^>]*>.*?</(?:\w+:)?(?:url|sitemap)\s*>"), 0)).alias("_block"),
    )
    inner = lambda tag: _unescape(F.regexp_extract("_block", rf"(?is)<(?:\w+:)?{tag}\b[^>]*>(.*?)</(?:\w+:)?{tag}\s*>", 1))
    return found.select(inner("loc").alias("url"), F.to_date(F.substring(F.nullif(inner("lastmod"), F.lit("")), 1, 10).try_cast("date")).alias("lastmod"), F.col("_block").rlike(r"(?i)^<(?:\w+:)?sitemap\b").alias("is_index")).filter("url <> ''")


_RULES = "site string, agent string, allow boolean, pattern string, sitemap string, crawl_delay double"


def robots_rules(robots: DataFrame, content: str = "content", site: str | None = None) -> DataFrame:
    """Rules of robots files: a row per agent and rule, per sitemap line and per crawl delay, with the site of the file.

    ``site`` names the column that says whose file it is (null without one).
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows: list[tuple] = []
            for own, text in zip(pdf["site"], pdf["content"].fillna("")):
                agents, in_rules = [], False
                for line in text.splitlines():
                    field, _, value = line.split("#", 1)[0].partition(":")
                    field, value = field.strip().lower(), value.strip()
                    if field == "user-agent":
                        agents = [value.lower()] if in_rules else agents + [value.lower()]
                        in_rules = False
                    elif field in ("allow", "disallow"):
                        in_rules = True
                        rows += [(own, a, field == "allow", value, None, None) for a in agents if value]
                    elif field == "crawl-delay":
                        in_rules = True
                        delay = float(value) if re.fullmatch(r"\d+(\.\d+)?", value) else None
                        rows += [(own, a, None, None, None, delay) for a in agents]
                    elif field == "sitemap" and value:
                        rows.append((own, None, None, None, value, None))
            yield pd.DataFrame(rows, columns=["site", "agent", "allow", "pattern", "sitemap", "crawl_delay"])

    whose = F.col(site).cast("string") if site else F.lit(None).cast("string")
    return robots.select(whose.alias("site"), F.col(content).alias("content")).mapInPandas(read, _RULES)


def robots_regex(pattern: Column) -> Column:
    """A robots pattern as a regular expression: * is anything, $ at the end is the end."""
    literal = F.regexp_replace(F.regexp_replace(pattern, r"\$$", ""), r"([.\\+?^${}()|\[\]])", r"\\$1")
    return F.concat(F.lit("^"), F.regexp_replace(literal, r"\*", ".*"), F.when(pattern.endswith("$"), "$").otherwise(""))


def _group_of(rules: DataFrame, agent: Column, by: list[str]) -> DataFrame:
    """The rules of the group that holds for an agent: that of the longest name contained in it, else that of *."""
    fits = F.when(F.col("agent") == "*", 0).when(F.lower(agent).contains(F.col("agent")), F.length("agent"))
    named = rules.filter("pattern IS NOT NULL").withColumn("_fits", fits).filter("_fits IS NOT NULL")
    best = named.groupBy(*by).agg(F.max("_fits").alias("_best"))
    same = [named[c].eqNullSafe(best[c]) for c in by]
    return named.join(best, [*same, named["_fits"] == best["_best"]], "left_semi").drop("_fits")


def robots_allowed(paths: DataFrame, rules: DataFrame, agent: str) -> DataFrame:
    """Whether an agent may fetch each path of each site: the longest rule wins, a tie allows, no rule allows.

    ``paths`` holds path and, if the rules are of several sites, site. The rules of a site
    are gathered into one row (a robots file is small) and matched there, so paths and
    rules meet by an equal key.
    """
    own = "site" in paths.columns
    once = paths.select(*(["site"] if own else []), "path").distinct()
    group = _group_of(rules, F.lit(agent), ["site"]).groupBy("site").agg(F.collect_list(F.struct(F.length("pattern").alias("n"), "allow", robots_regex(F.col("pattern")).alias("regex"))).alias("_rules"))
    joined = once.join(group.withColumnRenamed("site", "_site"), F.col("site").eqNullSafe(F.col("_site")), "left").drop("_site") if own else once.crossJoin(F.broadcast(group.drop("site").agg(F.flatten(F.collect_list("_rules")).alias("_rules"))))
    hit = F.array_max(F.transform(F.filter("_rules", lambda r: F.regexp(F.col("path"), r["regex"])), lambda r: F.struct(r["n"].alias("n"), r["allow"].alias("allow"))))
    return joined.select(*once.columns, F.coalesce(hit["allow"], F.lit(True)).alias("allowed"))


# Crawlers of answer engines and search engines whose access is reported.
AI_AGENTS = ["OAI-SearchBot", "ChatGPT-User", "GPTBot", "ClaudeBot", "Claude-User", "Claude-SearchBot", "PerplexityBot", "Google-Extended", "Googlebot", "Bingbot", "CCBot"]


def agent_access(rules: DataFrame, agents: list[str] = AI_AGENTS) -> DataFrame:
    """Access of each agent to the start page of each site that has rules: site, agent, allowed."""
    sites = rules.select("site").distinct().withColumn("path", F.lit("/"))
    parts = [robots_allowed(sites, rules, a).select("site", F.lit(a).alias("agent"), "allowed") for a in agents]
    return reduce(DataFrame.unionByName, parts)


def sniff_separator(first_line: str) -> str:
    """The separator that occurs most outside quotes: comma, semicolon or tab."""
    bare = re.sub(r'"[^"]*"', "", first_line)
    return max((",", ";", "\t"), key=bare.count)


def read_csv(spark: SparkSession, path: str, max_columns: int = 200, max_cell: int = 100_000, max_rows: int | None = None, lenient: bool = False) -> DataFrame:
    """A dataset as text columns: separator found from the header, quotes doubled, records over several lines.

    ``lenient`` trims cells, fills short records with nulls and leaves blank ones out;
    otherwise a record of another width is an error. A cell or a table beyond its limit is
    an error as well.
    """
    head = spark.read.text(path).first()
    header = (head["value"] if head else "").lstrip("\ufeff")
    sep = sniff_separator(header)
    df = spark.read.csv(path, header=True, sep=sep, quote='"', escape='"', multiLine=True, mode="PERMISSIVE" if lenient else "FAILFAST", inferSchema=False, ignoreLeadingWhiteSpace=lenient, ignoreTrailingWhiteSpace=lenient)
    if len(df.columns) > max_columns:
        raise ValueError(f"{len(df.columns)} columns, at most {max_columns} are read")
    names = [c.strip().lower() for c in next(csv.reader([header], delimiter=sep), [])]
    if len(set(names)) < len(names):
        raise ValueError("two columns of the header have the same name")
    if max_rows is not None and df.limit(max_rows + 1).count() > max_rows:
        raise ValueError(f"more than {max_rows} rows")
    if lenient:
        df = df.filter(F.coalesce(F.array_max(F.array(*(F.length(F.trim(F.col(f"`{c}`"))) for c in df.columns))), F.lit(0)) > 0)
    within = lambda c: F.when(F.length(c) > max_cell, F.raise_error(F.lit(f"a cell has more than {max_cell} characters"))).otherwise(c)
    return df.select(*(within(F.col(f"`{c}`")).alias(c) for c in df.columns))


# Headers (folded, other signs as blanks) that exports of link lists use, by what they hold, exact names before contained words.
LINK_HEADERS = {
    "source": (["referring page url", "source url", "source page", "linking page", "pagina de enlace", "pagina que enlaza", "url de origen", "sourceurl", "from url", "url"], "referring|source|linking|origen|enlaza"),
    "target": (["target url", "target page", "targeturl", "url de destino", "to url", "pagina de destino"], "target|destino"),
    "anchor": (["anchor", "anchor text", "anchortext", "texto del enlace", "texto de anclaje"], "anchor|ancla"),
}
# Headers that tell the tool an export comes from, in order.
LINK_TOOLS = [("ahrefs", "referring page url"), ("semrush", "source url"), ("majestic", "sourceurl|targeturl"), ("gsc", "linking page|pagina de enlace|pagina que enlaza"), ("moz", "url")]


def link_columns(header: list[str]) -> dict[str, str | None]:
    """Which columns of an export hold the linking page, its target and the anchor, and the tool it comes from (generic if unknown)."""
    folded = {c: re.sub("[^a-z0-9]+", " ", unicodedata.normalize("NFD", c).encode("ascii", "ignore").decode().lower()).strip() for c in header}
    found: dict[str, str | None] = {}
    for what, (names, words) in LINK_HEADERS.items():
        exact = (c for n in names for c, f in folded.items() if f == n)
        found[what] = next(exact, None) or next((c for c, f in folded.items() if re.search(words, f)), None)
    if found["target"] == found["source"]:
        found["target"] = None
    found["tool"] = next((tool for tool, pattern in LINK_TOOLS if any(re.fullmatch(pattern, f) for f in folded.values())), "generic")
    return found


def read_backlinks(spark: SparkSession, path: str, own_host: str) -> DataFrame:
    """A list of links from any exporter: source_url, source_domain, target_url, anchor, tool; own links and repeats left out."""
    df = read_csv(spark, path)
    found = link_columns(df.columns)
    if not found["source"]:
        raise ValueError("no column holds the linking page")
    column = lambda what: F.col(f"`{found[what]}`") if found[what] else F.lit(None).cast("string")
    links = df.select(F.trim(column("source")).alias("source_url"), domain_of(F.trim(column("source"))).alias("source_domain"), F.trim(column("target")).alias("target_url"), column("anchor").alias("anchor"), F.lit(found["tool"]).alias("tool"))
    return links.filter((F.col("source_domain") != "") & ~owns(F.col("source_domain"), F.lit(own_host))).dropDuplicates(["source_url", "target_url"])


def parse_results_pages(rows: DataFrame, own_host: str, json: str = "json") -> DataFrame:
    """Results pages as columns: position and url of the own page, features, top domains."""
    schema = "organic array<struct<position:int,link:string,title:string>>, ai_overview struct<references:array<struct<link:string,title:string>>>, people_also_ask array<struct<question:string>>, local_results array<struct<title:string>>, images array<struct<link:string>>"
    r = F.from_json(json, schema)
    own = F.filter(r["organic"], lambda o: (domain_of(o["link"]) == own_host) | domain_of(o["link"]).endswith(f".{own_host}"))
    present = lambda c, name: F.when(F.coalesce(F.size(c), F.lit(0)) > 0, name)
    sources = r["ai_overview"]["references"]
    return rows.select(
        "*", F.get(own, F.lit(0))["position"].alias("position"), F.get(own, F.lit(0))["link"].alias("url"),
        F.array_compact(F.array(F.when(r["ai_overview"].isNotNull(), "ai_overview"), present(r["people_also_ask"], "people_also_ask"), present(r["local_results"], "local"), present(r["images"], "images"))).alias("features"),
        F.when(r["ai_overview"].isNotNull(), F.exists(F.coalesce(sources, F.array().cast("array<struct<link:string,title:string>>")), lambda s: domain_of(s["link"]) == own_host)).alias("ai_cites_us"),
        F.transform(F.slice(r["organic"], 1, 10), lambda o: F.struct(o["position"].alias("position"), domain_of(o["link"]).alias("domain"), o["link"].alias("url"))).alias("top_domains"),
    )


def parse_speed_results(rows: DataFrame, json: str = "json") -> DataFrame:
    """Lab results of a page-speed run: score (0-100), lcp, cls, tbt."""
    v = F.try_parse_json(F.col(json))
    number = lambda path: F.try_variant_get(v, path, "double")
    return rows.select(
        "*", F.floor(number("$.categories.performance.score") * 100 + 0.5).cast("int").alias("score"), number("$.audits['largest-contentful-paint'].numericValue").alias("lcp_ms"),
        number("$.audits['cumulative-layout-shift'].numericValue").alias("cls"), number("$.audits['total-blocking-time'].numericValue").alias("tbt_ms"),
    )


def parse_field_history(rows: DataFrame, json: str = "json") -> DataFrame:
    """Field history given as parallel arrays: one row per period and metric."""
    schema = "collectionPeriods array<struct<lastDate:struct<year:int,month:int,day:int>>>, metrics map<string,struct<percentilesTimeseries:struct<p75s:array<double>>>>"
    r = rows.select("*", F.from_json(json, schema).alias("_r")).select("*", F.explode("_r.metrics").alias("metric", "_m"))
    return r.select("*", F.explode(F.arrays_zip(F.col("_r.collectionPeriods").alias("period"), F.col("_m.percentilesTimeseries.p75s").alias("p75"))).alias("_z")).select(
        *rows.columns, "metric", F.make_date("_z.period.lastDate.year", "_z.period.lastDate.month", "_z.period.lastDate.day").alias("date"), F.col("_z.p75").alias("p75")
    )


def json_ld_nodes(pages: DataFrame, key: str = "url", html: str = "html") -> DataFrame:
    """Nodes of the JSON-LD in pages: key, node_no, type, json; a block that is no JSON gives type null and json null."""

    def walk(value):
        if isinstance(value, dict):
            if "@type" in value:
                yield value
            for v in value.values():
                yield from walk(v)
        elif isinstance(value, list):
            for v in value:
                yield from walk(v)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import json

        script = re.compile(r"<script[^>]*application/ld\+json[^>]*>(.*?)</script\s*>", re.IGNORECASE | re.DOTALL)
        for pdf in batches:
            rows = []
            for k, text in zip(pdf[key], pdf[html].fillna("")):
                n = 0
                for block in script.findall(text):
                    try:
                        nodes = list(walk(json.loads(block)))
                    except ValueError:
                        rows.append((k, n, None, None))
                        n += 1
                        continue
                    for node in nodes:
                        kind = node["@type"]
                        rows.append((k, n, kind if isinstance(kind, str) else ",".join(map(str, kind)), json.dumps(node, ensure_ascii=False)))
                        n += 1
            yield pd.DataFrame(rows, columns=[key, "node_no", "type", "json"])

    return pages.select(F.col(key).cast("string"), html).mapInPandas(read, f"{key} string, node_no int, type string, json string")
