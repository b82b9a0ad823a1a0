"""Log reports: who fetches what, errors, waste, latency, coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from almena.functions.agents import crawler_category, crawler_name, is_ai, is_google
from almena.functions.privacy import hash_ip, redact_query
from almena.functions.stats import LATENCY_LIMITS, bucket_limit, latency_bucket
from almena.functions.text import round_up
from almena.functions.url import first_dir, path_of, path_only, query_keys
from almena.functions.web import KINDS, resource_kind
from almena.operators.relational import top_per
from almena.sources.logs import parse_lines
from almena.session import table

ENTRY = ["log_id", "import_id", "site_id", "ts", "bot_name", "bot_category", "is_bot", "status_code", "path", "size_bytes", "response_ms"]


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log entries, repeated rows once."""
    return table(spark, sf_dir, "log_entry").select(*ENTRY).dropDuplicates(["log_id"])


def bots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entries(spark, sf_dir).filter("is_bot")


def log_aggregate(df: DataFrame) -> DataFrame:
    """Hits per day, crawler, status and path; people's paths are folded to a star."""
    return df.groupBy(
        F.to_date("ts").alias("date"), "bot_name", "bot_category", "status_code", F.when(F.col("is_bot"), path_only(F.col("path"))).otherwise("*").alias("path")
    ).agg(
        F.count("*").alias("hits"), F.sum("size_bytes").alias("bytes"), F.sum(F.col("response_ms").cast("long")).alias("duration_sum"), F.count("response_ms").alias("duration_samples"),
    )


def a1_log_aggregate(spark, sf_dir):
    """Daily facts of the log."""
    return log_aggregate(entries(spark, sf_dir))


def a2_totals(spark, sf_dir):
    """Counters of the log in one pass."""
    df = entries(spark, sf_dir)
    return df.groupBy("site_id").agg(
        F.count("*").alias("total"), F.count_if("is_bot").alias("bots"), F.count_if(is_google(F.col("bot_name"))).alias("google"), F.count_if(is_ai(F.col("bot_category"))).alias("ai"),
        F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.countDistinct(F.when(F.col("is_bot"), path_only(F.col("path")))).alias("bot_paths"),
    )


def r1_bot_hits_by_day(spark, sf_dir):
    """Hits and bytes per day and crawler."""
    return bots(spark, sf_dir).groupBy(F.to_date("ts").alias("date"), "bot_name").agg(F.count("*").alias("hits"), F.sum("size_bytes").alias("bytes"))


def r1_by_directory(spark, sf_dir):
    """Crawler hits per site and first directory."""
    return bots(spark, sf_dir).groupBy("site_id", first_dir(F.col("path")).alias("directory")).agg(F.count("*").alias("hits"))


def r1_status(spark, sf_dir):
    """Crawler hits per status."""
    return bots(spark, sf_dir).groupBy("status_code").agg(F.count("*").alias("hits"))


def r1_hours(spark, sf_dir):
    """Crawler hits per hour of the day, all 24."""
    hits = bots(spark, sf_dir).groupBy(F.hour("ts").alias("hour")).agg(F.count("*").alias("n"))
    return spark.range(24).select(F.col("id").cast("int").alias("hour")).join(hits, "hour", "left").select("hour", F.coalesce("n", F.lit(0)).alias("hits"))


def _by_path(spark, sf_dir, rows=None):
    df = bots(spark, sf_dir)
    return (df.filter(rows) if rows is not None else df).groupBy("site_id", path_only(F.col("path")).alias("path")).agg(F.count("*").alias("hits"))


def r1_top_urls(spark, sf_dir):
    """The 50 paths crawlers fetch most."""
    return _by_path(spark, sf_dir).orderBy(F.desc("hits"), "site_id", "path").limit(50)


def r1_least_urls(spark, sf_dir):
    """The 50 paths crawlers fetch least."""
    return _by_path(spark, sf_dir).orderBy("hits", "site_id", "path").limit(50)


def r1_client_errors(spark, sf_dir):
    """The 100 paths with most 4xx answers."""
    return _by_path(spark, sf_dir, F.col("status_code").between(400, 499)).orderBy(F.desc("hits"), "site_id", "path").limit(100)


def r1_server_errors(spark, sf_dir):
    """The 100 paths with most 5xx answers."""
    return _by_path(spark, sf_dir, F.col("status_code") >= 500).orderBy(F.desc("hits"), "site_id", "path").limit(100)


def r1_redirects(spark, sf_dir):
    """The 100 paths with most redirects."""
    return _by_path(spark, sf_dir, F.col("status_code").between(300, 399)).orderBy(F.desc("hits"), "site_id", "path").limit(100)


def a3_parameters(spark, sf_dir):
    """The 500 most frequent query parameters in crawler requests."""
    keys = bots(spark, sf_dir).filter(F.col("path").contains("?")).select(F.explode(query_keys(F.col("path"))).alias("parameter"))
    return keys.groupBy("parameter").agg(F.count("*").alias("hits")).orderBy(F.desc("hits"), "parameter").limit(500)


def r1_crawl_waste(spark, sf_dir):
    """Share of crawler hits per site that met no plain page: status 300 and up, or parameters."""
    waste = (F.col("status_code") >= 300) | F.col("path").contains("?")
    return bots(spark, sf_dir).groupBy("site_id").agg(F.count("*").alias("hits"), F.count_if(waste).alias("waste"), round_up(F.count_if(waste) / F.count("*"), 4).alias("share"))


def r1_latency_percentiles(spark, sf_dir):
    """Latency percentiles per crawler from fixed buckets: the limit of the first bucket that reaches the rank."""
    counts = entries(spark, sf_dir).filter("response_ms IS NOT NULL").groupBy("bot_name", latency_bucket(F.col("response_ms")).alias("bucket")).agg(F.count("*").alias("n"))
    wide = counts.groupBy("bot_name").agg(F.sum("n").alias("samples"), *(F.sum(F.when(F.col("bucket") == b, F.col("n")).otherwise(0)).alias(f"_b{b}") for b in range(len(LATENCY_LIMITS) + 1)))
    upto = [sum((F.col(f"_b{i}") for i in range(1, b + 1)), F.col("_b0")) for b in range(len(LATENCY_LIMITS) + 1)]

    def at(p: float):
        rank = F.ceil(F.col("samples") * p - 1e-9)
        chain = F.when(upto[0] >= rank, 0)
        for b in range(1, len(upto)):
            chain = chain.when(upto[b] >= rank, b)
        return bucket_limit(chain)

    return wide.select("bot_name", "samples", at(0.5).alias("p50"), at(0.9).alias("p90"), at(0.99).alias("p99"))


def r1_never_crawled(spark, sf_dir):
    """Pages that answered 200 in a crawl and that Google's crawlers never asked for, per site."""
    pages = table(spark, sf_dir, "crawled_page").filter("status_code = 200").select("crawl_run_id", path_of(F.col("url")).alias("path"))
    known = pages.join(table(spark, sf_dir, "crawl_run").select("crawl_run_id", "site_id"), "crawl_run_id").select("site_id", "path").distinct()
    asked = entries(spark, sf_dir).filter(is_google(F.col("bot_name"))).select("site_id", "path").distinct()
    return known.join(asked, ["site_id", "path"], "left_anti")


def r1_not_in_crawl(spark, sf_dir):
    """Paths crawlers fetched with 200 that no crawl of the site has."""
    pages = table(spark, sf_dir, "crawled_page").select("crawl_run_id", path_of(F.col("url")).alias("path"))
    known = pages.join(table(spark, sf_dir, "crawl_run").select("crawl_run_id", "site_id"), "crawl_run_id").select("site_id", "path").distinct()
    return bots(spark, sf_dir).filter("status_code = 200").select("site_id", "path").distinct().join(known, ["site_id", "path"], "left_anti")


def r1_ai_bots(spark, sf_dir):
    """Hits of AI crawlers per site and crawler with their share of all crawler hits of the site."""
    df = bots(spark, sf_dir).groupBy("site_id", "bot_name", "bot_category").agg(F.count("*").alias("hits"))
    whole = F.sum("hits").over(Window.partitionBy("site_id"))
    return df.withColumn("share", round_up(F.col("hits") / whole, 4)).filter(is_ai(F.col("bot_category"))).select("site_id", "bot_name", "hits", "share")


def r2_bot_urls(spark, sf_dir):
    """Rows of the flat export: crawler, path, status, hits, bytes."""
    return bots(spark, sf_dir).groupBy("bot_name", path_only(F.col("path")).alias("path"), "status_code").agg(F.count("*").alias("hits"), F.sum("size_bytes").alias("bytes"))


def a8_grouping_sets(spark, sf_dir):
    """Hits by day, by crawler, by status and in all, from one pass over the aggregate."""
    base = bots(spark, sf_dir).select(F.to_date("ts").alias("date"), "bot_name", "status_code")
    return base.groupingSets([["date"], ["bot_name"], ["status_code"], []], "date", "bot_name", "status_code").agg(F.grouping_id().cast("long").alias("level"), F.count("*").alias("hits"))


def a7_distinct_exact(spark, sf_dir):
    """Distinct paths per crawler."""
    return bots(spark, sf_dir).groupBy("bot_name").agg(F.countDistinct("path").alias("paths"))


def a7_distinct_approx(spark, sf_dir):
    """Distinct paths per crawler, by sketch."""
    return bots(spark, sf_dir).groupBy("bot_name").agg(F.approx_count_distinct("path", 0.02).alias("paths"))


def s5_imports(spark, sf_dir):
    """Imports kept once per site and checksum, the earliest, with the share of lines that did not parse."""
    df = table(spark, sf_dir, "log_import").dropDuplicates(["import_id"])
    first = top_per(df, ["site_id", "checksum"], 1, F.col("created_at").asc(), F.col("import_id").asc())
    lines = F.col("valid_lines") + F.coalesce("invalid_lines", F.lit(0))
    return first.select("import_id", "site_id", "checksum", "valid_lines", round_up(F.coalesce(F.try_divide(F.coalesce("invalid_lines", F.lit(0)).cast("double"), lines.cast("double")), F.lit(0.0)), 6).alias("invalid_share"))


def a17_file_types(spark, sf_dir):
    """Crawler hits by kind of file."""
    return bots(spark, sf_dir).groupBy(resource_kind(F.col("path")).alias("kind")).agg(F.count("*").alias("hits"), F.countDistinct("site_id").alias("sites"))


def u2_known_paths(spark, sf_dir):
    """Paths per site that crawls or crawlers know, each once: how many."""
    pages = table(spark, sf_dir, "crawled_page").select("crawl_run_id", path_only(path_of(F.col("url"))).alias("path"))
    seen = pages.join(table(spark, sf_dir, "crawl_run").select("crawl_run_id", "site_id"), "crawl_run_id").select("site_id", "path")
    return seen.union(bots(spark, sf_dir).select("site_id", path_only(F.col("path")).alias("path"))).distinct().groupBy("site_id").agg(F.count("*").alias("paths"))


def a2_import_totals(spark, sf_dir):
    """Lines of imports per site: all, valid, invalid, and what the kept log holds of them."""
    i = table(spark, sf_dir, "log_import").dropDuplicates(["import_id"])
    n = entries(spark, sf_dir).groupBy("import_id").agg(F.count("*").alias("kept"), F.count_if("is_bot").alias("bots"))
    j = i.join(n, "import_id", "left")
    return j.groupBy("site_id").agg(F.count("*").alias("imports"), F.sum("valid_lines").alias("valid"), F.sum(F.coalesce("invalid_lines", F.lit(0))).alias("invalid"), F.count_if(F.col("invalid_lines").isNull()).alias("unknown"), F.sum(F.coalesce("kept", F.lit(0))).alias("kept"), F.sum(F.coalesce("bots", F.lit(0))).alias("bots"))


def combined_line() -> Column:
    """A log line in combined format written from the columns of an entry."""
    agent = F.concat(F.lit("Mozilla/5.0 (compatible; "), F.coalesce("bot_name", F.lit("-")), F.lit("/2.1)"))
    return F.concat(
        F.lit("198.51.100."), (F.col("log_id") % 250).cast("string"), F.lit(" - - ["), F.date_format(F.col("ts").cast("timestamp"), "dd/MMM/yyyy:HH:mm:ss"), F.lit(' +0000] "GET '), "path", F.lit(' HTTP/1.1" '), F.col("status_code").cast("string"), F.lit(" "),
        F.coalesce(F.col("size_bytes").cast("string"), F.lit("-")), F.lit(' "-" "'), agent, F.lit('"'), F.when(F.col("response_ms").isNotNull(), F.concat(F.lit(" "), F.format_string("%.3f", F.col("response_ms") / 1000.0))).otherwise(""),
    )


def s2_parse_combined(spark, sf_dir):
    """Entries written as combined lines and parsed again: hits, bytes and time per status and agent class."""
    lines = entries(spark, sf_dir).select(combined_line().alias("value"))
    parsed = parse_lines(lines, "salt").filter("ok")
    return parsed.groupBy("status_code", F.to_date("ts").alias("date")).agg(F.count("*").alias("hits"), F.sum("size_bytes").alias("bytes"), F.sum(F.col("response_ms").cast("long")).alias("duration_sum"))


def c1_crawler_names(spark, sf_dir):
    """Agents written from crawler names and told apart again."""
    names = entries(spark, sf_dir).groupBy("bot_name").agg(F.count("*").alias("hits"))
    agent = F.when(F.col("bot_name") == "Googlebot Smartphone", "Mozilla/5.0 (Linux; Android 14) Mobile (compatible; Googlebot/2.1)").when(F.col("bot_name") == "Googlebot Desktop", "Mozilla/5.0 (compatible; Googlebot/2.1)").otherwise(F.concat(F.lit("Mozilla/5.0 (compatible; "), "bot_name", F.lit("/2.1)")))
    found = crawler_name(agent)
    return names.filter("bot_name IS NOT NULL").select("bot_name", found.alias("found"), crawler_category(found).alias("category"), "hits")


def c5_redacted_queries(spark, sf_dir):
    """Query strings with the order parameter and all usual secrets masked."""
    df = entries(spark, sf_dir).filter(F.col("path").contains("?")).select(redact_query(F.regexp_extract("path", r"\?(.*)$", 1), ["orden"]).alias("query"))
    return df.groupBy("query").agg(F.count("*").alias("hits"))


def c6_hashed_clients(spark, sf_dir):
    """Keyed hashes of client addresses made from log ids: hits per hash."""
    ip = F.concat(F.lit("198.51.100."), (F.col("log_id") % 250).cast("string"))
    return entries(spark, sf_dir).select(hash_ip(ip, "salt").alias("ip_hash")).groupBy("ip_hash").agg(F.count("*").alias("hits"))


def a40_verified(spark, sf_dir):
    """Claimed crawler hits against a table of verified clients: claimed, verified, spoofed per crawler."""
    client = (F.col("log_id") % 250).alias("client")
    hits = bots(spark, sf_dir).select("bot_name", client).groupBy("bot_name", "client").agg(F.count("*").alias("hits"))
    verdicts = spark.range(250).select(F.col("id").alias("client"), (F.col("id") % 10 < 8).alias("genuine"))
    return hits.join(verdicts, "client", "left").groupBy("bot_name").agg(
        F.sum("hits").alias("claimed"), F.sum(F.when(F.col("genuine"), F.col("hits")).otherwise(0)).alias("verified"), F.sum(F.when(~F.col("genuine"), F.col("hits")).otherwise(0)).alias("spoofed"), F.count("client").alias("clients")
    )


_E = "WITH e AS (SELECT DISTINCT log_id, import_id, site_id, ts, bot_name, bot_category, is_bot, status_code, path, size_bytes, response_ms, split_part(path, '?', 1) AS pure FROM log_entry)\n"
_BY_PATH = _E + "SELECT site_id, pure AS path, count(*) AS hits FROM e WHERE is_bot {} GROUP BY 1, 2 ORDER BY {}, site_id, path LIMIT {}"
_BUCKET = "CASE " + " ".join(f"WHEN response_ms <= {x} THEN {i}" for i, x in enumerate(LATENCY_LIMITS)) + f" ELSE {len(LATENCY_LIMITS)} END"
_LIMIT = "CASE b " + " ".join(f"WHEN {i} THEN {x}" for i, x in enumerate([*LATENCY_LIMITS, LATENCY_LIMITS[-1]])) + " END"
_DIR = "CASE WHEN regexp_extract(pure, '^/*([^/]+)', 1) = '' THEN '/' ELSE '/' || regexp_extract(pure, '^/*([^/]+)', 1) || '/' END"
_PAGE_PATH = "(CASE WHEN regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1) = '' THEN '/' ELSE regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1) END || regexp_extract(url, '(\\?[^#]*)', 1))"

QUERIES = {f.__name__: f for f in (
    a1_log_aggregate, a2_totals, r1_bot_hits_by_day, r1_by_directory, r1_status, r1_hours, r1_top_urls, r1_least_urls, r1_client_errors, r1_server_errors, r1_redirects, a3_parameters, r1_crawl_waste,
    r1_latency_percentiles, r1_never_crawled, r1_not_in_crawl, r1_ai_bots, r2_bot_urls, a8_grouping_sets, a7_distinct_exact, a7_distinct_approx, s5_imports, a17_file_types, u2_known_paths, a2_import_totals, s2_parse_combined, c1_crawler_names, c5_redacted_queries, c6_hashed_clients, a40_verified,
)}
SQL = {
    "a1_log_aggregate": _E + "SELECT CAST(ts AS DATE) AS date, bot_name, bot_category, status_code, CASE WHEN is_bot THEN pure ELSE '*' END AS path, count(*) AS hits, CAST(sum(size_bytes) AS BIGINT) AS bytes, CAST(sum(response_ms) AS BIGINT) AS duration_sum, count(response_ms) AS duration_samples FROM e GROUP BY ALL",
    "a2_totals": _E + "SELECT site_id, count(*) AS total, count(*) FILTER (WHERE is_bot) AS bots, count(*) FILTER (WHERE bot_name LIKE 'Googlebot%') AS google, count(*) FILTER (WHERE bot_category IN ('AI_CRAWLER', 'AI_ASSISTANT')) AS ai, min(ts) AS first_ts, max(ts) AS last_ts, count(DISTINCT CASE WHEN is_bot THEN pure END) AS bot_paths FROM e GROUP BY 1",
    "r1_bot_hits_by_day": _E + "SELECT CAST(ts AS DATE) AS date, bot_name, count(*) AS hits, CAST(sum(size_bytes) AS BIGINT) AS bytes FROM e WHERE is_bot GROUP BY 1, 2",
    "r1_by_directory": _E + f"SELECT site_id, {_DIR} AS directory, count(*) AS hits FROM e WHERE is_bot GROUP BY 1, 2",
    "r1_status": _E + "SELECT status_code, count(*) AS hits FROM e WHERE is_bot GROUP BY 1",
    "r1_hours": _E + "SELECT CAST(h.range AS INTEGER) AS hour, count(e.log_id) AS hits FROM range(24) h LEFT JOIN e ON hour(e.ts) = h.range AND e.is_bot GROUP BY 1",
    "r1_top_urls": _BY_PATH.format("", "hits DESC", 50), "r1_least_urls": _BY_PATH.format("", "hits", 50),
    "r1_client_errors": _BY_PATH.format("AND status_code BETWEEN 400 AND 499", "hits DESC", 100), "r1_server_errors": _BY_PATH.format("AND status_code >= 500", "hits DESC", 100), "r1_redirects": _BY_PATH.format("AND status_code BETWEEN 300 AND 399", "hits DESC", 100),
    "a3_parameters": _E + "SELECT parameter, count(*) AS hits FROM (SELECT split_part(unnest(string_split(regexp_extract(path, '\\?([^#]*)', 1), '&')), '=', 1) AS parameter FROM e WHERE is_bot AND contains(path, '?')) WHERE parameter <> '' GROUP BY 1 ORDER BY hits DESC, parameter LIMIT 500",
    "r1_crawl_waste": _E + "SELECT site_id, count(*) AS hits, count(*) FILTER (WHERE status_code >= 300 OR contains(path, '?')) AS waste, floor(count(*) FILTER (WHERE status_code >= 300 OR contains(path, '?')) / count(*) * 10000 + 0.5) / 10000 AS share FROM e WHERE is_bot GROUP BY 1",
    "r1_latency_percentiles": _E + f", c AS (SELECT bot_name, {_BUCKET} AS b, count(*) AS n FROM e WHERE response_ms IS NOT NULL GROUP BY 1, 2), u AS (SELECT bot_name, b, sum(n) OVER (PARTITION BY bot_name ORDER BY b) AS upto, sum(n) OVER (PARTITION BY bot_name) AS samples FROM c) SELECT bot_name, CAST(samples AS BIGINT) AS samples, "
    + ", ".join(f"min({_LIMIT}) FILTER (WHERE upto >= ceil(samples * {p} - 1e-9)) AS {n}" for n, p in (("p50", 0.5), ("p90", 0.9), ("p99", 0.99))) + " FROM u GROUP BY bot_name, samples",
    "r1_never_crawled": f"SELECT DISTINCT r.site_id, {_PAGE_PATH} AS path FROM crawled_page p JOIN crawl_run r USING (crawl_run_id) WHERE p.status_code = 200 EXCEPT SELECT site_id, path FROM log_entry WHERE bot_name LIKE 'Googlebot%'",
    "r1_not_in_crawl": f"SELECT DISTINCT site_id, path FROM log_entry WHERE is_bot AND status_code = 200 EXCEPT SELECT r.site_id, {_PAGE_PATH} FROM crawled_page p JOIN crawl_run r USING (crawl_run_id)",
    "r1_ai_bots": _E + ", h AS (SELECT site_id, bot_name, bot_category, count(*) AS hits FROM e WHERE is_bot GROUP BY ALL), s AS (SELECT *, floor(hits / sum(hits) OVER (PARTITION BY site_id) * 10000 + 0.5) / 10000 AS share FROM h) SELECT site_id, bot_name, hits, share FROM s WHERE bot_category IN ('AI_CRAWLER', 'AI_ASSISTANT')",
    "r2_bot_urls": _E + "SELECT bot_name, pure AS path, status_code, count(*) AS hits, CAST(sum(size_bytes) AS BIGINT) AS bytes FROM e WHERE is_bot GROUP BY ALL",
    "a8_grouping_sets": _E + "SELECT CAST(ts AS DATE) AS date, bot_name, status_code, CAST(grouping(CAST(ts AS DATE), bot_name, status_code) AS BIGINT) AS level, count(*) AS hits FROM e WHERE is_bot GROUP BY GROUPING SETS ((CAST(ts AS DATE)), (bot_name), (status_code), ())",
    "a7_distinct_exact": _E + "SELECT bot_name, count(DISTINCT path) AS paths FROM e WHERE is_bot GROUP BY 1",
    "s5_imports": "WITH i AS (SELECT *, row_number() OVER (PARTITION BY site_id, checksum ORDER BY created_at, import_id) AS rn FROM (SELECT DISTINCT ON (import_id) * FROM log_import)) SELECT import_id, site_id, checksum, valid_lines, floor(CASE WHEN valid_lines + coalesce(invalid_lines, 0) = 0 THEN 0 ELSE coalesce(invalid_lines, 0) / (valid_lines + coalesce(invalid_lines, 0)) END * 1000000 + 0.5) / 1000000 AS invalid_share FROM i WHERE rn = 1",
    "a17_file_types": _E + ", x AS (SELECT *, lower(regexp_extract(pure, '\\.([A-Za-z0-9]{1,5})$', 1)) AS e FROM e WHERE is_bot) SELECT CASE " + " ".join(f"WHEN regexp_full_match(e, '{p}') THEN '{k}'" for k, p in KINDS.items()) + " ELSE 'page' END AS kind, count(*) AS hits, count(DISTINCT site_id) AS sites FROM x GROUP BY 1",
    "u2_known_paths": _E + f", p AS (SELECT r.site_id, split_part({_PAGE_PATH}, '?', 1) AS path FROM crawled_page JOIN crawl_run r USING (crawl_run_id) UNION SELECT site_id, pure FROM e WHERE is_bot) SELECT site_id, count(*) AS paths FROM p GROUP BY 1",
    "a2_import_totals": _E + ", i AS (SELECT DISTINCT ON (import_id) * FROM log_import), n AS (SELECT import_id, count(*) AS kept, count(*) FILTER (WHERE is_bot) AS bots FROM e GROUP BY 1) SELECT i.site_id, count(*) AS imports, CAST(sum(valid_lines) AS BIGINT) AS valid, CAST(sum(coalesce(invalid_lines, 0)) AS BIGINT) AS invalid, count(*) FILTER (WHERE invalid_lines IS NULL) AS unknown, CAST(sum(coalesce(kept, 0)) AS BIGINT) AS kept, CAST(sum(coalesce(bots, 0)) AS BIGINT) AS bots FROM i LEFT JOIN n USING (import_id) GROUP BY 1",
    "s2_parse_combined": _E + "SELECT status_code, CAST(ts AS DATE) AS date, count(*) AS hits, CAST(sum(coalesce(size_bytes, 0)) AS BIGINT) AS bytes, CAST(sum(response_ms) AS BIGINT) AS duration_sum FROM e GROUP BY 1, 2",
    "c1_crawler_names": _E + "SELECT bot_name, bot_name AS found, max(bot_category) AS category, count(*) AS hits FROM e WHERE bot_name IS NOT NULL GROUP BY bot_name",
    "c5_redacted_queries": _E + "SELECT regexp_replace(regexp_extract(path, '\\?(.*)$', 1), '(^|&)orden=[^&]*', '\\1orden=%5BREDACTED%5D', 'g') AS query, count(*) AS hits FROM e WHERE contains(path, '?') GROUP BY 1",
    "c6_hashed_clients": _E + f"SELECT substr(sha256(unhex('{bytes(b ^ 0x5C for b in b'salt'.ljust(64, bytes(1))).hex()}') || unhex(sha256(unhex('{bytes(b ^ 0x36 for b in b'salt'.ljust(64, bytes(1))).hex()}') || encode('198.51.100.' || (log_id % 250))))), 1, 16) AS ip_hash, count(*) AS hits FROM e GROUP BY 1",
    "a40_verified": _E + ", h AS (SELECT bot_name, log_id % 250 AS client, count(*) AS hits FROM e WHERE is_bot GROUP BY 1, 2) SELECT bot_name, CAST(sum(hits) AS BIGINT) AS claimed, CAST(sum(CASE WHEN client % 10 < 8 THEN hits ELSE 0 END) AS BIGINT) AS verified, CAST(sum(CASE WHEN client % 10 < 8 THEN 0 ELSE hits END) AS BIGINT) AS spoofed, count(client) AS clients FROM h GROUP BY 1",
}
