"""Crawl reports: audit, explorer, structure, differences, alerts, coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from almena.functions.stats import priority
from almena.functions.url import domain_of, endings, first_folder, host_of, parts, path_of, prefixes, url_key
from almena.operators import audit, crawl, monitor
from almena.operators.relational import as_of_gap, folder_tree, latest, previous_of, state_changes, top_per, union_tagged
from almena.session import table
from almena.sources.sinks import expired


def view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of all runs, once per URL."""
    return crawl.page_view(table(spark, sf_dir, "crawled_page"))


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "crawl_run").dropDuplicates(["crawl_run_id"])


def r4_issue_counts(spark, sf_dir):
    """Pages hit per run and audit rule."""
    return crawl.audit(view(spark, sf_dir)).groupBy("crawl_run_id", "code", "severity").agg(F.count("*").alias("urls"))


def wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with the columns of the full rules that can be told from the table: robots by the reason, one hop for a redirect, depth by folders, a sitemap of addresses without parameters."""
    v = view(spark, sf_dir)
    return v.withColumns({
        "robots_meta": F.when(F.col("indexability_reason") == "noindex", "noindex"), "x_robots_tag": F.lit(None).cast("string"), "error": F.lit(None).cast("string"), "in_sitemap": ~F.col("url").contains("?") & (F.col("status_code") != 404),
        "redirect_chain": F.when(F.col("redirected"), F.array(F.struct(F.col("final_url").alias("url"), F.lit(301).alias("status")))), "depth": F.size(F.filter(F.split(F.regexp_replace("url", "^https?://[^/]*/?", ""), "[/?]"), lambda x: x != "")),
    })


def r4_all_rules(spark, sf_dir):
    """Pages hit per rule over all runs, by every rule whose columns are there."""
    return audit.audit_pages(wide(spark, sf_dir)).groupBy("code", "severity").agg(F.count("*").alias("urls"))


def r6_tab_counts(spark, sf_dir):
    """Pages per tab and filter over all runs."""
    return audit.tab_counts(wide(spark, sf_dir)).groupBy("filter").agg(F.sum("rows").alias("rows"))


def t3_worst_issues(spark, sf_dir):
    """The 50 worst issues by severity, then by pages."""
    rank = F.create_map(*(F.lit(x) for p in {"CRITICAL": 0, "HIGH": 1, "MEDIUM": 2, "LOW": 3, "INFO": 4}.items() for x in p))
    issues = audit.audit_pages(wide(spark, sf_dir)).groupBy("crawl_run_id", "code", "severity").agg(F.count("*").alias("urls"))
    return issues.orderBy(rank[F.col("severity")], F.desc("urls"), "code", "crawl_run_id").limit(50)


def r27_run_news(spark, sf_dir):
    """Each site's last full crawl against the one before: what got better or worse."""
    v = view(spark, sf_dir).groupBy("crawl_run_id").agg(
        F.count_if("is_indexable").alias("indexable"), F.count_if(F.col("status_code").between(400, 499)).alias("errors_4xx"), F.count_if(F.col("status_code") >= 500).alias("errors_5xx"), F.round(F.avg(F.when(F.col("status_code") == 200, F.col("response_time_ms"))), 0).alias("mean_ms")
    )
    done = runs(spark, sf_dir).filter("run_status = 'completed' AND crawl_mode <> 'list'").select("crawl_run_id", "site_id", "started_at", F.lit(False).alias("partial"))
    return monitor.crawl_news(done.join(v, "crawl_run_id"))


def w13_recent_groups(spark, sf_dir):
    """Crawls with the newest start of their site, by which groups are ordered."""
    newest = F.max("started_at").over(Window.partitionBy("site_id"))
    return runs(spark, sf_dir).select("site_id", "crawl_run_id", newest.alias("newest"))


def j1_pages_with_hits(spark, sf_dir):
    """URLs of all crawls with the crawler hits of their address's key, 0 without any: URLs and hits per site host."""
    urls = table(spark, sf_dir, "crawled_page").select("url").distinct().withColumn("_k", url_key(F.col("url")))
    sites = table(spark, sf_dir, "crawl_run").select("crawl_run_id", "site_id").distinct().join(table(spark, sf_dir, "crawled_page").select("crawl_run_id", host_of(F.col("url")).alias("host")).distinct(), "crawl_run_id").select("site_id", "host").distinct()
    hits = table(spark, sf_dir, "log_entry").filter("is_bot").select("log_id", "site_id", "path").distinct().join(sites, "site_id").groupBy(url_key(F.concat(F.lit("https://"), "host", "path")).alias("_k")).agg(F.count("*").alias("hits"))
    return urls.join(hits, "_k", "left").groupBy(host_of(F.col("url")).alias("host")).agg(F.count("*").alias("urls"), F.sum(F.coalesce("hits", F.lit(0))).alias("hits"))


def r5_issue_states(spark, sf_dir):
    """Issues of each run against those of its base: new, open or resolved."""
    found = crawl.audit(view(spark, sf_dir)).groupBy("crawl_run_id", "code").agg(F.count("*").alias("urls"))
    pairs = runs(spark, sf_dir).filter("base_run_id IS NOT NULL")
    key = F.concat_ws(":", "run", "code").alias("issue")
    now = pairs.select(F.col("crawl_run_id").alias("run"), "crawl_run_id").join(found, "crawl_run_id").select(key)
    old = pairs.select(F.col("crawl_run_id").alias("run"), F.col("base_run_id").alias("crawl_run_id")).join(found, "crawl_run_id").select(key, F.lit(True).alias("open"))
    return state_changes(now, old, "issue")


def f12_priorities(spark, sf_dir):
    """Priority of each rule per run from its reach and severity."""
    weight = F.create_map(*(F.lit(x) for p in {"CRITICAL": 2.0, "HIGH": 1.5, "MEDIUM": 1.0, "LOW": 0.6, "INFO": 0.3}.items() for x in p))
    counts = crawl.audit(view(spark, sf_dir)).groupBy("crawl_run_id", "code", "severity").agg(F.count("*").alias("urls"))
    return counts.select("crawl_run_id", "code", priority(F.lit(5.0), F.lit(0.9), F.col("urls"), weight[F.col("severity")], F.lit(2.0), F.lit(1.0)).alias("priority"))


def c8_indexability(spark, sf_dir):
    """Reasons why pages cannot be indexed, from the first rule that holds."""
    return view(spark, sf_dir).select(crawl.indexability().alias("i")).groupBy("i.indexable", "i.reason").agg(F.count("*").alias("pages"))


def r6_explorer_counts(spark, sf_dir):
    """Pages per run and explorer filter, in one pass."""
    return crawl.explorer_counts(view(spark, sf_dir))


def r7_explorer_rows(spark, sf_dir):
    """First page of the filter for long titles, slowest first."""
    return crawl.explorer(view(spark, sf_dir), "titles_over_60", sort="response_time_ms", descending=True).select("crawl_run_id", "url", "response_time_ms", "title")


def r9_custom_search(spark, sf_dir):
    """Pages whose title matches a pattern, with the number of hits."""
    return crawl.custom_search(view(spark, sf_dir), "title", "regex", "[aeiou]n").select("crawl_run_id", "url", "hits")


def r10_structure(spark, sf_dir):
    """Pages, errors and mean words for every folder of each site and all above it."""
    pages = view(spark, sf_dir).withColumn("_path", path_of(F.col("url"))).withColumn("host", host_of(F.col("url")))
    return pages.select("host", "status_code", "word_count", F.explode(prefixes(F.col("_path"))).alias("folder")).groupBy("host", "folder").agg(
        F.count("*").alias("pages"), F.count_if(F.col("status_code") >= 400).alias("errors"), F.round(F.avg("word_count"), 4).alias("mean_words"))


def r10_folder_totals(spark, sf_dir):
    """Pages for every folder over all hosts."""
    return folder_tree(view(spark, sf_dir), path_of(F.col("url")), {"pages": F.count("*"), "inlinks": F.sum(F.col("inlinks").cast("long"))})


def r11_differences(spark, sf_dir):
    """Changes between runs and their bases, counted per kind."""
    return crawl.differences(view(spark, sf_dir), runs(spark, sf_dir)).groupBy("crawl_run_id", "change").agg(F.count("*").alias("urls"))


def r12_alerts(spark, sf_dir):
    """Alerts of each run."""
    v = view(spark, sf_dir)
    return crawl.alerts(crawl.differences(v, runs(spark, sf_dir)), v)


def a14_duplicate_titles(spark, sf_dir):
    """Titles that several URLs of a run share."""
    v = view(spark, sf_dir).filter("html200 AND trim(coalesce(title, '')) <> ''")
    return v.groupBy("crawl_run_id", F.lower(F.trim("title")).alias("title")).agg(F.count("*").alias("urls")).filter("urls > 1")


def j4_seen_in_logs(spark, sf_dir):
    """Pages per site that the log has asked for, and that it has not."""
    pages = table(spark, sf_dir, "crawled_page").select("crawl_run_id", path_of(F.col("url")).alias("path"))
    known = pages.join(runs(spark, sf_dir).select("crawl_run_id", "site_id"), "crawl_run_id").select("site_id", "path").distinct()
    asked = table(spark, sf_dir, "log_entry").select("site_id", "path").distinct().withColumn("seen", F.lit(True))
    return known.join(asked, ["site_id", "path"], "left").groupBy("site_id").agg(F.count("*").alias("pages"), F.count_if(F.coalesce("seen", F.lit(False))).alias("in_logs"))


def j11_previous_run(spark, sf_dir):
    """Each completed site crawl with the one before it on its site."""
    done = runs(spark, sf_dir).filter("run_status = 'completed' AND crawl_mode = 'site'").select("site_id", "crawl_run_id", "started_at")
    return previous_of(done, ["site_id"], "started_at", "crawl_run_id").select("crawl_run_id", "previous_crawl_run_id", "previous_started_at")


def j12_reference_run(spark, sf_dir):
    """Each site's last crawl day with the last one three weeks or more before it, else the first."""
    days = runs(spark, sf_dir).filter("run_status = 'completed'").select("site_id", F.to_date("started_at").alias("day")).distinct()
    return as_of_gap(days, ["site_id"], "day", 21)


def w1_latest_pages(spark, sf_dir):
    """Status of each URL at its last fetch over all runs."""
    pages = table(spark, sf_dir, "crawled_page").select("url", "fetched_at", "crawl_run_id", "status_code")
    return latest(pages, ["url"], "fetched_at", "crawl_run_id", "status_code").groupBy("status_code").agg(F.count("*").alias("urls"))


def w2_last_runs(spark, sf_dir):
    """The three newest crawls of each site."""
    return top_per(runs(spark, sf_dir), ["site_id"], 3, F.col("started_at").desc(), F.col("crawl_run_id").desc()).select("site_id", "crawl_run_id")


def k9_expired_runs(spark, sf_dir):
    """Crawls beyond the five newest of each site: their details may go."""
    return expired(runs(spark, sf_dir), "site_id", "started_at", 5, "crawl_run_id").select("site_id", "crawl_run_id")


def u1_problem_urls(spark, sf_dir):
    """URLs with a problem and where it was seen: crawl errors, thin pages, slow pages."""
    v = view(spark, sf_dir)
    return union_tagged({"error": v.filter("status_code >= 400"), "thin": v.filter("html200 AND word_count < 150"), "slow": v.filter("response_time_ms > 1000")}, "url")


def u3_lost_types(spark, sf_dir):
    """Structured-data types that pages of a run have lost against its base."""
    v = view(spark, sf_dir)
    pair = runs(spark, sf_dir).filter("base_run_id IS NOT NULL").select(F.col("crawl_run_id").alias("run"), "base_run_id")
    now = v.join(pair, v["crawl_run_id"] == pair["run"]).select("run", "url", "base_run_id", F.col("schema_types").alias("a"))
    old = v.select(F.col("crawl_run_id").alias("base_run_id"), "url", F.col("schema_types").alias("b"))
    lost = now.join(old, ["base_run_id", "url"]).select("run", F.explode(F.array_except("b", F.coalesce("a", F.array().cast("array<string>")))).alias("type"))
    return lost.groupBy(F.col("run").alias("crawl_run_id"), "type").agg(F.count("*").alias("urls"))


def f4_url_parts(spark, sf_dir):
    """Parts and keys of all page addresses."""
    urls = table(spark, sf_dir, "crawled_page").select("url").distinct()
    p = parts(F.col("url"))
    return urls.select("url", p["host"].alias("host"), p["path"].alias("path"), p["query"].alias("query"), url_key(F.col("url")).alias("key"), first_folder(path_of(F.col("url"))).alias("folder"), domain_of(F.col("url")).alias("domain"))


def j18_site_hosts(spark, sf_dir):
    """Pages of the two hosts named, and of all hosts below them, joined on the endings of each domain."""
    own = spark.createDataFrame([("olmeda-tienda.example",), ("example",)], "host string")
    urls = table(spark, sf_dir, "crawled_page").select("url").distinct().select(F.explode(endings(domain_of(F.col("url")))).alias("host"))
    return urls.join(own, "host").groupBy("host").agg(F.count("*").alias("urls"))


_V = """WITH v AS (
  SELECT *, (coalesce(final_url <> url, false) OR status_code BETWEEN 300 AND 399) AS redirected, status_code = 200 AND NOT (coalesce(final_url <> url, false) OR status_code BETWEEN 300 AND 399) AS html200
  FROM (SELECT *, row_number() OVER (PARTITION BY crawl_run_id, url ORDER BY fetched_at DESC) AS rn FROM crawled_page) WHERE rn = 1)
"""
_PATH = "(CASE WHEN regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1) = '' THEN '/' ELSE regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1) END)"
_HOST = "regexp_extract({}, '^https?://([^/?#]*)', 1)"
_EMPTY = "trim(coalesce({}, '')) = ''"
_RULES = {
    "HTTP_4XX": ("HIGH", "status_code BETWEEN 400 AND 499"), "HTTP_5XX": ("CRITICAL", "status_code >= 500"), "FETCH_FAILED": ("MEDIUM", "status_code = 0 AND NOT blocked_by_robots"),
    "INTERNAL_LINKS_TO_REDIRECTS": ("LOW", "redirected AND inlinks > 0"), "ROBOTS_BLOCKED": ("INFO", "blocked_by_robots"), "NOINDEX": ("INFO", "indexability_reason = 'noindex'"),
    "CANONICAL_MISSING": ("MEDIUM", f"html200 AND {_EMPTY.format('canonical')} AND coalesce(indexability_reason, '') <> 'noindex'"), "CANONICAL_CROSS_HOST": ("HIGH", f"html200 AND {_HOST.format('canonical')} <> {_HOST.format('url')}"),
    "PARAMETER_URLS_INDEXABLE": ("MEDIUM", "is_indexable AND html200 AND contains(url, '?')"), "TITLE_MISSING": ("HIGH", f"is_indexable AND html200 AND {_EMPTY.format('title')}"),
    "TITLE_TOO_SHORT": ("LOW", f"is_indexable AND html200 AND NOT {_EMPTY.format('title')} AND length(title) < 30"), "TITLE_TOO_LONG": ("LOW", "is_indexable AND html200 AND length(title) > 60"),
    "H1_MISSING": ("MEDIUM", f"is_indexable AND html200 AND {_EMPTY.format('h1')}"), "CONTENT_THIN": ("MEDIUM", "is_indexable AND html200 AND word_count < 150"),
    "SCHEMA_MISSING": ("INFO", "is_indexable AND html200 AND coalesce(len(schema_types), 0) = 0"), "SLOW_RESPONSE": ("MEDIUM", "html200 AND response_time_ms > 1000"),
}
_AUDIT = _V + ", hit AS (" + " UNION ALL ".join(f"SELECT crawl_run_id, '{c}' AS code, '{s}' AS severity, url FROM v WHERE {p}" for c, (s, p) in _RULES.items()) + f""" UNION ALL
  SELECT crawl_run_id, 'TITLE_DUPLICATE', 'MEDIUM', url FROM (SELECT crawl_run_id, url, count(*) OVER (PARTITION BY crawl_run_id, lower(trim(title))) AS n FROM v WHERE is_indexable AND html200 AND NOT {_EMPTY.format('title')}) WHERE n > 1),
issue AS (SELECT crawl_run_id, code, severity, count(*) AS urls FROM hit GROUP BY ALL)
"""
_DIFF = _V + """, pair AS (SELECT DISTINCT crawl_run_id AS run, base_run_id AS base, run_status = 'completed' AS done FROM crawl_run WHERE base_run_id IS NOT NULL),
a AS (SELECT pair.run, pair.done, v.* FROM v JOIN pair ON v.crawl_run_id = pair.run), b AS (SELECT pair.run, pair.done, v.* FROM v JOIN pair ON v.crawl_run_id = pair.base),
x AS (SELECT coalesce(a.run, b.run) AS run, coalesce(a.url, b.url) AS url, coalesce(a.done, b.done) AS done, a.run IS NULL AS gone, b.run IS NULL AS fresh,
  a.status_code AS s1, b.status_code AS s0, a.blocked_by_robots AS r1, b.blocked_by_robots AS r0, a.is_indexable AS i1, b.is_indexable AS i0, a.indexability_reason AS why, a.redirected AS d1, b.redirected AS d0,
  coalesce(a.final_url, '') <> coalesce(b.final_url, '') AS target, coalesce(a.title, '') <> coalesce(b.title, '') AS title, coalesce(a.canonical, '') <> coalesce(b.canonical, '') AS canon, coalesce(a.h1, '') <> coalesce(b.h1, '') AS h1,
  a.word_count AS w1, b.word_count AS w0, list_filter(coalesce(b.schema_types, []), lambda t: NOT list_contains(coalesce(a.schema_types, []), t)) AS lost FROM a FULL JOIN b ON a.run = b.run AND a.url = b.url),
f AS (SELECT *, s0 BETWEEN 200 AND 399 AS ok0, s1 BETWEEN 200 AND 399 AS ok1, s0 <> s1 AND NOT (r1 AND NOT r0) AS moved, s0 = 200 AND s1 = 200 AND NOT d0 AND NOT d1 AS plain FROM x WHERE NOT gone AND NOT fresh),
change AS (
  SELECT run, url, 'PAGE_ADDED' AS change FROM x WHERE fresh UNION ALL SELECT run, url, 'PAGE_REMOVED' FROM x WHERE gone AND done
  UNION ALL SELECT run, url, CASE WHEN ok0 AND NOT ok1 AND NOT r1 THEN 'PAGE_BROKEN' WHEN NOT ok0 AND ok1 THEN 'PAGE_RECOVERED' ELSE 'STATUS_CHANGED' END FROM f WHERE moved
  UNION ALL SELECT run, url, 'ROBOTS_BLOCKED_NEW' FROM f WHERE NOT r0 AND r1
  UNION ALL SELECT run, url, CASE WHEN why = 'noindex' THEN 'NOINDEX_ADDED' ELSE 'BECAME_NON_INDEXABLE' END FROM f WHERE i0 AND NOT i1 AND ok1 AND NOT r1
  UNION ALL SELECT run, url, 'BECAME_INDEXABLE' FROM f WHERE NOT i0 AND i1
  UNION ALL SELECT run, url, CASE WHEN NOT d0 THEN 'REDIRECT_ADDED' WHEN NOT d1 THEN 'REDIRECT_REMOVED' ELSE 'REDIRECT_TARGET_CHANGED' END FROM f WHERE d0 <> d1 OR (d0 AND d1 AND target)
  UNION ALL SELECT run, url, 'CANONICAL_CHANGED' FROM f WHERE plain AND canon UNION ALL SELECT run, url, 'TITLE_CHANGED' FROM f WHERE plain AND title UNION ALL SELECT run, url, 'H1_CHANGED' FROM f WHERE plain AND h1
  UNION ALL SELECT run, url, 'CONTENT_SHRUNK' FROM f WHERE plain AND w0 >= 150 AND w1 < w0 * 0.5 UNION ALL SELECT run, url, 'SCHEMA_REMOVED' FROM f WHERE plain AND len(lost) > 0),
counted AS (SELECT run AS crawl_run_id, change, count(*) AS urls FROM change GROUP BY ALL)
"""
_ALERTS = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in crawl.ALERTS.items())
_FILTERS = {
    "internal_all": "true", "internal_html": "html200", "internal_indexable": "is_indexable", "internal_non_indexable": "NOT is_indexable", "response_blocked": "blocked_by_robots", "response_none": "status_code = 0",
    "response_2xx": "status_code BETWEEN 200 AND 299", "response_3xx": "status_code BETWEEN 300 AND 399", "response_4xx": "status_code BETWEEN 400 AND 499", "response_5xx": "status_code >= 500",
    "uri_non_ascii": "html200 AND regexp_matches(url, '[^\\x00-\\x7F]')", "uri_underscores": "html200 AND contains(url, '_')", "uri_uppercase": "html200 AND regexp_matches(regexp_replace(url, '^https?://[^/]*', ''), '[A-Z]')", "uri_parameters": "html200 AND contains(url, '?')", "uri_over_115": "html200 AND length(url) > 115", "uri_multiple_slashes": "html200 AND contains(regexp_replace(url, '^https?://', ''), '//')",
    "titles_missing": f"html200 AND {_EMPTY.format('title')}", "titles_over_60": "html200 AND length(title) > 60", "titles_below_30": f"html200 AND NOT {_EMPTY.format('title')} AND length(title) < 30", "titles_same_as_h1": f"html200 AND NOT {_EMPTY.format('title')} AND lower(trim(title)) = lower(trim(h1))",
    "h1_missing": f"html200 AND {_EMPTY.format('h1')}", "h1_over_70": "html200 AND length(h1) > 70", "canonicals_self": "html200 AND canonical = url", "canonicals_other": "html200 AND canonical <> url", "canonicals_missing": f"html200 AND {_EMPTY.format('canonical')}",
    "structured_present": "html200 AND len(schema_types) > 0", "structured_missing": "html200 AND coalesce(len(schema_types), 0) = 0", "links_no_inlinks": "html200 AND inlinks = 0", "content_thin": "html200 AND word_count < 150",
}
_FOLDERS = f"""{_V}, p AS (SELECT *, {_PATH} AS path FROM v), s AS (SELECT *, list_filter(string_split(path, '/'), lambda y: y <> '') AS segs FROM p),
q AS (SELECT *, CASE WHEN path LIKE '%/' THEN segs ELSE segs[1:greatest(len(segs) - 1, 0)] END AS dirs FROM s),
t AS (SELECT *, unnest(range(len(dirs) + 1)) AS k FROM q), z AS (SELECT *, {_HOST.format('url')} AS host, CASE WHEN k = 0 THEN '/' ELSE '/' || array_to_string(dirs[1:k], '/') || '/' END AS folder FROM t)
"""
_KEYED = "WITH d AS (SELECT DISTINCT site_id, crawl_run_id, started_at, run_status, crawl_mode FROM crawl_run)\n"

QUERIES = {f.__name__: f for f in (
    r4_issue_counts, r4_all_rules, r6_tab_counts, t3_worst_issues, r27_run_news, w13_recent_groups, j1_pages_with_hits, r5_issue_states, f12_priorities, c8_indexability, r6_explorer_counts, r7_explorer_rows, r9_custom_search, r10_structure, r10_folder_totals, r11_differences, r12_alerts, a14_duplicate_titles,
    j4_seen_in_logs, j11_previous_run, j12_reference_run, w1_latest_pages, w2_last_runs, k9_expired_runs, u1_problem_urls, u3_lost_types, f4_url_parts, j18_site_hosts,
)}
_WIDE = _V.replace("WITH v AS (", "WITH v0 AS (") + """, v AS (SELECT *, CASE WHEN indexability_reason = 'noindex' THEN 'noindex' END AS robots, NOT contains(url, '?') AND status_code <> 404 AS listed, len(list_filter(regexp_split_to_array(regexp_replace(url, '^https?://[^/]*/?', ''), '[/?]'), lambda x: x <> '')) AS depth FROM v0)
"""
_OK = "html200 AND is_indexable"
_ALL_RULES = {
    **{k: v for k, v in _RULES.items() if k not in ("FETCH_FAILED", "ROBOTS_BLOCKED", "NOINDEX", "CANONICAL_MISSING", "SCHEMA_MISSING")},
    "FETCH_FAILED": ("MEDIUM", "status_code = 0 AND NOT blocked_by_robots"), "ROBOTS_BLOCKED": ("INFO", "blocked_by_robots AND NOT listed"), "NOINDEX": ("INFO", "html200 AND robots IS NOT NULL AND NOT listed"), "CANONICAL_MISSING": ("MEDIUM", f"html200 AND {_EMPTY.format('canonical')} AND robots IS NULL"),
    "SITEMAP_NON_INDEXABLE": ("HIGH", f"listed AND NOT ({_OK}) AND robots IS NULL"), "INDEXABLE_NOT_IN_SITEMAP": ("LOW", f"{_OK} AND NOT listed"), "SITEMAP_ORPHAN": ("MEDIUM", "html200 AND listed AND inlinks = 0 AND depth > 0"), "DEPTH_EXCESSIVE": ("LOW", f"{_OK} AND depth > 4"),
}
_ALL = _WIDE + ", hit AS (" + " UNION ALL ".join(f"SELECT crawl_run_id, '{c}' AS code, '{s}' AS severity, url FROM v WHERE {p}" for c, (s, p) in _ALL_RULES.items()) + f""" UNION ALL
  SELECT crawl_run_id, 'TITLE_DUPLICATE', 'MEDIUM', url FROM (SELECT crawl_run_id, url, count(*) OVER (PARTITION BY crawl_run_id, lower(trim(title))) AS n FROM v WHERE {_OK} AND NOT {_EMPTY.format('title')}) WHERE n > 1 UNION ALL
  SELECT v.crawl_run_id, 'CANONICAL_TO_NON_INDEXABLE', 'HIGH', v.url FROM v JOIN v t ON t.crawl_run_id = v.crawl_run_id AND t.url = v.canonical WHERE v.html200 AND v.canonical <> v.url AND NOT (t.is_indexable AND t.html200))
"""
_TAB_SQL = {
    "internal.all": "true", "internal.html": "html200", "internal.other": "NOT html200", "internal.indexable": "is_indexable", "internal.non_indexable": "NOT is_indexable", "response.all": "true", "response.blocked": "blocked_by_robots", "response.no_response": "status_code = 0 AND NOT blocked_by_robots", "response.2xx": "status_code BETWEEN 200 AND 299 AND NOT redirected",
    "response.3xx": "redirected", "response.4xx": "status_code BETWEEN 400 AND 499", "response.5xx": "status_code >= 500", "uri.non_ascii": "html200 AND regexp_matches(url, '[^\\x00-\\x7F]|%[89A-Fa-f][0-9A-Fa-f]')", **{f"uri.{k}": _FILTERS[f"uri_{k}"] for k in ("underscores", "uppercase", "parameters", "over_115", "multiple_slashes")},
    **{f"titles.{k}": _FILTERS[f"titles_{k}"] for k in ("missing", "over_60", "below_30", "same_as_h1")}, "h1.missing": _FILTERS["h1_missing"], "h1.over_70": _FILTERS["h1_over_70"], "canonicals.self": _FILTERS["canonicals_self"], "canonicals.canonicalised": _FILTERS["canonicals_other"], "canonicals.missing": _FILTERS["canonicals_missing"],
    "canonicals.cross_host": f"html200 AND {_HOST.format('canonical')} <> {_HOST.format('url')}", "directives.all": "true", "directives.noindex": "robots IS NOT NULL", "directives.nofollow": "false", "directives.x_robots": "false", "directives.blocked": "blocked_by_robots", "structured.contains": _FILTERS["structured_present"], "structured.missing": _FILTERS["structured_missing"],
    "links.no_inlinks": "html200 AND inlinks = 0 AND depth > 0", "links.deep": "html200 AND depth > 4", **{f"{t}.all": "html200" for t in ("uri", "titles", "meta", "keywords", "h1", "h2", "canonicals", "hreflang", "structured", "social", "links", "pagination", "search")},
}
_TABS = _WIDE + " UNION ALL ".join(f"SELECT '{n}' AS filter, count(*) FILTER (WHERE {p}) AS rows FROM v" for n, p in _TAB_SQL.items()) + "".join(
    f" UNION ALL SELECT '{t}.duplicate', count(*) FILTER (WHERE n > 1) FROM (SELECT count(*) OVER (PARTITION BY crawl_run_id, lower(trim({c}))) AS n FROM v WHERE html200 AND NOT {_EMPTY.format(c)})" for t, c in (("titles", "title"), ("h1", "h1"))
)
_NEWS = (
    _V + ", s AS (SELECT crawl_run_id, count(*) FILTER (WHERE is_indexable) AS ok, count(*) FILTER (WHERE status_code BETWEEN 400 AND 499) AS e4, count(*) FILTER (WHERE status_code >= 500) AS e5, round(avg(response_time_ms) FILTER (WHERE status_code = 200)) AS ms FROM v GROUP BY 1), "
    "d AS (SELECT DISTINCT site_id, crawl_run_id, started_at FROM crawl_run WHERE run_status = 'completed' AND crawl_mode <> 'list'), r AS (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY started_at DESC) AS n FROM d JOIN s USING (crawl_run_id)), j AS (SELECT a.site_id, a.ok AS ok1, b.ok AS ok0, a.e4 AS f1, b.e4 AS f0, a.e5 AS g1, b.e5 AS g0, a.ms AS m1, b.ms AS m0 FROM r a JOIN r b ON a.site_id = b.site_id AND a.n = 1 AND b.n = 2) "
    "SELECT 'crawl' AS area, insight, tone, site_id AS subject, CAST(before AS DOUBLE) AS before, CAST(after AS DOUBLE) AS after FROM (SELECT site_id, 'indexable_lost' AS insight, 'bad' AS tone, ok0 AS before, ok1 AS after FROM j WHERE ok0 - ok1 >= greatest(5, ok0 * 0.05) UNION ALL SELECT site_id, 'indexable_gained', 'info', ok0, ok1 FROM j WHERE ok1 - ok0 >= greatest(5, ok0 * 0.05) UNION ALL SELECT site_id, 'server_errors', 'bad', g0, g1 FROM j WHERE g1 > g0 "
    "UNION ALL SELECT site_id, 'client_errors', 'warn', f0, f1 FROM j WHERE f1 - f0 >= 3 UNION ALL SELECT site_id, 'client_errors_fixed', 'good', f0, f1 FROM j WHERE f0 - f1 >= 3 UNION ALL SELECT site_id, 'slower', 'warn', m0, m1 FROM j WHERE m0 > 0 AND m1 > 300 AND (m1 - m0) / m0 >= 0.5)"
)
_KEY = "('https://' || {host} || CASE WHEN split_part({path}, '?', 1) IN ('', '/') THEN '/' ELSE regexp_replace(split_part({path}, '?', 1), '/+$', '') END || CASE WHEN contains({path}, '?') THEN '?' || split_part({path}, '?', 2) ELSE '' END)"
SQL = {
    "r4_all_rules": _ALL + "SELECT code, severity, count(*) AS urls FROM hit GROUP BY 1, 2",
    "r6_tab_counts": _TABS,
    "t3_worst_issues": _ALL + "SELECT * FROM (SELECT crawl_run_id, code, severity, count(*) AS urls FROM hit GROUP BY ALL) ORDER BY CASE severity WHEN 'CRITICAL' THEN 0 WHEN 'HIGH' THEN 1 WHEN 'MEDIUM' THEN 2 WHEN 'LOW' THEN 3 ELSE 4 END, urls DESC, code, crawl_run_id LIMIT 50",
    "r27_run_news": _NEWS,
    "w13_recent_groups": "WITH d AS (SELECT DISTINCT site_id, crawl_run_id, started_at FROM crawl_run) SELECT site_id, crawl_run_id, max(started_at) OVER (PARTITION BY site_id) AS newest FROM d",
    "j1_pages_with_hits": f"WITH p AS (SELECT DISTINCT crawl_run_id, url, {_HOST.format('url')} AS host, regexp_extract(url, '^https?://[^/?#]*(.*)$', 1) AS path FROM crawled_page), u AS (SELECT DISTINCT url, host, {_KEY.format(host='host', path='path')} AS k FROM p), s AS (SELECT DISTINCT site_id, host FROM p JOIN crawl_run USING (crawl_run_id)), h AS (SELECT {_KEY.format(host='host', path='path')} AS k, count(*) AS hits FROM (SELECT DISTINCT log_id, site_id, path FROM log_entry WHERE is_bot) JOIN s USING (site_id) GROUP BY 1) SELECT host, count(*) AS urls, CAST(sum(coalesce(hits, 0)) AS BIGINT) AS hits FROM u LEFT JOIN h USING (k) GROUP BY 1",
    "r4_issue_counts": _AUDIT + "SELECT * FROM issue",
    "r5_issue_states": _AUDIT + ", pair AS (SELECT DISTINCT crawl_run_id AS run, base_run_id AS base FROM crawl_run WHERE base_run_id IS NOT NULL), n AS (SELECT run || ':' || code AS issue FROM pair JOIN issue ON crawl_run_id = run), o AS (SELECT run || ':' || code AS issue FROM pair JOIN issue ON crawl_run_id = base) SELECT coalesce(n.issue, o.issue) AS issue, CASE WHEN o.issue IS NULL THEN 'new' WHEN n.issue IS NULL THEN 'resolved' ELSE 'open' END AS state FROM n FULL JOIN o ON n.issue = o.issue",
    "f12_priorities": _AUDIT + "SELECT crawl_run_id, code, floor(5 * 0.9 * least(log10(greatest(urls, 1)) + 1, 5) * CASE severity WHEN 'CRITICAL' THEN 2.0 WHEN 'HIGH' THEN 1.5 WHEN 'MEDIUM' THEN 1.0 WHEN 'LOW' THEN 0.6 ELSE 0.3 END / 2.0 * 10 + 0.5) / 10 AS priority FROM issue",
    "c8_indexability": _V + ", i AS (SELECT CASE WHEN blocked_by_robots THEN 'blocked' WHEN status_code = 0 THEN 'no response' WHEN redirected THEN 'redirect' WHEN status_code <> 200 THEN 'status ' || status_code WHEN indexability_reason = 'noindex' THEN 'noindex' WHEN coalesce(canonical, url) <> url THEN 'canonicalised' END AS reason FROM v) SELECT reason IS NULL AS indexable, reason, count(*) AS pages FROM i GROUP BY 1, 2",
    "r6_explorer_counts": _V + " UNION ALL ".join(f"SELECT crawl_run_id, '{n}' AS filter, count(*) FILTER (WHERE {p}) AS pages FROM v GROUP BY 1" for n, p in _FILTERS.items()),
    "r7_explorer_rows": _V + "SELECT crawl_run_id, url, response_time_ms, title FROM v WHERE html200 AND length(title) > 60 ORDER BY response_time_ms DESC NULLS LAST, crawl_run_id, url LIMIT 500",
    "r9_custom_search": _V + "SELECT crawl_run_id, url, CAST(len(regexp_extract_all(title, '[aeiou]n')) AS INTEGER) AS hits FROM v WHERE regexp_matches(title, '[aeiou]n')",
    "r10_structure": _FOLDERS + "SELECT host, folder, count(*) AS pages, count(*) FILTER (WHERE status_code >= 400) AS errors, round(avg(word_count), 4) AS mean_words FROM z GROUP BY 1, 2",
    "r10_folder_totals": _FOLDERS + "SELECT folder, count(*) AS pages, CAST(sum(inlinks) AS BIGINT) AS inlinks FROM z GROUP BY 1",
    "r11_differences": _DIFF + "SELECT * FROM counted",
    "r12_alerts": _DIFF + f", size AS (SELECT crawl_run_id, count(*) AS pages FROM v GROUP BY 1) SELECT crawl_run_id, change AS alert, CASE change {_ALERTS} END AS severity, urls FROM counted WHERE CASE change {_ALERTS} END IS NOT NULL UNION ALL SELECT crawl_run_id, 'MASS_TITLE_CHANGE', 'MEDIUM', urls FROM counted JOIN size USING (crawl_run_id) WHERE change = 'TITLE_CHANGED' AND pages >= 10 AND urls >= 0.2 * pages",
    "a14_duplicate_titles": _V + "SELECT crawl_run_id, lower(trim(title)) AS title, count(*) AS urls FROM v WHERE html200 AND trim(coalesce(title, '')) <> '' GROUP BY 1, 2 HAVING count(*) > 1",
    "j4_seen_in_logs": f"WITH k AS (SELECT DISTINCT r.site_id, {_PATH} || regexp_extract(url, '(\\?[^#]*)', 1) AS path FROM crawled_page JOIN crawl_run r USING (crawl_run_id)), l AS (SELECT DISTINCT site_id, path FROM log_entry) SELECT k.site_id, count(*) AS pages, count(l.path) AS in_logs FROM k LEFT JOIN l ON k.site_id = l.site_id AND k.path = l.path GROUP BY 1",
    "j11_previous_run": _KEYED + "SELECT crawl_run_id, lag(crawl_run_id) OVER w AS previous_crawl_run_id, lag(started_at) OVER w AS previous_started_at FROM d WHERE run_status = 'completed' AND crawl_mode = 'site' WINDOW w AS (PARTITION BY site_id ORDER BY started_at, crawl_run_id)",
    "j12_reference_run": _KEYED + ", y AS (SELECT DISTINCT site_id, CAST(started_at AS DATE) AS day FROM d WHERE run_status = 'completed'), m AS (SELECT site_id, max(day) AS last, min(day) AS first FROM y GROUP BY 1) SELECT m.site_id, m.last AS last_day, coalesce(max(y.day) FILTER (WHERE m.last - y.day >= 21), CASE WHEN m.first < m.last THEN m.first END) AS reference_day FROM m JOIN y USING (site_id) GROUP BY m.site_id, m.last, m.first",
    "w1_latest_pages": "SELECT status_code, count(*) AS urls FROM (SELECT status_code, row_number() OVER (PARTITION BY url ORDER BY fetched_at DESC, crawl_run_id DESC, status_code DESC) AS rn FROM crawled_page) WHERE rn = 1 GROUP BY 1",
    "w2_last_runs": _KEYED + "SELECT site_id, crawl_run_id FROM (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY started_at DESC, crawl_run_id DESC) AS rn FROM d) WHERE rn <= 3",
    "k9_expired_runs": _KEYED + "SELECT site_id, crawl_run_id FROM (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY started_at DESC, crawl_run_id DESC) AS rn FROM d) WHERE rn > 5",
    "u1_problem_urls": _V + "SELECT url, list_sort(list(DISTINCT source)) AS sources FROM (SELECT url, 'error' AS source FROM v WHERE status_code >= 400 UNION SELECT url, 'thin' FROM v WHERE html200 AND word_count < 150 UNION SELECT url, 'slow' FROM v WHERE response_time_ms > 1000) GROUP BY 1",
    "u3_lost_types": _V + ", p AS (SELECT DISTINCT crawl_run_id AS run, base_run_id AS base FROM crawl_run WHERE base_run_id IS NOT NULL), t AS (SELECT run, unnest(list_distinct(list_filter(b.schema_types, lambda y: NOT list_contains(coalesce(a.schema_types, []), y)))) AS type FROM p JOIN v a ON a.crawl_run_id = run JOIN v b ON b.crawl_run_id = base AND b.url = a.url) SELECT run AS crawl_run_id, type, count(*) AS urls FROM t GROUP BY 1, 2",
    "f4_url_parts": f"WITH u AS (SELECT DISTINCT url, {_HOST.format('url')} AS host, regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(url, '\\?([^#]*)', 1) AS query FROM crawled_page) SELECT url, host, path, query, 'https://' || host || CASE WHEN path IN ('', '/') THEN '/' ELSE regexp_replace(path, '/+$', '') END || CASE WHEN contains(url, '?') THEN '?' || query ELSE '' END AS key, CASE WHEN regexp_matches(path, '^/*[^/]+/+[^/]') THEN '/' || regexp_extract(path, '^/*([^/]+)', 1) || '/' ELSE '/' END AS folder, host AS domain FROM u",
    "j18_site_hosts": f"WITH u AS (SELECT DISTINCT url, {_HOST.format('url')} AS domain FROM crawled_page), h AS (SELECT unnest(['olmeda-tienda.example', 'example']) AS host) SELECT host, count(*) AS urls FROM u JOIN h ON domain = host OR ends_with(domain, '.' || host) GROUP BY 1",
}
