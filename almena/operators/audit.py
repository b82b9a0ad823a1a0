"""All audit rules and explorer tabs over crawled pages, each as a predicate that is left out where its columns are missing.

Pages come as one row per run and URL (``crawl.page_view``). Columns that rules ask for
beyond those of the plain crawl table: mime, meta_description, canonical, robots_meta,
x_robots_tag, h1_count, h2, lang, hreflang, schema_errors, redirect_chain, error,
content_hash, outlinks, images, images_missing_alt, in_sitemap, depth, title_count,
meta_description_count, meta_keywords, og, twitter, rel_next, rel_prev; clicks,
impressions, position, in_logs; raw_title, raw_h1, raw_canonical, raw_robots_meta,
raw_word_count, js_only_links, js_errors, js_error.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from almena.functions.url import host_of
from almena.functions.web import KINDS

_KNOWN = frozenset(
    "url final_url status_code response_time_ms mime title meta_description canonical robots_meta x_robots_tag h1 h1_count h2 lang hreflang schema_types schema_errors redirect_chain error content_hash inlinks outlinks images "
    "images_missing_alt blocked_by_robots in_sitemap in_logs is_indexable indexability_reason word_count depth title_count meta_description_count meta_keywords og twitter rel_next rel_prev redirected html200 "
    "clicks impressions position raw_title raw_h1 raw_canonical raw_robots_meta raw_word_count js_only_links js_errors js_error production limit_reached robots_found robots_sitemap http_redirects host_redirects "
    "kind internal is_link content_type size_bytes src alt width height".split()
)
_EMPTY = "trim(coalesce({}, '')) = ''"
_NOINDEX = "(coalesce(concat_ws(',', robots_meta, x_robots_tag), '') RLIKE '(?i)noindex|none')"
_CHAIN = "size(coalesce(redirect_chain, array()))"
_LOOP = "coalesce(error, '') = 'Redirect loop'"
_OK = "html200 AND is_indexable"
_CODE = r"^(x-default|[A-Za-z]{2,3}(-[A-Za-z0-9]{2,8})*)$"


def _same(column: str, among: str, lower: bool = True) -> str:
    value = f"lower(trim({column}))" if lower else column
    return f"({among}) AND NOT ({_EMPTY.format(column)}) AND count(CASE WHEN ({among}) AND NOT ({_EMPTY.format(column)}) THEN 1 END) OVER (PARTITION BY crawl_run_id, {value}) > 1"


_HREFLANG = f"size(hreflang) > 0 AND (exists(hreflang, h -> NOT h.lang RLIKE '{_CODE}' OR trim(coalesce(h.href, '')) = '') OR NOT exists(hreflang, h -> h.href = url))"
# Rules by code with severity and what they hit.
RULES: dict[str, tuple[str, str]] = {
    "HTTP_4XX": ("HIGH", "status_code BETWEEN 400 AND 499"),
    "HTTP_5XX": ("CRITICAL", "status_code >= 500"),
    "FETCH_FAILED": ("MEDIUM", f"status_code = 0 AND NOT blocked_by_robots AND NOT ({_LOOP})"),
    "REDIRECT_LOOP": ("CRITICAL", _LOOP),
    "REDIRECT_CHAIN": ("MEDIUM", f"{_CHAIN} >= 2 AND NOT ({_LOOP})"),
    "INTERNAL_LINKS_TO_REDIRECTS": ("LOW", "redirected AND inlinks > 0"),
    "ROBOTS_BLOCKED": ("INFO", "blocked_by_robots AND NOT coalesce(in_sitemap, false)"),
    "NOINDEX_IN_SITEMAP": ("CRITICAL", f"html200 AND {_NOINDEX} AND in_sitemap AND production"),
    "NOINDEX_IN_SITEMAP_STAGING": ("MEDIUM", f"html200 AND {_NOINDEX} AND in_sitemap AND NOT production"),
    "NOINDEX": ("INFO", f"html200 AND {_NOINDEX} AND NOT in_sitemap"),
    "SITEMAP_NON_INDEXABLE": ("HIGH", f"in_sitemap AND NOT ({_OK}) AND NOT {_NOINDEX}"),
    "INDEXABLE_NOT_IN_SITEMAP": ("LOW", f"{_OK} AND NOT in_sitemap"),
    "SITEMAP_ORPHAN": ("MEDIUM", "html200 AND in_sitemap AND inlinks = 0 AND depth > 0"),
    "CANONICAL_MISSING": ("MEDIUM", f"html200 AND {_EMPTY.format('canonical')} AND NOT {_NOINDEX}"),
    "CANONICAL_CROSS_HOST": ("HIGH", "html200 AND regexp_extract(canonical, '^https?://([^/?#]*)', 1) <> '' AND lower(regexp_extract(canonical, '^https?://([^/?#]*)', 1)) <> lower(regexp_extract(url, '^https?://([^/?#]*)', 1))"),
    "PARAMETER_URLS_INDEXABLE": ("MEDIUM", f"{_OK} AND contains(url, '?')"),
    "TITLE_MISSING": ("HIGH", f"{_OK} AND {_EMPTY.format('title')}"),
    "TITLE_TOO_SHORT": ("LOW", f"{_OK} AND NOT ({_EMPTY.format('title')}) AND length(title) < 30"),
    "TITLE_TOO_LONG": ("LOW", f"{_OK} AND length(title) > 60"),
    "TITLE_DUPLICATE": ("MEDIUM", _same("title", _OK)),
    "META_DESCRIPTION_MISSING": ("LOW", f"{_OK} AND {_EMPTY.format('meta_description')}"),
    "META_DESCRIPTION_DUPLICATE": ("LOW", _same("meta_description", _OK)),
    "H1_MISSING": ("MEDIUM", f"{_OK} AND {_EMPTY.format('h1')}"),
    "H1_MULTIPLE": ("INFO", f"{_OK} AND h1_count > 1"),
    "LANG_MISSING": ("LOW", f"{_OK} AND {_EMPTY.format('lang')}"),
    "HREFLANG_INVALID": ("MEDIUM", f"{_OK} AND {_HREFLANG}"),
    "CONTENT_THIN": ("MEDIUM", f"{_OK} AND word_count < 150"),
    "CONTENT_DUPLICATE": ("HIGH", _same("content_hash", _OK, False)),
    "DEPTH_EXCESSIVE": ("LOW", f"{_OK} AND depth > 4"),
    "IMAGES_MISSING_ALT": ("LOW", "html200 AND images_missing_alt > 0"),
    "SCHEMA_INVALID_JSON": ("HIGH", "html200 AND schema_errors > 0"),
    "SCHEMA_MISSING": ("INFO", f"{_OK} AND size(coalesce(schema_types, array())) = 0 AND coalesce(schema_errors, 0) = 0"),
    "SLOW_RESPONSE": ("MEDIUM", "html200 AND response_time_ms > 1000"),
}
# Rules of a whole run, by its context; they hit its start page.
RUN_RULES: dict[str, tuple[str, str]] = {
    "ROBOTS_MISSING": ("LOW", "NOT robots_found"), "ROBOTS_NO_SITEMAP": ("INFO", "robots_found AND NOT robots_sitemap"),
    "HTTP_NOT_REDIRECTED_TO_HTTPS": ("HIGH", "NOT http_redirects"), "HOST_VARIANT_NOT_REDIRECTED": ("HIGH", "NOT host_redirects"),
}
#: How sure a rule is of a hit; less where a crawl that ended early may not have seen the links.
CONFIDENCE, LESS_SURE = 0.9, 0.5
_MERGED = {"NOINDEX_IN_SITEMAP_STAGING": "NOINDEX_IN_SITEMAP"}


def possible(expression: str, columns: list[str]) -> bool:
    """Whether all columns an expression names are there."""
    bare = re.sub(r"'[^']*'", "", expression)
    return not (set(re.findall(r"(?<![.\w])[a-z_0-9]+\b(?!\s*\()", bare)) & _KNOWN) - set(columns)


def audit_pages(view: DataFrame, links: DataFrame | None = None, context: DataFrame | None = None) -> DataFrame:
    """Pages hit by each rule whose columns are there: crawl_run_id, code, severity, confidence, url; once each.

    ``links`` holds crawl_run_id, source_url, target_url. ``context`` has a row per run:
    crawl_run_id, start_url and any of production, limit_reached, robots_found,
    robots_sitemap, http_redirects, host_redirects (null: not known, no hit).
    """
    if context is not None:
        own = [c for c in context.columns if c not in ("crawl_run_id", "start_url")]
        view = view.join(F.broadcast(context.select("crawl_run_id", *own)), "crawl_run_id", "left")
    sure = F.when((F.col("code") == "SITEMAP_ORPHAN") & F.coalesce(F.col("limit_reached"), F.lit(False)), LESS_SURE).otherwise(CONFIDENCE) if "limit_reached" in view.columns else F.lit(CONFIDENCE)
    hits = [
        F.when(F.coalesce(F.expr(p), F.lit(False)), F.struct(F.lit(_MERGED.get(code, code)).alias("code"), F.lit(severity).alias("severity")))
        for code, (severity, p) in RULES.items() if possible(p, view.columns)
    ]
    marked = view.withColumn("_hits", F.array_compact(F.array(*hits)))
    extra = ["limit_reached"] if "limit_reached" in view.columns else []
    flat = marked.select("crawl_run_id", "url", *extra, F.explode("_hits").alias("_h")).select("crawl_run_id", "_h.code", "_h.severity", "url", *extra)
    found = [flat.select("crawl_run_id", "code", "severity", sure.alias("confidence"), "url")]
    more = lambda rows, code, severity: rows.select("crawl_run_id", F.lit(code).alias("code"), F.lit(severity).alias("severity"), F.lit(CONFIDENCE).alias("confidence"), "url")
    if "canonical" in view.columns:
        target = view.select("crawl_run_id", F.col("url").alias("canonical"), F.expr("is_indexable AND html200").alias("_ok"))
        aside = view.filter("html200 AND canonical <> url").join(target, ["crawl_run_id", "canonical"])
        found.append(more(aside.filter(~F.coalesce("_ok", F.lit(False))), "CANONICAL_TO_NON_INDEXABLE", "HIGH"))
    if links is not None:
        bad = view.filter("status_code >= 400").select("crawl_run_id", F.col("url").alias("target_url"))
        found.append(more(links.join(bad, ["crawl_run_id", "target_url"]).select("crawl_run_id", F.col("source_url").alias("url")).distinct(), "BROKEN_INTERNAL_LINKS", "HIGH"))
    if context is not None:
        for code, (severity, p) in RUN_RULES.items():
            if possible(p, context.columns):
                found.append(more(context.filter(p).select("crawl_run_id", F.col("start_url").alias("url")), code, severity))
        if "production" in context.columns:
            staging = view.filter("NOT production AND html200 AND is_indexable").groupBy("crawl_run_id").agg(F.min("url").alias("url"))
            found.append(more(staging, "STAGING_INDEXABLE", "CRITICAL"))
    return reduce(DataFrame.unionByName, found).distinct()


_PAGE = "html200"
_LEN = "length({})"


def _twice(column: str) -> str:
    return _same(column, _PAGE)


# Tabs of the explorer: base, and filters by name.
TABS: dict[str, tuple[str, dict[str, str]]] = {
    "internal": ("true", {"html": "html200", "other": "NOT html200", "indexable": "is_indexable", "non_indexable": "NOT is_indexable"}),
    "response": ("true", {"blocked": "blocked_by_robots", "no_response": "status_code = 0 AND NOT blocked_by_robots", "2xx": "status_code BETWEEN 200 AND 299 AND NOT redirected", "3xx": "redirected", "4xx": "status_code BETWEEN 400 AND 499", "5xx": "status_code >= 500"}),
    "uri": (_PAGE, {
        "non_ascii": r"url RLIKE '[^\\x00-\\x7F]|%[89A-Fa-f][0-9A-Fa-f]'", "underscores": "contains(url, '_')", "uppercase": "regexp_replace(url, '^https?://[^/]*', '') RLIKE '[A-Z]'", "parameters": "contains(url, '?')",
        "over_115": "length(url) > 115", "multiple_slashes": "contains(regexp_replace(url, '^https?://', ''), '//')",
    }),
    "titles": (_PAGE, {"missing": _EMPTY.format("title"), "duplicate": _twice("title"), "over_60": "length(title) > 60", "below_30": f"NOT ({_EMPTY.format('title')}) AND length(title) < 30", "same_as_h1": f"NOT ({_EMPTY.format('title')}) AND lower(trim(title)) = lower(trim(h1))", "multiple": "title_count > 1"}),
    "meta": (_PAGE, {"missing": _EMPTY.format("meta_description"), "duplicate": _twice("meta_description"), "over_155": "length(meta_description) > 155", "below_70": f"NOT ({_EMPTY.format('meta_description')}) AND length(meta_description) < 70", "multiple": "meta_description_count > 1"}),
    "keywords": (_PAGE, {"present": f"NOT ({_EMPTY.format('meta_keywords')})"}),
    "h1": (_PAGE, {"missing": _EMPTY.format("h1"), "duplicate": _twice("h1"), "over_70": "length(h1) > 70", "multiple": "h1_count > 1"}),
    "h2": (_PAGE, {"missing": "size(coalesce(h2, array())) = 0", "duplicate": f"size(h2) > 0 AND count(CASE WHEN {_PAGE} AND size(h2) > 0 THEN 1 END) OVER (PARTITION BY crawl_run_id, lower(trim(get(h2, 0)))) > 1", "over_70": "exists(h2, x -> length(x) > 70)", "multiple": "size(h2) > 1"}),
    "canonicals": (_PAGE, {"self": "canonical = url", "canonicalised": "canonical <> url", "missing": _EMPTY.format("canonical"), "cross_host": "regexp_extract(canonical, '^https?://([^/?#]*)', 1) <> regexp_extract(url, '^https?://([^/?#]*)', 1)"}),
    "directives": ("true", {"noindex": _NOINDEX, "nofollow": "coalesce(concat_ws(',', robots_meta, x_robots_tag), '') RLIKE '(?i)nofollow|none'", "x_robots": f"NOT ({_EMPTY.format('x_robots_tag')})", "blocked": "blocked_by_robots"}),
    "hreflang": (_PAGE, {"contains": "size(hreflang) > 0", "missing_self": "size(hreflang) > 0 AND NOT exists(hreflang, h -> h.href = url)", "invalid": f"exists(hreflang, h -> NOT h.lang RLIKE '{_CODE}')", "missing_lang": _EMPTY.format("lang")}),
    "structured": (_PAGE, {"contains": "size(schema_types) > 0", "missing": "size(coalesce(schema_types, array())) = 0", "errors": "schema_errors > 0"}),
    "social": (_PAGE, {"missing_og_title": _EMPTY.format("og.title"), "missing_og_image": _EMPTY.format("og.image"), "missing_twitter": _EMPTY.format("twitter.card")}),
    "links": (_PAGE, {"no_inlinks": "inlinks = 0 AND depth > 0", "no_outlinks": "outlinks = 0", "many_outlinks": "outlinks > 100", "deep": "depth > 4"}),
    "pagination": (_PAGE, {"contains": f"NOT ({_EMPTY.format('rel_next')}) OR NOT ({_EMPTY.format('rel_prev')})"}),
    "search": (_PAGE, {
        "with_impressions": "impressions > 0", "with_clicks": "clicks > 0", "no_impressions": "coalesce(impressions, 0) = 0", "non_indexable_with_impressions": "NOT is_indexable AND impressions > 0", "low_ctr": "impressions >= 100 AND position <= 10 AND clicks / impressions < CASE WHEN position <= 3 THEN 0.05 WHEN position <= 6 THEN 0.025 ELSE 0.01 END",
        "striking_distance": "position BETWEEN 4 AND 15 AND impressions >= 50", "not_in_logs": "impressions > 0 AND NOT coalesce(in_logs, false)",
    }),
    "javascript": ("raw_word_count IS NOT NULL OR js_error IS NOT NULL", {
        "js_content": "word_count > 0 AND raw_word_count < 0.75 * word_count", "js_links": "size(js_only_links) > 0", "title": "coalesce(trim(raw_title), '') <> coalesce(trim(title), '')", "h1": "coalesce(trim(raw_h1), '') <> coalesce(trim(h1), '')",
        "canonical": "coalesce(raw_canonical, '') <> coalesce(canonical, '')", "robots": "coalesce(raw_robots_meta, '') <> coalesce(robots_meta, '')", "errors": "size(js_errors) > 0", "render_failed": "js_error IS NOT NULL",
    }),
}
_STATUS = {"2xx": "status_code BETWEEN 200 AND 299", "3xx": "status_code BETWEEN 300 AND 399 OR redirected", "4xx": "status_code BETWEEN 400 AND 499", "5xx": "status_code >= 500", "no_response": "coalesce(status_code, 0) = 0"}
_KINDS = (*KINDS, "page")
# What a resource claims by its kind and what it is sent as.
_MISMATCH = "(kind = 'script' AND NOT content_type RLIKE '(?i)javascript|ecmascript') OR (kind = 'css' AND NOT content_type RLIKE '(?i)css') OR (kind = 'image' AND NOT content_type RLIKE '(?i)^image/')"
RESOURCE_TABS: dict[str, tuple[str, dict[str, str]]] = {
    "resources": ("internal AND NOT is_link", {**{k: f"kind = '{k}'" for k in _KINDS}, "broken": "status_code >= 400 OR coalesce(status_code, 0) = 0", "heavy_image": "kind = 'image' AND size_bytes > 200 * 1024", "heavy": "size_bytes > 1024 * 1024", "type_mismatch": f"status_code = 200 AND content_type IS NOT NULL AND ({_MISMATCH})", **_STATUS}),
    "external": ("NOT internal", {"links": "is_link", "files": "NOT is_link", "broken": "status_code >= 400 OR coalesce(status_code, 0) = 0", "http": "url LIKE 'http:%'", **_STATUS}),
}
IMAGE_FILTERS = {"missing_alt": "alt IS NULL", "empty_alt": "trim(alt) = ''", "alt_over_100": "length(alt) > 100", "missing_dimensions": f"{_EMPTY.format('width')} OR {_EMPTY.format('height')}"}


def _filters(tabs: dict[str, tuple[str, dict[str, str]]], columns: list[str]) -> dict[str, Column]:
    out = {}
    for tab, (base, filters) in tabs.items():
        if possible(base, columns):
            for name, p in {"all": "true", **filters}.items():
                if possible(p, columns):
                    out[f"{tab}.{name}"] = F.coalesce(F.expr(f"({base}) AND ({p})"), F.lit(False))
    return out


def _counts(rows: DataFrame, filters: dict[str, Column]) -> DataFrame:
    """Rows per run that pass each filter; window counts are made first, then all are counted in one pass."""
    names = [f"_f{i}" for i in range(len(filters))]
    marked = rows.select("crawl_run_id", *(p.alias(n) for n, p in zip(names, filters.values())))
    wide = marked.groupBy("crawl_run_id").agg(*(F.count_if(n).alias(n) for n in names))
    return wide.select("crawl_run_id", F.explode(F.array(*(F.struct(F.lit(k).alias("filter"), F.col(n).alias("rows")) for k, n in zip(filters, names)))).alias("_f")).select("crawl_run_id", "_f.*")


def tab_counts(view: DataFrame, resources: DataFrame | None = None) -> DataFrame:
    """Rows of each run for every tab and filter whose columns are there: crawl_run_id, filter (tab.name), rows.

    Tabs of pages come from ``view``, those of images from its images, those of files and
    external links from ``resources`` (crawl_run_id, url, kind, internal, is_link,
    status_code, redirected, content_type, size_bytes).
    """
    parts = [_counts(view, _filters(TABS, view.columns))]
    if "images" in view.columns:
        parts.append(_counts(image_rows(view), {f"images.{n}": F.coalesce(F.expr(p), F.lit(False)) for n, p in {"all": "true", **IMAGE_FILTERS}.items()}))
    if resources is not None:
        parts.append(_counts(resources, _filters(RESOURCE_TABS, resources.columns)))
    return reduce(DataFrame.unionByName, parts)


def image_rows(view: DataFrame) -> DataFrame:
    """Images of the plain pages: crawl_run_id, url, src, alt, width, height."""
    rows = view.filter("html200").select("crawl_run_id", "url", F.explode("images").alias("_i"))
    return rows.select("crawl_run_id", "url", *(F.col(f"_i.{c}").alias(c) for c in ("src", "alt", "width", "height")))


def tab_rows(view: DataFrame, tab: str, name: str = "all") -> DataFrame:
    """Rows of one tab and filter."""
    source, tabs = (image_rows(view), {"images": ("true", IMAGE_FILTERS)}) if tab == "images" else (view, TABS | RESOURCE_TABS)
    base, filters = tabs[tab]
    p = {"all": "true", **filters}[name]
    return source.withColumn("_keep", F.expr(f"({base}) AND ({p})")).filter("_keep").drop("_keep")


def broken_pagination(view: DataFrame) -> DataFrame:
    """Pages whose next or previous page was crawled and is not a plain answer: crawl_run_id, url, target."""
    to = view.filter("html200").select("crawl_run_id", "url", F.explode(F.array_compact(F.array("rel_next", "rel_prev"))).alias("target"))
    bad = view.filter("NOT html200").select("crawl_run_id", F.col("url").alias("target"))
    return to.join(bad, ["crawl_run_id", "target"], "left_semi")


def page_detail(url: str, view: DataFrame, links: DataFrame, issues: DataFrame, most: int = 500) -> DataFrame:
    """What is known of one page in each run: its row, linking pages and linked pages (up to ``most`` each, by address) and codes of its issues."""
    page = view.filter(F.col("url") == url)
    gather = lambda df, col: df.groupBy("crawl_run_id").agg(F.array_sort(F.collect_set(col)).alias("_all"))
    into = gather(links.filter(F.col("target_url") == url), "source_url").select("crawl_run_id", F.slice("_all", 1, most).alias("inlinks_from"), F.size("_all").alias("n_inlinks"))
    out = gather(links.filter(F.col("source_url") == url), "target_url").select("crawl_run_id", F.slice("_all", 1, most).alias("links_to"), F.size("_all").alias("n_outlinks"))
    codes = gather(issues.filter(F.col("url") == url), "code").withColumnRenamed("_all", "issues")
    return page.join(into, "crawl_run_id", "left").join(out, "crawl_run_id", "left").join(codes, "crawl_run_id", "left")


def found_on(links: DataFrame, most: int = 20) -> DataFrame:
    """Where each resource was found: crawl_run_id, url, found_on (the first pages by address), found_on_count.

    ``links`` holds crawl_run_id, page and url. Pages are numbered before they are gathered, so no list grows beyond ``most``.
    """
    once = links.select("crawl_run_id", "url", "page").distinct()
    n = F.row_number().over(Window.partitionBy("crawl_run_id", "url").orderBy("page"))
    first = once.withColumn("_n", n).filter(F.col("_n") <= most).groupBy("crawl_run_id", "url").agg(F.array_sort(F.collect_list("page")).alias("found_on"))
    return first.join(once.groupBy("crawl_run_id", "url").agg(F.count("*").alias("found_on_count")), ["crawl_run_id", "url"])


# Why a crawler does not follow an address, in the order in which it asks.
def skip_reason(url: Column, start_host: str, include: list[str], exclude: list[str], max_depth: int, depth: Column, allowed: Column, seen: Column, nofollow: Column, max_length: int = 2048) -> Column:
    """Why an address is not fetched, or null if it is: the first reason that holds."""
    host = host_of(url)
    path = F.regexp_replace(url, "^https?://[^/]*", "")
    any_of = lambda patterns: reduce(lambda a, b: a | b, [url.rlike(p) for p in patterns])
    chain = F.when(host.isNull(), "not_http").when(F.length(url) > max_length, "too_long").when(seen, "seen").when(host != start_host, "other_host")
    chain = chain.when(path.rlike(r"(?i)\.(jpe?g|png|gif|svg|webp|ico|css|js|woff2?|ttf|mp4|webm|mp3|zip|pdf|xml|json)([?#]|$)"), "file")
    if exclude:
        chain = chain.when(any_of(exclude), "excluded")
    if include:
        chain = chain.when(~any_of(include), "not_included")
    return chain.when(nofollow, "nofollow").when(~allowed, "robots").when(depth > max_depth, "too_deep")
