"""Crawled pages: audit rules, differences of crawls, alerts, explorer filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from almena.functions.url import host_of


def answered(status: Column) -> Column:
    return status.between(200, 399)


def page_view(pages: DataFrame) -> DataFrame:
    """One row per run and URL, the latest fetched, with what rules and filters ask for."""
    rest = [c for c in pages.columns if c not in ("crawl_run_id", "url", "fetched_at")]
    row = F.max(F.struct("fetched_at", *rest)).alias("_row")
    once = pages.groupBy("crawl_run_id", "url").agg(row).select("crawl_run_id", "url", "_row.*")
    redirected = F.coalesce(F.col("final_url") != F.col("url"), F.lit(False)) | F.col("status_code").between(300, 399)
    return once.withColumn("redirected", redirected).withColumn("html200", (F.col("status_code") == 200) & ~redirected)


def indexability() -> Column:
    """Whether a page may be indexed, and why not: the first reason that holds."""
    reason = (
        F.when(F.col("blocked_by_robots"), "blocked").when(F.col("status_code") == 0, "no response").when(F.col("redirected"), "redirect")
        .when(F.col("status_code") != 200, F.concat(F.lit("status "), F.col("status_code").cast("string")))
        .when(F.col("indexability_reason") == "noindex", "noindex").when(F.coalesce("canonical", "url") != F.col("url"), "canonicalised")
    )
    return F.struct(reason.isNull().alias("indexable"), reason.alias("reason"))


def _twice(value: str, among: Column) -> Column:
    """Whether another page of the run among those counted has the same value, case aside; empty values never."""
    key = F.when(among & (F.coalesce(F.trim(value), F.lit("")) != ""), F.lower(F.trim(value)))
    return key.isNotNull() & (F.count(key).over(Window.partitionBy("crawl_run_id", key)) > 1)


# Rules with severity; predicates over the page view.
def audit_rules() -> dict[str, tuple[str, Column]]:
    """Rules by code: severity and the pages they hit."""
    c = F.col
    indexable = c("is_indexable") & c("html200")
    empty = lambda name: F.coalesce(F.trim(name), F.lit("")) == ""
    return {
        "HTTP_4XX": ("HIGH", c("status_code").between(400, 499)),
        "HTTP_5XX": ("CRITICAL", c("status_code") >= 500),
        "FETCH_FAILED": ("MEDIUM", (c("status_code") == 0) & ~c("blocked_by_robots")),
        "INTERNAL_LINKS_TO_REDIRECTS": ("LOW", c("redirected") & (c("inlinks") > 0)),
        "ROBOTS_BLOCKED": ("INFO", c("blocked_by_robots")),
        "NOINDEX": ("INFO", c("indexability_reason") == "noindex"),
        "CANONICAL_MISSING": ("MEDIUM", c("html200") & empty("canonical") & (F.coalesce("indexability_reason", F.lit("")) != "noindex")),
        "CANONICAL_CROSS_HOST": ("HIGH", c("html200") & (host_of(c("canonical")) != host_of(c("url")))),
        "PARAMETER_URLS_INDEXABLE": ("MEDIUM", indexable & c("url").contains("?")),
        "TITLE_MISSING": ("HIGH", indexable & empty("title")),
        "TITLE_TOO_SHORT": ("LOW", indexable & ~empty("title") & (F.length("title") < 30)),
        "TITLE_TOO_LONG": ("LOW", indexable & (F.length("title") > 60)),
        "H1_MISSING": ("MEDIUM", indexable & empty("h1")),
        "CONTENT_THIN": ("MEDIUM", indexable & (c("word_count") < 150)),
        "SCHEMA_MISSING": ("INFO", indexable & (F.coalesce(F.size("schema_types"), F.lit(0)) <= 0)),
        "SLOW_RESPONSE": ("MEDIUM", c("html200") & (c("response_time_ms") > 1000)),
    }


def audit(view: DataFrame) -> DataFrame:
    """Pages hit by each rule: crawl_run_id, code, severity, url."""
    rules = audit_rules()
    indexable = F.col("is_indexable") & F.col("html200")
    twice = view.withColumn("_twice", _twice("title", indexable))
    hits = [F.when(F.coalesce(p, F.lit(False)), F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"))) for code, (severity, p) in rules.items()]
    hits.append(F.when(F.col("_twice"), F.struct(F.lit("TITLE_DUPLICATE").alias("code"), F.lit("MEDIUM").alias("severity"))))
    return twice.select("crawl_run_id", "url", F.explode(F.array_compact(F.array(*hits))).alias("_h")).select("crawl_run_id", "_h.code", "_h.severity", "url")


def canonical_targets(view: DataFrame) -> DataFrame:
    """Pages whose canonical is another page of the run that cannot be indexed: crawl_run_id, url, canonical."""
    target = view.select("crawl_run_id", F.col("url").alias("canonical"), F.col("is_indexable").alias("_ok"))
    return view.filter("html200 AND canonical <> url").join(target, ["crawl_run_id", "canonical"]).filter(~F.coalesce("_ok", F.lit(False))).select("crawl_run_id", "url", "canonical")


def differences(view: DataFrame, runs: DataFrame) -> DataFrame:
    """Every change between a run and its base: crawl_run_id, url, change. One page may have several.

    Removals count only if the newer run is complete; a page that has just been blocked
    by robots reports that, not its status; contents are compared between two plain answers.
    """
    pair = runs.filter("base_run_id IS NOT NULL").select(F.col("crawl_run_id").alias("run"), F.col("base_run_id").alias("base"), (F.col("run_status") == "completed").alias("complete"))
    fields = ["status_code", "final_url", "title", "canonical", "h1", "is_indexable", "indexability_reason", "word_count", "blocked_by_robots", "schema_types", "redirected"]
    side = lambda key, tag: view.join(pair, view["crawl_run_id"] == pair[key]).select("run", "complete", "url", F.struct(*fields).alias(tag))
    both = side("run", "a").join(side("base", "b").withColumnRenamed("complete", "_complete"), ["run", "url"], "full")
    f = lambda name: (F.col(f"b.{name}"), F.col(f"a.{name}"))
    (bs, as_), (bb, ab), (bi, ai), (br, ar) = f("status_code"), f("blocked_by_robots"), f("is_indexable"), f("redirected")
    text = lambda name: F.coalesce(f(name)[0], F.lit("")) != F.coalesce(f(name)[1], F.lit(""))
    plain = (bs == 200) & (as_ == 200) & ~br & ~ar
    moved = (bs != as_) & ~(ab & ~bb)
    broken, back = answered(bs) & ~answered(as_) & ~ab, ~answered(bs) & answered(as_)
    types = lambda tag: F.coalesce(F.col(f"{tag}.schema_types"), F.array().cast("array<string>"))
    found = F.array_compact(
        F.array(
            F.when(moved & broken, "PAGE_BROKEN").when(moved & back, "PAGE_RECOVERED").when(moved, "STATUS_CHANGED"),
            F.when(~bb & ab, "ROBOTS_BLOCKED_NEW"),
            F.when(bi & ~ai & answered(as_) & ~ab, F.when(F.col("a.indexability_reason") == "noindex", "NOINDEX_ADDED").otherwise("BECAME_NON_INDEXABLE")),
            F.when(~bi & ai, "BECAME_INDEXABLE"),
            F.when(~br & ar, "REDIRECT_ADDED").when(br & ~ar, "REDIRECT_REMOVED").when(br & ar & text("final_url"), "REDIRECT_TARGET_CHANGED"),
            F.when(plain & text("canonical"), "CANONICAL_CHANGED"),
            F.when(plain & text("title"), "TITLE_CHANGED"),
            F.when(plain & text("h1"), "H1_CHANGED"),
            F.when(plain & (F.col("b.word_count") >= 150) & (F.col("a.word_count") < F.col("b.word_count") * 0.5), "CONTENT_SHRUNK"),
            F.when(plain & (F.size(F.array_except(types("b"), types("a"))) > 0), "SCHEMA_REMOVED"),
        )
    )
    change = F.when(F.col("b").isNull(), F.array(F.lit("PAGE_ADDED"))).when(F.col("a").isNull(), F.array(F.lit("PAGE_REMOVED"))).otherwise(found)
    rows = both.select(F.col("run").alias("crawl_run_id"), "url", F.coalesce("complete", "_complete").alias("_done"), F.explode(change).alias("change"))
    return rows.filter((F.col("change") != "PAGE_REMOVED") | F.col("_done")).select("crawl_run_id", "url", "change")


# Changes that alert, with severity.
ALERTS = {
    "NOINDEX_ADDED": "CRITICAL", "PAGE_BROKEN": "HIGH", "BECAME_NON_INDEXABLE": "HIGH", "CANONICAL_CHANGED": "HIGH", "ROBOTS_BLOCKED_NEW": "HIGH",
    "CONTENT_SHRUNK": "MEDIUM", "SCHEMA_REMOVED": "MEDIUM",
}


def alerts(changes: DataFrame, view: DataFrame, least_pages: int = 10, mass_share: float = 0.2) -> DataFrame:
    """Alerts of each run: crawl_run_id, alert, severity, urls. Many changed titles at once are one more."""
    counted = changes.groupBy("crawl_run_id", "change").agg(F.count("*").alias("urls"))
    severity = F.create_map(*(F.lit(x) for pair in ALERTS.items() for x in pair))
    single = counted.withColumn("severity", F.try_element_at(severity, "change")).filter("severity IS NOT NULL")
    size = view.groupBy("crawl_run_id").agg(F.count("*").alias("_pages"))
    mass = counted.filter("change = 'TITLE_CHANGED'").join(size, "crawl_run_id").filter((F.col("_pages") >= least_pages) & (F.col("urls") >= mass_share * F.col("_pages")))
    return single.select("crawl_run_id", F.col("change").alias("alert"), "severity", "urls").unionByName(mass.select("crawl_run_id", F.lit("MASS_TITLE_CHANGE").alias("alert"), F.lit("MEDIUM").alias("severity"), "urls"))


def explorer_filters() -> dict[str, Column]:
    """Filters of the explorer by tab and name, over the page view."""
    c, status = F.col, F.col("status_code")
    page = c("html200")
    empty = lambda name: F.coalesce(F.trim(name), F.lit("")) == ""
    out = {
        "internal_all": F.lit(True), "internal_html": page, "internal_indexable": c("is_indexable"), "internal_non_indexable": ~c("is_indexable"),
        "response_blocked": c("blocked_by_robots"), "response_none": status == 0, "response_2xx": status.between(200, 299), "response_3xx": status.between(300, 399), "response_4xx": status.between(400, 499), "response_5xx": status >= 500,
        "uri_non_ascii": page & c("url").rlike(r"[^\x00-\x7F]"), "uri_underscores": page & c("url").contains("_"), "uri_uppercase": page & F.regexp_replace("url", "^https?://[^/]*", "").rlike("[A-Z]"), "uri_parameters": page & c("url").contains("?"), "uri_over_115": page & (F.length("url") > 115), "uri_multiple_slashes": page & F.regexp_replace("url", "^https?://", "").contains("//"),
        "titles_missing": page & empty("title"), "titles_over_60": page & (F.length("title") > 60), "titles_below_30": page & ~empty("title") & (F.length("title") < 30), "titles_same_as_h1": page & ~empty("title") & (F.lower(F.trim("title")) == F.lower(F.trim("h1"))),
        "h1_missing": page & empty("h1"), "h1_over_70": page & (F.length("h1") > 70),
        "canonicals_self": page & (c("canonical") == c("url")), "canonicals_other": page & (c("canonical") != c("url")), "canonicals_missing": page & empty("canonical"),
        "structured_present": page & (F.size("schema_types") > 0), "structured_missing": page & (F.coalesce(F.size("schema_types"), F.lit(0)) <= 0),
        "links_no_inlinks": page & (c("inlinks") == 0), "content_thin": page & (c("word_count") < 150),
    }
    return {name: F.coalesce(p, F.lit(False)) for name, p in out.items()}


def explorer_counts(view: DataFrame) -> DataFrame:
    """Pages of each run that pass each filter, in one pass: crawl_run_id, filter, pages."""
    filters = explorer_filters()
    wide = view.groupBy("crawl_run_id").agg(*(F.count_if(p).alias(n) for n, p in filters.items()))
    return wide.select("crawl_run_id", F.explode(F.array(*(F.struct(F.lit(n).alias("filter"), F.col(n).alias("pages")) for n in filters))).alias("_f")).select("crawl_run_id", "_f.*")


def explorer(view: DataFrame, name: str, search: str = "", sort: str = "url", descending: bool = False, page: int = 0, size: int = 500) -> DataFrame:
    """One page of a tab: rows that pass a filter and contain the search text, in the order of a column and the URL."""
    rows = view.filter(explorer_filters()[name])
    if search:
        texts = [F.lower(n) for n, kind in view.dtypes if kind == "string"]
        rows = rows.filter(F.exists(F.array(*texts), lambda t: t.contains(search.lower())))
    by = F.collate(F.col(sort), "es") if dict(view.dtypes)[sort] == "string" else F.col(sort)
    return rows.orderBy(by.desc() if descending else by.asc(), "crawl_run_id", "url").offset(page * size).limit(size)


def custom_search(pages: DataFrame, column: str, mode: str, pattern: str) -> DataFrame:
    """Pages whose text contains, lacks, matches or does not match, with the number of hits."""
    if mode.endswith("regex") and any(x in pattern for x in ("+)+", "*)+", "+)*", "*)*")):
        raise ValueError("nested repetitions are refused")
    hits = F.regexp_count(column, F.lit(pattern)) if mode.endswith("regex") else (F.length(column) - F.length(F.replace(F.col(column), F.lit(pattern), F.lit("")))) / len(pattern)
    counted = pages.withColumn("hits", hits.cast("int"))
    return counted.filter(F.coalesce("hits", F.lit(0)) == 0 if mode.startswith("not") else F.col("hits") > 0)
