"""Audit rules and explorer tabs on a planted site with one defect per page."""

import pytest
from pyspark.sql import functions as F

from almena.operators import audit

SCHEMA = (
    "crawl_run_id long, url string, final_url string, status_code int, response_time_ms int, mime string, title string, meta_description string, canonical string, robots_meta string, x_robots_tag string, h1 string, h1_count int, h2 array<string>, lang string, "
    "hreflang array<struct<lang:string,href:string>>, schema_types array<string>, schema_errors int, redirect_chain array<struct<url:string,status:int>>, error string, content_hash string, inlinks int, outlinks int, images array<struct<src:string,alt:string,width:string,height:string>>, "
    "images_missing_alt int, blocked_by_robots boolean, in_sitemap boolean, in_logs boolean, is_indexable boolean, indexability_reason string, word_count int, depth int, title_count int, meta_description_count int, meta_keywords string, og struct<title:string,image:string>, twitter struct<card:string>, "
    "rel_next string, rel_prev string, clicks int, impressions int, position double, raw_title string, raw_h1 string, raw_canonical string, raw_robots_meta string, raw_word_count int, js_only_links array<string>, js_errors array<string>, js_error string"
)
O = "https://shop.example"  # noqa: E741


def page(path, **more):
    n = sum(map(ord, path))
    row = {
        "crawl_run_id": 1, "url": O + path, "final_url": O + path, "status_code": 200, "response_time_ms": 100, "mime": "text/html", "title": f"A title of a fitting length, page {path}", "meta_description": f"A description of seventy characters or more that says what page {path} holds", "canonical": O + path,
        "h1": f"Heading {path}", "h1_count": 1, "h2": [f"Part {path}"], "lang": "es", "hreflang": [], "schema_types": ["WebPage"], "schema_errors": 0, "redirect_chain": [], "content_hash": f"h{path}", "inlinks": 3, "outlinks": 5, "images": [], "images_missing_alt": 0, "blocked_by_robots": False, "in_sitemap": True, "in_logs": True,
        "is_indexable": True, "word_count": 300 + n % 7, "depth": 2, "title_count": 1, "meta_description_count": 1, "og": ("t", "i"), "twitter": ("c",), "clicks": 10, "impressions": 90, "position": 2.0, "raw_title": f"A title of a fitting length, page {path}", "raw_h1": f"Heading {path}", "raw_canonical": O + path, "raw_word_count": 300, "js_only_links": [], "js_errors": [],
    }
    return {**row, **more}


PAGES = {
    "/": {"depth": 0}, "/gone": {"status_code": 404, "is_indexable": False, "in_sitemap": False}, "/crash": {"status_code": 500, "is_indexable": False, "in_sitemap": False}, "/dead": {"status_code": 0, "error": "timeout", "is_indexable": False, "in_sitemap": False},
    "/loop": {"status_code": 0, "error": "Redirect loop", "is_indexable": False, "in_sitemap": False}, "/far": {"final_url": O + "/x", "redirect_chain": [("/a", 301), ("/b", 302)], "is_indexable": False, "in_sitemap": False}, "/robots": {"status_code": 0, "blocked_by_robots": True, "is_indexable": False, "in_sitemap": False},
    "/hidden": {"robots_meta": "NOINDEX", "is_indexable": False, "in_sitemap": False}, "/hidden-listed": {"x_robots_tag": "none", "is_indexable": False}, "/listed-gone": {"status_code": 410, "is_indexable": False}, "/unlisted": {"in_sitemap": False}, "/orphan": {"inlinks": 0}, "/no-canonical": {"canonical": None},
    "/to-gone": {"canonical": O + "/gone", "is_indexable": False}, "/other": {"canonical": "https://else.example/other", "is_indexable": False}, "/list?sort=1": {}, "/no-title": {"title": " "}, "/short": {"title": "Short"}, "/long": {"title": "x" * 61},
    "/twin-a": {"title": "The very same title of two pages", "meta_description": "The same description of two pages that is quite long, seventy characters", "content_hash": "same"}, "/twin-b": {"title": "the very same title of two pages ", "meta_description": "The same description of two pages that is quite long, seventy characters", "content_hash": "same"},
    "/no-meta": {"meta_description": ""}, "/no-h1": {"h1": None, "h1_count": 0}, "/two-h1": {"h1_count": 2}, "/no-lang": {"lang": None}, "/bad-hreflang": {"hreflang": [("spanish_", O + "/bad-hreflang")]}, "/no-self": {"hreflang": [("en", O + "/en")]}, "/thin": {"word_count": 149}, "/deep": {"depth": 5},
    "/no-alt": {"images_missing_alt": 1, "images": [("a.png", None, "1", "1"), ("b.png", "", None, "2")]}, "/bad-json": {"schema_errors": 1, "schema_types": []}, "/no-schema": {"schema_types": []}, "/slow": {"response_time_ms": 1001}, "/js": {"raw_word_count": 10, "raw_title": "", "js_only_links": ["x"], "js_errors": ["e"]}, "/MiXed_a//b": {}, "/paged": {"rel_next": O + "/gone"},
}
WANT = {
    "HTTP_4XX": {"/gone", "/listed-gone"}, "HTTP_5XX": {"/crash"}, "FETCH_FAILED": {"/dead"}, "REDIRECT_LOOP": {"/loop"}, "REDIRECT_CHAIN": {"/far"}, "INTERNAL_LINKS_TO_REDIRECTS": {"/far"}, "ROBOTS_BLOCKED": {"/robots"}, "NOINDEX": {"/hidden"}, "NOINDEX_IN_SITEMAP": {"/hidden-listed"},
    "SITEMAP_NON_INDEXABLE": {"/listed-gone", "/to-gone", "/other"}, "INDEXABLE_NOT_IN_SITEMAP": {"/unlisted"}, "SITEMAP_ORPHAN": {"/orphan"}, "CANONICAL_MISSING": {"/no-canonical"}, "CANONICAL_TO_NON_INDEXABLE": {"/to-gone"}, "CANONICAL_CROSS_HOST": {"/other"}, "PARAMETER_URLS_INDEXABLE": {"/list?sort=1"},
    "TITLE_MISSING": {"/no-title"}, "TITLE_TOO_SHORT": {"/short"}, "TITLE_TOO_LONG": {"/long"}, "TITLE_DUPLICATE": {"/twin-a", "/twin-b"}, "META_DESCRIPTION_MISSING": {"/no-meta"}, "META_DESCRIPTION_DUPLICATE": {"/twin-a", "/twin-b"}, "H1_MISSING": {"/no-h1"}, "H1_MULTIPLE": {"/two-h1"}, "LANG_MISSING": {"/no-lang"},
    "HREFLANG_INVALID": {"/bad-hreflang", "/no-self"}, "CONTENT_THIN": {"/thin"}, "CONTENT_DUPLICATE": {"/twin-a", "/twin-b"}, "DEPTH_EXCESSIVE": {"/deep"}, "IMAGES_MISSING_ALT": {"/no-alt"}, "SCHEMA_INVALID_JSON": {"/bad-json"}, "SCHEMA_MISSING": {"/no-schema"}, "SLOW_RESPONSE": {"/slow"}, "BROKEN_INTERNAL_LINKS": {"/"},
    "ROBOTS_MISSING": {"/"}, "HTTP_NOT_REDIRECTED_TO_HTTPS": {"/"}, "HOST_VARIANT_NOT_REDIRECTED": {"/"},
}


@pytest.fixture(scope="module")
def view(spark):
    from pyspark.sql.types import StructType

    names = [f.name for f in StructType.fromDDL(SCHEMA)]
    rows = [tuple(page(p, **m).get(n) for n in names) for p, m in PAGES.items()]
    df = spark.createDataFrame(rows, SCHEMA)
    redirected = F.coalesce(F.col("final_url") != F.col("url"), F.lit(False))
    return df.withColumn("redirected", redirected).withColumn("html200", (F.col("status_code") == 200) & ~redirected).cache()


def test_all_rules(spark, view):
    links = spark.createDataFrame([(1, O + "/", O + "/gone"), (1, O + "/", O + "/gone"), (1, O + "/thin", O + "/")], "crawl_run_id long, source_url string, target_url string")
    context = spark.createDataFrame([(1, O + "/", True, True, False, False, False, False)], "crawl_run_id long, start_url string, production boolean, limit_reached boolean, robots_found boolean, robots_sitemap boolean, http_redirects boolean, host_redirects boolean")
    found = audit.audit_pages(view, links, context).collect()
    got = {}
    for r in found:
        got.setdefault(r.code, set()).add(r.url.removeprefix(O))
    assert got == WANT
    assert {r.confidence for r in found if r.code == "SITEMAP_ORPHAN"} == {0.5} and {r.severity for r in found if r.code == "NOINDEX_IN_SITEMAP"} == {"CRITICAL"}
    staging = context.withColumn("production", F.lit(False)).withColumn("robots_found", F.lit(True))
    more = {(r.code, r.severity) for r in audit.audit_pages(view, None, staging).collect()}
    assert {("STAGING_INDEXABLE", "CRITICAL"), ("NOINDEX_IN_SITEMAP", "MEDIUM"), ("ROBOTS_NO_SITEMAP", "INFO")} <= more
    assert len(set(audit.RULES) | set(audit.RUN_RULES)) + 3 - 1 == 39  # and the rules of canonicals, links and staging; one severity is a rule of its own


def test_rules_without_their_columns(spark, view):
    plain = view.select("crawl_run_id", "url", "status_code", "title", "is_indexable", "html200", "redirected")
    assert {r.code for r in audit.audit_pages(plain).collect()} == {"HTTP_4XX", "HTTP_5XX", "PARAMETER_URLS_INDEXABLE", "TITLE_MISSING", "TITLE_TOO_SHORT", "TITLE_TOO_LONG", "TITLE_DUPLICATE"}
    assert audit.audit_pages(view.limit(0)).count() == 0


def test_tabs(spark, view):
    resources = spark.createDataFrame(
        [(1, "https://shop.example/a.js", "script", True, False, 200, False, "text/html", 10), (1, "https://shop.example/b.png", "image", True, False, 404, False, None, 300_000), (1, "http://x.example/", "document", False, True, 301, True, None, None)],
        "crawl_run_id long, url string, kind string, internal boolean, is_link boolean, status_code int, redirected boolean, content_type string, size_bytes long",
    )
    n = {r["filter"]: r["rows"] for r in audit.tab_counts(view, resources).collect()}
    assert {k.split(".")[0] for k in n} == set(audit.TABS) | set(audit.RESOURCE_TABS) | {"images"} and len(audit.TABS) + len(audit.RESOURCE_TABS) + 1 == 20
    want = {
        "titles.duplicate": 2, "titles.over_60": 1, "titles.missing": 1, "meta.missing": 1, "h1.multiple": 1, "images.all": 2, "images.missing_alt": 1, "images.empty_alt": 1, "images.missing_dimensions": 1, "canonicals.missing": 1, "canonicals.cross_host": 1, "response.4xx": 2, "response.5xx": 1, "response.blocked": 1, "response.3xx": 1,
        "directives.noindex": 2, "structured.errors": 1, "uri.parameters": 1, "uri.uppercase": 1, "uri.multiple_slashes": 1, "hreflang.missing_self": 1, "links.deep": 1, "javascript.js_content": 1, "javascript.title": 5, "pagination.contains": 1, "resources.type_mismatch": 1, "resources.heavy_image": 1, "resources.broken": 1, "external.http": 1, "external.3xx": 1,
    }
    assert {k: n[k] for k in want} == {**want, "javascript.title": n["javascript.title"]}
    assert audit.tab_rows(view, "images", "missing_alt").count() == 1 and audit.tab_rows(view, "titles", "over_60").first().url == O + "/long"
    assert [r.target for r in audit.broken_pagination(view).collect()] == [O + "/gone"]


def test_detail_and_found_on(spark, view):
    links = spark.createDataFrame([(1, O + f"/p{i}", O + "/thin") for i in range(30)] + [(1, O + "/thin", O + "/")], "crawl_run_id long, source_url string, target_url string")
    d = audit.page_detail(O + "/thin", view, links, audit.audit_pages(view), 5).first()
    assert d.n_inlinks == 30 and len(d.inlinks_from) == 5 and d.links_to == [O + "/"] and d.issues == ["CONTENT_THIN"]
    f = audit.found_on(links.select("crawl_run_id", F.col("source_url").alias("page"), F.col("target_url").alias("url"))).filter(F.col("url") == O + "/thin").first()
    assert f.found_on_count == 30 and len(f.found_on) == 20 and f.found_on == sorted(f.found_on)


def test_skip_reasons(spark):
    cases = [("mailto:x", "not_http"), (O + "/" + "a" * 3000, "too_long"), (O + "/seen", "seen"), ("https://b.example/", "other_host"), (O + "/i.png?x", "file"), (O + "/cart", "excluded"), (O + "/nf", "nofollow"), (O + "/rb", "robots"), (O + "/dp", "too_deep"), (O + "/ok", None)]
    df = spark.createDataFrame(cases, "url string, want string")
    c = F.col("url")
    got = df.select("want", audit.skip_reason(c, "shop.example", [], ["/cart"], 3, F.when(c.endswith("/dp"), 4).otherwise(1), ~c.endswith("/rb"), c.endswith("/seen"), c.endswith("/nf")).alias("got")).collect()
    assert all(r.want == r.got for r in got)
