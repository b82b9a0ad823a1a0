"""Fields and links of HTML pages by native expressions; relative addresses resolved in Arrow batches."""

from __future__ import annotations

from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from almena.functions.url import norm_url


def _clean(text: Column) -> Column:
    return F.nullif(F.trim(F.regexp_replace(F.regexp_replace(text, "<[^>]*>", " "), r"\s+", " ")), F.lit(""))


def _inner(html: Column, tag: str) -> Column:
    return F.transform(F.regexp_extract_all(html, F.lit(rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}\s*>"), 1), _clean)


def _attribute(tag: Column, name: str) -> Column:
    """Value of an attribute in quotes or bare; null if it is missing."""
    value = F.regexp_extract(tag, rf"""(?is)\s{name}\s*=\s*("[^"]*"|'[^']*'|[^\s>"']+)""", 1)
    return F.nullif(F.regexp_replace(value, """^["']|["']$""", ""), F.lit(""))


def _meta(html: Column, name: str) -> Column:
    """Content of the first meta tag of a name, whatever the order of its attributes."""
    tags = F.filter(F.regexp_extract_all(html, F.lit(r"(?is)<meta\b[^>]*>"), 0), lambda t: F.lower(_attribute(t, "name")) == name)
    return _attribute(F.get(tags, F.lit(0)), "content")


def _link(html: Column, rel: str) -> Column:
    tags = F.filter(F.regexp_extract_all(html, F.lit(r"(?is)<link\b[^>]*>"), 0), lambda t: F.lower(_attribute(t, "rel")) == rel)
    return _attribute(F.get(tags, F.lit(0)), "href")


def head_fields(pages: DataFrame, html: str = "html") -> DataFrame:
    """Pages with title, title_count, description, canonical, robots, lang, h1, h1_count, h2, images, images_missing_alt, links, words.

    Comments, scripts and styles are taken out first. A null page has null fields and counts of 0.
    """
    bare = F.regexp_replace(F.regexp_replace(F.coalesce(html, F.lit("")), r"(?s)<!--.*?-->", " "), r"(?is)<(script|style|template)\b.*?</\1\s*>", " ")
    p = pages.withColumn("_bare", bare)
    b = F.col("_bare")
    images = F.regexp_extract_all(b, F.lit(r"(?is)<img\b[^>]*>"), 0)
    return p.select(
        *pages.columns,
        F.get(_inner(b, "title"), F.lit(0)).alias("title"), F.size(_inner(b, "title")).alias("title_count"), _meta(b, "description").alias("description"), _link(b, "canonical").alias("canonical"), _meta(b, "robots").alias("robots"),
        _attribute(F.regexp_extract(b, r"(?is)<html\b[^>]*>", 0), "lang").alias("lang"), F.get(_inner(b, "h1"), F.lit(0)).alias("h1"), F.size(_inner(b, "h1")).alias("h1_count"), _inner(b, "h2").alias("h2"),
        F.size(images).alias("images"), F.size(F.filter(images, lambda t: ~t.rlike(r"(?is)\salt\s*="))).alias("images_missing_alt"), F.regexp_count(b, F.lit(r"(?is)<a\b[^>]*\shref\s*=")).alias("links"),
        F.size(F.filter(F.split(F.regexp_replace(b, "<[^>]*>", " "), r"\s+"), lambda w: w != "")).alias("words"),
    )


def resolved(base: Column, href: Column) -> Column:
    """Addresses relative to their page; null for what cannot be resolved."""

    def one(b: str | None, h: str | None) -> str | None:
        try:
            return urljoin(b or "", h.strip()) if h else None
        except ValueError:
            return None

    @F.pandas_udf("string")
    def run(bases: pd.Series, hrefs: pd.Series) -> pd.Series:
        return pd.Series([one(b, h) for b, h in zip(bases, hrefs)], dtype=object)

    return run(base, href)


def link_rows(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """Links of pages: source_url, target_url (no fragment, http only), anchor, nofollow; once per link tag."""
    bare = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?s)<!--.*?-->", " ")
    tags = pages.select(F.col(url).alias("source_url"), F.explode(F.regexp_extract_all(bare, F.lit(r"(?is)<a\b[^>]*>.*?</a\s*>"), 0)).alias("_a"))
    head = F.regexp_extract("_a", "(?is)^<a[^>]*>", 0)
    found = tags.select("source_url", _attribute(head, "href").alias("_href"), _clean(F.col("_a")).alias("anchor"), F.coalesce(_attribute(head, "rel").rlike(r"(?i)\bnofollow\b"), F.lit(False)).alias("nofollow"))
    kept = found.filter("_href IS NOT NULL AND NOT _href RLIKE '^(?i)(mailto|tel|javascript|data):'")
    return kept.select("source_url", norm_url(resolved(F.col("source_url"), F.col("_href"))).alias("target_url"), "anchor", "nofollow").filter("target_url IS NOT NULL")


def inlinks(links: DataFrame) -> DataFrame:
    """Distinct linking pages per target, the page itself not counted: url, inlinks."""
    return links.filter("source_url <> target_url").groupBy(F.col("target_url").alias("url")).agg(F.countDistinct("source_url").alias("inlinks"))


def broken_links(links: DataFrame, pages: DataFrame) -> DataFrame:
    """Links to crawled pages that answer with an error: source_url, target_url, status_code."""
    bad = pages.filter("status_code >= 400").select(F.col("url").alias("target_url"), "status_code").distinct()
    return links.join(bad, "target_url").select("source_url", "target_url", "status_code").distinct()
