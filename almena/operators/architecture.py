"""Site architecture: link report, orphans, link suggestions, redirect map, rendering, duplicates with a keeper."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from almena.functions.text import jaccard, round_up
from almena.functions.url import is_absolute, path_of, path_only, url_key
from almena.operators.graph import clean_edges, pagerank
from almena.operators.similarity import cosine_to_queries, near_duplicates, terms, tfidf
from almena.session import cut_lineage


def link_edges(pages: DataFrame, links: DataFrame) -> DataFrame:
    """Links between indexable pages, whichever spelling (own or final address) they use: src, dst, distinct, without loops.

    Of several pages that share a key the greatest address stands for it. Links marked nofollow do not count.
    """
    good = pages.filter("status_code = 200 AND is_indexable")
    keys = good.select("url", F.explode(F.array_distinct(F.array_compact(F.array(url_key(F.col("url")), url_key(F.col("final_url")))))).alias("_k")).groupBy("_k").agg(F.max("url").alias("url"))
    followed = links.filter("NOT coalesce(nofollow, false)") if "nofollow" in links.columns else links
    keyed = followed.select(url_key(F.col("source_url")).alias("_s"), url_key(F.col("target_url")).alias("_t")).distinct()
    side = lambda key, name: keys.select(F.col("_k").alias(key), F.col("url").alias(name))
    return clean_edges(keyed.join(side("_s", "src"), "_s").join(side("_t", "dst"), "_t").select("src", "dst"))


def link_report(pages: DataFrame, links: DataFrame, search: DataFrame | None = None, iterations: int = 40) -> DataFrame:
    """Indexable pages with link score (0 to 100), inlinks, outlinks, depth, clicks, impressions, and what they are: deep (over 3), weak (score under 30 with impressions)."""
    edges = cut_lineage(link_edges(pages, links))
    nodes = pages.filter("status_code = 200 AND is_indexable").select("url", "depth").dropDuplicates(["url"])
    ranks = pagerank(nodes.select(F.col("url").alias("id")), edges, iterations=iterations).select(F.col("id").alias("url"), F.col("score").cast("int").alias("link_score"))
    count = lambda end, name: edges.groupBy(F.col(end).alias("url")).agg(F.count("*").alias(name))
    out = nodes.join(ranks, "url").join(count("dst", "inlinks"), "url", "left").join(count("src", "outlinks"), "url", "left")
    out = out.select("url", "depth", "link_score", F.coalesce("inlinks", F.lit(0)).alias("inlinks"), F.coalesce("outlinks", F.lit(0)).alias("outlinks"))
    if search is not None:
        s = search.groupBy(url_key(F.col("page")).alias("_k")).agg(F.max_by(F.struct("clicks", "impressions"), "page").alias("_s"))
        out = out.withColumn("_k", url_key(F.col("url"))).join(s, "_k", "left").select(*out.columns, F.col("_s.clicks").alias("clicks"), F.col("_s.impressions").alias("impressions"))
    else:
        out = out.withColumns({"clicks": F.lit(None).cast("long"), "impressions": F.lit(None).cast("long")})
    return out.withColumns({"deep": F.coalesce(F.col("depth") > 3, F.lit(False)), "weak": (F.col("link_score") < 30) & (F.coalesce("impressions", F.lit(0)) > 0)})


def orphans(report: DataFrame, pages: DataFrame, sitemap: DataFrame, search: DataFrame) -> DataFrame:
    """Addresses that no link leads to: key, in_crawl, sources (no_links, sitemap, search), impressions; the start page (depth 0) is none."""
    key = lambda c: url_key(F.col(c)).alias("key")
    crawled = pages.select(key("url")).distinct()
    start = pages.filter("depth = 0").select(key("url")).distinct()
    unlinked = report.filter("inlinks = 0").select(key("url")).join(start, "key", "left_anti")
    listed = sitemap.select(key("url")).join(crawled, "key", "left_anti")
    found = search.filter("impressions > 0").select(key("page")).join(crawled, "key", "left_anti")
    tagged = [df.distinct().select("key", F.lit(inside).alias("in_crawl"), F.lit(name).alias("source")) for name, inside, df in (("no_links", True, unlinked), ("sitemap", False, listed), ("search", False, found))]
    seen = search.groupBy(key("page")).agg(F.sum("impressions").alias("impressions"))
    whole = reduce(DataFrame.unionByName, tagged).groupBy("key").agg(F.max("in_crawl").alias("in_crawl"), F.array_sort(F.collect_set("source")).alias("sources"))
    return whole.join(seen, "key", "left").select("key", "in_crawl", "sources", F.coalesce("impressions", F.lit(0)).cast("long").alias("impressions"))


# ------------------------------------------------------------------ phrases
_LETTERS = {"a": "aáàäâã", "e": "eéèëê", "i": "iíìïî", "o": "oóòöôõ", "u": "uúùüû", "n": "nñ"}


def _fold(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", text.lower()) if not unicodedata.combining(c))


def phrase_pattern(phrase: str) -> re.Pattern:
    """A phrase between word limits, whatever its accents, case and white space."""
    word = lambda w: "".join(f"[{_LETTERS[c]}]" if c in _LETTERS else re.escape(c) for c in w)
    return re.compile(r"(?<![^\W_])" + r"\s+".join(map(word, _fold(phrase).split())) + r"(?![^\W_])", re.IGNORECASE)


def anchor_candidates(title: str | None, h1: str | None, queries: list[str] | None = None) -> list[str]:
    """Texts a link to a page could have: its queries, heading and parts of its title of two to six words and at most 60 characters, once each."""
    parts = [*(queries or []), h1, *re.split(r"\s+[|\-–—:·]\s+", title or "")]
    out: dict[str, str] = {}
    for part in parts:
        text = " ".join((part or "").split())
        if 2 <= len(text.split()) <= 6 and len(text) <= 60:
            out.setdefault(_fold(text), text)
    return list(out.values())


def find_phrase(texts: list[str], phrases: list[str], around: int = 60) -> tuple[str, str, str] | None:
    """The first phrase that occurs in any text: phrase, as it is written there, and what stands around it."""
    for phrase in phrases:
        pattern = phrase_pattern(phrase)
        for text in texts:
            m = pattern.search(text)
            if m:
                a, b = max(0, m.start() - around), m.end() + around
                return phrase, m[0], f"{'…' if a else ''}{text[a : m.start()]}[[{m[0]}]]{text[m.end() : b]}{'…' if b < len(text) else ''}"
    return None


# Elements in which no link is put.
_NO_LINK = frozenset("a h1 h2 h3 h4 h5 h6 script style code pre button figcaption textarea".split())
_MARKUP = re.compile(r"<!--.*?-->|<(/?)([a-zA-Z][\w-]*)\b[^>]*?(/?)>|\[[^\]]+\]", re.DOTALL)


def insert_link(html: str, anchor: str, href: str) -> str | None:
    """The HTML with a link around the first occurrence of a text outside links, headings, code, comments and shortcodes; None if there is none."""
    pattern, open_, at = phrase_pattern(anchor), dict.fromkeys(_NO_LINK, 0), 0
    for m in [*_MARKUP.finditer(html), None]:
        hit = pattern.search(html[at : m.start() if m else len(html)]) if not any(open_.values()) else None
        if hit:
            a, b = at + hit.start(), at + hit.end()
            target = href.replace('"', "&quot;")
            return f'{html[:a]}<a href="{target}">{html[a:b]}</a>{html[b:]}'
        if m:
            tag = (m[2] or "").lower()
            if tag in open_ and not m[3]:
                open_[tag] = max(0, open_[tag] + (-1 if m[1] else 1))
            at = m.end()
    return None


def link_suggestions(pages: DataFrame, links: DataFrame, targets: DataFrame, least: float = 0.08, candidates: int = 60, per_target: int = 5) -> DataFrame:
    """Pages whose text could link to a target that they do not link to yet: target_url, source_url, anchor, context, similarity (per cent).

    ``pages`` holds url, title, h1 and paragraphs; ``targets`` url and queries (a stated set, searched
    against all pages). Per target the ``candidates`` most similar pages are read, and the
    first ``per_target`` of them that hold one of its anchors are suggested.
    """
    text = F.concat_ws(" ", "title", "h1", F.array_join("paragraphs", " "))
    vectors = cut_lineage(tfidf(pages.select("url", text.alias("text")), "url", "text"))
    wanted = targets.select(F.col("url").alias("target_url"), "queries").join(pages.select(F.col("url").alias("target_url"), F.col("title").alias("_t"), F.col("h1").alias("_h")), "target_url")
    near = cosine_to_queries(vectors, vectors.join(wanted.select(F.col("target_url").alias("url")), "url", "left_semi"), "url", least).withColumnsRenamed({"query": "target_url", "url": "source_url"})
    key = lambda c: url_key(F.col(c))
    linked = links.select(key("source_url").alias("_s"), key("target_url").alias("_d")).distinct()
    free = near.withColumns({"_s": key("source_url"), "_d": key("target_url")}).join(linked, ["_s", "_d"], "left_anti")
    best = Window.partitionBy("target_url").orderBy(F.desc(F.round("cosine", 9)), "source_url")
    some = free.withColumn("_n", F.row_number().over(best)).filter(F.col("_n") <= candidates)
    rows = some.join(wanted, "target_url").join(pages.select(F.col("url").alias("source_url"), "paragraphs"), "source_url")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for target, source, cosine, n, title, h1, queries, texts in pdf[["target_url", "source_url", "cosine", "_n", "_t", "_h", "queries", "paragraphs"]].itertuples(index=False):
                hit = find_phrase(list(texts) if texts is not None else [], anchor_candidates(title, h1, list(queries) if queries is not None else []))
                if hit:
                    out.append((target, source, hit[1], hit[2], int(cosine * 100 + 0.5), n))
            yield pd.DataFrame(out, columns=["target_url", "source_url", "anchor", "context", "similarity", "_n"])

    found = rows.select("target_url", "source_url", "cosine", "_n", "_t", "_h", "queries", "paragraphs").mapInPandas(read, "target_url string, source_url string, anchor string, context string, similarity int, _n int")
    place = F.row_number().over(Window.partitionBy("target_url").orderBy("_n"))
    return found.withColumn("_k", place).filter(F.col("_k") <= per_target).drop("_n", "_k")


# ------------------------------------------------------------------ redirects
# Words of addresses that say nothing.
_NOISE = ["html", "htm", "php", "aspx", "asp", "index", "www", "amp", "page", "pagina"]


def url_terms(path: Column) -> Column:
    """Distinct telling words of a path."""
    return F.array_distinct(F.filter(terms(F.regexp_replace(F.coalesce(F.try_url_decode(path), path), "[-_./+]+", " ")), lambda w: ~w.isin(_NOISE)))


def _path(url: Column) -> Column:
    return F.when(is_absolute(url), F.regexp_replace(path_only(path_of(url)), "/+$", "")).otherwise(F.lit(""))


def _parent(url: Column) -> Column:
    folder = F.regexp_extract(_path(url), "^(.*/)[^/]*$", 1)
    return F.when(folder == "", "/").otherwise(folder)


def redirect_map(broken: DataFrame, live: DataFrame, home: str, alike: DataFrame | None = None) -> DataFrame:
    """The best live page for each broken address: from_url, to_url, score, confidence (high, medium, low), reason.

    ``broken`` holds url and old_title (null if not known), ``live`` url and title; ``alike`` url, live_url
    and cosine of old and live texts. Words of the last part of the address count 0.55,
    those of address and old title against the live title 0.35, the same folder 0.1.
    Pages meet on shared words, for without one no score reaches the least of 0.2; then
    the folder above is proposed if it is a live page, else the start page.
    """
    leaf = F.regexp_extract(_path(F.col("url")), "([^/]*)$", 1)
    own = F.when(leaf != "", url_terms(leaf)).otherwise(url_terms(_path(F.col("url"))))
    old = broken.select(F.col("url").alias("from_url"), own.alias("_b"), F.array_union(own, F.array_distinct(terms(F.coalesce("old_title", F.lit(""))))).alias("_bt"), _parent(F.col("url")).alias("_bp"))
    new = live.select(F.col("url").alias("to_url"), url_terms(_path(F.col("url"))).alias("_c"), F.array_distinct(terms(F.coalesce("title", F.lit("")))).alias("_ct"), _parent(F.col("url")).alias("_cp"))
    meet = old.select("from_url", F.explode("_bt").alias("_w")).join(new.select("to_url", F.explode(F.array_union("_c", "_ct")).alias("_w")), "_w").select("from_url", "to_url").distinct()
    if alike is not None:
        meet = meet.unionByName(alike.select(F.col("url").alias("from_url"), F.col("live_url").alias("to_url"))).distinct()
    rows = meet.filter("from_url <> to_url").join(old, "from_url").join(new, "to_url")
    words = 0.55 * jaccard(F.col("_b"), F.col("_c")) + 0.35 * jaccard(F.col("_bt"), F.col("_ct")) + F.when(F.col("_bp") == F.col("_cp"), 0.1).otherwise(0.0)
    if alike is not None:
        rows = rows.join(alike.select(F.col("url").alias("from_url"), F.col("live_url").alias("to_url"), "cosine"), ["from_url", "to_url"], "left")
        text = F.coalesce("cosine", F.lit(0.0))
    else:
        text = F.lit(0.0)
    scored = rows.select("from_url", "to_url", F.round(F.greatest(words, text), 9).alias("score"), F.when(text > words, "text").otherwise("words").alias("reason"))
    best = scored.groupBy("from_url").agg(F.min(F.struct((-F.col("score")).alias("s"), "to_url", "reason")).alias("_m"))
    folders = live.select(F.regexp_replace(F.concat(_path(F.col("url")), F.lit("/")), "/+$", "/").alias("_folder"), "url").groupBy("_folder").agg(F.min("url").alias("_up"))
    j = old.select("from_url", "_bp").join(best, "from_url", "left").join(folders.filter("_folder <> '/'"), F.col("_bp") == F.col("_folder"), "left")
    score = -F.col("_m.s")
    good = F.coalesce(score >= 0.2, F.lit(False))
    return j.select(
        "from_url", F.when(good, F.col("_m.to_url")).otherwise(F.coalesce("_up", F.lit(home))).alias("to_url"), F.when(good, round_up(score * 100)).when(F.col("_up").isNotNull(), 15).otherwise(0).cast("int").alias("score"),
        F.when(good & (score >= 0.5), "high").when(good & (score >= 0.3), "medium").otherwise("low").alias("confidence"), F.when(good, F.col("_m.reason")).when(F.col("_up").isNotNull(), "folder").otherwise("home").alias("reason"),
    )


def broken_urls(**sources: DataFrame) -> DataFrame:
    """Broken addresses of several sources by key: url (the smallest spelling), sources, and the sums of their measures.

    Each source holds url and any of inlinks, bot_hits, impressions, backlinks.
    """
    names = ("inlinks", "bot_hits", "impressions", "backlinks")
    parts = [df.select("url", F.lit(name).alias("_s"), *((F.col(n) if n in df.columns else F.lit(0)).cast("long").alias(n) for n in names)) for name, df in sources.items()]
    return reduce(DataFrame.unionByName, parts).groupBy(url_key(F.col("url")).alias("_k")).agg(F.min("url").alias("url"), F.array_sort(F.collect_set("_s")).alias("sources"), *(F.sum(n).alias(n) for n in names)).drop("_k")


# ------------------------------------------------------------------ rendering
def render_report(pages: DataFrame) -> DataFrame:
    """What scripts change on each rendered page: url, raw_words, words, text_loss (per cent), changed fields, js_only_links, js_errors.

    Pages hold title, h1, canonical, robots_meta, word_count, and the raw_ fields, js_only_links and js_errors.
    """
    same = lambda a, b: F.trim(F.regexp_replace(F.coalesce(a, F.lit("")), r"\s+", " ")) == F.trim(F.regexp_replace(F.coalesce(b, F.lit("")), r"\s+", " "))
    changed = F.array_compact(F.array(*(F.when(~same(f"raw_{c}", c), c) for c in ("title", "h1", "canonical", "robots_meta"))))
    loss = F.when(F.col("word_count") > 0, F.greatest(F.lit(0), round_up((1 - F.col("raw_word_count") / F.col("word_count")) * 100).cast("int"))).otherwise(0)
    size = lambda c: F.coalesce(F.size(c), F.lit(0))
    return pages.filter("raw_word_count IS NOT NULL").select("url", F.col("raw_word_count").alias("raw_words"), F.col("word_count").alias("words"), loss.alias("text_loss"), changed.alias("changed"), size("js_only_links").alias("js_only_links"), size("js_errors").alias("js_errors"))


def render_totals(report: DataFrame) -> DataFrame:
    """Counters of a rendering report: one row."""
    return report.agg(
        F.count("*").alias("pages"), round_up(F.coalesce(F.avg("text_loss"), F.lit(0.0)), 1).alias("mean_loss"), F.count_if(F.col("text_loss") >= 30).alias("over_30"), F.count_if((F.col("raw_words") < 50) & (F.col("words") >= 150)).alias("empty_without_js"),
        F.coalesce(F.sum("js_only_links"), F.lit(0)).cast("long").alias("js_only_links"), F.count_if(F.size("changed") > 0).alias("changed"), F.count_if(F.col("js_errors") > 0).alias("with_errors"),
    )


def link_differences(rendered: Column, raw: Column) -> Column:
    """Links only in the rendered page and only in the raw one."""
    none = F.array().cast("array<string>")
    a, b = F.coalesce(rendered, none), F.coalesce(raw, none)
    return F.struct(F.array_sort(F.array_except(a, b)).alias("js_only"), F.array_sort(F.array_except(b, a)).alias("raw_only"))


# ------------------------------------------------------------------ duplicates
def duplicate_groups(texts: DataFrame, info: DataFrame, least: float = 0.85, exact_words: int = 20, near_words: int = 50) -> DataFrame:
    """Pages in groups of equal and of similar texts, each with the page to keep: kind (exact or near), keeper, url, status.

    ``texts`` holds url and words (an array); ``info`` url, clicks, impressions, inlinks, canonical, is_indexable. Kept is
    the page with most clicks, then links, then the shorter and smaller address. A page
    is resolved if it is not indexed or names the kept one as canonical. Near groups hold
    one page for each text, and similarity is exact (sequences of five words).
    """
    meta = info.select("url", F.coalesce("clicks", F.lit(0)).alias("clicks"), F.coalesce("inlinks", F.lit(0)).alias("inlinks"), "canonical", F.coalesce("is_indexable", F.lit(True)).alias("is_indexable"))
    hashed = texts.select("url", F.size("words").alias("n"), F.md5(F.array_join("words", " ")).alias("_d"), "words").join(meta, "url", "left")
    order = F.struct((-F.coalesce("clicks", F.lit(0))).alias("c"), (-F.coalesce("inlinks", F.lit(0))).alias("l"), F.length("url").alias("s"), "url")

    def advised(groups: DataFrame, kind: str) -> DataFrame:
        keeper = groups.groupBy("_g").agg(F.min(order).alias("_k"), F.count("*").alias("_size")).filter("_size > 1").select("_g", F.col("_k.url").alias("keeper"))
        done = ~F.coalesce("is_indexable", F.lit(True)) | F.coalesce(url_key(F.col("canonical")) == url_key(F.col("keeper")), F.lit(False))
        rows = groups.join(keeper, "_g").filter(F.col("url") != F.col("keeper"))
        return rows.select(F.lit(kind).alias("kind"), "keeper", "url", F.when(done, "resolved").otherwise("open").alias("status"))

    exact = hashed.filter(F.col("n") >= exact_words).withColumn("_g", F.col("_d"))
    long = hashed.filter(F.col("n") >= near_words)
    alone = long.groupBy("_d").agg(F.min(order).alias("_k")).select(F.col("_k.url").alias("url"))
    near = near_duplicates(long.join(alone, "url", "left_semi").select("url", "words"), "url", "words", least).filter("links > 0 OR `group` <> url").select("url", F.col("group").alias("_g"))
    return advised(exact, "exact").unionByName(advised(near.join(hashed, "url"), "near"))


def thin_pages(texts: DataFrame, info: DataFrame, least_words: int = 200) -> DataFrame:
    """Indexable pages of fewer words: url, words."""
    return texts.select("url", F.size("words").alias("words")).filter(F.col("words") < least_words).join(info.filter("is_indexable").select("url"), "url", "left_semi")


# ------------------------------------------------------------------ pages from templates
def fill(template: Column, row: Column) -> tuple[Column, Column]:
    """A template with its variables ({{name}}) put in from a map, escaped for HTML, and the names that are missing or empty."""
    from almena.functions.text import html_escape

    names = F.array_distinct(F.regexp_extract_all(template, F.lit(r"\{\{\s*([\w.-]+)\s*\}\}"), 1))
    value = lambda n: F.coalesce(F.try_element_at(row, n), F.lit(""))
    done = F.aggregate(names, template, lambda text, n: F.regexp_replace(text, F.concat(F.lit(r"\{\{\s*"), F.regexp_replace(n, r"([.\-])", r"\\$1"), F.lit(r"\s*\}\}")), F.regexp_replace(html_escape(value(n)), r"([\\$])", r"\\$1")))
    return done, F.filter(names, lambda n: F.trim(value(n)) == "")


def generated(rows: DataFrame, templates: DataFrame, taken: DataFrame | None = None) -> DataFrame:
    """Pages of all templates for all rows: template_id, row_no, slug, title, content, missing; the first row of a slug only, and no slug that is taken.

    ``rows`` holds row_no and data (a map); ``templates`` template_id, title_template, body_template, slug_template.
    """
    from almena.functions.text import slug

    both = rows.crossJoin(F.broadcast(templates))  # templates are a small, fixed set
    title, t_missing = fill(F.col("title_template"), F.col("data"))
    body, b_missing = fill(F.col("body_template"), F.col("data"))
    name, s_missing = fill(F.col("slug_template"), F.col("data"))
    made = both.select("template_id", "row_no", slug(name).alias("slug"), title.alias("title"), body.alias("content"), F.array_sort(F.array_distinct(F.concat(t_missing, b_missing, s_missing))).alias("missing"))
    first = made.withColumn("_n", F.row_number().over(Window.partitionBy("slug").orderBy("row_no", "template_id"))).filter("_n = 1 AND slug <> ''").drop("_n")
    return first.join(taken.select("slug").distinct(), "slug", "left_anti").select(first.columns) if taken is not None else first
