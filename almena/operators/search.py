"""Search, traffic and link reports: conflicts, decline, topics, results pages, gaps, engines, backlinks."""

from __future__ import annotations

import re
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from almena.functions.text import fold_text, jaccard, norm_query, ratio, round_up
from almena.functions.url import domain_of, owns, url_key


def _tokens(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.regexp_replace(fold_text(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", " "), " "), lambda w: F.length(w) > 2))


def conflicts(rows: DataFrame, least_impressions: int = 30, least_share: float = 0.1) -> tuple[DataFrame, DataFrame]:
    """Queries for which several pages compete, and pairs of pages that do so for two queries or more.

    ``rows`` holds query, page, clicks, impressions, position. Conflicts: query,
    impressions, clicks, pages, winner, runner_up, share (of the runner-up, in whole
    per cent), severity (high, medium, low). Pairs: page_a < page_b, queries, impressions;
    a query pairs all pages that compete for it, of which there are at most one in
    ``least_share``. Spellings of a query that fold alike are one.
    """
    pages = rows.groupBy(norm_query(F.col("query").cast("string")).alias("query"), "page").agg(
        F.sum("clicks").alias("clicks"), F.sum("impressions").alias("impressions"), F.sum(F.col("position") * F.col("impressions")).alias("_w")
    )
    whole = Window.partitionBy("query")
    shared = pages.withColumn("_total", F.sum("impressions").over(whole)).withColumn("_clicks", F.sum("clicks").over(whole))
    near = shared.filter((F.col("_total") >= least_impressions) & (F.col("impressions") >= least_share * F.col("_total")) & (F.col("impressions") >= 5)).select(
        "query", "page", "clicks", "impressions", "_total", "_clicks", round_up(F.col("impressions") / F.col("_total") * 100).cast("long").alias("share"), round_up(F.col("_w") / F.col("impressions"), 1).alias("position")
    )
    order = F.array_sort(F.collect_list(F.struct((-F.col("clicks")).alias("c"), (-F.col("impressions")).alias("i"), "page", "share", "position")))
    grouped = near.groupBy("query").agg(F.max("_total").alias("impressions"), F.max("_clicks").alias("clicks"), order.alias("_p"), F.min("position").alias("_best")).filter(F.size("_p") > 1)
    first, second = F.get("_p", F.lit(0)), F.get("_p", F.lit(1))
    even = (second["share"] >= 30) & (F.abs(first["position"] - second["position"]) <= 10) & (F.col("_best") <= 20)
    found = grouped.select(
        "query", "impressions", "clicks", F.size("_p").alias("pages"), first["page"].alias("winner"), second["page"].alias("runner_up"), second["share"].alias("share"),
        F.when(even, "high").when(second["share"] >= 20, "medium").otherwise("low").alias("severity"), F.transform("_p", lambda p: p["page"]).alias("_all"),
    )
    both = found.select("query", "impressions", F.explode("_all").alias("page_a"), "_all").select("query", "impressions", "page_a", F.explode("_all").alias("page_b")).filter("page_a < page_b")
    pairs = both.groupBy("page_a", "page_b").agg(F.count("*").alias("queries"), F.sum("impressions").alias("impressions")).filter("queries > 1")
    return found.drop("_all"), pairs


def declining(months: DataFrame, least_clicks: int = 30, least_drop: float = 0.2) -> DataFrame:
    """Pages that lost clicks: the last three months with data against the three before.

    ``months`` holds page, month (yyyy-MM), clicks, impressions, position; two spellings of
    a page are added up. Result: page, before, after, lost, drop (per cent),
    position_before, position_after, year_ago (null if a month is missing then), seasonal
    (within a tenth of last year), streak (months falling in a row), reasons.
    """
    key = F.coalesce(url_key(F.col("page").cast("string")), F.col("page").cast("string")).alias("page")
    m = months.groupBy(key, "month").agg(F.sum("clicks").alias("clicks"), F.sum("impressions").alias("impressions"), F.sum(F.col("position") * F.col("impressions")).alias("_w"))
    known = months.select("month").distinct().agg(F.array_sort(F.collect_list("month")).alias("_months"))  # a row a month
    at = lambda first, n: F.slice("_months", first, n)
    last3, prev3 = at(-3, 3), F.when(F.size("_months") >= 6, at(-6, 3)).otherwise(F.slice("_months", 1, F.greatest(F.size("_months") - 3, F.lit(0))))
    year = F.transform(last3, lambda x: F.concat((F.substring(x, 1, 4).cast("int") - 1).cast("string"), F.substring(x, 5, 3)))
    period = known.filter(F.size("_months") >= 4).select("_months", last3.alias("_now"), prev3.alias("_then"), year.alias("_year"), (F.size(F.array_except(year, F.col("_months"))) == 0).alias("_has_year"))
    rows = m.crossJoin(F.broadcast(period))
    within = lambda name, value: F.sum(F.when(F.array_contains(name, F.col("month")), F.col(value)).otherwise(0))
    sums = rows.groupBy("page").agg(
        within("_then", "clicks").alias("before"), within("_now", "clicks").alias("after"), within("_year", "clicks").alias("_y"), F.first("_has_year").alias("_has_year"), F.first("_months").alias("_months"),
        within("_then", "impressions").alias("_ib"), within("_now", "impressions").alias("_ia"), within("_then", "_w").alias("_wb"), within("_now", "_w").alias("_wa"), F.map_from_entries(F.collect_list(F.struct("month", "clicks"))).alias("_by"),
    )
    lost = sums.filter((F.col("before") >= least_clicks) & ((F.col("before") - F.col("after")) / F.col("before") >= least_drop))
    series = F.transform("_months", lambda x: F.coalesce(F.try_element_at("_by", x), F.lit(0)))
    falls = F.transform(F.sequence(F.lit(2), F.size("_months")), lambda i: F.element_at(series, i) < F.element_at(series, i - 1))
    streak = F.aggregate(falls, F.lit(0), lambda n, down: F.when(down, n + 1).otherwise(0))
    pb, pa = F.try_divide("_wb", "_ib"), F.try_divide("_wa", "_ia")
    moved = F.coalesce(pa - pb >= 2, F.lit(False))
    fewer = (F.col("_ib") > 0) & ((F.col("_ib") - F.col("_ia")) >= 0.2 * F.col("_ib"))
    cb, ca = ratio(F.col("before"), F.col("_ib")), ratio(F.col("after"), F.col("_ia"))
    rate = (cb > 0) & ((cb - ca) >= 0.2 * cb) & (F.col("_ia") >= 0.8 * F.col("_ib"))
    reasons = F.array_compact(F.array(F.when(moved, "position"), F.when(fewer & ~moved, "demand"), F.when(rate, "click_rate")))
    year_ago = F.when(F.col("_has_year"), F.col("_y"))
    return lost.select(
        "page", "before", "after", (F.col("before") - F.col("after")).alias("lost"), round_up((F.col("before") - F.col("after")) / F.col("before") * 100).cast("int").alias("drop"),
        round_up(pb, 1).alias("position_before"), round_up(pa, 1).alias("position_after"), year_ago.alias("year_ago"), F.coalesce((year_ago > 0) & (F.col("after") >= 0.9 * year_ago), F.lit(False)).alias("seasonal"),
        streak.alias("streak"), F.when(F.size(reasons) == 0, F.array(F.lit("unknown"))).otherwise(reasons).alias("reasons"),
    )


# Words that say nothing about the topic of a query, in Spanish and English.
TOPIC_STOP = frozenset(
    "a al algo algun alguna como con cual cuales cuando de del desde donde el ella en entre es esa ese eso esta este esto hay la las le lo los mas me mi mis muy no o para pero por que se si sin sobre su sus te tu un una uno unos y ya "
    "the of and for to in on with what how is are a an or best mejor mejores".split()
)


def topic_tokens(query: str) -> list[str]:
    """Distinct stems of a query's telling words, in order."""
    import unicodedata

    folded = "".join(c for c in unicodedata.normalize("NFD", query.lower()) if not unicodedata.combining(c))
    words = [w for w in re.findall("[a-z0-9]+", folded) if len(w) > 1 and w not in TOPIC_STOP]
    return list(dict.fromkeys(w[:-2] if len(w) > 5 and w.endswith("es") else w[:-1] if len(w) > 4 and w.endswith("s") else w for w in words))


def topics(rows: DataFrame, by: str = "site_id", most: int = 5000) -> DataFrame:
    """Search queries in topics, greedily: the largest query leads, others join the leader they share most words with.

    ``rows`` holds a site, query, page, clicks, impressions, position. A query joins at a
    similarity of words of 0.5, or of 0.25 (counted 0.25 higher) if its main page ranks for
    the topic. Per site the ``most`` queries with most impressions take part, which bounds a
    group. Result: site, topic (the leader), queries, clicks, impressions, position,
    target, target_share, pages, opportunity, status (clear, scattered, no_strong_page).
    """
    per_page = rows.groupBy(by, norm_query(F.col("query")).alias("query"), "page").agg(F.sum("clicks").alias("clicks"), F.sum("impressions").alias("impressions"), F.sum(F.col("position") * F.col("impressions")).alias("w"))
    total = F.sum("impressions").over(Window.partitionBy(by, "query"))
    ranked = per_page.withColumn("total", total).withColumn("_n", F.dense_rank().over(Window.partitionBy(by).orderBy(F.desc("total"), "query"))).filter(F.col("_n") <= most).drop("_n")
    kind = dict(rows.dtypes)[by]
    page_kind = dict(rows.dtypes)["page"]

    def cluster(pdf: pd.DataFrame) -> pd.DataFrame:
        queries = [(q, g.sort_values(["impressions", "page"], ascending=[False, True])) for q, g in pdf.sort_values(["total", "query"], ascending=[False, True]).groupby("query", sort=False)]
        heads: list[set[str]] = []
        members: list[list[str]] = []
        ranks: list[set] = []
        index: dict[str, list[int]] = {}
        for query, pages in queries:
            own = topic_tokens(query)
            score, at = 0.0, -1
            for i in sorted({i for w in own for i in index.get(w, ())}):
                shared = len(heads[i].intersection(own))
                j = shared / (len(heads[i]) + len(own) - shared)
                s = j if j >= 0.5 else j + 0.25 if j >= 0.25 and pages["page"].iloc[0] in ranks[i] else 0.0
                if s > score:
                    score, at = s, i
            if at < 0:
                at = len(heads)
                heads.append(set(own))
                members.append([])
                ranks.append(set())
                for w in own:
                    index.setdefault(w, []).append(at)
            members[at].append(query)
            ranks[at].update(pages["page"])
        topic = {q: m[0] for m in members for q in m}
        out = pdf[[by, "query", "page", "clicks", "impressions", "w"]].copy()
        out.insert(1, "topic", pdf["query"].map(topic))
        return out

    named = ranked.groupBy(by).applyInPandas(cluster, f"{by} {kind}, topic string, query string, page {page_kind}, clicks long, impressions long, w double")
    each = named.groupBy(by, "topic", "query").agg(F.sum("clicks").alias("clicks"), F.sum("impressions").alias("impressions"), F.sum("w").alias("w"))
    place = ratio(F.col("w"), F.col("impressions"))
    whole = each.groupBy(by, "topic").agg(F.count("*").alias("queries"), F.sum("clicks").alias("clicks"), F.sum("impressions").alias("impressions"), F.sum("w").alias("_w"), F.sum(F.when(place.between(4, 20), F.col("impressions")).otherwise(0)).alias("opportunity"))
    pages = named.groupBy(by, "topic", "page").agg(F.sum("clicks").alias("c"), F.sum("impressions").alias("i"))
    best = pages.groupBy(by, "topic").agg(F.count("*").alias("pages"), F.min(F.struct((-F.col("c")).alias("c"), (-F.col("i")).alias("i"), "page")).alias("_p"))
    share = round_up(F.try_divide(-F.col("_p.i") * 100.0, F.col("impressions")))
    position = ratio(F.col("_w"), F.col("impressions"))
    joined = whole.join(best, [by, "topic"]).filter("queries >= 2 OR impressions >= 100")
    status = F.when(position > 20, "no_strong_page").when((share < 70) & (F.col("pages") > 1), "scattered").otherwise("clear")
    return joined.select(by, "topic", "queries", "clicks", "impressions", round_up(position, 1).alias("position"), F.col("_p.page").alias("target"), share.cast("int").alias("target_share"), "pages", "opportunity", status.alias("status"))


# Sources of visits from answer engines, by product, in order.
ENGINES = {
    "ChatGPT": r"(^|\.)(chatgpt\.com|chat\.openai\.com|openai\.com)$|^chatgpt", "Perplexity": r"(^|\.)perplexity\.ai$|^perplexity", "Gemini": r"(^|\.)(gemini\.google\.com|bard\.google\.com)$|^gemini",
    "Copilot": r"(^|\.)(copilot\.microsoft\.com|copilot\.cloud\.microsoft)$|^copilot", "Claude": r"(^|\.)claude\.ai$|^claude", "DeepSeek": r"(^|\.)(chat\.)?deepseek\.com$", "Meta AI": r"(^|\.)meta\.ai$",
    "Grok": r"(^|\.)grok\.com$|^grok", "You.com": r"(^|\.)you\.com$", "Phind": r"(^|\.)phind\.com$",
}
MEASURES = ("sessions", "users", "engaged_sessions", "engagement_sec", "key_events", "revenue")


def engine_of(source: Column) -> Column:
    """The answer engine a visit came from, or null."""
    s = F.lower(F.trim(source))
    return reduce(lambda c, x: c.when(s.rlike(x[1]), x[0]), list(ENGINES.items())[1:], F.when(s.rlike(ENGINES["ChatGPT"]), "ChatGPT"))


def measures() -> list[Column]:
    """The six measures of visits added up and the ratios made of them."""
    s = {m: F.sum(m) for m in MEASURES}
    per = lambda m, k, d: round_up(ratio(s[m], s["sessions"]) * k, d)
    return [
        s["sessions"].alias("sessions"), s["users"].alias("users"), per("engaged_sessions", 100, 1).alias("engagement_rate"), per("engagement_sec", 1, 0).cast("long").alias("engagement_sec"),
        round_up(s["key_events"], 1).alias("key_events"), per("key_events", 100, 2).alias("conversion_rate"), round_up(s["revenue"], 2).alias("revenue"),
    ]


def landing_pages(rows: DataFrame, origin: str, search: DataFrame | None = None, titles: DataFrame | None = None) -> DataFrame:
    """Landing pages with their absolute address, measures and, where given, clicks, impressions and title by the address's key.

    ``search`` holds page, clicks, impressions, position and ``titles`` url and title; of
    several rows with one key the last by address counts.
    """
    page = F.col("page")
    url = F.when(page.rlike("(?i)^https?://"), page).when(page.startswith("/"), F.concat(F.lit(origin), page)).otherwise(F.concat(F.lit(f"{origin}/"), page))
    out = rows.groupBy("page").agg(*measures()).withColumn("url", url).withColumn("_key", url_key(F.col("url")))
    if search is not None:
        s = search.groupBy(url_key(F.col("page")).alias("_key")).agg(F.max_by(F.struct("clicks", "impressions", "position"), "page").alias("_s"))
        out = out.join(s, "_key", "left").select(*out.columns, F.col("_s.clicks").alias("clicks"), F.col("_s.impressions").alias("impressions"), round_up(F.col("_s.position"), 1).alias("position"))
    if titles is not None:
        t = titles.groupBy(url_key(F.col("url")).alias("_key")).agg(F.max_by("title", "url").alias("title"))
        out = out.join(t, "_key", "left")
    return out.drop("_key")


def engine_pages(rows: DataFrame) -> DataFrame:
    """Visits from answer engines per page, with the engines of each by sessions: page, measures, engines."""
    named = rows.withColumn("engine", F.coalesce(engine_of(F.col("source")), F.col("source")))
    each = named.groupBy("page", "engine").agg(*(F.sum(m).alias(m) for m in MEASURES))
    order = F.array_sort(F.collect_list(F.struct((-F.col("sessions")).alias("n"), "engine")))
    return each.groupBy("page").agg(*measures(), F.transform(order, lambda e: F.concat(e["engine"], F.lit(":"), (-e["n"]).cast("string"))).alias("engines"))


def low_engagement(pages: DataFrame, least_sessions: int = 20, most_rate: float = 40) -> DataFrame:
    """Landing pages with enough visits of which few engage."""
    return pages.filter((F.col("sessions") >= least_sessions) & (F.col("engagement_rate") < most_rate))


def serp_changes(snapshots: DataFrame, days: int = 21, most: int | None = None) -> DataFrame:
    """Each keyword's last results page against the last one ``days`` or more before it, else the oldest of the newest ``most``.

    ``snapshots`` holds keyword, date, position, features. Result: keyword, last_date,
    position, reference_date, reference_position, added, removed.
    """
    newest = F.row_number().over(Window.partitionBy("keyword").orderBy(F.desc("date")))
    rows = snapshots.dropDuplicates(["keyword", "date"]).withColumn("_n", newest)
    rows = rows.filter(F.col("_n") <= most) if most else rows
    last = Window.partitionBy("keyword")
    aged = rows.withColumn("_last", F.max("date").over(last)).withColumn("_age", F.datediff("_last", "date"))
    pick = lambda when, by: F.max_by(F.when(when, F.struct("date", "position", "features")), F.when(when, by))
    g = aged.groupBy("keyword").agg(
        pick(F.col("_age") == 0, F.col("date")).alias("_l"), F.coalesce(pick(F.col("_age") >= days, F.col("date")), pick(F.col("_age") > 0, F.col("_age"))).alias("_r")
    )
    lf, rf = (F.coalesce(F.col(f"{x}.features"), F.array().cast("array<string>")) for x in ("_l", "_r"))
    none = F.array().cast("array<string>")
    return g.select(
        "keyword", F.col("_l.date").alias("last_date"), F.col("_l.position").alias("position"), F.col("_r.date").alias("reference_date"), F.col("_r.position").alias("reference_position"),
        F.when(F.col("_r").isNotNull(), F.array_except(lf, rf)).otherwise(none).alias("added"), F.when(F.col("_r").isNotNull(), F.array_except(rf, lf)).otherwise(none).alias("removed"),
    )


def serp_insights(changes: DataFrame, days: DataFrame) -> DataFrame:
    """What explains lost clicks of a keyword: its last 28 days with data in all against the 28 before.

    ``days`` holds query, date, clicks, impressions, position. Adds clicks, clicks_before,
    click_change (per cent, from ten clicks on) and cause: new_blocks (place kept, blocks
    added), position (1.5 places or more lost), demand (place kept, nothing new), or null.
    """
    end = days.agg(F.max("date").alias("_end"))
    age = F.datediff("_end", "date")
    spans = {"now": age.between(0, 27), "before": age.between(28, 55)}
    d = days.crossJoin(F.broadcast(end)).groupBy(norm_query(F.col("query")).alias("_q")).agg(
        *(F.sum(F.when(w, F.col(c))).alias(f"_{c}_{n}") for n, w in spans.items() for c in ("clicks", "impressions")), *(F.sum(F.when(w, F.col("position") * F.col("impressions"))).alias(f"_w_{n}") for n, w in spans.items())
    )
    j = changes.withColumn("_q", norm_query(F.col("keyword"))).join(d, "_q", "left")
    change = F.when(F.col("_clicks_before") >= 10, round_up((F.col("_clicks_now") - F.col("_clicks_before")) / F.col("_clicks_before") * 100).cast("int"))
    then = F.coalesce(round_up(F.try_divide("_w_before", "_impressions_before"), 1), F.col("reference_position").cast("double"))
    now = F.coalesce(round_up(F.try_divide("_w_now", "_impressions_now"), 1), F.col("position").cast("double"))
    kept = F.coalesce(F.abs(now - then) < 1.5, F.lit(False))
    cause = F.when(change > -30, None).when(change.isNull(), None).when(kept & (F.size("added") > 0), "new_blocks").when(now - then >= 1.5, "position").when(kept, "demand")
    return j.select(*changes.columns, F.col("_clicks_now").alias("clicks"), F.col("_clicks_before").alias("clicks_before"), change.alias("click_change"), cause.alias("cause"))


def feature_share(changes: DataFrame, features: DataFrame) -> DataFrame:
    """Share of keywords whose last results page has each block: feature, keywords, share in per cent. ``features`` holds keyword, date, features."""
    last = features.join(changes.select("keyword", F.col("last_date").alias("date")), ["keyword", "date"]).dropDuplicates(["keyword"])
    total = last.agg(F.count("*").alias("_n"))
    each = last.select("keyword", F.explode(F.array_distinct("features")).alias("feature")).groupBy("feature").agg(F.count("*").alias("keywords"))
    return each.crossJoin(F.broadcast(total)).select("feature", "keywords", round_up(F.col("keywords") / F.col("_n") * 100).cast("int").alias("share"))


def gaps(results: DataFrame, own_host: str, competitors: list[str], search: DataFrame | None = None) -> DataFrame:
    """Keywords by where competitors stand in the first ten results: keyword, own_position, search_position, competitors, kind, score, urls.

    ``results`` holds keyword, position, url; ``search`` query, position, impressions. A domain
    owns its subdomains. Kinds: missing, weak, win, none.
    """
    top = results.filter(F.col("position") <= 10).withColumn("_d", domain_of(F.col("url")))
    which = reduce(lambda c, x: c.when(owns(F.col("_d"), F.lit(x)), x), competitors[1:], F.when(owns(F.col("_d"), F.lit(competitors[0])), competitors[0]))
    named = top.withColumn("_c", which)
    first = named.filter("_c IS NOT NULL").groupBy("keyword", "_c").agg(F.min("position").alias("_p")).groupBy("keyword").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("_c", "_p")))).alias("competitors"), F.min("_p").alias("_best"), F.sum(11 - F.col("_p")).alias("score"))
    base = named.groupBy("keyword").agg(F.min(F.when(owns(F.col("_d"), F.lit(own_host)), F.col("position"))).alias("own_position"), F.array_sort(F.collect_set("url")).alias("urls"))
    out = base.join(first, "keyword", "left").withColumn("_q", norm_query(F.col("keyword")))
    if search is None:
        out = out.withColumn("search_position", F.lit(None).cast("double"))
    else:
        s = search.groupBy(norm_query(F.col("query")).alias("_q")).agg(F.min("position").cast("double").alias("search_position"))
        out = out.join(s, "_q", "left")
    own, best = F.col("own_position"), F.col("_best")
    unseen = own.isNull() & (F.coalesce("search_position", F.lit(99.0)) > 20)
    kind = F.when(best.isNull() & own.isNotNull(), "win").when(best.isNull(), "none").when(own < best, "win").when(unseen, "missing").otherwise("weak")
    return out.select("keyword", "own_position", "search_position", "competitors", kind.alias("kind"), F.coalesce("score", F.lit(0)).cast("int").alias("score"), "urls")


def gap_clusters(found: DataFrame, by: str | None = None, shared: int = 3, most: int = 1000) -> DataFrame:
    """Gap keywords that share ``shared`` results or more with the group's leader, the strongest leading: [by,] keyword, lead.

    Per analysis the ``most`` strongest keywords take part, which bounds a group.
    """
    wanted = found.filter("kind IN ('missing', 'weak')").withColumn("_by", F.col(by).cast("string") if by else F.lit(""))
    placed = wanted.withColumn("_n", F.row_number().over(Window.partitionBy("_by").orderBy(F.desc("score"), "keyword"))).filter(F.col("_n") <= most)

    def cluster(pdf: pd.DataFrame) -> pd.DataFrame:
        leads: list[tuple[str, set[str]]] = []
        out = []
        for keyword, urls in pdf.sort_values("_n")[["keyword", "urls"]].itertuples(index=False):
            own = set(urls)
            lead = next((k for k, u in leads if len(u & own) >= shared), None)
            if lead is None:
                leads.append((keyword, own))
                lead = keyword
            out.append((pdf["_by"].iloc[0], keyword, lead))
        return pd.DataFrame(out, columns=["_by", "keyword", "lead"])

    named = placed.select("_by", "_n", "keyword", "urls").groupBy("_by").applyInPandas(cluster, "_by string, keyword string, lead string")
    return named.withColumnRenamed("_by", by) if by else named.drop("_by")


def competitor_summary(found: DataFrame) -> DataFrame:
    """Per competitor: keywords in the first ten, gaps against it, mean position."""
    each = found.select("kind", F.explode("competitors").alias("domain", "position"))
    return each.groupBy("domain").agg(F.count("*").alias("top10"), F.count_if(F.col("kind").isin("missing", "weak")).alias("gaps"), round_up(F.avg("position"), 1).alias("position"))


# Endings of domains and words that many bought links have.
SPAM_ENDINGS = "xyz top click loan work gq tk ml cf ga buzz rest bid win review date stream racing download cricket science party trade webcam accountant faith men".split()
SPAM_WORDS = r"(?i)\b(casino|viagra|cialis|porn|xxx|escort|sex|loan|payday|crypto|bitcoin|forex|bet|apuestas|replica|pharma|pills|seo[- ]?backlinks?|buy[- ]?links?)\b"


def spam_score(source_url: Column, anchor: Column, outlinks: Column) -> Column:
    """Signs of a bought link added up, 0 to 100."""
    d = domain_of(source_url)
    points = {
        20: F.substring_index(d, ".", -1).isin(SPAM_ENDINGS), 15: (F.regexp_count(d, F.lit("-")) >= 3) | d.rlike(r"\d{4,}"),
        40: F.concat_ws(" ", d, source_url, anchor).rlike(SPAM_WORDS), 25: F.coalesce(outlinks, F.lit(0)) >= 150,
    }
    return F.least(F.lit(100), sum((F.when(F.coalesce(w, F.lit(False)), n).otherwise(0) for n, w in points.items()), F.lit(0)))


def backlink_totals(links: DataFrame) -> DataFrame:
    """Counters of a list of links (source_domain, status, rel, target_status, target_hops, spam): one row."""
    live, broken = F.col("status") == "live", F.col("target_status").isin(404, 410)
    rel = lambda x: F.count_if(live & F.coalesce(F.col("rel").contains(x), F.lit(False)))
    return links.agg(
        F.count("*").alias("links"), F.countDistinct("source_domain").alias("domains"), F.count_if(live).alias("live"), F.count_if(F.col("status") == "lost").alias("lost"),
        rel("follow").alias("_f"), F.count_if(live & (F.col("rel") == "follow")).alias("follow"), rel("nofollow").alias("nofollow"), rel("sponsored").alias("sponsored"), rel("ugc").alias("ugc"),
        F.count_if(live & F.coalesce(broken, F.lit(False))).alias("to_broken"), F.count_if(live & (F.coalesce("target_hops", F.lit(0)) > 0)).alias("to_redirect"), F.count_if(F.col("spam") >= 40).alias("suspicious"),
    ).drop("_f")


def backlink_domains(links: DataFrame) -> DataFrame:
    """Per linking domain: links, live, follow, highest spam score."""
    live = F.col("status") == "live"
    return links.groupBy("source_domain").agg(F.count("*").alias("links"), F.count_if(live).alias("live"), F.count_if(live & (F.col("rel") == "follow")).alias("follow"), F.max("spam").alias("spam"))


def backlink_anchors(links: DataFrame) -> DataFrame:
    """Anchors of live links, folded to lower case and 80 characters; an empty one is named so."""
    text = F.left(F.lower(F.coalesce("anchor", F.lit(""))), F.lit(80))
    return links.filter("status = 'live'").groupBy(F.when(text == "", "(empty)").otherwise(text).alias("anchor")).agg(F.count("*").alias("links"))


def rescue(links: DataFrame) -> DataFrame:
    """Targets that answer 404 or 410 and still have live links: target, links, domains, follow."""
    lost = links.filter("status = 'live' AND target_status IN (404, 410) AND target_url IS NOT NULL")
    return lost.groupBy(url_key(F.col("target_url")).alias("target")).agg(F.count("*").alias("links"), F.countDistinct("source_domain").alias("domains"), F.count_if(F.col("rel") == "follow").alias("follow"))


def target_status(links: DataFrame, pages: DataFrame) -> DataFrame:
    """Links with the status their target had in a crawl, by the address's key: null where it was not crawled."""
    known = pages.groupBy(url_key(F.col("url")).alias("_k")).agg(F.max_by("status_code", "url").alias("target_status"))
    return links.drop("target_status").withColumn("_k", url_key(F.col("target_url"))).join(known, "_k", "left").drop("_k")


def title_similarity(a: Column, b: Column) -> Column:
    """Shared words over all words of two titles, words of three letters or more."""
    return jaccard(_tokens(a), _tokens(b))


def consolidation(pairs: DataFrame, stats: DataFrame) -> DataFrame:
    """Pairs of competing or alike pages (page_a, page_b, source) once each, with all sources and the page to keep: most clicks, then links, then the shorter address.

    ``stats`` holds page, clicks, inlinks.
    """
    once = pairs.select(F.least("page_a", "page_b").alias("page_a"), F.greatest("page_a", "page_b").alias("page_b"), "source").groupBy("page_a", "page_b").agg(F.array_sort(F.collect_set("source")).alias("sources"))
    side = lambda x: stats.select(F.col("page").alias(f"page_{x}"), F.struct(F.coalesce("clicks", F.lit(0)).alias("c"), F.coalesce("inlinks", F.lit(0)).alias("l"), (-F.length("page")).alias("s")).alias(f"_{x}"))
    j = once.join(side("a"), "page_a", "left").join(side("b"), "page_b", "left")
    none = lambda x: F.struct(F.lit(0).cast("long").alias("c"), F.lit(0).cast("long").alias("l"), (-F.length(f"page_{x}")).alias("s"))
    full = lambda x: F.coalesce(F.struct(F.col(f"_{x}.c").cast("long").alias("c"), F.col(f"_{x}.l").cast("long").alias("l"), F.col(f"_{x}.s").alias("s")), none(x))
    win = F.when(F.col("_b").isNull() & F.col("_a").isNull(), F.when(none("b") > none("a"), F.col("page_b")).otherwise(F.col("page_a"))).when(F.when(F.col("_b").isNull(), none("b")).otherwise(full("b")) > F.when(F.col("_a").isNull(), none("a")).otherwise(full("a")), F.col("page_b")).otherwise(F.col("page_a"))
    return j.select("page_a", "page_b", "sources", win.alias("keep"))
