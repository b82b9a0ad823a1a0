"""What answer engines and agents can use: page checks, agent checks, trust checks, llms.txt, readability."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from almena.functions.text import round_up
from almena.functions.url import first_folder, host_of, path_of, path_only, url_key
from almena.sources.dom import BLOCKS, by_page, clean, has_class, host_name, main_of, parse, structured, types_of

# Checks of a page with their weights, which sum to 100.
PAGE_CHECKS = {"direct_answer": 15, "question_headings": 10, "structure": 5, "headings": 5, "schema": 15, "author_date": 10, "no_js": 15, "depth": 10, "facts": 5, "sources": 5, "snippet": 5}
_QUESTION = re.compile(r"(?i)^(¿|(qu[eé]|c[oó]mo|cu[aá]l(es)?|cu[aá]nto|cu[aá]ndo|d[oó]nde|por qu[eé]|para qu[eé]|qui[eé]n|what|how|why|when|where|which|who|can|is|are|do|does)(?!\w))")
_WORD = re.compile(r"[^\W_][\w'’-]*")
_FACT = re.compile(r"(?i)\b\d+(?:[.,]\d+)?\s?(?:%|€|\$|usd|mxn|km|kg|cm|mm|m²|años?|meses|días|horas|minutos)|\$\s?\d[\d.,]*|\b(?:19|20)\d{2}\b")
_SOCIAL = re.compile(r"(facebook|twitter|x|instagram|linkedin|youtube|tiktok|pinterest|whatsapp|wa)\.(com|me)$")
_USEFUL = frozenset("Article NewsArticle BlogPosting FAQPage HowTo QAPage Product LocalBusiness Organization Service Recipe Event Course SoftwareApplication Person WebPage".split())
_LOCAL = re.compile("Business|Store|Restaurant|Dentist|Physician|Attorney|Agency")


def grade(score: Column) -> Column:
    return F.when(score >= 80, "excellent").when(score >= 60, "good").when(score >= 40, "fair").otherwise("poor")


def _step(n: float, full: float, half: float = 1) -> float:
    return 1.0 if n >= full else 0.5 if n >= half else 0.0


def page_checks(html: str | None, url: str | None, raw_words: int | None = None, robots_tag: str | None = None) -> dict[str, float]:
    """Each check of ``PAGE_CHECKS`` from 0 to 1; ``raw_words`` are the words without scripts, if they are known."""
    root = parse(html)
    nodes, _ = structured(root)
    types = {t for n in nodes for t in types_of(n)}
    metas = root.find("meta")
    meta = lambda *names: [m.attrs.get("content", "") for m in metas if (m.attrs.get("name") or m.attrs.get("property") or "").lower() in names]
    root.drop(lambda n: n.tag in ("script", "style", "noscript", "template", "svg"))
    h1, h2 = len(root.find("h1")), len(root.find("h2"))
    byline = any(n.attrs.get("rel") == "author" or n.attrs.get("itemprop") == "author" or has_class(n, "author", "byline") for n in root.walk())
    dated = any(n.attrs.get("datetime") for n in root.find("time"))
    main = main_of(root)
    main.drop(lambda n: n.tag in ("nav", "header", "footer", "aside", "form") or n.attrs.get("role") == "navigation")
    for n in main.walk():  # words of neighbouring blocks do not run together
        if n.tag in BLOCKS or n.tag in ("li", "td", "th", "br"):
            n.children.insert(0, " ")
            n.children.append(" ")
    text = clean(main.text())
    n_words = len(_WORD.findall(text))
    first = next((n for p in main.find("p") if (n := len(_WORD.findall(p.text()))) >= 8), 0)
    subs = [t for n in main.find("h2", "h3") if (t := clean(n.text()))]
    lists = any(sum(1 for c in n.children if not isinstance(c, str) and c.tag == "li") >= 3 for n in main.find("ul", "ol"))
    hosts = {host_name(a.attrs["href"]) for a in main.find("a") if a.attrs.get("href", "").startswith("http")}
    outside = {h for h in hosts if h and h != host_name(url) and not _SOCIAL.search(h)}
    author = bool([x for x in meta("author") if x]) or byline or any(n.get("author") for n in nodes)
    date = bool(meta("article:published_time", "article:modified_time")) or dated or any(n.get("datePublished") or n.get("dateModified") for n in nodes)
    robots = ",".join([*meta("robots", "googlebot"), robots_tag or ""])
    share = (raw_words / n_words if n_words else 1.0) if raw_words is not None else None
    return {
        "direct_answer": 0.0 if not first else 1.0 if 20 <= first <= 90 else 0.5, "question_headings": _step(sum(t.endswith("?") or bool(_QUESTION.match(t)) for t in subs), 2), "structure": float(lists or bool(main.first("table"))),
        "headings": 0.5 * (h1 == 1) + 0.5 * (h2 >= 2), "schema": 0.0 if not types else 1.0 if any(t in _USEFUL or _LOCAL.search(t) for t in types) else 0.5, "author_date": 0.5 * author + 0.5 * date,
        "no_js": _step(n_words, 150, 50) if share is None else _step(share, 0.7, 0.3), "depth": _step(n_words, 300, 150), "facts": _step(len(_FACT.findall(text)), 3), "sources": _step(len(outside), 2),
        "snippet": 0.0 if re.search(r"(?i)nosnippet|max-snippet\s*:\s*0(?!\d)", robots) else 1.0,
    }


def page_readiness(pages: DataFrame, key: str = "url", html: str = "html", base: str | None = None) -> DataFrame:
    """Checks of each page: key, check, score; a null page fails all but what it cannot fail."""
    return by_page(pages, lambda url, text: [{"check": c, "score": s} for c, s in page_checks(text, url).items()], "check string, score double", key, html, base)


def weighted(checks: DataFrame, weights: dict[str, int], key: str) -> DataFrame:
    """Score of each key from its checks, in per cent of the weights of those that apply (a null score does not): key, score, grade."""
    w = F.create_map(*(F.lit(x) for pair in weights.items() for x in pair))[F.col("check")]
    got = F.sum(F.when(F.col("score").isNotNull(), F.col("score") * w))
    out = checks.groupBy(key).agg(round_up(F.coalesce(F.try_divide(got * 100.0, F.sum(F.when(F.col("score").isNotNull(), w))), F.lit(0.0))).cast("int").alias("score"))
    return out.withColumn("grade", grade(F.col("score")))


def failing_checks(checks: DataFrame, weights: dict[str, int]) -> DataFrame:
    """Checks by what they cost: check, failing (below one), pages, mean score, cost (failing times weight)."""
    w = F.create_map(*(F.lit(x) for pair in weights.items() for x in pair))[F.col("check")]
    g = checks.filter("score IS NOT NULL").groupBy("check").agg(F.count_if(F.col("score") < 1).alias("failing"), F.count("*").alias("pages"), F.round(F.avg("score"), 4).alias("mean"))
    return g.withColumn("cost", (F.col("failing") * w).cast("long"))


def grade_counts(scores: DataFrame) -> DataFrame:
    return scores.groupBy("grade").agg(F.count("*").alias("pages"), F.round(F.avg("score"), 2).alias("mean"))


# Checks of a page for agents with their weights.
AGENT_CHECKS = {"semantic_controls": 20, "named_controls": 15, "form_labels": 20, "no_blocking_overlay": 15, "no_captcha": 10, "machine_readable_offer": 10, "clear_action": 10}
AGENT_FACTS = (
    "url string, fake_buttons int, unnamed_controls int, forms array<struct<fields:array<struct<type:string,name:string,label:string>>,submit:string>>, overlays array<struct<role:string,modal:boolean,close_name:string>>, "
    "captcha array<string>, prices array<string>, offer_schema boolean, actions array<struct<text:string,semantic:boolean>>"
)


def agent_checks(facts: DataFrame) -> DataFrame:
    """Checks of pages for agents from what a browser saw (``AGENT_FACTS``): url, check, score (null: does not apply)."""
    c = F.col
    few = lambda n: F.when(c(n) == 0, 1.0).when(c(n) <= 3, 0.5).otherwise(0.0)
    filled = lambda x: F.coalesce(F.trim(x), F.lit("")) != ""
    fields = F.flatten(F.transform("forms", lambda f: f["fields"]))
    n, labelled = F.size(fields), F.size(F.filter(fields, lambda f: filled(f["label"])))
    about = lambda f: F.concat_ws(" ", f["name"], f["label"])
    untyped = F.exists(fields, lambda f: about(f).rlike("(?i)mail|correo") & (F.coalesce(f["type"], F.lit("")) != "email"))
    sent = F.forall("forms", lambda f: filled(f["submit"]))
    ratio = F.coalesce(F.try_divide(labelled.cast("double"), n.cast("double")), F.lit(1.0))
    forms = F.when(F.size("forms") == 0, F.lit(None)).when((ratio == 1) & sent & ~untyped, 1.0).when((ratio >= 0.5) & sent, 0.5).otherwise(0.0)
    blocking = F.filter("overlays", lambda o: ~F.coalesce(filled(o["close_name"]) & (o["role"].isin("dialog", "alertdialog") | o["modal"]), F.lit(False)))
    overlay = F.when(F.size(blocking) == 0, 1.0).when(F.forall(blocking, lambda o: filled(o["close_name"])), 0.5).otherwise(0.0)
    prices, actions = F.size("prices") > 0, F.size("actions") > 0
    scores = {
        "semantic_controls": few("fake_buttons"), "named_controls": few("unnamed_controls"), "form_labels": forms, "no_blocking_overlay": overlay, "no_captcha": F.when(F.size("captcha") > 0, 0.5).otherwise(1.0),
        "machine_readable_offer": F.when(prices & c("offer_schema"), 1.0).when(prices | c("offer_schema"), 0.5).when(actions, 0.0), "clear_action": F.when(F.exists("actions", lambda a: a["semantic"]), 1.0).when(actions, 0.5).otherwise(0.0),
    }
    return facts.select("url", F.explode(F.array(*(F.struct(F.lit(k).alias("check"), v.cast("double").alias("score")) for k, v in scores.items()))).alias("_c")).select("url", "_c.*")


# Tasks of an agent and the checks each needs.
AGENT_TASKS = {"read": ["no_captcha", "no_blocking_overlay"], "contact": ["form_labels", "named_controls", "no_captcha"], "buy": ["semantic_controls", "machine_readable_offer", "clear_action", "no_blocking_overlay"]}


def agent_tasks(checks: DataFrame) -> DataFrame:
    """What an agent can do on a site: task, status (ok if all its checks pass on all pages, partial if none fails wholly, else blocked), pages that block."""
    need = checks.sparkSession.createDataFrame([(t, c) for t, cs in AGENT_TASKS.items() for c in cs], "task string, check string")
    j = checks.join(F.broadcast(need), "check").filter("score IS NOT NULL").groupBy("task", "url").agg(F.min("score").alias("_low"))
    return j.groupBy("task").agg(F.when(F.min("_low") == 1, "ok").when(F.min("_low") > 0, "partial").otherwise("blocked").alias("status"), F.count_if(F.col("_low") == 0).alias("blocked_pages"))


# Checks of a site's trustworthiness with their weights.
TRUST_CHECKS = {"org_profile": 15, "org_profiles_elsewhere": 10, "org_schema": 10, "about": 7, "contact": 7, "legal": 4, "authors": 8, "author_profiles": 12, "author_pages": 5, "article_author": 10, "article_date": 6, "article_entities": 6}


def trust_checks(org: DataFrame, authors: DataFrame, pages: DataFrame) -> DataFrame:
    """Trust checks of each site: site_id, check, score (1, 0.5, 0; null: does not apply).

    ``org`` has a row per site: logo, description, contact, same_as (array). ``authors``: site_id, url,
    image, description, same_as. ``pages``: site_id, url, depth, plain (200 and HTML), article, has_author,
    has_date, has_entities, org_schema (same_as of the organisation in its JSON-LD, null without one).
    """
    filled = lambda x: F.coalesce(F.trim(x), F.lit("")) != ""
    ok = pages.filter("plain")
    path = path_only(path_of(F.col("url")))
    of = lambda pattern: F.max(path.rlike(f"(?i){pattern}"))
    start = F.min_by(F.col("org_schema"), F.struct("depth", "url"))
    articles = F.count_if("article")
    share = lambda c: F.try_divide(F.count_if(F.col("article") & F.coalesce(F.col(c), F.lit(False))).cast("double"), articles.cast("double"))
    p = ok.groupBy("site_id").agg(of("nosotros|about|quienes-somos|acerca|equipo|team").alias("about"), of("contacto|contact").alias("contact_page"), of("privacidad|privacy|aviso-legal|terminos|terms|legal").alias("legal"), start.alias("schema"), *(share(f"has_{c}").alias(f"a_{c}") for c in ("author", "date", "entities")))
    key = lambda c: F.regexp_replace(c, "/$", "")
    known = ok.select("site_id", key(F.col("url")).alias("_u"), F.lit(True).alias("_there")).distinct()
    a = authors.withColumn("_u", key(F.col("url"))).join(known, ["site_id", "_u"], "left")
    good = (F.length(F.coalesce("description", F.lit(""))) >= 80) & (F.size(F.coalesce("same_as", F.array().cast("array<string>"))) > 0) & filled("url") & filled("image")
    a = a.groupBy("site_id").agg(F.count("*").alias("n"), F.count_if(good).alias("good"), F.count_if(filled("url")).alias("with_page"), F.count_if(F.coalesce("_there", F.lit(False))).alias("there"))
    j = org.join(p, "site_id", "left").join(a, "site_id", "left")
    n = F.coalesce("n", F.lit(0))
    fields = sum((filled(c).cast("int") for c in ("logo", "description", "contact")), F.lit(0))
    elsewhere = F.size(F.coalesce("same_as", F.array().cast("array<string>")))
    part = lambda all_, some: F.when(all_, 1.0).when(some, 0.5).otherwise(0.0)
    yes = lambda c: F.when(F.coalesce(F.col(c), F.lit(False)), 1.0).otherwise(0.0)
    enough = lambda c: F.when(F.col(c).isNull(), F.lit(None)).otherwise(part(F.col(c) >= 0.9, F.col(c) >= 0.4))
    scores = {
        "org_profile": part(fields == 3, fields > 0), "org_profiles_elsewhere": part(elsewhere >= 3, elsewhere > 0), "org_schema": F.coalesce(part(F.col("schema") > 0, F.col("schema").isNotNull()), F.lit(0.0)), "about": yes("about"), "contact": yes("contact_page"), "legal": yes("legal"),
        "authors": F.when(n > 0, 1.0).otherwise(0.0), "author_profiles": F.when(n > 0, part(F.col("good") == n, F.col("good") > 0)), "author_pages": F.when(n > 0, part((F.col("there") == F.col("with_page")) & (F.col("there") > 0), F.col("there") > 0)),
        "article_author": F.coalesce(enough("a_author"), F.lit(0.5)), "article_date": enough("a_date"), "article_entities": F.when(F.col("a_entities").isNotNull(), part(F.col("a_entities") >= 0.8, F.col("a_entities") > 0)),
    }
    return j.select("site_id", F.explode(F.array(*(F.struct(F.lit(k).alias("check"), v.cast("double").alias("score")) for k, v in scores.items()))).alias("_c")).select("site_id", "_c.*")


# Fixed value: paths that belong to the optional part of llms.txt.
_OPTIONAL = "(?i)/(tag|tags|category|categoria|author|autor|page|archivo|archive|privacidad|privacy|terminos|terms|aviso-legal|legal|cookies)(/|$)"


def llms_txt(pages: DataFrame, site: str, name: str = "name", per_section: int = 25, most: int = 200) -> DataFrame:
    """llms.txt of each site: ``site``, text, links.

    ``pages`` holds the site, its name, url, title, description and priority. Pages are grouped by first
    folder, folders of one page with the main pages first, then the largest; a section lists its
    ``per_section`` most important pages, a file ``most``. The start page gives the summary.
    """
    one = lambda c: F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))
    path = path_only(path_of(F.col("url")))
    p = pages.dropDuplicates([site, "url"]).withColumn("_path", path)
    home = p.filter("_path = '/'").groupBy(site).agg(F.max_by("description", F.struct("priority", "url")).alias("_about"))
    rest = p.filter("_path <> '/'").withColumn("_f", F.when(F.col("_path").rlike(_OPTIONAL), "~optional").otherwise(first_folder(F.col("_path"))))
    size = rest.withColumn("_n", F.count("*").over(Window.partitionBy(site, "_f")))
    section = F.when(F.col("_f") == "~optional", F.col("_f")).when((F.col("_f") == "/") | (F.col("_n") < 2), "").otherwise(F.col("_f"))
    named = size.withColumn("_s", section)
    title = F.regexp_replace(F.when(one("title") == "", F.col("url")).otherwise(one("title")), r"([\[\]])", r"\\$1")
    line = F.concat(F.lit("- ["), title, F.lit("]("), F.col("url"), F.lit(")"), F.when(one("description") == "", "").otherwise(F.concat(F.lit(": "), one("description"))))
    place = F.row_number().over(Window.partitionBy(site, "_s").orderBy(F.desc("priority"), "url"))
    kept = named.select(site, F.col(name).alias("_name"), "_s", place.alias("_k"), line.alias("_line")).filter(F.col("_k") <= per_section)
    held = kept.withColumn("_m", F.count("*").over(Window.partitionBy(site, "_s")))
    rank = F.when(F.col("_s") == "", 0).when(F.col("_s") == "~optional", 2).otherwise(1)
    order = Window.partitionBy(site).orderBy(rank, F.desc("_m"), "_s", "_k")
    some = held.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= most)
    head = F.when(F.col("_s") == "", "Main pages").when(F.col("_s") == "~optional", "Optional").otherwise(F.initcap(F.regexp_replace(F.regexp_replace("_s", "^/|/$", ""), "[-_]+", " ")))
    parts = some.groupBy(site, "_s", head.alias("_h")).agg(F.min("_r").alias("_first"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_r", "_line"))), lambda x: x["_line"]), "\n").alias("_t"), F.count("*").alias("_c"), F.max("_name").alias("_name"))
    whole = parts.groupBy(site).agg(F.max("_name").alias("_name"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_first", F.concat(F.lit("## "), F.col("_h"), F.lit("\n\n"), F.col("_t")).alias("t")))), lambda x: x["t"]), "\n\n").alias("_body"), F.sum("_c").cast("int").alias("links"))
    about = F.when(one("_about") != "", F.concat(F.lit("> "), one("_about"), F.lit("\n\n"))).otherwise("")
    return whole.join(home, site, "left").select(site, F.concat(F.lit("# "), one("_name"), F.lit("\n\n"), about, F.col("_body"), F.lit("\n")).alias("text"), "links")


def llms_lines(files: DataFrame, site: str, text: str = "text") -> DataFrame:
    """Entries of llms.txt files: site, line_no, section, label, url (null in a list line of another form)."""
    lines = files.select(site, F.posexplode(F.split(F.regexp_replace(text, "\r\n", "\n"), "\n")).alias("_no", "_l"))
    head = F.when(F.col("_l").rlike(r"^##\s+\S"), F.trim(F.regexp_replace("_l", r"^##\s+", "")))
    marked = lines.withColumn("section", F.coalesce(F.last(head, ignorenulls=True).over(Window.partitionBy(site).orderBy("_no")), F.lit("")))
    rx = r"^\s*[-*]\s+\[((?:\\.|[^\]\\])+)\]\(([^)\s]+)\)(:\s*.*)?$"
    entries = marked.filter(F.col("_l").rlike(r"^\s*[-*]\s+"))
    return entries.select(site, (F.col("_no") + 1).alias("line_no"), "section", F.nullif(F.regexp_extract("_l", rx, 1), F.lit("")).alias("label"), F.nullif(F.regexp_extract("_l", rx, 2), F.lit("")).alias("url"))


def llms_links(files: DataFrame, pages: DataFrame, site: str, host: str) -> DataFrame:
    """Links of llms.txt files with their status in the crawl: ok, not_crawled, broken, non_indexable, external, invalid.

    ``pages`` holds url, status_code, is_indexable. A link stands for itself, whatever its slash at the end.
    """
    rows = llms_lines(files, site).filter("url IS NOT NULL").withColumn("_k", url_key(F.col("url")))
    known = pages.groupBy(url_key(F.col("url")).alias("_k")).agg(F.max_by(F.struct("status_code", "is_indexable"), "url").alias("_p"))
    own = F.regexp_replace(F.coalesce(host_of(F.col("url")), F.lit("")), r"^www\.", "")
    status = (
        F.when(own == "", "invalid").when(own != host.removeprefix("www."), "external").when(F.col("_p").isNull(), "not_crawled").when((F.col("_p.status_code") >= 400) | (F.col("_p.status_code") == 0), "broken")
        .when(~F.col("_p.is_indexable") | F.col("_p.status_code").between(300, 399), "non_indexable").otherwise("ok")
    )
    return rows.join(known, "_k", "left").select(site, "line_no", "section", "label", "url", status.alias("status"))


def llms_checks(files: DataFrame, pages: DataFrame, site: str, host: str) -> DataFrame:
    """Nine checks of llms.txt files: site, check, passed, severity. ``files`` holds the site, text and content_type (null: not known, passed)."""
    lines = F.split(F.regexp_replace("text", "\r\n", "\n"), "\n")
    matching = lambda rx: F.size(F.filter(lines, lambda x: x.rlike(rx)))
    first = F.get(F.filter(lines, lambda x: F.trim(x) != ""), F.lit(0))
    links = llms_links(files, pages, site, host).groupBy(site).agg(F.count("*").alias("_links"), F.count_if(F.col("status").isin("broken", "invalid")).alias("_broken"), F.count_if(F.col("status") == "non_indexable").alias("_hidden"))
    odd = llms_lines(files, site).groupBy(site).agg(F.count_if(F.col("url").isNull()).alias("_odd"))
    j = files.join(links, site, "left").join(odd, site, "left")
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    checks = {
        "h1": ("error", F.coalesce(first.rlike(r"^#\s+\S"), F.lit(False)) & (matching(r"^#\s+\S") == 1)), "summary": ("warn", matching(r"^>\s*\S") > 0), "sections": ("error", matching(r"^##\s+\S") > 0), "levels": ("info", matching(r"^#{3,}\s") == 0),
        "format": ("warn", (n("_odd") == 0) & (n("_links") > 0)), "broken": ("error", n("_broken") == 0), "indexable": ("warn", n("_hidden") == 0), "size": ("warn", F.octet_length("text") <= 100 * 1024 + 511), "content_type": ("warn", F.coalesce(F.col("content_type").rlike("(?i)text/(plain|markdown)"), F.lit(True))),
    }
    return j.select(site, F.explode(F.array(*(F.struct(F.lit(k).alias("check"), p.alias("passed"), F.lit(s).alias("severity")) for k, (s, p) in checks.items()))).alias("_c")).select(site, "_c.*")


# ------------------------------------------------------------------ readability
_STRONG = frozenset("aeoáéóíú")
# Words and phrases that link sentences, folded, and forms of the passive voice.
LINKING = frozenset("ademas asimismo tambien pero sino aunque porque entonces finalmente primero segundo tercero luego despues mientras igualmente incluso pues".split())
LINKING_PHRASES = ("sin embargo", "no obstante", "por eso", "por lo tanto", "es decir", "por ejemplo", "en cambio", "por otro lado", "en resumen", "a pesar de", "ya que", "dado que", "en primer lugar", "como resultado")
PASSIVE = re.compile(r"\b(es|son|fue|fueron|era|eran|sera|seran|ha sido|han sido|siendo|ser) (?:\w+mente )?\w+(?:ado|ada|ados|adas|ido|ida|idos|idas)\b")


def syllables(word: str) -> int:
    """Syllables of a Spanish word: groups of vowels, two strong ones beside each other being two."""
    w = re.sub("[^a-záéíóúüñ]", "", word.lower())
    groups = re.findall("[aeiouáéíóúü]+", w)
    return max(1, len(groups) + sum(a in _STRONG and b in _STRONG for g in groups for a, b in zip(g, g[1:]))) if w else 0


def sentences(text: str) -> list[str]:
    """Sentences of a text, without the signs that open them."""
    parts = re.split(r"(?<=[.!?…])\s+", text)
    return [s for p in parts if re.search(r"\w", s := p.lstrip(" ¿¡\"“«(").strip())]


def _words(text: str) -> list[str]:
    folded = "".join(c for c in unicodedata.normalize("NFD", text.lower()) if not unicodedata.combining(c))
    return re.findall("[a-z0-9]+", folded)


def runs(values: list[str], least: int = 3) -> list[str]:
    """Values that stand ``least`` times or more in a row, once for each run."""
    out, n = [], 0
    for before, value in zip([None, *values], values):
        n = n + 1 if value and value == before else 1
        if n == least:
            out.append(value)
    return out


READING = "words int, sentences int, paragraphs int, subheadings int, syllables int, reading_ease double, long_paragraphs int, long_sentences double, linking double, passive double, repeated_starts array<string>, longest_section int"


def reading(html: str | None) -> dict:
    """Measures of how a text reads; shares of sentences in per cent, null without sentences."""
    root = parse(html)
    root.drop(lambda n: n.tag in ("script", "style", "noscript", "template"))
    tags = ("p", "li", "blockquote", "td", "h1", "h2", "h3", "h4", "h5", "h6")
    found = [(n.tag, t) for n in root.find(*tags) if (t := clean(n.text()))] or [("p", t) for p in re.split(r"\n\s*\n", root.text()) if (t := clean(p))]
    paras = [t for tag, t in found if tag[0] != "h"]
    all_words = [w for _, t in found for w in re.findall(r"[^\W\d_]+|\d+", t)]
    sents = [s for p in paras for s in sentences(p)]
    share = lambda n: 100.0 * n / len(sents) if sents else None
    folded = [_words(s) for s in sents]
    joined = [f" {' '.join(w)} " for w in folded]
    sections, size = [], 0
    for tag, t in found:
        if tag[0] == "h" and tag != "h1":
            sections.append(size)
            size = 0
        else:
            size += len(_words(t))
    n, syl = len(all_words), sum(map(syllables, all_words))
    return {
        "words": n, "sentences": len(sents), "paragraphs": len(paras), "subheadings": sum(tag in ("h2", "h3") for tag, _ in found), "syllables": syl, "reading_ease": 206.84 - 0.6 * (100 * syl / n) - 1.02 * (100 * len(sents) / n) if n and sents else None,
        "long_paragraphs": sum(len(_words(p)) > 150 for p in paras), "long_sentences": share(sum(len(w) > 25 for w in folded)), "linking": share(sum(bool(LINKING.intersection(w)) or any(f" {p} " in j for p in LINKING_PHRASES) for w, j in zip(folded, joined))),
        "passive": share(sum(bool(PASSIVE.search(j)) for j in joined)), "repeated_starts": runs([w[0] if w else "" for w in folded]), "longest_section": max([*sections, size]),
    }


def readability(pages: DataFrame, key: str = "url", html: str = "html") -> DataFrame:
    """Reading measures of each page and its rating: key, the columns of ``READING``, rating (too_short, good, ok, bad by the reading ease)."""
    out = by_page(pages, lambda _, text: [reading(text)], READING, key, html)
    ease = F.col("reading_ease")
    return out.withColumn("rating", F.when(F.col("words") < 50, "too_short").when(ease >= 60, "good").when(ease >= 50, "ok").otherwise("bad"))


def keyphrase_checks(pages: DataFrame, key: str = "url") -> DataFrame:
    """How well pages serve their key phrase: key, check, rating (good, ok, bad).

    ``pages`` holds the key, keyphrase, title, description, slug, text and intro (the first paragraph). A match
    is the folded phrase as it stands; all its words in another order are half of one.
    """
    fold = lambda c: F.concat(F.lit(" "), F.trim(F.regexp_replace(F.translate(F.lower(F.coalesce(c, F.lit(""))), "áéíóúüñ", "aeiouun"), "[^a-z0-9]+", " ")), F.lit(" "))
    k, words = fold("keyphrase"), F.filter(F.split(F.trim(fold("keyphrase")), " "), lambda w: w != "")
    exact = lambda c: F.contains(fold(c), k)
    loose = lambda c: F.forall(words, lambda w: F.contains(fold(c), F.concat(F.lit(" "), w, F.lit(" "))))
    n = F.size(F.filter(F.split(F.trim(fold("text")), " "), lambda w: w != ""))
    times = (F.length(fold("text")) - F.length(F.replace(fold("text"), k, F.lit(" ")))) / F.greatest(F.length(k) - 1, F.lit(1))
    density = F.coalesce(F.try_divide(times * 100.0, n.cast("double")), F.lit(0.0))
    title, desc = F.length(F.coalesce("title", F.lit(""))), F.length(F.coalesce("description", F.lit("")))
    pick = lambda good, ok: F.when(good, "good").when(ok, "ok").otherwise("bad")
    checks = {
        "phrase_length": F.when(F.size(words) == 0, "bad").otherwise(pick(F.size(words) <= 4, F.size(words) <= 8)), "title": pick(F.startswith(fold("title"), k), loose("title")), "description": pick(exact("description") | loose("description"), F.lit(False)), "slug": pick(loose("slug"), F.exists(words, lambda w: F.contains(fold("slug"), w))),
        "intro": pick(exact("intro") | loose("intro"), F.lit(False)), "density": F.when(density < 0.5, "bad").otherwise(pick(density <= 3, F.lit(True))), "length": pick(n >= 300, n >= 200), "title_length": F.when((title == 0) | (title > 60), "bad").otherwise(pick(title >= 30, F.lit(True))), "description_length": F.when(desc == 0, "bad").otherwise(pick(desc.between(120, 156), F.lit(True))),
    }
    return pages.select(key, F.explode(F.array(*(F.struct(F.lit(c).alias("check"), v.alias("rating")) for c, v in checks.items()))).alias("_c")).select(key, "_c.*")
