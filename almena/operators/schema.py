"""Structured data: a catalogue of types, building of JSON-LD from rows, validation, a connected graph for each page."""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Types with the properties search engines require (alternatives by a bar) and recommend.
CATALOGUE: dict[str, tuple[list[str], list[str]]] = {
    "Organization": (["name"], ["url", "logo", "sameAs"]),
    "LocalBusiness": (["name", "address"], ["url", "telephone", "image", "priceRange", "geo", "openingHoursSpecification", "aggregateRating"]),
    "WebSite": (["name", "url"], ["alternateName"]),
    "WebPage": (["name", "url"], ["description"]),
    "Article": (["headline"], ["image", "datePublished", "dateModified", "author", "author.name"]),
    "Product": (["name", "offers|review|aggregateRating"], ["image", "description", "brand", "sku", "offers.price", "offers.priceCurrency", "offers.availability"]),
    "Service": (["name"], ["description", "provider", "areaServed"]),
    "FAQPage": (["mainEntity", "mainEntity.name", "mainEntity.acceptedAnswer.text"], []),
    "HowTo": (["name", "step", "step.text"], ["image", "totalTime", "supply", "tool"]),
    "BreadcrumbList": (["itemListElement", "itemListElement.name"], ["itemListElement.item"]),
    "Event": (["name", "startDate", "location"], ["endDate", "description", "image", "offers", "organizer", "eventStatus"]),
    "Course": (["name", "description"], ["provider", "provider.name", "offers", "hasCourseInstance"]),
    "JobPosting": (["title", "description", "datePosted", "hiringOrganization", "hiringOrganization.name", "jobLocation|jobLocationType"], ["validThrough", "employmentType", "baseSalary"]),
    "Recipe": (["name", "image"], ["author", "datePublished", "description", "totalTime", "recipeIngredient", "recipeInstructions", "aggregateRating"]),
    "Person": (["name"], ["url", "sameAs", "jobTitle"]),
    "VideoObject": (["name", "description", "thumbnailUrl", "uploadDate"], ["duration", "contentUrl|embedUrl"]),
    "SoftwareApplication": (["name", "offers", "offers.price", "aggregateRating|review"], ["operatingSystem", "applicationCategory"]),
}
# Names of types that are a kind of one of the above.
_KINDS = {
    "Organization": "Corporation OnlineStore NGO EducationalOrganization CollegeOrUniversity School MedicalOrganization GovernmentOrganization NewsMediaOrganization SportsOrganization",
    "LocalBusiness": "Restaurant CafeOrCoffeeShop BarOrPub Bakery FastFoodRestaurant Store ClothingStore ElectronicsStore GroceryStore Pharmacy HardwareStore FurnitureStore JewelryStore Florist PetStore BookStore AutoDealer AutoRepair GasStation "
    "Dentist Physician MedicalClinic Hospital Optician VeterinaryCare BeautySalon HairSalon NailSalon DaySpa HealthClub LegalService Attorney AccountingService FinancialService InsuranceAgency RealEstateAgent Hotel Motel BedAndBreakfast "
    "TravelAgency Plumber Electrician HVACBusiness Locksmith MovingCompany GeneralContractor RoofingContractor HousePainter ChildCare EntertainmentBusiness NightClub MovieTheater ProfessionalService",
    "WebPage": "AboutPage ContactPage CollectionPage ProfilePage ItemPage", "Article": "BlogPosting NewsArticle", "SoftwareApplication": "MobileApplication WebApplication",
}
KIND_OF = {t: t for t in CATALOGUE} | {name: base for base, names in _KINDS.items() for name in names.split()}
# Properties by what they hold.
_URLS = frozenset("url logo image item sameAs contentUrl embedUrl thumbnailUrl menu mainEntityOfPage primaryImageOfPage urlTemplate".split())
_DATES = frozenset("datePublished dateModified startDate endDate uploadDate datePosted validThrough priceValidUntil foundingDate validFrom dateCreated".split())
_DURATIONS = frozenset("prepTime cookTime totalTime duration timeRequired courseWorkload".split())
_NUMBERS = frozenset("price ratingValue bestRating worstRating ratingCount reviewCount latitude longitude minValue maxValue lowPrice highPrice".split())
_CURRENCIES = frozenset(("priceCurrency", "currency"))
_ISO_DATE = re.compile(r"\d{4}-\d{2}-\d{2}(?:[T ]\d{2}:\d{2}(?::\d{2}(?:\.\d+)?)?(Z|[+-]\d{2}:?\d{2})?)?")
_ISO_DURATION = re.compile(r"P(?!$)(?:\d+Y)?(?:\d+M)?(?:\d+W)?(?:\d+D)?(?:T(?=\d)(?:\d+H)?(?:\d+M)?(?:\d+(?:\.\d+)?S)?)?")
_LD = re.compile(r"(?is)^\s*<script[^>]*>|</script>\s*$")


def _empty(value: object) -> bool:
    return value is None or value == "" or value == [] or (isinstance(value, dict) and not set(value) - {"@type"})


def holds(node: object, path: str) -> bool:
    """Whether a path (a.b) has a value, in any element of the arrays on its way."""
    head, _, rest = path.partition(".")
    for v in node if isinstance(node, list) else [node]:
        x = v.get(head) if isinstance(v, dict) else None
        if x is None or x in ("", []):
            continue
        if not rest or holds(x, rest):
            return True
    return False


def _formats(value: object, key: str, where: str) -> Iterator[tuple[str, str, str]]:
    """Problems of form below a value: level, rule, path."""
    if isinstance(value, list):
        for i, x in enumerate(value, 1):
            yield from _formats(x, key, f"{where}[{i}]")
        return
    if isinstance(value, dict):
        for k, x in value.items():
            if not k.startswith("@"):
                yield from _formats(x, k, f"{where}.{k}" if where else k)
        return
    text = isinstance(value, str)
    if text and not value.strip():
        yield "warning", "empty", where
        return
    if key in _URLS and text and not re.match(r"(?i)https?://\S+\.\S+", value) and "{search_term_string}" not in value:
        yield "error", "url", where
    if key in _DATES:
        m = _ISO_DATE.fullmatch(value) if text else None
        if not m:
            yield "error", "date", where
        elif len(value) > 10 and not m[1]:
            yield "warning", "no_time_zone", where
    if key in _DURATIONS and not (text and _ISO_DURATION.fullmatch(value)):
        yield "error", "duration", where
    if key in _NUMBERS and not (re.fullmatch(r"-?\d+(?:\.\d+)?", value.strip()) if text else isinstance(value, (int, float)) and not isinstance(value, bool)):
        yield "error", "number", where
    if key in _CURRENCIES and not (text and re.fullmatch("[A-Z]{3}", value)):
        yield "error", "currency", where


def check_node(node: dict, path: str) -> Iterator[dict]:
    """Messages about one object: node, type, level, rule, path; rules are required, recommended, type, unknown_type and those of form."""
    kind = node.get("@type")
    kind = str(kind[0]) if isinstance(kind, list) and kind else str(kind) if kind and not isinstance(kind, list) else ""
    say = lambda level, rule, at: {"node": path, "type": kind or None, "level": level, "rule": rule, "path": at}
    base = KIND_OF.get(kind)
    if not kind:
        yield say("error", "type", "@type")
    elif base is None:
        yield say("warning", "unknown_type", "@type")
    else:
        required, recommended = CATALOGUE[base]
        for level, rule, paths in (("error", "required", required), ("warning", "recommended", recommended)):
            for p in paths:
                if not any(holds(node, x) for x in p.split("|")):
                    yield say(level, rule, p)
        if base == "Product" and holds(node, "offers"):
            if not holds(node, "offers.price") and not holds(node, "offers.lowPrice"):
                yield say("error", "required", "offers.price")
            elif holds(node, "offers.price") and not holds(node, "offers.priceCurrency"):
                yield say("error", "required", "offers.priceCurrency")
        if base == "Event" and not holds(node, "location.address") and not holds(node, "location.url"):
            yield say("warning", "recommended", "location.address|location.url")
    seen = set()
    for m in _formats(node, "", ""):
        if m not in seen:
            seen.add(m)
            yield say(*m)


def validate(text: str | None) -> list[dict]:
    """Messages about a JSON-LD document; one that is no JSON has a single one, a valid one none."""
    say = lambda level, rule, path="": {"node": "", "type": None, "level": level, "rule": rule, "path": path}
    try:
        data = json.loads(_LD.sub("", text or "").strip())
    except ValueError:
        return [say("error", "json")]
    tops = data if isinstance(data, list) else [data]
    out: list[dict] = []
    for i, top in enumerate(tops, 1):
        if not isinstance(top, dict):
            out.append(say("error", "object"))
            continue
        context = top.get("@context")
        if not context:
            out.append(say("error", "context", "@context"))
        elif "schema.org" not in json.dumps(context).lower():
            out.append(say("warning", "context", "@context"))
        graph = top.get("@graph")
        if isinstance(graph, list):
            out += [m for k, n in enumerate(graph, 1) if isinstance(n, dict) for m in check_node(n, f"@graph[{k}]")]
        else:
            out += check_node(top, f"[{i}]" if len(tops) > 1 else "")
    return out


_MESSAGES = "node string, type string, level string, rule string, path string"


def validated(documents: DataFrame, key: str, column: str = "json") -> DataFrame:
    """Messages about JSON-LD documents: key, node, type, level, rule, path; a valid document has no row."""
    kind = dict(documents.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(k, *m.values()) for k, text in zip(pdf["_k"], pdf["_t"]) for m in validate(text)]
            yield pd.DataFrame(rows, columns=[key, "node", "type", "level", "rule", "path"])

    return documents.select(F.col(key).alias("_k"), F.col(column).alias("_t")).mapInPandas(run, f"{key} {kind}, {_MESSAGES}")


def catalogue(spark) -> DataFrame:
    """The catalogue as a table: type, base, required, recommended."""
    return spark.createDataFrame([(t, b, *CATALOGUE[b]) for t, b in KIND_OF.items()], "type string, base string, required array<string>, recommended array<string>")


# ------------------------------------------------------------------ values and building
def iso_duration(text: str | None) -> str | None:
    """A duration as people write it ("1 h 30 min", "1:30", minutes alone) in ISO 8601; None if it is none."""
    s = (text or "").strip().lower()
    if re.fullmatch(r"p(?:\d+[ymwd])*(?:t(?:\d+(?:\.\d+)?[hms])+)?", s) and s != "p":
        return s.upper()
    if m := re.fullmatch(r"(\d+):(\d{1,2})", s):
        parts = {"h": float(m[1]), "m": float(m[2])}
    elif s.isdigit():
        return f"PT{int(s)}M"
    else:
        parts = {}
        for n, unit in re.findall(r"(\d+(?:[.,]\d+)?)\s*(d[ií]as?|days?|d\b|horas?|hrs?|hours?|h\b|minutos?|mins?|minutes?|m\b|segundos?|secs?|seconds?|s\b)", s):
            parts[unit[0]] = parts.get(unit[0], 0) + float(n.replace(",", "."))
        if not parts:
            return None
    show = lambda k: f"{int(parts[k]) if parts[k] == int(parts[k]) else parts[k]}{k.upper()}" if parts.get(k) else ""
    time = "".join(map(show, "hms"))
    out = f"P{show('d')}{'T' + time if time else ''}"
    return out if out != "P" else "PT0M" if ":" in s else None


def local_number(text: str) -> float | int | str:
    """A number with blanks, thousands and a comma before one or two last digits; the text itself if it is none."""
    s = re.sub(r",(?=\d{1,2}$)", ".", re.sub(r"\s", "", text)).replace(",", "")
    try:
        n = float(s)
    except ValueError:
        return text
    return text if not math.isfinite(n) else int(n) if n == int(n) else n


def fill_text(text: str, row: dict[str, str | None]) -> str:
    return re.sub(r"\{\{\s*([^}]+?)\s*\}\}", lambda m: row.get(m[1]) or "", text)


def _converted(value: object, key: str, row: dict[str, str | None], offset: str) -> object:
    if isinstance(value, dict):
        made = {k: c for k, v in value.items() if not _empty(c := _converted(v, k, row, offset))}
        return made if not _empty(made) else None
    if isinstance(value, list):
        return [c for v in value if not _empty(c := _converted(v, key, row, offset))]
    if not isinstance(value, str):
        return value
    text = fill_text(value, row).strip()
    if not text:
        return None
    if key in _NUMBERS:
        return local_number(text)
    if key in _CURRENCIES:
        return text.upper()
    if key in _DURATIONS:
        return iso_duration(text) or text
    if key in _DATES and re.fullmatch(r"\d{4}-\d{2}-\d{2}T\d{2}:\d{2}(?::\d{2})?", text):
        return (text if len(text) > 16 else f"{text}:00") + offset
    return text


def _shaped(node: dict) -> dict:
    """The forms that some types want: answers, positions, steps, addresses to search."""
    listed = lambda v: v if isinstance(v, list) else [v]
    base = KIND_OF.get(str(node.get("@type")))
    if base == "FAQPage" and "mainEntity" in node:
        node["mainEntity"] = [{**q, "acceptedAnswer": {"@type": "Answer", "text": q["acceptedAnswer"]}} if isinstance(q, dict) and isinstance(q.get("acceptedAnswer"), str) else q for q in listed(node["mainEntity"])]
    if base == "BreadcrumbList" and "itemListElement" in node:
        node["itemListElement"] = [{**e, "position": i} for i, e in enumerate(listed(node["itemListElement"]), 1)]
    if base == "HowTo":
        for k, t in (("supply", "HowToSupply"), ("tool", "HowToTool")):
            if k in node:
                node[k] = [{"@type": t, "name": x} if isinstance(x, str) else x for x in listed(node[k])]
    if base == "Recipe" and "recipeInstructions" in node:
        node["recipeInstructions"] = [{"@type": "HowToStep", "text": x} if isinstance(x, str) else x for x in listed(node["recipeInstructions"])]
    if base == "WebSite" and "searchUrl" in node:
        node["potentialAction"] = {"@type": "SearchAction", "target": {"@type": "EntryPoint", "urlTemplate": node.pop("searchUrl")}, "query-input": "required name=search_term_string"}
    return node


def build(templates: list[dict], row: dict[str, str | None], page_url: str | None = None, offset: str = "") -> dict:
    """JSON-LD of one row from templates: objects of properties whose texts may name columns ({{name}}). Several make one graph."""
    nodes = []
    for t in templates:
        node = _converted(t, "", row, offset) or {}
        node = {"@type": node.get("@type", "Thing"), **({"@id": f"{page_url.split('#')[0]}#{str(node.get('@type', 'Thing')).lower()}"} if page_url else {}), **{k: v for k, v in node.items() if k != "@type"}}
        nodes.append(_shaped(node))
    return {"@context": "https://schema.org", **nodes[0]} if len(nodes) == 1 else {"@context": "https://schema.org", "@graph": nodes}


def built(rows: DataFrame, templates: list[dict], key: str, page_url: str | None = None, offset: str = "") -> DataFrame:
    """JSON-LD of every row: key, json, with < written so that it can stand in a script. All other columns serve as texts."""
    names = [c for c in rows.columns if c != key]
    kind = dict(rows.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for k, *values in pdf.itertuples(index=False, name=None):
                row = {n: None if v is None or v != v else str(v) for n, v in zip(names, values)}
                out.append((k, json.dumps(build(templates, row, row.get(page_url) if page_url else None, offset), ensure_ascii=False).replace("<", "\\u003c")))
            yield pd.DataFrame(out, columns=[key, "json"])

    return rows.select(key, *(F.col(f"`{n}`").cast("string").alias(n) for n in names)).mapInPandas(run, f"{key} {kind}, json string")


def placeholders(templates: list[dict]) -> list[str]:
    """Names of columns that templates use, in order."""
    return list(dict.fromkeys(re.findall(r"\{\{\s*([^}]+?)\s*\}\}", json.dumps(templates, ensure_ascii=False))))


_ARTICLES = ("Article", "BlogPosting", "NewsArticle")


def entity_graph(pages: DataFrame) -> DataFrame:
    """One connected graph for each page as JSON: url, json, warnings.

    ``pages`` holds url, type, title, description, image, date_published, date_modified, lang, about (array of
    name and same_as), the organisation (org: name, url, logo, description, same_as) and its author (author: slug, name,
    url, job_title, description, image, same_as). Empty values are left out.
    """
    c = F.col
    origin = F.regexp_extract("org.url", "^(https?://[^/]+)", 1)
    ref = lambda tail: F.struct(F.concat(origin, F.lit(tail)).alias("@id"))
    some = lambda a: F.when(F.size(a) > 0, a)
    person_id = F.concat(origin, F.lit("/#/schema/person/"), c("author.slug"))
    article, has_author = c("type").isin(*_ARTICLES), c("author").isNotNull()
    things = some(F.transform("about", lambda a: F.struct(F.lit("Thing").alias("@type"), a["name"].alias("name"), some(a["same_as"]).alias("sameAs"))))
    logo = F.when(c("org.logo").isNotNull(), F.struct(F.lit("ImageObject").alias("@type"), F.concat(origin, F.lit("/#logo")).alias("@id"), c("org.logo").alias("url")))
    org = F.to_json(F.struct(F.lit("Organization").alias("@type"), F.concat(origin, F.lit("/#organization")).alias("@id"), c("org.name").alias("name"), c("org.url").alias("url"), logo.alias("logo"), c("org.description").alias("description"), some(c("org.same_as")).alias("sameAs")))
    web = F.to_json(F.struct(F.lit("WebSite").alias("@type"), F.concat(origin, F.lit("/#website")).alias("@id"), F.concat(origin, F.lit("/")).alias("url"), c("org.name").alias("name"), ref("/#organization").alias("publisher"), c("lang").alias("inLanguage")))
    main = F.when(c("type").isin("AboutPage", "ContactPage"), ref("/#organization")).when((c("type") == "ProfilePage") & has_author, F.struct(person_id.alias("@id")))
    page = F.to_json(F.struct(
        F.when(article, "WebPage").otherwise(c("type")).alias("@type"), F.concat("url", F.lit("#webpage")).alias("@id"), c("url"), c("title").alias("name"), c("description"), ref("/#website").alias("isPartOf"), F.when(c("image").isNotNull(), F.struct(F.lit("ImageObject").alias("@type"), c("image").alias("url"))).alias("primaryImageOfPage"),
        F.when(~article, c("date_published")).alias("datePublished"), F.when(~article, c("date_modified")).alias("dateModified"), F.when(~article, things).alias("about"), main.alias("mainEntity"), c("lang").alias("inLanguage"),
    ))
    text = F.when(article, F.to_json(F.struct(
        c("type").alias("@type"), F.concat("url", F.lit("#article")).alias("@id"), F.left("title", F.lit(110)).alias("headline"), c("description"), c("image"), c("date_published").alias("datePublished"), F.coalesce("date_modified", "date_published").alias("dateModified"), F.when(has_author, F.struct(person_id.alias("@id"))).alias("author"),
        ref("/#organization").alias("publisher"), F.struct(F.concat("url", F.lit("#webpage")).alias("@id")).alias("mainEntityOfPage"), ref("/#website").alias("isPartOf"), things.alias("about"), c("lang").alias("inLanguage"),
    )))
    person = F.when(has_author, F.to_json(F.struct(F.lit("Person").alias("@type"), person_id.alias("@id"), c("author.name").alias("name"), c("author.url").alias("url"), c("author.job_title").alias("jobTitle"), c("author.description").alias("description"), c("author.image").alias("image"), some(c("author.same_as")).alias("sameAs"), ref("/#organization").alias("worksFor"))))
    graph = F.concat(F.lit('{"@context":"https://schema.org","@graph":['), F.array_join(F.array_compact(F.array(org, web, page, text, person)), ","), F.lit("]}"))
    short = F.length(F.coalesce("author.description", F.lit(""))) < 80
    size = lambda a: F.coalesce(F.size(a), F.lit(0))
    warn = F.array_compact(F.array(
        F.when(c("org.logo").isNull(), "no_logo"), F.when(size("org.same_as") < 2, "few_profiles"), F.when(article & ~has_author, "no_author"), F.when(article & has_author & short, "short_biography"), F.when(article & has_author & (size("author.same_as") == 0), "author_not_verifiable"), F.when(article & has_author & c("author.url").isNull(), "no_author_page"),
        F.when(article & c("date_published").isNull(), "no_date"), F.when(article & (size("about") == 0), "no_about"),
    ))
    return pages.select("url", graph.alias("json"), warn.alias("warnings"))
