"""Trees of HTML pages, read in Arrow batches: fields, main text, blocks, paragraphs, links of a page.

The parser is that of the standard library, so a tree is a best effort: void tags hold
nothing, a paragraph ends where a block begins, list items, cells and rows end where
the next one begins, and an end tag closes what is open up to its start tag.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin, urlsplit

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Groups of HTML tags.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style".split())
BLOCKS = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
FENCES = {"li": {"ul", "ol"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "option": {"select"}}
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")


class Node:
    """An element with its attributes and children, which are nodes or texts."""

    __slots__ = ("tag", "attrs", "children", "parent")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None):
        self.tag, self.attrs, self.children, self.parent = tag, attrs, [], parent

    def walk(self) -> Iterator[Node]:
        """All elements below, in order."""
        todo = [c for c in reversed(self.children) if isinstance(c, Node)]
        while todo:
            node = todo.pop()
            yield node
            todo.extend(c for c in reversed(node.children) if isinstance(c, Node))

    def find(self, *tags: str) -> list[Node]:
        return [n for n in self.walk() if n.tag in tags]

    def first(self, *tags: str) -> Node | None:
        return next((n for n in self.walk() if n.tag in tags), None)

    def text(self) -> str:
        """Text of the element and all below, as it stands."""
        out, todo = [], [self]
        while todo:
            node = todo.pop()
            if isinstance(node, str):
                out.append(node)
            else:
                todo.extend(reversed(node.children))
        return "".join(out)

    def drop(self, unwanted: Callable[[Node], bool]) -> None:
        """Take elements out of the tree."""
        todo = [self]
        while todo:
            node = todo.pop()
            node.children = [c for c in node.children if isinstance(c, str) or not unwanted(c)]
            todo.extend(c for c in node.children if isinstance(c, Node))


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("#root", {}, None)

    def _close(self, tags: set[str], fences: set[str]) -> None:
        node = self.at
        while node.parent is not None and node.tag not in fences:
            if node.tag in tags:
                self.at = node.parent
                return
            node = node.parent

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in BLOCKS:
            self._close({"p"}, {"li", "td", "th", "div", "section", "article", "main", "button"})
        while tag in ENDS:
            before = self.at
            self._close(ENDS[tag], FENCES[tag])
            if self.at is before or tag != "tr":
                break
        node = Node(tag, {k: v or "" for k, v in reversed(attrs)}, self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.at.children.append(Node(tag, {k: v or "" for k, v in reversed(attrs)}, self.at))

    def handle_endtag(self, tag: str) -> None:
        node = self.at
        while node.parent is not None and node.tag != tag:
            node = node.parent
        if node.parent is not None:
            self.at = node.parent

    def handle_data(self, data: str) -> None:
        self.at.children.append(data)


def parse(html: str | None) -> Node:
    """The tree of a page; a null page is an empty one."""
    builder = _Builder()
    builder.feed(html or "")
    builder.close()
    return builder.root


def clean(text: str | None) -> str:
    return " ".join((text or "").split())


def has_class(node: Node, *names: str) -> bool:
    return bool(set(node.attrs.get("class", "").split()).intersection(names))


def _furniture(node: Node) -> bool:
    return (
        node.tag in ("nav", "header", "footer", "aside") or node.attrs.get("role") in ("navigation", "banner", "contentinfo") or node.attrs.get("aria-hidden") == "true"
        or has_class(node, "menu", "breadcrumb", "breadcrumbs", "sidebar", "cookie") or node.attrs.get("id") == "cookie-banner"
    )


def main_of(root: Node) -> Node:
    """The main element, else the first article, else the body, else all."""
    return root.first("main") or root.first("article") or root.first("body") or root


def main_tree(html: str | None, controls: bool = True) -> tuple[Node, Node]:
    """The whole tree and its main part, without scripts, furniture and (unless kept) controls."""
    root = parse(html)
    gone = {"script", "style", "noscript", "template", "svg", "iframe", "canvas"} | ({"form", "button", "select", "input", "textarea"} if controls else {"form"})
    root.drop(lambda n: n.tag in gone)
    main = main_of(root)
    main.drop(_furniture)
    return root, main


def main_text(html: str | None) -> str:
    """Text of the main part, white space collapsed; every element ends a word."""
    _, main = main_tree(html)
    out = []

    def visit(node: Node) -> None:
        for c in node.children:
            if isinstance(c, str):
                out.append(c)
            else:
                out.append(" " if c.tag in BLOCKS or c.tag in ("li", "td", "th", "tr", "br") else "")
                visit(c)
                out.append(" " if c.tag in BLOCKS or c.tag in ("li", "td", "th", "tr") else "")

    visit(main)
    return clean("".join(out))


def paragraphs(html: str | None) -> list[str]:
    """Paragraphs, list items and cells of the main part of more than 30 characters, without headings and what is linked."""
    _, main = main_tree(html)
    main.drop(lambda n: n.tag in ("a", "button", *HEADINGS))
    return [t for n in main.find("p", "li", "td") if len(t := clean(n.text())) > 30]


def absolute(base: str | None, href: str) -> str:
    try:
        return urljoin(base or "", href.strip())
    except ValueError:
        return href


def host_name(url: str | None) -> str:
    try:
        return (urlsplit(url or "").hostname or "").lower().removeprefix("www.")
    except ValueError:
        return ""


def json_nodes(value: object) -> Iterator[dict]:
    """All objects of a JSON value, outermost first."""
    todo = [value]
    while todo:
        v = todo.pop()
        if isinstance(v, dict):
            yield v
            todo.extend(reversed(list(v.values())))
        elif isinstance(v, list):
            todo.extend(reversed(v))


def structured(root: Node) -> tuple[list[dict], int]:
    """Objects of the JSON-LD of a page and how many blocks are no JSON. To be called before scripts are taken out."""
    nodes, errors = [], 0
    for script in root.find("script"):
        if script.attrs.get("type", "").strip().lower() == "application/ld+json":
            try:
                nodes += json_nodes(json.loads(script.text()))
            except ValueError:
                errors += 1
    return nodes, errors


def types_of(node: dict) -> list[str]:
    kind = node.get("@type")
    return [k for k in (kind if isinstance(kind, list) else [kind]) if isinstance(k, str)]


FIELDS = (
    "title string, title_count int, meta_description string, meta_description_count int, meta_keywords string, robots_meta string, canonical string, canonical_count int, lang string, h1 string, h1_count int, h1_all array<string>, h2 array<string>, "
    "hreflang array<struct<lang:string,href:string>>, og struct<title:string,description:string,image:string,type:string,url:string>, twitter struct<card:string,title:string,description:string,image:string>, rel_next string, rel_prev string, "
    "images array<struct<src:string,alt:string,width:string,height:string,loading:string>>, images_missing_alt int, schema_types array<string>, schema_errors int, word_count int, content_hash string, internal_links array<string>, "
    "external_links array<string>, nofollow_links int, resources array<struct<url:string,kind:string>>, forms int, tables int, lists int, favicon string, amp string, charset string, viewport string"
)


def extract(url: str | None, html: str | None) -> dict:
    """The fields of ``FIELDS`` of a page; addresses are absolute."""
    root = parse(html)
    nodes, errors = structured(root)
    meta: dict[str, list[str]] = {}
    for m in root.find("meta"):
        name = (m.attrs.get("name") or m.attrs.get("property") or "").strip().lower()
        if name:
            meta.setdefault(name, []).append(clean(m.attrs.get("content")))
    links = root.find("link")
    rel = lambda what: [n for n in links if what in n.attrs.get("rel", "").lower().split()]
    href = lambda found: absolute(url, found[0].attrs["href"]) if found and found[0].attrs.get("href") else None
    one = lambda name: next((v for v in meta.get(name, []) if v), None)
    page = root.first("html")
    charset = next((m.attrs["charset"] for m in root.find("meta") if m.attrs.get("charset")), None)
    resources = [(absolute(url, n.attrs["src"]), kind) for tag, kind in (("script", "script"), ("img", "image"), ("iframe", "frame"), ("video", "media"), ("audio", "media"), ("source", "media")) for n in root.find(tag) if n.attrs.get("src")]
    resources += [(absolute(url, n.attrs["href"]), "style") for n in rel("stylesheet") if n.attrs.get("href")]
    titles = [clean(n.text()) for n in root.find("title") if not any(p.tag == "svg" for p in _above(n))]
    root.drop(lambda n: n.tag in ("script", "style", "noscript", "template"))
    body = root.first("body") or root
    words = clean(" ".join(_texts(body)))
    own, inner, outer, nofollow = host_name(url), {}, {}, 0
    for a in root.find("a"):
        to = absolute(url, a.attrs.get("href", "")).partition("#")[0]
        if a.attrs.get("href") and re.match("(?i)https?://", to):
            (inner if host_name(to) == own else outer).setdefault(to)
            nofollow += "nofollow" in a.attrs.get("rel", "").lower().split()
    h1, h2 = ([t for n in root.find(tag) if (t := clean(n.text()))] for tag in ("h1", "h2"))
    images = [{k: n.attrs.get(k) for k in ("src", "alt", "width", "height", "loading")} for n in root.find("img")]
    return {
        "title": titles[0] or None if titles else None, "title_count": len(titles), "meta_description": one("description"), "meta_description_count": len(meta.get("description", [])), "meta_keywords": one("keywords"),
        "robots_meta": ", ".join(v for n in ("robots", "googlebot") for v in meta.get(n, [])) or None, "canonical": href(rel("canonical")), "canonical_count": len(rel("canonical")), "lang": (page.attrs.get("lang") or None) if page else None,
        "h1": h1[0] if h1 else None, "h1_count": len(h1), "h1_all": h1, "h2": h2, "hreflang": [{"lang": n.attrs["hreflang"], "href": absolute(url, n.attrs.get("href", "")) if n.attrs.get("href") else ""} for n in rel("alternate") if n.attrs.get("hreflang")],
        "og": {k: one(f"og:{k}") for k in ("title", "description", "image", "type", "url")}, "twitter": {k: one(f"twitter:{k}") for k in ("card", "title", "description", "image")}, "rel_next": href(rel("next")), "rel_prev": href(rel("prev")),
        "images": images, "images_missing_alt": sum(i["alt"] is None for i in images), "schema_types": list(dict.fromkeys(t for n in nodes for t in types_of(n))), "schema_errors": errors, "word_count": len(words.split()),
        "content_hash": hashlib.sha256(words.lower().encode()).hexdigest() if words else None, "internal_links": list(inner), "external_links": list(outer), "nofollow_links": nofollow,
        "resources": [{"url": u, "kind": k} for u, k in dict.fromkeys(resources)], "forms": len(root.find("form")), "tables": len(root.find("table")), "lists": len(root.find("ul", "ol")),
        "favicon": href(rel("icon")), "amp": href(rel("amphtml")), "charset": charset, "viewport": one("viewport"),
    }


def _above(node: Node) -> Iterator[Node]:
    while node.parent is not None:
        node = node.parent
        yield node


def _texts(node: Node) -> Iterator[str]:
    for c in node.children:
        if isinstance(c, str):
            yield c
        else:
            yield from _texts(c)


def by_page(pages: DataFrame, read: Callable[[str | None, str | None], list[dict]], schema: str, key: str = "url", html: str = "html", base: str | None = None) -> DataFrame:
    """Rows that ``read`` (of the page's address and HTML) makes of each page, in batches: the key and the columns of ``schema``.

    ``base`` names the column with the address, by default the key.
    """
    kind = dict(pages.dtypes)[key]
    names = [key, *(c.name for c in _schema(schema))]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [{key: k, **row} for k, b, text in zip(pdf["_key"], pdf["_base"], pdf["_html"]) for row in read(b, text)]
            yield pd.DataFrame(rows, columns=names)

    chosen = pages.select(F.col(key).alias("_key"), F.col(base or key).cast("string").alias("_base"), F.col(html).alias("_html"))
    return chosen.mapInPandas(run, f"{key} {kind}, {schema}")


def _schema(ddl: str):
    from pyspark.sql.types import StructType

    return StructType.fromDDL(ddl)


def page_fields(pages: DataFrame, key: str = "url", html: str = "html", base: str | None = None) -> DataFrame:
    """All fields of each page: the key and the columns of ``FIELDS``; a null page has empty ones."""
    return by_page(pages, lambda url, text: [extract(url, text)], FIELDS, key, html, base)


def main_texts(pages: DataFrame, key: str = "url", html: str = "html") -> DataFrame:
    """Main text of each page and its words: key, text, words."""

    def read(_: str | None, text: str | None) -> list[dict]:
        found = main_text(text)
        return [{"text": found, "words": len(found.split())}]

    return by_page(pages, read, "text string, words int", key, html)


def links_to(html: str | None, url: str | None, own_host: str, target: str | None = None) -> dict:
    """Whether a page links to a site (or one address of it): found, href, rel, anchor, outlinks, site_links."""
    root = parse(html)
    own = own_host.lower().removeprefix("www.")
    here, wanted, outlinks, found = host_name(url), urlsplit(target) if target else None, 0, []
    strip = lambda p: p.path.rstrip("/") + (f"?{p.query}" if p.query else "")
    for a in root.find("a"):
        to = absolute(url, a.attrs["href"]) if a.attrs.get("href") else ""
        if not re.match("(?i)https?://", to):
            continue
        host = host_name(to)
        outlinks += host != here
        if host != own and not host.endswith(f".{own}"):
            continue
        rel = [r for r in ("nofollow", "sponsored", "ugc") if r in a.attrs.get("rel", "").lower().split()]
        image = a.first("img")
        label = clean(a.text()) or (f"[image: {image.attrs['alt']}]" if image is not None and image.attrs.get("alt") else "[image]")
        exact = wanted is not None and strip(urlsplit(to)) == strip(wanted)
        found.append((to, ",".join(rel) or "follow", label[:300], exact))
    none = any("nofollow" in m.attrs.get("content", "").lower() for m in root.find("meta") if m.attrs.get("name", "").lower() == "robots")
    hit = next((f for f in found if f[3]), None if target else found[0] if found else None)
    return {
        "found": hit is not None, "href": hit[0] if hit else None, "rel": ("nofollow" if none and hit[1] == "follow" else hit[1]) if hit else None, "anchor": hit[2] if hit else None, "outlinks": outlinks, "site_links": len(found),
    }


def link_presence(pages: DataFrame, own_host: str, key: str = "url", html: str = "html", target: str | None = None) -> DataFrame:
    """``links_to`` of each page: key, found, href, rel, anchor, outlinks, site_links."""
    return by_page(pages, lambda url, text: [links_to(text, url, own_host, target)], "found boolean, href string, rel string, anchor string, outlinks int, site_links int", key, html)


# ------------------------------------------------------------------ selectors and hints
_STEP = re.compile(r"([a-zA-Z][\w-]*|\*)?((?:#[\w-]+|\.[\w-]+|\[[\w-]+(?:[~^$*]?=\"?[^\]\"]*\"?)?\])*)")
_PART = re.compile(r"#([\w-]+)|\.([\w-]+)|\[([\w-]+)(?:([~^$*]?)=\"?([^\]\"]*)\"?)?\]")


def _fits(node: Node, step: str) -> bool:
    m = _STEP.fullmatch(step)
    if not m:
        raise ValueError(f"a selector of an unknown form: {step}")
    if m[1] not in (None, "*") and node.tag != m[1].lower():
        return False
    for name, cls, attr, how, value in _PART.findall(m[2]):
        has = node.attrs.get(attr or ("id" if name else "class"))
        if has is None or (name and has != name) or (cls and cls not in has.split()):
            return False
        if attr and (value or how) and not {"": has == value, "~": value in has.split(), "^": has.startswith(value), "$": has.endswith(value), "*": value in has}[how]:
            return False
    return True


def select(root: Node, selector: str) -> list[Node]:
    """Elements that a selector of tags, #ids, .classes and [attributes] fits, steps below one another, alternatives by commas."""
    ways = [w.split() for w in selector.split(",")]

    def ends(node: Node, steps: list[str]) -> bool:
        if not _fits(node, steps[-1]):
            return False
        at = len(steps) - 2
        for up in _above(node):
            if at < 0:
                break
            at -= up.parent is not None and _fits(up, steps[at])
        return at < 0

    return [n for n in root.walk() if any(ends(n, w) for w in ways if w)]


def extracted(pages: DataFrame, selector: str | None = None, pattern: str | None = None, attribute: str | None = None, most: int = 20, key: str = "url", html: str = "html") -> DataFrame:
    """Up to ``most`` values a selector (text, or an attribute) or a pattern (its first group) finds on each page: key, values, found. Pages without any stay out."""

    def read(_: str | None, text: str | None) -> list[dict]:
        if selector:
            found = [v for n in select(parse(text), selector) if (v := clean(n.text() if attribute is None else n.attrs.get(attribute)))]
        else:
            found = [clean(m[1] if m.re.groups else m[0]) for m in re.finditer(pattern, text or "")]
        return [{"values": found[:most], "found": len(found)}] if found else []

    return by_page(pages, read, "values array<string>, found int", key, html)


def hints(html: str | None, url: str | None) -> dict:
    """What a page says of itself for a form of structured data: a type and values by property."""
    f = extract(url, html)
    text = main_text(html)
    path = urlsplit(url or "").path.lower()
    price = re.search(r"(?i)(?:[$€£]|mxn|usd|eur)\s?(\d[\d.,]*\d|\d)|(\d[\d.,]*)\s?(?:€|mxn|usd|eur)", text)
    phone, mail = re.search(r"\+?\d[\d ()-]{7,}\d", text), re.search(r"[\w.+-]+@[\w-]+\.[\w.]+\w", text)
    questions = [h for h in f["h2"] if h.endswith("?")]
    kind = (
        f["schema_types"][0] if f["schema_types"] else "FAQPage" if len(questions) >= 2 else "Product" if price and re.search("product|tienda|shop|producto", path) else "Article" if f["og"]["type"] == "article" or re.search("/(blog|noticias|news|articulo)", path)
        else "WebSite" if path in ("", "/") else "WebPage"
    )
    values = {"name": f["og"]["title"] or f["h1"] or f["title"], "description": f["og"]["description"] or f["meta_description"], "image": f["og"]["image"], "url": f["canonical"] or url, "price": price and (price[1] or price[2]), "telephone": phone and clean(phone[0]), "email": mail and mail[0], "inLanguage": f["lang"]}
    return {"type": kind, "properties": {k: v for k, v in values.items() if v}}


def schema_hints(pages: DataFrame, key: str = "url", html: str = "html") -> DataFrame:
    """``hints`` of each page: key, type, properties (a map)."""
    return by_page(pages, lambda url, text: [hints(text, url)], "type string, properties map<string,string>", key, html)
