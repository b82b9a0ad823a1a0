"""HTML as Markdown blocks, and blocks as chunks that keep their headings, with flags for what a reader of chunks loses."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from almena.sources.dom import HEADINGS, Node, absolute, by_page, clean, main_tree

#: Tokens of a chunk; a heading of the first two levels begins a new one from a quarter of it on.
CHUNK = 512
# Elements that hold blocks, and those that are one.
_HOLDERS = frozenset("div section article main li header figcaption details center body html #root".split())
_SINGLE = frozenset(("p", "ul", "ol", "table", "pre", "blockquote", "figure", "hr", "dl", *HEADINGS))
_INNER = frozenset("p div h1 h2 h3 ul ol table".split())
# A figure with a currency, a unit or groups of thousands.
KEY_DATA = re.compile(r"(?i)(?:[$€£]|mxn|usd|eur)\s?\d|\d[\d.,]*\s?(?:%|€|\$|mxn|usd|kg|km|cm|mm|m²|gb|mb)|\b\d{1,3}(?:[.,]\d{3})+\b")
FLAGS = ("js_only", "key_data_js", "split_table", "split_list", "split_paragraph", "no_context", "tiny")


def tokens(text: str) -> int:
    return max(1, -(-len(text) // 4))


def _inline(nodes: list, base: str | None) -> str:
    """Markdown of inline content."""
    out = []
    for n in nodes:
        if isinstance(n, str):
            out.append(n)
            continue
        inner = clean(_inline(n.children, base)) if n.tag in ("a", "strong", "b", "em", "i", "code") else ""
        if n.tag == "a":
            href = n.attrs.get("href", "")
            out.append(f"[{inner}]({absolute(base, href)})" if inner and href and not href.startswith(("#", "javascript:")) else inner)
        elif n.tag in ("strong", "b", "em", "i"):
            mark = "**" if n.tag in ("strong", "b") else "*"
            out.append(f"{mark}{inner}{mark}" if inner else "")
        elif n.tag == "code":
            out.append(f"`{inner}`")
        elif n.tag == "br":
            out.append(" ")
        elif n.tag == "img":
            alt = clean(n.attrs.get("alt"))
            out.append(f"![{alt}]" if alt else "")
        else:
            out.append(f" {_inline(n.children, base)} ")
    return "".join(out)


def _items(list_: Node, base: str | None, depth: int = 0) -> list[str]:
    out, number = [], 0
    for li in list_.children:
        if isinstance(li, str) or li.tag != "li":
            continue
        nested = [c for c in li.children if isinstance(c, Node) and c.tag in ("ul", "ol")]
        text = clean(_inline([c for c in li.children if c not in nested], base))
        if text:
            number += 1
            out.append("  " * depth + (f"{number}. " if list_.tag == "ol" else "- ") + text)
        for sub in nested:
            out += _items(sub, base, depth + 1)
    return out


def _block(node: Node, base: str | None) -> dict | None:
    """A single block: kind, level, md, text, parts; None if there is nothing in it."""
    text = clean(node.text())
    kind, level, parts = "paragraph", 0, []
    md = clean(_inline(node.children, base))
    if node.tag in HEADINGS:
        kind, level = "heading", int(node.tag[1])
        text = clean(re.sub("[*`]", "", md))
        md = f"{'#' * level} {text}"
    elif node.tag in ("ul", "ol"):
        kind, parts = "list", _items(node, base)
        md = "\n".join(parts)
    elif node.tag == "dl":
        kind, parts = "list", [f"- **{clean(c.text())}**" if c.tag == "dt" else f"  {clean(c.text())}" for c in node.children if isinstance(c, Node) and c.tag in ("dt", "dd")]
        md = "\n".join(parts)
    elif node.tag == "table":
        rows = [[clean(_inline(c.children, base)).replace("|", "\\|") for c in tr.children if isinstance(c, Node) and c.tag in ("th", "td")] for tr in node.find("tr")]
        width = max(map(len, rows), default=0)
        if not width:
            return None
        kind, parts = "table", ["| " + " | ".join(r + [""] * (width - len(r))) + " |" for r in rows]
        md = "\n".join([parts[0], "|" + " --- |" * width, *parts[1:]])
    elif node.tag == "pre":
        kind, md = "code", "```\n" + node.text().strip() + "\n```"
    elif node.tag == "blockquote":
        kind, md = "quote", f"> {md}"
    elif node.tag == "figure":
        image, caption = node.first("img"), node.first("figcaption")
        alt, words = clean(image.attrs.get("alt")) if image is not None else "", clean(caption.text()) if caption is not None else ""
        kind, text = "image", clean(f"{alt} {words}")
        md = clean(f"{f'![{alt}]' if alt else ''} {words}")
    return {"kind": kind, "level": level, "md": md, "text": text, "parts": parts} if text and md else None


def blocks(html: str | None, base: str | None) -> list[dict]:
    """Blocks of the main part of a page in order, each with its number, kind, level, md, text and parts."""
    _, main = main_tree(html)
    out: list[dict] = []

    def add(block: dict | None) -> None:
        if block:
            out.append({"block_no": len(out), **block})

    def visit(nodes: list) -> None:
        run: list = []

        def flush() -> None:
            md = clean(_inline(run, base))
            run.clear()
            if md:
                add({"kind": "paragraph", "level": 0, "md": md, "text": clean(re.sub("[*`]", "", re.sub(r"\[([^\]]*)\]\([^)]*\)", r"\1", md))), "parts": []})

        for n in nodes:
            if isinstance(n, str):
                run.append(n)
            elif n.tag in ("span", "summary") and n.first(*_INNER):
                flush()
                visit(n.children)
            elif n.tag in _SINGLE:
                flush()
                if n.tag != "hr":
                    add(_block(n, base))
            elif n.tag in _HOLDERS:
                flush()
                visit(n.children)
            else:
                run.append(n)
        flush()

    visit(main.children)
    return out


def _folded(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", clean(text).lower()) if not unicodedata.combining(c))


def only_rendered(rendered: list[dict], raw: list[dict]) -> list[bool]:
    """Which blocks of a rendered page the raw page does not hold, as a block or (their first 120 characters) within its text."""
    whole = [_folded(b["text"]) for b in raw]
    known, joined = set(whole), " ".join(whole)
    return [bool(t := _folded(b["text"])) and t not in known and t[:120] not in joined for b in rendered]


def _pieces(block: dict, limit: int) -> list[str]:
    """A block larger than a chunk by rows, items or sentences, and these by words where one is too large itself."""
    rough = block["md"].split("\n") if block["kind"] == "table" else block["parts"] or re.split(r"(?<=[.!?])\s+", block["md"])
    out: list[str] = []
    for piece in rough:
        if tokens(piece) <= 0.9 * limit:
            out.append(piece)
            continue
        line = ""
        for word in piece.split():
            if line and tokens(f"{line} {word}") > 0.9 * limit:
                out.append(line)
                line = word
            else:
                line = f"{line} {word}".strip()
        if line:
            out.append(line)
    return out


class _Open:
    """The chunk being filled."""

    def __init__(self, headings: list[str]):
        self.headings, self.parts, self.size, self.flags, self.cut = headings, [], 0, set(), set()

    def take(self, md: str, block: dict, js: bool, piece: bool = False) -> None:
        self.parts.append(md)
        self.size += tokens(md)
        if js:
            self.flags.add("js_only")
            if KEY_DATA.search(block["text"]):
                self.flags.add("key_data_js")
        if piece:
            self.cut.add(block["block_no"])


def chunk(found: list[dict], js: list[bool] | None = None, limit: int = CHUNK) -> list[dict]:
    """Chunks of at most about ``limit`` tokens in order: chunk_no, md, tokens, headings, flags.

    A heading of level 1 or 2 begins a chunk if the open one is a quarter full; a block that
    does not fit begins one; a block above the limit is cut. Flags are those of ``FLAGS``.
    """
    js = js or [False] * len(found)
    done: list[_Open] = []
    path: dict[int, str] = {}
    at: _Open | None = None
    headings = lambda: [path[k] for k in sorted(path) if path[k]]

    def close() -> None:
        nonlocal at
        if at is not None and at.parts:
            done.append(at)
        at = None

    def open_one() -> _Open:
        nonlocal at
        at = at or _Open(headings())
        return at

    for b, only in zip(found, js):
        size = tokens(b["md"])
        if b["kind"] == "heading":
            if b["level"] <= 2 and at is not None and at.size >= limit // 4:
                close()
            for k in [k for k in path if k >= b["level"]]:
                del path[k]
            path[b["level"]] = b["text"]
            if at is not None and at.size + size > limit:
                close()
            open_one().headings = headings()
            at.take(b["md"], b, only)
        elif size <= limit:
            if at is not None and at.size + size > limit:
                close()
            open_one().take(b["md"], b, only)
        else:
            joint = " " if b["kind"] == "paragraph" else "\n"
            held: list[str] = []
            used = 0
            for piece in _pieces(b, limit):
                n = tokens(piece) + 1
                if held and used + n > limit - (at.size if at is not None else 0):
                    open_one().take(joint.join(held), b, only, True)
                    close()
                    held, used = [], 0
                held.append(piece)
                used += n
            if held:
                open_one().take(joint.join(held), b, only, True)
    close()
    spread: dict[int, int] = {}
    for c in done:
        for k in c.cut:
            spread[k] = spread.get(k, 0) + 1
    kinds = {b["block_no"]: b["kind"] for b in found}
    out = []
    for n, c in enumerate(done):
        md = "\n\n".join(c.parts)
        flags = set(c.flags) | {"split_" + {"table": "table", "list": "list"}.get(kinds[k], "paragraph") for k in c.cut if spread[k] > 1}
        if n and not c.headings:
            flags.add("no_context")
        if tokens(md) < 25:
            flags.add("tiny")
        out.append({"chunk_no": n, "md": md, "tokens": tokens(md), "headings": c.headings, "flags": [f for f in FLAGS if f in flags]})
    return out


_BLOCKS = "block_no int, kind string, level int, md string, text string, parts array<string>"
_CHUNKS = "chunk_no int, md string, tokens int, headings array<string>, flags array<string>"


def html_blocks(pages: DataFrame, key: str = "url", html: str = "html", base: str | None = None) -> DataFrame:
    """Markdown blocks of pages: key, block_no, kind, level, md, text, parts; a null or empty page has none."""
    return by_page(pages, lambda url, text: blocks(text, url), _BLOCKS, key, html, base)


def html_markdown(pages: DataFrame, key: str = "url", html: str = "html", base: str | None = None) -> DataFrame:
    """Pages as Markdown: key, title, markdown, words, images_without_alt."""

    def read(url: str | None, text: str | None) -> list[dict]:
        root, main = main_tree(text)
        title = root.first("title")
        found = blocks(text, url)
        bare = sum(not clean(n.attrs.get("alt")) for n in main.find("img"))
        return [{"title": clean(title.text()) or None if title is not None else None, "markdown": "\n\n".join(b["md"] for b in found), "words": sum(len(b["text"].split()) for b in found), "images_without_alt": bare}]

    return by_page(pages, read, "title string, markdown string, words int, images_without_alt int", key, html, base)


def html_chunks(pages: DataFrame, key: str = "url", html: str = "html", raw: str | None = None, limit: int = CHUNK) -> DataFrame:
    """Chunks of pages: key, chunk_no, md, tokens, headings, flags.

    ``raw`` names a column with the page as the server sent it: blocks that are only in
    the rendered page are flagged (null: nothing is known, nothing is flagged).
    """
    if raw is None:
        return by_page(pages, lambda url, text: chunk(blocks(text, url), limit=limit), _CHUNKS, key, html)
    mark = "\x00raw\x00"
    both = pages.withColumn("_both", F.concat(F.coalesce(F.col(html), F.lit("")), F.lit(mark), F.coalesce(F.col(raw), F.lit(mark))))

    def read(url: str | None, text: str | None) -> list[dict]:
        rendered, sent = text.split(mark, 1)
        found = blocks(rendered, url)
        return chunk(found, None if sent == mark else only_rendered(found, blocks(sent, url)), limit)

    return by_page(both, read, _CHUNKS, key, "_both")


def flag_counts(chunks: DataFrame) -> DataFrame:
    """Chunks by flag: flag, chunks; every flag has a row."""
    every = chunks.sparkSession.createDataFrame([(f,) for f in FLAGS], "flag string")
    seen = chunks.select(F.explode("flags").alias("flag")).groupBy("flag").agg(F.count("*").alias("n"))
    return every.join(seen, "flag", "left").select("flag", F.coalesce("n", F.lit(0)).alias("chunks"))
