"""Page boilerplate mixed with main content: a site style tree over Markdown pages.

Every page is a tree: page, presentation, line. The presentation of a line is prose,
plain words, an entry of a list, a link, a row of entries, a labelled value, an
arrow, a trail, a heading or structure of an article (tables, lists, quotes, code);
its content is its text with what differs from page to page masked: counts, link
targets, the end of a breadcrumb, the values after a label. The pages of a host are
merged by counting the share of pages that hold each node. The importance of a
content node is the information -ln(share) that its presence carries (the entropy of
a node spread evenly over the pages of a host is largest, its importance least); that
of a presentation node is the mean importance of the content below it. A line falls
if its content or its presentation is too unimportant; prose falls by its content
only and must be far more common than other lines, structure never falls, and a
heading falls with the links it leads to. Hosts with few pages are judged by the
tree of all hosts, in which a host's own name is masked. The title line of a page
always stays.

Texts are read once: a page becomes the numbers, presentations and hashed contents of its
lines, from which nodes are counted and, with the sets of fallen nodes, lines judged.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from almena.llm.repeated import once
from almena.session import cut_lineage

#: Hosts with fewer pages are judged by the tree of all hosts alone.
SMALL_HOST = 12
#: Share of pages from which content falls: on its host (and on at least that many pages), and over all hosts.
HOST_SHARE = {"prose": (0.17, 4), "other": (0.04, 3)}
ALL_SHARE = {"prose": 0.035, "other": 0.005}
#: A presentation falls if the content below it carries less information in the mean (natural logarithm), or less than this share of the most that so few pages can tell.
LEAST_MEAN, LEAST_OF_MOST = 3.0, 0.6
#: Share of a heading's occurrences that must lead to links or bare entries for it to fall with them.
LEADS = 0.5
#: Sets of fallen nodes of all hosts are broadcast up to this many nodes and hosts (8 bytes each), larger ones joined.
BROADCAST_NODES = 500_000
#: A heading falls only if it leads to links on this many pages, and on the share of pages from which other content falls.
LEADING_PAGES = 3
# Presentations by number; the number of its presentation is the low end of a node.
KINDS = ("body", "title", "prose", "plain", "entry", "link", "heading", "arrow", "trail", "label", "row", "leads")
BODY, TITLE, PROSE, PLAIN, ENTRY, LINK, HEADING, _, TRAIL, _, _, LEADS_TO = range(12)

_LINK = re.compile(r"\[([^\[\]]*)\]\(([^()\s]*)\)")
_ONLY_LINKS = re.compile(r"(?:\[[^\[\]]*\]\([^()\s]*\)[\s|·•,/–-]*)+\Z")
_NUMBER = re.compile(r"(?<![\w/.-])[+#]?\d+(?:[.,:]\d+)*(?![\w/-])")
_CRUMB = re.compile(r"\s+[>»›→/]\s+")
_ROW = re.compile(r"\s+[|·•]\s+|\s{2,}")
_BULLET = re.compile(r"(?:[-*+•]|\d{1,3}[.)])\s+")
_ENDS = re.compile(r"""[.!?…:;]["'»”’)\]]*\Z""")
_ARROW = re.compile(r"^(?:←|«|‹|<-)\s*\S|\S\s*(?:→|»|›|->)\Z")
_LABEL = re.compile(r"([^\W\d_][\w' ]{0,30}?):\s+(\S.*)\Z")


class Line:
    """A line of a page: number, presentation, node (hashed content), whether a blank stands before it, whether it is a first-level heading, and the hash of its words (of a trail its end)."""

    __slots__ = ("no", "kind", "node", "after_blank", "top", "name")

    def __init__(self, no: int, kind: int, node: int, after_blank: bool, top: bool = False, name: int = 0):
        self.no, self.kind, self.node, self.after_blank, self.top, self.name = no, kind, node, after_blank, top, name


def _folded(text: str) -> str:
    return re.sub(r"\s+", " ", text.casefold()).strip()


def brand_of(url: str | None) -> str:
    """The host's own name: its first label up to a hyphen, without www."""
    m = re.match(r"\w+://(?:www\.)?([^/:.-]+)", url or "")
    return m[1].casefold() if m else ""


def read_page(markdown: str, title: str | None, brand: str) -> list[Line]:
    """The lines of a page that hold text, in order."""
    out: list[Line] = []
    fence, blank = "", True
    titled = _folded(title) if title else ""
    for no, raw in enumerate(markdown.split("\n"), 1):
        text = raw.strip()
        if not text:
            blank = True
            continue
        kind, node = "body", ""
        if fence:
            if text.startswith(fence):
                fence = ""
        elif text.startswith(("```", "~~~")):
            fence = text[:3]
        elif not text.startswith(("|", ">")) and text not in ("---", "***"):
            kind, node = _node(text, titled, brand)
        number = KINDS.index(kind)
        name = 0 if title else _number(_folded(_CRUMB.split(text)[-1] if kind == "trail" else text.strip("*_ "))) if kind in ("trail", "plain") else 0
        out.append(Line(no, number, _hash(number, node) if node else 0, blank, text.startswith("# "), name))
        blank = False
    return out


def _node(text: str, titled: str, brand: str) -> tuple[str, str]:
    """Presentation and masked content of a line outside tables, quotes and code."""
    level = re.match(r"(#{1,6})\s+", text)
    words = text[level.end() :] if level else text
    bullet = None if level else _BULLET.match(words)
    if bullet:
        words = words[bullet.end() :]
    strong = re.fullmatch(r"(\*\*|__)(.+)\1", words)
    words = (strong[2] if strong else words).strip()
    folded = _folded(words)
    if not folded:
        return "body", ""
    if folded == titled:
        return "title", ""
    if _ONLY_LINKS.match(words):
        labels = _LINK.findall(words)
        return "link", "[link]" if len(labels) == 1 else _NUMBER.sub("9", _folded(" ".join(a for a, _ in labels)))
    if level:
        return "heading", folded
    if len(words) < 160 and _ARROW.search(words) and not _CRUMB.search(words.strip("←→«»‹›<>- ")):
        return "arrow", "arrow"
    crumbs = _CRUMB.split(words)
    if len(crumbs) > 1 and len(words) < 240 and len(crumbs[0]) <= 20 and not _ENDS.search(crumbs[0]):
        return "trail", _folded(crumbs[0])
    linked = _LINK.search(words)
    if linked:
        label = re.fullmatch(r"([^\W\d_][^\[\]]{0,30}?):?\s*", words[: linked.start()])
        if label and linked.end() == len(words):
            return "label", _folded(label[1])
        if linked.start() == 0 and bullet:
            return "body", ""  # an annotated link
    if bullet and re.search(r"\(/[^\s()]*\)\Z", words):
        return "body", ""
    if len(words) > 2 and words[0] == "[" and words[-1] == "]":
        words = words[1:-1]
    own = re.compile(rf"\b{re.escape(brand)}\b") if len(brand) > 2 else None
    node = _NUMBER.sub("9", _folded(words))
    node = own.sub("@", node) if own else node
    parts = len(_ROW.split(words))
    if _ENDS.search(words):
        return "prose", node
    label = _LABEL.match(words)
    if label and len(label[1].split()) <= 3 and (len(words) <= 120 or words.count(",") >= 3):
        return "label", own.sub("@", _folded(label[1])) if own else _folded(label[1])
    if len(words) > 120 and parts < 3:
        return "prose", node
    return "row" if parts > 1 else "entry" if bullet else "plain", node


def _number(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text) - (1 << 63)


def _hash(kind: int, node: str) -> int:
    """Number of a content node, with its presentation at the low end; an entry of a list has the content of plain words."""
    kind = PLAIN if kind == ENTRY else kind
    return _number(f"{KINDS[kind]}\x1f{node}") & ~15 | kind


def _leads(lines: list[Line], i: int) -> bool:
    """Whether a heading or plain line leads straight to a link or a bare entry."""
    return i + 1 < len(lines) and lines[i + 1].kind in (LINK, PLAIN, ENTRY) and not lines[i + 1].after_blank


_LINES = "page_id long, site string, titled boolean, numbers array<int>, forms array<int>, nodes array<long>, names array<long>, leads array<long>"


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pages as arrays over their lines: numbers, forms (presentation and marks), nodes, names (of pages without title), and nodes of headings that lead to links."""
    for batch in batches:
        out = []
        for page, site, url, title, markdown in zip(*(c.to_pylist() for c in batch.columns)):
            lines = read_page(markdown or "", title, brand_of(url))
            leads = [line.node & ~15 | LEADS_TO for i, line in enumerate(lines) if line.kind == HEADING and line.node and _leads(lines, i)]
            out.append((page, site, bool(title), [line.no for line in lines], [line.kind | line.after_blank << 4 | line.top << 5 for line in lines], [line.node for line in lines], [] if title else [line.name for line in lines], leads))
        columns = list(zip(*out)) if out else [()] * 8
        kinds = [pa.int64(), pa.string(), pa.bool_(), pa.list_(pa.int32()), pa.list_(pa.int32()), *[pa.list_(pa.int64())] * 3]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["page_id", "site", "titled", "numbers", "forms", "nodes", "names", "leads"])


def page_lines(pages: DataFrame, site: str = "site_id") -> DataFrame:
    """Lines of all pages as ``_LINES``, repeated rows of a page once. Read from the texts once."""
    texts = once(pages.select(F.col("page_id").cast("long"), F.col(site).cast("string").alias("site"), "url", "title", "markdown"), "page_id")
    return cut_lineage(texts.mapInArrow(_read, _LINES))


def fallen_nodes(lines: DataFrame) -> tuple[DataFrame, set[int], set[int]]:
    """What falls: per host (site, nodes, kinds; a null or small host is missing), and over all hosts.

    Both are bounded by the pages' own size, not their number: every node that falls, a heading
    too, is on a fixed share of pages. Pages without text are ignored.
    """
    held = lines.filter("size(numbers) > 0")
    each = F.array_distinct(F.concat(F.filter("nodes", lambda x: x != 0), "leads"))
    nodes = cut_lineage(held.select("site", F.explode(each).alias("node")).groupBy("site", "node").agg(F.count("*").alias("n")))
    sizes = cut_lineage(held.groupBy("site").agg(F.count("*").alias("m")))
    kind = F.col("node").bitwiseAND(F.lit(15))

    def judged(counts: DataFrame, m: DataFrame, by: list[str], least: int, share: dict) -> tuple[DataFrame, DataFrame]:
        shares = (counts.join(m, by) if by else counts.crossJoin(F.broadcast(m))).withColumns({"kind": kind, "share": F.col("n") / F.col("m")}).filter(F.col("m") >= least)
        (prose, prose_n), (other, other_n) = share["prose"], share["other"]
        falls = F.when(F.col("kind") == PROSE, (F.col("share") >= prose) & (F.col("n") >= prose_n)).when(F.col("kind").isin(HEADING, LEADS_TO), False).otherwise((F.col("share") >= other) & (F.col("n") >= other_n))
        plain = F.col("node").bitwiseAND(F.lit(~15)).bitwiseOR(F.lit(HEADING))
        leads = shares.filter(F.col("kind").isin(HEADING, LEADS_TO)).groupBy(*by, plain.alias("node")).agg(
            F.sum(F.when(F.col("kind") == HEADING, F.col("n"))).alias("all"), F.sum(F.when(F.col("kind") == LEADS_TO, F.col("n"))).alias("to_links"), F.max("m").alias("m")
        )
        leading = leads.filter((F.col("to_links") >= LEADS * F.col("all")) & (F.col("to_links") >= LEADING_PAGES) & (F.col("to_links") >= other * F.col("m")))
        low = shares.filter(falls).select(*by, "node").unionByName(leading.select(*by, "node"))
        most = F.least(F.lit(LEAST_MEAN), LEAST_OF_MOST * F.log(F.max("m")))
        means = shares.filter(~F.col("kind").isin(BODY, TITLE, PROSE, HEADING, LEADS_TO)).groupBy(*by, "kind").agg((F.sum(-F.log("share") * F.col("n")) / F.sum("n")).alias("mean"), most.alias("most"))
        return low, means.filter("mean < most").select(*by, "kind")

    low, kinds = judged(nodes, sizes, ["site"], SMALL_HOST, HOST_SHARE)
    per_host = (
        low.groupBy("site").agg(F.collect_set("node").alias("nodes"))
        .join(kinds.groupBy("site").agg(F.collect_set("kind").alias("kinds")), "site", "full")
        .join(sizes.filter(f"m >= {SMALL_HOST}").select("site"), "site", "left_semi")
    )
    everywhere = nodes.groupBy("node").agg(F.sum("n").alias("n"))
    low_all, kinds_all = judged(everywhere, sizes.agg(F.sum("m").alias("m")), [], 1, {k: (ALL_SHARE[k], HOST_SHARE[k][1]) for k in ALL_SHARE})
    return cut_lineage(per_host), {r[0] for r in low_all.collect()}, {int(r[0]) for r in kinds_all.collect()}


def body_lines(lines: list[Line], nodes: set[int], kinds: set[int], titled: bool) -> list[bool]:
    """Which lines are body; ``titled`` says whether the page came with a title."""
    stays: list[bool] = []
    end_of_trail = 0
    for i, line in enumerate(lines):
        kind = line.kind
        low = kind in kinds or (line.node != 0 and line.node in nodes)
        if kind == HEADING:
            low = low and _leads(lines, i)
        elif kind <= TITLE:
            low = False
        elif kind == ENTRY and not low:
            low = i > 0 and not stays[-1] and not line.after_blank and lines[i - 1].kind in (PLAIN, ENTRY, LINK, HEADING)
        if kind == TRAIL and low and not titled:
            end_of_trail = line.name
        stays.append(not low)
    if not titled and not any(line.kind == HEADING and line.top for line in lines):
        plain = [i for i, line in enumerate(lines) if line.kind == PLAIN and line.node not in nodes]
        named = [i for i in plain if end_of_trail and lines[i].name == end_of_trail]
        alone = [i for i in plain if lines[i].after_blank and not (i + 1 < len(lines) and not lines[i + 1].after_blank and lines[i + 1].kind in (PLAIN, LINK))]
        first_prose = next((i for i, line in enumerate(lines) if stays[i] and line.kind in (PROSE, BODY, HEADING)), len(lines))
        for i in (named or [i for i in alone if i < first_prose] or [i for i in plain if i < first_prose])[:1]:
            stays[i] = True
    return stays


def _with_hosts(rows: DataFrame, per_host: DataFrame) -> DataFrame:
    """Rows (with site) and what falls on their host; the sets of hosts are broadcast up to a measured size."""
    size = per_host.agg(F.sum(F.coalesce(F.size("nodes"), F.lit(0)) + F.lit(8))).first()[0] or 0
    hosts = per_host.withColumnsRenamed({"site": "_site", "nodes": "_nodes", "kinds": "_kinds"})
    return rows.join(F.broadcast(hosts) if size <= BROADCAST_NODES else hosts, F.col("site").eqNullSafe(F.col("_site")), "left").drop("_site")


class _Sets:
    """Fallen nodes and presentations for each page, those of a host made once."""

    def __init__(self, nodes: set[int], kinds: set[int]):
        self.nodes, self.kinds, self.known = nodes, kinds, {}

    def of(self, site: str | None, own: list[int] | None, own_kinds: list[int] | None) -> tuple[set[int], set[int]]:
        if own is None and own_kinds is None:
            return self.nodes, self.kinds
        if site not in self.known:
            self.known[site] = set(own or ()) | self.nodes, set(own_kinds or ()) | self.kinds
        return self.known[site]


def furniture_lines(pages: DataFrame) -> DataFrame:
    """Lines that are not body: page_id, line_no, once each; a null or empty page has none."""
    lines = page_lines(pages)
    per_host, nodes, kinds = fallen_nodes(lines)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = _Sets(nodes, kinds)
        for batch in batches:
            ids, numbers = [], []
            own = dict.fromkeys(batch.column("site").to_pylist())
            for site, n, k in zip(batch.column("site").to_pylist(), batch.column("_nodes"), batch.column("_kinds")):
                if own[site] is None:  # the sets of a host are turned into Python once
                    own[site] = sets.of(site, n.as_py(), k.as_py())
            rows = zip(*(batch.column(c).to_pylist() for c in ("page_id", "site", "titled", "numbers", "forms", "nodes", "names")))
            for page, site, titled, nos, forms, found, names in rows:
                names = names or [0] * len(nos)
                rebuilt = [Line(no, form & 15, node, bool(form & 16), bool(form & 32), name) for no, form, node, name in zip(nos, forms, found, names)]
                gone = [line.no for line, stay in zip(rebuilt, body_lines(rebuilt, *own[site], titled)) if not stay]
                ids += [page] * len(gone)
                numbers += gone
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(numbers, pa.int32())], names=["page_id", "line_no"])

    return _with_hosts(lines.drop("leads"), per_host).mapInArrow(run, "page_id long, line_no int")


def page_bodies(pages: DataFrame) -> DataFrame:
    """The body of each page: page_id, body, body_words; repeated rows count once, a null page has an empty body.

    The texts are read a second time here, for the bodies are made of them.
    """
    per_host, nodes, kinds = fallen_nodes(page_lines(pages))
    rows = once(pages.select(F.col("page_id").cast("long"), F.col("site_id").cast("string").alias("site"), "url", "title", "markdown"), "page_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = _Sets(nodes, kinds)
        for batch in batches:
            ids, bodies, sizes = [], [], []
            for page, site, url, title, markdown, own, own_kinds in zip(*(c.to_pylist() for c in batch.columns)):
                lines = read_page(markdown or "", title, brand_of(url))
                gone = {line.no for line, stay in zip(lines, body_lines(lines, *sets.of(site, own, own_kinds), bool(title))) if not stay}
                body = "\n".join(x for no, x in enumerate((markdown or "").split("\n"), 1) if no not in gone)
                body = re.sub(r"\n(?:[ \t]*\n){2,}", "\n\n", body).strip()
                ids.append(page)
                bodies.append(body)
                sizes.append(len(body.split()))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(bodies, pa.string()), pa.array(sizes, pa.int32())], names=["page_id", "body", "body_words"])

    return _with_hosts(rows, per_host).mapInArrow(run, "page_id long, body string, body_words int")
