"""Splitting oversized items at natural boundaries: ranges with halos, boundary tables, stitching, emission by offset.

An item is cut into ranges of fixed length, each read with a halo on either side, so
no worker ever holds a whole giant item. The worker of a range finds the boundaries in
it (headings, paragraphs, list items, rows and lines, sentences, words) under both
assumptions on whether a code block is open where the range starts, and from every
place at which a piece could start in the range's head it follows the pieces to the
first start beyond the range, counting them: where a piece ends depends only on the text
up to its limit. Stitching composes these small tables in order of the ranges, with the
prefix sums of pieces and the headings open at each range. Each worker then emits its
pieces by offset, numbered from the pieces before its range. An item of a single range
needs no stitching and is emitted at once. Items are rows (``split_items``) or whole
files (``split_files``), of which each worker reads the bytes of its range only.

Tokens are estimated as code points divided by four, rounded up.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from almena.llm.repeated import once
from almena.session import cut_lineage

CHARS_PER_TOKEN = 4
#: Code points of a range; longer limits widen it, so that a range holds several pieces.
RANGE = 32_768
# Ranks of boundaries, best first.
HEADING, PARAGRAPH, ITEM, SENTENCE, WORD = 0, 1, 2, 3, 4

_HEADING = re.compile(r"(#{1,6})[ \t]+(.*\S)[ \t]*")
_FENCE = re.compile(r"[ \t]{0,3}(```|~~~)")
_STRUCTURE = re.compile(r"^(?:[ \t]{0,3}(```|~~~).*|#{1,6}[ \t].*)", re.MULTILINE)
_SENTENCE = re.compile(r"(?:[.!?…]+[\"'»”’)\]]*(?=\s)|[。！？؟।]+[」』”]?)\s*")
_ENTRY = re.compile(r"[ \t]*(?:[-*+•]|\d{1,4}[.)])[ \t]+|[ \t]*\|")


def boundaries(text: str, start: int, end: int, fenced: bool, torn: bool = False) -> tuple[list[int], list[int], list[tuple[int, int, str]], bool]:
    """Boundaries of a text between two of its line starts or range limits.

    Returns places (a piece may end there and the next begin), their ranks, headings as
    (place, level, words), and whether a code block is open at ``end``. ``start`` is a
    line start unless it is inside a long line; ``torn`` says that the text begins inside one.
    """
    places: dict[int, int] = {}
    headings: list[tuple[int, int, str]] = []
    at, blank = start, False

    def mark(place: int, rank: int) -> None:
        if start < place <= end and rank < places.get(place, 9):
            places[place] = rank

    while at < end:
        stop = text.find("\n", at)
        stop = len(text) if stop < 0 else stop
        line = text[at : min(stop, end)]
        whole = not torn if at == 0 else text[at - 1] == "\n"
        fence = whole and _FENCE.match(line)
        if fence:
            mark(at, PARAGRAPH if not fenced else ITEM)
            fenced = not fenced
        elif fenced:
            mark(at, ITEM if not blank else PARAGRAPH)
        elif line.strip():
            head = whole and _HEADING.fullmatch(text[at:stop].rstrip("\r"))
            if head:
                headings.append((at, len(head[1]), head[2]))
                mark(at, HEADING)
            elif whole:
                mark(at, PARAGRAPH if blank else ITEM)
            for m in _SENTENCE.finditer(line):
                if m.end() < len(line):
                    mark(at + m.end(), SENTENCE)
        blank = whole and not line.strip()
        for m in re.finditer(r"\s+", line):
            mark(at + m.end(), WORD)
        at = stop + 1
        if stop < len(text):
            mark(at, ITEM)
    order = sorted(places)
    return order, [places[p] for p in order], headings, fenced


def structure(text: str, start: int, end: int, fenced: bool) -> tuple[list[tuple[int, int, str]], bool]:
    """Headings of the lines that begin from ``start`` up to ``end`` and whether a code block is open after them."""
    headings = []
    for m in _STRUCTURE.finditer(text, start, len(text)):
        if m.start() >= end:
            break
        if m[1]:
            fenced = not fenced
        elif not fenced and (head := _HEADING.fullmatch(m[0].rstrip("\r"))):
            headings.append((m.start(), len(head[1]), head[2]))
    return headings, fenced


class Cutter:
    """Where pieces of a text end, given its boundaries; all places are offsets of the item."""

    def __init__(self, base: int, text: str, total: int, places: list[int], ranks: list[int], limit: int, overlap: int):
        self.base, self.text, self.total, self.limit = base, text, total, limit
        self.overlap = min(overlap, limit // 2)
        self.places = [base + p for p in places]
        self.by_rank = [[p for p, r in zip(self.places, ranks) if r <= k] for k in range(5)]

    def begin(self, cut: int) -> int:
        """Where the piece after ``cut`` begins: about the overlap before it, at a word or better."""
        if not self.overlap or cut == 0:
            return cut
        low, high = cut - self.overlap, cut - self.overlap // 2
        for rank in (SENTENCE, WORD):
            i = bisect.bisect_left(self.by_rank[rank], low)
            if i < len(self.by_rank[rank]) and self.by_rank[rank][i] <= high:
                return self.by_rank[rank][i]
        return self._whole(low)

    def end(self, cut: int) -> int:
        """Where the piece that goes on from ``cut`` ends: the best boundary in the later half of its room."""
        begin = self.begin(cut)
        room = begin + self.limit
        if room >= self.total:
            return self.total
        for rank in range(5):
            least = max(cut, begin + self.overlap, begin + self.limit // (2 if rank < SENTENCE else 4))  # the next piece begins after this one
            i = bisect.bisect_right(self.by_rank[rank], room) - 1
            if i >= 0 and self.by_rank[rank][i] > least:
                return self.by_rank[rank][i]
        return max(cut + 1, begin + self.overlap + 1, self._whole(room))

    def _whole(self, place: int) -> int:
        """A hard cut is moved back from between a character and its marks or a line end's two halves."""
        i = place - self.base
        while i > 1 and i < len(self.text) and (self._joins(self.text[i]) or self.text[i - 1 : i + 1] == "\r\n" or self.text[i - 1] == "‍"):
            i -= 1
            if place - self.base - i > 16:
                return place
        return self.base + i

    @staticmethod
    def _joins(c: str) -> bool:
        return "̀" <= c <= "ͯ" or "︀" <= c <= "️" or c in "‍⃣" or "\U0001f3fb" <= c <= "\U0001f3ff"


def _open_headings(before: list[tuple[int, str]], more: list[tuple[int, int, str]]) -> list[tuple[int, str]]:
    """The headings open after ``more``: a heading closes those of its own and deeper levels."""
    stack = list(before)
    for _, level, words in more:
        while stack and stack[-1][0] >= level:
            stack.pop()
        stack.append((level, words))
    return stack


class Range:
    """One range of an item with its halos, analysed for a given state of code blocks at its start."""

    def __init__(self, item_length: int, first: int, last: int, base: int, text: str, limit: int, overlap: int, fenced: bool):
        self.first, self.last, self.base, self.text = first, last, base, text
        a, b = first - base, last - base
        own = min(a if a == 0 or text[a - 1] == "\n" else (text.find("\n", a) + 1 or len(text)), len(text))
        # code blocks are counted from the range's own first line on; before it the state is turned back by every fence of the halo
        turned = sum(1 for m in _STRUCTURE.finditer(text, 0, own) if m[1] and (m.start() or not base))
        order, ranks, _, _ = boundaries(text, 0, len(text), fenced ^ (turned % 2 == 1), base > 0)
        until = text.find("\n", b) + 1 if b < len(text) and not (b and text[b - 1] == "\n") else b
        found, self.fenced_after = structure(text, own, until or len(text), fenced)
        self.headings = [(base + p, level, words) for p, level, words in found]
        self.cutter = Cutter(base, text, item_length, order, ranks, limit, overlap)

    def follow(self, cut: int) -> tuple[list[tuple[int, int]], int]:
        """Pieces (begin, end) that start at ``cut`` or after it within the range, and the first cut beyond."""
        out = []
        while cut < self.last:
            end = self.cutter.end(cut)
            out.append((self.cutter.begin(cut), end))
            cut = end
        return out, cut

    def entries(self, upto: int) -> list[int]:
        """Places up to ``upto`` at which a piece could begin: boundaries, and where a hard cut can fall.

        A hard cut is made only if the latter half of the room has no boundary, so it is at least that far behind one.
        """
        far = max(0, self.cutter.limit // 2 - 40)
        places = self.cutter.places
        out = {self.first}
        if not places or places[0] > self.first:
            out.update(range(self.first, min(upto, places[0] if places else upto) + 1))
        for i, place in enumerate(places):
            if place > upto:
                break
            beyond = places[i + 1] if i + 1 < len(places) else upto + 1
            if place >= self.first:
                out.add(place)
            if beyond - place > far:
                out.update(range(max(self.first, place + far), min(upto, beyond) + 1))
        return sorted(out)

    def exits(self, upto: int) -> tuple[list[int], list[int], list[int]]:
        """First cut beyond the range and number of pieces up to it, from every possible entry up to ``upto``: entries, exits, pieces."""
        known: dict[int, tuple[int, int]] = {}

        def exit_of(cut: int) -> tuple[int, int]:
            way = []
            while cut < self.last and cut not in known:
                way.append(cut)
                cut = self.cutter.end(cut)
            end, n = known.get(cut, (cut, 0))
            for place in reversed(way):
                n += 1
                known[place] = end, n
            return end, n

        begins = self.entries(upto)
        found = [exit_of(cut) for cut in begins]
        return begins, [end for end, _ in found], [n for _, n in found]

    def pieces(self, cut: int, open_: list[tuple[int, str]], given: list[str]) -> list[tuple[int, int, str, list[str]]]:
        found, _ = self.follow(cut)
        out, stack, at = [], list(open_), 0
        for begin, end in found:
            upto = at
            while upto < len(self.headings) and self.headings[upto][0] <= begin:
                upto += 1
            if upto > at or not out:
                stack, at = _open_headings(stack, self.headings[at:upto]), upto
            out.append((begin, end, self.text[begin - self.base : end - self.base], given + [w for _, w in stack]))
        return out


_PIECES = "item_id long, piece_no int, begin long, finish long, md string, headings array<string>, n_pieces int"
_RANGE_COLUMNS = ["item_id", "first", "last", "base", "text", "length", "limit", "overlap", "headings"]


def oversized_ranges(items: DataFrame, size: int = RANGE) -> DataFrame:
    """Ranges of the items above their limit: item_id, first, last, base, text with halos, length, limit, overlap, headings."""
    limit = F.when(F.col("max_tokens").isNotNull(), F.greatest(F.col("max_tokens"), F.lit(1)) * CHARS_PER_TOKEN)
    clean = items.select(
        F.col("item_id").cast("long"), F.coalesce("md", F.lit("")).alias("md"), limit.cast("int").alias("limit"),
        (F.greatest(F.coalesce("overlap_tokens", F.lit(0)), F.lit(0)) * CHARS_PER_TOKEN).cast("int").alias("overlap"), F.coalesce(F.expr("filter(headings, h -> h IS NOT NULL)"), F.array().cast("array<string>")).alias("headings"),
    ).withColumn("length", F.length("md"))
    large = clean.filter("`limit` IS NOT NULL AND length > `limit`").withColumn("_range", F.greatest(F.lit(size), F.col("limit") * 4))
    spread = large.select("*", F.explode(F.sequence(F.lit(0), F.floor((F.col("length") - 1) / F.col("_range")).cast("int"))).alias("_no"))
    first = F.col("_no") * F.col("_range")
    base = F.greatest(F.lit(0), first - F.least(F.col("overlap"), F.floor(F.col("limit") / 2).cast("int")) - 64)
    last = F.least(F.col("length"), first + F.col("_range"))
    return spread.select(
        "item_id", first.cast("long").alias("first"), last.cast("long").alias("last"), base.cast("long").alias("base"),
        F.substring("md", (base + 1).cast("int"), (last + F.col("limit") + 256 - base).cast("int")).alias("text"), F.col("length").cast("long").alias("length"), "limit", "overlap", "headings",
    )


def _analysed(row: tuple, fenced: bool) -> Range:
    _, first, last, base, text, length, limit, overlap, _ = row
    return Range(length, first, last, base, text, limit, overlap, fenced)


def _survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per range and state of code blocks: entries, exits, pieces, headings, state after."""
    for batch in batches:
        out: list[tuple] = []
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            for fenced in (False, True) if row[1] else (False,):
                r = _analysed(row, fenced)
                # an overlap may reach back by a few characters more, and so may the entry lie that much further on
                table = r.exits(min(row[1] + row[6] + 64, row[2] - 1) if row[1] else 0)
                out.append((row[0], row[1], row[2], fenced, *table, [level for _, level, _ in r.headings], [w for _, _, w in r.headings], r.fenced_after))
        columns = list(zip(*out)) if out else [()] * 10
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.string()), pa.bool_()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["item_id", "first", "last", "fenced", "entries", "exits", "pieces", "levels", "words", "fenced_after"])


def _stitch(pdf: pd.DataFrame) -> pd.DataFrame:
    """Compose the tables of one item in order: the true entry, state, open headings and pieces before every range."""
    tables = {(first, fenced): rest for first, fenced, *rest in zip(pdf["first"], pdf["fenced"], pdf["last"], pdf["entries"], pdf["exits"], pdf["pieces"], pdf["levels"], pdf["words"], pdf["fenced_after"])}
    cut, fenced, open_, before, out = 0, False, [], 0, []
    for first in sorted(set(pdf["first"])):
        last, entries, exits, pieces, levels, words, after = tables[first, fenced]
        out.append((first, fenced, cut, [level for level, _ in open_], [w for _, w in open_], before))
        if cut < last:
            i = bisect.bisect_left(entries, cut)
            if i == len(entries) or entries[i] != cut:
                raise ValueError(f"no piece was expected to begin at {cut} of item {pdf['item_id'].iloc[0]}")
            cut, before = int(exits[i]), before + int(pieces[i])
        open_ = _open_headings(open_, [(0, int(level), w) for level, w in zip(levels, words)])
        fenced = bool(after)
    columns = list(zip(*out))
    return pd.DataFrame({"item_id": pdf["item_id"].iloc[0], **dict(zip(("first", "fenced", "cut", "open_levels", "open_words", "before"), columns)), "n_pieces": before})


def _split_ranges(ranges: DataFrame) -> DataFrame:
    """Numbered pieces of items given as ranges with halos."""

    def emit_single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                found = _analysed(row, False).pieces(0, [], row[8])
                out += [(row[0], n, *p, len(found)) for n, p in enumerate(found, 1)]
            yield _pieces_batch(out)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[10] < row[2]:
                    found = _analysed(row[:9], row[9]).pieces(row[10], list(zip(row[11], row[12])), row[8])
                    out += [(row[0], row[13] + n, *p, row[14]) for n, p in enumerate(found, 1)]
            yield _pieces_batch(out)

    single = ranges.filter("first = 0 AND last = length").mapInArrow(emit_single, _PIECES)
    several = ranges.filter("NOT (first = 0 AND last = length)")
    tables = several.mapInArrow(_survey, "item_id long, first long, last long, fenced boolean, entries array<long>, exits array<long>, pieces array<int>, levels array<int>, words array<string>, fenced_after boolean")
    entry = tables.groupBy("item_id").applyInPandas(_stitch, "item_id long, first long, fenced boolean, cut long, open_levels array<int>, open_words array<string>, before int, n_pieces int")
    stitched = several.join(entry, ["item_id", "first"]).select(*_RANGE_COLUMNS, "fenced", "cut", "open_levels", "open_words", "before", "n_pieces").mapInArrow(emit, _PIECES)
    return single.unionByName(stitched)


def _with_tokens(pieces: DataFrame, key: str = "item_id") -> DataFrame:
    return pieces.select(key, "piece_no", "begin", "finish", "md", F.ceil(F.length("md") / CHARS_PER_TOKEN).cast("int").alias("tokens"), "headings", "n_pieces")


def split_items(items: DataFrame, size: int = RANGE) -> DataFrame:
    """Pieces of every item: item_id, piece_no, begin, finish, md, tokens, headings, n_pieces.

    Pieces come in order; each is within max_tokens, begins about overlap_tokens before the
    end of the one before, and keeps the item's headings and those open where it begins.
    Items within the limit, and those without a limit, are one piece; a null or empty md
    is one empty piece. Repeated rows of an item count once.
    """
    single = once(items.select("item_id", "md", "max_tokens", "overlap_tokens", "headings"), "item_id")
    whole = single.filter("max_tokens IS NULL OR ceil(length(coalesce(md, '')) / 4.0) <= greatest(max_tokens, 1)").select(
        F.col("item_id").cast("long"), F.lit(1).alias("piece_no"), F.lit(0).cast("long").alias("begin"), F.length(F.coalesce("md", F.lit(""))).cast("long").alias("finish"), F.coalesce("md", F.lit("")).alias("md"),
        F.coalesce(F.expr("filter(headings, h -> h IS NOT NULL)"), F.array().cast("array<string>")).alias("headings"), F.lit(1).alias("n_pieces"),
    )
    return _with_tokens(whole.unionByName(_split_ranges(oversized_ranges(single, size))))


def split_files(spark: SparkSession, folder: str, max_tokens: int, overlap_tokens: int = 0, size: int = RANGE) -> DataFrame:
    """Pieces of UTF-8 text files, however large: path, piece_no, begin, finish, md, tokens, headings, n_pieces.

    ``folder`` (or a file) lies in a file system that all workers reach. Each file is cut into byte ranges; a
    first pass counts the characters of every range, whose prefix sums are the offsets
    of the ranges, and later ones read a range with its halos only. Bytes that are no
    UTF-8 are replaced; an empty file has no piece.
    """
    if max_tokens < 1:
        raise ValueError("a piece must have room for a token")
    limit, overlap = max_tokens * CHARS_PER_TOKEN, max(0, overlap_tokens) * CHARS_PER_TOKEN
    step = max(size, 4 * limit)
    files = spark.read.format("binaryFile").load(folder).select("path", F.col("length").alias("bytes"))
    ranges = files.select("path", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0).cast("long"), F.floor((F.col("bytes") - 1) / step).cast("long")))).alias("no")).repartition("path", "no")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = list(zip(*(c.to_pylist() for c in batch.columns)))
            sizes = [_characters(_read_bytes(path, no * step, min(total, (no + 1) * step))) for path, total, no in rows]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sizes, pa.int64())], names=["path", "bytes", "no", "chars"])

    sized = cut_lineage(ranges.mapInArrow(counted, "path string, bytes long, no long, chars long"))
    upto = Window.partitionBy("path").orderBy("no")
    placed = sized.withColumn("last", F.sum("chars").over(upto)).withColumn("length", F.sum("chars").over(Window.partitionBy("path")))
    placed = placed.select(F.xxhash64("path").alias("item_id"), (F.col("last") - F.col("chars")).alias("first"), "last", "path", "bytes", "no", "length").filter("first < last")
    halo = min(overlap, limit // 2) + 64

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for item, first, last, path, total, no, length in zip(*(c.to_pylist() for c in batch.columns)):
                start, end = no * step, min(total, (no + 1) * step)
                before = _read_bytes(path, max(0, start - 4 * halo), start).decode("utf-8", "replace")[-halo:]
                text = _read_bytes(path, start, min(total, end + 4 * (limit + 256))).decode("utf-8", "replace")[: last - first + limit + 256]
                out.append((item, first, last, first - len(before), before + text, length, limit, overlap, []))
            columns = list(zip(*out)) if out else [()] * 9
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.string())]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=_RANGE_COLUMNS)

    texts = placed.mapInArrow(read, "item_id long, first long, last long, base long, text string, length long, `limit` int, overlap int, headings array<string>")
    names = files.select(F.xxhash64("path").alias("item_id"), "path")
    pieces = _split_ranges(texts).join(names, "item_id")
    return _with_tokens(pieces.drop("item_id"), "path")


def _read_bytes(path: str, start: int, end: int) -> bytes:
    """Whole characters of a file from the first that begins at ``start`` or later to the last that begins before ``end``."""
    from pyarrow import fs

    system, name = fs.FileSystem.from_uri(path.replace("file:///", "file:/").replace("file:/", "file:///") if path.startswith("file:") else path)
    with system.open_input_file(name) as f:
        data = f.read_at(end - start + 3, start)
    skip = 0
    while start and skip < min(3, len(data)) and data[skip] & 0xC0 == 0x80:
        skip += 1
    stop = max(skip, end - start)
    while stop < len(data) and data[stop] & 0xC0 == 0x80:
        stop += 1
    return data[skip:stop]


def _characters(data: bytes) -> int:
    return len(data.decode("utf-8", "replace"))


def _pieces_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * 7
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.string()), pa.int32()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["item_id", "piece_no", "begin", "finish", "md", "headings", "n_pieces"])
