"""Template residue and error-page text: positive-unlabelled naive Bayes by expectation-maximization.

A page is read as units: passages (the blocks of its content, code and quotations taken
out) and marks (places in title, description or content that look like a variable of a
template or a printed missing value, with the words beside them). Fixed cues name
trusted records: filler words, the message of an error page that is all there is, the
syntax of a template language, a missing value where a template has a slot. All other
units are unlabelled. Two naive Bayes models, filler, notice or ordinary for passages and
placeholder or ordinary for marks, start from the trusted units and, by
expectation-maximization over all unlabelled ones, learn what else either kind says.
Cues serve to label the fit only: every unit is scored, and the scores decide. A page is
residue if it has a mark that is a placeholder, a block that is filler, or nothing but
blocks that are notices.

Units are read once and kept as numbers of words. A round of the fit is one pass over all
of them: partitions add up expected counts per feature, which is one of ``SLOTS``
hashed numbers, so that the model has the same size however much is read.
"""

from __future__ import annotations

import html
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from almena.llm.words import fold
from almena.session import cut_lineage

#: Hashed features of the models (words, pairs of words, form).
SLOTS = 1 << 18
#: Rounds of the fit at most; it ends once the numbers of units of each class settle to a share of all.
ROUNDS, SETTLED = 8, 1e-4
#: Share of the common distribution by which each class is smoothed.
COMMON = 0.03
#: Share of all units that a kind of residue is taken to have at most, before a unit is seen.
MOST_SHARE = 0.05
FILLER, NOTICE, ORDINARY = 0, 1, 2
PLACEHOLDER_MARK = 0
#: Families of units: what a unit is.
PASSAGE, MARK = 0, 1
#: Posterior from which a unit counts.
LEAST = 0.5
#: Words up to which a cue for a notice, or for filler, labels a passage for the fit; scores have no such bound.
LABEL_NOTICE, LABEL_FILLER = 40, 16

_NAME = r"[A-Za-zÀ-ÿ][\wÀ-ÿ.-]*"
# The ways in which template languages mark a variable or a tag.
PLACEHOLDER = re.compile(
    rf"\{{\{{\{{?\s*[#/&>^]?\s*{_NAME}|{_NAME}\s*\}}\}}|\$\{{\s*{_NAME}\s*\}}|<%[=\-]?\s*{_NAME}|\{{%[-\s]*{_NAME}|(?<![\w$}}])\{{{_NAME}\}}|\[\[\s*{_NAME}\s*\]\]"
    rf"|(?<![\w%\d])%{_NAME}%(?!\w)|(?<!\w)__{_NAME}__(?!\w)|(?<![\w&])#{_NAME}#(?!\w)|@@{_NAME}@@|\{{\{{\s*\}}\}}"
)
# What programs print for a missing value; the second group are also ordinary words.
MISSING = re.compile(r"(?<![\w.])(?:NaN|#N/A|#REF!|#VALUE!|#N/D|\[object Object\]|XXXX+|<null>|\(null\))(?![\w.]\w)")
MISSING_WORD = re.compile(r"(?<![\w.])(?:undefined|null|nil|None|N/A|n/a|NULL)(?!\w)")
# Words of the usual filler text, and cues that prove a passage of either kind.
LATIN = frozenset(
    "lorem ipsum dolor amet consectetur adipiscing elit nulla magna aliqua tempor tellus lectus risus arcu mauris velit semper felis porta lacinia congue vitae ligula urna massa nisi justo orci vestibulum".split()
)
FILLER_CUES = re.compile(
    r"^(todo|fixme)\s*:|\b(coming soon|proximamente|under construction|en construccion|goes here|text here|copy here|content here|to be added|to be defined|to follow|will be written|your own copy|sample (text|description|copy|paragraph)|placeholder text|dummy text|tbd"
    r"|insert\b.{0,40}\bhere|add\b.{0,60}\bhere|write\b.{0,40}\bhere|texto de (relleno|ejemplo|muestra|prueba)|parrafo de (muestra|ejemplo|relleno)|escriba aqui|inserte aqui|aqui va|por definir"
    r"|pendiente de (redactar|revisar|definir|escribir)|antes de publicar|no publicar|contenido de ejemplo|descripcion provisional|(texto|contenido|descripcion) pendiente)\b"
)
NOTICE_CUES = re.compile(
    r"\b(not found|no encontrad[ao]|no encontramos|no existe|could not be found|page is missing|bad gateway|gateway time-?out|service unavailable|servicio no disponible|internal server error|error interno"
    r"|too many requests|demasiadas solicitudes|access denied|acceso denegado|forbidden|do not have permission|no tiene permiso|has been blocked|session (has )?expired|sesion (ha )?(caduc|expir)\w*|log in again|inicie sesion"
    r"|maintenance|mantenimiento|database connection|sqlstate|fatal error|traceback|uncaught|stack trace|undefined array key|upstream|javascript|noscript|scripts?|browser|navegador|captcha|not a robot|no es un robot|algo salio mal|something went wrong)\b"
)
_BLOCK = re.compile(r"<\s*(/?)\s*(p|div|h[1-6]|ul|ol|li|table|tr|td|th|section|article|noscript|br|pre|blockquote|main|header|footer|body|html)\b[^<>]*>", re.IGNORECASE)
_CODE = re.compile(r"<\s*(code|pre|script|style|kbd|samp|blockquote|q)\b[^<>]*>.*?<\s*/\s*\1\s*>|`[^`]*`", re.IGNORECASE | re.DOTALL)
_QUOTED = re.compile(r"«[^«»]{0,200}»|“[^“”]{0,200}”")
_TAG = re.compile(r"<[/!?A-Za-z][^<>]*>")
_LINKS = re.compile(r"<a\b[^<>]*>.*?</a\s*>", re.IGNORECASE | re.DOTALL)
#: What looks like a mark: any bracketed name, and the fixed values above.
_BRACKETED = re.compile(r"[\[{]\s*([\w.-]+)\s*[\]}]")
_SIGNS = ("{", "[", "}}", "<%", "__", "@@", "NaN", "XXX", "#N/", "#REF", "#VAL", "null", "undefined", "nil", "None", "N/A", "n/a", "NULL")
_SIGNED = re.compile("[%#][A-Za-zÀ-ÿ]")
_WORD = re.compile(r"(?<![\w.])(?:undefined|null|nil|None|N/A|n/a|NULL)(?!\w)")
# Words of the usual filler text, and cues that prove a passage of either kind.
LATIN = frozenset(
    "lorem ipsum dolor amet consectetur adipiscing elit nulla magna aliqua tempor tellus lectus risus arcu mauris velit semper felis porta lacinia congue vitae ligula urna massa nisi justo orci vestibulum".split()
)
FILLER_CUES = re.compile(
    r"^(todo|fixme)\s*:|\b(coming soon|proximamente|under construction|en construccion|goes here|text here|copy here|content here|to be added|to be defined|to follow|will be written|your own copy|sample (text|description|copy|paragraph)|placeholder text|dummy text|tbd"
    r"|insert\b.{0,40}\bhere|add\b.{0,60}\bhere|write\b.{0,40}\bhere|texto de (relleno|ejemplo|muestra|prueba)|parrafo de (muestra|ejemplo|relleno)|escriba aqui|inserte aqui|aqui va|por definir"
    r"|pendiente de (redactar|revisar|definir|escribir)|antes de publicar|no publicar|contenido de ejemplo|descripcion provisional|(texto|contenido|descripcion) pendiente)\b"
)
NOTICE_CUES = re.compile(
    r"\b(not found|no encontrad[ao]|no encontramos|no existe|could not be found|page is missing|bad gateway|gateway time-?out|service unavailable|servicio no disponible|internal server error|error interno"
    r"|too many requests|demasiadas solicitudes|access denied|acceso denegado|forbidden|do not have permission|no tiene permiso|has been blocked|session (has )?expired|sesion (ha )?(caduc|expir)\w*|log in again|inicie sesion"
    r"|maintenance|mantenimiento|database connection|sqlstate|fatal error|traceback|uncaught|stack trace|undefined array key|upstream|javascript|noscript|scripts?|browser|navegador|captcha|not a robot|no es un robot|algo salio mal|something went wrong)\b"
)
_BLOCK = re.compile(r"<\s*(/?)\s*(p|div|h[1-6]|ul|ol|li|table|tr|td|th|section|article|noscript|br|pre|blockquote|main|header|footer|body|html)\b[^<>]*>", re.IGNORECASE)
_CODE = re.compile(r"<\s*(code|pre|script|style|kbd|samp|blockquote|q)\b[^<>]*>.*?<\s*/\s*\1\s*>|`[^`]*`", re.IGNORECASE | re.DOTALL)
_QUOTED = re.compile(r"«[^«»]{0,200}»|“[^“”]{0,200}”")
_TAG = re.compile(r"<[/!?A-Za-z][^<>]*>")
_LINKS = re.compile(r"<a\b[^<>]*>.*?</a\s*>", re.IGNORECASE | re.DOTALL)
#: What looks like a mark: any bracketed name, and the fixed values above.
_BRACKETED = re.compile(r"[\[{]\s*([\w.-]+)\s*[\]}]")
_MAYBE = re.compile(r"[\[\]{}$%_#@<(/]|NaN|XXX|undefined|null|nil|None|NULL")
_WORD = re.compile(r"[a-z]+(?:'[a-z]+)?|[0-9]+|[#%{}\[\]<>$_]+")


class Passage:
    """A passage: its place (title, description, heading, block), text, whether it is body, and a page's only body."""

    __slots__ = ("place", "text", "body", "sole", "bare", "folded", "words", "latin")

    def __init__(self, place: str, text: str, body: bool = False, sole: bool = False, bare: str = ""):
        self.place, self.text, self.body, self.sole, self.bare = place, text, body, sole, bare
        self.folded = fold(bare or text)
        self.words = _WORD.findall(self.folded)
        self.latin = sum(map(LATIN.__contains__, self.words)) >= 0.5 * len(self.words) > 1


def _plain(fragment: str) -> str:
    if "<" in fragment:
        fragment = _TAG.sub(" ", fragment)
    if "&" in fragment:
        fragment = html.unescape(fragment)
    return " ".join(fragment.split())


def _unquoted(text: str) -> str:
    return _QUOTED.sub(" ", text) if "«" in text or "“" in text else text


def _without_code(text: str) -> str:
    return _CODE.sub(" ", text) if "<" in text or "`" in text else text


def passages(title: str | None, description: str | None, content: str | None) -> list[Passage]:
    """The passages of a page, code and quotations left out; null and empty parts have none."""
    out = [Passage(place, _unquoted(_plain(_without_code(text)))) for place, text in (("title", title), ("description", description)) if text]
    blocks: list[tuple[bool, str, str]] = []
    at, heading = 0, False
    text = _without_code(content or "")
    for m in [*_BLOCK.finditer(text), None]:
        piece = text[at : m.start() if m else len(text)]
        if piece.strip():
            whole = _unquoted(_plain(piece))
            blocks.append((heading, whole, _unquoted(_plain(_LINKS.sub(" ", piece))) if "<" in piece else whole))
        if m:
            at = m.end()
            heading = not m[1] and m[2][0] in "hH" and m[2][1:].isdigit()
    body = [b for b in blocks if not b[0] and b[2]] or [b for b in blocks if b[2]][:1]
    for is_heading, whole, bare in blocks:
        if whole:
            is_body = (is_heading, whole, bare) in body
            out.append(Passage("heading" if is_heading else "block", whole, is_body, is_body and len(body) == 1, bare))
    return out


class _Numbers(dict):
    """Number of a word or feature, above 0; all numbers written in digits have the same."""

    def __missing__(self, word: str) -> int:
        if len(self) >= 400_000:
            self.clear()
        self[word] = n = self["0"] if word.isdigit() and word != "0" else (zlib.crc32(word.encode()) >> 1) + 1
        return n


def forms(p: Passage) -> list[str]:
    """What is known of a passage's form."""
    n = len(p.words)
    out = ["<sole>"] * 2 * p.sole + ["<empty>" if not n else "<short>" if n <= 12 else "<long>"]
    if n >= 3 and len(set(p.words)) == 1:
        out += ["<same>"] * 4
    if p.latin:
        out += ["<latin>"] * 4
    return out


def trusted_kind(p: Passage) -> int:
    """The class for which a fixed cue labels a passage, or -1."""
    words, text = p.words, p.folded
    if len(words) >= 3 and (p.latin or len(set(words)) == 1):
        return FILLER
    if len(words) <= LABEL_FILLER and FILLER_CUES.search(text):
        return FILLER
    if p.sole and len(words) <= LABEL_NOTICE and NOTICE_CUES.search(text):
        return NOTICE
    return -1


def _neighbour(text: str, at: int) -> str:
    words = re.findall(r"[^\W\d_]+|[|:.,;!?]", fold(text))
    return words[at] if words else ""


def marks(text: str, place: str, names: frozenset[str], slots: frozenset[tuple[str, str]]) -> Iterator[tuple[int, list[str]]]:
    """Marks of a passage: label (placeholder if a cue proves it, else -1) and features.

    ``names`` are the variables of the templates, ``slots`` the words before and after
    their places.
    """
    if not any(sign in text for sign in _SIGNS) and not (("%" in text or "#" in text) and _SIGNED.search(text)):
        return
    for pattern, syntax in ((PLACEHOLDER, True), (MISSING, True), (_BRACKETED, False), (MISSING_WORD, False)):
        for m in pattern.finditer(text):
            beside = _neighbour(text[max(0, m.start() - 80) : m.start()], -1), _neighbour(text[m.end() : m.end() + 80], 0)
            inner = re.findall(r"[^\W_][\w.-]*", m[0])
            named = any(fold(x) in names for x in inner)
            shape = re.sub(r"[^\W\d_][\w.-]*", "x", m[0]) if pattern is not MISSING_WORD else m[0]
            in_slot = beside in slots or beside == ("", "")
            label = PLACEHOLDER_MARK if syntax or (pattern is _BRACKETED and named) or (pattern is MISSING_WORD and in_slot) else -1
            kind = "syntax" if syntax else "bracket" if pattern is _BRACKETED else "missing"
            where = "named" if named else "slot" if in_slot and kind == "missing" else "free"
            yield label, [f"<{kind}>", f"<{shape}>", f"<{kind} {where}>", f"<{kind} {where}>", f"<before> {beside[0]}", f"<after> {beside[1]}", f"<in> {place}"]


def template_slots(templates: DataFrame) -> tuple[frozenset[str], frozenset[tuple[str, str]]]:
    """Variables of the templates and the words around them. The template table is fixed in size."""
    names, slots = set(), set()
    for row in templates.select(*(F.col(c).cast("string") for c in templates.columns if c.endswith("_template"))).collect():
        for text in row:
            for p in passages(None, None, text or ""):
                for m in re.finditer(r"\{\{\s*([\w.-]+)\s*\}\}", p.text):
                    names.add(fold(m[1]))
                    slots.add((_neighbour(re.sub(r"\{\{.*?\}\}", " ", p.text[: m.start()]), -1), _neighbour(re.sub(r"\{\{.*?\}\}", " ", p.text[m.end() :]), 0)))
    return frozenset(names), frozenset(slots - {("", "")})


_UNITS = "page_id long, family int, label int, body boolean, numbers array<int>"
_UNIT_KINDS = [pa.int64(), pa.int8(), pa.int8(), pa.bool_(), pa.list_(pa.int32())]


def read_units(pages: DataFrame, templates: DataFrame) -> DataFrame:
    """Units of all pages: page_id, family, label, body, numbers (of words in order, then 0 and each feature of the form)."""
    names, slots = template_slots(templates)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = _Numbers()
        for batch in batches:
            out = []
            for page, title, description, content in zip(*(c.to_pylist() for c in batch.columns)):
                for p in passages(title, description, content):
                    for label, found in marks(p.text, p.place, names, slots):
                        out.append((page, MARK, label, False, [x for f in found for x in (0, number[f])]))
                    if p.place == "block" or p.sole:
                        words = [number[w] for w in p.words]
                        out.append((page, PASSAGE, trusted_kind(p), p.body, words + [x for f in forms(p) for x in (0, number[f])]))
            columns = list(zip(*out)) if out else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, _UNIT_KINDS)], names=["page_id", "family", "label", "body", "numbers"])

    texts = pages.select(F.col("page_id").cast("long"), "title", "meta_description", "content")
    return texts.mapInArrow(run, _UNITS.replace("family int, label int", "family byte, label byte"))


class Model:
    """Log-probabilities of the hashed features by family and class, and the shares of the classes."""

    def __init__(self, logs: np.ndarray, prior: np.ndarray):
        self.logs, self.prior = logs.astype(np.float32), prior

    def posterior(self, family: np.ndarray, unit: np.ndarray, slot: np.ndarray) -> np.ndarray:
        """Posterior of every unit; ``unit`` and ``slot`` are its features."""
        score = self.prior[family].copy()
        for c in range(3):
            score[:, c] += np.bincount(unit, weights=self.logs[c, slot], minlength=len(family))
        score = np.exp(score - score.max(axis=1, keepdims=True))
        return score / score.sum(axis=1, keepdims=True)


def _features(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Family of every unit, and unit and slot of every feature: the numbers, and pairs of neighbouring ones but for zeros."""
    family = batch.column("family").to_numpy(zero_copy_only=False).astype(np.int64)
    lists = batch.column("numbers")
    size = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten().to_numpy().astype(np.uint64)
    unit = np.repeat(np.arange(len(size)), size)
    pair = (flat[:-1] > 0) & (flat[1:] > 0) & (unit[:-1] == unit[1:])
    mixed = (flat[:-1] * np.uint64(0x9E3779B97F4A7C15) + flat[1:])[pair] * np.uint64(0xC2B2AE3D27D4EB4F)
    one = flat > 0
    hashed = np.concatenate([(flat[one] * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(20), mixed >> np.uint64(20)]) % np.uint64(SLOTS)
    unit = np.concatenate([unit[one], unit[:-1][pair]])
    return family, unit, hashed.astype(np.int64) * 2 + family[unit]


def _round(units: DataFrame, model: Model | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """One pass: counts of features of trusted units by class, expected counts of unlabelled ones, and how many units of either kind by family."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((6, 2 * SLOTS + 2))  # classes of trusted and of unlabelled units; the last two places count the units of each family
        for batch in batches:
            if not batch.num_rows:
                continue
            family, unit, slot = _features(batch)
            label = batch.column("label").to_numpy(zero_copy_only=False).astype(np.int64)
            belief = np.tile([0.0, 0.0, 1.0], (len(label), 1)) if model is None else model.posterior(family, unit, slot)
            slot, unit = np.concatenate([slot, 2 * SLOTS + family]), np.concatenate([unit, np.arange(len(label))])
            for c in range(3):
                counts[c] += np.bincount(slot, weights=(label == c)[unit], minlength=counts.shape[1])
                counts[3 + c] += np.bincount(slot, weights=np.where(label < 0, belief[:, c], 0)[unit], minlength=counts.shape[1])
        at = np.flatnonzero(counts.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), *(pa.array(c[at], pa.float64()) for c in counts)], names=["slot", *"abcdef"])

    summed = units.mapInArrow(run, "slot int, " + ", ".join(f"{c} double" for c in "abcdef")).groupBy("slot").agg(*(F.sum(c).alias(c) for c in "abcdef")).toPandas()  # at most 2 * SLOTS + 2 rows
    counts = np.zeros((6, 2 * SLOTS + 2))
    counts[:, summed["slot"].to_numpy(dtype=np.int64)] = summed[list("abcdef")].to_numpy().T
    return counts[:3, :-2], counts[3:, :-2], counts[:3, -2:].T, counts[3:, -2:].T


def fit(units: DataFrame, rounds: int = ROUNDS) -> Model:
    """Expectation-maximization over all units: trusted ones keep their class, unlabelled ones get a posterior each round."""
    model, last = None, None
    for _ in range(rounds + 1):
        known, expected, held, share = _round(units, model)
        if last is not None and np.abs(share - last).max() <= SETTLED * max(1.0, share.sum()):
            break
        last = share if model is not None else None
        if model is None:
            common = known.sum(axis=0) + expected.sum(axis=0) + 0.5
            for family in (PASSAGE, MARK):
                common[family::2] /= common[family::2].sum()
        logs, prior = np.empty_like(known), np.empty((2, 3))
        for family in (PASSAGE, MARK):
            own, trusted, found = slice(family, None, 2), held[family], share[family]
            for c in range(3):
                # before the first round the unlabelled say nothing about residue, and later never more than the trusted
                weight = 1.0 if c == ORDINARY else min(1.0, trusted[c] / max(found[c], 1e-9)) * (model is not None)
                counts = known[c, own] + weight * expected[c, own]
                # smoothed by how common a feature is in all units: what a class has not seen speaks against it, rare features for none
                logs[c, own] = np.log((1 - COMMON) * counts / max(counts.sum(), 1e-9) + COMMON * common[own])
            prior[family] = np.minimum((np.minimum(found, trusted) + trusted + 1) / (trusted.sum() + found.sum() + 3), MOST_SHARE)
            prior[family, ORDINARY] = 1 - prior[family, :2].sum()
        model = Model(logs, np.log(prior))
    return model


REASONS = ("placeholder", "filler", "notice")


def find_residue(pages: DataFrame, templates: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """Pages with template residue: page_id, reason (placeholder, filler or notice), once each.

    Null and empty parts have no units; a page without any text is no case. Of several
    reasons of a page the first in that order counts. Repeated rows of a page count once.
    """
    units = cut_lineage(read_units(pages, templates))
    model = fit(units, rounds)
    shared = units.sparkSession.sparkContext.broadcast((model.logs, model.prior))  # of fixed size

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(*shared.value)
        for batch in batches:
            family, unit, slot = _features(batch)
            belief = model.posterior(family, unit, slot) if batch.num_rows else np.zeros((0, 3))
            mark, body = family == MARK, batch.column("body").to_numpy(zero_copy_only=False)
            columns = [mark & (belief[:, PLACEHOLDER_MARK] >= LEAST), ~mark & (belief[:, FILLER] >= LEAST), ~mark & body & (belief[:, NOTICE] >= LEAST), ~mark & body & (belief[:, NOTICE] < LEAST)]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), *(pa.array(c, pa.bool_()) for c in columns)], names=["page_id", *REASONS, "other"])

    verdicts = units.mapInArrow(score, "page_id long, placeholder boolean, filler boolean, notice boolean, other boolean")
    whole = verdicts.groupBy("page_id").agg(*(F.max(c).alias(c) for c in (*REASONS, "other")))
    reason = F.when(F.col("placeholder"), "placeholder").when(F.col("filler"), "filler").when(F.col("notice") & ~F.col("other"), "notice")
    return whole.select("page_id", reason.alias("reason")).filter("reason IS NOT NULL")
