"""Columns over text: folding, words, word sequences, counts and rounding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Latin letters with marks and the letters they fold to.
_MARKED = "áàâäãåéèêëíìîïóòôöõúùûüñçýÿÁÀÂÄÃÅÉÈÊËÍÌÎÏÓÒÔÖÕÚÙÛÜÑÇÝ"
_PLAIN = "aaaaaaeeeeiiiiooooouuuuncyyAAAAAAEEEEIIIIOOOOOUUUUNCY"


def fold_text(text: Column) -> Column:
    """Lower case without the accents of Latin letters (combining marks dropped)."""
    return F.translate(F.regexp_replace(F.lower(text), r"[\x{0300}-\x{036F}]", ""), _MARKED, _PLAIN)


def norm_query(text: Column) -> Column:
    """A search query folded, its white space collapsed."""
    return F.trim(F.regexp_replace(fold_text(text), r"\s+", " "))


def strip_html(text: Column) -> Column:
    """Text of HTML: scripts, styles, tags and entities become blanks."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"(?is)<(script|style)\b.*?</\1\s*>", " "), r"<[^>]*>", " "), r"&#?\w+;", " ")


def to_words(text: Column) -> Column:
    """Words of HTML or text: folded runs of a-z and 0-9."""
    return F.filter(F.split(F.regexp_replace(fold_text(strip_html(text)), "[^a-z0-9]+", " "), " "), lambda w: w != "")


def stem(word: Column) -> Column:
    """Plural endings off: es of words over five letters, else s of words over four."""
    return F.when((F.length(word) > 5) & word.endswith("es"), F.regexp_replace(word, "es$", "")).when((F.length(word) > 4) & word.endswith("s"), F.regexp_replace(word, "s$", "")).otherwise(word)


def slug(text: Column, joint: str = "-") -> Column:
    """Folded text with everything but letters and digits as one joint."""
    return F.regexp_replace(F.regexp_replace(fold_text(text), "[^a-z0-9]+", joint), f"^{joint}+|{joint}+$", "")


def shingles(words: Column, k: int = 3) -> Column:
    """Distinct sequences of ``k`` words; a shorter text is one sequence, an empty one none."""

    def of(w: Column) -> Column:
        several = F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - (k - 1), F.lit(1))), lambda i: F.array_join(F.slice(w, i, k), " "))
        return F.when(F.size(w) == 0, F.array().cast("array<string>")).otherwise(F.array_distinct(several))

    # bound as a variable, the words are computed once and not once for each sequence
    return F.get(F.transform(F.array(words), of), F.lit(0))


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all elements of two sets; 0 if both are empty."""
    shared = F.size(F.array_intersect(a, b))
    return F.coalesce(F.try_divide(shared.cast("double"), (F.size(a) + F.size(b) - shared).cast("double")), F.lit(0.0))


def multiset_minus(a: Column, b: Column) -> Column:
    """Words of ``a`` beyond their number in ``b``: one (word, n) per word left."""

    def of(both: Column) -> Column:
        count = lambda side, w: F.size(F.filter(both[side], lambda x: x == w))
        left = F.transform(F.array_distinct(both["a"]), lambda w: F.struct(w.alias("word"), (count("a", w) - count("b", w)).alias("n")))
        return F.filter(left, lambda s: s["n"] > 0)

    return F.get(F.transform(F.array(F.struct(a.alias("a"), b.alias("b"))), of), F.lit(0))


def token_estimate(text: Column) -> Column:
    """Code points over four, rounded up, at least one."""
    return F.greatest(F.lit(1), F.ceil(F.length(text) / 4)).cast("int")


def html_escape(text: Column) -> Column:
    """The five characters that have a meaning in HTML, as entities."""
    for raw, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(raw), F.lit(entity))
    return text


def round_up(value: Column, digits: int = 0) -> Column:
    """Rounding with halves towards plus infinity."""
    scale = 10.0**digits
    return F.floor(value * scale + 0.5) / scale


def ratio(a: Column, b: Column) -> Column:
    """a over b, 0 where b is 0 or null."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def csv_guard(text: Column) -> Column:
    """Cells that a spreadsheet would run as a formula get an apostrophe."""
    return F.when(text.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), text)).otherwise(text)
