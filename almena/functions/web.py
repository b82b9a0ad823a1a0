"""Columns that rate and sort web resources."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from almena.functions.url import path_only

# Kinds of resources by the end of their path.
KINDS = {
    "image": "png|jpe?g|gif|webp|avif|svg|ico|bmp", "css": "css", "script": "m?js", "font": "woff2?|ttf|otf|eot", "video": "mp4|webm|mov|avi|m3u8", "audio": "mp3|ogg|wav|m4a", "document": "pdf|docx?|xlsx?|pptx?|odt|csv|zip",
}
# Limits of good and of poor for the web vitals (seconds, milliseconds, or a score).
VITALS = {"lcp": (2500, 4000), "inp": (200, 500), "cls": (0.1, 0.25), "fcp": (1800, 3000), "ttfb": (800, 1800), "tbt": (200, 600)}


def resource_kind(path: Column) -> Column:
    """Kind of a resource by its extension; page for the rest."""
    end = F.lower(F.regexp_extract(path_only(path), r"\.([A-Za-z0-9]{1,5})$", 1))
    rules = list(KINDS.items())
    return reduce(lambda c, r: c.when(end.rlike(f"^({r[1]})$"), r[0]), rules[1:], F.when(end.rlike(f"^({rules[0][1]})$"), rules[0][0])).otherwise("page")


def vital_rating(metric: Column, value: Column) -> Column:
    """good, improve or poor for a vital's value; null for unknown ones."""
    good = F.create_map(*(F.lit(x) for k, (g, _) in VITALS.items() for x in (k, float(g))))
    poor = F.create_map(*(F.lit(x) for k, (_, p) in VITALS.items() for x in (k, float(p))))
    g, p = F.try_element_at(good, F.lower(metric)), F.try_element_at(poor, F.lower(metric))
    return F.when(value <= g, "good").when(value <= p, "improve").when(value > p, "poor")


def score_grade(score: Column) -> Column:
    """Letter of a score of 0 to 100."""
    return F.when(score >= 90, "A").when(score >= 80, "B").when(score >= 70, "C").when(score >= 60, "D").when(score >= 50, "E").when(score.isNotNull(), "F")
