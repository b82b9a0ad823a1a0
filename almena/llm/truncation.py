"""Text cut off by field limits: length hazards with false-discovery control, then endings.

Per source, the hazard of a length is the share of the texts of at least that
length that have just that length. A length at which texts are cut has a hazard
far above its neighbours; each is tested against the hazard around it: the texts that
end at the neighbouring lengths over the texts that were exposed at each of them
(Poisson upper tail by its Chernoff bound, so the p-value is conservative), and the
false-discovery rate is controlled per source by Benjamini and Hochberg's rule.
An ending is incomplete if the last line stops inside a word, sentence, list
entry, table row, code block, tag or link, or with a mark for a cut. At a significant
length incomplete endings are cuts by a limit, and endings that carry no punctuation of
their own (heading, tag line, signature, address) count as incomplete as well. Incomplete
endings at other lengths are broken transfers, which the hazards cannot find because
they break off anywhere: they are verdicts of a second kind, told apart by their cause.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Lengths on either side whose hazard is the expectation.
NEIGHBOURS = 200
#: False-discovery rate per source.
FDR = 0.01

# Marks that systems add at a cut, as they stand at the end of a text.
CUT_MARKS = (
    r"(…|\.\.\.|\[…\]|\[\.\.\.\]|\(…\)|\(\.\.\.\)|\((sigue|contin[uú]a|continued|cont\.)\)|\[(sigue|contin[uú]a|continued|truncated|cortado)\]"
    r"|(?<![.!?] )(leer m[aá]s|seguir leyendo|ver m[aá]s|read more|continue reading|show more))[»→>\s]*$"
)
BLANKS = " \t\n\r\x0b\x0c\xa0​   　﻿"


def ending_kind(text: Column) -> Column:
    """How a text ends: one of empty, mark, open_code, code, broken_markup, heading, table, open_table, address, tags, signature, list, open_list, sentence, open."""
    body = F.rtrim(text, F.lit(BLANKS))
    last = F.ltrim(F.substring_index(body, "\n", -1), F.lit(BLANKS))
    before = F.rtrim(F.substring_index(F.substring_index(body, "\n", -3), "\n", 2), F.lit(BLANKS))
    fences = (F.length(body) - F.length(F.replace(body, F.lit("```"), F.lit("")))) / 3
    closed = last.rlike(r"""[.!?。！？]["'»”’)\]*_]*(\s*(\[\^?\d+\]|[\x{1F300}-\x{1FAFF}\x{2600}-\x{27BF}\x{FE0F}]+))*$""")
    return (
        F.when(text.isNull() | (body == ""), "empty")
        .when(fences % 2 == 1, "open_code")
        .when(last.rlike(r"^(```|~~~)\s*$"), "code")
        .when(last.rlike(r"^#{1,6}\s*\S"), F.when(last.rlike("(?i)" + CUT_MARKS), "mark").otherwise("heading"))
        .when(last.startswith("|"), F.when(last.rlike(r"^\|.*\|$"), "table").otherwise("open_table"))
        .when(last.rlike("(?i)" + CUT_MARKS), "mark")
        .when(last.rlike(r"<[a-zA-Z/!][^<>]*$|&#?[a-zA-Z0-9]{0,8}$|\]\([^()\s]*$|\[[^\[\]()]{0,80}$|\x{FFFD}$"), "broken_markup")
        .when(last.rlike(r"^<?https?://\S+$|^(www\.)\S+$|^\S+@\S+\.\S+$"), "address")
        .when(last.rlike(r"(?i)^(\*\*)?(tags?|etiquetas?|keywords|palabras clave|categor[ií]as?|topics|temas)(\*\*)?\s*:"), "tags")
        .when(last.rlike(r"^[—–―-]{1,2}\s*\p{L}[^.!?]{0,80},\s*\p{Lu}[\p{L}' -]{1,40}$|^[—–―]\s*\p{Lu}[\p{L}.' -]{1,40}$"), "signature")
        .when(before.rlike(r"(?i)(^|\n)\s*(saludos|un saludo|atentamente|cordialmente|gracias|regards|best regards|kind regards|best|sincerely|thanks|cheers)[^\n]{0,20},$") & (F.length(last) <= 60), "signature")
        .when(
            last.rlike(r"^([-*+•]|\d{1,3}[.)])\s+"),
            F.when(closed | last.rlike(r"""[)\]"»”`]$"""), F.when(last.rlike(r"[(\[]\s*$"), "open_list").otherwise("list")).otherwise("open_list"),
        )
        .when(closed, "sentence")
        .when(last.rlike(r"^(calle|avenida|avda\.?|plaza|paseo|c/)\s.{3,60}\d|^\d{1,5}\s[\p{L} ]{3,40}(road|street|avenue|lane|square|st\.|rd\.)(,.{2,40})?$|^(tel\.?|tel[eé]fono|phone|call us)[:.]?\s*[+\d][\d\s()-]{5,}$"), "address")
        .otherwise("open")
    )


OPEN_KINDS = ("mark", "open_code", "broken_markup", "open_table", "open_list", "open")
BARE_KINDS = ("heading", "address", "tags", "signature")


def length_limits(endings: DataFrame, neighbours: int = NEIGHBOURS, fdr: float = FDR) -> DataFrame:
    """Significant lengths per source: source, n_chars, hits, at_risk, expected, p_value.

    ``endings`` holds source and n_chars. Counts per source and length come first, so a
    hot source is reduced before its window; a null source is a source of its own.
    """
    counts = endings.groupBy("source", "n_chars").agg(F.count("*").alias("hits"))
    by_length = Window.partitionBy("source").orderBy("n_chars")
    around = by_length.rangeBetween(-neighbours, neighbours)
    hazard = counts.withColumn("at_risk", F.sum("hits").over(by_length.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
    # exposure: every text counts once at each neighbouring length it reaches, up to its own; one more end is assumed, so few texts prove nothing
    beyond = by_length.rangeBetween(neighbours + 1, Window.unboundedFollowing)
    first = F.greatest(F.col("n_chars") - neighbours, F.lit(1))
    reached = F.sum(F.col("hits") * F.col("n_chars")).over(around) - F.sum("hits").over(around) * (first - 1)
    whole_way = F.coalesce(F.sum("hits").over(beyond), F.lit(0)) * (F.col("n_chars") + neighbours - first + 1)
    near = hazard.withColumn("_ends", F.sum("hits").over(around) - F.col("hits")).withColumn("_exposed", reached + whole_way - F.col("at_risk"))
    rate = (F.col("_ends") + 1) / F.greatest(F.col("_exposed"), F.lit(1))
    tested = near.withColumn("expected", rate * F.col("at_risk"))
    surplus = F.col("hits") * F.log(F.col("hits") / F.col("expected")) - F.col("hits") + F.col("expected")
    scored = tested.withColumn("p_value", F.when(F.col("hits") > F.col("expected"), F.exp(-surplus)).otherwise(F.lit(1.0)))
    by_p = Window.partitionBy("source").orderBy("p_value", "n_chars")
    whole = Window.partitionBy("source")
    ranked = scored.withColumn("_i", F.row_number().over(by_p)).withColumn("_m", F.count("*").over(whole))
    cut = F.max(F.when(F.col("p_value") <= F.col("_i") * fdr / F.col("_m"), F.col("p_value"))).over(whole)
    return ranked.withColumn("_cut", cut).filter(F.col("p_value") <= F.col("_cut")).select("source", "n_chars", "hits", "at_risk", "expected", "p_value")


def find_truncated(documents: DataFrame, neighbours: int = NEIGHBOURS, fdr: float = FDR) -> DataFrame:
    """Every document with its verdict: doc_id, source, n_chars, ending, at_limit, cause, truncated.

    ``cause`` is limit (an incomplete ending at a significant length of the source),
    transfer (an incomplete ending at another length) or null. Repeated rows of a
    document count once. A null or blank text is not truncated; the length is counted
    from the text, in characters.
    """
    endings = documents.select("doc_id", "source", F.coalesce(F.length("text"), F.lit(0)).alias("n_chars"), ending_kind(F.col("text")).alias("ending")).dropDuplicates(["doc_id"])
    limits = length_limits(endings.filter("n_chars > 0"), neighbours, fdr).select(F.col("source").alias("_s"), F.col("n_chars").alias("_n"))
    at = endings.join(limits, endings["source"].eqNullSafe(limits["_s"]) & (endings["n_chars"] == limits["_n"]), "left")
    hit = F.col("_n").isNotNull()
    cause = F.when(hit & F.col("ending").isin(*OPEN_KINDS, *BARE_KINDS), "limit").when(F.col("ending").isin(*OPEN_KINDS), "transfer")
    return at.select("doc_id", "source", "n_chars", "ending", hit.alias("at_limit"), cause.alias("cause"), cause.isNotNull().alias("truncated"))


def truncation_report(verdicts: DataFrame) -> DataFrame:
    """Per source: documents, truncated, by_limit, by_transfer, share."""
    return verdicts.groupBy("source").agg(
        F.count("*").alias("documents"), F.count_if("truncated").alias("truncated"), F.count_if(F.col("cause") == "limit").alias("by_limit"), F.count_if(F.col("cause") == "transfer").alias("by_transfer"),
        F.round(F.count_if("truncated") / F.count("*"), 6).alias("share"),
    )
