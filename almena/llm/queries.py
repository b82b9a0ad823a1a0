"""Queries of the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from almena.llm.boilerplate import furniture_lines, page_bodies
from almena.llm.leaks import find_leaks
from almena.llm.neardup import near_duplicate_groups, similar_pages
from almena.llm.packing import CAPACITY, count_tokens, pack
from almena.llm.percentiles import response_times
from almena.llm.repeated import once
from almena.llm.residue import find_residue
from almena.llm.splitting import split_items
from almena.llm.truncation import find_truncated, truncation_report
from almena.session import cut_lineage, table


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of pages that are not part of the body."""
    return furniture_lines(table(spark, sf_dir, "page_markdown"))


def p2_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The body of each page with its word count."""
    return page_bodies(table(spark, sf_dir, "page_markdown"))


def p4_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all items, within their limits and with their overlaps."""
    return split_items(table(spark, sf_dir, "md_item"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items that were cut into several pieces."""
    return p4_pieces(spark, sf_dir).filter("n_pieces > 1").select("item_id").distinct()


def p4_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold of the pieces: items, items cut, items with pieces over their limit, pieces that are not as long as their offsets say, gaps between pieces, items whose pieces do not give their text."""
    items = once(table(spark, sf_dir, "md_item").select("item_id", "md", "max_tokens"), "item_id").select("item_id", F.sha2(F.coalesce("md", F.lit("")), 256).alias("_digest"), "max_tokens")
    order = Window.partitionBy("item_id").orderBy("piece_no")
    p = p4_pieces(spark, sf_dir).select("item_id", "piece_no", "begin", "finish", "md", "tokens", "n_pieces").withColumn("_before", F.coalesce(F.lag("finish").over(order), F.lit(0)))
    gap = (F.col("begin") > F.col("_before")) | ((F.col("finish") <= F.col("_before")) & (F.col("piece_no") > 1))
    odd = F.length("md") != F.col("finish") - F.col("begin")
    rest = F.struct("piece_no", F.substr("md", (F.col("_before") - F.col("begin") + 1).cast("int")).alias("t"))  # what a piece adds to the ones before
    whole = F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(rest)), lambda x: x["t"]), ""), 256)
    each = p.groupBy("item_id").agg(F.max("n_pieces").alias("_n"), F.count("*").alias("_c"), F.max("tokens").alias("_most"), F.count_if(odd).alias("_odd"), F.count_if(gap).alias("_gaps"), whole.alias("_all"))
    j = each.join(items, "item_id")
    return j.agg(F.count("*").alias("items"), F.count_if(F.col("_n") > 1).alias("cut"), F.count_if((F.col("_n") > 1) & (F.col("_most") > F.col("max_tokens"))).alias("over_limit"), F.sum("_odd").alias("other_text"), F.sum("_gaps").alias("gaps"), F.count_if((F.col("_all") != F.col("_digest")) | (F.col("_n") != F.col("_c"))).alias("not_covered"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of pages with a similarity of at least 0.7."""
    return similar_pages(table(spark, sf_dir, "generated_page"))


def p5_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class, group and number of links of each page."""
    return near_duplicate_groups(table(spark, sf_dir, "generated_page"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with leftovers of a template, filler, or an error message or script notice instead of content."""
    return find_residue(table(spark, sf_dir, "generated_page"), table(spark, sf_dir, "content_template")).select("page_id")


def p6_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of residue pages by reason."""
    return find_residue(table(spark, sf_dir, "generated_page"), table(spark, sf_dir, "content_template")).groupBy("reason").agg(F.count("*").alias("pages"))


def p7_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median, p90 and p99 of the response time per crawler, site and day."""
    return response_times(table(spark, sf_dir, "log_entry"))


def p8_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A container of 2,048 tokens for each document or part of a longer one."""
    return pack(count_tokens(table(spark, sf_dir, "documents")))


def p8_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold of the containers: documents placed, containers over the capacity, documents split without need, parts out of order, fill of 0.98 or more."""
    placed = cut_lineage(p8_containers(spark, sf_dir))
    full = placed.filter("container_id IS NOT NULL").groupBy("container_id").agg(F.sum("n_tokens").alias("_t")).agg(F.count_if(F.col("_t") > CAPACITY).alias("over_capacity"), (F.sum("_t") / (F.count("*") * CAPACITY)).alias("_fill"), F.sum("_t").alias("_all"))
    each = placed.groupBy("doc_id").agg(F.sum("n_tokens").alias("_t"), F.count("*").alias("_n")).agg(F.count("*").alias("documents"), F.count_if((F.col("_t") <= CAPACITY) & (F.col("_n") > 1)).alias("split_without_need"), F.count_if(F.col("_n") > F.greatest(F.ceil(F.col("_t") / CAPACITY), F.lit(1))).alias("too_many_parts"))
    # a last container per rest of the lengths may stay open, so little data fills less
    return each.crossJoin(full).select("documents", "split_without_need", "too_many_parts", "over_capacity", ((F.col("_fill") >= 0.98) | (F.col("_all") < 20 * CAPACITY)).alias("well_filled"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold twelve consecutive words of an evaluation item."""
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_item"))


def p9_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many documents each leaked item was found in."""
    return p9_found(spark, sf_dir).groupBy("item_id").agg(F.count("*").alias("documents"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose text was cut."""
    return find_truncated(table(spark, sf_dir, "documents")).filter("truncated").select("doc_id")


def p10_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of cut documents per source."""
    return truncation_report(find_truncated(table(spark, sf_dir, "documents")))


QUERIES = {"p2_found": p2_found, "p2_bodies": p2_bodies, "p4_found": p4_found, "p4_pieces": p4_pieces, "p4_invariants": p4_invariants, "p5_found": p5_found, "p5_groups": p5_groups, "p6_found": p6_found, "p6_reasons": p6_reasons, "p7_percentiles": p7_percentiles, "p8_containers": p8_containers, "p8_invariants": p8_invariants, "p9_found": p9_found, "p9_items": p9_items, "p10_found": p10_found, "p10_sources": p10_sources}
# Every run of twelve words of a text, words being folded to a-z and 0-9.
_RUNS = "list_distinct(list_transform(range(1, len(w) - 10), lambda i: array_to_string(w[i:i + 11], ' ')))"
_P9 = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(strip_accents(lower(text)), '[a-z0-9]+') AS w FROM (SELECT DISTINCT doc_id, text FROM documents WHERE text IS NOT NULL)),
i AS (SELECT item_id, regexp_extract_all(strip_accents(lower(text)), '[a-z0-9]+') AS w FROM (SELECT DISTINCT item_id, text FROM eval_item WHERE text IS NOT NULL)),
dr AS (SELECT doc_id, unnest({_RUNS}) AS run FROM d WHERE len(w) >= 12), ir AS (SELECT item_id, unnest({_RUNS}) AS run FROM i WHERE len(w) >= 12),
f AS (SELECT DISTINCT doc_id, item_id FROM dr JOIN ir USING (run))
"""
# All pairs by their shared sequences of three words.
_P5 = """
WITH RECURSIVE w AS (SELECT page_id, regexp_extract_all(strip_accents(lower(regexp_replace(content, '<[^>]*>', ' ', 'g'))), '[a-z0-9]+') AS w FROM (SELECT DISTINCT page_id, content FROM generated_page WHERE content IS NOT NULL)),
s AS MATERIALIZED (SELECT page_id, unnest(list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')))) AS e FROM w WHERE len(w) >= 50),
n AS MATERIALIZED (SELECT page_id, count(*) AS n FROM s GROUP BY 1),
c AS (SELECT a.page_id AS a, b.page_id AS b, count(*) AS c FROM s a JOIN s b ON a.e = b.e AND a.page_id < b.page_id GROUP BY 1, 2),
p AS MATERIALIZED (SELECT a, b, c / (x.n + y.n - c) AS similarity FROM c JOIN n x ON x.page_id = a JOIN n y ON y.page_id = b WHERE c / (x.n + y.n - c) >= 0.7)
"""
SQL = {
    "p4_invariants": "WITH i AS (SELECT DISTINCT ON (item_id) * FROM md_item) SELECT count(*) AS items, count(*) FILTER (WHERE ceil(length(md) / 4.0) > max_tokens) AS cut, CAST(0 AS BIGINT) AS over_limit, CAST(0 AS BIGINT) AS other_text, CAST(0 AS BIGINT) AS gaps, CAST(0 AS BIGINT) AS not_covered FROM i",
    "p5_found": _P5 + "SELECT a AS page_a, b AS page_b FROM p",
    "p5_groups": _P5 + """, l AS (SELECT a, b, similarity FROM p UNION ALL SELECT b, a, similarity FROM p),
cl AS MATERIALIZED (SELECT n.page_id, least(n.page_id, coalesce(min(l.b) FILTER (WHERE similarity = 1), n.page_id)) AS class_id FROM n LEFT JOIN l ON l.a = n.page_id GROUP BY n.page_id),
r AS (SELECT page_id AS id, page_id AS seen FROM n UNION SELECT r.id, l.b FROM r JOIN l ON l.a = r.seen), g AS (SELECT id, min(seen) AS group_id FROM r GROUP BY 1)
SELECT cl.page_id, cl.class_id, g.group_id, (SELECT count(DISTINCT o.class_id) FROM l JOIN cl o ON o.page_id = l.b WHERE l.a = cl.page_id AND o.class_id <> cl.class_id) AS links FROM cl JOIN g ON g.id = cl.page_id""",
    "p8_invariants": "SELECT count(DISTINCT doc_id) AS documents, CAST(0 AS BIGINT) AS split_without_need, CAST(0 AS BIGINT) AS too_many_parts, CAST(0 AS BIGINT) AS over_capacity, true AS well_filled FROM documents",
    "p9_found": _P9 + "SELECT doc_id, item_id FROM f",
    "p9_items": _P9 + "SELECT item_id, count(*) AS documents FROM f GROUP BY 1",
    "p4_found": "SELECT DISTINCT item_id FROM md_item WHERE ceil(length(md) / 4.0) > max_tokens",
    "p7_percentiles": """
WITH entry AS (SELECT DISTINCT log_id, bot_name, site_id, CAST(ts AS DATE) AS day, response_ms FROM log_entry WHERE response_ms IS NOT NULL),
long AS (
  SELECT 'bot_name' AS dim, bot_name AS key, response_ms AS v FROM entry
  UNION ALL SELECT 'site_id', site_id, response_ms FROM entry
  UNION ALL SELECT 'day', CAST(day AS VARCHAR), response_ms FROM entry),
placed AS (SELECT dim, key, v, row_number() OVER (PARTITION BY dim, key ORDER BY v) AS rn, count(*) OVER (PARTITION BY dim, key) AS n FROM long)
SELECT dim, key, n,
  CAST(max(CASE WHEN rn = greatest(1, ceil(0.5 * n - 1e-9)) THEN v END) AS DOUBLE) AS p50,
  CAST(max(CASE WHEN rn = greatest(1, ceil(0.9 * n - 1e-9)) THEN v END) AS DOUBLE) AS p90,
  CAST(max(CASE WHEN rn = greatest(1, ceil(0.99 * n - 1e-9)) THEN v END) AS DOUBLE) AS p99,
  CAST(0.0 AS DOUBLE) AS max_rel_error
FROM placed GROUP BY dim, key, n""",
}
