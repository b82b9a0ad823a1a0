"""Text, graph, profile and streaming queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from almena.functions.text import csv_guard, fold_text, html_escape, jaccard, shingles, slug, to_words, token_estimate
from almena.operators import architecture, graph, readiness
from almena.operators.chunks import flag_counts, html_chunks
from almena.operators.crawl import custom_search
from almena.operators.relational import column_samples, profile_columns, repeated_rows, top_per
from almena.operators.similarity import STOP_WORDS, banded, cosine_totals, minhash, minhash_similarity, near_duplicates, simhash, text_hash, tfidf
from almena.session import cut_lineage, table
from almena.sources.html import head_fields
from almena.streaming.log_stream import hits_per_window, run_to_table, stream_entries

RANK_ROUNDS = 40
QUERY_SHARE = 20  # searches are made for rows whose id is divisible by this, against all rows


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").dropDuplicates(["doc_id"])


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "page_markdown").dropDuplicates(["page_id"])


def r15_exact_duplicates(spark, sf_dir):
    """Texts that stand under several documents: smallest document and how many."""
    return documents(spark, sf_dir).filter("text IS NOT NULL").groupBy(F.md5("text").alias("digest")).agg(F.min("doc_id").alias("keeper"), F.count("*").alias("documents")).filter("documents > 1").select("keeper", "documents")


def r15_thin(spark, sf_dir):
    """Pages of fewer than 200 words, counted from the text."""
    n = F.size(to_words(F.col("markdown")))
    return pages(spark, sf_dir).select("page_id", n.alias("words")).filter("words < 200")


def x1_shingles(spark, sf_dir):
    """Distinct sequences of three words per generated page."""
    g = table(spark, sf_dir, "generated_page").dropDuplicates(["page_id"])
    return g.select("page_id", F.size(shingles(to_words(F.col("content")))).alias("shingles"))


def x3_specific_words(spark, sf_dir):
    """Words of each generated page that its template does not have."""
    g = table(spark, sf_dir, "generated_page").dropDuplicates(["page_id"]).filter("template_id IS NOT NULL").select("page_id", "template_id", F.array_distinct(to_words(F.col("content"))).alias("words"))
    t = table(spark, sf_dir, "content_template").select("template_id", F.array_distinct(to_words(F.regexp_replace("body_template", r"\{\{[^}]*\}\}", " "))).alias("fixed"))
    return g.join(t, "template_id").select("page_id", F.size(F.array_except("words", "fixed")).alias("specific"))


def x4_simhash(spark, sf_dir):
    """SimHash of each document."""
    return documents(spark, sf_dir).select("doc_id", simhash(to_words(F.col("text"))).alias("simhash"))


def x5_minhash(spark, sf_dir):
    """MinHash signature of each document."""
    return minhash(documents(spark, sf_dir).select("doc_id", to_words(F.col("text")).alias("words")), "doc_id", "words")


def x5_text_hashes(spark, sf_dir):
    """Words of each document and the digest by which its copies are told."""
    return documents(spark, sf_dir).select("doc_id", F.size(to_words(F.coalesce("text", F.lit("")))).alias("n_words"), text_hash(to_words(F.coalesce("text", F.lit("")))).alias("text_hash"))


def x6_estimates(spark, sf_dir):
    """Estimated against exact similarity of documents that share a band with a query document: pairs, and those off by more than a quarter."""
    words = documents(spark, sf_dir).select("doc_id", to_words(F.col("text")).alias("words"))
    signed = cut_lineage(minhash(words, "doc_id", "words"))
    bands = banded(signed, "doc_id")
    met = bands.filter(F.col("doc_id") % QUERY_SHARE == 0).select(F.col("doc_id").alias("a"), "band", "bucket").join(bands.select(F.col("doc_id").alias("b"), "band", "bucket"), ["band", "bucket"]).filter("a <> b").select("a", "b").distinct()
    side = lambda x: signed.select(F.col("doc_id").alias(x), F.col("signature").alias(f"s_{x}")).join(words.select(F.col("doc_id").alias(x), shingles(F.col("words"), 5).alias(f"w_{x}")), x)
    both = met.join(side("a"), "a").join(side("b"), "b")
    off = F.abs(minhash_similarity(F.col("s_a"), F.col("s_b")) - jaccard(F.col("w_a"), F.col("w_b")))
    return both.agg(F.count("*").alias("pairs"), F.count_if(off > 0.25).alias("far_off"))


def x6_bands(spark, sf_dir):
    """Class, group and links of each document: Jaccard 0.8 or more over sequences of five words, all pairs verified."""
    return near_duplicates(documents(spark, sf_dir).select("doc_id", to_words(F.col("text")).alias("words")), "doc_id", "words")


def r15_near_duplicates(spark, sf_dir):
    """Documents of 50 words or more in groups of near duplicates (0.85): smallest of the group and how many."""
    d = documents(spark, sf_dir).select("doc_id", to_words(F.col("text")).alias("words")).filter("size(words) >= 50")
    return near_duplicates(d, "doc_id", "words", 0.85).groupBy(F.col("group").alias("keeper")).agg(F.count("*").alias("documents")).filter("documents > 1")


def _page_vectors(spark, sf_dir):
    """TF-IDF vectors of title and Markdown of every page, with a title or without."""
    whole = pages(spark, sf_dir).select("page_id", F.concat_ws(" ", "title", "markdown").alias("text"))
    return cut_lineage(tfidf(whole, "page_id", "text"))


def x8_top_terms(spark, sf_dir):
    """The three weightiest terms of each page, title and whole text."""
    t = _page_vectors(spark, sf_dir).withColumn("weight", F.round("weight", 6))
    return top_per(t, ["page_id"], 3, F.desc("weight"), F.col("term"))


def j17_similar_pages(spark, sf_dir):
    """Pages with whole texts like those of the query pages: how many, and the best cosine."""
    whole = pages(spark, sf_dir).select("page_id", F.concat_ws(" ", "title", "markdown").alias("text"))
    return cosine_totals(whole, "page_id", "text", F.col("page_id") % QUERY_SHARE == 0, 0.2).withColumn("best", F.round("best", 5))


def x14_page_fields(spark, sf_dir):
    """First heading, headings, links and words of each generated page."""
    g = table(spark, sf_dir, "generated_page").dropDuplicates(["page_id"]).select("page_id", F.col("content").alias("html"))
    return head_fields(g).select("page_id", "h1", "h1_count", F.size("h2").alias("h2_count"), "links")


def f18_tokens(spark, sf_dir):
    """Estimated tokens of Markdown items per kind, and how many stored estimates are stale."""
    i = table(spark, sf_dir, "md_item").dropDuplicates(["item_id"]).withColumn("estimate", token_estimate(F.col("md")))
    return i.groupBy("kind").agg(F.count("*").alias("items"), F.sum("estimate").alias("tokens"), F.count_if(F.col("tokens") != F.col("estimate")).alias("stale"))


def f3_slugs(spark, sf_dir):
    """Folded titles and their slugs."""
    return pages(spark, sf_dir).filter("title IS NOT NULL").select(fold_text(F.col("title")).alias("folded"), slug(F.col("title")).alias("slug")).distinct()


def f5_escaped(spark, sf_dir):
    """Length of contents once escaped for HTML, per template."""
    g = table(spark, sf_dir, "generated_page").dropDuplicates(["page_id"])
    return g.groupBy("template_id").agg(F.sum(F.length(html_escape(F.col("content")))).alias("characters"))


def k4_guarded(spark, sf_dir):
    """Balances as cells: those that a spreadsheet would take for formulas are made safe."""
    cell = csv_guard(F.col("c_acctbal").cast("decimal(14,2)").cast("string"))
    return table(spark, sf_dir, "customer").select("c_custkey", cell.alias("cell"))


def r36_profile(spark, sf_dir):
    """Type, rows, empty and distinct values of each column of the customers."""
    return profile_columns(table(spark, sf_dir, "customer"))


def a38_samples(spark, sf_dir):
    """The three smallest values of each column of the parts, and which columns are keys."""
    return column_samples(table(spark, sf_dir, "part"))


def a38_repeats(spark, sf_dir):
    """Raw records that repeat an earlier one of their dataset."""
    r = table(spark, sf_dir, "dataset_record").select("record_id", "dataset_id", "raw").distinct()
    return repeated_rows(r, "record_id")


def r36_datasets(spark, sf_dir):
    """Records of each dataset against the number its upload stated."""
    r = table(spark, sf_dir, "dataset_record").select("record_id", "dataset_id", (F.trim("raw") == "").alias("blank")).distinct().groupBy("dataset_id").agg(F.count("*").alias("records"), F.count_if("blank").alias("blank"))
    return table(spark, sf_dir, "dataset").select("dataset_id", "site_id", "row_count").join(r, "dataset_id", "left").select("dataset_id", "site_id", "row_count", F.coalesce("records", F.lit(0)).alias("records"), F.coalesce("blank", F.lit(0)).alias("blank"))


def r38_sections(spark, sf_dir):
    """Headings of all pages by level, outside code."""
    lines = pages(spark, sf_dir).select("page_id", F.posexplode(F.split("markdown", "\n")).alias("no", "line"))
    level = F.length(F.regexp_extract("line", r"^(#{1,6})\s", 1))
    return lines.filter(F.col("line").rlike(r"^#{1,6}\s")).groupBy(level.alias("level")).agg(F.count("*").alias("headings"), F.countDistinct("page_id").alias("pages"))


def _links(spark, sf_dir):
    """Suppliers link to their parts, which link back through first lines."""
    line = table(spark, sf_dir, "lineitem")
    s, p = F.concat(F.lit("s"), F.col("l_suppkey").cast("string")), F.concat(F.lit("p"), F.col("l_partkey").cast("string"))
    return line.select(s.alias("src"), p.alias("dst")).unionByName(line.filter("l_linenumber = 1").select(p.alias("src"), s.alias("dst"))).distinct()


def g1_pagerank(spark, sf_dir):
    """PageRank of suppliers and parts after 40 rounds."""
    e = cut_lineage(_links(spark, sf_dir))
    nodes = e.select(F.col("src").alias("id")).unionByName(e.select(F.col("dst").alias("id"))).distinct()
    return graph.pagerank(nodes, e, iterations=RANK_ROUNDS).select("id", F.round("rank", 9).alias("rank"), "score")


def g2_components(spark, sf_dir):
    """Crawls linked by comparison: the first of each group and how many."""
    e = table(spark, sf_dir, "crawl_run").filter("base_run_id IS NOT NULL").select(F.col("crawl_run_id").alias("src"), F.col("base_run_id").alias("dst"))
    return graph.components(e).groupBy("component").agg(F.count("*").alias("runs"))


def g3_depths(spark, sf_dir):
    """Nodes by their distance from the first supplier."""
    start = spark.createDataFrame([("s1",)], "id string")
    return graph.depths(_links(spark, sf_dir), start).groupBy("depth").agg(F.count("*").alias("nodes"))


def g8_redirects(spark, sf_dir):
    """Where redirected addresses end, over all crawls."""
    r = table(spark, sf_dir, "crawled_page").filter("final_url <> url").select(F.col("url").alias("src"), F.col("final_url").alias("dst"))
    return graph.redirect_ends(r).groupBy("hops", "loop").agg(F.count("*").alias("urls"))


def f7_digests(spark, sf_dir):
    """Digests of texts."""
    t = F.coalesce("text", F.lit(""))
    return documents(spark, sf_dir).select("doc_id", F.md5(t).alias("md5"), F.sha1(t).alias("sha1"), F.sha2(t, 256).alias("sha256"))


def f19_word_counts(spark, sf_dir):
    """Three counts of words: by single blanks, by white space, by runs of letters and digits."""
    t = F.coalesce("text", F.lit(""))
    return documents(spark, sf_dir).select("doc_id", F.size(F.split(F.trim(t), " ")).alias("blanks"), F.regexp_count(t, F.lit(r"\S+")).alias("runs"), F.regexp_count(t, F.lit(r"[\p{L}\p{N}]+")).alias("words"))


def f6_filled_templates(spark, sf_dir):
    """Titles of all templates filled for every nation, and variables they miss."""
    rows = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("row_no"), F.create_map(F.lit("ciudad"), "n_name", F.lit("city"), "n_name", F.lit("marca"), F.lit("A & B"), F.lit("brand"), F.lit("A & B")).alias("data"))
    t = table(spark, sf_dir, "content_template").select("template_id", "title_template")
    title, missing = architecture.fill(F.col("title_template"), F.col("data"))
    return rows.crossJoin(F.broadcast(t)).select("template_id", "row_no", title.alias("title"), F.size(missing).alias("missing"))


def p17_html_search(spark, sf_dir):
    """Generated pages whose HTML matches a pattern, with the number of hits."""
    g = table(spark, sf_dir, "generated_page").dropDuplicates(["page_id"])
    return custom_search(g, "content", "regex", "<h[23]>").select("page_id", "hits")


def w10_keepers(spark, sf_dir):
    """The document to keep of those with one text: with a title, then the shorter and smaller address, then the smaller id."""
    d = documents(spark, sf_dir).filter("text IS NOT NULL")
    order = F.struct(F.col("title").isNull().alias("t"), F.length("url").alias("n"), F.col("url").alias("u"), F.col("doc_id").alias("i"))
    return d.groupBy(F.md5("text").alias("digest")).agg(F.min(order)["i"].alias("keeper"), F.count("*").alias("documents")).filter("documents > 1")


def w12_runs(spark, sf_dir):
    """Runs of three or more hits of one crawler in a row on a site: how many by crawler, and the longest."""
    e = table(spark, sf_dir, "log_entry").select("log_id", "site_id", "ts", "bot_name").dropDuplicates(["log_id"]).withColumn("bot_name", F.coalesce("bot_name", F.lit("-")))
    order = Window.partitionBy("site_id").orderBy("ts", "log_id")
    new = e.withColumn("_new", F.when(F.col("bot_name") == F.lag("bot_name").over(order), 0).otherwise(1))
    runs = new.withColumn("_run", F.sum("_new").over(order)).groupBy("site_id", "_run", "bot_name").agg(F.count("*").alias("n")).filter("n >= 3")
    return runs.groupBy("bot_name").agg(F.count("*").alias("runs"), F.max("n").alias("longest"))


def a41_any_all(spark, sf_dir):
    """Items with any, and with only, headings of more than 20 characters."""
    i = table(spark, sf_dir, "md_item").dropDuplicates(["item_id"]).filter("headings IS NOT NULL")
    long = lambda h: F.coalesce(F.length(h) > 20, F.lit(False))
    return i.groupBy("kind").agg(F.count("*").alias("items"), F.count_if(F.exists("headings", long)).alias("any_long"), F.count_if(F.forall("headings", long)).alias("all_long"))


def r38_page_chunks(spark, sf_dir):
    """Chunks of all generated pages by flag."""
    g = table(spark, sf_dir, "generated_page").dropDuplicates(["page_id"])
    return flag_counts(html_chunks(g.select("page_id", "content"), "page_id", "content"))


def r26_page_grades(spark, sf_dir):
    """Generated pages by grade of their readiness for answer engines."""
    g = table(spark, sf_dir, "generated_page").dropDuplicates(["page_id"]).select("page_id", "content")
    return readiness.grade_counts(readiness.weighted(readiness.page_readiness(g, "page_id", "content"), readiness.PAGE_CHECKS, "page_id"))


def p31_page_reading(spark, sf_dir):
    """Generated pages by how they read."""
    g = table(spark, sf_dir, "generated_page").dropDuplicates(["page_id"]).select("page_id", "content")
    return readiness.readability(g, "page_id", "content").groupBy("rating").agg(F.count("*").alias("pages"), F.round(F.avg("words"), 2).alias("words"))


def st_daily_hits(spark, sf_dir):
    """Hits per day and crawler, computed as a stream with deduplication and late data."""
    hits = hits_per_window(stream_entries(spark, f"{sf_dir}/log_entry.parque[t]"), "1 day")
    return run_to_table(hits, "daily").select(F.to_date("begin").alias("date"), "bot_name", "hits", "bytes")


_WORDS = "list_filter(string_split(regexp_replace(strip_accents(lower(regexp_replace(regexp_replace({}, '<[^>]*>', ' ', 'g'), '&#?\\w+;', ' ', 'g'))), '[^a-z0-9]+', ' ', 'g'), ' '), lambda w: w <> '')"
_P = "WITH p AS (SELECT DISTINCT ON (page_id) * FROM page_markdown)\n"
_G = "WITH g AS (SELECT DISTINCT ON (page_id) * FROM generated_page)\n"
_STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)
_TERMS = (
    _P + f", w AS (SELECT page_id, unnest(list_filter(regexp_extract_all(strip_accents(lower(concat_ws(' ', title, markdown))), '[a-z]{{3,}}'), lambda t: t NOT IN ({_STOP}))) AS raw FROM p), "
    "s AS (SELECT page_id, CASE WHEN length(raw) > 5 AND raw LIKE '%es' THEN raw[1:-3] WHEN length(raw) > 4 AND raw LIKE '%s' THEN raw[1:-2] ELSE raw END AS term FROM w), "
    "c AS (SELECT page_id, term, count(*) AS tf FROM s GROUP BY 1, 2), d AS (SELECT term, count(*) AS df FROM c GROUP BY 1), n AS (SELECT count(*) AS n FROM p), "
    "x AS (SELECT page_id, term, (1 + ln(tf)) * ln((n + 1) / (df + 1)) AS w FROM c JOIN d USING (term), n WHERE (1 + ln(tf)) * ln((n + 1) / (df + 1)) > 0), "
    "v AS (SELECT page_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY page_id)) AS weight FROM x)\n"
)
_EDGES = "WITH RECURSIVE e AS MATERIALIZED (SELECT DISTINCT 's' || l_suppkey AS src, 'p' || l_partkey AS dst FROM lineitem UNION SELECT 'p' || l_partkey, 's' || l_suppkey FROM lineitem WHERE l_linenumber = 1)\n"
_RANK = (
    _EDGES + ", nd AS MATERIALIZED (SELECT src AS id FROM e UNION SELECT dst FROM e), dg AS MATERIALIZED (SELECT src, count(*) AS out FROM e GROUP BY 1), z AS MATERIALIZED (SELECT count(*) AS n FROM nd), k0 AS MATERIALIZED (SELECT id, 1.0::DOUBLE / n AS rank FROM nd, z)"
    + "".join(
        f", k{i + 1} AS MATERIALIZED (SELECT nd.id, 0.15 / n + 0.85 * (coalesce(f.flow, 0) + (SELECT coalesce(sum(rank), 0) FROM k{i} WHERE id NOT IN (SELECT src FROM dg)) / n) AS rank FROM nd CROSS JOIN z LEFT JOIN (SELECT e.dst, sum(rank / out) AS flow FROM e JOIN k{i} ON k{i}.id = e.src JOIN dg ON dg.src = e.src GROUP BY 1) f ON f.dst = nd.id)"
        for i in range(RANK_ROUNDS)
    )
    + f" SELECT id, round(rank, 9) AS rank, CAST(floor(ln(1 + rank * n) / ln(1 + (SELECT max(rank) FROM k{RANK_ROUNDS}) * n) * 100 + 0.5) AS INTEGER) AS score FROM k{RANK_ROUNDS}, z"
)

QUERIES = {f.__name__: f for f in (
    r15_exact_duplicates, r15_thin, x1_shingles, x3_specific_words, x4_simhash, x5_minhash, x5_text_hashes, x6_estimates, x6_bands, r15_near_duplicates, x8_top_terms, j17_similar_pages, x14_page_fields, f18_tokens, f3_slugs, f5_escaped, k4_guarded, r36_profile, a38_samples, a38_repeats, r36_datasets, r38_sections, g1_pagerank, g2_components, g3_depths, g8_redirects, f7_digests, f19_word_counts, f6_filled_templates, p17_html_search, w10_keepers, w12_runs, a41_any_all, r38_page_chunks, r26_page_grades, p31_page_reading, st_daily_hits,
)}
_NEAR = (
    "WITH RECURSIVE t AS (SELECT DISTINCT doc_id, text FROM documents), w AS (SELECT doc_id, " + _WORDS.format("coalesce(text, '')") + " AS w FROM t), "
    "s AS MATERIALIZED (SELECT doc_id, unnest(CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END) AS e FROM w WHERE len(w) > 0 {}), n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY 1), "
    "c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.e = b.e AND a.doc_id < b.doc_id GROUP BY 1, 2), p AS MATERIALIZED (SELECT a, b, c / (x.n + y.n - c) AS j FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE c / (x.n + y.n - c) >= {}), "
    "l AS MATERIALIZED (SELECT a, b, j FROM p UNION ALL SELECT b, a, j FROM p), r AS (SELECT doc_id AS id, doc_id AS seen FROM w UNION SELECT r.id, l.b FROM r JOIN l ON l.a = r.seen), g AS (SELECT id, min(seen) AS grp FROM r GROUP BY 1)\n"
)
SQL = {
    "x4_simhash": "WITH d AS (SELECT doc_id, " + _WORDS.format("coalesce(text, '')") + " AS w FROM (SELECT DISTINCT doc_id, text FROM documents)), g AS (SELECT doc_id, unnest(CASE WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) END) AS g FROM d WHERE len(w) > 0), h AS (SELECT doc_id, CAST('0x' || md5(g)[1:16] AS UBIGINT) AS h FROM g), "
    "b AS (SELECT doc_id, i, sum(CAST((h >> i) & 1 AS INTEGER)) * 2 > count(*) AS one FROM h, range(64) r(i) GROUP BY 1, 2), s AS (SELECT doc_id, sum(CASE WHEN one THEN CAST(1 AS HUGEINT) << CAST(i AS INTEGER) ELSE 0 END) AS u FROM b GROUP BY 1) SELECT d.doc_id, CAST(coalesce(CASE WHEN u >= 9223372036854775808 THEN u - 18446744073709551616 ELSE u END, 0) AS BIGINT) AS simhash FROM d LEFT JOIN s USING (doc_id)",
    "x5_text_hashes": "WITH d AS (SELECT doc_id, " + _WORDS.format("coalesce(text, '')") + " AS w FROM (SELECT DISTINCT doc_id, text FROM documents)) SELECT doc_id, CAST(len(w) AS INTEGER) AS n_words, sha1(array_to_string(w, ' ')) AS text_hash FROM d",
    "x6_bands": _NEAR.format("", 0.8) + "SELECT w.doc_id, least(w.doc_id, coalesce(min(l.b) FILTER (WHERE l.j = 1), w.doc_id)) AS class, any_value(g.grp) AS group, count(l.b) AS links FROM w JOIN g ON g.id = w.doc_id LEFT JOIN l ON l.a = w.doc_id GROUP BY w.doc_id",
    "r15_near_duplicates": _NEAR.format("AND len(w) >= 50", 0.85) + "SELECT grp AS keeper, count(*) AS documents FROM g JOIN n ON n.doc_id = g.id GROUP BY 1 HAVING count(*) > 1",
    "r15_exact_duplicates": "SELECT min(doc_id) AS keeper, count(*) AS documents FROM (SELECT DISTINCT doc_id, text FROM documents WHERE text IS NOT NULL) GROUP BY md5(text) HAVING count(*) > 1",
    "r15_thin": _P + f"SELECT page_id, CAST(len({_WORDS.format('markdown')}) AS INTEGER) AS words FROM p WHERE len({_WORDS.format('markdown')}) < 200",
    "x1_shingles": _G + f", w AS (SELECT page_id, {_WORDS.format('content')} AS w FROM g) SELECT page_id, CAST(CASE WHEN len(w) = 0 THEN 0 ELSE len(list_distinct(list_transform(range(1, greatest(len(w) - 1, 2)), lambda i: array_to_string(w[i:i + 2], ' ')))) END AS INTEGER) AS shingles FROM w",
    "x3_specific_words": _G + f", t AS (SELECT template_id, list_distinct({_WORDS.format(chr(39).join(['regexp_replace(body_template, ', '\\{\\{[^}]*\\}\\}', ', ', ' ', ', ', 'g', ')']))}) AS fixed FROM content_template), w AS (SELECT page_id, template_id, list_distinct({_WORDS.format('content')}) AS w FROM g) SELECT page_id, CAST(len(list_filter(w, lambda y: NOT list_contains(fixed, y))) AS INTEGER) AS specific FROM w JOIN t USING (template_id)",
    "x8_top_terms": _TERMS + "SELECT page_id, term, weight FROM (SELECT page_id, term, round(weight, 6) AS weight, row_number() OVER (PARTITION BY page_id ORDER BY round(weight, 6) DESC, term) AS rn FROM v) WHERE rn <= 3",
    "j17_similar_pages": _TERMS + f", q AS (SELECT a.page_id AS query, b.page_id, sum(a.weight * b.weight) AS cosine FROM v a JOIN v b ON a.term = b.term AND a.page_id <> b.page_id WHERE a.page_id % {QUERY_SHARE} = 0 GROUP BY 1, 2 HAVING sum(a.weight * b.weight) >= 0.2) SELECT query, count(*) AS similar, round(max(cosine), 5) AS best FROM q GROUP BY 1",
    "x14_page_fields": _G + ", h AS (SELECT page_id, regexp_extract_all(content, '(?is)<h1\\b[^>]*>(.*?)</h1\\s*>', 1) AS h1s, len(regexp_extract_all(content, '(?is)<h2\\b[^>]*>(.*?)</h2\\s*>')) AS h2s, len(regexp_extract_all(content, '(?is)<a\\b[^>]*\\shref\\s*=')) AS links FROM g) SELECT page_id, nullif(trim(regexp_replace(regexp_replace(h1s[1], '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g')), '') AS h1, CAST(len(h1s) AS INTEGER) AS h1_count, CAST(h2s AS INTEGER) AS h2_count, CAST(links AS INTEGER) AS links FROM h",
    "f18_tokens": "WITH i AS (SELECT DISTINCT item_id, kind, tokens, greatest(1, CAST(ceil(length(md) / 4.0) AS INTEGER)) AS estimate FROM md_item) SELECT kind, count(*) AS items, CAST(sum(estimate) AS BIGINT) AS tokens, count(*) FILTER (WHERE tokens <> estimate) AS stale FROM i GROUP BY 1",
    "f3_slugs": _P + "SELECT DISTINCT strip_accents(lower(title)) AS folded, trim(regexp_replace(strip_accents(lower(title)), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM p WHERE title IS NOT NULL",
    "f5_escaped": _G + "SELECT template_id, CAST(sum(length(replace(replace(replace(replace(replace(content, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), chr(39), '&#39;'))) AS BIGINT) AS characters FROM g GROUP BY 1",
    "k4_guarded": "WITH c AS (SELECT c_custkey, CAST(CAST(c_acctbal AS DECIMAL(14, 2)) AS VARCHAR) AS raw FROM customer) SELECT c_custkey, CASE WHEN raw[1:1] IN ('=', '+', '-', '@') THEN chr(39) || raw ELSE raw END AS cell FROM c",
    "r36_profile": " UNION ALL ".join(f"SELECT '{c}' AS \"column\", '{k}' AS type, count(*) AS n_rows, count(*) FILTER (WHERE {c} IS NULL) AS empty, count(DISTINCT {c}) AS distinct_values FROM customer" for c, k in (("c_custkey", "number"), ("c_name", "text"), ("c_nationkey", "number"), ("c_acctbal", "number"), ("c_mktsegment", "text"))),
    "a38_samples": "WITH n AS (SELECT count(*) AS n FROM part), v AS (" + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", CAST({c} AS VARCHAR) AS v FROM part" for c in ("p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice")) + "), d AS (SELECT DISTINCT \"column\", trim(v) AS v FROM v WHERE trim(coalesce(v, '')) <> '') SELECT \"column\", list_sort(list(v))[1:3] AS samples, count(*) = any_value(n.n) AS is_key FROM d, n GROUP BY 1",
    "a38_repeats": "WITH r AS (SELECT DISTINCT record_id, dataset_id, raw FROM dataset_record) SELECT record_id, first FROM (SELECT record_id, min(record_id) OVER (PARTITION BY dataset_id, raw) AS first FROM r) WHERE record_id <> first",
    "r36_datasets": "WITH r AS (SELECT dataset_id, count(*) AS records, count(*) FILTER (WHERE trim(raw) = '') AS blank FROM (SELECT DISTINCT record_id, dataset_id, raw FROM dataset_record) GROUP BY 1) SELECT d.dataset_id, site_id, row_count, coalesce(records, 0) AS records, coalesce(blank, 0) AS blank FROM dataset d LEFT JOIN r USING (dataset_id)",
    "r38_sections": _P + ", l AS (SELECT page_id, unnest(string_split(markdown, chr(10))) AS line FROM p) SELECT CAST(length(regexp_extract(line, '^(#{1,6})\\s', 1)) AS INTEGER) AS level, count(*) AS headings, count(DISTINCT page_id) AS pages FROM l WHERE regexp_matches(line, '^#{1,6}\\s') GROUP BY 1",
    "g1_pagerank": _RANK,
    "f7_digests": "SELECT DISTINCT doc_id, md5(coalesce(text, '')) AS md5, sha1(coalesce(text, '')) AS sha1, sha256(coalesce(text, '')) AS sha256 FROM documents",
    "f19_word_counts": "SELECT DISTINCT doc_id, CAST(len(string_split(trim(coalesce(text, ''), ' '), ' ')) AS INTEGER) AS blanks, CAST(len(regexp_extract_all(coalesce(text, ''), '\\S+')) AS INTEGER) AS runs, CAST(len(regexp_extract_all(coalesce(text, ''), '[\\p{L}\\p{N}]+')) AS INTEGER) AS words FROM documents",
    "f6_filled_templates": "WITH t AS (SELECT template_id, title_template AS t, list_distinct(regexp_extract_all(title_template, '\\{\\{\\s*([\\w.-]+)\\s*\\}\\}', 1)) AS names FROM content_template) SELECT template_id, n_nationkey AS row_no, regexp_replace(regexp_replace(regexp_replace(t, '\\{\\{\\s*(ciudad|city)\\s*\\}\\}', n_name, 'g'), '\\{\\{\\s*(marca|brand)\\s*\\}\\}', 'A &amp; B', 'g'), '\\{\\{\\s*[\\w.-]+\\s*\\}\\}', '', 'g') AS title, CAST(len(list_filter(names, lambda x: x NOT IN ('ciudad', 'city', 'marca', 'brand'))) AS INTEGER) AS missing FROM t, nation",
    "p17_html_search": _G + "SELECT page_id, CAST(len(regexp_extract_all(content, '<h[23]>')) AS INTEGER) AS hits FROM g WHERE regexp_matches(content, '<h[23]>')",
    "w10_keepers": "WITH d AS (SELECT DISTINCT ON (doc_id) * FROM documents WHERE text IS NOT NULL), k AS (SELECT md5(text) AS digest, doc_id, row_number() OVER (PARTITION BY text ORDER BY title IS NULL, length(url) NULLS FIRST, url NULLS FIRST, doc_id) AS n, count(*) OVER (PARTITION BY text) AS documents FROM d) SELECT digest, doc_id AS keeper, documents FROM k WHERE n = 1 AND documents > 1",
    "w12_runs": "WITH e AS (SELECT DISTINCT log_id, site_id, ts, coalesce(bot_name, '-') AS bot_name FROM log_entry), s AS (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY ts, log_id) - row_number() OVER (PARTITION BY site_id, bot_name ORDER BY ts, log_id) AS island FROM e), r AS (SELECT site_id, bot_name, island, count(*) AS n FROM s GROUP BY ALL HAVING count(*) >= 3) SELECT bot_name, count(*) AS runs, max(n) AS longest FROM r GROUP BY 1",
    "a41_any_all": "WITH i AS (SELECT DISTINCT ON (item_id) * FROM md_item) SELECT kind, count(*) AS items, count(*) FILTER (WHERE len(list_filter(headings, lambda h: coalesce(length(h) > 20, false))) > 0) AS any_long, count(*) FILTER (WHERE len(list_filter(headings, lambda h: NOT coalesce(length(h) > 20, false))) = 0) AS all_long FROM i WHERE headings IS NOT NULL GROUP BY 1",
    "g2_components": "WITH RECURSIVE l AS (SELECT DISTINCT crawl_run_id AS a, base_run_id AS b FROM crawl_run WHERE base_run_id IS NOT NULL), e AS (SELECT a, b FROM l UNION SELECT b, a FROM l), c AS (SELECT a AS id, a AS seen FROM e UNION SELECT c.id, e.b FROM c JOIN e ON e.a = c.seen), m AS (SELECT id, min(seen) AS component FROM c GROUP BY 1) SELECT component, count(*) AS runs FROM m GROUP BY 1",
    "g3_depths": _EDGES + ", b AS (SELECT 's1' AS id, 0 AS depth UNION SELECT e.dst, b.depth + 1 FROM b JOIN e ON e.src = b.id WHERE b.depth < 60), m AS (SELECT id, min(depth) AS depth FROM b GROUP BY 1) SELECT depth, count(*) AS nodes FROM m GROUP BY 1",
    "g8_redirects": "WITH RECURSIVE r AS MATERIALIZED (SELECT url AS src, min(final_url) AS dst FROM crawled_page WHERE final_url <> url GROUP BY 1), f AS (SELECT src, dst AS target, 1 AS hops FROM r UNION ALL SELECT f.src, r.dst, f.hops + 1 FROM f JOIN r ON r.src = f.target WHERE f.hops < 32), e AS (SELECT src, max(hops) AS hops FROM f GROUP BY 1), t AS (SELECT e.src, e.hops, f.target IN (SELECT src FROM r) AS loop FROM e JOIN f ON f.src = e.src AND f.hops = e.hops) SELECT CASE WHEN loop THEN NULL ELSE hops END AS hops, loop, count(*) AS urls FROM t GROUP BY 1, 2",
    "st_daily_hits": "SELECT CAST(ts AS DATE) AS date, bot_name, count(*) AS hits, CAST(sum(size_bytes) AS BIGINT) AS bytes FROM (SELECT DISTINCT log_id, ts, bot_name, size_bytes FROM log_entry) GROUP BY 1, 2",
}
