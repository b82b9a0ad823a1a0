"""Column functions against values worked out by hand."""

import hashlib
import hmac
import math

from pyspark.sql import functions as F

from almena.functions import agents, privacy, stats, text, url


def one(spark, column, **values):
    row = spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items()), *([F.lit(1).alias("_")] if not values else []))
    return row.select(column.alias("x")).first()["x"]


def test_url_keys(spark):
    key = lambda u: one(spark, url.url_key(F.col("u")), u=u)
    assert key("https://Example.COM/a/b/?q=1#top") == "https://example.com/a/b?q=1"
    assert key("https://example.com") == "https://example.com/"
    assert key("https://example.com:443/x/") == "https://example.com/x"
    assert key("not a url") == "not a url" and key(None) is None
    assert one(spark, url.path_of(F.col("u")), u="https://a.b?x=1") == "/?x=1"
    assert one(spark, url.domain_of(F.col("u")), u="https://WWW.Shop.example:8080/x") == "shop.example"
    assert one(spark, url.domain_of(F.col("u")), u="nothing") == ""
    assert one(spark, url.first_dir(F.col("u")), u="/about") == "/about/"
    assert one(spark, url.first_folder(F.col("u")), u="/about") == "/" and one(spark, url.first_folder(F.col("u")), u="/a/b") == "/a/"
    assert one(spark, url.prefixes(F.col("u")), u="/a/b/c") == ["/", "/a/", "/a/b/"]
    assert one(spark, url.prefixes(F.col("u")), u="/") == ["/"]
    assert one(spark, url.query_keys(F.col("u")), u="/p?a=1&b&a=2") == ["a", "b", "a"]


def test_text(spark):
    assert one(spark, text.fold_text(F.col("t")), t="Ñandú ÁÉ é") == "nandu ae e"
    assert one(spark, text.norm_query(F.col("t")), t="  Silla   ERGONÓMICA ") == "silla ergonomica"
    assert one(spark, text.to_words(F.col("t")), t="<p>Hola, &amp; adiós<script>x()</script></p> 3D") == ["hola", "adios", "3d"]
    assert one(spark, text.shingles(F.array(*map(F.lit, "a b c d b c d".split())))) == ["a b c", "b c d", "c d b", "d b c"]
    assert one(spark, text.shingles(F.array(F.lit("a")))) == ["a"] and one(spark, text.shingles(F.array().cast("array<string>"))) == []
    assert one(spark, text.jaccard(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("b"), F.lit("c")))) == 1 / 3
    assert one(spark, text.jaccard(F.array().cast("array<string>"), F.array().cast("array<string>"))) == 0
    assert [tuple(r) for r in one(spark, text.multiset_minus(F.array(*map(F.lit, "aab")), F.array(*map(F.lit, "ac"))))] == [("a", 1), ("b", 1)]
    assert one(spark, text.stem(F.col("t")), t="canciones") == "cancion" and one(spark, text.stem(F.col("t")), t="sillas") == "silla" and one(spark, text.stem(F.col("t")), t="mes") == "mes"
    assert one(spark, text.round_up(F.lit(-2.5))) == -2 and one(spark, text.round_up(F.lit(2.345), 2)) == 2.35
    assert one(spark, text.html_escape(F.col("t")), t="<a & \"b'>") == "&lt;a &amp; &quot;b&#39;&gt;"
    assert one(spark, text.csv_guard(F.col("t")), t="=1+1") == "'=1+1" and one(spark, text.csv_guard(F.col("t")), t="a=1") == "a=1"
    assert one(spark, text.slug(F.col("t")), t=" Qué  haremos? ") == "que-haremos"
    assert one(spark, text.token_estimate(F.col("t")), t="") == 1 and one(spark, text.token_estimate(F.col("t")), t="abcde") == 2


def test_agents(spark):
    name = lambda a: one(spark, agents.crawler_name(F.col("a")), a=a)
    assert name("Mozilla/5.0 (Linux; Android 6) Mobile Safari (compatible; Googlebot/2.1)") == "Googlebot Smartphone"
    assert name("Mozilla/5.0 (compatible; Googlebot/2.1)") == "Googlebot Desktop"
    assert name("Googlebot-Image/1.0") == "Googlebot-Image" and name("Claude-SearchBot/1") == "Claude-SearchBot" and name("ChatGPT-User/1.0") == "ChatGPT-User"
    assert name("SomeSpider") == "Unknown Bot" and name("Mozilla/5.0 Firefox") == "Browser / Other" and name("-") == "Unknown" and name(None) == "Unknown"
    assert one(spark, agents.crawler_category(F.lit("GPTBot"))) == "AI_CRAWLER" and one(spark, agents.crawler_category(F.lit("?"))) == "UNKNOWN"
    assert one(spark, agents.ai_referrer(F.lit("https://chatgpt.com/c/1"))) == "ChatGPT" and one(spark, agents.ai_referrer(F.lit("https://google.com"))) is None


def test_privacy(spark):
    assert one(spark, privacy.redact_query(F.col("q")), q="utm_source=x&token=abc&Token=z&token=d") == "utm_source=x&token=%5BREDACTED%5D&Token=%5BREDACTED%5D"
    for key in ("salt", "k" * 64, "k" * 100):
        assert one(spark, privacy.hash_ip(F.col("i"), key), i="203.0.113.9") == hmac.new(key.encode(), b"203.0.113.9", hashlib.sha256).hexdigest()[:16]
    assert one(spark, privacy.hash_ip(F.lit(None).cast("string"), "s")) == "0.0.0.0"
    assert one(spark, privacy.redact_line(F.col("s")), s="1.2.3.4 ?token=abc x") == "[ip] ?token=[REDACTED] x"


def test_stats(spark):
    z = one(spark, stats.normal_two_sided(F.lit(1.96)))
    assert abs(z - math.erfc(1.96 / 2**0.5)) < 1e-6
    assert one(spark, stats.welch_p(F.lit(1.0), F.lit(0.0), F.lit(9), F.lit(1.0), F.lit(0.0), F.lit(9))) == 1.0
    assert one(spark, stats.welch_p(F.lit(1.0), F.lit(1.0), F.lit(4), F.lit(1.0), F.lit(1.0), F.lit(9))) is None
    assert one(spark, stats.latency_bucket(F.lit(10))) == 0 and one(spark, stats.latency_bucket(F.lit(10001))) == 14 and one(spark, stats.bucket_limit(F.lit(14))) == 10000
    assert one(spark, stats.relative_change(F.lit(0), F.lit(3))) == 1.0 and one(spark, stats.relative_change(F.lit(0), F.lit(0))) == 0.0
    assert one(spark, stats.priority(F.lit(5.0), F.lit(0.9), F.lit(10), F.lit(1.0), F.lit(1.0), F.lit(1.0))) == 9.0
