"""Columns over user agents, referrers and clients."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Crawlers by name, category and pattern; the first that matches wins.
CRAWLERS = [
    ("Googlebot-Image", "SEARCH_ENGINE", "googlebot-image"),
    ("Googlebot-Video", "SEARCH_ENGINE", "googlebot-video"),
    ("Googlebot-News", "SEARCH_ENGINE", "googlebot-news"),
    ("Googlebot Smartphone", "SEARCH_ENGINE", "googlebot/.*(mobile|android|iphone)|(mobile|android|iphone).*googlebot/"),
    ("Googlebot Desktop", "SEARCH_ENGINE", "googlebot/"),
    ("Google-Extended", "AI_CRAWLER", "google-extended"),
    ("Bingbot", "SEARCH_ENGINE", "bingbot"),
    ("Applebot", "SEARCH_ENGINE", "applebot/"),
    ("DuckDuckBot", "SEARCH_ENGINE", "duckduckbot"),
    ("YandexBot", "SEARCH_ENGINE", "yandexbot"),
    ("Baiduspider", "SEARCH_ENGINE", "baiduspider"),
    ("OAI-SearchBot", "AI_CRAWLER", "oai-searchbot"),
    ("GPTBot", "AI_CRAWLER", "gptbot"),
    ("Claude-SearchBot", "AI_CRAWLER", "claude-searchbot"),
    ("ClaudeBot", "AI_CRAWLER", "claudebot"),
    ("PerplexityBot", "AI_CRAWLER", "perplexitybot"),
    ("Bytespider", "AI_CRAWLER", "bytespider"),
    ("Amazonbot", "AI_CRAWLER", "amazonbot"),
    ("CCBot", "AI_CRAWLER", "ccbot"),
    ("ChatGPT-User", "AI_ASSISTANT", "chatgpt-user"),
    ("Claude-User", "AI_ASSISTANT", "claude-user"),
    ("Perplexity-User", "AI_ASSISTANT", "perplexity-user"),
    ("FacebookExternalHit", "SOCIAL", "facebookexternalhit"),
    ("AhrefsBot", "SEO_TOOL", "ahrefsbot"),
    ("SemrushBot", "SEO_TOOL", "semrushbot"),
    ("Screaming Frog", "SEO_TOOL", "screaming frog"),
]
ANY_CRAWLER = "bot|crawler|spider|crawling"
# Hosts whose links come from an answer engine, as referrer and as traffic source.
REFERRERS = [
    ("ChatGPT", r"^https?://(chat\.openai\.com|chatgpt\.com)"),
    ("Perplexity", r"^https?://(www\.)?perplexity\.ai"),
    ("Claude", r"^https?://claude\.ai"),
    ("Gemini", r"^https?://gemini\.google\.com"),
    ("Copilot", r"^https?://copilot\.microsoft\.com"),
]


def _first(value: Column, rules: list[tuple[str, str]], other: Column) -> Column:
    """The name of the first rule whose pattern is in a lower-case value."""
    chain = reduce(lambda c, r: c.when(value.rlike(r[1]), r[0]), rules[1:], F.when(value.rlike(rules[0][1]), rules[0][0]))
    return chain.otherwise(other)


def crawler_name(agent: Column) -> Column:
    """Name of the crawler behind a user agent; Unknown for none, Browser / Other for people."""
    low = F.lower(F.coalesce(agent, F.lit("")))
    rest = F.when(low.isin("", "-"), "Unknown").when(low.rlike(ANY_CRAWLER), "Unknown Bot").otherwise("Browser / Other")
    return _first(low, [(n, p) for n, _, p in CRAWLERS], rest)


def crawler_category(name: Column) -> Column:
    """Category of a crawler by its name; UNKNOWN for the rest."""
    by_category: dict[str, list[str]] = {}
    for n, c, _ in CRAWLERS:
        by_category.setdefault(c, []).append(n)
    chain = reduce(lambda col, item: col.when(name.isin(item[1]), item[0]), list(by_category.items())[1:], F.when(name.isin(next(iter(by_category.values()))), next(iter(by_category))))
    return chain.otherwise("UNKNOWN")


def is_crawler(name: Column) -> Column:
    return ~F.coalesce(name, F.lit("Unknown")).isin("Unknown", "Browser / Other")


def is_google(name: Column) -> Column:
    return name.startswith("Googlebot")


def is_ai(category: Column) -> Column:
    return category.isin("AI_CRAWLER", "AI_ASSISTANT")


def ai_referrer(referrer: Column) -> Column:
    """The answer engine a visit came from; null for others."""
    return _first(F.lower(referrer), REFERRERS, F.lit(None).cast("string"))
