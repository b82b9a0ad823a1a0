"""All queries of the core, and the SQL that states the same results."""

from __future__ import annotations

from almena.plans import crawl_queries, log_queries, planted, record_queries, search_queries, text_queries

FLAGSHIP = "r1_bot_hits_by_day"
_MODULES = [log_queries, crawl_queries, search_queries, text_queries, record_queries, planted]
QUERIES = {name: run for m in _MODULES for name, run in m.QUERIES.items()}
SQL = {name: text for m in _MODULES for name, text in m.SQL.items()}
