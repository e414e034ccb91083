"""All queries of the core and their SQL counterparts."""

from __future__ import annotations

from . import cache_queries, corpus_queries, eval_queries, kg_queries, stream_queries, text_queries, training

FLAGSHIP = "token_heavy_hitters"
_ALL = (corpus_queries, text_queries, kg_queries, eval_queries, stream_queries, training, cache_queries)
QUERIES = {k: f for m in _ALL for k, f in m.QUERIES.items()}
ORACLE = {k: s for m in _ALL for k, s in m.ORACLE.items()}
