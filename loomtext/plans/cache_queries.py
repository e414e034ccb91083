"""Tables that pipelines keep between runs: tokens, vocabulary, weights, features, entity vectors and triples."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config, scratch
from ..functions import text as X
from ..operators import kb, kg, tfidf
from ..sources.sinks import KeyedTables
from .kg_queries import _CLAIMS, DIM, _vectors
from .tables import DOCS, claims, docs
from .text_queries import _DASHED, _IDF, _VOCAB, vocab_ids


def makers(spark: SparkSession, d: str, s: config.Settings) -> dict[str, tuple[dict, Callable[[], DataFrame]]]:
    """Name to the settings a table depends on, and how it is made."""
    tokens = lambda: docs(spark, d).select("id", "split", X.tokens(X.ascii_only(F.col("text")), X.DASHED).alias("tokens"))
    triples = lambda: kb.claim_rows(claims(spark, d), tuple(s.graph.relations)).select(F.col("qid").alias("h"), F.col("property").alias("r"), F.col("value").alias("t"))
    text = {"data": d, "pattern": X.DASHED}
    return {
        "tokens": (text, tokens),
        "vocabulary": (text | {"size": s.text.vocabulary}, lambda: vocab_ids(spark, d)),
        "weights": ({"data": d, "pattern": X.TERMS}, lambda: tfidf.idf(docs(spark, d).where("split = 'train'"))),
        "triples": ({"data": d, "relations": list(s.graph.relations)}, triples),
        "entity_vectors": ({"data": d, "weight": 0.1, "rounds": 5}, lambda: kg.refine(_vectors(spark, d), DIM)),
    }


def cached_tables(spark: SparkSession, d: str) -> DataFrame:
    """(name, n_rows, reused, other): each table made and kept, asked for again with the same settings, and with others."""
    store = KeyedTables(spark, scratch.folder(spark, "cache"))
    out = None
    for name, (settings, make) in makers(spark, d, config.load()).items():
        store.get(name, settings, make)
        again, other = store.load(name, settings), store.load(name, settings | {"changed": True})
        row = again.agg(F.lit(name).alias("name"), F.count("*").alias("n_rows"), F.lit(True).alias("reused"), F.lit(other is not None).alias("other"))
        out = row if out is None else out.union(row)
    return out


_TOP = "', '".join(kb.TOP_RELATIONS)
QUERIES = {"cached_tables": cached_tables}
ORACLE = {
    "cached_tables": f"""with {DOCS}, {_DASHED}, {_VOCAB}, {_IDF}, {_CLAIMS}
        select name, n_rows, true as reused, false as other from (
          select 'tokens' as name, (select count(*) from docs) as n_rows union all select 'vocabulary', (select count(*) from vocab) union all select 'weights', (select count(*) from idf)
          union all select 'triples', (select count(*) from cl where property in ('{_TOP}')) union all select 'entity_vectors', (select count(*) from embeddings))""",
}
