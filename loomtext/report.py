"""Reports as Markdown, from small result tables."""

from __future__ import annotations

from pyspark.sql import Row, SparkSession

from .plans import registry
from .sources.sinks import markdown

SECTIONS = (
    ("Corpus", "corpus_stats"),
    ("Labels", "label_stats"),
    ("Most frequent tokens, exact and sketched", "token_heavy_hitters"),
    ("Greatest relative error of the sketch", "cms_error"),
    ("Filter of resolved entities", "bloom_stats"),
    ("Linking", "link_counters"),
    ("Most frequent entities", "entity_frequency"),
    ("Duplicates", "dup_report"),
    ("Most similar pairs", "dup_sample"),
    ("Models", "model_reports"),
)
EVALUATION = (
    ("Models, best first", "model_reports"),
    ("Hashed words, by split", "hashing_logreg_report"),
    ("Ablation", "ablation_report"),
    ("Decisions by split", "confusion_prf"),
    ("Area under the curve", "roc_auc"),
    ("Overlap of generated and given titles", "rouge_means"),
    ("Vocabulary", "vocab_coverage"),
    ("Words with vectors", "vector_coverage"),
)


def _sections(spark: SparkSession, d: str, head: str, sections: tuple) -> str:
    return f"# {head}\n\n" + "\n".join(f"## {title}\n\n{markdown(registry.QUERIES[name](spark, d))}" for title, name in sections)


def corpus_report(spark: SparkSession, d: str) -> str:
    """Statistics, sketches, links and duplicates of the tables in folder d."""
    return _sections(spark, d, "Corpus report", SECTIONS)


def evaluation_report(spark: SparkSession, d: str) -> str:
    """The tables of an evaluation over folder d."""
    return _sections(spark, d, "Evaluation", EVALUATION)


def link_caption(counts: Row) -> str:
    """One line on a row of offline_link_counters."""
    asked = counts["hits"] + counts["misses"]
    return f"{asked} mentions: {counts['hits']} in the cache, {counts['misses']} not, {counts['resolved']} resolved"
