"""Queries of the training-data operators and their SQL counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import scratch
from ..operators.stitch import normal_qid
from . import frequent, mixing, names, neardup, overlap, packing, reading, seen, terms
from .oracle import ORACLE  # noqa: F401


def _read(spark: SparkSession, d: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{table}.parquet")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    groups = neardup.near_duplicate_groups(_read(spark, d, "articles"), "article_no", "text", threshold=0.6, min_words=30)
    return neardup.group_pairs(groups).select(F.col("a").alias("article_no_a"), F.col("b").alias("article_no_b"))


def p1_groups(spark: SparkSession, d: str) -> DataFrame:
    groups = neardup.near_duplicate_groups(_read(spark, d, "articles"), "article_no", "text")
    return groups.select(F.col("id").alias("article_no"), "rep", "group_no")


def p1_links(spark: SparkSession, d: str) -> DataFrame:
    """The groups with the number of links of each text."""
    articles = _read(spark, d, "articles")
    groups = scratch.keep(neardup.near_duplicate_groups(articles, "article_no", "text"), "groups")
    return neardup.link_counts(groups, articles, "article_no", "text").select(F.col("id").alias("article_no"), "rep", "group_no", "n_links")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = overlap.overlaps(_read(spark, d, "articles"), threshold=0.6)
    return pairs.select(F.least("t", "e").alias("article_no_a"), F.greatest("t", "e").alias("article_no_b")).distinct()


def p4_report(spark: SparkSession, d: str) -> DataFrame:
    return overlap.overlap_report(_read(spark, d, "articles"), threshold=0.6)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    answers = seen.linked_entities_seen(_read(spark, d, "linked_entities"), _read(spark, d, "kb_search"))
    return answers.where("seen and not history").select(F.col("no").alias("link_id"))


def p3_audit(spark: SparkSession, d: str) -> DataFrame:
    return seen.audit(_read(spark, d, "linked_entities"), _read(spark, d, "kb_search"))


def p3_filter(spark: SparkSession, d: str) -> DataFrame:
    return seen.filter_report(seen.linked_entities_seen(_read(spark, d, "linked_entities"), _read(spark, d, "kb_search")))


def _frequent(spark: SparkSession, d: str) -> DataFrame:
    qids = _read(spark, d, "linked_entities").select(F.lit("qid").alias("field"), normal_qid(F.col("qid")).alias("item"))
    blank = F.when(F.col("text").isNotNull(), F.coalesce(seen.normal_mention(F.col("text")), F.lit("")))
    mentions = _read(spark, d, "mentions").select(F.lit("mention").alias("field"), blank.alias("item"))
    return frequent.frequent_items(qids.union(mentions), 0.008)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return _frequent(spark, d).select("field", "item")


def p6_counts(spark: SparkSession, d: str) -> DataFrame:
    """Exact counts and shares of the second pass."""
    return _frequent(spark, d).select("field", "item", "n", F.round("share", 9).alias("share"))


def p6_estimates(spark: SparkSession, d: str) -> DataFrame:
    """The summaries' counts with their error bounds beside the exact ones."""
    return _frequent(spark, d)


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return terms.term_table(_read(spark, d, "articles"), "article_no", "text").where("mark is not null").select("term", "mark")


def p7_terms(spark: SparkSession, d: str) -> DataFrame:
    return terms.term_table(_read(spark, d, "articles"), "article_no", "text")


def p8_pack(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(_read(spark, d, "documents"), _read(spark, d, "container_sizes"))


def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill_report(p8_pack(spark, d))


def p9_uses(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(_read(spark, d, "documents"), _read(spark, d, "mix_targets"), mixing.CORPUS, lang_col="lang")[0]


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.share_report(*mixing.mix(_read(spark, d, "documents"), _read(spark, d, "mix_targets"), mixing.CORPUS, lang_col="lang"))


def p9_checks(spark: SparkSession, d: str) -> DataFrame:
    return mixing.checks(*mixing.mix(_read(spark, d, "documents"), _read(spark, d, "mix_targets"), mixing.CORPUS, lang_col="lang"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return reading.reading_levels(_read(spark, d, "documents"), _read(spark, d, "reading_labels")).select("doc_id", "reading_level")


def p10_validation(spark: SparkSession, d: str) -> DataFrame:
    return reading.validation(_read(spark, d, "documents"), _read(spark, d, "reading_labels"))


def _names(spark: SparkSession, d: str):
    """Rows of linked_entities in short, normalised once for all the steps that read them, the resolved ones among them, and the known names."""
    linked = _read(spark, d, "linked_entities")
    short = linked.select("link_id", "mention_id", "article_no", names.spelling_of(F.col("mention")).alias("spelling"), normal_qid(F.col("qid")).alias("known"))
    linked = scratch.keep(short, "linked")
    resolved = linked.where("known is not null").select(F.col("link_id").alias("id"), F.col("article_no").alias("grp"), "spelling", F.col("known").alias("qid"))
    table = scratch.keep(names.known_names(_read(spark, d, "kb_search")), "known")
    return linked, resolved, table


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    linked, resolved, table = _names(spark, d)
    habits = names.learn(resolved.select("spelling", "qid"), table)
    found = names.link_variants(linked.where("known is null"), "link_id", "spelling", "article_no", table, resolved.select("grp", "qid"), habits)
    return found.select(F.col("id").alias("link_id"), "qid")


def p5_mentions(spark: SparkSession, d: str) -> DataFrame:
    """The mentions behind unresolved rows, by their own text."""
    linked, resolved, table = _names(spark, d)
    open_rows = linked.where("known is null").select("mention_id").distinct()
    mentions = _read(spark, d, "mentions").join(open_rows, "mention_id", "left_semi")
    found = names.link_variants(mentions, "mention_id", "text", "article_no", table, resolved.select("grp", "qid"), names.learn(resolved.select("spelling", "qid"), table))
    return found.select(F.col("id").alias("mention_id"), "qid", "cost")


def p5_validation(spark: SparkSession, d: str) -> DataFrame:
    """Resolved rows of entities the habits were not learned from."""
    _, resolved, table = _names(spark, d)
    return names.held_out(resolved, table)


QUERIES = {
    f.__name__: f
    for f in (
        p1_found, p1_groups, p1_links, p3_found, p3_audit, p3_filter, p4_found, p4_report, p5_found, p5_mentions, p5_validation, p6_found, p6_counts, p6_estimates, p7_found, p7_terms,
        p8_pack, p8_fill, p9_uses, p9_shares, p9_checks, p10_found, p10_validation,
    )
}
