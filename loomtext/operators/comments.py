"""Rule-based comments on articles: entities that do not resolve or do not fit, and key topics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import kb

#: The sentences of a comment.
FLAGGED = "Potential entity-linking concerns for: {}. These are heuristic observations from a string-based Wikidata lookup and may simply reflect a wrong link rather than a factual problem with the article."
CLEAN = "All extracted entities resolve cleanly against Wikidata."


def quoted(c: Column) -> Column:
    """A text in single quotes; in double quotes where it holds single ones and no double ones; backslashes, line breaks, tabs and single quotes inside single quotes are escaped."""
    out = c
    for plain, written in (("\\", "\\\\"), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        out = F.replace(out, F.lit(plain), F.lit(written))
    switch = c.contains("'") & ~c.contains('"')
    return F.when(switch, F.concat(F.lit('"'), out, F.lit('"'))).otherwise(F.concat(F.lit("'"), F.replace(out, F.lit("'"), F.lit("\\'")), F.lit("'")))


def flags(mentions: DataFrame, search: DataFrame, claims: DataFrame, max_flags: int = 5) -> DataFrame:
    """(article_no, pos, text, reason) of flagged mentions, from (article_no, pos, text, label).

    A mention is flagged without an entity, or where the entity's kind clashes
    with the label. Once max_flags are reached at a mention that resolves,
    later mentions are not looked at; unresolved ones do not stop the search.
    """
    linked = kb.link(mentions, search)
    side = claims.select(F.col("qid").alias("_q"), F.col("claims")["P31"].alias("classes"))
    rows = linked.join(side, F.col("qid") == F.col("_q"), "left").drop("_q")
    record = F.struct("description", F.lit(False).alias("_no_match"))
    clash = F.coalesce(kb.class_mismatch(record, F.col("classes"), F.col("label")), F.lit(False))
    reason = F.when(F.col("qid").isNull(), F.concat(quoted(F.col("text")), F.lit(": no Wikidata match found"))).when(
        clash,
        F.concat(quoted(F.col("text")), F.lit(" (NER: "), F.col("label"), F.lit(") -> linked to '"), F.coalesce("entity_label", "qid"),
                 F.lit("' ["), F.coalesce("description", F.lit("(no description)")), F.lit("], which does not look like a "), F.col("label")),
    )
    w = Window.partitionBy("article_no").orderBy("pos")  # at most 25 mentions an article
    rows = rows.withColumn("reason", reason).withColumn("so_far", F.count("reason").over(w))
    full = F.when(F.col("qid").isNotNull() & (F.col("so_far") >= max_flags), F.col("pos"))
    rows = rows.withColumn("stop", F.min(full).over(Window.partitionBy("article_no")))
    return rows.where("reason is not null and (stop is null or pos <= stop)").select("article_no", "pos", "text", "reason")


def comments(articles: DataFrame, flagged: DataFrame, keywords: DataFrame) -> DataFrame:
    """(id, comment, n_flagged): the text built from the flagged mentions and the key topics; keywords is (id, rank, keyword)."""
    names = flagged.groupBy(F.col("article_no").alias("id")).agg(F.array_sort(F.collect_list(F.struct("pos", "text"))).alias("f"))
    topics = keywords.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("rank", "keyword"))).alias("k"))
    rows = articles.select("id").join(names, "id", "left").join(topics, "id", "left")
    head, tail = FLAGGED.split("{}")
    first = F.when(F.col("f").isNotNull(), F.concat(F.lit(head), F.array_join("f.text", ", "), F.lit(tail))).otherwise(F.lit(CLEAN))
    second = F.when(F.col("k").isNotNull(), F.concat(F.lit("Key topics: "), F.array_join("k.keyword", ", "), F.lit(".")))
    return rows.select("id", F.concat_ws(" ", first, second).alias("comment"), F.coalesce(F.size("f"), F.lit(0)).alias("n_flagged"))


def out_of_domain(tokens: str, resolved: str, min_tokens: int = 50) -> list:
    """Two flags: too short a text, and no resolved entity."""
    return [(F.col(tokens) < min_tokens).alias("too_short"), (F.col(resolved) == 0).alias("no_entities")]
