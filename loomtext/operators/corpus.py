"""Article rows and corpus statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import scratch
from ..functions import text as X
from ..functions.hashing import hash60
from .ordinals import with_ordinal


def articles(table: DataFrame) -> DataFrame:
    """(id, title, text, label, split): both datasets in one schema, label 1 = fake; null texts and titles read as empty, null labels stay null."""
    label = F.when(F.col("dataset") == "primary", X.label_flag(F.col("label"), "FAKE")).otherwise(X.label_flag(F.col("label"), 0))
    return table.select(F.col("article_no").alias("id"), X.whole(F.col("title")).alias("title"), X.whole(F.col("text")).alias("text"), label.cast("int").alias("label"), "split")


def capped(docs: DataFrame, most: int) -> DataFrame:
    """The first `most` documents by id, all of them for 0."""
    return docs.orderBy("id").limit(most) if most > 0 else docs


def token_counts(docs: DataFrame, pattern: str = X.WORDS, text: str = "text") -> DataFrame:
    """(token, n) over the whole corpus."""
    return docs.select(F.explode(X.tokens(F.col(text), pattern)).alias("token")).groupBy("token").agg(F.count("*").alias("n"))


def ranked(counts: DataFrame, item: str, n: str, k: int) -> DataFrame:
    """The k most frequent items with their rank; ties by item. Each task keeps k rows before they meet."""
    top = counts.orderBy(F.desc(n), F.asc(item)).limit(k)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(n), F.asc(item))))


def median_of_counts(counts: DataFrame, value: str, n: str) -> DataFrame:
    """(median): the value at position total div 2 of the values repeated n times."""
    running = counts.select(F.col(value).alias("v"), F.col(n).alias("c")).withColumn("through", F.sum("c").over(Window.orderBy("v")))  # one row per distinct value
    total = counts.agg(F.sum(n).alias("n"))
    return running.join(F.broadcast(total), F.col("through") > F.floor(F.col("n") / 2)).agg(F.min("v").alias("median"))


def upper_median(values: DataFrame, col: str) -> DataFrame:
    """(median): the value at position n div 2 of the sorted values, found through their counts."""
    return median_of_counts(values.where(F.col(col).isNotNull()).groupBy(col).agg(F.count("*").alias("_n")), col, "_n")


def corpus_stats(docs: DataFrame, pattern: str = X.WORDS) -> DataFrame:
    """One row: documents, tokens, unique tokens, mean, upper median, least and most tokens; zeros for no documents.

    One scan: each document gives its terms with their counts, and one row
    with its length; both are counted up together, so what is left to look at
    is one row per term and one per length.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("id"), X.tokens(F.col("text"), pattern).alias("t"))
    length = F.concat(F.lit(" "), F.size("t").cast("string"))
    per = X.term_counts(rows.select("id", F.array_append("t", length).alias("tokens")))
    counts = scratch.keep(per.groupBy("token").agg(F.sum("n").alias("n")), "counts")
    lengths = counts.where(F.col("token").startswith(" ")).select(F.substring("token", 2, 20).cast("int").alias("len"), "n")
    terms = counts.where(~F.col("token").startswith(" ")).agg(F.count("*").alias("n_unique"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    sums = lengths.agg(zero(F.sum("n")).alias("n_docs"), zero(F.sum(F.col("len") * F.col("n"))).alias("n_tokens"), zero(F.min("len")).alias("min_len"), zero(F.max("len")).alias("max_len"))
    one = lambda df: df.withColumn("one", F.lit(1))
    out = one(sums).join(one(terms), "one").join(one(median_of_counts(lengths, "len", "n")), "one").drop("one")
    return out.withColumn("mean_len", F.round(zero(F.col("n_tokens") / F.nullif("n_docs", F.lit(0))) * 1.0, 6)).withColumn("median", zero(F.col("median")))


def label_stats(docs: DataFrame) -> DataFrame:
    """One row: real and fake articles, and fake over real with at least 1 below."""
    s = docs.agg(F.count(F.when(F.col("label") == 0, 1)).alias("n_real"), F.count(F.when(F.col("label") == 1, 1)).alias("n_fake"))
    return s.withColumn("fake_to_real", F.round(F.col("n_fake") / F.greatest("n_real", F.lit(1)), 6))


def stratified_split(docs: DataFrame, train: float = 0.8, val: float = 0.1, seed: int = 42) -> DataFrame:
    """(id, label, part): per label the test part first, then val from the rest, in the order of a hash; exact shares per label, disjoint, covering.

    Rows without a label form a stratum of their own. Positions inside a label
    come from dense global positions, so no task holds a whole label.
    """
    rows = docs.select("id", "label", hash60(seed, F.col("id").cast("string")).alias("h"))
    at = with_ordinal(rows, "label", "h", "id")
    labels = at.groupBy("label").agg(F.min("ordinal").alias("first"), F.count("*").alias("n")).withColumnRenamed("label", "_label")
    at = at.join(F.broadcast(labels), F.col("label").eqNullSafe(F.col("_label"))).withColumn("at", F.col("ordinal") - F.col("first") + 1)  # one row per label
    n_test = F.round(F.col("n") * (1 - train - val))
    n_val = F.round((F.col("n") - n_test) * (val / (train + val)))
    part = F.when(F.col("at") <= n_test, "test").when(F.col("at") <= n_test + n_val, "val").otherwise("train")
    return at.select("id", "label", part.alias("part"))
