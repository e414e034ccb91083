"""Inverse document frequencies, vocabularies and weighted vectors."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.hashing import hash60


def idf(docs: DataFrame, min_df: int = 2, max_df: float = 0.95, max_features: int = 50_000) -> DataFrame:
    """(token, df, idf): smoothed inverse document frequency of the tokens in min_df documents to a share of max_df, the most frequent max_features of them.

    Tokens are counted once per document in one scan; both counts are sums of
    that. Ties at the limit go by token.
    """
    n = docs.count()
    per = X.term_counts(docs.select("id", X.tokens(X.ascii_only(F.col("text")), X.TERMS).alias("tokens")))
    df = per.groupBy("token").agg(F.count("*").alias("df"), F.sum("n").alias("tf")).where((F.col("df") >= min_df) & (F.col("df") <= max_df * n))
    kept = df.orderBy(F.desc("tf"), "token").limit(max_features)
    return kept.select("token", "df", (F.log((1 + F.lit(n)) / (1 + F.col("df"))) + 1).alias("idf"))


def vocabulary(tokens: DataFrame, max_size: int = 30_000, min_count: int = 2) -> DataFrame:
    """(token, n, token_id): 0 is padding, 1 unknown, the max_size - 2 most frequent tokens follow; ties by token."""
    counts = tokens.groupBy("token").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)
    top = counts.orderBy(F.desc("n"), "token").limit(max_size - 2)
    return top.withColumn("token_id", F.row_number().over(Window.orderBy(F.desc("n"), "token")) + 1)  # at most max_size rows


def encode(tokens: DataFrame, vocab: DataFrame, max_len: int = 400) -> DataFrame:
    """(id, pos, token_id) of the first max_len tokens of each document from (id, pos, token), unknown tokens as 1."""
    small = F.broadcast(vocab.select("token", "token_id"))  # bounded by the vocabulary's size
    return tokens.where(F.col("pos") < max_len).join(small, "token", "left").select("id", "pos", F.coalesce("token_id", F.lit(1)).alias("token_id"))


def padded(encoded: DataFrame, length: int) -> DataFrame:
    """(id, n, ids): token numbers of each document as one array, cut or padded with 0 to `length`."""
    rows = encoded.where(F.col("pos") < length).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", "token_id"))).alias("xs"))
    ids = F.col("xs.token_id")
    return rows.select("id", F.size(ids).alias("n"), F.concat(ids, F.array_repeat(F.lit(0), F.lit(length) - F.size(ids))).alias("ids"))


#: Prime modulus of the stand-in vectors, and the multiplier of each of their dimensions.
PRIME = (1 << 31) - 1
#: Bytes of a table of word vectors up to which it is broadcast.
BROADCAST_BYTES = 32 << 20


def multiplier(i: int) -> int:
    return 1 + (i * 48271 + 11) * 69621 % (PRIME - 1)


def pseudo_vector(token: Column, dim: int) -> Column:
    """A vector in [-1, 1) per token, for words without a trained one: one hash, and a multiplication modulo a prime for each dimension."""
    return X.let(hash60(100, token) % PRIME, lambda h: F.array(*[2 * (h * multiplier(i) % PRIME / F.lit(float(PRIME))) - 1 for i in range(dim)]))


def with_vectors(rows: DataFrame, vectors: DataFrame, dim: int) -> DataFrame:
    """`rows` (token, ...) with the word's vector (word, vec), or with its stand-in where it has none; `trained` tells which.

    The table of vectors is broadcast while its size allows it, else joined by shuffle.
    """
    side = vectors.select(F.col("word").alias("token"), F.transform("vec", lambda x: x.cast("double")).alias("_vec"))
    small = vectors.count() * (8 * dim + 64) <= BROADCAST_BYTES
    joined = rows.join(F.broadcast(side) if small else side, "token", "left")
    return joined.withColumn("trained", F.col("_vec").isNotNull()).withColumn("vec", F.coalesce("_vec", pseudo_vector(F.col("token"), dim))).drop("_vec")


def encode_spans(rows: DataFrame, encoder: Callable[[DataFrame], DataFrame], dim: int) -> DataFrame:
    """(id, dim, value): mean vector of the sentences of each document, from (id, sentences).

    All sentences of all documents go to the encoder in one flat table of
    different ones (sentence) and come back as (sentence, vec); each document is
    the mean over its own span. Documents without sentences give zeros.
    """
    flat = rows.select("id", F.posexplode_outer("sentences").alias("pos", "sentence"))
    encoded = encoder(flat.select("sentence").where("sentence is not null").distinct())
    means = flat.join(encoded, "sentence", "left").groupBy("id").agg(*[F.coalesce(F.avg(F.col("vec")[i].cast("double")), F.lit(0.0)).alias(f"m{i}") for i in range(dim)])
    return means.select("id", F.posexplode(F.array(*[f"m{i}" for i in range(dim)])).alias("dim", "value"))


def weighted_vectors(weighted: DataFrame, dim: int) -> DataFrame:
    """(id, dim, value): sum of weight * vector over the sum of weights, from (id, weight, vec); documents whose weights sum to 0 give zeros."""
    total = F.sum("weight")
    sums = weighted.groupBy("id").agg(total.alias("w"), *[F.sum(F.col("weight") * F.col("vec")[i]).alias(f"s{i}") for i in range(dim)])
    values = F.array(*[F.when(F.col("w") != 0, F.col(f"s{i}") / F.col("w")).otherwise(0.0) for i in range(dim)])
    return sums.select("id", F.posexplode(values).alias("dim", "value"))
