"""Duplicates, tf-idf, vocabularies and keywords over the articles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import scratch
from ..functions import text as X
from ..functions.hashing import hash60
from ..operators import dedup, textrank, tfidf
from .corpus_queries import _SENT
from .tables import DOCS, docs, read

PERMS, BANDS, ROWS, LIMIT = 128, 16, 8, 0.85
DIM = 64
#: Tokens of a padded sequence.
LENGTH = 256


def minhash_signatures(spark: SparkSession, d: str) -> DataFrame:
    sigs, _ = dedup.signed_texts(docs(spark, d), permutations=PERMS)
    return sigs.select("id", F.posexplode("sig").alias("perm", "value"))


def lsh_pairs(spark: SparkSession, d: str) -> DataFrame:
    return dedup.duplicate_pairs(docs(spark, d), LIMIT)[0].select("a", "b", F.round("estimate", 6).alias("estimate"))


def dup_clusters(spark: SparkSession, d: str) -> DataFrame:
    return dedup.duplicate_clusters(*dedup.duplicate_pairs(docs(spark, d), LIMIT))


def dup_report(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of different texts, documents and clusters, and the share of documents in a cluster."""
    pairs, members = dedup.duplicate_pairs(docs(spark, d), LIMIT)
    clusters = dedup.duplicate_clusters(pairs, members)
    one = lambda df: df.withColumn("one", F.lit(1))
    counts = clusters.agg(F.count("*").alias("n_in_cluster"), F.countDistinct("cluster").alias("n_clusters"))
    out = one(pairs.agg(F.count("*").alias("n_pairs"))).join(one(counts), "one").join(one(docs(spark, d).agg(F.count("*").alias("n_docs"))), "one").drop("one")
    return out.withColumn("dup_ratio", F.round(F.col("n_in_cluster") / F.greatest("n_docs", F.lit(1)), 9))


def dup_sample(spark: SparkSession, d: str) -> DataFrame:
    """The ten most similar pairs."""
    return lsh_pairs(spark, d).orderBy(F.desc("estimate"), "a", "b").limit(10)


def exact_dup_groups(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).groupBy(F.md5("text").alias("digest")).agg(F.count("*").alias("n"), F.min("id").alias("first_id")).where("n > 1")


def idf_table(spark: SparkSession, d: str) -> DataFrame:
    """Fitted on the training part only."""
    return tfidf.idf(docs(spark, d).where("split = 'train'")).select("token", "df", F.round("idf", 6).alias("idf"))


def mean_idf(spark: SparkSession, d: str) -> DataFrame:
    return tfidf.idf(docs(spark, d).where("split = 'train'")).agg(F.count("*").alias("n_tokens"), F.round(F.avg("idf"), 6).alias("mean_idf"))


def _weighted(spark: SparkSession, d: str) -> DataFrame:
    table = scratch.keep(tfidf.idf(docs(spark, d).where("split = 'train'")).select("token", "idf"), "idf")
    mean = table.agg(F.avg("idf")).first()[0] or 1.0
    counted = X.term_counts(docs(spark, d).select("id", X.tokens(X.ascii_only(F.col("text")), X.DASHED).alias("tokens")))
    return counted.join(F.broadcast(table), "token", "left").select("id", "token", (F.col("n") * F.coalesce("idf", F.lit(mean))).alias("weight"))


def token_weights(spark: SparkSession, d: str) -> DataFrame:
    """Sum of the weights of each document's tokens, unknown ones at the mean."""
    return _weighted(spark, d).groupBy("id").agg(F.count("*").alias("n_tokens"), F.round(F.sum("weight"), 4).alias("weight"))


def doc_text_vectors(spark: SparkSession, d: str) -> DataFrame:
    """tf-idf weighted mean of the words' vectors; sentence means weighted by their sums give the same."""
    w = tfidf.with_vectors(_weighted(spark, d), _word_vectors(spark, d), DIM)
    return tfidf.weighted_vectors(w, DIM).select("id", "dim", F.round("value", 6).alias("value"))


def _word_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Trained vectors of the most frequent words: number n of the vocabulary has the n-th row of the table of vectors."""
    rows = read(spark, d, "embeddings").select((F.col("vec_id") + 2).alias("token_id"), F.col("embedding").alias("vec"))
    return vocab_ids(spark, d).join(rows, "token_id").select(F.col("token").alias("word"), "vec")


def vector_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Words of the vocabulary, those with a trained vector that is not zero, and their share."""
    rows = vocab_ids(spark, d).select("token").join(_word_vectors(spark, d).select(F.col("word").alias("token"), F.exists("vec", lambda x: x != 0).alias("useful")), "token", "left")
    counts = rows.agg(F.count("*").alias("n_words"), F.count(F.when(F.col("useful"), 1)).alias("n_trained"))
    return counts.withColumn("share", F.round(F.col("n_trained") / F.greatest("n_words", F.lit(1)), 9))


def sentence_means(spark: SparkSession, d: str) -> DataFrame:
    """Mean over each article's sentences of the vectors an encoder gives them; the encoder here looks a sentence up by its hash."""
    rows = docs(spark, d).select("id", F.filter(X.sentences(X.ascii_only(F.col("text"))), lambda s: s != "").alias("sentences"))
    vectors = read(spark, d, "embeddings").select(F.col("vec_id").alias("key"), F.col("embedding").alias("vec"))
    look_up = lambda flat: flat.withColumn("key", hash60(9, F.col("sentence")) % 500).join(vectors, "key").select("sentence", "vec")
    return tfidf.encode_spans(rows, look_up, DIM).withColumn("value", F.round("value", 5))


def _train_tokens(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).where("split = 'train'").select(F.explode(X.tokens(X.ascii_only(F.col("text")), X.DASHED)).alias("token"))


def vocab_ids(spark: SparkSession, d: str) -> DataFrame:
    return tfidf.vocabulary(_train_tokens(spark, d))


def encoded_sequences(spark: SparkSession, d: str) -> DataFrame:
    """The first 400 token numbers of every article; an empty one is a single unknown."""
    rows = docs(spark, d).select("id", F.posexplode_outer(F.slice(X.tokens(X.ascii_only(F.col("text")), X.DASHED), 1, 400)).alias("pos", "token"))
    rows = rows.withColumn("pos", F.coalesce("pos", F.lit(0)))
    return tfidf.encode(rows, vocab_ids(spark, d))


def padded_sequences(spark: SparkSession, d: str) -> DataFrame:
    """The first LENGTH token numbers of every article, padded with 0."""
    out = tfidf.padded(encoded_sequences(spark, d), LENGTH)
    return out.select("id", "n", F.array_join(F.transform("ids", lambda x: x.cast("string")), " ").alias("ids"))


def vocab_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Share of all tokens and of all different tokens that the vocabulary knows."""
    toks = docs(spark, d).select(F.explode(X.tokens(X.ascii_only(F.col("text")), X.DASHED)).alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    known = toks.join(F.broadcast(vocab_ids(spark, d).select("token", "token_id")), "token", "left")
    return known.agg(F.round(F.sum(F.when(F.col("token_id").isNotNull(), F.col("n"))) / F.sum("n"), 9).alias("of_tokens"), F.round(F.count("token_id") / F.count("*"), 9).alias("of_types"))


def cooccurrence_edges(spark: SparkSession, d: str) -> DataFrame:
    return textrank.cooccurrence(docs(spark, d))


def textrank_keywords(spark: SparkSession, d: str) -> DataFrame:
    return textrank.textrank(docs(spark, d)).select("id", "rank", "keyword", F.round("score", 6).alias("score"))


_SHINGLED = """
w as (select id, list_transform(regexp_extract_all(text, '[A-Za-z0-9]+'), lambda x: lower(x)) as w from docs),
c as (select id, min(id) over (partition by w) as rep, w from w where len(w) > 0),
s as (select id, unnest(case when len(w) < 5 then [array_to_string(w, ' ')] else list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) end) as s from c where id = rep),
h as (select id, cast('0x' || substr(md5(s), 1, 8) as bigint) % 2147483647 as h from s),
"""
_SIG = f"{_SHINGLED} sig as (select id, [{', '.join('min((h * %d + %d) %% 2147483647)' % dedup.permutation(i) for i in range(PERMS))}] as sig from h group by id)"
_PAIRS = f"""{_SIG}, band as (select id, sig, i as band, sig[i * {ROWS} + 1:i * {ROWS} + {ROWS}] as k from sig, range({BANDS}) r(i)),
p as (select distinct x.id as a, y.id as b, x.sig as sa, y.sig as sb from band x join band y on x.band = y.band and x.k = y.k and x.id < y.id),
pairs as (select a, b, est as estimate from (select a, b, len(list_filter(list_zip(sa, sb), lambda z: z[1] = z[2])) / {PERMS}.0 as est from p) where est >= {LIMIT})"""
_CLUSTERS = f"""{_PAIRS}, e as (select a as u, b as v from pairs union all select b, a from pairs union all select rep, id from c where id <> rep union all select id, rep from c where id <> rep),
r as (select u as node, u as root from e union select e.v, r.root from r join e on e.u = r.node), cl as (select node as id, min(root) as cluster from r group by node)"""
_IDF = r"""
t as (select id, unnest(list_transform(regexp_extract_all(regexp_replace(text, '[^\x00-\x7F]', ' ', 'g'), '\b[A-Za-z][A-Za-z\-'']+\b'), lambda x: lower(x))) as token from docs where split = 'train'),
n as (select count(*) as n from docs where split = 'train'),
dfs as (select token, count(distinct id) as df, count(*) as tf from t group by token),
idf as (select token, df, ln((1 + n) / (1 + df)) + 1 as idf from dfs, n where df >= 2 and df <= 0.95 * n order by tf desc, token limit 50000)
"""
_DASHED = r"x as (select id, generate_subscripts(w, 1) - 1 as pos, unnest(w) as token from (select id, list_transform(regexp_extract_all(regexp_replace(text, '[^\x00-\x7F]', ' ', 'g'), '[A-Za-z][A-Za-z\-'']+'), lambda x: lower(x)) as w from docs))"
_WEIGHTED = f"{DOCS}, {_IDF}, {_DASHED}, wt as (select id, x.token, count(*) * any_value(coalesce(idf, (select avg(idf) from idf))) as weight from x left join idf using (token) group by id, x.token)"
_VOCAB = "vocab as (select token, count(*) as n, row_number() over (order by count(*) desc, token) + 1 as token_id from x join docs using (id) where split = 'train' group by token having count(*) >= 2 order by n desc, token limit 29998)"
_MULTIPLIERS = [tfidf.multiplier(i) for i in range(DIM)]
_TOKEN_VECTORS = f"""hs as (select token, cast('0x' || substr(md5('100|' || token), 1, 15) as bigint) % {tfidf.PRIME} as h from (select distinct token from x)),
tv as (select token, i as dim, coalesce(embedding[i + 1]::double, 2 * (h * ({_MULTIPLIERS})[i + 1] % {tfidf.PRIME} / {tfidf.PRIME}.0::double) - 1) as v
  from hs left join vocab using (token) left join embeddings on vec_id = token_id - 2, range({DIM}) r(i))"""

QUERIES = {
    f.__name__: f
    for f in (
        minhash_signatures, lsh_pairs, dup_clusters, dup_report, dup_sample, exact_dup_groups, idf_table, mean_idf, token_weights, doc_text_vectors, vector_coverage, sentence_means,
        vocab_ids, encoded_sequences, padded_sequences, vocab_coverage, cooccurrence_edges, textrank_keywords,
    )
}

ORACLE = {
    "minhash_signatures": f"with {DOCS}, {_SIG} select id, i as perm, sig[i + 1] as value from sig, range({PERMS}) r(i)",
    "lsh_pairs": f"with {DOCS}, {_PAIRS} select a, b, round(estimate, 6) as estimate from pairs",
    "dup_clusters": f"with recursive {DOCS}, {_CLUSTERS} select id, cluster from cl",
    "dup_report": f"with recursive {DOCS}, {_CLUSTERS} select (select count(*) from pairs) as n_pairs, count(*) as n_in_cluster, count(distinct cluster) as n_clusters, (select count(*) from docs) as n_docs, round(count(*) / (select count(*) from docs), 9) as dup_ratio from cl",
    "dup_sample": f"with {DOCS}, {_PAIRS} select a, b, round(estimate, 6) as estimate from pairs order by estimate desc, a, b limit 10",
    "exact_dup_groups": f"with {DOCS} select md5(text) as digest, count(*) as n, min(id) as first_id from docs group by text having count(*) > 1",
    "idf_table": f"with {DOCS}, {_IDF} select token, df, round(idf, 6) as idf from idf",
    "mean_idf": f"with {DOCS}, {_IDF} select count(*) as n_tokens, round(avg(idf), 6) as mean_idf from idf",
    "token_weights": f"with {_WEIGHTED} select id, count(*) as n_tokens, round(sum(weight), 4) as weight from wt group by id",
    "doc_text_vectors": f"with {_WEIGHTED}, {_VOCAB}, {_TOKEN_VECTORS} select id, dim, round(sum(weight * v) / sum(weight), 6) as value from wt join tv using (token) group by id, dim",
    "vector_coverage": f"""with {DOCS}, {_DASHED}, {_VOCAB}, t as (select token, len(list_filter(embedding, lambda z: z <> 0)) > 0 as useful from vocab left join embeddings on vec_id = token_id - 2)
        select count(*) as n_words, count(*) filter (useful) as n_trained, round(count(*) filter (useful) / greatest(count(*), 1), 9) as share from t""",
    "sentence_means": f"""with {DOCS}, {_SENT}, f as (select id, unnest(s) as s from sent), e as (select id, embedding from f join embeddings on vec_id = cast('0x' || substr(md5('9|' || s), 1, 15) as bigint) % 500)
        select docs.id, i as dim, round(coalesce(avg(embedding[i + 1]::double), 0), 5) as value from docs cross join range({DIM}) r(i) left join e on e.id = docs.id group by docs.id, i""",
    "vocab_ids": f"with {DOCS}, {_DASHED}, {_VOCAB} select token, n, token_id from vocab",
    "encoded_sequences": f"with {DOCS}, {_DASHED}, {_VOCAB} select x.id, x.pos, coalesce(token_id, 1) as token_id from x left join vocab using (token) where x.pos < 400 union all select id, 0, 1 from docs where id not in (select id from x)",
    "padded_sequences": f"""with {DOCS}, {_DASHED}, {_VOCAB}, e as (select x.id, x.pos, coalesce(token_id, 1) as t from x left join vocab using (token) where x.pos < {LENGTH} union all select id, 0, 1 from docs where id not in (select id from x)),
        l as (select id, count(*) as n, list(t order by pos) as ts from e group by id) select id, n, array_to_string(ts || list_transform(range({LENGTH} - n), lambda i: 0), ' ') as ids from l""",
    "vocab_coverage": f"with {DOCS}, {_DASHED}, {_VOCAB}, u as (select token, count(*) as m from x group by token) select round(sum(m) filter (token_id is not null) / sum(m), 9) as of_tokens, round(count(token_id) / count(*), 9) as of_types from u left join vocab using (token)",
    "cooccurrence_edges": f"with {DOCS}, {_DASHED} select p.id, least(p.token, q.token) as a, greatest(p.token, q.token) as b, count(*) as weight from x p join x q on p.id = q.id and q.pos between p.pos + 1 and p.pos + 4 and p.token <> q.token group by all",
}
