"""Problem 4: evaluation rows that repeat training rows.

Texts get a similarity-hash fingerprint of 1 024 bits, 64 minwise symbols of
16 bits: two texts of similarity J differ in about (1 - J) / 2 of the bits.
The fingerprint is cut into segments of 48 bits under two fixed permutations,
42 code blocks; blocks are joined across the splits only, pairs outside the
Hamming radius are dropped on the fingerprints alone, the rest is verified on
the exact shingle sets. At J = 0.6 a pair shares no block with probability
below 0.0004 (0.00001 at 0.7), and lies outside the radius with probability
below 0.0001.

A block with more than `dense` classes on both sides is not expanded: all
members of such blocks are joined by the prefixes of their shingle sets
instead (llm/prefix), which is exact, so a template that many rows share does
not make pairs of them.

Rows with equal words are one class; classes are compared, and a class link
is expanded to rows at the end or counted without expansion in the report.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import scratch
from . import shingles as S
from .neardup import jaccard_links
from .prefix import prefix_pairs

SYMBOLS, SEGMENT, ROUNDS, SEED, RADIUS = 64, 3, 2, 23, 352


def normal_id(c: Column) -> Column:
    """Trimmed, without .0 at the end and zeros in front; null where nothing is left."""
    t = F.regexp_replace(F.regexp_replace(F.trim(F.regexp_replace(c, r"[\t\r\n]", " ")), r"\.0$", ""), r"^0+(?=.)", "")
    return F.when(t != "", t)


def words(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit("([a-z0-9]+)"))


def within_radius(pairs: DataFrame, codes: DataFrame) -> DataFrame:
    """The pairs (a, b) whose fingerprints (rep, code) differ in at most RADIUS bits."""
    one, two = codes.select(F.col("rep").alias("a"), F.col("code").alias("x")), codes.select(F.col("rep").alias("b"), F.col("code").alias("y"))
    away = F.aggregate(F.zip_with("x", "y", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, n: s + n)
    return pairs.join(one, "a").join(two, "b").where(away <= RADIUS).select("a", "b")


def candidates(sides: DataFrame, docs: DataFrame, k: int, threshold: float, dense: int) -> DataFrame:
    """(a, b): classes of (rep, has_train, has_eval, keys) that meet across the splits, in small blocks as they stand, in large ones by prefixes."""
    blocks = sides.select("rep", "has_train", "has_eval", F.explode("keys").alias("key"))
    met = blocks.groupBy("key").agg(F.count(F.when(F.col("has_train"), 1)).alias("t"), F.count(F.when(F.col("has_eval"), 1)).alias("e"), F.count("*").alias("n")).where("t > 0 and e > 0 and n > 1")
    blocks = scratch.keep(blocks.join(met.select("key", (F.least("t", "e") > dense).alias("large")), "key"), "blocks")
    left = blocks.where("has_train and not large").select("key", F.col("rep").alias("x"))
    right = blocks.where("has_eval and not large").select("key", F.col("rep").alias("y"))
    pairs = left.join(right, "key").where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    crowd = blocks.where("large").select("rep", "has_train", "has_eval").distinct()
    if crowd.isEmpty():
        return pairs
    crowd = scratch.keep(crowd.withColumnRenamed("rep", "id"), "crowd")
    sets = docs.join(crowd.select("id"), "id", "left_semi").mapInArrow(S.shingler("id", "text", k), "id bigint, sh array<bigint>")
    sets = scratch.keep(sets.join(crowd, "id"), "open")
    across = lambda x, y: (F.col(x + "has_train") & F.col(y + "has_eval")) | (F.col(x + "has_eval") & F.col(y + "has_train"))
    return pairs.union(prefix_pairs(sets, threshold, {"has_train": "boolean", "has_eval": "boolean"}, F.max("has_train") & F.max("has_eval"), across)).distinct()


def class_links(docs: DataFrame, k: int, threshold: float, min_words: int, dense: int = 64) -> tuple[DataFrame, DataFrame]:
    """(classes, links): classes (id, rep, train, split, outlet); links (a, b) across the splits, a = b where a class lies on both sides. `dense` changes the way, not the rows."""
    sign = S.signer("id", "text", k, min_words, SYMBOLS, S.permuted_blocks(SYMBOLS, SEGMENT, ROUNDS, SEED), SEED, ("train", "split", "outlet"), code=True)
    schema = "id bigint, train boolean, split string, outlet string, digest binary, keys array<bigint>, code array<bigint>"
    signed = scratch.keep(scratch.spread(docs.select("id", "text", "train", "split", "outlet")).mapInArrow(sign, schema), "coded")
    sides = scratch.keep(signed.groupBy("digest").agg(F.min("id").alias("rep"), F.max(F.col("train")).alias("has_train"), F.max(~F.col("train")).alias("has_eval"), F.first("keys").alias("keys"), F.first("code").alias("code")), "sides")
    classes = scratch.keep(signed.select("id", "train", "split", "outlet", "digest").join(sides.select("digest", "rep"), "digest").drop("digest"), "classes")
    pairs = scratch.keep(within_radius(candidates(sides, docs, k, threshold, dense), sides.select("rep", "code")), "pairs")
    links = jaccard_links(pairs, docs, "id", "text", k, threshold).select("a", "b")
    same = sides.where("has_train and has_eval").select(F.col("rep").alias("a"), F.col("rep").alias("b"))
    return classes, scratch.keep(links.union(same), "links")


def prepared(articles: DataFrame) -> DataFrame:
    """Rows with the columns the overlap needs; rows of neither side are dropped."""
    a = articles.select(F.col("article_no").cast("bigint").alias("id"), "text", "title", F.col("id").alias("own_id"), "dataset", "split", F.lower(F.trim("outlet")).alias("outlet"))
    return a.where(F.col("split").isin("train", "val", "test", "heldout") & F.col("id").isNotNull()).withColumn("train", F.col("split") == "train")


def titles(a: DataFrame, min_words: int, title_words: int) -> DataFrame:
    """(id, train, short, key) of rows with a title of title_words words or more."""
    few = ~F.coalesce(F.lower("text").rlike(rf"^(?:[^a-z0-9]*+[a-z0-9]++){{{min_words}}}"), F.lit(False))  # stops at the last word that matters
    titled = a.select("id", "train", words(F.col("title")).alias("w"), few.alias("short")).where(F.size("w") >= title_words)
    return titled.select("id", "train", "short", F.concat_ws(" ", "w").alias("key"))


def overlaps(articles: DataFrame, k: int = 5, threshold: float = 0.8, min_words: int = 30, title_words: int = 5, dense: int = 64) -> DataFrame:
    """(t, e, reason): every pair of a training row and an evaluation row that repeat each other.

    reason is `text` (similarity of at least `threshold`, both texts of
    min_words words or more), `id` (same dataset and the same id) or `title`
    (a text of fewer words, and titles of the same title_words words or more
    in the same order); a pair comes once per reason. Null and empty texts
    have no words, null or blank ids and titles match nothing, rows of other
    splits and rows without article_no are ignored. Repeated rows each count. An empty table gives no pair.
    """
    a = prepared(articles)
    classes, links = class_links(a, k, threshold, min_words, dense)
    both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    t = classes.where("train").select(F.col("rep").alias("a"), F.col("id").alias("t"))
    e = classes.where("not train").select(F.col("rep").alias("b"), F.col("id").alias("e"))
    by_text = both.join(t, "a").join(e, "b").select("t", "e", F.lit("text").alias("reason"))
    ids = a.select("id", "train", "dataset", normal_id(F.col("own_id")).alias("own")).where("own is not null and dataset is not null")
    by_id = ids.where("train").select(F.col("id").alias("t"), "dataset", "own").join(ids.where("not train").select(F.col("id").alias("e"), "dataset", "own"), ["dataset", "own"]).select("t", "e", F.lit("id").alias("reason"))
    titled = titles(a, min_words, title_words)
    by_title = titled.where("train").select(F.col("id").alias("t"), F.col("short").alias("s"), "key").join(titled.where("not train").select(F.col("id").alias("e"), "short", "key"), "key").where("s or short").select("t", "e", F.lit("title").alias("reason"))
    return by_text.union(by_id).union(by_title)


def overlap_counts(articles: DataFrame, k: int = 5, threshold: float = 0.8, min_words: int = 30, title_words: int = 5) -> DataFrame:
    """(e, reason, pairs): in how many pairs of `overlaps` each evaluation row is, for rows in any.

    Training rows are counted per class, id and title before they meet the
    evaluation rows, so no pair of copies is ever written out.
    """
    a = prepared(articles)
    classes, links = class_links(a, k, threshold, min_words)
    both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    per_class = classes.where("train").groupBy(F.col("rep").alias("a")).agg(F.count("*").alias("n"))
    per_link = both.join(per_class, "a").groupBy(F.col("b").alias("rep")).agg(F.sum("n").alias("pairs"))
    by_text = classes.where("not train").join(per_link, "rep").select(F.col("id").alias("e"), F.lit("text").alias("reason"), "pairs")
    ids = a.select("id", "train", "dataset", normal_id(F.col("own_id")).alias("own")).where("own is not null and dataset is not null")
    per_id = ids.where("train").groupBy("dataset", "own").agg(F.count("*").alias("pairs"))
    by_id = ids.where("not train").join(per_id, ["dataset", "own"]).select(F.col("id").alias("e"), F.lit("id").alias("reason"), "pairs")
    titled = titles(a, min_words, title_words)
    per_title = titled.where("train").groupBy("key").agg(F.count("*").alias("n_all"), F.count(F.when(F.col("short"), 1)).alias("n_short"))
    by_title = titled.where("not train").join(per_title, "key").select(F.col("id").alias("e"), F.lit("title").alias("reason"), F.when(F.col("short"), F.col("n_all")).otherwise(F.col("n_short")).alias("pairs"))
    return by_text.union(by_id).union(by_title).where("pairs > 0")


def overlap_report(articles: DataFrame, threshold: float = 0.8, min_words: int = 30) -> DataFrame:
    """(reason, split, outlet, n_rows, n_hit, n_pairs): per evaluation split and outlet how many rows there are, how many repeat a training row, and in how many pairs."""
    a = prepared(articles).where("not train").select(F.col("id").alias("e"), "split", "outlet")
    hits = overlap_counts(articles, 5, threshold, min_words)
    per = hits.join(a, "e").groupBy("reason", "split", "outlet").agg(F.count("*").alias("n_hit"), F.sum("pairs").alias("n_pairs"))
    rows = a.groupBy("split", "outlet").agg(F.count("*").alias("n_rows"))
    joined = per.alias("p").join(rows.alias("r"), (F.col("p.split") == F.col("r.split")) & F.col("p.outlet").eqNullSafe(F.col("r.outlet")))
    return joined.select("p.reason", "p.split", "p.outlet", "n_rows", "n_hit", "n_pairs")
