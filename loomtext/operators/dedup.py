"""Minwise signatures, banded candidates and duplicate clusters."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import scratch
from ..functions import text as X
from ..functions.hashing import hash32
from .components import connected_components

PRIME = (1 << 31) - 1


def permutation(i: int) -> tuple[int, int]:
    """Multiplier and offset of the i-th permutation of the residues of PRIME."""
    return 1 + (i * 48271 + 11) * 69621 % (PRIME - 1), (i * 16807 + 7) * 39373 % PRIME


def signed_texts(docs: DataFrame, k: int = 5, permutations: int = 128) -> tuple[DataFrame, DataFrame]:
    """(sigs, members): (id, sig) of one document per different token sequence, and (id, rep) of every document that has any.

    Texts are signed and digested in the row and written once; only digests,
    ids and signatures are shuffled, never texts.
    """
    words = docs.select("id", X.tokens(F.col("text"), X.ALNUM).alias("w")).where(F.size("w") > 0)
    rows = words.select("id", F.md5(F.concat_ws(" ", "w")).alias("digest"), X.shingles(F.col("w"), k).alias("sh"))
    signed = scratch.keep(signatures(rows, permutations, ("digest",)), "signed")
    reps = signed.groupBy("digest").agg(F.min("id").alias("rep"))
    members = scratch.keep(signed.select("id", "digest").join(reps, "digest").select("id", "rep"), "members")
    return signed.join(members.where("id = rep").select("id"), "id", "left_semi").select("id", "sig"), members


def signatures(shingled: DataFrame, permutations: int = 128, carry: tuple[str, ...] = ()) -> DataFrame:
    """(id, carried strings, sig): per permutation the least hash over the shingles of a document. Hashes are made in the JVM, permutations as matrices on Arrow batches; nothing is shuffled."""
    pairs = np.array([permutation(i) for i in range(permutations)], np.int64)
    a, b = pairs[:, :1], pairs[:, 1:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("h")
            flat, ends = lists.flatten().to_numpy(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
            out = np.empty((batch.num_rows, permutations), np.int64)
            for i in range(batch.num_rows):
                h = flat[ends[i] : ends[i + 1]]
                out[i] = ((h * a + b) % PRIME).min(axis=1)
            sig = pa.ListArray.from_arrays(pa.array(np.arange(0, out.size + 1, permutations, dtype=np.int32)), pa.array(out.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("id"), *(batch.column(c) for c in carry), sig], ["id", *carry, "sig"])

    hashed = shingled.where(F.size("sh") > 0).select("id", *carry, F.transform("sh", lambda s: hash32(s) % PRIME).alias("h"))
    return hashed.mapInArrow(run, ", ".join(["id bigint", *(f"{c} string" for c in carry), "sig array<bigint>"]))


def share_equal(a: Column, b: Column, permutations: int) -> Column:
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda e: e)) / F.lit(permutations)


def band_pairs(sigs: DataFrame, bands: int = 16, rows: int = 8, dense: int = 64) -> DataFrame:
    """(a, b): pairs that agree in all rows of a band. Buckets over `dense` members keep every pair too, made by a salted join instead of inside one row."""
    keys = sigs.select("id", F.posexplode(F.array(*[F.xxhash64(F.slice("sig", i * rows + 1, rows)) for i in range(bands)])).alias("band", "h"))
    counts = keys.groupBy("band", "h").agg(F.count("*").alias("n")).where("n > 1")
    met = keys.join(counts, ["band", "h"])
    lists = met.where(F.col("n") <= dense).groupBy("band", "h").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    small = lists.select("ids", F.posexplode("ids").alias("at", "a")).select("a", F.explode(F.expr("slice(ids, at + 2, size(ids))")).alias("b"))
    large = met.where(F.col("n") > dense)
    left = large.select("band", "h", F.col("id").alias("a"), F.pmod("id", F.lit(16)).alias("salt"))
    right = large.select("band", "h", F.col("id").alias("b"), F.explode(F.sequence(F.lit(0), F.lit(15))).alias("salt"))
    pairs = left.join(right.withColumn("salt", F.col("salt").cast("bigint")), ["band", "h", "salt"]).where("a < b").select("a", "b")
    return small.union(pairs).distinct()


def duplicate_pairs(docs: DataFrame, threshold: float = 0.85, k: int = 5, permutations: int = 128, bands: int = 16, rows: int = 8) -> tuple[DataFrame, DataFrame]:
    """(pairs, members): pairs (a, b, estimate) of different texts whose signatures agree in at least `threshold`, and the members of each text.

    Equal texts are one class before anything is signed. Texts without tokens
    are left out. Two signatures at the threshold meet in some band with a
    probability of 0.99 at 16 bands of 8.
    """
    sigs, members = signed_texts(docs, k, permutations)
    sigs = scratch.keep(sigs, "signatures")
    one, two = sigs.select(F.col("id").alias("a"), F.col("sig").alias("sa")), sigs.select(F.col("id").alias("b"), F.col("sig").alias("sb"))
    est = band_pairs(sigs, bands, rows).join(one, "a").join(two, "b").select("a", "b", share_equal(F.col("sa"), F.col("sb"), permutations).alias("estimate"))
    return est.where(F.col("estimate") >= threshold), members


def duplicate_clusters(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """(id, cluster): documents that hang together by pairs or by equal text, clusters of two or more; cluster is its least id."""
    comps = connected_components(pairs.select("a", "b"))
    of = members.join(comps, members["rep"] == comps["node"], "left").select("id", F.coalesce("component", "rep").alias("cluster"))
    sizes = of.groupBy("cluster").agg(F.count("*").alias("n")).where("n > 1")
    return of.join(sizes, "cluster").select("id", "cluster")
