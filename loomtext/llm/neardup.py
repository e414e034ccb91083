"""Problem 1: groups of texts that differ by small edits.

Multi-index Hamming join. Every text gets a signature of 48 b-bit minwise
symbols, in which two texts of similarity J differ at a share 1 - J of the
positions. The signature is split into 12 chunks of 4 symbols; each chunk is
indexed with every single symbol left out, so each pair of signatures that
differs in at most 23 of the 48 symbols is certain to meet under some key, and
a pair at J = 0.6 (19 differing symbols on average, in no particular place)
is missed with probability below 0.0005. Pairs that meet are verified on the
exact shingle sets; links are joined to groups.

Rows whose words are the same are one class and are signed once. A key shared
by more than `dense` classes is not expanded into pairs: all its members are
verified against the least one, which joins what is alike. Members that then
still lie in different components are compared through the prefixes of their
shingle sets (llm/prefix), which is exact, and in which texts that share only
boilerplate do not meet. So the groups depend neither on `dense` nor on how
many texts share a key.

Links are counted by an operator of its own: both ends of a link lie in one
component, so all pairs of a component's members are compared, in blocks of
bounded size, and only the counts leave a block.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import scratch
from ..operators.components import connected_components
from . import shingles as S
from .prefix import prefix_pairs

SYMBOLS, CHUNK, SEED = 48, 4, 11
#: Members and shingles of a block of counted links, columns and expanded pairs held at once.
BLOCK_ROWS, BLOCK_SHINGLES, BLOCK_COLUMNS, BLOCK_PAIRS = 2048, 1 << 21, 2048, 1 << 21


def classes_of(signed: DataFrame) -> DataFrame:
    """(id, rep): rep is the least id with the same words. Aggregated first, so a text that fills a third of all rows is no hot key when joined back."""
    reps = signed.groupBy("digest").agg(F.min("id").alias("rep"), F.count("*").alias("n"))
    many = signed.select("id", "digest").join(reps.where("n > 1").select("digest", "rep"), "digest", "left")
    return many.select("id", F.coalesce("rep", "id").alias("rep")).distinct()


def jaccard_links(pairs: DataFrame, texts: DataFrame, id_col: str, text_col: str, k: int, threshold: float) -> DataFrame:
    """(a, b, similarity) of the candidate pairs whose exact shingle similarity reaches the threshold. Only texts in a pair are shingled again."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias(id_col)).distinct()
    chosen = texts.select(id_col, text_col).join(ids, id_col, "left_semi")
    sets = scratch.keep(chosen.mapInArrow(S.shingler(id_col, text_col, k), "id bigint, sh array<bigint>"), "shingles")
    one, two = sets.select(F.col("id").alias("a"), F.col("sh").alias("sh_a")), sets.select(F.col("id").alias("b"), F.col("sh").alias("sh_b"))
    both = pairs.select("a", "b").join(one, "a").join(two, "b")
    shared = F.size(F.array_intersect("sh_a", "sh_b"))
    both = both.select("a", "b", shared.alias("s"), (F.size("sh_a") + F.size("sh_b") - shared).alias("u"))
    return both.where((F.col("s") > 0) & (F.col("s") >= F.col("u") * threshold)).select("a", "b", (F.col("s") / F.col("u")).alias("similarity"))


def _bucket_pairs(members: DataFrame, dense: int) -> tuple[DataFrame, DataFrame]:
    """Candidate pairs of the buckets of at most `dense` members, and the stars of larger ones."""
    counts = members.groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias("pivot")).where("n > 1")
    shared = scratch.keep(members.join(counts, "key"), "shared")
    small = shared.where(F.col("n") <= dense).groupBy("key").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    each = small.select("ids", F.posexplode("ids").alias("at", "a"))
    pairs = each.select("a", F.explode(F.expr("slice(ids, at + 2, size(ids))")).alias("b"))
    stars = shared.where((F.col("n") > dense) & (F.col("id") != F.col("pivot"))).select("key", F.col("pivot").alias("a"), F.col("id").alias("b"))
    return pairs, stars


def across_candidates(stars: DataFrame, comps: DataFrame, done: DataFrame, docs: DataFrame, k: int, threshold: float) -> DataFrame:
    """(a, b): candidates among the members of large buckets that still lie in different components.

    A bucket whose members all lie in the component of its least one is done
    with. The members of the others are compared by prefixes, whichever bucket
    they come from, so no link that joins components is left out.
    """
    members = stars.select("key", F.col("a").alias("pivot"), F.col("b").alias("id")).union(stars.select("key", F.col("a").alias("pivot"), F.col("a").alias("id")).distinct())
    c = comps.select(F.col("node").alias("id"), "component")
    members = members.join(c, "id", "left").withColumn("c", F.coalesce("component", "id")).drop("component")
    p = comps.select(F.col("node").alias("pivot"), F.col("component").alias("pc"))
    members = scratch.keep(members.join(p, "pivot", "left").select("key", "id", "c", F.coalesce("pc", "pivot").alias("pc")), "members")
    mixed = members.groupBy("key").agg(F.max(F.col("c") != F.col("pc")).alias("mixed")).where("mixed").select("key")
    chosen = members.join(mixed, "key", "left_semi").select("id", "c").distinct()
    sets = docs.join(chosen.select("id"), "id", "left_semi").mapInArrow(S.shingler("id", "text", k), "id bigint, sh array<bigint>")
    sets = scratch.keep(sets.join(chosen, "id"), "open")
    pairs = prefix_pairs(sets, threshold, {"c": "bigint"}, F.min("c") != F.max("c"), lambda x, y: F.col(x + "c") != F.col(y + "c"))
    return pairs.join(done, ["a", "b"], "left_anti")


def _shared(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Number of shared values of each set of `a` and each of `b`.

    Values that many sets have are columns of a matrix product, the others are
    expanded to the pairs of sets that have them.
    """
    va, vb = np.concatenate(a), np.concatenate(b)
    ra, rb = np.repeat(np.arange(len(a)), [len(x) for x in a]), np.repeat(np.arange(len(b)), [len(x) for x in b])
    both = np.intersect1d(va, vb)
    total = np.zeros((len(a), len(b)), np.float32)
    if not len(both):
        return total.astype(np.int64)

    def placed(v: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(both, v), len(both) - 1)
        ok = both[at] == v
        order = np.argsort(at[ok], kind="stable")
        c, r = at[ok][order], r[ok][order]
        return c, r, np.searchsorted(c, np.arange(len(both) + 1))

    (ca, ra, sa), (cb, rb, sb) = placed(va, ra), placed(vb, rb)
    work = np.diff(sa) * np.diff(sb)
    wide = work * 64 > len(a) * len(b)
    number = np.cumsum(wide) - 1
    for lo in range(0, int(wide.sum()), BLOCK_COLUMNS):
        mats = []
        for c, r, n in ((ca, ra, len(a)), (cb, rb, len(b))):
            pick = wide[c] & (number[c] >= lo) & (number[c] < lo + BLOCK_COLUMNS)
            m = np.zeros((n, min(BLOCK_COLUMNS, int(wide.sum()) - lo)), np.float32)
            m[r[pick], number[c[pick]] - lo] = 1
            mats.append(m)
        total += mats[0] @ mats[1].T
    total = total.astype(np.int64).ravel()
    keep = ~wide[ca]
    left, start, n = ra[keep], sb[ca[keep]], (sb[1:] - sb[:-1])[ca[keep]]
    ends = np.cumsum(n)
    lo = 0
    while lo < len(n):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + BLOCK_PAIRS, "right")))
        part = n[lo:hi]
        at = np.arange(int(part.sum())) - np.repeat(np.cumsum(part) - part, part) + np.repeat(start[lo:hi], part)
        total += np.bincount(np.repeat(left[lo:hi], part) * len(b) + rb[at], minlength=len(total))
        lo = hi
    return total.reshape(len(a), len(b))


def _block_counts(threshold: float):
    """applyInArrow function from the members of two blocks of a component to (id, n): links between the blocks, or within the one."""

    def run(t: pa.Table) -> pa.Table:
        ids, of, sets = t["id"].to_numpy(), t["block"].to_numpy(), [x.values.to_numpy().view(np.uint64) for x in t["sh"]]
        x, y = t["x"][0].as_py(), t["y"][0].as_py()
        one, two = np.flatnonzero(of == x), np.flatnonzero(of == y)
        if not len(one) or not len(two):
            return pa.table({"id": pa.array([], pa.int64()), "n": pa.array([], pa.int64())})
        shared = _shared([sets[i] for i in one], [sets[i] for i in two])
        sizes = np.array([len(s) for s in sets])
        either = sizes[one][:, None] + sizes[two][None, :] - shared
        linked = (shared > 0) & (shared >= either * threshold) & (ids[one][:, None] != ids[two][None, :])
        n, m = linked.sum(axis=1), linked.sum(axis=0)
        if x == y:
            return pa.table({"id": ids[one], "n": n.astype(np.int64)})
        return pa.table({"id": np.concatenate([ids[one], ids[two]]), "n": np.concatenate([n, m]).astype(np.int64)})

    return run


def link_counts(groups: DataFrame, docs: DataFrame, id_col: str, text_col: str, k: int = 5, threshold: float = 0.8) -> DataFrame:
    """`groups` with n_links: the number of links of the row's class to other classes. All pairs of the classes of one group are compared, in blocks, so the work grows with the square of a group."""
    reps = groups.select("rep", "group_no").distinct()
    sizes = reps.groupBy("group_no").agg(F.count("*").alias("n")).where("n > 1").select("group_no")
    reps = reps.join(sizes, "group_no").select(F.col("rep").alias("id"), "group_no")
    docs = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text")).where("id is not null")
    sets = docs.join(reps.select("id").distinct(), "id", "left_semi").mapInArrow(S.shingler("id", "text", k), "id bigint, sh array<bigint>").join(reps, "id")
    sets = scratch.keep(sets.withColumn("salt", F.xxhash64("id", "sh")).dropDuplicates(["id", "group_no", "salt"]), "grouped")
    blocks = F.greatest(F.ceil(F.count("*") / BLOCK_ROWS), F.ceil(F.sum(F.size("sh")) / BLOCK_SHINGLES)).cast("int").alias("blocks")
    placed = sets.join(sets.groupBy("group_no").agg(blocks), "group_no").withColumn("block", F.pmod("salt", "blocks").cast("int")).drop("salt")
    other = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pairs = other.select("group_no", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "id", "block", "sh")
    counts = pairs.groupBy("group_no", "x", "y").applyInArrow(_block_counts(threshold), "id bigint, n bigint")
    per = counts.groupBy(F.col("id").alias("rep")).agg(F.sum("n").alias("n_links"))
    return groups.join(per, "rep", "left").select("id", "rep", "group_no", F.coalesce("n_links", F.lit(0)).alias("n_links"))


def near_duplicate_groups(docs: DataFrame, id_col: str, text_col: str, k: int = 5, threshold: float = 0.8, min_words: int = 5, dense: int = 32) -> DataFrame:
    """One row per document with enough words: (id, rep, group_no).

    rep is the least id with the same words, group_no the least id of all
    documents that hang together by links of at least `threshold`. Similarity
    is shared distinct runs of k words over all distinct runs of either text.

    Null, empty and short texts (fewer than min_words words) are in no group and
    give no row, nor does a null id. Equal texts fall in one class; a row that
    is repeated with its id counts once, and an id with several texts is in the
    group of each of them. Other columns are ignored, whatever their names. An empty
    table gives an empty result. Thresholds under 0.5 would need more chunks.
    `dense` changes the way, not the rows.
    """
    docs = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text")).where("id is not null")
    sign = S.signer("id", "text", k, min_words, SYMBOLS, S.neighbour_blocks(SYMBOLS, CHUNK), SEED)
    signed = scratch.keep(scratch.spread(docs).mapInArrow(sign, "id bigint, digest binary, keys array<bigint>"), "signed")
    classes = scratch.keep(classes_of(signed), "classes")
    once = signed.groupBy("digest").agg(F.min("id").alias("id"), F.first("keys").alias("keys"))
    members = once.select("id", F.explode("keys").alias("key"))
    pairs, stars = _bucket_pairs(members, dense)
    first = scratch.keep(pairs.union(stars.select("a", "b")).where("a <> b").distinct(), "pairs")
    links = scratch.keep(jaccard_links(first, docs, "id", "text", k, threshold), "links")
    comps = connected_components(links)
    if not stars.isEmpty():
        rest = scratch.keep(across_candidates(stars, scratch.keep(comps, "comps"), first, docs, k, threshold), "rest")
        comps = connected_components(links.union(jaccard_links(rest, docs, "id", "text", k, threshold)))
    out = classes.join(comps.withColumnRenamed("node", "rep"), "rep", "left")
    return out.select("id", "rep", F.coalesce("component", "rep").alias("group_no"))


def group_pairs(groups: DataFrame) -> DataFrame:
    """(a, b): every pair of rows of one group, a < b. Grows with the square of a group; use the groups where copies abound."""
    sizes = groups.groupBy("group_no").agg(F.count("*").alias("n")).where("n > 1")
    g = groups.join(sizes, "group_no").select("group_no", "id")
    return g.select("group_no", F.col("id").alias("a")).join(g.select("group_no", F.col("id").alias("b")), "group_no").where("a < b").select("a", "b")
