"""Problem 3: has this key been seen before?

Keys are hashed to 64 bits. The high bits choose one of a power of two of
shards, the low bits, reduced to the shard's target range, are what a shard
remembers, as Golomb-coded sets (about 1.6 bits more than the logarithm of the
wanted rate). Each shard reads its rows in order of arrival, a batch at a
time, probes them, and adds what is new.

Rows of one Arrow batch are compared among themselves before the shuffle: all
but the earliest row of a key are surely repeats, so a key that fills a third
of all rows sends one row per batch to its shard. Rows already answered go to
shards of their own row number and only pass through.

The number of shards follows from the rows and the history together. A shard
is large against a batch, so a batch probes a part of a shard's blocks only;
p3_filter reports the share that was decoded.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import scratch
from ..operators.stitch import normal_qid
from .gcs import SeenFilter

#: Range of a shard's reduced hashes, 44 bits: with four million keys in a shard a new key is taken for an old one once in four million times.
UNIVERSE_BITS = 44
#: Rows and keys of the history that a shard is meant for: some 12 MB if all keys differ.
KEYS_A_SHARD = 1 << 22


def normal_mention(c: Column) -> Column:
    """Runs of blanks made one, ends cut, lower-cased; null where nothing is left."""
    t = F.lower(F.trim(F.regexp_replace(c, r"[ \t\r\n]+", " ")))
    return F.when(t != "", t)


def entity_key(qid: Column, mention: Column) -> Column:
    """Normalised qid, else normalised mention, apart by a mark in front; null with neither."""
    return F.coalesce(F.concat(F.lit("q:"), normal_qid(qid)), F.concat(F.lit("m:"), normal_mention(mention)))


def _local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Mark the rows whose key an earlier row of the same batch has."""
    for b in batches:
        no, h = b.column("no").to_numpy(), b.column("h").to_numpy()
        order = np.lexsort((no, h))
        again = np.zeros(len(h), bool)
        again[order[1:]] = h[order[1:]] == h[order[:-1]]
        yield pa.RecordBatch.from_arrays([b.column("no"), b.column("h"), b.column("history"), pa.array(again)], ["no", "h", "history", "seen"])


_ANSWER = "no bigint, history boolean, seen boolean, kept bigint, chance double, blocks bigint, decoded bigint"


def _answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by shard and arrival to rows with their answer; what a probe did to the filter is told at its first row."""
    shard, keeper = None, None
    mask = np.uint64((1 << UNIVERSE_BITS) - 1)
    for b in batches:
        seen = b.column("seen").to_numpy(zero_copy_only=False).copy()
        told = {"kept": np.zeros(len(seen), np.int64), "chance": np.zeros(len(seen)), "blocks": np.zeros(len(seen), np.int64), "decoded": np.zeros(len(seen), np.int64)}
        shards = b.column("shard").to_numpy()
        reduced = b.column("h").to_numpy().view(np.uint64) & mask
        cuts = [0, *(np.flatnonzero(np.diff(shards)) + 1).tolist(), len(shards)]
        for lo, hi in zip(cuts, cuts[1:]):
            if hi == lo:
                continue
            if keeper is None or shards[lo] != shard:
                shard, keeper = shards[lo], SeenFilter(UNIVERSE_BITS)
            ask = lo + np.flatnonzero(~seen[lo:hi])
            if not len(ask):
                continue
            before = (keeper.kept, keeper.expected, keeper.asked, keeper.decoded)
            seen[ask] = keeper.offer(reduced[ask])
            for name, was, now in zip(told, before, (keeper.kept, keeper.expected, keeper.asked, keeper.decoded)):
                told[name][ask[0]] = now - was
        keep = ~b.column("history").to_numpy(zero_copy_only=False) | (told["chance"] > 0) | (told["kept"] > 0) | (told["blocks"] > 0)
        out = pa.RecordBatch.from_arrays([b.column("no"), b.column("history"), pa.array(seen), *map(pa.array, told.values())], ["no", "history", "seen", *told])
        yield out.filter(pa.array(keep))


def shards_for(keys: int, cores: int) -> int:
    """A power of two: enough for `keys` rows of stream and history at KEYS_A_SHARD each, and for all cores."""
    return 1 << max(int(np.ceil(np.log2(max(1, cores)))), int(np.ceil(np.log2(max(1, keys / KEYS_A_SHARD)))))


def seen_before(rows: DataFrame, no: str, key: Column, history: DataFrame | None = None, history_key: Column | None = None) -> DataFrame:
    """(no, history, seen, kept, chance, blocks, decoded) of each row that has a key: seen is whether its key came with a smaller `no` or in `history`.

    A repeat is always recognised; a new key is taken for a repeat with the
    chance summed up in `chance` (at the first row of each run probed), `kept`
    counts the keys added there, `blocks` and `decoded` the coded blocks there
    were and those decoded. Rows with history = true carry only these figures
    and stand for the history. `no` must be unique and not negative; rows with
    a null key or null `no` give no row; equal keys of the history count once.
    Other columns are ignored. Empty tables give an empty result.
    """
    spark = rows.sparkSession
    total = rows.count()
    stream = rows.select(F.col(no).cast("bigint").alias("no"), F.xxhash64(key).alias("h"), F.lit(False).alias("history"), key.isNotNull().alias("ok"))
    if history is not None:
        total += history.count()
        stream = stream.union(history.select(F.lit(-1).cast("bigint"), F.xxhash64(history_key), F.lit(True), history_key.isNotNull()))
    stream = stream.where("ok and no is not null").drop("ok")
    shards = shards_for(total, spark.sparkContext.defaultParallelism)
    local = stream.mapInArrow(_local, "no bigint, h bigint, history boolean, seen boolean")
    high = F.shiftrightunsigned("h", UNIVERSE_BITS).bitwiseAND(F.lit(shards - 1))
    placed = local.withColumn("shard", F.when(F.col("seen"), F.pmod(F.xxhash64("no"), F.lit(shards))).otherwise(high).cast("int"))
    sharded = placed.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "no")
    return sharded.mapInArrow(_answer, _ANSWER)


def known_keys(kb_search: DataFrame) -> DataFrame:
    """(key): the entities and the mentions of the search cache."""
    qid, mention = normal_qid(F.col("record.qid")), normal_mention(F.col("mention"))
    return kb_search.select(F.explode(F.array(F.concat(F.lit("q:"), qid), F.concat(F.lit("m:"), mention))).alias("key"))


def linked_entities_seen(linked: DataFrame, kb_search: DataFrame) -> DataFrame:
    """The rows of linked_entities against earlier ones and the search cache (its record.qid and its mention)."""
    return seen_before(linked, "link_id", entity_key(F.col("qid"), F.col("mention")), known_keys(kb_search), F.col("key"))


def filter_report(got: DataFrame) -> DataFrame:
    """One row of the filter's own figures: keys kept, false positives to be expected, coded blocks there were at all probes, decoded ones and their share."""
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0))
    out = got.agg(zero("kept").alias("n_keys"), F.coalesce(F.sum("chance"), F.lit(0.0)).alias("expected_false_positives"), zero("blocks").alias("n_blocks"), zero("decoded").alias("n_decoded"))
    return out.withColumn("share_decoded", F.col("n_decoded") / F.greatest("n_blocks", F.lit(1)))


def audit(linked: DataFrame, kb_search: DataFrame) -> DataFrame:
    """One row: answers given, keys kept, false positives expected in theory, and false positives and negatives against an exact comparison of all rows."""
    got = scratch.keep(linked_entities_seen(linked, kb_search), "seen")
    theory = got.agg(F.count(F.when(~F.col("history"), 1)).alias("n_rows"), F.coalesce(F.sum("kept"), F.lit(0)).alias("n_keys"), F.round(F.coalesce(F.sum("chance"), F.lit(0.0)), 4).alias("expected_false_positives"))
    rows = linked.select(F.col("link_id").alias("no"), entity_key(F.col("qid"), F.col("mention")).alias("key")).where("key is not null")
    known = known_keys(kb_search).where("key is not null")
    firsts = rows.union(known.select(F.lit(-1).cast("bigint"), "key")).groupBy("key").agg(F.min("no").alias("first"))
    exact = rows.join(firsts, "key").select("no", (F.col("first") < F.col("no")).alias("truth"))
    wrong = exact.join(got.where("not history").select("no", "seen"), "no", "full")
    count = lambda c: F.count(F.when(c, 1))
    seen, truth = F.col("seen"), F.col("truth")
    counts = wrong.agg(count(seen & ~truth).alias("false_positives"), count(~seen & truth).alias("false_negatives"), count(seen.isNull() | truth.isNull()).alias("unanswered"), count(~truth).alias("n_new"))
    both = theory.withColumn("one", F.lit(1)).join(counts.withColumn("one", F.lit(1)), "one").drop("one")
    return both.withColumn("false_positive_rate", F.round(F.col("false_positives") / F.greatest("n_new", F.lit(1)), 9))
