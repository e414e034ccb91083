"""Seen keys, frequent items, terms."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomtext.llm import frequent, seen, terms
from loomtext.llm.gcs import GolombSet, SeenFilter


@settings(max_examples=60, deadline=None)
@given(st.sets(st.integers(0, 2**44 - 1), min_size=1, max_size=700))
def test_golomb_round_trip(values):
    v = np.array(sorted(values), np.uint64)
    s = GolombSet(v, 44)
    assert (s.values() == v).all() and s.contains(v)[0].all()
    other = np.array(sorted({(x + 1) % 2**44 for x in values} - values), np.uint64)
    assert not len(other) or not s.contains(other)[0].any()


def test_golomb_size_and_sparse_probes():
    v = np.unique(np.random.default_rng(1).integers(0, 2**44, 200_000, np.uint64))
    s = GolombSet(v, 44)
    assert s.nbytes() * 8 / len(v) < np.log2(2**44 / len(v)) + 3.5
    found, decoded = s.contains(v[[5, 100_000, len(v) - 1]])
    assert found.all() and decoded == 3 and not s.contains(v[[5, 100_000]] + np.uint64(1))[0].any()
    some = np.sort(np.random.default_rng(2).choice(v, 300, replace=False))
    found, decoded = s.contains(some)
    assert found.all() and decoded <= 300 < len(s.firsts)


def test_golomb_dense_values():
    v = np.arange(1000, dtype=np.uint64)
    assert (GolombSet(v, 10).values() == v).all()


def test_filter_levels():
    rng = np.random.default_rng(2)
    f, known = SeenFilter(44, generation=64), set()
    for _ in range(40):
        batch = rng.integers(0, 3000, 100, np.uint64)
        want = []
        for x in batch.tolist():
            want.append(x in known)
            known.add(x)
        assert f.offer(batch).tolist() == want
    assert 0 < len(f.levels) <= 8 and f.kept == len(known) and 0 < f.decoded <= f.asked


def test_filter_decodes_part_of_a_large_set():
    rng = np.random.default_rng(4)
    f = SeenFilter(44)
    for _ in range(100):
        f.offer(rng.integers(0, 2**44, 10_000, np.uint64))
    asked, decoded = f.asked, f.decoded
    values = rng.integers(0, 2**44, 500, np.uint64)
    assert f.offer(values).sum() == 0 and f.offer(values).all()
    assert (f.decoded - decoded) < 0.2 * (f.asked - asked) and f.nbytes() < 5 * f.kept


def test_shards_count_the_history():
    assert seen.shards_for(1000, 8) == 8 and seen.shards_for(5_000_000_000, 8) == 2048 and seen.shards_for(0, 1) == 1


def test_levels_are_built_through_the_operator(spark):
    rows = spark.range(40_000).select(F.col("id").alias("no"), (F.col("id") % 30_000).cast("string").alias("key"))
    row = seen.filter_report(seen.seen_before(rows, "no", F.col("key"))).first()
    assert row["n_keys"] == 30_000 and 0 < row["n_decoded"] <= row["n_blocks"]


def run(spark, rows, history=()):
    df = spark.createDataFrame(rows, "no bigint, key string").withColumns({"h": F.lit("clash"), "seen": F.lit(0), "shard": F.lit(1)})
    h = spark.createDataFrame([(k,) for k in history], "key string")
    return {r["no"]: r["seen"] for r in seen.seen_before(df, "no", F.col("key"), h, F.col("key")).where("not history").collect()}


def test_seen(spark):
    assert run(spark, [(3, "a"), (1, "a"), (2, "b"), (4, None), (None, "a"), (5, "z")], ["z", "z", None]) == {1: False, 2: False, 3: True, 5: True}
    assert run(spark, [], ["z"]) == {}
    assert run(spark, [(1, "a")]) == {1: False}
    assert run(spark, [(1, "x" * 1_000_000), (2, "x" * 1_000_000)]) == {1: False, 2: True}


def test_seen_hot_key_out_of_order(spark):
    rows = spark.range(60_000).select((59_999 - F.col("id")).alias("no"), F.when(F.col("id") % 3 == 0, "hot").otherwise((F.col("id") % 7000).cast("string")).alias("key")).repartition(9)
    got = seen.seen_before(rows, "no", F.col("key")).select("no", "seen")
    first = rows.groupBy("key").agg(F.min("no").alias("f"))
    want = rows.join(first, "key").select("no", (F.col("f") < F.col("no")).alias("seen"))
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_audit(spark, data):
    row = seen.audit(spark.read.parquet(f"{data}/linked_entities.parquet"), spark.read.parquet(f"{data}/kb_search.parquet")).first()
    assert row["false_negatives"] == 0 and row["unanswered"] == 0 and row["false_positives"] <= 1 and row["expected_false_positives"] < 1e-3


def test_summary_bounds():
    import pyarrow as pa

    rng = np.random.default_rng(3)
    items = np.minimum(rng.zipf(1.3, 20_000), 5000)
    true = np.bincount(items)
    parts = []
    for chunk in np.array_split(items, 8):
        s = frequent.Summary(64)
        for batch in np.array_split(chunk, 5):
            v, c = np.unique(batch, return_counts=True)
            s.merge(pa.array([str(x) for x in v]), c, np.zeros(len(c), np.int64), 0, len(batch))
        parts.append(s)
    whole = frequent.Summary(64)
    for s in parts:
        whole.merge(s.items, s.counts, s.errors, s.floor, s.n)
    assert whole.n == 20_000
    for item, count, error in zip(whole.items.to_pylist(), whole.counts, whole.errors):
        assert count - error <= true[int(item)] <= count
    kept = {int(x) for x in whole.items.to_pylist()}
    assert {i for i in range(len(true)) if true[i] > whole.floor} <= kept and whole.floor <= 20_000 / 8


def test_frequent(spark):
    rows = spark.range(30_000).select(F.lit("f").alias("field"), F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 50 == 1, "warm").otherwise(F.col("id").cast("string")).alias("item"), F.lit(1).alias("n"))
    rows = rows.union(spark.createDataFrame([("f", None, 1), (None, "x", 1), ("g", "", 1), ("g", "y" * 100_000, 1)], "field string, item string, n int")).repartition(20)
    got = {(r["field"], r["item"][:5]): r["n"] for r in frequent.frequent_items(rows, 0.008, capacity=512).collect()}
    assert got[("f", "hot")] == 10_000 and got[("f", "warm")] == rows.where("item = 'warm'").count() and got[("g", "")] == 1 and got[("g", "yyyyy")] == 1 and len(got) == 4
    assert frequent.frequent_items(rows.where("false"), 0.01).count() == 0
    with pytest.raises(ValueError):
        frequent.frequent_items(rows, 0.001, capacity=100)


def test_estimates_bound_the_counts(spark, data):
    from loomtext.llm import registry

    got = registry.QUERIES["p6_estimates"](spark, data)
    assert got.where("estimate < n or estimate - error > n").count() == 0


def test_terms(spark):
    rows = [(1, "The the cat"), (2, "the Dog 9"), (3, None), (4, ""), (5, "123"), (1, "again the"), (None, "null id"), (None, "null id"), (6, "the " * 100_000)]
    df = spark.createDataFrame(rows, "k bigint, t string").withColumns({"term": F.lit("clash"), "part": F.lit(1), "record": F.lit(2)})
    got = {r["term"]: (r["n_occurrences"], r["n_records"], r["mark"]) for r in terms.term_table(df, "k", "t").collect()}
    assert got["the"] == (100_004, 3, None) and got["cat"] == (1, 1, "rare") and got["null"] == (2, 1, "rare") and got["dog"] == (1, 1, "rare")
    assert terms.term_table(df.where("false"), "k", "t").count() == 0


def test_common_needs_more_than_the_share(spark):
    df = spark.createDataFrame([(i, "a b" if i < 8 else "a") for i in range(10)], "k bigint, t string")
    got = {r["term"]: r["mark"] for r in terms.term_table(df, "k", "t").collect()}
    assert got == {"a": "common", "b": None}


def test_hot_terms_over_many_ranges(spark):
    df = spark.range(6000).select(F.col("id").alias("k"), F.concat(F.lit("hot hot "), F.translate((F.col("id") % 500).cast("string"), "0123456789", "abcdefghij")).alias("t"))
    got = terms.term_table(df, "k", "t")
    assert got.where("term = 'hot'").first()["n_occurrences"] == 12_000 and got.where("term = 'hot'").first()["n_records"] == 6000
    assert got.where("term <> 'hot'").agg(F.sum("n_records")).first()[0] == 6000


@pytest.mark.parametrize("parts", [8, 64, 400])
def test_ranges_are_even(spark, parts):
    """No range is far longer than the mean, whatever their number: neither hot terms nor the rows that count records gather in one."""
    word = lambda i: F.translate(F.abs(F.hash("id", F.lit(i)) % F.pow(F.lit(10), F.lit(1 + i % 5)).cast("int")).cast("string"), "0123456789", "abcdefghij")
    df = spark.range(12_000).select(F.col("id").alias("record"), F.concat_ws(" ", F.lit("the of and"), *[word(i) for i in range(60)]).alias("text")).repartition(6)
    bounds = terms.bounds_of(df, parts)
    sizes = [r["count"] for r in terms.ranged(df, bounds).groupBy("part").count().collect()]
    assert len(sizes) == parts and max(sizes) < 1.3 * sum(sizes) / parts


def test_ranges_change_no_row(spark, data):
    docs = spark.read.parquet(f"{data}/articles.parquet")
    one, many = (terms.term_table(docs, "article_no", "text", ranges=n) for n in (1, 50))
    assert one.exceptAll(many).count() == 0 and many.exceptAll(one).count() == 0


def test_bounds_open_few_partitions(spark):
    """The sample takes the first rows of chosen partitions, at most about SAMPLE_RECORDS in all."""
    df = spark.range(100_000).select(F.col("id").alias("record"), F.lit("a b").alias("text")).repartition(100)
    sample = terms._sample(df, 1000)
    assert 900 <= len(sample) <= 1100
