"""Rules of the operators on small hand-made tables."""

import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomtext.functions import text as X
from loomtext.functions.hashing import hash60
from loomtext.operators import augment, classify, comments, corpus, dedup, kb, kg, metrics, sketches, textrank, tfidf, transe
from loomtext.operators.components import connected_components
from loomtext.operators.ordinals import with_ordinal
from loomtext.plans import eval_queries


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def test_tokens_and_sentences(spark):
    assert one(spark, X.tokens(F.lit("It's 2 A-b"))) == ["it", "s", "a", "b"]
    assert one(spark, X.tokens(F.lit("It's 2 A-b"), X.ALNUM)) == ["it", "s", "2", "a", "b"]
    assert one(spark, X.tokens(F.lit("It's x A-b"), X.DASHED)) == ["it's", "a-b"]
    assert one(spark, X.sentences(F.lit("One. Two! three? Four"))) == ["One.", "Two! three?", "Four"]
    assert one(spark, X.sentence_tokens(F.lit("Aa bb cc. 1 2. Dd ee"), 3, 2)) == [["aa", "bb"], ["dd", "ee"]]
    assert one(spark, X.tokens(F.lit(None).cast("string"))) == []


@pytest.mark.parametrize("text, want", [("A b c", ["a b c"]), ("", []), ("a b c d e f", ["a b c d e", "b c d e f"]), ("a a a a a a", ["a a a a a"])])
def test_shingles(spark, text, want):
    assert one(spark, X.shingles(X.tokens(F.lit(text), X.ALNUM))) == want


@pytest.mark.parametrize("text, want", [('"the Strait of Hormuz,', "Strait of Hormuz"), ("the Mr. X", "Mr. X"), ("Bravo:", "Bravo"), ("", ""), ("...", ""), ("A an x", "an x")])
def test_clean_mention(spark, text, want):
    assert one(spark, X.clean_mention(F.lit(text))) == want


def test_names_with_offsets(spark):
    df = spark.createDataFrame([(1, "The Bank of New York hired John Smith"), (2, None), (3, "")], "k bigint, t string")
    got = [(r["text"], r["start"], r["end"]) for r in X.name_mentions(df, "k", "t").orderBy("pos").collect()]
    assert got == [("New York", 12, 20), ("John Smith", 27, 37)]


def test_labels(spark):
    assert one(spark, X.label_flag(F.lit(" fake "), "FAKE")) == 1 and one(spark, X.label_flag(F.lit("0"), 0)) == 1 and one(spark, X.label_flag(F.lit("x"), 0)) == 0


def test_upper_median_and_empty_corpus(spark):
    assert corpus.upper_median(spark.createDataFrame([(1,), (2,), (3,), (4,)], "v int"), "v").first()[0] == 3
    empty = spark.createDataFrame([], "id bigint, text string, label int, split string")
    row = corpus.corpus_stats(empty).first()
    assert (row["n_docs"], row["n_tokens"], row["mean_len"], row["median"]) == (0, 0, 0.0, 0)
    assert corpus.label_stats(empty).first()["fake_to_real"] == 0


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text("abcd", min_size=1, max_size=3), min_size=1, max_size=60))
def test_count_min_never_under(spark, items):
    counts = spark.createDataFrame([(i,) for i in items], "item string").groupBy("item").agg(F.count("*").alias("n"))
    est = sketches.cms_estimates(sketches.cms_cells(counts, width=16, depth=3), counts, width=16, depth=3).join(counts, "item")
    assert est.where("estimate < n").count() == 0


def test_sketches_merge(spark):
    a = spark.createDataFrame([("x", 2), ("y", 1)], "item string, n bigint")
    b = spark.createDataFrame([("x", 3), (None, 5)], "item string, n bigint")
    both = spark.createDataFrame([("x", 5), ("y", 1)], "item string, n bigint")
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(sketches.merge_cells(sketches.cms_cells(a), sketches.cms_cells(b))) == rows(sketches.cms_cells(both))


def test_bloom(spark):
    assert sketches.bloom_size(1000, 0.01) == (9586, 7) and sketches.bloom_size(0, 0.01) == (8, 1)
    members = spark.range(500).select(F.col("id").cast("string").alias("item"))
    bits = sketches.bloom_bits(members, *sketches.bloom_size(500, 0.01))
    probe = spark.range(5000).select(F.col("id").cast("string").alias("item"))
    got = sketches.bloom_contains(bits, probe, *sketches.bloom_size(500, 0.01))
    assert got.where("not maybe and cast(item as int) < 500").count() == 0
    assert got.where("maybe and cast(item as int) >= 500").count() < 4500 * 0.03


def test_components_against_union_find(spark):
    import random

    random.seed(3)
    edges = [(random.randrange(300), random.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 470)] + [(900, 900 + i) for i in range(1, 200)] + [(None, 1), (3, 3), (7, 8), (8, 7)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    got = connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()
    assert {r[0]: r[1] for r in got} == {x: find(x) for x in parent} and len(got) == len(parent)
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_ordinals(spark):
    df = spark.range(1000).select(F.concat(F.lit("k"), F.lpad(F.col("id").cast("string"), 5, "0")).alias("k"))
    got = with_ordinal(df.repartition(7), "k").orderBy("k").collect()
    assert [r["ordinal"] for r in got] == list(range(1000))


def test_duplicates(spark):
    words = [f"w{i}" for i in range(60)]
    rows = [(1, " ".join(words)), (2, " ".join(words)), (3, " ".join(words[:58] + ["x", "y"])), (4, "other text entirely here now and more words"), (5, None), (6, ""), (7, "a b")]
    pairs, members = dedup.duplicate_pairs(spark.createDataFrame(rows, "id bigint, text string"), 0.8)
    assert [(r["a"], r["b"]) for r in pairs.collect()] == [(1, 3)]
    assert sorted(map(tuple, dedup.duplicate_clusters(pairs, members).collect())) == [(1, 1), (2, 1), (3, 1)]


def test_dense_bands_keep_every_pair(spark):
    sigs = spark.range(100).select("id", F.array(*[F.lit(1).cast("bigint")] * 8).alias("sig"))
    assert dedup.band_pairs(sigs, 1, 8, dense=10).count() == 100 * 99 // 2


def test_idf_and_vocabulary(spark):
    docs = spark.createDataFrame([(1, "alpha beta beta"), (2, "alpha beta gamma"), (3, "alpha delta")], "id bigint, text string")
    got = {r["token"]: r["idf"] for r in tfidf.idf(docs).collect()}
    assert set(got) == {"beta"} and math.isclose(got["beta"], math.log(4 / 3) + 1)
    toks = spark.createDataFrame([(w,) for w in "a a a b b c".split()], "token string")
    vocab = tfidf.vocabulary(toks)
    assert {r["token"]: r["token_id"] for r in vocab.collect()} == {"a": 2, "b": 3}
    seq = spark.createDataFrame([(1, i, w) for i, w in enumerate("c a b".split())], "id bigint, pos int, token string")
    assert [r["token_id"] for r in tfidf.encode(seq, vocab).orderBy("pos").collect()] == [1, 2, 3]


def test_textrank():
    assert textrank.rank_tokens(["aa", "bb", "aa"], 4, 20, 0.85) == [("aa", 0.5), ("bb", 0.5)]
    drawn = dict(textrank.rank_tokens(["aa", "bb", "cc", "dd"], 1, 1, 0.85, {"aa": 5.0}))
    assert drawn["bb"] > drawn["cc"]  # one step from a start that favours aa
    assert textrank.rank_tokens(["aa", "aa"], 4, 20, 0.85) == [] and textrank.rank_tokens([], 4, 20, 0.85) == []


def test_last_write_and_no_match(spark):
    s = "line_no bigint, mention string, record struct<qid: string, label: string, description: string, score: double, _no_match: boolean>"
    rows = [(1, "Foo", ("Q1", "Foo", "a city", 0.5, None)), (2, "foo", ("Q2", "Foo", "a city", None, None)), (3, "Bar", (None, None, None, None, True)), (4, "Old", (None, None, None, None, None)), (5, None, ("Q9", "x", "y", 1.0, None)), (6, "GPE|foo", ("Q3", "Foo", "", 0.1, None))]
    search = spark.createDataFrame(rows, s)
    assert kb.cache_stats(search).first().asDict() == {"total": 4, "resolved": 2, "no_match": 1, "empty": 1}
    mentions = spark.createDataFrame([(1, "the Foo,", "GPE"), (2, "bar", None), (3, "none", "ORG"), (4, None, "ORG"), (5, "foo", "ORG")], "id int, text string, label string")
    got = {r["id"]: (r["cache_hit"], r["qid"]) for r in kb.link(mentions, search).collect()}
    assert got == {1: (True, "Q2"), 2: (True, None), 3: (False, None), 4: (False, None), 5: (True, "Q2")}
    first = {r["id"]: (r["qid"], r["trusted"]) for r in kb.link_prioritised(mentions, search).collect()}
    assert first[1] == ("Q3", True) and first[5] == ("Q2", False) and first[3] == (None, False)


def test_claims(spark):
    payload = '{"claims": {"P31": [{"mainsnak": {"datavalue": {"value": {"id": "Q5"}}}}, {"mainsnak": {}}, {"mainsnak": {"datavalue": {"value": "text"}}}, {"mainsnak": {"datavalue": {"value": {"time": "+1999"}}}}, {"mainsnak": {"datavalue": {"value": {"amount": "1"}}}}], "P1": [{"mainsnak": {}}]}}'
    assert one(spark, kb.flatten_claims(F.lit(payload))) == {"P31": ["Q5", "text", "+1999"]}
    rows = spark.createDataFrame([("Q1", {"P31": list("abcdefg"), "P9": ["x", None]}), ("Q2", None)], "qid string, claims map<string, array<string>>")
    assert kb.claim_rows(rows).count() == 6 and kb.claim_rows(rows, ("P9",)).count() == 1


def test_class_chain(spark):
    rows = [("Q1", {"P31": ["lit", "Q2"]}), ("Q2", {"P279": ["Q3"]}), ("Q3", {"P31": ["Q1", "Q4"], "P279": ["Q5"]}), ("Q7", {})]
    chains = kg.class_chains(spark.createDataFrame(rows, "qid string, claims map<string, array<string>>"))
    got = {r["qid"]: (r["c1"], r["c2"], r["c3"]) for r in chains.collect()}
    assert got["Q1"] == ("Q2", "Q3", "Q4") and got["Q7"] == (None, None, None)
    assert {r["qid"]: r["class_path"] for r in kg.crossview_of(chains).collect()}["Q1"] == "MISC.Q2.Q3"


def test_refinement_matches_rounds(spark):
    vec = spark.createDataFrame([(1, 0, [0.0]), (2, 0, [4.0])], "id int, label int, embedding array<float>")
    assert sorted(r["embedding"][0] for r in kg.refine(vec, 1, 0.5, 5).collect()) == [1.9375, 2.0625]
    assert kg.membership_loss(vec, 1).first()[0] == 4.0


def test_measures(spark):
    rows = spark.createDataFrame([(1, 1, 0.9), (1, 0, 0.4), (0, 0, 0.3), (0, 1, 0.6), (1, 1, 0.9), (None, 1, 0.2)], "label int, predicted int, score double")
    c = metrics.confusion(rows).first()
    assert (c["tp"], c["fp"], c["fn"], c["tn"]) == (2, 1, 1, 1) and round(c["f1"], 4) == 0.6667 and round(c["miss_rate"], 4) == 0.3333
    assert round(metrics.roc_auc(rows).first()[0], 4) == 0.8333
    assert metrics.roc_auc(rows.where("label = 1")).first()[0] is None
    none = metrics.confusion(rows.where("label > 5")).first()
    assert none["precision"] == 0 and none["miss_rate"] == 1


def test_rouge(spark):
    rows = spark.createDataFrame([(1, "the cat sat", "the cat ran"), (2, "", "x"), (3, None, None)], "id bigint, predicted string, reference string")
    f = lambda df: {r["id"]: round(r["f1"], 4) for r in df.collect()}
    assert f(metrics.rouge_n(rows, 1)) == {1: 0.6667, 2: 0, 3: 0} and f(metrics.rouge_n(rows, 2)) == {1: 0.5, 2: 0, 3: 0}
    assert f(metrics.rouge_l(rows)) == {1: 0.6667, 2: 0, 3: 0}


@given(st.lists(st.sampled_from("abc"), max_size=12), st.lists(st.sampled_from("abc"), max_size=12))
def test_common_subsequence(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    assert metrics._common(a, b) == table[-1][-1]


def test_measures_of_overlap_shuffle_nothing(spark):
    rows = spark.createDataFrame([(1, "a b a", "a a b"), (2, None, "x"), (3, "\t", "")], "id bigint, predicted string, reference string")
    for df in (metrics.rouge_n(rows, 2), metrics.rouge_l(rows), textrank.cooccurrence(rows.select("id", F.col("predicted").alias("text")))):
        assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
    assert [tuple(round(x, 4) for x in r) for r in metrics.rouge(rows).orderBy("id").collect()] == [(1, 1.0, 0.5, 0.6667), (2, 0, 0, 0), (3, 0, 0, 0)]


def test_quotes(spark):
    for text in ("plain", "O'Neil", 'say "x"', "O'Neil \"x\"", "a\\b", "line\nend\t"):
        assert one(spark, comments.quoted(F.lit(text))) == repr(text)


def test_weighted_means(spark):
    ents = spark.createDataFrame([(1, 1, 2, 1.0), (1, 2, 1, None), (1, 3, 9, 1.0), (1, 4, 9, 1.0), (2, 3, 1, 1.0)], "id bigint, key bigint, count bigint, given double")
    vecs = spark.createDataFrame([(1, [1.0, 0.0]), (2, [4.0, 3.0]), (3, [0.0, 0.0])], "key bigint, vec array<double>")
    got = {(r["id"], r["dim"]): r["value"] for r in kg.weighted_mean_vectors(ents, vecs, 2).collect()}
    assert got == {(1, 0): 2.0, (1, 1): 1.0, (2, 0): 0.0, (2, 1): 0.0}


def test_translation_blocks(spark):
    """Every entity and relation has a vector with one block and with several, and training brings true triples nearer than false ones."""
    rows = spark.createDataFrame([(f"a{i}", f"r{i % 2}", f"b{i // 4}") for i in range(200)] + [(None, "r", "x"), ("a1", "r1", "b0")], "h string, r string, t string")
    for size in (10_000, 60):
        got = {(r["kind"], r["key"]): r["vec"] for r in transe.train(rows, dim=8, rate=0.05, block_triples=size).collect()}
        assert len(got) == 200 + 50 + 2 and all(len(v) == 8 for v in got.values())
        away = lambda h, r, t: math.dist([x + y for x, y in zip(got["entity", h], got["relation", r])], got["entity", t])
        near, far = (sum(away(f"a{i}", f"r{i % 2}", f"b{(i // 4 + k) % 50}") for i in range(200)) for k in (0, 20))
        assert near < 0.9 * far
    assert transe.train(rows.where("false"), dim=8).count() == 0


def test_nested_ontology(spark):
    import json

    nodes = spark.createDataFrame([("A", 1, None, "P1,P2"), ("A.x", 2, "A", ""), ('A.q"', 2, "A", "P3"), ("B", 1, None, "")], "path string, level int, parent string, attributes string")
    got = json.loads(kg.nested(nodes).first()[0])
    assert set(got) == {"A", "B"} and got["A"]["attributes"] == ["P1", "P2"] and got["A"]["children"]['q"']["attributes"] == ["P3"] and got["B"]["parent"] is None and got["B"]["children"] == {}
    assert [r["path"] for r in kg.all_classes(nodes).orderBy("path").collect()] == ["A", 'A.q"', "A.x", "B"]


def test_encoder_sees_each_sentence_once(spark):
    rows = spark.createDataFrame([(1, ["s", "s", "t"]), (2, []), (3, None)], "id bigint, sentences array<string>")
    seen = []

    def encoder(flat):
        seen.append(flat.count())
        return flat.withColumn("vec", F.array(F.when(F.col("sentence") == "s", 3.0).otherwise(0.0)))

    got = {r["id"]: r["value"] for r in tfidf.encode_spans(rows, encoder, 1).collect()}
    assert got == {1: 2.0, 2: 0.0, 3: 0.0} and seen == [2]


def test_history(spark):
    docs = spark.createDataFrame([(i, "good fine" if i % 2 else "bad poor", i % 2, "train") for i in range(20)], "id bigint, text string, label int, split string")
    rows = classify.history(docs, 64, 5).orderBy("epoch").collect()
    assert len(rows) >= 2 and rows[-1]["loss"] < rows[0]["loss"]


def test_paraphrase_hook(spark):
    rows = spark.createDataFrame([(1, ["big", "cat"])], "id bigint, tokens array<string>")
    none, topics = spark.createDataFrame([], "word string, synonyms array<string>"), spark.createDataFrame([], "word string")
    assert augment.augmented(rows, none, topics).first()["tokens"] == ["big", "cat"]
    assert augment.augmented(rows, none, topics, paraphrase=lambda r: r.withColumn("tokens", F.reverse("tokens"))).first()["tokens"] == ["cat", "big"]


def test_majority(spark):
    rows = spark.createDataFrame([(1, 1), (1, 1), (1, 0), (1, 0), (2, 1), (2, 1), (2, 0)], "id int, predicted int")
    assert {r["id"]: r["verdict"] for r in metrics.majority(rows).collect()} == {1: "REAL", 2: "FAKE"}


def test_early_stop(spark):
    rows = spark.createDataFrame([("r", i, x) for i, x in enumerate([1.0, 0.5, 2.0, 2.0, 2.0, 2.0])], "run string, epoch bigint, loss double")
    got = metrics.smoothed_losses(rows, patience=2).orderBy("epoch").collect()
    assert round(got[1]["ema"], 6) == 0.9 and [r["stopped"] for r in got] == [False, False, False, False, True, True]


def test_coverage():
    assert augment.covered(list("ababab"), 0.6) == list("ababab") and augment.covered(list("ababab"), 0.4) == list("abab") and augment.covered([], 0.5) == []


def test_synonyms(spark):
    table = augment.synonym_lists(spark.createDataFrame([("Big", "large"), ("big", "huge"), ("big", "big"), ("big", "very_big")], "word string, synonym string"))
    assert table.first()["synonyms"] == ["huge", "large"]
    toks = spark.createDataFrame([(1, 0, "big"), (1, 1, "cat"), (1, 2, "Big")], "id bigint, pos int, token string")
    topics = spark.createDataFrame([("cat",)], "word string")
    got = [r["token"] for r in augment.synonym_replace(toks, table, topics, 1.0).orderBy("pos").collect()]
    assert got[1] == "cat" and {got[0], got[2]} <= {"huge", "large"}
    assert [r["token"] for r in augment.synonym_replace(toks, table, topics, 0.0).orderBy("pos").collect()] == ["big", "cat", "Big"]


def test_flags_stop_only_at_resolved_mentions(spark):
    s = "line_no bigint, mention string, record struct<qid: string, label: string, description: string, score: double, _no_match: boolean>"
    search = spark.createDataFrame([(1, "good", ("Q1", "Good", "a city", 1.0, None)), (2, "odd", ("Q2", "Odd", "", 1.0, None))], s)
    claims = spark.createDataFrame([("Q2", {"P31": ["Q999"]})], "qid string, claims map<string, array<string>>")
    rows = [(1, i, f"x{i}", "GPE") for i in range(1, 8)] + [(1, 8, "good", "GPE"), (1, 9, "x9", "GPE"), (2, 1, "odd", "PERSON"), (3, 1, "good", "GPE")]
    got = comments.flags(spark.createDataFrame(rows, "article_no bigint, pos int, text string, label string"), search, claims)
    assert sorted((r["article_no"], r["pos"]) for r in got.collect()) == [*[(1, i) for i in range(1, 8)], (2, 1)]
    docs = spark.createDataFrame([(2,), (3,)], "id bigint")
    words = spark.createDataFrame([(3, 1, "king"), (3, 2, "day")], "id bigint, rank int, keyword string")
    text = {r["id"]: r["comment"] for r in comments.comments(docs, got, words).collect()}
    assert text[3] == comments.CLEAN + " Key topics: king, day." and text[2].startswith("Potential entity-linking concerns for: odd.")


def test_split_shares(spark):
    docs = spark.range(1000).select("id", (F.col("id") % 2).cast("int").alias("label"))
    got = {(r["label"], r["part"]): r["count"] for r in corpus.stratified_split(docs).groupBy("label", "part").count().collect()}
    assert got == {(k, p): n for k in (0, 1) for p, n in (("train", 400), ("val", 50), ("test", 50))}


def test_hash_is_stable(spark):
    assert one(spark, hash60(0, F.lit("a"))) == int(__import__("hashlib").md5(b"0|a").hexdigest()[:15], 16)


def test_masks(spark):
    df = spark.createDataFrame([([1.0, 2.0],)], "v array<double>")
    assert df.select(classify.masked("v", "text_only", ("both",)).alias("x")).first()[0] == [0.0, 0.0]


def test_query_trains_the_whole_classifier(spark, data, monkeypatch):
    """hashing_logreg asks for the operator's own number of columns and iterations."""
    asked, real = [], classify.pipeline
    monkeypatch.setattr(classify, "pipeline", lambda *a: asked.append(a) or real(64, 1))
    assert eval_queries.hashing_logreg(spark, data).columns == ["id", "split", "label", "score"]
    assert asked == [(1 << 18, 200)]
