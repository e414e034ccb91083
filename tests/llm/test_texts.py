"""Names, containers, mixes, reading levels."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomtext.llm import mixing, names, packing, reading, registry
from loomtext.llm import tokens as K

KNOWN = [("Q1", "Margaret Henjimsit"), ("Q2", "Thomas Henjimsit"), ("Q3", "Reldothar Research Institute"), ("Q4", "New Sitreltil"), ("Q5", "Theodore Gulsostam"), ("Q6", "Borfur Brothers and Partners"), ("Q7", "Wusdot Savings Bank Limited"), ("Q8", "Zalkor Research Institute"), ("Q9", "Dintil National Laboratory"), ("Q10", "Harnol Research Institute"), ("Q11", "Kirvat Research Laboratory")]
KNOWN += [(f"Q{50 + i}", f"{w} {rest}") for i, (w, rest) in enumerate((w, r) for r in ("Brothers and Partners", "Savings Bank Limited") for w in ("Pemjer", "Dasvom", "Lunget", "Rutbis"))]
KNOWN += [(f"Q{20 + i}", f"{g} Xyl{chr(97 + i)}vor{chr(97 + k)}q") for k, g in enumerate(("Margaret", "Thomas", "Theodore")) for i in range(4)]


HABITS = names.Habits(
    full={"peggy": ["margaret"], "tom": ["thomas"], "ted": ["theodore"], "inst": ["institute"], "ltd": ["limited"], "of": ["savings"]},
    added={"dr", "mr", "the", "of"}, left={"margaret", "thomas", "theodore"}, seen={"same": 900, "edit1": 90, "edit2": 40, "initial": 60, "short": 50, "added": 40, "left": 20, "cut": 10, "acronym": 5},
)
WANTED = {
    "margaret henjimsit": "Q1", "henjimsit, margaret": "Q1", "m. henjimsit": "Q1", "henjimsit, t.": "Q2", "peggy henjimsit": "Q1", "tom henjimsit": "Q2", "margaret hejnimsit": "Q1", "mragaret henjimst": "Q1", "margaret-henjimsit": "Q1",
    "margaret j. henjimsit": "Q1", "t.f. gulsostam": "Q5", "dr. gulsostam": "Q5", "gulsostam": "Q5", "ted gulsostam": "Q5", "richard henjimsit": None, "henjimsit jimsit": None, "the reldothar research inst.": "Q3", "reldo. research institute": "Q3",
    "research institute of reldothar": "Q3", "rri": "Q3", "reldothar reseacrh institute": "Q3", "reldothar shipping company": None, "new sitreltil": "Q4", "lake sitreltil": None, "sitreltil": None, "and partners of borfur brothers": "Q6", "wusdot savings bank ltd.": "Q7",
    "peggi henjimsit": "Q1", "hen jimsit margaret": "Q1", "u n o": "Q12", "staff writer": None, "photo": None, "": None, "...": None, "x" * 5000: None, "márgaret henjimsit": "Q1", "margaret " * 30 + "henjimsit": None,
}


def test_spellings(spark):
    """Spelling by spelling; an exact name beats an acronym and costs nothing."""
    known = KNOWN + [("Q12", "u n o"), ("Q13", "Ulon National Office")]
    got = names.match_spellings(spark.createDataFrame([(s,) for s in WANTED], "spelling string"), spark.createDataFrame(known, "qid string, name string"), HABITS).collect()
    found = {s: {r["qid"] for r in got if r["spelling"] == s} for s in WANTED}
    assert "Q3" in found.pop("rri")
    assert found == {s: {q} if q else set() for s, q in WANTED.items() if s != "rri"}
    assert [r["cost"] for r in got if r["spelling"] == "u n o"] == [0.0]


def test_habits_are_learned(spark):
    """Short forms, added words and words left out come from resolved rows of several entities; what one entity shows is no habit."""
    kn = [(f"Q{i}", f"{g} Sur{chr(97 + i)}xolt") for i, g in enumerate(["Margaret"] * 3 + ["Thomas"] * 3 + ["Oswald", "Edwina", "Horace", "Imogen", "Lucian", "Winifred", "Zora", "New"])]
    rows = [(n.lower(), q) for q, n in kn]
    rows += [(f"peggy {n.split()[1].lower()}", q) for q, n in kn[:3]] + [(f"mr. {n.split()[1].lower()}", q) for q, n in kn[:13]] + [(f"tommo {kn[4][1].split()[1].lower()}", "Q4"), ("surbxlot, margaret", "Q1"), (None, "Q1"), ("peggy", None)]
    h = names.learn(spark.createDataFrame(rows, "spelling string, qid string"), spark.createDataFrame([(q, n.lower()) for q, n in kn], "qid string, name string"))
    assert h.full == {"peggy": ["margaret"]} and h.added == {"mr"} and {"margaret", "thomas"} <= h.left and "new" not in h.left and h.seen["edit1"] == 1
    empty = names.learn(spark.createDataFrame([], "spelling string, qid string"), spark.createDataFrame([], "qid string, name string"))
    assert not empty.full and not empty.added and all(c > 0 for c in empty.costs().values())


def test_held_out_entities(spark, data):
    """Variants of entities that taught nothing are read at all sizes of data; none is taken for another one."""
    rows = {r["form"]: r for r in registry.QUERIES["p5_validation"](spark, data).collect()}
    assert rows["plain"]["n_missed"] == 0 and all(r["n_right"] + r["n_wrong"] + r["n_missed"] == r["n_rows"] for r in rows.values())


def damerau(a, b):
    """Edits between two words, swapped letters counting one even where letters come between them."""
    d = {(i, j): i + j if not i * j else 99 for i in range(len(a) + 1) for j in range(len(b) + 1)}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            swaps = [d[k - 1, m - 1] + (i - k - 1) + 1 + (j - m - 1) for k in range(1, i) for m in range(1, j) if a[k - 1] == b[j - 1] and a[i - 1] == b[m - 1]]
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]), *swaps)
    return d[len(a), len(b)]


@settings(max_examples=300, deadline=None)
@given(st.sets(st.text("abc", min_size=1, max_size=7), min_size=1, max_size=12), st.sets(st.text("abc", min_size=1, max_size=7), min_size=1, max_size=12))
def test_trie_walk_is_exact(known, asked):
    got = names.Trie(sorted(known), 2).neighbours(sorted(asked))
    assert got == {w: near for w in asked if (near := {k: d for k in known if (d := damerau(w, k)) <= 2})}


@pytest.mark.parametrize("by, block", [(0, 1), (1, 3), (2, 1000)])
def test_cells_agree(spark, by, block):
    """All words within the bound are found whatever the cells and blocks, and a word visits a fixed number of cells."""
    rng = np.random.default_rng(7)
    known = sorted({"".join(rng.choice(list("abcnopz"), rng.integers(1, 9))) for _ in range(150)})
    asked = sorted({"".join(rng.choice(list("abcnopz"), rng.integers(1, 9))) for _ in range(80)} | set(known[:10]) | {"a" * 70, "a" * 68})
    known += ["a" * 69]
    sp, kn = spark.createDataFrame([(w,) for w in asked], "w string"), spark.createDataFrame([(w,) for w in known], "n string")
    got = {(r["w"], r["n"]): r["d"] for r in names.near_words(sp, kn, by, block).collect()}
    assert got == {(w, n): d for w in asked for n in known if abs(len(w) - len(n)) <= 2 and (d := damerau(w, n)) <= 2}
    visits = [len(r[0]) for r in sp.select(names.cells_of(F.col("w"), by, True)).collect()]
    assert max(visits) <= (1, 5, 19)[by] and all(len(r[0]) == 1 for r in kn.select(names.cells_of(F.col("n"), by, False)).collect())


def test_links_and_ties(spark):
    kn = spark.createDataFrame([("Q1", "New Place"), ("Q2", "New Place"), ("Q3", "Anna Bortil")], "qid string, name string")
    rows = [(1, 10, " NEW  place"), (2, 11, "new place"), (3, 12, "new place"), (4, 12, "anna bortil"), (5, 12, None), (6, 12, "  "), (7, 12, "..."), (8, None, "New Place"), (1, 10, "new place")]
    df = spark.createDataFrame(rows, "k bigint, art bigint, m string").withColumns({"qid": F.lit("clash"), "spelling": F.lit(1)})
    known = spark.createDataFrame([(10, "Q2"), (11, "Q1"), (11, "Q1"), (99, "Q2"), (99, "Q2")], "grp bigint, qid string")
    got = sorted((r["id"], r["qid"]) for r in names.link_variants(df, "k", "m", "art", kn, known, HABITS).collect())
    assert got[:5] == [(1, "Q2"), (2, "Q1"), (3, "Q2"), (4, "Q3"), (8, "Q2")] or got == [(1, "Q2"), (1, "Q2"), (2, "Q1"), (3, "Q2"), (4, "Q3"), (8, "Q2")]
    assert names.link_variants(df.where("false"), "k", "m", "art", kn, known, HABITS).count() == 0
    assert names.link_variants(df, "k", "m", "art", kn.where("false"), known, HABITS).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 250), min_size=0, max_size=80))
def test_first_fit(sizes):
    sizes = np.array(sizes, np.int64)
    at, piece, size, box, room = packing.first_fit_decreasing(np.arange(len(sizes)), sizes, 100)
    assert (np.bincount(at, size, len(sizes)) == sizes).all() and len({(a, p) for a, p in zip(at, piece)}) == len(at)
    load = np.bincount(box, size) if len(box) else np.zeros(0)
    assert (load <= 100).all() and all(100 - load[b] == r for b, r in zip(box, room))
    for i, s in enumerate(sizes):
        assert (at == i).sum() == max(1, -(-int(s) // 100))
    plain: list[int] = []
    for s in sorted([int(s) % 100 for s in sizes if s % 100 or not s], reverse=True):
        fit = next((k for k, left in enumerate(plain) if left >= s), None)
        if fit is None:
            plain.append(100)
            fit = len(plain) - 1
        plain[fit] -= s
    assert len(load) == len(plain) + int((sizes // 100).sum())


def test_packing(spark):
    docs = spark.createDataFrame([(1, "a b c " * 2000, "x"), (2, "", ""), (3, None, ""), (None, "null id", ""), (4, "same", ""), (4, "same", "")], "doc_id bigint, text string, container string").withColumns({"grp": F.lit(1), "capacity": F.lit(2)})
    sizes = spark.createDataFrame([("s", 512), ("m", 2048), ("bad", 0), ("none", None)], "container string, capacity_tokens int")
    got = packing.pack(docs, sizes)
    one = got.where("container = 's'")
    assert one.where("doc_id = 1").agg(F.sum("tokens")).first()[0] == len(K.encoder().encode_ordinary("a b c " * 2000))
    assert one.where("doc_id = 2").count() == 1 and one.where("doc_id = 4").count() == 2 and one.where("doc_id is null").count() == 1
    report = {r["container"]: r.asDict() for r in packing.fill_report(got).collect()}
    assert set(report) == {"s", "m"} and report["s"]["n_containers"] == report["s"]["n_least"]
    two = packing.pack(docs, spark.createDataFrame([("s", 512), ("s", 2048)], "container string, capacity_tokens int"))
    assert sorted(r["capacity"] for r in packing.fill_report(two).collect()) == [512, 2048] and two.groupBy("container_no").agg(F.sum("tokens") + F.max("space_left")).distinct().count() > 2
    assert packing.pack(docs.where("false"), sizes).count() == 0 and packing.pack(docs, sizes.where("false")).count() == 0


def test_copies_of_one_row_are_spread_over_groups(spark):
    docs = spark.range(900).select(F.lit(None).cast("bigint").alias("doc_id"), F.lit("the same text").alias("text"))
    got = packing.pack(docs, spark.createDataFrame([("s", 64)], "container string, capacity_tokens int"), group_size=100)
    per = [r["count"] for r in got.groupBy(F.shiftright("container_no", 24)).count().collect()]
    assert len(per) == 9 and max(per) < 160 and got.count() == 900


def test_packing_fill(spark, data):
    got = packing.fill_report(packing.pack(spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/container_sizes.parquet")))
    assert got.where("share_filled < 0.9").count() == 0


TARGETS = "source_name string, target_share double, max_repeats int"


def test_mixing_shares(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, " BIG ").when(F.col("id") % 30 == 1, "small").when(F.col("id") % 50 == 2, None).otherwise("other").alias("source"), F.repeat(F.lit("word "), (F.col("id") % 40).cast("int") + 1).alias("text"), F.lit("clash").alias("tokens"))
    targets = spark.createDataFrame([("big", 0.5, 1), ("small", 0.3, 4), ("absent", 0.2, 2), ("zero", 0.0, 1)], TARGETS)
    uses, per = mixing.mix(docs, targets)
    got = {r["source"]: r.asDict() for r in mixing.share_report(uses, per).collect()}
    assert set(got) == {"big", "small", "absent"} and got["absent"]["tokens_used"] == 0
    assert abs(got["big"]["actual_share"] / got["small"]["actual_share"] - 5 / 3) < 0.02
    assert got["small"]["most_uses"] <= 4 and got["big"]["most_uses"] <= 1 and uses.count() == 3000
    low = uses.where("source = 'small'").agg(F.min("uses"), F.max("uses")).first()
    assert low[1] - low[0] <= 1


def test_registered_mix_draws_the_corpus(spark, tmp_path):
    """A tiny source stops at its repeats and shows its shortfall; it does not decide how much of the others is drawn."""
    docs = spark.range(1000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 5, "tiny").when(F.col("id") < 300, "small").otherwise("big").alias("source"), F.repeat(F.lit("word "), 20).alias("text"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([("big", 0.4, 1), ("small", 0.5, 2), ("tiny", 0.1, 1)], TARGETS).write.parquet(f"{tmp_path}/mix_targets.parquet")
    got = {r["source"]: r for r in registry.p9_shares(spark, str(tmp_path)).collect()}
    each = got["tiny"]["tokens_there"] / 5
    assert (got["tiny"]["n_used"], got["tiny"]["most_uses"], got["small"]["n_used"], got["small"]["most_uses"], got["big"]["n_used"]) == (5, 1, 295, 2, 400)
    assert got["tiny"]["tokens_short"] == pytest.approx(95 * each) and got["big"]["tokens_short"] == got["small"]["tokens_short"] == 0
    uses = registry.p9_uses(spark, str(tmp_path))
    assert uses.agg(F.sum("uses")).first()[0] == 905 and uses.where("source = 'small'").agg(F.min("uses")).first()[0] == 1


def test_mixing_budget_and_odd_rows(spark):
    docs = spark.createDataFrame([(1, "a", "one two"), (1, "a", "one two"), (2, "a", None), (3, "a", ""), (4, None, "x"), (None, "a", "null id")], "doc_id bigint, source string, text string")
    uses, per = mixing.mix(docs, spark.createDataFrame([("A ", 1.0, 3)], TARGETS), total_tokens=10**9)
    assert uses.where("source = 'a'").select("uses").distinct().collect()[0][0] == 3 and uses.where("source is null").first()["uses"] == 0
    uses, per = mixing.mix(docs.where("false"), spark.createDataFrame([("a", 1.0, 3)], TARGETS))
    assert uses.count() == 0 and mixing.share_report(uses, per).first()["tokens_used"] == 0
    assert mixing.mix(docs, spark.createDataFrame([], TARGETS))[0].agg(F.sum("uses")).first()[0] == 0


@pytest.mark.parametrize("edge_rows", [mixing.EDGE_ROWS, 3])
def test_prefix_is_exact(spark, edge_rows):
    """Sums in levels and stretches choose what one walk over the sorted source chooses, in one stretch or in many."""
    docs = spark.range(2000).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"), F.repeat(F.lit("word "), ((F.col("id") * 7) % 17).cast("int") + 3).alias("text"))
    uses, _ = mixing.mix(docs, spark.createDataFrame([("s", 1.0, 2)], TARGETS), total_tokens=5003, edge_rows=edge_rows)
    left, want = 5003, set()
    for r in mixing.sized(docs, "doc_id", "text", "source", K.VOCABULARY).orderBy("key", "row").collect():
        if r["tokens"] <= left:
            want.add(r["doc_id"])
            left -= r["tokens"]
    assert {r["doc_id"] for r in uses.where("uses > 0").collect()} == want and uses.count() == 2000


def test_rows_of_one_id_are_told_apart(spark):
    """Copies of one id share the first 40 bits of their keys; the level behind them parts the copies."""
    docs = spark.range(5000).select(F.lit(7).cast("bigint").alias("doc_id"), F.lit("s").alias("source"), F.lit("one two three four").alias("text"))
    uses, per = mixing.mix(docs, spark.createDataFrame([("s", 1.0, 1)], TARGETS), total_tokens=8001, edge_rows=50)
    assert uses.count() == 5000 and uses.agg(F.sum("uses")).first()[0] == 2000 and mixing.checks(uses, per).first()["filled"]


def test_odd_texts_are_drawn_late(spark):
    """The fitted weight is low for texts unlike the rest of their language; a given column takes its place."""
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 10 == 0, F.lit("<p>|<b>|{}</b>|</p>\n\n")).otherwise(F.concat(F.lit("A plain sentence with number "), F.col("id").cast("string"))).alias("text"), F.lit("en").alias("lang"), (F.col("id") / 400).alias("w"), F.lit("s").alias("source"))
    rows = mixing.fitted_quality(docs.mapInArrow(K.sizer("text", K.VOCABULARY, ("doc_id", "lang"), signals=True), "doc_id bigint, lang string, tokens bigint, signals array<double>"))
    odd, plain = (rows.where(c).agg(F.avg("quality")).first()[0] for c in ("doc_id % 10 = 0", "doc_id % 10 > 0"))
    assert odd < 0.6 * plain and rows.where("quality < 0.05 or quality > 1").count() == 0
    uses, _ = mixing.mix(docs, spark.createDataFrame([("s", 1.0, 1)], TARGETS), total_tokens=700, quality_col="w")
    assert uses.where("uses = 1 and doc_id >= 200").count() > 2 * uses.where("uses = 1 and doc_id < 200").count()


def test_long_document_does_not_end_a_source(spark):
    """A document longer than the budget at the head of the order is passed over."""
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"), F.repeat(F.lit("word "), F.when(F.col("id") % 3 == 0, 5000).otherwise(20)).alias("text"))
    uses, _ = mixing.mix(docs, spark.createDataFrame([("s", 1.0, 1)], TARGETS), total_tokens=70)
    assert uses.agg(F.sum(F.col("tokens") * F.col("uses"))).first()[0] >= 60


def test_features_are_defined():
    for text in ("", "...", "<p></p>", "One.", "a" * 100_000, "word " * 50_000, "1 2 3", "é ü 漢字"):
        f = reading.features(text)
        assert f.shape == (len(reading.NAMES),) and np.isfinite(f).all()


def test_trees_learn():
    rng = np.random.default_rng(1)
    x = rng.random((400, 6)).astype(np.float32)
    y = 1 + 3 * (x[:, 0] > 0.5) + x[:, 1]
    score = reading.cross_validated(x, y, rng.integers(0, 9, 400).astype(str))
    assert np.corrcoef(score, y)[0, 1] > 0.95
    flat = reading.BoostedTrees().fit(np.zeros((5, 6), np.float32), np.arange(5.0))
    assert (flat.predict(np.ones((3, 6), np.float32)) == 2.0).all()


def test_cut_points():
    rng = np.random.default_rng(2)
    level = rng.integers(1, 5, 400).astype(float)
    score = level + rng.normal(0, 0.1, 400)
    wrong = rng.random(400) < 0.05
    cuts = reading.cut_points(score, np.where(wrong, np.clip(level + rng.choice([-1, 1], 400), 1, 4), level))
    assert (np.abs(cuts - [1.5, 2.5, 3.5]) < 0.25).all() and (1 + np.searchsorted(cuts, score, "right") == level).mean() > 0.98


def test_reading_levels(spark):
    easy, hard = "The cat sat. The dog ran. It was a red ball. ", "Notwithstanding institutional heterogeneity, the operationalisation whereby jurisprudence conditions remuneration remains provisional. "
    rows = [(i, (easy if i % 2 else hard) * (8 + i % 5), "EN-us " if i % 3 else "en", f"s{i % 6}", 500) for i in range(80)] + [(100, easy * 10, "fr", "s", 500), (101, easy, "en", "s", 100), (102, None, "en", None, 500), (103, easy * 10, None, "s", 500)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").withColumns({"features": F.lit(1), "level": F.lit(1)})
    labels = spark.createDataFrame([(i, "r", 1 if i % 2 else 4) for i in range(40)] + [(0, "r2", 4), (1, "r", None), (999, "r", 2), (3, "r", 9)], "doc_id bigint, rater string, reading_level int")
    got = {r["doc_id"]: r["reading_level"] for r in reading.reading_levels(docs, labels).collect()}
    assert {i: got[i] for i in range(80)} == {i: 1 if i % 2 else 4 for i in range(80)} and set(got) == {*range(80), 102}
    assert reading.validation(docs, labels).agg(F.sum("n")).first()[0] == 40
    none = reading.reading_levels(docs, labels.where("false"))
    assert none.count() == 81 and none.where("reading_level is not null").count() == 0 and reading.validation(docs, labels.where("false")).count() == 0
    assert reading.reading_levels(docs.where("false"), labels).count() == 0
