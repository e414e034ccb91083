"""Near duplicates and overlaps: exactness on hand-made tables, hot groups, odd rows."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomtext.llm import neardup, overlap, prefix
from loomtext.llm import shingles as S

SCHEMA = "article_no bigint, id string, title string, text string, dataset string, split string, outlet string"


def words(n, seed):
    r = random.Random(seed)
    return [f"w{r.randrange(10_000)}" for _ in range(n)]


def edited(base, edits, seed):
    r, out = random.Random(seed), list(base)
    for _ in range(edits):
        out[r.randrange(len(out))] = f"e{r.randrange(10**9)}"
    return out


def brute_groups(rows, threshold, min_words, k=5):
    sets = {i: {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} for i, t in rows if t and len(w := S.WORD.findall(t.lower())) >= min_words}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sets, 2):
        n = len(sets[a] & sets[b])
        if n and n >= threshold * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in sets}


def test_pigeonhole_keeps_every_close_signature():
    """Any two signatures that differ in at most 23 of 48 symbols share a key, wherever the differences lie."""
    rows, numbers = S.neighbour_blocks(48, 4)
    rng = np.random.default_rng(1)
    for _ in range(300):
        a = rng.integers(0, 1 << 16, 48).astype(np.uint64)
        b = a.copy()
        b[rng.choice(48, 23, replace=False)] ^= np.uint64(1)
        assert set(S.keyed(a[rows], numbers).tolist()) & set(S.keyed(b[rows], numbers).tolist())


def test_groups_match_brute_force(spark):
    rows = []
    for g in range(60):
        base = words(random.Random(g).choice([40, 120, 300]), g)
        rows += [" ".join(edited(base, e, g * 10 + e)) for e in (0, 1, 3, 6, 9)]
    rows = list(enumerate(rows, 1))
    got = neardup.near_duplicate_groups(spark.createDataFrame(rows, "id bigint, text string"), "id", "text", threshold=0.6, min_words=30)
    assert {r["id"]: r["group_no"] for r in got.collect()} == brute_groups(rows, 0.6, 30)


def test_odd_rows(spark):
    t = " ".join(words(50, 1))
    rows = [(1, t, "x"), (2, t, "y"), (3, t.upper() + " !!", None), (4, None, ""), (5, "", ""), (6, "too short", ""), (7, " ".join(words(50, 2)), "")]
    df = spark.createDataFrame(rows, "n bigint, body string, digest string").withColumns({"rep": F.lit(1), "key": F.lit(2), "keys": F.lit(3), "id": F.lit("clash")})
    groups = neardup.near_duplicate_groups(df, "n", "body")
    got = {r["id"]: (r["rep"], r["group_no"], r["n_links"]) for r in neardup.link_counts(groups, df, "n", "body").collect()}
    assert got == {1: (1, 1, 0), 2: (1, 1, 0), 3: (1, 1, 0), 7: (7, 7, 0)}
    empty = neardup.near_duplicate_groups(df.where("false"), "n", "body")
    assert empty.count() == 0 and neardup.group_pairs(empty).count() == 0


def test_very_long_text(spark):
    base = words(60_000, 3)
    rows = [(1, " ".join(base)), (2, " ".join(edited(base, 900, 4)))]
    got = neardup.near_duplicate_groups(spark.createDataFrame(rows, "id bigint, text string"), "id", "text").collect()
    assert {r["group_no"] for r in got} == {1}


@pytest.mark.parametrize("dense", [2, 8, 1000])
def test_hot_bucket_keeps_groups_exact(spark, dense):
    """A third of the rows are different near-copies of one text; the groups are those of brute force whatever counts as a large bucket."""
    base = words(120, 5)
    rows = [" ".join(edited(base, 2, i)) for i in range(150)] + [" ".join(edited(base, 14, 1000 + i)) for i in range(20)] + [" ".join(words(120, 100 + i)) for i in range(280)]
    rows = list(enumerate(rows, 1))
    got = neardup.near_duplicate_groups(spark.createDataFrame(rows, "id bigint, text string"), "id", "text", threshold=0.6, dense=dense)
    assert {r["id"]: r["group_no"] for r in got.collect()} == brute_groups(rows, 0.6, 5)


def templated(n):
    """Texts of which half is one template: similarity 1/3, so none is linked; every 50th is a near-copy of the one before."""
    template, out = words(60, 1), []
    for i in range(n):
        own = words(60, 10_000 + i) if i % 50 or not i else edited(own, 1, i)
        out.append((i, " ".join(template + own)))
    return out


def test_templates_do_not_make_pairs(spark, monkeypatch):
    """Texts that share half their words meet in large buckets; candidates grow with their number, not with its square."""
    seen = []
    plain = neardup.across_candidates

    def counted(*args):
        out = plain(*args).cache()
        seen.append(out.count())
        return out

    monkeypatch.setattr(neardup, "across_candidates", counted)
    for n in (500, 1000, 2000):
        got = neardup.near_duplicate_groups(spark.createDataFrame(templated(n), "id bigint, text string"), "id", "text", threshold=0.6)
        linked = {r["id"]: r["group_no"] for r in got.collect()}
        assert linked == {i: i - 1 if i % 50 == 0 and i else i for i in range(n)}
    assert len(seen) == 3 and all(k <= n for k, n in zip(seen, (500, 1000, 2000)))


@pytest.mark.parametrize("threshold", [0.6, 0.8])
def test_prefixes_are_exact(spark, threshold):
    """Every pair at the threshold is among the candidates, between sets of any sizes."""
    rng = np.random.default_rng(5)
    sets = []
    for g in range(60):
        base = np.unique(rng.integers(0, 2**63, rng.integers(1, 80), np.uint64))
        for _ in range(4):
            keep = base[rng.random(len(base)) < rng.choice([0.7, 0.9, 1.0])]
            sets.append(np.unique(np.concatenate([keep, rng.integers(0, 2**63, rng.integers(0, 8), np.uint64)])))
    want = {(i, j) for i, j in itertools.combinations(range(len(sets)), 2) if (s := len(np.intersect1d(sets[i], sets[j]))) and s >= threshold * len(np.union1d(sets[i], sets[j]))}
    df = spark.createDataFrame([(i, s.view(np.int64).tolist(), i % 7) for i, s in enumerate(sets)], "id bigint, sh array<bigint>, c int")
    got = {(r["a"], r["b"]) for r in prefix.prefix_pairs(df, threshold, {"c": "int"}, F.lit(True), lambda x, y: F.lit(True)).collect()}
    assert want <= got and len(want) > 40
    apart = {(r["a"], r["b"]) for r in prefix.prefix_pairs(df, threshold, {"c": "int"}, F.min("c") != F.max("c"), lambda x, y: F.col(x + "c") != F.col(y + "c")).collect()}
    assert apart == {(a, b) for a, b in got if a % 7 != b % 7}


def brute_links(rows, threshold, min_words, k=5):
    sets = {i: {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} for i, t in rows if len(w := S.WORD.findall(t.lower())) >= min_words}
    n = dict.fromkeys(sets, 0)
    for a, b in itertools.combinations(sets, 2):
        if len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]):
            n[a] += 1
            n[b] += 1
    return n


@pytest.mark.parametrize("block_rows", [2048, 40])
def test_hot_bucket_counts_all_links(spark, monkeypatch, block_rows):
    """Every link of near-copies whose keys are all hot is counted, in one block and across blocks."""
    monkeypatch.setattr(neardup, "BLOCK_ROWS", block_rows, raising=False)
    base = words(120, 5)
    rows = [" ".join(edited(base, 1 + i % 3, i)) for i in range(150)] + [" ".join(edited(base, 9, 1000 + i)) for i in range(20)] + [" ".join(words(120, 100 + i)) for i in range(100)]
    rows = list(enumerate(rows, 1))
    df = spark.createDataFrame(rows, "id bigint, text string")
    got = neardup.link_counts(neardup.near_duplicate_groups(df, "id", "text", threshold=0.8, dense=8), df, "id", "text")
    assert {r["id"]: r["n_links"] for r in got.collect()} == brute_links(rows, 0.8, 5)


def test_shared_counts():
    """The product of common columns and the expanded rare ones add up to the plain intersections."""
    rng = np.random.default_rng(3)
    common, rare = rng.integers(0, 2**63, 60, np.uint64), rng.integers(0, 2**63, 3000, np.uint64)
    a, b = ([np.unique(np.concatenate([rng.choice(common, 40), rng.choice(rare, 30)])) for _ in range(n)] for n in (90, 70))
    assert (neardup._shared(a, b) == [[len(np.intersect1d(x, y)) for y in b] for x in a]).all()


def test_hot_exact_copies(spark):
    t = " ".join(words(80, 6))
    df = spark.range(9000).select("id", F.when(F.col("id") % 3 == 0, F.lit(t)).otherwise(F.concat_ws(" ", *[F.md5(F.concat(F.col("id").cast("string"), F.lit(str(i)))) for i in range(10)])).alias("text"))
    got = neardup.near_duplicate_groups(df, "id", "text")
    assert got.where("group_no = 0").count() == 3000 and got.select("group_no").distinct().count() == 6001


@pytest.fixture(scope="module")
def articles(spark):
    base = words(100, 7)
    text = " ".join(base)
    rows = [
        (1, "007", "One two three four five", text, "primary", "train", " Times "),
        (2, "x1", None, text, "primary", "test", "times"),
        (3, "x2", "", " ".join(edited(base, 5, 1)), "secondary", "heldout", None),
        (4, " 7.0", "Other", "short text", "primary", "val", "b"),
        (5, "7", "Other", None, "secondary", "heldout", "b"),
        (6, None, "one TWO, three four-five", "tiny", "primary", "val", "c"),
        (7, None, "one two three four", "tiny", "primary", "val", "c"),
        (8, "", "five four three two one", None, "primary", "train", "d"),
        (9, "", None, "", "primary", "test", "d"),
        (10, "x1", "One two three four five", text, "primary", "dev", "e"),
        (11, "x3", None, " ".join(words(100, 8)), "primary", "test", "d"),
    ]
    return spark.createDataFrame(rows, SCHEMA)


def test_overlap_reasons(articles):
    df = articles.withColumns({"train": F.lit("clash"), "key": F.lit(0), "rep": F.lit(0)})
    got = sorted((r["t"], r["e"], r["reason"]) for r in overlap.overlaps(df, threshold=0.6).collect())
    assert got == [(1, 2, "text"), (1, 3, "text"), (1, 4, "id"), (1, 6, "title")]
    assert overlap.overlaps(articles.where("false")).count() == 0


@pytest.mark.parametrize("dense", [1, 1000])
def test_overlap_of_templates(spark, dense):
    """Rows of one template meet in large blocks; the pairs are those of brute force whatever counts as large."""
    base, rows = words(80, 9), []
    for i in range(160):
        text = edited(base, 2, i) if i % 8 == 0 else words(50, 1) + words(60, 20_000 + i // 2)
        rows.append((i, f"n{i}", None, " ".join(text), "primary", "train" if i % 2 else ("test" if i % 3 else "val"), "o"))
    sets = {r[0]: {tuple(w[j : j + 5]) for j in range(len(w) - 4)} for r in rows for w in [r[3].split()]}
    want = {(t, e) for t in sets for e in sets if rows[t][5] == "train" != rows[e][5] and len(sets[t] & sets[e]) >= 0.6 * len(sets[t] | sets[e])}
    got = {(r["t"], r["e"]) for r in overlap.overlaps(spark.createDataFrame(rows, SCHEMA), threshold=0.6, dense=dense).collect()}
    assert got == want and len(want) >= 60


def test_overlap_report(articles):
    got = {(r["reason"], r["split"], r["outlet"]): (r["n_rows"], r["n_hit"], r["n_pairs"]) for r in overlap.overlap_report(articles, 0.6).collect()}
    assert got == {("text", "test", "times"): (1, 1, 1), ("text", "heldout", None): (1, 1, 1), ("id", "val", "b"): (1, 1, 1), ("title", "val", "c"): (2, 1, 1)}


def test_fingerprint_radius_keeps_similar_texts():
    """Texts of similarity 0.6 to 1 share a code block and lie inside the radius."""
    xors, odds = S._permutations(overlap.SYMBOLS, overlap.SEED)
    rows, numbers = S.permuted_blocks(overlap.SYMBOLS, overlap.SEGMENT, overlap.ROUNDS, overlap.SEED)
    seen = 0
    for i in range(1500):
        base = words(80, i)
        a, b = (S.shingles(S.word_hashes(" ".join(w)), 5) for w in (base, edited(base, 3, i)))
        j = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        if j < 0.6:
            continue
        seen += 1
        x, y = S.minwise(a, xors, odds), S.minwise(b, xors, odds)
        assert set(S.keyed(x[rows], numbers).tolist()) & set(S.keyed(y[rows], numbers).tolist())
        assert sum(int(p ^ q).bit_count() for p, q in zip(x.tolist(), y.tolist())) <= overlap.RADIUS
    assert seen > 300
