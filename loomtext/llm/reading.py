"""Problem 10: reading level of each document.

Every text becomes one row of features: distributions of word and sentence
length, vocabulary (variety, suffix classes), syntax (rates of function words
and punctuation) and cohesion (words shared by neighbouring sentences). Boosted
regression trees are fitted to the raters' levels of a bounded sample of
labelled documents; predictions for held-out sources set the cut points
between the grades. Texts are read once; only the sample reaches the driver.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import scratch

#: Labelled documents the trees are fitted to at most.
MAX_LABELLED = 8_000
#: Closed-class words of English whose rates describe the syntax.
FUNCTION_WORDS = (
    "the a an this that these those my our your his her its their it we they he she i you who whose whom which what why where when how "
    "and or but nor neither either because although though while whereas wherein whereby insofar unless until since if then than as so such "
    "of in on at by for from to with within without under upon over after before against between across into near about through toward "
    "is are was were be been being has have had do does did can could may might must shall should will would "
    "not no only also thereby therefore thus hence however moreover notwithstanding pursuant absent merely largely yet still now one two some any every each all both many much more most "
    "subject according said told asked say"
).split()
_SUFFIXES = (("tion", "sion", "ment", "ity", "ance", "ence", "ism", "ness", "ship"), ("ed",), ("ly",), ("ing",), ("ive", "ous", "ial", "ical", "ary", "able", "ible", "ent", "ant"), ("ise", "ize", "ised", "ized", "ify"))
_TOKEN = re.compile(r"[a-z]+(?:['’][a-z]+)?|[.!?…]+(?=[\s\"”)<]|$)|[,;:\"“?]|\n+|[0-9]+")
_TAG = re.compile(r"<[^<>]{1,80}>")
_MARKS = {",": 0, ";": 1, ":": 1, '"': 2, "“": 2}

NAMES = (
    ["log_words", "len_mean", "len_sd", "len_p10", "len_p50", "len_p90", "share_7", "share_10", "share_13", "sent_mean", "sent_sd", "sent_p10", "sent_p50", "sent_p90", "variety", "once", "comma", "colon", "quote", "question", "number", "overlap", "overlap_zero", "repeat"]
    + [f"suffix_{i}" for i in range(len(_SUFFIXES))]
    + [f"word_{w}" for w in FUNCTION_WORDS]
)


class _Codes(dict):
    """Word to length, suffix class and function-word number, packed; emptied when it grows past a bound."""

    own = {w: i + 1 for i, w in enumerate(FUNCTION_WORDS)}

    def __missing__(self, w: str) -> int:
        if len(self) > 500_000:
            self.clear()
        suffix = next((i + 1 for i, s in reversed(list(enumerate(_SUFFIXES))) if len(w) > 4 and w.endswith(s)), 0)
        code = self[w] = min(len(w), 30) | suffix << 5 | self.own.get(w, 0) << 8
        return code


_CODES = _Codes()


def features(text: str) -> np.ndarray:
    """Feature vector of a whole text; zeros where there are no words."""
    out = np.zeros(len(NAMES), np.float32)
    if "<" in text:
        text = _TAG.sub("\n", text)
    words: list[str] = []
    ends, marks = [], [0, 0, 0, 0, 0]
    for t in _TOKEN.findall(text.lower()):
        c = t[0]
        if c.isalpha():
            words.append(t)
        elif c in ".!?…\n":
            if c == "?":
                marks[3] += 1
            ends.append(len(words))
        elif c.isdigit():
            marks[4] += 1
        else:
            marks[_MARKS[c]] += 1
    n = len(words)
    if not n:
        return out
    codes = np.fromiter(map(_CODES.__getitem__, words), np.int64, n)
    length = codes & 31
    of_length = np.bincount(length, minlength=32)
    cum = np.cumsum(of_length) / n
    stops = np.unique(np.array([0, *ends, n]))
    sent = np.sort(np.diff(stops))
    sets = [set(words[a:b]) for a, b in zip(stops[:-1].tolist(), stops[1:].tolist())]
    shared = np.array([len(x & y) / min(len(x), len(y)) for x, y in zip(sets, sets[1:])]) if len(sets) > 1 else np.zeros(1)
    _, seen = np.unique(np.array([hash(w) for w in words]), return_counts=True)
    q = lambda p: sent[min(len(sent) - 1, int(p * len(sent)))]
    head = [np.log1p(n), length.mean(), length.std(), np.searchsorted(cum, 0.1), np.searchsorted(cum, 0.5), np.searchsorted(cum, 0.9), 1 - cum[6], 1 - cum[9], 1 - cum[12]]
    head += [sent.mean(), sent.std(), q(0.1), q(0.5), q(0.9), len(seen) / np.sqrt(n), (seen == 1).sum() / n]
    head += [m / n for m in marks] + [shared.mean(), (shared == 0).mean(), seen.max() / n]
    out[: len(head)] = head
    k = len(head)
    suffix = np.bincount(codes >> 5 & 7, minlength=len(_SUFFIXES) + 1)[1:]
    out[k : k + len(_SUFFIXES)] = suffix / n
    out[k + len(_SUFFIXES) :] = np.bincount(codes >> 8, minlength=len(FUNCTION_WORDS) + 1)[1:] / n
    return out


def _featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [features(t or "") for t in b.column("text").to_pylist()]
        flat = np.concatenate(rows) if rows else np.empty(0, np.float32)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, len(NAMES), dtype=np.int32)), pa.array(flat))
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("source"), lists], ["doc_id", "source", "features"])


class BoostedTrees:
    """Least-squares gradient boosting of histogram trees."""

    def __init__(self, trees: int = 300, depth: int = 3, rate: float = 0.05, bins: int = 32, leaf: int = 4, share: float = 0.7, columns: float = 0.4, seed: int = 3):
        self.trees, self.depth, self.rate, self.bins, self.leaf = trees, depth, rate, bins, leaf
        self.share, self.columns, self.seed = share, columns, seed

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        rng = np.random.default_rng(self.seed)
        grid = np.linspace(0, 1, self.bins + 1)[1:-1]
        self.cuts = [np.unique(np.quantile(x[:, j], grid)) for j in range(x.shape[1])]
        binned = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(self.cuts)], axis=1).astype(np.int32)
        self.base, self.nodes = float(y.mean()), []
        at = np.full(len(y), self.base)
        usable = np.array([j for j, c in enumerate(self.cuts) if len(c) > 0 and c[0] < x[:, j].max()])
        for _ in range(self.trees if len(usable) else 0):
            rows = rng.random(len(y)) < self.share
            cols = rng.choice(usable, max(1, int(self.columns * len(usable))), replace=False)
            split, value = self._tree(binned, y - at, rows, cols)
            self.nodes.append((split, value))
            at += self.rate * value[self._leaf(binned, split)]
        return self

    def _tree(self, binned: np.ndarray, gap: np.ndarray, rows: np.ndarray, cols: np.ndarray):
        """Splits (column, bin) of a complete tree in heap order, and the values of its leaves."""
        inner = 2**self.depth - 1
        split = np.full((inner, 2), [0, self.bins + 1], np.int32)
        own = np.flatnonzero(rows)
        node = np.zeros(len(own), np.int64)
        b, g = binned[own], gap[own]
        offset = np.arange(len(cols)) * self.bins
        picked, weight = b[:, cols] + offset, np.repeat(g, len(cols))
        for level in range(self.depth):
            width, first = 2**level, 2**level - 1
            per = len(cols) * self.bins
            key = ((node - first)[:, None] * per + picked).ravel()
            s = np.bincount(key, weight, width * per).reshape(width, len(cols), self.bins).cumsum(axis=2)
            c = np.bincount(key, minlength=width * per).reshape(width, len(cols), self.bins).cumsum(axis=2)
            st, ct = s[:, :, -1:], c[:, :, -1:]
            ok = (c >= self.leaf) & (ct - c >= self.leaf)
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = np.where(ok, s**2 / c + (st - s) ** 2 / (ct - c) - st**2 / ct, 0).reshape(width, per)
            at = gain.argmax(axis=1)
            better = gain[np.arange(width), at] > 1e-9
            split[first : first + width][better] = np.stack([cols[at // self.bins], at % self.bins], axis=1)[better]
            node = 2 * node + 1 + (b[np.arange(len(own)), split[node, 0]] > split[node, 1])
        leaf = node - inner
        total = np.bincount(leaf, g, 2**self.depth)
        return split, total / (np.bincount(leaf, minlength=2**self.depth) + 1.0)

    def _leaf(self, binned: np.ndarray, split: np.ndarray) -> np.ndarray:
        node = np.zeros(len(binned), np.int64)
        rows = np.arange(len(binned))
        for _ in range(self.depth):
            node = 2 * node + 1 + (binned[rows, split[node, 0]] > split[node, 1])
        return node - len(split)

    def predict(self, x: np.ndarray) -> np.ndarray:
        binned = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(self.cuts)], axis=1).astype(np.int32)
        out = np.full(len(x), self.base)
        for split, value in self.nodes:
            out += self.rate * value[self._leaf(binned, split)]
        return out


def cut_points(score: np.ndarray, level: np.ndarray, levels: int = 4) -> np.ndarray:
    """Scores at which the grade rises, each the middle of the stretch of cuts that put most labels on their side."""
    cuts = []
    for k in range(1, levels):
        upper = level >= k + 0.5
        order = np.argsort(score, kind="stable")
        wrong = np.concatenate([[0], np.cumsum(upper[order])]) + np.concatenate([np.cumsum(~upper[order][::-1])[::-1], [0]])
        edge = np.concatenate([[score.min() - 1], (score[order][1:] + score[order][:-1]) / 2, [score.max() + 1]])
        near = np.flatnonzero(wrong <= wrong.min() + 0.5 * np.sqrt(wrong.min()))  # raters err, so cuts a label or two worse are as good
        cuts.append(float(np.clip((edge[near[0]] + edge[near[-1]]) / 2, k + 0.1, k + 0.9)))
    return np.maximum.accumulate(np.array(cuts))


def folds_of(source: np.ndarray, folds: int = 5) -> np.ndarray:
    """Fold of each row; a source lies in one fold, and folds are about as large."""
    names, at = np.unique(source, return_inverse=True)
    size = np.bincount(at)
    load, fold_of = np.zeros(folds), np.zeros(len(names), int)
    for s in np.argsort(-size, kind="stable"):
        fold_of[s] = load.argmin()
        load[fold_of[s]] += size[s]
    return fold_of[at]


def cross_validated(x: np.ndarray, y: np.ndarray, source: np.ndarray, folds: int = 5) -> np.ndarray:
    """Scores of every row by trees that saw no row of its source."""
    fold, out = folds_of(source, folds), np.full(len(y), y.mean())
    for f in range(folds):
        held = fold == f
        if held.any() and not held.all():
            out[held] = BoostedTrees().fit(x[~held], y[~held]).predict(x[held])
    return out


def eligible(lang: Column, n_chars: Column) -> Column:
    code = F.lower(F.trim(lang))
    return ((code == "en") | code.startswith("en-")) & (n_chars >= 400)


def _labelled(table: DataFrame, labels: DataFrame, max_labelled: int):
    """(features, mean level, source) of at most max_labelled labelled documents, chosen by a hash of the id."""
    mean = labels.where("reading_level between 1 and 4 and doc_id is not null").groupBy("doc_id").agg(F.avg("reading_level").alias("level"))
    rows = table.join(mean, "doc_id").orderBy(F.xxhash64("doc_id")).limit(max_labelled).select("doc_id", "source", "features", "level").toPandas()
    rows = rows.sort_values("doc_id", kind="stable")
    if not len(rows):
        return None
    return np.stack(rows["features"].to_numpy()), rows["level"].to_numpy(float), rows["source"].fillna("").to_numpy(str)


def feature_table(docs: DataFrame) -> DataFrame:
    """(doc_id, source, features) of the English documents of 400 characters or more, written once."""
    rows = docs.where(eligible(F.col("lang"), F.col("n_chars"))).select(F.col("doc_id").cast("bigint").alias("doc_id"), F.lower(F.trim("source")).alias("source"), "text")
    return scratch.keep(scratch.spread(rows).mapInArrow(_featurise, "doc_id bigint, source string, features array<float>"), "features")


def _grader(model: BoostedTrees, cuts: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = b.column("features").values.to_numpy().reshape(-1, len(NAMES))[: b.num_rows] if b.column("features").offset == 0 else np.stack(b.column("features").to_pylist())
            score = model.predict(x)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(score), pa.array((1 + np.searchsorted(cuts, score, "right")).astype(np.int32))], ["doc_id", "score", "reading_level"])

    return run


def reading_levels(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """(doc_id, score, reading_level) of every English document of 400 characters or more; levels run from 1 to 4.

    Documents in other languages, with a null language or length, or shorter
    give no row; a null text counts as one without words. Several labels of a
    document are averaged; labels that are null, outside 1 to 4 or of documents
    that are not eligible are ignored, and with none left scores and levels are
    null. Rows of one id are graded each. Other columns are ignored. An empty
    table of documents gives an empty result.
    """
    table = feature_table(docs)
    known = _labelled(table, labels, max_labelled)
    if known is None:
        return table.select("doc_id", F.lit(None).cast("double").alias("score"), F.lit(None).cast("int").alias("reading_level"))
    x, y, source = known
    cuts = cut_points(cross_validated(x, y, source), y)
    return table.mapInArrow(_grader(BoostedTrees().fit(x, y), cuts), "doc_id bigint, score double, reading_level int")


def validation(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """(source, n, share_right, share_within_1, mean_error) of held-out grades against the raters' levels, by source; no rows without labels. Neither the trees nor the cut points saw a row of the source they grade."""
    schema = T.StructType([T.StructField("source", T.StringType()), T.StructField("n", T.LongType()), *(T.StructField(c, T.DoubleType()) for c in ("share_right", "share_within_1", "mean_error"))])
    known = _labelled(feature_table(docs), labels, max_labelled)
    if known is None:
        return docs.sparkSession.createDataFrame([], schema)
    x, y, source = known
    score = cross_validated(x, y, source)
    fold, grade = folds_of(source), np.ones(len(y), np.int64)
    for f in np.unique(fold):
        held = fold == f
        seen = ~held if (~held).any() else held  # one source alone has no other to learn cuts from
        grade[held] = 1 + np.searchsorted(cut_points(score[seen], y[seen]), score[held], "right")
    rows = []
    for s in np.unique(source):
        own = source == s
        off = grade[own] - y[own]
        rows.append((str(s), int(own.sum()), float((np.abs(off) <= 0.5).mean()), float((np.abs(off) <= 1).mean()), float(off.mean())))
    return docs.sparkSession.createDataFrame(rows, schema)
