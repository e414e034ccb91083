"""Keywords by random walk over the co-occurrence graph of each document."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X


def cooccurrence(docs: DataFrame, window: int = 4, pattern: str = X.DASHED) -> DataFrame:
    """(id, a, b, weight) with a < b: how often two different tokens lie at most `window` positions apart. Counted inside the row, nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, a, b, n = [], [], [], []
            for i, t in zip(batch.column("id").to_pylist(), batch.column("t").to_pylist()):
                pairs = Counter((x, y) if x < y else (y, x) for k in range(1, window + 1) for x, y in zip(t, t[k:]) if x != y)
                ids += [i] * len(pairs)
                a += [x for x, _ in pairs]
                b += [y for _, y in pairs]
                n += pairs.values()
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string()), pa.array(n, pa.int64())], ["id", "a", "b", "weight"])

    return docs.select("id", X.tokens(X.ascii_only(F.col("text")), pattern).alias("t")).mapInArrow(run, "id bigint, a string, b string, weight bigint")


def rank_tokens(tokens: list[str], window: int, iterations: int, damping: float, prior: dict[str, float] | None = None) -> list[tuple[str, float]]:
    """(token, score) by falling score, ties by first use; nothing where all tokens are the same.

    The walk starts evenly, or in proportion to the prior weights, 1 for tokens without one.
    """
    first: dict[str, int] = {}
    code = np.fromiter((first.setdefault(t, len(first)) for t in tokens), np.int64, len(tokens))
    n = len(first)
    pairs = [np.stack([code[:-k], code[k:]]) for k in range(1, window + 1) if k < len(code)]
    if not pairs:
        return []
    x, y = np.concatenate(pairs, axis=1)
    apart = x != y
    if not apart.any():
        return []
    key = np.concatenate([x[apart] * n + y[apart], y[apart] * n + x[apart]])
    edge, weight = np.unique(key, return_counts=True)
    to, frm = edge // n, edge % n
    out = np.bincount(frm, weight, n)
    used = out > 0
    m = int(used.sum())
    start = np.array([prior.get(t, 1.0) for t in first]) if prior is not None else np.ones(n)
    score = np.where(used, start / start[used].sum(), 0.0)
    share = weight / out[frm]
    for _ in range(iterations):
        new = np.where(used, (1 - damping) / m + damping * np.bincount(to, share * score[frm], n), 0.0)
        done = np.allclose(new, score, atol=1e-6)
        score = new
        if done:
            break
    names = list(first)
    return [(names[i], float(score[i])) for i in np.lexsort((np.arange(n), -score)) if used[i]]


def textrank(docs: DataFrame, top_k: int = 15, window: int = 4, iterations: int = 20, damping: float = 0.85, prior: DataFrame | None = None) -> DataFrame:
    """(id, rank, keyword, score): the top_k keywords of each document; documents without two different tokens give no row.

    prior: (token, idf) of a fitted table, which its max_features bounds; it goes to every task.
    """
    weights = {r[0]: r[1] for r in prior.select("token", "idf").collect()} if prior is not None else None


    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(i, k, w, s) for i, t in zip(b.column("id").to_pylist(), b.column("t").to_pylist()) for k, (w, s) in enumerate(rank_tokens(t, window, iterations, damping, weights)[:top_k], 1)]
            cols = list(zip(*rows)) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.string(), pa.float64()))], ["id", "rank", "keyword", "score"])

    return docs.select("id", X.tokens(X.ascii_only(F.col("text")), X.DASHED).alias("t")).mapInArrow(run, "id bigint, rank int, keyword string, score double")
