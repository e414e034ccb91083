"""Exact candidates of a set-similarity join by prefixes, for buckets too large to be expanded into pairs.

Shingles are put in one global order, rare ones first. Two sets of similarity
t or more share a shingle within the first |x| - ceil(t |x|) + 1 of the larger
and the first |y| - ceil(2 t / (1 + t) |y|) + 1 of the smaller, so joining
these prefixes finds every such pair. Shingles that many texts share (a
template, an imprint) lie behind the prefix of any text whose own part is
large enough to keep it under t, so texts that only share boilerplate meet
nobody, and the work grows with the number of texts.

Any one order keeps the join exact; a good one needs frequencies. These are
counted in CELLS hashed cells, a table of fixed size whatever the input, which
goes to the tasks as one array.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CELL_BITS = 18
CELLS = 1 << CELL_BITS


def _cells(sh: np.ndarray) -> np.ndarray:
    return (sh >> np.uint64(64 - CELL_BITS)).astype(np.int64)


def _values(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """All shingles of a batch and where each row's begin."""
    lists = batch.column("sh")
    offsets = lists.offsets.to_numpy()
    return lists.values.to_numpy()[offsets[0] : offsets[-1]].view(np.uint64), offsets - offsets[0]


def _histogram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(CELLS, np.int64)
    for b in batches:
        total += np.bincount(_cells(_values(b)[0]), minlength=CELLS)
    used = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["cell", "n"])


def frequencies(sets: DataFrame) -> np.ndarray:
    """How many shingles of `sets` (sh) fall in each of the CELLS cells."""
    rows = sets.select("sh").mapInArrow(_histogram, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()  # CELLS rows at most
    out = np.zeros(CELLS, np.int64)
    out[rows["cell"].to_numpy()] = rows["n"].to_numpy()
    return out


def lengths(n: int, threshold: float) -> tuple[int, int]:
    """Prefix lengths of a set of n shingles as the smaller and as the larger of a pair."""
    need = lambda share: int(np.ceil(share * n - 1e-9))
    return max(0, n - need(2 * threshold / (1 + threshold)) + 1), max(0, n - need(threshold) + 1)


def _prefixes(order: np.ndarray, threshold: float, carry: tuple[str, ...]) -> Callable:
    """mapInArrow function to (s, id, carried columns, n, at, small): the prefix of each set; at is the place, small whether it lies in the shorter prefix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values, ends = _values(b)
            s, of, at, size, small = [], [], [], [], []
            for i in range(b.num_rows):
                own = values[ends[i] : ends[i + 1]]
                few, more = lengths(len(own), threshold)
                if not len(own):
                    continue
                first = own[np.lexsort((own, order[_cells(own)]))[:more]]
                s.append(first)
                of.append(np.full(len(first), i))
                at.append(np.arange(len(first)))
                size.append(np.full(len(first), len(own)))
                small.append(np.arange(len(first)) < few)
            if not s:
                continue
            rows = pa.array(np.concatenate(of))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(s).view(np.int64)), *(b.column(c).take(rows) for c in ("id", *carry)), pa.array(np.concatenate(size).astype(np.int32)), pa.array(np.concatenate(at).astype(np.int32)), pa.array(np.concatenate(small))],
                ["s", "id", *carry, "n", "at", "small"],
            )

    return run


def prefix_pairs(sets: DataFrame, threshold: float, carry: dict[str, str], met: Column, apart: Callable[[str, str], Column]) -> DataFrame:
    """(a, b), a < b: every pair of `sets` (id, sh, carried columns) that may reach the threshold, of those for which `apart` holds.

    carry: carried columns and their types. met: an aggregate over the rows of
    one shingle that is false where no two of them are apart, so those shingles
    are left out first. apart: the condition on a pair, from the prefixes of
    the names of the carried columns of either side.
    """
    schema = ", ".join(["s bigint", "id bigint", *(f"{c} {t}" for c, t in carry.items()), "n int", "at int", "small boolean"])
    rows = sets.select("id", "sh", *carry).mapInArrow(_prefixes(frequencies(sets), threshold, tuple(carry)), schema)
    useful = rows.groupBy("s").agg(met.alias("met"), F.count("*").alias("k")).where("met and k > 1").select("s")
    rows = rows.join(useful, "s")
    side = lambda p: rows.select("s", *[F.col(c).alias(p + c) for c in ("id", "n", "at", "small", *carry)])
    x, y = side("x_"), side("y_").where("y_small")
    larger = (F.col("y_n") < F.col("x_n")) | ((F.col("y_n") == F.col("x_n")) & (F.col("y_id") < F.col("x_id")))
    sizes = F.col("y_n") >= F.col("x_n") * threshold - 1e-9
    # shingles that can still be shared from here on; holds at the first one that a pair shares
    rest = F.least(F.col("x_n") - F.col("x_at"), F.col("y_n") - F.col("y_at")) >= (F.col("x_n") + F.col("y_n")) * (threshold / (1 + threshold)) - 1e-9
    pairs = y.join(x, "s").where(larger & sizes & rest & apart("x_", "y_"))
    return pairs.select(F.least("x_id", "y_id").alias("a"), F.greatest("x_id", "y_id").alias("b")).distinct()
