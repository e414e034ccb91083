"""Count-Min sketches and Bloom filters as tables, mergeable by union and sum."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import hash60


def cms_cells(counts: DataFrame, item: str = "item", n: str = "n", width: int = 4096, depth: int = 6) -> DataFrame:
    """(d, k, s): the non-zero cells of a Count-Min sketch of pre-aggregated counts.

    Null items are left out. Cells of two sketches of the same size add up to
    the sketch of both inputs.
    """
    rows = counts.where(F.col(item).isNotNull())
    cells = rows.select(F.col(n).alias("n"), F.posexplode(F.array(*[F.pmod(hash60(d, F.col(item)), F.lit(width)) for d in range(depth)])).alias("d", "k"))
    return cells.groupBy("d", "k").agg(F.sum("n").cast("bigint").alias("s"))


def merge_cells(*sketches: DataFrame) -> DataFrame:
    out = sketches[0]
    for s in sketches[1:]:
        out = out.unionByName(s)
    return out.groupBy("d", "k").agg(F.sum("s").alias("s"))


def cms_estimates(cells: DataFrame, items: DataFrame, item: str = "item", width: int = 4096, depth: int = 6) -> DataFrame:
    """(item, estimate) of each distinct candidate item: the least of its cells, 0 where a cell is missing.

    A sketch has at most width * depth cells, so it is broadcast below 1 M of
    them and joined by shuffle above.
    """
    probe = items.select(F.col(item).alias("item")).where("item is not null").distinct()
    probe = probe.select("item", F.posexplode(F.array(*[F.pmod(hash60(d, F.col("item")), F.lit(width)) for d in range(depth)])).alias("d", "k"))
    small = F.broadcast(cells) if width * depth <= 1 << 20 else cells
    return probe.join(small, ["d", "k"], "left").groupBy("item").agg(F.min(F.coalesce("s", F.lit(0))).cast("bigint").alias("estimate"))


def bloom_size(capacity: int, fp_rate: float) -> tuple[int, int]:
    """Bits and hashes for a capacity and a rate of false positives."""
    bits = -capacity * math.log(fp_rate) / math.log(2) ** 2 if capacity else 0.0
    hashes = bits / capacity * math.log(2) if capacity else 0.0
    return max(8, math.ceil(bits)), max(1, round(hashes))


def _positions(items: DataFrame, bits: int, hashes: int) -> DataFrame:
    return items.select("item", F.explode(F.array(*[F.pmod(hash60(i, F.col("item")), F.lit(bits)) for i in range(hashes)])).alias("bit"))


def bloom_bits(items: DataFrame, bits: int, hashes: int, item: str = "item") -> DataFrame:
    """(bit): the positions set by the items; the union of two filters' positions is the filter of both."""
    return _positions(items.select(F.col(item).alias("item")).where("item is not null").distinct(), bits, hashes).select("bit").distinct()


def bloom_contains(filter_bits: DataFrame, items: DataFrame, bits: int, hashes: int, item: str = "item") -> DataFrame:
    """(item, maybe): whether all positions of each distinct item are set; never false for a member."""
    probe = _positions(items.select(F.col(item).alias("item")).where("item is not null").distinct(), bits, hashes).distinct()
    hits = probe.join(filter_bits.withColumn("hit", F.lit(1)), "bit", "left")
    return hits.groupBy("item").agg((F.count("hit") == F.count("*")).alias("maybe"))
