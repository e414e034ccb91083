"""Problem 8: filling containers of fixed capacity.

First-fit decreasing inside groups of documents drawn at random by a hash of
the row's number, so that repeated ids and texts spread like any others. A group holds about `group_size` documents however large
the table is, so every task is bounded and the unused space, which comes from
the last containers of a group, is a fixed small share. The first container
with room is found in a tournament tree over the room left, in logarithmic
time.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import scratch
from . import tokens as K

GROUP_SIZE, SEED = 4096, 17
_BITS = 24


class Tournament:
    """Room left in open containers; a node holds the most room below it."""

    def __init__(self, leaves: int, capacity: int):
        self.base = 1 << max(0, (leaves - 1).bit_length())
        self.room = [capacity] * (2 * self.base)

    def place(self, size: int) -> int:
        """Number of the first container with room for size, whose room shrinks."""
        room, at = self.room, 1
        while at < self.base:
            at *= 2
            if room[at] < size:
                at += 1
        leaf = at - self.base
        room[at] -= size
        at >>= 1
        while at:
            left, right = room[2 * at], room[2 * at + 1]
            most = left if left > right else right
            if room[at] == most:
                break
            room[at] = most
            at >>= 1
        return leaf


def first_fit_decreasing(ids: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, ...]:
    """(position, piece, size, container, room left) of every piece.

    An item over the capacity is cut into full pieces, which take a container
    each, and a rest; no other item is cut. Ties are placed by id.
    """
    full, rest = sizes // capacity, sizes % capacity
    cut = np.flatnonzero((rest > 0) | (full == 0))
    order = cut[np.lexsort((ids[cut], -rest[cut]))]
    tree = Tournament(max(1, len(order)), capacity)
    into = np.fromiter((tree.place(s) for s in rest[order].tolist()), np.int64, len(order))
    room = np.asarray(tree.room[tree.base :], np.int64)[into]
    whole = np.repeat(np.arange(len(sizes)), full)
    piece = np.arange(len(whole)) - np.repeat(np.cumsum(full) - full, full)
    first = int(into.max()) + 1 if len(into) else 0
    return (
        np.concatenate([whole, order]),
        np.concatenate([piece, full[order]]),
        np.concatenate([np.full(len(whole), capacity), rest[order]]),
        np.concatenate([first + np.arange(len(whole)), into]),
        np.concatenate([np.zeros(len(whole), np.int64), room]),
    )


_OUT = "container string, doc_id bigint, piece int, tokens bigint, container_no bigint, space_left bigint"


def _pack(t: pa.Table) -> pa.Table:
    rows, ids, sizes = t["row"].to_numpy(), t["doc_id"].combine_chunks(), t["tokens"].to_numpy()
    capacity, group, name = t["capacity"][0].as_py(), t["grp"][0].as_py(), t["container"][0].as_py()
    at, piece, size, container, room = first_fit_decreasing(rows, sizes, capacity)
    return pa.table(
        {
            "container": pa.array([name] * len(at), pa.string()),
            "doc_id": ids.take(pa.array(at)),
            "piece": pa.array(piece.astype(np.int32)),
            "tokens": pa.array(size.astype(np.int64)),
            "container_no": pa.array((group << _BITS) + container),
            "space_left": pa.array(room),
        }
    )


def pack(docs: DataFrame, containers: DataFrame, id_col: str = "doc_id", text_col: str = "text", group_size: int = GROUP_SIZE, vocabulary: str = K.VOCABULARY) -> DataFrame:
    """(container, doc_id, piece, tokens, container_no, space_left): where each document lies, for every kind of container.

    container_no tells the containers of one kind apart; space_left is what
    stays free in it. A document longer than the capacity comes in pieces
    numbered from 0, any other as piece 0 alone. Null and empty texts have 0
    tokens and still get a place; rows of one id are items of their own; a null
    id stays null. Kinds of containers with a null or non-positive capacity are
    ignored; several capacities under one name are kinds of their own, told
    apart by container_no. Other columns are ignored. Empty tables give an
    empty result.
    """
    kinds = sorted((r[0] or "", r[0], int(r[1])) for r in containers.select("container", "capacity_tokens").distinct().collect() if r[1] and r[1] > 0)  # a handful of kinds
    if not kinds:
        return docs.sparkSession.createDataFrame([], _OUT)
    groups = max(1, -(-docs.count() // group_size))
    items = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    items = scratch.spread(items).mapInArrow(K.sizer("text", vocabulary, ("doc_id",)), "doc_id bigint, tokens bigint")
    items = scratch.keep(items.withColumn("row", F.monotonically_increasing_id()), "sizes")
    grp = F.pmod(F.xxhash64("row", F.lit(SEED)), F.lit(groups))
    kind = F.explode(F.array(*[F.struct(F.lit(n).cast("string").alias("container"), F.lit(c).cast("bigint").alias("capacity"), F.lit(i * groups).cast("bigint").alias("first")) for i, (_, n, c) in enumerate(kinds)]))
    spread = items.withColumn("grp", grp).select("row", "doc_id", "tokens", "grp", kind.alias("k"))
    spread = spread.select("row", "doc_id", "tokens", "k.container", "k.capacity", (F.col("k.first") + F.col("grp")).alias("grp"))
    return spread.groupBy("grp").applyInArrow(_pack, _OUT)


def fill_report(packed: DataFrame) -> DataFrame:
    """(container, capacity, n_containers, n_least, n_split, tokens, share_filled) per kind of container: n_least is the number that perfect filling would need, n_split the documents in more than one piece."""
    each = packed.groupBy("container", "container_no").agg(F.sum("tokens").alias("tokens"), F.max("space_left").alias("space"), F.count(F.when(F.col("piece") == 1, 1)).alias("split"))
    out = each.groupBy("container", (F.col("tokens") + F.col("space")).alias("capacity")).agg(F.count("*").alias("n_containers"), F.sum("tokens").alias("tokens"), F.sum("split").alias("n_split"))
    filled = F.col("tokens") / (F.col("n_containers") * F.col("capacity"))
    return out.select("container", "capacity", "n_containers", F.ceil(F.col("tokens") / F.col("capacity")).alias("n_least"), "n_split", "tokens", filled.alias("share_filled"))
