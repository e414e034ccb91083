"""Problem 6: most frequent items in bounded memory.

Each partition keeps one space-saving summary per field: at most `capacity`
counters, each an upper bound with its largest possible error, and a floor
that no dropped item can exceed. Arrow batches are counted first and merged
in as exact summaries. Summaries are merged in a tree of fan-in 8, so no task
ever holds more than nine of them; a second pass counts the survivors exactly.
Every item on more than n / capacity of the n rows is among the survivors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import scratch

FAN_IN = 8
_SCHEMA = "node int, field string, item string, estimate bigint, error bigint, n bigint"


class Summary:
    """Space-saving counters of one field."""

    def __init__(self, capacity: int):
        self.capacity, self.floor, self.n = capacity, 0, 0
        self.items, self.counts, self.errors = pa.array([], pa.string()), np.empty(0, np.int64), np.empty(0, np.int64)

    def merge(self, items: pa.Array, counts: np.ndarray, errors: np.ndarray, floor: int, n: int) -> None:
        """Take in another summary; its items must be distinct."""
        own = pc.index_in(self.items, items)
        other = pc.index_in(items, self.items)
        at = own.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        new = np.flatnonzero(other.is_null().to_numpy(zero_copy_only=False))
        hit = at >= 0
        mine = np.where(hit, counts[at] if len(counts) else 0, floor) + self.counts
        mine_err = np.where(hit, errors[at] if len(errors) else 0, floor) + self.errors
        self.items = pa.concat_arrays([self.items, items.take(pa.array(new))])
        self.counts = np.concatenate([mine, counts[new] + self.floor])
        self.errors = np.concatenate([mine_err, errors[new] + self.floor])
        self.floor += floor
        self.n += n
        if len(self.counts) > self.capacity:
            order = np.argsort(-self.counts, kind="stable")
            self.floor = max(self.floor, int(self.counts[order[self.capacity]]))
            keep = np.sort(order[: self.capacity])
            self.items, self.counts, self.errors = self.items.take(pa.array(keep)), self.counts[keep], self.errors[keep]

    def rows(self, node: int, field: str) -> pa.RecordBatch:
        """The counters, and a last row without item that carries the floor and the number of rows."""
        k = len(self.counts)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.full(k + 1, node, np.int32)),
                pa.array([field] * (k + 1)),
                pa.concat_arrays([self.items, pa.nulls(1, pa.string())]),
                pa.array(np.append(self.counts, self.floor)),
                pa.array(np.append(self.errors, self.floor)),
                pa.array(np.append(np.zeros(k, np.int64), self.n)),
            ],
            ["node", "field", "item", "estimate", "error", "n"],
        )


def _summarise(capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, held = TaskContext.get().partitionId(), {}
        for b in batches:
            field = b.column("field")
            for f in pc.unique(field).to_pylist():
                items = b.column("item").filter(pc.equal(field, f))
                counted = pc.value_counts(items)
                values, counts = counted.field("values"), counted.field("counts").to_numpy()
                held.setdefault(f, Summary(capacity)).merge(values, counts, np.zeros(len(counts), np.int64), 0, len(items))
        for f, s in held.items():
            yield s.rows(node, f)

    return run


def _combine(capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by new node, field and old node; one summary is gathered at a time."""
        held: list[pa.RecordBatch] = []
        mark, into, done = None, {}, None

        def take(parts: list[pa.RecordBatch]) -> tuple[int, str, Summary]:
            t = pa.Table.from_batches(parts)
            last = t.filter(pc.is_null(t["item"]))
            body = t.filter(pc.is_valid(t["item"]))
            key = (t["up"][0].as_py(), t["field"][0].as_py())
            s = into.setdefault(key, Summary(capacity))
            s.merge(body["item"].combine_chunks() if len(body) else pa.array([], pa.string()), body["estimate"].to_numpy(), body["error"].to_numpy(), last["estimate"][0].as_py(), last["n"][0].as_py())
            return key

        for b in batches:
            keys = list(zip(b.column("up").to_pylist(), b.column("field").to_pylist(), b.column("node").to_pylist()))
            cuts = [0, *[i for i in range(1, len(keys)) if keys[i] != keys[i - 1]], len(keys)]
            for lo, hi in zip(cuts, cuts[1:]):
                if hi == lo:
                    continue
                if mark is not None and keys[lo] != mark:
                    done = take(held)
                    held = []
                    if done != keys[lo][:2]:
                        yield into.pop(done).rows(*done)
                mark = keys[lo]
                held.append(b.slice(lo, hi - lo))
        if held:
            done = take(held)
            yield into.pop(done).rows(*done)

    return run


def summaries(rows: DataFrame, capacity: int) -> DataFrame:
    """(field, item, estimate, error, n): the merged counters of each field; the row without item has the floor and the row count."""
    nodes = rows.rdd.getNumPartitions()
    out = rows.mapInArrow(_summarise(capacity), _SCHEMA)
    while nodes > 1:
        nodes = -(-nodes // FAN_IN)
        up = out.withColumn("up", (F.floor(F.col("node") / FAN_IN) if nodes > 1 else F.lit(0)).cast("int"))
        out = up.repartition(nodes, "up").sortWithinPartitions("up", "field", "node").mapInArrow(_combine(capacity), _SCHEMA)
    return out.drop("node")


def frequent_items(rows: DataFrame, share: float, capacity: int = 4096) -> DataFrame:
    """(field, item, estimate, error, n, share) of every item on at least `share` of the rows of its field.

    `rows` has the columns field and item; rows with a null item or field do
    not count. estimate is the summary's count, never under the true n, and
    over it by at most `error`. share must be over 1 / capacity, else
    ValueError. Ties need no order, since no rank is cut. Other columns are
    ignored. An empty table gives an empty result.

    Memory is bounded by `capacity` counters a field; the survivors, at most
    that many, are broadcast to the second pass.
    """
    if share * capacity <= 1:
        raise ValueError("capacity must be over 1 / share, or a frequent item could be lost")
    rows = rows.select("field", "item").where("field is not null and item is not null")
    merged = scratch.keep(summaries(rows, capacity), "summary")
    totals = merged.where("item is null").select("field", F.col("n").alias("rows"))
    survivors = merged.where("item is not null").join(F.broadcast(totals), "field").where(F.col("estimate") >= F.col("rows") * share).select("field", "item", "estimate", "error", "rows")
    exact = rows.join(F.broadcast(survivors.select("field", "item")), ["field", "item"]).groupBy("field", "item").agg(F.count("*").alias("n"))
    out = exact.join(F.broadcast(survivors), ["field", "item"]).where(F.col("n") >= F.col("rows") * share)
    return out.select("field", "item", "estimate", "error", "n", (F.col("n") / F.col("rows")).alias("share"))
