"""Translation embeddings of a triple table, trained in blocks of triples whose vectors are averaged.

A block is trained in one task from the vectors of its own entities and
relations. After each round the vectors of all blocks are averaged by how many
of their triples touched them, so every triple is learned from, every entity
gets a vector, and no task holds more than `block_triples`. A table of one
block is trained in one go.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import scratch


def fit(h: np.ndarray, r: np.ndarray, t: np.ndarray, ent: np.ndarray, rel: np.ndarray, epochs: int, rate: float, margin: float, batch: int, patience: int, min_delta: float, seed: int) -> list[float]:
    """Train `ent` and `rel` in place; the smoothed loss of each epoch. Margin loss with corrupted tails, Adam, early stop on the smoothed loss."""
    rng = np.random.default_rng(seed)
    state = [[np.zeros_like(p), np.zeros_like(p)] for p in (ent, rel)]
    step, smooth, best, stale, history = 0, None, np.inf, 0, []
    for _ in range(epochs):
        order, total = rng.permutation(len(h)), 0.0
        for lo in range(0, len(h), batch):
            i = order[lo : lo + batch]
            wrong = rng.integers(0, len(ent), len(i))
            good, bad = ent[h[i]] + rel[r[i]] - ent[t[i]], ent[h[i]] + rel[r[i]] - ent[wrong]
            dg, db = np.linalg.norm(good, axis=1) + 1e-9, np.linalg.norm(bad, axis=1) + 1e-9
            live = (margin + dg - db > 0)[:, None]
            total += float(np.maximum(0, margin + dg - db).sum())
            ug, ub = live * good / dg[:, None] / len(i), live * bad / db[:, None] / len(i)
            ge, gr = np.zeros_like(ent), np.zeros_like(rel)
            np.add.at(ge, h[i], ug - ub)
            np.add.at(ge, t[i], -ug)
            np.add.at(ge, wrong, ub)
            np.add.at(gr, r[i], ug - ub)
            step += 1
            for p, g, (m, v) in zip((ent, rel), (ge, gr), state):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        loss = total / max(1, len(h))
        smooth = loss if smooth is None else 0.8 * smooth + 0.2 * loss
        history.append(smooth)
        best, stale = (smooth, 0) if smooth < best - min_delta else (best, stale + 1)
        if stale >= patience:
            break
    return history


def first_vector(kind: Column, key: Column, n: Column, dim: int, seed: int) -> Column:
    """Uniform start within sqrt(6 / (n + dim)), the same for a key in every block: from one hash and a multiplication a dimension."""
    h = F.pmod(F.xxhash64(kind, key, F.lit(seed)), F.lit(2**31 - 1))
    each = [(h * (1 + (i * 48271 + 11) * 69621 % (2**31 - 2)) % (2**31 - 1)) / F.lit(float(2**31 - 1)) * 2 - 1 for i in range(dim)]
    return F.transform(F.array(*each), lambda x: x * F.sqrt(F.lit(6.0) / (n + dim)))


def train(triples: DataFrame, dim: int = 64, epochs: int = 30, rate: float = 1e-3, margin: float = 1.0, batch: int = 256, patience: int = 5, min_delta: float = 1e-3, seed: int = 42, block_triples: int = 200_000, rounds: int = 5) -> DataFrame:
    """(kind, key, vec): vectors of all entities and relations of the distinct triples (h, r, t).

    Null parts are left out. An empty table gives an empty result. With more
    than block_triples triples the epochs are shared out over `rounds` rounds.
    """
    rows = triples.select("h", "r", "t").dropna().distinct()
    rows = scratch.keep(rows.withColumn("mix", F.xxhash64("h", "r", "t")), "triples")
    blocks = max(1, -(-rows.count() // block_triples))
    rounds = rounds if blocks > 1 else 1
    rows = rows.withColumn("block", F.pmod("mix", F.lit(blocks)).cast("int")).drop("mix")
    ends = F.array(F.struct(F.lit("entity").alias("kind"), F.col("h").alias("key")), F.struct(F.lit("relation").alias("kind"), F.col("r").alias("key")), F.struct(F.lit("entity").alias("kind"), F.col("t").alias("key")))
    places = scratch.keep(rows.select("block", F.explode(ends).alias("e")).groupBy("block", "e.kind", "e.key").agg(F.count("*").alias("n")), "places")
    keys = places.select("kind", "key").distinct()
    sizes = keys.groupBy("kind").agg(F.count("*").alias("size"))
    vectors = keys.join(F.broadcast(sizes), "kind").select("kind", "key", first_vector(F.col("kind"), F.col("key"), F.col("size"), dim, seed).alias("vec"))  # two kinds

    def run(part: pa.Table, held: pa.Table) -> pa.Table:
        at = {(k, x): i for i, (k, x) in enumerate(zip(held["kind"].to_pylist(), held["key"].to_pylist()))}
        vec = np.array(held["vec"].to_pylist(), np.float64).reshape(len(at), dim)
        is_entity = np.array([k == "entity" for k, _ in at], bool)
        place = np.where(is_entity, np.cumsum(is_entity) - 1, np.cumsum(~is_entity) - 1)
        order = np.lexsort([part[c].combine_chunks().dictionary_encode().indices.to_numpy() for c in ("t", "r", "h")])
        part = part.take(pa.array(order))
        h, r, t = (place[[at[kind, x] for x in part[c].to_pylist()]] for c, kind in (("h", "entity"), ("r", "relation"), ("t", "entity")))
        ent, rel = vec[is_entity], vec[~is_entity]
        fit(h, r, t, ent, rel, -(-epochs // rounds), rate, margin, batch, patience, min_delta, seed)
        out = np.where(is_entity[:, None], ent[np.minimum(place, len(ent) - 1)], rel[np.minimum(place, len(rel) - 1)])
        return pa.table({"kind": held["kind"], "key": held["key"], "vec": pa.array(out.tolist(), pa.list_(pa.float64())), "n": held["n"]})

    for _ in range(rounds):
        held = places.join(vectors, ["kind", "key"])
        parts = rows.groupBy("block").cogroup(held.groupBy("block")).applyInArrow(run, "kind string, key string, vec array<double>, n bigint")
        if blocks == 1:
            return parts.select("kind", "key", "vec")
        w = F.sum("n")
        means = parts.groupBy("kind", "key").agg(F.array(*[F.sum(F.col("vec")[i] * F.col("n")) / w for i in range(dim)]).alias("vec"))
        vectors = scratch.keep(means, "vectors")
    return vectors
