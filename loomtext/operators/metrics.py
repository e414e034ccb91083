"""Classification and text-overlap measures."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordinals import with_ordinal

_BLANK = re.compile(r"[ \t\n\x0b\f\r]+")


def confusion(rows: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(keys, tp, fp, fn, tn, precision, recall, f1, miss_rate, n) from (label, predicted), positive = 1; a ratio over nothing is 0, miss_rate is 1 - recall."""
    count = lambda y, p: F.count(F.when((F.col("label") == y) & (F.col("predicted") == p), 1))
    c = rows.where("label is not null and predicted is not null").groupBy(*(keys or [])).agg(count(1, 1).alias("tp"), count(0, 1).alias("fp"), count(1, 0).alias("fn"), count(0, 0).alias("tn"), F.count("*").alias("n"))
    over = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    c = c.withColumn("p", over(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("r", over(F.col("tp"), F.col("tp") + F.col("fn")))
    f1 = over(2 * F.col("p") * F.col("r"), F.col("p") + F.col("r"))
    return c.select(*(keys or []), "tp", "fp", "fn", "tn", "n", F.round("p", 9).alias("precision"), F.round("r", 9).alias("recall"), F.round(f1, 9).alias("f1"), F.round(1 - F.col("r"), 9).alias("miss_rate"))


def roc_auc(rows: DataFrame) -> DataFrame:
    """One row: area under the ROC curve of (label, score) by tie-aware ranks; null with one class only.

    Rows are reduced to counts per distinct score first. Ranks come from
    running sums over range-partitioned scores; only per-partition sums are
    gathered.
    """
    per = rows.where("label is not null and score is not null").groupBy("score").agg(F.sum(F.col("label").cast("bigint")).alias("pos"), F.count("*").alias("n"))
    at = with_ordinal(per, "score")
    block = F.floor(F.col("ordinal") / 65536)
    sums = at.groupBy(block.alias("block")).agg(F.sum("n").alias("bn"))
    before = sums.withColumn("ahead", F.coalesce(F.sum("bn").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # one row per 65 536 scores
    w = Window.partitionBy("block").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1)
    ranked = at.withColumn("block", block).join(before.select("block", "ahead"), "block").withColumn("lower", F.col("ahead") + F.coalesce(F.sum("n").over(w), F.lit(0)))
    s = ranked.agg(F.sum(F.col("pos") * (F.col("lower") + (F.col("n") + 1) / 2)).alias("ranks"), F.sum("pos").alias("p"), (F.sum("n") - F.sum("pos")).alias("q"))
    return s.select(F.when((F.col("p") > 0) & (F.col("q") > 0), F.round((F.col("ranks") - F.col("p") * (F.col("p") + 1) / 2) / (F.col("p") * F.col("q")), 9)).alias("auc"))


def _grams(words: list[str], n: int) -> Counter:
    return Counter(zip(*(words[i:] for i in range(n))))


def _f1(shared: int, p: int, r: int) -> float:
    return 2 * shared / (p + r) if shared else 0.0


def _common(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, one row of the table at a time as bits."""
    where: dict[str, int] = {}
    for i, w in enumerate(a):
        where[w] = where.get(w, 0) | 1 << i
    row, full = (1 << len(a)) - 1, (1 << len(a)) - 1
    for w in b:
        hit = row & where.get(w, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


def _overlaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for p, r in zip(b.column("predicted").to_pylist(), b.column("reference").to_pylist()):
            x, y = (_BLANK.sub(" ", t or "").lower().split(" ") for t in (p, r))
            x, y = [w for w in x if w], [w for w in y if w]
            f = [_f1(sum((_grams(x, n) & _grams(y, n)).values()), len(x) - n + 1, len(y) - n + 1) for n in (1, 2)]
            out.append((*f, _f1(_common(x, y), len(x), len(y))))
        cols = list(zip(*out)) if out else [[]] * 3
        yield pa.RecordBatch.from_arrays([b.column("id"), *(pa.array(c, pa.float64()) for c in cols)], ["id", "rouge1", "rouge2", "rougeL"])


def rouge(rows: DataFrame) -> DataFrame:
    """(id, rouge1, rouge2, rougeL): F1 of the columns predicted and reference by words, word pairs and longest common subsequence.

    Grams are counted with repeats; 0 where either side has none, null reads as
    empty. All three are made inside the row, nothing is shuffled.
    """
    return rows.select("id", "predicted", "reference").mapInArrow(_overlaps, "id bigint, rouge1 double, rouge2 double, rougeL double")


def rouge_n(rows: DataFrame, n: int) -> DataFrame:
    """(id, f1) of words (n = 1) or word pairs (n = 2)."""
    return rouge(rows).select("id", F.col(f"rouge{n}").alias("f1"))


def rouge_l(rows: DataFrame) -> DataFrame:
    """(id, f1) by the longest common subsequence of words."""
    return rouge(rows).select("id", F.col("rougeL").alias("f1"))


def majority(rows: DataFrame) -> DataFrame:
    """(id, n, n_fake, verdict) from one row per model (id, predicted): FAKE only where more than half say so."""
    s = rows.groupBy("id").agg(F.count("*").alias("n"), F.sum(F.col("predicted").cast("bigint")).alias("n_fake"))
    return s.withColumn("verdict", F.when(F.col("n_fake") > F.col("n") / 2, "FAKE").otherwise("REAL"))


def decided(probability: Column, threshold: float = 0.5) -> Column:
    return F.when(probability >= threshold, 1).when(probability < threshold, 0)


def smoothed_losses(rows: DataFrame, keep: float = 0.8, patience: int = 3, min_delta: float = 1e-4) -> DataFrame:
    """(run, epoch, ema, stopped) from (run, epoch, loss): the smoothed loss, and whether training had stopped before that epoch for want of progress.

    A run has a few hundred epochs at most, so its losses fit one row.
    """
    losses = rows.groupBy("run").agg(F.array_sort(F.collect_list(F.struct("epoch", "loss"))).alias("xs"))
    start = F.struct(F.lit(None).cast("double").alias("ema"), F.lit(float("inf")).alias("best"), F.lit(0).alias("stale"), F.lit(False).alias("halt"), F.array().cast("array<struct<epoch: bigint, ema: double, stopped: boolean>>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        ema = F.when(s["ema"].isNull(), x["loss"]).otherwise(keep * s["ema"] + (1 - keep) * x["loss"])
        better = ema < s["best"] - min_delta
        stale = F.when(better, 0).otherwise(s["stale"] + 1)
        row = F.struct(x["epoch"].cast("bigint").alias("epoch"), ema.alias("ema"), s["halt"].alias("stopped"))
        return F.struct(ema.alias("ema"), F.when(better, ema).otherwise(s["best"]).alias("best"), stale.alias("stale"), (s["halt"] | (stale >= patience)).alias("halt"), F.array_append(s["out"], row).alias("out"))

    return losses.select("run", F.explode(F.aggregate("xs", start, step, lambda s: s["out"])).alias("o")).select("run", "o.epoch", "o.ema", "o.stopped")
