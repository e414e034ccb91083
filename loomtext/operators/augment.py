"""Augmentation of token sequences."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import hash60, uniform


class Repetition:
    """Decides token by token what a sequence keeps, so that repeated pairs stay under a share of the tokens kept."""

    def __init__(self, threshold: float):
        self.threshold, self.last, self.size, self.repeats, self.pairs = threshold, None, 0, 0, set()

    def admits(self, token: str) -> bool:
        """Whether the token stays. The pair it makes with the last kept token counts either way."""
        pair = (self.last, token)
        known = self.size > 0 and pair in self.pairs
        self.repeats += known
        if self.size:
            self.pairs.add(pair)
        fits = not self.size or self.repeats <= self.threshold * self.size
        if fits:
            self.last, self.size = token, self.size + 1
        return fits


def covered(tokens: list[str], threshold: float) -> list[str]:
    """Tokens without those that would lift the ratio of repeated pairs over the threshold."""
    return list(filter(Repetition(threshold).admits, tokens))


def coverage_filter(rows: DataFrame, threshold: float = 0.6) -> DataFrame:
    """(id, tokens) with repetitive tokens dropped; null token arrays stay null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [None if t is None else covered(t, threshold) for t in b.column("tokens").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(out, pa.list_(pa.string()))], ["id", "tokens"])

    return rows.select("id", "tokens").mapInArrow(run, "id bigint, tokens array<string>")


def synonym_lists(table: DataFrame) -> DataFrame:
    """(word, synonyms) from (word, synonym): lower-cased, without the word itself and without phrases, sorted."""
    t = table.select(F.lower("word").alias("word"), F.lower("synonym").alias("synonym")).where("word <> synonym and instr(synonym, '_') = 0")
    return t.groupBy("word").agg(F.array_sort(F.collect_set("synonym")).alias("synonyms"))


def synonym_replace(tokens: DataFrame, synonyms: DataFrame, topics: DataFrame, prob: float = 0.1, seed: int = 1) -> DataFrame:
    """(id, pos, token) with about `prob` of the tokens replaced by a synonym, chosen by hash; topic words (word) and words without synonyms stay."""
    key = F.concat_ws("|", F.col("id").cast("string"), F.col("pos").cast("string"))
    rows = tokens.withColumn("_w", F.lower("token")).withColumn("_u", uniform(seed, key)).withColumn("_h", hash60(seed + 1, key))
    rows = rows.join(synonyms.withColumnRenamed("word", "_w"), "_w", "left").join(topics.select(F.col("word").alias("_w"), F.lit(True).alias("_topic")).distinct(), "_w", "left")
    swap = (F.col("_u") < prob) & F.col("_topic").isNull() & (F.size("synonyms") > 0)
    return rows.select("id", "pos", F.when(swap, F.get("synonyms", F.pmod("_h", F.size("synonyms")).cast("int"))).otherwise(F.col("token")).alias("token"))


def augmented(rows: DataFrame, synonyms: DataFrame, topics: DataFrame, prob: float = 0.1, threshold: float = 0.6, seed: int = 1, paraphrase: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(id, tokens): synonyms put in, then repetitive tokens dropped; from (id, tokens). Rows without tokens are left out.

    `paraphrase` is a hook for a generator: it gets (id, tokens) before that
    and gives (id, tokens) back; without it the tokens stay as they are.
    """
    rows = paraphrase(rows.select("id", "tokens")) if paraphrase else rows
    flat = rows.select("id", F.posexplode("tokens").alias("pos", "token"))
    swapped = synonym_replace(flat, synonyms, topics, prob, seed).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", "token"))).alias("xs"))
    return coverage_filter(swapped.select("id", F.col("xs.token").alias("tokens")), threshold)
