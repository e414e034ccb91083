"""One-pass sketches over streams. An extension: counts, cells and windows that merge.

Each micro-batch is reduced to a small mergeable table. A file of the store is
named by the batch it comes from and overwritten if the batch is run again, so
a restart counts nothing twice.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import sketches


def stream_table(spark: SparkSession, path: str, files_per_trigger: int = 64) -> DataFrame:
    """A Parquet table as a stream of its files."""
    schema = spark.read.option("recursiveFileLookup", "true").parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).option("recursiveFileLookup", "true").parquet(path)


def reduce_stream(stream: DataFrame, reduce: Callable[[DataFrame], DataFrame], store: str, checkpoint: str) -> None:
    """Run the stream to its present end; each batch's reduced table goes to store/batch=<number>."""

    def write(batch: DataFrame, number: int) -> None:
        reduce(batch).write.mode("overwrite").parquet(f"{store}/batch={number}")

    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def token_counts(spark: SparkSession, stream: DataFrame, store: str, checkpoint: str) -> DataFrame:
    """(token, n) over everything the stream has brought so far."""
    one = lambda b: b.select(F.explode(X.tokens(F.col("text"))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    reduce_stream(stream, one, store, checkpoint)
    return spark.read.parquet(store).groupBy("token").agg(F.sum("n").alias("n"))


def count_min(spark: SparkSession, stream: DataFrame, store: str, checkpoint: str, width: int = 4096, depth: int = 6) -> DataFrame:
    """(d, k, s): the Count-Min cells of the tokens the stream has brought so far."""

    def one(b: DataFrame) -> DataFrame:
        counts = b.select(F.explode(X.tokens(F.col("text"))).alias("item")).groupBy("item").agg(F.count("*").alias("n"))
        return sketches.cms_cells(counts, width=width, depth=depth)

    reduce_stream(stream, one, store, checkpoint)
    return sketches.merge_cells(spark.read.parquet(store).select("d", "k", "s"))


def event_windows(stream: DataFrame, late: str = "1 hour", window: str = "1 day") -> DataFrame:
    """Count and sum of values per window and event type; events later than `late` behind the watermark are dropped."""
    timed = stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")
