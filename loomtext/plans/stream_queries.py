"""Streaming queries; they run to the present end of the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import scratch
from ..streaming import sketches as S
from .corpus_queries import _CELLS
from .tables import DOCS, TOKENS


def _places(spark: SparkSession, name: str) -> tuple[str, str]:
    base = scratch.folder(spark, name)
    return f"{base}/store", f"{base}/checkpoint"


def stream_token_counts(spark: SparkSession, d: str) -> DataFrame:
    return S.token_counts(spark, S.stream_table(spark, f"{d}/articles.parquet"), *_places(spark, "tokens"))


def stream_cms(spark: SparkSession, d: str) -> DataFrame:
    return S.count_min(spark, S.stream_table(spark, f"{d}/articles.parquet"), *_places(spark, "cms"))


def stream_event_windows(spark: SparkSession, d: str) -> DataFrame:
    """Daily windows of the events; complete mode, so the last window is there too."""
    store, checkpoint = _places(spark, "events")
    windows = S.event_windows(S.stream_table(spark, f"{d}/events.parquet"), late="1 hour")

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(store)

    windows.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(store).select(F.to_date("start").alias("day"), "event_type", "n", F.round("total", 4).alias("total"))


QUERIES = {f.__name__: f for f in (stream_token_counts, stream_cms, stream_event_windows)}
ORACLE = {
    "stream_token_counts": f"with {DOCS}, {TOKENS} select token, count(*) as n from tok group by token",
    "stream_cms": f"with {_CELLS} select d, k, s from cell",
    "stream_event_windows": "select cast(ts as date) as day, event_type, count(*) as n, round(sum(value), 4) as total from events group by all",
}
