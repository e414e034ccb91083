"""Dense global positions without a global window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import scratch


def with_ordinal(df: DataFrame, *order: str, name: str = "ordinal") -> DataFrame:
    """`df` with the position of each row, from 0, in the order of the columns.

    Rows are range-partitioned and sorted; only one count per partition comes
    to the driver. Ties in the order are numbered arbitrarily.
    """
    spark = df.sparkSession
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    kept = scratch.keep(ranged, "ordinal").withColumn("_part", F.shiftright("_at", 33))
    counts = sorted((r[0], r[1]) for r in kept.groupBy("_part").agg(F.count("*")).collect())
    starts, total = [], 0
    for part, n in counts:
        starts.append((part, total))
        total += n
    offsets = F.broadcast(spark.createDataFrame(starts, "_part bigint, _start bigint"))  # one row per task
    local = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return kept.join(offsets, "_part").withColumn(name, F.col("_start") + local).drop("_part", "_start", "_at")
