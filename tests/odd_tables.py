"""Folders of odd tables made from the test tables: empty ones, and ones with nulls, repeated rows and columns with clashing names."""

from pathlib import Path

from pyspark.sql import functions as F

#: Names the operators use inside.
CLASHING = ("id", "rep", "key", "keys", "a", "b", "part", "local", "ordinal", "block", "shard", "seen", "h", "field", "item", "record", "tokens", "grp", "row", "bin", "source", "features", "spelling", "train", "term")


def write(spark, data, out, kind):
    for t in Path(data).glob("*.parquet"):
        df = spark.read.parquet(str(t))
        if kind == "empty":
            df = df.where("false")
        else:
            nulls = df.limit(3).select(*[F.lit(None).cast(df.schema[c].dataType).alias(c) for c in df.columns])
            each = [df.limit(2).withColumn(c, F.lit(None).cast(df.schema[c].dataType)) for c in df.columns]
            for extra in (nulls, df.limit(5), *each):
                df = df.union(extra)
            have = {c.lower() for c in df.columns}
            df = df.withColumns({c: F.lit("clash") for c in CLASHING if c not in have})
        df.coalesce(2).write.parquet(f"{out}/{t.name}")
    return str(out)
