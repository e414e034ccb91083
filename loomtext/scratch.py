"""Intermediate tables in the folder all executors share.

An operator that reads one intermediate several times, or that iterates,
writes it as Parquet under `spark.checkpoint.dir` and goes on from the files:
lineage is cut, a lost executor costs only the tasks it ran, and later reads
prune columns. Files go when the block of a `tables()` context ends, else when
the Python driver does.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}
_MADE: list[tuple[SparkSession, str]] = []


def base_dir(spark: SparkSession) -> str:
    """The shared folder: `spark.checkpoint.dir`. Only a local master that names none, as in tests, gets a private one; a cluster without it raises."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    app = spark.sparkContext.applicationId
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if app not in _OWN:
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="loomtext-")
    return _OWN[app]


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write `df` to the shared folder and return the table read back from there."""
    spark = df.sparkSession
    path = f"{base_dir(spark)}/loomtext-{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    _MADE.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def folder(spark: SparkSession, name: str) -> str:
    """A fresh folder beside the tables, deleted with them."""
    path = f"{base_dir(spark)}/loomtext-{name}-{uuid.uuid4().hex[:12]}"
    _MADE.append((spark, path))
    return path


@contextmanager
def tables() -> Iterator[None]:
    """Delete, at the end of the block, all tables and folders made inside it; for callers that have consumed their results by then."""
    before = len(_MADE)
    try:
        yield
    finally:
        forget([path for _, path in _MADE[before:]])


def forget(df_paths: list[str]) -> None:
    """Delete tables made by `keep` that no later plan reads."""
    for spark, path in [m for m in _MADE if m[1] in df_paths]:
        _delete(spark, path)
        _MADE.remove((spark, path))


def path_of(index: int = -1) -> str:
    """Path of a table that `keep` made, the last by default."""
    return _MADE[index][1]


#: Bytes, by the plan's own estimate, up to which an input is spread over idle cores.
SPREAD_BYTES = 1 << 30


def spread(df: DataFrame) -> DataFrame:
    """Use all cores where a small input has fewer splits than the cluster has cores; larger ones are left where they lie."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        return df
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size <= SPREAD_BYTES else df


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def _clean() -> None:
    for spark, path in _MADE:
        try:
            if spark.sparkContext._jsc is not None:
                _delete(spark, path)
        except Exception:  # the JVM has gone first, or one folder resists; the others are still tried
            continue
