"""Sources: article files, knowledge-base lines, word vectors, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X

SEARCH_SCHEMA = "mention string, record struct<qid: string, label: string, description: string, score: double, _no_match: boolean>"
CLAIMS_SCHEMA = "qid string, claims map<string, array<string>>"
REPORT_SCHEMA = "model string, precision double, recall double, f1 double, miss_rate double, auc double, confusion_matrix array<bigint>, n bigint"


def _csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    header = spark.read.option("header", True).csv(path, multiLine=True, escape='"').columns
    schema = T.StructType([T.StructField(c, T.StringType()) for c in header])
    rows = spark.read.schema(schema).csv(path, header=True, multiLine=True, escape='"', mode="PERMISSIVE")
    return rows.select(*[F.col(f"`{c}`") if c in header else F.lit(None).cast("string").alias(c) for c in columns])


def primary_csv(spark: SparkSession, path: str) -> DataFrame:
    """Articles from `id, title, text, label` with labels REAL / FAKE; a file that is missing raises. Without an id column the id is the row's position."""
    rows = _csv(spark, path, ["id", "title", "text", "label"]).withColumn("_at", F.monotonically_increasing_id())
    return rows.select(F.coalesce("id", F.col("_at").cast("string")).alias("id"), X.whole(F.col("title")).alias("title"), X.whole(F.col("text")).alias("text"), X.label_flag(F.col("label"), "FAKE").alias("label"))


def secondary_csv(spark: SparkSession, path: str) -> DataFrame:
    """Articles from `URLs, Headline, Body, Label` with 0 for fake; ids are row positions (one file, read in order)."""
    rows = _csv(spark, path, ["URLs", "Headline", "Body", "Label"]).withColumn("_at", F.monotonically_increasing_id())
    return rows.select(F.col("_at").cast("string").alias("id"), X.whole(F.col("Headline")).alias("title"), X.whole(F.col("Body")).alias("text"), X.label_flag(F.col("Label"), 0).alias("label"))


def search_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of the search cache with their order; malformed lines are skipped."""
    rows = spark.read.schema(SEARCH_SCHEMA).json(path, mode="DROPMALFORMED").withColumn("line_no", F.monotonically_increasing_id())
    return rows.where("mention is not null").select("line_no", "mention", "record")


def claim_lines(spark: SparkSession, path: str) -> DataFrame:
    """Claims, the last line of each qid; malformed lines are skipped."""
    rows = spark.read.schema(CLAIMS_SCHEMA).json(path, mode="DROPMALFORMED").withColumn("line_no", F.monotonically_increasing_id()).where("qid is not null")
    return rows.groupBy("qid").agg(F.max_by("claims", "line_no").alias("claims"))


def crossview_json(spark: SparkSession, path: str) -> DataFrame:
    """(qid, class_path) of a JSON object."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.explode(F.from_json("value", "map<string, string>")).alias("qid", "class_path"))


def word_vectors(spark: SparkSession, path: str, dim: int = 100) -> DataFrame:
    """(word, vec) of a text file of words and numbers; lines of another width are dropped, of repeated words the last stands."""
    rows = spark.read.text(path).withColumn("line_no", F.monotonically_increasing_id())
    parts = F.split(F.rtrim("value"), " ")
    good = rows.select("line_no", parts.alias("p")).where(F.size("p") == dim + 1)
    vec = F.transform(F.slice("p", 2, dim), lambda x: x.try_cast("float"))
    good = good.select("line_no", F.get("p", 0).alias("word"), vec.alias("vec")).where(~F.exists("vec", lambda x: x.isNull()))
    return good.groupBy("word").agg(F.max_by("vec", "line_no").alias("vec"))


def reports(spark: SparkSession, pattern: str) -> DataFrame:
    """Report files of a glob, one row each, the model named by the file where the report does not; unreadable files are skipped."""
    rows = spark.read.schema(REPORT_SCHEMA + ", _bad string").json(pattern, multiLine=True, mode="PERMISSIVE", columnNameOfCorruptRecord="_bad")
    stem = F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:_report)?\.json$", 1)
    return rows.withColumn("file", stem).where("_bad is null").drop("_bad").withColumn("model", F.coalesce("model", "file"))


def histories(spark: SparkSession, pattern: str) -> DataFrame:
    """(model, epoch, train_loss, val_loss) of history files, a bare array or an object with the key history."""
    rows = spark.read.text(pattern, wholetext=True).withColumn("model", F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:_history)?\.json$", 1))
    entry = "array<struct<epoch: bigint, train_loss: double, val_loss: double>>"
    bare = F.when(F.trim("value").startswith("["), F.from_json("value", entry))
    wrapped = F.from_json("value", f"history {entry}")["history"]
    return rows.select("model", F.explode(F.coalesce(bare, wrapped)).alias("e")).select("model", "e.epoch", "e.train_loss", "e.val_loss")


def ontology_file(spark: SparkSession, path: str, depth: int = 5) -> DataFrame:
    """(path, level, attributes) of a nested ontology file, to `depth` levels."""
    node = T.StructType([T.StructField("attributes", T.ArrayType(T.StringType()))])
    for _ in range(depth):
        node = T.StructType([T.StructField("attributes", T.ArrayType(T.StringType())), T.StructField("children", T.MapType(T.StringType(), node))])
    rows = spark.read.text(path, wholetext=True).select(F.from_json("value", node).alias("n"))
    level = rows.select(F.lit("").alias("path"), F.lit(0).alias("level"), "n")
    out = level.select("path", "level", "n.attributes")
    for k in range(1, depth + 1):
        level = level.select("path", F.explode("n.children").alias("name", "n")).select(F.concat_ws(".", F.nullif("path", F.lit("")), "name").alias("path"), F.lit(k).alias("level"), "n")
        out = out.union(level.select("path", "level", "n.attributes"))
    return out.where("level > 0")


def file_signatures(spark: SparkSession, *paths: str) -> DataFrame:
    """(file, exists, size, modified) of the files at each path, without reading their contents; a path without files gives one row with exists = false."""
    schema = "file string, exists boolean, size bigint, modified timestamp"
    out = spark.createDataFrame([], schema)
    for p in paths:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p)
        found = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(where)
        if found is None or not len(found):
            out = out.union(spark.createDataFrame([(p, False, None, None)], schema))
            continue
        rows = spark.read.format("binaryFile").load(p)
        out = out.union(rows.select("path", F.lit(True), "length", "modificationTime"))
    return out
