"""Reading the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import scratch
from ..operators import corpus
from ..operators.stitch import normal_qid


def read(spark: SparkSession, d: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{table}.parquet")


def docs(spark: SparkSession, d: str) -> DataFrame:
    """The articles of both datasets in one schema."""
    return corpus.articles(scratch.spread(read(spark, d, "articles")))


def linked(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "linked_entities").withColumn("qid", normal_qid(F.col("qid")))


def claims(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "kb_claims")


#: SQL of the same views.
DOCS = """
docs as (
  select article_no as id, coalesce(title, '') as title, coalesce(text, '') as text,
         case when label is null then null
              when dataset = 'primary' then cast(upper(trim(label)) = 'FAKE' as int)
              else coalesce(cast(try_cast(label as int) = 0 as int), 0) end as label, split
  from articles
)
"""
LINKED = r"""
linked as (
  select link_id, mention_id, article_no, mention, label, description, score,
         nullif(regexp_replace(upper(trim(qid, e' \t\r\n')), '^WD:', ''), '') as qid
  from linked_entities
)
"""
TOKENS = "tok as (select id, unnest(list_transform(regexp_extract_all(text, '[A-Za-z]+'), lambda x: lower(x))) as token from docs)"
