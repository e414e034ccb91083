"""Text classifier of hashed word pairs and words, and its scores."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, MultilayerPerceptronClassifier
from pyspark.ml.feature import HashingTF, NGram, Normalizer, RegexTokenizer, SQLTransformer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def pipeline(features: int = 1 << 18, iterations: int = 200) -> Pipeline:
    """Words and word pairs hashed to `features` columns, unit length, logistic regression."""
    return Pipeline(
        stages=[
            RegexTokenizer(inputCol="text", outputCol="_words", pattern=r"\b\w\w+\b", gaps=False, toLowercase=True),
            NGram(n=2, inputCol="_words", outputCol="_pairs"),
            SQLTransformer(statement="select *, concat(_words, _pairs) as _terms from __THIS__"),
            HashingTF(inputCol="_terms", outputCol="_tf", numFeatures=features),
            Normalizer(inputCol="_tf", outputCol="_x"),
            LogisticRegression(featuresCol="_x", labelCol="label", maxIter=iterations, regParam=1e-4),
        ]
    )


def scored(model: PipelineModel, docs: DataFrame) -> DataFrame:
    """(id, split, label, score): probability of the positive label of all rows."""
    return model.transform(docs).select("id", "split", "label", vector_to_array("probability")[1].alias("score"))


def losses(model: PipelineModel, spark: SparkSession) -> DataFrame:
    """(run, epoch, loss): the training loss of each iteration of a classifier just fitted, epoch 0 before the first."""
    return spark.createDataFrame([("hashing_logreg", i, float(x)) for i, x in enumerate(model.stages[-1].summary.objectiveHistory)], "run string, epoch bigint, loss double")  # one row an iteration


def fitted(docs: DataFrame, features: int, iterations: int) -> PipelineModel:
    return pipeline(features, iterations).fit(docs.where("split = 'train' and label is not null"))


def train_and_score(docs: DataFrame, features: int = 1 << 18, iterations: int = 200) -> DataFrame:
    """(id, split, label, score): probability of the positive label of all rows by a model of the labelled training rows."""
    return scored(fitted(docs, features, iterations), docs)


def history(docs: DataFrame, features: int = 1 << 18, iterations: int = 200) -> DataFrame:
    """(run, epoch, loss) of the fit of train_and_score."""
    return losses(fitted(docs, features, iterations), docs.sparkSession)


def masked(vec: str, mode: str, keeps: tuple[str, ...]):
    """The vector, or zeros of its size where the ablation mode leaves it out."""
    return F.col(vec) if mode in keeps else F.transform(F.col(vec), lambda _: F.lit(0.0))


def decide(rows: DataFrame, mode: str = "both", hidden: int = 16, iterations: int = 60, seed: int = 5) -> DataFrame:
    """(id, split, label, score) by a small network on the text and graph vectors, put together after the mode's mask; from (id, split, label, text, kg), both arrays of one size in all rows.

    Learned from the labelled training rows; a table without them raises.
    """
    joined = F.concat(masked("text", mode, ("both", "text_only")), masked("kg", mode, ("both", "ontology_only")))
    x = rows.withColumn("_x", array_to_vector(joined))
    known = x.where("split = 'train' and label is not null")
    width = len(known.select("_x").first()["_x"])
    model = MultilayerPerceptronClassifier(layers=[width, hidden, 2], maxIter=iterations, seed=seed, featuresCol="_x", labelCol="label").fit(known)
    return model.transform(x).select("id", "split", "label", vector_to_array("probability")[1].alias("score"))
