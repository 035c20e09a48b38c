"""Classifiers of labelled pairs on Spark's own learners; all relations in one model or one each."""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier, MultilayerPerceptronClassifier
from pyspark.ml.feature import OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def weighted(train: DataFrame) -> DataFrame:
    """Adds ``weight``: negatives per positive for positives, 1 for negatives; two numbers reach the driver."""
    n = train.agg(F.count_if(F.col("label") == 1).alias("p"), F.count_if(F.col("label") == 0).alias("n")).first()
    return train.withColumn("weight", F.when(F.col("label") == 1, F.lit(n["n"] / max(n["p"], 1))).otherwise(F.lit(1.0)))


def _vectors(df: DataFrame) -> DataFrame:
    return df.withColumn("raw", array_to_vector("features")).withColumn("label", F.col("label").cast("double"))


def _category(data: DataFrame, category: str):
    return StringIndexer(inputCol=category, outputCol="category_index", handleInvalid="keep").fit(data.filter("fold = 'train'"))


def gbt_scores(folded: DataFrame, keep: list[str], rounds: int = 10, depth: int = 3, category: str | None = None) -> DataFrame:
    """Scores of the rows outside the train fold by boosted trees fitted on the train fold.

    ``folded`` has ``features`` (array), ``label`` and ``fold``.  With a category column its
    index is a further feature, so one model serves all relations; it may have any number
    of values.
    """
    data = _vectors(folded)
    columns, bins = ["raw"], 32
    if category:
        index = _category(data, category)
        data, bins = index.transform(data), max(bins, len(index.labels) + 1)  # one more for values without training rows
        columns.append("category_index")
    data = VectorAssembler(inputCols=columns, outputCol="x").transform(data)
    train = weighted(data.filter("fold = 'train'"))
    if category and train.limit(bins).count() < bins:  # the learner wants no fewer rows than categories; two of each row fit the same trees
        train = train.unionByName(train)
    model = GBTClassifier(featuresCol="x", weightCol="weight", maxIter=rounds, maxDepth=depth, maxBins=bins, stepSize=0.3, seed=42).fit(train)
    scored = model.transform(data.filter("fold <> 'train'"))
    return scored.select(*keep, F.col("label").cast("int").alias("label"), F.round(vector_to_array("probability")[1], 6).alias("score"))


def mlp_scores(folded: DataFrame, keep: list[str], hidden: tuple[int, ...] = (32, 16), rounds: int = 30, category: str | None = None) -> DataFrame:
    """Scores of the rows outside the train fold by a multilayer perceptron on standardised features.

    A category column adds one input for each of its values.
    """
    data = _vectors(folded)
    data = StandardScaler(inputCol="raw", outputCol="scaled", withMean=True).fit(data.filter("fold = 'train'")).transform(data)
    columns = ["scaled"]
    if category:
        data = _category(data, category).transform(data)
        data = OneHotEncoder(inputCol="category_index", outputCol="category_inputs").fit(data).transform(data)
        columns.append("category_inputs")
    data = VectorAssembler(inputCols=columns, outputCol="x").transform(data)
    train = data.filter("fold = 'train'")
    width = train.select("x").first()["x"].size
    model = MultilayerPerceptronClassifier(featuresCol="x", layers=[width, *hidden, 2], maxIter=rounds, seed=42).fit(train)
    scored = model.transform(data.filter("fold <> 'train'"))
    return scored.select(*keep, F.col("label").cast("int").alias("label"), F.round(vector_to_array("probability")[1], 6).alias("score"))
