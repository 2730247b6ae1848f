"""Logistic regression and its scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_ITERATIONS = 10
REGULARISATION = 0.3
ELASTIC_NET = 0.8


def fit(
    labelled: DataFrame,
    max_iter: int = MAX_ITERATIONS,
    reg_param: float = REGULARISATION,
    elastic_net: float = ELASTIC_NET,
) -> LogisticRegressionModel:
    """A model over ``label, features``."""
    learner = LogisticRegression(maxIter=max_iter, regParam=reg_param, elasticNetParam=elastic_net)
    return learner.fit(labelled.select("label", "features"))


def with_features(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``df`` with the numeric ``columns`` as one ``features`` vector."""
    return VectorAssembler(inputCols=list(columns), outputCol="features").transform(df)


def score(model: LogisticRegressionModel, df: DataFrame) -> DataFrame:
    """``df`` without its vectors, with ``score`` (probability of 1) and ``prediction``."""
    scored = model.transform(df)
    return scored.withColumn("score", vector_to_array(F.col("probability"))[1]).drop(
        "features", "rawPrediction", "probability"
    )
