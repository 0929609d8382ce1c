"""Models over governance features with pyspark.ml: a promotion classifier with a gate, and a quality model."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F

FEATURES = ("confidence", "n_citations", "n_sources", "access_count", "age_days")
GATE = 0.65


def _scored(rows: DataFrame, train: DataFrame, classifier) -> DataFrame:
    model = Pipeline(stages=[VectorAssembler(inputCols=list(FEATURES), outputCol="features"), classifier]).fit(train)
    return model.transform(rows).withColumn("probability", vector_to_array("probability")[1])


def promotion_gate(rows: DataFrame, label: str, train: DataFrame) -> DataFrame:
    """Logistic probability; promoted at the gate with at least one citation."""
    x = _scored(rows, train, LogisticRegression(labelCol=label, maxIter=20, regParam=0.01))
    return x.withColumn("promoted", (F.col("probability") >= GATE) & (F.col("n_citations") > 0))


def quality_model(rows: DataFrame, label: str, train: DataFrame) -> DataFrame:
    return _scored(rows, train, GBTClassifier(labelCol=label, maxIter=10, maxDepth=3, seed=7))
