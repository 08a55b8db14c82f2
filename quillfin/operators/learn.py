"""Baseline models on features, by pyspark.ml."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression, MultilayerPerceptronClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fit_and_score(train: DataFrame, test: DataFrame, columns: list[str], y: str = "y", seed: int = 42) -> DataFrame:
    """model, rows, accuracy of the majority, logistic and perceptron baselines on ``test``."""
    stages = [VectorAssembler(inputCols=columns, outputCol="raw", handleInvalid="skip"), StandardScaler(inputCol="raw", outputCol="x", withMean=True)]
    # every pass of every model reads these rows, what they are made from is read once
    kept = StorageLevel.MEMORY_AND_DISK
    models = {
        "logistic": LogisticRegression(featuresCol="x", labelCol=y, maxIter=30, regParam=1e-3),
        "perceptron": MultilayerPerceptronClassifier(featuresCol="x", labelCol=y, layers=[len(columns), 16, 3], maxIter=30, seed=seed),
    }
    train, test = (d.dropna(subset=columns).select(*columns, F.col(y).cast("double").alias(y)).persist(kept) for d in (train, test))
    per = train.groupBy(y).count()
    best = per.agg(F.max(F.struct("count", -F.col(y))).alias("m")).select((-F.element_at(F.array("m.col2"), 1)).alias("prediction"))
    out = test.join(F.broadcast(best)).select(F.lit("majority").alias("model"), y, "prediction")  # one row
    scaler = Pipeline(stages=stages).fit(train)
    train, test = (scaler.transform(d).select("x", y) for d in (train, test))
    for name, m in models.items():
        scored = m.fit(train).transform(test)
        out = out.unionByName(scored.select(F.lit(name).alias("model"), y, "prediction"))
    return out.groupBy("model").agg(F.count(F.lit(1)).alias("rows"), F.avg((F.col(y) == F.col("prediction")).cast("int")).alias("accuracy"))
