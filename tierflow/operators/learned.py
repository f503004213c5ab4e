"""Learned policy on continuous observations.

The best-rewarded destination of each log is its label and a small neural
classifier is fitted to it.  This plays the part of an actor trained live, but
it is not the same algorithm.
"""

from collections.abc import Sequence

import numpy as np
from pyspark.ml.classification import (
    MultilayerPerceptronClassificationModel,
    MultilayerPerceptronClassifier,
)
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tierflow.operators import perceptron
from tierflow.operators.routing import action_code, action_destination
from tierflow.schemas import TIERS

# Hidden layers of the policy network.
HIDDEN = (128, 128)


def fit_classifier(
    labelled: DataFrame,
    vector: str,
    width: int,
    hidden: Sequence[int] = HIDDEN,
    max_iter: int = 50,
    seed: int = 7,
) -> MultilayerPerceptronClassificationModel:
    """Fit on ``vector`` and ``best_destination``; gradients are summed by Spark."""
    layers = [width, *hidden, len(TIERS)]
    blocks = perceptron.stored_blocks(
        labelled, F.col(vector), action_code(F.col("best_destination")), width, len(TIERS)
    )
    start = unfitted(labelled.sparkSession, layers, seed=seed).weights.toArray()
    fitted = perceptron.minimised(perceptron.summed(blocks, layers), start, max_iter)
    model = unfitted(labelled.sparkSession, layers, seed=seed, weights=fitted)
    model.set(model.maxIter, max_iter)
    return model


def unfitted(
    spark: SparkSession, layers: Sequence[int], seed: int, weights: np.ndarray | None = None
) -> MultilayerPerceptronClassificationModel:
    """Spark's model before any step: with the weights given, or drawn by the seed."""
    row = spark.createDataFrame([(Vectors.dense([0.0] * layers[0]), 0.0)], ["features", "label"])
    network = MultilayerPerceptronClassifier(
        layers=list(layers), maxIter=0, seed=seed, blockSize=perceptron.BLOCK
    )
    # Spark takes a None for weights that are given, and forgets the seed.
    if weights is not None:
        network.setInitialWeights(Vectors.dense(weights))
    return network.fit(row)


def route_learned(
    logs: DataFrame, vector: Column, model: MultilayerPerceptronClassificationModel
) -> DataFrame:
    """Most likely destination of each log."""
    found = perceptron.predicted(model.getLayers(), model.weights.toArray(), vector)
    return (
        logs.withColumn("_class", found)
        .withColumn("raw_destination", action_destination(F.col("_class")))
        .drop("_class")
    )
