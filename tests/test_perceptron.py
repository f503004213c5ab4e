import numpy as np
import pytest
from pyspark.ml.classification import MultilayerPerceptronClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from tierflow.operators import learned, perceptron
from tierflow.operators.routing import action_code

TIERS = ["mysql", "elk", "ipfs"]


def labelled(spark, rows=500, width=3, parts=3, noise=4.0):
    """Overlapping classes; partitions end in shorter blocks."""
    rng = np.random.default_rng(4)
    drawn = [
        (i, [float(x) for x in rng.normal(2 * (i % 3), noise, width)], TIERS[i % 3]) for i in range(rows)
    ]
    schema = "log_id long, vector array<double>, best_destination string"
    return spark.createDataFrame(spark.sparkContext.parallelize(drawn, parts), schema)


def features(df):
    return df.withColumn("features", array_to_vector("vector"))


def stored(df, width):
    return perceptron.stored_blocks(df, F.col("vector"), action_code(F.col("best_destination")), width, 3)


def plain(df, layers, weights):
    """Mean of the blocks' mean losses and its gradient, without Spark."""
    losses, gradients = [], []
    for part in df.rdd.glom().collect():
        for start in range(0, len(part), 128):
            rows = part[start : start + 128]
            x = np.array([r.vector for r in rows])
            target = np.eye(3)[[TIERS.index(r.best_destination) for r in rows]]
            net, at = [], 0
            for a, b in zip(layers, layers[1:]):
                net.append((weights[at : at + a * b].reshape(a, b), weights[at + a * b : at + (a + 1) * b]))
                at += (a + 1) * b
            outs = [x]
            for w, b in net[:-1]:
                outs.append(1 / (1 + np.exp(-(outs[-1] @ w + b))))
            e = np.exp(outs[-1] @ net[-1][0] + net[-1][1])
            p = e / e.sum(axis=1, keepdims=True)
            losses.append(-(target * np.log(p)).sum() / len(rows))
            delta, grads = (p - target) / len(rows), []
            for i in range(len(net) - 1, -1, -1):
                grads = [(outs[i].T @ delta).ravel(), delta.sum(axis=0), *grads]
                delta = (delta @ net[i][0].T) * outs[i] * (1 - outs[i])
            gradients.append(np.concatenate(grads))
    return np.mean(losses), np.mean(gradients, axis=0)


def test_fit_ends_at_the_weights_of_sparks_own_fit(spark):
    df = labelled(spark)
    data = features(df).withColumn("label", action_code(F.col("best_destination")).cast("double"))
    own = MultilayerPerceptronClassifier(layers=[3, 8, 8, 3], maxIter=15, seed=7, blockSize=128).fit(data)
    model = learned.fit_classifier(df, "vector", 3, hidden=(8, 8), max_iter=15)
    assert model.weights.toArray() == pytest.approx(own.weights.toArray(), abs=1e-6)
    assert model.getLayers() == [3, 8, 8, 3] and model.getMaxIter() == 15


def test_destinations_are_found_in_batches_and_as_the_model_says(spark):
    df = labelled(spark, rows=300)
    model = learned.fit_classifier(df, "vector", 3, hidden=(8,), max_iter=10)
    routed = learned.route_learned(df, F.col("vector"), model)
    assert routed.columns == ["log_id", "vector", "best_destination", "raw_destination"]
    plan = routed._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
    said = {r.log_id: TIERS[int(r.prediction)] for r in model.transform(features(df)).collect()}
    assert {r.log_id: r.raw_destination for r in routed.collect()} == said


@pytest.mark.parametrize(("width", "few"), [(3, 64), (3, 1), (200, 64)])
def test_sums_of_a_pass(spark, width, few):
    """Few partial sums, many, and vectors so wide that a block is several pieces."""
    df = labelled(spark, rows=700, width=width)
    layers = [width, 5, 3]
    weights = np.random.default_rng(5).normal(0, 0.3, sum((a + 1) * b for a, b in zip(layers, layers[1:])))
    blocks = stored(df, width)
    assert all(len(r.vectors) <= perceptron.PIECE_BYTES for r in blocks.collect())
    before = spark.conf.get(perceptron.BATCH_SETTING)
    loss, gradient = perceptron.summed(blocks, layers, few)(weights)
    assert spark.conf.get(perceptron.BATCH_SETTING) == before
    wanted, slope = plain(df, layers, weights)
    assert loss == pytest.approx(wanted)
    assert gradient == pytest.approx(slope, abs=1e-12)


def test_rows_are_stored_once_each(spark):
    df = labelled(spark, rows=700)
    kept = stored(df, 3).collect()
    vectors = np.concatenate([np.frombuffer(r.vectors).reshape(-1, 3) for r in kept])
    labels = np.concatenate([np.frombuffer(r.labels, np.uint8) for r in kept])
    told = sorted((*v, TIERS[c]) for v, c in zip(vectors.tolist(), labels))
    assert told == sorted((*r.vector, r.best_destination) for r in df.collect())


@pytest.mark.parametrize("bad", [None, [1.0, 2.0], [1.0, 2.0, None], [1.0, 2.0, float("nan")]])
def test_vectors_that_do_not_fit_are_errors(spark, bad):
    df = spark.createDataFrame(
        [(1, [1.0, 2.0, 3.0], "elk"), (2, bad, "elk")], "log_id long, vector array<double>, best_destination string"
    )
    with pytest.raises(Exception, match="vector"):
        learned.fit_classifier(df, "vector", 3, hidden=(2,), max_iter=1)


def test_optimiser_finds_the_minimum_and_gives_up_where_there_is_none():
    scale = np.array([1.0, 10.0, 100.0])
    found = perceptron.minimised(lambda x: (scale @ (x - 1) ** 2 + 1, 2 * scale * (x - 1)), np.zeros(3), 100)
    assert found == pytest.approx(np.ones(3), abs=1e-3)
    start = np.array([1.0, 2.0])
    seen = []

    def nowhere(x):
        seen.append(x)
        return (1.0 if len(seen) == 1 else float("nan")), np.ones(2)

    assert (perceptron.minimised(nowhere, start, 5) == start).all()
    assert len(seen) == 1 + 2 * perceptron.SEARCH_STEPS
