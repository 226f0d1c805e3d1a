"""Classifiers of pair features: a perceptron, random forests, extra trees; a registry that skips what is missing.

Spark's perceptron has sigmoid hidden units and L-BFGS, and takes no weights, so class weights are met by resampling.
Extra trees (random thresholds, Geurts et al. 2006) have no Spark class: each tree is grown by numpy in one group.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _assembled(rows: DataFrame, features: list[str]):
    from pyspark.ml.feature import VectorAssembler

    return VectorAssembler(inputCols=features, outputCol="features").transform(rows)


def _probabilities(rows: DataFrame, classes: int) -> DataFrame:
    from pyspark.ml.functions import vector_to_array

    p = vector_to_array("probability")
    return rows.withColumn("p", F.transform(F.sequence(F.lit(0), F.lit(classes - 1)), lambda i: F.coalesce(F.get(p, i), F.lit(0.0)))).drop("rawPrediction", "probability", "features")


def random_forest(train: DataFrame, test: DataFrame, features: list[str], label: str = "y", classes: int = 4, trees: int = 300, seed: int = 13) -> DataFrame:
    """test with prediction and p (probabilities of all classes)."""
    from pyspark.ml.classification import RandomForestClassifier

    model = RandomForestClassifier(labelCol=label, numTrees=trees, minInstancesPerNode=2, seed=seed).fit(_assembled(train, features))
    return _probabilities(model.transform(_assembled(test, features)), classes)


def fit_perceptron(train: DataFrame, features: list[str], label: str = "y", classes: int = 4, hidden: int = 64, epochs: int = 120, seed: int = 13, balanced: bool = False):
    """A fitted network with one hidden layer; balanced: training rows are resampled to equal classes by the class weights."""
    from pyspark.ml.classification import MultilayerPerceptronClassifier

    if balanced:
        counts = train.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
        total = counts.agg(F.max("n").alias("most"))
        times = counts.join(F.broadcast(total)).select(label, (F.col("most") / F.col("n")).alias("times"))
        copies = F.floor("times") + (F.rand(seed) < F.col("times") - F.floor("times")).cast("int")
        train = train.join(F.broadcast(times), label).withColumn("copies", copies.cast("int")).withColumn("copy", F.explode(F.sequence(F.lit(1), F.greatest("copies", F.lit(1))))).drop("times", "copies", "copy")
    return MultilayerPerceptronClassifier(labelCol=label, layers=[len(features), hidden, classes], maxIter=epochs, seed=seed).fit(_assembled(train, features))


def perceptron(train: DataFrame, test: DataFrame, features: list[str], label: str = "y", classes: int = 4, **options) -> DataFrame:
    """test with prediction and p; options: those of fit_perceptron."""
    return scored(fit_perceptron(train, features, label, classes, **options), test, features, classes)


def scored(model, test: DataFrame, features: list[str], classes: int = 4) -> DataFrame:
    """test with a fitted Spark model's prediction and p."""
    return _probabilities(model.transform(_assembled(test, features)), classes)


def parameters(inputs: int, hidden: int, classes: int = 4) -> int:
    """Weights and biases of a network with one hidden layer."""
    return inputs * hidden + hidden + hidden * classes + classes


def _grow(x: np.ndarray, y: np.ndarray, classes: int, rng: np.random.Generator, least: int, tries: int) -> list:
    """Nodes (feature, threshold, left, right, probabilities) of one tree, the root first."""
    nodes: list = []
    todo = [(np.arange(len(y)), 0)]
    nodes.append(None)
    while todo:
        own, at = todo.pop()
        counts = np.bincount(y[own], minlength=classes)
        best = None
        if len(own) >= 2 * least and (counts > 0).sum() > 1:
            lo, hi = x[own].min(0), x[own].max(0)
            for f in rng.permutation(np.flatnonzero(hi > lo))[:tries]:
                t = rng.uniform(lo[f], hi[f])
                left = x[own, f] <= t
                n = left.sum()
                if n < least or len(own) - n < least:
                    continue
                a = np.bincount(y[own[left]], minlength=classes)
                b = counts - a
                impurity = n - (a * a).sum() / n + (len(own) - n) - (b * b).sum() / (len(own) - n)
                if best is None or impurity < best[0]:
                    best = (impurity, f, t, left)
        if best is None:
            nodes[at] = (-1, 0.0, -1, -1, (counts / counts.sum()).tolist())
            continue
        _, f, t, left = best
        nodes[at] = (int(f), float(t), len(nodes), len(nodes) + 1, [])
        nodes += [None, None]
        todo += [(own[left], nodes[at][2]), (own[~left], nodes[at][3])]
    return nodes


def grow_forest(train: DataFrame, features: list[str], label: str = "y", classes: int = 4, trees: int = 300, seed: int = 13, least: int = 2, most_rows: int = 200_000) -> list[str]:
    """Trees as JSON.  They grow in parallel, one group each, on the same bounded training rows (most_rows, by a hash of
    the features), which are broadcast."""
    spark = train.sparkSession
    rows = train.select(*features, label).orderBy(F.xxhash64(*features, label)).limit(most_rows).toPandas()
    data = spark.sparkContext.broadcast((rows[features].to_numpy(float), rows[label].to_numpy(int)))
    tries = max(1, int(np.sqrt(len(features))))

    def grow(key: tuple, _: pd.DataFrame) -> pd.DataFrame:
        import json

        x, y = data.value
        return pd.DataFrame({"tree": [json.dumps(_grow(x, y, classes, np.random.default_rng([seed, int(key[0])]), least, tries))]})

    return [r["tree"] for r in spark.range(trees).groupBy("id").applyInPandas(grow, "tree string").collect()]


def score_forest(trees: list[str], test: DataFrame, features: list[str], classes: int = 4) -> DataFrame:
    """test with prediction and p; rows are scored in batches by all trees."""
    forest = test.sparkSession.sparkContext.broadcast(trees)

    def score(batches):
        import json

        tables = []
        for text in forest.value:
            nodes = json.loads(text)
            tables.append((np.array([n[0] for n in nodes]), np.array([n[1] for n in nodes]), np.array([n[2:4] for n in nodes]), np.array([n[4] or [0.0] * classes for n in nodes])))
        for frame in batches:
            x = frame[features].to_numpy(float)
            p = np.zeros((len(x), classes))
            for feature, threshold, child, leaf in tables:
                at = np.zeros(len(x), int)
                while len(x):
                    f = feature[at]
                    if (f < 0).all():
                        break
                    right = x[np.arange(len(x)), np.maximum(f, 0)] > threshold[at]
                    at = np.where(f < 0, at, child[at, right.astype(int)])
                p += leaf[at]
            p /= max(1, len(tables))
            yield frame.assign(prediction=p.argmax(1).astype(float) if len(p) else [], p=list(p))

    types = ", ".join(f"`{n}` {t}" for n, t in test.dtypes)
    return test.mapInPandas(score, f"{types}, prediction double, p array<double>")


def extra_trees(train: DataFrame, test: DataFrame, features: list[str], label: str = "y", classes: int = 4, trees: int = 300, seed: int = 13, least: int = 2, most_rows: int = 200_000) -> DataFrame:
    """test with prediction and p."""
    return score_forest(grow_forest(train, features, label, classes, trees, seed, least, most_rows), test, features, classes)


def loss_history(model) -> list[tuple[int, float]]:
    """(iteration, loss) of a fitted perceptron at the first, each 20th and the last iteration."""
    losses = list(model.summary().objectiveHistory)
    kept = [i for i in range(len(losses)) if i == 0 or (i + 1) % 20 == 0 or i + 1 == len(losses)]
    return [(i + 1, float(losses[i])) for i in kept]


def spread(stats: DataFrame) -> DataFrame:
    """One row: the smallest and the largest deviation of the features."""
    return stats.agg(F.min("std").alias("std_min"), F.max("std").alias("std_max"))


BACKENDS: dict[str, Callable] = {"mlp": perceptron, "random_forest": random_forest, "extra_trees": extra_trees}


def run_backends(names: str, train: DataFrame, test: DataFrame, features: list[str], **options) -> tuple[dict[str, DataFrame], list[str]]:
    """Predictions by backend name, and the names that were skipped because they are unknown or fail to load."""
    done, skipped = {}, []
    for name in (x.strip() for x in names.split(",")):
        if not name:
            continue
        try:
            if name in BACKENDS:
                done[name] = BACKENDS[name](train, test, features, **options)
                continue
        except ImportError:
            pass
        skipped.append(name)
    return done, skipped
