"""Learners: kernel and feed-forward models, clustering. Fits iterate over Spark jobs.

What reaches the driver is of fixed size: weights, centres, a small eigenproblem over a stated dimension.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.ml.classification import LinearSVC, LogisticRegression, MultilayerPerceptronClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dockyard.functions.metrics import roc_auc
from dockyard.operators.lineage import kept


def _vectors(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn("_x", array_to_vector(F.col(column).cast("array<double>")))


def kronecker_features(pairs: DataFrame, prot: DataFrame, mol: DataFrame, once: bool = False) -> DataFrame:
    """``x``: all products of a protein's and a molecule's features, whose inner product is the product of both kernels.

    ``once``: the pairs and their entities' features are kept as a table, in columns that repeat and compress; fits and scores
    that read the result many times then make the products alone, and shuffle nothing.
    """
    met = pairs.join(prot.hint("merge"), "prot_id").join(mol.hint("merge"), "mol_id")  # compressed files look small enough to broadcast
    met = kept(met) if once else met
    return met.withColumn("x", F.flatten(F.transform("pf", lambda a: F.transform("mf", lambda b: a * b))))


def linear_svm(train: DataFrame, c: float = 1.0) -> object:
    """Support vector machine on explicit features ``x`` and labels ``y``, classes balanced by weight."""
    n = {r.y: r.n for r in train.groupBy("y").agg(F.count("*").alias("n")).collect()}
    total = sum(n.values())
    weight = F.when(F.col("y") == 1, total / (2 * max(1, n.get(1, 0)))).otherwise(total / (2 * max(1, n.get(0, 0))))
    data = _vectors(train, "x").select("_x", F.col("y").cast("double").alias("y"), weight.alias("w"))
    return LinearSVC(featuresCol="_x", labelCol="y", weightCol="w", regParam=1 / (c * max(1, total)), maxIter=30).fit(data)


def fourier_features(df: DataFrame, column: str, size: int, gamma: float, count: int = 64, seed: int = 92) -> DataFrame:
    """Random Fourier features ``x`` of the RBF kernel exp(-gamma |a - b|^2) of an array column of ``size`` entries."""
    rng = np.random.default_rng(seed)
    w, shift = rng.standard_normal((count, size)) * math.sqrt(2 * gamma), rng.uniform(0, 2 * math.pi, count)
    rows = F.array(*[F.struct(F.array(*map(F.lit, map(float, r))).alias("w"), F.lit(float(s)).alias("b")) for r, s in zip(w, shift)])
    v = F.col(column).cast("array<double>")
    dot = lambda r: F.aggregate(F.zip_with(v, r["w"], lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    return df.withColumn("x", F.transform(rows, lambda r: F.cos(dot(r) + r["b"]) * math.sqrt(2 / count)))


def margins(model, df: DataFrame) -> DataFrame:
    """Scores of a fitted linear machine in column ``score``."""
    out = model.transform(_vectors(df, "x"))
    return out.withColumn("score", vector_to_array("rawPrediction")[1]).drop("_x", "rawPrediction", "prediction")


def feed_forward(train: DataFrame, column: str, label: str, layers: list[int], seed: int = 92):
    """Multilayer perceptron on an array column."""
    data = _vectors(train, column).select("_x", F.col(label).cast("double").alias("y"))
    return MultilayerPerceptronClassifier(featuresCol="_x", labelCol="y", layers=layers, seed=seed, maxIter=40).fit(data)


def kmeans_folds(df: DataFrame, key: str, column: str, k: int, seed: int = 92) -> DataFrame:
    """Clusters as folds, for splits between unlike examples."""
    data = _vectors(df, column)
    model = KMeans(featuresCol="_x", predictionCol="fold", k=k, seed=seed).fit(data)
    return model.transform(data).select(key, "fold")


def principal_axes(df: DataFrame, key: str, column: str, k: int | None = None, ratio: float = 0.9) -> DataFrame:
    """Principal components of an array column (a linear kernel's PCA), centred: the first ``k``, or as many as hold
    ``ratio`` of the variance."""
    size = len(df.select(column).where(F.col(column).isNotNull()).first()[0])
    data = StandardScaler(inputCol="_x", outputCol="_c", withMean=True, withStd=False).fit(_vectors(df, column)).transform(_vectors(df, column))
    model = PCA(k=k or size, inputCol="_c", outputCol="_p").fit(data)
    held = np.cumsum(model.explainedVariance.toArray())
    kept = k or min(size, int(np.searchsorted(held, ratio)) + 1)
    return model.transform(data).select(key, F.slice(vector_to_array("_p"), 1, kept).alias("components"))


def complete_linkage(kernel: DataFrame, group: DataFrame, clusters: int, most: int = 2000) -> DataFrame:
    """Clusters of the members (``id``) of each group (``g``) by complete linkage on the distance 1 - k.

    Agglomeration needs all distances of a group in one task, so groups have at most ``most`` members; a larger one is
    an error and calls for ``kmeans_folds``.
    """
    largest = group.groupBy("g").agg(F.count("*").alias("n")).agg(F.max("n").alias("n")).first()[0]
    if largest and largest > most:
        raise ValueError(f"a group has {largest} members; at most {most} can be clustered by linkage")
    met = kernel.join(group.toDF("i", "g"), "i").join(group.toDF("j", "h"), "j").where("g = h").select("g", "i", "j", "k")

    def merged(rows: pd.DataFrame) -> pd.DataFrame:
        ids = np.unique(rows[["i", "j"]].to_numpy())
        at = {v: n for n, v in enumerate(ids)}
        d = np.ones((len(ids), len(ids)))
        i, j = rows["i"].map(at).to_numpy(), rows["j"].map(at).to_numpy()
        d[i, j] = d[j, i] = 1 - rows["k"].to_numpy()
        np.fill_diagonal(d, np.inf)
        label = np.arange(len(ids))
        for _ in range(max(0, len(ids) - clusters)):
            a, b = sorted(divmod(int(d.argmin()), len(ids)))
            d[a] = d[:, a] = np.maximum(d[a], d[b])
            d[b] = d[:, b] = np.inf
            d[a, a] = np.inf
            label[label == b] = a
        _, code = np.unique(label, return_inverse=True)
        return pd.DataFrame({"g": rows["g"].iloc[0], "id": ids, "cluster": code})

    kind = dict(group.dtypes)
    return met.groupBy("g").applyInPandas(merged, f"g {kind['g']}, id {kind['id']}, cluster long")


def best_svm(train: DataFrame, val: DataFrame, grid) -> tuple[object, float, float]:
    """The machine of the C in ``grid`` with the highest area under the ROC curve on ``val``; ties go to the smaller C."""
    found = []
    for c in sorted(grid):
        model = linear_svm(train, c)
        area = roc_auc(margins(model, val).select("y", "score", F.lit(0).alias("g")), ["g"]).first()["rocauc"]
        found.append((model, c, area))
    return max(found, key=lambda f: f[2])


def probabilities(known: DataFrame, scored: DataFrame) -> DataFrame:
    """``scored`` with ``probability``: a logistic curve of ``score`` fitted on the labels ``y`` of ``known``."""
    row = lambda df: df.withColumn("_s", array_to_vector(F.array(F.col("score"))))
    data = row(known).select("_s", F.col("y").cast("double").alias("y"))
    curve = LogisticRegression(featuresCol="_s", labelCol="y", maxIter=50).fit(data)
    out = curve.transform(row(scored).withColumnRenamed("y", "_y")).withColumnRenamed("_y", "y")
    chance = vector_to_array("probability")[1].alias("probability")
    return out.select(*scored.columns, chance)


def ridge(train: DataFrame, strength: float = 0.01):
    """Least squares on explicit features ``x`` and targets ``y``; on Fourier features, kernel ridge regression."""
    data = _vectors(train, "x").select("_x", F.col("y").cast("double").alias("y"))
    return LinearRegression(featuresCol="_x", labelCol="y", regParam=strength).fit(data)


def predictions(model, df: DataFrame) -> DataFrame:
    return model.transform(_vectors(df, "x")).withColumnRenamed("prediction", "score").drop("_x")
