"""Clusters of the rows no specific regime claims, and how they line up with the regimes."""

from __future__ import annotations

import math
from functools import reduce
from operator import add

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lobwright.operators.regimes import share_within
from lobwright.sources.stages import cut

# The regimes taken as residual.
RESIDUAL = ("BALANCED_TRANSITION", "MILD_LIQUIDITY_STRESS", "UNKNOWN")


def residual_clusters(df: DataFrame, columns, k: int = 3, seed: int = 7):
    """Standardised features, k-means, Gaussian mixture and two principal components of all residual rows."""
    from pyspark.ml import Pipeline
    from pyspark.ml.clustering import GaussianMixture, KMeans
    from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler

    rows = df.filter(F.col("regime").isin(*RESIDUAL)).fillna(0.0, list(columns))
    stages = [
        VectorAssembler(inputCols=list(columns), outputCol="_raw"),
        StandardScaler(inputCol="_raw", outputCol="_scaled", withMean=True, withStd=True),
        KMeans(featuresCol="_scaled", predictionCol="kmeans_cluster", k=k, seed=seed),
        GaussianMixture(featuresCol="_scaled", predictionCol="gmm_cluster", probabilityCol="_gmm", k=k, seed=seed, maxIter=20),
        PCA(inputCol="_scaled", outputCol="_pca", k=2),
    ]
    return Pipeline(stages=stages).fit(rows).transform(rows).drop("_raw", "_scaled", "_gmm")


#: Rounds of the mixture, and what is added to each variance.
ROUNDS = 20
RIDGE = 1e-6

Component = tuple[float, list[float], list[float]]


def standardised(df: DataFrame, columns) -> DataFrame:
    """``z0``, ``z1``, ...: the columns less their mean over their population deviation (1 if it is 0); missing values count as 0."""
    clean = {c: F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(None)), F.lit(0.0)) for c in columns}
    rows = df.withColumns({f"z{i}": clean[c] for i, c in enumerate(columns)})
    fit = rows.agg(*[F.avg(f"z{i}").alias(f"m{i}") for i in range(len(columns))], *[F.stddev_pop(f"z{i}").alias(f"s{i}") for i in range(len(columns))]).first()
    return rows.withColumns({f"z{i}": (F.col(f"z{i}") - F.lit(fit[f"m{i}"])) / F.lit(fit[f"s{i}"] or 1.0) for i in range(len(columns))})


def log_densities(mixture: list[Component]) -> list[Column]:
    """The log of weight times density of a row's ``z`` columns, for each component."""
    def one(weight: float, mean: list[float], variance: list[float]) -> Column:
        start = math.log(weight) - 0.5 * sum(math.log(2 * math.pi * v) for v in variance)
        return F.lit(start) - 0.5 * reduce(add, [F.pow(F.col(f"z{i}") - F.lit(m), F.lit(2.0)) / F.lit(v) for i, (m, v) in enumerate(zip(mean, variance))])

    return [one(*c) for c in mixture]


def fit_mixture(rows: DataFrame, d: int, k: int = 3, rounds: int = ROUNDS) -> list[Component]:
    """A Gaussian mixture with diagonal covariance on the ``d`` columns of ``standardised`` rows, by expectation-maximisation.

    Each round is one aggregation of sufficient statistics: a component's share, and the sums of values and squares it has in
    every column.  Only these k * (1 + 2d) numbers come to the driver.  The start is fixed, the centres one deviation apart along
    the diagonal, and so is the number of rounds: equal rows give equal components, in the same order.
    """
    mixture: list[Component] = [(1 / k, [j - (k - 1) / 2] * d, [1.0] * d) for j in range(k)]
    for _ in range(rounds):
        logs = rows.withColumns({f"_l{j}": c for j, c in enumerate(log_densities(mixture))})
        top = F.greatest(*[F.col(f"_l{j}") for j in range(k)]) if k > 1 else F.col("_l0")
        parts = logs.withColumn("_top", top).withColumns({f"_e{j}": F.exp(F.col(f"_l{j}") - F.col("_top")) for j in range(k)})
        whole = reduce(add, [F.col(f"_e{j}") for j in range(k)])
        shares = parts.withColumns({f"_r{j}": F.col(f"_e{j}") / whole for j in range(k)})
        sums = [F.sum(f"_r{j}").alias(f"n{j}") for j in range(k)]
        for j in range(k):
            for i in range(d):
                z, r = F.col(f"z{i}"), F.col(f"_r{j}")
                sums += [F.sum(r * z).alias(f"x{j}_{i}"), F.sum(r * z * z).alias(f"q{j}_{i}")]
        got = shares.agg(F.count("*").alias("n"), *sums).first()
        if not got["n"]:
            return mixture
        mixture = []
        for j in range(k):
            n = got[f"n{j}"] + 1e-12
            mean = [got[f"x{j}_{i}"] / n for i in range(d)]
            mixture.append((n / got["n"], mean, [max(got[f"q{j}_{i}"] / n - mean[i] ** 2, 0.0) + RIDGE for i in range(d)]))
    return mixture


def principal_axes(rows: DataFrame, d: int, axes: int = 2) -> np.ndarray:
    """The first ``axes`` eigenvectors of the aggregated covariance, the largest entry of each positive; zeros beyond ``d``."""
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    got = rows.agg(*[F.coalesce(F.covar_pop(f"z{i}", f"z{j}"), F.lit(0.0)).alias(f"c{i}_{j}") for i, j in pairs]).first()
    matrix = np.zeros((d, d))
    for i, j in pairs:
        matrix[i, j] = matrix[j, i] = got[f"c{i}_{j}"]
    vectors = np.linalg.eigh(matrix)[1][:, ::-1][:, :axes].T
    signed = vectors * np.sign(vectors[np.arange(len(vectors)), np.abs(vectors).argmax(axis=1)])[:, None]
    return np.vstack([signed, np.zeros((axes - len(signed), d))])


def residual_mixture(df: DataFrame, columns, k: int = 3, rounds: int = ROUNDS) -> tuple[DataFrame, list[Component]]:
    """All residual rows with ``gmm_cluster``, ``pca_x`` and ``pca_y``, and the components; an empty table gives no rows."""
    d = len(columns)
    rows = cut(standardised(df.filter(F.col("regime").isin(*RESIDUAL)), columns), "residual_rows")
    mixture = fit_mixture(rows, d, k, rounds)
    best = F.array(*[F.round(c, 9) for c in log_densities(mixture)])
    placed = rows.withColumn("gmm_cluster", (F.array_position(best, F.array_max(best)) - 1).cast("int"))
    x, y = ([float(v) for v in axis] for axis in principal_axes(rows, d))
    on = lambda axis: reduce(add, [F.col(f"z{i}") * F.lit(v) for i, v in enumerate(axis)])
    return placed.withColumns({"pca_x": on(x), "pca_y": on(y)}).drop(*[f"z{i}" for i in range(d)]), mixture


def alignment(clustered: DataFrame, algorithms: tuple[str, ...] = ("kmeans_cluster", "gmm_cluster")) -> DataFrame:
    """Rows per regime and cluster with their shares within both, for each algorithm."""
    out = None
    for algo in algorithms:
        n = clustered.groupBy("regime", F.col(algo).cast("long").alias("cluster")).agg(F.count("*").alias("n_rows"))
        n = share_within(n, ["regime"], total="regime_rows", share="share_within_regime")
        n = share_within(n, ["cluster"], total="cluster_rows", share="share_within_cluster").withColumn("algorithm", F.lit(algo))
        out = n if out is None else out.unionByName(n)
    return out
