import numpy as np

from lobwright.operators.cluster import RESIDUAL, RIDGE, ROUNDS, fit_mixture, residual_mixture, standardised


def table(spark, n=400):
    rng = np.random.default_rng(5)
    at = rng.integers(0, 3, n)
    x = np.column_stack([rng.normal((at - 1) * 4, 1), rng.normal(at * 3, 0.5), rng.normal(0, 2, n), np.ones(n)])
    rows = [(("OTHER", *RESIDUAL)[i % 4], *map(float, v)) for i, v in enumerate(x)]
    keep = np.array([i % 4 > 0 for i in range(n)])
    return spark.createDataFrame(rows, "regime string, a double, b double, c double, d double"), x[keep], at[keep]


def em(z, k=3):
    """The same steps on one array."""
    w, m, v = np.full(k, 1 / k), np.tile(np.arange(k)[:, None] - (k - 1) / 2, (1, z.shape[1])), np.ones((k, z.shape[1]))
    for _ in range(ROUNDS):
        logs = np.log(w) - 0.5 * (((z[:, None] - m) ** 2 / v) + np.log(2 * np.pi * v)).sum(axis=2)
        r = np.exp(logs - logs.max(axis=1, keepdims=True))
        r /= r.sum(axis=1, keepdims=True)
        n = r.sum(axis=0)
        w, m = n / len(z), (r.T @ z) / n[:, None]
        v = np.maximum((r.T @ z**2) / n[:, None] - m**2, 0) + RIDGE
    return w, m, v


def test_mixture_and_axes_as_numpy(spark):
    df, x, at = table(spark)
    placed, mixture = residual_mixture(df, ["a", "b", "c", "d"])
    std = x.std(axis=0)
    z = (x - x.mean(axis=0)) / np.where(std == 0, 1, std)
    w, m, v = em(z)
    assert np.allclose([c[0] for c in mixture], w, atol=1e-9) and np.allclose([c[1] for c in mixture], m, atol=1e-8) and np.allclose([c[2] for c in mixture], v, atol=1e-8)
    got = placed.orderBy("a").collect()
    order = x[:, 0].argsort()
    assert np.mean([r.gmm_cluster for r in got] == at[order]) > 0.97 and {r.regime for r in got} == set(RESIDUAL)
    values, vectors = np.linalg.eigh(np.cov(z.T, bias=True))
    for name, axis in (("pca_x", vectors[:, -1]), ("pca_y", vectors[:, -2])):
        axis = axis * np.sign(axis[np.abs(axis).argmax()])
        assert np.allclose([r[name] for r in got], (z @ axis)[order], atol=1e-8)


def test_missing_values_and_no_rows(spark):
    df = spark.createDataFrame([("UNKNOWN", None), ("UNKNOWN", float("nan")), ("UNKNOWN", 2.0), ("UNKNOWN", 0.0)], "regime string, a double")
    z = sorted(r.z0 for r in standardised(df, ["a"]).collect())
    assert np.allclose(z, [-(3**-0.5)] * 3 + [3**0.5])
    placed, mixture = residual_mixture(df.limit(0), ["a"])
    assert placed.count() == 0 and mixture == fit_mixture(standardised(df.limit(0), ["a"]), 1)
