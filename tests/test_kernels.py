"""Kernel features against exact kernels, and fits against their optimality condition."""
import numpy as np
from pyspark.sql import functions as F

from quarry.operators import kernels as KN
from quarry.operators.learn import _packed


def _points(n, d=4, seed=1):
    return np.random.default_rng(seed).normal(size=(n, d))


def test_fourier_and_sketch_approach_their_kernels():
    x, z = _points(40), _points(40, seed=2)
    exact = np.exp(-0.2 * ((x[:, None] - z[None]) ** 2).sum(2))
    m = KN.Fourier.draw(4, 20000, 0.2)
    assert np.abs(m(x) @ m(z).T - exact).max() < 0.05
    exact = (0.3 * x @ z.T + 1.0) ** 3
    m = KN.TensorSketch.draw(4, 4096, 0.3, 3, 1.0)
    norms = np.sqrt(np.outer((0.3 * (x * x).sum(1) + 1) ** 3, (0.3 * (z * z).sum(1) + 1) ** 3))
    assert (np.abs(m(x) @ m(z).T - exact) / norms).max() < 0.1


def test_landmarks_give_the_positive_part():
    x = _points(30)
    k = np.tanh(0.1 * x @ x.T)
    values, vectors = np.linalg.eigh(k)
    positive = (vectors * np.where(values > 1e-9 * np.abs(values).max(), values, 0)) @ vectors.T
    z = KN.Landmarks.of(x, 0.1)(x)
    assert np.allclose(z @ z.T, positive, atol=1e-8)


def _rings(spark, n=600):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(n, 2))
    y = (x[:, 0] * x[:, 1] * x[:, 0] + 0.3 * x[:, 1] > 0).astype(int)
    rows = [(i, float(a), float(b), int(t), i % 3) for i, ((a, b), t) in enumerate(zip(x, y))]
    rows += [(n, None, 1.0, 1, 0), (n + 1, 0.5, 0.5, None, 1)]
    return spark.createDataFrame(rows, "id long, a double, b double, label int, fold int").repartition(4), x, y


def test_fits_are_optimal_and_keep_out_their_fold(spark):
    df, x, y = _rings(spark)
    maps = [KN.Fourier.draw(2, 24, 0.5), KN.TensorSketch.draw(2, 24, 0.5)]
    fits = [(m, c, f) for m in (0, 1) for c in (0.1, 100.0) for f in (0, 2)]
    blocks = _packed(df, ["a", "b"], "label", "fold")
    weights = KN.fit_together(blocks, maps, fits, [24, 24])
    blocks.unpersist()
    sign, fold = 2.0 * y - 1, np.arange(len(x)) % 3
    for (m, c, f), w in zip(fits, weights):
        z = np.hstack([maps[m](x), np.ones((len(x), 1))])[fold != f]
        s = sign[fold != f]
        gap = np.maximum(0, 1 - s * (z @ w))
        gradient = np.r_[w[:-1], 0] - 2 * c * z.T @ (s * gap)
        assert np.abs(gradient).max() < 1e-4 * max(1.0, 2 * c * len(s) / 10)


def test_moments_of_a_block_are_shared_by_its_fits():
    rng = np.random.default_rng(6)
    z, sign, f = rng.normal(size=(500, 6)), rng.choice([-1.0, 1.0], 500), rng.integers(0, 3, 500)
    weights = 0.3 * rng.normal(size=(6, 1)) + 0.05 * rng.normal(size=(6, 7))
    weights[:, 5] = 5.0
    held = [0, 1, 2, 0, 1, 2, 9]            # one fold without rows
    for j, (zz, zy, loss) in enumerate(KN._block_moments(z, sign, f, weights, held)):
        gap = 1 - sign * (z @ weights[:, j])
        at = (gap > 0) & (f != held[j])
        assert np.allclose(zz, z[at].T @ z[at]) and np.allclose(zy, z[at].T @ sign[at]) and np.isclose(loss, (gap[at] ** 2).sum())


def test_grid(spark):
    df, _, y = _rings(spark)
    found = KN.kernel_grid(df, ["a", "b"], "label", "id", "fold", gamma_names=("scale", 0.1), costs=(0.1, 100), width=32).collect()
    assert len(found) == 12 and sum(r.best for r in found) == 1
    best = max(found, key=lambda r: r.accuracy)
    assert best.accuracy == next(r.accuracy for r in found if r.best) > max(y.mean(), 1 - y.mean()) + 0.2
    assert KN.kernel_grid(df.where("id < 0"), ["a", "b"], "label", "id", "fold", width=8).count() == 0


def test_wide_rows_are_dealt_by_their_size(spark):
    """More rows make more partitions, none wider than asked for."""
    from quarry.operators import learn as LN
    d = spark.range(6000).selectExpr("id AS row_id", "id % 7 AS x")
    got = LN.dealt(d, ["row_id", "x"], 100, part_bytes=100 * 8 * 300)
    sizes = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
    assert got.rdd.getNumPartitions() == max(20, spark.sparkContext.defaultParallelism)
    assert sum(sizes) == 6000 and max(sizes) < 600


def test_the_svm_fit_gets_what_it_reads_and_no_second_copy(spark, monkeypatch):
    """The fit keeps blocks of the features itself: rows beside them would be kept for nothing."""
    from conftest import SF_SMALL
    from quarry.operators import learn
    from quarry.plans import q_models
    seen, make = [], learn.estimator

    class Spy:
        def __init__(self, est):
            self.est = est

        def fit(self, train):
            seen.append((train.columns, train.storageLevel.useMemory or train.storageLevel.useDisk))
            return self.est.fit(train)
    monkeypatch.setattr(learn, "estimator", lambda kind, **params: Spy(make(kind, **params)))
    assert q_models.k9_svm_rff(spark, SF_SMALL).count() == 1
    assert seen == [(["features", "label"], False)]
