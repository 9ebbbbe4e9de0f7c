"""Registered queries have the reference's sizes; small checks of what carries them."""
import numpy as np
import pytest

from conftest import SF_SMALL

import __spark_entry__ as E
from quarry.operators import learn
from quarry.operators import topics
from quarry.plans import q_models, q_topics


@pytest.mark.parametrize("sweep,query", [("sweep_lda", q_topics.j12_sweep), ("sweep_lsi", q_topics.j12_sweep_lsi)])
def test_sweeps_cover_2_to_20_topics(spark, monkeypatch, sweep, query):
    seen = {}

    def record(*args, **params):
        seen.update(ks=list(args[4 - (sweep == "sweep_lda")]), **params)
        return spark.createDataFrame([(2, 0.5)], "k int, coherence double"), 2
    monkeypatch.setattr(topics, sweep, record)
    query(spark, SF_SMALL)
    assert seen["ks"] == list(range(2, 21))
    assert "max_iter" not in seen


def test_graph_of_100_neighbours(spark):
    g = E.queries()["d8_knn_graph_100"](spark, SF_SMALL)
    assert g.groupBy("src").count().where("count <> 100").count() == 0


def test_logreg_gd_cv_matches_numpy(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(40, 2))
    y = (x[:, 0] + 0.3 * rng.normal(size=40) > 0).astype(float)
    rows = [(float(a), float(b), float(c), i % 5) for i, ((a, b), c) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "x1 double, x2 double, y double, fold int")
    got = {(r["alpha"], r["fold"]): r for r in learn.logreg_gd_cv(df, ["x1", "x2"], "y", "fold", [0.1, 0.01], 7).collect()}
    assert len(got) == 10
    held = np.arange(40) % 5
    for (alpha, f), r in got.items():
        t = np.zeros(2)
        for _ in range(7):
            t += alpha * x[held != f].T @ (y[held != f] - 1 / (1 + np.exp(-x[held != f] @ t)))
        assert np.allclose(r["theta"], t)
        assert r["accuracy"] == pytest.approx(((1 / (1 + np.exp(-x[held == f] @ t)) >= 0.5) == y[held == f]).mean())


def test_stacking_has_six_base_models(spark):
    assert len(q_models.stacking_base()) == 6
    r = q_models.k11_stacking(spark, SF_SMALL, folds=2, trees=2, rounds=1, epochs=5).first()
    assert r["n"] == 450


def test_gradient_steps_use_all_cores(spark, monkeypatch):
    """Rows that come in one partition are dealt to all cores, in blocks of one fold; none is lost."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(3000, 2))
    rows = [(float(a), float(b), float(a > 0.2), int(i % 3)) for i, (a, b) in enumerate(x)]
    df = spark.createDataFrame(rows, "x1 double, x2 double, y double, fold int").coalesce(1)
    want = {(r["alpha"], r["fold"]): r for r in learn.logreg_gd_cv(df, ["x1", "x2"], "y", "fold", [0.1, 1e-3], 5).collect()}
    monkeypatch.setattr(learn, "BLOCK_ROWS", 100)
    monkeypatch.setattr(learn, "STEP_ROWS", 64)
    seen, plain = [], learn._ascend
    monkeypatch.setattr(learn, "_ascend", lambda blocks, *rest: (seen.append(blocks.map(lambda b: (b[2], len(b[1]))).glom().collect()), plain(blocks, *rest))[1])
    got = {(r["alpha"], r["fold"]): r for r in learn.logreg_gd_cv(df, ["x1", "x2"], "y", "fold", [0.1, 1e-3], 5).collect()}
    per_task = [sum(n for _, n in task) for task in seen[0]]
    assert len(per_task) == min(30, spark.sparkContext.defaultParallelism) and sum(per_task) == 3000
    assert max(per_task) <= 3000 / len(per_task) + 2 * 64
    assert got.keys() == want.keys()
    for key, r in got.items():
        assert np.allclose(r["theta"], want[key]["theta"]) and r["accuracy"] == want[key]["accuracy"]


@pytest.mark.parametrize("scale", [1.0, 100.0, 1e4, 1e300])
def test_residuals_of_saturated_rows(scale):
    rng = np.random.default_rng(5)
    x, theta = rng.normal(size=(3, 500)), rng.normal(size=(4, 3)) * scale
    y = (x[0] > 0).astype(float)
    with np.errstate(over="ignore"):
        want = y - 1 / (1 + np.exp(-(theta @ x)))
    assert np.abs(learn._residuals(theta, x, y) - want).max() < 1e-25
