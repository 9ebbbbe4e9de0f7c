"""Attributions against plain enumeration of coalitions."""
from itertools import combinations
from math import comb

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.operators import attribution as AT


def enumerated(x, base, score):
    """Shapley values of one row by their definition."""
    d = len(x)
    v = {s: np.mean([score(np.where(np.isin(range(d), s), x, b)) for b in base])
         for k in range(d + 1) for s in combinations(range(d), k)}
    return [sum((v[tuple(sorted((*s, j)))] - v[s]) / (d * comb(d - 1, len(s)))
                for s in v if j not in s) for j in range(d)]


def frame(spark, x, names):
    return spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], ["id", *names])


def test_few_features_equal_the_definition(spark):
    rng = np.random.default_rng(3)
    x, names = rng.normal(size=(25, 4)), ["a", "b", "c", "e"]
    df = frame(spark, x, names)
    base = AT.background(df, "id", names, 6)
    assert len(base) == 6
    found = AT.shapley(df, "id", names, F.expr("a * b + tanh(c) - 2 * e * a"), base)
    score = lambda r: r[0] * r[1] + np.tanh(r[2]) - 2 * r[3] * r[0]
    for r in found.collect():
        want = enumerated(x[r.id], np.array(base), score)
        assert [r["phi_" + n] for n in names] == pytest.approx(want, abs=1e-9)
        assert r.prediction == pytest.approx(score(x[r.id]))
        assert r.prediction - r.base == pytest.approx(sum(want))
    mean = {r.feature: r.mean_abs for r in AT.mean_attributions(found, names).collect()}
    assert mean["a"] == pytest.approx(np.mean([abs(r.phi_a) for r in found.collect()]))


def test_many_features_by_drawn_coalitions(spark):
    """For a linear score any coalitions of full rank give the exact values; always
    do the values add up."""
    rng = np.random.default_rng(4)
    names = [f"f{i}" for i in range(14)]
    x, w = rng.normal(size=(10, 14)), rng.normal(size=14)
    df = frame(spark, x, names)
    base = AT.background(df, "id", names, 3)
    linear = sum((F.col(n) * float(c) for n, c in zip(names, w)), F.lit(0.0))
    for r in AT.shapley(df, "id", names, linear, base, most=200).collect():
        assert [r["phi_" + n] for n in names] == pytest.approx(list(w * (x[r.id] - np.mean(base, 0))), abs=1e-8)
    for r in AT.shapley(df, "id", names, F.tanh(linear) * F.col("f3"), base, most=200).collect():
        assert r.prediction - r.base == pytest.approx(sum(r["phi_" + n] for n in names), abs=1e-9)


def test_interactions_with_drawn_coalitions_come_near(spark):
    rng = np.random.default_rng(5)
    names = [f"f{i}" for i in range(12)]
    x = rng.normal(size=(4, 12))
    df = frame(spark, x, names)
    score = F.expr("f0 * f1 + f2 * f3 + f4")
    base = AT.background(df, "id", names, 2)
    exact = {r.id: r for r in AT.shapley(df, "id", names, score, base, most=5000).collect()}
    for r in AT.shapley(df, "id", names, score, base, most=1000).collect():
        assert [r["phi_" + n] for n in names] == pytest.approx([exact[r.id]["phi_" + n] for n in names], abs=0.15)


def test_edges(spark):
    df = spark.createDataFrame([(1, 1.0, 2.0), (2, None, 2.0), (3, 4.0, 0.0)], "id long, a double, b double")
    got = {r.id: r for r in AT.shapley(df, "id", ["a", "b"], F.expr("try_divide(a, b)"), [(1.0, 1.0)]).collect()}
    assert got[2].base is None and got[2].phi_a is None and got[2].prediction is None
    assert got[3].phi_a is None and got[3].prediction is None      # a score of null
    assert got[1].phi_a + got[1].phi_b == pytest.approx(0.5 - 1.0)
    one = AT.shapley(df.where("id = 3"), "id", ["a"], F.expr("2 * a"), [(1.0,), (3.0,)]).first()
    assert (one.base, one.prediction, one.phi_a) == (4.0, 8.0, 4.0)
    assert AT.shapley(df.where("id = 1"), "id", ["a", "b"], F.expr("a + b"), []).first().phi_a is None
    assert AT.shapley(df.limit(0), "id", ["a", "b"], F.expr("a + b"), [(1.0, 1.0)]).count() == 0
    assert AT.background(df, "id", ["a", "b"], 10) == AT.background(df.repartition(3), "id", ["a", "b"], 10)
