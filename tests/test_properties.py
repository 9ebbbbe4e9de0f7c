"""Property tests (hypothesis): distributed ranking and curve metrics against
plain pandas / numpy definitions on random inputs."""
import numpy as np
import pandas as pd
from hypothesis import given, settings
from hypothesis import strategies as st

from quarry.operators import metrics
from quarry.plans.ranking import prefix_sums

rows = st.lists(st.tuples(st.integers(0, 3), st.integers(-5, 5)), min_size=1, max_size=60)


@settings(max_examples=4, deadline=None)
@given(rows, st.integers(1, 5))
def test_prefix_sums_equal_pandas(spark, data, parts):
    pdf = pd.DataFrame(data, columns=["g", "v"])
    pdf["k"] = range(len(pdf))
    df = spark.createDataFrame(pdf[["k", "g", "v"]].astype("int64"))
    got = prefix_sums(df, ["v", "k"], ["v"], ["g"], num_partitions=parts).toPandas()
    want = pdf.sort_values(["g", "v", "k"])
    want["rn"] = want.groupby("g").cumcount() + 1
    want["cs"] = want.groupby("g")["v"].cumsum()
    m = got.merge(want, on="k")
    assert (m["_rn"] == m["rn"]).all() and (m["cum_v"] == m["cs"]).all()


@settings(max_examples=4, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 1), st.integers(0, 6)), min_size=2, max_size=80))
def test_curves_monotone_and_auc_pairwise(spark, data):
    y = np.array([a for a, _ in data])
    s = np.array([b / 6 for _, b in data])
    if y.min() == y.max():
        return
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, s)], "label int, score double")
    roc = metrics.roc_curve(df).toPandas().sort_values("threshold", ascending=False)
    assert (np.diff(roc["tpr"].to_numpy()) >= 0).all() and (np.diff(roc["fpr"].to_numpy()) >= 0).all()
    assert abs(roc["tpr"].max() - 1) < 1e-12 and abs(roc["fpr"].max() - 1) < 1e-12
    pos, neg = s[y == 1], s[y == 0]
    want = ((pos[:, None] > neg[None, :]).sum() + 0.5 * (pos[:, None] == neg[None, :]).sum()) \
        / (len(pos) * len(neg))
    assert abs(metrics.roc_auc(df).first()["auc"] - want) < 1e-12
