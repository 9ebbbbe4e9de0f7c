"""Hand-made edge cases and properties (nulls, ties, empty inputs, brute force)."""
import math

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from quarry.operators import clean, cluster, events, experiment, features, learn, metrics
from quarry.operators import neighbors, sampling, schedule, text, topics
from quarry.plans.ranking import prefix_sums, row_number


# ------------------------------------------------------------------ ranking
@pytest.mark.parametrize("parts", [1, 3, 7])
def test_row_number_matches_window_with_null_groups(spark, parts):
    df = spark.range(0, 500).select(
        "id", F.when(F.col("id") % 5 == 0, None).otherwise(F.col("id") % 3).alias("g"),
        (F.col("id") * 7919 % 101).alias("v"))
    r = row_number(df.repartition(parts), ["v", "id"], ["g"], num_partitions=parts)
    ref = df.withColumn("rn2", F.row_number().over(Window.partitionBy("g").orderBy("v", "id")))
    assert r.join(ref, "id").where("_rn <> rn2").count() == 0
    assert r.count() == 500


def test_prefix_sums_running_total(spark):
    df = spark.createDataFrame([(i, float(i)) for i in range(1, 101)], "k long, x double")
    r = prefix_sums(df, ["k"], ["x"], num_partitions=4).collect()
    got = {row["k"]: row["cum_x"] for row in r}
    assert all(abs(got[k] - k * (k + 1) / 2) < 1e-9 for k in got)


# ------------------------------------------------------------------ cleaning
def test_mode_tie_goes_to_smallest_and_all_null_mean_stays_null(spark):
    df = spark.createDataFrame([("b", None), ("a", None), ("b", None), ("a", None), (None, None)],
                               "c string, x double")
    assert clean.modes(df, ["c"])["c"] == "a"
    out = clean.impute_mean(df, ["x"]).collect()
    assert all(r["x"] is None for r in out)


def test_drop_all_null_and_empty_table(spark):
    df = spark.createDataFrame([(1, None), (2, None)], "a int, b string")
    assert clean.drop_all_null(df).columns == ["a"]
    empty = spark.createDataFrame([], "a int, b string")
    assert clean.drop_all_null(empty).columns == []


def test_dummies_null_row_zero_and_drop_first(spark):
    df = spark.createDataFrame([(1, "x"), (2, "y"), (3, None)], "id int, c string")
    d = clean.dummies(df, ["c"])
    assert d.columns == ["id", "c_x", "c_y"]
    assert d.where("id = 3").first()["c_x"] == 0
    d2 = clean.dummies(df, ["c"], drop_first=True)
    assert d2.columns == ["id", "c_y"]
    a = clean.align(d2, ["id", "c_x", "c_y", "c_z"])
    assert a.columns == ["id", "c_x", "c_y", "c_z"]
    assert a.agg(F.sum("c_z")).first()[0] == 0


def test_name_features_one_word_and_double_space(spark):
    df = spark.createDataFrame([("ann",), ("bo  lee",), ("eve ada x",)], "n string")
    r = clean.name_features(df, "n").collect()
    assert [(x["name_length"], x["name_vowels"]) for x in r] == [(3, 1), (2, 1), (6, 4)]


# ------------------------------------------------------------------ events
def test_match_pct_empty_left_and_fanout(spark):
    a = spark.createDataFrame([], "key long")
    b = spark.createDataFrame([(1,), (1,)], "key long")
    assert events.match_pct(a, b, "key").first()["match_pct"] is None
    a2 = spark.createDataFrame([(1,), (2,)], "key long")
    r = events.match_pct(a2, b, "key").first()
    assert r["match_pct"] == 100.0 and r["match_pct_distinct"] == 50.0


def test_event_summary_null_vs_empty(spark):
    log = spark.createDataFrame([
        (1, "TableA", "TargetEvent", None, "open", "2022-01-02"),
        (1, "TableA", "TargetEvent", "open", "", "2022-01-05"),
        (2, "TableA", "TargetEvent", "", "", "2022-01-03"),     # neither
        (3, "TableA", "TargetEvent", "open", None, "2022-01-04"),  # resolve only
    ], "document long, table_name string, field_name string, old_value string, "
       "new_value string, change_date string")
    r = {x["id"]: x for x in events.event_summary(log).collect()}
    assert set(r) == {1, 3}
    assert r[1]["event_count"] == 1 and r[1]["last_resolve_date"] == "2022-01-05"
    assert r[3]["first_event_date"] is None and r[3]["event_count"] == 0


# ------------------------------------------------------------------ experiments
def test_itt_tot_three_arm_golden_numbers(spark):
    rows = []
    spec = {0: (0.64, 0.0), 1: (0.66, 0.40), 2: (0.68, 0.60)}
    for arm, (out, take) in spec.items():
        for i in range(100):
            rows.append((arm, int(i < take * 100), int(i < out * 100)))
    df = spark.createDataFrame(rows, "arm int, took_up int, outcome int")
    r = {x["arm"]: x for x in experiment.itt_tot(df).collect()}
    assert math.isclose(r[1]["itt"], 0.02, abs_tol=1e-9) and math.isclose(r[2]["itt"], 0.04, abs_tol=1e-9)
    assert math.isclose(r[1]["tot"], 0.05, abs_tol=1e-9)
    assert math.isclose(r[2]["tot"], 0.04 / 0.6, abs_tol=1e-9)
    r2 = experiment.itt_tot(df, control=1).where("arm = 2").first()
    assert math.isclose(r2["tot"], 0.10, abs_tol=1e-9)


def test_ate_one_unit_per_arm_has_no_se(spark):
    df = spark.createDataFrame([(1, 5.0), (0, 3.0)], "treatment int, sale double")
    r = experiment.ate(df).first()
    assert r["ate"] == 2.0 and r["se"] is None


# ------------------------------------------------------------------ metrics
def test_metric_edge_cases(spark):
    one_class = spark.createDataFrame([(1, 1, 0.3), (1, 0, 0.2)], "label int, prediction int, score double")
    assert metrics.roc_auc(one_class).first()["auc"] is None
    none_pos = spark.createDataFrame([(1, 0, 0.5), (0, 0, 0.5)], "label int, prediction int, score double")
    r = metrics.classification_report(none_pos).first()
    assert r["precision"] == 0.0 and r["mcc"] == 0.0 and r["accuracy"] == 0.5
    assert metrics.roc_auc(none_pos).first()["auc"] == 0.5      # all scores equal
    c = metrics.confusion(none_pos).collect()
    assert sum(x["count"] for x in c) == 2 and len(c) == 4


def test_auc_matches_pairwise_definition(spark):
    rng = np.random.default_rng(1)
    y = rng.integers(0, 2, 300)
    s = np.round(rng.random(300), 1)                 # many ties
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, s)], "label int, score double")
    pos, neg = s[y == 1], s[y == 0]
    brute = ((pos[:, None] > neg[None, :]).sum() + 0.5 * (pos[:, None] == neg[None, :]).sum()) \
        / (len(pos) * len(neg))
    assert math.isclose(metrics.roc_auc(df).first()["auc"], brute, rel_tol=1e-12)


# ------------------------------------------------------------------ sampling
def test_folds_disjoint_exhaustive_balanced(spark):
    df = spark.range(0, 103).withColumn("label", (F.col("id") % 3 == 0).cast("int"))
    f = sampling.kfold(df, "id", 5, by="label")
    assert f.count() == 103 and f.select("id").distinct().count() == 103
    for lab in (0, 1):
        sizes = [r["count"] for r in f.where(F.col("label") == lab).groupBy("fold").count().collect()]
        assert len(sizes) == 5 and max(sizes) - min(sizes) <= 1
    h = sampling.holdout(df, "id", 0.2)
    assert h.where("is_test = 1").count() == math.ceil(103 * 0.2)


# ------------------------------------------------------------------ neighbours
def _vecs(spark, n=60, d=3, dup=True):
    rng = np.random.default_rng(7)
    X = rng.integers(0, 4, size=(n, d)).astype(float)     # many equal distances
    if dup:
        X[5] = X[6]
    rows = [(i, [float(v) for v in X[i]], int(i % 4 == 0)) for i in range(n)]
    return spark.createDataFrame(rows, "id long, v array<double>, y int"), X


def test_knn_matches_brute_force_with_ties(spark):
    df, X = _vecs(spark)
    k = 4
    g = neighbors.knn(df, None, k, "id", "v", block_rows=16).collect()
    assert len(g) == len(X) * k and all(r["src"] != r["dst"] for r in g)
    D = np.sqrt(((X[:, None, :] - X[None, :, :]) ** 2).sum(-1))
    for i in range(len(X)):
        order = sorted((D[i, j], j) for j in range(len(X)) if j != i)[:k]
        got = sorted((r["rank"], r["dst"]) for r in g if r["src"] == i)
        assert [j for _, j in order] == [d for _, d in got]


def test_smote_counts(spark):
    df, _ = _vecs(spark, dup=False)
    n_min = 15
    n_new = int(0.5 * 45 - n_min)
    s = neighbors.smote(df, "id", "v", "y", 1, ratio=0.5, k=3)
    assert s.where("synthetic = 1").count() == n_new
    assert s.count() == 60 + n_new


def test_silhouette_brute_force_and_singleton(spark):
    df, X = _vecs(spark, n=40, dup=False)
    lab = np.array([i % 3 for i in range(40)])
    lab[0] = 9                                      # a singleton cluster
    d2 = spark.createDataFrame([(i, [float(v) for v in X[i]], int(lab[i])) for i in range(40)],
                               "id long, v array<double>, c int")
    D = np.sqrt(((X[:, None, :] - X[None, :, :]) ** 2).sum(-1))
    s = []
    for i in range(40):
        own = (lab == lab[i]) & (np.arange(40) != i)
        if own.sum() == 0:
            s.append(0.0)
            continue
        a = D[i, own].mean()
        b = min(D[i, lab == c].mean() for c in set(lab) if c != lab[i])
        s.append((b - a) / max(a, b) if max(a, b) > 0 else 0.0)
    got = cluster.silhouette(d2, "id", "v", "c", block_rows=8).first()[0]
    assert math.isclose(got, float(np.mean(s)), rel_tol=1e-9)


# ------------------------------------------------------------------ features / models
def test_standardize_population_and_zero_variance(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (3.0, 5.0)], "a double, b double")
    r = features.standardize(df, ["a", "b"]).collect()
    assert [x["b"] for x in r] == [0.0, 0.0, 0.0]
    assert math.isclose(r[0]["a"], -1.0 / math.sqrt(2.0 / 3.0))


def test_logreg_gd_matches_numpy(spark):
    rng = np.random.default_rng(3)
    X = rng.normal(size=(50, 2))
    y = (X[:, 0] + 0.5 * X[:, 1] > 0).astype(float)
    df = spark.createDataFrame([(float(a), float(b), float(c)) for (a, b), c in zip(X, y)],
                               "x1 double, x2 double, y double")
    th = learn.logreg_gd(df, ["x1", "x2"], "y", 0.1, 5)
    t = np.zeros(2)
    for _ in range(5):
        t += 0.1 * X.T @ (y - 1 / (1 + np.exp(-X @ t)))
    assert np.allclose(th, t, atol=1e-9)


def test_tree_pure_and_separable(spark):
    df = spark.createDataFrame([(float(i), int(i >= 5)) for i in range(10)], "x double, y int")
    tree = learn.build_tree(df, ["x"], "y")
    root = tree.where("node = 1").first()
    assert root["feature"] == 0 and root["threshold"] == 5.0
    pred = learn.tree_predict(df, ["x"], tree).where("prediction <> y").count()
    assert pred == 0
    pure = spark.createDataFrame([(1.0, 1), (2.0, 1)], "x double, y int")
    assert learn.build_tree(pure, ["x"], "y").count() == 1


def test_tree_numbers_nodes_by_level(spark):
    """Alternating labels peel off one row a level: as many levels as rows."""
    df = spark.createDataFrame([(float(i), i % 2) for i in range(4)] + [(None, 1)], "x double, y int")
    nodes = sorted(learn.build_tree(df, ["x"], "y").collect(), key=lambda r: r["node"])
    assert [r["node"] for r in nodes] == list(range(1, len(nodes) + 1))
    kids = [k for r in nodes for k in (r["yes"], r["no"]) if k is not None]
    assert kids == list(range(2, len(nodes) + 1))
    leaves = [r for r in nodes if r["yes"] is None]
    assert sum(r["n"] for r in leaves) == 5 and max(r["depth"] for r in nodes) >= 2


def test_tree_in_tasks_equals_levels(spark, monkeypatch):
    """Subtrees finished in tasks are those of the levels, number by number; each depth took a level of jobs before."""
    rng = np.random.default_rng(3)
    rows = [(float(a), float(b) if b else None, int((a > 3) ^ (i % 7 == 0))) for i, (a, b) in enumerate(rng.integers(0, 6, (40, 2)))]
    df = spark.createDataFrame(rows, "a double, b double, y int")
    level = learn.build_tree(df, ["a", "b"], "y", node_rows=10).orderBy("node").collect()
    assert level[0]["n"] == 40 and max(r["depth"] for r in level) > 2
    monkeypatch.setattr(learn, "best_splits", None)         # no level needed
    assert level == learn.build_tree(df, ["a", "b"], "y").orderBy("node").collect()


@pytest.mark.parametrize("max_depth", [None, 2])
def test_large_nodes_are_split_over_rows_that_stay_in_place(spark, monkeypatch, max_depth):
    """Blocks of a few rows, values on both sides of a block's end, nulls, signed zeros, a feature without values."""
    rng = np.random.default_rng(12)
    rows = []
    for _ in range(600):
        a, b = (None if v < 2 else [-0.0, 0.0, -1.5][v - 2] if v < 5 else float(v) for v in rng.integers(0, 20, 2))
        rows.append((a, b, None, int((a or 0) + rng.random() * 9 > (b or 1))))
    df = spark.createDataFrame(rows, "a double, b double, c double, y int").repartition(3)
    whole = learn.build_tree(df, ["a", "b", "c"], "y", max_depth).orderBy("node").collect()
    monkeypatch.setattr(learn, "best_splits", None)         # a level is no query over all values
    monkeypatch.setattr(learn, "VALUE_ROWS", 50)
    assert learn.build_tree(df, ["a", "b", "c"], "y", max_depth, node_rows=40).orderBy("node").collect() == whole
    assert len(whole) > (5 if max_depth else 40)


def test_cuts_near_the_best_hold_the_best():
    """The quick gain ratio drops no cut that the exact one would choose, of runs of large and small counts."""
    rng = np.random.default_rng(13)
    for n in (7, 400, 50_000_000):
        size = min(n, 400)
        nl = np.sort(rng.choice(np.arange(1, n + 1), size, replace=False)).astype(float)
        nl[-1] = n
        p = int(rng.integers(1, n))
        pl = np.clip(np.floor(nl * p / n + rng.integers(-3, 4, size)), np.maximum(0, nl - (n - p)), np.minimum(nl, p))
        args = nl, pl, np.full(size, float(n)), np.full(size, float(p))
        ratio, near = learn._gain_ratio(*args), learn._near_best(*args, np.zeros(1, int))
        assert set(np.flatnonzero(ratio == ratio.max())) <= set(near) and (n < 1000 or len(near) < size)



def test_logarithm_is_that_of_spark(spark):
    p = np.concatenate([np.arange(1, n) / n for n in (2, 3, 7, 97, 1000, 4096)] + [1 - 2.0 ** -np.arange(15, 30), 2.0 ** -np.arange(1, 40)])
    found = spark.createDataFrame([(float(v),) for v in p], "p double").select(F.log2("p")).collect()
    assert [r[0] for r in found] == learn._log2(p).tolist()


# ------------------------------------------------------------------ schedule
def test_schedule_capacity_boundary(spark):
    at_cap = spark.createDataFrame([(i, 1, 1, 8 + i, 1.0) for i in range(8)],
                                   "encounter_id long, or_suite int, day int, hour int, booked_hr double")
    assert schedule.audit(at_cap).where("rule = 'room_day_hours'").count() == 0
    over = at_cap.unionByName(spark.createDataFrame([(99, 1, 1, 20, 1.0 / 60)], at_cap.schema))
    assert schedule.audit(over).where("rule = 'room_day_hours'").count() == 1


# ------------------------------------------------------------------ text
def test_tfidf_drops_terms_in_every_document(spark):
    docs = spark.createDataFrame([(1, ["a", "b", "b"]), (2, ["a", "c"])], "d long, tokens array<string>")
    t = text.tfidf(text.term_counts(docs, "d", "tokens"), "d", 2).collect()
    assert {r["term"] for r in t} == {"b", "c"}
    assert all(math.isclose(r["tfidf"], 1.0) for r in t)


def test_coherence_matches_python_reference(spark):
    rng = np.random.default_rng(5)
    vocab = ["w%d" % i for i in range(8)]
    docs = [[vocab[j] for j in rng.integers(0, 8, rng.integers(3, 30))] for _ in range(25)]
    df = spark.createDataFrame([(i, d) for i, d in enumerate(docs)], "d long, tokens array<string>")
    tops = [["w0", "w1", "w2"], ["w3", "w4", "w7"]]
    win = 5
    wins = []
    for d in docs:
        if len(d) <= win:
            wins.append(set(d))
        else:
            wins += [set(d[s:s + win]) for s in range(len(d) - win + 1)]
    N = len(wins)

    def p(*ws):
        return sum(all(w in s for w in ws) for s in wins) / N

    def npmi(a, b):
        pj = p(a, b)
        return math.log((pj + 1e-12) / (p(a) * p(b))) / -math.log(pj + 1e-12)
    want = []
    for t in tops:
        tot = [sum(npmi(a, b) for a in t) for b in t]
        sims = []
        for a in t:
            v = [npmi(a, b) for b in t]
            sims.append(np.dot(v, tot) / (np.linalg.norm(v) * np.linalg.norm(tot)))
        want.append(np.mean(sims))
    got = [r["coherence"] for r in topics.coherence_cv(df, "d", "tokens", tops, window=win)
           .orderBy("topic").collect()]
    assert np.allclose(got, want, atol=1e-9)


# ------------------------------------------------------------------ streaming
def test_event_summary_stream_equals_batch(spark, tmp_path):
    from quarry.streaming import event_summary_stream
    log = spark.createDataFrame([
        (1, "TableA", "TargetEvent", None, "open", "2022-01-02"),
        (1, "TableA", "TargetEvent", "open", "", "2022-01-05"),
        (2, "TableA", "TargetEvent", None, "x", "2022-01-01"),
    ], "document long, table_name string, field_name string, old_value string, "
       "new_value string, change_date string")
    src = str(tmp_path / "log")
    log.write.parquet(src)
    q = (event_summary_stream(spark, src, log.schema).writeStream.outputMode("complete")
         .format("memory").queryName("ev_stream_test")
         .option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start())
    q.awaitTermination(120)
    got = sorted(tuple(r) for r in spark.sql("SELECT * FROM ev_stream_test").collect())
    want = sorted(tuple(r) for r in events.event_summary(log).collect())
    assert got == want


def test_lsi_matches_numpy_svd(spark):
    rng = np.random.default_rng(11)
    A = (rng.random((30, 12)) < 0.3) * rng.random((30, 12))
    A[:, 0] += 2.0 * (np.arange(30) % 2)           # two clear directions
    A[:, 1] += 1.5 * (np.arange(30) % 3 == 0)
    rows = [(d, f"t{t:02d}", float(A[d, t])) for d in range(30) for t in range(12) if A[d, t] > 0]
    long = spark.createDataFrame(rows, "doc long, term string, tfidf double")
    sv, top = topics.lsi(long, "doc", 2, n_terms=3)
    want = np.linalg.svd(A, compute_uv=False)[:2]
    assert np.allclose(sv, want, rtol=1e-6)
    _, _, vt = np.linalg.svd(A)
    lead = f"t{int(np.argmax(np.abs(vt[0]))):02d}"
    assert top.where("topic = 0 AND rank = 1").first()["term"] == lead


def test_lsi_packs_documents_and_multiplies_inside_blocks(spark):
    import pandas as pd
    docs = spark.createDataFrame([([5, 9], [1.0, 2.0]), ([9], [3.0]), ([2, 5, 9], [1.0, 1.0, 1.0])], "tids array<long>, ws array<double>")
    block = docs.coalesce(1).mapInPandas(topics._pack, topics._BLOCK).toPandas()
    assert len(block) == 1 and np.frombuffer(block["ids"][0], np.int64).tolist() == [2, 5, 9]
    a, z = np.array([[0, 1, 2], [0, 0, 3], [1, 1, 1]], float), np.array([[1, 2], [0, 1], [3, -1]], float)
    turn = np.array([[2.0, 0.0], [1.0, 1.0]])
    mine = pd.DataFrame({"tid": [9, 2, 5], "spot": [2, 0, 1], "v": [z[i].tobytes() for i in (2, 0, 1)]})
    got = topics._products(turn)(block, mine)
    y = a @ z @ turn
    assert got["tid"].tolist() == [2, 5, 9, -1, -2]
    assert np.allclose(np.frombuffer(b"".join(got["v"])).reshape(-1, 2), np.vstack([a.T @ y, y.T @ y]))
    empty = spark.createDataFrame([], "doc long, term string, tfidf double")
    assert topics.lsi(empty, "doc", 2)[1].count() == 0


def test_ranking_with_a_hot_group_spanning_partitions(spark):
    # one group holds a third of all rows and must span several range partitions
    df = spark.range(0, 900).select(
        "id", F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id") % 50).alias("g"),
        (F.col("id") * 37 % 211).cast("double").alias("v"))
    r = prefix_sums(df, [F.desc("v"), "id"], ["v"], ["g"], num_partitions=6)
    w = Window.partitionBy("g").orderBy(F.desc("v"), "id")
    ref = df.withColumn("rn2", F.row_number().over(w)).withColumn(
        "c2", F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    bad = r.join(ref.select("id", "rn2", "c2"), "id").where("_rn <> rn2 OR abs(cum_v - c2) > 1e-9")
    assert bad.count() == 0


def test_match_pct_and_group_size_with_hot_key(spark):
    from quarry.operators import clean as C
    a = spark.range(0, 300).select(F.when(F.col("id") < 100, 1).otherwise(F.col("id")).alias("key"))
    b = spark.range(0, 60).select(F.when(F.col("id") < 20, 1).otherwise(F.col("id") + 1000).alias("key"))
    r = events.match_pct(a, b, "key").first()
    assert r["matched_rows"] == 100 * 20 and r["left_rows"] == 300
    g = C.group_size(a, "key", "n")
    assert g.where("key = 1").select(F.min("n"), F.max("n")).first() == (100, 100)


# ------------------------------------------------------------------ more edge cases (FIXTURES §3)
def test_equal_take_up_gives_null_tot(spark):
    df = spark.createDataFrame([(0, 1, 1), (0, 0, 0), (1, 1, 1), (1, 0, 1)],
                               "arm int, took_up int, outcome int")
    r = experiment.itt_tot(df).first()
    assert r["itt"] == 0.5 and r["tot"] is None


def test_unmapped_value_and_category_only_in_test(spark):
    df = spark.createDataFrame([(1, "A/1/P"), (2, "B/2/Q"), (3, None)], "id int, cabin string")
    p = clean.split_parts(df, "cabin", "/", ["deck", "num", "side"])
    m = {r["id"]: r["side"] for r in clean.map_values(p, "side", {"P": "Port", "S": "Starboard"}).collect()}
    assert m == {1: "Port", 2: None, 3: None}
    train = clean.dummies(p.select("id", "deck").where("id = 1"), ["deck"])
    test = clean.dummies(p.select("id", "deck"), ["deck"])
    aligned = clean.align(test, train.columns)
    assert aligned.columns == ["id", "deck_A"]          # test-only level B dropped


def test_score_exactly_at_threshold_and_identical_centres(spark):
    df = spark.createDataFrame([(1, 0.5), (0, 0.5), (1, 0.7)], "label int, score double")
    p = metrics.binarize(df, "score", 0.5).orderBy("score").collect()
    assert [r["prediction"] for r in p] == [0, 0, 1]     # strictly greater
    v = spark.createDataFrame([(1, [0.0, 0.0], 0), (2, [0.0, 0.0], 1), (3, [1.0, 0.0], 1)],
                              "id long, v array<double>, c int")
    r = cluster.centroid_scores(v, "v", "c").first()
    assert r["inertia"] == 0.5 and r["davies_bouldin"] >= 0


def test_smote_with_fewer_minority_rows_than_k(spark):
    df, _ = _vecs(spark, n=30, dup=False)
    df = df.withColumn("y", (F.col("id") < 3).cast("int"))      # 3 minority rows, k=5
    s = neighbors.smote(df, "id", "v", "y", 1, ratio=0.5, k=5)
    assert s.where("synthetic = 1").count() == int(0.5 * 27 - 3)


def test_stratified_split_with_single_row_label(spark):
    df = spark.range(0, 20).withColumn("label", F.when(F.col("id") == 0, 9).otherwise(F.col("id") % 2))
    h = sampling.holdout(df, "id", 0.25, by="label")
    assert h.where("label = 9").first()["is_test"] == 1          # ceil(1 · 0.25) = 1
    f = sampling.kfold(df, "id", 5, by="label")
    assert f.where("label = 9").first()["fold"] == 0


@pytest.mark.parametrize("parts", [1, 5])
def test_results_unchanged_by_repartition(spark, parts):
    df = spark.range(0, 200).select("id", (F.col("id") % 3).alias("label"),
                                    F.array((F.col("id") % 7).cast("double"),
                                            (F.col("id") % 5).cast("double")).alias("v"))
    d = df.repartition(parts)
    h = {r["id"]: r["is_test"] for r in sampling.holdout(d, "id", 0.3, by="label").collect()}
    h0 = {r["id"]: r["is_test"] for r in sampling.holdout(df.coalesce(1), "id", 0.3, by="label").collect()}
    assert h == h0
    g = sorted(tuple(r) for r in neighbors.knn(d, None, 3, "id", "v", block_rows=32)
               .select("src", "dst", "rank").collect())
    g0 = sorted(tuple(r) for r in neighbors.knn(df.coalesce(1), None, 3, "id", "v")
                .select("src", "dst", "rank").collect())
    assert g == g0


# ------------------------------------------------------------------ profiles
def test_profiles_with_odd_column_names_and_a_value_most_rows_share(spark):
    from quarry.operators import profile as P
    df = spark.createDataFrame([(0.0, 2.0)] * 30 + [(3.0, None), (5.0, 4.0)], ["it's", "_rows"])
    assert {tuple(r) for r in P.null_counts(df).collect()} == {("it's", 0), ("_rows", 1)}
    assert {tuple(r) for r in P.column_profile(df).collect()} == {("it's", "double", 32, 32), ("_rows", "double", 31, 32)}
    got = {(r["column"], r["p"]): r["value"] for r in P.quantiles(df, ["it's", "_rows"], (0.5, 1.0)).collect()}
    assert got == {("it's", 0.5): 0.0, ("it's", 1.0): 5.0, ("_rows", 0.5): 2.0, ("_rows", 1.0): 4.0}
