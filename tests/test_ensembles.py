"""Boosted trees and forests against plain recursive versions; both ways of growing give the same trees."""
import numpy as np
import pytest

from quarry.operators import boosting as BO
from quarry.operators import forest as FO
from quarry.operators import learn as LN

X = ["a", "b", "c", "d"]


def table(n=400, seed=7):
    rng = np.random.default_rng(seed)
    x = np.stack([rng.normal(size=n).round(1), rng.integers(0, 6, n), rng.normal(size=n), rng.integers(0, 40, n)], 1).astype(float)
    y = ((x[:, 0] + x[:, 1] * 0.4 + 0.5 * rng.normal(size=n)) > 0.8).astype(int)
    return x, y


@pytest.fixture(scope="module")
def data(spark):
    x, y = table()
    rows = [(i, *map(float, r), int(c), i % 4) for i, (r, c) in enumerate(zip(x, y))]
    rows += [(1000, None, float("nan"), 0.5, 3.0, 1, 0), (1001, 1.0, 1.0, 1.0, 1.0, None, 0)]
    return spark.createDataFrame(rows, "id long, a double, b double, c double, d double, label int, fold int").repartition(3).persist()


def booster(x, y, spec):
    """One tree after another by recursion; the gain of every cut is worked out from sums over the rows."""
    s, margin, trees = BO.SCALE, np.zeros(len(y)), []
    for _ in range(spec.rounds):
        p = 1 / (1 + np.exp(-margin))
        g, h = np.rint((p - y) * s), np.rint(p * (1 - p) * s)

        def node(rows, depth):
            G, H, best = g[rows].sum() / s, h[rows].sum() / s, (0.0, None, None)
            if depth < spec.depth:
                for f in range(x.shape[1]):
                    for v in np.unique(x[rows, f])[:-1]:
                        left = rows[x[rows, f] <= v]
                        gl, hl = g[left].sum() / s, h[left].sum() / s
                        gr, hr = G - gl, H - hl
                        gain = gl * gl / (hl + 1) + gr * gr / (hr + 1) - G * G / (H + 1)
                        if hl >= 1 and hr >= 1 and gain > best[0]:
                            best = (gain, f, v)
            _, f, v = best
            if f is None:
                value = -G / (H + spec.l2) * spec.rate
                margin[rows] += value
                return round(value, 12)
            return f, v, node(rows[x[rows, f] <= v], depth + 1), node(rows[x[rows, f] > v], depth + 1)
        trees.append(node(np.arange(len(y)), 0))
    return trees, margin


def nested(tree, cuts, at=0):
    f = tree.feature[at]
    if f < 0:
        return round(tree.value[at], 12)
    return f, cuts[f][tree.cut[at] - 1], nested(tree, cuts, tree.left[at]), nested(tree, cuts, tree.left[at] + 1)


def test_booster_equals_recursion(data):
    spec = BO.Spec(6, 0.3, 3)
    clean = data.where("id < 1000")
    m = BO.fit(clean, X, "label", "id", [spec])
    x, y = table()
    # cuts are values that occur, so binned values are compared like the values' cells
    cells = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(m.cuts)], 1)
    want, margin = booster(cells, y, spec)

    def with_cells(t):
        return t if not isinstance(t, tuple) else (t[0], m.cuts[t[0]][int(t[1])], with_cells(t[2]), with_cells(t[3]))
    assert [nested(t, m.cuts) for t in m.trees[0]] == [with_cells(t) for t in want]
    got = {r["id"]: r["p"] for r in m.predict(clean, ["p"]).collect()}
    assert np.allclose([got[i] for i in range(len(y))], 1 / (1 + np.exp(-margin)))


def test_a_tree_cut_off_gives_the_shares_of_its_upper_nodes():
    x, y = table(600)
    key, depth, feature, threshold, w, pos, n = FO.grow(x.T, y, np.ones(600), 3, FO.Spec(1, max_features=2))
    walk, order = FO.Walk(key, feature, threshold, pos / w), np.argsort(key)
    for most, least in ((99, 2), (0, 2), (3, 2), (99, 25), (5, 60)):
        stop = (n < least) | (depth >= most)
        want = FO.Walk(key, np.where(stop, -1, feature), threshold, pos / w).shares(x.T)
        assert (walk.share[walk.under(stop[order])][walk.leaves(x.T)] == want).all()


def test_only_drawn_features_are_scored(monkeypatch):
    x, y = table(600)
    places, score = [], FO._score
    monkeypatch.setattr(FO, "_score", lambda wl, *rest: places.append(len(wl)) or score(wl, *rest))
    FO.grow(x.T, y, np.ones(600), 3, FO.Spec(1, max_depth=1, max_features=1))
    assert len(places) == 1     # of four features


def test_one_model_writes_margins_every_few_rounds(data, monkeypatch):
    names, write = [], BO._written
    monkeypatch.setattr(BO, "_written", lambda df, name: names.append(name) or write(df, name))
    spec = [BO.Spec(7, 0.3, 3, 0.7, 1)]
    a, b = (BO.fit(data, X, "label", "id", spec, "fold", [3, 6, 7], max_bins=16, one_task=size) for size in (BO.ONE_TASK, 0))
    assert a.trees == b.trees and a.scores == b.scores and names.count("margins") == 1


def test_splits_of_a_level_equal_those_of_its_nodes():
    rng = np.random.default_rng(8)
    bins, place = rng.integers(0, 9, (3, 400)).astype(np.uint8), rng.integers(0, 5, 400)
    g, h = rng.integers(-50, 50, 400) * BO.SCALE / 16, rng.integers(1, 9, 400) * BO.SCALE / 16
    sums = BO._histograms(bins, 9, place, None, 4, (g, h))       # place 4: in no node
    found = list(zip(*BO.splits_of_histograms(*sums, BO.Spec())))
    for node in range(4):
        own = [np.stack([np.bincount(b[place == node], w[place == node], 9) for b in bins]) for w in (g, h)]
        assert found[node] == BO.split_of_histogram(*own, BO.Spec())
    rows = np.flatnonzero(place < 2)
    assert (BO._histograms(bins, 9, place[rows], rows, 2, (g, h)) == sums[:, :2]).all()


def test_boosting_in_passes_equals_tasks(data):
    specs = [BO.Spec(3, 0.3, 3, 0.7, f) for f in (0, 1)] + [BO.Spec(2, 0.1, 2)]
    a, b = (BO.fit(data, X, "label", "id", specs, "fold", [1, 2, 3], max_bins=16, one_task=size) for size in (BO.ONE_TASK, 0))
    assert a.trees == b.trees and a.scores[:2] == b.scores[:2]
    assert a.scores[0][1] == 101        # the row without a label is left out


def test_grid_stages_equal_single_fits(data):
    g = {(r["n_estimators"], r["max_depth"]): r for r in
         BO.grid_search(data, X, "label", "id", "fold", [2, 5], [0.3], [2, 3]).collect()}
    assert sorted(r["place"] for r in g.values()) == [1, 2, 3, 4]
    labelled = data.where("label is not null")
    for (n, depth), r in g.items():
        m = BO.fit(data, X, "label", "id", [BO.Spec(n, 0.3, depth, fold=f) for f in range(4)], "fold")
        share = []
        for f in range(4):
            rows = m.predict(labelled.where(f"fold = {f}"), ["p"], [f]).collect()
            share.append(np.mean([(x["p"] > 0.5) == (x["label"] == 1) for x in rows]))
        assert (r["mean"], r["std"]) == (pytest.approx(np.mean(share)), pytest.approx(np.std(share)))


def exact_tree(x, y, w):
    """Nested (feature, threshold, left, right) or (weight, positives), every value tried as a cut."""
    if w @ y in (0, w.sum()):
        return w.sum(), w @ y
    best = (-1.0, None, None)
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for v, after in zip(values, values[1:]):
            left = x[:, f] <= v
            wl, pl, wr, pr = w[left].sum(), w[left] @ y[left], w[~left].sum(), w[~left] @ y[~left]
            score = (pl * pl + (wl - pl) ** 2) / wl + (pr * pr + (wr - pr) ** 2) / wr
            if score > best[0]:
                best = (score, f, float(FO.midway(v, after)))
    if best[1] is None:
        return w.sum(), w @ y
    left = x[:, best[1]] <= best[2]
    return best[1], best[2], exact_tree(x[left], y[left], w[left]), exact_tree(x[~left], y[~left], w[~left])


def nested_nodes(nodes, key=FO.ROOT):
    r = nodes[key]
    if r["feature"] < 0:
        return r["w"], r["pos"]
    left, right = (int(FO.child_keys(np.array([key], np.uint64), s)[0]) for s in (0, 1))
    return r["feature"], r["threshold"], nested_nodes(nodes, left), nested_nodes(nodes, right)


def test_forest_equals_exhaustive_trees(data):
    spec = FO.Spec(3)
    nodes = FO.fit(data.where("id < 1000"), X, "label", "id", [spec]).nodes.collect()
    x, y = table()
    for tree in range(3):
        w = FO.draws(np.arange(len(y)), tree, spec)
        mine = {r["key"] % (1 << 64): r.asDict() for r in nodes if r["tree"] == tree}
        assert nested_nodes(mine) == exact_tree(x[w > 0], y[w > 0].astype(float), w[w > 0])
        # grown until nodes are pure, as no two rows agree in all features
        assert all(r["pos"] in (0, r["w"]) for r in mine.values() if r["feature"] < 0)


def test_forest_in_levels_equals_tasks(data):
    specs = [FO.Spec(2, max_features=2, min_leaf=2, fold=1), FO.Spec(1, max_depth=2)]
    a, b = (FO.fit(data, X, "label", "id", specs, "fold", **size) for size in ({}, {"one_task": 0, "node_rows": 120}))
    assert sorted(map(tuple, a.nodes.collect())) == sorted(map(tuple, b.nodes.collect()))
    rows = data.orderBy("id")
    p, q = ([(r["p"], r["q"]) for r in m.predict(rows, "id", ["p", "q"], broadcast_nodes=n).orderBy("id").collect()]
            for m, n in ((a, FO.BROADCAST_NODES), (b, 0)))
    assert np.allclose(p, q)


def test_forest_in_small_blocks_and_turns(data, monkeypatch):
    """Values, nodes and trees cut over many blocks and turns give the trees of one task."""
    specs = [FO.Spec(3, max_features=2), FO.Spec(2, min_leaf=3, bootstrap=False, fold=2)]
    whole = FO.fit(data, X, "label", "id", specs, "fold")
    monkeypatch.setattr(FO, "BLOCK_BYTES", 1500)
    monkeypatch.setattr(FO, "PLACES", 1)
    cut = FO.fit(data, X, "label", "id", specs, "fold", one_task=0, node_rows=40)
    assert sorted(map(tuple, whole.nodes.collect())) == sorted(map(tuple, cut.nodes.collect()))


def test_forest_rows_stay_in_place(data, monkeypatch):
    """Trees' rows were written once a level; now the rows are written once and pure nodes move none."""
    written = []
    plain = FO.cut_lineage
    monkeypatch.setattr(FO, "cut_lineage", lambda df: (written.append(df.count()), plain(df))[1])
    rows = data.withColumn("label", (data["b"] > 2).cast("int"))
    nodes = FO.fit(rows, X, "label", "id", [FO.Spec(20)], one_task=0, node_rows=30).nodes
    assert sum(written) <= 2 * data.count() + 2 * nodes.count()


def test_search_reads_cells_off_one_forest(data):
    grid = {"trees": [2, 5], "max_depth": [2, None], "min_split": [2, 30], "bootstrap": [True]}
    once, apart = (FO.search(data, X, "label", "id", "fold", grid, **size).orderBy("place").collect() for size in ({}, {"one_task": 1}))
    assert len(once) == 8
    for a, b in zip(once, apart):
        assert tuple(a)[:4] == tuple(b)[:4] and a["mean"] == pytest.approx(b["mean"]) and a["std"] == pytest.approx(b["std"])
    assert len(FO.draw_cells(grid, 3)) == 3


def test_importances(data):
    m = FO.fit(data, X, "label", "id", [FO.Spec(10, max_features=2)])
    found = {r["feature"]: r["importance"] for r in m.importances().collect()}
    assert sum(found.values()) == pytest.approx(1.0)
    assert min(found[0], found[1]) > max(found[2], found[3])


def test_stack_scores_each_row_without_itself(data):
    base = {"rf": FO.Spec(5, max_features=2), "gbt": BO.Spec(5, 0.3, 2), "lr": LN.estimator("logreg", maxIter=20)}
    clean = data.where("id < 1000")
    s = LN.stacking(clean, X, "label", "id", "fold", base)
    oof = s.oof.collect()
    assert len(oof) == 400
    alone = BO.fit(clean, X, "label", "id", [BO.Spec(5, 0.3, 2, fold=2)], "fold").predict(clean.where("fold = 2"), ["p"])
    assert {r["id"]: r["p"] for r in alone.collect()} == {r["id"]: r["p_gbt"] for r in oof if r["fold"] == 2}
    assert np.mean([(r["probability"] > 0.5) == (r["label"] == 1) for r in s.predict(clean).collect()]) > 0.85


def samme(x, y, rounds):
    w, stumps = np.ones(len(y)) / len(y), []
    for _ in range(rounds):
        best = (-1.0,)
        for f in range(x.shape[1]):
            values = np.unique(x[:, f])
            for v, after in zip(values, values[1:]):
                left = x[:, f] <= v
                sides = [(w[s].sum(), w[s] @ y[s]) for s in (left, ~left)]
                score = sum((p * p + (t - p) ** 2) / t for t, p in sides)
                if score > best[0] + 1e-12:
                    best = (score, f, (v + after) / 2, *[int(2 * p > t) for t, p in sides])
        _, f, t, a, b = best
        wrong = np.where(x[:, f] <= t, a, b) != y
        e = w[wrong].sum() / w.sum()
        alpha = np.log((1 - e) / e)
        stumps.append((f, t, a, b, alpha))
        w = w * np.exp(alpha * wrong)
        w /= w.sum()
    return stumps


def test_stumps_equal_exhaustive_search(spark, data, monkeypatch):
    monkeypatch.setattr(LN, "BLOCK_ROWS", 64)       # the driver packs by it too; blocks cut values apart
    x, y = table()
    got, want = LN.adaboost(data.where("id < 1000"), X, "label", 8), samme(x, y, 8)
    assert [s[:4] for s in got] == [(f, pytest.approx(t), a, b) for f, t, a, b, _ in want]
    assert np.allclose([s[4] for s in got], [s[4] for s in want])
    votes = sum(a * (2 * np.where(x[:, f] <= t, left, right) - 1) for f, t, left, right, a in want)
    p = {r["id"]: r["prediction"] for r in LN.adaboost_predict(data, X, got).collect()}
    assert [p[i] for i in range(len(y))] == (votes > 0).astype(int).tolist()
    assert len(p) == 402        # nulls and NaN are scored as lowest values


def test_stumps_stop(spark):
    rows = [(i, float(i % 2), float(i), i % 2) for i in range(50)]
    df = spark.createDataFrame(rows, "id long, a double, b double, label int")
    assert LN.adaboost(df, ["a", "b"], "label", 5) == [(0, 0.5, 0, 1, 1.0)]
    assert LN.adaboost(df.withColumn("a", F_lit()), ["a"], "label", 5) == []


def F_lit():
    from pyspark.sql import functions as F
    return F.lit(1.0)
