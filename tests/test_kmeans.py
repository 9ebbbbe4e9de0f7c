"""The sweep over k against plain k-means and the scores' definitions."""
import numpy as np
import pandas as pd
import pytest

from quarry.operators import cluster as CL


@pytest.fixture(scope="module")
def points():
    rng = np.random.default_rng(6)
    x = np.concatenate([rng.normal(c, 1.0, size=(40, 4)) for c in rng.uniform(-12, 12, size=(4, 4))])
    return np.concatenate([x, np.repeat(x[:1], 10, axis=0)])


def plain(x, c, tol=1e-4):
    while True:
        near = ((x[:, None] - c[None]) ** 2).sum(2).argmin(1)
        new = np.stack([x[near == j].mean(0) if (near == j).any() else c[j] for j in range(len(c))])
        done = ((new - c) ** 2).sum() <= tol * x.var(0).mean()
        c = new
        if done:
            return c


def scores(x, c):
    d2 = ((x[:, None] - c[None]) ** 2).sum(2)
    near = d2.argmin(1)
    k, n = len(c), len(x)
    pair = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    s = []
    for i in range(n):
        own = (near == near[i]) & (np.arange(n) != i)
        a, b = pair[i][own].mean() if own.any() else 0.0, min(pair[i][near == j].mean() for j in range(k) if j != near[i])
        s.append((b - a) / max(a, b) if own.any() and max(a, b) > 0 else 0.0)
    mean = [np.sqrt(d2[near == j, j]).mean() for j in range(k)]
    gap = np.sqrt(((c[:, None] - c[None]) ** 2).sum(2))
    db = np.mean([max((mean[i] + mean[j]) / gap[i, j] for j in range(k) if j != i) for i in range(k)])
    within = d2.min(1).sum()
    ch = sum((near == j).sum() * ((c[j] - x.mean(0)) ** 2).sum() for j in range(k)) * (n - k) / (within * (k - 1))
    return within, np.mean(s), db, ch


def test_sweep(spark, points):
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(points)], "id long, v array<double>").repartition(3)
    table, labels, centres = CL.kmeans_sweep(df, "id", "v", range(1, 6))
    blocks = CL._vector_blocks(df, "id", "v")
    start = CL.seeds(blocks, 5)
    rows = {r["k"]: r for r in table.collect()}
    assert all(any((s == p).all() for p in points) for s in start) and len(np.unique(start, axis=0)) == 5
    for k in range(1, 6):
        c = plain(points, start[:k])
        assert np.allclose(c, centres[k - 1])
        if k == 1:
            assert rows[1]["inertia"] == pytest.approx(points.var(0).sum() * len(points)) and rows[1]["silhouette"] is None
        else:
            assert np.allclose([rows[k][x] for x in ("inertia", "silhouette", "davies_bouldin", "calinski_harabasz")], scores(points, c))
    assert max((r for r in rows.values() if r["k"] > 1), key=lambda r: r["silhouette"])["k"] == 4
    near = {r["id"]: r["labels"] for r in labels.collect()}
    assert all(near[i][3] == ((centres[3] - p) ** 2).sum(1).argmin() for i, p in enumerate(points))


def test_fewer_rows_than_clusters(spark):
    df = spark.createDataFrame([(1, [0.0]), (2, [4.0]), (3, [4.0])], "id long, v array<double>")
    rows = CL.kmeans_sweep(df, "id", "v", [1, 2, 3])[0].collect()
    assert [r["inertia"] for r in rows][1:] == [0.0, 0.0]


def test_products_name_the_same_centres_and_distances():
    from quarry.operators import cluster as CL
    from quarry.plans import blocks
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 16)) + 30
    x[:40], x[50] = x[40], x[51] * (1 + 1e-15)
    centres = np.vstack([x[60], x[61], x[60], (x[60] + x[61]) / 2])     # equal ones, and rows halfway between
    assert (CL._nearest(x, centres) == CL._to_centres(x, centres).argmin(1)).all()
    plain = np.vstack([d for _, d in blocks.pair_distances(x, x)])
    parts = list(blocks.product_distances(x, x, budget_bytes=400 * 8 * 32))
    found = np.vstack([d for _, d in parts])
    assert max(len(d) for _, d in parts) <= 32
    assert (found[plain == 0] == 0).all() and np.allclose(found, plain, rtol=1e-8, atol=0)
    assert blocks.rows_a_block(600_000) == 16384


def test_silhouette_of_repeated_ids(spark):
    from quarry.operators import cluster as CL
    rng = np.random.default_rng(6)
    x, ids, c = rng.normal(size=(60, 3)), np.arange(60) % 55, np.arange(60) % 3
    q = pd.DataFrame({"qid": ids, "qv": list(x), "qc": c})
    got = CL._silhouette_kernel(q, q.set_axis(["bid", "bv", "bc"], axis=1)).set_index(["qid", "bc"]).sort_index()
    other = ids[:, None] != ids[None]
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2)) * other
    for i in (0, 3, 20):
        for k in range(3):
            rows = got.loc[[(i, k)]]
            want = [(d[r, c == k].sum(), other[r, c == k].sum()) for r in np.flatnonzero(ids == i)]
            assert np.allclose(sorted(zip(rows["s"], rows["n"])), sorted(want))
