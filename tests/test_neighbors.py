"""Pruned nearest neighbours against all pairs; how many rows move."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.operators import neighbors as N


def frame(spark, x, first=0):
    return spark.createDataFrame([(first + i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, v array<double>")


def all_pairs(q, b, k, same, first=0):
    out = set()
    for i, row in enumerate(q):
        d = np.sqrt(((b - row) ** 2).sum(1))
        order = [j for j in np.lexsort((np.arange(len(b)), d)) if not (same and i == j)][:k]
        out |= {(i, first + int(j), round(float(d[j]), 9), r) for r, j in enumerate(order, 1)}
    return out


def rows(df):
    return {(r["src"], r["dst"], round(r["dist"], 9), r["rank"]) for r in df.collect()}


@pytest.fixture(scope="module")
def clustered():
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(c, 0.3, size=(60, 3)) for c in rng.uniform(-40, 40, size=(10, 3))])
    x[5] = x[6] = x[7]                      # equal rows
    return np.concatenate([x, np.repeat(x[:1], 150, axis=0)])     # and a heap of copies, more than a block


@pytest.mark.parametrize("k", [1, 7])
def test_graph_equals_all_pairs(spark, clustered, k):
    got = N.knn(frame(spark, clustered), None, k, "id", "v", block_rows=50)
    assert rows(got) == all_pairs(clustered, clustered, k, True)


def test_two_sides_and_spread_data(spark):
    rng = np.random.default_rng(2)
    q, b = rng.normal(size=(90, 12)), rng.normal(size=(300, 12))
    assert rows(N.knn(frame(spark, q), frame(spark, b, 1000), 4, "id", "v", block_rows=40)) == all_pairs(q, b, 4, False, 1000)
    # more neighbours than rows, and one cell only
    assert rows(N.knn(frame(spark, q), frame(spark, b[:3], 1000), 5, "id", "v")) == all_pairs(q, b[:3], 5, False, 1000)
    assert rows(N.knn(frame(spark, q[:50]), None, 60, "id", "v", block_rows=10)) == all_pairs(q[:50], q[:50], 60, True)
    assert N.knn(frame(spark, q[:0]), frame(spark, b), 2, "id", "v", block_rows=40).count() == 0


def test_few_rows_move_on_clustered_data(spark, clustered):
    x = clustered[:600]
    base = frame(spark, x).select(F.col("id").alias("bid"), F.col("v").alias("bv"))
    queries = frame(spark, x).select(F.col("id").alias("qid"), F.col("v").alias("qv"))
    cells = N.Cells(base, len(x), 20)
    assert len(cells.bounds.pivots) == 30
    reach = {s: d for s, _, d, r in all_pairs(x, x, 5, True) if r == 5}
    bounds = cells.bounds
    sent = N._sent(queries, cells, lambda d, pdf: bounds.within(d, np.array([reach[i] for i in pdf["qid"]])))
    asked, held = N._met(sent, cells)
    blocks = 30
    assert asked.count() < len(x) * blocks / 4 and held.count() < len(x) * blocks / 4
    # base rows only where a query was sent
    assert held.select("block", "cell").distinct().join(asked.select("block", "cell").distinct(), ["block", "cell"], "left_anti").count() == 0


def test_hub_degree(spark):
    nodes = frame(spark, np.eye(4))
    edges = spark.createDataFrame([(0, 1), (2, 1), (3, 1)], "src long, dst long")
    got = {r["id"]: r["agg"] for r in N.aggregate_neighbors(nodes, edges, "id", "v", "gcn").collect()}
    assert np.allclose(got[1], [0.5, 0.25, 0.5, 0.5])


def test_distances_of_few_pairs_are_worked_out(spark, monkeypatch):
    """A product names the candidates: heaps of pairs never get a distance of their own."""
    import pandas as pd
    from quarry.plans import blocks
    rng = np.random.default_rng(3)
    x = rng.normal(size=(700, 24)) + 50
    x[:3], x[10], x[11] = x[3], x[12], x[13] * (1 + 1e-15)
    seen, plain = [], blocks.distances_of
    monkeypatch.setattr(N, "distances_of", lambda q, b, i, j: (seen.append(len(i)), plain(q, b, i, j))[1])
    pdf = pd.DataFrame({"id": np.arange(700), "v": list(x)})
    got = N._topk_kernel(5, True)(pdf.set_axis(["qid", "qv"], axis=1), pdf.set_axis(["bid", "bv"], axis=1))
    want = all_pairs(x, x, 5, True)
    assert set(zip(got["src"], got["dst"])) == {(s, d) for s, d, *_ in want} and len(got) == 5 * 700
    assert sum(seen) < 12 * 700
    known = pdf.set_axis(["qid", "qv"], axis=1).assign(reach=got.groupby("src")["dist"].max().to_numpy())
    seen.clear()
    again = N._topk_kernel(5, True)(known, pdf.set_axis(["bid", "bv"], axis=1))
    assert again.equals(got) and sum(seen) < 12 * 700
    huge = pdf.assign(v=list(x * 1e200))
    far = N._topk_kernel(1, True)(huge.set_axis(["qid", "qv"], axis=1), huge.set_axis(["bid", "bv"], axis=1))
    assert {(0, 1), (1, 0), (10, 12)} <= set(zip(far["src"], far["dst"]))


def test_what_is_sent_at_once_is_bounded():
    from quarry.plans.blocks import rows_a_block
    assert rows_a_block(2000) == 2048 and rows_a_block(10**9) == 16384
    import pandas as pd
    sizes = [len(p) for p in N._slices([pd.DataFrame({"a": range(10_000)})], N.SLICE // N.Cells.MAX_PIVOTS)]
    assert max(sizes) * N.Cells.MAX_PIVOTS <= N.SLICE and sum(sizes) == 10_000


def test_graph_over_several_blocks_of_queries(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(260, 8)).astype(np.float32).astype(float)
    x[200:] = x[0]                          # more copies than a block holds
    assert rows(N.knn(frame(spark, x), None, 3, "id", "v", block_rows=25)) == all_pairs(x, x, 3, True)


def test_rows_without_a_distance_and_repeated_ids(spark):
    """A row with a NaN is no one's neighbour and hides none of its cell; rows of one id share their places."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 6))
    x[7, 2] = np.nan
    got = rows(N.knn(frame(spark, x), None, 4, "id", "v", block_rows=30))
    sound = np.delete(np.arange(300), 7)
    want = {(int(sound[s]), int(sound[d]), dist, r) for s, d, dist, r in all_pairs(x[sound], x[sound], 4, True)}
    assert got == want
    y = x[:200].copy()
    y[7, 2] = 0.0
    twice = frame(spark, y).unionByName(frame(spark, y[:100] + 1e-3))       # ids 0..99 come with two rows
    got = N.knn(twice, None, 3, "id", "v", block_rows=30).collect()
    ids, v = np.r_[0:200, 0:100], np.vstack([y, y[:100] + 1e-3])
    for src in (0, 50, 99, 100, 199):
        pairs = sorted((round(float(np.linalg.norm(a - b)), 9), int(i)) for a in v[ids == src] for b, i in zip(v, ids) if i != src)[:3]
        assert [(round(r["dist"], 9), r["dst"]) for r in sorted(got, key=lambda r: r["rank"]) if r["src"] == src] == pairs
    assert len(got) == 600


@pytest.mark.parametrize("shift,scale", [(0.0, 1.0), (1e4, 1.0), (0.0, 1e25), (0.0, 1e160)])
def test_chunks_one_by_one_equal_all_pairs(shift, scale):
    """Products in single precision only name pairs: rows far from the centre, large ones and heaps of copies keep exact places."""
    rng = np.random.default_rng(6)
    x = (rng.normal(size=(900, 10)) + shift) * scale
    x[100:400] = x[0]
    x[401] = x[400] * (1 + 1e-12)
    ids = np.arange(900) * 3
    best = N._Nearest(ids, x, np.zeros(10), 5, True)
    for s in range(0, 900, 128):
        best.offer(np.arange(900), N._Chunk(ids[s:s + 128], x[s:s + 128], np.zeros(10)))
        assert best.n_waiting <= max(900 * 5, 1 << 16)
    best.settle()
    i, dst, dist = best.found
    i_, j_, d_ = N._local_topk(ids, x, ids, x, np.full(900, np.inf), 5, True)
    assert np.array_equal(i, i_) and np.array_equal(dst, ids[j_]) and np.array_equal(dist, d_)


def test_a_query_moves_once_and_a_base_row_once_a_block(spark, clustered, monkeypatch):
    """What a task gets grows with its block and the cells it asked for, not with pairs of queries and cells."""
    x = clustered[:600]
    seen, plain = [], N._scan
    monkeypatch.setattr(N, "_scan", lambda cells, *rest: (seen.append(cells), plain(cells, *rest))[1])
    read = []
    deal = type(spark.range(1)).repartitionById
    monkeypatch.setattr(type(spark.range(1)), "repartitionById", lambda self, n, by: (read.append((n, self)), deal(self, n, by))[1])
    assert rows(N.knn(frame(spark, x), None, 5, "id", "v", block_rows=20)) == all_pairs(x, x, 5, True)
    assert len(read) == 2
    for n, dealt in read:
        assert dealt.where("v is not null").count() == 600
        base = dealt.where("rows is not null").selectExpr("block", "at", "explode(transform(sequence(0, length(bids) div 8 - 1), i -> hex(substring(bids, i * 8 + 1, 8)))) as id")
        assert base.count() == base.distinct().count() < 600 * n / 4
