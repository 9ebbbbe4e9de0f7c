"""Rows reach only the blocks that sent a query to their cell."""
import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from quarry.llm import voronoi


def test_query_blocks_hold_neighbours_and_split_large_cells():
    centres = {2: np.array([[0, 0], [9, 0], [1, 0], [5, 0]], float)}
    counts = pd.DataFrame({"size": 2, "own": [0, 1, 2, 3], "n": [3, 4, 5, 25]})
    got = {r.own: (r.first, r.parts) for r in voronoi.query_blocks(counts, centres, 10).itertuples()}
    assert got == {0: (0, 1), 2: (0, 1), 3: (1, 3), 1: (4, 1)}
    assert voronoi.query_blocks(counts.head(0), centres).empty


def test_rows_are_sent_where_asked(spark, monkeypatch):
    """On clusters far apart, data rows shuffled are those asked for, far below rows times blocks."""
    rng = np.random.default_rng(8)
    away = rng.normal(size=(12, 6)) * 4000
    vectors = [(i, (away[i % 12] + rng.normal(size=6) * 20).astype(int).tolist()) for i in range(2400)]
    frame = spark.createDataFrame(vectors, "id long, v array<bigint>")
    seen = {}
    plain = voronoi.replicated

    def watched(data, chunks, sent):
        out = plain(data, chunks, sent)
        seen["rows"], seen["blocks"] = out.count(), sent.select("block").distinct().count()
        asked = {tuple(r) for r in sent.select("size", "cell", "chunk", "block").collect()}
        assert {tuple(r) for r in out.select("size", "cell", "chunk", "block").distinct().collect()} <= asked
        return out

    monkeypatch.setattr(voronoi, "replicated", watched)
    monkeypatch.setattr(voronoi.query_blocks, "__defaults__", (10,))
    got = voronoi.top_k(frame, F.col("id") % 20 == 0, k=3).collect()
    assert seen["blocks"] >= 12 and seen["rows"] < 2400 * seen["blocks"] / 2
    x = np.array([v for _, v in vectors], np.int64)
    for q in range(0, 2400, 20):
        s = x @ x[q]
        order = [i for i in np.lexsort((np.arange(len(s)), -s)) if i != q][:3]
        assert [r.vec_id for r in sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])] == order
