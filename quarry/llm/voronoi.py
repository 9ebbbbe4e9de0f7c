"""Exact top-k search by inner product: a Voronoi kNN join.

Every vector is assigned to its nearest pivot (its cell); each cell keeps a
summary: rows, radius, and the smallest distances to its pivot.  For a query q
and a vector v of the cell of pivot p, q.v = q.p + q.(v - p), so q.v lies
within |q| * |v - p| of q.p.  The summaries' smallest distances give each
query a score that at least k rows reach; a query is sent only to the cells
whose radius lets them reach it.  Cells are cut into chunks and queries into
blocks of bounded size; queries of one cell, or of cells whose pivots are near
each other, share blocks.  A row is replicated only to the blocks that sent a
query to its cell.  Blocks are solved locally and the local winners merged.

Pivots steer the work, not the result: a sample of at most ``pivots`` rows.

Defined results: vectors that are null, or hold null or non-finite
components, take no part, nor do rows with a null id; rows that repeat an id
count once (the smallest vector); vectors meet only vectors of their own
length; a query gets all its candidates, if there are fewer than k; equal
scores go to the smaller id; an empty table gives no rows; other columns are
ignored.
"""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import table, written

CHUNK, QUERIES = 8192, 4096     # rows of a cell and queries that are solved together
SLACK = 1e-9                    # relative room for rounding in the bounds


def whole_vectors(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256) -> DataFrame:
    """(id, v array<bigint>): floor(scale * component), one row per id."""
    v = F.col(vector_col).cast("array<double>")
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return (rows.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & sound)
            .select(F.col(id_col).cast("long").alias("id"), F.transform(v, lambda x: F.floor(x * scale).cast("long")).alias("v"))
            .groupBy("id").agg(F.min("v").alias("v")))


def _stack(vectors) -> np.ndarray:
    return np.array([np.asarray(x, np.int64) for x in vectors], np.int64)


def _cells(shared):
    def run(batches):
        pivots = shared.value
        for pdf in batches:
            sizes = pdf["v"].map(len).to_numpy()
            cell, far = np.zeros(len(pdf), np.int64), np.zeros(len(pdf))
            for size in np.unique(sizes):
                at = np.flatnonzero(sizes == size)
                x = _stack(pdf["v"].to_numpy()[at]).reshape(len(at), size).astype(float)
                p = pivots.get(int(size))
                if p is None:
                    far[at] = np.sqrt((x * x).sum(1))
                    continue
                d = np.maximum((x * x).sum(1)[:, None] + (p * p).sum(1) - 2 * x @ p.T, 0)
                cell[at] = d.argmin(1)
                far[at] = np.sqrt(((x - p[cell[at]]) ** 2).sum(1))
            yield pd.DataFrame({"id": pdf["id"], "v": pdf["v"], "size": sizes.astype(np.int32), "cell": cell.astype(np.int32), "far": far})
    return run


def _near(k: int):
    """Per part and cell: rows, radius and the k + 1 smallest distances."""
    def run(batches):
        seen: dict = {}
        for pdf in batches:
            for key, g in pdf.groupby(["size", "cell"])["far"]:
                n, radius, near = seen.get(key, (0, 0.0, []))
                seen[key] = n + len(g), max(radius, g.max()), sorted([*near, *g.nsmallest(k + 1)])[:k + 1]
        yield pd.DataFrame([(int(a), int(b), n, r, near) for (a, b), (n, r, near) in seen.items()],
                           columns=["size", "cell", "n", "radius", "near"])
    return run


def _route(shared, k: int):
    """Queries to the cells that may hold one of their k best."""
    def run(batches):
        pivots, summary = shared.value
        for pdf in batches:
            out = []
            for i, v, own in zip(pdf["id"], pdf["v"], pdf["cell"]):
                q = np.asarray(v, float)
                cells, chunks, radius, near = summary.get(len(q), ([], [], [], []))
                p = pivots.get(len(q), np.zeros((1, len(q))))[cells]
                at, long = p @ q, np.sqrt(q @ q)
                room = SLACK * (np.abs(at) + long * radius + 1) if len(cells) else 0
                least = np.sort(np.concatenate([a - long * np.asarray(d) for a, d in zip(at - room, near)] or [np.zeros(0)]))
                floor = least[-(k + 1)] if len(least) > k else -np.inf   # k + 1: the query's own row may be one
                for j in np.flatnonzero(at + long * radius + room >= floor) if len(cells) else ():
                    out += [(i, v, own, len(q), int(cells[j]), c) for c in range(chunks[j])]
            yield pd.DataFrame(out, columns=["id", "v", "own", "size", "cell", "chunk"])
    return run


def query_blocks(counts: pd.DataFrame, centres: dict, size: int = QUERIES) -> pd.DataFrame:
    """(size, own, first, parts) for the queries' counts (size, own, n) by cell.

    Cells follow each other by their pivot's distance from the first one; small
    neighbours share a block of about ``size`` queries, large ones get several."""
    far = [float(((centres[s][c] - centres[s][0]) ** 2).sum()) if s in centres else 0.0
           for s, c in zip(counts["size"], counts["own"])]
    counts = counts.assign(far=far).sort_values(["size", "far", "own"])
    out, block, filled, last = [], -1, size, None
    for s, own, n in zip(counts["size"], counts["own"], counts["n"]):
        parts = -(-n // size)
        if s != last or parts > 1 or filled + n > size:
            block, filled = block + 1, 0
        out.append((int(s), int(own), block, int(parts)))
        block, filled, last = block + parts - 1, size if parts > 1 else filled + n, s
    return pd.DataFrame(out, columns=["size", "own", "first", "parts"])


def replicated(data: DataFrame, chunks: DataFrame, sent: DataFrame) -> DataFrame:
    """The rows once for every (size, cell, chunk, block) that holds a query, no other."""
    asked = sent.select("size", "cell", "chunk", F.col("block").alias("to")).distinct()
    return (data.join(F.broadcast(chunks), ["size", "cell"])
            .withColumn("chunk", F.pmod(F.xxhash64("id", F.lit("chunk")), F.col("chunks")).cast("int"))
            .join(asked, ["size", "cell", "chunk"])
            .select("id", "v", "size", "cell", "chunk", F.col("to").alias("block")))


def _solve(k: int):
    def run(queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(queries) and len(rows):
            rows = rows.sort_values("id")
            x, ids = _stack(rows["v"]).reshape(len(rows), -1), rows["id"].to_numpy()
            q = _stack(queries["v"]).reshape(len(queries), -1)
            exact = x.shape[1] * float(np.abs(x).max(initial=0)) * float(np.abs(q).max(initial=0)) < 2 ** 53
            for start in range(0, len(q), 256):
                part = q[start:start + 256]
                scores = (part.astype(float) @ x.T.astype(float)).astype(np.int64) if exact else part @ x.T
                for own, s in zip(queries["id"].to_numpy()[start:start + 256], scores):
                    at = np.flatnonzero(s >= np.partition(s, -(k + 1))[-(k + 1)]) if len(s) > k + 1 else np.arange(len(s))
                    at = at[ids[at] != own]
                    best = at[np.lexsort((ids[at], -s[at]))[:k]]
                    out += [(own, i, v) for i, v in zip(ids[best], s[best])]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"], dtype=np.int64)
    return run


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, pivots: int = 64) -> DataFrame:
    """(query_id, rank, vec_id, score) for rows (id, v) of ``vectors``; queries are the
    rows on which ``is_query`` holds, candidates all rows but the query's own."""
    spark = vectors.sparkSession
    sample = vectors.orderBy(F.xxhash64("id", F.lit("pivot")), "id").limit(pivots).collect()
    by_size: dict[int, list] = {}
    for r in sample:
        by_size.setdefault(len(r["v"]), []).append(r["v"])
    centres = {s: np.array(p, float).reshape(len(p), s) for s, p in by_size.items()}
    shared = spark.sparkContext.broadcast(centres)
    data = written(vectors.mapInPandas(_cells(shared), "id long, v array<bigint>, size int, cell int, far double"), "cells")
    # cells x lengths of vectors: bounded by the number of pivots and lengths
    summary = (data.select("size", "cell", "far").mapInPandas(_near(k), "size int, cell int, n long, radius double, near array<double>")
               .groupBy("size", "cell").agg(F.sum("n").alias("n"), F.max("radius").alias("radius"),
                                            F.slice(F.sort_array(F.flatten(F.collect_list("near"))), 1, k + 1).alias("near"))
               .withColumn("chunks", F.ceil(F.col("n") / CHUNK).cast("int")))
    known = summary.toPandas()
    told = {int(s): (g["cell"].to_numpy(), g["chunks"].tolist(), g["radius"].to_numpy(), g["near"].tolist())
            for s, g in known.groupby("size")}
    queries = data.where(is_query).select("id", "v", "size", "cell")
    counts = queries.groupBy("size", F.col("cell").alias("own")).agg(F.count("*").alias("n")).toPandas()
    blocks = spark.createDataFrame(query_blocks(counts, centres), "size int, own int, first int, parts int")
    sent = written(queries.mapInPandas(_route(spark.sparkContext.broadcast((centres, told)), k),
                                       "id long, v array<bigint>, own int, size int, cell int, chunk int")
                   .join(F.broadcast(blocks), ["size", "own"])
                   .select("id", "v", "size", "cell", "chunk",
                           (F.col("first") + F.pmod(F.xxhash64("id", F.lit("block")), F.col("parts")).cast("int")).alias("block")), "sent")
    held = replicated(data, spark.createDataFrame(known[["size", "cell", "chunks"]], "size int, cell int, chunks int"), sent)
    key = ["size", "cell", "chunk", "block"]
    local = (sent.groupBy(*key).cogroup(held.groupBy(*key))
             .applyInPandas(lambda a, b: _solve(k)(a, b), "query_id long, vec_id long, score long"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return local.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op3_voronoi(spark, sf_dir):
    return top_k(whole_vectors(table(spark, sf_dir, "embeddings")), F.col("id") % 50 == 0)


OP3_SQL = """
WITH v AS (
  SELECT vec_id AS id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.id AS query_id, c.id AS vec_id,
    CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.id <> c.id WHERE q.id % 50 = 0
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""
