"""Clustering and cluster-quality metrics.

* ``silhouette`` is exact (Euclidean, as the reference's library computes
  it): the blocked cogroup kernel returns, per point and per cluster, the
  sum and count of distances — O(n·C) rows, never the pairs.
* Centroid metrics (inertia, Davies-Bouldin, Calinski-Harabasz) need only
  per-cluster aggregates; the k×k centroid arithmetic happens on k rows.
"""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.plans.blocks import as_matrix, n_blocks, pair_squares, product_distances, replicate, rows_a_block, same_ids
from quarry.session import cut_lineage, ship_package


def centroids(df: DataFrame, vec: str, cluster: str) -> DataFrame:
    """(cluster, n, centroid array): MLlib's vector ``Summarizer`` mean per
    cluster — one partial aggregate on whole vectors, no per-element rows."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer
    v = array_to_vector(F.col(vec).cast("array<double>"))
    return df.groupBy(cluster).agg(F.count(F.lit(1)).alias("n"),
                                   vector_to_array(Summarizer.mean(v)).alias("centroid"))


def _dist(a, b):
    d = F.zip_with(a, b, lambda x, y: (x - y) * (x - y))
    return F.sqrt(F.aggregate(d, F.lit(0.0), lambda acc, x: acc + x))


def assign(df: DataFrame, vec: str, centres, out: str = "cluster") -> DataFrame:
    """Nearest of the given centres (list of arrays; model state of size k×d),
    ties to the lower index — JVM higher-order functions, no Python."""
    cs = F.array(*[F.array(*[F.lit(float(x)) for x in c]) for c in centres])
    v = F.col(vec).cast("array<double>")
    ds = F.transform(cs, lambda c, i: F.struct(_dist(v, c).alias("d"), i.alias("i")))
    return df.withColumn(out, F.array_min(ds)["i"])


def kmeans(df: DataFrame, vec: str, k: int, seed: int = 123, max_iter: int = 20):
    """MLlib k-means on an array column; returns (model, assignments, inertia)."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector
    data = df.withColumn("_features", array_to_vector(F.col(vec).cast("array<double>")))
    model = KMeans(k=k, seed=seed, maxIter=max_iter, featuresCol="_features",
                   predictionCol="cluster").fit(data)
    return model, model.transform(data).drop("_features"), model.summary.trainingCost


def _others(i: np.ndarray, label: np.ndarray, rows: int, onehot: np.ndarray) -> np.ndarray:
    """(rows, labels): how many base rows of each label have another id; ``i`` and ``label`` list those with the same."""
    out = np.tile(onehot.sum(0).astype(np.int64), (rows, 1))
    np.subtract.at(out, (i, label), 1)
    return out


def _silhouette_kernel(q: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
    """Per query point and base cluster: sum and count of distances to the
    other points of that cluster in this block pair (two matrix products
    against the base block's one-hot cluster matrix)."""
    empty = pd.DataFrame({"qid": pd.Series([], dtype="int64"), "qc": pd.Series([], dtype="int64"),
                          "bc": pd.Series([], dtype="int64"), "s": pd.Series([], dtype="float64"),
                          "n": pd.Series([], dtype="int64")})
    if len(q) == 0 or len(b) == 0:
        return empty
    qm, bm = as_matrix(q["qv"]), as_matrix(b["bv"])
    qid = q["qid"].to_numpy(np.int64)
    bid = b["bid"].to_numpy(np.int64)
    qc = q["qc"].to_numpy(np.int64)
    labs, bc_idx = np.unique(b["bc"].to_numpy(np.int64), return_inverse=True)
    onehot = np.zeros((len(bid), len(labs)))
    onehot[np.arange(len(bid)), bc_idx] = 1.0
    parts = []
    for s, d in product_distances(qm, bm):
        m = d.shape[0]
        i, j = same_ids(qid[s:s + m], bid)
        d[i, j] = 0.0
        sums = d @ onehot
        cnts = _others(i, bc_idx[j], m, onehot)
        parts.append(pd.DataFrame({
            "qid": np.repeat(qid[s:s + m], len(labs)), "qc": np.repeat(qc[s:s + m], len(labs)),
            "bc": np.tile(labs, m), "s": sums.ravel(), "n": cnts.ravel()}))
    return pd.concat(parts, ignore_index=True) if parts else empty


def silhouette_points(df: DataFrame, id_col: str, vec: str, cluster: str,
                      block_rows: int | None = None) -> DataFrame:
    """Per-point silhouette (id, cluster, s); a point alone in its cluster scores 0."""
    ship_package(df.sparkSession)
    n = df.count()
    b = n_blocks(n, block_rows or rows_a_block(n), 2 * df.sparkSession.sparkContext.defaultParallelism)
    base = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec).alias("v"),
                     F.col(cluster).cast("long").alias("c"))
    q = replicate(base.toDF("qid", "qv", "qc"), "qid", "qblk", "bblk", b)
    r = replicate(base.toDF("bid", "bv", "bc"), "bid", "bblk", "qblk", b)
    sums = q.groupBy("qblk", "bblk").cogroup(r.groupBy("qblk", "bblk")).applyInPandas(
        _silhouette_kernel, "qid long, qc long, bc long, s double, n long")
    per = sums.groupBy("qid", "qc", "bc").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    mean = F.try_divide(F.col("s"), F.col("n"))
    pt = per.groupBy("qid", "qc").agg(
        F.max(F.when(F.col("bc") == F.col("qc"), mean)).alias("a"),
        F.max(F.when(F.col("bc") == F.col("qc"), F.col("n"))).alias("n_own"),
        F.min(F.when((F.col("bc") != F.col("qc")) & (F.col("n") > 0), mean)).alias("b"))
    s = F.when(F.coalesce(F.col("n_own"), F.lit(0)) == 0, F.lit(0.0)).otherwise(
        F.coalesce(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")), F.lit(0.0)))
    return pt.select(F.col("qid").alias(id_col), F.col("qc").alias(cluster), s.alias("silhouette"))


def silhouette(df: DataFrame, id_col: str, vec: str, cluster: str, block_rows: int | None = None,
               fast: bool = False) -> DataFrame:
    """Mean silhouette over all points.

    Default: exact Euclidean silhouette (all pairs, blocked).  ``fast=True``
    uses MLlib's ``ClusteringEvaluator``, which is linear in n because it
    works from per-cluster summaries — but with **squared** Euclidean
    distance, so its value differs; use it when O(n²) is out of reach."""
    if fast:
        from pyspark.ml.evaluation import ClusteringEvaluator
        from pyspark.ml.functions import array_to_vector
        data = df.select(array_to_vector(F.col(vec).cast("array<double>")).alias("_f"),
                         F.col(cluster).cast("double").alias("_c"))
        v = ClusteringEvaluator(featuresCol="_f", predictionCol="_c",
                                distanceMeasure="squaredEuclidean").evaluate(data)
        return df.sparkSession.createDataFrame([(float(v),)], "silhouette double")
    return silhouette_points(df, id_col, vec, cluster, block_rows).agg(
        F.avg("silhouette").alias("silhouette"))


def centroid_scores(df: DataFrame, vec: str, cluster: str) -> DataFrame:
    """inertia, Davies-Bouldin and Calinski-Harabasz in one row."""
    spark = df.sparkSession
    cen = centroids(df, vec, cluster)
    pts = df.select(cluster, F.col(vec).cast("array<double>").alias("_v")).join(
        F.broadcast(cen.select(cluster, "centroid")), cluster)      # k rows, collected below as well
    d = _dist(F.col("_v"), F.col("centroid"))
    per = pts.groupBy(cluster).agg(F.sum(d * d).alias("ss"), F.avg(d).alias("spread"))
    rows = per.join(cen, cluster).orderBy(cluster).collect()   # k rows of model state
    n_tot = sum(r["n"] for r in rows)
    k = len(rows)
    C = np.array([r["centroid"] for r in rows], dtype=np.float64)
    nk = np.array([r["n"] for r in rows], dtype=np.float64)
    ss = float(sum(r["ss"] for r in rows))
    spread = np.array([r["spread"] for r in rows], dtype=np.float64)
    mean = (C * nk[:, None]).sum(axis=0) / n_tot
    extra = float((nk * ((C - mean) ** 2).sum(axis=1)).sum())
    ch = 1.0 if ss == 0 else extra * (n_tot - k) / (ss * (k - 1)) if k > 1 else None
    if k > 1:
        cd = np.sqrt(((C[:, None, :] - C[None, :, :]) ** 2).sum(-1))
        cd[cd == 0] = np.inf
        comb = spread[:, None] + spread[None, :]
        db = float(np.max(comb / cd, axis=1).mean()) if np.any(spread) else 0.0
    else:
        db = None
    return spark.createDataFrame([(ss, db, ch)], "inertia double, davies_bouldin double, "
                                                 "calinski_harabasz double")


# ------------------------------------------------------------ many k at once
BLOCK_ROWS = 4096


def _vector_blocks(df: DataFrame, id_col: str, vec: str):
    """Rows as an RDD of (ids, matrix), written once; a round over it is one small job."""
    def pack(batches):
        for pdf in batches:
            x = as_matrix(pdf["v"])
            for i in range(0, len(x), BLOCK_ROWS):
                part = np.ascontiguousarray(x[i:i + BLOCK_ROWS])
                yield pd.DataFrame({"n": [len(part)], "ids": [pdf["id"].to_numpy(np.int64)[i:i + BLOCK_ROWS].tobytes()], "x": [part.tobytes()]})
    blocks = cut_lineage(df.select(F.col(id_col).cast("long").alias("id"), F.col(vec).alias("v")).mapInPandas(pack, "n long, ids binary, x binary"))
    return blocks.rdd.map(lambda r: (np.frombuffer(r["ids"], np.int64), np.frombuffer(r["x"]).reshape(r["n"], -1))).persist()


def _to_centres(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances of rows to centres."""
    return ((x[:, None, :] - centres[None]) ** 2).sum(2) if x.size * len(centres) < 1 << 22 else np.concatenate(
        [((part[:, None, :] - centres[None]) ** 2).sum(2) for part in np.array_split(x, -(-x.size * len(centres) >> 22))])


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Nearest centre of each row, ties to the first: by a matrix product, rows that this leaves open by differences."""
    near = np.zeros(len(x), np.int64)
    for s, d, slack in pair_squares(x, centres):
        near[s:s + len(d)] = d.argmin(1)
        if len(centres) > 1:
            two = np.partition(d, 1, axis=1)
            open_ = s + np.flatnonzero(~(two[:, 1] - two[:, 0] > 2 * slack))
            if len(open_):
                near[open_] = _to_centres(x[open_], centres).argmin(1)
    return near


def _hash_of(ids: np.ndarray, salt: int) -> np.ndarray:
    """Uniform numbers in (0, 1) by row id."""
    with np.errstate(over="ignore"):
        h = (ids.astype(np.uint64) + np.uint64(salt * 1_000_003 + 1)) * np.uint64(0x9E3779B97F4A7C15)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
    return ((h >> np.uint64(11)).astype(float) + 0.5) / 2.0 ** 53


def seeds(blocks, k: int, seed: int = 123) -> np.ndarray:
    """k starting centres, each drawn with a chance proportional to its squared distance to those before.

    A row's draw is log(u) / distance² with u from a hash of its id; the largest
    draw wins, so a centre is one pass and one row a block, and the first j centres are a
    start for j clusters."""
    centres = None
    for number in range(k):
        def best(block, centres=centres):
            ids, x = block
            far = np.ones(len(x)) if centres is None else _to_centres(x, centres).min(1)
            with np.errstate(divide="ignore"):
                draw = np.where(far > 0, np.log(_hash_of(ids, seed + number)) / np.where(far > 0, far, 1.0), -np.inf)
            i = int(np.lexsort((ids, -draw))[0])
            return float(draw[i]), int(ids[i]), x[i]
        draw, _, row = max(blocks.map(best).collect(), key=lambda r: (r[0], -r[1]))
        if centres is not None and draw == -np.inf:
            break               # fewer distinct rows than centres
        centres = row[None] if centres is None else np.vstack([centres, row])
    return centres


def lloyd(blocks, starts: list[np.ndarray], max_iter: int = 300, tol: float = 1e-4):
    """k-means from each of ``starts``; one pass moves the centres of all models.

    A model rests when its centres' squared moves stay below ``tol`` times the mean variance.
    An empty cluster keeps its centre.  Returns the centres."""
    def spread(block):
        return len(block[1]), block[1].sum(0), (block[1] ** 2).sum(0)
    n, one, two = blocks.map(spread).treeReduce(lambda a, b: tuple(x + y for x, y in zip(a, b)))
    limit = tol * float((two / n - (one / n) ** 2).mean())
    centres, live = [c.copy() for c in starts], set(range(len(starts)))
    for _ in range(max_iter):
        if not live:
            break

        def step(block, centres=centres, live=sorted(live)):
            x, out = block[1], {}
            for m in live:
                near = _nearest(x, centres[m])
                sums = np.zeros_like(centres[m])
                if np.isfinite(x).all():
                    sums = np.eye(len(centres[m]))[near].T @ x
                else:                       # stay with their own centre
                    np.add.at(sums, near, x)
                out[m] = (sums, np.bincount(near, minlength=len(centres[m])))
            return out
        total = blocks.map(step).treeReduce(lambda a, b: {m: (a[m][0] + b[m][0], a[m][1] + b[m][1]) for m in a})
        for m, (sums, size) in total.items():
            new = np.where(size[:, None] > 0, sums / np.maximum(size, 1)[:, None], centres[m])
            if ((new - centres[m]) ** 2).sum() <= limit:
                live.discard(m)
            centres[m] = new
    return centres


def _silhouettes_kernel(n_models: int):
    def fn(q: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if len(q) == 0 or len(b) == 0:
            return pd.DataFrame({"qid": [], "model": [], "qc": [], "bc": [], "s": [], "n": []})
        qid, bid = q["qid"].to_numpy(np.int64), b["bid"].to_numpy(np.int64)
        ql, bl = np.stack(q["qc"].to_numpy()), np.stack(b["bc"].to_numpy())
        parts = []
        for s, d in product_distances(as_matrix(q["qv"]), as_matrix(b["bv"])):
            m = len(d)
            i, j = same_ids(qid[s:s + m], bid)
            d[i, j] = 0.0
            for k in range(n_models):
                labels, at = np.unique(bl[:, k], return_inverse=True)
                onehot = np.eye(len(labels))[at]
                parts.append(pd.DataFrame({"qid": np.repeat(qid[s:s + m], len(labels)), "model": k, "qc": np.repeat(ql[s:s + m, k], len(labels)),
                                           "bc": np.tile(labels, m), "s": (d @ onehot).ravel(), "n": _others(i, at[j], m, onehot).ravel()}))
        return pd.concat(parts, ignore_index=True)
    return fn


def silhouettes(df: DataFrame, id_col: str, vec: str, labels: str, n_models: int, block_rows: int | None = None) -> DataFrame:
    """(model, silhouette): exact mean silhouette of each of ``n_models`` labellings (an array
    column); every distance is worked out once for all of them."""
    ship_package(df.sparkSession)
    n = df.count()
    b = n_blocks(n, block_rows or rows_a_block(n), 2 * df.sparkSession.sparkContext.defaultParallelism)
    base = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec).alias("v"), F.col(labels).alias("c"))
    q = replicate(base.toDF("qid", "qv", "qc"), "qid", "qblk", "bblk", b)
    r = replicate(base.toDF("bid", "bv", "bc"), "bid", "bblk", "qblk", b)
    per = (q.groupBy("qblk", "bblk").cogroup(r.groupBy("qblk", "bblk"))
           .applyInPandas(_silhouettes_kernel(n_models), "qid long, model int, qc int, bc int, s double, n long")
           .groupBy("qid", "model", "qc", "bc").agg(F.sum("s").alias("s"), F.sum("n").alias("n")))
    mean = F.try_divide(F.col("s"), F.col("n"))
    own = F.col("bc") == F.col("qc")
    pt = per.groupBy("qid", "model").agg(F.max(F.when(own, mean)).alias("a"), F.max(F.when(own, F.col("n"))).alias("n"),
                                         F.min(F.when(~own & (F.col("n") > 0), mean)).alias("b"))
    s = F.when(F.coalesce(F.col("n"), F.lit(0)) == 0, F.lit(0.0)).otherwise(F.coalesce(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")), F.lit(0.0)))
    return pt.groupBy("model").agg(F.avg(s).alias("silhouette"))


def kmeans_sweep(df: DataFrame, id_col: str, vec: str, ks, seed: int = 123, max_iter: int = 300, tol: float = 1e-4):
    """k-means for every k in ``ks`` (J13): one scan a round for all of them.

    Returns (scores (k, inertia, silhouette, davies_bouldin, calinski_harabasz; the last three
    null for one cluster), labels (id, labels array in the order of ``ks``), centres)."""
    spark, ks = df.sparkSession, list(ks)
    ship_package(spark)
    blocks = _vector_blocks(df, id_col, vec)
    try:
        start = seeds(blocks, max(ks), seed)
        centres = lloyd(blocks, [start[:k] for k in ks], max_iter, tol)

        def measure(block):
            x, out = block[1], []
            for c in centres:
                d = _to_centres(x, c)
                near = d.argmin(1)
                low = d[np.arange(len(x)), near]
                out.append(np.stack([np.bincount(near, minlength=len(c)), np.bincount(near, np.sqrt(low), len(c)), np.bincount(near, low, len(c))]))
            return out, len(x), x.sum(0)
        sums, n, total = blocks.map(measure).treeReduce(lambda a, b: ([x + y for x, y in zip(a[0], b[0])], a[1] + b[1], a[2] + b[2]))
    finally:
        blocks.unpersist()

    def label(vectors: pd.Series) -> pd.Series:
        x = as_matrix(vectors)
        return pd.Series(list(np.stack([_to_centres(x, c).argmin(1) for c in centres], 1).astype(np.int32)) if len(x) else [], dtype=object)
    labels = cut_lineage(df.select(F.col(id_col), F.col(vec), F.pandas_udf(label, "array<int>")(F.col(vec)).alias("labels")))
    several = [i for i, c in enumerate(centres) if (sums[i][0] > 0).sum() > 1]
    shown = labels.withColumn("labels", F.array(*[F.col("labels")[i] for i in several])) if several else None
    found = {several[r["model"]]: r["silhouette"] for r in silhouettes(shown, id_col, vec, "labels", len(several)).collect()} if several else {}
    rows = []
    for i, k in enumerate(ks):
        (size, dist, square), c = sums[i], centres[i]
        used = size > 0
        db = ch = None
        if used.sum() > 1:
            mean, c, size = dist[used] / size[used], c[used], size[used]
            apart = np.sqrt(_to_centres(c, c))
            with np.errstate(divide="ignore"):
                ratio = np.where(apart > 0, (mean[:, None] + mean[None]) / np.where(apart > 0, apart, 1.0), 0.0)
            db = float(ratio.max(1).mean())
            between = float((size * ((c - total / n) ** 2).sum(1)).sum())
            ch = between * (n - len(c)) / (float(square.sum()) * (len(c) - 1)) if square.sum() > 0 and n > len(c) else None
        rows.append((int(k), float(square.sum()), found.get(i), db, ch))
    scores = spark.createDataFrame(rows, "k int, inertia double, silhouette double, davies_bouldin double, calinski_harabasz double")
    return scores, labels.select(id_col, "labels"), centres
