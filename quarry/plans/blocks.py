"""Blocked pairwise kernels for exact all-pairs work (kNN, silhouette).

Rows of each side are hashed into ``B`` blocks by id.  Every query block
meets every base block through a *cogroup on (query_block, base_block)*:
query rows are replicated to the ``B`` base-block keys and base rows to the
``B`` query-block keys, so each ``applyInPandas`` call sees two bounded
blocks (``≈ block_rows`` rows each) — never a whole side, never a cross
join, and the output per call is already reduced (top-k candidates, or
per-cluster distance sums), not the pairs.  Hash blocking keeps the blocks
even however skewed any other attribute is.

Cost: each row is shuffled ``B`` times (``B ≈ n / block_rows``), i.e. the
inherent O(n²) of exact all-pairs work, spread over ``B²`` tasks.
"""
from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.columns import hash_int


def n_blocks(n_rows: int, block_rows: int = 2048, min_tasks: int = 1) -> int:
    """Blocks per side: enough that a block holds at most ``block_rows``
    rows, and enough that the B² block pairs give at least ``min_tasks``
    tasks (but never more blocks than rows)."""
    b = max(1, math.ceil(n_rows / block_rows), math.ceil(math.sqrt(min_tasks)))
    return max(1, min(b, n_rows))


def replicate(df: DataFrame, id_col: str, own: str, other: str, b: int) -> DataFrame:
    """Tag rows with their own block and replicate them to all ``b`` partner blocks."""
    return (df.withColumn(own, F.pmod(hash_int(id_col, "blk"), F.lit(b)).cast("int"))
            .withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(b - 1)))))


def rows_a_block(n_rows: int) -> int:
    """Rows of a block where all pairs may meet: 2n²/block rows move, so blocks grow with the
    root of n, up to a size (16384) whose task still is small."""
    return int(min(max(2048, math.sqrt(512 * n_rows)), 16384))


def as_matrix(series: pd.Series) -> np.ndarray:
    if len(series) == 0:
        return np.zeros((0, 0))
    return np.vstack([np.asarray(v, dtype=np.float64) for v in series.to_numpy()])


def pair_distances(q: np.ndarray, b: np.ndarray, budget_bytes: int = 64 << 20):
    """Yield (row_offset, euclidean distance chunk) between rows of q and b,
    computed from explicit differences (no |a|²+|b|²−2ab cancellation, so
    duplicate vectors give exactly 0 and ties stay ties).  The chunk height
    keeps the difference tensor under ``budget_bytes`` whatever the
    dimension, so a task's memory is bounded by the block sizes."""
    d = max(q.shape[1], 1)
    chunk = max(1, int(budget_bytes // (8 * d * max(b.shape[0], 1))))
    for s in range(0, q.shape[0], chunk):
        diff = q[s:s + chunk, None, :] - b[None, :, :]
        yield s, np.sqrt(np.einsum("ijk,ijk->ij", diff, diff))


def same_ids(qid: np.ndarray, bid: np.ndarray):
    """(i, j) of all pairs with one id."""
    order = np.argsort(bid, kind="stable")
    first, last = (np.searchsorted(bid[order], qid, side) for side in ("left", "right"))
    many = last - first
    i = np.repeat(np.arange(len(qid)), many)
    return i, order[np.arange(len(i)) - np.repeat(np.cumsum(many) - many, many) + first[i]]


def pair_squares(q: np.ndarray, b: np.ndarray, budget_bytes: int = 16 << 20):
    """Yield (row_offset, chunk of squared distances, slack of each row) from one matrix product.

    ``|a|²+|b|²−2ab`` is off by ``slack`` at most, so it can only choose pairs whose distance is
    then worked out from differences (:func:`distances_of`).  Values too large for squares
    go by differences."""
    chunk = max(1, int(budget_bytes // (8 * max(b.shape[0], 1))))
    with np.errstate(over="ignore", invalid="ignore"):
        qn, bn = np.einsum("ij,ij->i", q, q), np.einsum("ij,ij->i", b, b)
        top = max(qn.max(initial=0.0), bn.max(initial=0.0))
    if not top < 1e300:
        with np.errstate(over="ignore", invalid="ignore"):
            for s, d in pair_distances(q, b):
                yield s, d * d, np.zeros(len(d))
        return
    slack = 8 * (q.shape[1] + 8) * np.finfo(float).eps * (qn + bn.max(initial=0.0))
    for s in range(0, q.shape[0], chunk):
        d = q[s:s + chunk] @ b.T
        d *= -2.0
        d += qn[s:s + chunk, None]
        d += bn[None, :]
        yield s, d, slack[s:s + chunk]


def distances_of(q: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray, slice_pairs: int = 1 << 16) -> np.ndarray:
    """Distances of the pairs (q[i], b[j]) from explicit differences."""
    out = np.empty(len(i))
    with np.errstate(over="ignore", invalid="ignore"):
        for s in range(0, len(i), slice_pairs):
            diff = q[i[s:s + slice_pairs]] - b[j[s:s + slice_pairs]]
            out[s:s + slice_pairs] = np.sqrt(np.einsum("ij,ij->i", diff, diff))
    return out


def product_distances(q: np.ndarray, b: np.ndarray, budget_bytes: int = 16 << 20):
    """Yield (row_offset, distance chunk) from a matrix product; where it leaves less than about
    nine digits (near pairs), distances come from differences, so copies are 0 apart."""
    for s, d, slack in pair_squares(q, b, budget_bytes):
        with np.errstate(invalid="ignore"):
            i, j = np.nonzero(~(d > 1e9 * slack[:, None]))
        near = distances_of(q[s:s + len(d)], b, i, j)
        np.sqrt(np.maximum(d, 0.0, out=d), out=d)
        d[i, j] = near
        yield s, d
