"""Reproducible splits, folds and samples.

Randomness comes from ``md5(salt || key)`` rather than a task-local RNG, so
an assignment does not change when data is repartitioned or a lost task is
recomputed.  Exact-size cuts (hold-out of exactly ⌈n·p⌉ rows, k folds of
near-equal size) rank rows by that hash with the distributed
:func:`quarry.plans.ranking.row_number`, never with a global window.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.columns import hash_int, hash_unit
from quarry.plans.ranking import row_number
from quarry.session import cut_lineage


def assign_split(df: DataFrame, key: str, weights, salt: str = "", out: str = "split") -> DataFrame:
    """Split index by cumulative weight of a per-key uniform number (H1).
    Proportions are approximate (like ``randomSplit``) but stable."""
    total = float(sum(weights))
    u = hash_unit(key, salt)
    edges, acc = [], 0.0
    for w in weights[:-1]:
        acc += w / total
        edges.append(acc)
    expr = F.lit(len(weights) - 1)
    for i in reversed(range(len(edges))):
        expr = F.when(u < F.lit(edges[i]), F.lit(i)).otherwise(expr)
    return df.withColumn(out, expr)


def hash_split(df: DataFrame, key: str, weights, salt: str = ""):
    """List of DataFrames, one per weight (H1)."""
    a = assign_split(df, key, weights, salt, "_split")
    return [a.where(F.col("_split") == i).drop("_split") for i in range(len(weights))]


def _ranked(df, key, by, salt):
    by = [] if by is None else ([by] if isinstance(by, str) else list(by))
    h = df.withColumn("_h", hash_int(key, salt))
    return row_number(h, ["_h", key], by, out="_rank"), by


def holdout(df: DataFrame, key: str, test_frac: float, by=None, salt: str = "",
            out: str = "is_test") -> DataFrame:
    """Exactly ⌈n·test_frac⌉ rows per group (or overall) flagged as test
    (H2; H3 when ``by`` is the label)."""
    r, by = _ranked(df, key, by, salt)
    n = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")) if by else None
    if by:
        r = r.join(n, by, "left")
    else:
        r = r.withColumn("_n", F.lit(df.count()))
    flag = (F.col("_rank") <= F.ceil(F.col("_n") * F.lit(test_frac))).cast("int")
    return r.withColumn(out, flag).drop("_h", "_rank", "_n")


def three_way(df: DataFrame, key: str, test_frac: float, valid_frac: float, by=None, salt: str = "", out: str = "part") -> DataFrame:
    """``test``, ``valid`` and ``train`` per group (H3): exactly ⌈n·test_frac⌉ test rows, then
    ⌈rest·valid_frac⌉ validation rows of the others.  One ranking serves both stages."""
    by = [] if by is None else ([by] if isinstance(by, str) else list(by))
    # only keys are ranked; the other columns meet their rank in a join
    keys = df.select(key, *by)
    ranked, _ = _ranked(keys, key, by, salt)
    sizes = cut_lineage(keys.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")))
    ranked = ranked.join(sizes, [ranked[c].eqNullSafe(sizes[c]) for c in by], "inner").drop(*[sizes[c] for c in by]) if by else ranked.crossJoin(F.broadcast(sizes))
    test = F.ceil(F.col("_n") * F.lit(test_frac))
    valid = test + F.ceil((F.col("_n") - test) * F.lit(valid_frac))
    part = F.when(F.col("_rank") <= test, "test").when(F.col("_rank") <= valid, "valid").otherwise("train")
    parts = ranked.select(F.col(key).alias("_key"), part.alias(out))
    return df.join(parts, F.col(key).eqNullSafe(F.col("_key"))).drop("_key")


def kfold(df: DataFrame, key: str, k: int, by=None, salt: str = "", out: str = "fold") -> DataFrame:
    """Fold 0..k-1 dealt round-robin in hash order within each group, so
    every group is spread evenly over the folds (H5, stratified when ``by``)."""
    r, _ = _ranked(df, key, by, salt)
    return r.withColumn(out, ((F.col("_rank") - 1) % k).cast("int")).drop("_h", "_rank")


def block_folds(df: DataFrame, key: str, k: int, out: str = "fold") -> DataFrame:
    """Contiguous blocks in key order: fold = ⌊(row_number−1)·k/n⌋."""
    n = df.count()
    r = row_number(df, [key], out="_rn")
    return r.withColumn(out, F.floor((F.col("_rn") - 1) * F.lit(k) / F.lit(n)).cast("int")).drop("_rn")


def sample_frac(df: DataFrame, key: str, frac: float, salt: str = "") -> DataFrame:
    """Exactly round(n·frac) rows, chosen by hash order (H4)."""
    r, _ = _ranked(df, key, None, salt)
    m = int(round(df.count() * frac))
    return r.where(F.col("_rank") <= m).drop("_h", "_rank")


def undersample(df: DataFrame, key: str, label: str, minority_value, ratio: float,
                salt: str = "") -> DataFrame:
    """Keep every minority row and ⌊n_min/ratio⌋ majority rows chosen by hash
    order (H7: minority / majority = ratio afterwards)."""
    n_min = df.where(F.col(label) == minority_value).count()
    keep = int(n_min / ratio)
    maj = df.where(F.col(label) != minority_value)
    r, _ = _ranked(maj, key, None, salt)
    return df.where(F.col(label) == minority_value).unionByName(
        r.where(F.col("_rank") <= keep).drop("_h", "_rank"))
