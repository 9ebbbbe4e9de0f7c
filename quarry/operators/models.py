"""Model-side operators: voting, ensembles, class weights.
Fitted models live in :mod:`quarry.operators.learn`."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hard_vote(df: DataFrame, votes, out: str = "vote") -> DataFrame:
    """Majority of 0/1 votes; a tie goes to the smaller class 0."""
    s = reduce(lambda a, b: a + b, [F.col(v) for v in votes])
    return df.withColumn(out, (s > F.lit(len(votes) / 2.0)).cast("int"))


def mean_ensemble(df: DataFrame, probs, out: str = "ensemble") -> DataFrame:
    """Average of several probability columns."""
    s = reduce(lambda a, b: a + b, [F.col(p).cast("double") for p in probs])
    return df.withColumn(out, s / F.lit(float(len(probs))))


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """(label, n, weight, ratio_to_first): normalised inverse frequency and the
    count ratio to the smallest label (E16).  Per-class counts are one small
    aggregate; the two normalisers (Σ 1/n and the first label's n) come back
    as one row and are applied as literals."""
    c = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    tot = c.agg(F.sum(F.lit(1.0) / F.col("n")).alias("inv"),
                F.min_by(F.col("n"), F.col(label)).alias("first")).first()
    inv = F.lit(1.0) / F.col("n")
    return c.select(label, "n", (inv / F.lit(tot["inv"])).alias("weight"),
                    (F.col("n") / F.lit(float(tot["first"]))).alias("ratio_to_first"))
