"""Randomised-experiment analysis.

Each estimate is one global conditional aggregate (no per-arm masked scans);
cluster-level variants first roll rows up to (cluster, treatment) means with
a partial aggregate, which also neutralises a hot cluster.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def group_means(df: DataFrame, keys, cols=None) -> DataFrame:
    """Mean of every numeric column per group."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    num = [f.name for f in df.schema.fields if f.name not in keys
           and f.dataType.typeName() in ("double", "float", "integer", "long", "short",
                                         "decimal", "byte")]
    cols = cols or num
    return df.groupBy(*keys).agg(*[F.avg(c).alias(c) for c in cols])


def group_shares(df: DataFrame, key: str) -> DataFrame:
    """(key, n, share) — share of all rows (E3).  The total is one number."""
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    total = df.count()
    return counts.withColumn("share", F.try_divide(F.col("n"), F.lit(float(total)) if total else F.lit(None)))


def ate(df: DataFrame, treatment: str = "treatment", outcome: str = "sale",
        z: float = 1.96) -> DataFrame:
    """Difference of means with SE sqrt(var1/n1 + var0/n0) (sample variances)
    and a normal CI (E5).  Undefined variances (n <= 1) give null SE/CI."""
    t = F.col(treatment) == 1
    c = F.col(treatment) == 0
    y = F.col(outcome)
    agg = df.agg(F.avg(F.when(t, y)).alias("mean_t"), F.avg(F.when(c, y)).alias("mean_c"),
                 F.var_samp(F.when(t, y)).alias("var_t"), F.var_samp(F.when(c, y)).alias("var_c"),
                 F.count(F.when(t, y)).alias("n_t"), F.count(F.when(c, y)).alias("n_c"))
    est = F.col("mean_t") - F.col("mean_c")
    se = F.sqrt(F.try_divide(F.col("var_t"), F.col("n_t")) + F.try_divide(F.col("var_c"), F.col("n_c")))
    return agg.select("n_t", "n_c", "mean_t", "mean_c", est.alias("ate"), se.alias("se"),
                      (est - F.lit(z) * se).alias("ci_low"), (est + F.lit(z) * se).alias("ci_high"))


def cluster_ate(df: DataFrame, cluster: str = "store_id", treatment: str = "treatment",
                outcome: str = "sale", z: float = 1.96) -> DataFrame:
    """ATE on cluster means: one row per (cluster, treatment) first (E4+E5)."""
    rolled = df.groupBy(cluster, treatment).agg(F.avg(outcome).alias(outcome))
    return ate(rolled, treatment, outcome, z)


def itt_tot(df: DataFrame, arm: str = "arm", took_up: str = "took_up",
            outcome: str = "outcome", control=0) -> DataFrame:
    """Per arm vs the ``control`` arm: ITT (difference in outcome rates) and
    TOT = ITT / (difference in take-up rates), the Wald estimator (E6).

    Pass another arm as ``control`` for arm-vs-arm contrasts (e.g. T2 vs T1).
    The reference arm's rates come back as one aggregate row and are applied
    as literals (no join, no unpartitioned window).
    """
    per = df.groupBy(arm).agg(F.avg(outcome).alias("outcome_rate"),
                              F.avg(took_up).alias("take_up"),
                              F.count(F.lit(1)).alias("n"))
    # the reference arm's two rates: one small aggregate row, used as literals
    ref = df.where(F.col(arm) == F.lit(control)).agg(
        F.avg(outcome).alias("o"), F.avg(took_up).alias("t")).first()
    itt = F.col("outcome_rate") - F.lit(ref["o"])
    return per.where(F.col(arm) != F.lit(control)).select(
        arm, F.lit(control).alias("reference_arm"), "n", "outcome_rate", "take_up",
        itt.alias("itt"),
        F.try_divide(itt, F.col("take_up") - F.lit(ref["t"])).alias("tot"))
