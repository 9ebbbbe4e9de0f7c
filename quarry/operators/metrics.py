"""Evaluation metrics on an ``(id, label, score | prediction)`` DataFrame.

* Count-based metrics come from **one** conditional aggregate (the four
  confusion cells) and are derived with column arithmetic.
* Curve metrics first collapse rows to one row per *distinct score*
  (partial aggregate), then take running sums with the distributed
  :func:`quarry.plans.ranking.prefix_sums` — no single-task window even when
  the number of distinct scores is large.
* Undefined ratios (0/0) give 0, as the reference's metric library does by
  default; MCC gives 0 when its denominator is 0.
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.plans.ranking import prefix_sums, row_number


def _div0(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def confusion_counts(df: DataFrame, label: str = "label", pred: str = "prediction") -> DataFrame:
    """One row: tp, fp, tn, fn, n (binary, positive class 1)."""
    y, p = F.col(label), F.col(pred)
    return df.agg(F.count(F.when((y == 1) & (p == 1), 1)).alias("tp"),
                  F.count(F.when((y == 0) & (p == 1), 1)).alias("fp"),
                  F.count(F.when((y == 0) & (p == 0), 1)).alias("tn"),
                  F.count(F.when((y == 1) & (p == 0), 1)).alias("fn"),
                  F.count(F.when(y.isNotNull() & p.isNotNull(), 1)).alias("n"))


def confusion(df: DataFrame, label: str = "label", pred: str = "prediction") -> DataFrame:
    """(label, prediction, count) for all four binary cells, zeros included (L1)."""
    c = confusion_counts(df, label, pred)
    return c.selectExpr("stack(4, 0, 0, tn, 0, 1, fp, 1, 0, fn, 1, 1, tp) "
                        f"AS ({label}, {pred}, count)")


def _report_cols(tp, fp, tn, fn, n):
    prec = _div0(tp, tp + fp)
    rec = _div0(tp, tp + fn)
    f1 = _div0(2 * prec * rec, prec + rec)
    prec0 = _div0(tn, tn + fn)
    rec0 = _div0(tn, tn + fp)
    f1_0 = _div0(2 * prec0 * rec0, prec0 + rec0)
    n1, n0 = tp + fn, tn + fp
    sens_w = _div0(rec * n1 + rec0 * n0, n)        # support-weighted sensitivity
    spec_w = _div0(rec0 * n1 + rec * n0, n)        # support-weighted specificity
    denom = F.sqrt((tp + fp).cast("double") * (tp + fn) * (tn + fp) * (tn + fn))
    mcc = F.when(denom == 0, F.lit(0.0)).otherwise(
        (tp.cast("double") * tn - fp.cast("double") * fn) / denom)
    return {
        "accuracy": _div0(tp + tn, n), "precision": prec, "recall": rec, "f1": f1,
        "weighted_f1": _div0(f1 * n1 + f1_0 * n0, n),
        "balanced_accuracy": (rec + rec0) / 2, "mcc": mcc,
        "gmean": F.sqrt(sens_w * spec_w),
    }


def classification_report(df: DataFrame, label: str = "label",
                          pred: str = "prediction") -> DataFrame:
    """accuracy, precision, recall, F1, weighted F1, balanced accuracy, MCC and
    weighted geometric mean from one aggregate (L2, L3, L9, L10)."""
    c = confusion_counts(df, label, pred)
    tp, fp, tn, fn, n = (F.col(x) for x in ("tp", "fp", "tn", "fn", "n"))
    cols = _report_cols(tp, fp, tn, fn, n)
    return c.select("tp", "fp", "tn", "fn", "n", *[v.alias(k) for k, v in cols.items()])


def _score_table(df, label, score):
    """One row per distinct score: positives and negatives at that score."""
    return df.where(F.col(score).isNotNull() & F.col(label).isNotNull()).groupBy(
        F.col(score).cast("double").alias("threshold")).agg(
        F.count(F.when(F.col(label) == 1, 1)).alias("pos"),
        F.count(F.when(F.col(label) != 1, 1)).alias("neg"))


def _totals(df, label, score):
    r = df.where(F.col(score).isNotNull() & F.col(label).isNotNull()).agg(
        F.count(F.when(F.col(label) == 1, 1)).alias("P"),
        F.count(F.when(F.col(label) != 1, 1)).alias("N")).first()
    return r["P"], r["N"]


def roc_curve(df: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """(threshold, fpr, tpr) at every distinct score (descending cut
    ``score >= threshold``) plus the origin at threshold +inf (L4)."""
    P, N = _totals(df, label, score)
    cum = prefix_sums(_score_table(df, label, score), [F.desc("threshold")], ["pos", "neg"],
                      out_cols=["tp", "fp"], rank_col=None)
    pts = cum.select("threshold", (F.col("fp") / F.lit(float(N) if N else None)).alias("fpr"),
                     (F.col("tp") / F.lit(float(P) if P else None)).alias("tpr"))
    origin = df.sparkSession.createDataFrame([(float("inf"), 0.0, 0.0)], pts.schema)
    return pts.unionByName(origin)


def roc_auc(df: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """Exact ROC AUC with tied scores counted half (Mann-Whitney form)."""
    P, N = _totals(df, label, score)
    cum = prefix_sums(_score_table(df, label, score), ["threshold"], ["neg"],
                      out_cols=["neg_le"], rank_col=None)
    s = F.sum(F.col("pos") * (F.col("neg_le") - F.col("neg") / 2.0))
    return cum.agg((s / F.lit(float(P * N) if P and N else None)).alias("auc"))


def pr_curve(df: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """(threshold, precision, recall) at every distinct score."""
    P, _ = _totals(df, label, score)
    cum = prefix_sums(_score_table(df, label, score), [F.desc("threshold")], ["pos", "neg"],
                      out_cols=["tp", "fp"], rank_col=None)
    return cum.select("threshold", _div0(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"),
                      (F.col("tp") / F.lit(float(P) if P else None)).alias("recall"), "pos")


def average_precision(df: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """AP = Σ (R_k − R_{k−1}) · P_k over descending distinct thresholds, and
    the no-skill precision P/n (L6)."""
    P, N = _totals(df, label, score)
    pr = pr_curve(df, label, score)
    return pr.agg((F.sum(F.col("pos") * F.col("precision")) / F.lit(float(P) if P else None))
                  .alias("average_precision"),
                  F.lit(float(P) / (P + N) if P + N else None).alias("no_skill"))


def best_threshold(df: DataFrame, label: str = "label", score: str = "score",
                   how: str = "gmean") -> DataFrame:
    """Threshold maximising sqrt(TPR·(1−FPR)) (``how='gmean'``, what the
    reference computes) or TPR−FPR (``'youden'``); the highest threshold
    wins ties (L11)."""
    roc = roc_curve(df, label, score)
    crit = (F.sqrt(F.col("tpr") * (1 - F.col("fpr"))) if how == "gmean"
            else F.col("tpr") - F.col("fpr"))
    r = roc.withColumn("crit", crit)
    best = F.max_by(F.struct("threshold", "fpr", "tpr", "crit"), F.struct("crit", "threshold"))
    return r.agg(best.alias("b")).select("b.threshold", "b.fpr", "b.tpr",
                                         F.col("b.crit").alias(how))


def binarize(df: DataFrame, score: str, threshold: float, out: str = "prediction") -> DataFrame:
    return df.withColumn(out, (F.col(score) > F.lit(threshold)).cast("int"))


def regression_report(df: DataFrame, label: str = "label", pred: str = "score") -> DataFrame:
    """MSE, RMSE and R² (total sum of squares about the label mean)."""
    e = F.col(pred) - F.col(label)
    a = df.agg(F.avg(e * e).alias("mse"), F.var_pop(label).alias("_v"))
    return a.select("mse", F.sqrt("mse").alias("rmse"),
                    F.when(F.col("_v") == 0, F.lit(None)).otherwise(1 - F.col("mse") / F.col("_v"))
                    .alias("r2"))


def brier(df: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """Mean squared difference between probability and outcome."""
    e = F.col(score) - F.col(label)
    return df.agg(F.avg(e * e).alias("brier"))


def losses(df: DataFrame, label: str = "label", score: str = "score",
           weights: tuple[float, float] = (1.0, 1.0), gamma: float = 2.0,
           eps: float = 1e-15) -> DataFrame:
    """Log loss, class-weighted BCE and focal loss in one aggregate.

    Focal loss applies the class weight inside the cross-entropy *before*
    ``pt = exp(-ce)``, as the reference does."""
    y = F.col(label).cast("double")
    p = F.least(F.greatest(F.col(score).cast("double"), F.lit(eps)), F.lit(1 - eps))
    bce = -(y * F.log(p) + (1 - y) * F.log(1 - p))
    w = y * F.lit(weights[1]) + (1 - y) * F.lit(weights[0])
    ce = w * bce
    focal = F.pow(1 - F.exp(-ce), F.lit(gamma)) * ce
    return df.agg(F.avg(bce).alias("log_loss"), F.avg(ce).alias("weighted_bce"),
                  F.avg(focal).alias("focal_loss"))


def batch_accuracy(df: DataFrame, key: str, label: str = "label", pred: str = "prediction",
                   batch_size: int = 32) -> DataFrame:
    """Mean of per-batch accuracies over batches of ``batch_size`` rows in key
    order (differs from global accuracy when the last batch is short) (L13)."""
    r = row_number(df, [key], out="_rn")
    b = r.groupBy(F.floor((F.col("_rn") - 1) / batch_size).alias("_b")).agg(
        F.avg((F.col(label) == F.col(pred)).cast("double")).alias("_acc"))
    return b.agg(F.avg("_acc").alias("batch_accuracy"), F.count(F.lit(1)).alias("batches"))


def leaderboard(reports: dict) -> DataFrame:
    """Stack named classification reports into one table (L16); sort with
    ``orderBy(desc('accuracy'))`` when presenting."""
    parts = [r.select(F.lit(name).alias("model"), *r.columns) for name, r in reports.items()]
    return reduce(lambda a, b: a.unionByName(b), parts)
