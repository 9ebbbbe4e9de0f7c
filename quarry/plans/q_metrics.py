"""Registered queries: evaluation metrics, voting and ensembles (L*, K10, K16, G10, G13, E16)."""
from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions import columns as C
from quarry.operators import metrics as M
from quarry.operators import models as MD
from quarry.plans.fixtures import cte, fixture

Q, SQL = {}, {}


def _pred(spark, sf):
    return fixture(spark, sf, "fx_pred")


def _r(c, d=6):
    return F.round(c, d).alias(c)


_CELLS = """,
c AS (SELECT COUNT(CASE WHEN label = 1 AND {p} = 1 THEN 1 END) AS tp,
             COUNT(CASE WHEN label = 0 AND {p} = 1 THEN 1 END) AS fp,
             COUNT(CASE WHEN label = 0 AND {p} = 0 THEN 1 END) AS tn,
             COUNT(CASE WHEN label = 1 AND {p} = 0 THEN 1 END) AS fn,
             COUNT(CASE WHEN label IS NOT NULL AND {p} IS NOT NULL THEN 1 END) AS n FROM fx_pred)"""


def l1_confusion(spark, sf):
    return M.confusion(_pred(spark, sf)).select("label", "prediction",
                                                F.col("count").cast("long").alias("count"))


Q["l1_confusion"] = l1_confusion
SQL["l1_confusion"] = cte("fx_pred") + """,
cells AS (SELECT * FROM (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) v(label, prediction))
SELECT c.label, c.prediction, CAST(COUNT(p.id) AS BIGINT) AS count
FROM cells c LEFT JOIN fx_pred p ON p.label = c.label AND p.prediction = c.prediction
GROUP BY c.label, c.prediction"""

_REPORT = ["accuracy", "precision", "recall", "f1", "weighted_f1", "balanced_accuracy", "mcc", "gmean"]


def _report_sql(p):
    d = "(CASE WHEN ({b}) = 0 THEN 0.0 ELSE ({a}) * 1.0 / ({b}) END)"
    prec = d.format(a="tp", b="tp + fp")
    rec = d.format(a="tp", b="tp + fn")
    prec0 = d.format(a="tn", b="tn + fn")
    rec0 = d.format(a="tn", b="tn + fp")
    f1 = d.format(a=f"2 * {prec} * {rec}", b=f"{prec} + {rec}")
    f10 = d.format(a=f"2 * {prec0} * {rec0}", b=f"{prec0} + {rec0}")
    sens = d.format(a=f"{rec} * (tp + fn) + {rec0} * (tn + fp)", b="n")
    spec = d.format(a=f"{rec0} * (tp + fn) + {rec} * (tn + fp)", b="n")
    den = "SQRT((tp + fp) * 1.0 * (tp + fn) * (tn + fp) * (tn + fn))"
    return _CELLS.format(p=p) + f"""
SELECT CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(tn AS BIGINT) AS tn,
       CAST(fn AS BIGINT) AS fn, CAST(n AS BIGINT) AS n,
       ROUND({d.format(a='tp + tn', b='n')}, 6) AS accuracy, ROUND({prec}, 6) AS precision,
       ROUND({rec}, 6) AS recall, ROUND({f1}, 6) AS f1,
       ROUND({d.format(a=f'{f1} * (tp + fn) + {f10} * (tn + fp)', b='n')}, 6) AS weighted_f1,
       ROUND(({rec} + {rec0}) / 2, 6) AS balanced_accuracy,
       ROUND(CASE WHEN {den} = 0 THEN 0.0 ELSE (tp * 1.0 * tn - fp * 1.0 * fn) / {den} END, 6) AS mcc,
       ROUND(SQRT({sens} * {spec}), 6) AS gmean
FROM c"""


def l2_report(spark, sf):
    r = M.classification_report(_pred(spark, sf))
    return r.select(*[F.col(c).cast("long").alias(c) for c in ["tp", "fp", "tn", "fn", "n"]],
                    *[_r(c) for c in _REPORT])


Q["l2_report"] = l2_report
SQL["l2_report"] = cte("fx_pred") + _report_sql("prediction")

_SCORES = """,
s AS (SELECT score AS threshold, COUNT(CASE WHEN label = 1 THEN 1 END) AS pos,
             COUNT(CASE WHEN label <> 1 THEN 1 END) AS neg
      FROM fx_pred WHERE score IS NOT NULL AND label IS NOT NULL GROUP BY score),
t AS (SELECT SUM(pos) AS P, SUM(neg) AS N FROM s)"""


def l4_roc_curve(spark, sf):
    return M.roc_curve(_pred(spark, sf)).select("threshold", _r("fpr"), _r("tpr"))


Q["l4_roc_curve"] = l4_roc_curve
SQL["l4_roc_curve"] = cte("fx_pred") + _SCORES + """
SELECT threshold, ROUND(SUM(neg) OVER (ORDER BY threshold DESC) / N, 6) AS fpr,
       ROUND(SUM(pos) OVER (ORDER BY threshold DESC) / P, 6) AS tpr FROM s, t
UNION ALL SELECT 'inf'::DOUBLE, 0.0, 0.0"""


def l5_roc_auc(spark, sf):
    return M.roc_auc(_pred(spark, sf)).select(_r("auc"))


Q["l5_roc_auc"] = l5_roc_auc
SQL["l5_roc_auc"] = cte("fx_pred") + _SCORES + """,
c AS (SELECT pos, neg, SUM(neg) OVER (ORDER BY threshold) AS neg_le FROM s)
SELECT ROUND(SUM(pos * (neg_le - neg / 2.0)) / (ANY_VALUE(P) * ANY_VALUE(N)), 6) AS auc FROM c, t"""


def l6_pr_curve(spark, sf):
    return M.pr_curve(_pred(spark, sf)).select("threshold", _r("precision"), _r("recall"))


Q["l6_pr_curve"] = l6_pr_curve
SQL["l6_pr_curve"] = cte("fx_pred") + _SCORES + """,
c AS (SELECT threshold, SUM(pos) OVER (ORDER BY threshold DESC) AS tp,
             SUM(neg) OVER (ORDER BY threshold DESC) AS fp FROM s)
SELECT threshold, ROUND(tp * 1.0 / (tp + fp), 6) AS precision, ROUND(tp * 1.0 / P, 6) AS recall FROM c, t"""


def l6_average_precision(spark, sf):
    return M.average_precision(_pred(spark, sf)).select(_r("average_precision"), _r("no_skill"))


Q["l6_average_precision"] = l6_average_precision
SQL["l6_average_precision"] = cte("fx_pred") + _SCORES + """,
c AS (SELECT pos, SUM(pos) OVER (ORDER BY threshold DESC) AS tp,
             SUM(neg) OVER (ORDER BY threshold DESC) AS fp FROM s)
SELECT ROUND(SUM(pos * tp * 1.0 / (tp + fp)) / ANY_VALUE(P), 6) AS average_precision,
       ROUND(ANY_VALUE(P) * 1.0 / (ANY_VALUE(P) + ANY_VALUE(N)), 6) AS no_skill FROM c, t"""


def l7_regression(spark, sf):
    return M.regression_report(_pred(spark, sf)).select(_r("mse"), _r("rmse"), _r("r2"))


Q["l7_regression"] = l7_regression
SQL["l7_regression"] = cte("fx_pred") + """
SELECT ROUND(AVG((score - label) * (score - label)), 6) AS mse,
       ROUND(SQRT(AVG((score - label) * (score - label))), 6) AS rmse,
       ROUND(1 - AVG((score - label) * (score - label)) / VAR_POP(label), 6) AS r2 FROM fx_pred"""


def l8_brier(spark, sf):
    return M.brier(_pred(spark, sf)).select(_r("brier"))


Q["l8_brier"] = l8_brier
SQL["l8_brier"] = cte("fx_pred") + \
    "SELECT ROUND(AVG((score - label) * (score - label)), 6) AS brier FROM fx_pred"


def l11_best_threshold(spark, sf):
    b = M.best_threshold(_pred(spark, sf))
    return b.select("threshold", _r("fpr"), _r("tpr"), _r("gmean"))


Q["l11_best_threshold"] = l11_best_threshold
SQL["l11_best_threshold"] = cte("fx_pred") + _SCORES + """,
r AS (SELECT threshold, SUM(neg) OVER (ORDER BY threshold DESC) / N AS fpr,
             SUM(pos) OVER (ORDER BY threshold DESC) / P AS tpr FROM s, t
      UNION ALL SELECT 'inf'::DOUBLE, 0.0, 0.0)
SELECT threshold, ROUND(fpr, 6) AS fpr, ROUND(tpr, 6) AS tpr, ROUND(SQRT(tpr * (1 - fpr)), 6) AS gmean
FROM r ORDER BY SQRT(tpr * (1 - fpr)) DESC, threshold DESC LIMIT 1"""


def l12_losses(spark, sf):
    l = M.losses(_pred(spark, sf), weights=(0.25, 0.75), gamma=2.0)
    return l.select(_r("log_loss"), _r("weighted_bce"), _r("focal_loss"))


Q["l12_losses"] = l12_losses
SQL["l12_losses"] = cte("fx_pred") + """,
p AS (SELECT label * 1.0 AS y, LEAST(GREATEST(score, 1e-15), 1 - 1e-15) AS q FROM fx_pred),
b AS (SELECT -(y * LN(q) + (1 - y) * LN(1 - q)) AS bce, y * 0.75 + (1 - y) * 0.25 AS w FROM p)
SELECT ROUND(AVG(bce), 6) AS log_loss, ROUND(AVG(w * bce), 6) AS weighted_bce,
       ROUND(AVG(POW(1 - EXP(-(w * bce)), 2) * w * bce), 6) AS focal_loss FROM b"""


def l13_batch_accuracy(spark, sf):
    b = M.batch_accuracy(_pred(spark, sf), "id", batch_size=32)
    return b.select(_r("batch_accuracy"), F.col("batches").cast("long").alias("batches"))


Q["l13_batch_accuracy"] = l13_batch_accuracy
SQL["l13_batch_accuracy"] = cte("fx_pred") + """,
r AS (SELECT *, ROW_NUMBER() OVER (ORDER BY id) AS rn FROM fx_pred),
b AS (SELECT FLOOR((rn - 1) / 32) AS bt, AVG(CASE WHEN label = prediction THEN 1.0 ELSE 0.0 END) AS acc
      FROM r GROUP BY bt)
SELECT ROUND(AVG(acc), 6) AS batch_accuracy, CAST(COUNT(*) AS BIGINT) AS batches FROM b"""


def l16_leaderboard(spark, sf):
    p = _pred(spark, sf)
    reps = {m: M.classification_report(p, pred=m) for m in ["prediction", "vote1", "vote2", "vote3"]}
    lb = M.leaderboard(reps)
    return lb.select("model", *[_r(c) for c in ["accuracy", "precision", "recall", "f1"]])


Q["l16_leaderboard"] = l16_leaderboard
SQL["l16_leaderboard"] = cte("fx_pred") + " UNION ALL ".join(f"""
SELECT '{m}' AS model,
  ROUND(AVG(CASE WHEN label = {m} THEN 1.0 ELSE 0.0 END), 6) AS accuracy,
  ROUND(COALESCE(SUM(CASE WHEN label = 1 AND {m} = 1 THEN 1.0 END) / NULLIF(SUM({m}), 0), 0), 6) AS precision,
  ROUND(COALESCE(SUM(CASE WHEN label = 1 AND {m} = 1 THEN 1.0 END) / NULLIF(SUM(label), 0), 0), 6) AS recall,
  ROUND(COALESCE(2.0 * SUM(CASE WHEN label = 1 AND {m} = 1 THEN 1.0 END)
                 / NULLIF(SUM({m}) + SUM(label), 0), 0), 6) AS f1
FROM fx_pred""" for m in ["prediction", "vote1", "vote2", "vote3"])


def k10_vote(spark, sf):
    v = MD.hard_vote(_pred(spark, sf), ["vote1", "vote2", "vote3"])
    v2 = MD.hard_vote(_pred(spark, sf), ["vote1", "vote2"], out="vote_2")
    return v.select("id", "vote").join(v2.select("id", "vote_2"), "id")


Q["k10_vote"] = k10_vote
SQL["k10_vote"] = cte("fx_pred") + """
SELECT id, CASE WHEN vote1 + vote2 + vote3 > 1.5 THEN 1 ELSE 0 END AS vote,
       CASE WHEN vote1 + vote2 > 1.0 THEN 1 ELSE 0 END AS vote_2 FROM fx_pred"""


def k16_mean_ensemble(spark, sf):
    e = MD.mean_ensemble(_pred(spark, sf), ["score", "vote1", "vote2"])
    return e.select("id", _r("ensemble"))


Q["k16_mean_ensemble"] = k16_mean_ensemble
SQL["k16_mean_ensemble"] = cte("fx_pred") + \
    "SELECT id, ROUND((score + vote1 + vote2) / 3.0, 6) AS ensemble FROM fx_pred"


def g10_activations(spark, sf):
    p = _pred(spark, sf)
    x = F.col("score") * 10 - 5
    sm = F.array(F.col("score"), F.col("vote1").cast("double"), F.col("vote2").cast("double"))
    e = F.transform(sm, lambda v: F.exp(v))
    tot = F.aggregate(e, F.lit(0.0), lambda a, v: a + v)
    return p.select("id", F.round(C.sigmoid(x), 6).alias("sigmoid"),
                    F.round(C.gumbel(x), 6).alias("gumbel"),
                    F.round(F.element_at(e, 1) / tot, 6).alias("softmax0"),
                    F.round(C.log_loss_term(F.col("label"), F.col("score")), 6).alias("log_loss_term"))


Q["g10_activations"] = g10_activations
SQL["g10_activations"] = cte("fx_pred") + """
SELECT id, ROUND(1 / (1 + EXP(-(score * 10 - 5))), 6) AS sigmoid,
       ROUND(EXP(-EXP(-(score * 10 - 5))), 6) AS gumbel,
       ROUND(EXP(score) / (EXP(score) + EXP(vote1) + EXP(vote2)), 6) AS softmax0,
       ROUND(-(label * LN(LEAST(GREATEST(score, 1e-15), 1 - 1e-15))
               + (1 - label) * LN(1 - LEAST(GREATEST(score, 1e-15), 1 - 1e-15))), 6) AS log_loss_term
FROM fx_pred"""


def g13_entropy(spark, sf):
    l = spark.read.parquet(f"{sf}/labels.parquet")
    a = l.agg(F.avg("quality").alias("pq"), F.avg("toxic").alias("pt"))
    return a.select(F.round(C.entropy2(F.col("pq")), 6).alias("entropy_quality"),
                    F.round(C.entropy2(F.col("pt")), 6).alias("entropy_toxic"))


Q["g13_entropy"] = g13_entropy
SQL["g13_entropy"] = """
WITH a AS (SELECT AVG(quality) AS p, AVG(toxic) AS q FROM labels)
SELECT ROUND(CASE WHEN p <= 0 OR p >= 1 THEN 0 ELSE -p * LOG2(p) - (1 - p) * LOG2(1 - p) END, 6) AS entropy_quality,
       ROUND(CASE WHEN q <= 0 OR q >= 1 THEN 0 ELSE -q * LOG2(q) - (1 - q) * LOG2(1 - q) END, 6) AS entropy_toxic
FROM a"""


def e16_class_weights(spark, sf):
    w = MD.class_weights(spark.read.parquet(f"{sf}/labels.parquet"), "quality")
    return w.select("quality", F.col("n").cast("long").alias("n"), _r("weight"), _r("ratio_to_first"))


Q["e16_class_weights"] = e16_class_weights
SQL["e16_class_weights"] = """
WITH c AS (SELECT quality, COUNT(*) AS n FROM labels GROUP BY quality)
SELECT quality, CAST(n AS BIGINT) AS n, ROUND((1.0 / n) / SUM(1.0 / n) OVER (), 6) AS weight,
       ROUND(n * 1.0 / FIRST_VALUE(n) OVER (ORDER BY quality), 6) AS ratio_to_first FROM c"""
