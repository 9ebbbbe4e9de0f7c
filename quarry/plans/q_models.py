"""Registered queries: features, clustering, models (J*, K*, L14, L15, E15)."""
from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions.columns import sigmoid
from quarry.operators import attribution as AT
from quarry.operators import boosting as BO
from quarry.operators import categories as CT
from quarry.operators import cluster as CL
from quarry.operators import features as FE
from quarry.operators import forest as FO
from quarry.operators import kernels as KN
from quarry.operators import learn as LN
from quarry.operators import profile as PR
from quarry.operators import sampling as S
from quarry.plans.fixtures import cte, fixture

Q, SQL = {}, {}
X = ["x1", "x2", "x3", "x4"]


def _num(spark, sf):
    return fixture(spark, sf, "fx_num")


def _std_sql():
    return cte("fx_num") + ", st AS (SELECT row_id, label, " + ", ".join(
        f"(x{i} - AVG(x{i}) OVER ()) / CASE WHEN STDDEV_POP(x{i}) OVER () = 0 THEN 1 "
        f"ELSE STDDEV_POP(x{i}) OVER () END AS x{i}" for i in range(1, 5)) + " FROM fx_num)"


def j3_standardize(spark, sf):
    s = FE.standardize(_num(spark, sf), X)
    return s.select("row_id", *[F.round(c, 6).alias(c) for c in X])


Q["j3_standardize"] = j3_standardize
SQL["j3_standardize"] = _std_sql() + "\nSELECT row_id, " + ", ".join(
    f"ROUND(x{i}, 6) AS x{i}" for i in range(1, 5)) + " FROM st"


def k1_logreg_gd(spark, sf, alpha=0.01, steps=3):
    s = FE.standardize(_num(spark, sf), X)
    theta = LN.logreg_gd(s, X, "label", alpha, steps)
    return spark.createDataFrame([(c, float(t)) for c, t in zip(X, theta)],
                                 "feature string, theta double").select(
        "feature", F.round("theta", 6).alias("theta"))


def _k1_sql(alpha=0.01, steps=3):
    sql = _std_sql() + ",\nt0 AS (SELECT 0.0 AS t1, 0.0 AS t2, 0.0 AS t3, 0.0 AS t4)"
    for k in range(steps):
        z = " + ".join(f"t{i} * x{i}" for i in range(1, 5))
        sql += (f",\nt{k + 1} AS (SELECT " + ", ".join(
            f"ANY_VALUE(t{i}) + {alpha} * SUM(x{i} * (label - 1 / (1 + EXP(-({z}))))) AS t{i}"
            for i in range(1, 5)) + f" FROM st, t{k})")
    return sql + "\n" + " UNION ALL ".join(
        f"SELECT 'x{i}' AS feature, ROUND(t{i}, 6) AS theta FROM t{steps}" for i in range(1, 5))


Q["k1_logreg_gd"] = k1_logreg_gd
SQL["k1_logreg_gd"] = _k1_sql()


def k1_logreg_cv(spark, sf, alphas=(0.1, 0.01, 0.001), steps=1000, folds=5):
    """The whole cross-validated fit; ``k1_logreg_gd`` is its first steps, which SQL can unroll."""
    s = S.block_folds(FE.standardize(_num(spark, sf), X), "row_id", folds)
    return LN.logreg_gd_cv(s, X, "label", "fold", alphas, steps)


Q["k1_logreg_cv"] = k1_logreg_cv


def k4_best_split(spark, sf):
    b = LN.best_splits(_num(spark, sf).withColumn("node", F.lit(1)), X, "label")
    return b.select(F.col("feature").cast("long").alias("feature"), "threshold",
                    F.round("gain_ratio", 6).alias("gain_ratio"))


Q["k4_best_split"] = k4_best_split
_H = "CASE WHEN ({p}) <= 0 OR ({p}) >= 1 THEN 0.0 ELSE -({p}) * LOG2({p}) - (1 - ({p})) * LOG2(1 - ({p})) END"
SQL["k4_best_split"] = cte("fx_num") + """,
l AS (""" + " UNION ALL ".join(f"SELECT {i} AS feature, x{i + 1} AS value, label AS y FROM fx_num"
                               for i in range(4)) + """),
c AS (SELECT feature, value, COUNT(*) AS n, SUM(y) AS pos FROM l WHERE value IS NOT NULL GROUP BY feature, value),
cu AS (SELECT feature, value, SUM(n) OVER (PARTITION BY feature ORDER BY value DESC) * 1.0 AS nl,
              SUM(pos) OVER (PARTITION BY feature ORDER BY value DESC) * 1.0 AS pl FROM c),
t AS (SELECT COUNT(*) * 1.0 AS N, SUM(label) * 1.0 AS P FROM fx_num),
g AS (SELECT feature, value,
        """ + _H.format(p="P / N") + " - nl / N * " + _H.format(p="pl / nl") + """
        - (N - nl) / N * COALESCE(""" + _H.format(p="(P - pl) / NULLIF(N - nl, 0)") + """, 0.0) AS gain,
        CASE WHEN nl = 0 OR N - nl = 0 THEN 0.0
             ELSE -(nl / N) * LOG2(nl / N) - ((N - nl) / N) * LOG2((N - nl) / N) END AS si
      FROM cu, t),
r AS (SELECT feature, value, CASE WHEN si <> 0 THEN gain / si ELSE 0.0 END AS gr FROM g)
SELECT CAST(feature AS BIGINT) AS feature, value AS threshold, ROUND(gr, 6) AS gain_ratio
FROM r ORDER BY gr DESC, feature, value LIMIT 1"""


def j2_preprocess(spark, sf):
    m = fixture(spark, sf, "fx_main")
    train = m.where(F.col("record_date") < F.lit("2022-01-01").cast("date"))
    out = FE.preprocess(m, fit_on=train, keep_index=True)
    return out.select("id", F.col("category_a_indexed").alias("category_a_idx"),
                      F.col("category_b_indexed").alias("category_b_idx"),
                      F.round("scaled_numeric_feature", 6).alias("scaled_numeric_feature"))


Q["j2_preprocess"] = j2_preprocess


def _idx_sql(c):
    return f"""
i_{c} AS (SELECT {c} AS v, (ROW_NUMBER() OVER (ORDER BY COUNT(*) DESC, {c}) - 1) * 1.0 AS idx
          FROM tr WHERE {c} IS NOT NULL GROUP BY {c}),
n_{c} AS (SELECT COUNT(*) * 1.0 AS k FROM i_{c})"""


SQL["j2_preprocess"] = cte("fx_main") + """,
tr AS (SELECT * FROM fx_main WHERE record_date < DATE '2022-01-01'),""" + _idx_sql("category_a") + "," + \
    _idx_sql("category_b") + """,
s AS (SELECT AVG(numeric_feature) AS m, STDDEV_SAMP(numeric_feature) AS sd FROM tr)
SELECT f.id, CAST(COALESCE(ia.idx, (SELECT k FROM n_category_a)) AS DOUBLE) AS category_a_idx,
       CAST(COALESCE(ib.idx, (SELECT k FROM n_category_b)) AS DOUBLE) AS category_b_idx,
       ROUND((f.numeric_feature - s.m) / s.sd, 6) AS scaled_numeric_feature
FROM fx_main f LEFT JOIN i_category_a ia ON ia.v = f.category_a
LEFT JOIN i_category_b ib ON ib.v = f.category_b, s"""


def j1_one_hot(spark, sf):
    """Levels by frequency learned on the training rows, sparse rows of all; no level list on the driver."""
    m = fixture(spark, sf, "fx_main")
    cols = ["category_a", "category_b"]
    table = CT.level_table(m.where(F.col("record_date") < F.lit("2022-01-01").cast("date")), cols, by="frequency")
    return CT.one_hot(m, cols, table).select("id", F.col("one_hot.size").alias("width"),
                                             F.array_join("one_hot.indices", ",").alias("indices"))


Q["j1_one_hot"] = j1_one_hot
SQL["j1_one_hot"] = cte("fx_main") + """,
tr AS (SELECT * FROM fx_main WHERE record_date < DATE '2022-01-01'),
a AS (SELECT category_a AS v, ROW_NUMBER() OVER (ORDER BY COUNT(*) DESC, category_a) - 1 AS i FROM tr WHERE category_a IS NOT NULL GROUP BY 1),
b AS (SELECT category_b AS v, ROW_NUMBER() OVER (ORDER BY COUNT(*) DESC, category_b) - 1 AS i FROM tr WHERE category_b IS NOT NULL GROUP BY 1),
n AS (SELECT (SELECT COUNT(*) FROM a) AS na, (SELECT COUNT(*) FROM b) AS nb)
SELECT id, na + nb AS width, CONCAT_WS(',', a.i, b.i + na) AS indices
FROM fx_main LEFT JOIN a ON a.v = category_a LEFT JOIN b ON b.v = category_b, n"""


def _vec(spark, sf):
    return fixture(spark, sf, "fx_vec")


def j13_assign(spark, sf):
    v = _vec(spark, sf)
    cen = CL.centroids(v, "embedding", "label").orderBy("label").collect()  # k rows of model state
    a = CL.assign(v, "embedding", [r["centroid"] for r in cen], out="cluster")
    labels = [r["label"] for r in cen]
    m = F.create_map(*[x for i, l in enumerate(labels) for x in (F.lit(i), F.lit(l))])
    return a.select("vec_id", F.element_at(m, F.col("cluster")).cast("long").alias("cluster"))


Q["j13_assign"] = j13_assign
SQL["j13_assign"] = cte("fx_vec") + """,
v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM fx_vec),
lv AS (SELECT label, unnest(e) AS x, generate_subscripts(e, 1) AS pos FROM v),
c AS (SELECT label, list(m ORDER BY pos) AS ce FROM (SELECT label, pos, AVG(x) AS m FROM lv GROUP BY label, pos) GROUP BY label),
d AS (SELECT v.vec_id, c.label AS cluster,
             ROW_NUMBER() OVER (PARTITION BY v.vec_id ORDER BY list_distance(v.e, c.ce), c.label) AS rk
      FROM v, c)
SELECT vec_id, CAST(cluster AS BIGINT) AS cluster FROM d WHERE rk = 1"""


def l14_silhouette(spark, sf):
    s = CL.silhouette(_vec(spark, sf), "vec_id", "embedding", "label")
    return s.select(F.round("silhouette", 6).alias("silhouette"))


Q["l14_silhouette"] = l14_silhouette
SQL["l14_silhouette"] = cte("fx_vec") + """,
v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM fx_vec),
p AS (SELECT a.vec_id, a.label AS qc, b.label AS bc, AVG(list_distance(a.e, b.e)) AS md, COUNT(*) AS n
      FROM v a JOIN v b ON a.vec_id <> b.vec_id GROUP BY a.vec_id, a.label, b.label),
pt AS (SELECT vec_id, MAX(CASE WHEN qc = bc THEN md END) AS a, MIN(CASE WHEN qc <> bc THEN md END) AS b,
              MAX(CASE WHEN qc = bc THEN n END) AS n_own FROM p GROUP BY vec_id),
s AS (SELECT CASE WHEN COALESCE(n_own, 0) = 0 THEN 0.0 ELSE (b - a) / GREATEST(a, b) END AS s FROM pt)
SELECT ROUND(AVG(s), 6) AS silhouette FROM s"""


def l15_centroid_scores(spark, sf):
    s = CL.centroid_scores(_vec(spark, sf), "embedding", "label")
    return s.select(*[F.round(c, 4).alias(c) for c in s.columns])


Q["l15_centroid_scores"] = l15_centroid_scores
SQL["l15_centroid_scores"] = cte("fx_vec") + """,
v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM fx_vec),
lv AS (SELECT label, unnest(e) AS x, generate_subscripts(e, 1) AS pos FROM v),
c AS (SELECT label, COUNT(*) AS n, list(m ORDER BY pos) AS ce FROM (SELECT label, pos, AVG(x) AS m, COUNT(*) AS cnt FROM lv GROUP BY label, pos)
      GROUP BY label),
cn AS (SELECT c.label, (SELECT COUNT(*) FROM v WHERE v.label = c.label) AS n, c.ce FROM c),
g AS (SELECT pos, SUM(x) / (SELECT COUNT(*) FROM v) AS gm FROM (SELECT unnest(e) AS x, generate_subscripts(e, 1) AS pos FROM v) GROUP BY pos),
gm AS (SELECT list(gm ORDER BY pos) AS g FROM g),
pd AS (SELECT v.label, list_distance(v.e, cn.ce) AS d FROM v JOIN cn USING (label)),
sp AS (SELECT label, AVG(d) AS s, SUM(d * d) AS ss FROM pd GROUP BY label),
cc AS (SELECT a.label AS i, MAX(CASE WHEN list_distance(a.ce, b.ce) = 0 THEN 0
                              ELSE (sa.s + sb.s) / list_distance(a.ce, b.ce) END) AS r
       FROM cn a JOIN cn b ON a.label <> b.label JOIN sp sa ON sa.label = a.label JOIN sp sb ON sb.label = b.label
       GROUP BY a.label),
tot AS (SELECT SUM(ss) AS w FROM sp),
ex AS (SELECT SUM(cn.n * list_distance(cn.ce, gm.g) ^ 2) AS b FROM cn, gm)
SELECT ROUND((SELECT w FROM tot), 4) AS inertia, ROUND((SELECT AVG(r) FROM cc), 4) AS davies_bouldin,
       ROUND((SELECT b FROM ex) * ((SELECT COUNT(*) FROM v) - (SELECT COUNT(*) FROM cn))
             / ((SELECT w FROM tot) * ((SELECT COUNT(*) FROM cn) - 1)), 4) AS calinski_harabasz"""


def e15_cluster_profile(spark, sf):
    f = PR.five_numbers(_num(spark, sf), ["x1", "x3"], by="label")
    return f.select("label", "column", *[F.round(c, 6).alias(c) for c in ["min", "q1", "median", "q3", "max"]])


Q["e15_cluster_profile"] = e15_cluster_profile
SQL["e15_cluster_profile"] = cte("fx_num") + " UNION ALL ".join(f"""
SELECT label, '{c}' AS "column", ROUND(MIN({c}), 6) AS min, ROUND(QUANTILE_CONT({c}, 0.25), 6) AS q1,
       ROUND(QUANTILE_CONT({c}, 0.5), 6) AS median, ROUND(QUANTILE_CONT({c}, 0.75), 6) AS q3,
       ROUND(MAX({c}), 6) AS max FROM fx_num GROUP BY label""" for c in ["x1", "x3"])


def j7_covariance(spark, sf):
    s = FE.standardize(_num(spark, sf), X)
    aggs = [F.covar_samp(a, b).alias(f"{a}_{b}") for a in X for b in X]
    row = s.agg(*aggs)
    pairs = ", ".join(f"'{a}', '{b}', `{a}_{b}`" for a in X for b in X)
    return row.selectExpr(f"stack({len(X) ** 2}, {pairs}) AS (col_a, col_b, cov)").select(
        "col_a", "col_b", F.round("cov", 6).alias("cov"))


Q["j7_covariance"] = j7_covariance
SQL["j7_covariance"] = _std_sql() + "\n" + " UNION ALL ".join(
    f"SELECT '{a}' AS col_a, '{b}' AS col_b, ROUND(COVAR_SAMP({a}, {b}), 6) AS cov FROM st"
    for a in X for b in X)


# ------------------------------------------------- fitted models (rows-only)
def j7_pca_curve(spark, sf):
    v = _vec(spark, sf)
    _, curve = FE.pca_curve(v, "embedding", 10, standardize_first=True)
    return curve


def j7_pca_components(spark, sf):
    s = FE.standardize(_num(spark, sf), X)
    model, _ = FE.pca_curve(s.select(F.array(*X).alias("v")), "v", 2)
    return FE.pca_components(model, X, spark)


Q["j7_pca_components"] = j7_pca_components


def l14_silhouette_fast(spark, sf):
    return CL.silhouette(_vec(spark, sf), "vec_id", "embedding", "label", fast=True)


Q["l14_silhouette_fast"] = l14_silhouette_fast


Q["j7_pca_curve"] = j7_pca_curve


def j13_kmeans(spark, sf):
    _, a, _ = CL.kmeans(_vec(spark, sf), "embedding", 7, seed=123)
    return a.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))


Q["j13_kmeans"] = j13_kmeans


def j13_sweep(spark, sf):
    """k from 1 to 10: inertia, silhouette and centroid scores of every k."""
    v = _vec(spark, sf).select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    return CL.kmeans_sweep(v, "vec_id", "embedding", range(1, 11))[0]


Q["j13_sweep"] = j13_sweep


def _split(spark, sf):
    s = FE.standardize(_num(spark, sf), X)
    return S.holdout(s, "row_id", 0.3)


def _fit_report(est_kind, **params):
    def q(spark, sf):
        from quarry.operators import metrics as M
        d = LN.assemble(_split(spark, sf), X).withColumn("label", F.col("label").cast("double"))
        train = d.where("is_test = 0").select("features", "label").persist()        # what the fit reads, once
        m = LN.estimator(est_kind, **params).fit(train)
        train.unpersist()
        p = m.transform(d.where("is_test = 1")).withColumn("prediction", F.col("prediction").cast("int"))
        return M.classification_report(p, "label", "prediction")
    return q


def k2_logreg(spark, sf):
    from quarry.operators import metrics as M
    d = LN.assemble(_split(spark, sf), X).withColumn("label", F.col("label").cast("double"))
    train = d.where("is_test = 0").persist()
    m = LN.sklearn_style_logreg(train.count(), C=1.0, max_iter=100).fit(train)
    train.unpersist()
    p = m.transform(d.where("is_test = 1")).withColumn("prediction", F.col("prediction").cast("int"))
    return M.classification_report(p, "label", "prediction")


Q["k2_logreg"] = k2_logreg


def _report_of(p):
    from quarry.operators import metrics as M
    return M.classification_report(p.withColumn("prediction", (F.col("p") > 0.5).cast("int")), "label", "prediction")


def k5_forest(spark, sf, trees=100):
    """Trees grown to purity on exact thresholds, two of four features a node."""
    d = _split(spark, sf).persist()
    m = FO.fit(d.where("is_test = 0"), X, "label", "row_id", [FO.Spec(trees, max_features=2)])
    return _report_of(m.predict(d.where("is_test = 1"), "row_id", ["p"]))


def k5_importances(spark, sf, trees=100):
    m = FO.fit(_num(spark, sf), X, "label", "row_id", [FO.Spec(trees, max_features=2)])
    names = F.array(*map(F.lit, X))
    return m.importances().select(F.element_at(names, F.col("feature") + 1).alias("feature"), F.round("importance", 6).alias("importance"))


def k6_gbt(spark, sf, rounds=100):
    d = _split(spark, sf).persist()
    m = BO.fit(d.where("is_test = 0"), X, "label", "row_id", [BO.Spec(rounds, 0.1, 3)])
    return _report_of(m.predict(d.where("is_test = 1"), ["p"]))


Q["k5_forest"] = k5_forest
Q["k5_importances"] = k5_importances
Q["k6_gbt"] = k6_gbt
Q["k8_mlp"] = _fit_report("mlp", layers=[4, 12, 8, 2], maxIter=500)


def k9_svm_rff(spark, sf):
    from quarry.operators import metrics as M
    d = LN.random_fourier(LN.dealt(_split(spark, sf), ["row_id", *X], 100), X, n_components=100, gamma=0.5)
    d = LN.assemble(d, [f"rff_{i}" for i in range(100)]).withColumn("label", F.col("label").cast("double"))
    # the fit keeps blocks of the features itself: a second copy, or columns beside the vector, would be kept for nothing
    m = LN.estimator("svm", regParam=0.01).fit(d.where("is_test = 0").select("features", "label"))
    p = m.transform(d.where("is_test = 1")).withColumn("prediction", F.col("prediction").cast("int"))
    return M.classification_report(p, "label", "prediction")


Q["k9_svm_rff"] = k9_svm_rff


def k9_kernels(spark, sf):
    """Exact kernel values of every row against two given points."""
    s = FE.standardize(_num(spark, sf), X)
    return s.select("row_id", *[F.round(KN.kernel_value(X, p, kind, 0.25, coef0=0.5), 6).alias(f"{kind}_{i}")
                                for i, p in enumerate(KERNEL_POINTS) for kind in ("rbf", "poly", "sigmoid")])


KERNEL_POINTS = [(0.5, -0.5, 1.0, 0.0), (-1.0, 0.25, 0.0, 0.75)]


def _kernels_sql():
    cols = []
    for i, p in enumerate(KERNEL_POINTS):
        inner = "(0.25E0 * (" + " + ".join(f"{x} * {v}E0" for x, v in zip(X, p)) + ") + 0.5E0)"
        gap = " + ".join(f"POW({x} - ({v}E0), 2)" for x, v in zip(X, p))
        cols += [f"ROUND(EXP(-0.25E0 * ({gap})), 6) AS rbf_{i}", f"ROUND(POW({inner}, 3), 6) AS poly_{i}",
                 f"ROUND(TANH({inner}), 6) AS sigmoid_{i}"]
    return _std_sql() + "\nSELECT row_id, " + ", ".join(cols) + " FROM st"


def k9_kernel_grid(spark, sf):
    """75 cells: three kernels, five widths, five costs; 5 folds."""
    return KN.kernel_grid(_folds(spark, sf), X, "label", "row_id", "fold")


Q["k9_kernels"] = k9_kernels
SQL["k9_kernels"] = _kernels_sql()
Q["k9_kernel_grid"] = k9_kernel_grid


TREE = ["node", "depth", "feature", "threshold", "n", "pos", "value", "yes", "no"]


def k4_tree(spark, sf):
    return LN.build_tree(_num(spark, sf), X, "label").select(*TREE)     # grown to purity


def k4_tree_depth3(spark, sf):
    return LN.build_tree(_num(spark, sf), X, "label", max_depth=3).select(*TREE)


def _tree_sql(depths=3):
    """The tree's levels unrolled: rows, splits and nodes of each depth."""
    sql = cte("fx_num") + ",\nr0 AS (SELECT CAST(1 AS BIGINT) AS node, x1, x2, x3, x4, label FROM fx_num),\nm0 AS (SELECT 1 AS made)"
    for d in range(depths):
        long = " UNION ALL ".join(f"SELECT node, {i} AS feature, x{i + 1} AS value, label AS y FROM r{d}" for i in range(4))
        sql += f""",
c{d} AS (SELECT node, feature, value, COUNT(*) AS n, SUM(y) AS pos FROM ({long}) WHERE value IS NOT NULL GROUP BY ALL),
u{d} AS (SELECT node, feature, value, SUM(n) OVER w * 1.0E0 AS nl, SUM(pos) OVER w * 1.0E0 AS pl,
              SUM(n) OVER (PARTITION BY node, feature) * 1.0E0 AS N, SUM(pos) OVER (PARTITION BY node, feature) * 1.0E0 AS P
       FROM c{d} WINDOW w AS (PARTITION BY node, feature ORDER BY value DESC)),
g{d} AS (SELECT node, feature, value, {_H.format(p="P / N")} - nl / N * {_H.format(p="pl / nl")}
              - (N - nl) / N * COALESCE({_H.format(p="(P - pl) / NULLIF(N - nl, 0)")}, 0.0) AS gain,
              CASE WHEN nl = N THEN 0.0 ELSE -(nl / N) * LOG2(nl / N) - ((N - nl) / N) * LOG2((N - nl) / N) END AS si FROM u{d}),
q{d} AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY node ORDER BY gr DESC, feature, value) AS rk
       FROM (SELECT *, CASE WHEN si <> 0 THEN gain / si ELSE 0.0 END AS gr FROM g{d})),
s{d} AS (SELECT node, feature, value AS threshold, made - 1 + 2 * ROW_NUMBER() OVER (ORDER BY node) AS yes
       FROM q{d}, m{d} WHERE rk = 1 AND gr > 0),
m{d + 1} AS (SELECT made + 2 * (SELECT COUNT(*) FROM s{d}) AS made FROM m{d}),
r{d + 1} AS (SELECT CASE WHEN [x1, x2, x3, x4][feature + 1] >= threshold THEN yes ELSE yes + 1 END AS node, x1, x2, x3, x4, label
       FROM r{d} JOIN s{d} USING (node))"""
    empty = "(SELECT CAST(NULL AS BIGINT) AS node, NULL AS feature, NULL AS threshold, NULL AS yes WHERE FALSE)"
    return sql + "\n" + " UNION ALL ".join(
        f"""SELECT node, {d} AS depth, CAST(feature AS INTEGER) AS feature, CAST(threshold AS DOUBLE) AS threshold, COUNT(*) AS n,
       CAST(SUM(label) AS BIGINT) AS pos, CASE WHEN 2 * SUM(label) >= COUNT(*) THEN 1 ELSE 0 END AS value,
       CAST(yes AS BIGINT) AS yes, CAST(yes + 1 AS BIGINT) AS no
FROM r{d} LEFT JOIN {f's{d}' if d < depths else empty} USING (node) GROUP BY node, feature, threshold, yes"""
        for d in range(depths + 1))


Q["k4_tree"] = k4_tree
Q["k4_tree_depth3"] = k4_tree_depth3
SQL["k4_tree_depth3"] = _tree_sql()


def k7_adaboost(spark, sf):
    from quarry.operators import metrics as M
    d = _split(spark, sf)
    stages = LN.adaboost(d.where("is_test = 0"), X, "label", n_estimators=50)
    p = LN.adaboost_predict(d.where("is_test = 1"), X, stages)
    return M.classification_report(p, "label", "prediction")


Q["k7_adaboost"] = k7_adaboost


def stacking_base(trees=500, rounds=500, epochs=500):
    """The reference's six base models: a forest, three boosters of different depth, kernel classifier, network."""
    return {"rf": FO.Spec(trees, max_features=2), **{f"gbt{k}": BO.Spec(rounds, 0.05, k) for k in (3, 5, 7)},
            "svm": LN.rff_svm(X, regParam=0.01), "nn": LN.estimator("mlp", layers=[4, 12, 8, 2], maxIter=epochs)}


def k11_stacking(spark, sf, folds=5, **sizes):
    d = S.kfold(_split(spark, sf), "row_id", folds, by="label").persist()
    stack = LN.stacking(d.where("is_test = 0"), X, "label", "row_id", "fold", stacking_base(**sizes))
    return _report_of(stack.predict(d.where("is_test = 1")).withColumnRenamed("probability", "p"))


Q["k11_stacking"] = k11_stacking


def _folds(spark, sf):
    """Training rows with five stratified folds."""
    return S.kfold(_split(spark, sf), "row_id", 5, by="label").where("is_test = 0")


def k12_grid_search(spark, sf, rounds=(100, 200, 300, 400, 500), rates=(0.01, 0.05, 0.1, 0.2, 0.3), depths=range(3, 11)):
    """200 cells of a boosted model, five folds each."""
    return BO.grid_search(_folds(spark, sf), X, "label", "row_id", "fold", list(rounds), list(rates), list(depths))


def k12_grid_subsample(spark, sf, rounds=(100, 300, 500), rates=(0.01, 0.05, 0.1), depths=(3, 5, 7), subsamples=(0.7, 1.0)):
    """54 cells with row sampling."""
    return BO.grid_search(_folds(spark, sf), X, "label", "row_id", "fold", list(rounds), list(rates), list(depths), list(subsamples))


def k12_grid_forest(spark, sf, trees=(100, 300, 500)):
    """72 cells of a forest."""
    grid = {"trees": list(trees), "max_depth": [None, 10, 20], "min_split": [2, 5], "min_leaf": [1, 2], "bootstrap": [True, False], "max_features": [2]}
    return FO.search(_folds(spark, sf), X, "label", "row_id", "fold", grid)


def k13_random_search(spark, sf, trees=range(100, 1001, 100), n_iter=100):
    """100 cells of a forest drawn from 3,960; two of its values name the same number of features."""
    grid = {"trees": list(trees), "max_features": [2, 2], "max_depth": [*range(10, 101, 10), None], "min_split": [2, 5, 10],
            "min_leaf": [1, 2, 4], "bootstrap": [True, False]}
    return FO.search(_folds(spark, sf), X, "label", "row_id", "fold", grid, n_iter)


Q["k12_grid_search"] = k12_grid_search
Q["k12_grid_subsample"] = k12_grid_subsample
Q["k12_grid_forest"] = k12_grid_forest
Q["k13_random_search"] = k13_random_search


def k19_permutation(spark, sf):
    d = _split(spark, sf)
    train = d.where("is_test = 0")
    theta = LN.logreg_gd(train, X, "label", 0.001, 1000)
    return LN.permutation_importance(d.where("is_test = 1"), "row_id", X, "label",
                                     lambda df: LN.logreg_predict(df, X, theta))


Q["k19_permutation"] = k19_permutation


def k19_shapley(spark, sf, steps=1000, base=32):
    """Attributions of the fitted model's probability, per held-out row."""
    d = _split(spark, sf)
    train = d.where("is_test = 0")
    theta = LN.logreg_gd(train, X, "label", 0.001, steps)
    score = sigmoid(LN._dot(theta, X))
    return AT.shapley(d.where("is_test = 1"), "row_id", X, score, AT.background(train, "row_id", X, base))


Q["k19_shapley"] = k19_shapley

#: A given scorer with an interaction, so that SQL can list all coalitions.
_HASH = "('0x' || substr(md5('background' || row_id::VARCHAR), 1, 8))::BIGINT"
GIVEN = "1 / (1 + EXP(-(0.5 * x1 - 0.25 * x2 + 0.75 * x3 * x4)))"


def k19_shapley_given(spark, sf, base=4):
    d = FE.standardize(_num(spark, sf), X).dropna(subset=X)
    found = AT.shapley(d, "row_id", X, F.expr(GIVEN), AT.background(d, "row_id", X, base))
    return found.select("row_id", *[F.round(c, 6).alias(c) for c in found.columns[1:]])


def _shapley_sql(base=4):
    """All 16 coalitions, and the attributions by the formula over coalitions without the feature."""
    bit = lambda i: f"(m.s >> {i - 1}) & 1"
    mixed = ", ".join(f"CASE WHEN {bit(i)} = 1 THEN d.x{i} ELSE b.x{i} END AS x{i}" for i in range(1, 5))
    phi = ", ".join(
        "ROUND(SUM(v * CASE bit_count(s) " + " ".join(
            f"WHEN {k} THEN CASE WHEN (s >> {i - 1}) & 1 = 1 THEN {1 / (4 * (1, 1, 3, 3, 1)[k]) if k else 0.0} "
            f"ELSE {-1 / (4 * (1, 3, 3, 1, 1)[k]) if k < 4 else 0.0} END" for k in range(5))
        + f" END), 6) AS phi_x{i}" for i in range(1, 5))
    return _std_sql() + f""",
d AS (SELECT * FROM st WHERE x1 IS NOT NULL AND x2 IS NOT NULL AND x3 IS NOT NULL AND x4 IS NOT NULL),
b AS (SELECT x1, x2, x3, x4 FROM d ORDER BY {_HASH}, row_id LIMIT {base}),
m AS (SELECT CAST(UNNEST(range(16)) AS INTEGER) AS s),
met AS (SELECT d.row_id, m.s, {mixed} FROM d, b, m),
vals AS (SELECT row_id, s, AVG({GIVEN}) AS v FROM met GROUP BY row_id, s)
SELECT row_id, ROUND(SUM(CASE WHEN s = 0 THEN v END), 6) AS base, ROUND(SUM(CASE WHEN s = 15 THEN v END), 6) AS prediction, {phi}
FROM vals GROUP BY row_id"""


Q["k19_shapley_given"] = k19_shapley_given
SQL["k19_shapley_given"] = _shapley_sql()


def j6_rfe(spark, sf):
    kept, dropped = FE.rfe(_num(spark, sf), X, "label", 2, "row_id", num_trees=100)
    rows = [(f, 1, None) for f in kept] + [(f, 0, i + 1) for i, f in enumerate(dropped)]
    return spark.createDataFrame(rows, "feature string, kept int, dropped_round int")


Q["j6_rfe"] = j6_rfe


def k14_text_scoring(spark, sf):
    from quarry.operators import text as T
    d = T.preprocess(fixture(spark, sf, "fx_rev"), "content", "tokens")
    model = LN.text_classifier(d, "tokens", "quality", max_iter=50)
    return LN.score_texts(model, d, "doc_id")


Q["k14_text_scoring"] = k14_text_scoring
