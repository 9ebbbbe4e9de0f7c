"""Registered queries: nearest neighbours, graphs, SMOTE."""
from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions import columns as C
from quarry.operators import neighbors as N
from quarry.operators import sampling as S
from quarry.plans.fixtures import cte, fixture

Q, SQL = {}, {}


def _vec(spark, sf):
    return fixture(spark, sf, "fx_vec")


def _h(expr, salt):
    return f"('0x' || substr(md5('{salt}' || CAST({expr} AS VARCHAR)), 1, 8))::BIGINT"


_V = cte("fx_vec") + """,
v AS (SELECT vec_id, embedding::DOUBLE[] AS e, label, minority FROM fx_vec)"""


def _knn_sql(k, src="v", dst="v", cond="a.vec_id <> b.vec_id"):
    return f"""
SELECT src, dst, dist, rank FROM (
  SELECT a.vec_id AS src, b.vec_id AS dst, list_distance(a.e, b.e) AS dist,
         ROW_NUMBER() OVER (PARTITION BY a.vec_id ORDER BY list_distance(a.e, b.e), b.vec_id) AS rank
  FROM {src} a JOIN {dst} b ON {cond}) WHERE rank <= {k}"""


#: The reference's graph has 100 neighbours a node; the queries without this ending are its first 5.
K_ALL = 100


def d8_knn_graph(spark, sf, k=5):
    g = N.knn(_vec(spark, sf), None, k, "vec_id", "embedding")
    return g.select("src", "dst", F.round("dist", 6).alias("dist"), F.col("rank").cast("long").alias("rank"))


Q["d8_knn_graph"] = d8_knn_graph


def _d8_sql(k):
    return _V + ", g AS (" + _knn_sql(k) + """)
SELECT src, dst, ROUND(dist, 6) AS dist, CAST(rank AS BIGINT) AS rank FROM g"""


SQL["d8_knn_graph"] = _d8_sql(5)


def d7_nearest(spark, sf):
    v = _vec(spark, sf)
    g = N.knn(v.where("minority = 1"), v.where("minority = 0"), 1, "vec_id", "embedding")
    return g.select("src", "dst", F.round("dist", 6).alias("dist"))


Q["d7_nearest"] = d7_nearest
SQL["d7_nearest"] = _V + """,
mi AS (SELECT * FROM v WHERE minority = 1), ma AS (SELECT * FROM v WHERE minority = 0),
g AS (""" + _knn_sql(1, "mi", "ma", "TRUE") + """)
SELECT src, dst, ROUND(dist, 6) AS dist FROM g"""


def k3_1nn_predict(spark, sf):
    v = _vec(spark, sf)
    p = N.nearest_label(v, None, "vec_id", "embedding", "label")
    return p.join(v.select("vec_id", "label"), "vec_id").select(
        "vec_id", "predicted", C.binary_by(F.col("predicted") == F.col("label")).alias("correct"))


Q["k3_1nn_predict"] = k3_1nn_predict
SQL["k3_1nn_predict"] = _V + ", g AS (" + _knn_sql(1) + """)
SELECT g.src AS vec_id, b.label AS predicted, CASE WHEN b.label = a.label THEN 1 ELSE 0 END AS correct
FROM g JOIN v a ON a.vec_id = g.src JOIN v b ON b.vec_id = g.dst"""


def k3_grid(spark, sf):
    """The class of each of 41 × 41 points between -2 and 2 by the nearest row's first two components."""
    v = _vec(spark, sf).select(F.col("vec_id").alias("point"), F.slice(F.col("embedding").cast("array<double>"), 1, 2).alias("xy"), "label")
    return N.nearest_label(N.grid_points(spark, -2.0, 0.1, 41), v, "point", "xy", "label", exclude_self=False).select(
        "point", F.col("dst").alias("vec_id"), "predicted")


Q["k3_grid"] = k3_grid
SQL["k3_grid"] = _V + """,
p AS (SELECT range AS point, [CAST(-2.0 AS DOUBLE) + (range % 41) * CAST(0.1 AS DOUBLE), CAST(-2.0 AS DOUBLE) + (range // 41) * CAST(0.1 AS DOUBLE)] AS xy
      FROM range(1681))
SELECT point, vec_id, label AS predicted FROM (
  SELECT p.point, v.vec_id, v.label, ROW_NUMBER() OVER (PARTITION BY p.point ORDER BY list_distance(p.xy, v.e[1:2]), v.vec_id) AS r FROM p, v)
WHERE r = 1"""


def k3_folds(spark, sf):
    v = S.block_folds(_vec(spark, sf), "vec_id", 5)
    return N.fold_accuracy(v, "vec_id", "embedding", "label", "fold").select("fold", "n", F.round("accuracy", 6).alias("accuracy"))


Q["k3_folds"] = k3_folds
SQL["k3_folds"] = _V + """,
f AS (SELECT *, CAST(FLOOR((ROW_NUMBER() OVER (ORDER BY vec_id) - 1) * 5 / COUNT(*) OVER ()) AS INTEGER) AS fold FROM v),
n AS (SELECT a.fold, a.label = b.label AS hit, ROW_NUMBER() OVER (PARTITION BY a.vec_id ORDER BY list_distance(a.e, b.e), b.vec_id) AS r
      FROM f a JOIN f b ON a.fold <> b.fold)
SELECT fold, COUNT(*) AS n, ROUND(AVG(CASE WHEN hit THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM n WHERE r = 1 GROUP BY fold"""


def g11_distances(spark, sf, k=5):
    v = _vec(spark, sf)
    g = N.knn(v, None, k, "vec_id", "embedding")
    a = v.select(F.col("vec_id").alias("src"), F.col("embedding").alias("a"))
    b = v.select(F.col("vec_id").alias("dst"), F.col("embedding").alias("b"))
    wide = [F.col(c).cast("array<double>").alias(c) for c in ("a", "b")]      # after the joins: floats move
    p = g.select("src", "dst").join(a, "src").join(b, "dst").select("src", "dst", *wide)
    return p.select("src", "dst", F.round(C.euclidean("a", "b"), 6).alias("euclid"),
                    F.round(C.sq_euclidean("a", "b") / F.size("a"), 6).alias("mse"),
                    F.round(C.cosine_sim("a", "b"), 6).alias("cos_sim"))


Q["g11_distances"] = g11_distances


def _g11_sql(k):
    return _V + ", g AS (" + _knn_sql(k) + """)
SELECT g.src, g.dst, ROUND(list_distance(a.e, b.e), 6) AS euclid,
       ROUND(list_distance(a.e, b.e) ^ 2 / len(a.e), 6) AS mse,
       ROUND(list_dot_product(a.e, b.e) / (SQRT(list_dot_product(a.e, a.e)) * SQRT(list_dot_product(b.e, b.e)) + 1e-8), 6) AS cos_sim
FROM g JOIN v a ON a.vec_id = g.src JOIN v b ON b.vec_id = g.dst"""


SQL["g11_distances"] = _g11_sql(5)


def _agg_q(how, k=5):
    def q(spark, sf):
        v = _vec(spark, sf)
        g = N.knn(v, None, k, "vec_id", "embedding")
        a = N.aggregate_neighbors(v, g, "vec_id", "embedding", how)
        return a.select("vec_id", F.posexplode("agg").alias("pos", "agg"))
    return q


def _agg_sql(how, k=5):
    base = _V + ", g AS (" + _knn_sql(k) + """),
lv AS (SELECT vec_id AS node, unnest(e) AS x, generate_subscripts(e, 1) AS pos FROM v)"""
    if how == "gcn":
        base += """,
e AS (SELECT src, dst FROM g UNION ALL SELECT vec_id, vec_id FROM v),
deg AS (SELECT dst, COUNT(*) AS d FROM e GROUP BY dst),
ew AS (SELECT e.src, e.dst, 1.0 / SQRT(ds.d * dd.d) AS w FROM e JOIN deg ds ON ds.dst = e.src
       JOIN deg dd ON dd.dst = e.dst)"""
    else:
        base += ", ew AS (SELECT src, dst, 1.0 AS w FROM g)"
    agg = "AVG(x * w)" if how == "mean" else "SUM(x * w)"
    return base + f""",
per AS (SELECT ew.dst, lv.pos, {agg} AS val FROM ew JOIN lv ON lv.node = ew.src GROUP BY ew.dst, lv.pos)
SELECT dst AS vec_id, CAST(pos - 1 AS INTEGER) AS pos, val AS agg FROM per"""


for _how in ["mean", "sum", "gcn"]:
    Q[f"k17_neighbor_{_how}"] = _agg_q(_how)
    SQL[f"k17_neighbor_{_how}"] = _agg_sql(_how)


def k18_drop_edges(spark, sf, k=5):
    v = _vec(spark, sf)
    g = N.knn(v, None, k, "vec_id", "embedding")
    return N.drop_edges(g, 0.2)


Q["k18_drop_edges"] = k18_drop_edges


def _k18_sql(k):
    return _V + ", g AS (" + _knn_sql(k) + """),
u AS (SELECT DISTINCT src AS a, dst AS b FROM g WHERE src < dst),
k AS (SELECT a, b FROM u WHERE ('0x' || substr(md5('drop' || CAST(a AS VARCHAR) || '-' || CAST(b AS VARCHAR)), 1, 8))::BIGINT
                              / 4294967296.0 >= 0.2)
SELECT a AS src, b AS dst FROM k UNION ALL SELECT b, a FROM k"""


SQL["k18_drop_edges"] = _k18_sql(5)


def _with_k(q, k):
    return lambda spark, sf: q(spark, sf, k)


for _name, _q, _sql in [("d8_knn_graph", d8_knn_graph, _d8_sql), ("g11_distances", g11_distances, _g11_sql),
                        ("k18_drop_edges", k18_drop_edges, _k18_sql)]:
    Q[f"{_name}_{K_ALL}"] = _with_k(_q, K_ALL)
    SQL[f"{_name}_{K_ALL}"] = _sql(K_ALL)
for _how in ["mean", "sum", "gcn"]:
    Q[f"k17_neighbor_{_how}_{K_ALL}"] = _agg_q(_how, K_ALL)
    SQL[f"k17_neighbor_{_how}_{K_ALL}"] = _agg_sql(_how, K_ALL)


def h6_smote(spark, sf):
    v = _vec(spark, sf).select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"), "minority")
    s = N.smote(v, "vec_id", "embedding", "minority", 1, ratio=0.5, k=5)
    return s.select("vec_id", F.posexplode("embedding").alias("pos", "value"), "minority", "synthetic")


Q["h6_smote"] = h6_smote
SQL["h6_smote"] = _V + f""",
m AS (SELECT * FROM v WHERE minority = 1),
cnt AS (SELECT (SELECT COUNT(*) FROM m) AS n_min, (SELECT COUNT(*) FROM v WHERE minority <> 1) AS n_maj,
               (SELECT MAX(vec_id) FROM v) AS mx),
nb AS ({_knn_sql(5, "m", "m")}),
rk AS (SELECT vec_id, e, ROW_NUMBER() OVER (ORDER BY {_h('vec_id', 'smote')}, vec_id) AS r FROM m),
j AS (SELECT range AS j FROM range((SELECT CAST(FLOOR(0.5 * n_maj - n_min) AS BIGINT) FROM cnt))),
js AS (SELECT j, j % (SELECT n_min FROM cnt) + 1 AS r, {_h('j', 'smotenb')} % 5 + 1 AS rank,
              {_h('j', 'smoteu')} / 4294967296.0 AS u FROM j),
syn AS (SELECT (SELECT mx FROM cnt) + 1 + js.j AS vec_id,
               list_transform(list_zip(rk.e, y.e), lambda t: t[1] + u * (t[2] - t[1])) AS e
        FROM js JOIN rk ON rk.r = js.r JOIN nb ON nb.src = rk.vec_id AND nb.rank = js.rank
        JOIN m y ON y.vec_id = nb.dst)
SELECT vec_id, CAST(generate_subscripts(e, 1) - 1 AS INTEGER) AS pos, unnest(e) AS value, minority, 0 AS synthetic FROM v
UNION ALL
SELECT vec_id, CAST(generate_subscripts(e, 1) - 1 AS INTEGER), unnest(e), 1, 1 FROM syn"""
