"""Feature transforms.

Fitting returns small state (means, deviations, label orders, components)
computed by one distributed aggregate; applying it is a lazy projection.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.columns import vec_item


def standardize(df: DataFrame, cols, fit_on: DataFrame | None = None, ddof: int = 0,
                suffix: str = "") -> DataFrame:
    """(x − mean)/std with statistics from ``fit_on`` (default df).  ``ddof=0``
    is the population deviation (the reference's scaler); a zero deviation
    divides by 1 instead (J3)."""
    src = fit_on if fit_on is not None else df
    sd = F.stddev_pop if ddof == 0 else F.stddev_samp
    row = src.agg(*[F.avg(c).alias(f"m_{c}") for c in cols],
                  *[sd(c).alias(f"s_{c}") for c in cols]).first()
    out = []
    for c in df.columns:
        if c in cols:
            m, s = row[f"m_{c}"], row[f"s_{c}"]
            s = 1.0 if not s else s
            out.append(((F.col(c) - F.lit(m)) / F.lit(s)).alias(c + suffix))
            if suffix:
                out.append(F.col(c))
        else:
            out.append(F.col(c))
    return df.select(*out)


def preprocess_pipeline(categorical=("category_a", "category_b"), numeric="numeric_feature"):
    """StringIndexer(keep) + OneHotEncoder per categorical column, and
    VectorAssembler + StandardScaler(withMean, withStd) for one numeric (J1, J2)."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
    stages = []
    for c in categorical:
        stages += [StringIndexer(inputCol=c, outputCol=f"{c}_indexed", handleInvalid="keep"),
                   OneHotEncoder(inputCol=f"{c}_indexed", outputCol=f"{c}_encoded")]
    stages += [VectorAssembler(inputCols=[numeric], outputCol=f"{numeric}_vector"),
               StandardScaler(inputCol=f"{numeric}_vector", outputCol=f"scaled_{numeric}",
                              withMean=True, withStd=True)]
    return Pipeline(stages=stages)


def preprocess(df: DataFrame, fit_on: DataFrame | None = None,
               categorical=("category_a", "category_b"), numeric="numeric_feature",
               keep_index: bool = False) -> DataFrame:
    """Fit the pipeline on ``fit_on`` (training rows; default df), transform
    ``df``, unpack the scaled value to a double and drop intermediates (J2).
    The numeric input is cast to double first (the assembler rejects strings)."""
    df = df.withColumn(numeric, F.col(numeric).cast("double"))
    src = df if fit_on is None else fit_on.withColumn(numeric, F.col(numeric).cast("double"))
    model = preprocess_pipeline(categorical, numeric).fit(src)
    out = model.transform(df).withColumn(f"scaled_{numeric}", vec_item(f"scaled_{numeric}", 0))
    drop = list(categorical) + [f"{numeric}_vector"]
    if not keep_index:
        drop += [f"{c}_indexed" for c in categorical]
    return out.drop(*drop)


def pca_curve(df: DataFrame, vec: str, k: int = 10, standardize_first: bool = False):
    """Fit PCA **once** with k components and return (model, DataFrame of
    component, explained, cumulative) (J7) — one fit gives the whole
    cumulative curve for k = 1..10.  With ``standardize_first`` each
    dimension is scaled to unit variance (MLlib scaler; the explained-variance
    *ratios* do not depend on sample vs population deviation)."""
    from pyspark.ml.feature import PCA, StandardScaler
    from pyspark.ml.functions import array_to_vector
    data = df.select(array_to_vector(F.col(vec).cast("array<double>")).alias("_f"))
    if standardize_first:
        data = StandardScaler(inputCol="_f", outputCol="_s", withMean=True, withStd=True) \
            .fit(data).transform(data).select(F.col("_s").alias("_f"))
    model = PCA(k=k, inputCol="_f", outputCol="_p").fit(data)
    ev = [float(x) for x in model.explainedVariance.toArray()]
    rows, acc = [], 0.0
    for i, e in enumerate(ev):
        acc += e
        rows.append((i + 1, e, acc))
    curve = df.sparkSession.createDataFrame(rows, "component int, explained double, cumulative double")
    return model, curve


def pca_components(model, names=None, spark=None):
    """Loadings of a fitted PCA as (component, feature, loading), each
    component's sign fixed so its largest-magnitude loading is positive (J7)."""
    import numpy as np
    pc = model.pc.toArray()                      # d × k model state
    rows = []
    for j in range(pc.shape[1]):
        col = pc[:, j]
        sign = 1.0 if col[int(np.argmax(np.abs(col)))] >= 0 else -1.0
        for i, v in enumerate(col):
            rows.append((j + 1, names[i] if names else str(i), float(sign * v)))
    from pyspark.sql import SparkSession
    spark = spark or SparkSession.getActiveSession()
    return spark.createDataFrame(rows, "component int, feature string, loading double")


def rfe(df: DataFrame, features, label: str, n_keep: int, id_col: str, step: int = 1, num_trees: int = 100,
        seed: int = 42):
    """Recursive feature elimination with a random forest: refit, drop the
    least important feature(s), until ``n_keep`` remain (J6).  Forests have
    exact thresholds and pure leaves; a node draws the square root of the
    number of features.  Returns the kept feature names and the elimination order."""
    from quarry.operators import forest
    feats, dropped = list(features), []
    data = df.select(F.col(id_col), *feats, F.col(label)).persist()
    try:
        while len(feats) > n_keep:
            spec = forest.Spec(num_trees, max_features=max(1, int(len(feats) ** 0.5)), seed=seed)
            found = {r["feature"]: r["importance"] for r in forest.fit(data, feats, label, id_col, [spec]).importances().collect()}
            order = sorted(range(len(feats)), key=lambda i: (found.get(i, 0.0), feats[i]))
            for i in sorted(order[:min(step, len(feats) - n_keep)], reverse=True):
                dropped.append(feats.pop(i))
    finally:
        data.unpersist()
    return feats, dropped
