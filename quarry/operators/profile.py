"""Table profiles and summary statistics.

All statistics are single aggregate jobs; exact quantiles count equal values
first and add up the counts with :mod:`quarry.plans.ranking`, instead of
Spark's ``percentile`` aggregate, which would buffer a whole column inside one
task.  A value that most rows share is one counted row.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.plans.ranking import prefix_sums


def catalog(spark: SparkSession, tables: dict) -> DataFrame:
    """(table_name, column_name, position, data_type) for several tables (B2).
    Built from schemas only (metadata, size = number of columns)."""
    rows = [(name, f.name, i, f.dataType.simpleString())
            for name, df in tables.items() for i, f in enumerate(df.schema.fields)]
    return spark.createDataFrame(
        rows, "table_name string, column_name string, position int, data_type string")


def _ref(df: DataFrame, name: str):
    """The column of that very name, whatever characters it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def _unfold(df: DataFrame, names, rows, keep=()) -> DataFrame:
    """``keep`` and one row of ``names`` per tuple of ``rows`` (text or columns)."""
    as_col = lambda x: F.lit(x) if isinstance(x, str) else x
    cells = F.explode(F.array(*[F.struct(*[as_col(x).alias(n) for n, x in zip(names, r)]) for r in rows]))
    return df.select(*keep, cells.alias("__cell")).select(*keep, *[F.col("__cell")[n].alias(n) for n in names])


def _stack(df: DataFrame, cols, value_type: str = "double") -> DataFrame:
    """Long form (column, value) of the chosen columns — one narrow pass."""
    return _unfold(df, ["column", "value"], [(c, _ref(df, c).cast(value_type)) for c in cols])


def null_counts(df: DataFrame) -> DataFrame:
    """(column, null_count) — one aggregate over all columns."""
    row = df.agg(*[F.count_if(_ref(df, c).isNull()).alias(f"n{i}") for i, c in enumerate(df.columns)])
    return _unfold(row, ["column", "null_count"], [(c, F.col(f"n{i}")) for i, c in enumerate(df.columns)])


def column_profile(df: DataFrame) -> DataFrame:
    """(column, data_type, non_null, rows) — ``info()`` as a table."""
    row = df.agg(F.count(F.lit(1)).alias("rows"),
                 *[F.count(_ref(df, c)).alias(f"n{i}") for i, c in enumerate(df.columns)])
    cells = [(c, t, F.col(f"n{i}")) for i, (c, t) in enumerate(df.dtypes)]
    return _unfold(row, ["column", "data_type", "non_null"], cells, ["rows"]).select(
        "column", "data_type", "non_null", "rows")


def value_counts(df: DataFrame, col: str) -> DataFrame:
    """(value, count) — sort with ``orderBy(desc('count'))`` when needed."""
    return df.groupBy(F.col(col).alias("value")).agg(F.count(F.lit(1)).alias("count"))


def distinct_counts(df: DataFrame, cols, by: str | None = None) -> DataFrame:
    """Exact distinct non-null counts per column, optionally per group."""
    aggs = [F.countDistinct(F.col(c)).alias(f"n_{c}") for c in cols]
    return df.groupBy(by).agg(*aggs) if by else df.agg(*aggs)


def quantiles(df: DataFrame, cols, probs=(0.25, 0.5, 0.75), by=None) -> DataFrame:
    """Exact linearly-interpolated quantiles (pandas/numpy default) per column
    (and per group when ``by`` is given).

    The value at 1-based position 1+(n-1)·p, interpolated between the two
    neighbouring order statistics.  Distributed: equal values are counted
    (map-side), the counts are added up in value order per (group, column),
    and the target table (groups × columns × probs × 2 rows) selects the
    values whose rank interval holds a needed rank.  Returns ([by,] column, p, value).
    """
    by = [] if by is None else ([by] if isinstance(by, str) else list(by))
    long = _unfold(df, ["column", "value"], [(c, _ref(df, c).cast("double")) for c in cols],
                   [_ref(df, b) for b in by]).where(F.col("value").isNotNull())
    keys = by + ["column"]
    counts = long.groupBy(*keys, "value").agg(F.count(F.lit(1)).alias("_c"))
    ranked = prefix_sums(counts, ["value"], ["_c"], keys, out_cols=["_hi"], rank_col=None)
    n = ranked.groupBy(*keys).agg(F.max("_hi").alias("_n"))
    pos = n.select(*keys, F.explode(F.array(*[
        F.struct(F.lit(float(p)).alias("p"), ((F.col("_n") - 1) * F.lit(float(p)) + 1).alias("pos"))
        for p in probs])).alias("t")).select(*keys, "t.p", "t.pos")
    lo = F.floor("pos").cast("long")
    fr = F.col("pos") - lo
    picks = pos.select(*keys, "p", F.explode(F.array(
        F.struct(lo.alias("_r"), (F.lit(1.0) - fr).alias("w")),
        F.struct((lo + 1).alias("_r"), fr.alias("w")))).alias("t")).select(
        *keys, "p", "t._r", "t.w").where(F.col("w") > 0)
    if not by:  # size fixed by the arguments: columns × probs × 2
        picks = F.broadcast(picks)
    return (ranked.join(picks, keys).where((F.col("_r") <= F.col("_hi")) & (F.col("_r") > F.col("_hi") - F.col("_c")))
            .groupBy(*keys, "p").agg(F.sum(F.col("value") * F.col("w")).alias("value")))


def five_numbers(df: DataFrame, cols, by) -> DataFrame:
    """min, q1, median, q3, max per group and column — what a box plot draws."""
    q = quantiles(df, cols, (0.0, 0.25, 0.5, 0.75, 1.0), by=by)
    by = [by] if isinstance(by, str) else list(by)
    return (q.groupBy(*by, "column").pivot("p", [0.0, 0.25, 0.5, 0.75, 1.0]).agg(F.first("value"))
            .toDF(*by, "column", "min", "q1", "median", "q3", "max"))


def describe(df: DataFrame, cols) -> DataFrame:
    """count, mean, std (sample), min, 25%, 50%, 75%, max per column."""
    long = _stack(df, cols)
    base = long.groupBy("column").agg(
        F.count("value").alias("count"), F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"), F.min("value").alias("min"),
        F.max("value").alias("max"))
    q = quantiles(df, cols).groupBy("column").pivot("p", [0.25, 0.5, 0.75]).agg(F.first("value"))
    q = q.toDF("column", "q25", "q50", "q75")
    return base.join(q, "column", "left")


def corr_matrix(df: DataFrame, cols) -> DataFrame:
    """Pearson correlation for every ordered column pair, one aggregate."""
    row = df.agg(*[F.corr(_ref(df, a), _ref(df, b)).alias(f"r{i}_{j}") for i, a in enumerate(cols)
                   for j, b in enumerate(cols) if i <= j])     # symmetric: each pair once
    return _unfold(row, ["col_a", "col_b", "corr"],
                   [(a, b, F.col(f"r{min(i, j)}_{max(i, j)}")) for i, a in enumerate(cols) for j, b in enumerate(cols)])


def histogram(df: DataFrame, col: str, bins: int = 5) -> DataFrame:
    """Fixed-width bins between min and max; the top edge is closed."""
    mm = df.agg(F.min(col).alias("_mn"), F.max(col).alias("_mx")).first()
    lo, hi = mm["_mn"], mm["_mx"]
    if lo is None:
        return df.sparkSession.createDataFrame([], "bin int, lower double, upper double, count long")
    width = (hi - lo) / bins if hi > lo else 1.0
    b = F.least(F.floor((F.col(col) - F.lit(lo)) / F.lit(width)), F.lit(bins - 1)).cast("int")
    out = df.where(F.col(col).isNotNull()).groupBy(b.alias("bin")).agg(
        F.count(F.lit(1)).alias("count"))
    return out.select("bin", (F.lit(lo) + F.col("bin") * F.lit(width)).alias("lower"),
                      (F.lit(lo) + (F.col("bin") + 1) * F.lit(width)).alias("upper"), "count")


def min_max_median(df: DataFrame, col: str) -> DataFrame:
    """min, median and max as exact order statistics (quantiles 0, .5, 1)."""
    q = quantiles(df, [col], (0.0, 0.5, 1.0))
    return q.groupBy("column").pivot("p", [0.0, 0.5, 1.0]).agg(F.first("value")).toDF(
        "column", "min", "median", "max")
