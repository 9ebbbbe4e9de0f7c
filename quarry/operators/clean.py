"""Cleaning and type handling.

Operators that must learn something from the data (all-null columns, means,
modes, category levels) run one aggregate job that returns a single small
row to the driver — bounded by the number of columns or levels, never by the
number of rows — and then apply it lazily as literals.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions import columns as C
from quarry.session import cut_lineage


def drop_all_null(df: DataFrame) -> DataFrame:
    """Drop columns that are null in every row (B1) — one job for all columns."""
    row = df.agg(*[F.count(F.col(c)).alias(c) for c in df.columns]).first()
    return df.select(*[c for c in df.columns if row[c] > 0])


def means(df: DataFrame, cols) -> dict:
    row = df.agg(*[F.avg(c).alias(c) for c in cols]).first()
    return {c: row[c] for c in cols}


def impute_mean(df: DataFrame, cols, fit_on: DataFrame | None = None) -> DataFrame:
    """Fill numeric nulls with the column mean of ``fit_on`` (default: df itself)."""
    m = means(fit_on if fit_on is not None else df, cols)
    return df.select(*[F.coalesce(F.col(c), F.lit(m[c])).alias(c) if c in m and m[c] is not None
                       else F.col(c) for c in df.columns])


def modes(df: DataFrame, cols) -> dict:
    """Most frequent non-null value per column; ties go to the smallest value.

    One scan counts the (column, value) pairs of all columns, so no task holds
    all values of one; the values travel in one field per data type."""
    cols = list(dict.fromkeys(cols))
    if not cols:
        return {}
    kinds = {c: df.schema[c].dataType for c in cols}
    types = list(dict.fromkeys(kinds.values()))
    pair = lambda i, c: F.struct(F.lit(i).alias("i"), *[
        (F.col(c) if t == kinds[c] else F.lit(None).cast(t)).alias(f"v{k}") for k, t in enumerate(types)])
    values = [f"v{k}" for k in range(len(types))]
    counted = (df.select(F.explode(F.array(*[F.when(F.col(c).isNotNull(), pair(i, c)) for i, c in enumerate(cols)])).alias("p"))
               .where(F.col("p").isNotNull()).select("p.*").groupBy("i", *values).agg(F.count(F.lit(1)).alias("n")))
    best = counted.groupBy("i").agg(F.min(F.struct((-F.col("n")).alias("n"), *values)).alias("b")).collect()
    found = {cols[r["i"]]: r["b"][f"v{types.index(kinds[cols[r['i']]])}"] for r in best}
    return {c: found.get(c) for c in cols}


def impute_mode(df: DataFrame, cols, fit_on: DataFrame | None = None) -> DataFrame:
    m = modes(fit_on if fit_on is not None else df, cols)
    return df.select(*[F.coalesce(F.col(c), F.lit(m[c])).alias(c) if c in m and m[c] is not None
                       else F.col(c) for c in df.columns])


def fill(df: DataFrame, values: dict) -> DataFrame:
    """Fill nulls with per-column constants."""
    return df.select(*[F.coalesce(F.col(c), F.lit(values[c])).alias(c) if c in values
                       else F.col(c) for c in df.columns])


def map_values(df: DataFrame, col: str, mapping: dict, out: str | None = None) -> DataFrame:
    """Dictionary mapping; unmapped and null values become null."""
    m = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    return df.withColumn(out or col, F.when(F.col(col).isNull(), F.lit(None))
                         .otherwise(F.try_element_at(m, F.col(col))))


def to_number(df: DataFrame, cols, dtype: str = "double") -> DataFrame:
    """Lenient parse: unparsable text becomes null."""
    return df.select(*[F.col(c).try_cast(dtype).alias(c) if c in cols else F.col(c)
                       for c in df.columns])


def levels(df: DataFrame, cols, max_levels: int = 10000) -> dict:
    """Sorted distinct non-null values (as strings) of each column, computed
    as one distributed distinct over a stacked (column, value) view (one scan).  Fails
    loudly above ``max_levels`` in total instead of building huge schemas."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("_c"), F.col(c).cast("string").alias("_v"))
                                for c in cols]))
    stacked = df.select(pairs.alias("_p")).select("_p._c", "_p._v")     # one scan
    rows = stacked.where(F.col("_v").isNotNull()).distinct().limit(max_levels + 1).collect()
    if len(rows) > max_levels:
        raise ValueError(f"more than {max_levels} category levels; categories.one_hot takes any number")
    out = {c: [] for c in cols}
    for r in rows:
        out[r["_c"]].append(r["_v"])
    return {c: sorted(v) for c, v in out.items()}


def dummies(df: DataFrame, cols, drop_first: bool = False, lv: dict | None = None,
            sep: str = "_") -> DataFrame:
    """One 0/1 column per distinct value (B22), named ``col_value`` in sorted
    value order after the untouched columns; a null row is all zeros; with
    ``drop_first`` the smallest level is dropped.  No pivot shuffle."""
    lv = lv or levels(df, cols)
    keep = [F.col(c) for c in df.columns if c not in cols]
    new = []
    for c in cols:
        vals = lv[c][1:] if drop_first else lv[c]
        s = F.col(c).cast("string")
        new += [F.coalesce((s == v).cast("int"), F.lit(0)).alias(f"{c}{sep}{v}") for v in vals]
    return df.select(*keep, *new)


def align(df: DataFrame, columns) -> DataFrame:
    """Select ``columns`` in order; missing ones become 0, extra are dropped."""
    have = set(df.columns)
    return df.select(*[F.col(c) if c in have else F.lit(0).alias(c) for c in columns])


def split_parts(df: DataFrame, col: str, sep: str, names) -> DataFrame:
    """Split a composite string into named parts (G1)."""
    return df.withColumns({n: C.part(col, sep, i) for i, n in enumerate(names) if n})


def name_features(df: DataFrame, col: str, length: str = "name_length",
                  vowels: str = "name_vowels") -> DataFrame:
    """Length and lower-case vowel count of the first two name pieces."""
    return df.withColumns({length: C.name_length(col), vowels: C.name_vowels(col)})


def row_sum(df: DataFrame, cols, out: str) -> DataFrame:
    return df.withColumn(out, C.row_sum(cols))


def group_size(df: DataFrame, key: str, out: str = "group_size") -> DataFrame:
    """Group size attached to every row (F1).

    Computed as a partial aggregate joined back on the key rather than a
    window: a hot key is pre-aggregated map-side.  The sizes are checkpointed
    first: only then does AQE split the join side that carries the hot key.
    """
    sizes = df.groupBy(key).agg(F.count(F.lit(1)).alias(out))
    return df.join(cut_lineage(sizes), key, "left")


def drop_null_rows(df: DataFrame, subset) -> DataFrame:
    """Rows with a value in every ``subset`` column."""
    return df.dropna(subset=list(subset))


def split_xy(df: DataFrame, label: str | None = None):
    """Feature columns and label column; by default the label is the last
    column, as positional slicing does in the reference (B21)."""
    label = label or df.columns[-1]
    return [c for c in df.columns if c != label], label
