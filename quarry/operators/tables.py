"""Generic table operators: filters, lookups, arg-min/max, top-n, unions
(C4, C5, D4, D5, E8, F3, F5-F7)."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def exclude_values(df: DataFrame, col: str, values) -> DataFrame:
    """Rows whose ``col`` is not in ``values`` (C5).  The literal list is a
    hash-set membership test (``INSET``) evaluated in the scan stage; null
    keys are kept, as ``~isin`` keeps them in the reference."""
    vals = sorted(set(values))
    return df.where(F.col(col).isNull() | ~F.col(col).isin(vals))


def arg_extreme(df: DataFrame, by, target: str, value: str, tie: str | None = None,
                largest: bool = False, out: str | None = None) -> DataFrame:
    """Per group, the ``target`` of the row with the least (or greatest)
    ``value``; ties go to the smallest ``tie`` (F3).  A partial aggregate: no
    window sort, so a hot group costs one row per map task."""
    tie = tie or target
    by = [by] if isinstance(by, str) else list(by)
    if largest:
        key = F.struct(F.col(value), (-F.col(tie)) if _numeric(df, tie) else F.col(tie))
        agg = F.max_by(F.col(target), key)
    else:
        agg = F.min_by(F.col(target), F.struct(F.col(value), F.col(tie)))
    valagg = F.max(value) if largest else F.min(value)
    return df.groupBy(*by).agg(agg.alias(out or f"arg_{target}"), valagg.alias(value))


def _numeric(df, c):
    return df.schema[c].dataType.typeName() in ("integer", "long", "short", "double", "float")


def top_n(df: DataFrame, n: int, *order) -> DataFrame:
    """First ``n`` rows by ``order`` — planned as TakeOrderedAndProject
    (per-partition top-n, then merge), never a full sort (F6)."""
    return df.orderBy(*order).limit(n)


def union_all(*dfs: DataFrame) -> DataFrame:
    """Union by column **name**; missing columns become null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)


def sums(df: DataFrame, value: str, by=()) -> DataFrame:
    """Sum globally or per key(s)."""
    by = [by] if isinstance(by, str) else list(by)
    g = df.groupBy(*by) if by else df
    return g.agg(F.sum(value).alias(f"sum_{value}"))
