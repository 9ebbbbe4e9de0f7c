"""Category levels of any number: a distributed dictionary and sparse rows.

``level_table`` numbers the distinct values of several columns in one scan;
the dictionary stays a table, and rows meet it in one join a column, so neither
the driver nor the schema grows with the number of levels.  The dictionary is
cut off from its lineage first: its counts are pre-aggregated, each value is
one row of it, and a join that reads it can split a value that most rows hold.

Defined results: null is no level; a null or unseen value gets the number
after the last level as its index and no entry in a sparse row; values are
compared as strings, ties of frequency go to the smaller string; a column
without levels has size 0; rows that repeat are kept; other columns stay.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.plans.ranking import row_number
from quarry.session import cut_lineage


def level_table(df: DataFrame, cols, by: str = "value") -> DataFrame:
    """(column, value, rows, level): levels from 0 in order of the ``value`` or of falling ``frequency``."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in cols]))
    counted = (df.select(pairs.alias("p")).select("p.*").where(F.col("value").isNotNull())
               .groupBy("column", "value").agg(F.count(F.lit(1)).alias("rows")))
    order = {"value": ["value"], "frequency": [F.desc("rows"), "value"]}[by]
    ranked = row_number(counted, order, ["column"], out="level")
    return cut_lineage(ranked.select("column", "value", "rows", (F.col("level") - 1).cast("long").alias("level")))


def sizes(table: DataFrame, cols) -> dict[str, int]:
    """Number of levels of each column."""
    found = {r["column"]: r["n"] for r in table.groupBy("column").agg(F.count(F.lit(1)).alias("n")).collect()}
    return {c: found.get(c, 0) for c in cols}


def _levelled(df: DataFrame, cols, table: DataFrame) -> DataFrame:
    """(row, l0, l1, ...): the whole row beside the level of each column (null: none)."""
    out = df.select(F.struct("*").alias("row"))
    for i, c in enumerate(cols):
        own = table.where(F.col("column") == c).select(F.col("value").alias(f"v{i}"), F.col("level").alias(f"l{i}"))
        out = out.join(own, F.col("row").getField(c).cast("string") == F.col(f"v{i}"), "left").drop(f"v{i}")
    return out


def index(df: DataFrame, cols, table: DataFrame, suffix: str = "_idx") -> DataFrame:
    """``df`` with the level of each column; null and unseen values get the number of levels."""
    n = sizes(table, cols)
    return _levelled(df, cols, table).select("row.*", *[F.coalesce(f"l{i}", F.lit(n[c])).alias(c + suffix) for i, c in enumerate(cols)])


def one_hot(df: DataFrame, cols, table: DataFrame, out: str = "one_hot", drop_first: bool = False) -> DataFrame:
    """``df`` with the columns' indicators side by side as one sparse row (size, indices, values).

    Column after column holds its levels in order, without the first if ``drop_first``."""
    n, first = sizes(table, cols), int(drop_first)
    places, start = [], 0
    for i, c in enumerate(cols):
        places.append(F.when(F.col(f"l{i}") >= first, F.col(f"l{i}") + (start - first)))
        start += max(n[c] - first, 0)
    indices = F.filter(F.array(*places), lambda x: x.isNotNull())
    found = _levelled(df, cols, table).select("row", indices.alias("at"))
    return found.select("row.*", F.struct(F.lit(start).cast("long").alias("size"), F.col("at").alias("indices"),
                                          F.transform("at", lambda _: F.lit(1.0)).alias("values")).alias(out))
