"""Event-log feature tables, joins and match rates.

Scale notes
-----------
* ``event_summary`` is one filtered scan and one hash aggregate: Spark's
  partial (map-side) aggregation collapses a hot entity to one row per map
  task before the shuffle, so a key holding a third of the log is harmless.
* ``match_pct`` pre-aggregates both sides to ``(key, n)`` before joining and
  sums ``n_a * n_b``; the join never sees duplicate keys, so a skewed key
  cannot blow up one task, and the whole figure is a single plan.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _present(c: Column) -> Column:
    # non-null and non-empty; a null input makes the whole predicate false
    return c.isNotNull() & (c != "")


def event_condition(table: str = "TableA", field: str = "TargetEvent", *,
                    table_col: str = "table_name", field_col: str = "field_name",
                    new_col: str = "new_value") -> Column:
    """A target event: the field gets a non-empty new value."""
    return ((F.col(table_col) == table) & (F.col(field_col) == field)
            & _present(F.col(new_col)))


def resolve_condition(table: str = "TableA", field: str = "TargetEvent", *,
                      table_col: str = "table_name", field_col: str = "field_name",
                      old_col: str = "old_value", new_col: str = "new_value") -> Column:
    """A resolution: a non-empty old value is cleared (new value null or empty)."""
    return ((F.col(table_col) == table) & (F.col(field_col) == field)
            & _present(F.col(old_col))
            & (F.col(new_col).isNull() | (F.col(new_col) == "")))


def event_summary(log: DataFrame, entity: str = "document", date: str = "change_date",
                  is_event: Column | None = None, is_resolve: Column | None = None) -> DataFrame:
    """Per entity: first event date, last resolve date, number of events.

    Single pass: rows matching either condition are aggregated once with
    conditional aggregates (no union of two filtered scans).
    """
    ev = event_condition() if is_event is None else is_event
    rs = resolve_condition() if is_resolve is None else is_resolve
    return (log.where(ev | rs)
            .groupBy(F.col(entity).alias("id"))
            .agg(F.min(F.when(ev, F.col(date))).alias("first_event_date"),
                 F.max(F.when(rs, F.col(date))).alias("last_resolve_date"),
                 F.count(F.when(ev, F.lit(1))).alias("event_count")))


def filter_codes(df: DataFrame, col: str, codes) -> DataFrame:
    """Membership filter (C1); a literal list is pushed to the scan as ``In``."""
    return df.where(F.col(col).isin(list(codes)))


def details(main: DataFrame, aux: DataFrame, events: DataFrame, on: str = "id",
            aux_cols=("additional_column",)) -> DataFrame:
    """Inner join main×aux (all main columns + chosen aux columns), left join
    the event summary, and flag entities with at least one event (D1, D2, B17)."""
    m, a = main.alias("m"), aux.alias("a")
    joined = m.join(a, F.col(f"m.{on}") == F.col(f"a.{on}"), "inner").select(
        "m.*", *[F.col(f"a.{c}") for c in aux_cols])
    out = joined.join(events, on, "left")
    return out.withColumn("event_flag",
                          F.when(F.col("first_event_date").isNotNull(), 1).otherwise(0))


def target_flag(df: DataFrame, status_col: str = "status", inactive: str = "Inactive",
                out: str = "target_event_flag") -> DataFrame:
    """1 when the entity had an event and is not inactive; a null status
    makes the condition null, which falls to 0 (B17)."""
    cond = (F.col("event_flag") == 1) & (F.col(status_col) != inactive)
    return df.withColumn(out, F.when(cond, 1).otherwise(0))


def match_pct(a: DataFrame, b: DataFrame, on: str) -> DataFrame:
    """Rows of ``a ⋈ b`` (inner, on ``on``) per 100 rows of ``a`` (D3).

    Duplicate keys on the right push ``match_pct`` above 100, as an
    inner-join count does; ``match_pct_distinct`` counts each left row at
    most once (semi-join rate).  An empty ``a`` gives null, not an error.
    One plan: both sides are reduced to ``(key, n)`` first.
    """
    na = a.groupBy(on).agg(F.count(F.lit(1)).alias("_na"))
    nb = b.groupBy(on).agg(F.count(F.lit(1)).alias("_nb"))
    j = na.join(nb, on, "left")
    matched = F.sum(F.col("_na") * F.coalesce(F.col("_nb"), F.lit(0)))
    matched_left = F.sum(F.when(F.col("_nb").isNotNull(), F.col("_na")).otherwise(0))
    total = F.sum("_na")
    return j.agg(F.coalesce(matched, F.lit(0)).cast("long").alias("matched_rows"),
                 F.coalesce(matched_left, F.lit(0)).cast("long").alias("matched_left_rows"),
                 F.coalesce(total, F.lit(0)).cast("long").alias("left_rows"),
                 F.try_divide(matched * F.lit(100.0), total).alias("match_pct"),
                 F.try_divide(matched_left * F.lit(100.0), total).alias("match_pct_distinct"))


def split_by_date(df: DataFrame, col: str, cutoff: str):
    """(before, on_or_after) the cutoff date; null dates fall in neither."""
    d = F.to_date(F.col(col))
    lit = F.to_date(F.lit(cutoff))
    return df.where(d < lit), df.where(d >= lit)
