"""Schedule feasibility audit and utilisation reports.

The reference solves a scheduling MIP; here the *result* table is checked:
each of the model's six constraints becomes one grouping set of a single
GROUPING SETS aggregate that keeps only violating groups — one scan, one
shuffle of partial aggregates, so a crowded room/day cannot skew a task.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def lookup_last(df: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """Dictionary built from rows where the **last** duplicate wins (D6):
    the value at the greatest ``order`` per key."""
    return df.groupBy(key).agg(F.max_by(value, order).alias(value))


def _gid(keys, present) -> int:
    """grouping_id() of a grouping set: bit i (from the right, last key = bit 0)
    is 1 when key i is *not* in the set."""
    n = len(keys)
    return sum(1 << (n - 1 - i) for i, k in enumerate(keys) if k not in present)


def audit(df: DataFrame, hours: str = "booked_hr", room: str = "or_suite", day: str = "day",
          hour: str = "hour", encounter: str = "encounter_id", day_cap: float = 24.0,
          room_cap: float = 56.0, room_day_cap: float = 8.0) -> DataFrame:
    """Violations of the six scheduling constraints as
    (rule, or_suite, day, hour, encounter_id, value, cap).  Empty = feasible;
    a total exactly at capacity is feasible.

    All six rules are one GROUPING SETS aggregate: a single scan and a single
    shuffle of partial aggregates instead of six scans; ``grouping_id()``
    tells the sets apart (a null key is never confused with a rolled-up one)."""
    keys = [room, day, hour, encounter]
    rules = [  # (rule, grouping set, measure, cap)
        ("day_hours", [day], "hours", day_cap),
        ("room_one_at_a_time", [room, day, hour], "rows", 1),
        ("encounter_one_room", [encounter, day, hour], "rooms", 1),
        ("encounter_once", [encounter], "rows", 1),
        ("room_hours", [room], "hours", room_cap),
        ("room_day_hours", [room, day], "hours", room_day_cap),
    ]
    g = df.groupingSets([list(r[1]) for r in rules], *keys).agg(
        F.sum(hours).cast("double").alias("hours"),
        F.count(F.lit(1)).cast("double").alias("rows"),
        # distinct rooms of a group: bounded by the number of rooms
        F.size(F.collect_set(room)).cast("double").alias("rooms"),
        F.grouping_id().alias("_gid"))
    rule = F.lit(None).cast("string")
    value = F.lit(None).cast("double")
    cap = F.lit(None).cast("double")
    for name, members, measure, c in reversed(rules):
        hit = F.col("_gid") == F.lit(_gid(keys, members))
        rule = F.when(hit, F.lit(name)).otherwise(rule)
        value = F.when(hit, F.col(measure)).otherwise(value)
        cap = F.when(hit, F.lit(float(c))).otherwise(cap)
    out = g.select(rule.alias("rule"), *keys, value.alias("value"), cap.alias("cap"))
    return out.where(F.col("value") > F.col("cap")).select("rule", *keys, "value", "cap")


def utilisation(df: DataFrame, hours: str = "booked_hr", room: str = "or_suite",
                day: str = "day", room_day_cap: float = 8.0, rooms: int = 3,
                days: int = 7) -> DataFrame:
    """Scheduled hours against capacity by room, by day and by room×day (M2),
    as one GROUPING SETS aggregate."""
    keys = [room, day]
    levels = [("room", [room], room_day_cap * days), ("day", [day], room_day_cap * rooms),
              ("room_day", [room, day], room_day_cap)]
    g = df.groupingSets([lv[1] for lv in levels], *keys).agg(
        F.sum(hours).alias("hours"), F.grouping_id().alias("_gid"))
    level = F.lit(None).cast("string")
    cap = F.lit(None).cast("double")
    for name, members, c in levels:
        hit = F.col("_gid") == F.lit(_gid(keys, members))
        level = F.when(hit, F.lit(name)).otherwise(level)
        cap = F.when(hit, F.lit(float(c))).otherwise(cap)
    return g.select(level.alias("level"), room, day, "hours", cap.alias("capacity"),
                    (F.col("hours") / cap).alias("utilisation"))


def demand_vs_capacity(df: DataFrame, hours: str = "booked_hr", capacity: float = 168.0) -> DataFrame:
    """Total booked hours and their ratio to the available hours (M3)."""
    return df.agg(F.sum(hours).alias("booked_hours")).select(
        "booked_hours", F.lit(capacity).alias("capacity"),
        (F.col("booked_hours") / F.lit(capacity)).alias("ratio"))


def report(df: DataFrame, hours: str = "booked_hr", room: str = "or_suite", day: str = "day",
           hour: str = "hour", only_room=None, only_day=None) -> DataFrame:
    """Schedule rows with end time, optionally one room/day slice, ordered (M4)."""
    out = df.withColumn("end_time", F.col(hour) + F.col(hours))
    if only_room is not None:
        out = out.where(F.col(room) == only_room)
    if only_day is not None:
        out = out.where(F.col(day) == only_day)
    return out.orderBy(room, day, hour)
