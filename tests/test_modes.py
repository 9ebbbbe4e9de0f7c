"""Modes of many columns by one scan."""
import datetime as dt

from quarry.operators import clean as C


def test_modes_of_all_types_in_one_pass(spark):
    df = spark.createDataFrame(
        [(1, "b", 2.5, None, dt.date(2020, 1, 2), "x"), (2, "a", 2.5, None, dt.date(2020, 1, 1), None),
         (2, "b", None, None, None, "y"), (1, "a", 0.5, None, dt.date(2020, 1, 1), None)],
        "k long, s string, x double, none string, d date, t string")
    want = {"k": 1, "s": "a", "x": 2.5, "none": None, "d": dt.date(2020, 1, 1), "t": "x"}
    assert C.modes(df, df.columns) == want
    assert C.modes(df, ["t", "k"]) == {"t": "x", "k": 1}
    assert C.modes(df.limit(0), ["k", "s"]) == {"k": None, "s": None}
    assert C.modes(df, []) == {}
