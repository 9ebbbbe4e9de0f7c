"""Level dictionaries and sparse rows against plain Python."""
import collections

from quarry.operators import categories as CT


def _table(spark, n=20000):
    rows = [(i, "hot" if i % 3 else f"v{i}", None if i % 7 == 0 else i % 5) for i in range(n)]
    return spark.createDataFrame(rows, "id long, a string, b int"), rows


def test_more_levels_than_columns_could_hold(spark):
    df, rows = _table(spark, 40000)
    table = CT.level_table(df, ["a", "b"], by="frequency")
    count = collections.Counter(r[1] for r in rows)
    want = {v: i for i, v in enumerate(sorted(count, key=lambda v: (-count[v], v.encode())))}
    assert len(want) > 10000
    assert {r.value: (r.level, r.rows) for r in table.where("column = 'a'").collect()} == {v: (i, count[v]) for v, i in want.items()}
    found = CT.index(df, ["a", "b"], table).collect()
    assert len(found) == len(rows)
    assert all(r.a_idx == want[r.a] and (r.b_idx == 5) == (r.b is None) for r in found)


def test_sparse_rows(spark):
    df, rows = _table(spark, 60)
    for drop in (False, True):
        a, b = (sorted({str(r[k]) for r in rows if r[k] is not None}) for k in (1, 2))
        names = [("a", v) for v in a[drop:]] + [("b", v) for v in b[drop:]]
        for r in CT.one_hot(df, ["a", "b"], CT.level_table(df, ["a", "b"]), drop_first=drop).collect():
            own = {("a", r.a), ("b", None if r.b is None else str(r.b))}
            assert r.one_hot.size == len(names) and r.one_hot["values"] == [1.0] * len(r.one_hot.indices)
            assert r.one_hot.indices == [i for i, x in enumerate(names) if x in own]


def test_unseen_empty_and_clashing(spark):
    df = spark.createDataFrame([(1, "x", "p"), (2, None, "q"), (2, None, "q"), (3, "", "r")], "id long, l0 string, value string")
    table = CT.level_table(df.where("id < 3"), ["l0", "value"])
    got = sorted(tuple(r) for r in CT.index(df, ["l0", "value"], table).select("id", "l0_idx", "value_idx").collect())
    assert got == [(1, 0, 0), (2, 1, 1), (2, 1, 1), (3, 1, 2)]
    none = CT.level_table(df.where("id < 0"), ["l0"])
    assert none.count() == 0 and {tuple(r.one_hot.indices) for r in CT.one_hot(df, ["l0"], none).collect()} == {()}
