"""Registered queries: cleaning, string features, profiles (B*, E7, E9-E14, F1, G1-G4)."""
from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions import columns as C
from quarry.operators import categories as CT
from quarry.operators import clean, profile
from quarry.plans.fixtures import cte, fixture
from quarry.sources.tables import load

Q, SQL = {}, {}
SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


def _pax(spark, sf):
    return fixture(spark, sf, "fx_pax")


def b1_drop_all_null(spark, sf):
    return clean.drop_all_null(_pax(spark, sf))


Q["b1_drop_all_null"] = b1_drop_all_null
SQL["b1_drop_all_null"] = cte("fx_pax") + "SELECT * EXCLUDE (all_null) FROM fx_pax"


def b2_catalog(spark, sf):
    names = ["customer", "orders", "lineitem", "events"]
    cat = profile.catalog(spark, {n: load(spark, sf, n) for n in names})
    return cat.select("table_name", "column_name", F.col("position").cast("long").alias("position"))


Q["b2_catalog"] = b2_catalog
SQL["b2_catalog"] = """
SELECT table_name, column_name, CAST(ordinal_position - 1 AS BIGINT) AS position
FROM information_schema.columns
WHERE table_name IN ('customer', 'orders', 'lineitem', 'events')"""


def b3_b8_projection(spark, sf):
    """select / drop / rename / literal / unit conversion / conditional
    overwrite / derived end time on the schedule table (B3-B8, B12, B20)."""
    s = fixture(spark, sf, "fx_sched")
    out = (s.select("encounter_id", "or_suite", "day", "hour", "cpt_code", "booked_min")
           .drop("cpt_code")
           .withColumnRenamed("or_suite", "room")
           .withColumn("booked_hr", F.col("booked_min") / 60.0)
           .withColumn("booked_hr", F.when(F.col("day") == 7, F.lit(0.75))
                       .otherwise(F.col("booked_hr")))
           .withColumn("end_hour", F.col("hour") + F.col("booked_hr"))
           .withColumn("kind", F.lit("surgery")))
    return out.select("encounter_id", "room", "day", "hour",
                      F.round("booked_hr", 6).alias("booked_hr"),
                      F.round("end_hour", 6).alias("end_hour"), "kind")


Q["b3_b8_projection"] = b3_b8_projection
SQL["b3_b8_projection"] = cte("fx_sched") + """
SELECT encounter_id, or_suite AS room, day, hour,
       ROUND(CASE WHEN day = 7 THEN 0.75 ELSE booked_min / 60.0 END, 6) AS booked_hr,
       ROUND(hour + CASE WHEN day = 7 THEN 0.75 ELSE booked_min / 60.0 END, 6) AS end_hour,
       'surgery' AS kind
FROM fx_sched"""


def b8_join_select(spark, sf):
    """all columns of one side plus one column of the other."""
    m = fixture(spark, sf, "fx_main").alias("m")
    a = fixture(spark, sf, "fx_aux").alias("a")
    return m.join(a, F.col("m.id") == F.col("a.id"), "inner").select("m.*", "a.additional_column")


Q["b8_join_select"] = b8_join_select
SQL["b8_join_select"] = cte("fx_main", "fx_aux") + \
    "SELECT m.*, a.additional_column FROM fx_main m JOIN fx_aux a ON m.id = a.id"


def b9_fill(spark, sf):
    p = clean.fill(_pax(spark, sf), {"cabin": "Z/9999/Z", "name": "Nombre Apellido",
                                     "passenger_id": "999999"})
    return p.select("row_id", "cabin", "name", "passenger_id")


Q["b9_fill"] = b9_fill
SQL["b9_fill"] = cte("fx_pax") + """
SELECT row_id, COALESCE(cabin, 'Z/9999/Z') AS cabin, COALESCE(name, 'Nombre Apellido') AS name,
       COALESCE(passenger_id, '999999') AS passenger_id FROM fx_pax"""


def b10_impute_mean(spark, sf):
    p = clean.impute_mean(_pax(spark, sf), ["age", "room_service", "spa"])
    return p.select("row_id", *[F.round(c, 6).alias(c) for c in ["age", "room_service", "spa"]])


Q["b10_impute_mean"] = b10_impute_mean
SQL["b10_impute_mean"] = cte("fx_pax") + """
SELECT row_id, ROUND(COALESCE(age, AVG(age) OVER ()), 6) AS age,
       ROUND(COALESCE(room_service, AVG(room_service) OVER ()), 6) AS room_service,
       ROUND(COALESCE(spa, AVG(spa) OVER ()), 6) AS spa FROM fx_pax"""


def b11_impute_mode(spark, sf):
    p = clean.split_parts(_pax(spark, sf), "cabin", "/", ["deck", None, None])
    p = clean.impute_mode(p, ["home_planet", "deck"])
    return p.select("row_id", "home_planet", "deck")


Q["b11_impute_mode"] = b11_impute_mode
SQL["b11_impute_mode"] = cte("fx_pax") + """,
p AS (SELECT row_id, home_planet, split_part(cabin, '/', 1) AS deck FROM fx_pax),
mh AS (SELECT home_planet AS v FROM p WHERE home_planet IS NOT NULL
       GROUP BY home_planet ORDER BY COUNT(*) DESC, home_planet LIMIT 1),
md AS (SELECT deck AS v FROM p WHERE deck IS NOT NULL
       GROUP BY deck ORDER BY COUNT(*) DESC, deck LIMIT 1)
SELECT row_id, COALESCE(home_planet, (SELECT v FROM mh)) AS home_planet,
       COALESCE(deck, (SELECT v FROM md)) AS deck FROM p"""


def g1_b13_cabin_parts(spark, sf):
    p = clean.split_parts(_pax(spark, sf), "cabin", "/", ["deck", "cabin_number", "side"])
    p = clean.to_number(p, ["cabin_number"])
    p = clean.map_values(p, "side", {"P": "Port", "S": "Starboard"})
    return p.select("row_id", "deck", "cabin_number", "side")


Q["g1_b13_cabin_parts"] = g1_b13_cabin_parts
SQL["g1_b13_cabin_parts"] = cte("fx_pax") + """
SELECT row_id, split_part(cabin, '/', 1) AS deck,
       TRY_CAST(split_part(cabin, '/', 2) AS DOUBLE) AS cabin_number,
       CASE split_part(cabin, '/', 3) WHEN 'P' THEN 'Port' WHEN 'S' THEN 'Starboard' END AS side
FROM fx_pax"""


def b14_to_number(spark, sf):
    return clean.to_number(_pax(spark, sf), ["raw_number"]).select("row_id", "raw_number")


Q["b14_to_number"] = b14_to_number
SQL["b14_to_number"] = cte("fx_pax") + \
    "SELECT row_id, TRY_CAST(raw_number AS DOUBLE) AS raw_number FROM fx_pax"


def b16_b18_labels(spark, sf):
    r = fixture(spark, sf, "fx_rev")
    return r.select("doc_id", C.binary_by(F.col("score") > 3).alias("positive"),
                    C.three_way("score").alias("sentiment"),
                    C.binary_by(F.col("quality") >= 1).alias("good"))


Q["b16_b18_labels"] = b16_b18_labels
SQL["b16_b18_labels"] = cte("fx_rev") + """
SELECT doc_id, CASE WHEN score > 3 THEN 1 ELSE 0 END AS positive,
       CASE WHEN score > 3 THEN 'positive' WHEN score < 3 THEN 'negative' ELSE 'neutral' END AS sentiment,
       CASE WHEN quality >= 1 THEN 1 ELSE 0 END AS good FROM fx_rev"""


def b19_row_sum(spark, sf):
    p = clean.row_sum(_pax(spark, sf), ["room_service", "spa", "age"], "total")
    return p.select("row_id", F.round("total", 6).alias("total"))


Q["b19_row_sum"] = b19_row_sum
SQL["b19_row_sum"] = cte("fx_pax") + """
SELECT row_id, ROUND(COALESCE(room_service, 0) + COALESCE(spa, 0) + COALESCE(age, 0), 6) AS total
FROM fx_pax"""


def _dummy_sql(col, vals, prefix=None):
    prefix = prefix or col
    return ", ".join(f"CASE WHEN {col} = '{v}' THEN 1 ELSE 0 END AS \"{prefix}_{v}\"" for v in vals)


def b22_dummies(spark, sf):
    p = clean.split_parts(_pax(spark, sf), "cabin", "/", [None, None, "side"])
    p = p.select("row_id", "home_planet", "side", "transported")
    return clean.dummies(p, ["home_planet", "side", "transported"])


Q["b22_dummies"] = b22_dummies
SQL["b22_dummies"] = cte("fx_pax") + f"""
SELECT row_id, {_dummy_sql('home_planet', SEGMENTS)},
       {_dummy_sql("split_part(cabin, '/', 3)", ['P', 'S'], 'side')},
       {_dummy_sql('CAST(transported AS VARCHAR)', ['false', 'true'], 'transported')}
FROM fx_pax"""


def b22_wide(spark, sf):
    """Indicators of every customer and priority: one sparse row an order, levels by value."""
    o = spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", "o_custkey", "o_orderpriority")
    cols = ["o_custkey", "o_orderpriority"]
    return CT.one_hot(o, cols, CT.level_table(o, cols)).select(
        "o_orderkey", F.col("one_hot.size").alias("width"), F.array_join("one_hot.indices", ",").alias("indices"))


Q["b22_wide"] = b22_wide
SQL["b22_wide"] = """
WITH c AS (SELECT v, ROW_NUMBER() OVER (ORDER BY v) - 1 AS i FROM (SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS v FROM orders WHERE o_custkey IS NOT NULL)),
p AS (SELECT v, ROW_NUMBER() OVER (ORDER BY v) - 1 AS i FROM (SELECT DISTINCT o_orderpriority AS v FROM orders WHERE o_orderpriority IS NOT NULL)),
n AS (SELECT (SELECT COUNT(*) FROM c) AS nc, (SELECT COUNT(*) FROM p) AS np)
SELECT o_orderkey, nc + np AS width, CONCAT_WS(',', c.i, p.i + nc) AS indices
FROM orders LEFT JOIN c ON c.v = CAST(o_custkey AS VARCHAR) LEFT JOIN p ON p.v = o_orderpriority, n"""


def b23_align(spark, sf):
    p = _pax(spark, sf)
    full = clean.dummies(p.select("row_id", "home_planet"), ["home_planet"])
    part = clean.dummies(p.select("row_id", "home_planet"), ["home_planet"], drop_first=True)
    part = part.withColumn("extra", F.lit(1))
    return clean.align(part, full.columns)


Q["b23_align"] = b23_align
SQL["b23_align"] = cte("fx_pax") + f"""
SELECT row_id, 0 AS "home_planet_{SEGMENTS[0]}", {_dummy_sql('home_planet', SEGMENTS[1:])} FROM fx_pax"""


def g2_g3_g4_names(spark, sf):
    p = clean.name_features(_pax(spark, sf), "name")
    return p.select("row_id", C.last_token("name").alias("surname"),
                    C.strip_char("passenger_id", "_").cast("bigint").alias("passenger_num"),
                    "name_length", "name_vowels")


Q["g2_g3_g4_names"] = g2_g3_g4_names
SQL["g2_g3_g4_names"] = cte("fx_pax") + """
SELECT row_id,
       list_filter(regexp_split_to_array(name, '\\s+'), lambda x: x <> '')[-1] AS surname,
       CAST(replace(passenger_id, '_', '') AS BIGINT) AS passenger_num,
       CAST(length(split_part(name, ' ', 1) || split_part(name, ' ', 2)) AS BIGINT) AS name_length,
       CAST(length(regexp_extract_all(split_part(name, ' ', 1) || split_part(name, ' ', 2), '[aeiou]'))
            AS BIGINT) AS name_vowels
FROM fx_pax"""


def f1_group_size(spark, sf):
    p = _pax(spark, sf).withColumn("grp", C.part("passenger_id", "_", 0))
    p = clean.group_size(p, "grp", "family_size")
    return p.select("row_id", "grp", "family_size",
                    C.binary_by(F.col("family_size") == 1).alias("alone"))


Q["f1_group_size"] = f1_group_size
SQL["f1_group_size"] = cte("fx_pax") + """
SELECT row_id, split_part(passenger_id, '_', 1) AS grp,
       COUNT(*) OVER (PARTITION BY split_part(passenger_id, '_', 1)) AS family_size,
       CASE WHEN COUNT(*) OVER (PARTITION BY split_part(passenger_id, '_', 1)) = 1 THEN 1 ELSE 0 END AS alone
FROM fx_pax"""


def b24_profile(spark, sf):
    return profile.column_profile(_pax(spark, sf)).select(
        "column", F.col("non_null").cast("long").alias("non_null"),
        F.col("rows").cast("long").alias("rows"))


Q["b24_profile"] = b24_profile
_PAX_COLS = ["row_id", "passenger_id", "home_planet", "cabin", "age", "room_service", "spa",
             "name", "raw_number", "all_null", "transported"]
SQL["b24_profile"] = cte("fx_pax") + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", CAST(COUNT({c}) AS BIGINT) AS non_null, "
    f"CAST(COUNT(*) AS BIGINT) AS \"rows\" FROM fx_pax" for c in _PAX_COLS)


def e10_null_counts(spark, sf):
    return profile.null_counts(_pax(spark, sf)).select(
        "column", F.col("null_count").cast("long").alias("null_count"))


Q["e10_null_counts"] = e10_null_counts
SQL["e10_null_counts"] = cte("fx_pax") + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", CAST(COUNT(*) - COUNT({c}) AS BIGINT) AS null_count FROM fx_pax"
    for c in _PAX_COLS)


def e7_distinct_counts(spark, sf):
    s = fixture(spark, sf, "fx_sched")
    return profile.distinct_counts(s, ["cpt_code", "or_suite", "encounter_id"], by="day")


Q["e7_distinct_counts"] = e7_distinct_counts
SQL["e7_distinct_counts"] = cte("fx_sched") + """
SELECT day, COUNT(DISTINCT cpt_code) AS n_cpt_code, COUNT(DISTINCT or_suite) AS n_or_suite,
       COUNT(DISTINCT encounter_id) AS n_encounter_id FROM fx_sched GROUP BY day"""

_NUM = ["x1", "x2", "x3", "x4"]


def e9_describe(spark, sf):
    d = profile.describe(fixture(spark, sf, "fx_num"), _NUM)
    return d.select("column", F.col("count").cast("long").alias("count"),
                    *[F.round(c, 4).alias(c) for c in ["mean", "std", "min", "q25", "q50", "q75", "max"]])


Q["e9_describe"] = e9_describe
SQL["e9_describe"] = cte("fx_num") + " UNION ALL ".join(f"""
SELECT '{c}' AS "column", CAST(COUNT({c}) AS BIGINT) AS count, ROUND(AVG({c}), 4) AS mean,
       ROUND(STDDEV_SAMP({c}), 4) AS std, ROUND(MIN({c}), 4) AS min,
       ROUND(QUANTILE_CONT({c}, 0.25), 4) AS q25, ROUND(QUANTILE_CONT({c}, 0.5), 4) AS q50,
       ROUND(QUANTILE_CONT({c}, 0.75), 4) AS q75, ROUND(MAX({c}), 4) AS max FROM fx_num""" for c in _NUM)


def e11_corr(spark, sf):
    m = profile.corr_matrix(fixture(spark, sf, "fx_num"), _NUM + ["label"])
    return m.select("col_a", "col_b", F.round("corr", 6).alias("corr"))


Q["e11_corr"] = e11_corr
SQL["e11_corr"] = cte("fx_num") + " UNION ALL ".join(
    f"SELECT '{a}' AS col_a, '{b}' AS col_b, ROUND(CORR({a}, {b}), 6) AS corr FROM fx_num"
    for a in _NUM + ["label"] for b in _NUM + ["label"])


def e12_value_counts(spark, sf):
    return profile.value_counts(_pax(spark, sf), "home_planet").select(
        "value", F.col("count").cast("long").alias("count"))


Q["e12_value_counts"] = e12_value_counts
SQL["e12_value_counts"] = cte("fx_pax") + \
    "SELECT home_planet AS value, CAST(COUNT(*) AS BIGINT) AS count FROM fx_pax GROUP BY home_planet"


def e14_histogram(spark, sf):
    h = profile.histogram(fixture(spark, sf, "fx_num"), "x1", 5)
    return h.select(F.col("bin").cast("long").alias("bin"), F.round("lower", 4).alias("lower"),
                    F.round("upper", 4).alias("upper"), F.col("count").cast("long").alias("count"))


Q["e14_histogram"] = e14_histogram
SQL["e14_histogram"] = cte("fx_num") + """,
mm AS (SELECT MIN(x1) AS lo, MAX(x1) AS hi, (MAX(x1) - MIN(x1)) / 5.0 AS w FROM fx_num),
b AS (SELECT CAST(LEAST(FLOOR((x1 - lo) / w), 4) AS BIGINT) AS bin, lo, w FROM fx_num, mm
      WHERE x1 IS NOT NULL)
SELECT bin, ROUND(ANY_VALUE(lo) + bin * ANY_VALUE(w), 4) AS lower,
       ROUND(ANY_VALUE(lo) + (bin + 1) * ANY_VALUE(w), 4) AS upper, CAST(COUNT(*) AS BIGINT) AS count
FROM b GROUP BY bin"""


def e14_min_max_median(spark, sf):
    m = profile.min_max_median(fixture(spark, sf, "fx_num"), "x1")
    return m.select(*[F.round(c, 6).alias(c) for c in ["min", "median", "max"]])


Q["e14_min_max_median"] = e14_min_max_median
SQL["e14_min_max_median"] = cte("fx_num") + """
SELECT ROUND(MIN(x1), 6) AS min, ROUND(MEDIAN(x1), 6) AS median, ROUND(MAX(x1), 6) AS max FROM fx_num"""


def c7_dropna(spark, sf):
    return clean.drop_null_rows(_pax(spark, sf), ["age", "cabin"]).select("row_id", "age", "cabin")


Q["c7_dropna"] = c7_dropna
SQL["c7_dropna"] = cte("fx_pax") + \
    "SELECT row_id, age, cabin FROM fx_pax WHERE age IS NOT NULL AND cabin IS NOT NULL"
