"""Registered queries: event pipeline."""
from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import events as ev
from quarry.plans.fixtures import cte, fixture

Q, SQL = {}, {}

_EV = ("table_name = 'TableA' AND field_name = 'TargetEvent' "
       "AND new_value IS NOT NULL AND new_value <> ''")
_RS = ("table_name = 'TableA' AND field_name = 'TargetEvent' "
       "AND old_value IS NOT NULL AND old_value <> '' AND (new_value IS NULL OR new_value = '')")


def c1_code_filter(spark, sf):
    return ev.filter_codes(fixture(spark, sf, "fx_main"), "operation_code", ["code1", "code2"])


Q["c1_code_filter"] = c1_code_filter
SQL["c1_code_filter"] = cte("fx_main") + \
    "SELECT * FROM fx_main WHERE operation_code IN ('code1', 'code2')"


def c2_event_rows(spark, sf):
    log = fixture(spark, sf, "fx_log")
    e, r = ev.event_condition(), ev.resolve_condition()
    return (log.where(e | r)
            .select("document", "change_date",
                    F.when(e, 1).otherwise(0).alias("is_event"),
                    F.when(r, 1).otherwise(0).alias("is_resolve")))


Q["c2_event_rows"] = c2_event_rows
SQL["c2_event_rows"] = cte("fx_log") + f"""
SELECT document, change_date,
       CASE WHEN {_EV} THEN 1 ELSE 0 END AS is_event,
       CASE WHEN {_RS} THEN 1 ELSE 0 END AS is_resolve
FROM fx_log WHERE ({_EV}) OR ({_RS})"""


def c3_date_split(spark, sf):
    main = fixture(spark, sf, "fx_main")
    train, pred = ev.split_by_date(main, "record_date", "2022-01-01")
    return (train.withColumn("side", F.lit("train"))
            .unionByName(pred.withColumn("side", F.lit("predict")))
            .select("id", "record_date", "side"))


Q["c3_date_split"] = c3_date_split
SQL["c3_date_split"] = cte("fx_main") + """
SELECT id, record_date, 'train' AS side FROM fx_main WHERE record_date < DATE '2022-01-01'
UNION ALL
SELECT id, record_date, 'predict' AS side FROM fx_main WHERE record_date >= DATE '2022-01-01'"""


def e1_event_summary(spark, sf):
    return ev.event_summary(fixture(spark, sf, "fx_log"))


Q["e1_event_summary"] = e1_event_summary
SQL["e1_event_summary"] = cte("fx_log") + f"""
SELECT document AS id,
       MIN(CASE WHEN {_EV} THEN change_date END) AS first_event_date,
       MAX(CASE WHEN {_RS} THEN change_date END) AS last_resolve_date,
       CAST(COUNT(CASE WHEN {_EV} THEN 1 END) AS BIGINT) AS event_count
FROM fx_log WHERE ({_EV}) OR ({_RS})
GROUP BY document"""


def d1_details(spark, sf):
    main = ev.filter_codes(fixture(spark, sf, "fx_main"), "operation_code", ["code1", "code2"])
    aux = fixture(spark, sf, "fx_aux")
    summary = ev.event_summary(fixture(spark, sf, "fx_log"))
    return ev.target_flag(ev.details(main, aux, summary))


Q["d1_details"] = d1_details
SQL["d1_details"] = cte("fx_main", "fx_aux", "fx_log") + f""",
summary AS (
  SELECT document AS id,
         MIN(CASE WHEN {_EV} THEN change_date END) AS first_event_date,
         MAX(CASE WHEN {_RS} THEN change_date END) AS last_resolve_date,
         CAST(COUNT(CASE WHEN {_EV} THEN 1 END) AS BIGINT) AS event_count
  FROM fx_log WHERE ({_EV}) OR ({_RS}) GROUP BY document)
SELECT m.*, a.additional_column, s.first_event_date, s.last_resolve_date, s.event_count,
       CASE WHEN s.first_event_date IS NOT NULL THEN 1 ELSE 0 END AS event_flag,
       CASE WHEN s.first_event_date IS NOT NULL AND m.status <> 'Inactive' THEN 1 ELSE 0 END
         AS target_event_flag
FROM fx_main m JOIN fx_aux a ON m.id = a.id LEFT JOIN summary s ON m.id = s.id
WHERE m.operation_code IN ('code1', 'code2')"""


def _match(a, b):
    return ev.match_pct(a, b, "key").select(
        "matched_rows", "matched_left_rows", "left_rows",
        F.round("match_pct", 6).alias("match_pct"),
        F.round("match_pct_distinct", 6).alias("match_pct_distinct"))


def _match_sql(a, ak, b, bk):
    return f"""
WITH j AS (SELECT COUNT(*) AS m FROM {a} x JOIN {b} y ON x.{ak} = y.{bk}),
     s AS (SELECT COUNT(*) AS m FROM {a} x WHERE EXISTS (SELECT 1 FROM {b} y WHERE x.{ak} = y.{bk})),
     t AS (SELECT COUNT(*) AS n FROM {a})
SELECT CAST(j.m AS BIGINT) AS matched_rows, CAST(s.m AS BIGINT) AS matched_left_rows,
       CAST(t.n AS BIGINT) AS left_rows,
       ROUND(j.m * 100.0 / t.n, 6) AS match_pct, ROUND(s.m * 100.0 / t.n, 6) AS match_pct_distinct
FROM j, s, t"""


def d3_match_pct(spark, sf):
    o = spark.read.parquet(f"{sf}/orders.parquet").select(F.col("o_custkey").alias("key"))
    c = spark.read.parquet(f"{sf}/customer.parquet").select(F.col("c_custkey").alias("key"))
    return _match(o, c)


Q["d3_match_pct"] = d3_match_pct
SQL["d3_match_pct"] = _match_sql("orders", "o_custkey", "customer", "c_custkey")


def d3_match_pct_fanout(spark, sf):
    # customer -> orders: duplicate right keys push the rate above 100
    c = spark.read.parquet(f"{sf}/customer.parquet").select(F.col("c_custkey").alias("key"))
    o = spark.read.parquet(f"{sf}/orders.parquet").select(F.col("o_custkey").alias("key"))
    return _match(c, o)


Q["d3_match_pct_fanout"] = d3_match_pct_fanout
SQL["d3_match_pct_fanout"] = _match_sql("customer", "c_custkey", "orders", "o_custkey")
