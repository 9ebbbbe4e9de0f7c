"""Registered queries: sources and sinks."""
from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import features as FE
from quarry.plans.fixtures import cte, fixture
from quarry.sources import io

Q, SQL = {}, {}


def a1_a5_csv_roundtrip(spark, sf):
    c = spark.read.parquet(f"{sf}/customer.parquet")
    path = io.write_csv(c, io.scratch_path(spark, "customer-csv"))
    raw = io.read_csv(spark, path, columns=c.columns)           # every column string
    return io.typed(raw, {"c_custkey": "bigint", "c_nationkey": "int", "c_acctbal": "double"})


Q["a1_a5_csv_roundtrip"] = a1_a5_csv_roundtrip
SQL["a1_a5_csv_roundtrip"] = "SELECT * FROM customer"


def a2_a3_semicolon_typed(spark, sf):
    o = spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", "o_custkey", "o_totalprice",
                                                          "o_orderstatus")
    path = io.write_csv(o, io.scratch_path(spark, "orders-semicolon"), sep=";")
    return io.read_csv(spark, path, schema=o.schema, sep=";")


Q["a2_a3_semicolon_typed"] = a2_a3_semicolon_typed
SQL["a2_a3_semicolon_typed"] = "SELECT o_orderkey, o_custkey, o_totalprice, o_orderstatus FROM orders"


def a2_inferred(spark, sf):
    o = spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", "o_totalprice", "o_orderstatus")
    path = io.write_csv(o, io.scratch_path(spark, "orders-inferred"))
    c = io.read_csv(spark, path, infer=True)
    return c.select(F.col("o_orderkey").cast("bigint").alias("o_orderkey"), "o_totalprice", "o_orderstatus")


Q["a2_inferred"] = a2_inferred
SQL["a2_inferred"] = "SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders"


def a4_points(spark, sf):
    n = fixture(spark, sf, "fx_num")
    path = io.write_points(n, io.scratch_path(spark, "points"), ["x1", "x3", "label"])
    return io.read_points(spark, path, ["x1", "x2", "y"], ["double", "double", "int"])


Q["a4_points"] = a4_points
SQL["a4_points"] = cte("fx_num") + "SELECT x1, x3 AS x2, label AS y FROM fx_num"


def a7_submission(spark, sf):
    p = fixture(spark, sf, "fx_pax").withColumn(
        "pred", (F.col("row_id") % 2 == 0).cast("int"))
    sub = io.submission(p, "passenger_id", "pred", "transported")
    path = io.write_csv(sub, io.scratch_path(spark, "submission"))
    return io.read_csv(spark, path, schema=sub.schema)


Q["a7_submission"] = a7_submission
SQL["a7_submission"] = cte("fx_pax") + \
    "SELECT passenger_id, row_id % 2 = 0 AS transported FROM fx_pax"


def a8_model_roundtrip(spark, sf):
    m = fixture(spark, sf, "fx_main").withColumn("numeric_feature", F.col("numeric_feature").cast("double"))
    model = FE.preprocess_pipeline().fit(m)
    path = io.save_model(model, io.scratch_path(spark, "pipeline"))
    again = io.load_pipeline_model(path)
    from quarry.functions.columns import vec_item
    a = model.transform(m).select("id", vec_item("scaled_numeric_feature").alias("before"))
    b = again.transform(m).select("id", vec_item("scaled_numeric_feature").alias("after"))
    return a.join(b, "id").select("id", (F.abs(F.col("before") - F.col("after")) < 1e-12)
                                  .cast("int").alias("same"))


Q["a8_model_roundtrip"] = a8_model_roundtrip
SQL["a8_model_roundtrip"] = cte("fx_main") + "SELECT id, 1 AS same FROM fx_main"
