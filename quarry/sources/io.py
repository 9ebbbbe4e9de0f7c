"""Readers, writers and model persistence.

Scratch output goes under the cluster's shared checkpoint folder (never a
machine-local temp directory), so files written by one executor are
readable by every other.
"""
from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.session import ensure_checkpoint_dir


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/scratch/{name}-{uuid.uuid4().hex}"


def all_string_schema(columns) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in columns])


def read_csv(spark: SparkSession, path: str, schema: T.StructType | None = None,
             columns=None, sep: str = ",", header: bool = True,
             infer: bool = False, sampling: float = 1.0) -> DataFrame:
    """CSV with header.  With ``schema`` the types are applied by the reader
    (A2, A3); with only ``columns`` every column is read as string (A1);
    with ``infer`` the reader finds the types in a first pass over the share
    ``sampling`` of the rows (A2)."""
    r = spark.read.option("header", header).option("sep", sep)
    if schema is None and columns is not None:
        schema = all_string_schema(columns)
    if schema is not None:
        r = r.schema(schema)
    elif infer:
        r = r.option("inferSchema", True).option("samplingRatio", sampling)
    return r.csv(path)


def typed(df: DataFrame, types: dict) -> DataFrame:
    """Lenient casts of string columns (bad values become null)."""
    return df.select(*[F.col(c).try_cast(types[c]).alias(c) if c in types else F.col(c)
                       for c in df.columns])


def write_csv(df: DataFrame, path: str, sep: str = ",", header: bool = True) -> str:
    """CSV sink with header, no index column (A5)."""
    df.write.mode("overwrite").option("header", header).option("sep", sep).csv(path)
    return path


def write_points(df: DataFrame, path: str, cols) -> str:
    """Space-separated, header-less text lines (the input format of A4)."""
    line = F.concat_ws(" ", *[F.col(c).cast("string") for c in cols])
    df.select(line.alias("value")).write.mode("overwrite").text(path)
    return path


def read_points(spark: SparkSession, path: str, names, types) -> DataFrame:
    """Header-less text split on any whitespace; columns named and cast (A4)."""
    parts = F.split(F.trim(F.col("value")), r"\s+")
    raw = spark.read.text(path).where(F.trim(F.col("value")) != "")
    return raw.select(*[F.try_element_at(parts, F.lit(i + 1)).try_cast(t).alias(n)
                        for i, (n, t) in enumerate(zip(names, types))])


def submission(df: DataFrame, id_col: str, pred_col: str, out_col: str = "prediction",
               as_bool: bool = True) -> DataFrame:
    """Id carried through scoring + prediction (cast to boolean)."""
    p = F.col(pred_col).cast("boolean") if as_bool else F.col(pred_col)
    return df.select(id_col, p.alias(out_col))


def save_model(model, path: str) -> str:
    model.write().overwrite().save(path)
    return path


def load_pipeline_model(path: str):
    from pyspark.ml import PipelineModel
    return PipelineModel.load(path)
