"""Incremental event-log summary over a file stream (E1 on Structured Streaming)."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from quarry.operators import events as ev


def event_summary_stream(spark: SparkSession, path: str, schema: T.StructType,
                         entity: str = "document", date: str = "change_date",
                         fmt: str = "parquet", max_files_per_trigger: int | None = None) -> DataFrame:
    """Streaming DataFrame of per-entity (first_event_date, last_resolve_date,
    event_count), kept up to date as files arrive in ``path``.  Write it with
    ``outputMode('update')`` (or 'complete') and a checkpointLocation in the
    shared folder so the state survives restarts and lost executors."""
    r = spark.readStream.format(fmt).schema(schema)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return ev.event_summary(r.load(path), entity=entity, date=date)
