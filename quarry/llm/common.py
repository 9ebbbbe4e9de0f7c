"""Helpers shared by the operators of this subpackage."""
from __future__ import annotations

import atexit
import functools
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.session import ensure_checkpoint_dir, ship_package

#: ASCII letters lower-cased, every byte outside 0-9, a-z and 0x80-0xFF a blank.
WORD_TABLE = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32
    for c in range(256))

#: The same two word classes as Java / RE2 patterns.
WORD_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Words whose codes a task remembers at a time; beyond it the memory is cleared and filled anew.
WORD_CACHE = 100_000
#: Size of the batches that go to Python, unless the session names its own: texts may be long.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": "8m"}


def prepared(fn):
    """``fn(spark, ...)`` with the package on the workers and small batches to Python."""
    @functools.wraps(fn)
    def run(spark, *args, **kwargs):
        ship_package(spark)
        for key, value in BATCHES.items():
            if spark.conf.get(key, None) is None:
                spark.conf.set(key, value)
        return fn(spark, *args, **kwargs)
    return run


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def alnum_words(raw: bytes) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of a UTF-8 text, A-Z lower-cased."""
    return raw.translate(WORD_TABLE).split()


def space_words(raw: bytes) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a UTF-8 text, A-Z lower-cased."""
    return raw.lower().split()


def utf8(col: str | Column) -> Column:
    """A text column as UTF-8 bytes for Arrow (no decoding in Python); null stays null."""
    return (F.col(col) if isinstance(col, str) else col).cast("string").cast("binary")


def ascii_lower(col: Column) -> Column:
    return F.translate(col, UPPER, LOWER)


_SCRATCH: dict[str, str] = {}


def scratch_dir(spark: SparkSession) -> str:
    """This application's folder inside the shared checkpoint folder; removed at exit."""
    app = spark.sparkContext.applicationId
    if app not in _SCRATCH:
        _SCRATCH[app] = f"{ensure_checkpoint_dir(spark).rstrip('/')}/quarry-llm-{app}-{uuid.uuid4().hex[:8]}"
        atexit.register(_remove, spark, _SCRATCH[app])
    return _SCRATCH[app]


def _remove(spark: SparkSession, path: str) -> None:
    sc = spark.sparkContext
    if sc._jsc is None or sc._jsc.sc().isStopped():
        return
    p = sc._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write ``df`` as Parquet into the shared scratch folder and read it back."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex[:8]}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def crc_mod(col: str | Column, modulus: int) -> Column:
    """``crc32(id as text) mod modulus``; a null id counts as the empty string."""
    c = F.col(col) if isinstance(col, str) else col
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % modulus
