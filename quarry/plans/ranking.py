"""Exact row numbers and running sums without a single-task window.

``Window.orderBy(...)`` with no ``partitionBy`` moves every row into one
task.  These helpers instead

1. range-partition and sort the rows (``repartitionByRange`` +
   ``sortWithinPartitions``), so partition *i* holds a contiguous key range;
2. compute positions / running sums inside each partition with one
   Arrow-batched ``mapInPandas`` pass (state carried across batches);
3. write that result to the shared checkpoint folder, so partition ids are
   fixed even if executors are lost and stages are recomputed;
4. sum the per-partition totals of the *boundary* groups only (at most two
   groups per partition can span partitions) and broadcast those offsets —
   a table of at most ``2 × partitions`` rows, whatever the data size.

The ordering must be total (include a unique tie-breaker) for results to be
deterministic.
"""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.session import cut_lineage, ship_package

_PID = "_q_pid"


def _local_pass(partition_cols, sum_cols, out_cols):
    """mapInPandas body: per contiguous group run, running count and sums.
    Vectorised per Arrow batch; the running state of the last run is carried
    into the next batch of the same partition."""

    def fn(batches):
        from pyspark import TaskContext

        pid = TaskContext.get().partitionId()
        last_key = None      # key tuple of the last row seen in this partition
        carry = None         # running values of that row's run
        for pdf in batches:
            n = len(pdf)
            if n == 0:
                continue
            if partition_cols:
                kdf = pdf[partition_cols]
                prev = kdf.shift()
                # per column, null == null counts as equal
                diff = (kdf != prev) & ~(kdf.isna() & prev.isna())
                change = diff.any(axis=1).to_numpy()
                first_key = tuple(kdf.iloc[0].tolist())
                change[0] = (last_key is None) or (first_key != last_key)
                last_key = tuple(kdf.iloc[-1].tolist())
            else:
                change = np.zeros(n, dtype=bool)
                change[0] = last_key is None
                last_key = ()
            run = np.cumsum(change)
            cont = not change[0]          # first run continues the previous batch
            vals = {"_q_one": np.ones(n, dtype=np.int64)}
            for c in sum_cols:
                vals[c] = pdf[c].fillna(0).to_numpy()
            res = {}
            for name, v in vals.items():
                cs = pd.Series(v).groupby(run).cumsum().to_numpy()
                if cont and carry is not None:
                    first = run == run[0]
                    cs = cs.astype(np.result_type(cs.dtype, np.asarray(carry[name]).dtype))
                    cs[first] = cs[first] + carry[name]
                res[name] = cs
            carry = {name: res[name][-1] for name in res}
            out = pdf.copy()
            out[_PID] = np.int32(pid)
            out["_q_lpos"] = res["_q_one"]
            for c, oc in zip(sum_cols, out_cols):
                out[oc] = res[c]
            yield out

    return fn


def prefix_sums(df: DataFrame, order_cols, sum_cols=(), partition_cols=(),
                out_cols=None, num_partitions: int | None = None,
                rank_col: str | None = "_rn") -> DataFrame:
    """Running sums (inclusive) of ``sum_cols`` and a 1-based row number,
    ordered by ``order_cols`` within each ``partition_cols`` group.

    ``order_cols`` may be Column expressions (e.g. ``F.desc("score")``);
    ``sum_cols`` must be numeric column names.
    """
    ship_package(df.sparkSession)
    partition_cols = list(partition_cols)
    sum_cols = list(sum_cols)
    out_cols = list(out_cols or [f"cum_{c}" for c in sum_cols])
    keys = [F.col(c) for c in partition_cols] + [F.col(c) if isinstance(c, str) else c
                                                 for c in order_cols]
    # Without an explicit count, AQE sizes the range partitions at run time
    # (coalescing merges only neighbouring ranges, so order is kept).
    ranged = (df.repartitionByRange(num_partitions, *keys) if num_partitions
              else df.repartitionByRange(*keys))
    s = ranged.sortWithinPartitions(*keys)
    fields = list(df.schema.fields) + [T.StructField(_PID, T.IntegerType()),
                                       T.StructField("_q_lpos", T.LongType())]
    for c, oc in zip(sum_cols, out_cols):
        dt = df.schema[c].dataType
        fields.append(T.StructField(oc, T.DoubleType() if isinstance(
            dt, (T.FloatType, T.DoubleType, T.DecimalType)) else T.LongType()))
    local = s.mapInPandas(_local_pass(partition_cols, sum_cols, out_cols),
                          T.StructType(fields))
    local = cut_lineage(local)

    # totals of every (partition, group) run; keep only boundary runs
    tot_exprs = [F.count(F.lit(1)).alias("_q_n")] + [
        F.sum(F.coalesce(F.col(c), F.lit(0))).alias(f"_q_t{i}") for i, c in enumerate(sum_cols)]
    runs = local.groupBy(_PID, *partition_cols).agg(*tot_exprs)
    if partition_cols:
        gkey = F.struct(*partition_cols)
        wp = Window.partitionBy(_PID)
        runs = (runs.withColumn("_q_k", gkey)
                .withColumn("_q_lo", F.min("_q_k").over(wp))
                .withColumn("_q_hi", F.max("_q_k").over(wp))
                .where(F.col("_q_k").eqNullSafe(F.col("_q_lo")) | F.col("_q_k").eqNullSafe(F.col("_q_hi")))
                .drop("_q_k", "_q_lo", "_q_hi"))
    # offsets: totals of the same group in earlier partitions (tiny table)
    wo = (Window.partitionBy(*partition_cols).orderBy(_PID)
          .rowsBetween(Window.unboundedPreceding, -1))
    offs = runs.select(_PID, *partition_cols,
                       F.coalesce(F.sum("_q_n").over(wo), F.lit(0)).alias("_q_on"),
                       *[F.coalesce(F.sum(f"_q_t{i}").over(wo), F.lit(0)).alias(f"_q_o{i}")
                         for i in range(len(sum_cols))])
    # null-safe equality: a null group key is a group like any other
    o = offs.select(*[F.col(c).alias(f"_q_k_{c}") for c in [_PID, *partition_cols]],
                    "_q_on", *[f"_q_o{i}" for i in range(len(sum_cols))])
    cond = [local[c].eqNullSafe(o[f"_q_k_{c}"]) for c in [_PID, *partition_cols]]
    joined = local.join(F.broadcast(o), cond, "left")
    sel = [local[c] for c in df.columns]
    if rank_col:
        sel.append((F.col("_q_lpos") + F.coalesce(F.col("_q_on"), F.lit(0))).cast("long")
                   .alias(rank_col))
    for i, oc in enumerate(out_cols):
        sel.append((F.col(oc) + F.coalesce(F.col(f"_q_o{i}"), F.lit(0))).alias(oc))
    return joined.select(*sel)


def row_number(df: DataFrame, order_cols, partition_cols=(), out: str = "_rn",
               num_partitions: int | None = None) -> DataFrame:
    """Exact 1-based row number per group, distributed (see module doc)."""
    return prefix_sums(df, order_cols, (), partition_cols, rank_col=out,
                       num_partitions=num_partitions)
