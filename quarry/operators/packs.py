"""Documents packed into blocks, terms as numbers, and vectors that belong to terms.

A block holds some whole documents as a sparse matrix over its own distinct
terms.  What a computation knows of a term is a vector in a row of a
distributed table.  A step sends each block the vectors of its terms, works
inside the block and adds the blocks' vectors up by term; blocks are large, so
that a frequent term travels once for many documents.  Where vectors
travel as matrices, one for each block and part of the terms, see :class:`Exchange`.
"""
from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.session import cut_lineage, ensure_checkpoint_dir


def matrix(column: pd.Series) -> np.ndarray:
    """Rows of packed doubles as a matrix."""
    return np.frombuffer(b"".join(column)).reshape(len(column), -1)


#: Shuffle files go when the execution that wrote them ends, not when the JVM next collects garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read from there; what its shuffles left on disk is removed."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def discarded(df: DataFrame) -> None:
    """Deletes the files of a :func:`written` table that nothing reads any more."""
    spark = df.sparkSession
    folders = {f.rsplit("/", 1)[0] for f in df.inputFiles()}
    for folder in folders:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def numbered(terms: DataFrame) -> DataFrame:
    """(term, tid): every distinct term with a number of its own, fixed once."""
    return cut_lineage(cut_lineage(terms.select("term").distinct()).withColumn("tid", F.monotonically_increasing_id()))


#: Bytes of the vectors that a part of the terms sends to all blocks, at most (a term's own are never split).
PART_BYTES = 64 << 20
STATE = "g int, p int, v binary"
PIECES = "g int, block long, p int, spots binary, v binary"
FOUND = "g int, block long, p int, v binary"
_ROUTES = "p int, block long, spots binary, at binary"
ALONE = -1                  # the part of what a block finds beside its terms' vectors


class Exchange:
    """Vectors of terms between the parts that keep them and the blocks that use them.

    ``pairs`` (block, spot, tid) says which terms a block has.  Terms are dealt to parts by a
    hash of their numbers; a part's vectors are one matrix for each group ``g`` of columns, in the order
    of the numbers, and what a part and a block send each other is one matrix too.  The places of a
    block's terms in a part are worked out once."""

    def __init__(self, pairs: DataFrame, width: int):
        spark = pairs.sparkSession
        parts = max(spark.sparkContext.defaultParallelism, -(-pairs.count() * width * 8 // PART_BYTES))
        self._part = F.pmod(F.xxhash64("tid"), F.lit(parts)).cast("int")
        self._tasks = tasks_of(parts)

        def routes(pdf):
            p, block, spot = int(pdf["p"].iat[0]), pdf["block"].to_numpy(), pdf["spot"].to_numpy(np.int32)
            tids, at = np.unique(pdf["tid"].to_numpy(), return_inverse=True)
            order = np.lexsort((spot, block))
            starts = np.flatnonzero(np.append(True, np.diff(block[order]) != 0))
            cut = np.split(order, starts[1:])
            return pd.DataFrame({"p": p, "block": [ALONE, *block[order[starts]]], "spots": [tids.tobytes(), *(spot[o].tobytes() for o in cut)],
                                 "at": [b"", *(at[o].astype(np.int32).tobytes() for o in cut)]})
        self._routes = written(pairs.withColumn("p", self._part).repartition(self._tasks, "p").groupBy("p").applyInPandas(routes, _ROUTES), "routes")

    def _by_part(self, df: DataFrame):
        return df.repartition(self._tasks, "p").groupBy("p")

    def packed(self, rows: DataFrame, columns) -> DataFrame:
        """State of rows (tid, v): for each group the given columns."""
        def run(pdf):
            whole = matrix(pdf.sort_values("tid")["v"])
            return pd.DataFrame({"g": np.arange(len(columns), dtype=np.int32), "p": pdf["p"].iat[0], "v": [whole[:, c].tobytes() for c in columns]})
        return self._by_part(rows.select("tid", "v", self._part.alias("p"))).applyInPandas(run, STATE)

    def sent(self, state: DataFrame) -> DataFrame:
        """What every block needs of the state: (g, block, p, spots, v)."""
        def run(routes, held):
            out = []
            routes = routes[routes["block"] >= 0]
            places = [np.frombuffer(a, np.int32) for a in routes["at"]]
            terms = 1 + max((int(a.max()) for a in places if len(a)), default=-1)
            for g, v in zip(held["g"], held["v"]):
                v = np.frombuffer(v).reshape(terms, -1)
                out.append(pd.DataFrame({"g": np.int32(g), "block": routes["block"], "p": routes["p"], "spots": routes["spots"], "v": [v[a].tobytes() for a in places]}))
            return pd.concat(out) if out else pd.DataFrame({c.split()[0]: [] for c in PIECES.split(", ")})
        return self._by_part(self._routes).cogroup(self._by_part(state)).applyInPandas(run, PIECES)

    def added(self, found: DataFrame, extra=None) -> DataFrame:
        """What the blocks found (g, block, p, v), added up by term in the order of the blocks; ``extra[g]`` is added once
        to each sum.  Part ``ALONE`` holds the sums of what was found beside."""
        def run(routes, got):
            out, got = [], got.sort_values(["g", "block"])
            if len(got) and got["p"].iat[0] == ALONE:
                for g, mine in got.groupby("g"):
                    out.append((g, ALONE, matrix(mine["v"]).sum(0).tobytes()))
                return pd.DataFrame(out, columns=["g", "p", "v"])
            places = {b: np.frombuffer(a, np.int32) for b, a in zip(routes["block"], routes["at"])}
            terms = sum(len(s) // 8 for s in routes.loc[routes["block"] == ALONE, "spots"])
            for g, mine in got.groupby("g"):
                total = None
                for block, v in zip(mine["block"], mine["v"]):
                    v = np.frombuffer(v).reshape(len(places[block]), -1)
                    if total is None:
                        total = np.zeros((terms, v.shape[1])) + (0.0 if extra is None else extra[g])
                    total[places[block]] += v
                out.append((g, routes["p"].iat[0], total.tobytes()))
            return pd.DataFrame(out, columns=["g", "p", "v"])
        return self._by_part(self._routes).cogroup(self._by_part(found)).applyInPandas(run, STATE)

    def rows(self, state: DataFrame, order=None) -> DataFrame:
        """(tid, v): each term's vectors of all groups side by side, columns in ``order``."""
        def run(routes, held):
            tids = np.frombuffer(b"".join(routes["spots"]), np.int64)
            if not len(tids) or not len(held):
                return pd.DataFrame({"tid": [], "v": []})
            whole = np.hstack([np.frombuffer(v).reshape(len(tids), -1) for v in held.sort_values("g")["v"]])
            whole = whole if order is None else whole[:, order]
            return pd.DataFrame({"tid": tids, "v": [row.tobytes() for row in whole]})
        return self._by_part(self._routes.where(F.col("block") == ALONE)).cogroup(self._by_part(state)).applyInPandas(run, "tid long, v binary")


def beside(mine: pd.DataFrame):
    """(vectors of a block's terms by spot, [(part, its spots)]) from the pieces sent to it."""
    parts = [(p, np.frombuffer(s, np.int32)) for p, s in zip(mine["p"], mine["spots"])]
    n = sum(len(s) for _, s in parts)
    out = None
    for (_, spots), v in zip(parts, mine["v"]):
        v = np.frombuffer(v).reshape(len(spots), -1)
        out = np.empty((n, v.shape[1])) if out is None else out
        out[spots] = v
    return out, parts


SUMS = "g int, tid long, v binary"


def summed(parts: DataFrame, extra=None) -> DataFrame:
    """Vectors (g, tid, v) added up by group and term; ``extra[g]`` is added once to each sum."""
    def run(batches):
        last, carry = None, None

        def out(g, tid, sums):
            return pd.DataFrame({"g": np.int32(g), "tid": tid, "v": [s.tobytes() for s in (sums if extra is None else sums + extra[g])]})
        for pdf in batches:
            for g, part in pdf.groupby("g", sort=True):
                tid = part["tid"].to_numpy()
                starts = np.flatnonzero(np.append(True, tid[1:] != tid[:-1]))
                sums, names = np.add.reduceat(matrix(part["v"]), starts, axis=0), tid[starts]
                if last == (g, names[0]):
                    sums[0] += carry
                elif last is not None:
                    yield out(last[0], [last[1]], carry[None])
                last, carry = (g, names[-1]), sums[-1].copy()
                if len(names) > 1:
                    yield out(g, names[:-1], sums[:-1])
        if last is not None:
            yield out(last[0], [last[1]], carry[None])
    return parts.repartition("g", "tid").sortWithinPartitions("g", "tid").mapInPandas(run, SUMS)


def tasks_of(n_blocks: int) -> int:
    """Blocks are heavy and few: one or two a task, whatever their bytes."""
    return max(1, 2 * n_blocks if n_blocks < 1000 else n_blocks)
