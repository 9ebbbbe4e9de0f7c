"""Nearest neighbours, graphs on them, SMOTE.

Exact kNN puts base rows in cells around pivots: a cell goes only to blocks of queries
for which a bound allows one of the k nearest.  A block is a task that keeps its queries'
k nearest while base rows pass by in chunks.  Ties are broken by the neighbour id, so
results are deterministic.
"""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.columns import hash_int, hash_unit
from quarry.plans.blocks import as_matrix, distances_of, n_blocks, pair_distances, pair_squares, rows_a_block, same_ids
from quarry.plans.ranking import row_number
from quarry.session import cut_lineage, ship_package


def _local_topk(qid, qm, bid, bm, reach, k: int, exclude_self: bool):
    """Rows (query place, base place, distance) of the k nearest of each query within ``reach``, in order.
    A matrix product names the pairs that may belong to them, their distances come from differences."""
    kk = min(k, len(bid))
    found = []
    for s, d, slack in pair_squares(qm, bm):
        own = qid[s:s + len(d)]
        if exclude_self:
            d[same_ids(own, bid)] = np.inf
        limit = reach[s:s + len(d)] ** 2 * (1 + 1e-12) + 2 * slack
        open_ = ~np.isfinite(limit)
        if open_.any():
            kth = np.partition(d[open_], kk - 1, axis=1)[:, kk - 1]
            limit[open_] = np.where(np.isnan(kth), np.inf, kth) + 2 * slack[open_]
        with np.errstate(invalid="ignore"):
            i, j = np.nonzero(d <= limit[:, None])
        if exclude_self:
            other = own[i] != bid[j]
            i, j = i[other], j[other]
        # per row: order by (distance, neighbour id), keep the first k
        dist = distances_of(qm[s:s + len(d)], bm, i, j)
        i, j, dist = (v[np.isfinite(dist)] for v in (i, j, dist))
        order = np.lexsort((bid[j], dist, i))
        i, j, dist = i[order], j[order], dist[order]
        keep = np.arange(len(i)) - np.searchsorted(i, i) < kk
        found.append((s + i[keep], j[keep], dist[keep]))
    return tuple(np.concatenate(v) for v in zip(*found))


def _topk_kernel(k: int, exclude_self: bool):
    """Local top-k of each query row (within ``reach``, where known)."""
    def fn(q: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if len(q) == 0 or len(b) == 0:
            return pd.DataFrame({"src": pd.Series([], dtype="int64"),
                                 "dst": pd.Series([], dtype="int64"),
                                 "dist": pd.Series([], dtype="float64")})
        qid = q["qid"].to_numpy(dtype=np.int64)
        bid = b["bid"].to_numpy(dtype=np.int64)
        reach = q["reach"].fillna(np.inf).to_numpy(float) if "reach" in q else np.full(len(q), np.inf)
        i, j, dist = _local_topk(qid, as_matrix(q["qv"]), bid, as_matrix(b["bv"]), reach, k, exclude_self)
        return pd.DataFrame({"src": qid[i], "dst": bid[j], "dist": dist})
    return fn


class _Chunk:
    """Base rows ready for products: less ``centre``, transposed, their squares as a last row."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, centre: np.ndarray):
        sound = np.isfinite(rows).all(1)                    # others are no one's neighbours
        self.ids, self.rows = ids[sound], rows[sound]
        with np.errstate(over="ignore", invalid="ignore"):
            self.moved = self.rows - centre
            self.squares = np.einsum("ij,ij->i", self.moved, self.moved)
            self.top, self.plain_top = self.squares.max(initial=0.0), np.einsum("ij,ij->i", self.rows, self.rows).max(initial=0.0)
        self._sides = {}

    def side(self, kind) -> np.ndarray:
        if kind not in self._sides:
            self._sides[kind] = np.vstack([self.moved.T, self.squares]).astype(kind)
        return self._sides[kind]


class _Nearest:
    """The k nearest of some queries among the chunks of base rows offered so far.

    A product in single precision, whose error ``slack`` bounds, names the pairs that may be as near as
    the k-th so far; their distances come from differences.  Where it names too many (rows that lie close
    together far from the centre) the product is made in doubles."""

    TILE = 1 << 21          # pairs of a product held at a time

    def __init__(self, ids: np.ndarray, rows: np.ndarray, centre: np.ndarray, k: int, exclude_self: bool):
        self.ids, self.rows, self.k, self.exclude_self, self.kind = ids, rows, k, exclude_self, np.float32
        self.sound = np.isfinite(rows).all(1)
        with np.errstate(over="ignore", invalid="ignore"):
            moved = rows - centre
            self.squares, self.plain = np.einsum("ij,ij->i", moved, moved), np.einsum("ij,ij->i", rows, rows)
        self.factor = np.hstack([-2.0 * moved, np.ones((len(rows), 1))])
        self.kth, self.last = np.full(len(rows), np.inf), np.full(len(rows), np.iinfo(np.int64).max)
        self.found, self.waiting, self.n_waiting = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)), [], 0

    def add(self, i: np.ndarray, ids: np.ndarray, dist: np.ndarray) -> None:
        self.waiting.append((i, ids, dist))
        self.n_waiting += len(i)

    def settle(self) -> None:
        """Of what waits and was found before, the k first of each query by (distance, id)."""
        i, ids, dist = (np.concatenate(v) for v in zip(self.found, *self.waiting))
        order = np.lexsort((ids, dist, i))
        i, ids, dist = i[order], ids[order], dist[order]
        keep = np.arange(len(i)) - np.searchsorted(i, i) < self.k
        self.found, self.waiting, self.n_waiting = (i[keep], ids[keep], dist[keep]), [], 0
        many = np.bincount(self.found[0], minlength=len(self.ids))
        full = many >= self.k
        end = (np.cumsum(many) - 1)[full]
        self.kth[full], self.last[full] = self.found[2][end], self.found[1][end]

    def offer(self, who: np.ndarray, chunk: _Chunk) -> None:
        """Compare the queries at places ``who`` with a chunk."""
        who = who[self.sound[who]]
        if not len(who) or not len(chunk.ids):
            return
        large = not max(self.plain[who].max(), chunk.plain_top) < 1e300
        first = who if large else who[np.isinf(self.kth[who])]
        if len(first):
            i, j, dist = _local_topk(self.ids[first], self.rows[first], chunk.ids, chunk.rows, self.kth[first], self.k, self.exclude_self)
            self.add(first[i], chunk.ids[j], dist)
            self.settle()
        if large:
            return
        who = who[~np.isin(who, first)] if len(first) else who
        step = max(1, self.TILE // len(chunk.ids))
        for s in range(0, len(who), step):
            self._compare(who[s:s + step], chunk)

    def _compare(self, who: np.ndarray, chunk: _Chunk) -> None:
        kind = self.kind if max(self.squares[who].max(), chunk.top) < 1e30 else np.float64
        d = self.rows.shape[1]
        slack = 8 * (d + 8) * (np.finfo(kind).eps * (self.squares[who] + chunk.top) + np.finfo(float).eps * (self.plain[who] + chunk.plain_top))
        limit = self.kth[who] ** 2 * (1 + 1e-12) + 2 * slack - self.squares[who]
        limit = np.nextafter(limit.astype(kind), kind(np.inf))
        near = self.factor[who].astype(kind) @ chunk.side(kind) <= limit[:, None]
        i, j = np.divmod(np.flatnonzero(near), len(chunk.ids))
        if self.exclude_self:
            other = self.ids[who[i]] != chunk.ids[j]
            i, j = i[other], j[other]
        dist, i = distances_of(self.rows, chunk.rows, who[i], j), who[i]
        kept = (dist < self.kth[i]) | ((dist == self.kth[i]) & (chunk.ids[j] <= self.last[i]))
        if len(kept) > 64 * len(who) and kept.sum() < len(kept) // 8:
            self.kind = np.float64
        self.add(i[kept], chunk.ids[j[kept]], dist[kept])
        if self.n_waiting > max(len(self.ids) * self.k, 1 << 16):
            self.settle()


def _pivot_distances(v: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distances of rows to pivots, in slices of bounded memory."""
    if not len(v):
        return np.zeros((0, len(pivots)))
    return np.concatenate([d for _, d in pair_distances(v, pivots)])


class Bounds:
    """What is known of each cell: its pivot, its size, its smallest and largest distance to the pivot
    (a few numbers a pivot, whatever the data)."""

    def __init__(self, pivots: np.ndarray):
        self.pivots = pivots
        self.size, self.low, self.high = np.zeros(len(pivots), np.int64), np.full(len(pivots), np.inf), np.full(len(pivots), -np.inf)
        self._apart = None

    def apart(self) -> np.ndarray:
        """Distances between pivots, worked out once a task."""
        if self._apart is None:
            self._apart = _pivot_distances(self.pivots, self.pivots)
        return self._apart

    def home(self, d: np.ndarray, k: int) -> np.ndarray:
        """Cells that hold ``k`` rows together, nearest pivots first: (rows, cells) of truth values."""
        order = np.argsort(d, axis=1, kind="stable")
        before = np.cumsum(self.size[order], axis=1) - self.size[order]
        out = np.zeros(d.shape, bool)
        np.put_along_axis(out, order, before < k, axis=1)
        return out & (self.size > 0)

    def within(self, d: np.ndarray, reach: np.ndarray) -> np.ndarray:
        """Cells that may hold a row at distance ``reach`` or less, by rings and bisecting planes."""
        gap = np.maximum(d - self.high, self.low - d)
        own = d.argmin(1)
        between = self.apart()[own]
        with np.errstate(divide="ignore", invalid="ignore"):
            plane = np.where(between > 0, (d * d - (d[np.arange(len(d)), own] ** 2)[:, None]) / (2 * between), 0.0)
        slack = 1e-9 * (1 + d + np.where(np.isfinite(reach), reach, 0.0)[:, None])         # rounding of distances and bounds
        return (np.maximum(gap, plane) <= reach[:, None] + slack) & (self.size > 0)


SLICE = 1 << 16         # rows times cells that a task works on, or sends, at a time


def _slices(batches, rows: int):
    for pdf in batches:
        for s in range(0, len(pdf), max(1, rows)):
            yield pdf.iloc[s:s + max(1, rows)].reset_index(drop=True)


class Cells:
    """Base rows by their nearest pivot.

    Pivots are base rows drawn by hash, about one per ``block_rows`` rows and ``MAX_PIVOTS`` at
    most.  Cells of more than ``block_rows`` rows are cut into chunks by hash."""

    MAX_PIVOTS = 4096

    def __init__(self, base: DataFrame, n: int, block_rows: int):
        n_pivots = max(1, min(-(-n // block_rows), self.MAX_PIVOTS))
        drawn = base.withColumn("_h", hash_int("bid", "pivot")).orderBy("_h", "bid").limit(n_pivots if n_pivots > 1 else 0)
        pivots = as_matrix(drawn.select("bv").toPandas()["bv"])
        pivots = pivots[np.isfinite(pivots).all(1)]
        bounds = self.bounds = Bounds(pivots)
        self.block_rows, self.many = block_rows, len(pivots) > 1
        if not self.many:
            self.rows, self.chunks = base.withColumn("cell", F.lit(0)).withColumn("_c", hash_int("bid", "chunk")), np.array([max(1, -(-n // block_rows))])
            return

        def assign(batches):
            for part in _slices(batches, SLICE // len(pivots)):
                d = _pivot_distances(as_matrix(part["bv"]), pivots)
                d[np.isnan(d)] = np.inf
                cell = d.argmin(1)
                yield part.assign(cell=cell.astype(np.int32), d=d[np.arange(len(d)), cell])
        kind = base.schema["bv"].dataType.simpleString()
        placed = cut_lineage(base.mapInPandas(assign, f"bid long, bv {kind}, cell int, d double"))
        for r in placed.groupBy("cell").agg(F.count("*").alias("n"), F.min("d").alias("lo"), F.max("d").alias("hi")).collect():
            bounds.size[r["cell"]], bounds.low[r["cell"]], bounds.high[r["cell"]] = r["n"], r["lo"], r["hi"]
        self.chunks = np.maximum(1, -(-bounds.size // block_rows))
        self.rows = placed.drop("d").withColumn("_c", hash_int("bid", "chunk"))


def _parts(queries: DataFrame, cells: Cells) -> np.ndarray:
    """Blocks of queries around each pivot (a number a pivot)."""
    pivots = cells.bounds.pivots

    def own(batches):
        for part in _slices(batches, SLICE // len(pivots)):
            yield pd.DataFrame({"own": _pivot_distances(as_matrix(part["qv"]), pivots).argmin(1).astype(np.int32)})
    parts = np.ones(len(pivots), np.int64)
    for r in queries.select("qv").mapInPandas(own, "own int").groupBy("own").count().collect():
        parts[r["own"]] = -(-r["count"] // cells.block_rows)
    return parts


def _sent(queries: DataFrame, cells: Cells, choose, parts: np.ndarray | None = None, along=("qid", "qv", "reach")) -> DataFrame:
    """(qid, qv, and reach if given, block, cell), of these only ``along``: queries with each cell that ``choose(distances, batch)`` names.
    Near queries share a block: it is the nearest pivot, cut by hash into ``parts``."""
    pivots = cells.bounds.pivots
    parts = _parts(queries, cells) if parts is None else parts
    held, read = ([c for c in names if c in queries.columns] for names in (along, ("qid", "qv", "reach")))

    def run(batches):
        for part in _slices(batches, SLICE // len(pivots)):
            d = _pivot_distances(as_matrix(part["qv"]), pivots)
            who, cell = np.nonzero(choose(d, part))
            yield part[held].iloc[who].assign(own=d.argmin(1)[who].astype(np.int32), cell=cell.astype(np.int32))
    kinds = ", ".join(f"{c} {queries.schema[c].dataType.simpleString()}" for c in held)
    sent = queries.select(*read).mapInPandas(run, f"{kinds}, own int, cell int")
    cut = F.element_at(F.array(*map(F.lit, parts.tolist())), F.col("own") + 1)
    return sent.select(*held, F.struct("own", F.pmod(hash_int("qid", "part"), cut).cast("int").alias("part")).alias("block"), "cell")


def _met(sent: DataFrame, cells: Cells):
    """Both sides of the search by (block, cell, chunk): base rows go only where a query was sent."""
    chunks = F.array(*map(F.lit, cells.chunks.tolist()))
    cut = F.element_at(chunks, F.col("cell") + 1)
    keys = sent.select(F.col("block").alias("to"), F.col("cell").alias("at")).distinct()
    held = (cells.rows.withColumn("chunk", F.pmod(F.col("_c"), cut).cast("int")).join(keys, F.col("cell") == F.col("at"))
            .select(F.col("to").alias("block"), F.col("at").alias("cell"), "chunk", "bid", "bv"))
    asked = sent.withColumn("chunk", F.explode(F.sequence(F.lit(0), cut.cast("int") - 1)))
    return asked, held


def _candidates(sent: DataFrame, cells: Cells, k: int, exclude_self: bool) -> DataFrame:
    asked, held = _met(sent, cells)
    key = ["block", "cell", "chunk"]
    return asked.groupBy(*key).cogroup(held.groupBy(*key)).applyInPandas(_topk_kernel(k, exclude_self), "src long, dst long, dist double")


CHUNK_ROWS, QUERY_ROWS = 8192, 2048     # base rows compared at a time; queries that keep their neighbours together
PACK_ROWS, PACKS_HELD = 1024, 1 << 16   # base rows of a cell that move together; rows that a task holds to pack them


def _matrix(column) -> np.ndarray:
    """Rows of an Arrow list column."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    return flat.reshape(len(column), -1)


def _stretches(batches):
    """Rows of Arrow batches, cut where ``at`` changes."""
    for batch in batches:
        at = batch.column("at").to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(at)) + 1).tolist(), len(at)]
        for s, e in zip(cuts, cuts[1:]):
            if e > s:
                yield int(at[s]), batch.slice(s, e - s)


def _packed(cells: Cells) -> DataFrame:
    """(cell, bids, rows): base rows of a cell as matrices, for they move to many blocks."""
    import pyarrow as pa
    kind = np.float32 if cells.rows.schema["bv"].dataType.simpleString() == "array<float>" else np.float64

    def run(batches):
        held, n = [], 0

        def packs():
            ids, rows, cell = (np.concatenate(x) for x in zip(*held))
            order = np.argsort(cell, kind="stable")
            ends = np.flatnonzero(np.diff(cell[order])) + 1
            for own in np.split(order, ends):
                for s in range(0, len(own), PACK_ROWS):
                    some = own[s:s + PACK_ROWS]
                    yield pa.RecordBatch.from_arrays([pa.array([cell[some[0]]], pa.int32()), pa.array([ids[some].tobytes()], pa.binary()),
                                                      pa.array([rows[some].astype(kind).tobytes()], pa.binary())], ["cell", "bids", "rows"])
        for batch in batches:
            held.append((batch.column("bid").to_numpy(), _matrix(batch.column("bv")), batch.column("cell").to_numpy()))
            n += batch.num_rows
            if n >= PACKS_HELD:
                yield from packs()
                held, n = [], 0
        if n:
            yield from packs()
    return cut_lineage(cells.rows.select("bid", "bv", "cell").mapInArrow(run, "cell int, bids binary, rows binary"))


def _scan(cells: Cells, kind, choose, k: int, exclude_self: bool):
    """A task's pass: a block of queries, then the base rows of the cells it asked for, one cell after the other.
    Queries, their k nearest and one chunk are all it holds."""
    import pyarrow as pa
    bounds, stride = cells.bounds, len(cells.bounds.pivots) + 1
    centre = bounds.pivots.mean(0)

    def begun(rows):
        block = pa.Table.from_batches(rows).combine_chunks()
        out = []
        for s in range(0, block.num_rows, QUERY_ROWS):
            part = block.slice(s, QUERY_ROWS).combine_chunks().to_batches()[0]
            v = _matrix(part.column("v"))
            best = _Nearest(part.column("id").to_numpy(), v, centre, k, exclude_self)
            many = part.column("ids").value_lengths().fill_null(0).to_numpy()
            best.add(np.repeat(np.arange(len(v)), many), part.column("ids").flatten().to_numpy(), part.column("dists").flatten().to_numpy())
            best.settle()
            step = max(1, SLICE // len(bounds.pivots))
            wanted = [choose(_pivot_distances(v[a:a + step], bounds.pivots), best.kth[a:a + step]) for a in range(0, len(v), step)]
            out.append((best, np.concatenate(wanted), part))
        return out

    def offered(block, cell, pieces):
        if pieces:
            ids, rows = (np.concatenate(x) for x in zip(*pieces))
            chunk = _Chunk(ids, rows.astype(float), centre)
            for best, wanted, _ in block:
                best.offer(np.flatnonzero(wanted[:, cell]), chunk)

    def ended(block):
        for best, _, part in block:
            best.settle()
            i, ids, dist = best.found
            ends = pa.array(np.concatenate([[0], np.cumsum(np.bincount(i, minlength=len(best.ids)))]), pa.int32())
            yield pa.RecordBatch.from_arrays([part.column("id"), part.column("v"), part.column("block"), pa.ListArray.from_arrays(ends, pa.array(ids)),
                                              pa.ListArray.from_arrays(ends, pa.array(dist)), pa.array(best.kth)], ["qid", "qv", "block", "ids", "dists", "reach"])

    def run(batches):
        block, asked, pieces, before = [], [], [], 0
        for at, piece in _stretches(batches):
            if at != before:
                offered(block, before % stride - 1, pieces)
                pieces = []
            if at % stride == 0:
                if at != before:
                    yield from ended(begun(asked) if asked else block)
                    block, asked = [], []
                asked.append(piece)
            else:
                if asked:
                    block, asked = begun(asked), []
                for ids, rows in zip(piece.column("bids"), piece.column("rows")):
                    pieces.append((np.frombuffer(ids.as_buffer(), np.int64), np.frombuffer(rows.as_buffer(), kind).reshape(-1, len(centre))))
                    if sum(len(x) for x, _ in pieces) >= CHUNK_ROWS:
                        offered(block, at % stride - 1, pieces)
                        pieces = []
            before = at
        offered(block, before % stride - 1, pieces)
        yield from ended(begun(asked) if asked else block)
    return run


def _searched(asked: DataFrame, cells: Cells, packs: DataFrame, choose, parts: np.ndarray, k: int, exclude_self: bool) -> DataFrame:
    """``asked`` (qid, qv, block, ids, dists, reach) with the k nearest, those of the cells that ``choose(distances, reach)``
    names included.  A block of queries is a task; base rows go to each block that asks for their cell, once."""
    stride, first = len(cells.bounds.pivots) + 1, (np.cumsum(parts) - parts).tolist()
    number = F.element_at(F.array(*map(F.lit, first)), F.col("block.own") + 1) + F.col("block.part")
    keys = (_sent(asked, cells, lambda d, pdf: choose(d, pdf["reach"].fillna(np.inf).to_numpy(float)), parts, along=("qid",))
            .select("cell", number.cast("int").alias("block")).distinct().groupBy("cell").agg(F.collect_list("block").alias("to")))
    at = lambda key: (F.col("block").cast("long") * stride + key).alias("at")
    queries = asked.select("block", at(F.lit(0)), F.col("qid").alias("id"), F.col("qv").alias("v"), "ids", "dists")
    base = packs.join(F.broadcast(keys), "cell").select("cell", "bids", "rows", F.explode("to").alias("block")).select("block", at(F.col("cell") + 1), "bids", "rows")
    dealt = queries.unionByName(base, allowMissingColumns=True).repartitionById(int(parts.sum()), "block").sortWithinPartitions("at")
    kind = asked.schema["qv"].dataType.simpleString()
    scan = _scan(cells, np.float32 if kind == "array<float>" else np.float64, choose, k, exclude_self)
    return dealt.mapInArrow(scan, f"qid long, qv {kind}, block int, ids array<long>, dists array<double>, reach double")


def _numbered(queries: DataFrame, cells: Cells, parts: np.ndarray) -> DataFrame:
    """Queries with the number of their block and no neighbours yet."""
    first = (np.cumsum(parts) - parts).tolist()
    own = F.col("block.own") + 1
    placed = _sent(queries, cells, lambda d, _: np.arange(d.shape[1]) == d.argmin(1)[:, None], parts)
    return placed.select("qid", "qv", (F.element_at(F.array(*map(F.lit, first)), own) + F.col("block.part")).cast("int").alias("block"),
                         F.lit(None).cast("array<long>").alias("ids"), F.lit(None).cast("array<double>").alias("dists"), F.lit(None).cast("double").alias("reach"))


def knn(queries: DataFrame, base: DataFrame | None, k: int, id_col: str, vec: str,
        exclude_self: bool | None = None, block_rows: int | None = None,
        materialize: bool = True) -> DataFrame:
    """Exact k nearest neighbours by Euclidean distance.

    Returns (src, dst, dist, rank) with rank 1..k; with ``base=None`` the
    graph is built over ``queries`` itself and a row never pairs with its own
    id (ids, not positions, decide what "self" is).

    Base rows lie in cells around pivots.  A query first meets the nearest cells that
    hold k rows; its k-th distance there bounds the rest: it is compared with another
    cell only if ring and plane bounds allow a row as near.  Base rows move, packed, only
    to blocks (of about ``block_rows`` queries, by default growing with the root of the rows) that asked for their
    cell; queries move once a pass, with the neighbours found.  Few rows (one cell) are compared directly.  With ``materialize``
    (default) the n·k result is written to the checkpoint folder, so graph operators that read
    it several times do not recompute it.
    """
    ship_package(queries.sparkSession)
    same = base is None
    base = queries if same else base
    if queries.schema[vec].dataType != base.schema[vec].dataType:
        queries, base = (x.withColumn(vec, F.col(vec).cast("array<double>")) for x in (queries, base))    # one kind of rows
    exclude_self = same if exclude_self is None else exclude_self
    n = base.count()
    block_rows = rows_a_block(n) if block_rows is None else block_rows
    q = queries.select(F.col(id_col).cast("long").alias("qid"), F.col(vec).alias("qv"))
    cells = Cells(base.select(F.col(id_col).cast("long").alias("bid"), F.col(vec).alias("bv")), n, block_rows)
    if cells.many:
        need, bounds, parts = k + int(exclude_self), cells.bounds, _parts(q, cells)
        asked = cut_lineage(_numbered(q, cells, parts))
        packs = _packed(cells)
        best = cut_lineage(_searched(asked, cells, packs, lambda d, _: bounds.home(d, need), parts, k, exclude_self))
        found = _searched(best, cells, packs, lambda d, reach: bounds.within(d, reach) & ~bounds.home(d, need), parts, k, exclude_self)
        found = found.select(F.col("qid").alias("src"), F.posexplode(F.arrays_zip("ids", "dists"))).select(
            "src", F.col("col.ids").alias("dst"), F.col("col.dists").alias("dist"), (F.col("pos") + 1).alias("rank"))
        if not asked.groupBy("qid").count().where("count > 1").limit(1).count():       # a query's neighbours are in one place, in order
            return cut_lineage(found) if materialize else found
    else:
        tasks = n_blocks(queries.count(), block_rows, 2 * queries.sparkSession.sparkContext.defaultParallelism)
        block = F.struct(F.lit(0).alias("own"), F.pmod(hash_int("qid", "part"), F.lit(tasks)).cast("int").alias("part"))
        found = _candidates(q.select("qid", "qv", block.alias("block"), F.lit(0).alias("cell")), cells, k, exclude_self)
    w = Window.partitionBy("src").orderBy("dist", "dst")
    out = found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return cut_lineage(out) if materialize else out


def nearest_label(queries: DataFrame, base: DataFrame, id_col: str, vec: str, label: str,
                  exclude_self: bool | None = None) -> DataFrame:
    """1-NN classifier: the label of the nearest base row (K3)."""
    nn = knn(queries, base, 1, id_col, vec, exclude_self)
    labs = (base if base is not None else queries).select(
        F.col(id_col).alias("dst"), F.col(label).alias("predicted"))
    return nn.join(labs, "dst").select(F.col("src").alias(id_col), "dst", "dist", "predicted")


def fold_accuracy(df: DataFrame, id_col: str, vec: str, label: str, fold: str) -> DataFrame:
    """(fold, n, accuracy) of the 1-NN classifier: every fold's rows find their nearest row in the others (K3)."""
    out = None
    for f in [r[0] for r in df.select(fold).distinct().orderBy(fold).collect()]:
        own, rest = df.where(F.col(fold) == f), df.where(F.col(fold) != f)
        p = nearest_label(own, rest, id_col, vec, label, exclude_self=False).join(own.select(id_col, label), id_col)
        part = p.agg(F.lit(f).alias("fold"), F.count(F.lit(1)).alias("n"), F.avg((F.col("predicted") == F.col(label)).cast("double")).alias("accuracy"))
        out = part if out is None else out.unionByName(part)
    return out


def grid_points(spark, low: float, step: float, side: int) -> DataFrame:
    """(point, xy): a square grid of side² points, row by row."""
    at = lambda c: F.lit(low) + c.cast("double") * F.lit(step)
    p = F.col("id")
    return spark.range(side * side).select(p.alias("point"), F.array(at(p % side), at(F.floor(p / side))).alias("xy"))


def aggregate_neighbors(nodes: DataFrame, edges: DataFrame, id_col: str, vec: str,
                        how: str = "mean") -> DataFrame:
    """Neighbourhood aggregation of feature vectors, messages flowing
    src → dst (K17): ``mean`` (SAGE), ``sum`` (GraphConv) or ``gcn``
    (self loops + symmetric degree normalisation 1/sqrt(deg_i·deg_j)).
    Vectors are summed whole with MLlib's (weighted) ``Summarizer`` — one
    partial aggregate per destination, so a hub node is pre-aggregated
    map-side and no per-element rows are created."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer
    feats = nodes.select(F.col(id_col).alias("src"),
                         array_to_vector(F.col(vec).cast("array<double>")).alias("_v"))
    e = edges.select("src", "dst")
    if how == "gcn":
        e = e.unionByName(nodes.select(F.col(id_col).alias("src"), F.col(id_col).alias("dst")))
        # written, so that a join on a hub node can still be split at run time
        deg = cut_lineage(e.groupBy("dst").agg(F.count(F.lit(1)).alias("deg")))
        e = (e.join(deg.select(F.col("dst").alias("src"), F.col("deg").alias("ds")), "src")
             .join(deg.select("dst", F.col("deg").alias("dd")), "dst")
             .withColumn("w", F.lit(1.0) / F.sqrt(F.col("ds") * F.col("dd"))))
    m = e.join(feats, "src")
    if how == "mean":
        agg = Summarizer.mean(F.col("_v"))
    elif how == "sum":
        agg = Summarizer.sum(F.col("_v"))
    elif how == "gcn":
        agg = Summarizer.metrics("sum").summary(F.col("_v"), F.col("w")).getField("sum")
    else:
        raise ValueError(how)
    return m.groupBy("dst").agg(vector_to_array(agg).alias("agg")).select(
        F.col("dst").alias(id_col), "agg")


def drop_edges(edges: DataFrame, p: float = 0.2, salt: str = "drop") -> DataFrame:
    """Keep the edges with src < dst, drop each with probability ``p`` (decided by
    a hash), then make the graph symmetric (K18)."""
    und = edges.where(F.col("src") < F.col("dst")).select(F.col("src").alias("a"), F.col("dst").alias("b")).distinct()
    kept = und.where(hash_unit(F.concat_ws("-", "a", "b"), salt) >= F.lit(p))
    both = F.explode(F.array(F.struct(F.col("a").alias("src"), F.col("b").alias("dst")),
                             F.struct(F.col("b").alias("src"), F.col("a").alias("dst"))))
    return kept.select(both.alias("_e")).select("_e.src", "_e.dst")   # one pass, both directions


def smote(df: DataFrame, id_col: str, vec: str, label: str, minority_value, ratio: float = 0.5,
          k: int = 5, salt: str = "smote") -> DataFrame:
    """Synthetic minority rows until minority = ratio × majority (H6).

    Sample j (0-based) starts from the minority row at hash rank
    ``j mod n_min + 1``, takes its neighbour of rank ``hash(j) mod k + 1``
    among the k nearest minority rows, and interpolates
    ``x + u·(neighbour − x)`` with ``u = hash_unit(j)``.  Returns the input
    rows plus the synthetic ones (``synthetic = 1``, ids continue after the
    largest input id)."""
    spark = df.sparkSession
    mino = df.where(F.col(label) == minority_value)
    n_min = mino.count()
    n_maj = df.where(F.col(label) != minority_value).count()
    n_new = int(ratio * n_maj - n_min)
    base = df.withColumn("synthetic", F.lit(0))
    if n_new <= 0 or n_min == 0:
        return base
    kk = min(k, n_min - 1)
    if kk < 1:
        raise ValueError("SMOTE needs at least two minority rows")
    nb = knn(mino, None, kk, id_col, vec)
    ranked = row_number(mino.select(id_col, vec).withColumn("_h", hash_int(id_col, salt)),
                        ["_h", id_col], out="_r")
    max_id = df.agg(F.max(id_col)).first()[0]
    j = spark.range(n_new).select(F.col("id").alias("j"))
    j = j.select("j", (F.col("j") % n_min + 1).alias("_r"),
                 (F.pmod(hash_int("j", salt + "nb"), F.lit(kk)) + 1).alias("rank"),
                 hash_unit("j", salt + "u").alias("u"))
    s = j.join(ranked.select("_r", F.col(id_col).alias("src"), F.col(vec).alias("x")), "_r")
    s = s.join(nb.select("src", "rank", "dst"), ["src", "rank"])
    s = s.join(mino.select(F.col(id_col).alias("dst"), F.col(vec).alias("y")), "dst")
    wide = lambda c: F.col(c).cast("array<double>")  # noqa: E731 - no rounding to float in between
    new_vec = F.zip_with(wide("x"), wide("y"), lambda a, b: a + F.col("u") * (b - a))
    syn = s.select((F.lit(max_id) + 1 + F.col("j")).alias(id_col), new_vec.alias(vec),
                   F.lit(minority_value).alias(label), F.lit(1).alias("synthetic"))
    out_cols = [id_col, vec, label, "synthetic"]
    return base.select(*out_cols).unionByName(
        syn.select(*[F.col(c).cast(base.schema[c].dataType) for c in out_cols]))
