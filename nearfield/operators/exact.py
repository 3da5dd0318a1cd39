"""Exact k nearest neighbours.

Queries meet base rows in cells: both sides are dealt by hash, replicated over the other side's blocks and
brought together by cell. A side has about the square root of CELLS_A_CORE cells a core as blocks, so that what is
shuffled grows with the rows, until blocks reach MOST_ROWS, the most that a cell takes of either side, or of the rows as many as hold
MOST_COMPONENTS components, if these are more. In a cell matrix
products find the candidates, whose distances are then summed again in double from the first component to the last, so
that values don't depend on the blocking; a cell returns at most the k nearest of a query. A window limit over what the cells return gives the answer.
Equal distances go to the smaller id; with fewer than k rows all are returned.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BASE_ROWS = 4096
QUERY_ROWS = 1024
#: Rows of a cell of the search of all pairs: at most, and so few that a block isn't cut further.
MOST_ROWS = 1 << 15
#: Components of a cell's rows where these may be more than MOST_ROWS.
MOST_COMPONENTS = 1 << 23
LEAST_ROWS = 1024
CELLS_A_CORE = 12
#: Tiles in a cell, the rows that give the first bound, and the pairs whose distances are summed at once.
TILE_QUERIES = 128
TILE_ROWS = 4096
FIRST_ROWS = 4096
MOST_PAIRS = 1 << 16
NEAR = 1e-9


def _exact(metric: str, q: np.ndarray, rows: np.ndarray) -> np.ndarray:
    total = lambda x: np.add.accumulate(x, axis=1)[:, -1]
    if metric == "l2":
        return total((rows - q) * (rows - q))
    if metric == "mips":
        return 0.0 - total(rows * q)
    norms = np.sqrt(total(rows * rows)) * np.sqrt(total((q * q)[None, :]))
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(norms > 0, 0.0 - total(rows * q) / norms, np.inf)


def paired(metric: str, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of the rows of ``a`` to those of ``b`` at the same place, summed as in the exact search."""
    total = lambda x: np.add.accumulate(x, axis=1)[:, -1]
    if metric == "l2":
        return total((b - a) * (b - a))
    if metric == "mips":
        return 0.0 - total(b * a)
    norms = np.sqrt(total(b * b)) * np.sqrt(total(a * a))
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(norms > 0, 0.0 - total(b * a) / norms, np.inf)


def rough(metric: str, q: np.ndarray, rows: np.ndarray) -> np.ndarray:
    dot = q @ rows.T
    if metric == "l2":
        return (q * q).sum(1)[:, None] + (rows * rows).sum(1)[None, :] - 2 * dot
    if metric == "mips":
        return -dot
    norms = np.sqrt((q * q).sum(1))[:, None] * np.sqrt((rows * rows).sum(1))[None, :]
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(norms > 0, -dot / norms, np.inf)


def matrix(table, column: str) -> np.ndarray:
    """The vectors of an Arrow table as rows of a matrix of doubles."""
    return np.array(table.column(column).combine_chunks().flatten(), np.float64).reshape(table.num_rows, -1)


def _singles(metric: str, rows: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``rows`` and ``asked`` in single precision, and for each of ``asked`` twice a bound on what a rough distance to any row is wrong by.

    Vectors are taken relative to the rows' mean for l2, and at length 1 for cosine. Where squares could overflow, doubles stay.
    """
    if metric == "l2":
        middle = rows.mean(axis=0)
        rows, asked = rows - middle, asked - middle
    elif metric == "cosine":
        rows, asked = (x / np.sqrt((x * x).sum(1))[:, None] for x in (rows, asked))
    most, own = (rows * rows).sum(1).max(), (asked * asked).sum(1)
    kind = np.float32 if max(most, own.max()) < 1e36 else np.float64
    far = own + most if metric == "l2" else np.sqrt(own * most)
    return rows.astype(kind), asked.astype(kind), (4 * (rows.shape[1] + 16) * np.finfo(kind).eps * far + 1e-36).astype(kind)


def _cut(at: np.ndarray, i: np.ndarray, d: np.ndarray, k: int, bound: np.ndarray, slack: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The candidates (query, row, rough distance) within the bounds, which are lowered first to the k-th of each query."""
    order = np.lexsort((d, at))
    at, i, d = at[order], i[order], d[order]
    first = np.searchsorted(at, np.arange(len(bound)))
    kth = np.flatnonzero(np.diff(np.append(first, len(at))) >= k)
    bound[kth] = np.minimum(bound[kth], d[first[kth] + k - 1] + slack[kth])
    kept = d <= bound[at]
    return at[kept], i[kept], d[kept]


def nearest(metric: str, ids: np.ndarray, rows: np.ndarray, qids: np.ndarray, asked: np.ndarray, k: int, exclude_self: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(qid, id, dist) of at least the k nearest rows of each query; ties of the k-th come along.

    Tiles of queries by rows are scored roughly, and what lies within a query's bound so far, with room for what rough
    distances are wrong by, is kept. The bound is the k-th of a few rows at first and falls with each tile.
    """
    out = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
    if metric == "cosine":  # a vector of length 0 is near to nothing
        kept, there = (np.flatnonzero((x * x).sum(1) > 0) for x in (rows, asked))
        ids, rows, qids, asked = ids[kept], rows[kept], qids[there], asked[there]
    if not len(ids) or not len(qids):
        return tuple(x[0] for x in out)
    near, of, slack = _singles(metric, rows, asked)
    if metric == "l2":  # squares are two more components, so that a product gives whole distances
        one = lambda x: np.ones((len(x), 1), x.dtype)
        squares = lambda x: (x * x).sum(1)[:, None]
        near, of = np.hstack([near, squares(near), one(near)]), np.hstack([-2 * of, one(of), squares(of)])
    else:
        of = -of
    place = {}
    if exclude_self:
        sorted_ids = np.argsort(ids, kind="stable")
        low, high = (np.searchsorted(ids[sorted_ids], qids, side=side) for side in ("left", "right"))
        place = {j: sorted_ids[a:b] for j, (a, b) in enumerate(zip(low.tolist(), high.tolist())) if a < b}
    for begin in range(0, len(qids), TILE_QUERIES):
        some = slice(begin, begin + TILE_QUERIES)
        q, room = of[some], slack[some]
        bound = np.full(len(q), np.inf, near.dtype)
        own_place = [(j, r) for j in range(len(q)) for r in place.get(begin + j, ())]
        at, i, d, cut = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, near.dtype), 0
        for low in range(0, len(ids), TILE_ROWS):
            part = slice(low, low + TILE_ROWS)
            tile = q @ near[part].T
            for j, r in own_place:
                if low <= r < low + TILE_ROWS:
                    tile[j, r - low] = np.inf
            if not low and tile.shape[1] > k:
                few = tile[:, : max(FIRST_ROWS, k + 1)]
                bound = np.partition(few, k - 1, axis=1)[:, k - 1] + room
            a, r = np.divmod(np.flatnonzero(tile <= np.minimum(bound, np.finfo(tile.dtype).max)[:, None]), tile.shape[1])
            at, i, d = np.concatenate([at, a]), np.concatenate([i, r + low]), np.concatenate([d, tile[a, r]])
            if low + TILE_ROWS >= min(2 * cut, len(ids)) or len(at) > MOST_PAIRS:  # between two cuts about k more come up a query
                at, i, d = _cut(at, i, d, k, bound, room)
                cut = low + TILE_ROWS
        for low in range(0, len(at), MOST_PAIRS):
            a, r = at[low : low + MOST_PAIRS] + begin, i[low : low + MOST_PAIRS]
            out[0].append(qids[a])
            out[1].append(ids[r])
            out[2].append(paired(metric, asked[a], rows[r]))
    return np.concatenate(out[0]), np.concatenate(out[1]), np.concatenate(out[2])


def _blocks(n: int, m: int, cores: int, dim: int = 0) -> tuple[int, int]:
    """Blocks of ``n`` rows of ``dim`` components and of ``m`` queries; a query gets k rows of each block of rows, so these are larger if they may."""
    even = (cores * CELLS_A_CORE * max(n, 1) / max(m, 1)) ** 0.5
    sides = (n, even, max(MOST_ROWS, MOST_COMPONENTS // dim) if dim else MOST_ROWS), (m, cores * CELLS_A_CORE / even, MOST_ROWS)
    return tuple(max(1 + size // most, min(math.ceil(want), 1 + size // LEAST_ROWS)) for size, want, most in sides)


def knn(base: DataFrame, queries: DataFrame, k: int, metric: str = "l2", exclude_self: bool = False, match: str | None = None) -> DataFrame:
    """(qid, rank, id, dist) of the k nearest rows of base(id, vec) for queries(qid, qvec).

    metric is 'l2' (squared), 'mips' (minus the inner product) or 'cosine' (minus the cosine). With
    ``match``, only rows with an equal value in that column, which both tables have, are compared; null
    equals nothing. Vectors are only compared with vectors of their own length; a query of a length that no
    row has is an error.
    """
    extra = [match] if match else []
    if match:
        base, queries = base.where(F.col(match).isNotNull()), queries.where(F.col(match).isNotNull())
    sizes = [{r["d"]: r["count"] for r in side.groupBy(F.size(c).alias("d")).count().collect()} for side, c in ((base, "vec"), (queries, "qvec"))]  # a row a length
    if sizes[0] and set(sizes[1]) - set(sizes[0]):
        raise ValueError("queries and base have vectors of different length")
    n, m = (sum(x.values()) for x in sizes)
    blocks, columns = _blocks(n, m, base.sparkSession.sparkContext.defaultParallelism, max((d or 0 for d in sizes[0]), default=0))
    deal = lambda c, size: F.pmod(F.xxhash64(c), F.lit(size)).cast("int")
    every = lambda size: F.explode(F.sequence(F.lit(0), F.lit(size - 1)))
    left = base.select(F.col("id").cast("long").alias("id"), "vec", F.size("vec").alias("_dim"), *extra, deal(F.col("id"), blocks).alias("_b"), every(columns).alias("_q"))
    right = queries.select(F.col("qid").cast("long").alias("qid"), "qvec", F.size("qvec").alias("_dim"), *extra, every(blocks).alias("_b"), deal(F.col("qid"), columns).alias("_q"))

    def cell(a, b):
        import pyarrow as pa

        out = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        if a.num_rows and b.num_rows:
            ids, qids = (np.array(t.column(c).to_pylist(), np.int64) for t, c in ((a, "id"), (b, "qid")))
            out = nearest(metric, ids, matrix(a, "vec"), qids, matrix(b, "qvec"), k, exclude_self)
            order = np.lexsort((out[1], out[2], out[0]))
            out = tuple(x[order] for x in out)
            nth = np.arange(len(order)) - np.searchsorted(out[0], out[0])
            out = tuple(x[nth < k] for x in out)
        return pa.table([pa.array(x) for x in out], ["qid", "id", "dist"])

    keys = ["_b", "_q", "_dim", *extra]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(cell, "qid long, id long, dist double")
    order = Window.partitionBy("qid").orderBy("dist", "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("qid", "rank", "id", "dist")


def top_rows(df: DataFrame, by: list, n: int) -> DataFrame:
    """The first ``n`` rows of an order over the whole table, with their rank; Spark keeps n rows a task."""
    few = df.orderBy(*by).limit(n)
    return few.withColumn("rank", F.row_number().over(Window.orderBy(*by)))
