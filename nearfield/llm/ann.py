"""Approximate nearest neighbours: stable low-dimensional projections in kd-trees, with a chi-square stop.

Unit vectors are projected by PROJECTIONS Gaussian directions. For two vectors at distance d, the
squared projected distance over d^2 follows the chi-square law with PROJECTIONS degrees of freedom,
whatever the dimension. The upper levels of the kd-tree, at most MOST_CELLS leaves, are fitted on about
SAMPLE_ROWS rows and deal all rows over cells; a cell holds the lower levels over its own rows. A query
takes projected neighbours in increasing distance from the tree, verifies them on the original vectors,
and stops when the next one lies so far out that a vector nearer than the k-th found would only be
there with probability 1 - STOP. The bound holds per neighbour and cell.

A query searches its own cell first. The k-th it finds there says which other cells can hold a nearer
one by the same test, from their boxes; it visits these with the k-th in hand, so that it stops sooner
there. Where rows lie close to others, few cells are left; rows without near neighbours, such as
independent random ones, visit most, as any search at this confidence must.

A cell of more than SHARD_ROWS rows (cells don't grow in number beyond the bound, and a vector may come
very often) is cut by hash, and a cell's queries into blocks of QUERY_ROWS, so no task grows with either
table. Equal vectors are one point of a tree with its k + 1 least ids.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite components take no part,
nor do rows with a null id; vectors are only compared with vectors of their own length; rows that
repeat the query's id are not its neighbours; an id is a neighbour once, with the nearest of its vectors, however
often it comes; with fewer than k candidate ids all are returned; an empty table gives an empty result. Equal
scores go to the smaller id.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

PROJECTIONS = 8
SHARD_ROWS = 4096
QUERY_ROWS = 2048
LEAF_ROWS = 64
SAMPLE_ROWS = 16384
MOST_CELLS = 1024
LEAVES_A_STEP = 8
STOP = 0.999
TIE = 1e-12


def directions(dim: int, m: int = PROJECTIONS) -> np.ndarray:
    return np.random.default_rng(99).standard_normal((dim, m))


def chi_square_cdf(x: float, m: int = PROJECTIONS) -> float:
    """For an even number of degrees of freedom."""
    term = total = 1.0
    for i in range(1, m // 2):
        term *= x / 2 / i
        total += term
    return 1.0 - math.exp(-min(x / 2, 700.0)) * total


class Cells:
    """The upper levels of the kd-tree, fitted on a sample of projections: halved at the median of the widest side."""

    def __init__(self, sample: np.ndarray, leaves: int):
        self.depth = max(0, math.ceil(math.log2(leaves)))
        n = (1 << self.depth) - 1
        self.side, self.cut = np.zeros(n, np.int64), np.zeros(n)
        parts = {0: np.arange(len(sample))}
        for node in range(n):
            at = parts.pop(node)
            part = sample[at]
            if len(at):
                self.side[node] = int(np.argmax(part.max(0) - part.min(0)))
                self.cut[node] = float(np.median(part[:, self.side[node]]))
            right = part[:, self.side[node]] > self.cut[node]
            parts[2 * node + 1], parts[2 * node + 2] = at[~right], at[right]

    def of(self, points: np.ndarray) -> np.ndarray:
        node, rows = np.zeros(len(points), np.int64), np.arange(len(points))
        for _ in range(self.depth):
            node = 2 * node + 1 + (points[rows, self.side[node]] > self.cut[node])
        return node - ((1 << self.depth) - 1)


def kd_leaves(points: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """An order of the points, and (begin, end) of each leaf in it: halved at the median of the widest side."""
    order, stack, leaves = np.arange(len(points)), [(0, len(points))], []
    while stack:
        a, b = stack.pop()
        if b - a <= LEAF_ROWS:
            leaves.append((a, b))
            continue
        part = points[order[a:b]]
        side = int(np.argmax(part.max(0) - part.min(0)))
        half = (b - a) // 2
        order[a:b] = order[a:b][np.argpartition(part[:, side], half, kind="introselect")]
        stack += [(a, a + half), (a + half, b)]
    return order, leaves


class Shard:
    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int):
        distinct, inverse = np.unique(vectors, axis=0, return_inverse=True)
        pairs = np.unique(np.stack([inverse.ravel(), ids]), axis=1)  # a row of one id and vector counts once
        first = np.searchsorted(pairs[0], np.arange(len(distinct)))
        ends = np.append(first[1:], pairs.shape[1])
        # k + 1 different ids: one may be the query's own
        self.ids = [pairs[1, a : min(b, a + k + 1)].tolist() for a, b in zip(first.tolist(), ends.tolist())]
        self.raw = distinct.astype(np.float64)
        self.unit = self.raw / np.sqrt((self.raw**2).sum(1))[:, None]
        self.basis = directions(vectors.shape[1])
        projected = self.unit @ self.basis
        self.order, leaves = kd_leaves(projected)
        self.projected = projected[self.order]
        self.leaves = np.array(leaves)
        boxes = [self.projected[a:b] for a, b in leaves]
        self.low, self.high = np.array([b.min(0) for b in boxes]), np.array([b.max(0) for b in boxes])

    def search(self, own_id: int, query: np.ndarray, k: int, stop: float, known: float | None = None) -> list[int]:
        """Indexes of distinct vectors that hold the k nearest rows found, or those as near as ``known``, the cosine of a k-th found elsewhere."""
        unit = query / np.sqrt((query**2).sum())
        at = unit @ self.basis
        gap = np.maximum(self.low - at, 0) + np.maximum(at - self.high, 0)
        bound = (gap**2).sum(1)
        near = np.argsort(bound, kind="stable")
        found, cos = np.zeros(0, np.int64), np.zeros(0)
        waiting, waiting_d = np.zeros(0, np.int64), np.zeros(0)
        for step in range(0, len(near), LEAVES_A_STEP):
            places = np.concatenate([np.arange(a, b) for a, b in self.leaves[near[step : step + LEAVES_A_STEP]].tolist()])
            waiting = np.concatenate([waiting, places])
            waiting_d = np.concatenate([waiting_d, ((self.projected[places] - at) ** 2).sum(1)])
            reach = bound[near[step + LEAVES_A_STEP]] if step + LEAVES_A_STEP < len(near) else np.inf
            ready = waiting_d <= reach  # the next projected neighbours, nearer than any in the leaves to come
            batch = self.order[waiting[ready]]
            waiting, waiting_d = waiting[~ready], waiting_d[~ready]
            found, cos = np.concatenate([found, batch]), np.concatenate([cos, self.unit[batch] @ unit])
            rows, kth = {own_id}, known
            for j in np.argsort(-cos, kind="stable").tolist():
                rows.update(self.ids[found[j]])
                if len(rows) > k:
                    kth = cos[j] if known is None else max(cos[j], known)
                    break
            if kth is not None:
                keep = cos >= kth - TIE
                found, cos = found[keep], cos[keep]
                distance = max(2 - 2 * kth, 0.0)
                if reach == np.inf or distance == 0 and reach > 1e-9 or distance > 0 and chi_square_cdf(reach / distance) >= stop:
                    break
        return found.tolist()


def exact_cosine(a: np.ndarray, b: np.ndarray) -> float:
    """In double precision, summed from the first component to the last."""
    total = lambda x, y: float(np.add.accumulate(x * y)[-1])
    return total(a, b) / (math.sqrt(total(a, a)) * math.sqrt(total(b, b)))


def usable(rows: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, vec, dim) of the rows that can take part."""
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    vec = F.col(vec_col)
    square = F.aggregate(vec, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    ok = F.col(id_col).isNotNull() & vec.isNotNull() & (F.size(vec) > 0) & ~F.exists(vec, odd) & (square > 0) & (square < float("inf"))
    return rows.where(ok).select(F.col(id_col).cast("long").alias("id"), vec.alias("vec"), F.size(vec).alias("dim"))


def matrix(column) -> np.ndarray:
    column = column.combine_chunks() if hasattr(column, "combine_chunks") else column
    return np.array(column.flatten()).reshape(len(column), -1)


def projected(vectors: np.ndarray) -> np.ndarray:
    raw = vectors.astype(np.float64)
    return (raw / np.sqrt((raw**2).sum(1))[:, None]) @ directions(raw.shape[1])


def in_cells(rows: DataFrame, trees: dict[int, Cells]) -> DataFrame:
    """``rows`` (id, vec, dim) with the cell and the projections p of each."""

    def place(batches):
        import pyarrow as pa

        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims).tolist():
                part = batch.filter(pa.array(dims == dim))
                points = projected(matrix(part.column("vec")))
                cell = trees[dim].of(points) if dim in trees else np.zeros(len(points), np.int64)
                p = pa.FixedSizeListArray.from_arrays(pa.array(points.ravel()), PROJECTIONS).cast(pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(cell.astype(np.int32)), p], [*part.schema.names, "cell", "p"])

    return rows.mapInArrow(place, f"id long, vec {rows.schema['vec'].dataType.simpleString()}, dim int, cell int, p array<double>")


def searched(base: DataFrame, asked: DataFrame, cells: DataFrame, k: int, stop: float) -> DataFrame:
    """(query_id, vec_id, score) of what each row of ``asked`` (id, vec, dim, cell, known) finds in its cell."""
    blocks = asked.groupBy("dim", "cell").agg((1 + F.floor(F.count(F.lit(1)) / QUERY_ROWS)).cast("int").alias("blocks"))
    cells = F.broadcast(cells.select("dim", "cell", "parts").join(blocks, ["dim", "cell"]))  # at most MOST_CELLS rows a vector length
    deal = lambda n: F.pmod(F.xxhash64(F.col("id"), F.lit(5)), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = base.select("id", "vec", "dim", "cell").join(cells, ["dim", "cell"]).select("id", "vec", "dim", "cell", deal("parts").alias("part"), every("blocks").alias("block"))
    right = asked.join(cells, ["dim", "cell"]).select("id", "vec", "known", "dim", "cell", deal("blocks").alias("block"), every("parts").alias("part"))

    def meet(left, right):
        import pyarrow as pa

        out: list[list] = [[], [], []]
        if left.num_rows and right.num_rows:
            shard = Shard(np.array(left.column("id").to_pylist(), np.int64), matrix(left.column("vec")), k)
            for own, query, known in zip(right.column("id").to_pylist(), matrix(right.column("vec")).astype(np.float64), right.column("known").to_pylist()):
                for j in shard.search(own, query, k, stop, known):
                    score = exact_cosine(query, shard.raw[j])
                    for i in [x for x in shard.ids[j] if x != own]:
                        for column, value in zip(out, (own, i, score)):
                            column.append(value)
        return pa.table([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.float64()))], ["query_id", "vec_id", "score"])

    keys = ["dim", "cell", "part", "block"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(meet, "query_id long, vec_id long, score double")


def best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))  # an id may have several vectors
    return once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def nearest(rows: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", stop: float = STOP) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows of largest cosine found for each row of ``queries``, itself left out."""
    # a row that repeats goes before cells are made: copies of one id would all meet in one part
    base, asked = (written(usable(x, id_col, vec_col).dropDuplicates(["id", "vec"]), "rows") for x in (rows, queries))
    n = base.count()
    sample = base.where(F.pmod(F.xxhash64(F.col("id"), F.lit(11)), F.lit(max(1, n // SAMPLE_ROWS))) == 0).limit(2 * SAMPLE_ROWS).select("dim", "vec").toArrow()
    leaves, trees = min(MOST_CELLS, 1 + n // SHARD_ROWS), {}
    dims = np.array(sample.column("dim").to_pylist(), np.int64)
    for dim in np.unique(dims).tolist():
        trees[dim] = Cells(projected(matrix(sample.filter(dims == dim).column("vec"))), leaves)
    base, asked = written(in_cells(base, trees), "cells"), written(in_cells(asked, trees), "asked")
    box = [f(F.get("p", F.lit(j))).alias(f"{f.__name__}_{j}") for f in (F.min, F.max) for j in range(PROJECTIONS)]
    cells = base.groupBy("dim", "cell").agg((1 + F.floor(F.count(F.lit(1)) / SHARD_ROWS)).cast("int").alias("parts"), *box)
    cells = written(cells, "boxes")
    boxes = {}
    for r in cells.collect():  # at most MOST_CELLS rows a vector length
        boxes.setdefault(r["dim"], []).append((r["cell"], *[r[f"{f}_{j}"] for f in ("min", "max") for j in range(PROJECTIONS)]))

    def visit(batches):
        """The other cells that may hold a nearer row than the query's k-th."""
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                rows, cell = [], []
                for i, (dim, own, p, known) in enumerate(zip(*(part.column(c).to_pylist() for c in ("dim", "cell", "p", "known")))):
                    table = np.array(boxes.get(dim, np.zeros((0, 1 + 2 * PROJECTIONS))))
                    low, high = table[:, 1 : 1 + PROJECTIONS], table[:, 1 + PROJECTIONS :]
                    reach = (np.maximum(low - p, 0) + np.maximum(p - high, 0)) ** 2
                    far = 0.0 if known is None else max(2 - 2 * known, 0.0)
                    for number, r in zip(table[:, 0].astype(int).tolist(), reach.sum(1).tolist()):
                        over = known is not None and (r > 1e-9 if far == 0 else chi_square_cdf(r / far) >= stop)
                        if number != own and not over:
                            rows.append(i)
                            cell.append(number)
                taken = part.select(["id", "vec", "dim", "known"]).take(pa.array(rows, pa.int64()))
                yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(cell, pa.int32())], ["id", "vec", "dim", "known", "cell"])

    first = written(searched(base, asked.withColumn("known", F.lit(None).cast("double")), cells, k, stop), "found")
    kth = best(first, k).where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("known"))
    kind = asked.schema["vec"].dataType.simpleString()
    visits = asked.join(kth, "id", "left").select("id", "vec", "dim", "cell", "p", "known").mapInArrow(visit, f"id long, vec {kind}, dim int, known double, cell int")
    further = searched(base, written(visits, "visits"), cells, k, stop)
    return best(first.unionByName(further), k).select("query_id", "rank", "vec_id", "score")
