"""Exact k nearest neighbours that leave out the rows which bounds exclude.

Rows go to the nearest of a bounded number of pivots, and a pivot's rows to rings by their distance from it. A
part (pivot, ring) has a nearest and a farthest distance, so that for a query at distance d of the pivot no row
of the part is nearer than d - farthest or nearest - d (triangle), and no inner product with the query q exceeds
q.pivot + |q| * farthest (norm). A query takes parts in ascending order of their bound: first as many as hold k
rows, then a few more at a time, and ends where a bound passes its k-th distance. So no neighbour is lost, ties
included; what is saved depends on how far the rows cluster.

Pivots and the bounds of parts go to all tasks: at most 2 * PIVOTS vectors and RINGS bounds for each. A part
is split by a hash of the id into blocks of about BASE_ROWS, its visits into blocks of about QUERY_ROWS, so that neither a
vector that a third of the rows share nor one that a third of the queries ask for makes a large task.
"""

from __future__ import annotations

from math import isqrt

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import written
from .exact import BASE_ROWS, QUERY_ROWS, matrix, nearest, paired, rough
from .navigable import level

PIVOTS = 1024
RINGS = 4
#: Parts visited in the rounds after the first; the round after these visits all that the bounds leave.
ROUNDS = (8, 64)
#: Bounds give way by this share of the lengths they are made of, which covers their rounding.
SLACK = 1e-7
FOUND = "qid long, rank int, id long, dist double"


def placed(rows: DataFrame, centres: np.ndarray) -> DataFrame:
    """``rows`` (id, vec) with cell, the index of the nearest centre, and far, the distance from it."""

    def place(batches):
        import pyarrow as pa

        for batch in batches:
            if batch.num_rows:
                x = matrix(pa.Table.from_batches([batch]), "vec")
                cell = rough("l2", x, centres).argmin(1).astype(np.int32)
                far = np.sqrt(paired("l2", centres[cell], x))
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("vec"), pa.array(cell), pa.array(far)], ["id", "vec", "cell", "far"])

    return rows.select(F.col("id").cast("long").alias("id"), F.col("vec").cast("array<float>").alias("vec")).mapInArrow(place, "id long, vec array<float>, cell int, far double")


def bounds(metric: str, q: np.ndarray, centres: np.ndarray, cell: np.ndarray, near: np.ndarray, far: np.ndarray) -> np.ndarray:
    """A row a query, a column a part: no row of the part has a smaller distance."""
    norms, sizes = np.sqrt((q * q).sum(1))[:, None], np.sqrt((centres * centres).sum(1))[None, :]
    if metric == "mips":
        return -(q @ centres.T)[:, cell] - norms * far - SLACK * norms * (sizes[:, cell] + far)
    d = np.sqrt(np.maximum(0.0, rough("l2", q, centres)))[:, cell]
    least = np.maximum(d - far, near - d) - SLACK * (norms + sizes[:, cell] + far)
    return np.square(np.maximum(0.0, least))


def _of_length(base: DataFrame, queries: DataFrame, n: int, k: int, metric: str, exclude_self: bool, pivots: int | None) -> tuple[DataFrame, DataFrame]:
    spark = base.sparkSession
    top = level(base.select("id", "vec"), pivots or min(PIVOTS, max(16, isqrt(n)))).collect()  # at most 2 * PIVOTS rows
    centres = np.array([r.vec for r in top] or [base.first().vec], np.float64)
    rows = written(placed(base, centres), "placed")
    cuts = rows.groupBy("cell").agg(F.percentile_approx("far", [i / RINGS for i in range(1, RINGS)], 1000).alias("cuts"))
    rows = rows.join(F.broadcast(cuts), "cell").withColumn("ring", F.size(F.filter("cuts", lambda c: c < F.col("far")))).drop("cuts")  # a row a pivot
    parts = rows.groupBy("cell", "ring").agg(F.count(F.lit(1)).alias("n"), F.min("far").alias("near"), F.max("far").alias("far")).orderBy("cell", "ring").collect()  # RINGS rows a pivot
    cell, near, far, sizes = (np.array([r[c] for r in parts]) for c in ("cell", "near", "far", "n"))
    table = spark.createDataFrame([(i, r.cell, r.ring, r.n, 1 + r.n // BASE_ROWS) for i, r in enumerate(parts)], "part int, cell int, ring int, n long, blocks int")
    dealt = rows.join(F.broadcast(table.drop("n")), ["cell", "ring"])
    dealt = written(dealt.select("id", "vec", "part", F.pmod(F.xxhash64("id"), "blocks").cast("int").alias("block")), "dealt")
    wanted = k + exclude_self

    def following(step: int | None, first: bool):
        def choose(batches):
            import pyarrow as pa

            for batch in batches:
                for at in range(0, batch.num_rows, 256):
                    some = pa.Table.from_batches([batch.slice(at, 256)])
                    done, kth = some.column("done").to_numpy(), some.column("kth").to_numpy()
                    least = bounds(metric, matrix(some, "qvec"), centres, cell, near, far)
                    out, ends = [], []
                    for j, order in enumerate(np.argsort(least, axis=1, kind="stable")):
                        end = int(np.searchsorted(np.cumsum(sizes[order]), wanted)) + 1 if first else len(order) if step is None else done[j] + step
                        take = order[done[j] : end]
                        stay = take[least[j, take] <= kth[j]]
                        out.append(stay.astype(np.int32))
                        ends.append(min(end, len(order)) if len(stay) == len(take) else len(order))  # all later bounds are larger
                    yield pa.RecordBatch.from_arrays([some.column("qid").combine_chunks(), some.column("qvec").combine_chunks(), pa.array(ends, pa.int32()), pa.array(out, pa.list_(pa.int32()))], ["qid", "qvec", "done", "parts"])

        return choose

    def block(a, b):
        import pyarrow as pa

        out = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        if a.num_rows and b.num_rows:
            out = nearest(metric, a.column("id").to_numpy(), matrix(a, "vec"), b.column("qid").to_numpy(), matrix(b, "qvec"), k, exclude_self)
        return pa.table([pa.array(x) for x in out], ["qid", "id", "dist"])

    state = queries.select(F.col("qid").cast("long").alias("qid"), F.col("qvec").cast("array<float>").alias("qvec"), F.lit(0).alias("done"), F.lit(float("inf")).alias("kth"))
    found, visits, order = None, None, Window.partitionBy("qid").orderBy("dist", "id")
    for turn, step in enumerate((0, *ROUNDS, None)):
        chosen = written(state.mapInArrow(following(step, turn == 0), "qid long, qvec array<float>, done int, parts array<int>"), "chosen")
        asked = chosen.select("qid", "qvec", F.explode("parts").alias("part"))
        columns = asked.groupBy("part").agg((1 + F.floor(F.count(F.lit(1)) / QUERY_ROWS)).cast("int").alias("columns"))
        shape = F.broadcast(table.join(columns, "part").select("part", "blocks", "columns"))  # a row a part
        every = lambda size: F.explode(F.sequence(F.lit(0), F.col(size) - 1))
        left = dealt.join(shape, "part").select("id", "vec", "part", "block", every("columns").alias("column"))
        right = asked.join(shape, "part").select("qid", "qvec", "part", F.pmod(F.xxhash64("qid"), "columns").cast("int").alias("column"), every("blocks").alias("block"))
        keys = ["part", "block", "column"]
        new = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(block, "qid long, id long, dist double")
        both = new if found is None else found.drop("rank").unionByName(new)
        found = written(both.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("qid", "rank", "id", "dist"), "found")
        seen = asked.select("qid", "part").join(F.broadcast(table.select("part", "n")), "part")
        visits = seen if visits is None else visits.unionByName(seen)
        kth = found.where(F.col("rank") == k).select("qid", F.col("dist").alias("kth"))
        state = chosen.where(F.col("done") < len(parts)).select("qid", "qvec", "done").join(kth, "qid", "left").withColumn("kth", F.coalesce("kth", F.lit(float("inf"))))
        if state.isEmpty():
            break
    return found, visits


def knn_pruned(base: DataFrame, queries: DataFrame, k: int, metric: str = "l2", exclude_self: bool = False, pivots: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The (qid, rank, id, dist) of ``exact.knn`` for metrics 'l2' and 'mips', and the visits (qid, part, n) it took.

    ``n`` is the rows of the part that was visited; all others weren't compared with the query. Ids of base and of queries are
    unique. ``pivots`` is their number, by default the square root of the rows, 16 at least and PIVOTS at most. Lengths of vectors
    are searched one by one; a query of a length that no row has is an error. Null vectors take no part.
    """
    if metric not in ("l2", "mips"):
        raise ValueError("metric is 'l2' or 'mips'; normalise for the cosine")
    base, queries = base.where(F.col("id").isNotNull() & F.col("vec").isNotNull()), queries.where(F.col("qid").isNotNull() & F.col("qvec").isNotNull())
    sizes = [{r["d"]: r["count"] for r in side.groupBy(F.size(c).alias("d")).count().collect()} for side, c in ((base, "vec"), (queries, "qvec"))]  # a row a length
    if sizes[0] and set(sizes[1]) - set(sizes[0]):
        raise ValueError("queries and base have vectors of different length")
    found, visits = (base.sparkSession.createDataFrame([], s) for s in (FOUND, "qid long, part int, n long"))
    for d in sorted(set(sizes[0]) & set(sizes[1])):
        one = _of_length(base.where(F.size("vec") == d), queries.where(F.size("qvec") == d), sizes[0][d], k, metric, exclude_self, pivots)
        found, visits = found.unionByName(one[0]), visits.unionByName(one[1])
    return found, visits
