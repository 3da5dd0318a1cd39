"""Navigable graphs: occlusion pruning of near-neighbour lists, bounded reverse edges, and entries by hashed levels.

A near-neighbour graph leads well among near rows and badly from far away, because a node's neighbours all lie
on one side. Pruning keeps a candidate only while no kept one is nearer to it, by the factor ``alpha``, than
the node is: what stays points in different directions. Kept edges are then offered to their ends too, and
lists that outgrow the degree are pruned again, so that no hub gathers more than ``degree`` edges.

Candidates travel once a pass with their vectors, at most 2 * ``width`` a node, and are pruned in blocks of nodes; no
pair of rows is compared that doesn't share a candidate list.

A search is better entered near its query. ``entries`` finds the nearest row of a hashed level, whose size
is bounded whatever the table's, by exact search, so that walks start within the right region. ``descended`` goes on
from there through a hierarchy of hashed layers, where the rows between are too many to start from one of a bounded level.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import written
from .exact import MOST_PAIRS, knn, matrix, paired
from .search import adjacency, greedy, greedy_held

BLOCK_NODES = 256
ALPHA = 1.2
#: A multiplicative hash of ids modulo 2^31; products stay within 64 bits.
MULTIPLIER, MODULUS = 1103515245, 1 << 31


def kept_by_occlusion(vecs: np.ndarray, dist: np.ndarray, degree: int, alpha: float) -> list[int]:
    """Of candidates in ascending order of distance (squared L2), those that no kept one occludes, at most ``degree``."""
    x = vecs - vecs.mean(axis=0)
    own = (x * x).sum(1)
    between, far = own[:, None] + own[None, :] - 2 * (x @ x.T), own[:, None] + own[None, :]
    slack = 4 * (x.shape[1] + 16) * np.finfo(np.float64).eps * far + 1e-300
    occludes = alpha * alpha * (between + slack) < dist[None, :]
    i, j = np.nonzero(~occludes & ~(alpha * alpha * (between - slack) > dist[None, :]))  # too near to tell by products: summed again
    i, j = i[i < j], j[i < j]
    for low in range(0, len(i), MOST_PAIRS):
        a, b = i[low : low + MOST_PAIRS], j[low : low + MOST_PAIRS]
        occludes[a, b] = alpha * alpha * paired("l2", vecs[a], vecs[b]) <= dist[b]
    free, alive, kept = ~occludes, np.ones(len(dist), bool), []
    for at in range(len(dist)):
        if not alive[at]:
            continue
        kept.append(at)
        if len(kept) == degree:
            break
        alive &= free[at]
    return kept


def pruned(edges: DataFrame, rows: DataFrame, degree: int, alpha: float = ALPHA) -> DataFrame:
    """(src, pos, dst, dist) of the edges (src, dst, dist; squared L2) that occlusion leaves, at most ``degree`` a node."""
    blocks = 1 + rows.count() // BLOCK_NODES
    cands = edges.select("src", "dst", "dist").where("src != dst").join(rows.select(F.col("id").alias("dst"), "vec"), "dst")
    cands = cands.select("src", "dst", "dist", "vec", F.pmod(F.xxhash64("src"), F.lit(blocks)).alias("block"))

    def prune(block):
        import pyarrow as pa

        src, dst, dist, vecs = *(block.column(c).to_numpy() for c in ("src", "dst", "dist")), matrix(block, "vec")
        order = np.lexsort((dst, dist, src))
        out = [[], []]
        for group in np.split(order, np.flatnonzero(np.diff(src[order])) + 1):
            stay = group[kept_by_occlusion(vecs[group], dist[group], degree, alpha)]
            out[0].append(stay)
            out[1].append(np.arange(1, len(stay) + 1, dtype=np.int32))
        stay, pos = np.concatenate(out[0]), np.concatenate(out[1])
        return pa.table([pa.array(src[stay]), pa.array(pos), pa.array(dst[stay]), pa.array(dist[stay])], ["src", "pos", "dst", "dist"])

    return cands.groupBy("block").applyInArrow(prune, "src long, pos int, dst long, dist double")


def navigable(near: DataFrame, rows: DataFrame, degree: int, width: int = 64, alpha: float = ALPHA) -> DataFrame:
    """(src, pos, dst, dist): a graph to walk, of at most ``degree`` edges a node, from near neighbours (src, dst, dist; squared L2).

    A node's candidates are its near neighbours and the ``width`` nearest of those it is a near neighbour of. ``rows`` holds (id, vec).
    """
    rows = rows.select("id", "vec")
    back = Window.partitionBy("src").orderBy("dist", "dst")
    reverse = near.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "dist").withColumn("nth", F.row_number().over(back)).where(F.col("nth") <= width).drop("nth")
    first = written(pruned(near.select("src", "dst", "dist").unionByName(reverse).distinct(), rows, degree, alpha), "pruned")
    turned = first.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "dist").withColumn("nth", F.row_number().over(back)).where(F.col("nth") <= width).drop("nth")
    both = written(first.select("src", "dst", "dist").unionByName(turned).distinct(), "both")
    sizes = both.groupBy("src").agg(F.count(F.lit(1)).alias("n"))
    again = written(both.join(sizes.where(F.col("n") > degree), "src", "left_semi"), "again")
    few = both.join(sizes.where(F.col("n") <= degree), "src", "left_semi").withColumn("pos", F.row_number().over(back)).select("src", "pos", "dst", "dist")
    return few.unionByName(pruned(again, rows, degree, alpha))


def level(rows: DataFrame, most: int) -> DataFrame:
    """About ``most`` rows, chosen by a hash of their id; never more than twice as many."""
    n = rows.count()
    key = F.pmod(F.pmod("id", F.lit(MODULUS)) * MULTIPLIER, F.lit(MODULUS))
    return rows.where(key < F.lit(MODULUS * most // max(1, n))).orderBy(key, "id").limit(2 * most) if n > most else rows


def entries(rows: DataFrame, queries: DataFrame, most: int = 1024) -> DataFrame:
    """``queries`` (qid, qvec) with entry: the nearest row of the hashed level."""
    top = written(level(rows.select("id", "vec"), most), "level")
    return queries.join(knn(top, queries, 1).select("qid", F.col("id").alias("entry")), "qid")


def descended(rows: DataFrame, queries: DataFrame, build: Callable[[DataFrame], DataFrame], most: int = 1024, ratio: int = 16, width: int = 4, layers: int | None = None) -> DataFrame:
    """``queries`` (qid, qvec) with entry, and n_expand of the way there: searched layer by layer, each about ``ratio`` times as large.

    The top layer is the ``most`` rows of least hash, of which the nearest is found exactly. A layer holds all rows up to a
    limit of the hash, so the layers above it too; ``build`` makes its graph (src, pos, dst), and one-shot search with a list of
    ``width`` goes on from the row found above; a layer that all tasks can hold is walked in one pass. There are ``layers`` below the top, or as many as are smaller than the table.
    No rows, or no queries, give no rows.
    """
    rows, key = rows.select("id", "vec"), F.pmod(F.pmod("id", F.lit(MODULUS)) * MULTIPLIER, F.lit(MODULUS))
    n, top = rows.count(), written(rows.orderBy(key, "id").limit(most), "layer")
    found = knn(top, queries, 1).select("qid", F.col("id").alias("entry"), F.lit(0).cast("long").alias("n_expand"))
    least, size, depth = (top.agg(F.max(key)).first()[0] or 0) + 1, most * ratio, 0
    while n and (size < n if layers is None else depth < layers):
        layer = written(rows.where(key < max(least, MODULUS * size // n)), "layer")
        edges = build(layer)
        held = greedy_held(queries.join(found, "qid"), edges, layer, width)
        if held is not None:
            found = held.select("qid", "entry", "n_expand")
        else:
            came = written(found, "entries")
            at = greedy(queries.join(came.select("qid", "entry"), "qid"), adjacency(edges, layer), layer, None, width, 1)
            on = at.select("qid", F.col("id").alias("to"), F.col("n_expand").alias("more"))
            found = came.join(on, "qid").select("qid", F.col("to").alias("entry"), (F.col("n_expand") + F.col("more")).alias("n_expand"))
        size, depth = size * ratio, depth + 1
    return queries.join(found, "qid")
