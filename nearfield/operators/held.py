"""Graph search where a task can hold the graph: queries are dealt over tasks, and each task gets the graph and walks its queries to their end.

A walk goes from node to node, so that in supersteps it waits for a join at nearly every hop. A graph of at most HELD_NUMBERS numbers (components
and links) is brought to the tasks by a shuffle instead, in packs of rows, once a task; what is shuffled grows with the rows, as there is a task
a core or for MOST_QUERIES queries. A task holds the vectors in single precision, a place a link, and the walk of one query. Larger graphs, vectors of
uneven length, ids that repeat and components that aren't finite numbers are left to the supersteps of ``search``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import bounded_batches, written
from .exact import paired

#: Components and links of a graph that tasks hold, queries that a task walks at most and at least, and those whose results it gathers before it hands them on.
HELD_NUMBERS = 1 << 26
MOST_QUERIES = 1 << 14
LEAST_QUERIES = 64
QUERIES_AT_ONCE = 256
PACK_ROWS = 500
PACKS = "ids binary, vecs binary, sizes binary, near binary"


def _shape(rows: DataFrame, vec: str) -> tuple[int, int] | None:
    """How many ``rows`` there are and their vectors' length; None where the lengths differ or a component isn't a finite single-precision number."""
    if rows.schema[vec].dataType.simpleString() != "array<float>":
        return None
    odd = F.col(vec).isNull() | F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    r = rows.agg(F.count(F.lit(1)).alias("n"), F.min(F.size(vec)).alias("least"), F.max(F.size(vec)).alias("most"), F.count_if(odd).alias("odd")).first()
    return (r.n, r.least) if r.n and r.least == r.most and r.least > 0 and not r.odd else None


def spread(spark: SparkSession, n: int) -> list[int]:
    """``n`` keys of groups that Spark deals to as many tasks, if there are so many partitions."""
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    if n > parts:
        return list(range(n))
    keys = spark.range(0, 32 * parts, 1, 1).select(F.col("id").cast("int").alias("key"))
    found = keys.groupBy(F.pmod(F.hash("key"), F.lit(parts)).alias("part")).agg(F.min("key").alias("key")).orderBy("part").collect()  # a row a partition
    own = [r.key for r in found][:n]
    return own + [key for key in range(2 * n) if key not in own][: n - len(own)]


class Held:
    """A graph ``edges`` (src, pos, dst) over ``base`` (id, vec) that tasks can hold; see ``held``."""

    def __init__(self, edges: DataFrame, base: DataFrame, n: int, length: int) -> None:
        self.edges, self.base, self.n, self.length = edges, base, n, length

    @cached_property
    def packs(self) -> DataFrame:
        """Rows of the graph in packs: ids, vectors, numbers of neighbours, and neighbours in order."""
        near = self.edges.groupBy("src").agg(F.array_sort(F.collect_list(F.struct("pos", "dst"))).alias("near"))
        rows = self.base.select(F.col("id").cast("long").alias("id"), "vec").join(near.select(F.col("src").alias("id"), F.col("near.dst").cast("array<bigint>").alias("near")), "id", "left")
        bounded_batches(self.base.sparkSession, PACK_ROWS)

        def pack(batches):
            for batch in batches:
                if batch.num_rows:
                    near = batch.column(2)
                    parts = batch.column(0).to_numpy(), np.asarray(batch.column(1).flatten(), np.float32), near.value_lengths().fill_null(0).to_numpy(), near.flatten().to_numpy()
                    yield pa.RecordBatch.from_arrays([pa.array([x.astype(kind).tobytes()], pa.binary()) for x, kind in zip(parts, (np.int64, np.float32, np.int32, np.int64))], ["ids", "vecs", "sizes", "near"])

        return written(rows.mapInArrow(pack, PACKS), "packs")

    def walk(self, queries: DataFrame, entry: int | None, metric: str, walked: Callable, out: str) -> DataFrame | None:
        """What ``walked`` finds for the queries (qid, qvec, and entry where ``entry`` is None): rows ``out``, of which the first column is qid.

        ``walked(near, dist, entry)`` gives the columns but qid as lists, where ``near[id]`` holds the neighbours of a node as (pos, id, dist).
        Queries whose entry isn't in the graph give no rows. None, if a query's vector isn't one of the graph's length.
        """
        spark, shape = queries.sparkSession, _shape(queries, "qvec")
        if shape is None or shape[1] != self.length:
            return None
        n, length = self.n, self.length
        tasks = max(min(spark.sparkContext.defaultParallelism, 1 + shape[0] // LEAST_QUERIES), 1 + shape[0] // MOST_QUERIES)
        keys = F.array(*[F.lit(key) for key in spread(spark, tasks)])
        start = F.col("entry") if entry is None else F.lit(entry)
        asked = queries.select(F.get(keys, F.pmod(F.xxhash64("qid", "qvec"), F.lit(tasks)).cast("int")).alias("task"), F.col("qid").cast("long").alias("qid"), "qvec", start.cast("long").alias("entry"))
        both = self.packs.withColumn("task", F.explode(keys)).unionByName(asked, allowMissingColumns=True)

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, vecs, sizes = np.empty(n, np.int64), np.empty((n, length), np.float32), np.empty(n, np.int32)
            lists, filled, waiting = [], 0, []
            for batch in batches:
                at = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
                packed = at["ids"].is_valid()
                for part in zip(*(at[c].filter(packed) for c in ("ids", "vecs", "sizes", "near"))):
                    own, x, some, near = (np.frombuffer(p.as_buffer(), kind) for p, kind in zip(part, (np.int64, np.float32, np.int32, np.int64)))
                    rows = slice(filled, filled + len(own))
                    ids[rows], vecs[rows], sizes[rows], filled = own, x.reshape(-1, length), some, rows.stop
                    lists.append(near.copy())
                waiting.append(pa.table([at[c] for c in ("qid", "qvec", "entry")], ["qid", "qvec", "entry"]).filter(at["ids"].is_null()))
            if not filled:
                return
            order = np.argsort(ids)  # nodes are named by their place in the order of ids, so that ties follow ids
            ids = ids[order]
            ends = np.append(0, np.cumsum(sizes, dtype=np.int64))
            links, low = np.empty(ends[-1], np.int32), 0
            while lists:
                some = lists.pop(0)
                place = np.minimum(np.searchsorted(ids, some), n - 1)
                links[low : low + len(some)] = np.where(ids[place] == some, place, -1)  # one without a vector is left out
                low += len(some)

            class Near(dict):
                """The neighbours of the nodes that the walk asks for, with their distances to ``q``."""

                def __init__(self, q):
                    self.q = q

                def __contains__(self, node):
                    return True

                def __missing__(self, node):
                    row = order[node]
                    all_ = links[ends[row] : ends[row + 1]]
                    there = all_[all_ >= 0]
                    dist = paired(metric, self.q, vecs[order[there]].astype(np.float64)) if len(there) else there
                    self[node] = found = list(zip(range(1, len(there) + 1), there.tolist(), dist.tolist()))
                    return found

            names = out.split(", ")
            kinds = [pa.int64(), *({"int": pa.int32(), "long": pa.int64(), "double": pa.float64()}[name.split()[1]] for name in names[1:])]
            for some in waiting:
                for low in range(0, some.num_rows, QUERIES_AT_ONCE):
                    part, rows = some.slice(low, QUERIES_AT_ONCE), [[] for _ in names]
                    for qid, vec, first in zip(part.column("qid").to_pylist(), part.column("qvec").to_pylist(), part.column("entry").to_pylist()):
                        at = n if first is None else int(np.searchsorted(ids, first))
                        if at == n or ids[at] != first:
                            continue
                        q = np.array(vec, np.float64)[None, :]
                        found = walked(Near(q), paired(metric, q, vecs[order[at : at + 1]].astype(np.float64)).tolist()[0], at)
                        for column, values in zip(rows, ([qid] * len(found[0]), *found)):
                            column.extend(values)
                    values = [ids[np.array(column, np.int64)] if name.split()[0] == "id" else column for name, column in zip(names, rows)]
                    yield pa.RecordBatch.from_arrays([pa.array(v, kind) for v, kind in zip(values, kinds)], [name.split()[0] for name in names])

        return both.groupBy("task").applyInArrow(search, out)


def held(edges: DataFrame, base: DataFrame) -> Held | None:
    """The graph ``edges`` (src, pos, dst) over ``base`` (id, vec) for tasks to hold; None where it is larger than they may, or its rows aren't even."""
    shape = _shape(base, "vec")
    if shape is None or shape[0] * shape[1] > HELD_NUMBERS or base.agg(F.count_distinct("id")).first()[0] != shape[0]:
        return None
    return Held(edges, base, *shape) if shape[0] * shape[1] + edges.count() <= HELD_NUMBERS else None
