"""Neighbour graphs as tables: build, normalise, walk breadth-first, renumber, and report on locality.

A graph is edges(src, pos, dst), pos counting from 1 in the order of the neighbours.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.pages import page_span, spans_meet
from ..functions.vectors import squared_l2
from ..sources.tables import written
from .exact import knn, top_rows
from .ordering import numbered


def knn_graph(base: DataFrame, degree: int, metric: str = "l2") -> DataFrame:
    """edges with dist: the exact nearest rows of each row, itself left out."""
    asked = base.select(F.col("id").alias("qid"), F.col("vec").alias("qvec"))
    return knn(base, asked, degree, metric, exclude_self=True).select(F.col("qid").alias("src"), F.col("rank").alias("pos"), F.col("id").alias("dst"), "dist")


def neighbours(edges: DataFrame) -> DataFrame:
    """(src, nbrs): neighbours in order; a row per source, whose out-degree bounds it."""
    rows = edges.groupBy("src").agg(F.array_sort(F.collect_list(F.struct("pos", "dst"))).alias("e"))
    return rows.select("src", F.col("e.dst").alias("nbrs"))


def edges_of(graph: DataFrame) -> DataFrame:
    return graph.select("src", F.posexplode("nbrs").alias("pos", "dst")).withColumn("pos", F.col("pos") + 1)


def padded(nbrs: Column, src: Column, degree: int) -> Column:
    """Exactly ``degree`` neighbours: cut, or filled with the last one, or with the node itself if there is none."""
    last = F.when(F.size(nbrs) > 0, F.element_at(nbrs, -1)).otherwise(src)
    return F.slice(F.concat(nbrs, F.array_repeat(last, degree)), 1, degree)


def medoid(base: DataFrame) -> DataFrame:
    """(id, dist) of the row nearest to the mean vector."""
    flat = base.select(F.posexplode("vec").alias("i", "x"))
    mean = flat.groupBy("i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    center = mean.agg(F.array_sort(F.collect_list(F.struct("i", "m"))).alias("c")).select(F.col("c.m").alias("center"), F.lit(0).alias("one"))
    far = base.withColumn("one", F.lit(0)).join(F.broadcast(center), "one").select("id", squared_l2(F.col("center"), F.col("vec")).alias("dist"))  # one row
    return far.orderBy(F.round("dist", 9), "id").limit(1)


def hubs(edges: DataFrame, n: int) -> DataFrame:
    """(rank, id, indegree): the nodes with most incoming edges; repeated edges count."""
    counts = edges.groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("indegree"))
    return top_rows(counts, [F.col("indegree").desc(), F.col("id")], n)


def breadth_first(edges: DataFrame, entry: int, levels: int | None = None, nodes: int | None = None) -> DataFrame:
    """(id, level, ord): nodes in order of discovery from ``entry``; edges to unknown nodes are walked as they are.

    One job per level: new nodes get the place of their first discovery, by the parent's place and the
    neighbour's position. Places within a level are numbered by range of that order, not in one task.
    """
    spark = edges.sparkSession
    found = written(spark.createDataFrame([(entry, 0, 0)], "id long, level int, ord long"), "bfs")
    front, level, total = found, 0, 1
    while (levels is None or level < levels) and (nodes is None or total < nodes):
        level += 1
        seen = front.join(edges, F.col("id") == F.col("src")).select(F.col("dst").alias("id"), F.col("ord").alias("parent"), "pos")
        fresh = seen.groupBy("id").agg(F.min(F.struct("parent", "pos")).alias("at")).join(found.select("id"), "id", "left_anti")
        front = numbered(fresh.select("id", "at.*"), ["parent", "pos"], "ord", total).select("id", F.lit(level).alias("level"), "ord")
        front = written(front, "bfs")
        grown = front.count()
        if not grown:
            break
        found, total = found.unionByName(front), total + grown
    return found if nodes is None else found.where(F.col("ord") < nodes)


def permutation(order: DataFrame, ids: DataFrame) -> DataFrame:
    """(new_id, old_id): discovered nodes in order, then the others ascending."""
    reached = order.count()
    rest = ids.join(order.select("id"), "id", "left_anti")
    rest = numbered(rest.select("id"), ["id"], "new_id", reached).select(F.col("id").alias("old_id"), "new_id")
    return order.select(F.col("id").alias("old_id"), F.col("ord").alias("new_id")).unionByName(rest)


def checked_map(id_map: DataFrame, n: int) -> DataFrame:
    """``id_map``, if it holds each of 0..n-1 once on both sides; an error otherwise."""
    r = id_map.agg(F.count(F.lit(1)).alias("rows"), *[f(c).alias(f"{f.__name__}_{c}") for c in ("new_id", "old_id") for f in (F.count_distinct, F.min, F.max)]).first()
    if n and (r["rows"] != n or any(r[f"count_distinct_{c}"] != n or r[f"min_{c}"] != 0 or r[f"max_{c}"] != n - 1 for c in ("new_id", "old_id"))):
        raise ValueError("the id map is not a permutation of the rows")
    return id_map


def remapped(edges: DataFrame, id_map: DataFrame) -> DataFrame:
    """(src, pos, dst) in new ids; a neighbour that the map doesn't know becomes 0."""
    a = id_map.select(F.col("old_id").alias("src"), F.col("new_id").alias("_s"))
    b = id_map.select(F.col("old_id").alias("dst"), F.col("new_id").alias("_d"))
    return edges.join(a, "src").join(b, "dst", "left").select(F.col("_s").alias("src"), "pos", F.coalesce("_d", F.lit(0)).cast("long").alias("dst"))


def laid_out(rows: DataFrame, id_map: DataFrame, partitions: int) -> DataFrame:
    """Rows in new ids, written out by range of them, so that near ids share files and row groups."""
    moved = rows.join(id_map, F.col("id") == F.col("old_id")).drop("id", "old_id").withColumnRenamed("new_id", "id")
    return moved.repartitionByRange(partitions, "id").sortWithinPartitions("id")


def _both(edges: DataFrame, id_map: DataFrame, every: int) -> DataFrame:
    """Edges of every ``every``-th new id, with the ends in new and old ids."""
    a = id_map.where(F.col("new_id") % every == 0).select(F.col("old_id").alias("src"), F.col("new_id").alias("ns"))
    b = id_map.select(F.col("old_id").alias("dst"), F.col("new_id").alias("nd"))
    return edges.join(a, "src").join(b, "dst")


def edge_locality(edges: DataFrame, id_map: DataFrame, every: int = 64) -> DataFrame:
    gap, old = F.abs(F.col("nd") - F.col("ns")), F.abs(F.col("dst") - F.col("src"))
    share = lambda k: F.avg(F.when(gap <= k, 1.0).otherwise(0.0)).alias(f"within_{k}")
    return _both(edges, id_map, every).agg(F.count(F.lit(1)).alias("n_edges"), F.avg(gap).alias("mean_new"), F.avg(old).alias("mean_old"), share(64), share(256), share(4096))


def page_locality(edges: DataFrame, id_map: DataFrame, packed: int, capacity: int, every: int = 8) -> DataFrame:
    rows = _both(edges, id_map, every).where("src != dst")
    gap, old = F.abs(F.col("nd") - F.col("ns")), F.abs(F.col("dst") - F.col("src"))
    span = lambda c: page_span(F.col(c), packed, packed)
    pct = lambda cond, name: (F.avg(F.when(cond, 1.0).otherwise(0.0)) * 100).alias(name)
    return rows.agg(
        F.count(F.lit(1)).alias("n_edges"), pct(gap <= 1, "new_1"), pct(gap <= 2, "new_2"), pct(gap <= 3, "new_3"), pct(gap < capacity, "new_bin"), pct(gap <= 64, "new_64"),
        pct(spans_meet(span("ns"), span("nd")), "new_share"), pct(old <= 2, "old_2"), pct(spans_meet(span("src"), span("dst")), "old_share"),
    )


def pages_per_expansion(edges: DataFrame, id_map: DataFrame, nodes: DataFrame, packed: int) -> DataFrame:
    """Mean number of distinct pages that the neighbours of a node in ``nodes`` (id) lie on."""
    new = id_map.select(F.col("old_id").alias("dst"), F.col("new_id").alias("nd"))
    first, last = page_span(F.col("nd"), packed, packed)
    pages = edges.join(nodes.select(F.col("id").alias("src")), "src").where("src != dst").join(new, "dst").select("src", F.explode(F.sequence(first, last)).alias("page"))
    return pages.groupBy("src").agg(F.count_distinct("page").alias("n")).agg(F.count(F.lit(1)).alias("n_nodes"), F.avg("n").alias("mean_pages"))


def two_hop(edges: DataFrame, nodes: DataFrame, top: int) -> DataFrame:
    """(qid, id): the neighbours of a node's first ``top`` neighbours that are neither it nor its own neighbours."""
    own = edges.join(nodes.select(F.col("qid").alias("src")), "src").select(F.col("src").alias("qid"), "pos", F.col("dst").alias("via"))
    next_hop = own.where(F.col("pos") <= top).join(edges.select(F.col("src").alias("via"), F.col("dst").alias("id")), "via").select("qid", "id").where("qid != id").distinct()
    return next_hop.join(own.select("qid", F.col("via").alias("id")), ["qid", "id"], "left_anti")


def cover_ranked(ids: DataFrame, page_of: Column, budget_pages: int) -> DataFrame:
    """(qid, rank, page, cover) of the pages that hold most of a query's ids, at most ``budget_pages``."""
    pages = ids.select("qid", page_of.alias("page")).groupBy("qid", "page").agg(F.count(F.lit(1)).alias("cover"))
    order = Window.partitionBy("qid").orderBy(F.col("cover").desc(), "page")
    return pages.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= budget_pages).select("qid", "rank", "page", "cover")


def budgeted(records: DataFrame, budgets: list[int], page: int) -> DataFrame:
    """(qid, budget, nth, id, charge): the records (qid, nth, id, first, last) that a query fetches in order within ``budgets`` bytes.

    A record is charged the pages of its span that the query doesn't hold yet; one that costs more than is left is passed over, and
    later ones are still tried. One that is held whole isn't fetched. A query's records are folded in one row: they are bounded by
    the search that names them.
    """
    each = records.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("nth", "id", "first", "last"))).alias("of")).withColumn("budget", F.explode(F.array(*[F.lit(b).cast("long") for b in budgets])))
    start = F.struct(F.col("budget").alias("left"), F.array().cast("array<bigint>").alias("held"), F.array().cast("array<struct<nth:bigint,id:bigint,charge:bigint>>").alias("took"))

    def step(state: Column, r: Column) -> Column:
        new = F.array_except(F.sequence(r["first"], r["last"]), state["held"])
        charge = F.size(new).cast("long") * page
        took = F.struct(r["nth"].cast("long").alias("nth"), r["id"].alias("id"), charge.alias("charge"))
        taken = F.struct((state["left"] - charge).alias("left"), F.concat(state["held"], new).alias("held"), F.concat(state["took"], F.array(took)).alias("took"))
        return F.when((charge > 0) & (charge <= state["left"]), taken).otherwise(state)

    return each.select("qid", "budget", F.inline(F.aggregate("of", start, step)["took"]))


def entry_pins(order: DataFrame, edges: DataFrame, base: DataFrame, vectors: int = 256) -> DataFrame:
    """(id, part, bytes) that a search keeps at hand: of the entry nodes ``order`` (id, ord), all neighbour lists and the first ``vectors`` vectors."""
    lists = edges.join(order, F.col("src") == F.col("id")).groupBy("id").agg((F.count(F.lit(1)) * 4).alias("bytes"))
    near = order.where(F.col("ord") < vectors).join(base.select("id", "vec"), "id")
    return lists.select("id", F.lit("neighbours").alias("part"), "bytes").unionByName(near.select("id", F.lit("vector").alias("part"), (F.size("vec").cast("long") * 4).alias("bytes")))
