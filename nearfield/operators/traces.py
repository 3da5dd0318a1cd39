"""Reports over an access trace (qid, seq, id): first touches, pins, frequencies, reuse.

A cache of whole records that keeps the most recently used ones hits exactly where fewer distinct
records than its capacity were touched since the last touch of the same one. So hit rates for any
number of capacities come from one reuse-distance table, and no cache is stepped through. Distances
reach over the whole trace, or only within sessions where the caches are emptied between these.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import written
from .ordering import numbered

#: Values of the earlier touch that are ranked in one window.
CELL = 4096


def first_touches(trace: DataFrame) -> DataFrame:
    """(qid, fetches, misses) of a cache that never drops anything: only a record's first touch misses."""
    nth = F.row_number().over(Window.partitionBy("id").orderBy("seq"))
    return trace.withColumn("nth", nth).groupBy("qid").agg(F.count(F.lit(1)).alias("fetches"), F.count(F.when(F.col("nth") == 1, 1)).alias("misses"))


def pinned_hits(trace: DataFrame, pinned: DataFrame) -> DataFrame:
    """(qid, fetches, hits, hit_pct) where pinned (id) always hits."""
    held = trace.join(pinned.select("id").distinct().withColumn("held", F.lit(1)), "id", "left")
    return held.groupBy("qid").agg(F.count(F.lit(1)).alias("fetches"), F.count("held").alias("hits")).withColumn("hit_pct", F.col("hits") * 100.0 / F.col("fetches"))


def frequencies(trace: DataFrame) -> DataFrame:
    return trace.groupBy("id").agg(F.count(F.lit(1)).alias("n"))


def unique_per_query(trace: DataFrame) -> DataFrame:
    return trace.groupBy("qid").agg(F.count(F.lit(1)).alias("fetches"), F.count_distinct("id").alias("unique_ids"))


def reuse_distances(trace: DataFrame, session: Column) -> DataFrame:
    """(session, seq, id, distance): distinct other records since the last touch of the same one in the session; null at first."""
    rows = trace.withColumn("session", session)
    own = Window.partitionBy("session", "id").orderBy("seq")
    rows = rows.select("session", "seq", "id", F.lag("seq").over(own).alias("before"), F.lead("seq").over(own).alias("after"))
    # of the touches between, count those that are the last of their record before this one
    a, b = rows.alias("a"), rows.alias("b")
    between = (F.col("a.session") == F.col("b.session")) & (F.col("b.seq") > F.col("a.before")) & (F.col("b.seq") < F.col("a.seq")) & (F.coalesce(F.col("b.after"), F.lit(2**62)) >= F.col("a.seq"))
    counted = a.where("before is not null").join(b, between, "left").groupBy(F.col("a.session").alias("session"), F.col("a.seq").alias("seq"), F.col("a.id").alias("id")).agg(F.count("b.seq").alias("distance"))
    return counted.unionByName(rows.where("before is null").select("session", "seq", "id", F.lit(None).cast("long").alias("distance")))


def whole_reuse_distances(trace: DataFrame) -> DataFrame:
    """(seq, id, distance): distinct other records since the last touch of the same one in the whole trace; null at first.

    Of the touches between, those whose record comes again before this touch are left out: they are the
    earlier touches of pairs that lie within this one's, so a pair counts the pairs that end before it and
    begin after it. Places are compared bit by bit: at each bit, the pairs of a block's left half are counted
    for those of its right half, in cells of CELL beginnings whose sums are carried on; no task has a whole block.
    """
    rows = numbered(trace.select("seq", "id"), ["seq", "id"], "n")
    own = Window.partitionBy("id").orderBy("n")
    rows = written(rows.select("seq", "id", "n", F.lag("n").over(own).alias("before")), "touches")
    bits = max(1, int(rows.agg(F.max("n")).first()[0] or 0).bit_length())
    pairs = rows.where("before is not null").select("n", "before", F.explode(F.sequence(F.lit(0), F.lit(bits - 1))).alias("bit"))
    left = (F.lit(1) - F.expr("shiftright(n, bit) & 1")).cast("long")
    pairs = pairs.select("n", "before", "bit", F.expr("shiftright(n, bit + 1)").alias("block"), F.call_function("div", F.col("before"), F.lit(CELL)).alias("cell"), left.alias("left"))
    to_here = Window.partitionBy("bit", "block", "cell").orderBy(F.col("before").desc())
    later = Window.partitionBy("bit", "block").orderBy(F.col("cell").desc()).rowsBetween(Window.unboundedPreceding, -1)
    sums = pairs.groupBy("bit", "block", "cell").agg(F.sum("left").alias("lefts"))
    sums = sums.select("bit", "block", "cell", F.coalesce(F.sum("lefts").over(later), F.lit(0)).alias("carried"))
    inside = pairs.withColumn("here", F.sum("left").over(to_here.rowsBetween(Window.unboundedPreceding, Window.currentRow))).where("left = 0")
    nested = inside.join(sums, ["bit", "block", "cell"]).groupBy("n").agg(F.sum(F.col("here") + F.col("carried")).alias("nested"))
    distance = F.col("n") - F.col("before") - 1 - F.coalesce("nested", F.lit(0))
    return rows.join(nested, "n", "left").select("seq", "id", distance.cast("long").alias("distance"))


def next_hits(trace: DataFrame, capacities: list[int]) -> DataFrame:
    """(capacity, total, hits, hit_pct): of the neighbours of expanded nodes, those that a cache of the most recently used records holds at the moment of expansion.

    ``trace`` is (qid, hop, src, pos, id), fetched in that order. A neighbour's distance at its own fetch counts the fetches of its
    expansion before it; those that were last touched before the neighbour was, or never, are taken off again.
    """
    ordered = numbered(trace.select("qid", "hop", "pos", "id"), ["qid", "hop", "pos"], "seq")
    ordered = written(ordered.select("qid", "hop", "pos", "id", "seq"), "fetches")
    distances = whole_reuse_distances(ordered.select("seq", "id"))
    before = F.lag("seq").over(Window.partitionBy("id").orderBy("seq"))
    known = ordered.withColumn("before", before).join(distances.select("seq", "distance"), "seq")
    # an expansion's fetches in one row, as many as the node has neighbours
    one = known.groupBy("qid", "hop").agg(F.array_sort(F.collect_list(F.struct("pos", "id", F.coalesce("before", F.lit(-1)).alias("before"), "distance"))).alias("of"))
    firsts = F.filter("of", lambda x, i: ~F.exists(F.slice("of", F.lit(1), i), lambda y: y["id"] == x["id"]))
    one = one.withColumn("first", firsts)

    def at_expansion(x: Column) -> Column:
        of = F.filter("first", lambda y: y["id"] == x["id"])[0]
        later = F.size(F.filter("first", lambda y: (y["pos"] < of["pos"]) & (y["before"] < of["before"])))
        return of["distance"] - later

    each = one.select(F.explode(F.transform("of", at_expansion)).alias("distance"))
    return hit_rates(each, capacities).withColumnRenamed("accesses", "total")


def promoted_per_step(trace: DataFrame, edges: DataFrame, entry: int, tops: list[int], block: int = 1 << 16) -> DataFrame:
    """(top, promoted, used, leftover): neighbours of each expansion's ``top`` nearest neighbours, promoted ahead, and how many are used.

    ``trace`` is (qid, hop, src, pos, id, dist). After an expansion, the neighbours of its ``top`` nearest are promoted, but
    for those that the query has fetched so far, the entry, and those that wait promoted since their last fetch by any query.
    A record that is promoted between two of its fetches is promoted once and used by the second. So promotions are the
    different pairs of a record and the number of its fetches before.
    """
    steps = trace.select("qid", "hop").distinct()
    steps = written(numbered(steps, ["qid", "hop"], "step").select("qid", "hop", "step"), "steps")
    of = written(trace.join(steps, ["qid", "hop"]), "fetches")
    rank = F.row_number().over(Window.partitionBy("qid", "hop").orderBy("dist", "id", "pos"))
    near = of.withColumn("nth", rank).where(F.col("nth") <= max(tops)).select("qid", "hop", "step", "nth", F.col("id").alias("via"))
    offers = near.join(edges.select(F.col("src").alias("via"), F.col("dst").alias("id")), "via").groupBy("qid", "hop", "step", "id").agg(F.min("nth").alias("nth"))
    held = of.groupBy("qid", "id").agg(F.min("hop").alias("since"))
    offers = offers.where(F.col("id") != entry).join(held, ["qid", "id"], "left").where(F.col("since").isNull() | (F.col("since") > F.col("hop")))
    # how often each record was fetched up to a step: counts by block of steps are carried on, so that no task has all fetches of a record
    place = lambda c: F.call_function("div", F.col(c), F.lit(block))
    fetches = of.groupBy("id", "step").agg(F.count(F.lit(1)).alias("n")).withColumn("block", place("step"))
    sums = fetches.groupBy("id", "block").agg(F.sum("n").alias("n"))
    carried = sums.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    events = fetches.select("id", "block", "step", "n", F.lit(None).cast("int").alias("nth")).unionByName(offers.select("id", place("step").alias("block"), "step", F.lit(0).cast("long").alias("n"), "nth"))
    inside = events.withColumn("here", F.sum("n").over(Window.partitionBy("id", "block").orderBy("step").rangeBetween(Window.unboundedPreceding, Window.currentRow))).where("nth is not null")
    # offers of blocks in which the record isn't fetched take the last block's sum before
    lasts = Window.partitionBy("id").orderBy("block", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    marks = carried.select("id", "block", F.lit(0).alias("kind"), "before", "n").unionByName(inside.select("id", "block").distinct().join(carried.select("id", "block"), ["id", "block"], "left_anti").select("id", "block", F.lit(1).alias("kind"), F.lit(None).cast("long").alias("before"), F.lit(None).cast("long").alias("n")))
    marks = marks.withColumn("sum", F.coalesce(F.last(F.col("before") + F.col("n"), ignorenulls=True).over(lasts), F.lit(0)))
    marks = marks.select("id", "block", F.when(F.col("kind") == 0, F.col("before")).otherwise(F.col("sum")).alias("carried"))
    epochs = inside.join(marks, ["id", "block"]).select("id", "nth", (F.col("here") + F.col("carried")).alias("epoch"))
    epochs = epochs.groupBy("id", "epoch").agg(F.min("nth").alias("nth"))
    total = sums.groupBy("id").agg(F.sum("n").alias("total"))
    used = epochs.join(total, "id", "left").select("nth", F.when(F.col("epoch") < F.col("total"), 1).alias("used"))
    table = trace.sparkSession.createDataFrame([(t,) for t in tops], "top int")
    counts = used.groupBy("nth").agg(F.count(F.lit(1)).alias("promoted"), F.count("used").alias("used"))  # a row a rank
    each = table.join(F.broadcast(counts), F.col("nth") <= F.col("top"), "left").groupBy("top").agg(F.coalesce(F.sum("promoted"), F.lit(0)).alias("promoted"), F.coalesce(F.sum("used"), F.lit(0)).alias("used"))
    return each.withColumn("leftover", F.col("promoted") - F.col("used"))


def hit_rates(distances: DataFrame, capacities: list[int]) -> DataFrame:
    """(capacity, accesses, hits, hit_pct) of a cache that keeps the most recently used records."""
    sized = distances.withColumn("capacity", F.explode(F.array(*[F.lit(c) for c in capacities])))
    return sized.groupBy("capacity").agg(F.count(F.lit(1)).alias("accesses"), F.count(F.when(F.col("distance") < F.col("capacity"), 1)).alias("hits")).withColumn("hit_pct", F.col("hits") * 100.0 / F.col("accesses"))


def target_misses(trace: DataFrame, targets: list[int]) -> DataFrame:
    """(target, pinned, fetches, misses, miss_pct): pinning a leading share of the sorted working set aims at a miss share."""
    ids = frequencies(trace)
    n = ids.agg(F.count(F.lit(1)).alias("total"))
    placed = numbered(ids, ["id"], "place", 1).join(F.broadcast(n)).withColumn("target", F.explode(F.array(*[F.lit(t) for t in targets])))
    held = F.col("place") <= F.floor((100 - F.col("target")) * F.col("total") / 100)
    return placed.groupBy("target").agg(F.count(F.when(held, 1)).alias("pinned"), F.sum("n").alias("fetches"), F.sum(F.when(held, 0).otherwise(F.col("n"))).alias("misses")).withColumn("miss_pct", F.col("misses") * 100.0 / F.col("fetches"))


def adaptive_beam(rates: Column, start: int = 32, least: int = 4, most: int = 64) -> Column:
    """Beam after each miss rate: halved above 0.45, doubled below 0.25, carried on."""
    def step(beams: Column, rate: Column) -> Column:
        b = F.element_at(beams, -1)
        nxt = F.when(rate > 0.45, F.greatest(F.lit(least), F.floor(b / 2).cast("int"))).when(rate < 0.25, F.least(F.lit(most), b * 2)).otherwise(b)
        return F.concat(beams, F.array(nxt.cast("int")))

    return F.slice(F.aggregate(rates, F.array(F.lit(start)), step), 2, F.greatest(F.size(rates), F.lit(1)))


def adaptive_beams(rates: DataFrame, by: str, start: int = 32, least: int = 4, most: int = 64, block: int = 1 << 16) -> DataFrame:
    """(by, beam): the beam after each row of ``rates`` (by, rate) in the order of ``by``, as in adaptive_beam.

    Each block of rows is reduced to a map from the beams there can be to the beam after it; only these maps,
    one row a block, are composed in one place, and each block is then replayed from its own start.
    """

    def after(beam: int, rate: float | None) -> int:
        if rate is not None and rate > 0.45:
            return max(least, beam // 2)
        return min(most, beam * 2) if rate is not None and rate < 0.25 else beam

    states, fresh = {start}, [start]
    while fresh:
        fresh = [x for x in {after(b, r) for b in fresh for r in (0.0, 1.0)} if x not in states]
        states.update(fresh)
    states = sorted(states)
    rows = numbered(rates.select(by, "rate"), [by], "_n")
    rows = written(rows.withColumn("_block", F.call_function("div", F.col("_n"), F.lit(block))), "rates")

    def ordered(table):
        return table.sort_by("_n")

    def reduced(table):
        import pyarrow as pa

        at = list(states)
        for rate in ordered(table).column("rate").to_pylist():
            at = [after(b, rate) for b in at]
        return pa.table({"_b": table.column("_block").slice(0, 1), "to": pa.array([at], pa.list_(pa.int32()))})

    def replayed(table):
        import pyarrow as pa

        table, beams = ordered(table), []
        beam = table.column("_start")[0].as_py()
        for rate in table.column("rate").to_pylist():
            beam = after(beam, rate)
            beams.append(beam)
        return pa.table({by: table.column(by), "beam": pa.array(beams, pa.int32())})

    maps = rows.groupBy("_block").applyInArrow(reduced, "_b long, to array<int>").orderBy("_b").collect()
    starts, beam = [], start
    for m in maps:
        starts.append((m["_b"], beam))
        beam = m["to"][states.index(beam)]
    begun = rows.join(rows.sparkSession.createDataFrame(starts, "_b long, _start int"), F.col("_block") == F.col("_b"))
    return begun.select(by, "rate", "_n", "_block", "_start").groupBy("_block").applyInArrow(replayed, f"{by} {rates.schema[by].dataType.simpleString()}, beam int")
