"""One-shot search that looks up several open candidates at once, for several widths in the same supersteps."""

import random

import pytest
from pyspark.sql import functions as F

from nearfield.operators import search as S


@pytest.mark.parametrize("width,iters,ahead", [(1, None, 1), (4, None, 3), (12, None, 4), (6, 5, 4)])
def test_walk_against_one_that_looks_up_one_at_a_time(width, iters, ahead):
    rng = random.Random(width)
    for _ in range(60):
        n = 40
        far = [float(rng.randrange(9)) for _ in range(n)]  # many ties
        graph = {i: [(j, far[j]) for j in rng.choices(range(n), k=5)] for i in range(n)}  # with repeats
        want, met, steps = [(far[0], 0, False)], {0}, 0
        while (iters is None or steps < iters) and not all(c[2] for c in want):
            at = next(c for c in want if not c[2])
            fresh = {j for j, _ in graph[at[1]]} - met
            met |= fresh
            want = sorted([c if c != at else (*c[:2], True) for c in want] + [(far[j], j, False) for j in fresh])[:width]
            steps += 1
        cand, seen, done, trips = [(far[0], 0, False)], {0}, 0, 0
        while (iters is None or done < iters) and not all(c[2] for c in cand):
            at_hand = {i: graph[i] for i in [i for _, i, gone in cand if not gone][:ahead]}
            cand, done = S._walked(cand, seen, done, at_hand, width, iters)
            trips += 1
        assert (cand, seen, done) == (want, met, steps) and trips <= steps


def test_sweep_gives_each_width_its_own_walk(spark):
    rng = random.Random(5)
    points = {i: [rng.random() for _ in range(3)] for i in range(60)}
    base = spark.createDataFrame(list(points.items()), "id long, vec array<float>")
    edges = spark.createDataFrame([(i, p, j) for i in points for p, j in enumerate(rng.sample(range(60), 4), 1)], "src long, pos int, dst long")
    asked = base.where("id % 9 = 0").select(F.col("id").alias("qid"), F.col("vec").alias("qvec"))
    twice = asked.unionByName(asked.where("qid = 9").withColumn("qvec", F.reverse("qvec")))  # an id that is asked with two vectors
    adj = S.adjacency(edges, base)
    swept = S.greedy_sweep(twice, adj, base, 0, [2, 5], 3, "width").collect()
    for width in (2, 5):
        alone = S.greedy(twice, adj, base, 0, width, 3).collect()
        assert sorted(tuple(r) for r in alone) == sorted(tuple(r)[:-1] for r in swept if r.width == width)
    assert sum(r.qid == 9 for r in swept) == 2 * (2 + 3)


def _cloud(spark, n: int, dim: int):
    rng = random.Random(n)
    base = spark.createDataFrame([(i, [rng.random() for _ in range(dim)]) for i in range(n)], "id long, vec array<float>")
    edges = spark.createDataFrame([(i, p, j) for i in range(n) for p, j in enumerate([(i + 1) % n, (i + 7) % n, rng.randrange(n)], 1)], "src long, pos int, dst long")
    return base, edges, base.where("id % 17 = 0").select(F.col("id").alias("qid"), F.col("vec").alias("qvec"))


@pytest.mark.parametrize("entry", [0, None])
def test_supersteps_that_read_ids_look_hops_ahead_and_walk_alike(spark, monkeypatch, entry):
    base, edges, asked = _cloud(spark, 200, 4)
    asked = asked if entry == 0 else asked.withColumn("entry", F.pmod(F.col("qid") * 3, F.lit(200)))
    adj, supersteps, written = S.adjacency(edges, base), [], S.written
    monkeypatch.setattr(S, "written", lambda df, name: supersteps.append(name) or written(df, name))
    found, took = [], []
    for most in (0, 1 << 14):  # none, and all
        monkeypatch.setattr(S, "FEW_MET", (most, most))
        supersteps.clear()
        found.append(sorted(tuple(r) for r in S.greedy(asked, adj, base, entry, 6, 4).collect()))
        took.append(len(supersteps))
    assert found[0] == found[1] and len(found[0]) == 4 * 12
    assert took[1] < 0.7 * took[0]


def test_small_layers_are_walked_in_one_pass(spark, monkeypatch):
    from nearfield.operators import navigable as N

    base, edges, asked = _cloud(spark, 300, 3)
    inside = lambda layer: edges.join(layer.select(F.col("id").alias("dst")), "dst").select("src", "pos", "dst")
    odd = asked.unionByName(spark.createDataFrame([(1000, [0.5, None, 0.5])], "qid long, qvec array<float>"))  # null distances

    def ways():
        return sorted((r.qid, r.entry, r.n_expand) for r in N.descended(base, asked, inside, most=8, ratio=5, width=3, layers=2).collect())

    def walks(at, held):
        if held:
            return sorted((r.qid, r.entry, r.n_expand) for r in S.greedy_held(at.withColumn("n_expand", F.lit(0).cast("long")), edges, base, 3).collect())
        return sorted((r.qid, r.id, r.n_expand) for r in S.greedy(at, S.adjacency(edges, base), base, None, 3, 1).collect())

    entered = odd.withColumn("entry", F.when(F.col("qid") == 34, 5000).otherwise(F.pmod("qid", F.lit(300))))  # one enters nowhere
    assert walks(entered, True) == walks(entered, False)
    with monkeypatch.context() as m:
        m.setattr(N, "greedy", None)  # no supersteps
        found = ways()
    monkeypatch.setattr(S, "HELD_ROWS", 10)
    assert S.greedy_held(entered.withColumn("n_expand", F.lit(0).cast("long")), edges, base, 3) is None
    assert ways() == found and len(found) == 18


def test_occlusion_is_decided_by_exact_sums():
    import numpy as np

    from nearfield.operators import navigable as N

    rng = np.random.default_rng(4)
    for turn in range(200):
        x = rng.integers(0, 3, (rng.integers(1, 80), 3)).astype(float) + (turn % 3) * 1e7  # ties and copies, far from the origin
        dist = ((x - x[0]) ** 2).sum(1)
        order = np.argsort(dist, kind="stable")
        x, dist = x[order], dist[order]
        want = []
        for i in range(len(x)):
            if len(want) < 5 and all(1.44 * ((x[i] - x[j]) ** 2).sum() > dist[i] for j in want):
                want.append(i)
        assert N.kept_by_occlusion(x, dist, 5, 1.2) == want


def test_a_graph_that_tasks_hold_is_walked_without_supersteps(spark, monkeypatch):
    """Equal to the supersteps, with copies of vectors, ids of any sign, links to rows without a vector, and rows without links."""
    from nearfield.operators import held as H

    rng = random.Random(8)
    ids = [rng.randrange(-(1 << 40), 1 << 40) for _ in range(150)]
    points = {i: [float(rng.randrange(3)) for _ in range(3)] for i in ids}
    base = spark.createDataFrame(list(points.items()), "id long, vec array<float>")
    links = [(i, p, j) for i in ids[:140] for p, j in enumerate([*rng.sample(ids, 3), 1 << 50], 1)]
    edges = spark.createDataFrame(links, "src long, pos int, dst long").repartition(3)
    asked = base.where("id % 3 = 0").select(F.col("id").alias("qid"), F.col("vec").alias("qvec"))
    entered = asked.withColumn("entry", F.when(F.col("qid") % 2 == 0, ids[0]).otherwise(F.lit(5)))  # no row has the id 5
    monkeypatch.setattr(H, "LEAST_QUERIES", 8)
    monkeypatch.setattr(H, "PACK_ROWS", 20)
    adj, held, kept = S.adjacency(edges, base), S.walkable(edges, base), lambda df: sorted(tuple(r) for r in df.collect())
    assert isinstance(held, H.Held)
    limits = [(3, 5), (8, 30), (200, 200)]
    for graph, out in ((adj, want := []), (held, got := [])):
        with monkeypatch.context() as m:
            if graph is held:
                m.setattr(S, "written", None)
            out += [S.greedy_sweep(asked, graph, base, ids[0], [2, 9], 4, "width"), S.greedy(entered, graph, base, None, 5, 4, "mips", 7), S.best_first_sweep(asked, graph, base, ids[0], limits, 4, "ef", traced=False)[0]]
    assert [kept(df) for df in want] == [kept(df) for df in got] and [df.columns for df in want] == [df.columns for df in got]
    odd = asked.limit(1).withColumn("qvec", F.expr("array(1f, null, 0f)"))
    assert kept(S.greedy(odd, held, base, ids[0], 3, 2)) == kept(S.greedy(odd, adj, base, ids[0], 3, 2))  # left to the supersteps
    for other in (base.unionByName(base.limit(1)), base.withColumn("vec", F.slice("vec", 1, F.pmod("id", F.lit(3)).cast("int") + 1)), base.withColumn("vec", F.col("vec").cast("array<double>"))):
        assert H.held(edges, other) is None
    monkeypatch.setattr(H, "HELD_NUMBERS", 150 * 3 + len(links) - 1)
    assert H.held(edges, base) is None


def test_registered_hop_sweep_needs_no_superstep(spark, sf_dir, monkeypatch):
    from nearfield.plans import catalog

    written = S.written

    def few(df, name):
        assert name != "search"
        return written(df, name)

    monkeypatch.setattr(S, "written", few)
    assert {r.ef for r in catalog.QUERIES["ef_sweep"](spark, sf_dir).collect()} == {100, 200, 400, 800, 1600}


def test_registered_search_from_entries_needs_no_superstep(spark, sf_dir, monkeypatch):
    from nearfield.plans import further

    monkeypatch.setattr(S, "written", None)  # of this module, supersteps alone write
    found = {r.entry: r for r in further.navigable_entries(spark, sf_dir).collect()}
    assert set(found) == {"level", "first"} and all(r.recall > 0.9 and r.n_queries == 50 for r in found.values())
