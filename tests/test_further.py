"""Navigable graphs, byte budgets, and reports on the steps of a search, against plain loops."""

import random
from collections import Counter, OrderedDict, defaultdict

import numpy as np
import pytest

from nearfield.operators import graph as G
from nearfield.operators import navigable as N
from nearfield.operators import near_graph as near_graphs
from nearfield.operators import search as S
from nearfield.operators import traces as T
from nearfield.operators.exact import knn
from nearfield.operators.near_graph import near_graph


@pytest.fixture(scope="module")
def cloud(spark):
    rng = np.random.default_rng(11)
    vecs = rng.standard_normal((400, 6)).astype(np.float32)
    vecs[7] = vecs[8]
    rows = spark.createDataFrame([(i, v.tolist(), i % 5) for i, v in enumerate(vecs)], "id long, vec array<float>, label int")
    return rows, vecs.astype(np.float64)


def plain_prune(cands, vecs, degree, alpha):
    kept = []
    for d, c in sorted(cands):
        if len(kept) < degree and all(alpha**2 * ((vecs[k] - vecs[c]) ** 2).sum() > d for _, k in kept):
            kept.append((d, c))
    return kept


def test_navigable_graph_against_plain_pruning(cloud):
    rows, vecs = cloud
    near = G.knn_graph(rows, 20)
    lists, back = defaultdict(set), defaultdict(list)
    for r in near.collect():
        lists[r.src].add((r.dist, r.dst))
        back[r.dst].append((r.dist, r.src))
    for p, some in back.items():
        lists[p] |= set(sorted(some)[:24])
    first = {p: plain_prune(c, vecs, 8, N.ALPHA) for p, c in lists.items()}
    both, back = {p: set(c) for p, c in first.items()}, defaultdict(list)
    for p, some in first.items():
        for d, c in some:
            back[c].append((d, p))
    for p, some in back.items():
        both[p] |= set(sorted(some)[:24])
    want = {p: [c for _, c in (sorted(c) if len(c) <= 8 else plain_prune(c, vecs, 8, N.ALPHA))] for p, c in both.items()}
    got = {r.src: r.nbrs for r in G.neighbours(N.navigable(near, rows, 8, width=24)).collect()}
    assert got == want and max(map(len, got.values())) <= 8


def test_level_is_bounded_and_entries_are_its_nearest(spark, cloud):
    rows, vecs = cloud
    top = [r.id for r in N.level(rows.select("id", "vec"), 32).collect()]
    assert 16 <= len(top) <= 64 and N.level(rows, 1000).count() == 400
    wide = spark.range(100).selectExpr("id * 92233720368547758 - 4611686018427387904 AS id", "array(1f) AS vec")
    assert 1 <= N.level(wide, 10).count() <= 20  # ids of any size
    asked = rows.where("id < 20").selectExpr("id AS qid", "vec AS qvec")
    for r in N.entries(rows, asked, 32).collect():
        assert r.entry == min(top, key=lambda i: (((vecs[i] - vecs[r.qid]) ** 2).sum(), i))


def test_near_graph_rounds_find_what_cells_miss(spark):
    """Rows of few intrinsic dimensions in many cells: rounds of local joins bring nearly all neighbours."""
    rng = np.random.default_rng(12)
    x = (rng.standard_normal((3000, 6)) @ rng.standard_normal((6, 24))).astype(np.float32)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<float>")
    d = ((x[:, None, :].astype(np.float64)[::20] - x[None]) ** 2).sum(2)
    d[np.arange(len(d)), np.arange(0, 3000, 20)] = np.inf
    want = np.argsort(d, axis=1)[:, :8]
    got = defaultdict(set)
    for r in near_graph(rows, 8, orders=2, cell_rows=64).where("src % 20 = 0").collect():
        got[r.src].add(r.dst)
        assert r.dist == pytest.approx(d[r.src // 20, r.dst])
    assert np.mean([len(got[20 * k] & set(w.tolist())) / 8 for k, w in enumerate(want)]) > 0.95


def test_near_graph_rounds_move_a_vector_once_a_block(spark):
    """A round equals a plain one over all neighbourhoods, and brings a block each vector once."""
    rng = np.random.default_rng(13)
    n, degree, blocks = 300, 6, 3
    x = rng.standard_normal((n, 5)).astype(np.float32).astype(np.float64)
    d = np.array([[np.add.accumulate((b - a) * (b - a))[-1] for b in x] for a in x])
    lists = {i: sorted((d[i, j], j) for j in rng.permutation(n).tolist() if j != i and rng.random() < 0.3)[: degree - (i % 7 == 0)] for i in range(n)}
    fresh = {(i, j): bool(rng.random() < 0.1) for i in lists for _, j in lists[i]}
    edges = spark.createDataFrame([(i, j, float(v), fresh[i, j], k + 1) for i in lists for k, (v, j) in enumerate(lists[i])], "src long, dst long, dist double, new boolean, pos int")
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<float>")
    reach = {i: lists[i][-1][0] if len(lists[i]) == degree else np.inf for i in lists}
    best = {i: {(v, j) for v, j in lists[i]} for i in lists}
    slots = 0
    for u in range(n):
        new = defaultdict(bool)
        for _, j in lists[u]:
            new[j] |= fresh[u, j]
        for _, i in sorted((v, i) for i in lists for v, j in lists[i] if j == u)[:degree]:
            new[i] |= fresh[i, u]
        if any(new.values()):
            new[u] = False
            slots += len(new)
            for i, j in ((i, j) for i in new for j in new if i != j and (new[i] or new[j]) and d[i, j] <= reach[i]):
                best[i].add((d[i, j], j))
    more = near_graphs._joined(edges, rows, blocks, degree, "l2").collect()
    got = {i: set(lists[i]) for i in lists}
    for r in more:
        got[r.src].add((r.dist, r.dst))
    assert all(sorted(got[i])[:degree] == sorted(best[i])[:degree] for i in lists)
    needed = near_graphs._needed(near_graphs._neighbourhoods(edges, blocks, degree))
    assert needed.count() == needed.distinct().count() <= blocks * n < slots
    for size in (10_000, 100_000, 600_000):  # vectors a row that a round moves don't grow with the table while it fits a block
        assert near_graphs._blocks(size, 64, 64, 12) <= 19


def test_near_graph_blocks_gather_a_bounded_number_of_edges(spark, monkeypatch):
    """Passes over a block's neighbourhoods find what one pass does, and none sorts more edges than a bound."""
    rng = np.random.default_rng(14)
    x = rng.standard_normal((240, 4)).astype(np.float32)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<float>")
    lists = {i: rng.choice([j for j in range(240) if j != i], 8, replace=False).tolist() for i in range(240)}
    dist = lambda i, j: float(((x[i].astype(np.float64) - x[j]) ** 2).sum())
    edges = spark.createDataFrame([(i, j, d, True, k) for i in lists for k, (d, j) in enumerate(sorted((dist(i, j), j) for j in lists[i]), 1)], "src long, dst long, dist double, new boolean, pos int")
    found = lambda: sorted(tuple(r) for r in near_graphs._joined(edges, rows, 2, 8, "l2").collect())
    whole, best = found(), near_graphs._best

    def bounded(edges, degree):
        assert len(edges[0]) <= 1000 + 600 + 17 * 17  # what is kept, what is new, and the last neighbourhood
        return best(edges, degree)

    monkeypatch.setattr(near_graphs, "PASS_MET", 1000)
    monkeypatch.setattr(near_graphs, "MOST_MET", 600)
    monkeypatch.setattr(near_graphs, "_best", bounded)
    assert found() == whole and len(whole) > 2000


def test_knn_by_label_and_length(spark):
    base = spark.createDataFrame([(1, [0.0, 0.0], 1), (2, [1.0, 0.0], None), (3, [2.0, 0.0], 1), (4, [1.0], 1)], "id long, vec array<double>, label int")
    asked = spark.createDataFrame([(10, [0.0, 0.0], 1), (11, [0.0, 0.0], None), (12, [5.0], 1)], "qid long, qvec array<double>, label int")
    pairs = lambda df: sorted((r.qid, r.id) for r in df.collect())
    assert pairs(knn(base, asked, 5, match="label")) == [(10, 1), (10, 3), (12, 4)]
    assert pairs(knn(base, asked, 5)) == [(q, i) for q in (10, 11) for i in (1, 2, 3)] + [(12, 4)]
    with pytest.raises(ValueError, match="different length"):
        knn(base, asked.selectExpr("qid", "concat(qvec, qvec, qvec) AS qvec"), 5)
    assert knn(base.where("false"), asked, 5).count() == 0


@pytest.mark.parametrize("most", [8, 400])
def test_search_by_label_is_completed_exactly(spark, cloud, most):
    """A label that a walk doesn't reach, universal rows and dummies."""
    rows, vecs = cloud
    rows = rows.selectExpr("id", "vec", "CASE WHEN id >= 397 THEN 77 WHEN id % 50 = 3 THEN 9 WHEN id % 40 = 7 THEN NULL ELSE label END AS label")
    labels = {r.id: r.label for r in rows.collect()}
    asked = rows.where("id % 57 = 0 or id = 399").selectExpr("id AS qid", "vec AS qvec", "label").unionByName(spark.createDataFrame([(1000, [0.0] * 6, None)], "qid long, qvec array<float>, label int"))
    adj = S.adjacency(G.knn_graph(rows, 6), rows, "label")
    found = defaultdict(list)
    for r in S.labelled(asked, adj, rows, 0, 8, 5, most=most, universal=9, dummy=lambda i: i % 11 == 0).orderBy("qid", "rank").collect():
        found[r.qid].append(r.id)
    for q in asked.collect():
        takes = [i for i in labels if i % 11 and (labels[i] == 9 or labels[i] is not None and labels[i] == q.label)]
        want = sorted(takes, key=lambda i: (((vecs[i] - np.array(q.qvec, np.float64)) ** 2).sum(), i))[:5]
        assert len(found[q.qid]) == len(want) and set(found[q.qid]) <= set(takes)
        if q.label in (77, None):
            assert len(set(found[q.qid]) & set(want)) >= 4


def test_budgets_pass_over_what_costs_too_much(spark):
    records = spark.createDataFrame([(1, 1, 10, 0, 1), (1, 2, 11, 1, 1), (1, 3, 12, 5, 7), (1, 4, 13, 2, 2), (1, 5, 14, 1, 2), (2, 1, 10, 0, 0)], "qid long, nth long, id long, first long, last long")
    got = sorted(tuple(r) for r in G.budgeted(records, [100, 300, 0], 100).collect())
    assert got == [(1, 100, 2, 11, 100), (1, 300, 1, 10, 200), (1, 300, 4, 13, 100), (2, 100, 1, 10, 100), (2, 300, 1, 10, 100)]


def some_steps(seed, queries=12, hops=9, degree=5, nodes=60):
    rng = random.Random(seed)
    graph = {n: [rng.randrange(nodes) for _ in range(degree)] for n in range(nodes)}
    return graph, [(q, h, src, pos, dst) for q in range(queries) for h in range(hops) for src in [rng.randrange(nodes)] for pos, dst in enumerate(graph[src], 1)]


@pytest.mark.parametrize("seed", [1, 2])
def test_next_hits_against_a_stepped_cache(spark, seed):
    _, steps = some_steps(seed)
    got = {r.capacity: (r.total, r.hits) for r in T.next_hits(spark.createDataFrame(steps, "qid long, hop int, src long, pos int, id long").repartition(5), [1, 4, 16, 64]).collect()}
    for capacity in (1, 4, 16, 64):
        cache: OrderedDict = OrderedDict()
        hits, at = 0, 0
        while at < len(steps):
            one = [s for s in steps[at : at + 5]]
            hits += sum(s[4] in cache for s in one)
            for s in one:
                cache[s[4]] = None
                cache.move_to_end(s[4])
                if len(cache) > capacity:
                    cache.popitem(last=False)
            at += 5
        assert got[capacity] == (len(steps), hits)


@pytest.mark.parametrize("block", [3, 1 << 16])
def test_promotions_against_a_stepped_run(spark, block):
    graph, steps = some_steps(3)
    rng = random.Random(4)
    dist = {(q, i): rng.random() for q in range(12) for i in range(60)}
    trace = spark.createDataFrame([(*s, dist[s[0], s[4]]) for s in steps], "qid long, hop int, src long, pos int, id long, dist double")
    edges = spark.createDataFrame([(s, p, d) for s, ds in graph.items() for p, d in enumerate(ds, 1)], "src long, pos int, dst long")
    got = {r.top: (r.promoted, r.used, r.leftover) for r in T.promoted_per_step(trace, edges, 0, [0, 1, 2, 5, 9], block).collect()}
    for top in (0, 1, 2, 5, 9):
        waiting: set = set()
        count = Counter()
        for q in range(12):
            visited = {0}
            for h in range(9):
                one = [s for s in steps if s[0] == q and s[1] == h]
                for s in one:
                    if s[4] in waiting:
                        count["used"] += 1
                        waiting.discard(s[4])
                    visited.add(s[4])
                for s in sorted(one, key=lambda s: (dist[q, s[4]], s[4], s[3]))[:top]:
                    for i in graph[s[4]]:
                        if i not in visited and i not in waiting:
                            waiting.add(i)
                            count["promoted"] += 1
        assert got[top] == (count["promoted"], count["used"], len(waiting))


def test_scratches_of_threads_and_inner_scratches_keep_apart(spark):
    import threading
    from pathlib import Path

    from nearfield.sources.tables import new_path, scratch, shared_dir, written

    folder = Path(shared_dir(spark).removeprefix("file://"))
    with scratch(spark):
        outer = new_path(spark, "outer")
        with scratch(spark):
            written(spark.range(3), path=outer)
            inner = written(spark.range(3), "inner")
            assert inner.count() == 3
        assert Path(outer.removeprefix("file://")).exists() and not list(folder.glob("inner-*"))
        thread = threading.Thread(target=lambda: written(spark.range(2), "elsewhere"))
        thread.start()
        thread.join()
    assert not Path(outer.removeprefix("file://")).exists() and list(folder.glob("elsewhere-*"))


def test_descent_through_layers(spark, cloud):
    """Every layer holds those above it, and the way down is that of a plain greedy search in each."""
    rows, vecs = cloud
    rows, ids = rows.select("id", "vec"), range(len(vecs))
    asked = rows.where("id % 40 = 3").selectExpr("id AS qid", "vec AS qvec")
    key = {i: i * N.MULTIPLIER % N.MODULUS for i in ids}
    made = []

    def build(layer):
        made.append(sorted(r.id for r in layer.collect()))
        return G.knn_graph(layer, 5)

    got = {r.qid: (r.entry, r.n_expand) for r in N.descended(rows, asked, build, most=10, ratio=5, width=3).collect()}
    top = sorted(ids, key=lambda i: (key[i], i))[:10]
    assert len(made) == 2 and set(top) <= set(made[0]) <= set(made[1]) < set(ids)  # 50, then 250 rows
    far = lambda q, i: ((vecs[i] - vecs[q]) ** 2).sum()
    for q in range(3, 400, 40):
        at, hops = min(top, key=lambda i: (far(q, i), i)), 0
        for layer in made:
            near = {i: sorted((x for x in layer if x != i), key=lambda x: (far(i, x), x))[:5] for i in layer}
            best, seen, done = [(far(q, at), at)], {at}, set()
            while todo := [i for _, i in best if i not in done]:
                done.add(todo[0])
                hops += 1
                best = sorted(best + [(far(q, x), x) for x in near[todo[0]] if x not in seen])[:3]
                seen |= set(near[todo[0]])
            at = best[0][1]
        assert got[q] == (at, hops)
    assert N.descended(rows.limit(0), asked, build).count() == 0 and N.descended(rows, asked.limit(0), build, 10, 5).count() == 0
