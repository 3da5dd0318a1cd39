"""Operators against worked examples, SQL and invariants."""

import math
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from nearfield.functions import pages as P
from nearfield.functions import vectors as V
from nearfield.operators import graph as G
from nearfield.operators import metrics as M
from nearfield.operators import search as S
from nearfield.operators import traces as T
from nearfield.operators.exact import knn
from nearfield.operators.near_graph import near_graph
from nearfield.operators.ordering import numbered
from nearfield.plans import catalog
from nearfield.sources import generate, vector_files

LINE = {0: [1, 2], 1: [0, 2], 2: [1, 3], 3: [2, 4], 4: [3, 5], 5: [4, 3]}


@pytest.fixture(scope="module")
def line(spark):
    base = spark.createDataFrame([(i, [float(i), 0.0], i % 2) for i in range(6)], "id long, vec array<float>, label int")
    graph = spark.createDataFrame(list(LINE.items()), "src long, nbrs array<long>")
    asked = spark.createDataFrame([(0, [4.2, 0.0])], "qid long, qvec array<float>")
    return base, G.edges_of(graph), asked


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_exact_worked(line):
    base, _, asked = line
    got = [(r.id, round(r.dist, 4)) for r in knn(base, asked, 2).orderBy("rank").collect()]
    assert got == [(4, 0.04), (5, 0.64)]
    assert knn(base, asked, 50).count() == 6
    assert [r.id for r in knn(base, base.select(F.col("id").alias("qid"), F.col("vec").alias("qvec")).where("id = 2"), 4, exclude_self=True).orderBy("rank").collect()] == [1, 3, 0, 4]
    with pytest.raises(Exception, match="different length"):
        knn(base, asked.select("qid", F.array(F.lit(1.0).cast("float")).alias("qvec")), 1).collect()


def test_greedy_worked(line):
    base, edges, asked = line
    adj = S.adjacency(edges, base)
    full = S.greedy(asked, adj, base, 0, 2, 2).orderBy("rank").collect()
    assert [r.id for r in full] == [4, 5] and full[0].n_dist == 6 and full[0].n_expand == 5
    once = S.greedy(asked, adj, base, 0, 2, 2, iters=1).orderBy("rank").collect()
    assert [(r.id, round(r.dist, 2)) for r in once] == [(2, 4.84), (1, 10.24)]


def test_hop_limited_worked(line):
    base, edges, asked = line
    found, trace = S.best_first(asked, S.adjacency(edges, base), base, 0, 2, 2, 2)
    assert trace.count() == 4  # with the entry, 1 + hops * degree fetches
    assert found.count() == 2


def test_greedy_doesnt_depend_on_partitions(spark, sf_dir):
    rows, asked = catalog.load(spark, sf_dir)
    adj = S.adjacency(catalog.graph(rows), rows)
    a = S.greedy(asked.repartition(1), adj, rows, 0, 10, 5)
    b = S.greedy(asked.repartition(7), adj, rows, 0, 10, 5)
    assert sorted(map(repr, a.collect())) == sorted(map(repr, b.collect()))


def test_superstep_equals_plain_loop(spark, sf_dir):
    """Greedy and best-first search against straightforward loops."""
    rows, asked = catalog.load(spark, sf_dir)
    edges = catalog.graph(rows, 8)
    vec = {r.id: np.array(r.vec, np.float64) for r in rows.collect()}
    nbrs = {r.src: r.nbrs for r in G.neighbours(edges).collect()}
    adj = S.adjacency(edges, rows)
    few = asked.where("qid < 100")
    d = lambda q, i: float(((vec[q] - vec[i]) ** 2).sum())

    def greedy(q, width, k):
        cand, seen, done = [(d(q, 0), 0)], {0}, set()
        while True:
            left = [c for c in cand if c[1] not in done]
            if not left:
                return [i for _, i in cand[:k]], len(seen), len(done)
            done.add(min(left)[1])
            at = min(left)[1]
            new = [n for n in nbrs[at] if n not in seen]
            seen.update(new)
            cand = sorted(cand + [(d(q, n), n) for n in new])[:width]

    got = {}
    for r in S.greedy(few, adj, rows, 0, 12, 5).orderBy("qid", "rank").collect():
        got.setdefault(r.qid, ([], r.n_dist, r.n_expand))[0].append(r.id)
    assert {q: tuple(g) for q, g in got.items()} == {q: greedy(q, 12, 5) for q in got}

    def best_first(q, beam, hops, k):
        best, front, seen = [(d(q, 0), 0)], [(d(q, 0), 0)], {0}
        for _ in range(hops):
            if not front:
                break
            at = front.pop(0)[1]
            for n in nbrs[at]:
                if n in seen:
                    continue
                seen.add(n)
                if len(best) < beam or d(q, n) < best[-1][0]:
                    best = sorted(best + [(d(q, n), n)])[:beam]
                    front = sorted(front + [(d(q, n), n)])
        return [i for _, i in best[:k]]

    got = {}
    for r in S.best_first(few, adj, rows, 0, 6, 5, 5)[0].orderBy("qid", "rank").collect():
        got.setdefault(r.qid, []).append(r.id)
    assert got == {q: best_first(q, 6, 5, 5) for q in got}


def test_label_filtered_search_finds_k_with_the_label(spark, sf_dir):
    found = catalog.QUERIES["label_filtered_search"](spark, sf_dir).collect()
    truth = catalog.QUERIES["exact_knn_label_filtered"](spark, sf_dir).collect()
    sizes = lambda rows: {q: sum(r.qid == q for r in rows) for q in {r.qid for r in rows}}
    assert sizes(found) == sizes(truth)
    true = {(r.qid, r.id) for r in truth}
    assert sum((r.qid, r.id) in true for r in found) / len(true) >= 0.95


def test_one_shot_search_runs_until_nothing_is_open(spark):
    """A path of 200 nodes, whose end is the answer."""
    base = spark.createDataFrame([(i, [float(i)]) for i in range(200)], "id long, vec array<float>")
    edges = spark.createDataFrame([(i, 1, i + 1) for i in range(199)], "src long, pos int, dst long")
    asked = spark.createDataFrame([(0, [199.0])], "qid long, qvec array<float>")
    found = S.greedy(asked, S.adjacency(edges, base), base, 0, 2, 1).collect()
    assert [(r.id, r.n_dist, r.n_expand) for r in found] == [(199, 200, 200)]


def test_hop_limited_search_arrives(spark, sf_dir):
    """The registered hops reach the neighbours, and so does the least ef of the sweep."""
    found = catalog.QUERIES["best_first_search"](spark, sf_dir)
    truth = knn(*catalog.load(spark, sf_dir), 10)
    assert np.mean([r.recall for r in M.recall(found, truth, 10).collect()]) >= 0.9
    got = {r.ef: r.recall for r in catalog.QUERIES["ef_sweep"](spark, sf_dir).collect()}
    assert set(got) == {100, 200, 400, 800, 1600} and min(got.values()) >= 0.95


def test_recall(spark):
    truth = spark.createDataFrame([(0, 1, 4), (0, 2, 3)], "qid long, rank int, id long")
    found = spark.createDataFrame([(0, 1, 4), (0, 2, 5), (0, 3, 4)], "qid long, rank int, id long")
    assert M.recall(found, truth, 2).first().recall == 0.5
    assert M.recall(found.withColumn("id", F.lit(9).cast("long")), truth, 2).first().recall == 0.0
    ladder = spark.createDataFrame([(10, 0.5), (20, 0.9), (40, 0.95)], "width int, recall double")
    assert M.first_enough(ladder, 0.9).first().width == 20


def test_graph_worked(line, spark):
    base, edges, _ = line
    assert {r.id: r.indegree for r in G.hubs(edges, 6).collect()} == {0: 1, 1: 2, 2: 3, 3: 3, 4: 2, 5: 1}
    assert [r.id for r in G.hubs(edges, 2).orderBy("rank").collect()] == [2, 3]
    order = G.breadth_first(edges, 2)
    id_map = G.permutation(order, base.select("id"))
    assert [r.old_id for r in id_map.orderBy("new_id").collect()] == [2, 1, 3, 0, 4, 5]
    new = G.remapped(edges, id_map)
    assert [r.dst for r in new.where("src = 0").orderBy("pos").collect()] == [1, 2]
    back = G.remapped(new, id_map.select(F.col("new_id").alias("old_id"), F.col("old_id").alias("new_id")))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, edges.select("src", "pos", "dst").collect()))
    moved = G.laid_out(base, id_map, 2)
    assert sorted(r.id for r in moved.collect()) == list(range(6))


def test_unreached_nodes_follow_in_order(spark):
    edges = spark.createDataFrame([(3, 1, 1), (1, 1, 3), (5, 1, 0)], "src long, pos int, dst long")
    ids = spark.range(6).toDF("id")
    id_map = G.permutation(G.breadth_first(edges, 3), ids)
    assert [r.old_id for r in id_map.orderBy("new_id").collect()] == [3, 1, 0, 2, 4, 5]


def test_near_graph_finds_most_neighbours_and_splits_repeats(spark):
    rng = np.random.default_rng(3)
    centers = rng.normal(size=(40, 24))
    spread = [(int(i), (centers[i % 40] + 0.4 * rng.normal(size=24)).tolist(), "x") for i in range(1200)]
    same = [(5000 + i, [1.0] * 24, "y") for i in range(600)]  # a third of all rows
    rows = spark.createDataFrame(spread + same, "id long, vec array<float>, dist string")
    found = near_graph(rows, 8, cell_rows=128).toPandas()
    assert found.groupby("src").size().eq(8).all() and found.src.nunique() == 1800
    assert (found.src != found.dst).all() and not found.duplicated(["src", "dst"]).any()
    assert (found[found.src >= 5000].dist == 0).all()  # which of equal rows are found, cells decide
    true = G.knn_graph(rows, 8).toPandas()
    pair = found.merge(true, on=["src", "dst"], suffixes=("", "_true"))
    assert (pair.dist == pair.dist_true).all()
    assert (pair.src < 5000).sum() >= 0.9 * 1200 * 8


def test_near_graph_of_few_rows_is_exact(spark):
    rows = spark.createDataFrame([(i, [float(i * i), float(i % 3)]) for i in range(30)], "id long, vec array<float>")
    key = ["src", "pos", "dst", "dist"]
    assert near_graph(rows, 4).select(key).orderBy(key).collect() == G.knn_graph(rows, 4).select(key).orderBy(key).collect()
    assert near_graph(rows.limit(1), 4).count() == 0 == near_graph(rows.where("id < 0"), 4).count()
    assert near_graph(rows.where("id < 3"), 4).count() == 6
    assert near_graph(rows, 4, "cosine", cell_rows=8).where("dist = double('infinity') or isnan(dist)").count() == 0


def test_padding(spark):
    rows = spark.createDataFrame([(1, [7]), (5, []), (6, [1, 2, 3, 4])], "src long, nbrs array<long>")
    got = {r.src: r.p for r in rows.select("src", G.padded(F.col("nbrs"), F.col("src"), 3).alias("p")).collect()}
    assert got == {1: [7, 7, 7], 5: [5, 5, 5], 6: [1, 2, 3]}


def test_level_beam_keeps_repeated_ids(spark):
    codes = spark.createDataFrame([(i, [i]) for i in range(4)], "id long, code array<smallint>")
    edges = spark.createDataFrame([(0, 1, 1), (0, 2, 2), (1, 1, 3), (2, 1, 3)], "src long, pos int, dst long")
    asked = spark.createDataFrame([(0, [3])], "qid long, qcode array<smallint>")
    assert [r.id for r in S.level_beam(asked, edges, codes, 0, 4, 0).collect()] == [0]
    assert [r.id for r in S.level_beam(asked, edges, codes, 0, 4, 2).orderBy("pos").collect()] == [3, 3]
    assert [r.id for r in S.level_beam(asked, edges, codes, 0, 4, 5).orderBy("pos").collect()] == [3, 3]


def test_scalar_functions(spark):
    quant = lambda x: V.quantized(F.array(F.lit(x)), 2)
    r = one(spark, *[quant(x).alias(f"q{k}") for k, x in enumerate([-1.0, 0.0, 1.0, -3.0, 3.0])])
    assert [c[0] for c in r] == [0, 128, 255, 0, 255] and r[0][1] == 128
    zero = one(spark, V.normalized(F.array(F.lit(0.0), F.lit(0.0))).alias("z"))
    assert zero.z == [0.0, 0.0]
    assert one(spark, V.code_distance(F.array(F.lit(1), F.lit(255)), F.array(F.lit(3), F.lit(0))).alias("d")).d == 4 + 255**2
    assert math.copysign(1, one(spark, V.mips_score(F.array(F.lit(0.0)), F.array(F.lit(1.0))).alias("s")).s) == 1
    bits = np.array([0x3C00, 0xC000, 0x0001, 0x7BFF, 0x3555], np.uint16)
    want = np.where(bits == 1, 0, bits.view(np.float16).astype(np.float64)).tolist()
    got = [r.v for r in spark.createDataFrame([(k, int(b)) for k, b in enumerate(bits)], "k int, b int").select("k", V.from_half(F.col("b")).alias("v")).orderBy("k").collect()]
    assert got == want


def test_page_functions(spark):
    first, last = P.page_span(F.col("id"), 3072, 3072)
    assert [(r[0], r[1]) for r in spark.range(5).coalesce(1).select(first, last).collect()] == [(0, 0), (0, 1), (1, 2), (2, 2), (3, 3)]
    assert [P.bin_capacity(x) for x in (3072, 800, 256)] == [3, 11, 32]
    lengths = spark.createDataFrame([(k, n) for k, n in enumerate([3072, 800, 2048, 2049, 5000])], "k int, n long").orderBy("k")
    assert [r[0] for r in lengths.select(P.page_charge(F.col("n"))).collect()] == [8192, 4096, 4096, 8192, 8192]
    assert one(spark, P.stride_of(F.lit(4096 * 10), F.lit(10), F.lit(3072))) == (4096,) and one(spark, P.stride_of(F.lit(10), F.lit(10), F.lit(3072))) == (3072,)


def test_traces(spark):
    trace = spark.createDataFrame([(0, k, ord(c)) for k, c in enumerate("abaca")], "qid long, seq long, id long")
    hits = T.hit_rates(T.reuse_distances(trace, F.lit(0)), [2]).first()
    assert (hits.hits, hits.accesses) == (2, 5)
    assert T.first_touches(trace).first().misses == 3
    assert T.pinned_hits(trace, spark.createDataFrame([(97,)], "id long")).first().hits == 3
    assert T.unique_per_query(trace).first().unique_ids == 3
    assert one(spark, T.adaptive_beam(F.array(*[F.lit(x) for x in (0.5, 0.3, 0.1, 0.6)])).alias("b")).b == [16, 16, 32, 16]
    assert one(spark, F.percentile_approx(F.lit(1), 0.5))[0] == 1
    p90 = spark.range(1, 11).select(F.percentile("id", F.lit(0.9)).alias("p")).first().p
    assert p90 == pytest.approx(9.1)


def test_whole_reuse_distances_against_a_plain_count(spark, monkeypatch):
    monkeypatch.setattr(T, "CELL", 16)
    ids = np.random.default_rng(5).integers(0, 90, 500).tolist()
    trace = spark.createDataFrame([(0, 3 * k, i) for k, i in enumerate(ids)], "qid long, seq long, id long")
    want, last = {}, {}
    for k, i in enumerate(ids):
        want[3 * k] = len(set(ids[last[i] + 1 : k])) if i in last else None
        last[i] = k
    assert {r.seq: r.distance for r in T.whole_reuse_distances(trace).collect()} == want


def test_adaptive_beams_by_blocks(spark):
    rates = [(k, k * 37 % 100 / 100) for k in range(200)]
    got = T.adaptive_beams(spark.createDataFrame(rates, "qid long, rate double").repartition(3), "qid", block=16)
    want, beam = [], 32
    for _, rate in rates:
        beam = max(4, beam // 2) if rate > 0.45 else min(64, beam * 2) if rate < 0.25 else beam
        want.append(beam)
    assert [r.beam for r in got.orderBy("qid").collect()] == want


def test_whole_locality_counts_every_edge(spark, sf_dir):
    edges = catalog.graph(catalog.base(spark, sf_dir), 8).count()
    assert [catalog.QUERIES[q](spark, sf_dir).first().n_edges for q in ("edge_locality_whole", "page_locality_whole")] == [edges, edges]


def test_numbering(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1009).alias("k"))
    got = numbered(df, ["k"], "n", 5).orderBy("k").collect()
    assert [r.n for r in got] == list(range(5, 1005))


def test_generators(spark):
    rows = generate.vectors(spark, 200, 8, seed=3)
    norms = [r.n for r in rows.select(V.norm(F.col("vec")).alias("n")).collect()]
    assert all(abs(n - 1) < 1e-5 for n in norms)
    assert sorted(map(repr, rows.collect())) == sorted(map(repr, generate.vectors(spark, 200, 8, seed=3).repartition(3).collect()))
    graph = generate.half_local_graph(spark, 500, 6).collect()
    assert all(len(r.nbrs) == 6 and r.src not in r.nbrs and all(0 <= x < 500 for x in r.nbrs) for r in graph)
    near = np.mean([min(abs(x - r.src), 500 - abs(x - r.src)) <= 24 for r in graph for x in r.nbrs])
    assert 0.45 < near < 0.65
    ids = [r.id for r in generate.query_ids(spark, 1000, 400, skewed=True).collect()]
    assert all(0 <= i < 1000 for i in ids)
    few = generate.sampled(spark.range(100).toDF("id"), 10).collect()
    assert len({r.id for r in few}) == 10 and sorted(r.ord for r in few) == list(range(10))


def test_files_round_trip(spark, tmp_path):
    vector_files.register(spark)
    rows = generate.vectors(spark, 300, 5).repartitionByRange(3, "id").sortWithinPartitions("id")
    want = {r.id: r.vec for r in rows.collect()}
    for name in ("vec_f32", "raw_f32"):
        rows.select("id", "vec").write.format(name).mode("append").save(str(tmp_path / name))
        back = spark.read.format(name).option("dim", 5).option("rows_a_split", 64).load(str(tmp_path / name))
        assert {r.id: r.vec for r in back.collect()} == want
    rows.write.format("vec_f16").mode("append").save(str(tmp_path / "half"))
    half = {r.id: r.vec for r in spark.read.format("vec_f16").load(str(tmp_path / "half")).collect()}
    assert all(np.allclose(half[i], want[i], atol=2e-3) for i in want)
    np.save(tmp_path / "rows.npy", np.array([want[i] for i in range(300)], np.float32))
    assert {r.id: r.vec for r in spark.read.format("numpy_rows").load(str(tmp_path / "rows.npy")).collect()} == want
    lists = spark.createDataFrame([(0, [5, 6]), (1, [7, 8])], "qid long, ids array<long>").coalesce(1)
    lists.write.format("id_lists").mode("append").save(str(tmp_path / "gt"))
    assert sorted(tuple(r) for r in spark.read.format("id_lists").load(str(tmp_path / "gt")).collect()) == [(0, 1, 5), (0, 2, 6), (1, 1, 7), (1, 2, 8)]
    graph = spark.createDataFrame([(0, [1, 2]), (1, [2, 0])], NBRS := "src long, nbrs array<long>").coalesce(1)
    graph.write.format("raw_u32").mode("append").save(str(tmp_path / "graph"))
    assert sorted(map(tuple, spark.read.format("raw_u32").option("dim", 2).load(str(tmp_path / "graph")).collect())) == [(0, [1, 2]), (1, [2, 0])], NBRS
    body = b"".join(struct.pack(f"<I{len(x)}I", len(x), *x) for x in ([1, 2], [], [0]))
    (tmp_path / "index").write_bytes(struct.pack("<QIIQ", 24 + len(body), 2, 0, 0) + body)
    assert [tuple(r) for r in spark.read.format("memory_graph").load(str(tmp_path / "index")).orderBy("src").collect()] == [(0, [1, 2]), (1, []), (2, [0])]
    (tmp_path / "entry").write_bytes(struct.pack("<III3I", 3, 1, 9, 9, 4, 2))
    assert [r.id for r in spark.read.format("id_column").option("header", 3).load(str(tmp_path / "entry")).orderBy("ord").collect()] == [9, 4, 2]
    (tmp_path / "short").write_bytes(struct.pack("<II", 10, 10))
    with pytest.raises(Exception, match="shorter"):
        spark.read.format("vec_f32").load(str(tmp_path / "short")).collect()


def test_query_stream(spark, sf_dir, tmp_path):
    from nearfield.streaming.queries import answer_stream

    rows, asked = catalog.load(spark, sf_dir)
    asked.repartition(2).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(asked.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    answer_stream(stream, rows, 3, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out")).select("qid", "rank", "id")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, knn(rows, asked, 3).select("qid", "rank", "id").collect()))


def test_flagship_recall(spark):
    got = __spark_entry__.entry(spark).collect()
    assert got and np.mean([r.recall for r in got]) >= 0.95


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_queries_equal_sql(spark, sf_dir, duck, name):
    df = catalog.QUERIES[name](spark, sf_dir)
    want = duck.sql(catalog.ORACLES[name])
    cols = sorted(df.columns)
    assert sorted(want.columns) == cols
    mine = sorted(repr([r[c] for c in cols]) for r in df.collect())
    assert mine == sorted(repr([r[want.columns.index(c)] for c in cols]) for r in want.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES) - {"flagship"}))
def test_other_queries_give_rows(spark, sf_dir, name):
    assert catalog.QUERIES[name](spark, sf_dir).count() > 0


def test_recall_variants_and_map_check(spark):
    truth = spark.createDataFrame([(0, 1, 4), (0, 2, 3)], "qid long, rank int, id long")
    found = spark.createDataFrame([(0, 1, 4), (0, 2, 4)], "qid long, rank int, id long")
    assert M.recall_at_most(found, truth, 2).first().recall == 1.0
    assert M.recall_with_repeats(found, truth, 2).first().recall == 1.0
    bad = spark.createDataFrame([(0, 1), (0, 0)], "new_id long, old_id long")
    with pytest.raises(ValueError):
        G.checked_map(bad, 2)


def test_shards_together_find_nearly_all(spark, sf_dir):
    rows, asked = catalog.load(spark, sf_dir)
    found = S.sharded(asked, rows, 3, 8, 20, 10)
    truth = knn(rows, asked, 10)
    assert np.mean([r.recall for r in M.recall(found, truth, 10).collect()]) >= 0.9


def test_layout_round_trip(spark, tmp_path):
    """Vectors, graph, map and entry nodes come back in the new order."""
    from nearfield.operators import graph as G
    from nearfield.sources.layout import read_layout, write_layout

    rows = spark.createDataFrame([(i, [float(i % 7), float(i * i % 11), 1.0]) for i in range(60)], "id long, vec array<float>")
    edges = G.knn_graph(rows, 4).select("src", "pos", "dst")
    id_map = G.checked_map(G.permutation(G.breadth_first(edges, 5), rows.select("id")), 60)
    write_layout(rows, edges, id_map, 5, 4, 2, str(tmp_path / "layout"), entry_nodes=10, partitions=3)
    head, vectors, graph, again, entry = read_layout(spark, str(tmp_path / "layout"), 4)
    new = {r.old_id: r.new_id for r in id_map.collect()}
    assert {r.old_id: r.new_id for r in again.collect()} == new and new[5] == 0
    assert {r.id: r.vec for r in vectors.collect()} == {new[r.id]: r.vec for r in rows.collect()}
    assert {(r.src, r.pos, r.dst) for r in graph.collect()} == {(new[r.src], r.pos, new[r.dst]) for r in edges.collect()}
    first = {r.ord: r.id for r in G.breadth_first(G.remapped(edges, id_map), 0, nodes=10).collect()}
    assert {r.ord: r.id for r in entry.collect()} == first
    h = head.first()
    assert (h.n, h.dim, h.entry, h.off_codes % 4096, h.off_vectors % 4096) == (60, 3, 0, 0, 0)


def test_scratch_removes_intermediates(spark):
    from pathlib import Path

    from nearfield.sources.tables import bucketed, scratch, shared_dir, written

    folder = Path(shared_dir(spark).removeprefix("file://"))
    before = set(folder.iterdir())
    with scratch(spark):
        kept = written(spark.range(5), "a").join(bucketed(spark.range(3), "id"), "id").count()
        assert kept == 3 and len(set(folder.iterdir()) - before) == 2
    assert set(folder.iterdir()) == before
