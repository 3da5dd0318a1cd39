"""Graph search over parts against the search that looks up one node at a time."""

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from nearfield.operators import graph as G
from nearfield.operators import parted as P
from nearfield.operators import search as S


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((12, 8)) * 3
    vecs = (centres[rng.integers(0, 12, 600)] + rng.standard_normal((600, 8))).astype(np.float32)
    vecs[50:60] = vecs[40]  # ties
    ids = [i - 20 if i % 2 else i + (1 << 40) for i in range(600)]  # of any size
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, vecs)], "id long, vec array<float>")
    asked = rows.where(F.pmod("id", F.lit(9)) == 0).select(F.col("id").alias("qid"), F.col("vec").alias("qvec"))
    return rows, asked


@pytest.mark.parametrize("metric,degree,width,part_rows", [("l2", 8, 20, 64), ("mips", 6, 12, 50), ("l2", 4, 3, 1000)])
def test_same_walk_as_one_node_at_a_time(table, metric, degree, width, part_rows):
    rows, asked = table
    edges = G.knn_graph(rows, degree).where(F.pmod("src", F.lit(11)) != 0)  # some nodes have no neighbours
    want = S.greedy(asked, S.adjacency(edges, rows), rows, 1, width, 10, metric)
    got = P.greedy_in_parts(asked, P.in_parts(rows, edges, part_rows), 1, width, 10, metric)
    plain = lambda df: sorted((r.qid, r.rank, r.id, round(r.dist, 9), r.n_dist, r.n_expand) for r in df.collect())
    assert plain(got) == plain(want)


def test_few_supersteps_and_little_to_store(spark, table):
    rows, asked = table
    edges = G.knn_graph(rows, 8)
    parts = P.in_parts(rows, edges, 64)
    found = P.greedy_in_parts(asked, parts, 1, 40, 10).where("rank = 1").agg(F.sum("trips").alias("t"), F.sum("n_expand").alias("n")).first()
    assert found.t * 3 < found.n
    # a vector once, and a number a neighbour
    assert parts.vectors.starts[-1] == parts.links.starts[-1] == 600 and parts.links.width == 2 + 8


def test_ranges_reach_over_files(spark, table, monkeypatch):
    monkeypatch.setattr(P, "FILE_ROWS", 100)
    rows, asked = table
    parts = P.in_parts(rows, G.knn_graph(rows, 3), 70)
    assert len(parts.vectors.names) > 1
    by_num = {r.num: r for r in parts.numbers.join(rows, "id").collect()}
    for first in range(0, 600, 70):
        some, links = parts.vectors.read(first, 70), parts.links.read(first, 70).astype(np.int64)
        assert len(some) == min(70, 600 - first)
        assert [v.tolist() for v in some] == [by_num[first + i].vec for i in range(len(some))]
        assert [int(lo | (hi << 32)) for lo, hi in links[:, :2]] == [by_num[first + i].id for i in range(len(some))]


def test_no_entry_no_queries_no_rows_and_no_edges(spark, table):
    rows, asked = table
    parts = P.in_parts(rows, G.knn_graph(rows, 3).limit(0), 64)
    assert {(r.id, r.n_dist, r.trips) for r in P.greedy_in_parts(asked, parts, 1, 5, 3).collect()} == {(1, 1, 1)}
    assert not P.greedy_in_parts(asked, parts, 123456, 5, 3).collect()
    assert not P.greedy_in_parts(asked.limit(0), parts, 1, 5, 3).collect()
    with pytest.raises(ValueError, match="needs a row"):
        P.in_parts(rows.limit(0), G.knn_graph(rows, 3))
    with pytest.raises(ValueError, match="one length"):
        P.in_parts(spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], "id long, vec array<float>"), G.knn_graph(rows, 3))


def in_some_order():
    return (F.row_number().over(Window.orderBy(F.xxhash64("id"), "id")) - 1).cast("long").alias("num")


@pytest.mark.parametrize("page_rows", [1, 7, 1000])
def test_a_page_is_read_once_for_all_who_ask(spark, table, page_rows, monkeypatch):
    from pyspark.sql import Observation

    monkeypatch.setattr(P, "FILE_ROWS", 150)
    monkeypatch.setattr(P, "RUN_PAGES", 3)
    rows, _ = table
    numbers = rows.select("id", in_some_order())
    moved = rows.join(numbers, "id")
    vectors, reads = P.in_order(moved), Observation()
    nums = [5, 5, 6, 13, 14, 599, 300, 301, 5, None, -1, 600, 10**12]
    got = {r.num: r.vec for r in P.fetched(spark.createDataFrame([(n,) for n in nums], "num long"), vectors, page_rows, reads).collect()}
    wanted = {n for n in nums if n is not None and 0 <= n < 600}
    want = {r.num: r.vec for r in moved.where(F.col("num").isin(*wanted)).collect()}
    assert got == want and reads.get == {"pages": len({n // page_rows for n in wanted}), "records": len(wanted)}
    assert not P.fetched(spark.createDataFrame([], "num long"), vectors, page_rows).collect()


def test_rerank_by_pages_is_the_rerank(table):
    rows, asked = table
    numbers = rows.select("id", in_some_order())
    found = asked.join(rows.select("id"), F.pmod(F.xxhash64("qid", "id"), F.lit(13)) == 0).select("qid", "id")
    got, reads = P.reranked_by_pages(found, asked, P.in_order(rows.join(numbers, "id")), numbers, 16, 5)
    plain = lambda df: sorted((r.qid, r.rank, r.id, r.dist) for r in df.collect())
    assert plain(got) == plain(S.reranked(found, rows, asked, 5))
    assert reads["records"] == found.select("id").distinct().count() and reads["pages"] <= 38
    assert not P.reranked_by_pages(found.limit(0), asked, P.in_order(rows.join(numbers, "id")), numbers, 16, 5)[0].collect()
