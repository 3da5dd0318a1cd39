"""Exact search that skips parts by bounds, against the search that compares all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from nearfield.operators import pruned as P
from nearfield.operators.exact import knn


def frame(spark, x, first=0):
    return spark.createDataFrame([(first + i, v.tolist()) for i, v in enumerate(x.astype(np.float32))], "id long, vec array<float>")


def asked_of(rows, every):
    return rows.where(F.col("id") % every == 0).select(F.col("id").alias("qid"), F.col("vec").alias("qvec"))


def held(df):
    return sorted((r.qid, r.rank, r.id, r.dist) for r in df.collect())


@pytest.mark.parametrize("metric", ["l2", "mips"])
@pytest.mark.parametrize("clusters", [0, 12])
def test_same_rows_as_all_pairs(spark, monkeypatch, metric, clusters):
    monkeypatch.setattr(P, "BASE_ROWS", 40)
    monkeypatch.setattr(P, "QUERY_ROWS", 8)
    monkeypatch.setattr(P, "ROUNDS", (2, 3))
    rng = np.random.default_rng(3)
    x = rng.standard_normal((1200, 8))
    if clusters:
        x = 8 * rng.standard_normal((clusters, 8))[rng.integers(0, clusters, 1200)] + 0.3 * x
    x[100:500] = x[100]  # a third of the rows are one vector
    x[7] = 0
    rows = frame(spark, x)
    asked = asked_of(rows, 20)
    found, visits = P.knn_pruned(rows, asked, 5, metric, pivots=24)
    assert held(found) == held(knn(rows, asked, 5, metric))
    read = visits.agg(F.sum("n")).first()[0]
    assert visits.count() == visits.select("qid", "part").distinct().count()  # nothing is compared twice
    assert read <= 1200 * 60 and (not clusters or metric != "l2" or read < 0.5 * 1200 * 60)


def test_bounds_hold(spark):
    rng = np.random.default_rng(4)
    x, q, centres = rng.standard_normal((300, 5)), rng.standard_normal((40, 5)), rng.standard_normal((6, 5))
    cell = ((x[:, None] - centres) ** 2).sum(2).argmin(1)
    far = np.sqrt(((x - centres[cell]) ** 2).sum(1))
    lows, highs = (np.array([f(far[cell == c]) for c in range(6)]) for f in (np.min, np.max))
    truth = {"l2": ((q[:, None] - x) ** 2).sum(2), "mips": -(q @ x.T)}
    for metric, d in truth.items():
        least = P.bounds(metric, q, centres, np.arange(6), lows, highs)
        assert all((d[:, cell == c].min(1) >= least[:, c]).all() for c in range(6))


def test_few_rows_own_rows_and_odd_tables(spark):
    rng = np.random.default_rng(5)
    rows = frame(spark, rng.standard_normal((4, 3)))
    asked = asked_of(rows, 1)
    assert held(P.knn_pruned(rows, asked, 9)[0]) == held(knn(rows, asked, 9))
    assert held(P.knn_pruned(rows, asked, 2, exclude_self=True)[0]) == held(knn(rows, asked, 2, exclude_self=True))
    mixed = rows.unionByName(frame(spark, rng.standard_normal((30, 2)), 10)).unionByName(spark.createDataFrame([(99, None)], rows.schema))
    clean = mixed.where("vec IS NOT NULL")
    assert held(P.knn_pruned(mixed, asked_of(mixed, 3), 3)[0]) == held(knn(clean, asked_of(clean, 3), 3))
    assert P.knn_pruned(rows.limit(0), asked, 3)[0].count() == 0 and P.knn_pruned(rows, asked.limit(0), 3)[0].count() == 0
    with pytest.raises(ValueError):
        P.knn_pruned(rows, asked, 3, "cosine")
    with pytest.raises(ValueError):
        P.knn_pruned(rows, asked.unionByName(spark.createDataFrame([(5, [1.0])], asked.schema)), 3)
