"""Flat datasets, and graph files of records of no fixed length."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from nearfield.sources import flat
from nearfield.sources import memory_graph as MG
from nearfield.sources import vector_files


def graph_file(path, lists):
    body = b"".join(struct.pack(f"<I{len(x)}I", len(x), *x) for x in lists)
    path.write_bytes(struct.pack("<QIIQ", 24 + len(body), max(map(len, lists), default=0), 0, 0) + body)


def test_one_graph_file_in_many_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(MG, "CHUNK", 64)  # records that reach over several chunks
    rng = np.random.default_rng(1)
    lists = [rng.integers(0, 1 << 32, n).tolist() for n in rng.integers(0, 60, 1000)]
    lists[3] = lists[-1] = []
    graph_file(tmp_path / "index", lists)
    vector_files.register(spark)
    got = MG.read_memory_graph(spark, str(tmp_path / "index"), 100)
    assert got.rdd.getNumPartitions() == 10 and got.groupBy(F.spark_partition_id()).count().count() >= 8
    rows = sorted(map(tuple, got.collect()))
    assert rows == [(i, x) for i, x in enumerate(lists)]
    assert rows == sorted(map(tuple, spark.read.format("memory_graph").load(str(tmp_path / "index")).collect()))


def test_parts_empty_and_broken_graph_files(spark, tmp_path):
    (tmp_path / "parts").mkdir()
    graph_file(tmp_path / "parts/part-0", [[1], [0, 1]])
    graph_file(tmp_path / "parts/part-1", [[7]])
    graph_file(tmp_path / "parts/part-2", [])
    assert sorted(map(tuple, MG.read_memory_graph(spark, str(tmp_path / "parts")).collect())) == [(0, [1]), (0, [7]), (1, [0, 1])]
    graph_file(tmp_path / "none", [])
    assert MG.read_memory_graph(spark, str(tmp_path / "none")).count() == 0
    (tmp_path / "long").write_bytes(struct.pack("<QIIQ3I", 36, 1, 0, 0, 1, 5, 4))  # the last node has 4 neighbours and none is there
    (tmp_path / "size").write_bytes(struct.pack("<QIIQ", 40, 1, 0, 0))
    for name, said in (("long", "ends inside"), ("size", "as long as")):
        with pytest.raises(Exception, match=said):
            MG.read_memory_graph(spark, str(tmp_path / name))


def test_flat_dataset_round_trip(spark, tmp_path):
    rng = np.random.default_rng(2)
    want = {i: v.tolist() for i, v in enumerate(rng.standard_normal((90, 5)).astype(np.float32))}
    links = {i: [(i + 1) % 90, (i + 7) % 90] for i in range(90)}
    rows = spark.createDataFrame(list(want.items()), "id long, vec array<float>").repartition(3)
    graph = spark.createDataFrame(list(links.items()), "src long, nbrs array<long>").repartition(5)
    path = str(tmp_path / "flat")
    assert flat.write_flat(rows, graph, 4, path, 3) == (90, 5, 2, 4)
    assert (tmp_path / "flat/meta.bin").read_bytes() == struct.pack("<4I", 90, 5, 2, 4)
    meta, vecs, lists = flat.read_flat(spark, path)
    assert meta.entry == 4 and {r.id: r.vec for r in vecs.collect()} == want and {r.src: r.nbrs for r in lists.collect()} == links
    one = tmp_path / "files"  # the same as single files
    one.mkdir()
    flat.write_meta(str(one), meta)
    (one / "vectors.bin").write_bytes(np.array([want[i] for i in range(90)], "<f4").tobytes())
    (one / "graph.bin").write_bytes(np.array([links[i] for i in range(90)], "<u4").tobytes())
    assert {r.id: r.vec for r in flat.read_flat(spark, str(one))[1].collect()} == want
    flat.write_meta(str(one), meta._replace(n=91))
    with pytest.raises(ValueError, match="meta.bin says"):
        flat.read_flat(spark, str(one))
    with pytest.raises(ValueError, match="each id"):
        flat.write_flat(rows.where("id > 0"), graph, 4, str(tmp_path / "bad"))
    assert not (tmp_path / "bad").exists()
