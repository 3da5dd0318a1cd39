"""Flat datasets: a folder of meta.bin (u32 n, dim, degree, entry), vectors.bin and graph.bin.

Vectors and graph are rows without a header, in order of id; each is one file, or a folder of parts as Spark writes it.
"""

from __future__ import annotations

import struct
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .vector_files import _files, _fs, register


class Meta(NamedTuple):
    n: int
    dim: int
    degree: int
    entry: int


def write_meta(path: str, meta: Meta) -> None:
    store, at = _fs(f"{path}/meta.bin")
    store.create_dir(at.rpartition("/")[0], recursive=True)
    with store.open_output_stream(at) as f:
        f.write(struct.pack("<4I", *meta))


def read_meta(path: str) -> Meta:
    store, at = _fs(f"{path}/meta.bin")
    with store.open_input_stream(at) as f:
        raw = f.read(16)
    if len(raw) != 16:
        raise ValueError(f"{path}/meta.bin is shorter than its four numbers")
    return Meta(*struct.unpack("<4I", raw))


def write_flat(rows: DataFrame, graph: DataFrame, entry: int, path: str, partitions: int = 8) -> Meta:
    """Write rows (id, vec) and graph (src, nbrs). Both hold each id from 0 on once, vectors one length and lists another.

    meta.bin comes last, so that a folder with one is whole.
    """
    register(rows.sparkSession)
    n, top, dim = rows.agg(F.count_distinct("id"), F.max("id"), F.max(F.size("vec"))).first()
    nodes, last, degree = graph.agg(F.count_distinct("src"), F.max("src"), F.max(F.size("nbrs"))).first()
    if not n or not (n == nodes == rows.count() == graph.count() == top + 1 == last + 1) or not 0 <= entry < n:
        raise ValueError("rows and graph hold each id from 0 on once, and the entry is one of them")
    for df, key, kind, name in ((rows.select("id", "vec"), "id", "raw_f32", "vectors.bin"), (graph.select("src", "nbrs"), "src", "raw_u32", "graph.bin")):
        df.repartitionByRange(partitions, key).sortWithinPartitions(key).write.format(kind).mode("append").save(f"{path}/{name}")
    meta = Meta(n, dim, degree, entry)
    write_meta(path, meta)
    return meta


def read_flat(spark: SparkSession, path: str) -> tuple[Meta, DataFrame, DataFrame]:
    """(meta, rows (id, vec), graph (src, nbrs)); files whose size isn't what meta.bin says are an error."""
    register(spark)
    meta, out = read_meta(path), []
    for name, kind, width in (("vectors.bin", "raw_f32", meta.dim), ("graph.bin", "raw_u32", meta.degree)):
        size = 0
        for part in _files(f"{path}/{name}"):
            store, at = _fs(part)
            size += store.get_file_info(at).size
        if size != 4 * meta.n * width:
            raise ValueError(f"{path}/{name} holds {size} bytes, meta.bin says {4 * meta.n * width}")
        out.append(spark.read.format(kind).option("dim", width).load(f"{path}/{name}"))
    return meta, *out
