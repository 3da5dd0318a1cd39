"""A laid-out index: rows and graph renumbered and written in order, with the offsets of its sections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import pages as P
from ..operators.graph import breadth_first, edges_of, laid_out, neighbours, remapped
from .tables import written
from .vector_files import register

HEADER, PIVOTS = 160, 64 * 1024


def header(rows: DataFrame, degree: int, code_bytes: int, vector_bytes: int = 4) -> DataFrame:
    """One row: where the sections of codes, graph, vectors and pivots start, each on a page of its own, and a checksum."""
    m = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vec")).cast("long").alias("dim"))
    at = lambda x: P.align_up(x, P.PAGE)
    m = m.withColumn("off_codes", at(F.lit(HEADER)))
    m = m.withColumn("off_graph", at(F.col("off_codes") + F.col("n") * code_bytes))
    m = m.withColumn("off_vectors", at(F.col("off_graph") + F.col("n") * (degree * 4)))
    m = m.withColumn("off_pivots", at(F.col("off_vectors") + F.col("n") * F.col("dim") * vector_bytes))
    m = m.withColumn("bytes", at(F.col("off_pivots") + PIVOTS))
    return m.withColumn("checksum", F.col("n").bitwiseXOR(F.col("dim")).bitwiseXOR(F.lit(degree)).bitwiseXOR(F.col("n") * F.col("dim") * vector_bytes))


def write_layout(rows: DataFrame, edges: DataFrame, id_map: DataFrame, entry: int, degree: int, code_bytes: int, path: str, entry_nodes: int = 64, partitions: int = 8) -> None:
    """Write vectors, graph, id map, entry nodes and header below ``path``, in the order of ``id_map`` (new_id, old_id).

    Every node has ``degree`` neighbours. Vectors and graph are files of raw rows, part by range of new ids,
    so that a row is found by its number; the header is a row of Parquet.
    """
    register(rows.sparkSession)
    moved = laid_out(rows.select("id", "vec"), id_map, partitions)
    moved.select("id", "vec").write.format("raw_f32").mode("append").save(f"{path}/vectors")
    renumbered = written(remapped(edges, id_map), "layout")
    graph = neighbours(renumbered).repartitionByRange(partitions, "src").sortWithinPartitions("src")
    graph.write.format("raw_u32").mode("append").save(f"{path}/graph")
    in_order = id_map.repartitionByRange(partitions, "new_id").sortWithinPartitions("new_id")
    in_order.select(F.col("new_id").alias("ord"), F.col("old_id").alias("id")).write.format("id_column").mode("append").save(f"{path}/map")
    new_entry = id_map.where(F.col("old_id") == entry).first()["new_id"]
    first = breadth_first(renumbered, new_entry, nodes=entry_nodes)
    region = first.join(neighbours(renumbered), F.col("id") == F.col("src")).select("ord", "id", "nbrs")
    region.coalesce(1).sortWithinPartitions("ord").write.format("entry_nodes").option("entry", new_entry).mode("append").save(f"{path}/entry")  # entry_nodes rows
    header(rows, degree, code_bytes).withColumn("entry", F.lit(new_entry)).write.parquet(f"{path}/header")


def read_layout(spark, path: str, degree: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    """(header, vectors (id, vec), edges (src, pos, dst), map (new_id, old_id), entry nodes (ord, id, nbrs)) of what ``write_layout`` wrote."""
    register(spark)
    head = spark.read.parquet(f"{path}/header")
    dim = head.first()["dim"]
    load = lambda kind, name, **options: spark.read.format(kind).options(**options).load(f"{path}/{name}")
    edges = edges_of(load("raw_u32", "graph", dim=degree))
    id_map = load("id_column", "map").select(F.col("ord").alias("new_id"), F.col("id").alias("old_id"))
    return head, load("raw_f32", "vectors", dim=dim), edges, id_map, load("entry_nodes", "entry")
