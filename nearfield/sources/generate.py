"""Synthetic corpora and query choices, by seeded functions of the row's id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import normalized


def _uniform(seed: int, *parts: Column) -> Column:
    """A number in (0, 1) from a hash, the same at every run and partitioning."""
    return (F.pmod(F.xxhash64(*parts, F.lit(seed)), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)


def vectors(spark: SparkSession, n: int, dim: int, seed: int = 1) -> DataFrame:
    """(id, vec): Gaussian directions of length 1."""
    def gauss(i: Column) -> Column:
        u, v = _uniform(seed, F.col("id"), i), _uniform(seed + 1, F.col("id"), i)
        return F.sqrt(F.lit(-2.0) * F.log(u)) * F.cos(F.lit(6.283185307179586) * v)

    raw = spark.range(n).select("id", F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), gauss).alias("raw"))
    return raw.select("id", F.transform(normalized(F.col("raw")), lambda x: x.cast("float")).alias("vec"))


def half_local_graph(spark: SparkSession, n: int, degree: int, seed: int = 1) -> DataFrame:
    """(src, nbrs): half of the edges within 4 * degree places on a ring, half anywhere; a self edge goes to the next node."""
    def edge(i: Column) -> Column:
        near = F.floor(_uniform(seed, F.col("id"), i) * (8 * degree + 1)) - 4 * degree
        far = F.floor(_uniform(seed + 1, F.col("id"), i) * n)
        to = F.when(_uniform(seed + 2, F.col("id"), i) < 0.5, F.pmod(F.col("id") + near, F.lit(n))).otherwise(far).cast("long")
        return F.when(to == F.col("id"), F.pmod(F.col("id") + 1, F.lit(n))).otherwise(to)

    return spark.range(n).select(F.col("id").alias("src"), F.transform(F.sequence(F.lit(0), F.lit(degree - 1)), edge).alias("nbrs"))


def query_ids(spark: SparkSession, n: int, queries: int, seed: int = 1, skewed: bool = False) -> DataFrame:
    """(qid, id): uniform ids, or ids at a geometric distance (p = 0.002) from the middle."""
    u = _uniform(seed, F.col("id"))
    uniform = F.floor(u * n)
    geometric = F.pmod(F.lit(n // 2) + F.floor(F.log(u) / F.log(F.lit(0.998))), F.lit(n))
    return spark.range(queries).select(F.col("id").alias("qid"), (geometric if skewed else uniform).cast("long").alias("id"))


def sampled(rows: DataFrame, n: int, seed: int = 42, key: str = "id") -> DataFrame:
    """``n`` rows without replacement, in a shuffled order given by ``ord``; a limit by hash, so no full sort."""
    from pyspark.sql import Window

    draw = F.xxhash64(F.col(key), F.lit(seed))
    few = rows.withColumn("_draw", draw).orderBy("_draw", key).limit(n)
    return few.withColumn("ord", F.row_number().over(Window.orderBy("_draw", key)) - 1).drop("_draw")
