"""Helpers shared by the corpus operators: numbering, word patterns, and the shared folder of the library."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.tables import new_path, shared_dir, written  # noqa: F401

#: A word is a run of anything but ASCII white space.
SPACE_RUN = r"[\x20\x09-\x0D]+"
SPACE_CHARS = " \t\n\x0b\x0c\r"


def bounded_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Hand documents to Python ``rows`` at a time at most: Spark's default of 10,000 is meant for narrower rows.

    It is a setting of the session, read when a plan runs, so it stays set.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, rows)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words_of(text: Column) -> Column:
    """The words of a text; none for null or blank text."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE_CHARS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE_RUN))


def let(value: Column, body) -> Column:
    """Bind ``value`` once for use at several places in ``body``."""
    return F.transform(F.array(value), body)[0]


def parallelism(spark: SparkSession) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def numbered(df: DataFrame, key: str, order: list[str], out: str) -> DataFrame:
    """Number the rows of each ``key`` from 0 without gaps.

    A key may hold most rows, so its rows are first dealt over hash cells, as many as there are shuffle partitions; each cell is numbered
    by itself and shifted by the count of the cells before it.
    """
    ways = max(64, parallelism(df.sparkSession))
    cell = df.withColumn("_cell", F.pmod(F.xxhash64(*order), F.lit(ways)).cast("int"))
    ranked = cell.withColumn("_nth", F.row_number().over(Window.partitionBy(key, "_cell").orderBy(*order)) - 1)
    counts = cell.groupBy(key, "_cell").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(key).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    shift = counts.select(F.col(key).alias("_key"), F.col("_cell").alias("_cell2"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    joined = ranked.join(shift, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_cell") == F.col("_cell2")))
    return joined.withColumn(out, (F.col("_nth") + F.col("_shift")).cast("long")).drop("_cell", "_nth", "_key", "_cell2", "_shift")
