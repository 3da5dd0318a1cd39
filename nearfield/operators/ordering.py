"""Number the rows of a table in a global order without bringing them into one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import written


def numbered(df: DataFrame, by: list[str], out: str, start: int = 0) -> DataFrame:
    """``df`` with ``out`` counting from ``start`` by the columns ``by``.

    Rows are dealt by range and written; each part is numbered by itself and shifted by the rows before
    it, of which there is one sum a part.
    """
    parts = written(df.repartitionByRange(*by).select("*", F.spark_partition_id().alias("_part")), "ordered")
    sizes = parts.groupBy("_part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shift = sizes.select(F.col("_part").alias("_p"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_shift"))
    nth = F.row_number().over(Window.partitionBy("_part").orderBy(*by))
    joined = parts.withColumn("_nth", nth).join(shift, F.col("_part") == F.col("_p"))
    return joined.withColumn(out, (F.col("_shift") + F.col("_nth") - 1 + start).cast("long")).drop("_part", "_p", "_nth", "_shift")
