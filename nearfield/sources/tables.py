"""The corpus and the queries as DataFrames."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERY_EVERY = 10


def base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, vec, label) of every usable row: null vectors and vectors with null or non-finite components are left out."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), "label")
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return rows.where(F.col("id").isNotNull() & F.col("vec").isNotNull() & ~F.exists("vec", odd))


def queries(rows: DataFrame, every: int = QUERY_EVERY) -> DataFrame:
    """(qid, qvec): every ``every``-th row by id."""
    return rows.where(F.col("id") % every == 0).select(F.col("id").alias("qid"), F.col("vec").alias("qvec"))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. In local mode, where it is unset, one of our own."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="nearfield-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


#: Intermediates of the innermost ``scratch`` of this thread or task: (path, name of its table or None), oldest first.
_KEPT: ContextVar[list[tuple[str, str | None]] | None] = ContextVar("kept", default=None)


def _keep(path: str, label: str | None = None) -> None:
    if (kept := _KEPT.get()) is not None:
        kept.append((path, label))


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _keep(path)
    return path


def written(df: DataFrame, name: str = "state", path: str | None = None) -> DataFrame:
    """Write once to the shared folder, or to ``path``, and read back: cuts lineage, survives lost executors."""
    path = path or new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, key: str, name: str = "buckets") -> DataFrame:
    """Write once to the shared folder, bucketed and sorted by ``key``, so that joins on it don't shuffle this side again."""
    spark = df.sparkSession
    n, label = int(spark.conf.get("spark.sql.shuffle.partitions")), f"nearfield_{name}_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{label}"
    _keep(path, label)
    spark.conf.set("spark.sql.legacy.bucketedTableScan.outputOrdering", "true")  # a bucket is one file here, so that its rows aren't sorted again
    df.repartition(n, key).write.bucketBy(n, key).sortBy(key).option("path", path).saveAsTable(label)
    return spark.table(label)


def bounded_batches(spark: SparkSession, rows: int) -> None:
    """Hand wide rows to Python ``rows`` at a time at most; a setting of the session, read when a plan runs, so it stays set."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, rows)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Remove the intermediates that are written inside; what is computed from them must be written or collected by the end."""
    kept: list[tuple[str, str | None]] = []
    outer = _KEPT.set(kept)
    try:
        yield
    finally:
        _KEPT.reset(outer)
        for path, label in kept:
            if label:
                spark.sql(f"DROP TABLE IF EXISTS {label}")
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
