"""A stream of queries answered from a static corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.exact import knn


def answer_stream(queries: DataFrame, base: DataFrame, k: int, path: str, checkpoint: str, metric: str = "l2", **trigger) -> StreamingQuery:
    """Write (qid, rank, id, dist) of every streamed query (qid, qvec) to Parquet at ``path``, a folder per batch.

    A batch that is run again after a failure overwrites its own folder, so each query is answered once.
    """

    def answer(batch: DataFrame, number: int) -> None:
        knn(base, batch, k, metric).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return queries.writeStream.foreachBatch(answer).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
