"""In-memory graph files read in many tasks, though their records have no fixed length.

A node's record is its number of neighbours and these, so where a record starts is known only from those before
it. A first pass follows the records of each file, a task a file, and notes where every ``rows_a_split``-th
starts; the second pass reads these ranges, a task each. Format ``memory_graph`` reads the same rows in one task a file.
"""

from __future__ import annotations

import struct

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from .tables import written
from .vector_files import NBRS, ROWS_A_SPLIT, _files, _fs

HEADER = 24
CHUNK = 1 << 23
MARKS = "path string, first long, rows long, at long, bytes long"


def _starts(path: str, step: int) -> list[tuple[int, int, int, int]]:
    """(first node, nodes, offset, bytes) of each range of ``step`` nodes of a file."""
    store, at = _fs(path)
    with store.open_input_file(at) as f:
        size = f.size()
        if size < HEADER or struct.unpack("<Q", f.read(8))[0] != size or size % 4:
            raise ValueError(f"{path} isn't as long as its header says")
        f.seek(HEADER)
        begin, node, following, marks = HEADER // 4, 0, HEADER // 4, []
        while begin < size // 4:
            words = memoryview(f.read(CHUNK)).cast("I")
            while following < begin + len(words):
                if node % step == 0:
                    marks.append(following)
                following += 1 + words[following - begin]
                node += 1
            begin += len(words)
    if following != size // 4:
        raise ValueError(f"{path} ends inside a node")
    ends = [*marks[1:], following]
    return [(k * step, min(step, node - k * step), 4 * a, 4 * (b - a)) for k, (a, b) in enumerate(zip(marks, ends))]


def record_ranges(spark: SparkSession, path: str, rows_a_split: int = ROWS_A_SPLIT) -> DataFrame:
    """(path, first, rows, at, bytes): ranges of whole records of each file."""
    files = _files(path)

    def scan(batches):
        import pyarrow as pa

        for batch in batches:
            for name in batch.column("path").to_pylist():
                found = [(name, *x) for x in _starts(name, rows_a_split)]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*found)], ["path", "first", "rows", "at", "bytes"])

    return spark.createDataFrame([(f,) for f in files], "path string").repartition(max(1, len(files))).mapInArrow(scan, MARKS)


def read_memory_graph(spark: SparkSession, path: str, rows_a_split: int = ROWS_A_SPLIT) -> DataFrame:
    """(src, nbrs) of a file or a folder of parts, read by ranges of ``rows_a_split`` nodes; nodes count from 0 in each file.

    A file whose length isn't its header's, or that ends inside a node, is an error.
    """

    def load(batches):
        import pyarrow as pa

        for batch in batches:
            for r in batch.to_pylist():
                store, at = _fs(r["path"])
                with store.open_input_file(at) as f:
                    f.seek(r["at"])
                    words = np.frombuffer(f.read(r["bytes"]), "<u4")
                heads, place, view = np.zeros(r["rows"], np.int64), 0, memoryview(words)
                for i in range(r["rows"]):
                    heads[i] = place
                    place += 1 + view[place]
                ends = np.concatenate([[0], np.cumsum(words[heads], dtype=np.int64)]).astype(np.int32)
                nbrs = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.delete(words, heads).astype(np.int64)))
                whole = pa.RecordBatch.from_arrays([pa.array(np.arange(r["first"], r["first"] + r["rows"])), nbrs], ["src", "nbrs"])
                for k in range(0, r["rows"], 4096):
                    yield whole.slice(k, 4096)

    ranges = written(record_ranges(spark, path, rows_a_split), "ranges")
    return ranges.repartition(max(1, ranges.count())).mapInArrow(load, NBRS)
