"""Binary vector and graph files as Spark data sources.

register(spark) adds the formats; ``spark.read.format(name).load(path)`` and
``df.write.format(name).save(path)`` use them. All numbers are little-endian.

    vec_f32, vec_f16   u32 n, u32 dim, then n rows of floats            id long, vec array<float>
    id_lists           u32 n, u32 k, then n rows of u32                 qid long, rank int, id long
    raw_f32, raw_u32   rows of option 'dim' numbers, without a header   id long, vec | nbrs
    id_column          u32 per row (option 'header': u32s to skip)      ord long, id long
    memory_graph       u64 size, u32 degree, u32 start, u64 frozen; per node u32 k, u32[k]   src long, nbrs
    entry_nodes        u32 n, u32 k, u32 entry; u32[n] ids; n rows of u32[k]   ord long, id long, nbrs (option 'entry' to write)
    numpy_rows         a two-dimensional .npy of f2, f4 or f8           id long, vec array<float>

A reader takes a file or a folder of parts and splits it by ranges of rows ('rows_a_split'); a
memory_graph has no row index, so a file of it is one split. A writer makes a folder of parts, in
order of partition, each a whole file of its format, and a manifest; ids count on from part to part.
"""

from __future__ import annotations

import json
import struct

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

ROWS_A_SPLIT = 1 << 16
VEC, LISTS, NBRS, IDS = "id long, vec array<float>", "qid long, rank int, id long", "src long, nbrs array<long>", "ord long, id long"


def _fs(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def _files(path: str) -> list[str]:
    from pyarrow import fs

    store, at = _fs(path)
    if store.get_file_info(at).type == fs.FileType.Directory:
        found = sorted(f.path for f in store.get_file_info(fs.FileSelector(at)) if f.base_name.startswith("part-"))
        prefix = path[: len(path) - len(at)] if "://" in path else ""
        return [prefix + f for f in found]
    return [path]


class Split(InputPartition):
    def __init__(self, path: str, offset: int, rows: int, width: int, first: int, kind: str):
        self.path, self.offset, self.rows, self.width, self.first, self.kind = path, offset, rows, width, first, kind


def _list_column(rows, kind):
    import numpy as np
    import pyarrow as pa

    ends = np.arange(0, rows.size + 1, rows.shape[1] or 1, dtype=np.int32) if rows.shape[1] else np.zeros(len(rows) + 1, np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(rows.ravel().astype(kind)))


class RowReader(DataSourceReader):
    """Reads fixed-width rows; subclasses say how a file begins."""

    number = "<f4"

    def __init__(self, options: dict):
        self.path, self.step, self.options = options["path"], int(options.get("rows_a_split", ROWS_A_SPLIT)), options

    def shape(self, head: bytes, size: int) -> tuple[int, int, int]:
        """(bytes of header, rows, numbers in a row)"""
        n, width = struct.unpack("<II", head[:8])
        return 8, n, width

    def kind(self, head: bytes) -> str:
        return self.number

    def partitions(self):
        import numpy as np

        out, first = [], 0
        for path in _files(self.path):
            store, at = _fs(path)
            with store.open_input_file(at) as f:
                head, size = f.read(4096), f.size()
            kind = self.kind(head)
            offset, n, width = self.shape(head, size)
            stride = np.dtype(kind).itemsize * width
            if offset + n * stride > size:
                raise ValueError(f"{path} is shorter than its header says")
            out += [Split(path, offset + k * stride, min(self.step, n - k), width, first + k, kind) for k in range(0, n, self.step)]
            first += n
        return out or [None]

    def read(self, split):
        import numpy as np

        if split is None:
            return
        store, at = _fs(split.path)
        with store.open_input_file(at) as f:
            f.seek(split.offset)
            raw = f.read(split.rows * split.width * np.dtype(split.kind).itemsize)
        rows = np.frombuffer(raw, split.kind).reshape(split.rows, split.width)
        for k in range(0, split.rows, 4096):
            yield self.batch(rows[k : k + 4096], split.first + k)

    def batch(self, rows, first: int):
        import numpy as np
        import pyarrow as pa

        return pa.RecordBatch.from_arrays([pa.array(np.arange(first, first + len(rows))), _list_column(rows, "f4")], ["id", "vec"])


class HalfReader(RowReader):
    number = "<f2"


class ListReader(RowReader):
    number = "<u4"

    def batch(self, rows, first):
        import numpy as np
        import pyarrow as pa

        n, k = rows.shape
        columns = [np.repeat(np.arange(first, first + n), k), np.tile(np.arange(1, k + 1, dtype=np.int32), n), rows.ravel().astype(np.int64)]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["qid", "rank", "id"])


class RawReader(RowReader):
    def shape(self, head, size):
        width = int(self.options["dim"])
        if size % (4 * width):
            raise ValueError("the file isn't a whole number of rows")
        return 0, size // (4 * width), width


class RawListReader(RawReader):
    number = "<u4"

    def batch(self, rows, first):
        import numpy as np
        import pyarrow as pa

        return pa.RecordBatch.from_arrays([pa.array(np.arange(first, first + len(rows))), _list_column(rows, "i8")], ["src", "nbrs"])


class IdReader(RowReader):
    number = "<u4"

    def shape(self, head, size):
        skip = 4 * int(self.options.get("header", 0))
        n = int(self.options["rows"]) if "rows" in self.options else (size - skip) // 4
        return skip, n, 1

    def batch(self, rows, first):
        import numpy as np
        import pyarrow as pa

        return pa.RecordBatch.from_arrays([pa.array(np.arange(first, first + len(rows))), pa.array(rows[:, 0].astype(np.int64))], ["ord", "id"])


class NumpyReader(RowReader):
    def _head(self, head):
        import ast

        size = struct.unpack("<H", head[8:10])[0] if head[6] == 1 else struct.unpack("<I", head[8:12])[0]
        start = 10 if head[6] == 1 else 12
        return start + size, ast.literal_eval(head[start : start + size].decode())

    def shape(self, head, size):
        offset, info = self._head(head)
        if info["fortran_order"] or len(info["shape"]) != 2:
            raise ValueError("rows of a two-dimensional array are wanted")
        return offset, *info["shape"]

    def kind(self, head):
        return self._head(head)[1]["descr"]


class MemoryGraphReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]

    def partitions(self):
        return [Split(path, 24, 0, 0, 0, "") for path in _files(self.path)]

    def read(self, split):
        import numpy as np
        import pyarrow as pa

        store, at = _fs(split.path)
        with store.open_input_stream(at, buffer_size=1 << 20) as f:
            size = struct.unpack("<QIIQ", f.read(24))[0]
            done, node, lists = 24, 0, []
            while done < size:
                k = struct.unpack("<I", f.read(4))[0]
                lists.append(np.frombuffer(f.read(4 * k), "<u4").astype(np.int64))
                done += 4 + 4 * k
                if len(lists) == 4096 or done >= size:
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(node, node + len(lists))), pa.array(lists, pa.list_(pa.int64()))], ["src", "nbrs"])
                    node, lists = node + len(lists), []


class EntryReader(DataSourceReader):
    """A file of an entry region, which is small: one split a file."""

    def __init__(self, options: dict):
        self.path = options["path"]

    def partitions(self):
        return [Split(path, 0, 0, 0, 0, "") for path in _files(self.path)]

    def read(self, split):
        import numpy as np
        import pyarrow as pa

        store, at = _fs(split.path)
        with store.open_input_file(at) as f:
            raw = np.frombuffer(f.read(), "<u4")
        n, k = int(raw[0]), int(raw[1])
        if len(raw) != 3 + n + n * k:
            raise ValueError(f"{split.path} isn't as long as its header says")
        nbrs = _list_column(raw[3 + n :].reshape(n, k), "i8")
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(n)), pa.array(raw[3 : 3 + n].astype(np.int64)), nbrs], ["ord", "id", "nbrs"])


class Part(WriterCommitMessage):
    def __init__(self, name: str, rows: int, size: int):
        self.name, self.rows, self.size = name, rows, size


class RowWriter(DataSourceArrowWriter):
    """Writes a part per partition; the width is the first row's, and all rows must share it."""

    number, column, header = "<f4", "vec", True

    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite = options["path"].rstrip("/"), overwrite

    def rows(self, batch):
        import numpy as np

        column = batch.column(self.column)
        widths = np.unique(np.diff(column.offsets.to_numpy()))
        if len(widths) > 1 or column.null_count:
            raise ValueError("rows of one width are wanted")
        return np.array(column.flatten()).reshape(batch.num_rows, -1)

    def write(self, batches):
        import numpy as np
        from pyspark import TaskContext

        task = TaskContext.get()
        name = f"part-{task.partitionId():05d}-{task.taskAttemptId()}"
        store, at = _fs(f"{self.path}/{name}")
        store.create_dir(at.rpartition("/")[0], recursive=True)
        held = [x for x in (self.rows(b) for b in batches if b.num_rows)]
        rows = np.concatenate(held) if held else np.zeros((0, 0))
        raw = rows.astype(self.number).tobytes()
        head = struct.pack("<II", *rows.shape) if self.header else b""
        if len(rows):
            with store.open_output_stream(at) as f:
                f.write(head + raw)
        return Part(name, len(rows), len(head) + len(raw))

    def _clear(self, keep: set[str]) -> None:
        from pyarrow import fs

        store, at = _fs(self.path)
        for f in store.get_file_info(fs.FileSelector(at, allow_not_found=True)):
            if f.base_name.startswith("part-") and f.base_name not in keep:
                store.delete_file(f.path)

    def commit(self, messages):
        parts = [m for m in messages if m is not None and m.rows]
        self._clear({m.name for m in parts})  # also what lost or repeated tasks left
        store, at = _fs(f"{self.path}/manifest.json")
        with store.open_output_stream(at) as f:
            f.write(json.dumps({"rows": sum(m.rows for m in parts), "parts": [{"name": m.name, "rows": m.rows, "bytes": m.size} for m in parts]}).encode())

    def abort(self, messages):
        self._clear(set())


class HalfWriter(RowWriter):
    number = "<f2"


class RawWriter(RowWriter):
    header = False


class RawListWriter(RowWriter):
    number, column, header = "<u4", "nbrs", False


class IdWriter(RowWriter):
    """Writes the ids of (ord, id) rows in their order."""

    number, column, header = "<u4", "id", False

    def rows(self, batch):
        return batch.column("id").to_numpy().reshape(-1, 1)


class EntryWriter(RowWriter):
    """Writes (ord, id, nbrs) as one file, so from one partition; option 'entry' is the entry's id."""

    number, column = "<u4", "nbrs"

    def write(self, batches):
        import numpy as np
        from pyspark import TaskContext

        held = [b for b in batches if b.num_rows]
        if not held:
            return Part("", 0, 0)
        if TaskContext.get().partitionId():
            raise ValueError("an entry file is written from one partition")
        ids, rows = np.concatenate([b.column("id").to_numpy() for b in held]), np.concatenate([self.rows(b) for b in held])
        raw = np.concatenate([[*rows.shape, self.entry], ids, rows.ravel()]).astype("<u4").tobytes()
        name = f"part-00000-{TaskContext.get().taskAttemptId()}"
        store, at = _fs(f"{self.path}/{name}")
        store.create_dir(at.rpartition("/")[0], recursive=True)
        with store.open_output_stream(at) as f:
            f.write(raw)
        return Part(name, len(ids), len(raw))

    def __init__(self, options: dict, overwrite: bool):
        super().__init__(options, overwrite)
        self.entry = int(options["entry"])


class ListWriter(RowWriter):
    """Writes (qid, ids): a row of ids a query."""

    number, column = "<u4", "ids"


def _source(name_: str, schema_: str, reader, writer=None):
    class Source(DataSource):
        @classmethod
        def name(cls):
            return name_

        def schema(self):
            return schema_

        def reader(self, schema):
            return reader(self.options)

        def writer(self, schema, overwrite):
            if writer is None:
                raise ValueError(f"{name_} can't be written")
            return writer(self.options, overwrite)

    return Source


SOURCES = [
    _source("vec_f32", VEC, RowReader, RowWriter),
    _source("vec_f16", VEC, HalfReader, HalfWriter),
    _source("id_lists", LISTS, ListReader, ListWriter),
    _source("raw_f32", VEC, RawReader, RawWriter),
    _source("raw_u32", NBRS, RawListReader, RawListWriter),
    _source("id_column", IDS, IdReader, IdWriter),
    _source("entry_nodes", "ord long, id long, nbrs array<long>", EntryReader, EntryWriter),
    _source("memory_graph", NBRS, MemoryGraphReader),
    _source("numpy_rows", VEC, NumpyReader),
]


def register(spark: SparkSession) -> None:
    for source in SOURCES:
        spark.dataSource.register(source)
