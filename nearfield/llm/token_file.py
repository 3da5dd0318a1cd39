"""Token ids in a compressed file format: static range asymmetric numeral system.

Documents are dealt to range partitions of doc_id and encoded in that order. A partition is written as
segments of about SEGMENT_TOKENS ids. A segment has one shared frequency table (its own exact counts,
scaled to 2^SCALE_BITS) and independent blocks of BLOCK_TOKENS ids; a block is coded by LANES
interleaved states that share one stream of 32-bit words, has a checkpoint (states and stream
position) every CHECKPOINT_STEPS steps from which decoding may start, and carries the CRC-32 of its
stream and of its ids. Blocks and checkpoints decode in any order, so readers split freely; a segment
is a row of the file, and a row holds all that its decoding needs. Memory in a task is bounded by a
segment and the longest document.

Files are Parquet containers written by Spark, since the store may be one that only Spark reaches.

Defined cases: null text is empty and holds the end id alone; rows with a null id come after all
others; rows that repeat an id are written next to each other, by hash of the text and then by the text,
so that reruns give the same places; an empty table gives files without rows and an empty result.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounded_batches, parallelism
from .tokens import encoder, slices

END_ID = 1
SCALE_BITS = 20
LANES = 2048
BLOCK_TOKENS = 1 << 19
SEGMENT_TOKENS = 1 << 21
CHECKPOINT_STEPS = 128
LOW = np.uint64(1 << 31)
WORD = np.uint64(32)

SEGMENT = (
    "part int, segment int, first_id long, tokens long, doc_ids binary, known binary, doc_tokens binary, symbols binary, freqs binary, "
    "blocks array<struct<tokens:int,words:binary,states:binary,stops:binary,words_crc:long,ids_crc:long>>"
)


def scaled(counts: np.ndarray, bits: int = SCALE_BITS) -> np.ndarray:
    """Frequencies of at least 1 with sum 2^bits, near the proportions of ``counts`` (all above 0)."""
    total = 1 << bits
    freqs = np.maximum(1, counts.astype(np.float64) * total / counts.sum()).astype(np.int64)
    order = np.argsort(-freqs, kind="stable")
    short = total - int(freqs.sum())
    if short >= 0:
        freqs[order[0]] += short
    for k in order:
        if short >= 0:
            break
        cut = min(-short, int(freqs[k]) // 2)
        freqs[k] -= cut
        short += cut
    return freqs


def encode_block(symbols: np.ndarray, freqs: np.ndarray, starts: np.ndarray) -> tuple[bytes, bytes, bytes]:
    """(stream of words, states at each checkpoint, stream position at each) for symbol indexes of one block."""
    n = len(symbols)
    steps = -(-n // LANES)
    bits, f_all, c_all = np.uint64(SCALE_BITS), freqs[symbols], starts[symbols]
    room = np.uint64(31 - SCALE_BITS + 32)
    x = np.full(LANES, LOW, dtype=np.uint64)
    stream, states, behind, total = [], [], [], 0
    for step in range(steps - 1, -1, -1):
        at = step * LANES
        f, c = f_all[at : at + LANES], c_all[at : at + LANES]
        own = x[: len(f)]
        full = own >= f << room
        if full.any():
            stream.append(own[full].astype(np.uint32))
            total += len(stream[-1])
            own[full] >>= WORD
        q = own // f
        x[: len(f)] = (q << bits) + (own - q * f) + c
        if step % CHECKPOINT_STEPS == 0:
            states.append(x.copy())
            behind.append(total)
    words = np.concatenate(stream[::-1]) if stream else np.zeros(0, np.uint32)
    return words.astype("<u4").tobytes(), np.concatenate(states[::-1]).astype("<u8").tobytes(), np.array([total - b for b in behind[::-1]], dtype="<i8").tobytes()


def decode_steps(words: np.ndarray, x: np.ndarray, position: int, first: int, last: int, n: int, slot: np.ndarray, freqs: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The symbol indexes of steps ``first`` to ``last`` of a block of ``n``, from a checkpoint's states and position."""
    bits, mask = np.uint64(SCALE_BITS), np.uint64((1 << SCALE_BITS) - 1)
    x, out = x.copy(), np.empty(min(n, last * LANES) - first * LANES, dtype=slot.dtype)
    for step in range(first, last):
        lanes = min(LANES, n - step * LANES)
        own = x[:lanes]
        low = own & mask
        found = slot[low]
        at = (step - first) * LANES
        out[at : at + lanes] = found
        own = freqs[found] * (own >> bits) + low - starts[found]
        need = np.flatnonzero(own < LOW)
        if len(need):
            own[need] = own[need] << WORD | words[position : position + len(need)]
            position += len(need)
        x[:lanes] = own
    return out


def encode_segment(ids: np.ndarray) -> tuple[bytes, bytes, list[dict]]:
    counts = np.bincount(ids)
    symbols = np.flatnonzero(counts)
    index = np.zeros(len(counts), np.uint32)
    index[symbols] = np.arange(len(symbols), dtype=np.uint32)
    inverse, freqs = index[ids], scaled(counts[symbols])
    f64, starts = freqs.astype(np.uint64), (np.cumsum(freqs) - freqs).astype(np.uint64)
    blocks = []
    for at in range(0, len(ids), BLOCK_TOKENS):
        words, states, stops = encode_block(inverse[at : at + BLOCK_TOKENS], f64, starts)
        part = ids[at : at + BLOCK_TOKENS]
        blocks.append({"tokens": len(part), "words": words, "states": states, "stops": stops, "words_crc": zlib.crc32(words), "ids_crc": zlib.crc32(part.astype("<u4").tobytes())})
    return zlib.compress(np.diff(symbols, prepend=0).astype("<u4").tobytes()), zlib.compress(freqs.astype("<u4").tobytes()), blocks


def decode_segment(symbols: bytes, freqs: bytes, blocks: list[dict]) -> np.ndarray:
    """The ids of a segment; every checkpoint is decoded by itself and every checksum is held against what comes out."""
    table = np.cumsum(np.frombuffer(zlib.decompress(symbols), "<u4")).astype(np.uint32)
    f = np.frombuffer(zlib.decompress(freqs), "<u4").astype(np.int64)
    slot, starts = np.repeat(np.arange(len(f), dtype=np.uint32), f), (np.cumsum(f) - f).astype(np.uint64)
    f, out = f.astype(np.uint64), []
    for b in blocks:
        if zlib.crc32(b["words"]) != b["words_crc"]:
            raise ValueError("a block's stream is damaged")
        words, states = np.frombuffer(b["words"], "<u4").astype(np.uint64), np.frombuffer(b["states"], "<u8").reshape(-1, LANES)
        steps = -(-b["tokens"] // LANES)
        parts = [decode_steps(words, states[k], int(stop), k * CHECKPOINT_STEPS, min(steps, (k + 1) * CHECKPOINT_STEPS), b["tokens"], slot, f, starts) for k, stop in enumerate(np.frombuffer(b["stops"], "<i8"))]
        ids = table[np.concatenate(parts)]
        if zlib.crc32(ids.astype("<u4").tobytes()) != b["ids_crc"]:
            raise ValueError("a block's ids are damaged")
        out.append(ids)
    return np.concatenate(out) if out else np.zeros(0, np.uint32)


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = END_ID, partitions: int | None = None) -> None:
    """Encode every text and write the file at ``path`` in ascending order of doc_id."""

    def encode(batches):
        import pyarrow as pa

        schema = pa.schema([("part", pa.int32()), ("segment", pa.int32()), ("first_id", pa.int64()), ("tokens", pa.int64()), ("doc_ids", pa.binary()), ("known", pa.binary()), ("doc_tokens", pa.binary()), ("symbols", pa.binary()), ("freqs", pa.binary()),
                            ("blocks", pa.list_(pa.struct([("tokens", pa.int32()), ("words", pa.binary()), ("states", pa.binary()), ("stops", pa.binary()), ("words_crc", pa.int64()), ("ids_crc", pa.int64())])))])
        end = np.array([end_id], dtype="<u4").tobytes()
        held, doc_ids, lengths, size, number, part = [], [], [], 0, 0, 0

        def segment():
            ids = np.frombuffer(b"".join(held), "<u4")
            symbols, freqs, blocks = encode_segment(ids)
            row = {"part": part, "segment": number, "first_id": doc_ids[0], "tokens": len(ids), "symbols": symbols, "freqs": freqs, "blocks": blocks,
                   "doc_ids": zlib.compress(np.array([i or 0 for i in doc_ids], "<i8").tobytes()), "known": zlib.compress(np.packbits([i is not None for i in doc_ids]).tobytes()), "doc_tokens": zlib.compress(np.array(lengths, "<i8").tobytes())}
            return pa.RecordBatch.from_pylist([row], schema=schema)

        for big in batches:
            for batch in slices(big):
                part = batch.column("part")[0].as_py()
                for doc, ids in zip(batch.column("doc_id").to_pylist(), encoder(tokenizer_path).encode(batch.column("raw").to_pylist())):
                    held.append(ids + end)
                    doc_ids.append(doc)
                    lengths.append(len(ids) // 4 + 1)
                    size += lengths[-1]
                    if size >= SEGMENT_TOKENS:
                        yield segment()
                        held, doc_ids, lengths, size, number = [], [], [], 0, number + 1
        if held:
            yield segment()

    bounded_batches(docs.sparkSession)
    n = partitions or parallelism(docs.sparkSession)
    raw = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("raw"))
    raw = raw.withColumn("tie", F.xxhash64("raw"))
    order = [F.col("doc_id").asc_nulls_last(), "tie"]
    in_order = raw.repartitionByRange(n, *order).sortWithinPartitions(*order, "raw").select(F.spark_partition_id().alias("part"), "doc_id", "raw")
    in_order.mapInArrow(encode, SEGMENT).write.option("compression", "uncompressed").option("parquet.block.size", 8 << 20).parquet(path)


def read_tokens(spark: SparkSession, path: str, keep_ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32 and, on request, ids) of every document in the file."""

    def decode(batches):
        import pyarrow as pa

        for big in batches:
            for batch in slices(big, 1):
                r = batch.to_pylist()[0]
                ids = decode_segment(r["symbols"], r["freqs"], r["blocks"]).astype("<u4").tobytes()
                docs, n = (np.frombuffer(zlib.decompress(r[c]), "<i8") for c in ("doc_ids", "doc_tokens"))
                known = np.unpackbits(np.frombuffer(zlib.decompress(r["known"]), np.uint8))[: len(docs)].astype(bool)
                ends = np.cumsum(n)
                parts = [ids[4 * (e - k) : 4 * e] for e, k in zip(ends.tolist(), n.tolist())]
                columns = [np.full(len(docs), r["part"], np.int32), np.full(len(docs), r["segment"], np.int32), pa.array(docs, mask=~known), ends - n, n, np.array([zlib.crc32(p) for p in parts], np.int64)]
                arrays = [c if isinstance(c, pa.Array) else pa.array(c) for c in columns] + ([pa.array(parts, pa.binary())] if keep_ids else [])
                yield pa.RecordBatch.from_arrays(arrays, ["part", "segment", "doc_id", "within", "n_tokens", "ids_crc32"] + ["ids"] * keep_ids)

    file = spark.read.schema(SEGMENT).parquet(path)
    docs = file.mapInArrow(decode, "part int, segment int, doc_id long, within long, n_tokens long, ids_crc32 long" + ", ids binary" * keep_ids)
    sizes = file.select(F.col("part").alias("_p"), F.col("segment").alias("_s"), "tokens")
    before = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    parts = sizes.groupBy(F.col("_p").alias("_part")).agg(F.sum("tokens").alias("n"))  # one row per partition of the file
    parts = parts.select("_part", F.coalesce(F.sum("n").over(before().orderBy("_part")), F.lit(0)).alias("_from"))
    offsets = sizes.withColumn("_in", F.coalesce(F.sum("tokens").over(before("_p").orderBy("_s")), F.lit(0))).join(parts, F.col("_p") == F.col("_part"))
    joined = docs.join(offsets, (F.col("part") == F.col("_p")) & (F.col("segment") == F.col("_s")))
    return joined.select("doc_id", (F.col("_from") + F.col("_in") + F.col("within")).cast("long").alias("start"), "n_tokens", "ids_crc32", *(["ids"] if keep_ids else []))
