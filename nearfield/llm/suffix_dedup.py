"""Suffix-array dedup: depth-limited radix sort of suffixes, by most-significant-digit passes.

Two suffixes that agree through DEPTH bytes are a repeated window. Sorting every suffix would move
many times the corpus, so the sort key of a window puts a digit first that equal windows share and
neighbours mostly share too: the least hash among the window's DIGIT-byte strings (its minimizer).

Pass 1 sorts that digit alone: each block of documents sends its distinct digits, a bucket finds the
    groups that more than one document has, and tells each block which of its digits those are.
    A group with a single document ends here; in ordinary text that is nearly everything.
Pass 2 sorts the windows of the groups left through their whole depth. Windows of a run share their
    digit and travel as one string of at most 2 * DEPTH - DIGIT bytes, once per block and content,
    with the least doc_id. The bucket's digits are a window's hash and then its bytes, eight at a time from
    the most significant; only groups of several windows go on to the next digit, and equal groups after the
    last are exactly the repeated windows. The bucket answers which windows a smaller document has.
Last, each block marks the bytes covered and cuts them.

The blocks' texts are dealt once and that exchange is reused by all three stages. Buckets are sized by
bytes of corpus; a string that a third of all documents share comes to its bucket once per block.

Defined cases: null text is empty; texts under DEPTH bytes lose nothing; rows with a null id neither
lose nor claim anything; rows that repeat an id don't cut each other; an empty table gives an empty
result; other columns are carried along, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .common import bounded_batches, parallelism

DEPTH = 50
DIGIT = 25
BLOCK_BYTES = 4 << 20
BUCKET_BYTES = 4 << 20
SLICE = 1 << 19

_POWERS: dict[int, tuple] = {}


def _constants(which: int):
    """Byte values, powers and inverse powers of one of two polynomial hashes modulo 2^64."""
    if which not in _POWERS:
        rng = np.random.default_rng(20240607 + which)
        values = rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        base = int(rng.integers(1, 1 << 62)) * 8 + 5
        n = SLICE + 2 * DEPTH
        up, down = np.full(n, base % (1 << 64), np.uint64), np.full(n, pow(base, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        _POWERS[which] = values, np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _POWERS[which]


def window_hashes(data: np.ndarray, length: int, which: int = 0) -> np.ndarray:
    """A mixed 64-bit hash of every ``length``-byte string of ``data`` (at most SLICE + 2 * DEPTH bytes)."""
    if len(data) < length:
        return np.zeros(0, np.uint64)
    values, up, down = _constants(which)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(values[data] * up[: len(data)], out=sums[1:])
    h = (sums[length:] - sums[:-length]) * down[: len(data) - length + 1]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    return h


class Runs:
    """The windows of a block of documents as runs with one digit: first window, last window, document index, digit hash."""

    def __init__(self, texts: list[bytes]):
        self.data = np.frombuffer(b"".join(texts), np.uint8)
        self.sizes = np.array([len(t) for t in texts], np.int64)
        self.ends = np.cumsum(self.sizes)
        self.first, self.last, self.digit = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
        ok = np.zeros(len(self.data) + 1, np.int32)  # window starts within a document
        room = self.sizes >= DEPTH
        np.add.at(ok, (self.ends - self.sizes)[room], 1)
        np.add.at(ok, (self.ends - DEPTH + 1)[room], -1)
        ok = np.cumsum(ok[:-1], dtype=np.int32) > 0
        for at in range(0, len(self.data), SLICE):
            self._slice(at, ok[at : at + SLICE])
        self.first, self.last, self.digit = (np.concatenate(x) for x in (self.first, self.last, self.digit))
        self.doc = np.searchsorted(self.ends, self.first, side="right")

    def _slice(self, at: int, ok: np.ndarray) -> None:
        grams = window_hashes(self.data[at : at + SLICE + DEPTH - 1], DIGIT)
        n = min(len(ok), len(grams) - (DEPTH - DIGIT))
        if n <= 0 or not ok[:n].any():
            return
        place = np.uint64((1 << 21) - 1)
        least = grams & ~place | np.arange(len(grams), dtype=np.uint64)
        width, need = 1, DEPTH - DIGIT + 1
        while 2 * width <= need:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        if need > width:
            least = np.minimum(least[: len(least) - (need - width)], least[need - width :])
        anchor = np.where(ok[:n], (least[:n] & place).astype(np.int64), -1)
        cut = np.flatnonzero(np.diff(anchor)) + 1
        first, last = np.concatenate([[0], cut]), np.concatenate([cut, [n]]) - 1
        held = anchor[first] >= 0
        first, last = first[held], last[held]
        self.first.append(first + at)
        self.last.append(last + at)
        # least hashes crowd near zero: mixed again, they spread over all buckets
        d = grams[anchor[first]] * np.uint64(0x9E3779B97F4A7C15)
        self.digit.append((d ^ d >> np.uint64(31)) * np.uint64(0xBF58476D1CE4E5B9))

    def keys(self, bits: int) -> np.ndarray:
        """Digits as bucket (``bits`` bits) and 32 bits more."""
        return self.digit >> np.uint64(32 - bits)

    def content(self, chosen: np.ndarray) -> np.ndarray:
        """A hash of each chosen run's whole string."""
        h = np.zeros(len(chosen), np.uint64)
        for at in range(0, len(self.data), SLICE):
            here = np.flatnonzero((self.first[chosen] >= at) & (self.first[chosen] < at + SLICE))
            if len(here):
                windows = window_hashes(self.data[at : at + SLICE + DEPTH - 1], DEPTH)
                a, b = self.first[chosen[here]] - at, self.last[chosen[here]] - at
                # two windows, at most DEPTH - DIGIT apart, hold the whole string
                h[here] = windows[a] * np.uint64(0x9E3779B97F4A7C15) + (windows[b] ^ (b - a).astype(np.uint64))
        return h


def byte_groups(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(indexes of windows, first of each group among them) of the DEPTH-byte windows at ``at``, ascending, that equal another.

    The first digit is the window's hash, the others are its bytes, eight at a time, the last eight overlapping. Windows
    alone in their group leave, and a digit that all of a group share needs no sorting.
    """
    first = np.empty(len(at), np.uint64)
    for low in range(0, len(data), SLICE):
        a, b = np.searchsorted(at, [low, low + SLICE])
        first[a:b] = window_hashes(data[low : low + SLICE + DEPTH - 1], DEPTH)[at[a:b] - low]
    live = np.argsort(first)
    live, sizes = _several(live, first[live][1:] != first[live][:-1])
    digits = np.lib.stride_tricks.sliding_window_view(data, 8) if len(data) >= 8 else None
    for offset in [*range(0, DEPTH - 8, 8), DEPTH - 8]:
        if not len(live):
            break
        key = digits[at[live] + offset].view(np.uint64).ravel()
        if (key == np.repeat(key[np.cumsum(sizes) - sizes], sizes)).all():
            continue
        group = np.repeat(np.arange(len(sizes)), sizes)
        order = np.lexsort((key.byteswap(), group))
        live, key, group = live[order], key[order], group[order]
        live, sizes = _several(live, (group[1:] != group[:-1]) | (key[1:] != key[:-1]))
    return live, np.cumsum(sizes) - sizes


def _several(live: np.ndarray, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Those of ``live`` whose group holds others, and the sizes of their groups; ``cut`` says where one differs from the one before."""
    start = np.flatnonzero(np.concatenate([np.ones(min(1, len(live)), bool), cut]))
    sizes = np.diff(np.append(start, len(live)))
    return live[np.repeat(sizes > 1, sizes)], sizes[sizes > 1]


def unique_contents(runs: Runs, chosen: np.ndarray, keys: np.ndarray, ids: np.ndarray):
    """(order of distinct contents as run indexes with the least id each, index of each chosen run's content), sorted by key."""
    h = runs.content(chosen)
    order = np.lexsort((ids[runs.doc[chosen]], h, keys))
    k, c = keys[order], h[order]
    new = np.ones(len(order), bool)
    new[1:] = (k[1:] != k[:-1]) | (c[1:] != c[:-1])
    # two windows, at most DEPTH - DIGIT apart, hold a whole run: those of equal hash must agree byte by byte
    windows, alike = np.lib.stride_tricks.sliding_window_view(runs.data, DEPTH), np.flatnonzero(~new)
    for low in range(0, len(alike), 1 << 16):
        k = alike[low : low + (1 << 16)]
        a, b = chosen[order[k - 1]], chosen[order[k]]
        for end in (runs.first, runs.last):
            new[k] |= (windows[end[a]] != windows[end[b]]).any(1)
        new[k] |= runs.last[a] - runs.first[a] != runs.last[b] - runs.first[b]
    index = np.empty(len(order), np.int64)
    index[order] = np.cumsum(new) - 1
    return chosen[order[new]], index


def _ordered(table):
    """A block's rows by id and text: every stage must see them in one order, whatever the shuffle's."""
    ids, texts = table.column("_id").to_pylist(), table.column("_text").to_pylist()
    return table.take(sorted(range(len(ids)), key=lambda k: (ids[k] is None, ids[k] or 0, texts[k] or b"")))


def _texts(table, texts: str, ids: str) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Texts in analysis (empty for rows without an id), ids, and which rows have an id."""
    known = np.array(table.column(ids).is_valid().to_pylist(), bool)
    raw = [t if t is not None and k else b"" for t, k in zip(table.column(texts).to_pylist(), known)]
    return raw, np.array([i if i is not None else 0 for i in table.column(ids).to_pylist()], np.int64), known


def _packed(*arrays) -> list[bytes]:
    import zstandard

    squeeze = zstandard.ZstdCompressor(level=1).compress
    return [squeeze(np.ascontiguousarray(a).tobytes()) for a in arrays]


def _unpacked(value: bytes, kind) -> np.ndarray:
    import zstandard

    return np.frombuffer(zstandard.ZstdDecompressor().decompress(value), kind)


def _by_bucket(buckets: np.ndarray):
    """(bucket, slice) of a sorted array."""
    if len(buckets):
        cut = np.concatenate([[0], np.flatnonzero(np.diff(buckets)) + 1, [len(buckets)]])
        for a, b in zip(cut[:-1].tolist(), cut[1:].tolist()):
            yield int(buckets[a]), slice(a, b)


def _rows(schema: str, rows: list[tuple]):
    import pyarrow as pa

    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    fields = [x.split() for x in schema.split(", ")]
    return pa.table([pa.array(c, kinds[k]) for c, (_, k) in zip(zip(*rows) if rows else [[]] * len(fields), fields)], [n for n, _ in fields])


DIGITS = "_block int, _bucket int, rest binary, many binary"
FLAGS = "_block int, _bucket int, repeated binary"
STRINGS = "_block int, _bucket int, rest binary, extra binary, doc binary, raw binary"
ANSWERS = "_block int, _bucket int, rest binary, masks binary"


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the repeated bytes cut from the text; bytes of a character that was cut in two are dropped."""
    return removed(docs, id_col, text_col).select("row.*")


def removed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rewrite: bool = True) -> DataFrame:
    """(row, n_bytes, n_removed, n_spans, kept_sha256) of each row; the digest is of the exact bytes that stay.

    ``row`` holds the columns of ``docs`` with the text cut as ``dedup`` does, or the id alone without ``rewrite``.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    total = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    blocks, bits = 1 + total // BLOCK_BYTES, max(4, (max(total // BUCKET_BYTES, 1)).bit_length())
    place = F.pmod(F.xxhash64(F.col(id_col), F.col(text_col)), F.lit(blocks)).cast("int")
    columns = docs.columns
    dealt = docs.select(place.alias("_block"), F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("binary").alias("_text"), F.struct(*[c for c in columns if c == id_col or rewrite and c != text_col]).alias("_row"))
    dealt = dealt.repartition(parallelism(spark), "_block")

    def send_digits(table):
        raw, ids, _ = _texts(_ordered(table), "_text", "_id")
        runs = Runs(raw)
        keys = runs.keys(bits)
        doc = ids[runs.doc]
        order = np.lexsort((doc, keys))
        k, d = keys[order], doc[order]
        new = np.ones(len(k), bool)
        new[1:] = k[1:] != k[:-1]
        start = np.flatnonzero(new)
        many = np.maximum.reduceat(d, start) != d[start] if len(start) else np.zeros(0, bool)
        k = k[start]
        block = table.column("_block")[0].as_py()
        rows = [(block, b, k[s].astype("<u4").tobytes(), np.packbits(many[s]).tobytes()) for b, s in _by_bucket(k >> np.uint64(32))]
        return _rows(DIGITS, rows)

    def find_repeated(table):
        rest = [np.frombuffer(x, "<u4") for x in table.column("rest").to_pylist()]
        many = [np.unpackbits(np.frombuffer(x, np.uint8))[: len(r)].astype(bool) for x, r in zip(table.column("many").to_pylist(), rest)]
        whole = np.sort(np.concatenate([*rest, *[r[m] for r, m in zip(rest, many)]]))
        repeated = np.unique(whole[1:][whole[1:] == whole[:-1]])
        rows = []
        for block, bucket, r in zip(table.column("_block").to_pylist(), table.column("_bucket").to_pylist(), rest):
            at = np.minimum(np.searchsorted(repeated, r), max(len(repeated) - 1, 0))
            held = repeated[at] == r if len(repeated) else np.zeros(len(r), bool)
            if held.any():
                rows.append((block, bucket, r[held].tobytes()))
        return _rows(FLAGS, rows)

    def selected(runs, table, name):
        """The runs whose digit the buckets named, and their keys."""
        known = [(np.uint64(b) << np.uint64(32)) | np.frombuffer(x, "<u4").astype(np.uint64) for b, x in sorted(zip(table.column("_bucket").to_pylist(), table.column(name).to_pylist()))]
        keys = runs.keys(bits)
        if not known or not len(keys):
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        named = np.unique(np.concatenate(known))
        at = np.minimum(np.searchsorted(named, keys), len(named) - 1)
        chosen = np.flatnonzero(named[at] == keys)
        return chosen, keys[chosen]

    def send_strings(left, right):
        raw, ids, _ = _texts(_ordered(left), "_text", "_id")
        runs = Runs(raw)
        chosen, keys = selected(runs, right, "repeated")
        rows = []
        if len(chosen):
            distinct, _ = unique_contents(runs, chosen, keys, ids)
            key = runs.keys(bits)[distinct]
            first, extra = runs.first[distinct], runs.last[distinct] - runs.first[distinct]
            block = left.column("_block")[0].as_py()
            for b, s in _by_bucket(key >> np.uint64(32)):
                string = b"".join([runs.data[a : a + n].tobytes() for a, n in zip(first[s].tolist(), (extra[s] + DEPTH).tolist())])
                rows.append((block, b, *_packed(key[s].astype("<u4"), extra[s].astype(np.uint8), ids[runs.doc[distinct[s]]].astype("<i8"), np.frombuffer(string, np.uint8))))
        return _rows(STRINGS, rows)

    def answer(table):
        rest, extra, doc, raw = ([_unpacked(x, kind) for x in table.column(name).to_pylist()] for name, kind in (("rest", "<u4"), ("extra", np.uint8), ("doc", "<i8"), ("raw", np.uint8)))
        e, d = np.concatenate(extra).astype(np.int64), np.concatenate(doc)
        data = np.concatenate(raw)
        ends = np.cumsum(e + DEPTH)
        begins = ends - e - DEPTH
        lead = np.cumsum(e + 1) - (e + 1)  # index of each string's first window
        n = int((e + 1).sum())
        at = np.repeat(begins - lead, e + 1) + np.arange(n)  # where each window starts in the data
        owner = np.repeat(d, e + 1)
        live, start = byte_groups(data, at)
        covered = np.zeros(n, bool)
        if len(live):
            least = np.minimum.reduceat(owner[live], start)
            covered[live] = np.repeat(least, np.diff(np.append(start, len(live)))) < owner[live]
        bit = (np.arange(n) - np.repeat(lead, e + 1)).astype(np.uint64)
        masks = np.add.reduceat(covered.astype(np.uint64) << bit, lead).astype("<u4")
        cut = np.cumsum([0, *map(len, rest)])
        rows = [(block, bucket, *_packed(r, masks[cut[k] : cut[k + 1]])) for k, (block, bucket, r) in enumerate(zip(table.column("_block").to_pylist(), table.column("_bucket").to_pylist(), rest))]
        return _rows(ANSWERS, rows)

    def cut_out(left, right):
        import pyarrow as pa

        if not left.num_rows:
            return empty
        left = _ordered(left)
        raw, ids, known = _texts(left, "_text", "_id")
        runs = Runs(raw)
        data, starts = runs.data, runs.ends - runs.sizes
        gone = np.zeros(len(data), bool)
        if right.num_rows:
            answers = sorted(zip(right.column("_bucket").to_pylist(), right.column("rest").to_pylist(), right.column("masks").to_pylist()))
            named = pa.table({"_bucket": [b for b, _, _ in answers], "rest": [_unpacked(r, "<u4").tobytes() for _, r, _ in answers]})
            chosen, keys = selected(runs, named, "rest")
            distinct, index = unique_contents(runs, chosen, keys, ids)
            masks = np.concatenate([_unpacked(m, "<u4") for _, _, m in answers])[index]
            doc = ids[runs.doc[chosen]]
            masks = np.where(doc > ids[runs.doc[distinct]][index], np.uint32(0xFFFFFFFF), masks)
            first, count = runs.first[chosen], runs.last[chosen] - runs.first[chosen] + 1
            edge = np.zeros(len(data) + 1, np.int32)
            for j in range(int(count.max())):
                p = first[(count > j) & ((masks >> np.uint32(j)) & 1).astype(bool)] + j
                edge[p] += 1  # a window start comes once
                np.add.at(edge, p + DEPTH, -1)
            gone = np.cumsum(edge[:-1], dtype=np.int32) > 0
        bytes_gone = np.concatenate([np.zeros(1, np.int32), np.cumsum(gone, dtype=np.int32)])
        begins = gone.copy()
        begins[1:] &= ~gone[:-1]
        inner = starts[(runs.sizes > 0)]
        begins[inner] = gone[inner]  # a run ends with its document
        spans = np.concatenate([np.zeros(1, np.int32), np.cumsum(begins, dtype=np.int32)])
        n_removed, n_spans = (bytes_gone[runs.ends] - bytes_gone[starts]).astype(np.int64), (spans[runs.ends] - spans[starts]).astype(np.int64)
        originals = left.column("_text").to_pylist()
        kept = []
        for text, k, n, a, e in zip(originals, known, n_removed.tolist(), starts.tolist(), runs.ends.tolist()):
            kept.append(data[a:e][~gone[a:e]].tobytes() if n else (text or b""))
        out = [left.column("_row"), pa.array([len(t or b"") for t in originals], pa.int64()), pa.array(n_removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string())]
        if rewrite:
            out.append(pa.array([None if t is None else k.decode("utf-8", "ignore") for t, k in zip(originals, kept)], pa.string()))
        return pa.table(out, names)

    names = ["row", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["text"] * rewrite
    schema = StructType([StructField(n, t) for n, t in zip(names, [dealt.schema["_row"].dataType, LongType(), LongType(), LongType(), StringType(), StringType()])])
    from pyspark.sql.pandas.types import to_arrow_schema

    empty = to_arrow_schema(schema).empty_table()
    digits = dealt.groupBy("_block").applyInArrow(send_digits, DIGITS)
    flags = digits.groupBy("_bucket").applyInArrow(find_repeated, FLAGS)
    strings = dealt.groupBy("_block").cogroup(flags.groupBy("_block")).applyInArrow(send_strings, STRINGS)
    answers = strings.groupBy("_bucket").applyInArrow(answer, ANSWERS)
    found = dealt.groupBy("_block").cogroup(answers.groupBy("_block")).applyInArrow(cut_out, schema)
    if not rewrite:
        return found
    whole = F.struct(*[F.col("text").alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in columns])
    return found.select(whole.alias("row"), *names[1:-1])
