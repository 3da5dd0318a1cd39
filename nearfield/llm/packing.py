"""Best-fit packing by bin completion.

Only lengths matter to packing and they are at most ``capacity``, so Spark reduces the pieces to a
histogram of at most ``capacity`` rows, whatever the corpus. Bin completion works on that: take the
largest length left and branch on every undominated filling of the room beside it, fullest first, and
on how many sequences take it, as many as the counts allow first. Fillings are found by sum: sets of
reachable sums, kept as bits, lead to each filling without a dead end, so that they come one by one
and none is left out. The incumbent is best-fit decreasing, then the best solution found; a branch
ends where its waste or the lower bound of what is left can't beat it. The search ends at the lower
bound, when no branch is open, or after ``nodes`` fillings beyond the first branch; what is returned
with the plan says which: the plan is optimal where the bound equals its sequences. The plan, a few
thousand patterns at most, then tells each piece its place by its rank among pieces of its length;
ranks are numbered in Spark.

Defined cases: null text is empty and makes a piece of the end id alone; repeated rows are packed as
rows of their own; rows with a null id are packed too; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, numbered, written
from .tokens import encoder, slices

CAPACITY = 2048
END_ID = 0
#: Words kept per worker, fewer than by default: in a pipeline, workers go on to other stages with them.
CACHE_WORDS = 120_000
#: Fillings looked at after the first branch has ended.
NODES = 5000
#: Frames of the search that keep their enumeration; older ones begin theirs again when the search returns to them.
LIVE = 64

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces_of(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, keep_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32 and, on request, ids): documents as token runs of at most ``capacity``."""

    def encode(batches):
        import pyarrow as pa

        end = np.array([end_id], dtype="<u4").tobytes()
        for big in batches:
            for batch in slices(big):
                rows: list[list] = [[], [], [], [], [], []]
                ids_of = encoder(tokenizer_path).encode(batch.column("raw").to_pylist(), CACHE_WORDS)
                for doc, ids in zip(batch.column("doc_id").to_pylist(), ids_of):
                    ids += end
                    for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                        part = ids[at : at + 4 * capacity]
                        for column, value in zip(rows, (doc, piece, at // 4, len(part) // 4, zlib.crc32(part), part)):
                            column.append(value)
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
                n = 6 if keep_ids else 5
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows[:n], kinds)], names[:n])

    raw = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("raw"))
    return raw.mapInArrow(encode, PIECES + ", ids binary" * keep_ids)


def lower_bound(counts: np.ndarray, capacity: int) -> int:
    """Martello and Toth's L2 on a histogram: for each k, the bins that lengths above capacity / 2 need, and what doesn't fit beside them."""
    sizes = np.arange(len(counts))
    n, s = np.concatenate([[0], np.cumsum(counts)]), np.concatenate([[0], np.cumsum(counts * sizes)])
    half = capacity // 2
    k = np.arange(half + 1)
    large = n[capacity + 1] - n[capacity - k + 1]
    middle, middle_sum = n[capacity - k + 1] - n[half + 1], s[capacity - k + 1] - s[half + 1]
    small_sum = s[half + 1] - s[k]
    more = np.maximum(0, -(-(small_sum - (middle * capacity - middle_sum)) // capacity))
    return int((large + middle + more).max())


def reachable(sizes: list[int], counts: list[int], room: int) -> list[int]:
    """[bits]: bit s of entry i is set where copies of the first i of ``sizes`` add up to s, at most ``room``."""
    mask, reach = (1 << room + 1) - 1, [1]
    for size in sizes:
        sums, left, step = reach[-1], min(counts[size], room // size), 1
        while left:
            step = min(step, left)
            sums |= sums << size * step & mask
            left -= step
            step *= 2
        reach.append(sums)
    return reach


def spread(bits: int, n: int) -> int:
    """Every bit and the ``n`` above it."""
    width = 1
    while width <= n:
        step = min(width, n + 1 - width)
        bits |= bits << step
        width += step
    return bits


def dominated(filling: tuple[int, ...], slack: int, counts: list[int], have: int) -> bool:
    """Whether one more item can take the place of some of the filling's and fill as much or more.

    ``have`` has a bit for each length with counts above 0; ``slack`` is the room that the filling leaves.
    """
    one = more = 0  # sums of one item, of several
    for size in filling:
        more |= (one | more) << size
        one |= 1 << size
    better = spread(more, slack) | (spread((one | 1) << 1, slack - 1) if slack else 0)  # an item beside the others, too
    for size in set(filling):
        if counts[size] == filling.count(size):
            have &= ~(1 << size)
    return bool(better & have)


def fillings(counts: list[int], room: int, least: int = 0) -> Iterator[tuple[int, ...] | None]:
    """Every undominated filling of ``room`` of at least ``least``, fullest first; None for each dominated one passed over."""
    sizes = [size for size in range(1, room + 1) if counts[size]]
    reach = reachable(sizes, counts, room)
    have = sum(1 << size for size in sizes)

    def of_sum(total: int, upto: int) -> Iterator[tuple[int, ...]]:
        if not total:
            yield ()
        for i in range(upto, 0, -1):
            if not reach[i] >> total & 1:
                return
            size = sizes[i - 1]
            for n in range(min(counts[size], total // size), 0, -1):
                if reach[i - 1] >> total - n * size & 1:
                    for rest in of_sum(total - n * size, i - 1):
                        yield (size,) * n + rest

    sums = reach[-1] >> least << least
    while sums:
        total = sums.bit_length() - 1
        sums ^= 1 << total
        for filling in of_sum(total, len(sizes)):
            yield None if dominated(filling, room - total, counts, have) else filling


def best_fit(counts: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing on the histogram: each piece goes to the tightest room that holds it, many alike at a time."""
    rooms: dict[int, list] = {}
    for size in np.flatnonzero(counts)[::-1].tolist():
        left = int(counts[size])
        while left and size:
            room = min((r for r in rooms if r >= size), default=capacity)
            pattern, n = rooms[room].pop() if room in rooms else ((), left)
            if room in rooms and not rooms[room]:
                del rooms[room]
            # a sequence that took a piece is the tightest still, as long as it holds one more
            each = min(room // size, left)
            take = min(n, left // each)
            left -= take * each
            rooms.setdefault(room - each * size, []).append(((*pattern, *[size] * each), take))
            if n > take and pattern:
                rooms.setdefault(room, []).append((pattern, n - take))
    return [(pattern, n) for stack in rooms.values() for pattern, n in stack]


def bin_completion(counts: np.ndarray, capacity: int = CAPACITY, nodes: int = NODES) -> tuple[list[tuple[tuple[int, ...], int]], int]:
    """([(lengths of a sequence, how many such sequences)], bound): every piece is held, and no packing takes fewer than ``bound`` sequences.

    counts[n] is the number of pieces of length n, from 1 to ``capacity``.
    """
    left = counts.astype(np.int64)
    left[0] = 0
    whole = int(left @ np.arange(len(left)))
    best, bound = best_fit(left, capacity), lower_bound(left, capacity)
    fewest = sum(n for _, n in best)
    used = waste = looked = 0
    # one for each choice made: [pattern, times, largest length, fillings tried, their enumeration, pattern that may not come next]
    frames: list[list] = []
    ended = False

    def choices(largest: int, avoid: tuple[int, ...] | None) -> Iterator[tuple[int, ...] | None]:
        mine = left.tolist()
        mine[largest] -= 1
        room = capacity - largest
        # a sequence may waste no more than the incumbent allows for all
        least = max(0, room - ((fewest - 1) * capacity - whole - waste))
        for filling in fillings(mine, room, least):
            yield None if filling is None or (largest, *filling) == avoid else (largest, *filling)

    def take(pattern: tuple[int, ...], times: int) -> None:
        nonlocal used, waste
        np.subtract.at(left, list(pattern), times)
        used += times
        waste += times * (capacity - sum(pattern))

    def descend() -> None:
        """Open a frame for the largest length left, unless nothing is left or what is left can't beat the incumbent."""
        nonlocal best, fewest, ended
        top = np.flatnonzero(left)
        if not len(top) and used < fewest:
            best, fewest = [(f[0], f[1]) for f in frames], used
        if len(top) and used + lower_bound(left, capacity) < fewest and waste + whole <= (fewest - 1) * capacity:
            largest = int(top[-1])
            avoid = frames[-1][0] if frames and frames[-1][2] == largest else None
            frames.append([None, 0, largest, 0, choices(largest, avoid), avoid])
            if len(frames) > LIVE:
                frames[-1 - LIVE][4] = None
        else:
            ended = True

    descend()
    while frames and fewest > bound and looked <= nodes:
        frame = frames[-1]
        pattern, times, largest, tried, source, avoid = frame
        if pattern is not None:  # back here: take it back, and once less often
            take(pattern, -times)
            if times > 1:
                frame[1] = times - 1
                take(pattern, times - 1)
                looked += ended
                descend()
                continue
            frame[0] = None
        if source is None:
            source = frame[4] = islice(choices(largest, avoid), tried, None)
        pattern = None
        for found in source:
            frame[3] += 1
            looked += ended
            if found is not None or looked > nodes:
                pattern = found
                break
        if pattern is None:
            frames.pop()
            continue
        need = np.bincount(pattern, minlength=len(left))
        held = np.flatnonzero(need)
        frame[0], frame[1] = pattern, int((left[held] // need[held]).min())
        take(frame[0], frame[1])
        descend()
    return best, bound if frames and fewest > bound else fewest


def plan_rows(plan: list[tuple[tuple[int, ...], int]]) -> dict[int, list[tuple[int, int, int, int, int]]]:
    """length -> [(first rank, sequences, pieces of it in each, first sequence, offset)] in order of rank."""
    rows: dict[int, list] = {}
    ranks: dict[int, int] = {}
    sequence = 0
    for pattern, times in plan:
        offset = 0
        for size in sorted(set(pattern), reverse=True):
            each = pattern.count(size)
            rows.setdefault(size, []).append((ranks.get(size, 0), times, each, sequence, offset))
            ranks[size] = ranks.get(size, 0) + times * each
            offset += size * each
        sequence += times
    return rows


def placed(pieces: DataFrame, capacity: int = CAPACITY, nodes: int = NODES) -> DataFrame:
    """``pieces`` (columns doc_id, piece, length and any others) with sequence_id and offset.

    n_sequences and least_sequences say how many sequences there are and how many any packing needs; where they are equal, this one is optimal.
    """
    histogram = pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()  # at most ``capacity`` rows
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for r in histogram:
        counts[r["length"]] = r["n"]
    patterns, bound = bin_completion(counts, capacity, nodes)
    plan = {size: [np.array(c, dtype=np.int64) for c in zip(*rows)] for size, rows in plan_rows(patterns).items()}
    ranked = numbered(pieces, "length", ["doc_id", "piece"], "_rank")
    names = [c for c in pieces.columns]

    def place(batches):
        import pyarrow as pa

        for batch in batches:
            size, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "_rank"))
            sequence, offset = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
            for n in np.unique(size):
                at = np.flatnonzero(size == n)
                first, _, each, base, start = plan[int(n)]
                k = np.searchsorted(first, rank[at], side="right") - 1
                within = rank[at] - first[k]
                sequence[at] = base[k] + within // each[k]
                offset[at] = start[k] + within % each[k] * n
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    kinds = ", ".join(f"`{c}` {t}" for c, t in pieces.dtypes)
    put = ranked.select(*names, "_rank").mapInArrow(place, f"{kinds}, sequence_id long, offset long")
    return put.withColumns({"n_sequences": F.lit(sum(n for _, n in patterns)).cast("long"), "least_sequences": F.lit(bound).cast("long")})


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, keep_ids: bool = False, nodes: int = NODES) -> DataFrame:
    """Every piece of every document with its sequence and its place there; documents are encoded once."""
    bounded_batches(docs.sparkSession)
    return placed(written(pieces_of(docs, tokenizer_path, capacity, end_id, keep_ids), "pieces"), capacity, nodes)
