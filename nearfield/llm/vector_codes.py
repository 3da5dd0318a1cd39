"""Vector code compression: codebooks by Lloyd rounds in integers, with Hamerly's bounds.

A component x becomes the integer floor(SCALE * x), and a vector is cut into PARTS equal consecutive
parts. Each part position has a codebook of ENTRIES entries, which starts as that part of the least
ids. A round gives every part to its nearest entry and moves each entry to the floor of its parts' mean.

Every part keeps an upper bound on the distance to its own entry and a lower bound on that to the
second nearest. When entries move, the bounds move by as much. While the upper bound lies strictly
below the lower one, or below half the way from its entry to the next one, the nearest entry can't
have changed, nor can another be as near. Otherwise the distance to the own entry is worked out, and if
that doesn't settle it, all entries are scanned in integers, where the lower index wins a tie. Bounds
are rounded outwards, so that no tie is lost to rounding.

The state (integers, codes and bounds of each vector) is a table that a round reads and writes once; a
task adds up its own parts on the way, one row a task. Codebooks (PARTS * ENTRIES entries) go through the
driver; nothing else does, and no label or vector is gathered in one task, however often it comes.

Defined cases: vectors that are null or hold null or non-finite components are dropped, as are those
that can't be cut into parts (empty, or of another length than that of the least id kept, which must
be a multiple of PARTS) and those with a component of LIMIT or more in size (their squares don't add up
in 64 bits). Rows with a null id are coded, and come last where ids are ordered; rows that repeat an id
are ordered by their vector; with fewer rows than ENTRIES the codebooks are as short. An empty table
gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

PARTS = 4
ENTRIES = 256
ROUNDS = 4
SCALE = 1024
LIMIT = float(1 << 17)
EXACT = float(1 << 53)
SLACK = 1e-12
SCAN_ROWS = 512


def distances(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances of integer rows to entries, as exact integers."""
    largest = float(max(np.abs(x).max(initial=0), np.abs(entries).max(initial=0)))
    if 4 * largest**2 * max(1, x.shape[1]) < EXACT:  # every partial sum of the product is exact in double
        a, b = x.astype(np.float64), entries.astype(np.float64)
        return ((a**2).sum(1)[:, None] - 2 * (a @ b.T) + (b**2).sum(1)).astype(np.int64)
    return np.stack([((x - e) ** 2).sum(1) for e in entries], 1)


def own_distances(x: np.ndarray, entries: np.ndarray, code: np.ndarray) -> np.ndarray:
    return ((x - entries[code]) ** 2).sum(1)


def below(x):
    return x * (1 - SLACK)


def above(x):
    return x * (1 + SLACK)


def scan(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code, upper, lower) of each row from all distances; the lower index wins a tie."""
    code, upper, lower = np.zeros(len(x), np.int32), np.zeros(len(x)), np.full(len(x), np.inf)
    for at in range(0, len(x), SCAN_ROWS):
        d = distances(x[at : at + SCAN_ROWS], entries)
        rows, nearest = np.arange(len(d)), d.argmin(1)
        code[at : at + SCAN_ROWS], upper[at : at + SCAN_ROWS] = nearest, above(np.sqrt(d[rows, nearest]))
        if len(entries) > 1:
            d[rows, nearest] = np.iinfo(np.int64).max
            lower[at : at + SCAN_ROWS] = below(np.sqrt(d.min(1)))
    return code, upper, lower


def reassign(x: np.ndarray, entries: np.ndarray, drift: np.ndarray, code: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(code, upper, lower, rows scanned) after each entry has moved by ``drift``."""
    code, upper = code.copy(), above(upper + drift[code])
    order = np.argsort(-drift, kind="stable")
    others = np.full(len(drift), drift[order[0]])  # the most that any other entry moved
    others[order[0]] = drift[order[1]] if len(drift) > 1 else 0.0
    moved = others[code]
    lower = lower - moved - SLACK * (np.where(np.isfinite(lower), np.abs(lower), 0) + moved)
    if len(entries) > 1:
        between = distances(entries, entries)
        np.fill_diagonal(between, np.iinfo(np.int64).max)
        half = below(np.sqrt(between.min(1)) / 2)
    else:
        half = np.array([np.inf])
    safe = np.maximum(lower, half[code])
    open_ = np.flatnonzero(~(upper < safe))
    upper[open_] = above(np.sqrt(own_distances(x[open_], entries, code[open_])))
    open_ = open_[~(upper[open_] < safe[open_])]
    if len(open_):
        code[open_], upper[open_], lower[open_] = scan(x[open_], entries)
    return code, upper, lower, len(open_)


def drifts(old: list[np.ndarray], new: list[np.ndarray]) -> list[np.ndarray]:
    return [above(np.sqrt(((a - b) ** 2).sum(1))) for a, b in zip(old, new)]


def integers(vec):
    return F.transform(vec, lambda x: F.floor(x.cast("double") * SCALE).cast("int"))


def usable(rows: DataFrame, id_col: str, vec_col: str, label_col: str) -> DataFrame:
    """(id, label, ints) of the rows whose vectors can be coded, whatever their length."""
    vec = F.col(vec_col)
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) >= LIMIT)
    ok = vec.isNotNull() & (F.size(vec) > 0) & (F.size(vec) % PARTS == 0) & ~F.exists(vec, odd)
    return rows.where(ok).select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), integers(vec).alias("ints"))


STATE = "ints array<int>, code array<int>, upper array<double>, lower array<double>, sums array<long>, scanned long"


def _round(state: DataFrame, books: list[np.ndarray], drift: list[np.ndarray] | None) -> DataFrame:
    """The state after one assignment, and one row a task of sums and counts by part and entry (``sums``, else null)."""
    entries, width = books[0].shape

    def run(batches):
        import pyarrow as pa

        sums, counts, scanned, last = np.zeros((PARTS, entries, width), np.int64), np.zeros((PARTS, entries), np.int64), 0, None
        flat = lambda a, kind: pa.ListArray.from_arrays(pa.array(np.arange(len(a) + 1, dtype=np.int32) * PARTS), pa.array(a.ravel(), kind))
        for batch in batches:
            n, last = batch.num_rows, batch
            if not n:
                continue
            x = batch.column("ints").flatten().to_numpy().astype(np.int64).reshape(n, PARTS, width)
            code, upper, lower = np.zeros((n, PARTS), np.int32), np.zeros((n, PARTS)), np.zeros((n, PARTS))
            if drift is not None:
                before = [batch.column(c).flatten().to_numpy().reshape(n, PARTS) for c in ("code", "upper", "lower")]
            for p in range(PARTS):
                if drift is None:
                    code[:, p], upper[:, p], lower[:, p] = scan(x[:, p], books[p])
                    scanned += n
                else:
                    code[:, p], upper[:, p], lower[:, p], full = reassign(x[:, p], books[p], drift[p], *(b[:, p] for b in before))
                    scanned += full
                np.add.at(sums[p], code[:, p], x[:, p])
                counts[p] += np.bincount(code[:, p], minlength=entries)
            values = [*(batch.column(c) for c in ("id", "label", "ints")), flat(code, pa.int32()), flat(upper, pa.float64()), flat(lower, pa.float64()), pa.nulls(n, pa.list_(pa.int64())), pa.nulls(n, pa.int64())]
            yield pa.RecordBatch.from_arrays(values, names)
        if last is not None:
            whole = np.concatenate([sums, counts[:, :, None]], 2).ravel()
            kinds = [last.schema.field(c).type for c in ("id", "label", "ints")] + [pa.list_(pa.int32()), pa.list_(pa.float64()), pa.list_(pa.float64())]
            yield pa.RecordBatch.from_arrays([*(pa.nulls(1, k) for k in kinds), pa.array([whole], pa.list_(pa.int64())), pa.array([scanned], pa.int64())], names)

    names = ["id", "label", "ints", "code", "upper", "lower", "sums", "scanned"]
    label = state.schema["label"].dataType.simpleString()
    columns = ["id", "label", "ints"] if drift is None else ["id", "label", "ints", "code", "upper", "lower"]
    return written(state.select(*columns).mapInArrow(run, f"id long, label {label}, {STATE}"), "codes")


def _moved(state: DataFrame, books: list[np.ndarray]) -> list[np.ndarray]:
    """Each entry at the floor of its parts' mean; entries without parts stay."""
    entries, width = books[0].shape
    # at most PARTS * ENTRIES * (width + 1) sums come to the driver
    totals = state.where("sums is not null").select(F.posexplode("sums").alias("at", "x")).groupBy("at").agg(F.sum("x").alias("x")).collect()
    sums = np.zeros(PARTS * entries * (width + 1), np.int64)
    for r in totals:
        sums[r["at"]] = r["x"]
    sums = sums.reshape(PARTS, entries, width + 1)
    count = sums[:, :, -1:]
    return [np.where(count[p] > 0, sums[p, :, :-1] // np.maximum(count[p], 1), books[p]) for p in range(PARTS)]


def train(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", rounds: int = ROUNDS) -> tuple[DataFrame, list[np.ndarray], list[np.ndarray] | None]:
    """(state, codebooks, how far they moved since the state's codes were assigned); no codebooks for an empty table."""
    kept = usable(rows, id_col, vec_col, label_col)
    by = [F.col("id").asc_nulls_last(), F.col("ints")]
    least = kept.orderBy(*by).limit(1).collect()
    if not least:
        return kept, [], None
    state = kept.where(F.size("ints") == len(least[0]["ints"]))
    seeds = np.array([r["ints"] for r in state.orderBy(*by).limit(ENTRIES).collect()], np.int64)  # the first codebook, ENTRIES rows
    books, drift = np.split(seeds, PARTS, axis=1), None
    for _ in range(rounds):
        state = _round(state, books, drift)
        moved = _moved(state, books)
        drift, books = drifts(books, moved), moved
        state = state.where("sums is null")
    return state, books, drift


def books_digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(int(x)) for b in books for x in b.ravel()).encode()).hexdigest()


def codebooks(spark, books: list[np.ndarray]) -> DataFrame:
    """(part, entry, centre) of the trained codebooks; centres are integers, SCALE to one."""
    found = [(p, k, [int(x) for x in e]) for p, b in enumerate(books) for k, e in enumerate(b)]
    return spark.createDataFrame(found, "part int, entry int, centre array<long>")


def coded(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(id, label, codes, code, error, label_error, codebooks_sha256) of every vector that can be coded."""
    state, books, drift = train(rows, id_col, vec_col, label_col)
    label = state.schema["label"].dataType.simpleString()
    if not books:
        return state.select("id", "label", F.array().cast("array<int>").alias("codes"), F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256"))
    width = books[0].shape[1]

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            n = batch.num_rows
            x = batch.column("ints").flatten().to_numpy().astype(np.int64).reshape(n, PARTS, width)
            code, upper, lower = (batch.column(c).flatten().to_numpy().reshape(n, PARTS) for c in ("code", "upper", "lower"))
            final, error = np.zeros((n, PARTS), np.int32), np.zeros(n, np.int64)
            for p in range(PARTS if n else 0):
                final[:, p] = reassign(x[:, p], books[p], drift[p], code[:, p], upper[:, p], lower[:, p])[0]
                error += own_distances(x[:, p], books[p], final[:, p])
            codes = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * PARTS), pa.array(final.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), codes, pa.array(error)], ["id", "label", "codes", "error"])

    found = written(state.select("id", "label", "ints", "code", "upper", "lower").mapInArrow(run, f"id long, label {label}, codes array<int>, error long"), "coded")
    by_label = found.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "_label")
    code = F.array_join(F.transform("codes", lambda c: F.lower(F.lpad(F.hex(c), 2, "0"))), "")
    joined = found.join(by_label, F.col("label").eqNullSafe(F.col("_label")))
    return joined.select("id", "label", "codes", code.alias("code"), "error", "label_error", F.lit(books_digest(books)).alias("codebooks_sha256"))


def restored(codes: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """(id, vec): the vectors that ``codes`` (id, codes) stand for."""
    table = [b.astype(np.float64) / SCALE for b in books]

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            at = batch.column("codes").flatten().to_numpy().reshape(batch.num_rows, PARTS)
            vec = np.concatenate([table[p][at[:, p]] for p in range(PARTS)], 1)
            values = pa.ListArray.from_arrays(pa.array(np.arange(len(vec) + 1, dtype=np.int32) * vec.shape[1]), pa.array(vec.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("id"), values], ["id", "vec"])

    return codes.select("id", "codes").mapInArrow(run, "id long, vec array<double>")
