"""MinHash near-dedup with tensored banding.

A document has COLLECTIONS small collections of ROWS minhashes each. A table key joins two of them, so
COLLECTIONS * (COLLECTIONS - 1) / 2 tables of 2 * ROWS rows come from COLLECTIONS * ROWS minhashes,
about the square root of what independent tables would need. At similarity 0.75 a pair misses all
tables where fewer than 2 of 16 collections agree: with probability 4e-5.

Equal shingle sets are one class from the start. A collection value that no other class has can't be
part of a shared key, so only shared values are paired into keys. Buckets may be as large as a third
of the corpus, and not all pairs of a bucket can be tried. What is tried loses no link that a bucket holds:

1. The shingles of a class that no other bucketed class has can't be in an intersection. With s shared
   shingles, n and m the set sizes, a link needs 175 * min(s, s') >= 75 * (n + m); classes with
   100 * s < 75 * n are linked with nothing and leave their buckets.
2. Every class is verified against the most central member of each of its buckets, the one with the
   smallest share of shingles of its own.
3. Links found give components, and a bucket whose members are in one component is done. The members of
   the others form families (nodes that such buckets connect). A family is cut into blocks of bounded
   size, those of its largest component apart; every two blocks but those meet in a cell, and a cell
   intersects its sets by matrix products over the shingles both blocks hold. Pairs are never written
   out: a cell returns a link for two components.

Links are confirmed on full shingle sets.

Defined cases: text without words has an empty set and is linked with nothing; rows with a null id
take no part and are kept; rows that repeat an id with unlike texts are documents of their own; of a
group's rows with its least id ``keep_one`` keeps one; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, written
from .components import components
from .shingles import mixed, shingle_sets
from .tokens import slices

COLLECTIONS = 16
ROWS = 2
SIMILAR = 75
#: Of a family's blocks: nodes, hashes, and columns of a matrix at a time.
BLOCK_NODES = 512
BLOCK_HASHES = 1 << 20
CHUNK = 4096
_A = np.random.default_rng(4242).integers(1, 1 << 63, COLLECTIONS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def sketched(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, h, n_shingles, set_a, set_b, u): hash of the text, size and 128-bit hash of its set, and its collections."""

    def sketch(batches):
        import pyarrow as pa

        for big in batches:
            for batch in slices(big):
                sets = shingle_sets(batch.column("raw").to_pylist())
                n = np.array([len(s) for s in sets], np.int64)
                full = np.flatnonzero(n)
                a, b, u = np.zeros(len(n), np.uint64), np.zeros(len(n), np.uint64), np.zeros((len(n), COLLECTIONS), np.uint64)
                if len(full):
                    h = np.concatenate([sets[k] for k in full])
                    cut = np.cumsum(n[full]) - n[full]
                    a[full], b[full] = np.add.reduceat(mixed(h), cut), np.bitwise_xor.reduceat(mixed(h + np.uint64(77)), cut)
                    for k in range(COLLECTIONS):
                        low = [np.minimum.reduceat(h * _A[k * ROWS + r], cut) for r in range(ROWS)]
                        key = low[0]
                        for x in low[1:]:
                            key = mixed(key) + x
                        u[full, k] = mixed(key)
                u = pa.FixedSizeListArray.from_arrays(pa.array(u.ravel().view(np.int64)), COLLECTIONS).cast(pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("h"), pa.array(n), pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), u], ["id", "h", "n_shingles", "set_a", "set_b", "u"])

    raw = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("raw"))
    return raw.withColumn("h", F.xxhash64("raw")).mapInArrow(sketch, "id long, h long, n_shingles long, set_a long, set_b long, u array<long>")


def bucket_members(classes: DataFrame) -> DataFrame:
    """(key, node): the tables' buckets, without those of a single class."""
    flat = classes.select("node", F.posexplode("u").alias("k", "v"))
    shared = flat.groupBy("k", "v").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("k", "v")
    own = flat.join(shared, ["k", "v"]).groupBy("node").agg(F.sort_array(F.collect_list(F.struct("k", "v"))).alias("s"))  # at most COLLECTIONS each
    # all pairs of one document's own shared collections
    pairs = F.flatten(F.transform("s", lambda x, i: F.transform(F.slice(F.col("s"), i + 2, COLLECTIONS), lambda y: F.xxhash64(x["k"], x["v"], y["k"], y["v"]))))
    return own.where(F.size("s") > 1).select("node", F.explode(pairs).alias("key"))


def sets_of(docs: DataFrame, nodes: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(node, n, hashes): the full set of each of ``nodes`` (node, id, h), by the text with that id and hash."""

    def collect(batches):
        import pyarrow as pa

        for big in batches:
            for batch in slices(big):
                sets = shingle_sets(batch.column("raw").to_pylist())
                n = np.array([len(s) for s in sets], np.int64)
                flat = np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64)
                hashes = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(flat))
                yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(n), hashes], ["node", "n", "hashes"])

    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("raw")).withColumn("h", F.xxhash64("raw"))
    own = texts.join(nodes, ["id", "h"]).select("node", "raw").dropDuplicates(["node"])
    return own.mapInArrow(collect, "node long, n long, hashes array<long>")


def with_shared(sets: DataFrame) -> DataFrame:
    """(node, n, s) of each set: s shingles stand in another set too."""
    flat = sets.select("node", F.explode("hashes").alias("h"))
    several = flat.groupBy("h").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("h")
    counts = flat.join(several, "h", "left_semi").groupBy("node").agg(F.count(F.lit(1)).alias("s"))
    return sets.select("node", "n").join(counts, "node").select("node", "n", "s")


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those (a, b) of ``pairs`` whose full sets are similar enough."""

    def confirm(batches):
        import pyarrow as pa

        for batch in batches:
            hashes = [batch.column(c) for c in ("ha", "hb")]
            ends = [h.offsets.to_numpy() for h in hashes]
            flat = [h.values.to_numpy() for h in hashes]
            keep = []
            for k in range(batch.num_rows):
                p, q = (f[e[k] : e[k + 1]] for f, e in zip(flat, ends))
                both = len(np.intersect1d(p, q, assume_unique=True))
                keep.append(100 * both >= SIMILAR * (len(p) + len(q) - both))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left = pairs.join(sets.select(F.col("node").alias("a"), F.col("hashes").alias("ha")), "a")
    both = left.join(sets.select(F.col("node").alias("b"), F.col("hashes").alias("hb")), "b")
    return both.select("a", "b", "ha", "hb").mapInArrow(confirm, "a long, b long")


def intersections(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of sets in ``a`` with sets in ``b``, over the hashes that both sides hold, CHUNK at a time."""
    flat = [np.concatenate(x) for x in (a, b)]
    common = np.intersect1d(*flat)
    total = np.zeros((len(a), len(b)), np.int64)
    if not len(common):
        return total
    at = []
    for x, side in zip(flat, (a, b)):
        owner = np.repeat(np.arange(len(side)), [len(h) for h in side])
        column = np.minimum(np.searchsorted(common, x), len(common) - 1)
        held = common[column] == x
        order = np.argsort(column[held], kind="stable")
        at.append((owner[held][order], column[held][order]))
    for low in range(0, len(common), CHUNK):
        parts = []
        for (owner, column), side in zip(at, (a, b)):
            i, j = np.searchsorted(column, [low, low + CHUNK])
            m = np.zeros((len(side), min(CHUNK, len(common) - low)), np.float32)
            m[owner[i:j], column[i:j] - low] = 1
            parts.append(m)
        total += (parts[0] @ parts[1].T).astype(np.int64)
    return total


def between_parts(left: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b): links between the components of rows (node, head, part, n); a node has a row for each open bucket's head."""
    families = components(left.select(F.col("node").alias("a"), F.col("head").alias("b")))
    nodes = left.select("node", "part", "n").distinct().join(families, "node").withColumnRenamed("component", "family")
    parts = nodes.groupBy("family", "part").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("h"))
    sizes = parts.groupBy("family").agg(F.max(F.struct("c", "h", "part")).alias("main"), F.sum("c").alias("c"), F.sum("h").alias("h"))
    blocks = lambda c, h: (1 + F.floor(F.greatest(c / BLOCK_NODES, h / BLOCK_HASHES))).cast("int")
    sizes = sizes.select("family", F.col("main.part").alias("main"), blocks(F.col("main.c"), F.col("main.h")).alias("of_main"), blocks(F.col("c") - F.col("main.c"), F.col("h") - F.col("main.h")).alias("of_rest"))
    # the largest component's blocks come first and don't meet each other
    nodes = nodes.join(sizes, "family").withColumn("in_main", F.col("part") == F.col("main"))
    spread = lambda n: F.pmod(F.xxhash64("node"), n).cast("int")
    nodes = nodes.withColumn("block", F.when(F.col("in_main"), spread(F.col("of_main"))).otherwise(F.col("of_main") + spread(F.col("of_rest"))))
    met = F.sequence(F.when(F.col("in_main"), F.col("of_main")).otherwise(0), F.col("of_main") + F.col("of_rest") - 1)
    cells = nodes.select("family", "node", "part", "block", F.inline(F.transform(met, lambda x: F.struct(F.least(x, "block").alias("i"), F.greatest(x, "block").alias("j")))))
    cells = cells.join(sets.select("node", "hashes"), "node")

    def meet(table):
        import pyarrow as pa

        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        node, part, block = (table.column(c).to_numpy() for c in ("node", "part", "block"))
        column = table.column("hashes").combine_chunks()
        flat, ends = column.values.to_numpy(), column.offsets.to_numpy()
        hashes = [flat[a:b] for a, b in zip(ends[:-1], ends[1:])]
        rows, columns = np.flatnonzero(block == i), np.flatnonzero(block == j)
        out: dict[tuple[int, int], tuple[int, int]] = {}
        if len(rows) and len(columns):
            both = intersections([hashes[k] for k in rows], [hashes[k] for k in columns])
            n = np.array([len(h) for h in hashes], np.int64)
            near = (100 * both >= SIMILAR * (n[rows][:, None] + n[columns][None, :] - both)) & (part[rows][:, None] != part[columns][None, :])
            for x, y in zip(*np.nonzero(near)):
                p, q = rows[x], columns[y]
                out.setdefault((min(part[p], part[q]), max(part[p], part[q])), (int(node[p]), int(node[q])))
        a, b = zip(*out.values()) if out else ((), ())
        return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return cells.groupBy("family", "i", "j").applyInArrow(meet, "a long, b long")


def _linked(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, h, n_shingles, part, component_id, kept) of every row; rows of a component share ``part``."""
    bounded_batches(docs.sparkSession)
    sketch = written(sketched(docs, id_col, text_col), "sketches")
    full = sketch.where("id is not null and n_shingles > 0")
    classes = full.groupBy("set_a", "set_b", "n_shingles").agg(F.min(F.struct("id", "h")).alias("of"), F.first("u").alias("u"))
    # ids may repeat with unlike texts, so classes have numbers of their own
    classes = written(classes.select("*", "of.id", "of.h").drop("of").withColumn("node", F.monotonically_increasing_id()), "classes")
    buckets = written(bucket_members(classes), "buckets")
    sets = written(sets_of(docs, classes.select("node", "id", "h").join(buckets.select("node").distinct(), "node"), id_col, text_col), "sets")
    able = with_shared(sets).where(F.col("s") * 100 >= F.col("n") * SIMILAR)
    members = written(buckets.join(able, "node"), "members")
    fits = F.least("s", "t") * (100 + SIMILAR) >= (F.col("n") + F.col("m")) * SIMILAR
    central = F.min(F.struct(((F.col("n") - F.col("s")) / F.col("n")).alias("own"), F.col("node").alias("node"), "n", "s")).alias("h")

    heads = members.groupBy("key").agg(central).select("key", F.col("h.node").alias("b"), F.col("h.n").alias("m"), F.col("h.s").alias("t"))
    star = members.join(heads, "key").where((F.col("node") != F.col("b")) & fits).select(F.col("node").alias("a"), "b")
    pairs = written(star.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "pairs")
    links = written(verified(pairs, sets), "links")
    parts = components(links)
    placed = members.join(parts, "node", "left").withColumn("part", F.coalesce("component", "node")).drop("component")
    bounds = placed.groupBy("key").agg(F.min("part").alias("lo"), F.max("part").alias("hi"), F.min("node").alias("head")).where("lo != hi")
    left = written(placed.join(bounds.select("key", "head"), "key").select("node", "head", "part", "n").distinct(), "open")
    if not left.isEmpty():
        parts = components(links.unionByName(between_parts(left, sets)))
    of_class = classes.select("set_a", "set_b", "n_shingles", "id", "node").join(parts, "node", "left")
    least = of_class.where("component is not null").groupBy("component").agg(F.min("id").alias("least"))
    of_class = of_class.join(least, "component", "left").select("set_a", "set_b", "n_shingles", F.coalesce("component", "node").alias("part"), F.coalesce("least", "id").alias("of"))
    joined = sketch.join(of_class, ["set_a", "set_b", "n_shingles"], "left")
    component = F.when(F.col("n_shingles") > 0, F.when(F.col("id").isNotNull(), F.col("of"))).otherwise(F.col("id"))
    return joined.select("id", "h", "n_shingles", "part", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)))


def linked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id, kept) of every row."""
    return _linked(docs, id_col, text_col).select("id", "n_shingles", "component_id", "kept")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay: one of each group of near duplicates."""
    found = _linked(docs, id_col, text_col).where("id is not null and n_shingles > 0")
    texts = found.groupBy("id", "h", "part", "kept").agg(F.count(F.lit(1)).alias("rows"))
    # of a group's rows with its least id, the text of least hash stays
    first = texts.where("kept").groupBy("id", "part").agg(F.min("h").alias("first"))
    texts = texts.join(first, ["id", "part"], "left").withColumn("stays", F.col("kept") & (F.col("h") == F.col("first")))
    texts = written(texts.where("not stays or rows > 1").select("id", "h", "stays"), "gone")
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).cast("long").alias("id"), F.xxhash64(F.col(text_col).cast("binary")).alias("h"))
    kept = rows.join(texts, ["id", "h"], "left_anti")
    repeated = texts.where("stays")
    if not repeated.isEmpty():
        kept = kept.unionByName(rows.join(repeated, ["id", "h"], "left_semi").dropDuplicates(["id", "h"]))
    return kept.select("row.*")
