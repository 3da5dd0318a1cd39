"""Best-fit-decreasing sharding of indivisible groups.

Equal texts form a group that stays together. Best fit only looks at sizes, so Spark reduces the groups
to a histogram of sizes, rounded up to SIZE_BITS significant bits: at most 2^(SIZE_BITS - 1) sizes an
octave, whatever the corpus, and sizes under 2^SIZE_BITS are exact. Every group is an item by itself.

Items, largest first, enter the bin with the tightest remaining capacity that holds them; the bins
stand in a balanced tree by remaining capacity. A bin that took an item is the tightest still as long
as it holds another of the size, so items of one size are placed many at a time: a run says which of
them, by rank, go to which bin. ``shards_for`` finds the least capacity with which that fills no more
than the wanted shards. Groups are then ranked within their size by hash and joined to the runs.

Defined cases: null text counts as empty; repeated rows are placed together; an empty table gives an
empty result; a group larger than a fair share fills a shard by itself; other columns are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import numbered, written

SIZE_BITS = 16
#: Groups of more than this part of all rows, so fewer than this many, are joined by broadcast.
HEAVY_PARTS = 1 << 12


class CapacityTree:
    """A treap of (remaining capacity, bin); find takes the tightest bin that holds a size."""

    def __init__(self):
        self.root, self.state = None, 1

    def _split(self, node, key):
        if node is None:
            return None, None
        if node[0] < key:
            node[3], right = self._split(node[3], key)
            return node, right
        left, node[2] = self._split(node[2], key)
        return left, node

    def _merge(self, a, b):
        if a is None or b is None:
            return a or b
        if a[1] > b[1]:
            a[3] = self._merge(a[3], b)
            return a
        b[2] = self._merge(a, b[2])
        return b

    def add(self, room: int, number: int) -> None:
        self.state = self.state * 6364136223846793005 + 1442695040888963407 & (1 << 64) - 1
        left, right = self._split(self.root, (room, number))
        self.root = self._merge(self._merge(left, [(room, number), self.state >> 32, None, None]), right)

    def take(self, size: int):
        """Remove and return the (room, number) of least room >= size, or None."""
        left, right = self._split(self.root, (size, -1))
        if right is None:
            self.root = left
            return None
        node = right
        while node[2] is not None:
            node = node[2]
        first, rest = self._split(right, (node[0][0], node[0][1] + 1))
        self.root = self._merge(left, rest)
        return node[0]


def best_fit_decreasing(counts: dict[int, int], capacity: int, most: int | None = None) -> list[tuple[int, int, int, int]] | None:
    """[(size, first, n, bin)]: of the items of a size, the ``n`` from rank ``first`` on enter that bin.

    ``counts`` holds how many items there are of each size. An item above the capacity gets a bin of its
    own. None, if that needs more than ``most`` bins.
    """
    tree, bins, runs = CapacityTree(), 0, []
    for size in sorted(counts, reverse=True):
        first = 0
        while first < counts[size]:
            found = tree.take(size) if size <= capacity else None
            room, number = found or (max(capacity, size), bins)
            bins += found is None
            if most is not None and bins > most:
                return None
            n = min(counts[size] - first, room // size)
            runs.append((size, first, n, number))
            tree.add(room - n * size, number)
            first += n
    return runs


def shards_for(counts: dict[int, int], shards: int) -> list[tuple[int, int, int, int]]:
    """The runs of best-fit decreasing at the least capacity, to one part in 2^20, that needs no more than ``shards`` bins."""
    if not counts:
        return []
    low = max(-(-sum(size * n for size, n in counts.items()) // shards), max(counts))
    high, best = low, best_fit_decreasing(counts, low, shards)
    while best is None:
        low, high = high + 1, high + max(1, high >> 4)
        best = best_fit_decreasing(counts, high, shards)
    step = max(1, low >> 20)
    while high - low > step:
        middle = (low + high) // 2
        placed = best_fit_decreasing(counts, middle, shards)
        if placed is None:
            low = middle + 1
        else:
            best, high = placed, middle
    return best


def rounded_up(size: Column) -> Column:
    """``size`` with SIZE_BITS significant bits, rounded up."""
    shift = F.greatest(F.length(F.bin(size)) - SIZE_BITS, F.lit(0)).cast("int")
    return F.call_function("shiftleft", F.call_function("shiftright", size + F.call_function("shiftleft", F.lit(1).cast("long"), shift) - 1, shift), shift)


def _sharded(docs: DataFrame, place) -> DataFrame:
    """Rows with the shard that ``place`` (histogram of sizes -> runs) gives their group, numbered within it."""
    spark = docs.sparkSession
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    sized = docs.select("doc_id", (F.octet_length(raw) + 1).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"), F.xxhash64(raw).alias("hash"))
    sized = written(sized, "sharding")
    groups = sized.groupBy("hash").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"))
    groups = written(groups.select("hash", "n", rounded_up(F.col("bytes")).alias("class")), "groups")
    counts = {r["class"]: r["count"] for r in groups.groupBy("class").count().collect()}  # bounded by SIZE_BITS
    runs = spark.createDataFrame([(size, first, first + n, number) for size, first, n, number in place(counts)], "class long, first long, last long, shard int")
    ranked = numbered(groups, "class", ["hash"], "nth").join(runs, "class").where((F.col("nth") >= F.col("first")) & (F.col("nth") < F.col("last")))
    put = written(ranked.select("hash", "n", "shard"), "shards")
    least = (groups.agg(F.sum("n")).first()[0] or 0) // HEAVY_PARTS
    heavy, light = put.where(F.col("n") > least), put.where(F.col("n") <= least)
    known = sized.join(F.broadcast(heavy.select("hash", "shard")), "hash", "left")  # fewer than HEAVY_PARTS rows
    names = ["doc_id", "size", "text_crc32", "shard"]
    rest = known.where("shard is null").drop("shard").join(light.select("hash", "shard"), "hash")
    return numbered(known.where("shard is not null").select(names).unionByName(rest.select(names)), "shard", ["doc_id", "text_crc32"], "slot")


def shard_by_bytes(docs: DataFrame, shards: int = 8) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) over ``shards`` shards of near equal size, equal texts together."""
    return _sharded(docs, lambda counts: shards_for(counts, shards))


def shard_by_capacity(docs: DataFrame, capacity: int) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) over as few shards of at most ``capacity`` bytes as best fit finds.

    A group above the capacity has a shard of its own.
    """
    return _sharded(docs, lambda counts: best_fit_decreasing(counts, capacity))
