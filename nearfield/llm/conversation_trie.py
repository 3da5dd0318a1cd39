"""Conversation prefix tries: what conversations share from their first turn on.

A node is a distinct sequence of the first d turns (role and text); a conversation is a member of every
node it starts with. Equal conversations collapse into one sequence first, by a sorted stream, however
many there are. Sequences are dealt over buckets by the digest of their first turn; a bucket builds its
tries as dictionaries of (parent, turn) -> node inside applyInPandas, and sums up subtrees from the last
node made to the first, which is a postorder without recursion, since children are made after parents.

A subtrie of more than MOST_TURNS turns isn't built in one task. Its sequences are partitioned again by the
turn after their longest common prefix (by the next turn, where the prefix is only its top), round by round
until all are small; the nodes of the common prefix come from an aggregation. The common prefix of a group is
that of its least and its greatest sequence. Sums of the large subtries are added up from the last round to
the first, one aggregation a round.

Defined cases: null roles and texts are empty; turns go by number, null first, and turns of equal number by
the digest of their role and text; rows with a null id belong to no conversation; a conversation
without turns is a member of the root; an empty table has no nodes; other columns are ignored. A conversation is one row while it is worked
on, 24 bytes a turn, as a document is.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import parallelism, written

MOST_TURNS = 1 << 16
BUCKET_TURNS = 1 << 16
NO_END = hashlib.sha256(b"").hexdigest()

NODES = "grp string, parent_grp string, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
COLUMNS = "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256".split()


def turns_of(conversations: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """(conv_id, turns): the turns of each conversation in order, as (turn, digest of role and text, UTF-8 bytes of the text)."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)))
    turn = F.struct(F.col("turn").alias("turn"), digest.alias("digest"), F.octet_length(text).cast("long").alias("size"))
    return conversations.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("conv_id")).agg(F.sort_array(F.collect_list(turn)).alias("turns"))


def spliced(turns: DataFrame, every: int = 5, most: int = 9) -> DataFrame:
    """(conv_id, turns) rebuilt: the first h turns of conversation c - c % ``every``, then c's own after its first h; h = crc32 of decimal c, modulo ``most``."""
    heads = turns.where(F.col("conv_id") % every == 0).select(F.col("conv_id").alias("_head"), F.slice("turns", 1, most - 1).alias("lead"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("int")
    lead = F.slice(F.coalesce(F.col("lead"), F.slice("turns", 1, 0)), F.lit(1), h)
    rest = F.slice("turns", h + 1, F.size("turns"))
    return turns.join(heads, F.col("conv_id") - F.col("conv_id") % every == F.col("_head"), "left").select("conv_id", F.concat(lead, rest).alias("turns"))


def sequences(conversations: DataFrame) -> DataFrame:
    """One row for each distinct sequence of turns of (conv_id, turns): least conv_id, n, digest of all its conv_ids, digests and sizes by depth (the root's first)."""
    key = F.md5(F.array_join(F.transform("turns", lambda t: F.hex(t["digest"])), ","))
    found = written(conversations.select("conv_id", key.alias("key"), "turns"), "sequences")

    def fold(batches):
        import pyarrow as pa

        def lines():
            for batch in batches:
                yield from zip(batch.column("key").to_pylist(), batch.column("conv_id").to_pylist())

        done: list[tuple] = []
        now = least = digest = None
        n = 0
        for key, conv in lines():
            if key != now:
                if now is not None:
                    done.append((least, n, digest.hexdigest()))
                now, least, n, digest = key, conv, 0, hashlib.sha256()
            digest.update(str(conv).encode() if not n else b"," + str(conv).encode())
            n += 1
            if len(done) >= 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done)], names)
                done = []
        if now is not None:
            done.append((least, n, digest.hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done)], names)

    names = ["conv_id", "n", "ends"]
    # equal conversations in a row, ascending: their ids are hashed as they come and never held together
    ordered = found.select("key", "conv_id").repartition(parallelism(found.sparkSession), "key").sortWithinPartitions("key", "conv_id")
    copies = ordered.mapInArrow(fold, "conv_id long, n long, ends string")
    digests = F.concat(F.array(F.lit(b"")), F.col("turns.digest"))
    sizes = F.concat(F.array(F.lit(0).cast("long")), F.col("turns.size"))
    return found.join(copies, "conv_id").select(F.col("conv_id").alias("least"), "n", "ends", digests.alias("digests"), sizes.alias("sizes"))


def common_length(a: Column, b: Column) -> Column:
    """Number of leading elements that two arrays share."""
    n = F.least(F.size(a), F.size(b))
    same = F.transform(F.arrays_zip(F.slice(a, F.lit(1), n).alias("a"), F.slice(b, F.lit(1), n).alias("b")), lambda x: x["a"] == x["b"])
    at = F.array_position(same, False)
    return F.when(at == 0, n).otherwise(at - 1).cast("int")


def build_tries(rows):
    """A bucket's nodes from its sequences: each starts at depth ``at`` of its group."""
    import pandas as pd

    index: dict[tuple, int] = {}
    group, over, parent, least, depth, above, n, size, ends = [], [], [], [], [], [], [], [], []
    for r in rows.itertuples(index=False):
        node = -1
        for d in range(r.at, len(r.digests)):
            key = (node, r.digests[d]) if node >= 0 else (-1, r.grp)
            child = index.get(key)
            if child is None:
                child = index[key] = len(depth)
                for column, value in ((group, r.grp), (over, r.parent_grp if node < 0 else None), (parent, node), (least, r.least), (depth, d), (above, r.parent_least), (n, 0), (size, int(r.sizes[d])), (ends, NO_END)):
                    column.append(value)
            n[child] += r.n
            least[child] = min(least[child], r.least)
            node = child
        ends[node] = r.ends
    children, leaves, saved = [0] * len(n), [0] * len(n), [0] * len(n)
    for k in range(len(n) - 1, -1, -1):  # children come after their parents
        leaves[k] = leaves[k] or 1
        saved[k] += (n[k] - 1) * size[k]
        if (p := parent[k]) >= 0:
            children[p] += 1
            leaves[p] += leaves[k]
            saved[p] += saved[k]
    up = [least[p] if p >= 0 else a for p, a in zip(parent, above)]
    found = pd.DataFrame({"grp": group, "parent_grp": over, "conv_id": least, "depth": depth, "parent_conv_id": up, "n_convs": n, "n_children": children, "n_leaves": leaves, "saved_tokens": saved, "ends_sha256": ends})
    return found.astype({"parent_conv_id": "Int64"})


def trie(conversations: DataFrame, most_turns: int = MOST_TURNS, bucket_turns: int = BUCKET_TURNS) -> DataFrame:
    """The nodes of the trie of (conv_id, turns), as COLUMNS."""
    whole = sequences(conversations)
    none = F.lit(None)
    state = written(whole.select(F.md5(F.lit(b"")).alias("grp"), none.cast("string").alias("parent_grp"), none.cast("long").alias("parent_least"), F.lit(0).alias("at"), *whole.columns), "trie")
    small, large, turns = [], [], 0
    while True:
        sizes = state.groupBy("grp").agg(F.sum(F.size("digests") - F.col("at")).alias("turns"))
        # the root has no turn of its own to be dealt by; every other group stays whole while it is small
        big = sizes if not large else sizes.where(F.col("turns") > most_turns)
        big = written(big, "large")
        inside = state.join(big.select("grp"), "grp", "left_semi")
        rest = F.struct(F.slice("digests", F.col("at") + 1, F.size("digests")).alias("digests"), F.slice("sizes", F.col("at") + 1, F.size("sizes")).alias("sizes"))
        chains = inside.groupBy("grp", "parent_grp", "parent_least", "at").agg(F.min(rest).alias("low"), F.max(rest).alias("high"), F.sum("n").alias("n"), F.min("least").alias("first"))
        run = common_length(F.col("low.digests"), F.col("high.digests"))
        chains = written(chains.select("grp", "parent_grp", "parent_least", "at", "n", "first", run.alias("run"), F.slice("low.sizes", F.lit(1), run).alias("chain")), "chains")
        if not large:
            turns = sizes.agg(F.sum("turns")).first()[0] or 0
        else:
            small.append(state.join(big.select("grp"), "grp", "left_anti"))
        if not chains.limit(1).count():
            break
        below = inside.join(chains.select("grp", "first", (F.col("at") + F.col("run")).alias("to")), "grp")
        stay = below.where(F.size("digests") == F.col("to")).select("grp", "ends")
        large.append(written(chains.join(stay, "grp", "left"), "chains"))
        down = below.where(F.size("digests") > F.col("to"))
        child = F.md5(F.concat(F.col("grp"), F.hex(F.get("digests", F.col("to")))))
        state = written(down.select(child.alias("grp"), F.col("grp").alias("parent_grp"), F.col("first").alias("parent_least"), F.col("to").alias("at"), *whole.columns), "trie")
    if not large:
        return whole.sparkSession.createDataFrame([], NODES).select(*COLUMNS)
    dealt = small[0]
    for more in small[1:]:
        dealt = dealt.unionByName(more)
    buckets = 1 + turns // bucket_turns
    dealt = dealt.withColumn("bucket", F.pmod(F.xxhash64("grp"), F.lit(buckets)))
    built = written(dealt.repartition(max(parallelism(whole.sparkSession), min(buckets, 8192)), "bucket").groupBy("bucket").applyInPandas(build_tries, NODES), "nodes")
    total = lambda tops: tops.groupBy("parent_grp").agg(F.count(F.lit(1)).alias("kids"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"))
    kids = total(built.where("parent_grp is not null"))
    result, tops = built.select(*COLUMNS), None
    for chains in reversed(large):
        under = kids
        if tops is not None:
            under = kids.unionByName(total(tops)).groupBy("parent_grp").agg(*[F.sum(c).alias(c) for c in ("kids", "leaves", "saved")])
        under = under.select(F.col("parent_grp").alias("_under"), "kids", "leaves", "saved")
        joined = chains.join(under, F.col("grp") == F.col("_under"), "left").select(*chains.columns, *[F.coalesce(c, F.lit(0)).alias(c) for c in ("kids", "leaves", "saved")])
        node = joined.select("*", F.posexplode("chain").alias("j", "_size"))
        last = F.col("j") == F.col("run") - 1
        below = F.aggregate(F.slice("chain", F.col("j") + 1, F.col("run")), F.lit(0).cast("long"), lambda s, x: s + x)
        nodes = node.select(
            "grp", F.when(F.col("j") == 0, F.col("parent_grp")).alias("parent_grp"), F.col("first").alias("conv_id"), (F.col("at") + F.col("j")).cast("long").alias("depth"),
            F.when(F.col("j") == 0, F.col("parent_least")).otherwise(F.col("first")).alias("parent_conv_id"), F.col("n").alias("n_convs"),
            F.when(last, F.col("kids")).otherwise(F.lit(1)).cast("long").alias("n_children"), F.greatest(F.col("leaves"), F.lit(1)).cast("long").alias("n_leaves"),
            (F.col("saved") + (F.col("n") - 1) * below).cast("long").alias("saved_tokens"), F.when(last & F.col("ends").isNotNull(), F.col("ends")).otherwise(F.lit(NO_END)).alias("ends_sha256"),
        )
        nodes = written(nodes, "nodes")
        tops = nodes.where("parent_grp is not null")
        result = result.unionByName(nodes.select(*COLUMNS))
    return result
