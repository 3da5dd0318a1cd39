"""Substring dedup of word windows, by matching statistics against suffix automata of reference shards.

A window is DEPTH consecutive words of a document. A word goes if a window that covers it also starts in
a document with a smaller id.

A reference shard's suffix automaton knows every string of words in the shard, and for each the least
document that holds it, because documents are fed in ascending order of id. A text is streamed through
it word by word: the matching statistic is the length of the longest string ending there that the shard
holds. Where it reaches DEPTH, the state of that window tells its least document, and consecutive
covered windows make up a maximal span.

Broadcasting the automata of all of a corpus to all of its documents would read every document once a
shard, quadratic in the corpus. So shards are cut by a key that equal windows share, and a shard meets
only the text that holds its keys: the key of a window is the least hash among its GRAM-word strings (its
minimizer), consecutive windows of one key form a run, and

1. each document sends (key, content hash) of its runs; keys that one document alone has end here,
2. equal runs collapse to the one of the least document, by partial aggregation, however many copies there are,
3. the words of these runs are dealt over shards by key; a shard builds its automaton and streams its runs,
4. answers go back to all copies of a run: those in a later document are covered whole.

A key of more than MOST_RUNS different runs (a passage in very many surroundings) would make an unbounded
shard. Its windows are dealt again, by minimizers under another hash, up to AGAIN times, which makes a few runs of each. Those
of keys that are still as wide are cut into their single windows, which then collapse by step 2 alone. The wide keys, at most
one for MOST_RUNS different runs and WIDE_KEYS in all (beyond which only wider ones count), are broadcast, and texts are read
again where they lie: only the runs of wide keys are dealt anew, and neither texts nor the runs that stay are moved for them.

Given a reference that is small by a checked bound (``against``), its automata are broadcast to all tasks.

Defined cases: a null text has no words; texts under DEPTH words lose nothing; rows with a null id neither
lose nor claim anything; rows that repeat an id don't cut each other; an empty table gives an empty
result; other columns are carried along, whatever their names. Runs are told apart by two 64-bit hashes (key and
content); inside a shard, words are compared as such.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .common import bounded_batches, parallelism, written
from .suffix_dedup import SLICE, _constants
from .tokens import slices

DEPTH = 50
GRAM = 10
MOST_RUNS = 1024
AGAIN = 3
WIDE_KEYS = 1 << 22
SHARD_WORDS = 1 << 16
MOST_REFERENCE_WORDS = 1 << 20
PIECE = 1 << 18

_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ h >> np.uint64(29)


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, hash) of every word of ``data``; words are runs of anything but ASCII white space."""
    word = ~_SPACE[data]
    edge = np.flatnonzero(np.diff(np.concatenate([[False], word, [False]]).view(np.int8)))
    start, end = edge[::2], edge[1::2]
    out = np.zeros(len(start), np.uint64)
    values, up, down = _constants(0)
    at = 0
    while at < len(start):
        low = int(start[at])
        to = int(np.searchsorted(end, low + SLICE, side="right"))
        if to <= at:  # a word longer than a slice
            to = at + 1
            out[at] = int.from_bytes(hashlib.blake2b(data[low : int(end[at])].tobytes(), digest_size=8).digest(), "little")
        else:
            part = data[low : int(end[to - 1])]
            sums = np.zeros(len(part) + 1, np.uint64)
            np.cumsum(values[part] * up[: len(part)], out=sums[1:])
            a, b = start[at:to] - low, end[at:to] - low
            out[at:to] = mixed((sums[b] - sums[a]) * down[a])
        at = to
    return start, out


def window_runs(h: np.ndarray, ok: np.ndarray, split: bool = False, salt: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first window, number of windows, key, content hash) of the runs among word hashes ``h``; ``ok`` says which words start a window.

    With ``split`` every window is a run, and its key a hash of all its words. Another ``salt`` gives other minimizers.
    """
    found: list[list[np.ndarray]] = [[], [], [], []]
    (_, up, down), (_, up2, down2) = _constants(1), _constants(0)
    odd = np.uint64(0x9E3779B97F4A7C15)
    for low in range(0, len(ok), PIECE):
        here = ok[low : low + PIECE]
        x = h[low : low + PIECE + DEPTH - 1]
        n = min(len(here), len(x) - DEPTH + 1)
        if n <= 0 or not here[:n].any():
            continue
        sums = np.zeros(len(x) + 1, np.uint64)
        np.cumsum(x * up[: len(x)], out=sums[1:])
        if split:
            first = np.flatnonzero(here[:n])
            last = first
            content = mixed((sums[first + DEPTH] - sums[first]) * down[first])
            second = np.zeros(len(x) + 1, np.uint64)
            np.cumsum(x * up2[: len(x)], out=second[1:])
            key = mixed((second[first + DEPTH] - second[first]) * down2[first])
        else:
            grams = mixed((sums[GRAM:] - sums[:-GRAM]) * down[: len(x) - GRAM + 1])
            if salt:
                grams = mixed(grams + odd * np.uint64(salt))
            place = np.uint64((1 << 20) - 1)
            least = grams & ~place | np.arange(len(grams), dtype=np.uint64)
            width, need = 1, DEPTH - GRAM + 1
            while 2 * width <= need:
                least = np.minimum(least[:-width], least[width:])
                width *= 2
            if need > width:
                least = np.minimum(least[: len(least) - (need - width)], least[need - width :])
            anchor = np.where(here[:n], (least[:n] & place).astype(np.int64), -1)
            cut = np.flatnonzero(np.diff(anchor)) + 1
            first, last = np.concatenate([[0], cut]), np.concatenate([cut, [n]]) - 1
            held = anchor[first] >= 0
            first, last = first[held], last[held]
            key = mixed(grams[anchor[first]] * odd)
            content = mixed((sums[last + DEPTH] - sums[first]) * down[first]) + (last - first).astype(np.uint64)
        for out, value in zip(found, (first + low, last - first + 1, key, content)):
            out.append(value)
    kinds = (np.int64, np.int64, np.uint64, np.uint64)
    return tuple(np.concatenate(x) if x else np.zeros(0, kind) for x, kind in zip(found, kinds))


class SuffixAutomaton:
    """All strings of words of the sequences fed to it, each with the first owner fed; feed owners in ascending order."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.length, self.owner = [-1], [0], [None]

    def _state(self, length: int, link: int, following: dict, owner) -> int:
        self.next.append(following)
        self.link.append(link)
        self.length.append(length)
        self.owner.append(owner)
        return len(self.length) - 1

    def feed(self, sequence, owner) -> None:
        last = 0
        for word in sequence:
            last = self._extend(last, word, owner)

    def _extend(self, last: int, word, owner) -> int:
        nxt, link, length = self.next, self.link, self.length
        q = nxt[last].get(word)
        if q is not None and length[q] == length[last] + 1:
            return q
        new = None if q is not None else self._state(length[last] + 1, 0, {}, owner)
        p = last
        if new is not None:
            while p >= 0 and word not in nxt[p]:
                nxt[p][word] = new
                p = link[p]
            if p < 0:
                return new
            q = nxt[p][word]
            if length[q] == length[p] + 1:
                link[new] = q
                return new
        clone = self._state(length[p] + 1, link[q], dict(nxt[q]), self.owner[q])
        while p >= 0 and nxt[p].get(word) == q:
            nxt[p][word] = clone
            p = link[p]
        link[q] = clone
        if new is None:
            return clone
        link[new] = clone
        return new

    def first_owners(self, sequence, depth: int):
        """(end, first owner) of each string of ``depth`` words of ``sequence`` that the automaton holds."""
        nxt, link, length = self.next, self.link, self.length
        state = matched = 0
        for at, word in enumerate(sequence):
            while state and word not in nxt[state]:
                state = link[state]
                matched = length[state]
            if word in nxt[state]:
                state = nxt[state][word]
                matched += 1
            if matched >= depth:
                while length[link[state]] >= depth:
                    state = link[state]
                matched = min(matched, length[state])
                yield at, self.owner[state]


def covered(words: int, runs, depth: int = DEPTH) -> np.ndarray:
    """Which of ``words`` words the windows cover that ``runs`` (first, number, mask) name."""
    edge = np.zeros(words + 1, np.int32)
    for first, n, mask in runs:
        if mask == (1 << n) - 1:
            edge[first] += 1
            edge[first + n - 1 + depth] -= 1
            continue
        for j in range(n):
            if mask >> j & 1:
                edge[first + j] += 1
                edge[first + j + depth] -= 1
    return np.cumsum(edge[:-1]) > 0


RUNS = "doc long, k long, pos int, n int, key long, content long"


def among(h: np.ndarray, ok: np.ndarray, keys: np.ndarray, salt: int) -> np.ndarray:
    """Which of the windows ``ok`` have a key among ``keys`` (sorted), dealt by ``salt``."""
    first, n, key, _ = window_runs(h, ok, salt=salt)
    held = keys[np.minimum(np.searchsorted(keys, key), len(keys) - 1)] == key
    edge = np.zeros(len(ok) + 1, np.int8)
    edge[first[held]] += 1
    edge[(first + n)[held]] -= 1
    return np.cumsum(edge[:-1], dtype=np.int8) > 0


def runs_of(texts: DataFrame, wide: list | None = None) -> DataFrame:
    """(doc, k, pos, n, key, content) of the runs of (doc, k, text).

    ``wide`` has broadcast keys (sorted) for each time that windows were dealt so far: only windows whose keys are among all of them are dealt
    again, by other minimizers, or each by itself after AGAIN times.
    """
    wide = list(wide or [])

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for part in slices(batch):
                raw = part.column("text").to_pylist()
                data = np.frombuffer(b" ".join(raw), np.uint8)
                ends = np.cumsum(np.array([len(t) + 1 for t in raw], np.int64))
                start, h = word_hashes(data)
                owner = np.searchsorted(ends, start, side="right")
                ok = np.zeros(len(h), bool)
                if len(h) >= DEPTH:
                    ok[: len(h) - DEPTH + 1] = owner[DEPTH - 1 :] == owner[: len(h) - DEPTH + 1]
                lead = np.searchsorted(owner, np.arange(len(raw)))  # first word of each text
                for salt, keys in enumerate(wide):
                    if ok.any():
                        ok = among(h, ok, keys.value, salt)
                first, n, key, content = window_runs(h, ok, len(wide) > AGAIN, len(wide))
                whose = pa.array(owner[first])
                values = [part.column("doc").take(whose), part.column("k").take(whose), pa.array((first - lead[owner[first]]).astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(key.view(np.int64)), pa.array(content.view(np.int64))]
                yield pa.RecordBatch.from_arrays(values, ["doc", "k", "pos", "n", "key", "content"])

    return texts.mapInArrow(run, RUNS)


def shared(runs: DataFrame) -> DataFrame:
    """The runs whose key several documents have."""
    several = runs.groupBy("key").agg(F.min("doc").alias("low"), F.max("doc").alias("high")).where("low < high").select("key")
    # written, so that the join meets two plain exchanges: Spark can then split a key that a third of all runs have
    return runs.join(written(several, "several"), "key", "left_semi").select("doc", "k", "pos", "n", "key", "content")


def first_runs(runs: DataFrame) -> DataFrame:
    """One row for each (key, content): the least document with it, where it stands there, and how many different runs its key has."""
    first = runs.groupBy("key", "content").agg(F.min(F.struct("doc", "k", "pos", "n")).alias("first"))
    return first.join(first.groupBy("key").agg(F.count(F.lit(1)).alias("different")), "key").select("key", "content", "first.*", "different")


def search_shard(table):
    """(key, content, doc, mask) of a shard's runs: bit j of the mask says that a smaller document has window j."""
    import pyarrow as pa

    docs, texts = table.column("doc").to_pylist(), table.column("words").to_pylist()
    order = sorted(range(len(docs)), key=lambda k: (docs[k], texts[k]))
    numbers: dict[bytes, int] = {}
    sequences = {k: [numbers.setdefault(w, len(numbers)) for w in texts[k].split()] for k in order}
    automaton = SuffixAutomaton()
    for k in order:
        automaton.feed(sequences[k], docs[k])
    masks = []
    for k in range(len(docs)):
        mask = 0
        for end, owner in automaton.first_owners(sequences[k], DEPTH):
            if owner < docs[k]:
                mask |= 1 << end - DEPTH + 1
        masks.append(mask)
    return pa.table([table.column("key"), table.column("content"), table.column("doc"), pa.array(masks, pa.int64())], ["key", "content", "doc", "mask"])


def answers(first: DataFrame, dealt: DataFrame) -> DataFrame:
    """(key, content, doc, mask) for every (key, content) of ``first``."""
    spark = first.sparkSession
    alone = first.where("different = 1").select("key", "content", "doc", F.lit(0).cast("long").alias("mask"))
    alike = first.where("different > 1")
    total = alike.agg(F.sum(F.col("n") + DEPTH - 1)).first()[0] or 0
    places = alike.groupBy("k").agg(F.collect_list(F.struct("doc", "key", "content", "pos", "n")).alias("runs"))

    def cut(batches):
        import pyarrow as pa

        for batch in batches:
            for part in slices(batch):
                out: list[tuple] = []
                for doc, text, runs in zip(part.column("doc").to_pylist(), part.column("text").to_pylist(), part.column("runs").to_pylist()):
                    words = text.split()
                    out += [(r["key"], r["content"], doc, b" ".join(words[r["pos"] : r["pos"] + r["n"] + DEPTH - 1])) for r in runs if r["doc"] == doc]
                columns = list(zip(*out)) if out else [[]] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.binary()))], ["key", "content", "doc", "words"])

    texts = dealt.join(places, "k").mapInArrow(cut, "key long, content long, doc long, words binary")
    # rows that repeat an id and a text cut the same run again
    texts = texts.dropDuplicates(["key", "content"]).withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(1 + total // SHARD_WORDS)))
    found = texts.repartition(max(parallelism(spark), min(1 + total // SHARD_WORDS, 8192)), "shard").groupBy("shard").applyInArrow(search_shard, "key long, content long, doc long, mask long")
    return alone.unionByName(found)


def removed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rewrite: bool = True) -> DataFrame:
    """(row, n_words, n_removed, kept_sha256) of each row; the digest is of the words that stay, joined by one space.

    ``row`` holds the columns of ``docs``, or the id alone without ``rewrite``; a text that loses words is the words that stay.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    columns = docs.columns
    kept = F.struct(*[c for c in columns if c == id_col or rewrite and c != text_col]).alias("_row")
    # k tells texts of one id apart
    dealt = docs.select(F.col(id_col).cast("long").alias("doc"), F.xxhash64(F.col(id_col).cast("long"), F.col(text_col)).alias("k"), F.col(text_col).cast("binary").alias("text"), kept)
    known = dealt.where("doc is not null and length(text) >= 99").select("doc", "k", "text")  # DEPTH words and the gaps between them
    wide, hots, firsts = [], [], []  # a time that windows are dealt: wide keys, runs of shared keys, and the first of each in keys that aren't wide
    while True:
        hots.append(written(shared(written(runs_of(known, wide), "runs")), "shared"))
        first = written(first_runs(hots[-1]), "first")
        most = max(MOST_RUNS, first.count() // WIDE_KEYS)
        keys = np.array([] if len(wide) > AGAIN else [r.key for r in first.where(F.col("different") > most).select("key").distinct().collect()], np.int64).view(np.uint64)
        firsts.append(first.where(F.col("different") <= most) if len(keys) else first)
        if not len(keys):
            break
        wide.append(spark.sparkContext.broadcast(np.sort(keys)))
    hot, first = reduce(DataFrame.unionByName, hots), reduce(DataFrame.unionByName, firsts)
    dealt = dealt.repartition(parallelism(spark), "k")
    known_runs = answers(first, dealt).withColumnRenamed("doc", "least")
    whole = F.expr("shiftleft(1L, n) - 1")
    mask = F.when(F.col("doc") > F.col("least"), whole).otherwise(F.col("mask"))
    gone = hot.join(known_runs, ["key", "content"]).where("doc > least or mask != 0").groupBy("k").agg(F.collect_set(F.struct("doc", "pos", "n", mask.alias("mask"))).alias("gone"))

    def cut_out(batches):
        import pyarrow as pa

        for batch in batches:
            for part in slices(batch):
                n_words, n_removed, digests, texts = [], [], [], []
                for doc, text, runs in zip(part.column("doc").to_pylist(), part.column("text").to_pylist(), part.column("gone").to_pylist()):
                    words = (text or b"").split()
                    n, lost = len(words), 0
                    if runs:
                        away = covered(n, [(r["pos"], r["n"], r["mask"]) for r in runs if r["doc"] == doc])
                        words = [w for w, x in zip(words, away.tolist()) if not x]
                        lost = n - len(words)
                    joined = b" ".join(words)
                    n_words.append(n)
                    n_removed.append(lost)
                    digests.append(hashlib.sha256(joined).hexdigest())
                    texts.append(joined.decode() if lost else None)
                out = [part.column("_row"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digests, pa.string())]
                if rewrite:
                    original = part.column("text")
                    out.append(pa.array([t if lost else None if o is None else o.decode() for t, lost, o in zip(texts, n_removed, original.to_pylist())], pa.string()))
                yield pa.RecordBatch.from_arrays(out, names)

    names = ["row", "n_words", "n_removed", "kept_sha256"] + ["text"] * rewrite
    schema = StructType([StructField(n, t) for n, t in zip(names, [dealt.schema["_row"].dataType, LongType(), LongType(), StringType(), StringType()])])
    found = dealt.join(gone, "k", "left").select("doc", "text", "gone", "_row").mapInArrow(cut_out, schema)
    if not rewrite:
        return found
    whole_row = F.struct(*[F.col("text").alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in columns])
    return found.select(whole_row.alias("row"), *names[1:-1])


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the words that windows of smaller documents cover."""
    return removed(docs, id_col, text_col).select("row.*")


def against(docs: DataFrame, reference: DataFrame, id_col: str = "doc_id", text_col: str = "text", depth: int = DEPTH) -> DataFrame:
    """``docs`` with n_words and spans: (first word, words) of the maximal spans covered by windows that ``reference`` (a column text) holds.

    The reference's automata are broadcast, behind a check of its size: at most MOST_REFERENCE_WORDS words, else an error. A
    larger reference belongs in one table with the documents, at smaller ids.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    total = reference.select(F.sum(F.size(F.split("text", r"[\x20\x09-\x0D]+")))).first()[0] or 0
    if total > MOST_REFERENCE_WORDS:
        raise ValueError(f"the reference has {total} words, more than {MOST_REFERENCE_WORDS}: put it into the table of documents, at smaller ids")
    shards: list[list[list[bytes]]] = [[]]
    held = 0
    for r in reference.where("text is not null").select("text").collect():  # bounded by the check above
        if held > SHARD_WORDS:
            shards.append([])
            held = 0
        shards[-1].append(r["text"].encode().split())
        held += len(shards[-1][-1])
    sent = spark.sparkContext.broadcast(shards)

    def run(batches):
        import pyarrow as pa

        automata = []
        for shard in sent.value:
            automata.append(SuffixAutomaton())
            for sequence in shard:
                automata[-1].feed(sequence, 0)
        for batch in batches:
            for part in slices(batch):
                counts, spans = [], []
                for text in part.column("_text").to_pylist():
                    words = (text or b"").split()
                    away = covered(len(words), [(end - depth + 1, 1, 1) for a in automata for end, _ in a.first_owners(words, depth)], depth)
                    edge = np.flatnonzero(np.diff(np.concatenate([[0], away, [0]])))
                    counts.append(len(words))
                    spans.append([{"first": int(a), "words": int(b - a)} for a, b in zip(edge[::2], edge[1::2])])
                kind = pa.list_(pa.struct([("first", pa.int64()), ("words", pa.int64())]))
                yield pa.RecordBatch.from_arrays([part.column("_row"), pa.array(counts, pa.int64()), pa.array(spans, kind)], ["row", "n_words", "spans"])

    rows = docs.select(F.struct(*docs.columns).alias("_row"), F.col(text_col).cast("binary").alias("_text"))
    row = rows.schema["_row"].dataType.simpleString()
    return rows.mapInArrow(run, f"row {row}, n_words long, spans array<struct<first: long, words: long>>")
