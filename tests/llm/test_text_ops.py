"""Operators on documents against brute force, with odd rows and empty tables."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from nearfield.llm import licenses, mixing, near_dup, packing, quality, sharding, suffix_dedup, token_file
from nearfield.llm.common import new_path, table
from nearfield.llm.queries import QUERIES, vocabulary

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def rows(df):
    return [r.asDict() for r in df.collect()]


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary())


def ids_of(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids


# --- suffix dedup


def brute_suffix(docs):
    """{(doc_id, text): (n_bytes, n_removed, n_spans, sha)} by sets of windows."""
    firsts = {}
    for i, t in docs:
        b = (t or "").encode()
        for p in range(len(b) - 49):
            w = b[p : p + 50]
            if i is not None:
                firsts[w] = min(firsts.get(w, i), i)
    out = []
    for i, t in docs:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - 49):
            if i is not None and firsts[b[p : p + 50]] < i:
                gone[p : p + 50] = b"\1" * 50
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(1 for p in range(len(b)) if gone[p] and (p == 0 or not gone[p - 1]))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return Counter(out)


def test_suffix_dedup_odd_rows(odd_docs):
    docs = [(r.doc_id, r.text) for r in odd_docs.collect()]
    got = suffix_dedup.removed(odd_docs)
    found = Counter((r["row"]["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got.collect())
    assert found == brute_suffix(docs)
    cut = suffix_dedup.dedup(odd_docs)
    assert cut.columns == odd_docs.columns
    others = [c for c in odd_docs.columns if c != "text"]
    assert sorted(map(repr, cut.select(others).collect())) == sorted(map(repr, odd_docs.select(others).collect()))


@pytest.mark.parametrize("mask", [0, 3 << 40, (1 << 64) - 1])
def test_byte_groups_are_equal_windows(monkeypatch, mask):
    """Also with hashes of no bit or two."""
    plain = suffix_dedup.window_hashes
    monkeypatch.setattr(suffix_dedup, "window_hashes", lambda data, length, which=0: plain(data, length, which) & np.uint64(mask))
    rng = np.random.default_rng(4)
    text = bytes(rng.choice([97, 98], 300).astype(np.uint8)) * 3
    data = np.frombuffer(text, np.uint8)
    at = np.flatnonzero(rng.random(len(data) - suffix_dedup.DEPTH + 1) < 0.8)
    live, start = suffix_dedup.byte_groups(data, at)
    want = defaultdict(set)
    for k, p in enumerate(at.tolist()):
        want[text[p : p + suffix_dedup.DEPTH]].add(k)
    ends = [*start.tolist()[1:], len(live)]
    got = [set(live[a:b].tolist()) for a, b in zip(start.tolist(), ends)]
    assert sorted(map(sorted, got)) == sorted(sorted(x) for x in want.values() if len(x) > 1)


def test_suffix_dedup_does_not_trust_hashes(spark, monkeypatch):
    """With hashes of a few bits, which agree for most strings, the answers are the same."""
    plain = suffix_dedup.window_hashes
    monkeypatch.setattr(suffix_dedup.Runs, "content", lambda self, chosen: np.zeros(len(chosen), np.uint64))
    monkeypatch.setattr(suffix_dedup, "window_hashes", lambda data, length, which=0: plain(data, length, which) & np.uint64(3 << 40))
    rng = np.random.default_rng(8)
    words = [f"w{i}" for i in range(40)]
    texts = [" ".join(rng.choice(words, 60)) for _ in range(6)]
    texts += [texts[0][:150] + texts[1][40:], texts[2], texts[3][30:120]]
    raw = [t.encode() for t in texts]
    runs, ids = suffix_dedup.Runs(raw), np.arange(len(raw))
    chosen = np.arange(len(runs.first))
    distinct, index = suffix_dedup.unique_contents(runs, chosen, runs.keys(4), ids)
    for k in chosen.tolist():
        a, b = runs.first[k], runs.last[k] + suffix_dedup.DEPTH
        c = distinct[index[k]]
        assert runs.data[a:b].tobytes() == runs.data[runs.first[c] : runs.last[c] + suffix_dedup.DEPTH].tobytes()


def test_suffix_dedup_many_blocks(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "BLOCK_BYTES", 20_000)
    monkeypatch.setattr(suffix_dedup, "BUCKET_BYTES", 20_000)
    docs = table(spark, sf_dir, "documents")
    found = Counter(tuple(r) for r in QUERIES["op7_suffix_dedup"](spark, sf_dir).collect())
    assert found == brute_suffix([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])


def test_suffix_runs_across_slices():
    """Windows of a text longer than a slice are found alike wherever the slice ends."""
    rng = np.random.default_rng(3)
    text = bytes(rng.integers(97, 123, suffix_dedup.SLICE + 5000, dtype=np.uint8))
    a, b = suffix_dedup.Runs([text]), suffix_dedup.Runs([b"x" * 777, text])
    assert set(a.digit.tolist()) <= set(b.digit.tolist())
    assert (a.last - a.first + 1).sum() == len(text) - 49


# --- near duplicates


def brute_components(docs):
    """{(id, text): (size, first (id, text) of the component)}."""

    def shingles(t):
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())

    sets = {(i, t): shingles(t) for i, t in docs if i is not None}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets, key=lambda x: (x[0], x[1] or ""))
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)), key=ids.index)
                parent[y] = x
    return {x: (len(sets[x]), root(x)) for x in ids}


def brute_near(docs):
    """{id: (size, component)}, for ids that come once."""
    return {i: (n, c) for (i, _), (n, (c, _)) in brute_components(docs).items()}


def test_near_dup_odd_rows(odd_docs):
    docs = [(r.doc_id, r.text) for r in odd_docs.collect()]
    parts = brute_components(docs)
    want = Counter((i, *((parts[i, t][0], parts[i, t][1][0], i == parts[i, t][1][0]) if i is not None else (None, None, True))) for i, t in docs)
    got = rows(near_dup.linked(odd_docs))
    assert Counter((r["id"], *((r["n_shingles"], r["component_id"], r["kept"]) if r["id"] is not None else (None, r["component_id"], r["kept"]))) for r in got) == want
    kept = near_dup.keep_one(odd_docs)
    assert kept.columns == odd_docs.columns
    # a row of each component; rows without words or id stay
    found = [(r["doc_id"], r["text"]) for r in rows(kept)]
    one = [parts[x][1] for x in found if x[0] is not None and parts[x][0]]
    assert len(one) == len(set(one)) and set(one) == {c for n, c in parts.values() if n}
    assert all(x[0] == parts[x][1][0] for x in found if x[0] is not None and parts[x][0])
    rest = lambda pairs: Counter(x for x in pairs if x[0] is None or not parts[x][0])
    assert rest(found) == rest(docs)


def test_near_dup_family_of_edits(spark):
    """A large family of near copies with few and many edits, as buckets that don't fall to one component."""
    rng = np.random.default_rng(5)
    base = [f"word{i}" for i in range(150)]
    docs = []
    for i in range(150):
        own = list(base)
        for at in rng.choice(150, int(rng.integers(0, 9)), replace=False):
            own[at] = f"edit{i}at{at}"
        docs.append((i, " ".join(own)))
    want = brute_near(docs)
    got = rows(near_dup.linked(spark.createDataFrame(docs, "doc_id long, text string")))
    assert {r["id"]: (r["n_shingles"], r["component_id"]) for r in got} == want
    assert 1 < len({c for _, c in want.values()}) < 150


# --- packing and token files


def test_packing_odd_rows(odd_docs, tokenizer):
    docs = [(r.doc_id, r.text) for r in odd_docs.collect()]
    want = Counter()
    for i, t in docs:
        ids = np.array(ids_of(tokenizer, t) + [0], "<u4")
        for k, at in enumerate(range(0, len(ids), 64)):
            part = ids[at : at + 64]
            want[(i, k, at, len(part), zlib.crc32(part.tobytes()))] += 1
    got = rows(packing.pack(odd_docs, vocabulary(), capacity=64))
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    by = defaultdict(list)
    for r in got:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 64
    assert {(r["n_sequences"], r["least_sequences"]) for r in got} == {(len(by), len(by))}


def fewest_bins(sizes, capacity):
    """The optimum over all subsets of the sizes: (bins, what the last one holds) of each."""
    best = [(0, capacity)] + [(len(sizes) + 1, 0)] * ((1 << len(sizes)) - 1)
    for m, (bins, last) in enumerate(best):
        for i, size in enumerate(sizes):
            if not m >> i & 1:
                best[m | 1 << i] = min(best[m | 1 << i], (bins, last + size) if last + size <= capacity else (bins + 1, size))
    return best[-1][0]


def held_by(plan, capacity):
    held = Counter()
    for pattern, n in plan:
        assert sum(pattern) <= capacity
        for s in pattern:
            held[s] += n
    return held


def test_bin_completion_reaches_the_optimum():
    """Instances of up to 14 pieces against the best over all subsets."""
    rng = np.random.default_rng(0)
    cases = [([64, 90, 177, 282, 283, 287, 290, 291, 410, 643, 687, 771, 854, 990], 2048), ([500] * 8, 2048), ([2048, 1, 2047], 2048)]
    for k in range(500):
        n = 14 if k % 100 == 0 else int(rng.integers(5, 11))
        capacity = int(rng.choice([24, 100, 2048]))
        cases.append((rng.integers(max(1, capacity // int(rng.choice([4, 8, 30]))), capacity * 6 // 10, n).tolist(), capacity))
    for sizes, capacity in cases:
        counts = np.bincount(sizes, minlength=capacity + 1)
        plan, bound = packing.bin_completion(counts, capacity, nodes=10**9)
        assert held_by(plan, capacity) == Counter(sizes)
        assert sum(n for _, n in plan) == bound == fewest_bins(sizes, capacity)
        assert packing.lower_bound(counts, capacity) <= bound <= sum(n for _, n in packing.best_fit(counts, capacity))


def test_fillings_are_the_undominated_ones():
    """Against all multisets: one is dominated where another comes from it by putting one item in the place of several, or of a smaller one."""
    rng = np.random.default_rng(1)
    for _ in range(40):
        room, sizes = 30, Counter(rng.integers(3, 16, 6).tolist())
        counts = [sizes[s] for s in range(room + 1)]
        every = {()}
        for s in sorted(sizes.elements(), reverse=True):
            every |= {f + (s,) for f in every if sum(f) + s <= room}
        every = {tuple(sorted(f, reverse=True)) for f in every}

        def beaten(f):
            for m in range(1 << len(f)):
                part = [s for k, s in enumerate(f) if m >> k & 1]
                for x in sizes:
                    fits = sum(f) - sum(part) + x <= room and counts[x] > f.count(x)
                    if fits and (x > sum(part) or x == sum(part) and len(part) > 1):
                        return True
            return False

        got = [f for f in packing.fillings(counts, room) if f is not None]
        assert sorted(got) == sorted(f for f in every if not beaten(f))
        assert [sum(f) for f in got] == sorted(map(sum, got), reverse=True)


def test_packing_stops_within_its_budget():
    """Best fit decreasing isn't optimal here, and the search may end before it is: the plan is whole and the bound holds."""
    rng = np.random.default_rng(3)
    counts = np.bincount(rng.choice(rng.integers(100, 1200, 7), 500), minlength=2049)
    plan, bound = packing.bin_completion(counts, 2048, nodes=50)
    assert held_by(plan, 2048) == Counter({s: n for s, n in enumerate(counts.tolist()) if n})
    assert packing.lower_bound(counts, 2048) <= bound <= sum(n for _, n in plan) <= sum(n for _, n in packing.best_fit(counts, 2048))


def test_token_file_round_trip(spark, odd_docs, tokenizer, monkeypatch):
    monkeypatch.setattr(token_file, "SEGMENT_TOKENS", 5000)
    monkeypatch.setattr(token_file, "BLOCK_TOKENS", 4096)
    path = new_path(spark, "tokens")
    token_file.write_tokens(odd_docs, path, vocabulary())
    got = sorted(rows(token_file.read_tokens(spark, path, keep_ids=True)), key=lambda r: r["start"])
    start, want = 0, Counter()
    for r in odd_docs.collect():
        want[r.doc_id, np.array(ids_of(tokenizer, r.text) + [1], "<u4").tobytes()] += 1
    for r in got:
        assert (r["start"], 4 * r["n_tokens"], r["ids_crc32"]) == (start, len(r["ids"]), zlib.crc32(r["ids"]))
        start += r["n_tokens"]
    assert Counter((r["doc_id"], bytes(r["ids"])) for r in got) == want
    order = [r["doc_id"] for r in got]
    assert order == sorted(order, key=lambda i: (i is None, i or 0)) and None in order
    again = new_path(spark, "tokens")
    token_file.write_tokens(odd_docs.repartition(7), again, vocabulary())
    assert sorted(map(repr, rows(token_file.read_tokens(spark, again)))) == sorted(repr({k: v for k, v in r.items() if k != "ids"}) for r in got)


def test_entropy_code_is_near_the_entropy_and_detects_damage():
    rng = np.random.default_rng(1)
    ids = np.minimum(rng.zipf(1.3, 300_000), 49_000).astype(np.uint32)
    symbols, freqs, blocks = token_file.encode_segment(ids)
    assert (token_file.decode_segment(symbols, freqs, blocks) == ids).all()
    p = np.bincount(ids) / len(ids)
    entropy = -(p[p > 0] * np.log2(p[p > 0])).sum() / 8 * len(ids)
    assert sum(len(b["words"]) for b in blocks) < 1.03 * entropy + 1000
    blocks[0] = blocks[0] | {"words": b"\0" + blocks[0]["words"][1:]}
    with pytest.raises(ValueError):
        token_file.decode_segment(symbols, freqs, blocks)


def test_words_are_encoded_as_in_whole_texts(tokenizer):
    from nearfield.llm.tokens import encoder

    odd = ["İstanbul ΑΣ. Σ, á, x y é,. don't can't. <|endoftext|>q <|ENDOFTEXT|> 'S A,B.C 1.5, …, ẞ.", "", "  \n", "\x00a b", "a.b., c..", "½ ２ ﬁ", "it's we're I'll x's,", "éa, ö."]
    got = encoder(vocabulary()).encode([t.encode() for t in odd] + [None])
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [ids_of(tokenizer, t) for t in odd] + [[]]


# --- sharding, mixing, quality, licences


def test_sharding(spark, odd_docs, sf_dir):
    for docs in (odd_docs, table(spark, sf_dir, "documents")):
        got = rows(sharding.shard_by_bytes(docs))
        texts = Counter((r.doc_id, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in docs.collect())
        assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == texts
        slots, of = defaultdict(list), defaultdict(set)
        for r in got:
            slots[r["shard"]].append(r["slot"])
            of[(r["size"], r["text_crc32"])].add(r["shard"])
        assert set(slots) <= set(range(8)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
        assert all(len(s) == 1 for s in of.values())
    sizes = Counter()
    for r in got:
        sizes[r["shard"]] += r["size"]
    groups = Counter()
    for r in got:
        groups[(r["size"], r["text_crc32"])] += r["size"]
    assert max(sizes.values()) <= max(1.02 * sum(sizes.values()) / 8, max(groups.values()))


def plain_best_fit(sizes, capacity):
    """Item by item, over a list of rooms: the rooms left."""
    rooms = []
    for size in sorted(sizes, reverse=True):
        fits = [(r, j) for j, r in enumerate(rooms) if r >= size]
        j = min(fits)[1] if fits else len(rooms)
        rooms += [max(capacity, size)] * (not fits)
        rooms[j] -= size
    return sorted(rooms)


def test_best_fit_decreasing_takes_the_tightest_bin():
    rng = np.random.default_rng(0)
    for capacity in (100, 250, 3000):
        for _ in range(20):
            sizes = rng.integers(1, rng.integers(2, 130), int(rng.integers(1, 400))).tolist()
            counts, rooms, held = Counter(sizes), {}, Counter()
            for size, first, n, number in sharding.best_fit_decreasing(counts, capacity):
                assert first == held[size]
                held[size] += n
                rooms[number] = rooms.get(number, max(capacity, size)) - n * size
            assert held == counts and sorted(rooms.values()) == plain_best_fit(sizes, capacity)
            runs = sharding.shards_for(counts, 8)
            loads = Counter()
            for size, _, n, number in runs:
                loads[number] += size * n
            assert len(loads) <= 8 and sum(loads.values()) == sum(sizes)
            # no lower capacity that plain best fit meets within an eighth
            assert max(loads.values()) <= max(-(-sum(sizes) // 8), max(sizes)) + max(sizes)


def test_sizes_are_rounded_up_to_their_leading_bits(spark):
    sizes = [1, 65_535, 65_536, 65_537, 131_072, 131_073, (1 << 45) - 1, (1 << 45) + 1]
    df = spark.createDataFrame([(x,) for x in sizes], "size long")
    for x, up in df.select("size", sharding.rounded_up(df["size"])).collect():
        unit = 1 << max(0, x.bit_length() - sharding.SIZE_BITS)
        assert up == -(-x // unit) * unit


def test_sharding_by_capacity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    total = sum(len((r.text or "").encode()) + 1 for r in docs.collect())
    sizes = Counter()
    for r in rows(sharding.shard_by_capacity(docs, 60_000)):
        sizes[r["shard"]] += r["size"]
    assert max(sizes.values()) <= 60_000 and sum(sizes.values()) == total
    assert len(sizes) <= -(-total // 60_000) + 1


def water(sizes, weights=(3, 1, 2), share=1.5, most=2.0):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    w = {s: weights[k % 3] for k, s in enumerate(names)}
    left, free, target = share * sum(sizes.values()), set(names), {}
    while True:
        level = left / sum(w[s] for s in free) if free else 0
        over = [s for s in free if level * w[s] > most * sizes[s]]
        if not over:
            return target | {s: level * w[s] for s in free}
        for s in over:
            target[s] = most * sizes[s]
            left -= target[s]
            free.discard(s)


def test_mixing(odd_docs):
    got = rows(mixing.copies(odd_docs))
    sizes = Counter()
    for r in got:
        assert r["size"] == len(WORD.findall(r["row"]["text"] or ""))
        sizes[r["row"]["source"]] += r["size"]
    want = water(sizes)
    for r in got:
        assert r["source_size"] == sizes[r["row"]["source"]]
        assert r["target"] == pytest.approx(want[r["row"]["source"]])
        rate = r["target"] / r["source_size"] if r["source_size"] else 0
        assert int(rate) <= r["copies"] <= int(rate) + 1 and r["copies"] <= 2
    mixed = mixing.mix(odd_docs)
    assert mixed.columns == odd_docs.columns
    assert mixed.count() == sum(r["copies"] for r in got)
    assert Counter(map(repr, mixed.collect())) == Counter(map(repr, mixing.mix(odd_docs.repartition(5)).collect()))
    for r in got:
        assert sum(repr(r["row"]) == repr(m) for m in mixed.collect()) % max(1, r["copies"]) == 0


def test_mixing_is_near_its_targets(spark):
    docs = spark.createDataFrame([(i, "w " * (1 + i % 7), ["a", "b", "c"][i % 3]) for i in range(9000)], "doc_id long, text string, source string")
    taken, target = Counter(), {}
    for r in rows(mixing.copies(docs)):
        taken[r["row"]["source"]] += r["size"] * r["copies"]
        target[r["row"]["source"]] = r["target"]
    assert all(abs(taken[s] - target[s]) < 0.03 * target[s] for s in target)


def brute_quality(text):
    w = WORD.findall(text or "")
    windows = Counter(zip(w, w[1:], w[2:]))
    covered = {k + j for k in range(len(w) - 2) if windows[tuple(w[k : k + 3])] > 1 for j in range(3)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_quality(odd_docs):
    docs = Counter((r.doc_id, *brute_quality(r.text)) for r in odd_docs.collect())
    got = rows(quality.assess(odd_docs))
    assert Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in got) == docs
    for r in got:
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
        assert not (r["base_failed"] and r["kept"])
    kept = quality.keep_good(odd_docs)
    assert kept.columns == odd_docs.columns
    assert Counter(r["doc_id"] for r in rows(kept)) == Counter(r["doc_id"] for r in got if r["kept"])


def test_repeated_words_with_colliding_hashes(spark):
    """Hashes of two bits agree for unlike windows; the count is that of the words."""
    rng = np.random.default_rng(9)
    texts = [" ".join(rng.choice(["a", "b", "c", "d", "e", "f"], int(n))) for n in (3, 4, 9, 30, 80, 200)] + ["a b c a b c", " ".join(f"w{i}" for i in range(50))]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    for bits in (2, 64):
        got = df.select("text", quality.repeated_words(quality.words_of(df["text"]), bits).alias("n")).collect()
        assert [r.n for r in got] == [brute_quality(r.text)[4] for r in got]


def test_quality_limits_follow_the_source(spark):
    """Symbols that a source has everywhere are its habit; the same share elsewhere is rejected."""
    plain = " ".join(f"word{i}" for i in range(80))
    symbols = " ".join(f"word{i}#" for i in range(80))
    docs = [(i, symbols if i % 2 else plain, "en", "odd" if i % 2 else "plain") for i in range(400)] + [(1000, symbols, "en", "plain")]
    got = {r["doc_id"]: r["kept"] for r in rows(quality.assess(spark.createDataFrame(docs, "doc_id long, text string, lang string, source string")))}
    assert not got.pop(1000) and all(got.values())


def brute_base(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    hits = [(k, label) for phrase, label in licenses.PHRASES.items() for k in range(len(w)) if w[k : k + len(phrase.split())] == phrase.split()]
    at = [k for k, _ in hits]
    return len(w), len(hits), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in hits}))


def test_licenses(spark, odd_docs):
    more = spark.createDataFrame([(50, licenses.TEMPLATES["mit"].replace("charge to", "charge and to").upper()), (51, "mit mit license license general general public license")], "doc_id long, text string")
    for docs in (odd_docs, more):
        got = rows(licenses.labelled(docs))
        assert Counter((r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in got) == Counter((r.doc_id, *brute_base(r.text)) for r in docs.collect())
        assert all(set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1 for r in got)
    by = {r["doc_id"]: r for r in got}
    assert by[50]["labels"] == "mit" and by[50]["base_labels"] == "" and by[50]["score"] < 1


def brute_labels(text):
    """Labels and score from every gram's diagonal, template by template."""
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    listed = [(t, label, 2, True) for t, label in licenses.PHRASES.items()] + [(t, label, 2, False) for label, t in licenses.TEMPLATES.items()]
    listed += [(t, label, licenses.LONG_GRAM, False) for label, t in licenses.WHOLE.items()]
    labels, best = set(), 0.0
    for t, label, k, phrase in listed:
        t = t.split()
        n = len(t) - k + 1
        at = defaultdict(list)
        for p in range(n):
            at[tuple(t[p : p + k])].append(p)
        votes = defaultdict(set)
        for p in range(len(w) - k + 1):
            for place in at.get(tuple(w[p : p + k]), ()):
                votes[p - place].add(place)
        shift = 0 if phrase else min(licenses.MAX_SHIFT, 2 + n // 16)
        for d in votes:
            score = len(set().union(*(votes[x] for x in range(d, d + shift + 1) if x in votes))) / n
            if score == 1 if phrase else score >= licenses.LEAST_SCORE:
                labels.add(label)
                best = max(best, score)
    return ",".join(sorted(labels)), best


def test_license_spans(spark):
    """Whole texts, edited and embedded, and grams of a template strewn over a text, which make no span."""
    gpl = licenses.TEMPLATES["gpl"].split()
    strewn = " ".join(f"{a} {b} x{k}" for k, (a, b) in enumerate(zip(gpl, gpl[1:])))
    filler = " ".join(f"filler{k}" for k in range(40))
    whole = [f"{filler} {t} {filler}" for t in licenses.WHOLE.values()]
    edited = [" ".join(x for k, x in enumerate(t.split()) if k % 45 != 20) for t in licenses.WHOLE.values()]
    cut = [" ".join(t.split()[: len(t.split()) // 2]) for t in licenses.WHOLE.values()]
    texts = [strewn, *whole, *edited, *cut, *[" ".join(f"{x} new{k}" if k % 40 == 7 else x for k, x in enumerate(t.split())) for t in licenses.WHOLE.values()]]
    got = {r["doc_id"]: r for r in rows(licenses.labelled(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")))}
    for i, t in enumerate(texts):
        labels, score = brute_labels(t)
        assert got[i]["labels"] == labels and got[i]["score"] == pytest.approx(score), t
    assert got[0]["labels"] == "" and all(set(label.split(",")) <= set(got[k + 1]["labels"].split(",")) for k, label in enumerate(licenses.WHOLE))


def test_empty_tables(spark, no_docs):
    assert suffix_dedup.dedup(no_docs).count() == 0
    assert near_dup.linked(no_docs).count() == 0 and near_dup.keep_one(no_docs).count() == 0
    assert packing.pack(no_docs, vocabulary()).count() == 0
    path = new_path(spark, "tokens")
    token_file.write_tokens(no_docs, path, vocabulary())
    assert token_file.read_tokens(spark, path).count() == 0
    assert sharding.shard_by_bytes(no_docs).count() == 0
    assert mixing.mix(no_docs).count() == 0
    assert quality.assess(no_docs).count() == 0 and quality.keep_good(no_docs).count() == 0
    assert licenses.labelled(no_docs).count() == 0


def test_targets_equal_the_iterative_rule(spark):
    """Capping and resharing again and again, for many sources of very uneven size."""
    rng = np.random.default_rng(11)
    for round_ in range(4):
        sizes = {f"s{k}" if k else None: int(x) for k, x in enumerate((10 ** rng.uniform(0, 5, 25)).astype(int))}
        sizes["none"] = 0
        df = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size long")
        want = water(sizes)
        for r in mixing.source_targets(df).collect():
            assert r.target == pytest.approx(want[r.source], rel=1e-9, abs=1e-6)


def test_near_dup_cells_with_small_blocks(spark, monkeypatch):
    """Families cut into many blocks, and matrices into many chunks, give the same components."""
    monkeypatch.setattr(near_dup, "BLOCK_NODES", 7)
    monkeypatch.setattr(near_dup, "CHUNK", 16)
    rng = np.random.default_rng(6)
    docs = []
    for i in range(60):
        own = [f"word{j}" for j in range(90)]
        for at in rng.choice(90, int(rng.integers(0, 8)), replace=False):
            own[at] = f"edit{i % 9}at{at}"
        docs.append((i, " ".join(own)))
    got = {r["id"]: (r["n_shingles"], r["component_id"]) for r in rows(near_dup.linked(spark.createDataFrame(docs, "doc_id long, text string")))}
    assert got == brute_near(docs)


def test_components_of_hubs_and_paths(spark):
    """A hub at the least, the greatest and a middle node, a path, a ring, loops, repeats and null ends, against a search."""
    from nearfield.llm import components as C

    rng = random.Random(3)
    edges = [(0, k) for k in range(1, 400)] + [(2_000, k) for k in range(1_000, 1_400)] + [(3_200, k) for k in range(3_000, 3_400)]
    edges += [(k, k + 1) for k in range(5_000, 5_040)] + [(6_000 + k, 6_000 + (k + 1) % 9) for k in range(9)]
    edges += [(rng.randrange(7_000, 7_300), rng.randrange(7_000, 7_300)) for _ in range(200)] + [(9_000, 9_000), (-5, 8_000), (-5, 8_000), (8_000, -5)]
    near = {}
    for a, b in edges:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    expected = {}
    for node in sorted(near):
        if node not in expected:
            todo = [node]
            while todo:
                at = todo.pop()
                if at not in expected:
                    expected[at] = node
                    todo += near[at]
    table = spark.createDataFrame([*edges, (None, 4), (4, None)], "a long, b long")
    assert sorted(map(tuple, C.components(table).collect())) == sorted(expected.items())
    assert C.components(table.limit(0)).count() == 0
    # a hub's edges come back with their least, and are joined over many cells
    least = C._with_least(table.where("a is not null and b is not null"), 64)
    assert {r.m for r in least.where("a = 2000").collect()} == {1_000} and least.count() == len(edges)
    assert least.where("a = 2000").select(F.pmod(F.xxhash64("b"), F.lit(64))).distinct().count() > 32
