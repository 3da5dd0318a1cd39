"""Vector codes, conversation tries and word windows against brute force, with odd rows and empty tables."""

import hashlib
import itertools
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from nearfield.llm import automaton_dedup, conversation_trie, vector_codes

# --- vector codes


def brute_codes(rows, parts=4, entries=256, rounds=4):
    """[(id, code, error, label_error, digest)] of (id, vector, label), by full scans in Python integers."""
    kept = [(i, [math.floor(1024 * float(x)) for x in v], lab) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = len(kept[0][1]) // parts
    cut = [[v[p * width : (p + 1) * width] for p in range(parts)] for _, v, _ in kept]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    nearest = lambda x, book: min(range(len(book)), key=lambda e: (far(x, book[e]), e))
    for _ in range(rounds):
        for p in range(parts):
            at = [nearest(c[p], books[p]) for c in cut]
            for e in range(len(books[p])):
                own = [c[p] for c, k in zip(cut, at) if k == e]
                if own:
                    books[p][e] = [sum(col) // len(own) for col in zip(*own)]
    codes = [[nearest(c[p], books[p]) for p in range(parts)] for c in cut]
    errors = [sum(far(c[p], books[p][k[p]]) for p in range(parts)) for c, k in zip(cut, codes)]
    labels = Counter()
    for (_, _, lab), e in zip(kept, errors):
        labels[lab] += e
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return Counter((i, "".join(f"{k:02x}" for k in code), e, labels[lab], digest) for (i, _, lab), code, e in zip(kept, codes, errors))


def got_codes(df):
    return Counter((r["id"], r["code"], r["error"], r["label_error"], r["codebooks_sha256"]) for r in vector_codes.coded(df).collect())


def test_codes_of_odd_rows(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=8)], i % 3 if i % 7 else None) for i in range(330)]
    same = rows[0][1]
    rows += [(1000 + i, same, 1) for i in range(200)]  # one vector many times: ties between equal first entries
    rows += [(5, None, 1), (6, [1.0, None] * 4, 1), (7, [math.nan] * 8, 1), (8, [math.inf] * 8, 1), (None, rows[3][1], 2), (9, rows[9][1], 0), (9, [0.0] * 8, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    assert got_codes(df) == brute_codes(rows)
    clash = df.selectExpr("*", "1 AS id", "2 AS code", "'x' AS ints", "3 AS sums")
    assert got_codes(clash.repartition(7)) == brute_codes(rows)


@pytest.mark.parametrize("scale", [0.002, 1.0, 100_000.0])
def test_codes_at_every_scale(spark, scale):
    """Coarse integers have many ties; large ones don't fit exactly into a product of doubles."""
    rng = np.random.default_rng(2)
    rows = [(i, [float(np.float32(x)) for x in rng.uniform(-scale, scale, 8)], 0) for i in range(400)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    assert got_codes(df) == brute_codes(rows)


def test_codes_of_few_or_odd_lengths(spark):
    rows = [(3, [1.0] * 8, None), (4, [2.0] * 8, None)]
    odd = [(1, [], None), (2, [1.0] * 7, None), (5, [1.0] * 4, None), (6, [2.0e6] * 8, None)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, label string")
    assert got_codes(df) == brute_codes(rows)
    empty = df.where("vec_id < 0")
    assert vector_codes.coded(empty).collect() == []
    assert set(vector_codes.coded(empty).columns) == set(vector_codes.coded(df).columns)


def test_bounds_skip_and_agree_with_scans():
    rng = np.random.default_rng(3)
    centres = rng.integers(-900, 900, (8, 4))
    x = centres[rng.integers(0, 8, 3000)] + rng.integers(-20, 20, (3000, 4))
    entries = x[:16].copy()
    code, upper, lower = vector_codes.scan(x, entries)
    scanned = 0
    for _ in range(5):
        moved = np.array([x[code == e].sum(0) // max(1, (code == e).sum()) if (code == e).any() else entries[e] for e in range(16)])
        drift = vector_codes.drifts([entries], [moved])[0]
        entries = moved
        code, upper, lower, full = vector_codes.reassign(x, entries, drift, code, upper, lower)
        scanned += full
        assert (code == vector_codes.scan(x, entries)[0]).all()
    assert scanned < 0.7 * 5 * 3000


def test_restored_vectors_are_the_entries(spark):
    rows = [(i, [float(i), 1.0, 2.0, -float(i)], 0) for i in range(20)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    _, books, _ = vector_codes.train(df)
    found = {r["id"]: r["vec"] for r in vector_codes.restored(vector_codes.coded(df), books).collect()}
    assert found == {i: v for i, v, _ in rows}  # fewer rows than entries: every vector is an entry
    assert vector_codes.codebooks(spark, books).count() == 80


# --- conversation tries


def brute_trie(rebuilt):
    """Counter of node rows of {conv_id: [(role, text)]}."""
    members = defaultdict(list)
    for c, turns in sorted(rebuilt.items()):
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = defaultdict(set)
    for seq in members:
        if seq:
            children[seq[:-1]].add(seq)
    out = Counter()
    for seq, convs in members.items():
        leaves = saved = 0
        stack = [seq]
        while stack:
            x = stack.pop()
            leaves += not children[x]
            saved += (len(members[x]) - 1) * (len(x[-1][1].encode()) if x else 0)
            stack += children[x]
        ends = ",".join(str(c) for c in convs if len(rebuilt[c]) == len(seq))
        out[(convs[0], len(seq), members[seq[:-1]][0] if seq else None, len(convs), len(children[seq]), leaves, saved, hashlib.sha256(ends.encode()).hexdigest())] += 1
    return out


def brute_rebuilt(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [(r, t) for _, _, r, t in sorted(v)] for c, v in own.items()}
    out = {}
    for c, v in turns.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = turns.get(c - c % 5, [])[:h] + v[h:]
    return out


def got_trie(nodes):
    return Counter(tuple(r[c] for c in conversation_trie.COLUMNS) for r in nodes.collect())


CONVERSATIONS = "conv_id long, turn long, role string, text string"


def odd_conversations():
    rng = random.Random(4)
    rows = []
    for c in range(60):
        for turn in range(rng.randrange(1, 14)):
            rows.append((c, turn, "user" if turn % 2 == 0 else "assistant", rng.choice(["hello", "good day", "é" * 40, None, ""])))
    rows += [(c, turn, "user", "a common turn") for c in range(100, 160) for turn in range(9)]
    rows += [(c, turn, "user", "a common turn" if turn < 6 else f"{c}") for c in range(200, 240) for turn in range(9)]
    rows += [(300, None, None, None), (300, 2, "user", "x"), (300, 1, "user", ""), (None, 1, "user", "nobody's"), (302, 0, None, "alone")]
    return rows


@pytest.mark.parametrize("most", [1, 40, 1 << 16])
def test_trie_of_odd_conversations(spark, most):
    rows = odd_conversations()
    df = spark.createDataFrame([(*r, "grp", 1) for r in rows], CONVERSATIONS + ", grp string, least int")
    spliced = conversation_trie.spliced(conversation_trie.turns_of(df))
    assert got_trie(conversation_trie.trie(spliced, most_turns=most, bucket_turns=100)) == brute_trie(brute_rebuilt(rows))


def test_trie_of_conversations_as_they_are(spark):
    """Without rebuilding; a long common prefix is one chain, taken in one round."""
    rows = [(c, turn, "user", "same" if turn < 30 else f"{c % 4} {turn}") for c in range(12) for turn in range(36)] + [(50, turn, "user", "same") for turn in range(30)]
    df = spark.createDataFrame(rows, CONVERSATIONS)
    turns = defaultdict(list)
    for c, _, role, text in rows:
        turns[c].append((role, text))
    assert got_trie(conversation_trie.trie(conversation_trie.turns_of(df), most_turns=10)) == brute_trie(turns)


def test_trie_of_nothing(spark):
    none = conversation_trie.turns_of(spark.createDataFrame([], CONVERSATIONS))
    nodes = conversation_trie.trie(conversation_trie.spliced(none))
    assert nodes.columns == conversation_trie.COLUMNS and nodes.collect() == []
    bare = spark.createDataFrame([(7, []), (9, [])], "conv_id long, turns array<struct<turn: long, digest: binary, size: long>>")
    assert got_trie(conversation_trie.trie(bare)) == brute_trie({7: [], 9: []})


# --- word windows


def brute_windows(docs, depth=50):
    firsts = {}
    for i, t in docs:
        w = (t or "").encode().split()
        if i is not None:
            for p in range(len(w) - depth + 1):
                key = tuple(w[p : p + depth])
                firsts[key] = min(firsts.get(key, i), i)
    out = Counter()
    for i, t in docs:
        w = (t or "").encode().split()
        gone = [False] * len(w)
        for p in range(len(w) - depth + 1):
            if i is not None and firsts[tuple(w[p : p + depth])] < i:
                gone[p : p + depth] = [True] * depth
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out[(i, len(w), sum(gone), hashlib.sha256(kept).hexdigest())] += 1
    return out


def got_windows(df):
    return Counter((r["row"]["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in automaton_dedup.removed(df).collect())


def test_windows_of_odd_rows(odd_docs, no_docs):
    docs = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    assert got_windows(odd_docs) == brute_windows(docs)
    cut = automaton_dedup.dedup(odd_docs)
    assert cut.columns == odd_docs.columns and cut.count() == len(docs)
    assert automaton_dedup.dedup(no_docs).collect() == [] and automaton_dedup.removed(no_docs, rewrite=False).collect() == []


def passages(seed):
    """Documents of few words in which passages of 30 to 120 words come again, in other surroundings, cut short and joined."""
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(40)] + ["ab", "é", " x"]
    known = [[rng.choice(words) for _ in range(rng.randrange(30, 120))] for _ in range(6)]
    docs = []
    for i in range(80):
        text = []
        for _ in range(rng.randrange(1, 5)):
            p = rng.choice(known)
            a = rng.randrange(0, 20)
            text += [rng.choice(words) for _ in range(rng.randrange(0, 40))] + p[a : len(p) - rng.randrange(0, 20)]
        docs.append((rng.randrange(60), rng.choice([" ", "\n", " \t "]).join(text)))
    return docs


@pytest.mark.parametrize("most", [1, 4, 1024])
def test_windows_of_passages(spark, monkeypatch, most):
    """Also where keys have many surroundings, so that their runs are cut into windows."""
    monkeypatch.setattr(automaton_dedup, "MOST_RUNS", most)
    monkeypatch.setattr(automaton_dedup, "SHARD_WORDS", 500)
    docs = passages(5)
    df = spark.createDataFrame([(*d, None, None, None) for d in docs], "doc_id long, text string, lang string, source string, n_chars long")
    assert got_windows(df) == brute_windows(docs)


def test_windows_over_pieces_and_slices(monkeypatch):
    rng = random.Random(6)
    text = " ".join(rng.choice("abcdefgh") * rng.randrange(1, 9) for _ in range(4000)).encode()
    whole = np.frombuffer(text, np.uint8)
    start, h = automaton_dedup.word_hashes(whole)
    assert [text[s:].split()[0] for s in start[:50].tolist()] == text.split()[:50]
    monkeypatch.setattr(automaton_dedup, "SLICE", 64)
    assert (automaton_dedup.word_hashes(whole)[1] == h).all()
    ok = np.zeros(len(h), bool)
    ok[: len(h) - 49] = True
    for size in (1 << 18, 700):
        monkeypatch.setattr(automaton_dedup, "PIECE", size)
        first, n, _, _ = automaton_dedup.window_runs(h, ok)
        assert sorted(itertools.chain.from_iterable(range(a, a + k) for a, k in zip(first.tolist(), n.tolist()))) == list(range(len(h) - 49))
        assert n.max() <= 41


def test_automaton_knows_every_string_and_its_first_owner():
    rng = random.Random(7)
    texts = [[rng.choice("abc") for _ in range(rng.randrange(1, 30))] for _ in range(12)]
    automaton = automaton_dedup.SuffixAutomaton()
    for owner, t in enumerate(texts):
        automaton.feed(t, owner)
    for depth in (1, 3, 5):
        for t in [*texts, [rng.choice("abcd") for _ in range(60)]]:
            want = {}
            for end in range(depth - 1, len(t)):
                s = t[end - depth + 1 : end + 1]
                owners = [o for o, x in enumerate(texts) if any(x[k : k + depth] == s for k in range(len(x) - depth + 1))]
                if owners:
                    want[end] = owners[0]
            assert dict(automaton.first_owners(t, depth)) == want


def test_spans_against_a_broadcast_reference(spark, monkeypatch):
    monkeypatch.setattr(automaton_dedup, "SHARD_WORDS", 100)
    item = " ".join(f"q{k}" for k in range(70))
    docs = spark.createDataFrame([(1, f"before {item} after"), (2, "short"), (3, None), (4, " ".join(f"q{k}" for k in range(20, 65)))], "doc_id long, text string")
    reference = spark.createDataFrame([(item,), (" ".join(f"z{k}" for k in range(90)),), (None,)], "text string")
    found = {r["row"]["doc_id"]: (r["n_words"], [tuple(s) for s in r["spans"]]) for r in automaton_dedup.against(docs, reference).collect()}
    assert found == {1: (72, [(1, 70)]), 2: (1, []), 3: (0, []), 4: (45, [])}
    monkeypatch.setattr(automaton_dedup, "MOST_REFERENCE_WORDS", 100)
    with pytest.raises(ValueError, match="more than 100"):
        automaton_dedup.against(docs, reference)



def test_windows_of_wide_keys_are_few_runs():
    """Under another salt, equal windows share a key whatever surrounds them, and a text has far fewer runs than windows."""
    rng = random.Random(9)
    passage, keys, runs = [f"p{k}" for k in range(70)], [], []
    for _ in range(5):
        words = [f"a{rng.randrange(10**6)}" for _ in range(60)] + passage + [f"b{rng.randrange(10**6)}" for _ in range(60)]
        h = automaton_dedup.word_hashes(np.frombuffer(" ".join(words).encode(), np.uint8))[1]
        first, n, key, _ = automaton_dedup.window_runs(h, np.arange(len(h)) < len(h) - 49, salt=2)
        assert n.sum() == len(h) - 49 and n.max() <= 41
        keys.append(np.repeat(key, n)[60:81].tolist())
        runs.append(len(first))
    assert all(k == keys[0] for k in keys) and max(runs) < 40
    assert keys[0] != np.repeat(*automaton_dedup.window_runs(h, np.arange(len(h)) < len(h) - 49)[2:0:-1])[60:81].tolist()


def test_only_runs_of_wide_keys_are_dealt_again(spark, monkeypatch):
    """Copies whose keys aren't wide are written once, however often the windows of a passage in many surroundings are dealt."""
    rng = random.Random(10)
    word = lambda: f"u{rng.randrange(10**6)}"
    passage = [f"p{k}" for k in range(45)]
    docs = [(i, " ".join([word() for _ in range(45)] + passage + [word() for _ in range(45)])) for i in range(30)]
    copies = [" ".join(word() for _ in range(90)) for _ in range(20)]
    docs += [(100 + i, copies[i % 20]) for i in range(60)]
    sizes = []

    def counting(df, name="state", path=None):
        out = written(df, name, path)
        if name == "shared":
            sizes.append(out.where("doc >= 100").count())
        return out

    written = automaton_dedup.written
    monkeypatch.setattr(automaton_dedup, "written", counting)
    monkeypatch.setattr(automaton_dedup, "MOST_RUNS", 8)
    df = spark.createDataFrame([(*d, None, None, None) for d in docs], "doc_id long, text string, lang string, source string, n_chars long")
    assert got_windows(df) == brute_windows(docs)
    assert len(sizes) > 1 and sizes[0] >= 60 and not any(sizes[1:])
