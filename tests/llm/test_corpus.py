"""Tries of conversations, suffix arrays and importance resampling against brute force on small tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import prefix_trie, resampling, suffix_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# --- op11


def brute_trie(rows, head=3, period=20):
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            turns[conv].append((turn is not None, turn or 0, hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest(), role, text))
    own = {c: [t[3:] for t in sorted(found)] for c, found in turns.items()}
    whole = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % (head + 1)
        base = c - int(math.fmod(c, period))
        whole[c] = own.get(base, [])[:h] + own[c][h:]
    members = defaultdict(list)
    for c, said in whole.items():
        for d in range(len(said) + 1):
            members[tuple(said[:d])].append(c)
    children, leaves, saved = defaultdict(set), Counter(), Counter()
    for node in members:
        if node:
            children[node[:-1]].add(node)
    for node, found in members.items():
        cost = (len(found) - 1) * len(WORD.findall(node[-1][1])) if node else 0
        for d in range(len(node) + 1):
            saved[node[:d]] += cost
            leaves[node[:d]] += not children[node]
    out = Counter()
    for node, found in members.items():
        ends = ",".join(str(c) for c in sorted(c for c in found if len(whole[c]) == len(node)))
        parent = min(members[node[:-1]]) if node else None
        out[(min(found), len(node), parent, len(found), len(children[node]), leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest())] += 1
    return out


def conversations_of(rng, n, turns=3):
    texts = ["hello there", "what is it", "a  b\tc", "", "x", None, "é è"]
    rows = []
    for c in rng.sample(range(-30, 200), n):
        for t in range(rng.randrange(1, turns + 2)):
            rows.append((c, rng.choice([t, t, t, None]), rng.choice(["user", "assistant", None]), rng.choice(texts[: 2 + t])))
    return rows


SCHEMA = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("shard_rows, block", [(200_000, 1024), (0, 1), (40, 3)])
def test_trie_equals_brute_force(spark, monkeypatch, shard_rows, block):
    """Whatever is upper and wherever blocks end: repeated turns, nulls, negative ids, conversations whose base is absent or shorter than its head."""
    monkeypatch.setattr(prefix_trie, "BLOCK", block)
    rng = random.Random(shard_rows)
    rows = conversations_of(rng, 60) + [(None, 0, "user", "x"), (7, 0, "user", "hello there"), (7, 0, "user", "hello there")]
    rows += [(300, t, "user", f"turn {t % 3}") for t in range(40)] + [(301, t, "user", f"turn {t % 3}") for t in range(41)]
    found = prefix_trie.prefix_trie(spark.createDataFrame(rows, SCHEMA), shard_rows=shard_rows)
    assert found.dtypes == [tuple(x.split()) if x.split()[1] != "long" else (x.split()[0], "bigint") for x in prefix_trie.RESULT.split(", ")]
    assert Counter(map(tuple, found.collect())) == brute_trie(rows)


def test_trie_of_one_hot_first_turn_and_many_ends(spark, monkeypatch):
    """A third of all conversations are one and the same: their ids are formatted in parts and hashed as a stream."""
    monkeypatch.setattr(prefix_trie, "ENDS", 7)
    rows = [(c, 0, "user", "same" if c % 3 else f"other {c}") for c in range(400)] + [(c, 1, "assistant", "again") for c in range(0, 400, 5)]
    found = prefix_trie.prefix_trie(spark.createDataFrame(rows, SCHEMA), head=0, shard_rows=50)
    want = brute_trie(rows, head=0)
    assert Counter(map(tuple, found.collect())) == want


def test_trie_of_no_rows_and_clashing_names(spark):
    from pyspark.sql import functions as F

    rows = [(1, 0, "user", "a b"), (2, 0, "user", "a b"), (2, 1, None, None)]
    extra = spark.createDataFrame(rows, SCHEMA).withColumns({n: F.lit("x") for n in ("conv", "depth", "n", "p1", "words", "length", "tie", "number", "block")})
    assert Counter(map(tuple, prefix_trie.prefix_trie(extra).collect())) == brute_trie(rows)
    assert prefix_trie.prefix_trie(spark.createDataFrame([], SCHEMA)).count() == 0


def test_louds_bits_name_parents_and_children():
    """A forest of two trees, level by level: the bits say what the pointers said."""
    parent = np.array([-1, 0, 0, -1, 1, 1, 2])
    level = np.array([0, 1, 1, 0, 2, 2, 2])
    labels = np.array([5, 9, 2, 1, 4, 3, 8])
    trie = prefix_trie.Trie(parent, level, labels)
    assert trie.order.tolist() == [3, 0, 2, 1, 6, 5, 4]
    assert "".join(map(str, np.unpackbits(trie.bits, count=2 * 7 + 1))) == "110" + "0" + "110" + "10" + "110" + "000"
    assert trie.parents().tolist() == [-1, -1, 1, 1, 2, 3, 3]
    assert trie.children().tolist() == [0, 2, 1, 2, 0, 0, 0]
    assert trie.rolled_up(np.ones(7, np.int64)).tolist() == [1, 6, 2, 3, 1, 1, 1]


# --- op12


def brute_removed(rows, length=50):
    texts = [(i if i is not None else 1 << 62, (t or "").encode()) for i, t in rows]
    first = {}
    for i, t in texts:
        for p in range(len(t) - length + 1):
            w = t[p : p + length]
            first[w] = min(first.get(w, i), i)
    out = Counter()
    for (own, _), (i, t) in zip(rows, texts):
        gone = [False] * len(t)
        for p in range(len(t) - length + 1):
            if first[t[p : p + length]] < i:
                gone[p : p + length] = [True] * length
        runs = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        kept = bytes(b for b, g in zip(t, gone) if not g)
        out[(own, len(t), sum(gone), runs, hashlib.sha256(kept).hexdigest())] += 1
    return out


def passages(rng):
    """Texts that share passages near and below the length, overlapping ones, repeats within, runs of one character and bytes beyond ASCII."""
    alphabet = "abcde é\0\n"
    shared = ["".join(rng.choice(alphabet) for _ in range(n)) for n in (30, 49, 50, 51, 80, 200)] + ["a" * 120, "ab" * 60, "é" * 40]
    rows = []
    for i in range(40):
        parts = []
        for _ in range(rng.randrange(0, 6)):
            s = rng.choice(shared)
            a = rng.randrange(0, 20)
            parts.append(rng.choice([s, s[a:], s[: len(s) - a], "".join(rng.choice(alphabet) for _ in range(rng.randrange(90)))]))
        rows.append((rng.randrange(30) if rng.random() < 0.95 else None, "".join(parts)))
    return rows + [(5, None), (6, ""), (7, "x" * 49), (8, "x" * 50), (9, "x" * 400), (9, "x" * 400), (9, "y" + "x" * 300), (3, shared[5]), (3, shared[5]), (None, shared[5])]


@pytest.mark.parametrize("settings", [{}, {"SALT_ROWS": 2, "HANDED": 50}, {"SORT_BYTES": 300, "SCAN_BYTES": 128}, {"SORT_BYTES": 1, "COMPARED": 20, "GATHERED": 400, "SALT_ROWS": 1}])
def test_removed_bytes_equal_brute_force(spark, monkeypatch, settings):
    """Whatever fits a task: salted keys, keys cut where the bytes to sort are full, texts scanned in pieces, many parts."""
    for name, value in settings.items():
        monkeypatch.setattr(suffix_dedup, name, value)
    rows = passages(random.Random(len(settings)))
    found = suffix_dedup.suffix_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))
    assert Counter(map(tuple, found.collect())) == brute_removed(rows)


def test_removed_bytes_of_no_rows_and_clashing_names(spark):
    from pyspark.sql import functions as F

    rows = [(1, "p" * 30 + "q" * 30), (2, "z" + "p" * 30 + "q" * 30)]
    docs = spark.createDataFrame(rows, "doc_id int, text string").withColumns({n: F.lit("x") for n in ("id", "hash", "own_id", "n_bytes", "sha256", "first", "whole", "spans", "key")})
    assert Counter(map(tuple, suffix_dedup.suffix_dedup(docs).collect())) == brute_removed(rows)
    kept = suffix_dedup.suffix_dedup(docs, with_text=True).where("doc_id = 2").first()["kept_bytes"]
    assert bytes(kept) == b"z"
    assert suffix_dedup.suffix_dedup(docs.limit(0)).count() == 0


def test_a_long_text_and_a_hot_passage(spark):
    """One text of a megabyte is scanned in pieces; a passage that most texts have is in one row of a combine each."""
    rng = random.Random(1)
    base = "".join(rng.choice("abcdefgh ") for _ in range(1_000_000))
    rows = [(1, base), (2, base[500_000:] + "!" + base[:200_000])] + [(i, f"{i} begins " + base[100:180] + f" ends {i}") for i in range(3, 300)]
    found = {r["doc_id"]: r for r in suffix_dedup.suffix_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found[1]["n_removed"] == 0 and (found[2]["n_removed"], found[2]["n_spans"]) == (700_000, 2)
    want = {r[0]: r for r in brute_removed([(1, base[:400]), *rows[2:]])}
    assert all(tuple(found[i]) == want[i] and want[i][2] >= 80 for i in range(3, 300))


def test_suffix_array_and_common_prefixes():
    rng = random.Random(2)
    for depth in (3, 8, 12, 50):
        for alphabet in (b"a", b"ab", b"\0\1\2", bytes(range(256))):
            data = bytes(rng.choice(alphabet) for _ in range(300)) + b"a" * 80
            places, words = suffix_dedup.suffix_array(np.frombuffer(data, np.uint8), depth)
            assert sorted(places.tolist()) == list(range(len(data)))
            full = [p for p in places.tolist() if p + depth <= len(data)]
            begins = [data[p : p + depth] for p in full]
            assert begins == sorted(begins)
            common = suffix_dedup.common_prefixes(words, np.array(full), depth).tolist()
            for k in range(1, len(full)):
                same = next((j for j in range(depth) if begins[k][j] != begins[k - 1][j]), depth)
                assert common[k] == same


def test_equal_windows_have_equal_keys():
    rng = np.random.default_rng(3)
    data = rng.integers(0, 256, 500).astype(np.uint8)
    twice = np.concatenate([data[100:400], data])
    keys = suffix_dedup.window_keys(twice)
    assert (keys[:251] == keys[400:651]).all()
    texts = pa.array(["a" * 60, "b" * 49, None, "a" * 50])
    found = [(int(o), int(f + s), int(m)) for k, owner, first, many, data, shift in suffix_dedup.segments(texts) for o, f, m, s in zip(owner, first, many, np.broadcast_to(shift, first.shape))]
    assert found == [(0, 0, 11), (3, 0, 1)]


# --- op13

FEATURE_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lowered(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


def brute_resampled(rows, target):
    def features(text):
        w = FEATURE_WORD.findall(lowered(text))
        return len(w), [zlib.crc32(x.encode()) % 10_000 for x in w + [f"{a} {b}" for a, b in zip(w, w[1:])]]

    every = [(i, *features(t)) for i, t in rows]
    s, t = Counter(b for _, _, f in every for b in f), Counter(b for x in target for b in features(x)[1])
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (big_s + 10_000) / ((s[b] + 1) * (big_t + 10_000)))) for b in s}
    out = []
    for i, n, f in every:
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'null' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((n, i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((x for x in out if x[0] >= 20), key=lambda x: (-x[4], x[1] is None, x[1] or 0, x))
    drawn = able[: 25 * len(able) // 100]
    ranked = [(*x[1:], k + 1) for k, x in enumerate(drawn)] + [(*x[1:], None) for x in able[len(drawn) :]]
    return Counter(ranked + [(*x[1:], None) for x in out if x[0] < 20])


def resampling_texts(rng):
    words = ["the", "The", "é", "naïve", "a1", "7", "x" * 47, "y" * 48, "Z" * 49, "w" * 200, "don't", "\0", "_", "zwölf"]
    return [(i, " ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 2, 19, 20, 40, 300])))) for i in range(60)]


@pytest.mark.parametrize("chunk, piece", [(1 << 16, 500_000), (40, 100), (1, 1)])
def test_resampling_equals_brute_force(spark, monkeypatch, chunk, piece):
    """Wherever texts are cut: nulls, repeated rows, one id with two texts, words longer than chunks."""
    monkeypatch.setattr(resampling, "CHUNK", chunk)
    monkeypatch.setattr(resampling, "PIECE", piece)
    rng = random.Random(4)
    rows = resampling_texts(rng)
    rows += [(100, None), (101, ""), (5, rows[5][1]), (6, "another text of the same number " * 5), (None, "no number but words enough to be drawn or not " * 4), (-3, "--- ..."), (None, None)]
    target = [t for _, t in resampling_texts(rng)[:10]] + [None, ""]
    found = resampling.resampled(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), spark.createDataFrame([(t,) for t in target], "text string"))
    got = [tuple(r) for r in found.collect()]
    want = brute_resampled(rows, target)
    # rows of one id tie: which of them comes first is open
    assert Counter(r[:4] for r in got) == Counter({k: n for k, n in Counter(x[:4] for x in want.elements()).items()})
    assert sorted(r[4] for r in got if r[4]) == sorted(x[4] for x in want.elements() if x[4])
    single = {i for i, n in Counter(i for i, _ in rows).items() if n == 1}
    assert {r for r in got if r[0] in single} == {x for x in want if x[0] in single}


def test_chunks_own_each_feature_once():
    """Whatever the size of chunks, features that chunks own are those of the text."""
    rng = random.Random(5)
    for _ in range(50):
        text = "".join(rng.choice(["ab", "c", " ", "é", "--", "d" * 30]) for _ in range(rng.randrange(60)))
        whole = Counter(b for _, _, _, buckets in resampling.features(pa.array([text])) for b in buckets.tolist())
        for size in (1, 5, 17, 1000):
            data = text.encode()
            places = resampling.cut(data, size)
            assert "".join(data[a:b].decode() for a, b, _ in places) == text
            parts = pa.array([data[a:c].decode() for a, _, c in places], pa.string())
            owned = np.array([b - a for a, b, _ in places], np.int64)
            assert Counter(b for _, _, _, buckets in resampling.features(parts, owned) for b in buckets.tolist()) == whole


def test_resampling_of_no_rows_and_clashing_names(spark):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([(1, "one two three " * 10)], "doc_id int, text string").withColumns({n: F.lit("x") for n in ("id", "hash", "chunk", "owned", "n_words", "n_features", "gain", "score", "rank")})
    nothing = docs.limit(0).select("text")
    assert Counter(map(tuple, resampling.resampled(docs, nothing).collect())) == brute_resampled([(1, "one two three " * 10)], [])
    assert resampling.resampled(docs.limit(0), docs).count() == 0
