import hashlib
import random
from collections import Counter, defaultdict

import numpy as np

from papyra.llm import segments, suffix_array, suffix_tree


def sha(b):
    return hashlib.sha256(b).hexdigest()


def brute_bytes(pairs, width):
    texts = [(t or "").encode() for _, t in pairs]
    seen = Counter(t[i:i + width] for t in texts for i in range(len(t) - width + 1))
    out = []
    for (d, _), t in zip(pairs, texts):
        gone = np.zeros(len(t) + 1, bool)
        for i in range(len(t) - width + 1):
            if seen[t[i:i + width]] > 1:
                gone[i:i + width] = True
        gone = gone[:len(t)]
        spans = int((gone & ~np.concatenate([[False], gone[:-1]])).sum()) if len(t) else 0
        out.append((d, len(t), int(gone.sum()), spans, sha(bytes(np.frombuffer(t, np.uint8)[~gone]))))
    return sorted(out, key=repr)


def brute_words(pairs, width):
    rows = [(-(1 << 63) if d is None else d, (t or "").encode().split()) for d, t in pairs]
    low = {}
    for d, w in rows:
        for i in range(len(w) - width + 1):
            key = tuple(w[i:i + width])
            low[key] = min(low.get(key, d), d)
    out = []
    for (d0, _), (d, w) in zip(pairs, rows):
        gone = [False] * len(w)
        for i in range(len(w) - width + 1):
            if low[tuple(w[i:i + width])] < d:
                gone[i:i + width] = [True] * width
        out.append((d0, len(w), sum(gone), sha(b" ".join(x for x, g in zip(w, gone) if not g))))
    return sorted(out, key=repr)


def corpus(seed, words=12, n=120):
    rng = random.Random(seed)
    vocab = ["a", "b", "ab", "ç", "the", "ß", "xyz", "\x00", "loooong"]
    make = lambda k: " ".join(rng.choice(vocab) for _ in range(rng.randrange(k)))
    shared = [make(words * 8) for _ in range(6)]
    pairs = [(None, None), (None, shared[0] + " end"), (0, ""), (1, "a" * 700), (2, "b " * 300), (2, "b " * 300)]
    for i in range(n):
        t = make(words * 6)
        for _ in range(rng.randrange(3)):
            s = rng.choice(shared)
            lo = rng.randrange(len(s) + 1)
            t += rng.choice(["", " ", "\n"]) + s[lo:lo + rng.randrange(len(s) + 1)] + make(4)
        pairs.append((rng.randrange(40, 90) if i % 10 == 0 else 100 + i, t))
    pairs += [(300, pairs[20][1]), (300, pairs[21][1]), (301, pairs[20][1]), (301, pairs[20][1])]
    pairs.append((400, " ".join(t for _, t in pairs[6:30])))
    rng.shuffle(pairs)
    return pairs


def check_bytes(spark, docs_of, pairs, unit):
    got = suffix_array.remove_repeats(docs_of(pairs, 4), unit).collect()
    assert sorted(map(tuple, got), key=repr) == brute_bytes(pairs, unit.width)


def check_words(spark, docs_of, pairs, unit):
    got = suffix_tree.remove_repeats(docs_of(pairs, 4), unit).collect()
    assert sorted(map(tuple, got), key=repr) == brute_words(pairs, unit.width)


def test_bytes(spark, docs_of):
    check_bytes(spark, docs_of, corpus(1), segments.BYTES)


def test_bytes_small_windows_and_slices(spark, docs_of, monkeypatch):
    monkeypatch.setattr(suffix_array, "CHUNK", 3000)
    monkeypatch.setattr(segments, "LONGEST", 16)
    check_bytes(spark, docs_of, corpus(2), segments.Unit(False, 24, 7, 256))


def test_bytes_crowded_anchors(spark, docs_of, monkeypatch):
    monkeypatch.setattr(segments, "MAX_CLASSES", 3)
    check_bytes(spark, docs_of, corpus(3), segments.Unit(False, 24, 7, 1 << 20))


def test_words(spark, docs_of):
    check_words(spark, docs_of, corpus(4, words=40, n=80), segments.WORDS)


def test_words_small_windows_and_slices(spark, docs_of, monkeypatch):
    monkeypatch.setattr(suffix_tree, "GROUP", 20)
    monkeypatch.setattr(suffix_tree, "CHUNK", 3000)
    monkeypatch.setattr(segments, "LONGEST", 8)
    check_words(spark, docs_of, corpus(5), segments.Unit(True, 7, 2, 64))


def test_words_crowded_anchors(spark, docs_of, monkeypatch):
    monkeypatch.setattr(segments, "MAX_CLASSES", 3)
    check_words(spark, docs_of, corpus(6), segments.Unit(True, 7, 2, 1 << 17))


def test_empty_tables(spark, docs_of):
    docs = docs_of([(1, "a")]).limit(0)
    assert suffix_array.remove_repeats(docs).count() == 0
    assert suffix_tree.remove_repeats(docs).count() == 0


def test_two_stage_order_is_the_suffix_order():
    rng = random.Random(9)
    for size in (2, 3, 250):
        segs = [bytes(rng.randrange(size) for _ in range(rng.randrange(30, 90))) for _ in range(40)]
        counts = [len(s) - 29 for s in segs]
        text = np.zeros(sum(len(s) + 1 for s in segs), np.int16)
        owned, at, want = np.zeros(len(text), bool), 0, []
        for s, n in zip(segs, counts):
            text[at:at + len(s)] = np.frombuffer(s, np.uint8).astype(np.int16) + 1
            owned[at:at + n] = True
            want += [(s[i:i + 30], at + i) for i in range(n)]
            at += len(s) + 1
        array = suffix_array.TwoStage(text, owned, 30)
        order = array.order()
        order = order[owned[order]]
        where = {p: w for w, p in want}
        assert len(order) == len(want) and [where[p] for p in order.tolist()] == sorted(w for w, _ in want)
        common = array.common(order)
        for x, y, c in zip(order[:-1].tolist(), order[1:].tolist(), common.tolist()):
            u, v = where[x], where[y]
            assert c == next((i for i in range(30) if u[i] != v[i]), 30)
