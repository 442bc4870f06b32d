import random
import re

import numpy as np
import xxhash

from papyra.llm import simhash


def brute_fp(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    sh = [" ".join(words)] if len(words) < 3 else [" ".join(words[i:i + 3]) for i in range(len(words) - 2)]
    hs = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute(pairs, bits=2):
    fp = [brute_fp(t) for _, t in pairs]
    root = list(range(len(pairs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i in range(len(pairs)):
        for j in range(i):
            if (fp[i] ^ fp[j]).bit_count() <= bits:
                root[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(pairs):
        if d is not None:
            low[find(i)] = min(low.get(find(i), d), d)
    return sorted(((d, f"{fp[i]:016x}", low.get(find(i))) for i, (d, _) in enumerate(pairs)), key=repr)


def corpus(seed=3):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeéß") for _ in range(rng.randrange(1, 6)))
    pairs = [(None, None), (5, ""), (6, " \n\t"), (7, "One"), (8, "one two"), (9, "ONE two"), (10, "one  two three")]
    base = [" ".join(word() for _ in range(rng.randrange(5, 200))) for _ in range(60)]
    for i in range(300):
        t = rng.choice(base).split()
        for _ in range(rng.randrange(0, 3)):
            t[rng.randrange(len(t))] = word()
        pairs.append((100 + i, " ".join(t)))
    pairs += [(1000, "É word " * 30_000), (100, pairs[7][1]), (100, pairs[7][1]), (100, "other text here now")]
    return pairs


def test_matches_brute_force(spark, docs_of, monkeypatch):
    pairs = corpus()
    want = brute(pairs)
    got = simhash.report(simhash.near_duplicates(docs_of(pairs, 5)))
    assert sorted(map(tuple, got.collect()), key=repr) == want
    monkeypatch.setattr(simhash, "SHARD_ROWS", 40)       # many shards, blocks of blocks
    monkeypatch.setattr(simhash, "BLOCK_ROWS", 10)
    got = simhash.report(simhash.near_duplicates(docs_of(pairs, 5)))
    assert sorted(map(tuple, got.collect()), key=repr) == want


def test_shards_hold_every_linked_pair():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, size=4000, dtype=np.uint64)
    flip = np.uint64(1) << rng.integers(0, 64, size=(4000, 2)).astype(np.uint64)
    near = base ^ flip[:, 0] ^ flip[:, 1]
    fps = np.unique(np.concatenate([base, near]))
    tree, n = simhash.build_tree(fps, 1.0, 2, 200)
    assert n > 8
    rows, shards = simhash.route(tree, fps, 2)
    sets = {}
    for r, s in zip(rows, shards):
        sets.setdefault(int(fps[r]), set()).add(s)
    assert all(sets[int(a)] & sets[int(b)] for a, b in zip(base, near))


def test_empty_table_and_keep_one(spark, docs_of):
    docs = docs_of([(3, "a b c d"), (1, "a b c d"), (1, "a b c d"), (9, "x y z"), (None, None), (None, "")])
    assert simhash.report(simhash.near_duplicates(docs.limit(0))).count() == 0
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id, r.text or "") for r in kept.collect() if r.doc_id is not None) == [(1, "a b c d"), (9, "x y z")]
    assert kept.count() == 3


def test_long_chain_is_one_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 200)], "a long, b long")
    got = {r.node: r.root for r in simhash.components(edges).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 200: 100}
