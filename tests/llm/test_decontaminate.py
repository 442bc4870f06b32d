import random
import re
from collections import Counter

import numpy as np
import pytest

from papyra.llm import decontaminate as dc


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        prev = 0
        for j, y in enumerate(b):
            prev, row[j + 1] = row[j + 1], prev + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


def test_common_words_is_the_lcs():
    rng = random.Random(1)
    for _ in range(300):
        a, b = ([rng.randrange(6) for _ in range(rng.randrange(1, 40))] for _ in range(2))
        assert dc.common_words(dc.masks_of(np.array(a)), len(a), b) == lcs(a, b)


def make(seed):
    rng = random.Random(seed)
    common = [f"c{chr(97 + i)}" for i in range(12)]
    word = lambda: rng.choice(common) if rng.random() < 0.5 else "w" + "".join(rng.choice("abcdé") for _ in range(5))
    text = lambda n: " ".join(word() for _ in range(n))
    items = [(i, (text(rng.randrange(14, 50)) + ". " + text(8) + ".").capitalize()) for i in range(20)] + [(90, None), (91, "")]
    pairs, truth = [(None, None), (0, ""), (1, "ca " * 5000)], set()
    for i in range(2, 160):
        t = text(rng.randrange(1, 200))
        if i % 4 == 0:
            n, item = items[rng.randrange(20)]
            words = item.split()
            kind = rng.randrange(3)
            if kind == 1:
                words = [w.upper() + "," for w in words]
            if kind == 2:
                for _ in range(len(words) // 8):
                    words[rng.randrange(len(words))] = word()
            t += "\n" + " ".join(words) + " " + text(rng.randrange(60))
            truth.add((i, n))
        pairs.append((i, t))
    return pairs, items, truth


def test_finds_planted_items_and_nothing_else(spark, docs_of):
    pairs, items, truth = make(2)
    pairs.append(pairs[4 + 2])
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = dc.report(docs_of(pairs, 4), bench).collect()
    found = {(r.doc_id, r.item_id) for r in got}
    assert found <= truth and len(found & truth) >= 0.97 * len(truth)
    docs = docs_of(pairs, 4)
    kept = dc.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, _ in pairs} - {d for d, _ in found}


def test_candidates_lose_no_pair_that_brute_force_finds(spark, docs_of):
    """Against the same checks over every passage (no bound on cosine or energy): recall."""
    pairs, items, _ = make(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = docs_of(pairs, 4)
    every = {(r.doc_id, r.item_id) for r in dc.report(docs, bench, dc.Settings(cosine=-2.0, energy=0.0)).collect()}
    found = {(r.doc_id, r.item_id) for r in dc.report(docs, bench).collect()}
    assert found <= every and len(found) >= 0.95 * len(every) and every


def test_empty(spark, docs_of):
    bench = spark.createDataFrame([(1, "some words here")], "item_id long, text string")
    assert dc.report(docs_of([(1, "a")]).limit(0), bench).count() == 0
    assert dc.report(docs_of([(1, "a")]), bench.limit(0)).count() == 0
    assert dc.drop_contaminated(docs_of([(1, "a")]), bench.limit(0)).count() == 1


def test_items_of_common_words_with_unknown_words_between(spark, docs_of):
    """Words that no item has must not hide a passage, however many rows there are."""
    rng = random.Random(5)
    common = [f"c{chr(97 + i)}" for i in range(26)]
    items = [(i, " ".join(rng.choice(common) for _ in range(24))) for i in range(6)]
    pairs = []
    for i in range(300):
        words = [w for w in common if rng.random() < 0.9]
        rng.shuffle(words)
        if i % 30 == 0:
            leak = items[i // 30 % 6][1].split()
            for x in rng.sample(range(24), 4):
                leak[x] = f"unknown{rng.random()}"
            words = words[:12] + leak + words[12:]
        pairs.append((i, " ".join(words)))
    found = {(r.doc_id, r.item_id) for r in dc.report(docs_of(pairs, 4), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert {(i, i // 30 % 6) for i in range(0, 300, 30)} <= found


def brute(pairs, items, width=24, share=0.7, answer_share=0.6):
    """The rule written out: an item is in a row if some passage with an item's length
    on both sides holds enough of it, and of its last sentence, in order."""
    words = lambda t: re.findall(r"[a-z0-9\x80-\U0010ffff]+", (t or "").lower())
    out = set()
    for doc, text in pairs:
        row = words(text)
        blocks = -(-len(row) // (width // 2))
        for n, item in items:
            whole, last = words(item), words((item or "").rstrip(".").rsplit(". ", 1)[-1])
            for b in range(0, max(blocks - 1, min(blocks, 1))):
                start = b * width // 2
                near = row[max(0, start - len(whole)):start + width + len(whole)]
                if not whole or sum((Counter(near) & Counter(whole)).values()) < share * len(whole):
                    continue                            # the LCS cannot be longer
                if lcs(whole, near) >= share * len(whole) and lcs(last, near) >= answer_share * len(last):
                    out.add((doc, n))
                    break
    return out


def test_equals_brute_force(spark, docs_of):
    """Independent tokens, passages, surroundings and checks; without the cosine the
    results are equal, with it nearly all are found."""
    pairs, items, _ = make(7)
    pairs += [(200, items[3][1]), (200, items[3][1]), (201, " ".join(reversed(items[4][1].split())))]
    bench, docs = spark.createDataFrame(items, "item_id long, text string"), docs_of(pairs, 4)
    want = brute(pairs, items)
    every = {(r.doc_id, r.item_id) for r in dc.report(docs, bench, dc.Settings(cosine=-2.0)).collect()}
    found = {(r.doc_id, r.item_id) for r in dc.report(docs, bench).collect()}
    assert every == want and (200, 3) in want and (201, 4) not in want
    assert found <= want and len(found) >= 0.95 * len(want)


@pytest.mark.parametrize("cells, flat", [(1 << 24, 1 << 21), (100, 300)])
def test_reach_counts_words_that_stand_near(monkeypatch, cells, flat):
    monkeypatch.setattr(dc.Reach, "CELLS", cells)
    monkeypatch.setattr(dc.Reach, "FLAT", flat)
    rng = np.random.default_rng(3)
    items = [rng.integers(0, 40, n) for n in (1, 5, 17, 30)]
    ids = rng.integers(-1, 40, 500)
    off = np.array([0, 3, 3, 200, 500])
    reach = dc.Reach(items, 40, 24)
    for _ in range(2):                                  # the table is used again
        row = np.sort(rng.choice([0, 2, 3], 60))
        word = np.array([rng.integers(off[r], off[r + 1]) for r in row])
        pairs = [(p, q) for p in range(60) for q in range(4) if rng.random() < 0.6]
        p, q = map(np.array, zip(*pairs))
        got = reach.counts(ids, off[row], off[row + 1], word, p, q)
        for (a, b), n in zip(pairs, got):
            size = len(items[b])
            near = ids[max(off[row[a]], word[a] - size):min(off[row[a] + 1], word[a] + 24 + size)]
            assert n == np.isin(items[b], near).sum()


def test_rare_words_keep_every_item_that_can_be_reached():
    """Any 70 % of an item's words, in any order: the class of the item asks for no more."""
    rng = np.random.default_rng(6)
    items = [rng.integers(0, 60, n) for n in (1, 2, 3, 8, 15, 15, 40, 90)]
    df = rng.integers(1, 50, 60)
    classes = dc.rare_words(items, df, 0.7, classes=3, spare=4)
    for item in items:
        need = int(np.ceil(0.7 * len(item) - 1e-9))
        for _ in range(200):
            held = rng.permutation(item)[:need]
            assert any(longest >= len(item) and mark[held].sum() >= least for mark, longest, least in classes)
        assert not any(mark[-1] for mark, _, _ in classes)


def test_sparse_rows_equal_dense_ones():
    rng = np.random.default_rng(4)
    passages = [rng.integers(0, 30, n) for n in (1, 9, 24, 24)]
    idf, table = rng.random(30) + 0.1, rng.random((30, 5)).astype(np.float32)
    dense = np.zeros((4, 30))
    for x, w in zip(dense, passages):
        np.add.at(x, w, idf[w])
    dense /= np.linalg.norm(dense, axis=1, keepdims=True)
    rows = dc.SparseRows.of(passages, idf)
    assert np.allclose(rows.times(table), dense @ table, atol=1e-5)
    assert np.allclose(rows.transposed_times(table[:4], 30), dense.T @ table[:4], atol=1e-5)


def test_a_large_benchmark_is_an_error_and_repeated_items_count_once(spark, docs_of):
    bench = spark.createDataFrame([(1, "alpha beta gamma delta epsilon zeta"), (1, "alpha beta gamma delta epsilon zeta"),
                                   (None, "one two three four five six")], "item_id long, text string")
    docs = docs_of([(5, "alpha beta gamma delta epsilon zeta"), (6, "one two three four five six")])
    got = sorted(((r.doc_id, r.item_id) for r in dc.report(docs, bench).collect()), key=repr)
    assert got == [(5, 1), (6, None)]
    with pytest.raises(ValueError):
        dc.report(docs, bench, dc.Settings(max_benchmark_bytes=10))
