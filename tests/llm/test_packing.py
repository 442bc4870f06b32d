import random
import zlib

import numpy as np
import pytest

from papyra.llm import packing

tokenizers = pytest.importorskip("tokenizers")
P = pytest.importorskip("public_tokenizers")
PATH = P.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def direct():
    t = tokenizers.Tokenizer.from_file(PATH)
    return lambda text: t.encode(text or "", add_special_tokens=False).ids + [1]


def check(direct, docs, rows, capacity):
    """Every document's pieces, read back from the sequences' places."""
    want = []
    for i, text in docs:
        ids = direct(text)
        for n, s in enumerate(range(0, len(ids), capacity)):
            part = np.array(ids[s:s + capacity], "<u4")
            want.append((i is None, i or 0, n, s, len(part), zlib.crc32(part.tobytes())))
    assert sorted(want) == sorted((r.doc_id is None, r.doc_id or 0, r.piece, r.start, r.length, r.ids_crc32) for r in rows)
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences), -(-sum(r.length for r in rows) // capacity)


def texts(n, seed):
    rng = random.Random(seed)
    words = ["the", "It's", "they'll", "naïve", "ÉCOLE", "Straße", "İx", "x86", "don't,", "北京", "áb", "Σας", "§$%", "...",
             "<|endoftext|>", "A<|startoftext|>b", "<|x", "'S", "1234", "\x1cq", "e\x85f", " ", "\xa0", "😀", "ﬁ", "́"]
    gaps = [" ", "  ", "\n", "\t", "\r\n", "\x0b", "　", ""]
    return ["".join(rng.choice(words) + rng.choice(gaps) for _ in range(rng.randint(0, 60))) for _ in range(n)]


def test_ids_are_the_tokenizers(direct):
    encode = packing.Encoder(PATH)
    sample = texts(400, 1) + ["", " ", "the " * 5000, "x" * 3000, "́ ́e", "á\ń", "I'LL we'Re 'veX ''s", "_a-b_c"]
    for text, ids in zip(sample, encode([t.encode() for t in sample])):
        assert np.frombuffer(ids, "<u4").tolist() == direct(text)[:-1], repr(text)


def test_latin_letters(direct):
    """Every character of the direct way, alone and between others."""
    encode = packing.Encoder(PATH)
    sample = [f"{a}{chr(c)}{b}" for c in [*range(33, 127), *range(0xC0, 0x180)] for a, b in (("", ""), ("x", "Y,"), ("é.", "9's"))]
    for text, ids in zip(sample, encode([t.encode() for t in sample])):
        assert np.frombuffer(ids, "<u4").tolist() == direct(text)[:-1], repr(text)


def test_cache_is_bounded(direct, monkeypatch):
    monkeypatch.setattr(packing, "CACHE_PARTS", 50)
    encode = packing.Encoder(PATH)
    for text in texts(60, 2):
        assert np.frombuffer(encode([text.encode()])[0], "<u4").tolist() == direct(text)[:-1]
    assert len(encode.parts) < 150 and len(encode.parts.old) < 150


def test_packs_every_piece(spark, docs_of, direct, monkeypatch):
    docs = list(enumerate(texts(200, 3)))
    docs += [(None, "lost id"), (7, docs[7][1]), (300, None), (301, ""), (302, "one two three " * 2000), (None, None)]
    n, least = check(direct, docs, packing.pack(docs_of(docs), PATH, 128).collect(), 128)
    assert n <= least + 2
    monkeypatch.setattr(packing, "GROUP_PIECES", 20)        # many groups, several rounds
    n, least = check(direct, docs, packing.pack(docs_of(docs), PATH, 128).collect(), 128)
    assert n <= least * 1.05 + 1


def test_repeatable_and_empty(spark, docs_of):
    docs = list(enumerate(texts(50, 4)))
    assert packing.pack(docs_of([]), PATH).collect() == []
    whole = [sorted(map(tuple, packing.pack(docs_of(docs), PATH, 64).select("doc_id", "piece", "ids_crc32").collect()))
             for _ in range(2)]
    assert whole[0] == whole[1]


def greedy(lengths, capacity):
    """The rule, written out: try every open sequence."""
    bins = []
    for s in sorted(lengths, reverse=True):
        best = None
        for gap in sorted({g for g in bins if g >= s}):
            after = list(bins)
            after.remove(gap)
            after.append(gap - s)
            counts = [after.count(g) for g in set(after) if g]
            cost = sum(c * c for c in counts)
            if best is None or cost < best[0]:
                best = cost, gap
        if best is None:
            bins.append(capacity - s)
        else:
            bins.remove(best[1])
            bins.append(best[1] - s)
    return sorted(bins)


def test_rule_matches_brute_force():
    rng = random.Random(7)
    for _ in range(60):
        capacity = rng.choice([8, 20, 50])
        lengths = np.array([rng.randint(1, capacity - 1) for _ in range(rng.randint(0, 60))], np.int64)
        where, offset, gaps = packing.sum_of_squares(lengths, capacity)
        assert sorted(gaps.tolist()) == greedy(lengths.tolist(), capacity)


def test_few_pieces_are_dissolved():
    where, _, gaps = packing.sum_of_squares(np.array([60] * 100, np.int64), 100)     # nothing fits together
    gone = packing.dissolved(where, gaps, 100)
    assert len(gone) == 12
