import math
import random
import re

from papyra.llm import ranked

TERM = re.compile("[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
ITEMS = "item_id long, text string, score string, doc_id string"


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k=20):
    held = [(i, terms(t)) for i, t in docs]
    held = [(i, t) for i, t in held if t]
    n_docs, total = len(held), sum(len(t) for _, t in held)
    out = []
    for item, text in items:
        scored = []
        for i, t in held:
            m = 100 - 25 + (25 * len(t) * n_docs) // total
            s = 0
            for x in terms(text):
                df, tf = sum(x in u for _, u in held), t.count(x)
                s += math.floor(1000 * math.log((2.0 * n_docs + 2) / (2.0 * df + 1))) * ((10 ** 9 * tf) // (1000 * tf + 12 * m))
            if s > 0:
                scored.append((-s, i is None, i or 0, i))
        out += [(item, r + 1, s[3], -s[0]) for r, s in enumerate(sorted(scored, key=lambda s: s[:3])[:k])]
    return out


def run(spark, docs_of, docs, items, k=20, **kw):
    table = spark.createDataFrame([(i, t, "x", "y") for i, t in items], ITEMS)
    got = ranked.search(docs_of(docs), table, k, **kw)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    key = (lambda r: tuple((x is None, x or 0) for x in r))
    assert sorted(map(tuple, got.collect()), key=key) == sorted(brute(docs, items, k), key=key)


def corpus(n, seed):
    rng = random.Random(seed)
    words = ["Alpha", "béta", "GAMMA", "δelta", "x1", "éa", "É", "the", "of", "Zeta_eta", "a.b"] + [f"w{i}" for i in range(30)]
    docs = [(i, rng.choice([" ", ", ", "\n", "\x00"]).join(rng.choices(words, k=rng.randint(0, 25)))) for i in range(n)]
    docs += [(1000 + i, docs[3][1].upper() if i % 2 else docs[3][1]) for i in range(45)]     # a large class
    docs += [(None, docs[3][1]), (None, None), (2000, None), (2001, ""), (2002, "... !!"), (5, docs[5][1]),
             (3000, "w1 " * 30_000 + "tail")]
    items = [(j, " ".join(rng.choices(words, k=rng.randint(1, 12)))) for j in range(8)]
    return docs, items + [(None, "the w1 w1"), (50, None), (51, ""), (52, "nowhere at all"), (2, "w2 w3"), (60, docs[3][1])]


def test_matches_brute_force(spark, docs_of, monkeypatch):
    docs, items = corpus(150, 1)
    run(spark, docs_of, docs, items)
    monkeypatch.setattr(ranked, "CLASS_ROWS", 7)
    run(spark, docs_of, docs, items, 3)
    run(spark, docs_of, docs, items, max_block_bytes=40)         # several passes


def test_integer_path(spark, docs_of, monkeypatch):
    monkeypatch.setattr(ranked, "EXACT", 0.0)
    run(spark, docs_of, *corpus(40, 2))


def test_empty_tables(spark, docs_of):
    docs, items = corpus(10, 3)
    run(spark, docs_of, [], items)
    run(spark, docs_of, docs, [])
    run(spark, docs_of, [(1, None), (2, " ")], items)


def test_classes_send_their_smallest_ids(spark, docs_of):
    found = ranked.bags(docs_of([(i, "a b") for i in range(90, 0, -1)] + [(None, "a b"), (7, "a b a")]), {b"a": 0, b"b": 1})
    got = sorted((len(r.ids), r.ids[:3]) for r in ranked.classes(found, 20, 92, 185).collect())
    assert got == [(1, [7]), (20, [1, 2, 3])]
