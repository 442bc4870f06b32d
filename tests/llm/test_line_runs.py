import hashlib
import random

from papyra.llm import line_runs

KEY = lambda p: (-(1 << 63) if p[0] is None else p[0])


def brute(pairs, m, words=50):
    """Rows that repeat count once; order among equal ids is free, so ids are unique here otherwise."""
    docs = {}
    for p in pairs:
        docs.setdefault((KEY(p), p[1]), [(n, x) for n, x in enumerate((p[1] or "").split("\n")) if x.strip(" ")])
    order = sorted(docs, key=lambda x: (x[0], x[1] or ""))
    first, out = {}, {}
    for key in order:
        seq = [x for _, x in docs[key]]
        for i in range(len(seq) - m + 1):
            first.setdefault(tuple(seq[i:i + m]), (key, i))
        for i, x in enumerate(seq):
            if len(x.split()) >= words:
                first.setdefault((x,), (key, i))
    suffixes = [(key, i) for key in order for i in range(len(docs[key]))]
    for key in order:
        seq, gone, longest = [x for _, x in docs[key]], set(), 0
        for i in range(len(seq)):
            if i + m <= len(seq) and first[tuple(seq[i:i + m])] != (key, i):
                gone |= {docs[key][i + t][0] for t in range(m)}
            wide = len(seq[i].split()) >= words
            if wide and first[seq[i],] != (key, i):
                gone.add(docs[key][i][0])
            for other, j in suffixes:
                if (other, j) != (key, i):
                    o, n = docs[other], 0
                    while i + n < len(seq) and j + n < len(o) and seq[i + n] == o[j + n][1]:
                        n += 1
                    if n >= m or wide and n:
                        longest = max(longest, n)
        every = (key[1] or "").split("\n")
        kept = "\n".join(x for n, x in enumerate(every) if n not in gone)
        runs = sum(n - 1 not in gone for n in gone)
        out[key] = (len(every), len(gone), runs, longest, hashlib.sha256(kept.encode()).hexdigest())
    return sorted(((p[0], *out[KEY(p), p[1]]) for p in pairs), key=repr)


def corpus(seed):
    rng = random.Random(seed)
    pool = [f"line {i}" for i in range(14)] + ["", "  ", "é" * 30]
    pairs = [(None, None), (0, ""), (1, "\n\n"), (2, "hot\nhot\nhot\nhot"), (3, "x\n" * 40)]
    blocks = [[rng.choice(pool) for _ in range(rng.randrange(1, 12))] for _ in range(5)]
    for i in range(60):
        t = []
        for _ in range(rng.randrange(1, 4)):
            t += rng.choice(blocks)[rng.randrange(3):] + [f"only {rng.random()}"] * rng.randrange(2)
        pairs.append((10 + i, "\n".join(t)))
    pairs += [pairs[8], pairs[8], (200, pairs[9][1])]
    rng.shuffle(pairs)
    return pairs


def check(spark, docs_of, pairs, m, words=50):
    got = line_runs.report(docs_of(pairs, 4), m, words).collect()
    assert sorted(map(tuple, got), key=repr) == brute(pairs, m, words)


def test_single_lines(spark, docs_of):
    check(spark, docs_of, corpus(1), 1)


def test_runs_of_two_and_long_lines(spark, docs_of):
    pairs = corpus(4)
    long = [" ".join(f"w{j}" for j in range(n)) for n in (49, 50, 51)]
    pairs += [(300 + i, f"own {i}\n{long[i % 3]}\nmine {i}") for i in range(9)]
    check(spark, docs_of, pairs, 2)
    check(spark, docs_of, corpus(5), 2, 2)          # two words make a run: lines of the pool


def test_short_shared_lines_stay(spark, docs_of):
    docs = docs_of([(i, f"head {i}\n----\nbody {i}\nYours\ntail {i}") for i in range(40)])
    assert all(r.n_removed == 0 and r.longest_repeat == 0 for r in line_runs.report(docs).collect())
    out = {r.doc_id: r.text for r in line_runs.dedup_lines(docs).collect()}
    assert out[7] == "head 7\n----\nbody 7\nYours\ntail 7"


def test_runs_of_three_and_seven(spark, docs_of):
    check(spark, docs_of, corpus(2), 3)
    check(spark, docs_of, corpus(3), 7)


def test_dedup_keeps_columns(spark, docs_of):
    pairs = [(2, "a\nb\nc"), (1, "a\nb"), (3, None), (4, "a"), (5, "new")]
    docs = docs_of(pairs)
    out = line_runs.dedup_lines(docs)
    assert out.columns == docs.columns
    got = {r.doc_id: (r.text, r.n_chars) for r in out.collect()}
    # "a" alone is no run of two lines
    assert got == {1: ("a\nb", None), 2: ("c", 1), 3: (None, None), 4: ("a", None), 5: ("new", None)}
    assert line_runs.report(docs.limit(0)).count() == 0
    assert line_runs.dedup_lines(docs.limit(0)).count() == 0
