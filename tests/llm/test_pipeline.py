import random
from collections import Counter

import corpus_pipeline
from papyra.llm import decontaminate as dc
from papyra.llm import toxicity
from test_line_runs import KEY
from test_simhash import brute_fp
from test_decontaminate import lcs

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 7)))
    line = lambda n: " ".join(word() for _ in range(n))
    items = [(i, line(30).capitalize() + ". " + line(9) + ".") for i in range(6)]
    boiler = [line(12) + "\n" + line(9) for _ in range(2)] + [line(12), line(55)]
    docs, labels = [], []
    for i in range(400):
        t = [line(rng.randrange(5, 40)) for _ in range(rng.randrange(1, 5))]
        if i % 5 == 0:
            t[0] += " vilest"
        if i % 9 == 0:
            t.insert(0, rng.choice(boiler))
        if i % 17 == 0:
            t.append(items[i % 6][1] + " " + line(12))
        docs.append((i, "\n".join(t)))
        labels.append((i, 1, int(i % 5 == 0)))
    for i in range(400, 440):
        words = docs[i - 399][1].split(" ")
        words[len(words) // 2] = word()
        docs.append((i, " ".join(words)))
    docs += [(500, docs[1][1]), (501, docs[2][1]), (502, None), (503, "")]
    return docs, labels, items


def brute(docs, labels, items, model):
    docs = [(i, t) for i, t in docs if toxicity.probability(model, t) < 0.5]
    seen, out = set(), []
    for i, t in sorted(docs, key=KEY):
        every = (t or "").split("\n")
        solid = [n for n, x in enumerate(every) if x.strip(" ")]
        runs = [(a, b) for a, b in zip(solid, solid[1:])] + [(n,) for n in solid if len(every[n].split()) >= 50]
        gone = set()
        for run in runs:            # in the order of their places; a later place of a run goes
            text = tuple(every[n] for n in run)
            gone |= set(run) if text in seen else set()
            seen.add(text)
        out.append((i, None if t is None else "\n".join(x for n, x in enumerate(every) if n not in gone)))
    fps, groups = [brute_fp(t) for _, t in out], list(range(len(out)))
    for a in range(len(out)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= 2 and groups[a] != groups[b]:
                old, new = max(groups[a], groups[b]), min(groups[a], groups[b])
                groups = [new if g == old else g for g in groups]
    out = [x for n, x in enumerate(out) if groups[n] == n]
    fold = lambda t: "".join(c if c.isalnum() else " " for c in (t or "").lower()).split()
    clean = []
    for i, t in out:
        words = fold(t)
        hit = any(lcs(fold(q), words[a:a + 24 + 2 * len(fold(q))]) >= 0.7 * len(fold(q))
                  for _, q in items for a in range(0, len(words), 6))
        if not hit:
            clean.append((i, t))
    return clean


def test_pipeline_matches_brute_force(spark, tmp_path):
    docs, labels, items = corpus()
    df = spark.createDataFrame([(i, t, "en", f"src{i % 4}", None if t is None else len(t)) for i, t in docs], SCHEMA)
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    df.repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    lab.write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    rows = out.collect()
    want = brute(docs, labels, items, toxicity.fit(df, lab))
    assert sorted(((r.doc_id, r.text) for r in rows), key=repr) == sorted(want, key=repr)
    assert all(r.n_chars == len(r.text) for r in rows if r.text is not None)
    assert out.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"]
    assert max(Counter((r.slot, r.in_block) for r in rows).values()) == 1
    assert 100 < len(rows) < len(docs)


def test_pipeline_on_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "a b c d")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
