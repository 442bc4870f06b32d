import random
import zlib

from papyra.llm import toxicity as tox


def corpus():
    rng = random.Random(4)
    bad, names = ["vile", "scummy", "rotten"], ["muslim", "women", "gay"]
    pairs, labels = [(None, None), (0, "")], [(0, 0, 0), (0, 0, None), (1, None, 1)]
    for i in range(2, 900):
        words = [f"w{chr(97 + rng.randrange(26))}{chr(97 + rng.randrange(26))}" for _ in range(30)]
        y = rng.random() < 0.3
        if y:
            words[rng.randrange(30)] = rng.choice(bad).title()
        if rng.random() < (0.5 if y else 0.05):     # group mentions go along with toxic rows
            words[rng.randrange(30)] = "muslim"
        pairs.append((i, " ".join(words) + "."))
        labels.append((i, 1, int(y)))
    return pairs, labels, names


def test_learns_and_ignores_group_names(spark, docs_of):
    pairs, labels, _ = corpus()
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    docs = docs_of(pairs)
    model = tox.fit(docs, lab, tox.Settings(min_df=3))
    plain = tox.fit(docs, lab, tox.Settings(min_df=3, fairness=0.0))
    rows = {r.doc_id: r for r in tox.score(docs, model).collect()}
    truth = {i: y for i, _, y in labels if y is not None}
    held = [r for r in rows.values() if r.held_out and r.doc_id in truth]
    assert len(held) > 100 and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in held)
    assert sum(r.predicted == truth[r.doc_id] for r in held) / len(held) > 0.97
    gap = lambda m: abs(m["weights"].get("muslim", 0) - m["weights"].get("christian", 0))
    assert gap(model) < 0.5 * gap(plain)
    assert model["weights"].get("muslim", 0) < 0.7 < 0.5 * plain["weights"]["muslim"]
    assert rows[0].score == tox.probability(model, "") and 0 < rows[0].score < 0.5
    kept = tox.drop_toxic(docs, model)
    assert kept.columns == docs.columns
    assert kept.count() == sum(r.predicted == 0 for r in tox.score(docs, model).collect())


def test_without_labels_and_empty(spark, docs_of):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = tox.fit(docs_of([(1, "a")]), none)
    assert tox.score(docs_of([(1, "a")]), model).first().score < 0.5
    assert tox.score(docs_of([(1, "a")]).limit(0), model).count() == 0


def test_sample_is_bounded(spark, docs_of):
    pairs, labels, _ = corpus()
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    n = tox.training_rows(docs_of(pairs), lab, tox.Settings(train_rows=100)).count()
    assert 50 < n < 160
