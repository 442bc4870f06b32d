"""Plug-in slots with toy models: encoder, pair scorer, summariser."""

import numpy as np
from pyspark.sql import functions as F

from papyra.functions import plugins as PL
from papyra.operators import retrieval as R
from papyra.operators import summaries as SU
from papyra.streaming import incremental as INC


def make_letter_encoder():
    """A toy model factory. Built inside a function so it is pickled by value
    (the Python workers cannot import this test module)."""
    import numpy

    def factory():
        def enc(texts):
            out = numpy.zeros((len(texts), 26))
            for i, t in enumerate(texts):
                for ch in t.lower():
                    if "a" <= ch <= "z":
                        out[i, ord(ch) - 97] += 1
            return out
        return enc
    return factory


def test_encoder_plugin(spark):
    df = spark.createDataFrame([(1, "abc"), (2, "   "), (3, None)], "doc_id long, combined_text string")
    out = {r["doc_id"]: r["vec"] for r in PL.encoder(make_letter_encoder(), "letters")(df, "combined_text").collect()}
    assert np.isclose(np.linalg.norm(out[1]), 1.0)
    assert not any(out[2]) and not any(out[3])


def test_scorer_and_summarizer_plugins(spark):
    papers = spark.createDataFrame(
        [(1, "1501.00001", "alpha", "alpha beta gamma", "alpha. alpha beta gamma", ["x"], None, ["A"]),
         (2, "1501.00002", "beta", "beta delta", "beta. beta delta", ["y"], None, ["B"])],
        "doc_id long, id string, title string, abstract string, combined_text string, "
        "categories array<string>, update_date timestamp, authors array<string>")
    length_scorer = PL.pair_scorer(lambda: (lambda qs, ts: [float(len(t)) for t in ts]), "len")
    q = spark.createDataFrame([(1, "alpha")], "query_id long, query string")
    res = R.search(q, papers, R.SearchOptions(top_k=2, min_similarity=0.0, scorer=length_scorer)).collect()
    assert [r["doc_id"] for r in sorted(res, key=lambda r: r["rank"])] == [1, 2]   # longer text first
    summ = PL.summarizer(lambda: (lambda ti, ab: [None if t == "beta" else "S:" + t for t in ti]), "toy")
    cache = spark.createDataFrame([], "key string, summary string, ts timestamp, title string")
    got = {r["doc_id"]: (r["summary"], r["cached"]) for r in SU.lookup(papers, cache, summ).collect()}
    assert got[1] == ("S:alpha", False)
    assert got[2] == ("beta delta.", False)          # backend failed -> rule-based summary


def test_index_with_plugged_encoder(spark, tmp_path):
    papers = spark.createDataFrame([("a1", "t", "abc"), ("a2", "t", "xyz")], "id string, title string, combined_text string")
    path = str(tmp_path / "idx")
    assert INC.build_index(papers, path, encoder=PL.encoder(make_letter_encoder(), "letters"), model="letters")
    v = INC.read_index(spark, path)
    assert v.where(F.col("model") == "letters").count() == 2
