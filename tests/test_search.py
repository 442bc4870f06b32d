"""Search behaviour on a small hand-made corpus."""

import datetime as dt
from dataclasses import replace

from pyspark.sql import functions as F

from papyra.functions import encode as E
from papyra.operators import retrieval as R

DOCS = [
    (1, "Deep learning for vision", "machine learning methods for computer vision and images"),
    (2, "Graph neural networks", "graph neural networks for molecules and node classification"),
    (3, "Cooking pasta", "how to cook pasta with tomato sauce"),
    (4, "Learning to learn", "machine learning and artificial intelligence with meta learning"),
    (5, "Undated vision", "computer vision image recognition with convolutional networks"),
]


def papers(spark):
    rows = []
    for i, t, a in DOCS:
        d = None if i == 5 else dt.datetime(2023, i, 1)
        rows.append((i, f"2301.{i:05d}", t, a, f"{t}. {a}", ["cs.AI"] if i % 2 else ["cs.CV"], d, ["Au"]))
    return spark.createDataFrame(rows, "doc_id long, id string, title string, abstract string, "
                                       "combined_text string, categories array<string>, "
                                       "update_date timestamp, authors array<string>")


def test_expansion_cases(spark):
    q = spark.createDataFrame([("ml",), ("ML for vision",), ("ml, ai",), ("graph neural networks",), ("",),
                               ("ai ml",)], "q string")
    got = [r["e"] for r in q.select(E.expand_query("q").alias("e")).collect()]
    assert got == ["ml machine learning", "ML for vision machine learning", "ml, ai artificial intelligence",
                   "graph neural networks neural network deep learning artificial intelligence", "",
                   "ai ml machine learning artificial intelligence"]


def test_search_contract(spark):
    p = papers(spark)
    q = spark.createDataFrame([(1, "machine learning vision"), (2, "   "), (3, "pasta")], "query_id long, query string")
    opts = R.SearchOptions(top_k=3, use_reranking=True, min_similarity=0.0)
    res = R.search(q, p, opts)
    rows = res.collect()
    assert {r["query_id"] for r in rows} <= {1, 3}             # blank query answers nothing
    for qid in (1, 3):
        ranks = [r["rank"] for r in rows if r["query_id"] == qid]
        assert sorted(ranks) == list(range(1, len(ranks) + 1)) and len(ranks) <= 3
    top = {r["query_id"]: r["document_id"] for r in rows if r["rank"] == 1}
    assert top[3] == "2301.00003"
    assert all(r["abstract_url"] == "https://arxiv.org/abs/" + r["arxiv_id"] for r in rows)
    env = {r["query_id"]: r for r in R.envelope(q, res).collect()}
    assert env[2]["total_results"] == 0 and env[2]["average_similarity"] == 0.0
    assert abs(env[2]["estimated_cost"] - 0.0016) < 1e-12


def test_filters_pre_and_post(spark):
    p = papers(spark)
    q = spark.createDataFrame([(1, "computer vision images")], "query_id long, query string")
    base = R.SearchOptions(top_k=2, use_reranking=False, min_similarity=0.0, category_filter=("cs.CV",))
    post = R.search(q, p, base).collect()
    pre = R.search(q, p, replace(base, filter_mode="pre")).collect()
    assert all("cs.CV" in r["categories"] for r in post + pre)
    assert len(pre) >= len(post)
    dated = replace(base, category_filter=None, start_date=dt.date(2023, 3, 1))
    got = {r["doc_id"] for r in R.search(q, p, replace(dated, top_k=5)).collect()}
    assert 5 in got and 1 not in got and 2 not in got           # null dates pass, early dates do not


def test_rerank_subset_and_threshold(spark):
    p = papers(spark)
    q = spark.createDataFrame([(1, "learning")], "query_id long, query string")
    plain = R.search(q, p, R.SearchOptions(top_k=5, use_reranking=False, min_similarity=0.0))
    rer = R.search(q, p, R.SearchOptions(top_k=5, use_reranking=True, min_similarity=0.0))
    assert {r["doc_id"] for r in rer.collect()} <= {r["doc_id"] for r in plain.collect()} | {3, 5}
    strict = R.search(q, p, R.SearchOptions(top_k=5, use_reranking=True, min_similarity=0.99)).collect()
    assert all(r["similarity_score"] >= 0.99 for r in strict)


def test_no_text_is_shuffled_by_query_before_the_cut(spark):
    from papyra.operators import retrieval as R
    papers = spark.createDataFrame([(i, f"id{i}", f"title {i}", f"deep network number {i}", ["a"], ["c"]) for i in range(20)],
                                   "doc_id long, id string, title string, abstract string, authors array<string>, categories array<string>") \
        .selectExpr("*", "timestamp'2024-01-01' AS update_date")
    queries = spark.createDataFrame([(1, "deep network"), (2, "number 7")], "query_id int, query string")
    for opts in (R.SearchOptions(), R.SearchOptions(use_reranking=False), R.SearchOptions(scorer=lambda q, t: q.substr(1, 1).cast("double"))):
        narrow = R.candidates(queries, R.prepare_corpus(papers), opts)
        assert not {"title", "abstract", "authors", "categories", "_text"} & set(narrow.columns)
        plan = R.search(queries, papers, opts)._jdf.queryExecution().optimizedPlan().toString()
        windows = [line for line in plan.splitlines() if "Window [" in line]
        # texts come in above all windows: those are below the join that brings them
        depth = [len(line) - len(line.lstrip(" :+-")) for line in plan.splitlines() if "abstract" in line and "Relation" in line]
        assert windows and depth
        for line in windows:
            assert "abstract" not in line


def test_rerank_agreement_writes_no_texts(spark, monkeypatch, tmp_path):
    """Both runs share the papers that were hit, and of their results no text is written."""
    from papyra.plans import q_results as QR

    spark.createDataFrame([(i, f"{t}\n{a}", "en", "src1", 100) for i, t, a in DOCS],
                          "doc_id long, text string, lang string, source string, n_chars long") \
        .write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 0, "user", "machine learning vision"), (2, 0, "user", "pasta"), (3, 0, "user", " ")],
                          "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    written, materialize = [], R.materialize

    def noted(df, name="table"):
        written.append((name, df.columns))
        return materialize(df, name)
    monkeypatch.setattr(R, "materialize", noted)
    row = QR.rerank_agreement(spark, str(tmp_path)).first()
    assert 0 <= row["mean_agreement"] <= 1
    assert abs(row["mean_agreement"] + row["reranking_changes_results"] - 1) < 1e-6
    assert [n for n, _ in written].count("hit-papers") == 1
    results = [c for n, c in written if n == "results"]
    assert len(results) == 2 and all(set(c).isdisjoint({"title", "abstract", "ai_summary"}) for c in results)


def _small_tables(spark, path):
    spark.createDataFrame([(i, f"{t}\n{a}", "en", "src1", 100) for i, t, a in DOCS],
                          "doc_id long, text string, lang string, source string, n_chars long") \
        .write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, 0, "user", "machine learning vision"), (2, 0, "user", "pasta"), (3, 0, "user", " ")],
                          "conv_id long, turn long, role string, text string").write.parquet(f"{path}/conversations.parquet")


def test_paper_tokens_are_dealt_by_paper_only(spark, monkeypatch):
    """The join that brings a paper's tokens is the last before the score, so they are in no
    shuffle by query, and the pairs are written without them."""
    written, materialize = {}, R.materialize

    def noted(df, name="table"):
        written[name] = df
        return materialize(df, name)
    monkeypatch.setattr(R, "materialize", noted)
    q = spark.createDataFrame([(1, "machine learning vision"), (3, "pasta")], "query_id long, query string")
    found = R.candidates(q, R.prepare_corpus(papers(spark)), R.SearchOptions())
    assert found.count() == 10
    assert not {"_q", "_text", "query"} & set(written["pairs"].columns)
    joins = [line for line in written["pairs"]._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join Inner" in line]
    assert "doc_id" in joins[0] and "query_id" in joins[1]


def test_results_are_written_without_texts(spark, monkeypatch, tmp_path):
    """Profiles, digests and prompts read the results several times; what is written of them
    is what they read, with the rows that whole results give."""
    from papyra.operators import results as RS
    from papyra.plans import q_results as QR
    from papyra.plans import q_search as QS

    _small_tables(spark, tmp_path)
    q, at = QS.queries_table(spark, str(tmp_path)), str(tmp_path)
    whole = R.materialize(QS.run_search(spark, at, QS.DEFAULT), "whole")
    written, materialize = [], R.materialize

    def noted(df, name="table"):
        back = materialize(df, name)
        if name == "results":
            written.append(back)
        return back
    monkeypatch.setattr(R, "materialize", noted)
    rows = lambda df: sorted(map(str, df.collect()))
    for got, want in ((QR.diversity_profile, RS.diversity_profile(whole)), (QR.result_summary, RS.result_summary(whole)),
                      (QR.relevance_profile, RS.relevance_profile(whole)), (QR.batch_digest, RS.batch_digest(q, whole, QR.ASOF)),
                      (QR.batch_prompt, RS.batch_prompt(q, whole))):
        assert rows(got(spark, at)) == rows(want)
    assert len(rows(QR.search_overview(spark, at))) == 3
    assert len(written) == 6
    for back in written:
        if "abstract" in back.columns:
            assert back.where("abstract IS NOT NULL AND ai_summary <> ''").count() == 0
        elif "title" in back.columns:
            assert back.where("title IS NOT NULL AND rank > 1 OR length(ai_summary) > 1").count() == 0
