"""Search queries: expansion, rerank, full search, filters, envelopes."""

from __future__ import annotations

import datetime as dt
import uuid
from dataclasses import replace

from pyspark.sql import functions as F

from papyra.functions import encode as E
from papyra.functions import vectors as V
from papyra.operators import celltree as C
from papyra.operators import papers as P
from papyra.operators import retrieval as R
from papyra.plans import adapters as A
from papyra.plans import sqlsearch as Q
from papyra.plans import sqltext as S
from papyra.plans.catalog import register
from papyra.plans.q_ingest import papers
from papyra.session import scratch_path

DEFAULT = R.SearchOptions()
FILTERED = R.SearchOptions(category_filter=("src3", "src7", "src11"), start_date=dt.date(2023, 6, 1),
                           end_date=dt.date(2024, 6, 30), use_reranking=False)
PRE = replace(FILTERED, filter_mode="pre")


def queries_table(spark, sf_dir):
    """User turns of the conversations table as search queries."""
    c = A.table(spark, sf_dir, "conversations")
    return c.where(F.col("role") == "user").select(
        (F.col("conv_id") * 100 + F.col("turn")).alias("query_id"), F.col("text").alias("query"))


def _out(df):
    return df.select("query_id", "rank", "candidate_rank", "doc_id", "document_id", "title",
                     "similarity_score", "update_date", "arxiv_id", "abstract_url", "pdf_url",
                     "pdf_available", "ai_summary", F.array_join("authors", "|").alias("authors"),
                     F.array_join("categories", "|").alias("categories"))


def corpus(spark, sf_dir, **index):
    """The papers of ``documents``; hit papers are cleaned after the semi-join."""
    raw = A.raw_papers(spark, sf_dir)
    return R.prepare_corpus(papers(spark, sf_dir), rows_of=lambda ids: P.build_papers(
        raw.join(ids, "doc_id", "left_semi"), language=None), **index)


def run_search(spark, sf_dir, opts):
    return R.search(queries_table(spark, sf_dir), None, opts, corpus=corpus(spark, sf_dir))


@register("query_expand", f"""WITH {Q.QUERIES_CTE}
SELECT query_id, {S.expand_query('query')} AS expanded FROM qs""")
def query_expand(spark, sf_dir):
    q = queries_table(spark, sf_dir)
    return q.select("query_id", E.expand_query("query").alias("expanded"))


@register("query_expand_vector", "WITH " + ",\n".join(
    [Q.QUERIES_CTE, Q.search_ctes(DEFAULT)[0], S.encode_cte("qe1", "qx", "query_id", "query"),
     S.encode_cte("qe2", "qx", "query_id", "expanded"), Q.search_ctes(DEFAULT)[3]]) + """
SELECT * FROM (SELECT query_id, CAST(generate_subscripts(qvec, 1) - 1 AS INTEGER) AS bucket,
  round(unnest(qvec), 6) AS weight FROM qv) WHERE weight <> 0""")
def query_expand_vector(spark, sf_dir):
    """0.7 * enc(query) + 0.3 * enc(expanded query), nonzero buckets."""
    qv = R.query_vectors(queries_table(spark, sf_dir), expand=True)
    out = qv.select("query_id", F.posexplode("qvec").alias("bucket", "weight")) \
        .withColumn("weight", V.round_score("weight"))
    return out.where(F.col("weight") != 0)


@register("search_full", Q.with_search(DEFAULT) + f"SELECT {Q.RESULT_COLS} FROM res")
def search_full(spark, sf_dir):
    """Expansion, rerank of the top 50, threshold 0.3, 10 results, summaries."""
    return _out(run_search(spark, sf_dir, DEFAULT))


@register("knn_filtered_post", Q.with_search(FILTERED) + f"SELECT {Q.RESULT_COLS} FROM res")
def knn_filtered_post(spark, sf_dir):
    """Category and date filters after a x3 candidate fetch (reference meaning)."""
    return _out(run_search(spark, sf_dir, FILTERED))


@register("knn_filtered_pre", Q.with_search(PRE) + f"SELECT {Q.RESULT_COLS} FROM res")
def knn_filtered_pre(spark, sf_dir):
    """Same filters applied to the corpus before the top-k (full recall)."""
    return _out(run_search(spark, sf_dir, PRE))


RERANK_ONLY = replace(DEFAULT, min_similarity=0.0, generate_summaries=False)


@register("rerank", Q.with_search(RERANK_ONLY) + """SELECT query_id, doc_id, similarity_score AS score,
  candidate_rank AS rank FROM res""")
def rerank(spark, sf_dir):
    """Two-stage retrieval: top-50 cosine candidates re-scored by the pair
    scorer, min-max normalised; first 10 per query."""
    r = run_search(spark, sf_dir, RERANK_ONLY)
    return r.select("query_id", "doc_id", F.col("similarity_score").alias("score"),
                    F.col("candidate_rank").alias("rank"))


@register("minmax_norm", "WITH " + ",\n".join(
    [S.raw_cte(), S.flagged_cte(), S.papers_cte(), Q.QUERIES_CTE] + Q.search_ctes(DEFAULT)[:8]) + """
SELECT query_id, doc_id, raw, round((raw - min(raw) OVER w) / (max(raw) OVER w - min(raw) OVER w + 1e-8), 6) AS norm_score
FROM pairs WINDOW w AS (PARTITION BY query_id)""")
def minmax_norm(spark, sf_dir):
    """Raw pair scores of the rerank candidates and their min-max normal form."""
    cand = R.candidates(queries_table(spark, sf_dir), corpus(spark, sf_dir), DEFAULT)
    return cand.select("query_id", "doc_id", "raw", F.col("score").alias("norm_score"))


@register("search_envelope", Q.with_search(DEFAULT) + f"""SELECT q.query_id,
  coalesce(r.n, 0) AS total_results, coalesce(r.s, 0) AS ai_summaries_count, coalesce(r.d, 0) AS downloadable_pdfs,
  round(coalesce(r.a, 0.0), 6) AS average_similarity,
  round((least(coalesce(r.n, 0), 5) * 350 + 800) / 1000.0 * 0.002, 8) AS estimated_cost
FROM qs q LEFT JOIN (SELECT query_id, count(*) AS n, count(ai_summary) AS s, count_if(pdf_available) AS d,
  avg(similarity_score) AS a FROM res GROUP BY query_id) r ON r.query_id = q.query_id""")
def search_envelope(spark, sf_dir):
    """Per query, also blank or hit-less ones: totals, mean score, cost."""
    q = queries_table(spark, sf_dir)
    res = R.search(q, None, DEFAULT, corpus=corpus(spark, sf_dir))
    return R.envelope(q, res)


def _method_sql():
    runs = [("basic", replace(DEFAULT, top_k=5, use_reranking=False, use_query_expansion=False)),
            ("expanded", replace(DEFAULT, top_k=5, use_reranking=False, use_query_expansion=True)),
            ("expanded_rerank", replace(DEFAULT, top_k=5, use_reranking=True, use_query_expansion=True))]
    ctes = [S.raw_cte(), S.flagged_cte(), S.papers_cte(), Q.QUERIES_CTE]
    selects = []
    for i, (name, o) in enumerate(runs):
        ctes += Q.search_ctes(o, tag=str(i))
        selects.append(f"SELECT '{name}' AS method, query_id, rank, doc_id, similarity_score FROM res{i}")
    return "WITH " + ",\n".join(ctes) + "\n" + "\nUNION ALL ".join(selects)


@register("method_compare", _method_sql())
def method_compare(spark, sf_dir):
    r = R.compare_methods(queries_table(spark, sf_dir), None, top_k=5, corpus=corpus(spark, sf_dir))
    return r.select("method", "query_id", "rank", "doc_id", "similarity_score")


YEARS = R.SearchOptions(years_back=1, use_reranking=False)


@register("knn_filtered_years", Q.with_search(YEARS) + f"SELECT {Q.RESULT_COLS} FROM res")
def knn_filtered_years(spark, sf_dir):
    """Date filter relative to the as-of date (last year; undated papers pass)."""
    return _out(run_search(spark, sf_dir, YEARS))


def cell_corpus(spark, sf_dir, tuned: bool = True):
    """The papers behind a stored cell index; its slack is tuned on about 256
    of the queries, chosen by hash, for 93 in 100 of their candidates."""
    path = scratch_path(spark, f"search-cells-{uuid.uuid4().hex}")
    v = R.doc_vectors(papers(spark, sf_dir)).select(F.col("doc_id").alias("id"), "vec")
    index = C.build(v, path)
    if tuned:
        qv = R.materialize(R.query_vectors(queries_table(spark, sf_dir), DEFAULT.use_query_expansion), "query-vectors")
        share = min(1.0, 256 / max(qv.count(), 1))
        sample = qv.where(F.pmod(F.xxhash64("query_id"), F.lit(1 << 30)) < int(share * (1 << 30)))
        index = C.tune(index, path, sample, DEFAULT.pool, recall=0.93, query_vec_col="qvec")
    return corpus(spark, sf_dir, cells=index)


@register("search_ivf_all", Q.with_search(DEFAULT) + f"SELECT {Q.RESULT_COLS} FROM res")
def search_ivf_all(spark, sf_dir):
    """The same index with its full covering angles: the rows of ``search_full``."""
    return _out(R.search(queries_table(spark, sf_dir), None, DEFAULT, corpus=cell_corpus(spark, sf_dir, tuned=False)))


def search_figures(spark, sf_dir):
    """One row of figures: what the tuned index keeps of ``search_full`` and what it reads."""
    q, found = queries_table(spark, sf_dir), cell_corpus(spark, sf_dir)
    full = R.materialize(run_search(spark, sf_dir, DEFAULT).select("query_id", "doc_id"), "full")
    qv = R.query_vectors(q, DEFAULT.use_query_expansion)
    hits, scored = C.search(found.cells, qv, DEFAULT.pool, query_vec_col="qvec")
    hits = R.materialize(hits.select("query_id", F.col("id").alias("doc_id"), F.col("score").alias("cosine"), "rank"), "hits")
    mine = R.search(q, None, DEFAULT, corpus=found, hits=hits).select("query_id", "doc_id")
    kept = full.join(mine, ["query_id", "doc_id"], "left_semi").agg(F.count(F.lit(1)).alias("kept"))
    n = found.cells.cells.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("cells"))
    return full.agg(F.count_distinct("query_id").alias("queries"), F.count(F.lit(1)).alias("results")) \
        .withColumn("recall", kept.scalar() / F.col("results")) \
        .withColumn("read_share", scored.agg((F.sum("scored") / F.count(F.lit(1))).alias("m")).scalar()
                    / n.select("n").scalar()) \
        .withColumn("vectors", n.select("n").scalar()) \
        .withColumn("cells_share", n.select("cells").scalar() / n.select("n").scalar()) \
        .withColumn("slack", F.lit(found.cells.slack))


@register("search_ivf", Q.with_search(DEFAULT) + """SELECT count(DISTINCT query_id) AS queries, count(*) AS results,
  TRUE AS recall_reached, TRUE AS under_a_third FROM res""")
def search_ivf(spark, sf_dir):
    """Full search over a trained, stored cell index with a tuned stop rule: does it keep
    0.9 of the results of ``search_full`` while a query is compared with under a third of
    the vectors (on tiny tables: with under twice the rows it asks for)?"""
    f = search_figures(spark, sf_dir)
    return f.select("queries", "results", (F.col("recall") >= 0.9).alias("recall_reached"),
                    (F.col("read_share") < F.greatest(F.lit(1 / 3), 2 * DEFAULT.pool / F.col("vectors"))).alias("under_a_third"))


SIMILAR = replace(DEFAULT, use_query_expansion=False, top_k=6)


def _similar_sql() -> str:
    qs = ("qs AS (SELECT doc_id AS query_id, id AS _self, " + S.rerank_text("title", "abstract") + " AS query FROM papers "
          "WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 0))")
    ctes = [S.raw_cte(), S.flagged_cte(None), S.papers_cte(), qs] + Q.search_ctes(SIMILAR)
    return "WITH " + ",\n".join(ctes) + """
SELECT query_id, doc_id, similarity_score, ai_summary, CAST(rn AS INTEGER) AS rank FROM (
  SELECT r.*, row_number() OVER (PARTITION BY r.query_id ORDER BY r.rank) AS rn
  FROM res r JOIN qs q ON q.query_id = r.query_id WHERE r.document_id <> q._self) WHERE rn <= 5"""


@register("similar_papers", _similar_sql())
def similar_papers(spark, sf_dir):
    """Papers like the probes (papers labelled low quality): rerank, summaries,
    threshold, the probe itself taken out."""
    probes = A.table(spark, sf_dir, "labels").where("quality = 0").select("doc_id")
    r = R.similar_papers(probes, None, 5, DEFAULT, corpus=corpus(spark, sf_dir))
    return r.select("query_id", "doc_id", "similarity_score", "ai_summary", "rank")
