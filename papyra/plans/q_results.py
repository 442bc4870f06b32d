"""Queries over summaries and search results: extractive summaries,
snippets, the summary cache, digests, prompts, bands, histograms and the
benchmark profiles."""

from __future__ import annotations

import datetime as dt
import uuid
from dataclasses import replace

from pyspark.sql import functions as F

from papyra.functions import text as T
from papyra.operators import results as RS
from papyra.operators import retrieval as R
from papyra.operators import summaries as SU
from papyra.plans import adapters as A
from papyra.plans import sqlsearch as Q
from papyra.plans import sqltext as S
from papyra.plans.catalog import register
from papyra.plans.q_ingest import papers
from papyra.plans.q_search import DEFAULT, corpus, queries_table, run_search
from papyra.session import scratch_path
from papyra.streaming import cachestate as CS


def results_table(spark, sf_dir, rows, opts=DEFAULT, q=None):
    """Search results written once (queries x k rows) for consumers that read
    them several times; ``rows(results)`` selects what these read."""
    q = q if q is not None else queries_table(spark, sf_dir)
    return R.materialize(rows(R.search(q, None, opts, corpus=corpus(spark, sf_dir))), "results")


ASOF = dt.date(2024, 12, 31)
WP = S.with_papers()
NO_SUMMARY = replace(DEFAULT, generate_summaries=False)
PLAIN = replace(DEFAULT, use_reranking=False)


@register("summary_rule", WP + f"SELECT doc_id, {S.rule_summary('abstract')} AS summary FROM papers")
def summary_rule(spark, sf_dir):
    return papers(spark, sf_dir).select("doc_id", T.rule_summary("abstract").alias("summary"))


@register("snippet", WP + f"""SELECT doc_id, {S.snippet('abstract', None, 200)} AS snippet_200,
  {S.snippet('abstract', None, 100)} AS snippet_100 FROM papers""")
def snippet(spark, sf_dir):
    return papers(spark, sf_dir).select("doc_id", T.snippet("abstract", None, 200).alias("snippet_200"),
                                        T.snippet("abstract", None, 100).alias("snippet_100"))


@register("summary_budget", Q.with_search(NO_SUMMARY) + f"""SELECT query_id, rank, doc_id,
  ({S.rule_summary('abstract')} <> '' AND row_number() OVER (PARTITION BY query_id,
   {S.rule_summary('abstract')} <> '' ORDER BY rank) <= 5) AS gets_summary FROM res""")
def summary_budget(spark, sf_dir):
    res = run_search(spark, sf_dir, NO_SUMMARY)
    return SU.summary_budget(res).select("query_id", "rank", "doc_id", "gets_summary")


def cache_table(spark, sf_dir):
    """Summaries an earlier run stored: papers labelled quality = 1."""
    lab = A.table(spark, sf_dir, "labels").where(F.col("quality") == 1).select("doc_id")
    p = papers(spark, sf_dir).join(lab, "doc_id", "left_semi")
    return SU.with_keys(p).select(
        "key", T.snippet("abstract", None, 150).alias("summary"),
        (F.lit("2024-01-01").cast("timestamp") + F.make_interval(days=(F.col("doc_id") % 365).cast("int")))
        .alias("ts"), "title")


CACHE_SQL = (f"cache AS (SELECT {S.cache_key('title', 'abstract')} AS key, {S.snippet('abstract', None, 150)} "
             f"AS summary, TIMESTAMP '2024-01-01 00:00:00' + to_days(CAST(doc_id % 365 AS INTEGER)) AS ts, title "
             f"FROM papers WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1))")
LATEST_SQL = ("latest AS (SELECT * EXCLUDE (n) FROM (SELECT *, row_number() OVER (PARTITION BY key "
              "ORDER BY ts DESC, summary DESC) AS n FROM cache) WHERE n = 1)")


@register("cache_lookup", S.with_papers(extra=CACHE_SQL + ",\n" + LATEST_SQL) + f"""
SELECT p.doc_id, {S.cache_key('p.title', 'p.abstract')} AS key, l.summary IS NOT NULL AS cached,
  coalesce(l.summary, {S.rule_summary('p.abstract')}) AS summary
FROM papers p LEFT JOIN latest l ON l.key = {S.cache_key('p.title', 'p.abstract')}""")
def cache_lookup(spark, sf_dir):
    """Cached summary when the key is present, else the rule summary."""
    out = SU.lookup(papers(spark, sf_dir), cache_table(spark, sf_dir))
    return out.select("doc_id", "key", "cached", "summary")


NEW_SQL = (f"new AS (SELECT {S.cache_key('title', 'abstract')} AS key, {S.rule_summary('abstract')} AS summary, "
           f"TIMESTAMP '2024-06-01 00:00:00' + to_days(CAST(doc_id % 200 AS INTEGER)) AS ts, title FROM papers "
           f"WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 0))")


@register("cache_upsert", S.with_papers(extra=CACHE_SQL + ",\n" + NEW_SQL) + """
SELECT key, summary, ts, title FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts DESC, summary DESC) AS n
  FROM (SELECT * FROM cache UNION ALL SELECT * FROM new)) WHERE n = 1""")
def cache_upsert(spark, sf_dir):
    """New summaries (papers labelled non-toxic) merged into the cache;
    newest entry per key wins."""
    lab = A.table(spark, sf_dir, "labels").where(F.col("toxic") == 0).select("doc_id")
    p = papers(spark, sf_dir).join(lab, "doc_id", "left_semi")
    new = SU.with_keys(p).select(
        "key", T.rule_summary("abstract").alias("summary"),
        (F.lit("2024-06-01").cast("timestamp") + F.make_interval(days=(F.col("doc_id") % 200).cast("int")))
        .alias("ts"), "title")
    return SU.upsert(cache_table(spark, sf_dir), new)


CACHE_STATE_SQL = S.with_papers(extra=CACHE_SQL + ",\n" + NEW_SQL) + """
SELECT key, summary, ts, title FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts DESC, summary DESC) AS n
  FROM (SELECT * FROM cache UNION ALL SELECT * FROM new)) WHERE n = 1"""


@register("cache_state", CACHE_STATE_SQL)
def cache_state(spark, sf_dir):
    """The cache as keyed stream state after three arrivals: new summaries, then older
    ones (late) with some of the new ones again (equal), then the second again."""
    base = scratch_path(spark, f"cache-state-{uuid.uuid4().hex}")
    lab = A.table(spark, sf_dir, "labels").where(F.col("toxic") == 0).select("doc_id")
    p = papers(spark, sf_dir).join(lab, "doc_id", "left_semi")
    new = R.materialize(SU.with_keys(p).select(
        "key", T.rule_summary("abstract").alias("summary"),
        (F.lit("2024-06-01").cast("timestamp") + F.make_interval(days=(F.col("doc_id") % 200).cast("int")))
        .alias("ts"), "title"), "new-entries")
    late = cache_table(spark, sf_dir).unionByName(new.where(F.pmod(F.xxhash64("key"), F.lit(3)) == 0))
    for part in (new, late, late):
        part.write.mode("append").json(f"{base}/in")
        CS.start_cache_state(spark, f"{base}/in", f"{base}/ck").awaitTermination()
    return CS.cache_state(spark, f"{base}/ck")


def _digest_sql() -> str:
    return Q.with_search(DEFAULT) + f"""
, cats AS (SELECT query_id, cat, count(*) AS n FROM (SELECT query_id, unnest(categories) AS cat FROM res WHERE rank <= 10)
  GROUP BY ALL),
top5 AS (SELECT query_id, string_agg(printf('%s (%d)', cat, n), ', ' ORDER BY r) AS areas FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY n DESC, cat) AS r FROM cats) WHERE r <= 5 GROUP BY query_id),
per AS (SELECT query_id, count(*) AS n, count_if(pdf_available) AS pdfs,
  count_if(ai_summary IS NOT NULL AND ai_summary <> '') AS with_summaries,
  count_if(year(CAST(update_date AS TIMESTAMP)) >= {ASOF.year - 2}) AS recent,
  arg_min(title, rank) AS top_title, arg_min(similarity_score, rank) AS top_score FROM res GROUP BY query_id)
SELECT q.query_id, CASE WHEN per.n IS NULL THEN 'No papers found.' ELSE printf('Found %d papers related to ''%s''. ', n, q.query) || printf('%d PDFs available. ', pdfs)
  || CASE WHEN with_summaries > 0 THEN printf('%d with AI summaries. ', with_summaries) ELSE '' END
  || CASE WHEN areas IS NOT NULL THEN 'Main areas: ' || areas || '. ' ELSE '' END
  || CASE WHEN recent > 0 THEN printf('%d from last 2 years. ', recent) ELSE '' END
  || 'Top result: ''' || top_title || ''' (score: ' || printf('%.3f', top_score) || ').' END AS digest
FROM qs q LEFT JOIN per ON q.query_id = per.query_id LEFT JOIN top5 ON top5.query_id = q.query_id"""


@register("batch_digest", _digest_sql())
def batch_digest(spark, sf_dir):
    q = queries_table(spark, sf_dir)
    return RS.batch_digest(q, results_table(spark, sf_dir, RS.digest_rows, DEFAULT, q), ASOF)


@register("prompt_table", WP + f"""SELECT doc_id, {S.q(T.INDIVIDUAL_SUMMARY_PROMPT.split('{title}')[0])}
  || title || {S.q(T.INDIVIDUAL_SUMMARY_PROMPT.split('{title}')[1].split('{abstract}')[0])}
  || left(abstract, 1000) || {S.q(T.INDIVIDUAL_SUMMARY_PROMPT.split('{abstract}')[1])} AS prompt FROM papers""")
def prompt_table(spark, sf_dir):
    """The per-paper summary prompt, for an external model job."""
    return papers(spark, sf_dir).select("doc_id", T.individual_prompt("title", "abstract").alias("prompt"))


def _batch_prompt_sql() -> str:
    head, rest = T.BATCH_SUMMARY_PROMPT.split("{count}")
    mid, rest = rest.split("{query}")
    mid2, tail = rest.split("{papers_info}")
    info = (f"{{'title': title, 'summary': {S.snippet('abstract', 'ai_summary', 100)}, "
            f"'categories': list_slice(categories, 1, 2), 'score': similarity_score}}")
    return Q.with_search(DEFAULT) + f"""
, firsts AS (SELECT query_id, to_json(list({info} ORDER BY rank)) AS j FROM res WHERE rank <= 5 GROUP BY query_id),
cnt AS (SELECT query_id, count(*) AS n FROM res GROUP BY query_id)
SELECT q.query_id, {S.q(head)} || CAST(c.n AS VARCHAR) || {S.q(mid)} || q.query || {S.q(mid2)}
  || left(f.j, 1500) || {S.q(tail)} AS prompt
FROM qs q LEFT JOIN cnt c ON q.query_id = c.query_id LEFT JOIN firsts f ON f.query_id = q.query_id"""


@register("batch_prompt", _batch_prompt_sql())
def batch_prompt(spark, sf_dir):
    q = queries_table(spark, sf_dir)
    return RS.batch_prompt(q, results_table(spark, sf_dir, RS.prompt_rows, DEFAULT, q))


DISPLAY = "least(greatest(CASE WHEN similarity_score > 1.0 THEN least(similarity_score / 10.0, 1.0) ELSE similarity_score END, 0.0), 1.0)"


@register("score_bands", Q.with_search(DEFAULT) + f"""SELECT query_id, rank, {DISPLAY} AS display_score,
  CASE WHEN {DISPLAY} > 0.7 THEN 'High Match' WHEN {DISPLAY} > 0.5 THEN 'Good Match' ELSE 'Fair Match' END AS band FROM res""")
def score_bands(spark, sf_dir):
    return RS.score_bands(run_search(spark, sf_dir, DEFAULT))


@register("score_histogram", Q.with_search(DEFAULT) + f"""SELECT CAST(least(15, floor({DISPLAY} * 15) + 1) AS INTEGER) AS bin,
  count(*) AS n FROM res GROUP BY ALL""")
def score_histogram(spark, sf_dir):
    return RS.score_histogram(run_search(spark, sf_dir, DEFAULT))


@register("result_summary", Q.with_search(DEFAULT) + f"""
, b AS (SELECT query_id, count(*) AS n, round(avg({DISPLAY}), 6) AS avg_score, round(max({DISPLAY}), 6) AS max_score
  FROM res GROUP BY query_id HAVING count(*) >= 2),
c AS (SELECT query_id, count(DISTINCT x) AS unique_categories FROM (SELECT query_id, unnest(categories) AS x FROM res) GROUP BY ALL),
a AS (SELECT query_id, count(DISTINCT x) AS unique_authors FROM (SELECT query_id, unnest(authors) AS x FROM res) GROUP BY ALL)
SELECT b.query_id, b.n, avg_score, max_score, coalesce(unique_categories, 0) AS unique_categories,
  coalesce(unique_authors, 0) AS unique_authors FROM b LEFT JOIN c USING (query_id) LEFT JOIN a USING (query_id)""")
def result_summary(spark, sf_dir):
    return RS.result_summary(results_table(
        spark, sf_dir, lambda res: res.select("query_id", "similarity_score", "categories", "authors")))


@register("relevance_profile", Q.with_search(DEFAULT) + """
, pq AS (SELECT query_id, arg_min(similarity_score, rank) AS top1,
  avg(CASE WHEN rank <= 5 THEN similarity_score END) AS top5 FROM res GROUP BY query_id)
SELECT round(avg(similarity_score), 6) AS mean_all_scores, round(min(similarity_score), 6) AS min_score,
  round(max(similarity_score), 6) AS max_score, round(avg(CAST(similarity_score > 0.7 AS DOUBLE)), 6) AS share_above_0_7,
  round(avg(CAST(similarity_score > 0.5 AS DOUBLE)), 6) AS share_above_0_5,
  round((SELECT avg(top1) FROM pq), 6) AS mean_top1_score, round((SELECT avg(top5) FROM pq), 6) AS mean_top5_score
FROM res""")
def relevance_profile(spark, sf_dir):
    return RS.relevance_profile(results_table(spark, sf_dir, lambda res: res.select("query_id", "rank", "similarity_score")))


@register("diversity_profile", Q.with_search(DEFAULT) + """
, c AS (SELECT query_id, count(DISTINCT x) AS nc FROM (SELECT query_id, unnest(categories) AS x FROM res) GROUP BY ALL),
a AS (SELECT query_id, count(DISTINCT x) AS na FROM (SELECT query_id, unnest(authors) AS x FROM res) GROUP BY ALL),
pq AS (SELECT q.query_id, coalesce(nc, 0) AS nc, coalesce(na, 0) AS na FROM (SELECT DISTINCT query_id FROM res) q
  LEFT JOIN c USING (query_id) LEFT JOIN a USING (query_id))
SELECT round(avg(nc), 6) AS mean_category_diversity, round(avg(na), 6) AS mean_author_diversity,
  min(nc) AS min_categories, max(nc) AS max_categories FROM pq""")
def diversity_profile(spark, sf_dir):
    return RS.diversity_profile(results_table(spark, sf_dir, lambda res: res.select("query_id", "categories", "authors")))


def _agreement_sql() -> str:
    ctes = [S.raw_cte(), S.flagged_cte(), S.papers_cte(), Q.QUERIES_CTE]
    ctes += Q.search_ctes(PLAIN, tag="a") + Q.search_ctes(DEFAULT, tag="b")
    return "WITH " + ",\n".join(ctes) + """
, common AS (SELECT a.query_id, count(*) AS common FROM resa a JOIN resb b ON a.query_id = b.query_id AND a.doc_id = b.doc_id
  GROUP BY a.query_id),
pq AS (SELECT q.query_id, coalesce(c.common, 0) / 10.0 AS agreement,
  (b1.similarity_score - a1.similarity_score) / nullif(a1.similarity_score, 0) AS improvement
  FROM (SELECT query_id FROM qs WHERE NOT """ + S.is_blank("query") + """) q
  LEFT JOIN common c ON c.query_id = q.query_id
  LEFT JOIN (SELECT * FROM resa WHERE rank = 1) a1 ON a1.query_id = q.query_id
  LEFT JOIN (SELECT * FROM resb WHERE rank = 1) b1 ON b1.query_id = q.query_id)
SELECT round(avg(agreement), 6) AS mean_agreement, round(avg(improvement), 6) AS mean_score_improvement,
  round(1 - avg(agreement), 6) AS reranking_changes_results FROM pq"""


@register("rerank_agreement", _agreement_sql())
def rerank_agreement(spark, sf_dir):
    """Same queries with and without rerank: overlap / 10, top-score change."""
    q = queries_table(spark, sf_dir).where(~T.is_blank("query"))
    c = corpus(spark, sf_dir)
    qv = R.query_vectors(q, expand=True)
    hits = R.materialize(R.retrieve(qv, c, max(PLAIN.pool, DEFAULT.pool)), "hits")      # one scan for both runs
    wide = R.hit_papers(c, hits.select("doc_id").distinct(), DEFAULT)
    # of the results only what is compared is written, no texts
    a, b = (R.materialize(R.search(q, None, o, corpus=c, hits=hits.where(F.col("rank") <= o.pool), wide=wide)
                          .select("query_id", "rank", "doc_id", "similarity_score"), "results") for o in (PLAIN, DEFAULT))
    return RS.rerank_agreement(q, a, b, DEFAULT.k)


@register("latency_profile", """SELECT event_type, round(avg(value), 6) AS mean_latency_ms,
  round(median(value), 6) AS median_latency_ms, round(stddev_pop(value), 6) AS std_latency_ms,
  min(value) AS min_latency_ms, max(value) AS max_latency_ms, count(value) AS total_queries
FROM events GROUP BY event_type""")
def latency_profile(spark, sf_dir):
    """Timing profile per event type over the events log."""
    return RS.latency_profile(A.table(spark, sf_dir, "events"), "value", ["event_type"])


@register("cost_column", Q.with_search(DEFAULT) + """SELECT q.query_id, coalesce(r.n, 0) AS total_results,
  round((least(coalesce(r.n, 0), 5) * 350 + 800) / 1000.0 * 0.002, 8) AS estimated_cost
FROM qs q LEFT JOIN (SELECT query_id, count(*) AS n FROM res GROUP BY query_id) r ON r.query_id = q.query_id""")
def cost_column(spark, sf_dir):
    q = queries_table(spark, sf_dir)
    res = R.search(q, None, DEFAULT, corpus=corpus(spark, sf_dir))
    n = res.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    out = q.select("query_id").join(n, "query_id", "left")
    total = F.coalesce("n", F.lit(0))
    return out.select("query_id", total.alias("total_results"),
                      R.cost_per_search(total).alias("estimated_cost"))


@register("search_overview", _digest_sql().rsplit("\nSELECT q.query_id, CASE", 1)[0] + """
, env AS (SELECT query_id, count(*) AS n, count(ai_summary) AS s, count_if(pdf_available) AS d,
  avg(similarity_score) AS a, string_agg(document_id, '|' ORDER BY rank) AS results FROM res GROUP BY query_id),
dig AS (SELECT q.query_id, CASE""" + _digest_sql().rsplit("\nSELECT q.query_id, CASE", 1)[1] + """)
SELECT q.query_id, coalesce(e.results, '') AS results, g.digest AS overview, coalesce(e.n, 0) AS total_results,
  coalesce(e.d, 0) AS downloadable_pdfs, coalesce(e.s, 0) AS ai_summaries_count,
  round((least(coalesce(e.n, 0), 5) * 350 + 800) / 1000.0 * 0.002, 8) AS estimated_cost,
  round(coalesce(e.a, 0.0), 6) AS average_similarity, TRUE AS used_reranking
FROM qs q LEFT JOIN env e ON e.query_id = q.query_id JOIN dig g ON g.query_id = q.query_id""")
def search_overview(spark, sf_dir):
    """One row per query: results, overview, totals, cost."""
    out = R.search_overview(queries_table(spark, sf_dir), None, ASOF, DEFAULT, corpus=corpus(spark, sf_dir))
    return out.drop("query").withColumn("results", F.array_join("results", "|"))
