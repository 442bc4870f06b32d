"""Source, sink, index-table and streaming queries.

Round trips write to the shared checkpoint folder (``spark.checkpoint.dir``)
and read back; where the read-back table equals something DuckDB can compute
from the driver tables, the oracle checks the values.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from papyra.operators import celltree as C
from papyra.operators import index as IX
from papyra.operators import knn as K
from papyra.operators import retrieval as R
from papyra.operators import sampling as SM
from papyra.operators import summaries as SU
from papyra.plans import adapters as A
from papyra.plans import sqltext as S
from papyra.plans.catalog import register
from papyra.plans.q_corpus import SAMPLE_N
from papyra.plans.q_ingest import PROJECTION_COLS, _projection_out, papers
from papyra.plans.q_results import CACHE_SQL, cache_table
from papyra.session import scratch_path
from papyra.sources import files as FS


def scratch(spark, name):
    return scratch_path(spark, f"{name}-{uuid.uuid4().hex}")


@register("jsonl_roundtrip", f"WITH {S.raw_cte()} SELECT id, title, update_date, authors FROM raw")
def jsonl_roundtrip(spark, sf_dir):
    """Raw records written as JSON lines plus one malformed line, read back
    with the declared schema; the bad line is skipped, not fatal."""
    path = scratch(spark, "raw-jsonl")
    raw = A.raw_papers(spark, sf_dir)
    FS.save_json_lines(raw, path)
    spark.createDataFrame([("{broken json",)], "value string").write.mode("append").text(path)
    back = FS.read_raw(spark, path, "jsonl")
    return FS.good_records(back).select("id", "title", "update_date", "authors")


@register("jsonl_skipped", "SELECT CAST(1 AS BIGINT) AS skipped, count(*) AS good FROM documents")
def jsonl_skipped(spark, sf_dir):
    path = scratch(spark, "raw-jsonl")
    FS.save_json_lines(A.raw_papers(spark, sf_dir), path)
    spark.createDataFrame([("{broken json",)], "value string").write.mode("append").text(path)
    back = FS.read_raw(spark, path, "jsonl")
    good = FS.good_records(back).agg(F.count(F.lit(1)).alias("good"))
    return FS.skipped_records(back).withColumn("good", good.scalar())


@register("papers_table_roundtrip", S.with_papers() + f"SELECT {PROJECTION_COLS} FROM papers")
def papers_table_roundtrip(spark, sf_dir):
    """Processed papers stored as Parquet and read back."""
    path = scratch(spark, "papers")
    FS.save_table(papers(spark, sf_dir), path)
    return _projection_out(FS.load_table(spark, path))


LATEST = ("latest AS (SELECT * EXCLUDE (n) FROM (SELECT *, row_number() OVER (PARTITION BY key "
          "ORDER BY ts DESC, summary DESC) AS n FROM cache) WHERE n = 1)")


@register("cache_file_roundtrip", S.with_papers(extra=CACHE_SQL + ",\n" + LATEST)
          + "SELECT key, summary, title FROM latest")
def cache_file_roundtrip(spark, sf_dir):
    """Summary cache written as JSON objects (bounded groups) and read back."""
    path = scratch(spark, "summary-cache")
    SU.write_cache_file(SU.latest_per_key(cache_table(spark, sf_dir)), path, entries_per_object=50)
    return SU.read_cache_file(spark, path, whole_file=False).select("key", "summary", "title")


@register("index_roundtrip", f"""WITH v2 AS ({S.vectors_cte('m64', 'm64')[len('m64 AS ('):-1]}
  UNION ALL {S.vectors_cte('m32', 'm32')[len('m32 AS ('):-1]})
SELECT model, count(*) AS total_vectors, CAST(max(len(vec)) AS INTEGER) AS dimension,
  count(DISTINCT label) AS n_clusters FROM v2 GROUP BY model""")
def index_roundtrip(spark, sf_dir):
    """Vectors of both models stored partitioned by (model, cluster_id), read
    back, summarised."""
    path = scratch(spark, "index")
    v = A.all_models(spark, sf_dir).withColumn("cluster_id", F.col("label").cast("long")).drop("label")
    IX.write_index(v, path)
    back, _ = IX.read_index(spark, path)
    return IX.index_stats(back)


@register("indexed_ids", "SELECT DISTINCT vec_id AS id FROM embeddings")
def indexed_ids(spark, sf_dir):
    return IX.indexed_ids(A.vectors(spark, sf_dir))


@register("union_dedupe", S.with_papers() + f"""SELECT DISTINCT id FROM (
  (SELECT id FROM papers ORDER BY md5(CAST(id AS VARCHAR) || '#42'), id LIMIT {SAMPLE_N})
  UNION ALL (SELECT id FROM papers ORDER BY update_date DESC NULLS LAST, id LIMIT {SAMPLE_N}))""")
def union_dedupe(spark, sf_dir):
    """Union of the random and the recent sample, one row per id."""
    p = papers(spark, sf_dir)
    both = SM.sample_random(p, SAMPLE_N).select("id").unionByName(SM.sample_recent(p, SAMPLE_N).select("id"))
    return IX.first_per_id(both, "id")


def ivf_figures(spark, sf_dir):
    """One row of figures: recall@10 of a tuned cell index over all vectors, and the share of the
    vectors that a query is compared with, tuned and with full covering angles."""
    v = A.vectors(spark, sf_dir)
    q, path = v.withColumnRenamed("id", "query_id"), scratch(spark, "cells")
    index = C.build(v, path)
    share = min(1.0, 256 / max(q.count(), 1))
    sample = q.where(F.pmod(F.xxhash64("query_id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    index = C.tune(index, path, sample, 10, recall=0.92)
    hits, scored = C.search(index, q, 10)
    _, scored_all = C.search(index, q, 10, slack=1.0)
    exact = R.materialize(K.exact_knn(v, q, 10).select("query_id", "id"), "exact")
    hit = exact.join(hits.select("query_id", "id"), ["query_id", "id"], "left_semi").agg(F.count(F.lit(1)).alias("h"))
    pairs = F.col("queries") * F.col("queries")
    return exact.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("query_id").alias("queries")) \
        .withColumn("recall", hit.scalar() / F.col("n")) \
        .withColumn("read_share", scored.agg(F.sum("scored").alias("s")).scalar() / pairs) \
        .withColumn("read_share_exact", scored_all.agg(F.sum("scored").alias("s")).scalar() / pairs) \
        .withColumn("slack", F.lit(index.slack)).drop("n")


@register("ivf_recall", """SELECT count(*) AS queries, TRUE AS recall_reached, TRUE AS under_a_third FROM embeddings""")
def ivf_recall(spark, sf_dir):
    """Does the tuned cell index keep 0.9 of the true 10 nearest vectors of every vector
    while a query is compared with under a third of them?"""
    return ivf_figures(spark, sf_dir).select("queries", (F.col("recall") >= 0.9).alias("recall_reached"),
                                               (F.col("read_share") < 1 / 3).alias("under_a_third"))
