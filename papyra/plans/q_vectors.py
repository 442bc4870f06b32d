"""Vector-store queries: exact and clustered k-NN, blends, multi-model,
encoder output, index statistics and removal."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from papyra.functions import encode as E
from papyra.functions import vectors as V
from papyra.operators import celltree as C
from papyra.operators import index as IX
from papyra.operators import knn as K
from papyra.operators import papers as P
from papyra.plans import adapters as A
from papyra.plans import sqltext as S
from papyra.plans.catalog import register
from papyra.plans.q_ingest import papers
from papyra.operators.retrieval import materialize
from papyra.session import scratch_path

K_NN = 10
SIMILAR_K = 5
N_PROBE = 3
MULTI_K = 5

VEC = "v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS vec, label FROM embeddings)"


def _rank_sql(scored: str, k: int, part: str = "query_id", order: str = "score DESC, id") -> str:
    return (f"SELECT * EXCLUDE (rn), CAST(rn AS INTEGER) AS rank FROM (SELECT *, row_number() OVER "
            f"(PARTITION BY {part} ORDER BY {order}) AS rn FROM {scored}) WHERE rn <= {k}")


KNN_SQL = f"""WITH {VEC},
s AS (SELECT q.id AS query_id, d.id AS id, round({S.cosine('q.vec', 'd.vec')}, 6) AS score FROM v q CROSS JOIN v d)
{_rank_sql('s', K_NN)}"""


@register("knn_exact", KNN_SQL)
def knn_exact(spark, sf_dir):
    v = A.vectors(spark, sf_dir)
    return K.exact_knn(v, v.withColumnRenamed("id", "query_id"), K_NN)


@register("knn_cells", KNN_SQL)
def knn_cells(spark, sf_dir):
    """Exact search through a stored cell index: clusters and cells whose bound is below
    a query's k-th score are skipped (``ivf_figures`` reports the share read)."""
    v = A.vectors(spark, sf_dir)
    index = C.build(v, scratch_path(spark, f"knn-cells-{uuid.uuid4().hex}"))
    return C.search(index, v.withColumnRenamed("id", "query_id"), K_NN, slack=1.0)[0]


def _similar_sql() -> str:
    extra = (f"{VEC}, pv AS (SELECT * FROM v WHERE id IN (SELECT doc_id FROM papers)),\n"
             f"s AS (SELECT q.id AS query_id, d.id AS id, round({S.cosine('q.vec', 'd.vec')}, 6) AS score "
             f"FROM pv q CROSS JOIN pv d),\n"
             f"c AS ({_rank_sql('s', SIMILAR_K + 1)}),\n"
             f"f AS (SELECT query_id, id, score, rank AS candidate_rank, row_number() OVER "
             f"(PARTITION BY query_id ORDER BY rank) AS rn FROM c WHERE score >= 0.3 AND id <> query_id)")
    return S.with_papers(extra=extra) + f"""SELECT f.query_id AS query_doc_id, f.id AS doc_id, p.id AS paper_id,
  p.title, f.score, CAST(f.candidate_rank AS INTEGER) AS candidate_rank, CAST(f.rn AS INTEGER) AS rank
FROM f JOIN papers p ON p.doc_id = f.id WHERE f.rn <= {SIMILAR_K}"""


@register("similar_docs", _similar_sql())
def similar_docs(spark, sf_dir):
    """For every paper with a vector: its most similar other papers (top
    k+1 candidates, threshold 0.3, self removed, first k)."""
    p = papers(spark, sf_dir)
    # the paper-backed vectors feed both sides: written once, read twice
    v = materialize(A.vectors(spark, sf_dir).join(p.select(F.col("doc_id").alias("id")), "id", "left_semi"),
                    "paper-vectors")
    cand = K.exact_knn(v, v.withColumnRenamed("id", "query_id"), SIMILAR_K + 1)
    kept = cand.where((F.col("score") >= 0.3) & (F.col("id") != F.col("query_id")))
    w = Window.partitionBy("query_id").orderBy("rank")
    kept = kept.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= SIMILAR_K)
    return kept.join(p.select(F.col("doc_id").alias("id"), F.col("id").alias("paper_id"), "title"), "id") \
        .select(F.col("query_id").alias("query_doc_id"), F.col("id").alias("doc_id"), "paper_id", "title",
                "score", F.col("rank").alias("candidate_rank"), F.col("rn").alias("rank"))


def _centroid_sql() -> str:
    u = S.normalize("vec")
    return (f"u AS (SELECT id, label, {u} AS u FROM v),\n"
            f"cd AS (SELECT label AS cluster_id, pos, avg(x) AS m FROM (SELECT label, unnest(u) AS x, "
            f"generate_subscripts(u, 1) AS pos FROM u) GROUP BY ALL),\n"
            f"cen AS (SELECT cluster_id, {S.normalize('list(m ORDER BY pos)')} AS vec FROM cd GROUP BY cluster_id)")


@register("knn_clustered", f"""WITH {VEC}, {_centroid_sql()},
pr AS (SELECT query_id, cluster_id FROM (SELECT q.id AS query_id, c.cluster_id, row_number() OVER (
  PARTITION BY q.id ORDER BY round({S.cosine('q.vec', 'c.vec')}, 6) DESC, c.cluster_id) AS r
  FROM v q CROSS JOIN cen c) WHERE r <= {N_PROBE}),
s AS (SELECT pr.query_id, d.id, round({S.cosine('q.vec', 'd.vec')}, 6) AS score
  FROM pr JOIN v d ON d.label = pr.cluster_id JOIN v q ON q.id = pr.query_id)
{_rank_sql('s', K_NN)}""")
def knn_clustered(spark, sf_dir):
    """IVF search with the ``label`` column as the cluster assignment and
    label means as centroids; 3 of 10 clusters probed."""
    v = A.vectors(spark, sf_dir)
    cen = K.label_centroids(v, "label")
    corpus = v.withColumn("cluster_id", F.col("label").cast("long"))
    return K.clustered_knn(corpus, cen, v.withColumnRenamed("id", "query_id"), K_NN, N_PROBE)


@register("centroids", f"""WITH {VEC}, {_centroid_sql()}
SELECT cluster_id, CAST(generate_subscripts(vec, 1) - 1 AS INTEGER) AS pos, round(unnest(vec), 6) AS value FROM cen""")
def centroids(spark, sf_dir):
    cen = K.label_centroids(A.vectors(spark, sf_dir), "label")
    return cen.select("cluster_id", F.posexplode("vec").alias("pos", "value")) \
        .withColumn("value", V.round_score("value"))


@register("hybrid_blend", f"""WITH {VEC},
b AS (SELECT t.id, {S.blend('t.vec', 'a.vec', E.TITLE_WEIGHT, E.ABSTRACT_WEIGHT)} AS vec
  FROM v t JOIN v a ON a.id = (t.id * 7 + 3) % (SELECT count(*) FROM v))
SELECT id, CAST(generate_subscripts(vec, 1) - 1 AS INTEGER) AS pos, round(unnest(vec), 6) AS value FROM b""")
def hybrid_blend(spark, sf_dir):
    """Title vector = vector id, abstract vector = vector (id*7+3) % n;
    0.4 / 0.6 blend, re-normalised; long form (id, pos, value)."""
    v = A.vectors(spark, sf_dir).select("id", "vec")
    n = v.agg(F.count(F.lit(1))).scalar()
    t = v.withColumn("partner", (F.col("id") * 7 + 3) % n)
    a = v.select(F.col("id").alias("partner"), F.col("vec").alias("avec"))
    b = t.join(a, "partner").select("id", V.blend("vec", "avec", E.TITLE_WEIGHT, E.ABSTRACT_WEIGHT).alias("vec"))
    return b.select("id", F.posexplode("vec").alias("pos", "value")).withColumn("value", V.round_score("value"))


@register("hash_encode", S.with_papers(extra=S.encode_cte("enc", "papers", "doc_id", "combined_text")) + """
SELECT * FROM (SELECT doc_id, CAST(generate_subscripts(vec, 1) - 1 AS INTEGER) AS bucket,
  round(unnest(vec), 6) AS weight FROM enc) WHERE weight <> 0""")
def hash_encode(spark, sf_dir):
    """Built-in encoder over each paper's combined text; nonzero buckets."""
    enc = E.hash_encode(papers(spark, sf_dir).select("doc_id", "combined_text"), "combined_text", "vec")
    out = enc.select("doc_id", F.posexplode("vec").alias("bucket", "weight")) \
        .withColumn("weight", V.round_score("weight"))
    return out.where(F.col("weight") != 0)


@register("multi_model_topk", f"""WITH v2 AS ({S.vectors_cte('m64', 'm64')[len('m64 AS ('):-1]}
  UNION ALL {S.vectors_cte('m32', 'm32')[len('m32 AS ('):-1]}),
s AS (SELECT q.model, q.id AS query_id, d.id AS id, round({S.cosine('q.vec', 'd.vec')}, 6) AS score
  FROM v2 q JOIN v2 d ON q.model = d.model)
{_rank_sql('s', MULTI_K, part='model, query_id')}""")
def multi_model_topk(spark, sf_dir):
    """One encoding per model (m64, m32); top-k per (model, query)."""
    out = None
    for m in ("m64", "m32"):
        v = A.vectors(spark, sf_dir, m)
        r = K.exact_knn(v, v.withColumnRenamed("id", "query_id"), MULTI_K).withColumn("model", F.lit(m))
        out = r if out is None else out.unionByName(r)
    return out.select("model", "query_id", "id", "score", "rank")


@register("index_stats", f"""WITH v2 AS ({S.vectors_cte('m64', 'm64')[len('m64 AS ('):-1]}
  UNION ALL {S.vectors_cte('m32', 'm32')[len('m32 AS ('):-1]})
SELECT model, count(*) AS total_vectors, CAST(max(len(vec)) AS INTEGER) AS dimension,
  count(DISTINCT label) AS n_clusters FROM v2 GROUP BY model""")
def index_stats(spark, sf_dir):
    v = A.all_models(spark, sf_dir).withColumnRenamed("label", "cluster_id")
    return IX.index_stats(v)


@register("remove_docs", f"""WITH {S.raw_cte()}, {S.flagged_cte()}
SELECT vec_id AS id FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM flagged WHERE reject_reason IS NOT NULL)""")
def remove_docs(spark, sf_dir):
    """Drop the vectors of documents that fail ingest."""
    rejected = P.with_reject_reason(A.raw_papers(spark, sf_dir)) \
        .where(F.col("reject_reason").isNotNull()).select(F.col("doc_id").alias("id"))
    return IX.remove(A.vectors(spark, sf_dir), rejected).select("id")


@register("truncate_tokens", f"""WITH {S.raw_cte()}
SELECT doc_id, array_to_string(list_slice(string_split({S.squeeze('abstract')}, ' '), 1, 512), ' ') AS truncated FROM raw""")
def truncate_tokens(spark, sf_dir):
    """Whitespace-token truncation to 512 tokens before encoding (whole raw texts)."""
    from papyra.functions import text as TX
    return A.raw_papers(spark, sf_dir).select("doc_id", TX.truncate_tokens("abstract").alias("truncated"))


ENCODER_MODELS = {"hash64": 64, "hash128": 128}


def _multi_encode_sql() -> str:
    ctes, sel = [], []
    for name, dim in ENCODER_MODELS.items():
        ctes.append(S.encode_cte(f"e_{name}", "papers", "doc_id", "combined_text", dim))
        sel.append(f"SELECT '{name}' AS model, doc_id, CAST(len(list_filter(vec, lambda x: x <> 0)) AS INTEGER) AS nonzero, "
                   f"round(list_reduce(vec, lambda a, b: a + b, 0.0), 6) AS weight_sum FROM e_{name}")
    return S.with_papers(extra=",\n".join(ctes)) + "\nUNION ALL ".join(sel)


@register("multi_model_encode", _multi_encode_sql())
def multi_model_encode(spark, sf_dir):
    """One encoding per model (here two bucket widths), tagged with ``model``."""
    p = papers(spark, sf_dir).select("doc_id", "combined_text")
    out = None
    for name, dim in ENCODER_MODELS.items():
        e = E.hash_encode(p, "combined_text", "vec", dim).select(
            F.lit(name).alias("model"), "doc_id",
            F.size(F.filter("vec", lambda x: x != 0)).alias("nonzero"),
            V.round_score(F.aggregate("vec", F.lit(0.0), lambda a, b: a + b)).alias("weight_sum"))
        out = e if out is None else out.unionByName(e)
    return out


@register("engine_stats", S.with_papers() + """SELECT (SELECT count(*) FROM papers) AS total_documents,
  'm64' AS embedding_model, CAST(max(len(embedding)) AS INTEGER) AS embedding_dimension,
  count(*) AS total_vectors, count(DISTINCT label) AS n_clusters FROM embeddings""")
def engine_stats(spark, sf_dir):
    """Corpus and index figures in one row."""
    n_docs = papers(spark, sf_dir).agg(F.count(F.lit(1))).scalar()
    v = A.vectors(spark, sf_dir)
    return v.agg(F.max(F.size("vec")).alias("embedding_dimension"), F.count(F.lit(1)).alias("total_vectors"),
                  F.count_distinct("label").alias("n_clusters")) \
        .select(n_docs.alias("total_documents"), F.lit("m64").alias("embedding_model"), "embedding_dimension",
                "total_vectors", "n_clusters")
