"""Exact and clustered k-nearest-neighbour search over vector tables.

Exact search (the "Flat" index): queries whose vectors and hits fit ``max_block_bytes``
(counted first) are collected once and broadcast; the corpus is scanned once by
a ``mapInArrow`` BLAS kernel that keeps each query's top-k over the whole task.
A larger query side never leaves the executors: queries are cut into blocks of bounded
size and the corpus into parts, and a task holds one query block and streams one part of
the corpus past it, so a task's memory does not depend on the part, and a query's bound
rises over the whole part. The corpus is copied once per query block, but in rounds of a
few blocks: a round's hits are written and its copies deleted before the next, so the disk
in use does not grow with the number of blocks. The global top-k
is a ``row_number`` window, which Spark plans as a partial ``WindowGroupLimit``
before the shuffle; few queries are merged in two levels, so that no task gets
all partial results of a query.

Clustered search (the "IVF" index): vectors carry a ``cluster_id``; each query
probes its ``n_probe`` nearest centroids (broadcast within a checked bound,
searched as a distributed corpus beyond it). Scoring happens in place against
broadcast queries, or in cogrouped groups. Where a query would be copied to more
clusters than the corpus has blocks, the groups are (query block, corpus block) as in
the exact search, and a task finds the probes of its queries itself. Else they
are keyed by (cluster, doc sub-block, query sub-block): cluster sizes decide how many
sub-blocks a cluster is split into, so a hot cluster holding a large share of all
rows is spread over many tasks instead of landing in one.

Vectors must have one width: a row of another width fails the job. Null
vectors are skipped.
"""

from __future__ import annotations

import itertools
import math
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from papyra.functions import vectors as V
from papyra.session import delete_path, materialize, stage

DEFAULT_MAX_BLOCK_BYTES = 64 * 1024 * 1024
DEFAULT_MAX_GROUP_ROWS = 50_000
DEFAULT_MAX_CENTROID_BYTES = 256 * 1024 * 1024
FEW_QUERIES, MERGE_SALTS = 64, 32
SCORE_CELLS = 8_000_000
PART_BYTES, PART_ROWS = 256 * 1024 * 1024, 16_384


def vector_width(df: DataFrame, vec_col: str = "vec") -> int:
    row = df.select(F.size(vec_col).alias("d")).where(F.col(vec_col).isNotNull()).first()
    if row is None:
        raise ValueError("no vectors")
    return int(row["d"])


def fixed_width(vec, width: int):
    """The vector as doubles; another width fails the job with both numbers."""
    v = V.to_double(vec)
    return F.when(F.size(v) == width, v).otherwise(F.raise_error(
        F.format_string(f"a vector has %d components, expected {width}", F.size(v))))


def top_k(scored: DataFrame, k: int, partition_cols=("query_id",), score_col: str = "score",
          id_col: str = "id", rank_col: str = "rank", levels: int = 1) -> DataFrame:
    """Per-partition top-k by (score desc, id asc) with a 1-based rank.
    ``levels=2`` first cuts to k rows per (partition, hash of the id)."""
    order = [F.col(score_col).desc(), F.col(id_col).asc()]
    if levels == 2:
        salted = scored.withColumn("_salt", F.pmod(F.xxhash64(id_col), F.lit(MERGE_SALTS)))
        scored = _best(salted, k, [*partition_cols, "_salt"], id_col, score_col).drop("_salt")
    w = Window.partitionBy(*partition_cols).orderBy(*order)
    return scored.withColumn(rank_col, F.row_number().over(w)).where(F.col(rank_col) <= k)


def _best(scored: DataFrame, k: int, partition_cols, id_col: str, score_col: str = "score") -> DataFrame:
    w = Window.partitionBy(*partition_cols).orderBy(F.col(score_col).desc(), F.col(id_col).asc())
    return scored.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).drop("_r")


def query_bytes(width: int, k: int) -> int:
    """What a task holds for a query of its block: its vector and its hits (number, id, score)."""
    return 8 * width + 24 * k


def exact_knn(corpus: DataFrame, queries: DataFrame, k: int, *, id_col: str = "id",
              vec_col: str = "vec", query_id_col: str = "query_id", query_vec_col: str = "vec",
              exclude_self: bool = False, dim: int | None = None,
              max_block_bytes: int = DEFAULT_MAX_BLOCK_BYTES, n_queries: int | None = None) -> DataFrame:
    """Top-k corpus rows per query by cosine; ``(query_id, id, score, rank)``.

    Scores are rounded to 6 decimals before ranking and ties go to the smaller
    id, so results are deterministic. ``exclude_self`` drops corpus rows whose
    id equals the query id. Ids may be integers or strings. ``n_queries`` is
    an upper bound of the number of queries, if one is known.
    """
    id_type = corpus.schema[id_col].dataType.simpleString()
    q_type = queries.schema[query_id_col].dataType.simpleString()
    schema = f"query_id {q_type}, {id_col} {id_type}, score double"
    given = queries.where(F.col(query_vec_col).isNotNull())
    n = given.count() if n_queries is None else n_queries
    width = dim
    if width is None and n:
        first = given.select(F.size(query_vec_col).alias("d")).first()
        width = int(first["d"]) if first else None
    if not n or width is None:
        return corpus.sparkSession.createDataFrame([], schema + ", rank int")
    q = given.select(F.col(query_id_col).alias("qid"), fixed_width(query_vec_col, width).alias("qvec"))
    docs = corpus.where(F.col(vec_col).isNotNull()).select(F.col(id_col), fixed_width(vec_col, width).alias("_v"))
    n_blocks = max(1, math.ceil(n * query_bytes(width, k) / max_block_bytes))
    scored = _score_broadcast(docs, q, k, id_col, width, exclude_self, schema) if n_blocks == 1 \
        else _score_blocks(docs, q, k, id_col, width, exclude_self, schema, n_blocks)
    return top_k(scored, k, id_col=id_col, levels=2 if n <= FEW_QUERIES else 1)


def _score_broadcast(docs, q, k, id_col, width, exclude_self, schema):
    """All queries in one broadcast block (their size has been checked)."""
    tbl = q.toArrow()
    bc = docs.sparkSession.sparkContext.broadcast(
        (tbl.column("qid").combine_chunks(), V.list_to_matrix(tbl.column("qvec"), width)))

    def kernel(batches):
        qids, qmat = bc.value
        return V.score_kernel(qids, qmat, k, id_col, "_v", width, exclude_self)(batches)
    return docs.mapInArrow(kernel, schema)


def _score_blocks(docs, q, k, id_col, width, exclude_self, schema, n_blocks):
    """(query block, corpus part) tasks; nothing passes through the driver."""
    def scorer(qids, qmat):
        return V.score_kernel(qids, qmat, k, id_col, "_v", width, exclude_self)
    return _block_pairs(docs, q, k, id_col, width, schema, n_blocks, scorer)


def corpus_parts(n_docs: int, width: int, n_blocks: int, cores: int) -> int:
    """Parts of the corpus that a query block meets one per task: ``PART_BYTES`` each at most,
    and more, of ``PART_ROWS`` at least, where the tasks would be fewer than four a core.
    Every part costs a query k hits, so there are no more than that."""
    return max(1, math.ceil(n_docs * 8 * width / PART_BYTES),
               min(math.ceil(4 * cores / n_blocks), math.ceil(n_docs / PART_ROWS)))


def query_blocks(q, n_blocks: int):
    """The queries dealt evenly over ``n_blocks`` blocks, whatever their ids, and written:
    the table with ``_block``, and its path."""
    dealt = q.withColumn("_block", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(n_blocks)).cast("int"))
    return stage(dealt.repartitionById(n_blocks, "_block"), "query-blocks", by="_block")


def round_blocks(parts: int, cores: int) -> int:
    """Query blocks searched at a time: as many as give four tasks a core."""
    return math.ceil(4 * cores / parts)


def _block_pairs(docs, q, k, id_col, width, schema, n_blocks, scorer):
    """``scorer(query ids, query vectors)`` over the rows of each corpus part: the best ``k`` of
    each query of a block. A partition holds the queries of one block and then the rows of
    one part, which are streamed. The blocks come in rounds, see ``round_blocks``."""
    spark = docs.sparkSession
    docs, docs_path = stage(docs, "corpus-vectors")     # made once, read for their number and by every round
    blocks, blocks_path = query_blocks(q, n_blocks)
    cores = spark.sparkContext.defaultParallelism
    parts = corpus_parts(docs.count(), width, n_blocks, cores)
    fields = [c for c in docs.columns if c != "_v"]

    def run(batches):
        batches, qids, qvecs, first = iter(batches), [], [], None
        for b in batches:
            asked = b.num_rows - (pc.sum(b.column("_doc")).as_py() or 0)
            if asked:
                qids.append(b.column("qid").slice(0, asked))
                qvecs.append(V.list_to_matrix(b.column("_v").slice(0, asked), width))
            if asked < b.num_rows:
                first = b.slice(asked)
                break
        if first is None or not qids:
            for _ in batches:
                pass
            return
        kernel = scorer(pa.concat_arrays(qids), np.concatenate(qvecs))
        qids, qvecs = None, None
        yield from kernel(b.select([*fields, "_v"]) for b in itertools.chain([first], batches))
    out, step = [], round_blocks(parts, cores)
    for lo in range(0, n_blocks, step):
        hi = min(lo + step, n_blocks)
        every = lambda a, b: F.explode(F.sequence(F.lit(a), F.lit(b - 1)))
        task = ((F.col("_block") - lo) * parts + F.col("part")).cast("int").alias("_task")
        left = blocks.where((F.col("_block") >= lo) & (F.col("_block") < hi)) \
            .withColumn("part", every(0, parts)).select(task, F.lit(False).alias("_doc"), "qid", *[
                F.lit(None).cast(docs.schema[c].dataType).alias(c) for c in fields], F.col("qvec").alias("_v"))
        right = docs.withColumn("part", F.pmod(F.xxhash64(id_col), F.lit(parts))).withColumn("_block", every(lo, hi)) \
            .select(task, F.lit(True).alias("_doc"), F.lit(None).cast(q.schema["qid"].dataType).alias("qid"), *fields, "_v")
        scored = left.unionByName(right).repartitionById((hi - lo) * parts, "_task").drop("_task") \
            .sortWithinPartitions("_doc").mapInArrow(run, schema)
        out.append(materialize(_best(scored, k, ["query_id"], id_col), "block-hits"))
    for path in (docs_path, blocks_path):
        delete_path(spark, path)
    return reduce(DataFrame.unionByName, out)


def label_centroids(vectors: DataFrame, cluster_col: str = "label", vec_col: str = "vec") -> DataFrame:
    """Mean of the unit vectors of each cluster, re-normalised: ``(cluster_id, vec)``.

    MLlib's ``Summarizer.mean`` aggregates dense vectors in the JVM with one
    partial buffer per (task, cluster), so the shuffle carries #clusters
    vectors per task, not one row per component.
    """
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    unit = vectors.select(F.col(cluster_col).alias("cluster_id"),
                          array_to_vector(V.normalize(V.to_double(vec_col))).alias("u"))
    means = unit.groupBy("cluster_id").agg(Summarizer.mean(F.col("u")).alias("m"))
    return means.select("cluster_id", V.normalize(vector_to_array("m")).alias("vec"))


def probe_clusters(queries: DataFrame, centroids: DataFrame, n_probe: int, *,
                   query_id_col: str = "query_id", query_vec_col: str = "vec",
                   max_centroid_bytes: int = DEFAULT_MAX_CENTROID_BYTES) -> DataFrame:
    """``(query_id, cluster_id, probe_rank, score)``: each query's nearest centroids."""
    spark = queries.sparkSession
    dim = vector_width(centroids)
    bound = max(1, max_centroid_bytes // (8 * dim))
    cents = centroids.select(F.col("cluster_id").cast("long"), fixed_width("vec", dim).alias("vec"))
    tbl = cents.limit(bound + 1).toArrow()
    if tbl.num_rows > bound:            # too many to broadcast: search them like any corpus
        near = exact_knn(cents, queries, n_probe, id_col="cluster_id", query_id_col=query_id_col,
                         query_vec_col=query_vec_col, dim=dim)
        return near.select("query_id", "cluster_id", F.col("rank").alias("probe_rank"), "score")
    ids = tbl.column("cluster_id").to_numpy().astype(np.int64)
    bc = spark.sparkContext.broadcast((ids, V.list_to_matrix(tbl.column("vec"), dim)))

    def kernel(batches):
        cids, cmat = bc.value
        return V.nearest_rows_kernel(cids, cmat, n_probe, "query_id", "_v", dim, "cluster_id")(batches)
    q = queries.where(F.col(query_vec_col).isNotNull()).select(
        F.col(query_id_col).alias("query_id"), fixed_width(query_vec_col, dim).alias("_v"))
    q_type = q.schema["query_id"].dataType.simpleString()
    return q.mapInArrow(kernel, f"query_id {q_type}, cluster_id long, probe_rank int, score double")


def _group_scorer(k: int, dim: int, exclude_self: bool):
    def run(docs: pd.DataFrame, qs: pd.DataFrame) -> pd.DataFrame:
        if docs.empty or qs.empty:
            return pd.DataFrame({"query_id": qs["query_id"].iloc[:0], "id": docs["id"].iloc[:0],
                                 "score": pd.Series([], "float64")})
        d = V.unit_rows(np.vstack(docs["_v"].to_numpy()).astype(np.float64).reshape(len(docs), dim))
        q = V.unit_rows(np.vstack(qs["_q"].to_numpy()).astype(np.float64).reshape(len(qs), dim))
        ids, qids = pa.array(docs["id"]), pa.array(qs["query_id"])
        best = V.RunningTopK(len(q), k, "id")
        V.add_scores(best, np.arange(len(q)), q, q.astype(np.float32), ids, d,
                     V.id_codes(qids, qids) if exclude_self else None, V.id_codes(ids, qids) if exclude_self else None)
        out = [b.to_pandas() for b in best.batches(qids)]
        return pd.concat(out) if out else pd.DataFrame({"query_id": qs["query_id"].iloc[:0], "id": docs["id"].iloc[:0],
                                                        "score": pd.Series([], "float64")})
    return run


def clustered_knn(corpus: DataFrame, centroids: DataFrame, queries: DataFrame, k: int,
                  n_probe: int, *, query_id_col: str = "query_id", query_vec_col: str = "vec",
                  exclude_self: bool = False, max_group_rows: int = DEFAULT_MAX_GROUP_ROWS,
                  max_block_bytes: int = DEFAULT_MAX_BLOCK_BYTES, method: str = "auto") -> DataFrame:
    """IVF search. ``corpus`` has ``(id, vec, cluster_id)``; returns
    ``(query_id, id, score, rank)``. With ``n_probe`` = #clusters it equals
    :func:`exact_knn`.

    ``method="broadcast"`` (chosen by ``auto`` when the query vectors and the
    probe lists fit ``max_block_bytes``): the corpus is read only for probed
    clusters (a partition filter on ``cluster_id``) and scored in place
    against the broadcast queries; no shuffle of the corpus.
    ``method="cogroup"``: corpus and probing queries meet in groups keyed by
    (cluster, doc sub-block, query sub-block), each bounded by
    ``max_group_rows``, for query sets beyond the broadcast bound.
    ``method="blocks"`` (chosen by ``auto`` beyond that bound when there are fewer corpus
    blocks than probes and the centroids can be broadcast): blocks of queries meet blocks of
    the corpus, so neither is copied once per probe.
    """
    dim = vector_width(centroids)
    probes = probe_clusters(queries, centroids, n_probe, query_id_col=query_id_col,
                            query_vec_col=query_vec_col).select("query_id", "cluster_id")
    if method in ("auto", "broadcast"):
        out = _clustered_broadcast(corpus, queries, probes, k, dim, query_id_col, query_vec_col,
                                   exclude_self, max_block_bytes, n_probe, force=(method == "broadcast"))
        if out is not None:
            return out
    if method in ("auto", "blocks"):
        out = _clustered_blocks(corpus, centroids, queries, k, n_probe, dim, query_id_col, query_vec_col, exclude_self,
                                max_block_bytes, force=(method == "blocks"))
        if out is not None:
            return out
    return _clustered_cogroup(corpus, queries, probes, k, dim, query_id_col, query_vec_col,
                              exclude_self, max_group_rows)


def _clustered_broadcast(corpus, queries, probes, k, dim, query_id_col, query_vec_col, exclude_self,
                         max_block_bytes, n_probe, force=False):
    """Broadcast plan, or None when the query side exceeds the byte bound."""
    spark = corpus.sparkSession
    max_rows = max(1, max_block_bytes // (8 * (dim + n_probe)))
    q = queries.where(F.col(query_vec_col).isNotNull()).select(
        F.col(query_id_col).alias("query_id"), fixed_width(query_vec_col, dim).alias("qvec"))
    tbl = q.limit(max_rows + 1).toArrow()
    if tbl.num_rows > max_rows:
        if force:
            raise ValueError(f"more than {max_rows} queries exceed max_block_bytes; use method='auto' or 'cogroup'")
        return None
    qids = tbl.column("query_id").combine_chunks()
    qmat = V.list_to_matrix(tbl.column("qvec"), dim)
    pr = probes.toArrow()                                      # n_queries x n_probe rows
    col_of = pc.index_in(pr.column("query_id"), value_set=qids).to_numpy(zero_copy_only=False)
    cl = pr.column("cluster_id").to_numpy()
    keep = ~np.isnan(col_of.astype(float)) if col_of.dtype.kind == "f" else np.ones(len(cl), bool)
    col_of, cl = col_of[keep].astype(np.int64), cl[keep].astype(np.int64)
    probe_lists = _probe_lists(col_of, cl)
    bc = spark.sparkContext.broadcast((qids, qmat, probe_lists))
    id_type = corpus.schema["id"].dataType.simpleString()
    q_type = queries.schema[query_id_col].dataType.simpleString()
    docs = corpus.where(F.col("cluster_id").cast("long").isin(list(probe_lists)) & F.col("vec").isNotNull()) \
        .select("id", F.col("cluster_id").cast("long").alias("cluster_id"), fixed_width("vec", dim).alias("_v"))

    def kernel(batches):
        ids_, mat_, lists_ = bc.value
        return V.ivf_kernel(ids_, mat_, lists_, k, "id", "cluster_id", "_v", dim, exclude_self)(batches)
    scored = docs.mapInArrow(kernel, f"query_id {q_type}, id {id_type}, score double")
    return top_k(scored, k)


def _clustered_blocks(corpus, centroids, queries, k, n_probe, dim, query_id_col, query_vec_col, exclude_self,
                      max_block_bytes, force=False):
    """(query block, corpus block) tasks; None where the probes are fewer than the corpus
    blocks or the centroids exceed the broadcast bound."""
    bound = max(1, DEFAULT_MAX_CENTROID_BYTES // (8 * dim))
    tbl = centroids.select(F.col("cluster_id").cast("long"), fixed_width("vec", dim).alias("vec")).limit(bound + 1).toArrow()
    docs = corpus.where(F.col("vec").isNotNull()).select(
        "id", F.col("cluster_id").cast("long").alias("cluster_id"), fixed_width("vec", dim).alias("_v"))
    if tbl.num_rows > bound or not (force or docs.count() <= n_probe * max(1, max_block_bytes // (8 * dim))):
        if force:
            raise ValueError(f"more than {bound} centroids; use method='auto' or 'cogroup'")
        return None
    numbers, mat = tbl.column("cluster_id").to_numpy().astype(np.int64), V.list_to_matrix(tbl.column("vec"), dim)
    bc = corpus.sparkSession.sparkContext.broadcast((numbers, mat))
    q = queries.where(F.col(query_vec_col).isNotNull()).select(
        F.col(query_id_col).alias("qid"), fixed_width(query_vec_col, dim).alias("qvec"))
    # a query's probes take room beside its vector while its block is searched
    n_blocks = max(1, math.ceil(q.count() * (query_bytes(dim, k) + (8 * n_probe if n_probe < len(numbers) else 0)) / max_block_bytes))

    def scorer(qids, qmat):
        known, cmat = bc.value
        if n_probe >= len(known):
            probes = dict.fromkeys(known.tolist(), np.arange(len(qids)))
        else:
            batch = pa.RecordBatch.from_arrays([pa.array(np.arange(len(qids))), _lists(qmat)], names=["query_id", "_v"])
            near = list(V.nearest_rows_kernel(known, cmat, n_probe, "query_id", "_v", dim, "cluster_id")([batch]))
            who, cl = (np.concatenate([b.column(i).to_numpy() for b in near]) for i in (0, 1))
            probes = _probe_lists(who, cl)
        return V.ivf_kernel(qids, qmat, probes, k, "id", "cluster_id", "_v", dim, exclude_self)
    q_type, id_type = (x.simpleString() for x in (q.schema["qid"].dataType, docs.schema["id"].dataType))
    scored = _block_pairs(docs, q, k, "id", dim, f"query_id {q_type}, id {id_type}, score double", n_blocks, scorer)
    return top_k(scored, k)


def _lists(mat: np.ndarray) -> pa.Array:
    offsets = pa.array(np.arange(0, mat.size + 1, max(mat.shape[1], 1)), pa.int32())
    return pa.ListArray.from_arrays(offsets, pa.array(mat.ravel()))


def _probe_lists(who: np.ndarray, clusters: np.ndarray) -> dict[int, np.ndarray]:
    """cluster id -> the numbers of the queries that probe it, ascending."""
    order = np.lexsort((who, clusters))
    used, first = np.unique(clusters[order], return_index=True)
    return {int(c): w for c, w in zip(used, np.split(who[order], first[1:]))}


def _clustered_cogroup(corpus, queries, probes, k, dim, query_id_col, query_vec_col, exclude_self,
                       max_group_rows):
    docs = corpus.where(F.col("vec").isNotNull()).select(
        F.col("id"), F.col("cluster_id").cast("long"), fixed_width("vec", dim).alias("_v"))
    # split factors per cluster: one row a cluster
    doc_n = docs.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("nd"))
    q_n = probes.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("nq"))
    split = doc_n.join(q_n, "cluster_id").select(
        "cluster_id",
        F.greatest(F.lit(1), F.ceil(F.col("nd") / max_group_rows)).cast("int").alias("sd"),
        F.greatest(F.lit(1), F.ceil(F.col("nq") / max_group_rows)).cast("int").alias("sq"))
    # each doc goes to one doc sub-block and is repeated for every query sub-block
    d = docs.join(split, "cluster_id") \
        .withColumn("dsub", F.pmod(F.xxhash64("id"), F.col("sd")).cast("int")) \
        .withColumn("qsub", F.explode(F.sequence(F.lit(0), F.col("sq") - 1))) \
        .select("cluster_id", "dsub", "qsub", "id", "_v")
    qv = queries.where(F.col(query_vec_col).isNotNull()).select(
        F.col(query_id_col).alias("query_id"), fixed_width(query_vec_col, dim).alias("_q"))
    q = probes.join(qv, "query_id").join(split, "cluster_id") \
        .withColumn("qsub", F.pmod(F.xxhash64("query_id"), F.col("sq")).cast("int")) \
        .withColumn("dsub", F.explode(F.sequence(F.lit(0), F.col("sd") - 1))) \
        .select("cluster_id", "dsub", "qsub", "query_id", "_q")
    keys = ["cluster_id", "dsub", "qsub"]
    id_type = docs.schema["id"].dataType.simpleString()
    q_type = qv.schema["query_id"].dataType.simpleString()
    scored = d.groupBy(*keys).cogroup(q.groupBy(*keys)).applyInPandas(
        _group_scorer(k, dim, exclude_self), f"query_id {q_type}, id {id_type}, score double")
    return top_k(scored, k)


def cluster_count(n: int) -> int:
    """Clusters for ``n`` vectors: n / 10 up to 256, about 200 vectors each from
    there on (5 000 for a million), and 8 * sqrt(n) once that is fewer."""
    return max(10, min(256, n // 10), min(n // 195, int(8 * math.sqrt(n))))


def default_probes(clusters: int) -> int:
    """Clusters probed by default: three in four, 32 at least; ``ivf_recall``
    measures the recall at this number."""
    return max(min(clusters, 32), clusters * 3 // 4)


def kmeans_index(vectors: DataFrame, n_clusters: int | None = None, *, vec_col: str = "vec",
                 seed: int = 42, max_iter: int = 20):
    """Train cosine k-means (MLlib) on unit vectors; returns
    ``(vectors with cluster_id, centroids)``. The default count grows with the
    table, see :func:`cluster_count`."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    unit = vectors.withColumn("_u", V.normalize(V.to_double(vec_col)))
    if n_clusters is None:
        n_clusters = cluster_count(unit.count())
    # cosine k-means is undefined for zero vectors: they score 0 against any
    # query, so they go to cluster 0 without taking part in training
    nonzero = F.exists("_u", lambda x: x != 0)
    feats = unit.where(nonzero).withColumn("_f", array_to_vector("_u"))
    model = KMeans(k=n_clusters, seed=seed, maxIter=max_iter, featuresCol="_f",
                   predictionCol="cluster_id", distanceMeasure="cosine").fit(feats)
    zeros = unit.where(~nonzero | F.col("_u").isNull()).withColumn("cluster_id", F.lit(0))
    assigned = model.transform(feats).drop("_f").unionByName(zeros).drop("_u")
    spark = vectors.sparkSession
    centers = [(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())]
    centroids = spark.createDataFrame(centers, "cluster_id long, vec array<double>") \
        .select("cluster_id", V.normalize("vec").alias("vec"))
    return assigned.withColumn("cluster_id", F.col("cluster_id").cast("long")), centroids
