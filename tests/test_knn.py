"""k-NN operators against numpy brute force, plus plan and scale properties."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from papyra.operators import knn as K


def brute(corpus, queries, k, exclude_self=False):
    ids = np.array([c[0] for c in corpus])
    m = np.array([c[1] for c in corpus], dtype=float)
    m = m / (np.linalg.norm(m, axis=1, keepdims=True) + 1e-8)
    out = {}
    for qid, qv in queries:
        q = np.array(qv, dtype=float)
        q = q / (np.linalg.norm(q) + 1e-8)
        s = np.round(m @ q, 6)
        rows = sorted(((-s[i], ids[i]) for i in range(len(ids)) if not (exclude_self and ids[i] == qid)))
        out[qid] = [(i, -ns) for ns, i in rows[:k]]
    return out


def as_dict(df, id_col="id"):
    got = {}
    for r in df.orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r[id_col], r["score"]))
    return got


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(7)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(300)]
    rows[5] = (5, [0.0] * 8)                       # zero vector
    rows[7] = (7, list(rows[6][1]))                # duplicate pair -> tie broken by id
    return rows


def test_exact_matches_brute_force(spark, vectors):
    df = spark.createDataFrame(vectors, "id long, vec array<double>")
    qs = vectors[:20]
    q = spark.createDataFrame(qs, "query_id long, vec array<double>")
    got = as_dict(K.exact_knn(df, q, 7))
    exp = brute(vectors, qs, 7)
    assert got.keys() == exp.keys()
    for qid in exp:
        assert [i for i, _ in got[qid]] == [int(i) for i, _ in exp[qid]]
        assert np.allclose([s for _, s in got[qid]], [s for _, s in exp[qid]])


def test_exact_blocks_self_and_string_ids(spark, vectors):
    df = spark.createDataFrame(vectors, "id long, vec array<double>")
    q = df.withColumnRenamed("id", "query_id")
    one_block = as_dict(K.exact_knn(df, q, 5, exclude_self=True))
    many_blocks = as_dict(K.exact_knn(df, q, 5, exclude_self=True, max_block_bytes=2048))
    assert one_block == many_blocks
    exp = brute(vectors, vectors, 5, exclude_self=True)
    assert {k: [i for i, _ in v] for k, v in one_block.items()} == \
           {k: [int(i) for i, _ in v] for k, v in exp.items()}
    srows = [(f"p{i:04d}", v) for i, v in vectors]
    sdf = spark.createDataFrame(srows, "id string, vec array<double>")
    sq = sdf.withColumnRenamed("id", "query_id")
    sgot = as_dict(K.exact_knn(sdf, sq, 5, exclude_self=True))
    assert {k: [i for i, _ in v] for k, v in sgot.items()} == \
           {f"p{k:04d}": [f"p{i:04d}" for i, _ in v] for k, v in one_block.items()}


def test_topk_properties_and_plan(spark, vectors):
    df = spark.createDataFrame(vectors, "id long, vec array<double>").repartition(4)
    q = df.withColumnRenamed("id", "query_id")
    r = K.exact_knn(df, q, 4)
    per_q = {}
    for row in r.collect():
        per_q.setdefault(row["query_id"], []).append((row["rank"], row["score"]))
    for lst in per_q.values():
        lst.sort()
        assert len(lst) <= 4
        scores = [s for _, s in lst]
        assert scores == sorted(scores, reverse=True)
    plan = r._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_clustered_all_probes_equals_exact(spark, vectors):
    df = spark.createDataFrame([(i, v, i % 6) for i, v in vectors], "id long, vec array<double>, label int")
    cen = K.label_centroids(df, "label")
    corpus = df.withColumn("cluster_id", F.col("label").cast("long"))
    q = df.where("id < 30").withColumnRenamed("id", "query_id")
    exact = as_dict(K.exact_knn(df, q, 5))
    for method in ("broadcast", "cogroup"):
        assert as_dict(K.clustered_knn(corpus, cen, q, 5, n_probe=6, method=method)) == exact
    # a hot cluster split into many cogroup groups gives the broadcast answer
    hot = corpus.withColumn("cluster_id", F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("cluster_id")))
    a = as_dict(K.clustered_knn(hot, cen, q, 5, n_probe=2, method="broadcast"))
    b = as_dict(K.clustered_knn(hot, cen, q, 5, n_probe=2, method="cogroup", max_group_rows=7))
    assert a == b
    # the automatic choice falls back to cogroup beyond the byte bound
    c = as_dict(K.clustered_knn(hot, cen, q, 5, n_probe=2, max_block_bytes=64))
    assert c == a
    # string ids and self exclusion agree between the two plans
    sc = hot.withColumn("id", F.format_string("d%04d", "id"))
    sq = sc.where("id < 'd0030'").withColumnRenamed("id", "query_id")
    x = as_dict(K.clustered_knn(sc, cen, sq, 4, n_probe=3, exclude_self=True, method="broadcast"))
    y = as_dict(K.clustered_knn(sc, cen, sq, 4, n_probe=3, exclude_self=True, method="cogroup"))
    assert x == y and all(qid not in [i for i, _ in v] for qid, v in x.items())


def test_kmeans_index(spark, vectors):
    df = spark.createDataFrame(vectors, "id long, vec array<double>")
    assigned, cen = K.kmeans_index(df, n_clusters=5, max_iter=5)
    assert cen.count() == 5
    assert assigned.select("cluster_id").distinct().count() <= 5
    q = df.where("id < 10").withColumnRenamed("id", "query_id")
    full = as_dict(K.clustered_knn(assigned, cen, q, 3, n_probe=5))
    assert full == as_dict(K.exact_knn(df, q, 3))


def test_many_blocks_collect_nothing(spark, vectors, monkeypatch):
    """Beyond the byte bound the query side stays on the executors."""
    df = spark.createDataFrame(vectors, "id long, vec array<double>")
    q = df.withColumnRenamed("id", "query_id")
    want = as_dict(K.exact_knn(df, q, 5))
    from pyspark.sql.classic.dataframe import DataFrame
    for name in ("toArrow", "collect", "toPandas"):
        monkeypatch.setattr(DataFrame, name, lambda self, *a: pytest.fail("collected"))
    blocks = K.exact_knn(df, q, 5, dim=8, max_block_bytes=512)
    monkeypatch.undo()
    assert as_dict(blocks) == want and len(want) == 300


def test_forced_broadcast_never_truncates(spark, vectors):
    df = spark.createDataFrame([(i, v, i % 6) for i, v in vectors], "id long, vec array<double>, label int")
    cen = K.label_centroids(df, "label")
    corpus = df.withColumn("cluster_id", F.col("label").cast("long"))
    q = df.where("id < 200").withColumnRenamed("id", "query_id")
    with pytest.raises(ValueError):
        K.clustered_knn(corpus, cen, q, 5, n_probe=2, method="broadcast", max_block_bytes=1024)
    assert len(as_dict(K.clustered_knn(corpus, cen, q, 5, n_probe=2, max_block_bytes=1024))) == 200
    near = K.probe_clusters(q, cen, 2).collect()
    far = K.probe_clusters(q, cen, 2, max_centroid_bytes=64).collect()     # searched, not broadcast
    key = lambda r: (r["query_id"], r["cluster_id"], r["probe_rank"], r["score"])
    assert sorted(map(key, near)) == sorted(map(key, far))


def test_mixed_widths_fail(spark, vectors):
    df = spark.createDataFrame(vectors, "id long, vec array<double>")
    odd = df.withColumn("vec", F.when(F.col("id") == 9, F.array(F.lit(1.0))).otherwise(F.col("vec")))
    q = df.where("id < 3").withColumnRenamed("id", "query_id")
    with pytest.raises(Exception, match="1 components, expected 8"):
        K.exact_knn(odd, q, 3).collect()
    with pytest.raises(Exception, match="1 components, expected 8"):
        K.exact_knn(df, odd.withColumnRenamed("id", "query_id"), 3, dim=8).collect()


def test_running_top_k_equals_one_batch(spark, vectors):
    import pyarrow as pa
    from papyra.functions import vectors as V
    rng = np.random.default_rng(1)
    ids = pa.array(range(1000), pa.int64())
    m = np.round(rng.normal(size=(1000, 4)), 1)
    q = np.round(rng.normal(size=(9, 4)), 1)
    col = pa.ListArray.from_arrays(pa.array(np.arange(0, 4001, 4), pa.int32()), pa.array(m.ravel()))
    whole = pa.RecordBatch.from_arrays([ids, col], names=["id", "_v"])
    run = lambda parts: sorted(x for b in V.score_kernel(pa.array(range(9)), q, 5, "id", "_v", 4, False)(parts)
                               for x in zip(*(c.to_pylist() for c in b.columns)))
    got = run([whole.slice(i, 37) for i in range(0, 1000, 37)])
    assert got == run([whole]) and len(got) == 45


def test_kernel_equals_doubles(tmp_path):
    """float32 products only leave out what cannot win: close scores, copies, zero rows, self pairs."""
    import pyarrow as pa
    from papyra.functions import vectors as V
    rng = np.random.default_rng(5)
    base = rng.normal(size=(700, 16))
    m = np.vstack([base, base[:300] + 1e-7 * rng.normal(size=(300, 16)), base[:40], np.zeros((3, 16)),
                   np.tile(base[0], (1800, 1))])
    ids = rng.permutation(len(m))
    q = np.vstack([base[:50], base[:20] + 1e-6, np.zeros((1, 16)), rng.normal(size=(30, 16))])
    qids = np.r_[ids[:50], -1 - np.arange(len(q) - 50)]
    col = pa.ListArray.from_arrays(pa.array(np.arange(0, m.size + 1, 16), pa.int32()), pa.array(m.ravel()))
    whole = pa.RecordBatch.from_arrays([pa.array(ids), col], names=["id", "_v"])
    s = np.round(V.unit_rows(m) @ V.unit_rows(q).T, 6)
    for exclude in (False, True):
        want = set()
        for j, qid in enumerate(qids):
            order = sorted((-s[i, j], ids[i]) for i in range(len(m)) if not (exclude and ids[i] == qid))[:7]
            want |= {(qid, i, -x) for x, i in order}
        for size in (len(m), 900, 61):
            got = [x for b in V.score_kernel(pa.array(qids), q, 7, "id", "_v", 16, exclude)(
                [whole.slice(i, size) for i in range(0, len(m), size)]) for x in zip(*(c.to_pylist() for c in b.columns))]
            assert len(got) == 7 * len(q) and set(got) == want


def test_clustered_blocks_copy_no_query_per_probe(spark, vectors):
    df = spark.createDataFrame([(i, v, i % 6) for i, v in vectors], "id long, vec array<double>, label int")
    cen = K.label_centroids(df, "label")
    corpus = df.withColumn("cluster_id", F.col("label").cast("long"))
    q = df.where("id < 90").withColumnRenamed("id", "query_id")
    for n_probe in (2, 6):
        want = as_dict(K.clustered_knn(corpus, cen, q, 5, n_probe=n_probe, exclude_self=True, method="broadcast"))
        assert as_dict(K.clustered_knn(corpus, cen, q, 5, n_probe=n_probe, exclude_self=True, method="blocks",
                                       max_block_bytes=2048)) == want
    # beyond the broadcast bound, with more probes than corpus blocks, no join by cluster is planned
    found = K.clustered_knn(corpus, cen, q, 5, n_probe=6, max_block_bytes=4096)
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()


def test_cluster_count_grows():
    assert [K.cluster_count(n) for n in (5, 500, 2560, 50_000)] == [10, 50, 256, 256]
    assert 4000 < K.cluster_count(1_000_000) < 8192 < K.cluster_count(10_000_000)


def test_recall_at_the_default_probes(spark):
    """A clustered corpus searched without a probe count keeps recall@10 of 0.9."""
    import random

    from papyra.operators import retrieval as R

    rng = random.Random(3)
    v = spark.createDataFrame([(i, [rng.gauss(0, 1) for _ in range(32)]) for i in range(1500)], "doc_id long, vec array<double>")
    assigned, cen = K.kmeans_index(v, 150, max_iter=3)
    assigned, cen = R.materialize(assigned, "assigned"), R.materialize(cen, "centroids")
    q = v.where("doc_id < 100").select(F.col("doc_id").alias("query_id"), F.col("vec").alias("qvec"))
    papers = v.select("doc_id", F.lit("").alias("combined_text"))

    def pairs(centroids):
        corpus = R.prepare_corpus(papers, assigned, centroids)
        return {(r.query_id, r.doc_id) for r in R.retrieve(q, corpus, 10, dim=32).collect()}
    exact = pairs(None)
    assert len(exact) == 1000 and len(exact & pairs(cen)) >= 900


@pytest.mark.parametrize("text_ids", [False, True])
def test_bounds_rise_with_every_tile(monkeypatch, text_ids):
    """The hits a task keeps and scores in doubles stay near what can survive, with the
    rows of brute force, where ids and vectors repeat and others are not finite."""
    import pyarrow as pa

    from papyra.functions import vectors as V

    monkeypatch.setattr(V, "TILE_ROWS", 256)
    rng = np.random.default_rng(5)
    n, m, k = 6_000, 40, 10
    d = np.abs(rng.standard_normal((n, 16)))
    d[1000:1020] = d[:20]
    d[77, 3] = np.nan
    numbers = rng.integers(0, n - 500, n)
    ids = pa.array([f"v{i}" for i in numbers]) if text_ids else pa.array(numbers)
    q, qids = d[::n // m][:m].copy(), ids.take(pa.array(np.arange(0, n, n // m)[:m]))
    rescored, add = [], V.RunningTopK.add

    def counted(self, cols, got, scores):
        rescored.append(len(cols))
        add(self, cols, got, scores)
    monkeypatch.setattr(V.RunningTopK, "add", counted)
    table = pa.table({"id": ids, "_v": pa.FixedSizeListArray.from_arrays(pa.array(d.ravel()), 16).cast(pa.list_(pa.float64()))})
    out = list(V.score_kernel(qids, q, k, "id", "_v", 16, True)(table.to_batches(max_chunksize=1000)))
    got = sorted(x for b in out for x in zip(*(b.column(i).to_pylist() for i in range(3))))
    scores = np.round(V.unit_rows(d) @ V.unit_rows(q).T, V.SCORE_DECIMALS)
    want = []
    for c, mine in enumerate(qids.to_pylist()):
        rows = [(-scores[r, c], i) for r, i in enumerate(ids.to_pylist()) if i != mine and np.isfinite(scores[r, c])]
        want += [(mine, i, -x) for x, i in sorted(rows)[:k]]
    assert got == sorted(want)
    # k for the first rows, then k / j for the j-th part as large: few times k in all
    assert sum(rescored) < 5 * k * m


def test_query_blocks_hold_the_hits():
    """A block is bounded by its hits as well as by its vectors."""
    assert K.query_bytes(256, 50) >= 8 * 256 + 20 * 50


def test_corpus_parts_stream_past_a_block(spark, monkeypatch):
    """A query gives k hits for each part of the corpus, not for each stretch of a block's
    size, and the corpus vectors are made once."""
    rng = np.random.default_rng(11)
    m = rng.standard_normal((2_000, 8)).tolist()
    made = spark.sparkContext.accumulator(0)

    def encode(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b
    df = spark.createDataFrame(list(enumerate(m)), "id long, vec array<double>")
    q = df.where("id < 100").withColumnRenamed("id", "query_id")
    scored, top_k = [], K.top_k

    def counted(rows, *a, **b):
        scored.append(rows)
        return top_k(rows, *a, **b)
    monkeypatch.setattr(K, "top_k", counted)
    got = as_dict(K.exact_knn(df.mapInArrow(encode, df.schema), q, 5, dim=8, max_block_bytes=4096))
    assert made.value == 2_000
    assert scored[0].count() == 100 * 5         # one part: 2,000 rows are fewer than PART_ROWS
    assert got == brute(list(enumerate(m)), list(enumerate(m[:100])), 5)


def test_corpus_parts():
    assert K.corpus_parts(0, 256, 3, 12) == 1
    assert K.corpus_parts(1_700_000, 256, 41, 12) == 13             # by bytes
    assert K.corpus_parts(300_000, 256, 7, 12) == 7                 # by cores
    assert K.corpus_parts(1_700_000, 256, 4_100, 12) == 13


def test_scores_in_doubles_need_little_memory():
    """Candidates are scored in doubles a cache's worth at a time."""
    import tracemalloc

    from papyra.functions import vectors as V

    rng = np.random.default_rng(2)
    d, q = V.unit_rows(rng.standard_normal((4_096, 256))), V.unit_rows(rng.standard_normal((900, 256)))
    best, d32, q32 = V.RunningTopK(900, 50, "id"), d.astype(np.float32), q.astype(np.float32)
    tracemalloc.start()
    rows, cols, score = V.reaching(best, np.arange(900), d, d32, q, q32)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (np.bincount(cols, minlength=900) >= 50).all()
    assert np.allclose(score, (d[rows] * q[cols]).sum(axis=1), atol=1e-6)
    assert peak < 64e6          # the products are 15 MB


def test_encoding_is_bounded_by_rows():
    """A batch of long token lists is counted a bounded number of rows at a time."""
    import pyarrow as pa

    from papyra.functions import vectors as V

    lists = pa.array([list(range(i % 7)) * 2 for i in range(3_000)], pa.list_(pa.int64()))
    out = list(V.bucket_count_kernel("b", 8, "v")([pa.RecordBatch.from_arrays([pa.array(range(3_000)), lists], ["id", "b"])]))
    assert max(b.num_rows for b in out) <= V.ENCODED_ROWS and sum(b.num_rows for b in out) == 3_000
    got = {i: v for b in out for i, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist())}
    for i in (0, 1, 6, 1_025, 2_999):
        want = np.bincount(np.array(lists[i].as_py(), int), minlength=8).astype(float)
        assert np.allclose(got[i], want / (np.linalg.norm(want) or 1))


def test_query_blocks_come_in_rounds(spark, monkeypatch):
    """The copies of the corpus are made for a few query blocks at a time and are gone with
    their round, like the tables behind the hits. A query id that many queries share does
    not fill one block, and its rows are merged over the blocks."""
    import os

    from papyra.session import ensure_checkpoint_dir

    rng = np.random.default_rng(4)
    m = rng.standard_normal((300, 8)).tolist()
    df = spark.createDataFrame(list(enumerate(m)), "id long, vec array<double>")
    q = df.where("id < 120").select(F.when(F.col("id") >= 20, F.col("id")).otherwise(-1).alias("query_id"), "vec")
    here = ensure_checkpoint_dir(spark)
    before = set(os.listdir(here))
    assert [K.round_blocks(p, 12) for p in (1, 13, 48, 100)] == [48, 4, 1, 1]
    rounds, materialize = [], K.materialize

    def noted(rows, name="table"):
        rounds.append(rows._jdf.queryExecution().optimizedPlan().toString())
        return materialize(rows, name)
    monkeypatch.setattr(K, "materialize", noted)
    monkeypatch.setattr(K, "round_blocks", lambda parts, cores: 3)
    found = K.exact_knn(df, q, 4, dim=8, max_block_bytes=2048)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "MapInArrow" not in plan
    assert len(rounds) == 4 and all("Generate" in p for p in rounds)        # ten blocks
    assert {n.rsplit("-", 1)[0] for n in set(os.listdir(here)) - before} == {"block-hits"}
    scores = np.round(np.array([v / np.linalg.norm(v) for v in np.array(m)])[:20] @ np.array([v / np.linalg.norm(v) for v in np.array(m)]).T, 6)
    want = sorted((-scores[i, j], j) for i in range(20) for j in range(300))[:4]
    got = sorted((r["rank"], -r["score"], r["id"]) for r in found.where("query_id = -1").collect())
    assert [(abs(s + 1) < 1e-5, r) for r, s, _ in got] == [(True, i) for i in (1, 2, 3, 4)]
    assert sorted(j for _, _, j in got) == sorted(j for _, j in want) and found.count() == 101 * 4

    blocks, _ = K.query_blocks(spark.range(4_000).select(F.lit(7).alias("qid"), F.array(F.lit(1.0)).alias("qvec")), 8)
    sizes = [r["count"] for r in blocks.groupBy("_block").count().collect()]
    assert len(sizes) == 8 and max(sizes) < 700


def test_written_tables_leave_no_shuffle_files(spark):
    import time

    from papyra.session import SHUFFLE_CLEANUP, materialize

    spark._jvm.System.gc()
    files = lambda: {f.getName() for f in
                     _list(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles())
                     if f.getName().startswith("shuffle_")}
    before, set_to = files(), spark.conf.get(SHUFFLE_CLEANUP, None)
    back = materialize(spark.range(5_000).repartition(3).groupBy((F.col("id") % 7).alias("k")).count(), "counts")
    end = time.time() + 20
    while files() - before and time.time() < end:
        time.sleep(0.2)
    assert not files() - before
    assert back.count() == 7 and spark.conf.get(SHUFFLE_CLEANUP, None) == set_to


def _list(seq):
    return [seq.apply(i) for i in range(seq.size())]
