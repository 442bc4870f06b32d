"""Incremental index updates: availableNow streams over new files, replay
safety, first build vs forced rebuild, cache log upserts."""

import json

from pyspark.sql import functions as F

from papyra.operators import knn as K
from papyra.operators import papers as P
from papyra.schemas import RAW
from papyra.streaming import incremental as I


def paper(i, text_len=80):
    return {"id": f"2301.{i:05d}", "title": f"Title {i}", "abstract": ("word " * 40)[:text_len] + f" n{i}",
            "categories": "cs.AI", "update_date": "2023-01-01"}


def write_batch(d, name, ids, dup=None):
    rows = [paper(i) for i in ids] + ([paper(dup)] if dup is not None else [])
    (d / name).write_text("\n".join(json.dumps(r) for r in rows) + "\n")


def test_index_stream_is_idempotent(spark, tmp_path):
    src = tmp_path / "incoming"
    src.mkdir()
    index, stats = str(tmp_path / "index"), str(tmp_path / "stats")
    write_batch(src, "a.json", range(0, 10), dup=3)           # duplicate inside the batch
    q = I.start_index_stream(spark, str(src), index, str(tmp_path / "ck1"), stats, language=None)
    q.awaitTermination()
    assert I.read_index(spark, index).count() == 10
    write_batch(src, "b.json", range(5, 15))                  # 5 known, 5 new
    q = I.start_index_stream(spark, str(src), index, str(tmp_path / "ck1"), stats, language=None)
    q.awaitTermination()
    idx = I.read_index(spark, index)
    assert idx.count() == 15 and idx.select("id").distinct().count() == 15
    last = spark.read.parquet(stats).orderBy(F.col("at").desc()).first()
    assert (last["existing"], last["added"], last["duplicates"], last["total_after"]) == (10, 5, 5, 15)
    # a batch that is run again (same stream and batch) changes neither rows nor counters
    before = sorted((r["stream"], r["batch_id"], r["existing"], r["added"]) for r in spark.read.parquet(stats).collect())
    batch = P.build_papers(spark.read.schema(RAW).json(str(src / "b.json")), language=None)
    I.add_batch(batch, index, stats_path=stats, batch_id=1, stream="stream")
    after = sorted((r["stream"], r["batch_id"], r["existing"], r["added"]) for r in spark.read.parquet(stats).collect())
    assert before == after == [("stream", 0, 0, 10), ("stream", 1, 10, 5)]
    # replay everything with a fresh checkpoint: nothing is added twice
    q = I.start_index_stream(spark, str(src), index, str(tmp_path / "ck2"), None, language=None)
    q.awaitTermination()
    assert I.read_index(spark, index).count() == 15


def test_build_and_rebuild(spark, tmp_path):
    raw = spark.createDataFrame([paper(i) for i in range(4)])
    papers = P.build_papers(raw.select("id", "title", "abstract", "categories", "update_date")
                            .withColumn("authors", F.lit(None).cast("string"))
                            .withColumn("authors_parsed", F.lit(None).cast("array<array<string>>"))
                            .withColumn("submitter", F.lit(None).cast("string"))
                            .withColumn("doi", F.lit(None).cast("string"))
                            .withColumn("journal-ref", F.lit(None).cast("string")), language=None)
    path = str(tmp_path / "idx")
    assert I.build_index(papers, path) is True
    assert I.build_index(papers, path) is False               # exists, not forced
    assert I.build_index(papers.limit(2), path, force=True) is True
    assert I.read_index(spark, path).count() == 2


def test_cache_stream(spark, tmp_path):
    src = tmp_path / "entries"
    src.mkdir()
    (src / "1.json").write_text(json.dumps({"key": "k", "summary": "old", "ts": "2024-01-01T00:00:00",
                                            "title": "t"}) + "\n")
    log = str(tmp_path / "log")
    I.start_cache_stream(spark, str(src), log, str(tmp_path / "ck")).awaitTermination()
    (src / "2.json").write_text(json.dumps({"key": "k", "summary": "new", "ts": "2024-02-01T00:00:00",
                                            "title": "t"}) + "\n")
    I.start_cache_stream(spark, str(src), log, str(tmp_path / "ck")).awaitTermination()
    cur = I.current_cache(spark, log).collect()
    assert [(r["key"], r["summary"]) for r in cur] == [("k", "new")]


def rows(spark, ids, text="word"):
    return spark.createDataFrame([(f"p{i}", f"{text} title {i}", f"{text} abstract {i % 3} x{i}",
                                   f"{text} title {i}. {text} abstract {i % 3} x{i}") for i in ids],
                                 "id string, title string, abstract string, combined_text string")


def test_changed_text_gets_a_new_vector(spark, tmp_path):
    path = str(tmp_path / "idx")
    I.build_index(rows(spark, range(6)), path)
    I.add_batch(rows(spark, [1, 2]).unionByName(rows(spark, [3], "changed")), path, batch_id=4)
    assert I.read_index(spark, path).count() == 7
    now = {r["id"]: r for r in I.current_index(spark, path).collect()}
    assert len(now) == 6 and now["p3"]["batch_id"] == 4 and now["p1"]["stream"] == "build"


def test_clustered_build_and_update_are_one_index(spark, tmp_path):
    from papyra.operators import index as IX
    path = str(tmp_path / "idx")
    I.build_index(rows(spark, range(40)), path, clustered=True, n_clusters=4, hybrid=True)
    I.add_batch(rows(spark, range(30, 50)), path, hybrid=True, batch_id=1)
    vectors, centroids = IX.read_index(spark, path)
    assert vectors.count() == 50 and centroids.count() == 4
    assert vectors.where("cluster_id IS NULL OR NOT hybrid").count() == 0
    q = vectors.where("id IN ('p3', 'p45')").select(F.col("id").alias("query_id"), "vec")
    best = K.clustered_knn(vectors, centroids, q, 1, n_probe=1).collect()
    assert {(r["query_id"], r["id"]) for r in best} == {("p3", "p3"), ("p45", "p45")}


def test_hot_cluster_is_several_files(spark, tmp_path):
    import glob
    from papyra.operators import index as IX
    df = spark.range(1000).select("id", F.lit("m").alias("model"), F.array(F.lit(1.0)).alias("vec"),
                                  F.when(F.col("id") < 900, 0).otherwise(F.col("id") % 5).cast("long").alias("cluster_id"))
    IX.write_index(df, str(tmp_path), rows_per_file=100)
    assert len(glob.glob(f"{tmp_path}/vectors/model=m/cluster_id=0/*.parquet")) > 3
