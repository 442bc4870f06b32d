"""Nothing is cut silently: whole texts, all queries, all ids, all counts."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from papyra.functions import encode as E
from papyra.functions import text as T
from papyra.operators import analytics as AN
from papyra.operators import results as RS
from papyra.operators import retrieval as R
from papyra.operators import sampling as SM
from papyra.operators import summaries as SU


def corpus(spark, n):
    return spark.range(n).select(
        F.col("id").alias("doc_id"), F.format_string("2301.%05d", "id").alias("id"),
        F.format_string("title word%d", "id").alias("title"), F.lit("common text of every paper").alias("abstract"),
        F.format_string("title word%d. common text of every paper", "id").alias("combined_text"),
        F.array(F.lit("cs.AI")).alias("categories"), F.lit(dt.datetime(2023, 1, 1)).alias("update_date"),
        F.array(F.lit("Au")).alias("authors"))


def test_every_token_counts(spark):
    long = " ".join(f"t{i}" for i in range(512))
    df = spark.createDataFrame([(1, long), (2, long + " extra")], "i int, x string")
    a, b = [r["vec"] for r in E.hash_encode(df, "x").orderBy("i").collect()]
    assert a != b
    c, d = [r["vec"] for r in E.hash_encode(df, "x", max_tokens=512).orderBy("i").collect()]
    assert c == d


def test_rerank_cap_never_below_top_k(spark):
    q = spark.createDataFrame([(1, "common text word7")], "query_id long, query string")
    opts = R.SearchOptions(top_k=200, min_similarity=-1.0, generate_summaries=False)
    assert R.search(q, corpus(spark, 300), opts).count() == 200
    assert R.SearchOptions(top_k=10).pool == 50 and R.SearchOptions(top_k=30).pool == 100
    assert R.SearchOptions(top_k=30, rerank_cap=500).pool == 150


def test_overview_also_without_hits(spark):
    q = spark.createDataFrame([(1, "common text"), (2, "   "), (3, "zzz")], "query_id long, query string")
    plain = R.SearchOptions(use_reranking=False)
    out = {r["query_id"]: r for r in R.search_overview(q, corpus(spark, 5), dt.date(2024, 1, 1), plain).collect()}
    assert set(out) == {1, 2, 3} and out[1]["total_results"] > 0 and len(out[1]["results"]) == out[1]["total_results"]
    assert out[2]["overview"] == "No papers found." and out[2]["results"] == [] and out[2]["total_results"] == 0
    prompts = {r["query_id"]: r["prompt"] for r in RS.batch_prompt(q, R.search(q, corpus(spark, 5), plain)).collect()}
    assert set(prompts) == {1, 2, 3} and prompts[2] is None and prompts[1]


def test_similar_papers_leave_the_probe_out(spark):
    p = corpus(spark, 20)
    probes = spark.createDataFrame([(3,), (4,), (999,)], "doc_id long")
    rows = R.similar_papers(probes, p, 5, R.SearchOptions(min_similarity=-1.0)).collect()
    assert {r["query_id"] for r in rows} == {3, 4}
    for q in (3, 4):
        mine = sorted((r["rank"], r["doc_id"]) for r in rows if r["query_id"] == q)
        assert [x for x, _ in mine] == [1, 2, 3, 4, 5] and q not in [d for _, d in mine]


def test_diverse_sample_with_repeated_ids(spark):
    p = corpus(spark, 60).withColumn("categories", F.array(F.format_string("c%d", F.col("doc_id") % 7)))
    twice = p.unionByName(p.withColumn("abstract", F.lit("second row"))).unionByName(p.limit(5))
    out = SM.sample_diverse(twice, 40)
    rows = out.collect()
    assert len(rows) == 40 and len({r["id"] for r in rows}) == 40 and out.columns == twice.columns + ["sample_order"]


def test_exact_median_without_one_group_in_a_task(spark):
    df = spark.range(2001).select(F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("g"),
                                  (F.xxhash64("id") % 1000 / 7).alias("v")).unionByName(
        spark.createDataFrame([("c", 1.5), ("c", None), ("d", None)], "g string, v double"))
    got = {r["g"]: r["median_latency_ms"] for r in RS.latency_profile(df, "v", ["g"]).collect()}
    want = {r["g"]: r["m"] for r in df.groupBy("g").agg(F.round(F.median("v"), 6).alias("m")).collect()}
    assert got == want
    whole = RS.latency_profile(df, "v").first()["median_latency_ms"]
    assert whole == df.agg(F.round(F.median("v"), 6)).first()[0]


def test_plans_read_their_table_once(spark, tmp_path):
    corpus(spark, 30).withColumn("word_count", F.lit(3)).write.parquet(str(tmp_path / "p"))
    p = spark.read.parquet(str(tmp_path / "p"))
    cache = SU.with_keys(p.limit(3)).select("key", F.lit("s").alias("summary"), F.current_timestamp().alias("ts"), "title")
    for df, scans in ((AN.category_share(p), 1), (AN.corpus_kpis(p, dt.date(2024, 1, 1)), 1),
                      (AN.trending_categories(p, dt.date(2023, 1, 2)), 1), (SU.lookup(p, cache), 2)):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Relation [") == scans, plan


@pytest.mark.parametrize("size,unit", [(1 << 50, "TB"), (5 << 60, "TB"), (1 << 40, "TB")])
def test_huge_sizes_format(spark, size, unit):
    out = spark.createDataFrame([(size,)], "n long").select(T.format_file_size("n").alias("s")).first()["s"]
    assert out.endswith(" " + unit)


def test_checkpoint_folder_is_required_off_local(monkeypatch):
    from papyra import session

    class Conf:
        def get(self, *a):
            return None

    class Context:
        applicationId, master = "none", "spark://host:7077"

        def getConf(self):
            return Conf()

    class Session:
        sparkContext, conf = Context(), Conf()
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.ensure_checkpoint_dir(Session())
