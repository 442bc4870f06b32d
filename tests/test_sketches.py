"""Stored sketches, merged on read; counters taken while writing."""

import json
import random

from pyspark.sql import functions as F

from papyra.operators import analytics as AN
from papyra.operators import papers as P
from papyra.operators import sketches as K
from papyra.sources import files as S

PAPERS = "id string, text_length int, word_count int, update_date timestamp, authors array<string>, categories array<string>"


def rows(n, seed):
    rng = random.Random(seed)
    return [(str(i), rng.randint(50, 5000), rng.randint(5, 900), None,
             rng.choice([None, [], [f"a{rng.randint(0, 3000)}", f"a{rng.randint(0, 9)}"]]), ["x", f"c{i % 7}"]) for i in range(n)]


def test_merged_arrivals(spark, tmp_path):
    path = str(tmp_path / "stats")
    first, second = rows(3000, 1), rows(2000, 2)
    make = lambda r: spark.createDataFrame(r, PAPERS)
    K.record_arrival(make(rows(50, 9)), path, "b")      # replaced by the next
    K.record_arrival(make(second), path, "b")
    K.record_arrival(make(first), path, "a")
    both = make(first + second)
    exact = AN.corpus_stats(both).first()
    got = K.corpus_totals(spark, path).first()
    assert got.total_papers == 5000 and abs(got.avg_text_length - exact.avg_text_length) < 1e-9
    true = AN.distinct_authors(both).first()[0]
    assert abs(got.unique_authors - true) < 0.05 * true
    lengths = sorted(r[1] for r in first + second)
    assert abs(sum(x <= got.median_text_length for x in lengths) / 5000 - 0.5) < 0.015
    assert sorted(K.category_totals(spark, path).collect()) == sorted(AN.category_distribution(both).collect())
    counts = {}
    for r in first + second:
        for a in r[4] or []:
            counts[a] = counts.get(a, 0) + 1
    want = sorted(counts.values(), reverse=True)[:5]
    top = [(r.author, r.papers) for r in K.top_authors(spark, path, 5).collect()]
    assert [n for _, n in top] == want and all(counts[a] == n for a, n in top)


def test_empty_arrival(spark, tmp_path):
    path = str(tmp_path / "stats")
    K.record_arrival(spark.createDataFrame([], PAPERS), path, "a")
    K.record_arrival(spark.createDataFrame(rows(5, 1), PAPERS), path, "b")
    assert K.corpus_totals(spark, path).first().total_papers == 5


def test_describe_sketched(spark):
    rng = random.Random(3)
    data = [(rng.gauss(0, 1), float(i)) for i in range(20_000)] + [(None, None), (float("nan"), 1.0)]
    df = spark.createDataFrame(data, "x double, y double").repartition(5)
    got = {(r["column"], r["stat"]): r["value"] for r in K.describe_sketched(df, ["x", "y"]).collect()}
    exact = {(r["column"], r["stat"]): r["value"] for r in AN.describe(df.where(~F.isnan("x")), ["x"]).collect()}
    assert got["x", "count"] == 20_000 and got["y", "count"] == 20_001
    for s in ("mean", "std", "min", "max"):
        assert abs(got["x", s] - exact["x", s]) < 1e-6
    xs = sorted(x for x, _ in data if x is not None and x == x)
    for s, p in (("25%", 0.25), ("50%", 0.5), ("75%", 0.75)):
        assert abs(sum(x <= got["x", s] for x in xs) / len(xs) - p) < 0.012
    none = {(r["column"], r["stat"]): r["value"] for r in K.describe_sketched(df.limit(0), ["x"]).collect()}
    assert none["x", "count"] == 0 and none["x", "50%"] is None


def test_counters_of_the_writing_pass(spark, tmp_path):
    good = [{"id": str(i), "title": f"t {i}", "abstract": "word " * n, "categories": "cs.AI"} for i, n in enumerate([5, 20, 30, 900])]
    src = tmp_path / "raw.json"
    src.write_text("\n".join([json.dumps(r) for r in good] + ["{broken", json.dumps({"id": "x"})]) + "\n")
    raw = S.read_raw(spark, str(src), "jsonl")
    counts = P.write_papers(raw, str(tmp_path / "papers"), language=None)
    written = spark.read.parquet(str(tmp_path / "papers"))
    assert written.count() == counts["kept"] == 2 and counts["malformed"] == 1 and counts["total"] == 5
    want = P.ingest_counters(S.good_records(raw), language=None).first().asDict()
    assert {k: counts[k] for k in want if k != "success_pct"} == {k: v for k, v in want.items() if k != "success_pct"}
    assert P.write_papers(S.read_raw(spark, str(src), "jsonl").where("id = 'none'"), str(tmp_path / "e"), language=None)["total"] == 0
