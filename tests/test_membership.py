"""The key table and index updates that rest on it."""

import glob
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from papyra.operators import index as IX
from papyra.operators import membership as M
from papyra.streaming import incremental as I

PAPER = "id string, title string, abstract string, combined_text string"


def ids(spark, names):
    return spark.createDataFrame([(n, len(n or "")) for n in names], "id string, size int")


def test_filters_have_no_false_negatives():
    rng = np.random.default_rng(0)
    h1, h2 = rng.integers(-2 ** 63, 2 ** 63 - 1, (2, 5000))
    f = M.bloom(h1, h2)
    assert M.may_hold([f], h1, h2).all()
    o1, o2 = rng.integers(-2 ** 63, 2 ** 63 - 1, (2, 20000))
    assert M.may_hold([f], o1, o2).mean() < 0.03
    assert not M.may_hold([], h1, h2).any()


def test_lookup_opens_only_reachable_buckets(spark, tmp_path):
    table = M.KeyTable(spark, str(tmp_path / "keys"))
    assert table.lookup(ids(spark, ["a"])) is None
    table.create()
    table.add(ids(spark, [f"k{i}" for i in range(300)] + [None]))
    table.add(ids(spark, ["late"]))
    found = table.lookup(ids(spark, ["k7", "late", "new", None]))
    assert sorted(r.id for r in found.collect()) == ["k7", "late"]
    opened = {f.split("bucket=")[1].split("/")[0] for f in found.inputFiles()}
    assert 1 <= len(opened) <= 3 < len(glob.glob(f"{tmp_path}/keys/keys/bucket=*"))
    assert "bucket" not in found.columns and found.columns == ["id", "size"]
    # new ids: hardly any bucket is opened
    assert len(table.reachable(ids(spark, [f"n{i}" for i in range(20)]))) <= 5
    dense = table.compact(str(tmp_path / "dense"))
    assert sorted(r.id for r in dense.lookup(ids(spark, ["k7", "late", "new"])).collect()) == ["k7", "late"]
    with pytest.raises(ValueError, match="holds a key table"):
        table.compact(str(tmp_path / "dense"))


def papers(spark, rows, parts=3):
    rows = [(i, f"t {t}", f"a {t}", f"t {t}. a {t}") for i, t in rows]
    return spark.createDataFrame(rows, PAPER).repartition(parts)


def contents(spark, path):
    return sorted((r.id, r.text_md5, r.stream, r.batch_id) for r in I.read_index(spark, path).collect())


def test_one_winner_in_any_order(spark):
    rows = [("x", f"text {i}") for i in range(6)] + [("y", "one")]
    seen = set()
    for seed in range(5):
        random.Random(seed).shuffle(rows)
        df = papers(spark, rows, 1 + seed)
        seen.add(tuple(sorted(r.title for r in IX.first_per_id(df).collect())))
    assert len(seen) == 1


def test_replay_in_any_order_adds_nothing(spark, tmp_path):
    path, stats = str(tmp_path / "idx"), str(tmp_path / "stats")
    rows = [(f"p{i % 7}", f"text {i}") for i in range(20)]
    I.add_batch(papers(spark, rows), path, stats_path=stats, batch_id=3, stream="s")
    before, counted = contents(spark, path), spark.read.parquet(stats).drop("at").collect()
    assert len(before) == 7
    for seed in range(3):
        random.Random(seed).shuffle(rows)
        I.add_batch(papers(spark, rows, 1 + seed), path, stats_path=stats, batch_id=3, stream="s")
        assert contents(spark, path) == before and spark.read.parquet(stats).drop("at").collect() == counted
    I.add_batch(papers(spark, rows), path, stats_path=stats, batch_id=0, stream="other")
    assert contents(spark, path) == before
    last = spark.read.parquet(stats).where("stream = 'other'").first()
    assert (last.existing, last.added, last.duplicates, last.total_after) == (7, 0, 7, 7)


def test_attempt_that_stopped_before_its_keys(spark, tmp_path):
    path, stats = str(tmp_path / "idx"), str(tmp_path / "stats")
    I.add_batch(papers(spark, [("a", "1"), ("b", "2")]), path, batch_id=0, stream="s")
    done = M.KeyTable.add
    M.KeyTable.add = lambda self, rows: (_ for _ in ()).throw(RuntimeError("lost"))
    batch = [("b", "2"), ("c", "3"), ("d", "4")]
    try:
        with pytest.raises(RuntimeError):
            I.add_batch(papers(spark, batch), path, stats_path=stats, batch_id=1, stream="s")
    finally:
        M.KeyTable.add = done
    half = contents(spark, path)
    assert len(half) == 4
    I.add_batch(papers(spark, batch), path, stats_path=stats, batch_id=1, stream="s")
    assert contents(spark, path) == half
    assert I.key_table(spark, path).all().count() == 4
    last = spark.read.parquet(stats).first()
    assert (last.existing, last.added, last.duplicates, last.total_after) == (2, 2, 1, 4)


def test_compacted_index_goes_on(spark, tmp_path):
    path, to = str(tmp_path / "idx"), str(tmp_path / "new")
    I.build_index(papers(spark, [(f"p{i}", str(i)) for i in range(10)]), path, clustered=True, n_clusters=2)
    for b in range(3):
        I.add_batch(papers(spark, [(f"p{i}", f"changed {b}" if i == 3 else str(i)) for i in range(9 + b, 12 + b)] + [("p3", f"v{b}")]),
                    path, batch_id=b)
    now = {(r.id, r.text_md5) for r in I.current_index(spark, path).collect()}
    I.compact_index(spark, path, to)
    assert {(r.id, r.text_md5) for r in I.read_index(spark, to).collect()} == now
    assert len(glob.glob(f"{to}/vectors/**/*.parquet", recursive=True)) < len(glob.glob(f"{path}/vectors/**/*.parquet", recursive=True))
    I.add_batch(papers(spark, [("p3", "v2"), ("p20", "20")]), to, stats_path=str(tmp_path / "stats"), batch_id=9)
    assert I.read_index(spark, to).count() == len(now) + 1
    last = spark.read.parquet(str(tmp_path / "stats")).first()
    assert (last.existing, last.added, last.duplicates) == (len(now), 1, 1)
    assert I.read_index(spark, to).where(F.col("cluster_id").isNull()).count() == 0
