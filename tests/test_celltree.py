"""The cell index: exact with full covering angles, few lost hits when tuned."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from papyra.functions import vectors as V
from papyra.operators import celltree as C
from papyra.operators import knn as K


def table(spark, x, names="id long, vec array<double>", ids=None):
    ids = range(len(x)) if ids is None else ids
    return spark.createDataFrame([(i, [float(c) for c in v]) for i, v in zip(ids, x)], names).repartition(4)


def data(n=400, d=12, seed=0):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(8, d))
    x = centers[rng.integers(0, 8, n)] + 0.5 * rng.normal(size=(n, d))
    x[5:25] = x[5]                      # copies: ties
    x[30 % n] = 0
    return x


def rows(df):
    return sorted(map(tuple, df.select("query_id", "id", "score", "rank").collect()))


def test_full_angles_are_exact(spark, tmp_path, monkeypatch):
    x = data()
    v = table(spark, x)
    queries = v.where("id < 60").withColumnRenamed("id", "query_id")
    want = rows(K.exact_knn(v, queries, 7))
    index = C.build(v, str(tmp_path / "a"))
    hits, scored = C.search(index, queries, 7, slack=1.0)
    assert rows(hits) == want
    assert 0 < scored.agg(F.sum("scored")).first()[0] < 60 * 400
    hits, _ = C.search(index, queries, 7, slack=1.0, exclude_self=True)
    assert rows(hits) == rows(K.exact_knn(v, queries, 7, exclude_self=True))
    hits, _ = C.search(index, queries, 7, slack=1.0, max_block_bytes=2000)          # several query blocks
    assert rows(hits) == want
    monkeypatch.setattr(C, "BLOCK_ROWS", 40)        # a cluster of several blocks
    monkeypatch.setattr(C, "CELL_CAP", 6)
    hits, _ = C.search(C.build(v, str(tmp_path / "b"), cell_rows=5), queries, 7, slack=1.0)
    assert rows(hits) == want


def test_text_ids_and_small_tables(spark, tmp_path):
    x = data(20, 3, 1)
    v = table(spark, x, "id string, vec array<double>", [f"k{i}" for i in range(20)])
    q = v.withColumnRenamed("id", "query_id")
    hits, _ = C.search(C.build(v, str(tmp_path / "a")), q, 30, slack=1.0)           # k above the table
    assert rows(hits) == rows(K.exact_knn(v, q, 30))
    zero = table(spark, np.zeros((3, 3)))
    hits, _ = C.search(C.build(zero, str(tmp_path / "z")), zero.withColumnRenamed("id", "query_id"), 2)
    assert [r[1:] for r in rows(hits)] == [(0, 0.0, 1), (1, 0.0, 2)] * 3
    hits, scored = C.search(C.load(spark, str(tmp_path / "z")), zero.where("id < 0").withColumnRenamed("id", "query_id"), 2)
    assert hits.count() == 0 and scored.count() == 0
    with pytest.raises(Exception, match="expected 3"):
        C.search(C.load(spark, str(tmp_path / "z")), table(spark, np.ones((1, 2))).withColumnRenamed("id", "query_id"), 2)


def test_cells_cover_their_members(spark, tmp_path):
    x = data()
    index = C.build(table(spark, x), str(tmp_path / "a"))
    unit = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    centers = {r.cluster_id: np.array(r.vec) for r in index.centers.collect()}
    seen = []
    for r in index.cells.collect():
        assert len(r.ids) == r.n <= C.CELL_CAP
        assert np.allclose(np.array(r.vecs).reshape(r.n, -1), x[r.ids])
        for i in r.ids:
            seen.append(i)
            if unit[i].any():
                assert np.arccos(np.clip(unit[i] @ np.array(r.center), -1, 1)) <= r.radius + 1e-6
                assert np.arccos(np.clip(unit[i] @ centers[r.cluster_id], -1, 1)) <= r.reach + 1e-6
    assert sorted(seen) == list(range(400))


def test_tuned_slack_keeps_hits_and_reads_less(spark, tmp_path):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(1500, 24))
    v, q = table(spark, x), table(spark, rng.normal(size=(120, 24))).withColumnRenamed("id", "query_id")
    path = str(tmp_path / "a")
    index = C.build(v, path)
    tuned = C.tune(index, path, q.where("query_id % 3 = 0"), 10, recall=0.95)
    assert 0 < tuned.slack < 1 and C.load(spark, path).slack == tuned.slack
    rest = q.where("query_id % 3 <> 0")             # not those it was tuned on
    hits, scored = C.search(tuned, rest, 10)
    kept = K.exact_knn(v, rest, 10).join(hits.select("query_id", "id"), ["query_id", "id"], "left_semi").count()
    read = scored.agg(F.sum("scored")).first()[0] / (80 * 1500)
    assert kept >= 0.9 * 800 and read < 0.4
    full = C.search(tuned, rest, 10, slack=1.0)[1].agg(F.sum("scored")).first()[0] / (80 * 1500)
    assert read < full


def test_append_and_compact(spark, tmp_path):
    x = data()
    v = table(spark, x)
    path = str(tmp_path / "a")
    C.build(v.where("id < 300"), path)
    for lo in range(300, 400, 25):
        index = C.append(v.where(f"id >= {lo} AND id < {lo + 25}"), path)
    q = v.where("id % 10 = 0").withColumnRenamed("id", "query_id")
    want = rows(K.exact_knn(v, q, 5))
    assert rows(C.search(index, q, 5)[0]) == want
    dense = C.compact(spark, path, str(tmp_path / "b"))
    assert rows(C.search(dense, q, 5)[0]) == want
    assert dense.cells.count() < index.cells.count()
    with pytest.raises(ValueError, match="holds an index"):
        C.compact(spark, path, str(tmp_path / "b"))


def test_vectors_are_made_once(spark, tmp_path):
    """An index is built from vectors that are written once, not made for every step."""
    made = spark.sparkContext.accumulator(0)

    def encode(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b
    v = table(spark, data())
    index = C.build(v.mapInArrow(encode, v.schema), str(tmp_path / "a"), cell_rows=5)
    assert made.value == 400 and index.cells.agg(F.sum("n")).first()[0] == 400
    made.value = 0
    asked = v.where("id < 60").withColumnRenamed("id", "query_id")
    hits, _ = C.search(index, asked.mapInArrow(encode, asked.schema), 7, slack=1.0, max_block_bytes=2000)
    assert hits.count() == 60 * 7 and made.value == 60


def test_cells_in_reach_are_compared_together(spark, tmp_path, monkeypatch):
    """With full angles cells that most queries reach share a product; hits are those of the
    exact search, and of a search cell by cell."""
    calls, add = [], V.add_scores
    monkeypatch.setattr(V, "add_scores", lambda best, js, q, q32, ids, d, *a: (calls.append(len(d)), add(best, js, q, q32, ids, d, *a))[1])
    x = np.random.default_rng(9).standard_normal((300, 24))
    found = []
    for joint in (1_024, 1):
        monkeypatch.setattr(C, "JOINT_ROWS", joint)
        cells, ids, vecs = np.arange(300).reshape(60, 5), [], []
        for c in cells:
            ids.append(c.tolist())
            vecs.append(x[c].ravel().tolist())
        unit = V.unit_rows(x)
        centers = V.unit_rows(np.array([unit[c].mean(axis=0) for c in cells]))
        radius = [float(np.arccos(np.clip(unit[c] @ m, -1, 1)).max()) for c, m in zip(cells, centers)]
        batch = pa.RecordBatch.from_arrays([pa.array([0] * 60, pa.int64()), pa.array(centers.tolist()), pa.array(radius),
                                            pa.array(ids), pa.array(vecs)], names=["cluster_id", "center", "radius", "ids", "vecs"])
        bc = type("B", (), {"value": (pa.array(range(40)), unit[:40], {0: np.arange(40)}, np.full(40, -np.inf))})
        calls.clear()
        out = [b for b in C._wave_kernel(bc, 4, 24, 1.0, False, True)([batch])]
        found.append((sorted((q, i, s) for b in out for q, i, s in zip(*(b.column(j).to_pylist() for j in range(3))) if i is not None),
                      len(calls)))
    score = np.round(unit[:40] @ unit.T, 6)
    want = sorted((q, i, score[q, i]) for q in range(40) for i in sorted(range(300), key=lambda i: (-score[q, i], i))[:4])
    for hits, _ in found:
        assert [h[:2] for h in hits] == [w[:2] for w in want] and np.allclose([h[2] for h in hits], [w[2] for w in want])
    assert found[0][1] * 4 < found[1][1]
