"""Nearest-neighbour search over a two-level cell index with a stop rule per query.

The index. Coarse clusters (cosine k-means on a bounded sample, every vector goes to
the nearest centre) are cut into cells of a few vectors each (k-means inside blocks
of at most ``BLOCK_ROWS`` vectors, so a hot cluster is many tasks). A row of the
``cells`` table is a cell: its centre, the covering angle of its members, the angle
that covers them from the coarse centre, their ids and their vectors. Cells are
partitioned by ``cluster_id``; ``centers`` holds the coarse centres.

The search. No member of a cell can score more than cos(angle(query, centre) -
covering angle). Each query first visits the coarse clusters nearest to it, cell by
cell (with full angles in runs of cells that most queries reach) from the best bound down, until the next bound is below its k-th score so
far; that score then rules out coarse clusters and cells of the second wave, for
which only the partitions that some query can still reach are read. With ``slack=1``
the result is exactly that of ``knn.exact_knn``. A smaller ``slack`` shrinks the
covering angles: ``tune`` finds the one that keeps a wanted share of the true hits
of sample queries. The work is reported: ``scored`` counts, for each query, the vectors
it was compared with.

Queries whose vectors fit ``max_block_bytes`` are broadcast; more are searched in
several passes, a block of queries each. Ties go to the smaller id. Zero vectors have
cells of their own and score 0. Null vectors are skipped; another width fails the job.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papyra.functions import vectors as V
from papyra.operators import knn as K
from papyra.session import delete_path, materialize, path_exists, shuffles_dropped, stage

BLOCK_ROWS = 4_096          # vectors that one task cuts into cells
CELL_CAP = 256              # members of one cell row
TRAIN_ROWS = 256            # sample rows for each coarse cluster
ROUNDS = 8
TRIALS = 5
JOINT_ROWS = 1_024          # vectors of cells that are compared together
TOLERANCE = 1e-6            # scores are rounded to six decimals


@dataclass(frozen=True)
class CellIndex:
    """``cells`` (cluster_id, cell, center, radius, reach, n, ids, vecs), ``centers``
    (cluster_id, vec) and the slack that ``search`` uses."""
    cells: DataFrame
    centers: DataFrame
    dim: int
    slack: float = 1.0


def rows_per_cell(n: int) -> int:
    """Small cells while the table is small, 32 vectors from 16 000 rows on."""
    return min(32, max(3, n // 500))


def coarse_count(n: int, cell_rows: int, dim: int) -> int:
    """About as many coarse clusters as each has cells, within the broadcast bound."""
    most = K.DEFAULT_MAX_CENTROID_BYTES // (8 * dim)
    return int(max(1, min(n, most, math.sqrt(n / cell_rows))))


def _angles(unit: np.ndarray, center: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(unit @ center, -1.0, 1.0))


def cut_cells(unit: np.ndarray, cell_rows: int, seed: int = 0) -> np.ndarray:
    """Cell number of each row: k-means on unit vectors; zero vectors get -1."""
    cell = np.full(len(unit), -1, np.int64)
    live = np.flatnonzero((unit != 0).any(axis=1))
    if not len(live):
        return cell
    x, rng = unit[live], np.random.default_rng(seed)
    n = max(1, len(x) // cell_rows)
    centers = x[np.sort(rng.choice(len(x), n, replace=False))]
    for _ in range(ROUNDS):
        near = (x @ centers.T).argmax(axis=1)
        order = np.argsort(near, kind="stable")
        used, first = np.unique(near[order], return_index=True)
        centers = V.unit_rows(np.add.reduceat(x[order], first, axis=0))
        near = np.searchsorted(used, near)
    cell[live] = near
    return cell


def _cell_rows(ids: pa.Array, vecs: np.ndarray, cluster: int, sub: int, coarse: np.ndarray, cell_rows: int, schema):
    """The cell rows of one block."""
    unit = V.unit_rows(vecs)
    cell = cut_cells(unit, cell_rows)
    order = np.argsort(cell, kind="stable")
    edges = np.flatnonzero(np.r_[True, np.diff(cell[order]) != 0])
    out: list[tuple] = []
    for lo, hi in zip(edges, np.r_[edges[1:], len(order)]):
        for at in range(lo, hi, CELL_CAP):
            rows = order[at:min(at + CELL_CAP, hi)]
            center = V.unit_rows(unit[rows].mean(axis=0, keepdims=True))[0]
            angles = _angles(unit[rows], center) if cell[order[lo]] >= 0 else np.zeros(1)
            out.append((cluster, sub * BLOCK_ROWS + len(out), center.tolist(), float(angles.max()),
                        float(_angles(unit[rows], coarse).max()), len(rows), ids.take(pa.array(rows)).to_pylist(),
                        vecs[rows].ravel().tolist()))
    return pa.table([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)


def train_centers(vectors: DataFrame, n: int, dim: int, cell_rows: int, seed: int = 42) -> DataFrame:
    """Coarse centres from a bounded sample: ``TRAIN_ROWS`` vectors a centre."""
    count = coarse_count(n, cell_rows, dim)
    share = min(1.0, count * TRAIN_ROWS / max(n, 1))
    sample = vectors if share == 1.0 else vectors.where(
        F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 30)) < int(share * (1 << 30)))
    some = vectors.where(F.exists(V.to_double("vec"), lambda x: x != 0)).limit(1).count()
    if count < 2 or not some:
        return vectors.sparkSession.createDataFrame([(0, [0.0] * dim)], "cluster_id long, vec array<double>")
    return K.kmeans_index(sample, count, seed=seed)[1]


def make_cells(vectors: DataFrame, centers: DataFrame, dim: int, cell_rows: int) -> DataFrame:
    """Cells of ``vectors`` (id, vec) around given centres."""
    id_type = vectors.schema["id"].dataType
    tbl = centers.select("cluster_id", K.fixed_width("vec", dim).alias("vec")).toArrow()
    numbers, mat = tbl.column("cluster_id").to_numpy().astype(np.int64), V.list_to_matrix(tbl.column("vec"), dim)
    bc = vectors.sparkSession.sparkContext.broadcast((numbers, V.unit_rows(mat)))

    def nearest(batches):
        known, c = bc.value
        for b in batches:
            near = known[(V.unit_rows(V.list_to_matrix(b.column(1), dim)) @ c.T).argmax(axis=1)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(near, pa.int64())], names=["id", "vec", "cluster_id"])
    rows = vectors.where(F.col("vec").isNotNull()).select("id", K.fixed_width("vec", dim).alias("vec"))
    assigned = materialize(rows.mapInArrow(nearest, f"id {id_type.simpleString()}, vec array<double>, cluster_id long"),
                           "assigned")
    sizes = assigned.groupBy("cluster_id").agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).alias("_blocks"))
    # one row a centre, and the centres fit the broadcast bound
    blocks = assigned.join(F.broadcast(sizes), "cluster_id").withColumn(
        "sub", F.pmod(F.xxhash64("id", "vec"), F.col("_blocks")).cast("long"))
    out = f"cluster_id long, cell long, center array<double>, radius double, reach double, n int, " \
          f"ids array<{id_type.simpleString()}>, vecs array<double>"
    arrow = pa.schema([("cluster_id", pa.int64()), ("cell", pa.int64()), ("center", pa.list_(pa.float64())),
                       ("radius", pa.float64()), ("reach", pa.float64()), ("n", pa.int32()),
                       ("ids", pa.list_(_arrow_type(id_type))), ("vecs", pa.list_(pa.float64()))])

    def cut(key, t):
        known, c = bc.value
        t = t.combine_chunks()
        ids = t.column("id").combine_chunks()
        ids = ids.cast(_arrow_type(id_type))
        order = np.argsort(V.tie_keys(ids), kind="stable")      # not the order of arrival
        cluster, sub = key[0].as_py(), key[1].as_py()
        vecs = V.list_to_matrix(t.column("vec"), dim)[order]
        return _cell_rows(ids.take(pa.array(order)), vecs, cluster, sub, c[int(np.flatnonzero(known == cluster)[0])],
                          cell_rows, arrow)
    return blocks.select("cluster_id", "sub", "id", "vec").groupBy("cluster_id", "sub").applyInArrow(cut, out)


def _arrow_type(t) -> pa.DataType:
    return {"long": pa.int64(), "integer": pa.int32(), "string": pa.string()}[t.typeName()]


def build(vectors: DataFrame, path: str, cell_rows: int | None = None, seed: int = 42) -> CellIndex:
    """Train, cut and store the index of ``vectors`` (id, vec) under ``path``."""
    # made once: they are read for their width and number, to train and to be cut
    rows, rows_path = stage(vectors.where(F.col("vec").isNotNull()).select("id", "vec"), "index-vectors")
    dim, n = K.vector_width(rows), rows.count()
    cell_rows = cell_rows or rows_per_cell(n)
    centers = train_centers(rows, n, dim, cell_rows, seed)
    centers.write.mode("overwrite").parquet(f"{path}/centers")
    spark = vectors.sparkSession
    centers = spark.read.parquet(f"{path}/centers")
    with shuffles_dropped(spark):
        make_cells(rows, centers, dim, cell_rows).write.mode("overwrite").partitionBy("cluster_id").parquet(f"{path}/cells")
    delete_path(spark, rows_path)
    spark.createDataFrame([(dim, cell_rows, 1.0)], "dim int, cell_rows int, slack double") \
        .write.mode("overwrite").parquet(f"{path}/settings")
    return load(spark, path)


def load(spark: SparkSession, path: str) -> CellIndex:
    s = spark.read.parquet(f"{path}/settings").first()
    cells = spark.read.parquet(f"{path}/cells").withColumn("cluster_id", F.col("cluster_id").cast("long"))
    return CellIndex(cells, spark.read.parquet(f"{path}/centers"), s["dim"], s["slack"])


def append(vectors: DataFrame, path: str) -> CellIndex:
    """New vectors become cells of their own beside the old ones."""
    spark = vectors.sparkSession
    s = spark.read.parquet(f"{path}/settings").first()
    make_cells(vectors.select("id", "vec"), spark.read.parquet(f"{path}/centers"), s["dim"], s["cell_rows"]) \
        .write.mode("append").partitionBy("cluster_id").parquet(f"{path}/cells")
    return load(spark, path)


def vectors_of(index: CellIndex) -> DataFrame:
    """(id, vec) of all members."""
    d = index.dim
    return index.cells.select("ids", "vecs").select(F.posexplode("ids").alias("_p", "id"), "vecs") \
        .select("id", F.slice("vecs", F.col("_p") * d + 1, F.lit(d)).alias("vec"))


def compact(spark: SparkSession, path: str, to: str) -> CellIndex:
    """The index cut anew around its centres and written to ``to``, without the
    fragments that many small ``append`` calls leave; keeps the slack."""
    old = load(spark, path)
    s = spark.read.parquet(f"{path}/settings")
    if path_exists(spark, f"{to}/cells"):
        raise ValueError(f"{to} holds an index")
    old.centers.write.parquet(f"{to}/centers")
    make_cells(vectors_of(old), old.centers, old.dim, s.first()["cell_rows"]) \
        .write.partitionBy("cluster_id").parquet(f"{to}/cells")
    s.write.parquet(f"{to}/settings")
    return load(spark, to)


# ---- search -------------------------------------------------------------------

def _joint(bound: np.ndarray, order: np.ndarray, best: V.RunningTopK, lens: np.ndarray):
    """Runs of cells in the given order, of about ``JOINT_ROWS`` members, or single cells
    where half of the (cell, query) pairs of a run or more are out of reach."""
    run = (np.cumsum(lens[order]) - 1) // JOINT_ROWS
    for cells in np.split(order, np.flatnonzero(np.diff(run)) + 1):
        reached = bound[cells] >= best.kth - TOLERANCE
        some = reached.any(axis=0)
        if len(cells) == 1 or 2 * np.count_nonzero(reached) > len(cells) * np.count_nonzero(some):
            yield cells
        else:
            yield from cells[:, None]


def _members(ids: pa.Array, vecs: pa.Array, cells: np.ndarray, dim: int) -> tuple[pa.Array, np.ndarray]:
    """Ids and unit vectors of the members of some cells."""
    if len(cells) == 1:
        ids, vecs = (a.slice(int(cells[0]), 1) for a in (ids, vecs))
    else:
        ids, vecs = (a.take(pa.array(cells)) for a in (ids, vecs))
    return ids.flatten(), V.unit_rows(vecs.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim))


def _wave_kernel(bc, k: int, dim: int, slack: float, exclude_self: bool, first: bool, step: int = 8_000_000):
    """Cells are visited from the best bound down; rows with an id are hits, rows
    without one say how many vectors a query was compared with."""
    def run(batches):
        qids, q, lists, floor = bc.value
        found = V.RunningTopK(len(qids), k, "id", floor)
        scored = np.zeros(len(qids), np.int64)
        q_codes = V.id_codes(qids, qids) if exclude_self else None
        everyone, low = np.arange(len(qids)), q.astype(np.float32)
        for b in batches:
            if not b.num_rows:
                continue
            cluster = b.column(b.schema.get_field_index("cluster_id")).to_numpy(zero_copy_only=False).astype(np.int64)
            centers = V.list_to_matrix(b.column(b.schema.get_field_index("center")), dim)
            radius = b.column(b.schema.get_field_index("radius")).to_numpy(zero_copy_only=False)
            ids, vecs = (b.column(b.schema.get_field_index(c)) for c in ("ids", "vecs"))
            lens = np.diff(ids.offsets.to_numpy())
            for c in np.unique(cluster):
                listed = lists.get(int(c), np.zeros(0, np.int64))
                js = listed if first else np.setdiff1d(everyone, listed, assume_unique=True)
                cells = np.flatnonzero(cluster == c)
                width = max(1, step // max(len(js), 1))
                mine, mine32 = (q, low) if len(js) == len(q) else (q[js], low[js])
                # hits of these queries, cut back as they come: the next bounds meet tight scores
                best = V.RunningTopK(len(js), k, "id", found.kth[js])
                best.limit = max(len(js) * k * 5 // 4, 4 * k)
                for lo in range(0, len(cells) if len(js) else 0, width):
                    part = cells[lo:lo + width]
                    angle = np.arccos(np.clip(centers[part] @ mine.T, -1.0, 1.0))
                    bound = np.cos(np.maximum(angle - slack * radius[part, None], 0.0))
                    order = np.argsort(-bound.max(axis=1), kind="stable")
                    for run_of in _joint(bound, order, best, lens[part]) if slack >= 1.0 else order[:, None]:
                        who = np.flatnonzero(bound[run_of].max(axis=0) >= best.kth - TOLERANCE)
                        if not len(who):
                            continue
                        members, x = _members(ids, vecs, part[run_of], dim)
                        scored[js[who]] += len(x)
                        every = len(who) == len(js)
                        V.add_scores(best, who, mine if every else mine[who], mine32 if every else mine32[who], members, x,
                                     q_codes[js] if exclude_self else None,
                                     V.id_codes(members, qids) if exclude_self else None)
                found.kth[js] = np.maximum(found.kth[js], best.kth)
                for cols, got, sc in best.parts:
                    found.add(js[cols], got, sc)
        for out in found.batches(qids):
            yield pa.RecordBatch.from_arrays([*out.columns, pa.nulls(out.num_rows, pa.int64())],
                                             names=["query_id", "id", "score", "scored"])
        some = np.flatnonzero(scored)
        if len(some):
            kind = ids.type.value_type
            yield pa.RecordBatch.from_arrays([qids.take(pa.array(some)), pa.nulls(len(some), kind),
                                              pa.nulls(len(some), pa.float64()), pa.array(scored[some])],
                                             names=["query_id", "id", "score", "scored"])
    return run


def _coarse(index: CellIndex) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Number, centre, covering angle and size of each coarse cluster that has members."""
    sizes = index.cells.groupBy("cluster_id").agg(F.max("reach").alias("reach"), F.sum("n").alias("n"))
    tbl = index.centers.join(sizes, "cluster_id").orderBy("cluster_id").select(
        "cluster_id", K.fixed_width("vec", index.dim).alias("vec"), "reach", "n").toArrow()
    return (tbl.column("cluster_id").to_numpy().astype(np.int64), V.unit_rows(V.list_to_matrix(tbl.column("vec"), index.dim)),
            tbl.column("reach").to_numpy(), tbl.column("n").to_numpy())


def _search_block(index: CellIndex, coarse, q: DataFrame, k: int, slack: float, exclude_self: bool):
    spark, (numbers, centers, reach, sizes) = q.sparkSession, coarse
    tbl = q.toArrow()
    qids, qmat = tbl.column("qid").combine_chunks(), V.unit_rows(V.list_to_matrix(tbl.column("qvec"), index.dim))
    schema = f"query_id {q.schema['qid'].dataType.simpleString()}, id {index.cells.schema['ids'].dataType.elementType.simpleString()}, " \
             "score double, scored long"
    # wave 1: the nearest clusters that together hold twice the wanted rows, of a tiny table fewer
    near = min(2 * k, max(k, int(sizes.sum()) // 4))
    lists: dict[int, list[int]] = {}
    step = max(1, K.SCORE_CELLS // len(numbers))
    for lo in range(0, len(qmat), step):
        order = np.argsort(-np.round(qmat[lo:lo + step] @ centers.T, V.SCORE_DECIMALS), axis=1, kind="stable")
        before = np.cumsum(sizes[order], axis=1) - sizes[order]
        for j, c in zip(*np.nonzero(before < near)):
            lists.setdefault(int(numbers[order[j, c]]), []).append(lo + int(j))
    probe = {c: np.sort(np.array(js, np.int64)) for c, js in lists.items()}
    floor = np.full(len(qmat), -np.inf)

    def wave(clusters, first):
        bc = spark.sparkContext.broadcast((qids, qmat, probe, floor))
        cells = index.cells.where(F.col("cluster_id").isin([int(c) for c in clusters])) \
            .select("cluster_id", "center", "radius", "ids", "vecs")
        return materialize(cells.mapInArrow(_wave_kernel(bc, k, index.dim, slack, exclude_self, first), schema), "cells-wave")
    one = wave(probe, True)
    kth = K.top_k(one.where("id IS NOT NULL"), k).where(F.col("rank") == k).select("query_id", "score").toArrow()
    at = pc.index_in(kth.column("query_id"), value_set=qids).to_numpy(zero_copy_only=False).astype(np.int64)
    floor[at] = kth.column("score").to_numpy()
    reachable = np.zeros(len(numbers), bool)
    for lo in range(0, len(qmat), step):
        angle = np.arccos(np.clip(qmat[lo:lo + step] @ centers.T, -1.0, 1.0))
        bound = np.cos(np.maximum(angle - slack * reach, 0.0))
        reachable |= (bound >= floor[lo:lo + step, None] - TOLERANCE).any(axis=0)
    return one.unionByName(wave(numbers[reachable], False)) if reachable.any() else one


def search(index: CellIndex, queries: DataFrame, k: int, *, slack: float | None = None, query_id_col: str = "query_id",
           query_vec_col: str = "vec", exclude_self: bool = False,
           max_block_bytes: int = K.DEFAULT_MAX_BLOCK_BYTES) -> tuple[DataFrame, DataFrame]:
    """``(query_id, id, score, rank)`` and ``(query_id, scored)``. Query ids are distinct."""
    spark = queries.sparkSession
    slack = index.slack if slack is None else slack
    given = queries.where(F.col(query_vec_col).isNotNull()).select(
        F.col(query_id_col).alias("qid"), K.fixed_width(query_vec_col, index.dim).alias("qvec"))
    given, given_path = stage(given, "query-vectors")       # made once, read for their number and by the blocks
    coarse, n = _coarse(index), given.count()
    parts = []
    blocks = max(1, math.ceil(n * 8 * (index.dim + k) / max_block_bytes))
    if n and len(coarse[0]):
        dealt, dealt_path = (given, None) if blocks == 1 else K.query_blocks(given, blocks)
        for i in range(blocks):
            mine = dealt if blocks == 1 else dealt.where(F.col("_block") == i).select("qid", "qvec")
            if blocks == 1 or mine.limit(1).count():
                parts.append(_search_block(index, coarse, mine, k, slack, exclude_self))
        if dealt_path:
            delete_path(spark, dealt_path)
    delete_path(spark, given_path)
    if not parts:
        kinds = f"query_id {given.schema['qid'].dataType.simpleString()}"
        empty = spark.createDataFrame([], f"{kinds}, id {index.cells.schema['ids'].dataType.elementType.simpleString()}, "
                                          "score double, rank int")
        return empty, spark.createDataFrame([], f"{kinds}, scored long")
    out = reduce(DataFrame.unionByName, parts)
    hits = K.top_k(out.where("id IS NOT NULL").drop("scored"), k, levels=2 if n <= K.FEW_QUERIES else 1)
    return hits, out.where("id IS NULL").groupBy("query_id").agg(F.sum("scored").alias("scored"))


def tune(index: CellIndex, path: str, sample: DataFrame, k: int, recall: float = 0.95, *, query_id_col: str = "query_id",
         query_vec_col: str = "vec", exclude_self: bool = False) -> CellIndex:
    """The slack that keeps a share ``recall`` of the sample queries' true hits, stored
    with the index. At the starting value that share of them lies in cells (and
    clusters) whose bound reaches the true k-th score: they cannot be missed, as no
    running k-th score is above the true one. As it is below for most of the search, less
    is enough: ``TRIALS`` searches of the sample halve the range. ``sample`` should
    hold some hundred queries at most."""
    spark, d = sample.sparkSession, index.dim
    q = sample.where(F.col(query_vec_col).isNotNull()).select(
        F.col(query_id_col).alias("query_id"), V.normalize(K.fixed_width(query_vec_col, d)).alias("_q"))
    members = vectors_of(index)
    truth = materialize(K.exact_knn(members, q, k, query_vec_col="_q", exclude_self=exclude_self, dim=d), "tune")
    last = truth.groupBy("query_id").agg(F.min("score").alias("_kth"))
    cells = index.cells.select("cluster_id", "center", "radius", "reach", F.explode("ids").alias("id"))
    centers = index.centers.select("cluster_id", F.col("vec").alias("_coarse"))
    hits = truth.join(cells, "id").join(centers, "cluster_id").join(last, "query_id").join(q, "query_id")

    def angle(c):
        return F.acos(F.greatest(F.least(V.dot("_q", c), F.lit(1.0)), F.lit(-1.0)))
    target = F.acos(F.greatest(F.least(F.col("_kth"), F.lit(1.0)), F.lit(-1.0)))

    def needed(c, cover):
        gap = angle(c) - target
        return F.when(gap <= 0, F.lit(0.0)).when(F.col(cover) <= 0, F.lit(1.0)).otherwise(F.least(gap / F.col(cover), F.lit(1.0)))
    # the reach is of the whole cluster, not of the hit's cell
    wide = index.cells.groupBy("cluster_id").agg(F.max("reach").alias("_wide"))
    need = hits.join(wide, "cluster_id").select(F.greatest(needed("center", "radius"), needed("_coarse", "_wide")).alias("x"))
    slack = need.agg(F.percentile("x", F.lit(recall))).first()[0]
    old = spark.read.parquet(f"{path}/settings").first()
    slack = 1.0 if slack is None else min(1.0, float(slack) + 1e-6)
    wanted, low = truth.select("query_id", "id"), 0.0
    n = wanted.count()
    for _ in range(TRIALS if n else 0):
        trial = (low + slack) / 2
        hits, _ = search(index, q, k, slack=trial, query_vec_col="_q", exclude_self=exclude_self)
        if wanted.join(hits.select("query_id", "id"), ["query_id", "id"], "left_semi").count() >= recall * n:
            slack = trial
        else:
            low = trial
    spark.createDataFrame([(old["dim"], old["cell_rows"], slack)], "dim int, cell_rows int, slack double") \
        .write.mode("overwrite").parquet(f"{path}/settings")
    return load(spark, path)
