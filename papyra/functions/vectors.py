"""Vector expressions and the Arrow-batched kernels.

Small per-row vector arithmetic (norms, blends) is written with built-in
higher-order functions, so it runs in the JVM. Scoring many queries against
many vectors is a dense matrix product: it runs in ``mapInArrow`` tasks with
one BLAS call per Arrow batch, against a query block whose size is checked
before it is broadcast. Hashed text encoding counts buckets with
``numpy.bincount`` over the whole batch. Everything else (partitioning,
top-k merge, joins) stays with Spark.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-8
SCORE_DECIMALS = 6


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def to_double(v) -> Column:
    return _c(v).cast("array<double>")


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x * y), F.lit(0.0),
                       lambda acc, x: acc + x)


def norm(a) -> Column:
    return F.sqrt(F.aggregate(_c(a), F.lit(0.0), lambda acc, x: acc + x * x))


def normalize(a) -> Column:
    """Unit length; a zero vector stays zero. The squared norm is folded once
    and handed to the finishing lambda (a lambda that referenced ``norm(a)``
    directly would recompute it for every component)."""
    v = _c(a)
    return F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x * x,
                       lambda ss: F.transform(v, lambda x: F.when(ss > 0, x / F.sqrt(ss)).otherwise(x * 0.0)))


def blend(a, b, wa: float, wb: float) -> Column:
    """``wa*a + wb*b`` re-normalised."""
    return normalize(F.zip_with(_c(a), _c(b), lambda x, y: x * wa + y * wb))


def round_score(c) -> Column:
    return F.round(_c(c), SCORE_DECIMALS)


# ---------------------------------------------------------------------------
# numpy helpers used inside tasks
# ---------------------------------------------------------------------------

def list_to_matrix(arr: pa.Array, dim: int) -> np.ndarray:
    """Arrow list<double> column (no nulls, fixed width) -> (n, dim) float64."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    flat = arr.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    if len(arr) and flat.size != len(arr) * dim:
        raise ValueError("vectors must all have the same width")
    return flat.reshape(len(arr), dim)


def unit_rows(m: np.ndarray, eps: float = EPS) -> np.ndarray:
    return m / (np.linalg.norm(m, axis=1, keepdims=True) + eps)


def tie_keys(ids) -> np.ndarray:
    """Integer keys that order like the ids (ascending): the ids themselves
    when integral, else their rank in binary (UTF-8) order, which is Spark's
    string order."""
    if isinstance(ids, (pa.Array, pa.ChunkedArray)):
        if pa.types.is_integer(ids.type):
            return ids.to_numpy(zero_copy_only=False).astype(np.int64)
        order = pc.sort_indices(ids).to_numpy()
    else:
        ids = np.asarray(ids)
        if ids.dtype.kind in "iu":
            return ids.astype(np.int64)
        order = np.argsort(ids, kind="stable")
    rank = np.empty(len(order), dtype=np.int64)
    rank[order] = np.arange(len(order))
    return rank


def top_k_per_column(scores: np.ndarray, ties: np.ndarray, k: int):
    """For each column of ``scores`` the best ``k`` rows by (score desc, tie
    key asc). Returns (row_index, column_index, score) arrays; -inf scores
    are never returned. Breaking ties by id makes the union of per-batch
    results merge into the exact global top-k."""
    n, m = scores.shape
    if n == 0 or m == 0:
        e = np.empty(0, dtype=np.int64)
        return e, e, np.empty(0)
    if n > k:
        kth = np.partition(scores, n - k, axis=0)[n - k]      # k-th largest per column
        rows, cols = np.nonzero(scores >= kth[None, :])
    else:
        rows, cols = np.nonzero(np.ones_like(scores, dtype=bool))
    s = scores[rows, cols]
    ok = np.isfinite(s)
    rows, cols, s = rows[ok], cols[ok], s[ok]
    order = np.lexsort((ties[rows], -s, cols))
    rows, cols, s = rows[order], cols[order], s[order]
    start = np.r_[0, np.flatnonzero(cols[1:] != cols[:-1]) + 1]
    counts = np.diff(np.r_[start, cols.size])
    rank = np.arange(cols.size) - np.repeat(start, counts)
    keep = rank < k
    return rows[keep], cols[keep], s[keep]


class RunningTopK:
    """The best ``k`` rows per query over all batches of a task. Rows below a
    query's k-th score so far are dropped on arrival, with integer ids also its ties
    of a larger id; the buffer is cut back when it holds twice what can survive, first
    by the bounds known by then and only if that is not enough by sorting.
    ``kth`` may start from known lower bounds and be raised to others."""

    def __init__(self, n_queries: int, k: int, id_col: str, kth: np.ndarray | None = None):
        self.k, self.id_col = k, id_col
        self.kth = np.full(n_queries, -np.inf) if kth is None else kth.copy()
        self.tops = np.full((k, n_queries), -np.inf, np.float32)    # of distinct rows, see ``raise_bounds``
        self.last_score, self.last_id = np.full(n_queries, np.inf), np.zeros(n_queries, np.int64)
        self.limit = max(2 * n_queries * k, 50_000)
        self.parts: list[tuple[np.ndarray, pa.Array, np.ndarray]] = []
        self.size = 0

    @property
    def groups(self) -> int:
        """Groups of rows whose best scores raise the bounds."""
        return max(64, 2 * self.k)

    def raise_bounds(self, who: np.ndarray, best: np.ndarray, off: float) -> None:
        """``best``: for the queries ``who`` the best float32 scores of groups of rows not seen
        before. The best rows of k groups of rows are k rows, so the k-th score is at least the
        least of them, less the error ``off``."""
        up = np.flatnonzero(best.max(axis=0) > self.tops[0, who])       # the first of ``tops`` is the least
        at = who[up]
        both = np.concatenate([self.tops[:, at], best[:, up]])
        both.partition(len(best), axis=0)
        self.tops[:, at] = both[len(best):]
        self.kth[at] = np.maximum(self.kth[at], both[len(best)].astype(np.float64) - off)

    def add(self, cols: np.ndarray, ids: pa.Array, scores: np.ndarray) -> None:
        keep = scores >= self.kth[cols]
        if pa.types.is_integer(ids.type):
            keep &= (scores != self.last_score[cols]) | (ids.to_numpy(zero_copy_only=False) <= self.last_id[cols])
        if not keep.all():
            cols, ids, scores = cols[keep], ids.filter(pa.array(keep)), scores[keep]
        if len(cols):
            self.parts.append((cols.astype(np.int32), ids, scores))
            self.size += len(cols)
            if self.size > self.limit:
                self.thin()
                if self.size > self.limit * 3 // 4:
                    self.cut()

    def thin(self) -> None:
        """Drop what the bounds known by now exclude."""
        left = []
        while self.parts:
            cols, ids, scores = self.parts.pop()
            keep = scores >= self.kth[cols]
            if keep.any():
                left.append((cols[keep], ids.filter(pa.array(keep)), scores[keep]))
        self.parts, self.size = left, sum(len(c) for c, _, _ in left)

    def cut(self) -> None:
        cols = np.concatenate([c for c, _, _ in self.parts])
        ids = pa.concat_arrays([i for _, i, _ in self.parts])
        scores = np.concatenate([x for _, _, x in self.parts])
        self.parts = []
        ties = tie_keys(ids)
        order = np.lexsort((ties, -scores, cols))
        cols, scores = cols[order], scores[order]
        start = np.flatnonzero(np.r_[True, cols[1:] != cols[:-1]])
        rank = np.arange(len(cols)) - np.repeat(start, np.diff(np.r_[start, len(cols)]))
        keep = rank < self.k
        last = rank == self.k - 1
        self.kth[cols[last]] = np.maximum(self.kth[cols[last]], scores[last])
        if pa.types.is_integer(ids.type):
            self.last_score[cols[last]], self.last_id[cols[last]] = scores[last], ties[order[last]]
        self.parts = [(cols[keep], ids.take(pa.array(order[keep])), scores[keep])]
        self.size = int(keep.sum())

    def batches(self, query_ids: pa.Array, rows: int = 100_000):
        if self.parts:
            self.thin()
        if self.parts:
            self.cut()
            cols, ids, scores = self.parts[0]
            for i in range(0, len(cols), rows):
                yield pa.RecordBatch.from_arrays(
                    [query_ids.take(pa.array(cols[i:i + rows], pa.int64())), ids.slice(i, rows),
                     pa.array(scores[i:i + rows], pa.float64())], names=["query_id", self.id_col, "score"])


TILE_ROWS, TILE_CELLS, RESCORED, HITS_QUERIES = 4_096, 4_000_000, 1_024, 3_904
ENCODED_ROWS = 1_024


def float32_error(dim: int) -> float:
    """More than a float32 product of two vectors of length one at most can be off, and
    the half unit of the last rounded decimal."""
    return (dim + 8) * 2.0 ** -22 + 10.0 ** -SCORE_DECIMALS


def group_best(s: np.ndarray, groups: int) -> np.ndarray:
    """The best scores of ``groups`` groups of rows: row i is in group i mod ``groups``."""
    best = s[:groups].copy()
    for lo in range(groups, len(s), groups):
        part = s[lo:lo + groups]
        np.maximum(best[:len(part)], part, out=best[:len(part)])
    return best


def reaching(best: RunningTopK, who: np.ndarray, d: np.ndarray, d32: np.ndarray, q: np.ndarray, q32: np.ndarray,
             same=None):
    """(row, column, score) of all pairs of ``d`` and the queries ``who`` of ``best`` whose
    score is at least the query's k-th so far, which these rows raise first (a few rows
    only where it is not known). float32
    products leave out what lies below by more than their error, whole groups of rows by
    their best one; the others are worked out in doubles, a cache's worth of rows at a
    time. The pairs ``same``, (rows, columns), are left out."""
    s, off = d32 @ q32.T, float32_error(d.shape[1])
    if same is not None:
        s[same] = -np.inf
    groups = min(len(s), best.groups)
    top = group_best(s, groups)
    if np.isnan(top).any():
        s[np.isnan(s)] = -np.inf
        top = group_best(s, groups)
    if len(s) >= 8 * best.k or (best.kth[who] == -np.inf).any():
        best.raise_bounds(who, top, off)
    kth = best.kth[who]
    low = np.maximum((kth - off).astype(np.float32), np.finfo(np.float32).min)
    near = top >= low
    if np.count_nonzero(near) > near.size // 8:
        rows, cols = np.divmod(np.flatnonzero(s >= low), s.shape[1])
    else:
        first, at = np.nonzero(near)
        rows = (first[:, None] + np.arange(0, len(s), groups)).ravel()
        cols = np.repeat(at, len(rows) // max(len(at), 1))
        inside = rows < len(s)
        rows, cols = rows[inside], cols[inside]
        met = s[rows, cols] >= low[cols]
        rows, cols = rows[met], cols[met]
    if len(rows) > s.size // 8:
        score = np.round(d @ q.T, SCORE_DECIMALS)[rows, cols]
    else:
        score = np.empty(len(rows))
        for lo in range(0, len(rows), RESCORED):
            at = slice(lo, lo + RESCORED)
            score[at] = np.einsum("ij,ij->i", d[rows[at]], q[cols[at]])
        score = np.round(score, SCORE_DECIMALS)
    keep = (score >= kth[cols]) & np.isfinite(score)
    return rows[keep], cols[keep], score[keep]


def equal_pairs(codes: np.ndarray, q_codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of all pairs of equal codes; a negative code equals none."""
    order = np.argsort(q_codes, kind="stable")
    first, end = (np.searchsorted(q_codes[order], codes, side) for side in ("left", "right"))
    n = np.where(codes < 0, 0, end - first)
    rows = np.repeat(np.arange(len(codes)), n)
    return rows, order[np.repeat(first - np.cumsum(n) + n, n) + np.arange(len(rows))]


def add_scores(best: RunningTopK, js: np.ndarray, q: np.ndarray, q32: np.ndarray, ids: pa.Array, d: np.ndarray,
               q_codes=None, codes=None) -> None:
    """Rows ``d`` against the queries ``js`` of ``best``, whose vectors are ``q``, a bounded
    number of scores at a time. Rows and queries of equal codes do not meet."""
    for at in range(0, len(d), TILE_ROWS):
        mine = slice(at, at + TILE_ROWS)
        dd = d[mine]
        d32, width = dd.astype(np.float32), max(1, TILE_CELLS // len(dd))
        for lo in range(0, len(js), width):
            who = js[lo:lo + width]
            same = None if codes is None else equal_pairs(codes[mine], q_codes[who])
            rows, cols, sc = reaching(best, who, dd, d32, q[lo:lo + width], q32[lo:lo + width], same)
            best.add(who[cols], ids.take(pa.array(at + rows, pa.int64())), sc)


def id_codes(ids, known: pa.Array) -> np.ndarray:
    """Position in ``known`` of each id, -1 if it is not there."""
    return pc.fill_null(pc.index_in(ids, value_set=known), -1).to_numpy(zero_copy_only=False).astype(np.int64)


def score_kernel(query_ids: pa.Array, query_mat: np.ndarray, k: int, id_col: str,
                 vec_col: str, dim: int, exclude_self: bool):
    """Build the ``mapInArrow`` function: each batch of corpus vectors is scored
    against the query block and only each query's top-k of the whole task
    leaves it. Ids may be integers or strings."""
    def run(batches):
        qn = unit_rows(query_mat)
        q32 = qn.astype(np.float32)
        q_codes = id_codes(query_ids, query_ids) if exclude_self else None
        # hits are sorted for so many queries at a time
        parts = [slice(lo, lo + HITS_QUERIES) for lo in range(0, len(query_ids), HITS_QUERIES)]
        best = [RunningTopK(len(query_ids[mine]), k, id_col) for mine in parts]
        for batch in batches:
            for lo in range(0, batch.num_rows, TILE_ROWS):
                tile = batch.slice(lo, TILE_ROWS)
                ids, d = tile.column(id_col), unit_rows(list_to_matrix(tile.column(vec_col), dim))
                codes = id_codes(ids, query_ids) if exclude_self else None
                for mine, top in zip(parts, best):
                    add_scores(top, np.arange(len(top.kth)), qn[mine], q32[mine], ids, d,
                               q_codes[mine] if exclude_self else None, codes)
        for mine, top in zip(parts, best):
            yield from top.batches(query_ids[mine])
    return run


def nearest_rows_kernel(ref_ids: np.ndarray, ref_mat: np.ndarray, k: int, id_col: str,
                        vec_col: str, dim: int, out_col: str, chunk_cells: int = 8_000_000):
    """Per scanned row, the ``k`` nearest rows of a small broadcast matrix
    (e.g. cluster centroids): output ``(id, out_col, probe_rank, score)``."""
    rn = unit_rows(ref_mat)
    order_ids = np.asarray(ref_ids, dtype=np.int64)

    def run(batches):
        for batch in batches:
            n = batch.num_rows
            if n == 0:
                continue
            ids = batch.column(id_col)
            d = unit_rows(list_to_matrix(batch.column(vec_col), dim))
            step = max(1, chunk_cells // len(rn))
            for lo in range(0, n, step):
                s = np.round(d[lo:lo + step] @ rn.T, SCORE_DECIMALS)
                # per scanned row: (score desc, ref id asc)
                refs, row, sc = top_k_per_column(s.T, order_ids, k)
                first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
                rank = np.arange(len(row)) - np.repeat(first, np.diff(np.r_[first, len(row)]))
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(lo + row, pa.int64())), pa.array(order_ids[refs], pa.int64()),
                     pa.array(rank + 1, pa.int32()), pa.array(sc, pa.float64())],
                    names=[id_col, out_col, "probe_rank", "score"])
    return run


def bucket_count_kernel(bucket_col: str, dim: int, out_col: str):
    """Dense L2-normalised bag-of-buckets vectors from per-row bucket lists, a bounded
    number of rows at a time. All other columns pass through unchanged; ``bucket_col`` is
    replaced by ``out_col``."""
    def run(batches):
        for batch in (b.slice(lo, ENCODED_ROWS) for b in batches for lo in range(0, b.num_rows, ENCODED_ROWS)):
            n = batch.num_rows
            lists = batch.column(bucket_col)
            lens = np.diff(lists.offsets.to_numpy())
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            row = np.repeat(np.arange(n), lens)
            counts = np.bincount(row * dim + flat, minlength=n * dim).reshape(n, dim).astype(np.float64)
            nrm = np.linalg.norm(counts, axis=1, keepdims=True)
            vec = np.divide(counts, nrm, out=np.zeros_like(counts), where=nrm > 0)
            offsets = pa.array(np.arange(0, (n + 1) * dim, dim, dtype=np.int32))
            keep = [i for i, name in enumerate(batch.schema.names) if name != bucket_col]
            arrays = [batch.column(i) for i in keep]
            names = [batch.schema.names[i] for i in keep]
            arrays.append(pa.ListArray.from_arrays(offsets, pa.array(vec.ravel(), pa.float64())))
            names.append(out_col)
            yield pa.RecordBatch.from_arrays(arrays, names=names)
    return run


def ivf_kernel(query_ids: pa.Array, query_mat: np.ndarray, probes: dict, k: int, id_col: str,
               cluster_col: str, vec_col: str, dim: int, exclude_self: bool):
    """Clustered scoring against a query block: within a batch, the
    rows of each cluster are scored only against the queries that probe that
    cluster (``probes``: cluster id -> query column indices), a bounded number
    of cells at a time; each query's top-k of the whole task leaves it."""
    def run(batches):
        qn, everyone = unit_rows(query_mat), np.arange(len(query_ids))
        q32 = qn.astype(np.float32)
        q_codes = id_codes(query_ids, query_ids) if exclude_self else None
        best = RunningTopK(len(query_ids), k, id_col)
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column(id_col)
            clusters = batch.column(cluster_col).to_numpy(zero_copy_only=False).astype(np.int64)
            d = unit_rows(list_to_matrix(batch.column(vec_col), dim))
            codes = id_codes(ids, query_ids) if exclude_self else None
            listed = {int(c): probes.get(int(c)) for c in np.unique(clusters)}
            # clusters that every query probes are scored together
            full = [c for c, js in listed.items() if js is not None and len(js) == len(everyone)]
            groups = [(everyone, np.isin(clusters, full))] if full else []
            groups += [(js, clusters == c) for c, js in listed.items() if js is not None and len(js) < len(everyone)]
            for js, mine in groups:
                r = np.flatnonzero(mine)
                q, low = (qn, q32) if js is everyone else (qn[js], q32[js])
                add_scores(best, js, q, low, ids.take(pa.array(r)), d[r],
                           None if q_codes is None else q_codes, None if codes is None else codes[r])
        yield from best.batches(query_ids)
    return run
