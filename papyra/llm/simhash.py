"""SimHash near-duplicates, linked exactly through vantage-point shards.

Fingerprint: A-Z lower-cased, words ``[^\\x20\\x09-\\x0D]+``, shingles of
``shingle`` words joined by a space (fewer words: the whole sequence; none:
fingerprint zero), XXH64 with seed 42 of each; a bit is set if it is set in
more than half of the hashes. Fingerprints link at ``max_bits`` or fewer
differing bits; components are taken over all links.

Links are found between distinct fingerprints only. A vantage-point tree over
a bounded sample fixes the shards: each inner node has a vantage point and a
radius; a fingerprint within the radius goes left, the others go right, and
those within ``max_bits`` of the boundary go both ways (triangle inequality),
so every linked pair meets in some shard. Each shard compares its members
and returns a spanning forest of their links, never all pairs; a shard
that outgrows ``shard_rows`` (dense regions cannot be split by distance) is cut
into blocks, and each pair of blocks is a task of its own. Components come from
alternating large-star and small-star steps on written tables.

Cases: null and empty texts have fingerprint zero and link like any other;
``component_id`` is the smallest non-null id reachable; repeated rows give
repeated results; an empty table an empty result; other columns do not matter.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyra.llm.common import Staged, row_key

SAMPLE = 16_384         # fingerprints that shape the tree
SHARD_ROWS = 4_000      # fingerprints a shard should have
BLOCK_ROWS = 16_384     # larger shards are cut into blocks of this size


def fingerprint(text: bytes | None, shingle: int = 3) -> int:
    """Unsigned 64-bit SimHash of a UTF-8 text."""
    import xxhash

    words = text.lower().split() if text else []
    if not words:
        return 0
    flat = b" ".join(words)
    gap = np.flatnonzero(np.frombuffer(flat, np.uint8) == 32)
    starts, ends = [0, *(gap + 1).tolist()], [*gap.tolist(), len(flat)]
    h = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        hashes = [h(flat, 42)]
    else:
        hashes = [h(flat[a:b], 42) for a, b in zip(starts, ends[shingle - 1:])]
    count = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 4096):
        part = np.array(hashes[i:i + 4096], dtype="<u8").view(np.uint8).reshape(-1, 8)
        count += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * count > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, d, k, fp) per row; a map over the scan."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *row_key(), F.col("text").cast("binary").alias("t"))

    def run(batches):
        import pyarrow as pa

        for b in batches:
            fps = np.array([fingerprint(t.as_py(), shingle) for t in b.column(3)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(fps, pa.int64())],
                                             names=["doc_id", "d", "k", "fp"])
    return rows.mapInArrow(run, "doc_id long, d long, k long, fp long")


def distances(fps: np.ndarray, one) -> np.ndarray:
    return np.bitwise_count(fps ^ np.uint64(one)).astype(np.int16)


def build_tree(sample: np.ndarray, scale: float, max_bits: int, shard_rows: int = SHARD_ROWS):
    """Nested (vantage point, radius, inside, outside); a leaf is its number."""
    rng = np.random.default_rng(7)
    leaves = [0]

    def leaf():
        leaves[0] += 1
        return leaves[0] - 1

    def grow(part: np.ndarray):
        if len(part) * scale <= shard_rows or len(part) < 48:
            return leaf()
        probe = part[rng.integers(len(part), size=min(1024, len(part)))]
        points = part[rng.integers(len(part), size=12)]
        point = max(points, key=lambda p: distances(probe, p).std())
        dist = distances(part, point)
        best = min(range(65), key=lambda r: max((dist <= r).sum(), (dist > r - max_bits).sum()))
        inside, outside = part[dist <= best], part[dist > best - max_bits]
        if max(len(inside), len(outside)) > 0.9 * len(part):
            return leaf()
        return int(point), best, grow(inside), grow(outside)
    return grow(sample), leaves[0]


def route(tree, fps: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(row numbers, shards): every shard each fingerprint belongs to."""
    rows, shards, todo = [], [], [(tree, np.arange(len(fps)))]
    while todo:
        node, at = todo.pop()
        if not len(at):
            continue
        if isinstance(node, int):
            rows.append(at)
            shards.append(np.full(len(at), node))
            continue
        point, radius, inside, outside = node
        dist = distances(fps[at], point)
        todo += [(inside, at[dist <= radius]), (outside, at[dist > radius - max_bits])]
    none = np.zeros(0, np.int64)
    return np.concatenate(rows or [none]), np.concatenate(shards or [none])


def forest(fps: np.ndarray, max_bits: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among distinct fingerprints."""
    label, edges = np.arange(len(fps)), []
    for i in range(1, len(fps)):
        near = np.flatnonzero(np.bitwise_count(fps[:i] ^ fps[i]) <= max_bits)
        if len(near):
            roots, first = np.unique(label[near], return_index=True)
            edges += [(i, int(near[j])) for j in first]
            label[i] = roots[0]
            if len(roots) > 1:
                label[:i][np.isin(label[:i], roots[1:])] = roots[0]
    return edges


def links(distinct: DataFrame, max_bits: int = 2) -> DataFrame:
    """Edges (a, b) between distinct fingerprints ``fp`` that join the same
    fingerprints as all links do."""
    n = distinct.count()
    share = min(1.0, SAMPLE / max(n, 1))
    sample = distinct.where(F.pmod(F.xxhash64("fp"), F.lit(1 << 30)) < F.lit(int(share * (1 << 30)))).select("fp")
    picked = np.sort(np.array([r.fp for r in sample.collect()], np.int64)).view(np.uint64)
    tree, shards = build_tree(picked, n / max(len(picked), 1), max_bits)

    def send(batches):
        import pyarrow as pa

        for b in batches:
            fps = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            rows, shard = route(tree, fps.view(np.uint64), max_bits)
            for i in range(0, len(rows), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(shard[i:i + 100_000], pa.int64()),
                                                  pa.array(fps[rows[i:i + 100_000]], pa.int64())], names=["shard", "fp"])
    routed = Staged(distinct.select("fp").mapInArrow(send, "shard long, fp long"), "simhash-shards")
    sizes = routed.df.groupBy("shard").agg(F.ceil(F.count("*") / BLOCK_ROWS).alias("nb"), F.count("*").alias("m"))
    # one row a shard: bounded by the sample that shapes the tree
    blocks = routed.df.join(F.broadcast(sizes.select("shard", "nb")), "shard").withColumn(
        "own", F.pmod(F.xxhash64("fp"), F.col("nb")))
    tasks = blocks.select("fp", F.explode(F.transform(
        F.sequence(F.lit(0), F.col("nb") - 1),
        lambda j: F.concat_ws(".", "shard", F.least("own", j), F.greatest("own", j)))).alias("task"))
    rows = sizes.agg(F.sum(F.col("m") * F.col("nb")).alias("rows")).first()["rows"] or 0
    parts = max(shards, int(rows // SHARD_ROWS) + 1)

    def compare(table):
        import pyarrow as pa

        fps = np.unique(table.column("fp").to_numpy().astype(np.int64).view(np.uint64))
        found = np.array(forest(fps, max_bits), np.int64).reshape(-1, 2)
        return pa.table({"a": pa.array(fps[found[:, 0]].view(np.int64), pa.int64()),
                         "b": pa.array(fps[found[:, 1]].view(np.int64), pa.int64())})
    edges = Staged(tasks.repartition(parts, "task").groupBy("task").applyInArrow(compare, "a long, b long"),
                   "simhash-edges")
    routed.drop()
    return edges.df


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of ``edges`` (a, b): large-star and small-star
    steps until nothing changes. Each round is written to the shared folder."""
    def mark(df):
        return df.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()

    def lowest(df, value):
        # written, so that the join below has plain tables on both sides and a
        # hub with very many edges can be split
        return Staged(df.groupBy("a").agg(value.alias("m")), "simhash-low")

    def ordered(df):
        return df.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = Staged(ordered(edges), "simhash-star")
    seen = mark(now.df)
    while True:
        both = now.df.union(now.df.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = lowest(both, F.least(F.col("a"), F.min("b")))
        large = Staged(ordered(both.join(low.df, "a").where(F.col("b") > F.col("a"))
                               .select(F.col("b").alias("a"), F.col("m").alias("b"))), "simhash-large")
        low2 = lowest(large.df, F.min("b"))
        small = large.df.join(low2.df, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(
            low2.df.select("a", F.col("m").alias("b")))
        new = Staged(ordered(small), "simhash-star")
        for t in (now, low, large, low2):
            t.drop()
        now, last, seen = new, seen, mark(new.df)
        if seen == last:
            break
    return now.df.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.col("b").alias("root")) \
        .union(now.df.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def near_duplicates(docs: DataFrame, shingle: int = 3, max_bits: int = 2) -> DataFrame:
    """(doc_id, d, k, fp, component_id) per row."""
    fps = Staged(fingerprints(docs, shingle), "simhash-fp").df
    distinct = Staged(fps.groupBy("fp").agg(F.min("doc_id").alias("m")), "simhash-distinct").df
    nodes = components(links(distinct, max_bits))
    linked = Staged(nodes.join(distinct, nodes.node == distinct.fp).select("fp", "root", "m"), "simhash-linked").df
    smallest = Staged(linked.groupBy("root").agg(F.min("m").alias("component_id")), "simhash-smallest").df
    grouped = Staged(distinct.join(linked.join(smallest, "root").select("fp", "component_id"), "fp", "left")
                     .select("fp", F.coalesce("component_id", "m").alias("component_id")), "simhash-groups").df
    return fps.join(grouped, "fp").select("doc_id", "d", "k", "fp", "component_id")


def report(found: DataFrame) -> DataFrame:
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, shingle: int = 3, max_bits: int = 2) -> DataFrame:
    """One row of each group, the one with the smallest id; all columns stay.
    A group whose ids are all null keeps its row with the smallest key."""
    found = near_duplicates(docs, shingle, max_bits)
    group = F.coalesce(F.col("component_id").cast("string"), F.concat(F.lit("fp"), F.col("fp")))
    first = found.groupBy(group.alias("g")).agg(F.min(F.struct(F.col("doc_id").isNull().alias("x"), "d", "k")).alias("r")) \
        .select(F.col("r.d").alias("__d"), F.col("r.k").alias("__k"))
    d, k = row_key()
    marked = docs.withColumns({"__d": d, "__k": k})
    return marked.join(first, ["__d", "__k"]).dropDuplicates(["__d", "__k"]).select(*docs.columns)
