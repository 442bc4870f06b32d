"""Mixing sources to target weights by Pfair scheduling.

Rows of a source, in a hash order of their keys, are cut into blocks of ``block_rows``. A
source's target is its weight in whole units of 1 / ``units`` of the total (largest
remainder, one unit at least). With a units, its block j is released at slot
floor(j * units / a) with deadline ceil((j + 1) * units / a), and earliest deadline first
over the released blocks gives every slot one block. So at every slot each source is less
than one block off its target. After ``units`` slots all windows begin anew, exactly: one
such period is scheduled, by one task that gets a row a source and takes ``units`` steps at
most whatever the number of rows, and the place of any block follows from it by
arithmetic: slot(j) = j div a * units + slot(j mod a).

Weights are ``weights`` (source -> number) or rows ** ``power``. Every row is kept once; a
source that has run out leaves its slots empty. More than ``units`` / 64 sources raise
``units`` to 64 a source, so that the least unit stays small. Blocks are numbered by one
range shuffle of the rows; slots reach them by a join with one row a source, broadcast up
to ``BROADCAST_SOURCES`` sources (``units`` numbers in all) and shuffled beyond.

Cases: a null source is a source of its own; null ids and texts are rows like
others; repeated rows stay repeated; an empty table gives an empty result; sources
without a weight, or with one that is not above zero, get one unit; other columns
stay, but a column named like an output is replaced.
"""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from papyra.llm.common import Staged, row_key

UNITS = 1 << 20
BROADCAST_SOURCES, BROADCAST_PARTS = 1 << 14, 1 << 18
OUTPUT = ("block", "in_block", "release", "deadline", "slot")


def target_units(weights: list[float], units: int) -> list[int]:
    """Whole units of each source, one at least; they sum to ``units``."""
    w = np.maximum(np.array(weights, np.float64), 0.0)
    if not len(w):
        return []
    share = (w / w.sum() if w.sum() > 0 else np.full(len(w), 1 / len(w))) * units
    out = np.maximum(np.floor(share), 1).astype(np.int64)
    while (left := units - int(out.sum())) > 0:         # largest remainders first
        out[np.argsort(out - share, kind="stable")[:left]] += 1
    while (left := int(out.sum()) - units) > 0:         # what the least units cost, off the largest
        big = np.argsort(-out, kind="stable")
        big = big[out[big] > 1]
        take = np.minimum(np.ceil(out[big] / out[big].sum() * left).astype(np.int64), out[big] - 1)
        take[np.cumsum(take) > left] = 0
        if not take.any():
            take[0] = min(left, int(out[big[0]]) - 1)
        out[big] -= take
    return out.tolist()


def windows(a: int, units: int, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """Release and deadline of the first ``blocks`` blocks."""
    j = np.arange(blocks, dtype=np.int64)
    return j * units // a, -(-(j + 1) * units // a)


def period(targets: list[int], units: int, upto: int | None = None) -> list[list[int]]:
    """Slots of each source's blocks, in order, in the first ``upto`` slots of a period."""
    upto, k = units if upto is None else min(upto, units), len(targets)
    jobs = []
    for s, a in enumerate(targets):
        release, deadline = windows(a, units, -(-upto * a // units))
        jobs.append(np.stack([release, deadline * k + s]))      # one number orders by deadline, then source
    every = np.concatenate(jobs, axis=1) if jobs else np.zeros((2, 0), np.int64)
    every = every[:, np.argsort(every[0], kind="stable")]
    releases, keys = every.tolist()
    out: list[list[int]] = [[] for _ in targets]
    ready, at, n = [], 0, len(keys)
    for slot in range(upto if k else 0):
        while at < n and releases[at] <= slot:
            heapq.heappush(ready, keys[at])
            at += 1
        out[heapq.heappop(ready) % k].append(slot)      # weights sum to one: some block is always due
    return out


def plan(sources: DataFrame, units: int) -> DataFrame:
    """(__source, a, slots): units and the slots of a period of each of ``sources``
    (__source, weight, blocks); slots beyond the last block of all are left out."""
    def run(t):
        import pyarrow as pa

        rows = sorted(zip(*(t.column(c).to_pylist() for c in ("__source", "weight", "blocks"))))
        targets = target_units([w for _, w, _ in rows], units)
        upto = max((-(-b * units // a) for (_, _, b), a in zip(rows, targets)), default=0)
        slots = period(targets, units, upto)
        return pa.table([pa.array([s for s, _, _ in rows], pa.string()), pa.array(targets, pa.int64()),
                         pa.array(slots, pa.list_(pa.int32()))], names=["__source", "a", "slots"])
    return sources.withColumn("one", F.lit(0)).groupBy("one").applyInArrow(run, "__source string, a long, slots array<int>")


def mix(docs: DataFrame, weights: dict[str, float] | None = None, power: float = 0.5, block_rows: int = 16,
        units: int = UNITS) -> DataFrame:
    """``docs`` with block, in_block (place in the block), release, deadline and
    slot; reading by (slot, in_block) gives the mix."""
    spark = docs.sparkSession
    docs = docs.drop(*OUTPUT)
    names = docs.columns
    d, k = row_key()
    source = F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("n"))
    keys = ["__source", "__hash", "__d", "__k"]
    rows = Staged(docs.withColumns({"__source": source, "__d": d, "__k": k}).withColumn("__hash", F.xxhash64("__d", "__k"))
                  .repartitionByRange(*keys).sortWithinPartitions(*keys)
                  .withColumn("__m", F.monotonically_increasing_id()), "mix-rows").df
    # one row for each (partition, source) that meet: partitions + sources at most
    parts = rows.groupBy("__source", F.shiftright("__m", 33).alias("__part")).agg(
        F.count("*").alias("__n"), F.min("__m").alias("__first"))
    before = W.partitionBy("__source").orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    parts = Staged(parts.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0))), "mix-parts").df
    sizes = parts.groupBy("__source").agg(F.sum("__n").alias("n"))
    if weights:
        given = spark.createDataFrame([("n" if s is None else f"s{s}", float(w)) for s, w in weights.items()],
                                      "__source string, weight double")
        sizes = sizes.join(given, "__source", "left").withColumn("weight", F.coalesce("weight", F.lit(0.0)))
    else:
        sizes = sizes.withColumn("weight", F.pow(F.col("n").cast("double"), F.lit(float(power))))
    sizes = Staged(sizes.withColumn("blocks", F.ceil(F.col("n") / block_rows).cast("long")), "mix-sources").df
    count, n_parts = sizes.count(), parts.count()
    units = max(units, 64 * count)
    slots = Staged(plan(sizes.select("__source", "weight", "blocks"), units), "mix-slots").df
    # both are counted before they are broadcast
    near = F.broadcast if n_parts <= BROADCAST_PARTS else (lambda t: t)
    known = F.broadcast if count <= BROADCAST_SOURCES else (lambda t: t)
    ranked = rows.withColumn("__part", F.shiftright("__m", 33)) \
        .join(near(parts.select("__source", "__part", "__first", "__before")), ["__source", "__part"]) \
        .withColumn("__rank", F.col("__m") - F.col("__first") + F.col("__before")) \
        .withColumn("block", F.floor(F.col("__rank") / block_rows)) \
        .withColumn("in_block", F.col("__rank") % block_rows)
    b, a = F.col("block"), F.col("a")
    return ranked.join(known(slots), "__source").select(
        *names, "block", "in_block", F.expr(f"(block * {units}L) div a").alias("release"),
        F.expr(f"((block + 1) * {units}L + a - 1) div a").alias("deadline"),
        (F.expr("block div a") * units + F.get("slots", (b % a).cast("int"))).alias("slot"))
