"""The summary cache as keyed state of a stream.

Entries ``(key, summary, ts, title)`` arrive as JSON lines. The stream keeps one entry a
key in Spark's state store: a later ``ts`` replaces it, an equal one only if its summary
is larger, an older or repeated entry changes nothing; so late arrivals and replays are
harmless, and readers get one row a key without ranking a history. The state is
read with Spark's state store reader; it is as old as the last finished batch.

Keys are spread over the state partitions by their hash; a key's entries reach its task in
pieces and are compared one by one, so a hot key is never held whole. Null keys are
dropped; a null ``ts`` loses against any other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papyra.session import ensure_checkpoint_dir

ENTRY = "key string, summary string, ts timestamp, title string"
STATE = "rank string, summary string, ts timestamp, title string"


def _rank(col_ts="ts", col_summary="summary"):
    """Text that orders entries: by time, then by summary."""
    ts = F.coalesce(F.date_format(col_ts, "yyyyMMddHHmmssSSSSSS"), F.lit("")).alias("t")
    return F.concat(F.rpad(ts, 20, " "), F.coalesce(F.col(col_summary), F.lit("")))


def keep_best(key, batches, state):
    """State update: the entry with the largest rank; nothing is emitted."""
    best = tuple(state.get) if state.exists else None
    for rows in batches:
        for r in rows.itertuples(index=False):
            if best is None or r.rank.encode() > best[0].encode():
                best = (r.rank, r.summary, None if r.ts != r.ts else r.ts, r.title)
    state.update(best)
    yield from ()


def start_cache_state(spark: SparkSession, source_dir: str, checkpoint: str | None = None, available_now: bool = True):
    """Keep the newest entry of each key of the files in ``source_dir``; the state
    lives in ``checkpoint``."""
    ckpt = checkpoint or f"{ensure_checkpoint_dir(spark).rstrip('/')}/cache-state"
    src = spark.readStream.schema(ENTRY).json(source_dir).where(F.col("key").isNotNull())
    kept = src.select("key", _rank().alias("rank"), "summary", "ts", "title").groupBy("key").applyInPandasWithState(
        keep_best, "key string", STATE, "update", "NoTimeout")
    w = kept.writeStream.outputMode("update").format("noop").option("checkpointLocation", ckpt)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start()


def cache_state(spark: SparkSession, checkpoint: str) -> DataFrame:
    """``(key, summary, ts, title)``: the current entry of each key."""
    e = F.col("value.groupState")
    return spark.read.format("statestore").load(checkpoint).select(
        F.col("key.key").alias("key"), e["summary"].alias("summary"), e["ts"].alias("ts"), e["title"].alias("title"))
