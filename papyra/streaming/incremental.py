"""Incremental ingest and index maintenance with Structured Streaming.

New raw paper files arrive in a folder. A file-source stream (declared
schema, ``maxFilesPerTrigger``) feeds ``foreachBatch``; each micro-batch is
ingested (filters + projection), de-duplicated by id, reduced to the papers
whose (id, model, hybrid, text hash) the index does not hold yet, encoded,
assigned to the nearest stored centroid and appended to the index.

``foreachBatch`` is at-least-once. Every index row carries the (stream, batch)
that wrote it, vectors are written before their keys, and a batch's counters replace the
batch's own counter file: replaying a batch adds no row and leaves the same counters.
What the index holds is asked of a key table in buckets with Bloom filters
(``papyra.operators.membership``), so a batch reads neither the vectors nor all keys.
``compact_index`` writes an index anew after many small batches. A paper whose text has changed gets a
new row; readers take the newest row per (id, model) with ``current_index``.

One index is one folder: ``vectors`` (partitioned by model, cluster, stream and batch),
``keys``, ``counts`` (ids that each batch brought) and, if it is clustered, ``centroids``; ``papyra.operators.knn.clustered_knn`` reads what
both the build and the update have written.

``trigger(availableNow=True)`` processes what is there and stops (the batch
"update" command); a processing-time trigger keeps it running.

The summary cache is an append-only log of entries; its current state is the
newest entry per key (``papyra.operators.summaries.latest_per_key``), so an
upsert is an append and replays are harmless.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from papyra.functions import encode as E
from papyra.functions import vectors as V
from papyra.operators import index as IX
from papyra.operators import knn as K
from papyra.operators import papers as P
from papyra.operators.membership import KeyTable, mark
from papyra.schemas import RAW
from papyra.session import delete_path, ensure_checkpoint_dir, materialize, path_exists

INDEX_COLUMNS = ["id", "model", "hybrid", "text_md5", "vec", "cluster_id", "stream", "batch_id", "added_at"]
FIRST_BUILD = "build"


def read_index(spark: SparkSession, index_path: str) -> DataFrame | None:
    """All rows of the index, also replaced ones."""
    return IX.read_index(spark, index_path)[0] if path_exists(spark, f"{index_path}/vectors") else None


def current_index(spark: SparkSession, index_path: str) -> DataFrame | None:
    """The newest row per (id, model, hybrid)."""
    rows = read_index(spark, index_path)
    if rows is None:
        return None
    w = Window.partitionBy("id", "model", "hybrid").orderBy(F.desc("added_at"), F.desc("text_md5"))
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def encode_papers(papers: DataFrame, model: str = "hash256", encoder=None, hybrid: bool = False) -> DataFrame:
    """``(id, model, hybrid, text_md5, vec, added_at)``; ``encoder(df, text_col) ->
    df + vec`` plugs in another model (see ``papyra.functions.plugins``).
    ``hybrid`` encodes title and abstract apart and blends them 0.4 / 0.6."""
    run = encoder or (lambda df, col: E.hash_encode(df, col, "vec"))
    rows = papers.withColumn("text_md5", F.md5("combined_text"))
    if hybrid:
        rows = run(rows, "title").withColumnRenamed("vec", "_title")
        rows = run(rows, "abstract").withColumn("vec", V.blend("_title", "vec", E.TITLE_WEIGHT, E.ABSTRACT_WEIGHT))
    else:
        rows = run(rows, "combined_text")
    return rows.select("id", F.lit(model).alias("model"), F.lit(hybrid).alias("hybrid"), "text_md5", "vec",
                       F.current_timestamp().alias("added_at"))


def _assigned(rows: DataFrame, centroids: DataFrame | None) -> DataFrame:
    """``cluster_id`` of the nearest centroid; 0 in an index without centroids."""
    if centroids is None:
        return rows.withColumn("cluster_id", F.lit(0).cast("long"))
    probes = K.probe_clusters(rows.withColumn("query_id", F.concat_ws("#", "id", "text_md5")), centroids, 1)
    near = probes.select(F.col("query_id").alias("_key"), "cluster_id")
    return rows.withColumn("_key", F.concat_ws("#", "id", "text_md5")).join(near, "_key", "left") \
        .withColumn("cluster_id", F.coalesce("cluster_id", F.lit(0)).cast("long")).drop("_key")


def build_index(papers: DataFrame, index_path: str, force: bool = False, model: str = "hash256",
                encoder=None, hybrid: bool = False, clustered: bool = False, n_clusters: int | None = None) -> bool:
    """First build (or forced rebuild): encode, train centroids if ``clustered``,
    write vectors and centroids. Returns False when an index exists and
    ``force`` is not set (nothing done)."""
    spark = papers.sparkSession
    if path_exists(spark, f"{index_path}/vectors") and not force:
        return False
    rows = materialize(encode_papers(IX.first_per_id(papers, "id"), model, encoder, hybrid), "index-rows")
    centroids = None
    if clustered:
        rows, centroids = K.kmeans_index(rows, n_clusters)
    else:
        rows = _assigned(rows, None)
        delete_path(spark, f"{index_path}/centroids")
    rows = rows.withColumns({"stream": F.lit(FIRST_BUILD), "batch_id": F.lit(0).cast("long")})
    for part in ("keys", "counts", "started"):
        delete_path(spark, f"{index_path}/{part}")
    IX.write_index(rows.select(*INDEX_COLUMNS), index_path, centroids)
    _write_keys(spark, rows, index_path)
    return True


def key_table(spark: SparkSession, index_path: str) -> KeyTable:
    """(id, model, hybrid, text_md5, first, stream, batch_id) of every index row;
    ``first`` marks the row that brought the id into its model."""
    return KeyTable(spark, f"{index_path}/keys")


def _tag(stream: str, batch_id: int):
    return (F.col("stream") == stream) & (F.col("batch_id") == batch_id)


def add_batch(batch_papers: DataFrame, index_path: str, model: str = "hash256", encoder=None,
              stats_path: str | None = None, batch_id: int | None = None, hybrid: bool = False,
              stream: str = "batch") -> None:
    """Append the papers of one batch that the index does not hold under the full key,
    then replace the batch's counters. The index itself is not read: the key table
    opens the buckets that may hold an id of the batch. Vectors are written before
    their keys; a batch that has been started before looks for its own vectors (one
    partition) too, so running it again, in any row order, adds nothing."""
    spark = batch_papers.sparkSession
    batch_id = 0 if batch_id is None else batch_id
    again = mark(spark, f"{index_path}/started/{stream}/{batch_id}")
    keys = key_table(spark, index_path)
    if not keys.exists():
        keys.create()
    papers = materialize(IX.first_per_id(batch_papers, "id").withColumn("text_md5", F.md5("combined_text")), "batch")
    stored = keys.lookup(papers)
    columns = ["id", "text_md5", "stream", "batch_id", "first"]
    known = spark.createDataFrame([], "id string, text_md5 string, stream string, batch_id long, first boolean") \
        if stored is None else stored.where((F.col("model") == model) & (F.col("hybrid") == F.lit(hybrid))).select(*columns)
    known = materialize(known, "known")
    fresh, centroids = papers.join(known, ["id", "text_md5"], "left_anti"), None
    vectors = f"{index_path}/vectors"
    if path_exists(spark, f"{index_path}/centroids"):
        centroids = spark.read.parquet(f"{index_path}/centroids")
    lost = None                 # vectors that an earlier attempt left without keys
    if again and path_exists(spark, vectors):
        mine = IX.read_index(spark, index_path)[0].where(_tag(stream, batch_id) & (F.col("model") == model)
                                                         & (F.col("hybrid") == F.lit(hybrid))).select("id", "text_md5")
        lost = materialize(mine.join(known.where(_tag(stream, batch_id)), ["id", "text_md5"], "left_anti"), "lost")
        fresh = fresh.join(lost, ["id", "text_md5"], "left_anti")
    rows = _assigned(encode_papers(fresh.drop("text_md5"), model, encoder, hybrid), centroids).withColumns(
        {"stream": F.lit(stream), "batch_id": F.lit(batch_id).cast("long")})
    rows.select(*INDEX_COLUMNS).write.mode("append").partitionBy(*IX.PARTITIONS).parquet(vectors)
    new = fresh.select("id", "text_md5") if lost is None else fresh.select("id", "text_md5").unionByName(lost)
    new = materialize(new.join(known.select("id").distinct().withColumn("_old", F.lit(True)), "id", "left")
                      .withColumn("first", F.col("_old").isNull()).drop("_old"), "new-keys")
    if new.limit(1).count():
        keys.add(new.select("id", F.lit(model).alias("model"), F.lit(hybrid).alias("hybrid"), "text_md5", "first",
                            F.lit(stream).alias("stream"), F.lit(batch_id).cast("long").alias("batch_id")))
    own = known.where(_tag(stream, batch_id) & F.col("first")).select("id").unionByName(new.where("first").select("id"))
    own = own.distinct()
    counts = f"{index_path}/counts/{stream}-{batch_id}-{model}-{hybrid}"
    if again:                   # keys of an earlier attempt with other papers count as well
        own_all = keys.all().where(_tag(stream, batch_id) & (F.col("model") == model)
                                   & (F.col("hybrid") == F.lit(hybrid)) & F.col("first")).select("id").distinct()
    else:
        own_all = own
    own_all.agg(F.lit(model).alias("model"), F.lit(hybrid).alias("hybrid"), F.lit(stream).alias("stream"),
                F.lit(batch_id).cast("long").alias("batch_id"), F.count(F.lit(1)).alias("new_ids")) \
        .write.mode("overwrite").parquet(counts)
    if stats_path is not None:
        # ids that other batches brought are what existed before; a replay sees the same
        later = (F.col("stream") == stream) & (F.col("batch_id") >= batch_id)
        before = spark.read.option("recursiveFileLookup", "true").parquet(f"{index_path}/counts") \
            .where((F.col("model") == model) & (F.col("hybrid") == F.lit(hybrid)) & ~later) \
            .agg(F.coalesce(F.sum("new_ids"), F.lit(0)).alias("n"))
        added = own.join(papers.select("id"), "id", "left_semi").agg(F.count(F.lit(1)).alias("n"))
        stats = papers.agg(F.count(F.lit(1)).alias("ids")).select(
            before.scalar().alias("existing"), added.scalar().alias("added"), "ids")
        stats.select("existing", "added", (F.col("ids") - F.col("added")).alias("duplicates"),
                     (F.col("existing") + F.col("added")).alias("total_after"), F.current_timestamp().alias("at")) \
            .write.mode("overwrite").parquet(f"{stats_path}/stream={stream}/batch_id={batch_id}")


def compact_index(spark: SparkSession, index_path: str, to: str) -> None:
    """The current index written anew to ``to``: newest row per (id, model, hybrid), few
    files a cluster, one filter a bucket. Readers move over when it is complete."""
    if path_exists(spark, f"{to}/vectors"):
        raise ValueError(f"{to} holds an index")
    rows = materialize(current_index(spark, index_path), "compacted")
    centroids = IX.read_index(spark, index_path)[1]
    IX.write_index(rows.select(*INDEX_COLUMNS).withColumns({"stream": F.lit(FIRST_BUILD), "batch_id": F.lit(0).cast("long")}),
                   to, centroids)
    _write_keys(spark, rows, to)
    # batches that are run again on the new index are looked up like any others


def _write_keys(spark: SparkSession, rows: DataFrame, index_path: str) -> None:
    """Keys and counters of an index that has one row per (id, model, hybrid)."""
    keys = key_table(spark, index_path)
    keys.create(rows.count())
    keys.add(rows.select("id", "model", "hybrid", "text_md5", F.lit(True).alias("first"),
                         F.lit(FIRST_BUILD).alias("stream"), F.lit(0).cast("long").alias("batch_id")))
    rows.groupBy("model", "hybrid").agg(F.count(F.lit(1)).alias("new_ids")).select(
        "model", "hybrid", F.lit(FIRST_BUILD).alias("stream"), F.lit(0).cast("long").alias("batch_id"), "new_ids") \
        .write.mode("overwrite").parquet(f"{index_path}/counts/{FIRST_BUILD}")


def start_index_stream(spark: SparkSession, source_dir: str, index_path: str, checkpoint: str | None = None,
                       stats_path: str | None = None, model: str = "hash256", encoder=None,
                       hybrid: bool = False, stream: str = "stream",
                       language: str | None = "en", categories=None, max_files_per_trigger: int = 100,
                       available_now: bool = True, fmt: str = "json"):
    """Stream new raw paper files from ``source_dir`` into the index."""
    ckpt = checkpoint or f"{ensure_checkpoint_dir(spark).rstrip('/')}/index-stream"
    reader = spark.readStream.schema(RAW).option("maxFilesPerTrigger", max_files_per_trigger)
    if fmt == "array":
        reader = reader.option("multiLine", True)
    raw = reader.json(source_dir)

    def each(batch_df: DataFrame, batch_id: int) -> None:
        papers = P.build_papers(batch_df, language=language, categories=categories)
        add_batch(papers, index_path, model, encoder, stats_path, batch_id, hybrid, stream)

    w = raw.writeStream.foreachBatch(each).option("checkpointLocation", ckpt)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start()


def start_cache_stream(spark: SparkSession, source_dir: str, cache_log: str, checkpoint: str | None = None,
                       available_now: bool = True):
    """Append new summary entries ``(key, summary, ts, title)`` (JSON lines)
    to the cache log; readers take the newest entry per key."""
    ckpt = checkpoint or f"{ensure_checkpoint_dir(spark).rstrip('/')}/cache-stream"
    schema = "key string, summary string, ts timestamp, title string"
    src = spark.readStream.schema(schema).json(source_dir)
    w = src.writeStream.format("parquet").option("path", cache_log).option("checkpointLocation", ckpt)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start()


def current_cache(spark: SparkSession, cache_log: str) -> DataFrame:
    from papyra.operators.summaries import latest_per_key
    return latest_per_key(spark.read.parquet(cache_log))

