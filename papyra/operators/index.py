"""Vector index maintenance: membership tests, incremental add, removal,
statistics and persistence.

The index is a plain table ``(id, model, vec, cluster_id, added_at)`` stored
as Parquet partitioned by ``model`` and ``cluster_id`` (so a clustered search
reads only the probed partitions), plus a small ``centroids`` table. Adds are
keyed by id: rows already present are skipped, duplicates inside one batch
are collapsed first, so replaying a batch changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from papyra.session import path_exists


def unseen(incoming: DataFrame, index: DataFrame, id_col: str = "id", index_id: str = "id") -> DataFrame:
    """Incoming rows whose id is not in the index (left anti join)."""
    return incoming.join(index.select(F.col(index_id).alias(id_col)), id_col, "left_anti")


def already_indexed(incoming: DataFrame, index: DataFrame, id_col: str = "id",
                    index_id: str = "id") -> DataFrame:
    """Incoming rows whose id is already in the index (left semi join)."""
    return incoming.join(index.select(F.col(index_id).alias(id_col)), id_col, "left_semi")


def update_stats(incoming: DataFrame, index: DataFrame, id_col: str = "id",
                 index_id: str = "id") -> DataFrame:
    """One row: existing, added, duplicates, total_after (distinct ids)."""
    inc = incoming.select(F.col(id_col).alias("k")).distinct().withColumn("i", F.lit(1))
    ex = index.select(F.col(index_id).alias("k")).distinct().withColumn("e", F.lit(1))
    j = inc.join(ex, "k", "full")
    existing = F.count_if(F.col("e").isNotNull())
    added = F.count_if(F.col("i").isNotNull() & F.col("e").isNull())
    return j.agg(existing.alias("existing"), added.alias("added"),
                 F.count_if(F.col("i").isNotNull() & F.col("e").isNotNull()).alias("duplicates"),
                 (existing + added).alias("total_after"))


def row_order(df: DataFrame) -> list:
    """A total order of a table's distinct rows that does not depend on their
    arrival: a hash of the whole row, then the row as text."""
    whole = F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"ignoreNullFields": "false"})
    return [F.xxhash64(whole), whole]


def first_per_id(df: DataFrame, id_col: str = "id", order_cols=None) -> DataFrame:
    """Keep one row per id: the first by ``order_cols``, then by ``row_order``, so
    that the winner does not depend on the order of arrival."""
    w = Window.partitionBy(id_col).orderBy(*(order_cols or []), *row_order(df))
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") == 1).drop("_n")


def remove(index: DataFrame, ids: DataFrame, id_col: str = "id") -> DataFrame:
    """Index without the given ids."""
    return index.join(ids.select(id_col), id_col, "left_anti")


def index_stats(index: DataFrame, vec_col: str = "vec", cluster_col: str | None = "cluster_id",
                ts_col: str | None = None) -> DataFrame:
    """Per model: vector count, width, cluster count, first/last add time."""
    aggs = [F.count(F.lit(1)).alias("total_vectors"), F.max(F.size(vec_col)).alias("dimension")]
    if cluster_col:
        aggs.append(F.count_distinct(cluster_col).alias("n_clusters"))
    if ts_col:
        aggs += [F.min(ts_col).alias("created_at"), F.max(ts_col).alias("last_updated")]
    return index.groupBy("model").agg(*aggs)


ROWS_PER_FILE = 250_000
PARTITIONS = ("model", "cluster_id", "stream", "batch_id")


def write_index(vectors: DataFrame, path: str, centroids: DataFrame | None = None,
                mode: str = "overwrite", rows_per_file: int = ROWS_PER_FILE) -> None:
    """Persist vectors partitioned by (model, cluster_id) and the centroids. A
    cluster is written by as many tasks as its size asks for, so a hot one
    is neither one task nor one file."""
    parts = [c for c in PARTITIONS if c in vectors.columns]
    if parts:
        sizes = vectors.groupBy(*parts).agg(F.ceil(F.count(F.lit(1)) / rows_per_file).alias("_files"))
        salted = vectors.join(sizes, parts).withColumn("_salt", F.pmod(F.xxhash64("id"), F.col("_files")))
        files = int(sizes.agg(F.sum("_files")).first()[0] or 1)
        vectors = salted.repartition(files, *parts, "_salt").drop("_files", "_salt")
    vectors.write.mode(mode).partitionBy(*parts).parquet(f"{path}/vectors")
    if centroids is not None:
        centroids.write.mode(mode).parquet(f"{path}/centroids")


def read_index(spark: SparkSession, path: str):
    """(vectors, centroids); a flat index has no centroids."""
    v = spark.read.parquet(f"{path}/vectors")
    # folder names say nothing of their types
    kinds = {"model": "string", "cluster_id": "long", "stream": "string", "batch_id": "long"}
    v = v.withColumns({c: F.col(c).cast(t) for c, t in kinds.items() if c in v.columns})
    return v, spark.read.parquet(f"{path}/centroids") if path_exists(spark, f"{path}/centroids") else None


def needs_encoding(papers: DataFrame, index: DataFrame, model: str, hybrid: bool,
                   text_col: str = "combined_text") -> DataFrame:
    """Papers without a stored vector under the full key (id, model, hybrid,
    hash of the text), with ``text_md5``."""
    keyed = papers.withColumn("text_md5", F.md5(F.col(text_col)))
    stored = index.where((F.col("model") == model) & (F.col("hybrid") == F.lit(hybrid))).select("id", "text_md5")
    return keyed.join(stored, ["id", "text_md5"], "left_anti")


def indexed_ids(index: DataFrame, id_col: str = "id") -> DataFrame:
    return index.select(id_col).distinct()
