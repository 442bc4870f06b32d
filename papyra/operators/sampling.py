"""Repeatable samples of the papers table.

Random order is a hash of (id, seed), so a sample is exact in size and the
same on every run and cluster size. The per-category sample uses a
``row_number`` filter that Spark turns into a partial ``WindowGroupLimit``:
each task forwards at most ``per_category`` rows per category, so a category
holding a large share of all papers does not become one huge group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from papyra.operators.analytics import top_categories
from papyra.operators.retrieval import materialize


def random_key(id_col: str = "id", seed: int = 42, salt=None):
    parts = [F.col(id_col).cast("string"), F.lit(f"#{seed}")]
    if salt is not None:
        parts += [F.lit("#"), salt]
    return F.md5(F.concat(*parts))


def sample_random(df: DataFrame, n: int, seed: int = 42, id_col: str = "id") -> DataFrame:
    return df.orderBy(random_key(id_col, seed), id_col).limit(n)


def sample_recent(df: DataFrame, n: int, id_col: str = "id") -> DataFrame:
    return df.orderBy(F.col("update_date").desc_nulls_last(), F.col(id_col)).limit(n)


def sample_diverse(df: DataFrame, n: int, seed: int = 42, id_col: str = "id",
                   n_categories: int = 20) -> DataFrame:
    """Up to max(1, n // 20) papers from each of the 20 largest categories,
    de-duplicated by id (a paper keeps its place in the first category that
    picked it), topped up with random other papers, first n rows. Adds
    ``sample_order``. A table that holds an id several times gives that id once,
    the row with the smallest hash over all columns.

    ``df`` is read twice: once for the narrow (id, categories) rows, which are
    written, and once for the rows of the chosen ids."""
    per_cat = max(1, n // n_categories)
    narrow = materialize(df.select(id_col, "categories", _row_key(df).alias("_row")), "sample-ids")
    one = Window.partitionBy(id_col).orderBy("_row")
    ids = narrow.withColumn("_n", F.row_number().over(one)).where("_n = 1").drop("_n")
    # the largest categories: at most n_categories rows
    top = top_categories(ids, n_categories).select(
        "category", F.row_number().over(Window.orderBy(F.col("n").desc(), "category")).alias("cat_rank"))
    members = ids.select(id_col, "_row", F.explode("categories").alias("category")) \
        .join(F.broadcast(top), "category")
    w = Window.partitionBy("category").orderBy(random_key(id_col, seed, F.col("category")), id_col)
    picked = members.withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= per_cat)
    first = Window.partitionBy(id_col).orderBy("cat_rank", "pos")
    chosen = picked.withColumn("k", F.row_number().over(first)).where(F.col("k") == 1) \
        .select(id_col, "_row", (F.col("cat_rank") * (per_cat + 1) + F.col("pos")).cast("long").alias("sample_order"))
    # top-up: random papers not chosen yet, ordered after every chosen one
    rest = ids.select(id_col, "_row").join(chosen.select(id_col), id_col, "left_anti") \
        .orderBy(random_key(id_col, seed), id_col).limit(n) \
        .withColumn("sample_order", (F.lit(10 ** 9) + F.row_number().over(
            Window.orderBy(random_key(id_col, seed), id_col))).cast("long"))
    both = chosen.unionByName(rest).orderBy("sample_order").limit(n)
    wide = df.withColumn("_row", _row_key(df)).join(both, [id_col, "_row"])
    # rows equal in every column share the hash: one of them
    return wide.dropDuplicates([id_col]).select(*df.columns, "sample_order")


def _row_key(df: DataFrame):
    return F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])
