"""Derive the reference-shaped inputs from the driver tables.

``documents`` stands in for raw paper metadata and ``embeddings`` for the
vector store. The arithmetic is deterministic, so the DuckDB oracle computes
the same rows (see ``papyra.plans.oracle``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papyra.functions import vectors as V


#: For benchmarks on small single-file tables only: deal the rows of a text
#: table, whose one file gives one split, over this many tasks.
SPREAD_SCANS = 0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return df.repartition(SPREAD_SCANS) if SPREAD_SCANS and name in ("documents", "pages", "conversations") else df


def raw_papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` -> raw paper records (schema of ``papyra.schemas.RAW`` + doc_id)."""
    d = table(spark, sf_dir, "documents")
    doc = F.col("doc_id")
    day = F.date_add(F.lit("2023-01-01").cast("date"), (doc % 730).cast("int"))
    date_text = F.date_format(day, "yyyy-MM-dd")
    return d.select(
        doc.alias("doc_id"),
        F.format_string("%02d%02d.%05d", F.lit(15) + doc % 10, F.lit(1) + doc % 12, doc).alias("id"),
        F.substring_index(F.col("text"), "\n", 1).alias("title"),
        F.col("text").alias("abstract"),
        F.concat_ws(" ", "lang", "source", "lang").alias("categories"),
        F.when(doc % 2 == 1, F.format_string("Author %d, Author %d, Author %d",
                                             doc % 97, doc % 89, doc % 83)).alias("authors"),
        F.when(doc % 2 == 0, F.array(
            F.array(F.format_string("L%d", doc % 97), F.format_string("F%d", doc % 53)),
            F.array(F.format_string("L%d", doc % 89), F.lit("")))).alias("authors_parsed"),
        F.when(doc % 50 == 0, F.lit("bad"))
         .when(doc % 50 == 1, F.concat(date_text, F.lit("T00:00:00")))
         .otherwise(date_text).alias("update_date"),
        F.lit(None).cast("string").alias("submitter"),
        F.lit(None).cast("string").alias("doi"),
        F.lit(None).cast("string").alias("journal-ref"),
    )


def vectors(spark: SparkSession, sf_dir: str, model: str = "m64") -> DataFrame:
    """``embeddings`` -> ``(id, model, vec, label)``; ``m32`` folds the
    halves of the vector onto each other, re-normalised."""
    e = table(spark, sf_dir, "embeddings")
    vec = F.col("embedding").cast("array<double>")
    if model == "m32":
        half = F.floor(F.size(vec) / 2).cast("int")
        vec = V.normalize(F.zip_with(F.slice(vec, F.lit(1), half), F.slice(vec, half + 1, half), lambda x, y: x + y))
    elif model != "m64":
        raise ValueError(f"unknown model {model!r}")
    return e.select(F.col("vec_id").alias("id"), F.lit(model).alias("model"),
                    vec.alias("vec"), F.col("label"))


def all_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors(spark, sf_dir, "m64").unionByName(vectors(spark, sf_dir, "m32"))


def paper_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id -> adapter paper id (used to attach vectors to papers)."""
    return raw_papers(spark, sf_dir).select("doc_id", "id")
