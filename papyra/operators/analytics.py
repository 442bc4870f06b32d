"""Corpus analytics over the ``papers`` table.

All of these are single aggregations (with map-side partial aggregation) or
an ``explode`` followed by one grouped count. Totals that a ratio needs come
from a scalar subquery, never from a driver round trip or a cross join.
Medians and quartiles use the exact ``percentile`` aggregate: its buffer is a
map of distinct values to counts, bounded by the number of distinct lengths,
not by the number of rows.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from papyra.functions import text as T


def corpus_stats(papers: DataFrame) -> DataFrame:
    return papers.agg(F.count(F.lit(1)).alias("total_papers"),
                      F.avg("text_length").alias("avg_text_length"),
                      F.avg("word_count").alias("avg_word_count"))


def distinct_authors(papers: DataFrame, approx: bool = False) -> DataFrame:
    a = papers.select(F.explode("authors").alias("author"))
    f = F.approx_count_distinct("author") if approx else F.count_distinct("author")
    return a.agg(f.alias("unique_authors"))


def date_range(papers: DataFrame) -> DataFrame:
    return papers.agg(F.min("update_date").alias("earliest"), F.max("update_date").alias("latest"))


def category_distribution(papers: DataFrame) -> DataFrame:
    return papers.select(F.explode("categories").alias("category")) \
        .groupBy("category").agg(F.count(F.lit(1)).alias("n"))


def top_categories(papers: DataFrame, n: int = 20) -> DataFrame:
    """Most common categories; ties by name."""
    return category_distribution(papers).orderBy(F.col("n").desc(), F.col("category")).limit(n)


def text_statistics(texts: DataFrame, col: str) -> DataFrame:
    """count, totals, mean/median/min/max of characters and words. Empty
    input gives no row."""
    t = texts.select(F.length(col).alias("c"),
                     T.word_count(col).alias("w"))
    stats = t.agg(F.count(F.lit(1)).alias("total_texts"),
                  F.sum("c").alias("total_characters"), F.sum("w").alias("total_words"),
                  F.avg("c").alias("avg_length"), F.median("c").alias("median_length"),
                  F.avg("w").alias("avg_words"), F.median("w").alias("median_words"),
                  F.min("c").alias("min_length"), F.max("c").alias("max_length"))
    return stats.where(F.col("total_texts") > 0)


def _counts_with_total(papers: DataFrame) -> DataFrame:
    """(category, n, total): each paper also counts once under a marker, so the
    total comes out of the same pass. The window runs over the counts only (one
    row a category)."""
    marker = F.array(F.lit(None).cast("string"))
    rows = papers.select(F.posexplode(F.concat(
        marker, F.coalesce("categories", F.array().cast("array<string>")))).alias("pos", "category"))
    n = rows.groupBy((F.col("pos") == 0).alias("all"), "category").agg(F.count(F.lit(1)).alias("n"))
    total = F.max(F.when(F.col("all"), F.col("n"))).over(Window.partitionBy())
    return n.withColumn("total", total).where(~F.col("all")).select("category", "n", "total")


def trending_categories(papers: DataFrame, asof: dt.date, period_days: int = 30) -> DataFrame:
    """Category counts among papers updated in the last ``period_days``
    (inclusive of the cut-off), with the window size and paper count."""
    cutoff = F.lit(asof).cast("timestamp") - F.make_interval(days=F.lit(period_days))
    return _counts_with_total(papers.where(F.col("update_date") >= cutoff)).select(
        "category", "n", F.col("total").alias("total_papers"), F.lit(period_days).alias("period_days"))


def category_share(papers: DataFrame, n: int = 5) -> DataFrame:
    """Top categories with their share of papers in percent."""
    return _counts_with_total(papers).orderBy(F.col("n").desc(), F.col("category")).limit(n).select(
        "category", "n", F.round(F.col("n") * 100.0 / F.col("total"), 6).alias("pct"))


def corpus_kpis(papers: DataFrame, asof: dt.date) -> DataFrame:
    """Papers, int(mean words), distinct authors, papers newer than 365 days,
    in one pass: a paper's own figures ride on its first author row."""
    cutoff = F.lit(asof).cast("timestamp") - F.make_interval(days=F.lit(365))
    marker = F.array(F.lit(None).cast("string"))
    rows = papers.select("word_count", "update_date", F.posexplode(F.concat(
        marker, F.coalesce("authors", F.array().cast("array<string>")))).alias("pos", "author"))
    own = F.col("pos") == 0
    return rows.agg(F.count_if(own).alias("papers"),
                    F.floor(F.avg(F.when(own, F.col("word_count")))).cast("long").alias("avg_words"),
                    F.count_if(own & (F.col("update_date") > cutoff)).alias("recent_papers"),
                    F.count_distinct(F.when(~own, F.col("author"))).alias("authors"))


QUARTILES = (0.25, 0.5, 0.75)
NUMERIC_STATS = ["count", "mean", "std", "min", "25%", "50%", "75%", "max"]


def describe(df: DataFrame, cols) -> DataFrame:
    """``(column, stat, value)``: count, mean, sample std, min, exact
    quartiles (linear interpolation), max for each numeric column. The quartiles keep
    a count for each distinct value: for lengths and the like; columns of
    continuous values go to ``sketches.describe_sketched``."""
    aggs = []
    for c in cols:
        x = F.col(c).cast("double")
        aggs += [F.count(x).cast("double").alias(f"{c}|count"), F.avg(x).alias(f"{c}|mean"),
                 F.stddev_samp(x).alias(f"{c}|std"), F.min(x).alias(f"{c}|min"),
                 # one map of values for the three
                 F.percentile(x, F.array(*[F.lit(p) for p in QUARTILES])).alias(f"{c}|q"), F.max(x).alias(f"{c}|max")]
    wide = df.agg(*aggs)
    wide = wide.select(*[F.col(f"`{a}`") for a in wide.columns if not a.endswith("|q")],
                       *[F.get(f"`{c}|q`", i).alias(f"{c}|{p:.0%}") for c in cols for i, p in enumerate(QUARTILES)])
    long = wide.unpivot([], [a for a in wide.columns], "key", "value")
    return long.select(F.split_part("key", F.lit("|"), F.lit(1)).alias("column"),
                       F.split_part("key", F.lit("|"), F.lit(2)).alias("stat"),
                       F.round("value", 6).alias("value"))


def value_counts(df: DataFrame, array_col: str = "categories") -> DataFrame:
    return df.select(F.explode(array_col).alias("value")).groupBy("value") \
        .agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "value")


def describe_text(df: DataFrame, cols) -> DataFrame:
    """``(column, stat, value)`` for text columns: count, unique, top (most
    frequent value, ties by value) and freq, as text. One grouped count per
    column; the most frequent value is a partial maximum over those counts."""
    out = None
    for c in cols:
        counts = df.where(F.col(c).isNotNull()).groupBy(F.col(c).cast("string").alias("v")).agg(
            F.count(F.lit(1)).alias("n"))
        one = counts.agg(F.sum("n").alias("count"), F.count(F.lit(1)).alias("unique"),
                         F.min_by("v", F.struct(-F.col("n"), F.col("v"))).alias("top"), F.max("n").alias("freq"))
        long = one.select(*[F.coalesce(F.col(x).cast("string"), F.lit("0" if x in ("count", "unique") else None))
                            .alias(x) for x in one.columns]).unpivot([], ["count", "unique", "top", "freq"], "stat", "value")
        long = long.select(F.lit(c).alias("column"), "stat", "value")
        out = long if out is None else out.unionByName(long)
    return out
