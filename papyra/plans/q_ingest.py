"""Ingest queries: cleaning, parsing, filtering and projecting paper records."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from papyra.functions import text as T
from papyra.operators import language as LG
from papyra.operators import papers as P
from papyra.plans import adapters as A
from papyra.plans import sqltext as S
from papyra.plans.catalog import register
from papyra.session import scratch_path
from papyra.sources import files as FS

INCLUDED_CATEGORIES = ["src3", "src7"]
SCAN_LIMIT = 300


def papers(spark, sf_dir, language=None, categories=None):
    return P.build_papers(A.raw_papers(spark, sf_dir), language=language, categories=categories)


def joined(c):
    return F.array_join(c, "|")


@register("clean_text", f"""WITH {S.raw_cte()}
SELECT doc_id, {S.clean_text('title')} AS clean_title, {S.clean_text('abstract')} AS clean_abstract FROM raw""")
def clean_text(spark, sf_dir):
    raw = A.raw_papers(spark, sf_dir)
    return raw.select("doc_id", T.clean_text("title").alias("clean_title"),
                      T.clean_text("abstract").alias("clean_abstract"))


@register("split_categories", f"""WITH {S.raw_cte()}
SELECT doc_id, array_to_string({S.split_categories('categories')}, '|') AS categories,
  CAST(len({S.split_categories('categories')}) AS INTEGER) AS n_categories FROM raw""")
def split_categories(spark, sf_dir):
    c = T.split_categories("categories")
    return A.raw_papers(spark, sf_dir).select(
        "doc_id", joined(c).alias("categories"), F.size(c).alias("n_categories"))


@register("parse_authors", f"""WITH {S.raw_cte()}
SELECT doc_id, array_to_string({S.parse_authors('authors_parsed', 'authors')}, '|') AS authors,
  CAST(len({S.parse_authors('authors_parsed', 'authors')}) AS INTEGER) AS n_authors FROM raw""")
def parse_authors(spark, sf_dir):
    a = T.parse_authors("authors_parsed", "authors")
    return A.raw_papers(spark, sf_dir).select(
        "doc_id", joined(a).alias("authors"), F.size(a).alias("n_authors"))


@register("parse_dates", f"""WITH {S.raw_cte()}
SELECT doc_id, update_date AS raw_date, {S.parse_date('update_date')} AS update_date FROM raw""")
def parse_dates(spark, sf_dir):
    return A.raw_papers(spark, sf_dir).select(
        "doc_id", F.col("update_date").alias("raw_date"), T.parse_date("update_date").alias("update_date"))


PROJECTION_COLS = """doc_id, id, title, abstract, combined_text, array_to_string(authors, '|') AS authors,
  array_to_string(categories, '|') AS categories, update_date, submitter, doi, journal_ref, text_length, word_count"""


def _projection_out(df):
    return df.select("doc_id", "id", "title", "abstract", "combined_text",
                     joined("authors").alias("authors"), joined("categories").alias("categories"),
                     "update_date", "submitter", "doi", "journal_ref", "text_length", "word_count")


@register("paper_projection", S.with_papers() + f"SELECT {PROJECTION_COLS} FROM papers")
def paper_projection(spark, sf_dir):
    return _projection_out(papers(spark, sf_dir))


@register("paper_filter_counters", f"""WITH {S.raw_cte()}, {S.flagged_cte('en')}
SELECT count(*) AS total, count_if(reject_reason IS NULL) AS kept,
  count(*) - count_if(reject_reason IS NULL) AS skipped,
  round(count_if(reject_reason IS NULL) * 100.0 / nullif(count(*), 0), 6) AS success_pct,
  {', '.join(f"count_if(reject_reason = '{r}') AS {r}" for r in P.REASONS)}
FROM flagged""")
def paper_filter_counters(spark, sf_dir):
    return P.ingest_counters(A.raw_papers(spark, sf_dir), language="en")


@register("language_ngrams", "SELECT count(*) AS scored, TRUE AS reaches_stop_words, TRUE AS reaches_976 FROM documents")
def language_ngrams(spark, sf_dir):
    """N-gram profiles learnt from three quarters of ``documents`` (by id), all rows scored:
    on the held-out quarter, does the agreement with ``lang`` reach the stop-word vote's,
    and 0.976?"""
    docs = A.table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = F.pmod(F.xxhash64("doc_id"), F.lit(4)) == 0
    profile = LG.fit(docs.where(~held), "text", "lang")
    scored = docs.select(held.alias("held"), "lang", LG.detect("text", profile).alias("g"), P.detect_language(F.col("text")).alias("w"))
    share = lambda c: F.avg(F.when(F.col("held") & F.col("lang").isNotNull(),     # noqa: E731
                                   F.coalesce(F.col(c) == F.col("lang"), F.lit(False)).cast("double")))
    one = scored.agg(F.count(F.lit(1)).alias("scored"), share("g").alias("g"), share("w").alias("w"))
    return one.select("scored", (F.col("g") >= F.col("w")).alias("reaches_stop_words"), (F.col("g") >= 0.976).alias("reaches_976"))


@register("ingest_write_counters", f"""WITH {S.raw_cte()}, {S.flagged_cte('en')}
SELECT CAST(1 AS BIGINT) AS malformed, count(*) AS total, count_if(reject_reason IS NULL) AS kept,
  count(*) - count_if(reject_reason IS NULL) AS skipped,
  {', '.join(f"count_if(reject_reason = '{r}') AS {r}" for r in P.REASONS)}, count_if(reject_reason IS NULL) AS written
FROM flagged""")
def ingest_write_counters(spark, sf_dir):
    """JSON lines and one malformed line read once: papers written, counters from the
    same pass."""
    base = scratch_path(spark, f"ingest-{uuid.uuid4().hex}")
    FS.save_json_lines(A.raw_papers(spark, sf_dir), f"{base}/raw")
    spark.createDataFrame([("{broken json",)], "value string").write.mode("append").text(f"{base}/raw")
    counts = P.write_papers(FS.read_raw(spark, f"{base}/raw", "jsonl"), f"{base}/papers", language="en")
    return FS.load_table(spark, f"{base}/papers").agg(F.count(F.lit(1)).alias("written")).select(
        *[F.lit(counts[c]).cast("long").alias(c) for c in ("malformed", "total", "kept", "skipped", *P.REASONS)], "written")


@register("category_include", S.with_papers(categories=INCLUDED_CATEGORIES)
          + "SELECT id, array_to_string(categories, '|') AS categories FROM papers")
def category_include(spark, sf_dir):
    p = papers(spark, sf_dir, categories=INCLUDED_CATEGORIES)
    return p.select("id", joined("categories").alias("categories"))


@register("language_filter", f"""WITH {S.raw_cte()}
SELECT doc_id, {S.detect_language(S.strip("coalesce(abstract, '')"))} AS detected_lang,
  {S.is_english('abstract')} AS keep FROM raw""")
def language_filter(spark, sf_dir):
    raw = A.raw_papers(spark, sf_dir)
    return raw.select("doc_id", P.detect_language(T.strip(F.coalesce("abstract", F.lit("")))).alias("detected_lang"),
                      P.is_english(F.col("abstract")).alias("keep"))


@register("papers_english", S.with_papers(language="en") + f"SELECT {PROJECTION_COLS} FROM papers")
def papers_english(spark, sf_dir):
    return _projection_out(papers(spark, sf_dir, language="en"))


@register("scan_limit", f"""WITH {S.raw_cte().replace('FROM documents)', f'FROM documents ORDER BY doc_id LIMIT {SCAN_LIMIT})')},
{S.flagged_cte()}, {S.papers_cte()} SELECT id FROM papers""")
def scan_limit(spark, sf_dir):
    p = P.build_papers(A.raw_papers(spark, sf_dir), language=None, sample_size=SCAN_LIMIT,
                       order_key="doc_id")
    return p.select("id")
