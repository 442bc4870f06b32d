"""Corpus analytics, sampling and id-set queries over the papers table."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import functions as F

from papyra.operators import analytics as AN
from papyra.operators import sampling as SM
from papyra.operators import index as IX
from papyra.operators import sketches as SK
from papyra.plans import adapters as A
from papyra.plans import sqltext as S
from papyra.plans.catalog import register
from papyra.plans.q_ingest import papers
from papyra.session import materialize, scratch_path

ASOF = dt.date(2024, 12, 31)
ASOF_SQL = "TIMESTAMP '2024-12-31 00:00:00'"
TREND_DAYS = 90
SAMPLE_N = 100
WP = S.with_papers()


@register("corpus_stats", WP + """SELECT count(*) AS total_papers, avg(text_length) AS avg_text_length,
  avg(word_count) AS avg_word_count FROM papers""")
def corpus_stats(spark, sf_dir):
    return AN.corpus_stats(papers(spark, sf_dir))


@register("distinct_authors", WP + """SELECT count(DISTINCT author) AS unique_authors
  FROM (SELECT unnest(authors) AS author FROM papers)""")
def distinct_authors(spark, sf_dir):
    return AN.distinct_authors(papers(spark, sf_dir))


@register("date_range", WP + "SELECT min(update_date) AS earliest, max(update_date) AS latest FROM papers")
def date_range(spark, sf_dir):
    return AN.date_range(papers(spark, sf_dir))


CAT_DIST = "SELECT category, count(*) AS n FROM (SELECT unnest(categories) AS category FROM papers) GROUP BY category"


@register("category_distribution", WP + CAT_DIST)
def category_distribution(spark, sf_dir):
    return AN.category_distribution(papers(spark, sf_dir))


@register("top_categories", WP + CAT_DIST + " ORDER BY n DESC, category LIMIT 20")
def top_categories(spark, sf_dir):
    return AN.top_categories(papers(spark, sf_dir), 20)


@register("text_statistics", WP + f"""SELECT count(*) AS total_texts,
  CAST(sum(c) AS BIGINT) AS total_characters, CAST(sum(w) AS BIGINT) AS total_words,
  avg(c) AS avg_length, median(c) AS median_length, avg(w) AS avg_words, median(w) AS median_words,
  min(c) AS min_length, max(c) AS max_length
FROM (SELECT {S.length('abstract')} AS c, {S.word_count('abstract')} AS w FROM papers)
HAVING count(*) > 0""")
def text_statistics(spark, sf_dir):
    return AN.text_statistics(papers(spark, sf_dir), "abstract")


@register("trending_categories", WP + f"""SELECT category, count(*) AS n,
  (SELECT count(*) FROM papers WHERE update_date >= {ASOF_SQL} - INTERVAL {TREND_DAYS} DAY) AS total_papers,
  {TREND_DAYS} AS period_days
FROM (SELECT unnest(categories) AS category FROM papers
      WHERE update_date >= {ASOF_SQL} - INTERVAL {TREND_DAYS} DAY) GROUP BY category""")
def trending_categories(spark, sf_dir):
    return AN.trending_categories(papers(spark, sf_dir), ASOF, TREND_DAYS)


@register("category_share", WP + f"""SELECT category, n, round(n * 100.0 / (SELECT count(*) FROM papers), 6) AS pct
FROM ({CAT_DIST} ORDER BY n DESC, category LIMIT 5)""")
def category_share(spark, sf_dir):
    return AN.category_share(papers(spark, sf_dir), 5)


@register("corpus_kpis", WP + f"""SELECT count(*) AS papers, CAST(floor(avg(word_count)) AS BIGINT) AS avg_words,
  count_if(update_date > {ASOF_SQL} - INTERVAL 365 DAY) AS recent_papers,
  (SELECT count(DISTINCT a) FROM (SELECT unnest(authors) AS a FROM papers)) AS authors
FROM papers""")
def corpus_kpis(spark, sf_dir):
    return AN.corpus_kpis(papers(spark, sf_dir), ASOF)


def _describe_sql(cols):
    parts = []
    for c in cols:
        x = f"CAST({c} AS DOUBLE)"
        for stat, agg in [("count", f"CAST(count({x}) AS DOUBLE)"), ("mean", f"avg({x})"),
                          ("std", f"stddev_samp({x})"), ("min", f"min({x})"),
                          ("25%", f"quantile_cont({x}, 0.25)"), ("50%", f"quantile_cont({x}, 0.5)"),
                          ("75%", f"quantile_cont({x}, 0.75)"), ("max", f"max({x})")]:
            parts.append(f"SELECT '{c}' AS \"column\", '{stat}' AS stat, round({agg}, 6) AS value FROM papers")
    return "\nUNION ALL ".join(parts)


DESCRIBE_COLS = ["text_length", "word_count"]


@register("describe", WP + _describe_sql(DESCRIBE_COLS))
def describe(spark, sf_dir):
    return AN.describe(papers(spark, sf_dir), DESCRIBE_COLS)


@register("value_counts", WP + """SELECT value, count(*) AS n FROM (SELECT unnest(categories) AS value FROM papers)
GROUP BY value ORDER BY n DESC, value""")
def value_counts(spark, sf_dir):
    return AN.value_counts(papers(spark, sf_dir))


def _sample_cols(df):
    return df.select("id", "update_date")


@register("sample_random", WP + f"""SELECT id, update_date FROM papers
ORDER BY md5(CAST(id AS VARCHAR) || '#42'), id LIMIT {SAMPLE_N}""")
def sample_random(spark, sf_dir):
    return _sample_cols(SM.sample_random(papers(spark, sf_dir), SAMPLE_N))


@register("sample_recent", WP + f"""SELECT id, update_date FROM papers
ORDER BY update_date DESC NULLS LAST, id LIMIT {SAMPLE_N}""")
def sample_recent(spark, sf_dir):
    return _sample_cols(SM.sample_recent(papers(spark, sf_dir), SAMPLE_N))


def _diverse_sql(n: int, per_cat: int) -> str:
    key = "md5(CAST(id AS VARCHAR) || '#42')"
    return WP.rstrip() + f""",
once AS (SELECT id, any_value(categories) AS categories, any_value(update_date) AS update_date FROM papers GROUP BY id),
top AS (SELECT category, row_number() OVER (ORDER BY n DESC, category) AS cat_rank
        FROM (SELECT category, count(*) AS n FROM (SELECT unnest(categories) AS category FROM once) GROUP BY category
              ORDER BY n DESC, category LIMIT 20)),
members AS (SELECT p.id, c.category FROM (SELECT id, unnest(categories) AS category FROM once) p
            JOIN top c ON p.category = c.category),
picked AS (SELECT m.id, t.cat_rank, row_number() OVER (PARTITION BY m.category
             ORDER BY md5(CAST(m.id AS VARCHAR) || '#42' || '#' || m.category), m.id) AS pos
           FROM members m JOIN top t ON m.category = t.category),
chosen AS (SELECT id, cat_rank * {per_cat + 1} + pos AS sample_order FROM (
             SELECT *, row_number() OVER (PARTITION BY id ORDER BY cat_rank, pos) AS k
             FROM picked WHERE pos <= {per_cat}) WHERE k = 1),
rest AS (SELECT id, 1000000000 + row_number() OVER (ORDER BY {key}, id) AS sample_order
         FROM (SELECT id FROM once WHERE id NOT IN (SELECT id FROM chosen) ORDER BY {key}, id LIMIT {n})),
both_ AS (SELECT * FROM (SELECT * FROM chosen UNION ALL SELECT * FROM rest) ORDER BY sample_order LIMIT {n})
SELECT p.id, p.update_date, b.sample_order FROM once p JOIN both_ b ON p.id = b.id"""


@register("sample_diverse", _diverse_sql(SAMPLE_N, max(1, SAMPLE_N // 20)))
def sample_diverse(spark, sf_dir):
    return SM.sample_diverse(papers(spark, sf_dir), SAMPLE_N).select("id", "update_date", "sample_order")


VEC_IDS = "(SELECT DISTINCT vec_id FROM embeddings)"


@register("new_docs_anti", WP + f"SELECT doc_id FROM papers WHERE doc_id NOT IN {VEC_IDS}")
def new_docs_anti(spark, sf_dir):
    return IX.unseen(papers(spark, sf_dir).select("doc_id"), A.vectors(spark, sf_dir), "doc_id", "id")


@register("duplicate_semi", WP + f"SELECT doc_id FROM papers WHERE doc_id IN {VEC_IDS}")
def duplicate_semi(spark, sf_dir):
    return IX.already_indexed(papers(spark, sf_dir).select("doc_id"), A.vectors(spark, sf_dir), "doc_id", "id")


@register("update_stats", WP + f"""SELECT
  (SELECT count(*) FROM {VEC_IDS}) AS existing,
  count_if(doc_id NOT IN {VEC_IDS}) AS added,
  count_if(doc_id IN {VEC_IDS}) AS duplicates,
  (SELECT count(*) FROM {VEC_IDS}) + count_if(doc_id NOT IN {VEC_IDS}) AS total_after
FROM (SELECT DISTINCT doc_id FROM papers)""")
def update_stats(spark, sf_dir):
    return IX.update_stats(papers(spark, sf_dir).select("doc_id"), A.vectors(spark, sf_dir), "doc_id", "id")


@register("arrival_statistics", WP + """SELECT count(*) AS total_papers, round(avg(text_length), 6) AS avg_text_length,
  round(avg(word_count), 6) AS avg_word_count, min(update_date) AS earliest, max(update_date) AS latest,
  TRUE AS authors_within_5_percent, TRUE AS medians_within_2_percent FROM papers""")
def arrival_statistics(spark, sf_dir):
    """Statistics of three arrivals (one recorded twice), merged from their sketches;
    distinct authors and median ranks against the exact ones."""
    path = scratch_path(spark, f"arrivals-{uuid.uuid4().hex}")
    p = materialize(papers(spark, sf_dir), "papers")
    for name, part in (("a", 0), ("b", 1), ("c", 2), ("b", 1)):
        SK.record_arrival(p.where(F.pmod(F.xxhash64("id"), F.lit(3)) == part), path, name)
    t = SK.corpus_totals(spark, path)
    true = AN.distinct_authors(p).scalar()
    ranks = [p.agg((F.count_if(F.col(c) < t.select(m).scalar()) / F.count(F.lit(1))).alias("r")).scalar()
             for c, m in (("text_length", "median_text_length"), ("word_count", "median_word_count"))]
    ends = [p.agg((F.count_if(F.col(c) <= t.select(m).scalar()) / F.count(F.lit(1))).alias("r")).scalar()
            for c, m in (("text_length", "median_text_length"), ("word_count", "median_word_count"))]
    near = F.lit(True)
    for lo, hi in zip(ranks, ends):
        near = near & (lo <= 0.52) & (hi >= 0.48)
    return t.select("total_papers", F.round("avg_text_length", 6).alias("avg_text_length"),
                    F.round("avg_word_count", 6).alias("avg_word_count"), "earliest", "latest",
                    (F.abs(F.col("unique_authors") - true) <= 0.05 * true).alias("authors_within_5_percent"),
                    near.alias("medians_within_2_percent"))


@register("arrival_categories", WP + CAT_DIST)
def arrival_categories(spark, sf_dir):
    """Category counts merged from two arrivals."""
    path = scratch_path(spark, f"arrivals-{uuid.uuid4().hex}")
    p = papers(spark, sf_dir)
    for part in (0, 1):
        SK.record_arrival(p.where(F.pmod(F.xxhash64("id"), F.lit(2)) == part), path, str(part))
    return SK.category_totals(spark, path)


@register("describe_sketched", """WITH v AS (SELECT value AS x FROM events WHERE value IS NOT NULL)
SELECT 'value' AS "column", p AS stat, TRUE AS rank_within_2_percent FROM (VALUES ('25%'), ('50%'), ('75%')) AS q(p)
WHERE (SELECT count(*) FROM v) > 0""")
def describe_sketched(spark, sf_dir):
    """KLL quartiles of a continuous column: is the share of values below each within 0.02
    of its own?"""
    v = A.table(spark, sf_dir, "events").where(F.col("value").isNotNull()).select("value")
    d = materialize(SK.describe_sketched(v, ["value"]), "described").where(F.col("stat").endswith("%"))
    n = F.count(F.lit(1))
    out = None
    for s, p in (("25%", 0.25), ("50%", 0.5), ("75%", 0.75)):
        x = d.where(F.col("stat") == s).select("value").scalar()
        one = v.agg((F.count_if(F.col("value") < x) / n).alias("lo"), (F.count_if(F.col("value") <= x) / n).alias("hi")) \
            .select(F.lit("value").alias("column"), F.lit(s).alias("stat"),
                    ((F.col("lo") <= p + 0.02) & (F.col("hi") >= p - 0.02)).alias("rank_within_2_percent"))
        out = one if out is None else out.unionByName(one)
    return out
