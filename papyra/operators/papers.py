"""Ingest: filter and project raw paper records into the ``papers`` table.

All filters run on the raw (uncleaned, stripped) fields; the output fields are
cleaned. The language test is a per-row stop-word count over the first 200
characters (no shuffle, no join); cheap predicates are evaluated first.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from papyra.functions import text as T
from papyra.operators.language import Profile, detect
from papyra.schemas import CORRUPT_COL

MIN_ABSTRACT_LENGTH = 50
MAX_ABSTRACT_LENGTH = 2000
LANGUAGE_SAMPLE_CHARS = 200
LANGUAGE_MIN_CHARS = 20

# Stop words per language for the language test (our own lists).
STOPWORDS = {
    "de": ["der", "die", "das", "und", "ist", "nicht", "mit", "von", "den", "dem", "des",
           "ein", "eine", "zu", "auf", "für", "sich", "im", "es", "auch", "als", "wird",
           "werden", "sind", "oder", "bei", "aus"],
    "en": ["the", "and", "of", "to", "in", "is", "that", "for", "with", "as", "on", "by",
           "this", "are", "be", "it", "an", "from", "at", "which", "or", "we", "was",
           "were", "has", "have", "these", "their", "not"],
    "es": ["el", "la", "los", "las", "de", "del", "y", "en", "que", "es", "un", "una",
           "por", "con", "para", "se", "al", "lo", "como", "más", "su", "sus", "no",
           "pero", "son", "este", "esta"],
    "fr": ["le", "la", "les", "des", "du", "de", "et", "en", "un", "une", "est", "que",
           "qui", "dans", "pour", "par", "sur", "au", "aux", "ce", "il", "elle", "pas",
           "ne", "se", "sont", "avec", "plus"],
}
LETTER_SPLIT = r"[^\p{L}]+"

REASONS = ["missing_id", "missing_title", "missing_abstract", "abstract_too_short",
           "abstract_too_long", "not_english", "category_excluded"]


def detect_language(text_col) -> F.Column:
    """Language with most stop-word hits in the first 200 characters
    (ties -> alphabetical); null when there is no hit.

    One pass over the tokens counts hits for every language at once; the
    finishing lambda picks the first maximum, so nothing is evaluated twice.
    """
    tokens = F.split(F.lower(F.left(text_col, F.lit(LANGUAGE_SAMPLE_CHARS))), LETTER_SPLIT)
    langs = sorted(STOPWORDS)
    lists = [F.array(*[F.lit(w) for w in STOPWORDS[lang]]) for lang in langs]
    init = F.array(*[F.lit(0) for _ in langs])

    def count(acc, t):
        return F.array(*[acc[i] + F.when(F.array_contains(lists[i], t), 1).otherwise(0)
                         for i in range(len(langs))])

    def pick(acc):
        best = F.array_max(acc)
        return F.when(best > 0, F.element_at(F.array(*[F.lit(x) for x in langs]),
                                             F.array_position(acc, best).cast("int")))
    return F.aggregate(tokens, init, count, pick)


def is_english(text_col) -> F.Column:
    """Keep English, short (<20 chars stripped) and undetectable texts."""
    stripped = T.strip(F.coalesce(text_col, F.lit("")))
    lang = detect_language(stripped)
    return (F.length(stripped) < LANGUAGE_MIN_CHARS) | (F.coalesce(lang, F.lit("en")) == "en")


def is_language(text_col, code: str, profile: Profile | None = None) -> F.Column:
    """Keep texts of the language, short (<20 chars stripped) and undetectable ones. With
    a ``profile`` the n-gram test decides, else the stop-word vote."""
    if code == "en" and profile is None:
        return is_english(text_col)
    known = sorted(STOPWORDS) if profile is None else sorted(profile.languages)
    if code not in known:
        raise ValueError(f"no test for language {code!r}; known: {', '.join(known)}")
    stripped = T.strip(F.coalesce(text_col, F.lit("")))
    lang = detect_language(stripped) if profile is None else detect(stripped, profile)
    return (F.length(stripped) < LANGUAGE_MIN_CHARS) | (F.coalesce(lang, F.lit(code)) == code)


def with_reject_reason(raw: DataFrame, language: str | None = None,
                       categories: Sequence[str] | None = None, profile: Profile | None = None) -> DataFrame:
    """Add ``reject_reason`` (null = kept): first failing rule, in the
    reference's short-circuit order."""
    abstract = T.strip(F.coalesce(F.col("abstract"), F.lit("")))
    n = F.length(abstract)
    reason = (F.when(T.is_blank("id"), "missing_id")
              .when(T.is_blank("title"), "missing_title")
              .when(abstract == "", "missing_abstract")
              .when(n < MIN_ABSTRACT_LENGTH, "abstract_too_short")
              .when(n > MAX_ABSTRACT_LENGTH, "abstract_too_long"))
    if language is not None:
        reason = reason.when(~is_language(F.col("abstract"), language, profile),
                             "not_english" if language == "en" else "other_language")
    if categories:
        wanted = F.array(*[F.lit(c) for c in categories])
        reason = reason.when(~F.arrays_overlap(T.split_categories("categories"), wanted),
                             "category_excluded")
    return raw.withColumn("reject_reason", reason)


def project(raw: DataFrame) -> DataFrame:
    """The 12-column paper row (cleaned fields, parsed lists and date).

    Two steps: cleaned title/abstract first, then the columns derived from
    them. The optimizer keeps the steps apart (it does not duplicate costly
    expressions that are referenced several times), so each text is cleaned
    once.
    """
    journal = F.col("`journal-ref`") if "journal-ref" in raw.columns else F.lit(None).cast("string")
    extra = ["doc_id"] if "doc_id" in raw.columns else []
    cleaned = raw.select(
        *extra,
        T.strip(F.col("id")).alias("id"),
        T.clean_text("title").alias("title"),
        T.clean_text("abstract").alias("abstract"),
        T.parse_authors("authors_parsed", "authors").alias("authors"),
        T.split_categories("categories").alias("categories"),
        T.parse_date("update_date").alias("update_date"),
        F.col("submitter"), F.col("doi"), journal.alias("journal_ref"),
    )
    combined = cleaned.withColumn("combined_text", F.concat("title", F.lit(". "), "abstract"))
    return combined.select(
        *extra, "id", "title", "abstract", "combined_text", "authors", "categories", "update_date",
        "submitter", "doi", "journal_ref",
        F.length("combined_text").alias("text_length"),
        T.word_count("combined_text").alias("word_count"),
    )


def build_papers(raw: DataFrame, language: str | None = "en",
                 categories: Sequence[str] | None = None, sample_size: int | None = None, order_key: str = "id",
                 profile: Profile | None = None) -> DataFrame:
    """Filter + project. ``profile`` replaces the stop-word vote of the language test
    (``language.fit``). ``sample_size`` keeps the first n raw rows (by
    ``order_key``) before any filter, as the reference's scan limit does."""
    if sample_size is not None:
        raw = raw.orderBy(order_key).limit(sample_size)
    flagged = with_reject_reason(raw, language, categories, profile)
    return project(flagged.filter(F.col("reject_reason").isNull()))


def ingest_counters(raw: DataFrame, language: str | None = "en",
                    categories: Sequence[str] | None = None) -> DataFrame:
    """One row: total, kept, skipped, success % (null on empty input) and a
    count per reject reason."""
    r = F.col("reject_reason")
    flagged = with_reject_reason(raw, language, categories)
    total = F.count(F.lit(1))
    kept = F.count_if(r.isNull())
    return flagged.agg(
        total.alias("total"), kept.alias("kept"), (total - kept).alias("skipped"),
        F.round(F.try_divide(kept * 100.0, total), 6).alias("success_pct"),
        *[F.count_if(r == name).alias(name) for name in REASONS])


def write_papers(raw: DataFrame, path: str, language: str | None = "en", categories: Sequence[str] | None = None) -> dict[str, int]:
    """Write the kept papers as Parquet and return the counters of that same pass:
    malformed (``_bad`` records), total, kept, skipped and each reject reason. The raw
    records are read once."""
    bad = F.col(CORRUPT_COL).isNotNull() if CORRUPT_COL in raw.columns else F.lit(False)
    flagged = with_reject_reason(raw.withColumn("_malformed", bad), language, categories)
    good, r = ~F.col("_malformed"), F.col("reject_reason")
    seen = Observation("ingest")
    counted = flagged.observe(
        seen, F.count_if(F.col("_malformed")).alias("malformed"), F.count_if(good).alias("total"),
        F.count_if(good & r.isNull()).alias("kept"), F.count_if(good & r.isNotNull()).alias("skipped"),
        *[F.count_if(good & (r == name)).alias(name) for name in REASONS])
    project(counted.where(good & r.isNull())).write.mode("overwrite").parquet(path)
    return {k: v or 0 for k, v in seen.get.items()}
