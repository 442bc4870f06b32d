"""Document clean-up pipeline: five stages over ``documents``.

Each stage takes ``(spark, docs, sf_dir)`` and works on all rows that the stage
before has kept; its result is written as Parquet and read again. All but the
last return the columns of ``documents``; the last adds the place in the mix.
Null texts count as empty, repeated rows are ordinary rows until the SimHash
stage keeps one of each group, and an empty table passes through empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from papyra.llm import decontaminate, line_runs, mixing, simhash, toxicity
from papyra.llm.common import Staged, read_table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose predicted label is 0, by a classifier fitted on the labels."""
    return toxicity.drop_toxic(docs, toxicity.fit(docs, read_table(spark, sf_dir, "labels")))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of runs of two lines or more, or of a line of 50 words or more, go
    from the texts; all rows stay."""
    return line_runs.dedup_lines(docs, min_lines=2, min_words=50)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each SimHash group, the one with the smallest id."""
    return simhash.keep_one(docs, shingle=3, max_bits=2)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without a benchmark item."""
    return decontaminate.drop_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows with block, in_block, release, deadline and slot."""
    return mixing.mix(docs, power=0.5, block_rows=16)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("simhash", keep_one_of_near_copies),
    ("decontamination", drop_benchmark_leaks),
    ("mixing", mix_sources),
]
ORACLE_SQL = None       # fitted models and hashing loops; tests/llm holds the brute-force version


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order; a stage's table is deleted once the next is written."""
    docs, last = read_table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        table = Staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if last:
            last.drop()
        docs, last = table.df, table
    return docs
