import pytest


DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs_of(spark):
    """documents rows from (doc_id, text) pairs, with columns whose names clash
    with outputs and internals."""
    def make(pairs, partitions=3, extra=True):
        rows = [(i, t, None if i is None or i % 3 else "en", f"src{(i or 0) % 3}", None) for i, t in pairs]
        df = spark.createDataFrame(rows, DOCS).repartition(partitions)
        if extra:
            from pyspark.sql import functions as F
            for c in ("d", "k", "score", "spans", "fingerprint", "line", "block", "n_words"):
                df = df.withColumn(c, F.lit("clash"))
        return df
    return make
