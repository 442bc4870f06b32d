"""Declared schemas (never inferred)."""

from __future__ import annotations

from pyspark.sql import types as T

CORRUPT_COL = "_bad"

RAW = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("abstract", T.StringType()),
    T.StructField("categories", T.StringType()),
    T.StructField("authors", T.StringType()),
    T.StructField("authors_parsed", T.ArrayType(T.ArrayType(T.StringType()))),
    T.StructField("update_date", T.StringType()),
    T.StructField("submitter", T.StringType()),
    T.StructField("doi", T.StringType()),
    T.StructField("journal-ref", T.StringType()),
])

RAW_WITH_CORRUPT = T.StructType(RAW.fields + [T.StructField(CORRUPT_COL, T.StringType())])
