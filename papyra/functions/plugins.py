"""Extension points: a model encoder, a pair scorer and a summariser.

Each wraps a user function in an Arrow-batched pandas UDF, so the model is
loaded once per Python worker and sees whole batches (the reference's batches
of 32 become Arrow batches, sized by
``spark.sql.execution.arrow.maxRecordsPerBatch``). Nothing here is needed by
the built-in defaults, which are pure column expressions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_MODELS: dict = {}


def _load(key, factory):
    """One model instance per Python worker process."""
    if key not in _MODELS:
        _MODELS[key] = factory()
    return _MODELS[key]


def encoder(factory: Callable[[], Callable[[list[str]], np.ndarray]], name: str,
            normalize: bool = True) -> Callable[[DataFrame, str], DataFrame]:
    """``factory()`` returns ``encode(texts) -> (n, dim) array``. The result
    appends ``vec`` (unit length when ``normalize``; blank text -> zeros)."""
    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def enc(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = _load(("enc", name), factory)
        for texts in batches:
            t = texts.fillna("").astype(str)
            blank = t.str.strip() == ""
            out = np.asarray(model(t.tolist()), dtype=np.float64)
            if normalize:
                n = np.linalg.norm(out, axis=1, keepdims=True)
                out = np.divide(out, n, out=np.zeros_like(out), where=n > 0)
            out[blank.to_numpy()] = 0.0
            yield pd.Series(list(out))

    def apply(df: DataFrame, text_col: str) -> DataFrame:
        return df.withColumn("vec", enc(F.col(text_col)))
    return apply


def pair_scorer(factory: Callable[[], Callable[[list[str], list[str]], np.ndarray]],
                name: str) -> Callable[[Column, Column], Column]:
    """``factory()`` returns ``score(queries, texts) -> array``; usable as
    ``SearchOptions(scorer=...)``."""
    @F.pandas_udf(T.DoubleType())
    def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = _load(("pair", name), factory)
        for q, t in batches:
            yield pd.Series(np.asarray(model(q.fillna("").tolist(), t.fillna("").tolist()), dtype=np.float64))

    return lambda query, text: F.round(score(query, text), 6)


def summarizer(factory: Callable[[], Callable[[list[str], list[str]], list[str | None]]],
               name: str) -> Callable[[DataFrame], DataFrame]:
    """``factory()`` returns ``summarise(titles, abstracts) -> summaries``
    (None = failed). Failed rows fall back to the rule-based summary."""
    from papyra.functions import text as TX

    @F.pandas_udf(T.StringType())
    def summ(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = _load(("sum", name), factory)
        for ti, ab in batches:
            yield pd.Series(model(ti.fillna("").tolist(), ab.fillna("").tolist()), dtype=object)

    def apply(df: DataFrame) -> DataFrame:
        s = summ(F.col("title"), F.col("abstract"))
        return df.withColumn("summary", F.coalesce(F.nullif(s, F.lit("")), TX.rule_summary("abstract")))
    return apply
