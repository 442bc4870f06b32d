"""Registry of named queries: ``name -> (spark builder, DuckDB oracle SQL)``.

A builder takes ``(spark, sf_dir)`` and returns a DataFrame over the driver
tables (or tables Spark derives from them). The SQL is the same query for
DuckDB over the same parquet files; ``None`` means a rows-only check.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Builder = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, tuple[Builder, str | None]] = {}


def _bigint_count_if(sql: str) -> str:
    """DuckDB's ``count_if`` returns a 128-bit integer; cast it to BIGINT so
    the oracle's column types equal Spark's ``count_if`` (bigint)."""
    out, i, key = [], 0, "count_if("
    while True:
        j = sql.find(key, i)
        if j < 0:
            out.append(sql[i:])
            return "".join(out)
        depth, k = 0, j + len(key) - 1
        while True:
            if sql[k] == "(":
                depth += 1
            elif sql[k] == ")":
                depth -= 1
                if depth == 0:
                    break
            k += 1
        out.append(sql[i:j])
        inner = sql[j + len(key):k]            # argument text between the parentheses
        out.append("CAST(count_if(" + _bigint_count_if(inner) + ") AS BIGINT)")
        i = k + 1


def register(name: str, sql: str | None = None):
    def deco(fn: Builder) -> Builder:
        prev = REGISTRY.get(name)
        if prev is not None and prev[0].__module__ != fn.__module__:
            raise ValueError(f"query {name} registered by two modules")
        REGISTRY[name] = (fn, _bigint_count_if(sql) if sql else sql)   # re-import re-registers
        return fn
    return deco


def load_all() -> dict[str, tuple[Builder, str | None]]:
    # importing the modules fills REGISTRY
    from papyra.plans import (q_ingest, q_corpus, q_vectors, q_search,  # noqa: F401
                              q_results, q_format, q_io, q_more)
    return REGISTRY
