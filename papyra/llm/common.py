"""Pieces shared by the operators: row keys, staged tables, flat text views.

Rows are identified by ``(d, k)``: ``d`` is ``doc_id`` (null becomes the
smallest long, so a null id sorts first) and ``k`` a 64-bit hash of id and
text. Rows that repeat share the key and get the same result; rows that share
an id but not the text stay apart.
"""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from papyra.session import delete_path, ensure_checkpoint_dir

NULL_ID = -(1 << 63)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def row_key(doc_id: str = "doc_id", text: str = "text") -> list[Column]:
    """Columns ``d`` and ``k`` of a row."""
    return [F.coalesce(F.col(doc_id).cast("long"), F.lit(NULL_ID)).alias("d"),
            F.xxhash64(F.col(doc_id), F.col(text)).alias("k")]


def real_id(col: str = "d") -> Column:
    return F.when(F.col(col) != NULL_ID, F.col(col))


class Staged:
    """A table written to the shared checkpoint folder and read back: later
    jobs start from the files, so a lost executor costs no recomputation."""

    def __init__(self, df: DataFrame, tag: str):
        self.spark = df.sparkSession
        self.path = f"{ensure_checkpoint_dir(self.spark).rstrip('/')}/papyra-{tag}-{uuid.uuid4().hex}"
        df.write.parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        """Delete the files; only when nothing reads them any more."""
        delete_path(self.spark, self.path)


# ---- flat text views inside tasks -------------------------------------------

def utf8_view(arr) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column of an Arrow batch, and each row's offsets
    (nulls are empty)."""
    import pyarrow as pa

    if pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type):
        kind = np.int64
    elif pa.types.is_string(arr.type) or pa.types.is_binary(arr.type):
        kind = np.int32
    else:
        arr, kind = arr.cast(pa.string()), np.int32
    if arr.null_count:
        import pyarrow.compute as pc
        arr = pc.fill_null(arr, b"" if pa.types.is_binary(arr.type) else "")
    bufs = arr.buffers()
    off = np.frombuffer(bufs[1], kind)[arr.offset:arr.offset + len(arr) + 1].astype(np.int64) \
        if len(arr) else np.zeros(1, np.int64)
    data = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None else np.zeros(0, np.uint8)
    return data[off[0]:off[-1]], off - off[0]


def row_blocks(off: np.ndarray, limit: int):
    """Ranges of rows of at most ``limit`` bytes together (one row at least)."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
        yield i, j
        i = j


_MULT = np.uint64(0x9E3779B97F4A7C15 | 1)
_POW: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd multiplier and of its inverse modulo 2**64."""
    if len(_POW[0]) < n:
        size = 1 << (n - 1).bit_length()
        inverse = pow(int(_MULT), -1, 1 << 64)
        for i, base in enumerate((int(_MULT), inverse)):
            a = np.full(size, base, np.uint64)
            a[0] = 1
            _POW[i] = np.multiply.accumulate(a)
    return _POW[0], _POW[1]


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


class Rolling:
    """Polynomial hashes of any substring of a symbol array (modulo 2**64)."""

    def __init__(self, symbols: np.ndarray):
        n = len(symbols)
        pw, self.inv = powers(n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum((symbols.astype(np.uint64) + np.uint64(1)) * pw[:n], out=self.sums[1:])

    def grams(self, k: int) -> np.ndarray:
        n = len(self.sums) - k
        return mix((self.sums[k:] - self.sums[:n]) * self.inv[:n])

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        x = (self.sums[end] - self.sums[start]) * self.inv[start]
        return mix(x ^ ((end - start).astype(np.uint64) * np.uint64(0xA24BAED4963EE407)))


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each ``w`` consecutive values."""
    span = 1
    while span * 2 <= w:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    if span < w:
        x = np.minimum(x[:len(x) - (w - span)], x[w - span:])
    return x


def word_spans(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end bytes of the words ``[^\\x20\\x09-\\x0D]+`` of all rows;
    words end at row boundaries."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    solid = (data != 32) & ((data < 9) | (data > 13))
    first = np.zeros(n + 1, bool)
    first[off] = True
    edge = np.empty(n + 1, bool)
    edge[0] = edge[n] = True
    edge[1:n] = ~solid[:-1]
    starts = np.flatnonzero(solid & (edge[:n] | first[:n]))
    edge[:n - 1] = ~solid[1:]
    edge[n - 1] = True
    ends = np.flatnonzero(solid & (edge[:n] | first[1:])) + 1
    return starts, ends


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, block: int = 1 << 21) -> np.ndarray:
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + block, "right")))
        base = starts[i]
        out[i:j] = Rolling(data[base:ends[j - 1]]).spans(starts[i:j] - base, ends[i:j] - base)
        i = j
    return out
