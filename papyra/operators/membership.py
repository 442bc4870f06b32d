"""A key table that answers "which of these ids are known" without scanning it.

Keys are stored in buckets by the hash of their id (``bucket=<n>`` folders). Every
write adds, beside the keys, one Bloom filter row for each bucket it touches. A lookup
reads the filters of its own buckets, tests its ids there, and then opens only the
buckets for which some id may be known: a batch of new ids reads no key at all, up to
the filters' false hits (about one in a hundred ids).

The number of buckets is fixed when the table is created (``BUCKET_KEYS`` keys each).
``compact`` rewrites the table with one filter a bucket and buckets for its new size.
Null ids are never known.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papyra.session import materialize, path_exists

BUCKET_KEYS, LEAST_BUCKETS = 1_000_000, 32
BITS_PER_KEY, HASHES = 10, 4


def _hashed(df: DataFrame, buckets: int) -> DataFrame:
    h = F.xxhash64("id")
    return df.withColumns({"_h1": h, "_h2": F.xxhash64("id", F.lit(11)), "bucket": F.pmod(h, F.lit(buckets)).cast("int")})


def _places(h1: np.ndarray, h2: np.ndarray, bits: int) -> np.ndarray:
    a, b = h1.view(np.uint64), h2.view(np.uint64) | np.uint64(1)
    return np.stack([(a + np.uint64(j) * b) % np.uint64(bits) for j in range(HASHES)]).astype(np.int64)


def bloom(h1: np.ndarray, h2: np.ndarray) -> bytes:
    """Bits of a filter over the keys."""
    bits = np.zeros(max(1024, 1 << (BITS_PER_KEY * len(h1) - 1).bit_length()), bool)
    bits[_places(h1, h2, len(bits)).ravel()] = True
    return np.packbits(bits, bitorder="little").tobytes()


def may_hold(filters: list[bytes], h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    out = np.zeros(len(h1), bool)
    for f in filters:
        data = np.frombuffer(f, np.uint8)
        at = _places(h1, h2, 8 * len(data))
        out |= ((data[at >> 3] >> (at & 7).astype(np.uint8)) & 1).all(axis=0)
    return out


class KeyTable:
    """Rows with an ``id`` and any other columns, under ``path``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def exists(self) -> bool:
        return path_exists(self.spark, f"{self.path}/settings")

    def create(self, expected: int = 0) -> None:
        buckets = max(LEAST_BUCKETS, -(-expected // BUCKET_KEYS))
        self.spark.createDataFrame([(buckets,)], "buckets int").write.mode("overwrite").parquet(f"{self.path}/settings")

    @property
    def buckets(self) -> int:
        return self.spark.read.parquet(f"{self.path}/settings").first()["buckets"]

    def _read(self, part: str, buckets: list[int]) -> DataFrame | None:
        """Only the folders of ``buckets`` are listed and read."""
        root = f"{self.path}/{part}"
        found = [f"{root}/bucket={b}" for b in buckets if path_exists(self.spark, f"{root}/bucket={b}")]
        return self.spark.read.option("basePath", root).parquet(*found) if found else None

    def add(self, rows: DataFrame) -> None:
        """Append ``rows``; the caller has made sure that they are not there yet."""
        keys = materialize(_hashed(rows.where(F.col("id").isNotNull()), self.buckets), "new-keys")

        def build(key, t):
            import pyarrow as pa
            bits = bloom(t.column("_h1").to_numpy(), t.column("_h2").to_numpy())
            return pa.table([pa.array([key[0].as_py()], pa.int32()), pa.array([t.num_rows], pa.int64()), pa.array([bits], pa.binary())],
                            names=["bucket", "n", "bits"])
        filters = keys.select("bucket", "_h1", "_h2").groupBy("bucket").applyInArrow(build, "bucket int, n long, bits binary")
        # filters first: a key without a filter would be overlooked, a filter without keys costs a read
        filters.write.mode("append").partitionBy("bucket").parquet(f"{self.path}/filters")
        keys.drop("_h1", "_h2").repartition("bucket").write.mode("append").partitionBy("bucket").parquet(f"{self.path}/keys")

    def reachable(self, ids: DataFrame) -> list[int]:
        """Buckets that may hold one of ``ids``."""
        mine = materialize(_hashed(ids.select("id").where(F.col("id").isNotNull()).distinct(), self.buckets), "looked-up")
        filters = self._read("filters", [r.bucket for r in mine.select("bucket").distinct().collect()])
        if filters is None:
            return []

        def test(key, a, f):
            import pyarrow as pa
            hit = f.num_rows and a.num_rows and may_hold(f.column("bits").to_pylist(), a.column("_h1").to_numpy(),
                                                         a.column("_h2").to_numpy()).any()
            return pa.table([pa.array([key[0].as_py()] if hit else [], pa.int32())], names=["bucket"])
        pairs = mine.select("bucket", "_h1", "_h2").groupBy("bucket").cogroup(
            filters.select(F.col("bucket").cast("int").alias("bucket"), "bits").groupBy("bucket"))
        return sorted(r.bucket for r in pairs.applyInArrow(test, "bucket int").collect())

    def lookup(self, ids: DataFrame) -> DataFrame | None:
        """The stored rows of ``ids``; None when no bucket can hold any."""
        if not self.exists():
            return None
        keys = self._read("keys", self.reachable(ids))
        return None if keys is None else keys.drop("bucket").join(ids.select("id").distinct(), "id", "left_semi")

    def all(self) -> DataFrame | None:
        root = f"{self.path}/keys"
        return self.spark.read.parquet(root).drop("bucket") if path_exists(self.spark, root) else None

    def compact(self, to: str) -> KeyTable:
        """The table written anew to ``to``: one filter and few files a bucket."""
        rows, out = self.all(), KeyTable(self.spark, to)
        if out.exists():
            raise ValueError(f"{to} holds a key table")
        out.create(0 if rows is None else rows.count())
        if rows is not None:
            out.add(rows)
        return out


def mark(spark: SparkSession, path: str) -> bool:
    """Leave a marker folder; was it there?"""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    there = fs.exists(p)
    fs.mkdirs(p)
    return there
