"""Digests of files of any size, worked out in tasks.

A file is read as lines, which Spark splits at any byte. Each range gives one short row:
its lines and bytes, and the value of its lines' hashes as a polynomial; values of
neighbouring ranges combine (``v1 * R ** lines2 + v2``), so the digest of a file is that of
its lines in order, wherever the ranges were cut, and no content leaves the tasks. Beside
it comes the quick digest for change detection: MD5 of the first MiB, of the last MiB of
files beyond two, and of the size as text; a range passes on those bytes only if it
touches them.

Bytes are taken as they are, text or not; a line must fit a row (2 GiB). The digest is 128
bits wide and not meant against forged files.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papyra.session import packed

EDGE = 1 << 20
PRIME, BASE = (1 << 127) - 1, 0x9E3779B97F4A7C15F39CC0605CEDC835
RANGES = "path string, at long, size long, lines long, bytes long, value binary, head binary, tail binary"
FILES = "path string, length long, lines long, digest string, quick_digest string"


def fold(value: int, line: bytes) -> int:
    return (value * BASE + int.from_bytes(hashlib.md5(line).digest(), "big")) % PRIME


class _Range:
    def __init__(self, key, edge: int):
        self.edge = edge
        self.path, self.at, self.size, self.nominal_end = key
        self.lines = self.bytes = self.value = self.last = 0
        self.head, self.tail = bytearray(), bytearray()

    def add(self, line: bytes) -> None:
        self.lines += 1
        self.bytes += len(line) + 1
        self.value = fold(self.value, line)
        if self.at < self.edge and len(self.head) < self.edge:
            self.head += line[:self.edge] + b"\n"
        if self.size > 2 * self.edge:
            self.last = len(line)
            self.tail += line[-self.edge - 1:] + b"\n"
            if len(self.tail) > 4 * self.edge:
                del self.tail[:-self.edge - 1]

    def row(self):
        # a range runs over its end by its last line at most
        if self.nominal_end + self.last + self.edge + 1 < self.size:
            self.tail.clear()
        return (self.path, self.at, self.size, self.lines, self.bytes, self.value.to_bytes(16, "big"),
                bytes(self.head[:self.edge]), bytes(self.tail[-self.edge - 1:]))


def ranges(spark: SparkSession, paths: list[str], edge: int = EDGE) -> DataFrame:
    meta = F.col("_metadata")
    lines = packed(spark.read.option("lineSep", "\n").text(paths).select(
        meta["file_path"].alias("path"), meta["file_block_start"].alias("at"), meta["file_size"].alias("size"),
        (meta["file_block_start"] + meta["file_block_length"]).alias("end"), F.col("value").cast("binary").alias("t")))

    def run(batches):
        import pyarrow as pa

        kinds = (pa.string(), *[pa.int64()] * 4, pa.binary(), pa.binary(), pa.binary())
        names = [c.split()[0] for c in RANGES.split(", ")]
        now, key = None, None
        for b in batches:
            for *k, line in zip(*(c.to_pylist() for c in b.columns)):
                if k != key:
                    if now:
                        yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(now.row(), kinds)], names=names)
                    key, now = k, _Range(k, edge)
                now.add(line)
        if now:
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(now.row(), kinds)], names=names)
    return lines.mapInArrow(run, RANGES)


def combined(size: int, rows, edge: int = EDGE) -> tuple[int, str, str]:
    """(lines, digest, quick digest) of a file from its ranges' rows in order."""
    lines, total, value, head, tail = 0, 0, 0, b"", b""
    for r in rows:
        value = (value * pow(BASE, r["lines"], PRIME) + int.from_bytes(r["value"], "big")) % PRIME
        lines, total = lines + r["lines"], total + r["bytes"]
        head = (head + r["head"])[:edge] if len(head) < edge else head
        tail = (tail + r["tail"])[-edge - 1:] if r["tail"] else tail
    tail = tail[:-1] if total > size else tail          # the last line has no line feed
    quick = hashlib.md5(head[:min(edge, size)] + (tail[-edge:] if size > 2 * edge else b"") + str(size).encode())
    digest = hashlib.md5(b"%d:%d:" % (size, lines) + value.to_bytes(16, "big")).hexdigest()
    return lines, digest, quick.hexdigest()


def file_digests(spark: SparkSession, paths: list[str], edge: int = EDGE, found: DataFrame | None = None) -> DataFrame:
    """``FILES`` of the given files; a file's group is a short row a range. ``found``
    passes their ``ranges``, if they have been worked out before."""
    if not paths:
        return spark.createDataFrame([], FILES)

    def join(key, t):
        import pyarrow as pa

        t = t.sort_by("at")
        size = t.column("size")[0].as_py()
        rows = (r for b in t.to_batches(max_chunksize=4096) for r in b.to_pylist())
        lines, digest, quick = combined(size, rows, edge)
        return pa.table([pa.array([x], k) for x, k in zip((key[0].as_py(), size, lines, digest, quick),
                                                          (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()))],
                        names=[c.split()[0] for c in FILES.split(", ")])
    found = ranges(spark, paths, edge) if found is None else found
    out = found.groupBy("path").applyInArrow(join, FILES)
    # files without a line have no range
    _, digest, quick = combined(0, [])
    empty = [(p, 0, 0, digest, quick) for p in map(str, paths) if _length(spark, p) == 0]
    return out.unionByName(spark.createDataFrame(empty, FILES)) if empty else out


def _length(spark: SparkSession, path: str) -> int:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).getLen()
