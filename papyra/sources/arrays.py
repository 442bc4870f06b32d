"""JSON-array files read by several tasks each.

Spark reads an array file with ``multiLine`` as one record stream of one task. Here the
file is read as text that ends at each ``}``, which Spark splits at any byte, so a large
file is many ranges. Whether a quote opens or closes a string, and how deep a bracket is,
depends on everything before it; so there are two passes. The first finds, for each
range and for both cases (the range begins inside a string or not), the change of depth,
the number of records that end and the case it leaves behind: one short row a range,
put together in the order of the ranges. The second knows each range's true start,
cuts out the records, and passes on the pieces at its two ends; the pieces of a record that
crosses ranges are joined by its number, whatever its length.

Records are the objects at depth one; they are parsed with the declared schema, and one
that does not fit is kept in ``_bad``. Elements that are no objects are not
records. An escape cannot stand before a range's start, as ``\\}`` is no JSON escape.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papyra.schemas import CORRUPT_COL, RAW_WITH_CORRUPT
from papyra.session import materialize, packed

CHUNK = 4 << 20
END = "}"
RANGE = "file string, at long, "


def _structure(data: np.ndarray, inside: bool) -> tuple[np.ndarray, np.ndarray, bool]:
    """Per byte: is it outside strings; the change of depth; does the text end inside one."""
    slash = data == 92
    quotes = np.flatnonzero(data == 34)
    if slash.any() and len(quotes):
        # a quote after an odd run of backslashes is escaped
        last = np.maximum.accumulate(np.where(~slash, np.arange(len(data)), -1))
        before = np.where(quotes > 0, last[np.maximum(quotes - 1, 0)], -1)
        quotes = quotes[(quotes - 1 - before) % 2 == 0]
    flips = np.zeros(len(data) + 1, np.int8)
    flips[quotes + 1] = 1
    closed = ((np.cumsum(flips[:-1], dtype=np.int64) + inside) % 2) == 0
    step = np.zeros(len(data), np.int64)
    step[(data == 123) | (data == 91)] = 1
    step[(data == 125) | (data == 93)] = -1
    step[~closed] = 0
    return closed, step, (len(quotes) + inside) % 2 == 1


class Scanner:
    """Follows one range from a known start."""

    def __init__(self, inside: bool, depth: int):
        self.inside, self.depth, self.ended = inside, depth, 0
        self.open = depth >= 2          # within a record
        self.text: list[bytes] = []

    def feed(self, data: bytes, keep: bool) -> list[bytes]:
        """Records that end in ``data`` (text since their start if ``keep``)."""
        raw = np.frombuffer(data, np.uint8)
        closed, step, inside = _structure(raw, self.inside)
        depth = self.depth + np.cumsum(step)
        ends = np.flatnonzero((raw == 125) & closed & (depth == 1) & (step == -1))
        starts = np.flatnonzero((raw == 123) & closed & (depth == 2) & (step == 1))
        self.inside, self.depth = inside, int(depth[-1]) if len(depth) else self.depth
        self.ended += len(ends)
        if not keep:
            return []
        out, at = [], 0
        marks = iter(starts.tolist())
        for end in ends.tolist():
            begin = 0 if self.open else next(marks)
            out.append(b"".join([*self.text, data[begin:end + 1]]))
            self.text, self.open, at = [], False, end + 1
        begin = 0 if self.open else next((s for s in marks if s >= at), None)
        if begin is not None:
            self.text.append(data[begin:])
            self.open = True
        return out


def _ranges(batches):
    """((file, range start), text) pieces of bounded size, in order."""
    key, held, size = None, [], 0
    for b in batches:
        for file, at, text in zip(*(c.to_pylist() for c in b.columns)):
            if (file, at) != key or size > CHUNK:
                if held:
                    yield key, b"".join(held)
                key, held, size = (file, at), [], 0
            held += [text, b"}"]
            size += len(text) + 1
    if held:
        yield key, b"".join(held)


def segments(spark: SparkSession, paths: list[str]) -> DataFrame:
    meta = F.col("_metadata")
    return packed(spark.read.option("lineSep", END).text(paths).select(
        meta["file_path"].alias("file"), meta["file_block_start"].alias("at"), F.col("value").cast("binary").alias("t")))


def summaries(segs: DataFrame) -> DataFrame:
    """(file, at, outside, inside): for both starts (ends inside a string, change of depth)."""
    def run(batches):
        import pyarrow as pa

        names = ["file", "at", "ends0", "depth0", "ends1", "depth1"]
        kinds = (pa.string(), pa.int64(), pa.bool_(), pa.int64(), pa.bool_(), pa.int64())
        key, both, rows = None, None, []
        for k, data in _ranges(batches):
            if k != key:
                if key:
                    rows.append((*key, *(x for s in both for x in (s.inside, s.depth))))
                key, both = k, (Scanner(False, 0), Scanner(True, 0))
            for s in both:
                s.feed(data, False)
        if key:
            rows.append((*key, *(x for s in both for x in (s.inside, s.depth))))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)
    return segs.mapInArrow(run, RANGE + "ends0 boolean, depth0 long, ends1 boolean, depth1 long")


def starts(found: DataFrame) -> tuple[dict[tuple[str, int], tuple[bool, int]], set[str]]:
    """True start of each range: (inside a string, depth), a row a range (128 MB); and
    the files whose brackets do not balance."""
    out, ends, inside, depth = {}, {}, False, 0
    for r in found.orderBy("file", "at").collect():
        if r.file not in ends:
            inside, depth = False, 0
        out[r.file, r.at] = (inside, depth)
        inside, depth = (r.ends1, depth + r.depth1) if inside else (r.ends0, depth + r.depth0)
        ends[r.file] = (inside, depth)
    # the reader's last text gets a closing brace that the file does not have
    return out, {f for f, end in ends.items() if end != (False, -1)}


def records(spark: SparkSession, paths: list[str]) -> tuple[DataFrame, set[str]]:
    """(file, value): the text of every record of the array files; and the files that are
    left out because their brackets do not balance."""
    segs = segments(spark, paths)
    known, broken = starts(summaries(segs))
    if broken:
        segs = segs.where(~F.col("file").isin(sorted(broken)))

    def run(batches):
        import pyarrow as pa

        def out(rows):
            kinds = (pa.string(), pa.int64(), pa.string(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)],
                                              names=["file", "at", "part", "value"])
        key, scan, head = None, None, False
        for k, data in _ranges(batches):
            rows = []
            if k != key:
                if key and scan.open:
                    rows.append((*key, "through" if head else "tail", b"".join(scan.text)))
                key, scan = k, Scanner(*known[k])
                head = scan.open
            for text in scan.feed(data, True):
                rows.append((*key, "head" if head else "whole", text))
                head = False
            if rows:
                yield out(rows)
        if key and scan.open:
            yield out([(*key, "through" if head else "tail", b"".join(scan.text))])
    found = materialize(segs.mapInArrow(run, RANGE + "part string, value binary"), "array-records")
    whole = found.where("part = 'whole'").select("file", F.col("value").cast("string").alias("value"))
    # pieces at range ends: a record is a tail, any ranges it runs through, and a head
    ends = found.where("part <> 'whole'")
    marks = sorted((r.file, r.at, r.part == "tail") for r in ends.select("file", "at", "part").collect())    # two a range at most
    number, at = {}, 0
    for file, a, tail in sorted(marks, key=lambda m: (m[0], m[1], m[2])):       # a range's head comes before its tail
        at += tail
        number[file, a, tail] = at
    if not number:
        return whole, broken
    table = spark.createDataFrame([(f, a, t, n) for (f, a, t), n in number.items()], "file string, at long, tail boolean, n long")
    joined = ends.withColumn("tail", F.col("part") == "tail").join(F.broadcast(table), ["file", "at", "tail"]) \
        .groupBy("file", "n").agg(F.array_sort(F.collect_list(F.struct("at", "value"))).alias("p"))
    text = F.aggregate("p", F.lit(b"").cast("binary"), lambda acc, x: F.concat(acc, x["value"]))
    return whole.unionByName(joined.select("file", text.cast("string").alias("value"))), broken


def read_arrays(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Raw paper records + ``_bad`` of JSON-array files. Files without balanced brackets
    are left to Spark's own reader, which marks them as bad."""
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT_COL}
    texts, broken = records(spark, paths)
    out = texts.select(F.from_json("value", RAW_WITH_CORRUPT, options).alias("r")).select("r.*")
    if broken:
        whole = spark.read.schema(RAW_WITH_CORRUPT).options(**options).option("multiLine", True)
        out = out.unionByName(whole.json(sorted(broken)))
    return out
