"""File digests from ranges: independent of the cuts, quick digest as defined."""

import hashlib
import random

import pytest

from papyra.sources import digests as D
from papyra.sources import files as S


def quick(data, edge):
    tail = data[-edge:] if len(data) > 2 * edge else b""
    return hashlib.md5(data[:edge] + tail + str(len(data)).encode()).hexdigest()


def whole(data):
    lines, value = data.split(b"\n"), 0
    if lines[-1] == b"":
        lines.pop()
    for line in lines:
        value = D.fold(value, line)
    return len(lines), hashlib.md5(b"%d:%d:" % (len(data), len(lines)) + value.to_bytes(16, "big")).hexdigest()


@pytest.mark.parametrize("size", ["700", "100000"])
def test_digests_do_not_depend_on_ranges(spark, tmp_path, size):
    rng = random.Random(4)
    files = {"empty": b"", "one": b"x", "line": b"x\n", "blank": b"\n\n\n", "crlf": b"a\r\nb\r\nc",
             "bytes": bytes(rng.randrange(256) for _ in range(5000)), "long": b"y" * 9000 + b"\n" + b"z" * 1500,
             "text": "\n".join("é" * rng.randrange(90) for _ in range(300)).encode(),
             "edge": b"q" * 1999 + b"\n", "over": b"q\n" * 1001}
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    old = [spark.conf.get(n) for n in names]
    try:
        for n, v in zip(names, (size, "1")):
            spark.conf.set(n, v)
        got = {r.path.rsplit("/", 1)[1]: r for r in D.file_digests(spark, [str(tmp_path / n) for n in files], edge=1000).collect()}
    finally:
        for n, v in zip(names, old):
            spark.conf.set(n, v)
    assert set(got) == set(files)
    for name, data in files.items():
        r = got[name]
        assert (r.length, r.lines, r.digest) == (len(data), *whole(data)), name
        assert r.quick_digest == quick(data, 1000), name
    assert len({r.digest for r in got.values()}) == len(files)


def test_large_files_take_the_range_digest(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(S, "WHOLE_BYTES", 10)
    (tmp_path / "a").write_bytes(b"hello")
    (tmp_path / "b").write_bytes(b"hello\nworld\n")
    got = {r.path.rsplit("/", 1)[1]: r.digest for r in S.file_digests(spark, str(tmp_path)).collect()}
    assert got == {"a": hashlib.md5(b"hello").hexdigest(), "b": "lines:" + whole(b"hello\nworld\n")[1]}


def test_small_ranges_share_tasks(spark, tmp_path):
    (tmp_path / "a.txt").write_text("".join(f"line {i}\n" for i in range(20_000)))
    path = [str(tmp_path / "a.txt")]
    whole = D.file_digests(spark, path).collect()
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = [spark.conf.get(n) for n in names]
    try:
        for n in names:
            spark.conf.set(n, "256")
        found = D.ranges(spark, path)
        tasks, n = found.rdd.getNumPartitions(), found.count()
        cut = D.file_digests(spark, path, found=found).collect()
    finally:
        for k, v in zip(names, before):
            spark.conf.set(k, v)
    assert cut == whole and n > 200 and tasks <= 4 * spark.sparkContext.defaultParallelism
