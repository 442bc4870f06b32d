"""Summary cache in the state store: late, equal and repeated entries."""

import json

from papyra.operators import summaries as SU
from papyra.streaming import cachestate as C

NAMES = ("key", "summary", "ts", "title")


def write(folder, name, rows):
    (folder / f"{name}.json").write_text("\n".join(json.dumps(dict(zip(NAMES, r))) for r in rows) + "\n")


def test_newest_entry_of_each_key(spark, tmp_path):
    src, ckpt = tmp_path / "in", str(tmp_path / "ck")
    src.mkdir()
    one = [("a", "s1", "2024-01-02T00:00:00", "t"), ("a", "s0", "2024-01-01T00:00:00", "t"), ("b", "x", None, "u"),
           ("c", "m", "2024-03-01T00:00:00.000001", "v"), (None, "lost", "2024-01-01T00:00:00", "w"), ("e", None, None, None)]
    two = [("a", "late", "2023-12-31T23:59:59", "t"), ("b", "y", "2020-01-01T00:00:00", "u"),
           ("c", "m", "2024-03-01T00:00:00.000001", "v"), ("c", "n", "2024-03-01T00:00:00.000001", "v2"),
           ("c", "l", "2024-03-01T00:00:00.000001", "v3"), ("d", "new", "2024-01-01T00:00:00", "z")] + one[:2]
    for name, rows in (("1", one), ("2", two), ("3", two)):         # the third repeats the second
        write(src, name, rows)
        C.start_cache_state(spark, str(src), ckpt).awaitTermination()
    got = sorted((r.key, r.summary, r.title) for r in C.cache_state(spark, ckpt).collect())
    assert got == [("a", "s1", "t"), ("b", "y", "u"), ("c", "n", "v2"), ("d", "new", "z"), ("e", None, None)]
    log = spark.read.schema(C.ENTRY).json(str(src)).where("key IS NOT NULL")
    best = sorted((r.key, r.summary) for r in SU.latest_per_key(log).collect())
    assert best == [g[:2] for g in got]
