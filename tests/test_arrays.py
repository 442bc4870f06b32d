"""Array files cut into ranges give the records that a whole read gives."""

import json
import random

import numpy as np
import pytest

from papyra.schemas import RAW_WITH_CORRUPT
from papyra.sources import arrays as A
from papyra.sources import files as S

NASTY = ['br{ack}ets [in] "quotes"', "back\\slash\\\\", '\\"}', "}{][", "", "é}ü", 'a\\', '"', "\n}\n{", "x" * 700]


def records(n, seed=0):
    rng = random.Random(seed)
    return [{"id": str(i), "title": "".join(rng.choices(NASTY, k=rng.randint(0, 4))), "abstract": rng.choice(NASTY),
             "authors_parsed": rng.choice([None, [], [["L}", "F{"], ["x", ""]]]),
             "extra": {"deep": [{"a": {"b": "}"}}, 1, "]"]}} for i in range(n)]


def rows(df):
    return sorted(map(repr, df.select(*[f.name for f in RAW_WITH_CORRUPT.fields]).collect()))


@pytest.fixture
def small_ranges(spark):
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    old = [spark.conf.get(n) for n in names]
    for n, v in zip(names, ("700", "1")):
        spark.conf.set(n, v)
    yield
    for n, v in zip(names, old):
        spark.conf.set(n, v)


@pytest.mark.parametrize("indent", [None, 2])
def test_ranges_equal_a_whole_read(spark, tmp_path, small_ranges, indent):
    paths = []
    for k in range(2):
        p = tmp_path / f"{k}.json"
        p.write_text(json.dumps(records(60, k), indent=indent, ensure_ascii=bool(k)) + "\n")
        paths.append(str(p))
    assert A.segments(spark, paths).rdd.getNumPartitions() > 20
    got = A.read_arrays(spark, paths)
    whole = spark.read.schema(RAW_WITH_CORRUPT).option("columnNameOfCorruptRecord", "_bad").option("multiLine", True).json(paths)
    assert got.count() == 120 and rows(got) == rows(whole)


def test_long_record_small_and_empty_files(spark, tmp_path, small_ranges):
    p = tmp_path / "a.json"
    p.write_text(json.dumps([{"id": "1"}, {"id": "2", "abstract": "}" * 9000 + '"{' * 500}, {"id": "3"}]))
    assert sorted((r.id, len(r.abstract or "")) for r in A.read_arrays(spark, [str(p)]).collect()) == \
        [("1", 0), ("2", 10000), ("3", 0)]
    for name, text in (("b", "[]"), ("c", " [ ] \n"), ("d", "")):
        (tmp_path / f"{name}.json").write_text(text)
        assert A.read_arrays(spark, [str(tmp_path / f"{name}.json")]).count() == 0
    (tmp_path / "e.json").write_text('[{"id": "1", "title": [}, {"id": "2"}]')
    both = A.read_arrays(spark, [str(p), str(tmp_path / "e.json")])
    assert S.skipped_records(both).first()["skipped"] == 1 and S.good_records(both).count() == 3


def test_large_arrays_are_found_by_the_reader(spark, tmp_path, small_ranges):
    (tmp_path / "big.json").write_text(json.dumps(records(40), indent=1))
    (tmp_path / "small.json").write_text('[{"id": "s"}]')
    (tmp_path / "lines.json").write_text("\n".join(json.dumps(r) for r in records(3, 9)))
    raw = S.read_raw(spark, str(tmp_path))
    assert S.good_records(raw).count() == 44 and S.skipped_records(raw).first()["skipped"] == 0
    assert S.good_records(S.read_raw(spark, str(tmp_path / "big.json"), "array")).count() == 40


def test_scanner_in_pieces_equals_one_pass():
    data = json.dumps(records(12, 5), indent=1).encode()
    want = [json.loads(x) for x in A.Scanner(False, 0).feed(data, True)]
    assert want == records(12, 5)
    rng = np.random.default_rng(0)
    for _ in range(30):
        # pieces end where the reader cuts: behind a closing brace
        cuts = [i + 1 for i, c in enumerate(data) if c == 125 and rng.random() < 0.3]
        scan, got = A.Scanner(False, 0), []
        for a, b in zip([0, *cuts], [*cuts, len(data)]):
            got += scan.feed(data[a:b], True)
        assert [json.loads(x) for x in got] == want and scan.ended == 12


def test_small_ranges_share_tasks(spark, tmp_path):
    """Cut into many small ranges, a scan has a bounded number of tasks and the same rows."""
    import json

    for f in range(3):
        (tmp_path / f"{f}.json").write_text(json.dumps([{"id": f"{f}-{i}", "title": 'a "}" b' * 5} for i in range(400)]))
    files = sorted(str(p) for p in tmp_path.glob("*.json"))
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = [spark.conf.get(n) for n in names]
    try:
        for n in names:
            spark.conf.set(n, "256")
        segs = A.segments(spark, files)
        ranges, tasks = segs.select("file", "at").distinct().count(), segs.rdd.getNumPartitions()
        got = sorted(r.id for r in A.read_arrays(spark, files).collect())
    finally:
        for n, v in zip(names, before):
            spark.conf.set(n, v)
    assert got == sorted(f"{f}-{i}" for f in range(3) for i in range(400))
    assert ranges > 200 and tasks <= 4 * spark.sparkContext.defaultParallelism
