import random
from collections import Counter, defaultdict
from fractions import Fraction

from papyra.llm import mixing


def brute(targets, units, upto):
    """Earliest deadline first, written out: at each slot every source's next block is tried."""
    done, out = [0] * len(targets), [[] for _ in targets]
    for slot in range(upto):
        best = None
        for s, a in enumerate(targets):
            w = Fraction(a, units)
            release, deadline = done[s] / w, (done[s] + 1) / w
            if release.__floor__() <= slot:
                best = min(best or (deadline.__ceil__(), s), (deadline.__ceil__(), s))
        done[best[1]] += 1
        out[best[1]].append(slot)
    return out


def cases():
    rng = random.Random(1)
    yield [7], 7
    yield [5, 1, 1], 7
    for units in (10, 97, 400, 1024):
        for n in (1, 2, 5, 9):
            yield mixing.target_units([rng.random() ** 3 + 1e-6 for _ in range(n)], units), units
    yield mixing.target_units([1e6, 1e5, *[1.0] * 60], 4096), 4096


def test_period_matches_brute_force():
    for targets, units in cases():
        assert sum(targets) == units and min(targets) >= 1
        plan = mixing.period(targets, units)
        assert plan == brute(targets, units, units)
        assert mixing.period(targets, units, units // 3) == [[t for t in p if t < units // 3] for p in plan]
        assert sorted(sum(plan, [])) == list(range(units)) and [len(p) for p in plan] == targets


def test_less_than_one_block_off_at_every_slot_of_many_periods():
    for targets, units in cases():
        plan, got = mixing.period(targets, units), [0] * len(targets)
        by = {t: s for s, p in enumerate(plan) for t in p}
        for slot in range(5 * units if units < 500 else 2 * units):
            got[by[slot % units]] += 1
            assert all(abs(n * units - (slot + 1) * a) < units for n, a in zip(got, targets))
        for s, a in enumerate(targets):
            release, deadline = mixing.windows(a, units, a)
            assert all(r <= t < e for r, t, e in zip(release, plan[s], deadline))


def test_units_follow_the_weights():
    for weights, units in (([0.9, 0.05, 0.05], 1 << 20), ([1e6, 1e5, *[1.0] * 200], 1 << 22), ([3, 1.7], 7),
                           ([(1 / 3) ** 0.5, *[(2 / 3 / 299) ** 0.5] * 299], 1 << 20)):
        got, total = mixing.target_units(weights, units), sum(weights)
        assert sum(got) == units
        assert all(abs(g - w / total * units) < 1.01 for g, w in zip(got, weights))
    assert mixing.target_units([0, 0, 0], 9) == [3, 3, 3]
    assert mixing.target_units([5.0, -1, 0], 100) == [98, 1, 1]
    many = mixing.target_units([1.0] + [0.0] * 999, 64_000)
    assert many[0] == 63_001 and sum(many) == 64_000
    assert sum(mixing.target_units([random.Random(3).random() ** 40 for _ in range(900)], 1000)) == 1000


def check(rows, n, block_rows):
    assert len(rows) == n
    assert max(Counter((r.slot, r.in_block) for r in rows).values(), default=1) == 1
    by = defaultdict(list)
    for r in rows:
        by[r.source].append(r)
        assert r.release <= r.slot < r.deadline
    for g in by.values():
        assert Counter(r.block for r in g) == Counter({b: min(block_rows, len(g) - block_rows * b)
                                                       for b in range(-(-len(g) // block_rows))})
        assert len({(r.block, r.slot) for r in g}) == len({r.block for r in g})
        assert [r.slot for r in sorted(g, key=lambda r: r.block)] == sorted(r.slot for r in g)


def test_mix_rows(spark, docs_of, monkeypatch):
    pairs = [(i, f"t{i}") for i in range(500)] + [(7, "t7"), (None, None), (3, "other")]
    docs = docs_of(pairs, 5)
    from pyspark.sql import functions as F
    docs = docs.withColumn("source", F.when(F.col("doc_id") % 2 == 0, "hot").when(F.col("doc_id") == 9, None)
                           .otherwise(F.col("source")))
    out = mixing.mix(docs, power=0.5, block_rows=4, units=20)
    rows = out.collect()
    check(rows, len(pairs), 4)
    assert set(docs.columns) - {"block"} <= set(out.columns)
    assert sorted((r.doc_id, r.text) for r in rows if r.doc_id is not None) == sorted(p for p in pairs if p[0] is not None)
    assert mixing.mix(docs.limit(0)).count() == 0
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)         # shuffled joins give the same
    monkeypatch.setattr(mixing, "BROADCAST_PARTS", 0)
    again = mixing.mix(docs, power=0.5, block_rows=4, units=20).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, rows))


def test_given_weights(spark, docs_of):
    rows = mixing.mix(docs_of([(i, "x") for i in range(300)]), weights={"src0": 3, "src1": 1}, block_rows=2,
                      units=40).collect()           # raised to 64 a source
    head = Counter(r.source for r in rows if r.slot < 40)
    assert head["src0"] > 2.5 * head["src1"] > 0
    assert sum(r.source == "src2" and r.slot < 192 for r in rows) == 2
    assert len(rows) == 300


def test_many_sources(spark, docs_of):
    from pyspark.sql import functions as F

    docs = docs_of([(i, "x") for i in range(600)]).withColumn("source", F.when(F.col("doc_id") < 200, "hot").otherwise(
        F.concat(F.lit("site"), F.col("doc_id"))))
    rows = mixing.mix(docs, block_rows=2).collect()
    check(rows, 600, 2)
    assert len({r.source for r in rows}) == 401


def test_mix_follows_the_targets(spark, docs_of):
    from pyspark.sql import functions as F

    docs = docs_of([(i, "x") for i in range(2000)]).withColumn("source", F.when(F.col("doc_id") < 1000, "hot").otherwise(
        F.concat(F.lit("s"), F.col("doc_id") % 9)))
    weights = {"hot": 9, **{f"s{i}": 1 for i in range(9)}}
    rows = mixing.mix(docs, weights, block_rows=1).collect()
    check(rows, 2000, 1)
    slots = sorted(r.slot for r in rows if r.source == "hot")
    for upto in range(1, 1600):
        assert abs(sum(t < upto for t in slots[:1 + upto]) - upto / 2) < 1
