"""Repeated segments: which stretches of which rows can hold a repeated window.

A window is ``width`` consecutive symbols (bytes or words) of a row. Its anchor is
the smallest hash of its grams of ``gram`` symbols, so equal windows have equal
anchors wherever they stand. Consecutive window starts with one anchor form a
member. Members whose anchor occurs once cannot hold a repeat and are left out
(an anchor may occur twice in one member, ``places`` says so); this loses nothing,
since it only uses that equal windows have equal anchors.
The others are grouped by anchor; members of equal content form one class, and
the text of one member per class is fetched for the exact search.

An anchor with very many classes (a passage of a large share of the rows, each
with its own surroundings) is dealt anew: its windows become members of their
own, keyed by the hash of the whole window, so that no group of classes grows
with the input.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyra.llm.common import (Rolling, Staged, row_blocks, row_key, sliding_min, utf8_view, word_hashes,
                               word_spans)

LONGEST = 1024              # starts of a member
MAX_CLASSES = 8192          # of an anchor; beyond, its windows are dealt one by one
SEGMENTS_A_TASK = 10_000
MEMBER = "a long, c long, d long, k long, s int, n int, places int"


@dataclass(frozen=True)
class Unit:
    words: bool         # symbols are words, else bytes
    width: int          # symbols of a window
    gram: int           # symbols of an anchor's gram
    block: int          # symbols worked on at a time


BYTES = Unit(False, 200, 50, 1 << 20)
WORDS = Unit(True, 50, 10, 1 << 17)


def symbols(data: np.ndarray, off: np.ndarray, unit: Unit) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of all rows of a batch and the rows' offsets."""
    if not unit.words:
        return data, off
    starts, ends = word_spans(data, off)
    return word_hashes(data, starts, ends), np.searchsorted(starts, off)


def pieces(off: np.ndarray, unit: Unit):
    """(rows, lo, hi, bounds, base): blocks of whole rows; a row larger than a
    block comes in slices that overlap by a window less one symbol."""
    for i, j in row_blocks(off, unit.block):
        size = off[j] - off[i]
        if j > i + 1 or size <= 2 * unit.block:
            yield np.arange(i, j), off[i], off[j], off[i:j + 1] - off[i], 0
            continue
        for t in range(0, int(size) - unit.width + 1, unit.block):
            hi = min(off[j], off[i] + t + unit.block + unit.width - 1)
            yield np.array([i]), off[i] + t, hi, np.array([0, hi - off[i] - t]), t


def sliding_max(x: np.ndarray, w: int) -> np.ndarray:
    return ~sliding_min(~x, w)


def twins(grams: np.ndarray, low: np.ndarray, w: int) -> np.ndarray:
    """Marks window starts around two occurrences of one anchor."""
    edge = np.zeros(w - 1, np.uint64)
    chosen = np.flatnonzero(sliding_max(np.concatenate([edge, low, edge]), w) == grams)
    out = np.zeros(len(low) + 1, np.int64)
    pair = np.flatnonzero((grams[chosen[1:]] == grams[chosen[:-1]]) & (np.diff(chosen) <= w))
    np.add.at(out, np.clip(chosen[pair + 1] - w, 0, len(low)), 1)
    np.add.at(out, np.clip(chosen[pair] + 1, 0, len(low)), -1)
    return np.cumsum(out[:-1]) > 0


def members_of(data: np.ndarray, off: np.ndarray, unit: Unit):
    """(row, s, n, a, c, places) arrays of the members of a batch."""
    sym, off = symbols(data, off, unit)
    for rows, lo, hi, bounds, base in pieces(off, unit):
        if hi - lo < unit.width:
            continue
        roll = Rolling(sym[lo:hi])
        grams, span = roll.grams(unit.gram), unit.width - unit.gram + 1
        low = sliding_min(grams, span)
        count = len(low)
        cut = np.zeros(count + 1, np.int64)         # windows across rows
        inner = bounds[1:-1]
        np.add.at(cut, np.clip(inner - unit.width + 1, 0, count), 1)
        np.add.at(cut, np.clip(inner, 0, count), -1)
        at = np.flatnonzero(np.cumsum(cut[:count]) == 0)
        if not len(at):
            continue
        new = np.ones(len(at), bool)
        new[1:] = (np.diff(at) > 1) | (low[at[1:]] != low[at[:-1]])
        first = np.flatnonzero(new)
        if np.diff(np.append(first, len(at))).max() > LONGEST:
            place = np.arange(len(at)) - np.repeat(first, np.diff(np.append(first, len(at))))
            first = np.flatnonzero(new | (place % LONGEST == 0))
        n = np.diff(np.append(first, len(at)))
        s = at[first]
        row = np.searchsorted(bounds, s, "right") - 1
        twice = np.concatenate([[0], np.cumsum(twins(grams, low, span))])
        places = 1 + (twice[s + n] > twice[s])
        yield rows[row], s - bounds[row] + base, n, low[s], roll.spans(s, s + n + unit.width - 1), places


def _batch(cols, schema: str):
    import pyarrow as pa

    kinds = {"long": pa.int64(), "int": pa.int32()}
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(cols, fields)],
                                      names=[f for f, _ in fields])


def members(docs: DataFrame, unit: Unit) -> DataFrame:
    rows = docs.select(*row_key(), F.col("text").cast("string").alias("text"))

    def run(batches):
        for b in batches:
            d, k = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for row, s, n, a, c, places in members_of(*utf8_view(b.column(2)), unit):
                yield _batch([a.view(np.int64), c.view(np.int64), d[row], k[row], s.astype(np.int32),
                              n.astype(np.int32), places.astype(np.int32)], MEMBER)
    return rows.mapInArrow(run, MEMBER)


def with_text(lists: DataFrame, docs: DataFrame) -> DataFrame:
    """``lists`` (d, k, items) with the rows' texts; a repeated row may come twice."""
    d, k = row_key()
    return lists.join(docs.select(d, k, F.col("text").cast("binary").alias("text")), ["d", "k"])


def cut_text(text: bytes, s: int, n: int, unit: Unit, words: list[bytes] | None) -> bytes:
    return b" ".join(words[s:s + n + unit.width - 1]) if unit.words else text[s:s + n + unit.width - 1]


def _single_windows(found: DataFrame, docs: DataFrame, unit: Unit) -> DataFrame:
    """The windows of ``found`` members as members of one start each."""
    lists = found.groupBy("d", "k").agg(F.collect_set(F.struct("s", "n")).alias("items"))

    def run(batches):
        for b in batches:
            for d, k, items, text in zip(*(b.column(i).to_pylist() for i in range(4))):
                data = np.frombuffer(text or b"", np.uint8)
                sym, _ = symbols(data, np.array([0, len(data)]), unit)
                for x in items:
                    part = sym[x["s"]:x["s"] + x["n"] + unit.width - 1]
                    roll, at = Rolling(part), np.arange(x["n"])
                    whole = roll.spans(at, at + unit.width)
                    other = Rolling(part[::-1].copy()).spans(x["n"] - 1 - at, x["n"] - 1 - at + unit.width)
                    yield _batch([whole.view(np.int64), other.view(np.int64), np.full(len(at), d), np.full(len(at), k),
                                  (x["s"] + at).astype(np.int32), np.ones(len(at), np.int32),
                                  np.ones(len(at), np.int32)], MEMBER)
    return with_text(lists, docs).mapInArrow(run, MEMBER)


class Repeats:
    """Members with a repeated anchor and their classes.

    ``across`` asks for anchors of two rows with different ids; otherwise two
    places anywhere are enough."""

    def __init__(self, docs: DataFrame, unit: Unit, across: bool):
        self.docs, self.unit = docs, unit
        several = (F.min("d") < F.max("d")) if across else (F.sum("places") > 1)
        every = Staged(members(docs, unit), "segments")
        anchors = Staged(every.df.groupBy("a").agg(several.alias("x")).where("x").select("a"), "anchors")
        found = Staged(every.df.join(anchors.df, "a").select("a", "c", "d", "k", "s", "n"), "repeats")
        every.drop()
        anchors.drop()
        self.members, self.classes = found, self._classes(found.df)
        crowded = Staged(self.classes.df.groupBy("a").count().where(F.col("count") > MAX_CLASSES).select("a"), "crowded")
        if not crowded.df.isEmpty():
            dealt = Staged(_single_windows(found.df.join(crowded.df, "a"), docs, unit), "windows")
            anchors = Staged(dealt.df.groupBy("a", "c").agg(several.alias("x")).where("x").select("a", "c"), "anchors")
            rest = found.df.join(crowded.df, "a", "left_anti").unionByName(
                dealt.df.drop("places").join(anchors.df, ["a", "c"]))
            self.members = Staged(rest.select("a", "c", "d", "k", "s", "n"), "repeats")
            self.classes.drop()
            self.classes = self._classes(self.members.df)
            for t in (dealt, anchors, found):
                t.drop()
        crowded.drop()

    @staticmethod
    def _classes(found: DataFrame) -> Staged:
        return Staged(found.groupBy("a", "c").agg(F.count("*").alias("occ"), F.min("d").alias("low"),
                                                  F.min(F.struct("d", "k", "s", "n")).alias("r"))
                      .select("a", "c", "occ", "low", "r.*"), "classes")

    def solve(self, search, schema: str) -> Staged:
        """``search`` over the classes' texts, as a map over streams in which
        the classes of an anchor stand together, in order."""
        unit = self.unit
        lists = self.classes.df.groupBy("d", "k").agg(F.collect_list(F.struct("a", "c", "occ", "low", "s", "n"))
                                                      .alias("items"))

        def fetch(batches):
            names = ("a", "c", "occ", "low", "n")
            for b in batches:
                out, texts, size = [], [], 0
                for items, text in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
                    words = (text or b"").split() if unit.words else None
                    for x in items:
                        out.append([x[c] for c in names])
                        texts.append(cut_text(text, x["s"], x["n"], unit, words))
                        size += len(texts[-1])
                        if size > 1 << 22:
                            yield _segments(out, texts)
                            out, texts, size = [], [], 0
                if out:
                    yield _segments(out, texts)

        def _segments(out, texts):
            import pyarrow as pa

            cols = [pa.array(x, pa.int64()) for x in zip(*out)]
            return pa.RecordBatch.from_arrays([*cols, pa.array(texts, pa.binary())],
                                              names=["a", "c", "occ", "low", "n", "seg"])
        segs = with_text(lists, self.docs).select("d", "k", "items", "text").mapInArrow(
            fetch, "a long, c long, occ long, low long, n long, seg binary")
        parts = self.classes.df.count() // SEGMENTS_A_TASK + 1
        return Staged(segs.repartition(parts, "a").sortWithinPartitions("a", "c").mapInArrow(search, schema), "solved")

    def drop(self):
        self.members.drop()
        self.classes.drop()


def chunks(batches, limit: int):
    """Lists of segments (a, c, occ, low, n, seg): whole anchors, about ``limit``
    bytes of text together; a class comes once."""
    rows, size, last = [], 0, None
    for b in batches:
        for row in zip(*(b.column(i).to_pylist() for i in range(6))):
            if last is not None and row[:2] == last:
                continue
            if size > limit and row[0] != last[0]:
                yield rows
                rows, size = [], 0
            rows.append(row)
            size += len(row[5])
            last = row[:2]
    if rows:
        yield rows


def runs(flags: np.ndarray) -> tuple[list[int], list[int]]:
    edge = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist()


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(spans):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


def finish(docs: DataFrame, spans: DataFrame, rest, schema: str) -> DataFrame:
    """Per row of ``docs``: ``rest(text, items)`` gives the values after doc_id;
    ``spans`` has (d, k, items), one row a key."""
    d, k = row_key()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), d, k, F.col("text").cast("binary").alias("text"))
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches):
        import pyarrow as pa

        kinds = {"long": pa.int64(), "string": pa.string()}
        types = [kinds[f.split()[1]] for f in schema.split(", ")]
        for b in batches:
            out = [[] for _ in names]
            for doc, text, items in zip(b.column(0).to_pylist(), b.column(1), b.column(2)):
                for col, v in zip(out, (doc, *rest(text.as_py() or b"", items.as_py() or []))):
                    col.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, types)], names=names)
    return rows.join(spans, ["d", "k"], "left").select("doc_id", "text", "items").mapInArrow(run, schema)


def spans_of(joined: DataFrame) -> DataFrame:
    """(d, k, items) from rows (d, k, s, lo, hi); a repeated row counts once."""
    return Staged(joined.groupBy("d", "k").agg(F.collect_set(F.struct("s", "lo", "hi")).alias("items")), "spans").df
