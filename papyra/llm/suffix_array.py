"""Removal of repeated byte strings with a two-stage suffix array.

A byte goes if a string of ``width`` (200) bytes that covers it also starts
anywhere else, in the same row or another; overlaps count, and strings are
judged on the input. ``segments`` finds the stretches that can hold such strings
and co-locates equal ones. In each task the suffixes of the fetched stretches
are sorted in two stages: those smaller than their successor are sorted
directly, eight-byte keys at a time to the depth of a window; every other one
follows its successor in a scan over the first-byte buckets. Neighbours in that
order with a common prefix of a window or more are repeats; a stretch that
stands in several places is kept once with its count.

Cases: null text is empty; texts shorter than a window lose nothing; repeated
rows are places of their own, so both lose what they share; a null id is a row
like others; text length is not limited; an empty table gives an empty result;
other columns do not matter.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame

from papyra.llm.segments import BYTES, Repeats, chunks, finish, merged, runs, spans_of

SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
KEY = 7             # symbols of 9 bits in a sort key
CHUNK = 1 << 20     # bytes of text sorted together


class TwoStage:
    """Order of the marked suffixes of ``text`` (symbols, 0 ends a segment), by
    their first ``depth`` symbols."""

    def __init__(self, text: np.ndarray, owned: np.ndarray, depth: int):
        self.text, self.depth = text, depth
        n = len(text)
        padded = np.concatenate([text, np.zeros(depth + 2 * KEY, text.dtype)]).astype(np.int64)
        self.keys = np.zeros(n + depth + KEY, np.int64)
        for i in range(KEY):
            self.keys |= padded[i:i + len(self.keys)] << (9 * (KEY - 1 - i))
        # smaller than the successor: decided at the next change of symbol
        step = np.sign(np.diff(padded[:n + 1]))
        change = np.where(step != 0, np.arange(n), n - 1)
        nearest = np.minimum.accumulate(change[::-1])[::-1]
        self.small = step[nearest] > 0
        self.small[n - 1] = True        # the last end of a segment
        # a suffix induced from an unmarked successor needs it marked, down to one sorted directly
        direct = np.flatnonzero(self.small)
        marked = owned.copy()
        last = np.flatnonzero(owned & ~np.append(owned[1:], False))
        for a, b in zip(last.tolist(), direct[np.searchsorted(direct, last)].tolist()):
            marked[a:b + 1] = True
        self.marked = marked

    def direct(self) -> np.ndarray:
        """The marked suffixes that are smaller than their successors, sorted."""
        at = np.flatnonzero(self.marked & self.small)
        at = at[np.argsort(self.keys[at], kind="stable")]
        key, deep = self.keys[at], KEY
        group = np.cumsum(np.concatenate([[0], key[1:] != key[:-1]])) if len(at) else np.zeros(0, int)
        while deep < self.depth and len(at):
            size = np.bincount(group)
            tied = np.flatnonzero(size[group] > 1)
            if not len(tied):
                break
            part, g = at[tied], group[tied]
            key = self.keys[part + deep]
            order = np.lexsort((key, g))
            at[tied] = part[order]
            key = key[order]
            split = np.zeros(len(at), bool)
            split[tied[1:]] = (key[1:] != key[:-1]) & (g[1:] == g[:-1])
            group = np.cumsum(split | np.concatenate([[False], group[1:] != group[:-1]]))
            deep += KEY
        return at

    def order(self) -> np.ndarray:
        """All marked suffixes in order: one scan over the buckets of first
        symbols; each suffix passes its place on to its predecessor if that is
        the larger of the two."""
        first = self.direct()
        size = int(self.text.max(initial=0)) + 1
        edges = np.searchsorted(self.text[first], np.arange(size + 1))
        waiting: list[list[np.ndarray]] = [[] for _ in range(size)]
        out = []

        def induce(part: np.ndarray, own: int):
            before = part[part > 0] - 1
            before = before[self.marked[before] & ~self.small[before]]
            if not len(before):
                return None
            symbol = self.text[before]
            by = np.argsort(symbol, kind="stable")
            before, symbol = before[by], symbol[by]
            cuts = np.flatnonzero(np.diff(symbol)) + 1
            same = None
            for x in np.split(before, cuts):
                c = int(self.text[x[0]])
                if c == own:
                    same = x
                else:
                    waiting[c].append(x)
            return same
        for c in range(size):
            if waiting[c]:
                part = np.concatenate(waiting[c])
                while part is not None:
                    out.append(part)
                    part = induce(part, c)
            part = first[edges[c]:edges[c + 1]]
            if len(part):
                out.append(part)
                induce(part, -1)
        return np.concatenate(out) if out else np.zeros(0, np.int64)

    def common(self, order: np.ndarray) -> np.ndarray:
        """Common prefix of neighbours in ``order``, up to ``depth`` symbols."""
        a, b = order[:-1], order[1:]
        out = np.zeros(len(a), np.int64)
        alive, deep = np.arange(len(a)), 0
        while len(alive) and deep < self.depth:
            differ = self.keys[a[alive] + deep] ^ self.keys[b[alive] + deep]
            end = differ != 0
            block = np.searchsorted(1 << 9 * np.arange(1, KEY), differ[end], "right")     # highest that differs
            out[alive[end]] = deep + KEY - 1 - block
            alive = alive[~end]
            deep += KEY
        out[alive] = self.depth
        return np.minimum(out, self.depth)


def repeated_starts(segs: list[bytes], counts: list[int], occ: list[int], width: int) -> list[np.ndarray]:
    """Per segment, which of its first ``counts`` window starts are repeated."""
    sizes = np.array([len(s) + 1 for s in segs])
    at = np.concatenate([[0], np.cumsum(sizes)])
    text = np.zeros(at[-1], np.int16)
    owned = np.zeros(at[-1], bool)
    for s, n, lo in zip(segs, counts, at.tolist()):
        text[lo:lo + len(s)] = np.frombuffer(s, np.uint8).astype(np.int16) + 1
        owned[lo:lo + n] = True
    array = TwoStage(text, owned, width)
    order = array.order()
    order = order[owned[order]]
    same = array.common(order) >= width
    hit = np.zeros(at[-1], bool)
    hit[order[:-1][same]] = True
    hit[order[1:][same]] = True
    return [np.ones(n, bool) if o > 1 else hit[lo:lo + n] for n, o, lo in zip(counts, occ, at.tolist())]


def repeats(docs: DataFrame, unit=BYTES) -> DataFrame:
    """(d, k, items): the removed spans of each row that has any, as structs
    (s, lo, hi) of window starts relative to s."""
    found = Repeats(docs, unit, across=False)

    def search(batches):
        import pyarrow as pa

        for rows in chunks(batches, CHUNK):
            a, c, occ, _low, n, segs = (list(x) for x in zip(*rows))
            flags = repeated_starts(segs, n, occ, unit.width)
            out = [(x, y, *runs(f)) for x, y, f in zip(a, c, flags) if f.any()]
            cols = list(zip(*out)) or [()] * 4
            kinds = [pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(cols, kinds)], names=["a", "c", "lo", "hi"])
    solved = found.solve(search, "a long, c long, lo array<int>, hi array<int>")
    spans = spans_of(found.members.df.join(solved.df, ["a", "c"]))
    found.drop()
    solved.drop()
    return spans


def covered(items, width: int) -> list[tuple[int, int]]:
    return merged([(x["s"] + lo, x["s"] + hi + width - 1) for x in items for lo, hi in zip(x["lo"], x["hi"])])


def remove_repeats(docs: DataFrame, unit=BYTES) -> DataFrame:
    """``SCHEMA`` per row."""
    def rest(text: bytes, items):
        spans, sha, at = covered(items, unit.width), hashlib.sha256(), 0
        for lo, hi in spans:
            sha.update(text[at:lo])
            at = hi
        sha.update(text[at:])
        return len(text), sum(hi - lo for lo, hi in spans), len(spans), sha.hexdigest()
    return finish(docs, repeats(docs, unit), rest, SCHEMA)
