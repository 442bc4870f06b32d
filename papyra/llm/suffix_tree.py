"""Removal of repeated word strings with prefix-partitioned suffix trees.

Words are ``[^\\x20\\x09-\\x0D]+``, unchanged. A word goes if a window of ``width`` (50)
consecutive words that covers it also starts in a row with a smaller id;
windows are judged on the input. ``segments`` finds the stretches that can hold
such windows and co-locates equal ones. In each task the suffixes of the fetched
stretches are split by their first words, a prefix being lengthened word by
word until its group fits ``GROUP`` suffixes; each group's subtree is then grown
from the top, a node splitting by its next word and leaves dropping out. Nodes
as deep as a window are the repeats; the smallest id below a node is where
its window comes from first. Words are numbered exactly, not hashed, there.

Cases: null text has no words; texts shorter than a window lose nothing; a null
id is the smallest; repeated rows and rows that share an id do not remove from
each other; an empty table gives an empty result; other columns do not matter.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyra.llm.segments import WORDS, Repeats, chunks, finish, merged, runs, spans_of

SCHEMA = "doc_id long, n_words long, n_removed long, kept_sha256 string"
CHUNK = 1 << 22         # bytes of text numbered together
GROUP = 1 << 16         # suffixes of a prefix group


def split_nodes(node: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Children of the nodes by the next symbol: (order, child of each)."""
    order = np.lexsort((symbol, node))
    n, s = node[order], symbol[order]
    return order, np.cumsum(np.concatenate([[0], (n[1:] != n[:-1]) | (s[1:] != s[:-1])]))


def prefix_groups(words: np.ndarray, starts: np.ndarray, width: int):
    """(suffixes, node, prefix length): suffixes by variable-length prefixes. A
    prefix shared by more than ``GROUP`` suffixes is lengthened by a word (up to a
    window); the others of one length are packed, a node each, into groups of
    about ``GROUP`` suffixes."""
    todo, deep = [starts], 0
    while todo:
        longer, pack, size = [], [], 0
        for part in todo:
            if len(part) < 2:
                continue
            if len(part) > GROUP and deep < width:
                order, child = split_nodes(np.zeros(len(part), np.int64), words[part + deep])
                longer += np.split(part[order], np.flatnonzero(np.diff(child)) + 1)
                continue
            if pack and size + len(part) > GROUP:
                yield np.concatenate(pack), np.repeat(np.arange(len(pack)), [len(x) for x in pack]), deep
                pack, size = [], 0
            pack.append(part)
            size += len(part)
        if pack:
            yield np.concatenate(pack), np.repeat(np.arange(len(pack)), [len(x) for x in pack]), deep
        todo, deep = longer, deep + 1


def deep_nodes(words: np.ndarray, at: np.ndarray, node: np.ndarray, deep: int,
               width: int) -> tuple[np.ndarray, np.ndarray]:
    """(suffixes, node): the suffixes below each node of depth ``width``; those
    that leave their node alone before are leaves and drop out."""
    while deep < width and len(at):
        order, child = split_nodes(node, words[at + deep])
        alive = np.bincount(child)[child] > 1
        at, node = at[order][alive], child[alive]
        deep += 1
    return at, node


def earlier_starts(segs: list[bytes], counts: list[int], low: list[int], width: int) -> list[np.ndarray]:
    """Per segment, which of its first ``counts`` windows also start in a segment
    with a smaller ``low`` (the smallest id of its rows)."""
    number: dict[bytes, int] = {}
    texts = [[number.setdefault(w, len(number)) for w in s.split()] for s in segs]
    at = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    words = np.fromiter((x for t in texts for x in t), np.int64, at[-1])
    starts = np.concatenate([np.arange(lo, lo + n) for lo, n in zip(at.tolist(), counts)])
    first = np.repeat(np.array(low, np.int64), np.diff(at))
    hit = np.zeros(at[-1], bool)
    for part, node, deep in prefix_groups(words, starts, width):
        leaves, node = deep_nodes(words, part, node, deep, width)
        if len(leaves):
            smallest = np.full(node.max() + 1, (1 << 63) - 1, np.int64)
            np.minimum.at(smallest, node, first[leaves])
            hit[leaves] = smallest[node] < first[leaves]
    return [hit[lo:lo + n] for lo, n in zip(at.tolist(), counts)]


def repeats(docs: DataFrame, unit=WORDS) -> DataFrame:
    """(d, k, items): the removed spans of each row that has any, as structs
    (s, lo, hi) of window starts relative to s."""
    found = Repeats(docs, unit, across=True)

    def search(batches):
        import pyarrow as pa

        for rows in chunks(batches, CHUNK):
            a, c, _occ, low, n, segs = (list(x) for x in zip(*rows))
            out = [(x, y, z, m, *runs(f)) for x, y, z, m, f in
                   zip(a, c, low, n, earlier_starts(segs, n, low, unit.width))]
            kinds = [*[pa.int64()] * 4, pa.list_(pa.int32()), pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*out), kinds)],
                                             names=["a", "c", "low", "m", "lo", "hi"])
    solved = found.solve(search, "a long, c long, low long, m long, lo array<int>, hi array<int>")
    # a class that starts in a smaller id is removed whole; in its first row, only what is earlier elsewhere
    later = F.col("d") > F.col("low")
    joined = found.members.df.join(solved.df, ["a", "c"]).select(
        "d", "k", "s", F.when(later, F.array(F.lit(0))).otherwise(F.col("lo")).alias("lo"),
        F.when(later, F.array(F.col("m").cast("int"))).otherwise(F.col("hi")).alias("hi")).where(F.size("lo") > 0)
    spans = spans_of(joined)
    found.drop()
    solved.drop()
    return spans


def remove_repeats(docs: DataFrame, unit=WORDS) -> DataFrame:
    """``SCHEMA`` per row."""
    def rest(text: bytes, items):
        words = text.split()
        spans = merged([(x["s"] + lo, x["s"] + hi + unit.width - 1) for x in items for lo, hi in zip(x["lo"], x["hi"])])
        kept, at = [], 0
        for lo, hi in spans:
            kept += words[at:lo]
            at = hi
        kept += words[at:]
        return len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()
    return finish(docs, repeats(docs, unit), rest, SCHEMA)
