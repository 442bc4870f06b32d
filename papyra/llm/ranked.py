"""Ranked lexical search over bags of words, each distinct bag scored once.

Terms are the runs of ASCII letters, digits and non-ASCII characters of the
whole text, A-Z lower-cased. A document keeps only the terms that some item
holds: its bag is the list of (term, occurrences) plus ``m``, the number that
stands for its length. Score of an item: for each of its terms, repeats
included, ``w * ((1000000000 * tf) div (1000 * tf + 12 * m))``, in integers.

Documents of one class (equal bag and m) have equal scores for every item. Bags
are grouped by their hash, and by the bag itself, so a collision joins nothing;
a class sends on its number and the ``k`` smallest ids, which is all that any
top ``k`` can use (ties go to the smaller id). ``k`` is cut in each task before
the shuffle, so a class with a third of all documents is no hot group. Tasks
score a block of classes against the items as one exact matrix product, classes
x terms times terms x items, and keep ``k`` rows an item; a window merges them.

Items are read to the driver in blocks of at most ``max_block_bytes`` of text
(counted first); each block is searched in a pass of its own, exactly.

Cases: a null or term-free text is no document (it counts in neither N, L nor df);
a null ``doc_id`` comes after all others among equal scores; repeated rows are
documents of their own; a null or term-free item has no result, items that share
an id are ranked one by one under that id; empty tables give an empty result;
other columns do not matter.
"""

from __future__ import annotations

import math
from collections import Counter
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from papyra.llm.common import Staged

BLOCK_BYTES = 4 << 20       # item text of one pass
CLASS_ROWS = 512            # classes of one matrix product
EXACT = 2.0 ** 53
TOP_SCHEMA = "item int, doc_id long, score long"

_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def terms_of(text: bytes | None) -> list[bytes]:
    """Terms of a UTF-8 text, in order, with repeats."""
    return text.translate(_FOLD).split() if text else []


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2.0 * n_docs + 2) / (2.0 * df + 1)))


def bags(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """(doc_id, n, bag) of documents with a term; ``bag`` packs the ascending
    (term number, occurrences) pairs of the vocabulary's terms."""
    def run(batches):
        import pyarrow as pa

        for b in batches:
            n, packed = [], []
            for text in b.column(1):
                words = terms_of(text.as_py())
                n.append(len(words))
                found = Counter(map(vocabulary.get, words))
                found.pop(None, None)
                packed.append(np.array(sorted(found.items()), "<i4").tobytes())
            out = pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(packed, pa.binary())],
                                             names=["doc_id", "n", "bag"])
            yield out.filter(pa.array(np.array(n, np.int64) > 0, pa.bool_()))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("t"))
    return rows.mapInArrow(run, "doc_id long, n long, bag binary")


def term_counts(found: DataFrame, size: int) -> dict[int, int]:
    """Documents that hold each term: one row a term leaves a task."""
    def run(batches):
        import pyarrow as pa

        total = np.zeros(size, np.int64)
        for b in batches:
            for bag in b.column(0):
                total[np.frombuffer(bag.as_py(), "<i4")[::2]] += 1
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["term", "df"])
    counted = found.select("bag").mapInArrow(run, "term int, df long")
    return {r.term: r.df for r in counted.groupBy("term").agg(F.sum("df").alias("df")).collect()}


def classes(found: DataFrame, k: int, n_docs: int, n_terms: int) -> DataFrame:
    """(m, bag, ids): the classes and the ``k`` smallest ids of each, a null last."""
    m = (F.lit(75).cast("long") + F.expr(f"(25L * n * {n_docs}L) div {max(n_terms, 1)}L")).alias("m")
    rows = found.where(F.length("bag") > 0).select("doc_id", "bag", m) \
        .withColumn("h", F.xxhash64("m", "bag"))
    order = W.partitionBy("h", "m", "bag").orderBy(F.col("doc_id").asc_nulls_last())
    first = rows.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k)
    # collect_list skips nulls: they are wrapped
    return first.groupBy("h", "m", "bag").agg(F.sort_array(F.collect_list(F.struct("r", "doc_id"))).alias("ids")) \
        .select("m", "bag", F.col("ids.doc_id").alias("ids"))


def saturation(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + 12 * m)


class TopRows:
    """The best ``k`` (score, id) rows of each item seen so far."""

    def __init__(self, items: int, k: int):
        self.k, self.rows, self.kth = k, [[] for _ in range(items)], np.zeros(items, np.int64)

    def add(self, score: np.ndarray, ids: list[list]) -> None:
        """``score`` is classes x items; ``ids`` the members of each class."""
        for item in np.flatnonzero((score >= np.maximum(self.kth, 1)).any(axis=0)):
            got = np.flatnonzero(score[:, item] >= max(self.kth[item], 1))
            if len(got) > self.k:           # k classes with more points are ahead of the rest
                least = np.partition(score[got, item], -self.k)[-self.k]
                got = got[score[got, item] >= least]
            rows = self.rows[item] + [(-int(score[c, item]), i is None, i or 0, i) for c in got for i in ids[c]]
            rows.sort(key=lambda r: r[:3])
            self.rows[item] = rows[:self.k]
            if len(rows) >= self.k:
                self.kth[item] = -rows[self.k - 1][0]


def score_classes(found: DataFrame, weights: np.ndarray, k: int) -> DataFrame:
    """The ``k`` best rows of each item among the classes of every task.
    ``weights`` is terms x items: w times the term's repeats in the item."""
    peak = float(weights.sum(axis=0).max(initial=0)) * 1_000_000.0
    kind = np.float64 if peak < EXACT else np.int64         # both exact
    table = weights.astype(kind)

    def run(batches):
        import pyarrow as pa

        top = TopRows(table.shape[1], k)
        for b in batches:
            for at in range(0, b.num_rows, CLASS_ROWS):
                part = b.slice(at, CLASS_ROWS)
                pairs = [np.frombuffer(x.as_py(), "<i4").reshape(-1, 2) for x in part.column(1)]
                flat = np.concatenate(pairs).astype(np.int64)
                row = np.repeat(np.arange(len(pairs)), [len(p) for p in pairs])
                m = part.column(0).to_numpy(zero_copy_only=False)
                used, col = np.unique(flat[:, 0], return_inverse=True)
                x = np.zeros((len(pairs), len(used)), kind)
                x[row, col] = saturation(flat[:, 1], m[row])
                top.add((x @ table[used]).astype(np.int64), part.column(2).to_pylist())
        out = [(i, r[3], -r[0]) for i, rows in enumerate(top.rows) for r in rows]
        cols = list(zip(*out)) or [()] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int64(), pa.int64()))],
                                         names=["item", "doc_id", "score"])
    return found.mapInArrow(run, TOP_SCHEMA)


def _blocks(items: DataFrame, max_block_bytes: int):
    """The items' (id, text) rows in lists of bounded size."""
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("binary").alias("t"))
    size = rows.agg(F.sum(F.length("t"))).first()[0] or 0
    n = -(-size // max_block_bytes)
    part = F.pmod(F.xxhash64("item_id", "t"), F.lit(max(n, 1)))
    return [[(r.item_id, r.t) for r in rows.where(F.length("t") > 0).where(part == i).collect()] for i in range(n)]


def search(docs: DataFrame, items: DataFrame, k: int = 20, max_block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's ``k`` best documents."""
    spark, out = docs.sparkSession, []
    for block in _blocks(items, max_block_bytes):
        held = [Counter(terms_of(t)) for _, t in block]
        vocabulary = {t: n for n, t in enumerate(sorted(set().union(*held)))}
        if not vocabulary:
            continue
        found = Staged(bags(docs, vocabulary), "ranked-bags").df
        n_docs, n_terms = found.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        df = term_counts(found, len(vocabulary))
        weights = np.zeros((len(vocabulary), len(block)), np.int64)
        for i, terms in enumerate(held):
            for t, times in terms.items():
                weights[vocabulary[t], i] = times * weight(n_docs, df.get(vocabulary[t], 0))
        best = score_classes(classes(found, k, n_docs, n_terms), weights, k)
        order = W.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
        ids = spark.createDataFrame([(i, x) for i, (x, _) in enumerate(block)], "item int, item_id long")
        ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        out.append(ranked.join(F.broadcast(ids), "item").select("item_id", "rank", "doc_id", "score"))
    if not out:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    return reduce(DataFrame.unionByName, out)
