"""Toxicity: logistic classifier with a counterfactual regulariser.

Features are the presence of words (lower-cased letter runs of the whole
text) and of word beginnings of 4 to 8 letters, which carry the signal where a
language builds many forms on one stem. They are screened by their log-odds
over the training rows; identity terms always stay in the vocabulary. For every labelled sentence that names a
group, its terms are swapped twice, for others of the same list and for a
neutral word; the squared change of the logit under each swap is added to the
loss, so that a group mention as such does not move the score.

The classifier is fitted on at most about ``Settings.train_rows`` labelled rows,
drawn by a hash of the id (all of them where there are fewer); scoring covers
every row. Label, language, source and id are never inputs of a score.

Cases: null or empty text has no words and scores the bias; null ids are held
out (the check sum of the empty string is 0); several labels of an id: the
largest; null labels are ignored; without labels every score is 0.02; rows
that repeat get equal results; an empty table an empty result; other columns
do not matter.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papyra.llm.common import Staged

# fixed values: terms of one row are swapped for each other
IDENTITY = (
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino", "indigenous"),
    ("gay", "lesbian", "straight", "bisexual", "transgender"),
    ("woman", "man"), ("women", "men"), ("girl", "boy"), ("female", "male"),
    ("immigrant", "citizen"), ("immigrants", "citizens"), ("disabled", "abled"), ("old", "young"),
    ("frau", "mann"), ("femme", "homme"), ("mujer", "hombre"),
    ("american", "mexican", "chinese", "indian", "german", "french", "african", "arab", "russian"),
)
SWAP = {t: row[(i + 1) % len(row)] for row in IDENTITY for i, t in enumerate(row)}
NEUTRAL = "someone"
WORD = re.compile(r"[^\W\d_]+")
STEMS = range(4, 9)
SENTENCE = re.compile(r"[.!?\n]+")
SCHEMA = "doc_id long, held_out boolean, score double, predicted int"


@dataclass(frozen=True)
class Settings:
    train_rows: int = 20_000        # bound of the training sample
    min_df: int = 5                 # rows a word must occur in
    min_z: float = 4.0              # log-odds z score a word must reach
    max_words: int = 4096           # size of the vocabulary
    l2: float = 3e-6
    fairness: float = 1.0           # weight of the counterfactual penalty
    steps: int = 400


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def features(words) -> set[str]:
    """The words and, marked by ``^``, their beginnings."""
    out = set(words)
    for w in tuple(out):
        for n in STEMS:
            if len(w) > n:
                out.add("^" + w[:n])
    return out


def words_of(text: str | None) -> set[str]:
    return features(WORD.findall(text.lower())) if text else set()


def counterfactuals(text: str | None) -> list[tuple[list[str], list[str]]]:
    """(words, words after a swap) for both swaps of each sentence that has an
    identity term."""
    out = []
    for sentence in SENTENCE.split(text.lower()) if text else ():
        words = WORD.findall(sentence)
        if any(w in SWAP for w in words):
            plain = sorted(features(words))
            out += [(plain, sorted(features(SWAP.get(w, w) for w in words))),
                    (plain, sorted(features(NEUTRAL if w in SWAP else w for w in words)))]
    return out


def training_rows(docs: DataFrame, labels: DataFrame, s: Settings) -> DataFrame:
    """Labelled rows that are not held out: label, words, counterfactuals. The
    sample of ids is bounded by ``train_rows`` and therefore broadcast."""
    given = (labels.select(F.col("doc_id").cast("long").alias("i"), F.col("toxic").cast("int").alias("y"))
             .where("i IS NOT NULL AND y IS NOT NULL").where(~held_out(F.col("i")))
             .groupBy("i").agg((F.max("y") > 0).cast("int").alias("y")))
    total = given.count()
    share = 1.0 if total <= s.train_rows else s.train_rows / total
    if share < 1.0:
        given = given.where(F.pmod(F.xxhash64("i"), F.lit(1 << 30)) < F.lit(int(share * (1 << 30))))
    rows = (docs.select(F.col("doc_id").cast("long").alias("i"), F.col("text").cast("string").alias("t"))
            .join(F.broadcast(given), "i").select("y", "t"))

    def run(batches):
        import pyarrow as pa

        pairs = pa.list_(pa.struct([("plain", pa.list_(pa.string())), ("swapped", pa.list_(pa.string()))]))
        for b in batches:
            texts = b.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays(
                [b.column(0).cast(pa.int32()), pa.array([sorted(words_of(t)) for t in texts], pa.list_(pa.string())),
                 pa.array([[{"plain": p, "swapped": q} for p, q in counterfactuals(t)] for t in texts], pairs)],
                names=["y", "words", "pairs"])
    return rows.mapInArrow(run, "y int, words array<string>, "
                                "pairs array<struct<plain:array<string>,swapped:array<string>>>")


def screen(rows: DataFrame, s: Settings) -> tuple[list[str], int, int]:
    """Vocabulary (most telling words first, then identity terms) and the
    number of clean and toxic training rows."""
    n = {r.y: r["count"] for r in rows.groupBy("y").count().collect()}
    clean, toxic = n.get(0, 0), n.get(1, 0)
    if not clean or not toxic:
        return [], clean, toxic
    t, c = F.col("t") + 0.5, F.col("c") + 0.5
    nt, nc = F.lit(toxic + 1.0) - t, F.lit(clean + 1.0) - c
    z = (F.log(t / nt) - F.log(c / nc)) / F.sqrt(1 / t + 1 / c + 1 / nt + 1 / nc)
    found = (rows.select("y", F.explode("words").alias("w")).groupBy("w")
             .agg(F.sum("y").alias("t"), F.sum(1 - F.col("y")).alias("c"))
             .where(F.col("t") + F.col("c") >= s.min_df).withColumn("z", F.abs(z)).where(F.col("z") >= s.min_z)
             .orderBy(F.desc("z"), "w").limit(s.max_words).select("w").collect())
    vocab = [r.w for r in found]
    return vocab + sorted(set(SWAP) - set(vocab)), clean, toxic


def fit(docs: DataFrame, labels: DataFrame, s: Settings = Settings()) -> dict:
    """``{"bias": float, "weights": {word: weight}}``. Features of the bounded
    sample are few numbers a row; the optimiser runs on them in the driver."""
    staged = Staged(training_rows(docs, labels, s), "toxicity-train")
    vocab, clean, toxic = screen(staged.df, s)
    if not vocab:
        rows = clean + toxic
        staged.drop()
        return {"bias": math.log((toxic + 0.5) / (clean + 0.5)) if rows else math.log(0.02 / 0.98), "weights": {}}
    words = F.array(*[F.lit(w) for w in vocab])
    keep = lambda c: F.array_intersect(c, words)
    sample = sorted(staged.df.select("y", keep("words").alias("x"), F.transform(
        "pairs", lambda p: F.struct(keep(p["plain"]).alias("a"), keep(p["swapped"]).alias("b"))).alias("pairs")).collect())
    staged.drop()
    index = {w: i for i, w in enumerate(vocab)}
    data, labels_, deltas = [], [], []
    for r in sample:
        data.append(sorted(index[w] for w in r.x))
        labels_.append(r.y)
        for p in r.pairs:
            a, b = {index[w] for w in p.a}, {index[w] for w in p.b}
            deltas.append([(j, 1.0) for j in sorted(b - a)] + [(j, -1.0) for j in sorted(a - b)])
    bias, w = optimise(data, np.array(labels_, float), deltas, len(vocab), s)
    return {"bias": float(bias), "weights": {v: float(x) for v, x in zip(vocab, w) if abs(x) > 1e-9}}


def optimise(data, y, deltas, dim, s: Settings):
    """Full-batch Adam on logistic loss + L2 + fairness * mean squared change
    of the logit under the swaps."""
    rows = np.repeat(np.arange(len(data)), [len(x) for x in data])
    cols = np.fromiter((j for x in data for j in x), int, len(rows))
    drow = np.repeat(np.arange(len(deltas)), [len(x) for x in deltas])
    dcol = np.fromiter((j for x in deltas for j, _ in x), int, len(drow))
    dval = np.fromiter((v for x in deltas for _, v in x), float, len(drow))
    w, b = np.zeros(dim), math.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))
    m, v = np.zeros(dim + 1), np.zeros(dim + 1)
    for step in range(1, s.steps + 1):
        p = 1 / (1 + np.exp(-np.clip(b + np.bincount(rows, w[cols], len(y)), -40, 40)))
        g = (p - y) / len(y)
        grad = np.bincount(cols, g[rows], dim) + 2 * s.l2 * w
        if len(deltas):
            change = np.bincount(drow, w[dcol] * dval, len(deltas))
            grad += s.fairness * 2 / len(deltas) * np.bincount(dcol, change[drow] * dval, dim)
        full = np.append(grad, g.sum())
        m, v = 0.9 * m + 0.1 * full, 0.999 * v + 0.001 * full * full
        move = 0.1 * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-9)
        w, b = w - move[:-1], b - move[-1]
    return b, w


def probability(model: dict, text: str | None) -> float:
    hits = words_of(text) & model["weights"].keys()
    x = model["bias"] + math.fsum(model["weights"][w] for w in hits)
    return 1 / (1 + math.exp(-max(-40.0, min(40.0, x))))


def score(docs: DataFrame, model: dict) -> DataFrame:
    """``SCHEMA`` per row: a map over the scan."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"),
                       F.col("text").cast("string").alias("text"))

    def run(batches):
        import pyarrow as pa

        for b in batches:
            p = [probability(model, t.as_py()) for t in b.column(2)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(p, pa.float64()), pa.array([int(x >= 0.5) for x in p], pa.int32())],
                names=["doc_id", "held_out", "score", "predicted"])
    return rows.mapInArrow(run, SCHEMA)


def drop_toxic(docs: DataFrame, model: dict) -> DataFrame:
    """Rows whose predicted label is 0, all columns unchanged."""
    at = docs.columns.index("text")

    def run(batches):
        import pyarrow as pa

        for b in batches:
            yield b.filter(pa.array([probability(model, t.as_py()) < 0.5 for t in b.column(at)], pa.bool_()))
    return docs.mapInArrow(run, docs.schema)
