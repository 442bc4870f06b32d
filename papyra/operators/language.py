"""Language by character n-grams: naive Bayes over hashed trigrams.

``fit`` counts the trigrams of labelled texts (at most about ``SAMPLE`` of them, chosen by
hash) by language and bucket; what it returns, ``BUCKETS`` log-probabilities a language,
does not grow with the corpus. ``detect`` scores a text against it as one column
expression, in the scan. Only the first ``CHARS`` characters are looked at, lower-cased,
as language shows in a few words.

Texts without a trigram, and null ones, get null. Ties go to the first language by name.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAMPLE, BUCKETS, CHARS = 20_000, 4096, 400


@dataclass(frozen=True)
class Profile:
    """Log-probability of each bucket in each language, and of the language itself."""
    languages: tuple[str, ...]
    prior: tuple[float, ...]
    weights: tuple[tuple[float, ...], ...]


def grams(text) -> Column:
    """Buckets of the trigrams of a text, with repeats."""
    t = F.left(F.lower(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))), F.lit(CHARS))
    chars = F.split(t, "")
    n = F.greatest(F.size(chars) - 2, F.lit(0))
    # lambdas touch their own arguments only: an outer text would be lower-cased for every place
    pairs = F.zip_with(F.slice(chars, 1, n), F.slice(chars, 2, n), lambda x, y: F.concat(x, y))
    return F.zip_with(pairs, F.slice(chars, 3, n), lambda x, y: F.pmod(F.xxhash64(F.concat(x, y)), F.lit(BUCKETS)).cast("int"))


def fit(texts: DataFrame, text_col: str, language_col: str, sample: int = SAMPLE) -> Profile:
    labelled = texts.where(F.col(language_col).isNotNull()).select(F.col(text_col).alias("t"), F.col(language_col).alias("lang"))
    n = labelled.count()
    share = min(1.0, sample / max(n, 1))
    some = labelled.where(F.pmod(F.xxhash64("t", "lang"), F.lit(1 << 30)) < int(share * (1 << 30)))
    counts = some.select("lang", F.explode(grams("t")).alias("b")).groupBy("lang", "b").agg(F.count(F.lit(1)).alias("n"))
    docs = {r.lang: r.n for r in some.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    table = {lang: [0] * BUCKETS for lang in sorted(docs)}
    for r in counts.collect():                  # languages x buckets at most
        table[r.lang][r.b] = r.n
    total = sum(docs.values())
    weights = tuple(tuple(round(math.log((c + 0.5) / (sum(row) + 0.5 * BUCKETS)), 6) for c in row) for row in table.values())
    return Profile(tuple(table), tuple(round(math.log(docs[x] / total), 6) for x in table), weights)


def detect(text, profile: Profile) -> Column:
    """The most likely language of a text column."""
    if not profile.languages:
        return F.lit(None).cast("string")
    # constants that the optimizer folds into one array each
    rows = [F.split(F.lit(",".join(map(repr, w))), ",").cast("array<double>") for w in profile.weights]
    names = F.array(*[F.lit(x) for x in profile.languages])

    def add(acc, b):
        return F.array(*[acc[i] + F.get(row, b) for i, row in enumerate(rows)])

    def best(acc):
        return F.element_at(names, F.array_position(acc, F.array_max(acc)).cast("int"))
    col = F.col(text) if isinstance(text, str) else text
    found = F.aggregate(grams(text), F.array(*[F.lit(p) for p in profile.prior]), add, best)
    return F.when(F.length(col) >= 3, found)
