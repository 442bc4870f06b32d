"""Built-in text encoder, query expansion and pair scorer.

The default encoder is a hashed bag of words: word tokens (lower-cased,
split on anything that is not a letter or digit, all tokens), each hashed
with md5 into one of ``dim`` buckets, counts L2-normalised. Token and bucket
computation are JVM column expressions; only the dense bucket count runs in
an Arrow kernel (one ``bincount`` per batch). Any other encoder (a
sentence model, say) plugs in through ``papyra.functions.plugins``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as Ty

from papyra.functions import vectors as V

ENCODER_DIM = 256
TOKEN_SPLIT = r"[^\p{L}\p{N}]+"

# The query-expansion dictionary (term -> added text), in order.
EXPANSIONS = [
    ("transformer", "transformer attention mechanism self-attention"),
    ("transformers", "transformer attention mechanism self-attention"),
    ("neural network", "neural network deep learning artificial intelligence"),
    ("neural networks", "neural network deep learning artificial intelligence"),
    ("ml", "machine learning"),
    ("ai", "artificial intelligence"),
    ("cnn", "convolutional neural network image recognition"),
    ("rnn", "recurrent neural network sequential data"),
    ("lstm", "long short-term memory network recurrent"),
    ("gru", "gated recurrent unit network"),
    ("gnn", "graph neural network node classification"),
    ("bert", "bert transformer language model nlp"),
    ("gpt", "gpt generative pre-trained transformer language model"),
    ("nlp", "natural language processing text analysis"),
    ("cv", "computer vision image recognition visual"),
    ("rl", "reinforcement learning agent policy"),
    ("gan", "generative adversarial network image generation"),
    ("vae", "variational autoencoder generative model"),
    ("attention", "attention mechanism self-attention cross-attention"),
    ("classification", "classification prediction supervised learning"),
    ("regression", "regression prediction supervised learning"),
    ("clustering", "clustering unsupervised learning grouping"),
    ("detection", "object detection localization bounding box"),
    ("segmentation", "image segmentation pixel-level classification"),
]
ORIGINAL_WEIGHT = 0.7
EXPANDED_WEIGHT = 0.3
TITLE_WEIGHT = 0.4
ABSTRACT_WEIGHT = 0.6


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def tokens(text) -> Column:
    parts = F.split(F.lower(F.coalesce(_c(text), F.lit(""))), TOKEN_SPLIT)
    return F.filter(parts, lambda t: t != "")


def buckets(text, dim: int = ENCODER_DIM, max_tokens: int | None = None) -> Column:
    def bucket(t):
        return F.pmod(F.conv(F.substring(F.md5(t), 1, 8), 16, 10).cast("bigint"), F.lit(dim))
    t = tokens(text)
    return F.transform(t if max_tokens is None else F.slice(t, 1, max_tokens), bucket)


def hash_encode(df: DataFrame, text_col: str, out_col: str = "vec", dim: int = ENCODER_DIM,
                max_tokens: int | None = None) -> DataFrame:
    """Append ``out_col`` (unit ``array<double>``; zero vector for blank text).
    All tokens count unless ``max_tokens`` sets a limit."""
    tmp = "_buckets"
    staged = df.withColumn(tmp, F.coalesce(buckets(text_col, dim, max_tokens),
                                           F.array().cast("array<bigint>")))
    fields = [f for f in staged.schema.fields if f.name != tmp]
    schema = Ty.StructType(fields + [Ty.StructField(out_col, Ty.ArrayType(Ty.DoubleType()))])
    return staged.mapInArrow(V.bucket_count_kernel(tmp, dim, out_col), schema)


def word_grams(text) -> Column:
    """Single-space tokens of the lower-cased text and their adjacent pairs.
    (Lambdas only touch their own arguments, so each row is split once.)"""
    toks = F.split(F.lower(F.coalesce(_c(text), F.lit(""))), " ", -1)
    n = F.size(toks)
    pairs = F.zip_with(F.slice(toks, 1, n - 1), F.slice(toks, 2, n - 1),
                       lambda a, b: F.concat(a, F.lit(" "), b))
    return F.concat(toks, pairs)


def matched_expansions(text) -> Column:
    """Dictionary expansions whose term occurs as a whole space-delimited
    word (or word pair) of the query, in dictionary order."""
    terms = F.array(*[F.lit(t) for t, _ in EXPANSIONS])
    lookup = F.create_map(*[x for t, e in EXPANSIONS for x in (F.lit(t), F.lit(e))])
    hit = F.array_intersect(terms, word_grams(text))        # keeps dictionary order
    return F.transform(hit, lambda t: F.element_at(lookup, t))


def expand_query(text) -> Column:
    q = F.coalesce(_c(text), F.lit(""))
    exp = matched_expansions(q)
    return F.when(F.size(exp) > 0, F.concat_ws(" ", q, F.array_join(exp, " "))).otherwise(q)


def overlap_score(query, text) -> Column:
    """Default pair scorer: share of the query's distinct tokens found in the
    text (0 when the query has none)."""
    qt = F.array_distinct(tokens(query))
    return F.round(F.coalesce(F.try_divide(F.size(F.array_intersect(qt, tokens(text))).cast("double"),
                                           F.size(qt)), F.lit(0.0)), V.SCORE_DECIMALS)


def overlap_of_tokens(query_tokens, text_tokens) -> Column:
    """:func:`overlap_score` on already tokenised, de-duplicated inputs."""
    qt = _c(query_tokens)
    return F.round(F.coalesce(F.try_divide(F.size(F.array_intersect(qt, _c(text_tokens))).cast("double"),
                                           F.size(qt)), F.lit(0.0)), V.SCORE_DECIMALS)


def rerank_text(title, abstract, chars: int = 500) -> Column:
    return F.concat_ws(" ", F.coalesce(_c(title), F.lit("")),
                       F.left(F.coalesce(_c(abstract), F.lit("")), F.lit(chars)))
