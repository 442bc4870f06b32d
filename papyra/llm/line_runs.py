"""Line deduplication with a suffix array over line ids.

Lines are the pieces of a text between line feeds; lines of spaces only are not
compared and stay. Every other line gets an id (128-bit hash); lines that
occur once break a text into runs of repeated lines. The suffixes of these runs
are sorted by prefix doubling: the rank of 2L lines is that of the pair (rank
of L lines, rank of the L lines after them), ranks are given by one range sort
of the distinct pairs, and doubling ends when no group splits any more. Common
prefixes of neighbours come from the ranks of all levels, from the longest down.
An interval of suffixes that share ``min_lines`` lines or more is a repeated run:
its first place, by (doc_id, line), stays and the lines of the others go. A line of
``min_words`` words or more is a run by itself. Shorter lines that documents share by
chance, with other lines around them, stay: stretches of repeated lines that are too
short to hold a run leave the array before it is sorted.

Every step is a join, aggregation or range sort on keys that spread; groups as
large as the table (one line in a third of all rows) are only counted, reduced
to their smallest place, or joined with one row each.

Cases: null text is empty and has no lines to compare; an empty text is one
blank line; a null id comes first; rows that repeat (same id, same text) count
as one document and get the same result; a repeat inside one document counts;
text length is not limited; an empty table gives an empty result; other columns
do not matter.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from papyra.llm.common import Staged, row_key

SCHEMA = "doc_id long, n_lines long, n_removed long, n_runs long, longest_repeat long, kept_sha256 string"
AT = ["d", "k", "i"]
MIN_LINES, MIN_WORDS = 2, 50
WORD = r"[^\x20\x09-\x0D]+"


def lines(docs: DataFrame, min_words: int) -> DataFrame:
    """(d, k, i, line, long, h1, h2) of the lines that are compared: ``i`` counts them,
    ``line`` is the number in the text; ``long`` lines are runs by themselves."""
    pieces = F.split(F.coalesce(F.col("text").cast("string"), F.lit("")), "\n")
    numbered = F.filter(F.transform(pieces, lambda x, n: F.struct(
        n.alias("line"), x.alias("x"))), lambda s: F.length(F.trim(s["x"])) > 0)
    return docs.select(*row_key(), F.posexplode(numbered).alias("i", "s")).select(
        "d", "k", "i", F.col("s.line").alias("line"), F.xxhash64("s.x").alias("h1"),
        F.xxhash64(F.lit(7), F.col("s.x")).alias("h2"),
        # no line has more words than half its length, rounded up: most need no count
        ((F.length("s.x") >= 2 * min_words - 1) & (F.regexp_count("s.x", F.lit(WORD)) >= min_words)).alias("long"))


def ranked(keys: DataFrame, cols: list[str]) -> Staged:
    """Distinct ``keys`` with a ``rank`` that grows with their order."""
    return Staged(keys.repartitionByRange(*cols).sortWithinPartitions(*cols)
                  .withColumn("rank", F.monotonically_increasing_id()), "line-ranks")


class SuffixArray:
    """``levels[j]``: (d, k, i, r), the rank of 2**j lines from each repeated line;
    ``last``: the ranks that no longer split; ``place``: (d, k, i, line, long, b), b the
    lines up to the break."""

    def __init__(self, docs: DataFrame, min_lines: int = MIN_LINES, min_words: int = MIN_WORDS):
        every = Staged(lines(docs, min_words), "lines")
        ids = Staged(every.df.groupBy("h1", "h2").agg(F.count("*").alias("n")).where("n > 1").select("h1", "h2"),
                     "line-ids")
        alphabet = ranked(ids.df, ["h1", "h2"])
        # one shuffle by row: repeated rows count once, then both windows find their rows in place
        found = every.df.join(alphabet.df, ["h1", "h2"]).select(*AT, "line", "long", F.col("rank").alias("r")) \
            .repartition("d", "k").dropDuplicates(AT)
        run, whole = W.partitionBy("d", "k").orderBy("i"), W.partitionBy("d", "k", "g")
        island = found.withColumn("g", F.col("i") - F.row_number().over(run))
        kept = island.withColumns({"b": F.max("i").over(whole) - F.col("i") + 1, "size": F.count("*").over(whole),
                                   "some": F.max("long").over(whole)}).where((F.col("size") >= min_lines) | F.col("some"))
        self.place = Staged(kept.select(*AT, "line", "long", "b", "r"), "line-breaks").df
        every.drop()
        ids.drop()
        self.levels, self.last = [self.place.select(*AT, "r")], alphabet
        groups, size = -1, alphabet.df.count()
        while size != groups:
            groups, length, now = size, 1 << (len(self.levels) - 1), self.levels[-1]
            after = now.select("d", "k", (F.col("i") - length).alias("i"), F.col("r").alias("r2"))
            pairs = Staged(now.join(after, AT, "left").select(*AT, "r", F.coalesce("r2", F.lit(-1)).alias("r2")), "line-pairs")
            keys = ranked(pairs.df.select("r", "r2").distinct(), ["r", "r2"])
            size = keys.df.count()
            if size != groups:
                self.levels.append(Staged(pairs.df.join(keys.df, ["r", "r2"]).select(*AT, F.col("rank").alias("r")),
                                          "line-level").df)
                self.last = keys
            pairs.drop()

    def groups(self) -> DataFrame:
        """(r, n, d, k, i, b): the groups of equal suffixes in order, with size,
        first place and lines up to the break."""
        final = self.levels[-1].join(self.place.select(*AT, "b"), AT)
        return final.groupBy("r").agg(F.count("*").alias("n"), F.min(F.struct(*AT, "b")).alias("s")).select("r", "n", "s.*")

    def common(self) -> Staged:
        """(r, lcp): lines that each group's suffixes share with the nearest others."""
        spark = self.place.sparkSession
        groups = Staged(self.groups(), "line-groups")
        ends = [tuple(x) for x in self.last.df.groupBy(F.shiftright("rank", 33).alias("p"))
                .agg(F.min("rank"), F.max("rank")).orderBy("p").collect()]       # one row a partition
        seams = spark.createDataFrame([(b[1], a[2]) for a, b in zip(ends, ends[1:])], "r long, seam long")
        before = groups.df.join(F.broadcast(seams), "r", "left").withColumn(
            "q", F.coalesce("seam", F.col("r") - 1)).drop("seam")
        other = groups.df.select(F.col("r").alias("q"), F.col("d").alias("qd"), F.col("k").alias("qk"), F.col("i").alias("qi"))
        pairs = Staged(before.join(other, "q").withColumn("off", F.lit(0)), "line-neighbours")
        for j in range(len(self.levels) - 1, -1, -1):
            mine = self.levels[j].select("d", "k", F.col("i").alias("pi"), F.col("r").alias("x"))
            theirs = self.levels[j].select(F.col("d").alias("qd"), F.col("k").alias("qk"), F.col("i").alias("ri"),
                                           F.col("r").alias("y"))
            grown = (pairs.df.withColumns({"pi": F.col("i") + F.col("off"), "ri": F.col("qi") + F.col("off")})
                     .join(mine, ["d", "k", "pi"], "left").join(theirs, ["qd", "qk", "ri"], "left")
                     .withColumn("off", F.when(F.col("x") == F.col("y"), F.least(F.col("off") + (1 << j), F.col("b")))
                                 .otherwise(F.col("off")).cast("int")).select(*pairs.df.columns))
            new = Staged(grown, "line-neighbours")
            pairs.drop()
            pairs = new
        sides = pairs.df.select("r", F.col("off").alias("lcp")).union(pairs.df.select("q", "off")).union(
            groups.df.select("r", F.when(F.col("n") > 1, F.col("b")).otherwise(0)))
        out = Staged(sides.groupBy("r").agg(F.max("lcp").cast("int").alias("lcp")), "line-lcp")
        pairs.drop()
        groups.drop()
        return out

    def intervals(self, min_lines: int) -> DataFrame:
        """(d, k, i, n, key): suffixes of ``min_lines`` lines or more and those that begin
        with a long line; equal keys are one interval of common prefix n or more (n is
        ``min_lines``, or 1 for a long line)."""
        j = min(min_lines.bit_length() - 1, len(self.levels) - 1)
        long = self.place.where(F.col("b") >= min_lines).select(*AT)
        keyed = long.join(self.levels[j], AT)
        rest, parts, at = min_lines - (1 << j), ["r"], 1 << j
        while rest > 0:                 # the remaining lines, overlapping if they must
            at = min(at, min_lines - (1 << j))
            name = f"r{len(parts)}"
            keyed = keyed.join(self.levels[j].select("d", "k", (F.col("i") - at).alias("i"), F.col("r").alias(name)), AT)
            parts.append(name)
            at += 1 << j
            rest = min_lines - at
        out = keyed.select(*AT, F.lit(min_lines).alias("n"), F.array(*parts).alias("key"))
        if min_lines == 1:
            return out
        single = self.place.where("long").select(*AT, F.lit(1).alias("n"), F.array("r").alias("key"))
        return out.unionByName(single)


def analyse(docs: DataFrame, min_lines: int = MIN_LINES, min_words: int = MIN_WORDS,
            longest: bool = True) -> tuple[DataFrame, DataFrame | None]:
    """(d, k, gone): line numbers that go; (d, k, longest), if asked for: the longest
    run a document shares with another place."""
    array = SuffixArray(docs, min_lines, min_words)
    suffixes = Staged(array.intervals(min_lines), "line-intervals").df
    first = Staged(suffixes.groupBy("n", "key").agg(F.min(F.struct(*AT)).alias("first")), "line-first").df
    later = suffixes.join(first, ["n", "key"]).where(F.struct(*AT) > F.col("first"))
    covered = later.select("d", "k", F.explode(F.sequence(F.col("i"), F.col("i") + F.col("n") - 1)).alias("i")).distinct()
    gone = Staged(covered.join(array.place.select(*AT, "line"), AT).groupBy("d", "k").agg(
        F.collect_list("line").alias("gone")), "line-gone").df
    if not longest:
        return gone, None
    runs = array.levels[-1].join(array.common().df, "r").join(array.place.select(*AT, "long"), AT)
    counts = (F.col("lcp") >= min_lines) | (F.col("long") & (F.col("lcp") > 0))
    return gone, Staged(runs.where(counts).groupBy("d", "k").agg(F.max("lcp").cast("long").alias("longest")), "line-longest").df


def kept_lines(text: str | None, gone: list[int] | None) -> tuple[list[str], list[str]]:
    every, out = (text or "").split("\n"), set(gone or ())
    return every, [x for n, x in enumerate(every) if n not in out]


def report(docs: DataFrame, min_lines: int = MIN_LINES, min_words: int = MIN_WORDS) -> DataFrame:
    """``SCHEMA`` per row: ``n_runs`` counts maximal stretches of removed lines."""
    gone, longest = analyse(docs, min_lines, min_words)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *row_key(), F.col("text").cast("string").alias("text"))
    joined = rows.join(gone.join(longest, ["d", "k"], "full"), ["d", "k"], "left").select("doc_id", "text", "gone", "longest")

    def run(batches):
        import pyarrow as pa

        kinds = [*[pa.int64()] * 5, pa.string()]
        for b in batches:
            out = [[] for _ in kinds]
            for doc, text, gone, most in zip(*(b.column(i).to_pylist() for i in range(4))):
                every, kept = kept_lines(text, gone)
                cut = sorted(gone or ())
                starts = sum(n == 0 or cut[n - 1] != x - 1 for n, x in enumerate(cut))
                for col, v in zip(out, (doc, len(every), len(cut), starts, most or 0,
                                        hashlib.sha256("\n".join(kept).encode()).hexdigest())):
                    col.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, kinds)],
                                             names=[f.split()[0] for f in SCHEMA.split(", ")])
    return joined.mapInArrow(run, SCHEMA)


def dedup_lines(docs: DataFrame, min_lines: int = MIN_LINES, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` without the later copies; ``n_chars`` follows the text if it is
    there, all other columns stay."""
    gone, _ = analyse(docs, min_lines, min_words, longest=False)
    d, k = row_key()
    pieces = F.split(F.col("text").cast("string"), "\n")
    cut = F.array_join(F.transform(F.filter(F.transform(pieces, lambda x, n: F.struct(n.alias("n"), x.alias("x"))),
                                            lambda s: ~F.array_contains("__gone", s["n"])), lambda s: s["x"]), "\n")
    marked = docs.withColumns({"__d": d, "__k": k}).join(
        gone.select(F.col("d").alias("__d"), F.col("k").alias("__k"), F.col("gone").alias("__gone")), ["__d", "__k"], "left")
    out = marked.withColumn("text", F.when(F.col("__gone").isNull(), F.col("text")).otherwise(cut))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("__gone").isNull(), F.col("n_chars")).otherwise(F.length("text"))
                             .cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)
