"""Benchmark decontamination by latent semantic retrieval.

Words are letter and digit runs (ASCII punctuation separates, A-Z and the accented
Latin-1 capitals are folded). Features are the words of the benchmark; idf counts
all rows. Passages are ``width`` words, every ``width / 2`` words, of every row, and
every ``width / 4`` words of every item. A randomised SVD of the TF-IDF matrix
of the rows' passages, with the items' passages weighted to equal their number, is
worked out in one pass: each task adds up its share of A'A Omega, and
the Nystroem form of that sketch gives the leading right singular vectors.
Passages whose cosine with a passage of an item in that space reaches ``cosine``
are candidates, unless their surroundings hold too few of the items' rarest words for
any item to reach ``lcs``, whatever their order (``rare_words``). ``energy`` can ask in addition that the
benchmark's words carry that share of the passage's TF-IDF norm; it is off (0), as
words that no item has weigh more the more rows there are. A pair goes on only if
enough of the item's words stand in the surroundings at all: that number is never
below the longest common subsequence, so this loses no pair. A candidate stands if the
longest common subsequence of the item and the passage with its surroundings (an
item's length on both sides)
holds ``lcs`` of the item's words, and ``answer`` of the words of the item's
answer: its last sentence, or its last third if it has one sentence only.

The benchmark is small by nature: it is read into the driver, at most
``max_benchmark_bytes`` of text, an error beyond. Everything that grows with the
rows (token ids, counts, sketch, candidates, checks) stays in tasks; a task's
sketch has the size of vocabulary x rank, and the sketches are added in two rounds.

Cases: null or empty texts and items have no words and match nothing; repeated
rows or items are reported once per (row, item); null ids are carried; empty
tables give an empty result; text length is not limited; other columns do not
matter.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyra.llm.common import Staged, row_blocks, row_key, utf8_view, word_hashes, word_spans

SCHEMA = "doc_id long, item_id long, cosine double, lcs double, answer double"
SALTS, BLOCK_WORDS = 16, 128


@dataclass(frozen=True)
class Settings:
    width: int = 24
    rank: int = 128
    cosine: float = 0.5
    energy: float = 0.0
    lcs: float = 0.7
    answer: float = 0.6
    max_benchmark_bytes: int = 16 << 20


def _fold_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint8)
    for c in range(128):
        low = c + 32 if 65 <= c <= 90 else c
        t[c] = low if 48 <= low < 58 or 97 <= low < 123 else 32
    return t


FOLD = _fold_table()


def folded_words(arr) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of an Arrow string column, and the rows' offsets."""
    data, off = utf8_view(arr)
    out, count = [], [np.zeros(1, np.int64)]
    total = 0
    for i, j in row_blocks(off, 1 << 21):
        part = data[off[i]:off[j]]
        text = FOLD[part]
        if len(part) > 1:
            upper = np.flatnonzero((part[:-1] == 0xC3) & (part[1:] >= 0x80) & (part[1:] <= 0x9E) & (part[1:] != 0x97)) + 1
            text[upper] += 32
        bounds = off[i:j + 1] - off[i]
        starts, ends = word_spans(text, bounds)
        out.append(word_hashes(text, starts, ends))
        count.append(total + np.searchsorted(starts, bounds[1:]))
        total += len(starts)
    return np.concatenate(out) if out else np.zeros(0, np.uint64), np.concatenate(count)


def answer_of(text: str) -> str:
    sentences = [s for s in re.split(r"(?<=[.!?])\s+|\n+", text) if any(c.isalnum() for c in s)]
    return sentences[-1] if len(sentences) > 1 else ""


class Items:
    """The benchmark as numbers: vocabulary (sorted word hashes), items and
    answers as word numbers."""

    def __init__(self, benchmark: DataFrame, s: Settings):
        import pyarrow as pa

        size = benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        if size > s.max_benchmark_bytes:
            raise ValueError(f"the benchmark has {size} bytes of text; max_benchmark_bytes is {s.max_benchmark_bytes}")
        rows = sorted(((r.item_id, r.text) for r in benchmark.select(
            F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
            .distinct().collect() if r.text), key=repr)
        words, off = folded_words(pa.array([t for _, t in rows], pa.string()))
        self.vocab = np.unique(words)
        self.ids, self.items, self.answers = [], [], []
        ends, eoff = folded_words(pa.array([answer_of(t) for _, t in rows], pa.string()))
        for n, (item, _) in enumerate(rows):
            mine = np.searchsorted(self.vocab, words[off[n]:off[n + 1]])
            last = np.searchsorted(self.vocab, ends[eoff[n]:eoff[n + 1]])
            if len(mine):
                self.ids.append(item)
                self.items.append(mine)
                self.answers.append(last if len(last) else mine[-max(1, len(mine) // 3):])

    def passages(self, width: int) -> tuple[list[np.ndarray], np.ndarray]:
        out, item = [], []
        for n, w in enumerate(self.items):
            for a in range(0, max(1, len(w) - width + width // 4), width // 4):
                out.append(w[a:a + width])
                item.append(n)
        return out, np.array(item)


def tokens(docs: DataFrame, vocab: np.ndarray) -> DataFrame:
    """(doc_id, d, k, ids): each word's number in the vocabulary, -1 for others."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *row_key(), F.col("text").cast("string").alias("text"))

    def run(batches):
        import pyarrow as pa

        for b in batches:
            words, off = folded_words(b.column(3))
            at = np.minimum(np.searchsorted(vocab, words), len(vocab) - 1)
            ids = np.where(vocab[at] == words, at, -1).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), b.column(2),
                 pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(ids, pa.int32()))],
                names=["doc_id", "d", "k", "ids"])
    return rows.mapInArrow(run, "doc_id long, d long, k long, ids array<int>")


def _lists(column) -> tuple[np.ndarray, np.ndarray]:
    off = column.offsets.to_numpy().astype(np.int64)
    return column.values.to_numpy(zero_copy_only=False)[off[0]:off[-1]], off - off[0]


def document_counts(found: DataFrame, size: int) -> tuple[np.ndarray, int]:
    """Rows each word occurs in, and the number of rows."""
    def run(batches):
        import pyarrow as pa

        df, n = np.zeros(size, np.int64), 0
        for b in batches:
            ids, off = _lists(b.column(0))
            row = np.repeat(np.arange(len(off) - 1), np.diff(off))
            inside = ids >= 0
            words, row = ids[inside], row[inside]
            order = _by_word(words, size)
            words, row = words[order], row[order]       # rows ascend within a word
            new = np.ones(len(words), bool)
            new[1:] = (words[1:] != words[:-1]) | (row[1:] != row[:-1])
            df += np.bincount(words[new], minlength=size)
            n += len(off) - 1
        at = np.append(np.flatnonzero(df), -1)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(np.append(df, n)[at], pa.int64())],
                                         names=["w", "n"])
    rows = found.select("ids").mapInArrow(run, "w long, n long").groupBy("w").agg(F.sum("n").alias("n")).collect()
    df, n = np.zeros(size, np.int64), 0
    for r in rows:
        if r.w < 0:
            n = r.n
        else:
            df[r.w] = r.n
    return df, n


def _by_word(words: np.ndarray, size: int) -> np.ndarray:
    """Stable order by word number (small numbers take numpy's radix sort)."""
    return np.argsort(words.astype(np.uint16) if size < 1 << 16 else words, kind="stable")


def _grouped(ids: np.ndarray, off: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Blocks of ``step`` words of each row: (block of each word, first block of
    each row, blocks)."""
    size = np.diff(off)
    blocks = -(-size // step)
    first = np.concatenate([[0], np.cumsum(blocks)])
    place = np.arange(len(ids)) - np.repeat(off[:-1], size)
    return np.repeat(first[:-1], size) + place // step, first, int(first[-1])


def _sums(table: np.ndarray, rows: np.ndarray, group: np.ndarray, n: int, weight: np.ndarray | None = None,
          step: int = 1 << 12) -> np.ndarray:
    """Per group (ascending), the weighted sum of the given rows of ``table``."""
    out = np.zeros((n, table.shape[1]), np.float32)
    for i in range(0, len(rows), step):
        g, x = group[i:i + step], table[rows[i:i + step]]
        if weight is not None:
            x *= weight[i:i + step, None]
        cut = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
        out[g[cut]] += np.add.reduceat(x, cut, axis=0)
    return out


@dataclass(frozen=True)
class SparseRows:
    """Unit TF-IDF rows of passages: ``value`` at (``row``, ``word``), sorted by both."""
    row: np.ndarray
    word: np.ndarray
    value: np.ndarray
    n: int

    @staticmethod
    def of(passages: list[np.ndarray], idf: np.ndarray) -> SparseRows:
        row = np.repeat(np.arange(len(passages)), [len(w) for w in passages])
        key, times = np.unique(row * len(idf) + np.concatenate(passages), return_counts=True)
        row, word = key // len(idf), key % len(idf)
        value = times * idf[word]
        norm = np.sqrt(np.bincount(row, value * value, len(passages)))
        return SparseRows(row, word, (value / norm[row]).astype(np.float32), len(passages))

    def times(self, table: np.ndarray) -> np.ndarray:
        return _sums(table, self.word, self.row, self.n, self.value)

    def transposed_times(self, table: np.ndarray, size: int) -> np.ndarray:
        order = np.argsort(self.word, kind="stable")
        return _sums(table, self.row[order], self.word[order], size, self.value[order])


def sketch(found: DataFrame, idf: np.ndarray, omega: np.ndarray, width: int) -> tuple[np.ndarray, int]:
    """A'A Omega over all rows' passages (unit rows), and their number."""
    size, rank = omega.shape
    blocks = -(-size // BLOCK_WORDS)
    scaled = (omega * idf[:, None]).astype(np.float32)

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        total, count = np.zeros((blocks * BLOCK_WORDS, rank)), 0
        for b in batches:
            every, offs = _lists(b.column(0))
            for i, j in row_blocks(offs, 1 << 18):
                ids, off = every[offs[i]:offs[j]], offs[i:j + 1] - offs[i]
                group, _, n = _grouped(ids, off, width)
                inside = ids >= 0
                words, group = ids[inside], group[inside]
                square = np.bincount(group, (idf * idf)[words], n)
                y = _sums(scaled, words, group, n) / np.maximum(square, 1e-18).astype(np.float32)[:, None]
                order = _by_word(words, size)
                total[:size] += _sums(y, group[order], words[order], size)
                count += int((square > 0).sum())
        part = TaskContext.get().partitionId()
        total[:size] *= idf[:, None]
        for i in range(blocks):
            body = total[i * BLOCK_WORDS:(i + 1) * BLOCK_WORDS].tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([i]), pa.array([part % SALTS]), pa.array([count if i == 0 else 0]),
                                              pa.array([body], pa.binary())], names=["block", "salt", "n", "body"])

    def add(batches):
        import pyarrow as pa

        sums: dict = {}
        for b in batches:
            for block, salt, n, body in zip(*(b.column(i).to_pylist() for i in range(4))):
                x = sums.setdefault((block, salt), [0, np.zeros(BLOCK_WORDS * rank)])
                x[0] += n
                x[1] += np.frombuffer(body)
        for (block, salt), (n, x) in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([salt]), pa.array([n]),
                                              pa.array([x.tobytes()], pa.binary())], names=["block", "salt", "n", "body"])
    schema = "block long, salt long, n long, body binary"
    first = Staged(found.select("ids").mapInArrow(run, schema).repartition("block", "salt").mapInArrow(add, schema), "lsi-sketch")
    whole = first.df.withColumn("salt", F.lit(0).cast("long")).repartition("block").mapInArrow(add, schema).collect()
    first.drop()
    out, count = np.zeros((blocks * BLOCK_WORDS, rank)), 0
    for r in whole:
        out[r.block * BLOCK_WORDS:(r.block + 1) * BLOCK_WORDS] = np.frombuffer(r.body).reshape(BLOCK_WORDS, rank)
        count += r.n
    return out[:size], count


def basis(found: DataFrame, idf: np.ndarray, item_rows: SparseRows, s: Settings) -> np.ndarray:
    """Leading right singular vectors (vocabulary x rank) of the weighted matrix."""
    rank = min(s.rank, len(idf))
    omega = np.random.default_rng(11).standard_normal((len(idf), rank)).astype(np.float32)
    z, n = sketch(found, idf, omega, s.width)
    z = z + max(1.0, n / item_rows.n) * item_rows.transposed_times(item_rows.times(omega), len(idf))
    c = omega.T @ z
    value, vector = np.linalg.eigh((c + c.T) / 2)
    keep = value > value.max() * 1e-6
    left, _, _ = np.linalg.svd(z @ (vector[:, keep] / np.sqrt(value[keep])), full_matrices=False)
    return left.astype(np.float32)


def common_words(masks: dict[int, int], size: int, words: list[int]) -> int:
    """Length of the longest common subsequence, one bit a word of the item."""
    row = full = (1 << size) - 1
    for w in words:
        m = masks.get(w)
        if m:
            u = row & m
            row = ((row + u) | (row - u)) & full
    return size - row.bit_count()


def masks_of(words: np.ndarray) -> dict[int, int]:
    out: dict[int, int] = {}
    for i, w in enumerate(words.tolist()):
        out[w] = out.get(w, 0) | 1 << i
    return out


def rare_words(items: list[np.ndarray], df: np.ndarray, share: float, classes: int = 8, spare: int = 4):
    """(mark, longest, least) for classes of items of about equal length.

    An item that reaches ``share`` misses few of its words, so of its rarest words, as
    many as it may miss and ``spare`` more, at least ``spare`` stand in the surroundings,
    each in a place of its own. ``mark`` tells these words of a class's items (the place
    after the last stands for unknown words), ``longest`` is the longest item,
    ``least`` the number that the surroundings must hold."""
    out, length = [], np.array([len(w) for w in items])
    for part in np.array_split(np.argsort(length, kind="stable"), min(classes, len(items))):
        mark, least = np.zeros(len(df) + 1, bool), spare
        for q in part:
            need = int(np.ceil(share * length[q] - 1e-9))
            more = min(spare, need)
            mark[items[q][np.argsort(df[items[q]], kind="stable")[:length[q] - need + more]]] = True
            least = min(least, more)
        out.append((mark, int(length[part].max()), least))
    return out


class Reach:
    """Upper bound of the longest common subsequence: the words of an item that stand
    somewhere in a passage's surroundings (an item's length on both sides).

    A table of passages x vocabulary holds each word's distance from the passage; it
    has a fixed number of cells, and only cells that were written are cleared."""

    CELLS, FLAT = 1 << 24, 1 << 21

    def __init__(self, items: list[np.ndarray], size: int, width: int):
        self.length = np.array([len(w) for w in items])
        self.first = np.concatenate([[0], np.cumsum(self.length)])
        self.words = np.concatenate(items)
        self.size, self.width, self.longest = size, width, int(self.length.max())
        self.rows = max(1, min(4096, self.CELLS // size, self.FLAT // (width + 2 * self.longest)))
        self.table: np.ndarray | None = None            # made in the task

    def counts(self, ids: np.ndarray, lo: np.ndarray, hi: np.ndarray, word: np.ndarray, passage: np.ndarray,
               item: np.ndarray) -> np.ndarray:
        """For pairs (``passage`` ascending, ``item``); passage p starts at ``word[p]``
        of ``ids`` in a row that spans ``lo[p]`` to ``hi[p]``."""
        if self.table is None:
            self.table = np.full((self.rows, self.size), self.longest + 1, np.int32)
        used, at = np.unique(passage, return_inverse=True)
        out = np.zeros(len(passage), np.int64)
        for i in range(0, len(used), self.rows):
            w = word[used[i:i + self.rows]]
            a = np.maximum(lo[used[i:i + self.rows]], w - self.longest)
            n = np.minimum(hi[used[i:i + self.rows]], w + self.width + self.longest) - a
            p = np.repeat(np.arange(len(w)), n)
            pos = np.arange(len(p)) + np.repeat(a - np.concatenate([[0], np.cumsum(n)[:-1]]), n)
            known = ids[pos] >= 0
            p, pos = p[known], pos[known]
            far = np.maximum(np.maximum(w[p] - pos, pos - w[p] - self.width + 1), 0)
            order = _by_word(far, self.longest + 1)[::-1]       # the nearest is written last
            cell = p[order] * self.size + ids[pos[order]]
            flat = self.table.reshape(-1)
            flat[cell] = far[order]
            pairs = np.arange(*np.searchsorted(at, [i, i + self.rows]))
            step = max(1, self.FLAT // self.longest)
            for j in range(0, len(pairs), step):
                mine = pairs[j:j + step]
                n = self.length[item[mine]]
                begin = np.concatenate([[0], np.cumsum(n)[:-1]])
                x = np.arange(n.sum()) + np.repeat(self.first[item[mine]] - begin, n)
                near = flat[np.repeat((at[mine] - i) * self.size, n) + self.words[x]] <= np.repeat(n, n)
                out[mine] = np.add.reduceat(near.astype(np.int64), begin)
            flat[cell] = self.longest + 1
        return out


def contaminated(docs: DataFrame, benchmark: DataFrame, s: Settings = Settings()) -> DataFrame:
    """(doc_id, d, k, item_id, cosine, lcs, answer) of every row and item found."""
    spark = docs.sparkSession
    items = Items(benchmark, s)
    schema = "doc_id long, d long, k long, item_id long, cosine double, lcs double, answer double"
    if not items.ids:
        return spark.createDataFrame([], schema)
    found = Staged(tokens(docs, items.vocab), "lsi-tokens").df
    df, n = document_counts(found, len(items.vocab))
    idf = np.log((n + 1.0) / (df + 1.0)) + 1e-3
    passages, item_of = items.passages(s.width)
    rows = SparseRows.of(passages, idf)
    space = basis(found, idf, rows, s)
    queries = rows.times(space)
    queries /= np.maximum(np.linalg.norm(queries, axis=1, keepdims=True), 1e-9)
    latent = (space * idf[:, None]).astype(np.float32)
    square, rare = idf * idf, float(np.log(n + 1.0)) ** 2
    step = s.width // 2
    rarest = rare_words(items.items, df, s.lcs)
    masks = [(masks_of(w), len(w), masks_of(a), len(a)) for w, a in zip(items.items, items.answers)]
    names, ids_of = [f.split()[0] for f in schema.split(", ")], items.ids
    reach = Reach(items.items, len(idf), s.width)

    def candidates(ids: np.ndarray, off: np.ndarray):
        """(row, first word, item, cosine), best passage of an item each."""
        group, first, n = _grouped(ids, off, step)
        inside = ids >= 0
        row = np.repeat(np.arange(len(off) - 1), np.diff(first))
        size = np.diff(first)[row]
        last = np.arange(n) == first[row + 1] - 1
        start = np.flatnonzero(~last | (size == 1))         # a passage is two halves, or the only one
        second = np.where(size[start] > 1, start + 1, start)
        known = np.bincount(group[inside], square[ids[inside]], n)
        other = np.bincount(group[~inside], minlength=n) * rare
        mine, rest = known[start] + known[second], other[start] + other[second]
        told = (mine > 0) & (mine >= s.energy ** 2 * (mine + rest))
        start, second = start[told], second[told]
        at = row[start]
        word = off[at] + (start - first[at]) * step
        told = np.zeros(len(start), bool)
        for mark, longest, least in rarest:                 # no bound on the order: loses no pair
            upto = np.concatenate([[0], np.cumsum(mark[ids], dtype=np.int32)])
            told |= upto[np.minimum(off[at + 1], word + s.width + longest)] - upto[np.maximum(off[at], word - longest)] >= least
        start, second = start[told], second[told]
        used = np.zeros(n, bool)
        used[start] = used[second] = True
        place = np.cumsum(used) - 1
        inside &= used[group]
        half = _sums(latent, ids[inside], place[group[inside]], int(used.sum()))
        for i in range(0, len(start), 4096):
            a, b = start[i:i + 4096], second[i:i + 4096]
            x = half[place[a]] + half[place[b]]
            norm = np.linalg.norm(x, axis=1)
            cos = (x / np.maximum(norm, 1e-9)[:, None]) @ queries.T
            at, q = np.divmod(np.flatnonzero(cos >= s.cosine), len(queries))
            if len(at):
                key = at * len(ids_of) + item_of[q]
                order = np.lexsort((-cos[at, q], key))
                at, q, key = at[order], q[order], key[order]
                once = np.concatenate([[True], key[1:] != key[:-1]])
                at, q = at[once], q[once]
                r = row[a]
                most = reach.counts(ids, off[r], off[r + 1], off[r] + (a - first[r]) * step, at, item_of[q])
                told = most / reach.length[item_of[q]] >= s.lcs
                for p, c in zip(at[told].tolist(), q[told].tolist()):
                    yield int(r[p]), int((a[p] - first[r[p]]) * step), int(item_of[c]), float(cos[p, c])

    def run(batches):
        import pyarrow as pa

        kinds = [*[pa.int64()] * 4, *[pa.float64()] * 3]
        for b in batches:
            doc, d, k = (b.column(i).to_pylist() for i in range(3))
            every, offs = _lists(b.column(3))
            best: dict = {}
            for i, j in row_blocks(offs, 1 << 18):
                ids, off = every[offs[i]:offs[j]], offs[i:j + 1] - offs[i]
                for r, word, item, cos in candidates(ids, off):
                    mask, size, amask, asize = masks[item]
                    lo, hi = max(off[r], off[r] + word - size), min(off[r + 1], off[r] + word + s.width + size)
                    near = ids[lo:hi]
                    near = near[near >= 0].tolist()
                    lcs = common_words(mask, size, near) / size
                    if lcs >= s.lcs and lcs > best.get((i + r, item), (0, 0, 0))[1]:
                        answer = common_words(amask, asize, near) / asize
                        if answer >= s.answer:
                            best[i + r, item] = cos, lcs, answer
            rows_ = [(doc[r], d[r], k[r], ids_of[item], *v) for (r, item), v in sorted(best.items())]
            cols = list(zip(*rows_)) or [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, kinds)], names=names)
    return found.mapInArrow(run, schema)


def report(docs: DataFrame, benchmark: DataFrame, s: Settings = Settings()) -> DataFrame:
    return contaminated(docs, benchmark, s).select("doc_id", "item_id", "cosine", "lcs", "answer")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, s: Settings = Settings()) -> DataFrame:
    """``docs`` without the rows that hold an item; all columns stay."""
    bad = Staged(contaminated(docs, benchmark, s).select(F.col("d").alias("__d"), F.col("k").alias("__k")).distinct(),
                 "contaminated").df
    d, k = row_key()
    return docs.withColumns({"__d": d, "__k": k}).join(bad, ["__d", "__k"], "left_anti").select(*docs.columns)
