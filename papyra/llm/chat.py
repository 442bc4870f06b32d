"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example: all turns before it are context and
only its own text is trainable. ``format_turns`` gives one row per turn with its
formatted segment and its place in the formatted conversation; ``examples`` expands
them: an example is the whole text of the prefix that ends with an assistant segment
and the span of it that is trained on. The expansion grows with the square of a
conversation's length; it is a stream within the tasks that formatted the turns,
without another shuffle, in batches of bounded size.

Template: ``<|im_start|>ROLE\\nTEXT<|im_end|>\\n``. Texts are escaped so that no
control string can come from them: a backslash is put into every ``<``,
backslashes, ``|`` run, and taken out again by ``unescape``. Roles are escaped
the same way, with their backslashes and line breaks escaped first.

Cases: null text or role is empty; a null ``conv_id`` is one conversation of
its own; turns are ordered by (turn, role, text), null turns first, and
repeated rows stay repeated; a conversation without assistant turns has no
example but keeps its turns; an empty table gives an empty result. Columns
other than conv_id, turn, role, text are ignored.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, END, TARGET = "<|im_start|>", "<|im_end|>", "assistant"
_ESCAPE, _UNESCAPE = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")

TURNS = "conv_id long, pos long, segment string, seg_start long, seg_end long, " \
        "example long, loss_start long, loss_end long"


def escape(text: str) -> str:
    return _ESCAPE.sub(r"<\1\\|", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"<\1|", text)


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role), flags=re.S)


def format_turns(conversations: DataFrame) -> DataFrame:
    """One row per turn: ``segment`` is its formatted text, [seg_start, seg_end)
    its place in the formatted conversation (code points). An assistant turn
    carries its example number and the loss span. One shuffle by conversation;
    a task keeps only counters, however long a conversation is."""
    turns = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    ordered = turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def run(batches):
        import pyarrow as pa

        conv, pos, at, example = object(), 0, 0, 0
        for b in batches:
            out: list[list] = [[] for _ in range(8)]
            cols = b.to_pydict()
            for c, role, text in zip(cols["conv_id"], cols["role"], cols["text"]):
                if c != conv:
                    conv, pos, at, example = c, 0, 0, 0
                head, body = f"{START}{escape_role(role)}\n", escape(text)
                segment = f"{head}{body}{END}\n"
                hit = role == TARGET
                for col, v in zip(out, (c, pos, segment, at, at + len(segment), example if hit else None,
                                        at + len(head) if hit else None,
                                        at + len(head) + len(body) if hit else None)):
                    col.append(v)
                pos, at, example = pos + 1, at + len(segment), example + hit
            kinds = [pa.int64(), pa.int64(), pa.string(), *[pa.int64()] * 5]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds)],
                                             names=[f.split()[0] for f in TURNS.split(", ")])
    return ordered.mapInArrow(run, TURNS)


EXAMPLES = "conv_id long, example long, context_turns long, text_chars long, loss_start long, loss_end long, text string"
EXAMPLE_CHARS = 4 << 20         # text in one batch of examples, one example at least


def examples(turns: DataFrame) -> DataFrame:
    """One row per assistant turn, in order within its conversation: ``text`` is the formatted
    turns up to and with this one, of which only [loss_start, loss_end) is trained on. The
    rows of ``format_turns`` stand together and in order; a task keeps the prefix of one
    conversation."""
    def run(batches):
        import pyarrow as pa

        kinds = [*[pa.int64()] * 6, pa.string()]
        conv, prefix, rows, size = object(), [], [], 0

        def batch():
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows)) or [()] * len(kinds), kinds)],
                                              names=[f.split()[0] for f in EXAMPLES.split(", ")])
        for b in batches:
            for c, pos, segment, example, lo, hi in zip(*(b.column(i).to_pylist() for i in range(b.num_columns))):
                if c != conv or not pos:
                    conv, prefix = c, []
                prefix.append(segment)
                if example is None:
                    continue
                text = "".join(prefix)
                prefix = [text]
                rows.append((c, example, pos, len(text), lo, hi, text))
                size += len(text)
                if size >= EXAMPLE_CHARS:
                    yield batch()
                    rows, size = [], 0
        yield batch()
    return turns.select("conv_id", "pos", "segment", "example", "loss_start", "loss_end").mapInArrow(run, EXAMPLES)


def materialize(turns: DataFrame) -> DataFrame:
    """The full text of every example with its loss span, for export."""
    return examples(turns).select("conv_id", "example", "loss_start", "loss_end", "text")


def read_segment(segment: str) -> tuple[str, str]:
    """Role and text of a formatted turn."""
    head, _, rest = segment[len(START):].partition("\n")
    if not segment.startswith(START) or not rest.endswith(f"{END}\n"):
        raise ValueError("not a formatted turn")
    return unescape_role(head), unescape(rest[:-len(END) - 1])


TURN_DIGEST = "conv_id long, n_turns long, turns_sha256 string, chars long"
EXAMPLE_DIGEST = "conv_id long, loss_chars long, loss_sha256 string, formatted_chars long, n_examples long"


def _by_conversation(rows: DataFrame, columns: list[str], start, step, schema: str) -> DataFrame:
    """One row per conversation from rows that stand together and in order: ``step``
    takes the state of ``start()`` forward row by row, so nothing of a conversation
    is kept; the state's hashes become hex digests."""
    def run(batches):
        import pyarrow as pa

        names = [f.split()[0] for f in schema.split(", ")]
        kinds = [{"long": pa.int64(), "string": pa.string()}[f.split()[1]] for f in schema.split(", ")]
        done, state, conv = [], None, None

        def close():
            if state is not None:
                done.append((conv, *(x if isinstance(x, int) else x.hexdigest() for x in state)))

        def batch():
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(list(zip(*done)) or [()] * len(kinds), kinds)],
                                              names=names)
        for b in batches:
            for c, *row in zip(*(b.column(i).to_pylist() for i in range(b.num_columns))):
                if state is None or c != conv:
                    close()
                    conv, state = c, start()
                step(state, *row)
            if len(done) >= 2000:
                yield batch()
                done.clear()
        close()
        yield batch()
    return rows.select("conv_id", *columns).mapInArrow(run, schema)


def _read_turn(state, segment, end):
    role, text = read_segment(segment)
    state[0] += 1
    state[1].update(f"{role}\n{text}\n".encode())
    state[2] = end


def _read_example(state, text, lo, hi):
    kept = unescape(text[lo:hi])
    state[0] += len(kept)
    state[1].update(kept.encode())
    state[2] += len(text)
    state[3] += 1


def digest(turns: DataFrame) -> DataFrame:
    """Digests per conversation, read back: the turns from the formatted segments; the loss
    and the size of the expanded training set from the whole texts of ``examples``, each
    under its own loss span. ``formatted_chars`` is the sum of all example
    lengths (without examples, the length of the turns). The rows of ``format_turns``
    are together and in order, so the hashes, which need the order, run over the stream."""
    read = _by_conversation(turns, ["segment", "seg_end"], lambda: [0, hashlib.sha256(), 0], _read_turn, TURN_DIGEST)
    learnt = _by_conversation(examples(turns), ["text", "loss_start", "loss_end"],
                              lambda: [0, hashlib.sha256(), 0, 0], _read_example, EXAMPLE_DIGEST)
    both = read.withColumnRenamed("conv_id", "c").join(learnt, F.col("c").eqNullSafe(F.col("conv_id")), "left")
    zero = F.lit(0).cast("long")
    return both.select(
        F.col("c").alias("conv_id"), "n_turns", "turns_sha256", F.coalesce("loss_chars", zero).alias("loss_chars"),
        F.coalesce("loss_sha256", F.lit(hashlib.sha256().hexdigest())).alias("loss_sha256"),
        F.coalesce("formatted_chars", "chars").alias("formatted_chars"), F.coalesce("n_examples", zero).alias("n_examples"))
