r"""Chat formatting: conversations as training windows of a token budget, with a loss mask, and back.

A window is ``<s>`` and turns.  A turn to be learned from once is ``[INST] role [/INST]text</s>``; one repeated for context is
``[PAST] role [/PAST]text</s>``.  A backslash inside a control string (after its first character) and doubled
backslashes keep texts and roles apart from the template; ``unescaped`` undoes both.

How windows are chosen: every turn's tokens are counted, prefix sums give each turn its place in its conversation
(``ordered.running``, so a conversation may lie on many tasks), and each stretch of ``stretch`` tokens is cut by
searching the prefix sums: the leading system turn, then the longest run of earlier turns within ``history``
tokens, then as many new turns as the budget still holds.  Spans are turn-aligned; a turn longer than the budget has a
window of its own beside the system turn.  The loss mask covers the text of new assistant turns only: repeated targets are masked.

Defined cases: a null role or text is empty; null conversation ids are one conversation; null turns come first; rows of one turn go by role and
text; repeated rows are turns of their own; an empty table gives no windows; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickerloom.llm import arrays as A
from tickerloom.llm.ordered import Batches, arrow_schema, running, tuples

BUDGET, HISTORY, STRETCH = 2048, 512, 1 << 16
COUNTED_CHARS = 1 << 16  # longer turns are counted in pieces of so many characters

BEGIN, END = "<s>", "</s>"
_CONTROL = re.compile(r"([<\[])(?=/?s>|/?INST\]|/?PAST\])")
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)
_TURN = re.compile(r"\[(INST|PAST)\] (.*?) \[/\1\](.*?)</s>", re.DOTALL)
_TOKENIZERS: dict[str, object] = {}


def escaped(text: str) -> str:
    return _CONTROL.sub(r"\1\\", text.replace("\\", "\\\\"))


def unescaped(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def head(role: str, mark: str) -> str:
    return f"[{mark}] {escaped(role)} [/{mark}]"


def _tokenizer(path: str):
    if path not in _TOKENIZERS:
        from tokenizers import Tokenizer

        _TOKENIZERS[path] = Tokenizer.from_file(path)
    return _TOKENIZERS[path]


def _counted(vocabulary: str, role: int, text: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(vocabulary)
        for batch in batches:
            for part in A.slices(batch, "text"):
                counts = []
                for r, t in zip(part.column(role).to_pylist(), part.column(text).to_pylist(), strict=True):
                    turn = head(r, "INST") + escaped(t) + END
                    counts.append(sum(len(tokenizer.encode(turn[i : i + COUNTED_CHARS], add_special_tokens=False).ids) for i in range(0, len(turn), COUNTED_CHARS)))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(counts, pa.int64())], names=[*part.schema.names, "tokens"])

    return run


def counted(rows: DataFrame, vocabulary: str) -> DataFrame:
    """(conv_id, turn, role, text) in their order with ``tokens`` of each turn as formatted, by the library of the vocabulary file."""
    return rows.mapInArrow(_counted(vocabulary, 2, 3), T.StructType([*rows.schema.fields, T.StructField("tokens", T.LongType())]))


def spans(tokens: list[int], own: int, system: int, budget: int, history: int) -> list[tuple[int, int, int]]:
    """(past, first, end) of each window over turns with ``tokens``: turns past:first are repeated, first:end are new.

    New turns start at ``own``; the turns before it are history only.  ``system`` tokens are needed in each window.
    """
    sums = np.concatenate(([0], np.cumsum(np.asarray(tokens, np.int64))))
    out, first = [], own
    while first < len(tokens):
        room = budget - system
        reach = max(0, min(history, room - tokens[first]))
        past = int(np.searchsorted(sums, sums[first] - reach, "left"))
        end = int(np.searchsorted(sums, sums[past] + room, "right")) - 1
        end = max(end, first + 1)
        out.append((past, first, end))
        first = end
    return out


def _render(system: tuple | None, turns: list[tuple], past: int, first: int, end: int) -> tuple[str, list[tuple[int, int]]]:
    parts, marks, size = [BEGIN], [], len(BEGIN)
    shown = [(*t, "PAST") for t in ([system] if system else []) + turns[past:first]] + [(*t, "INST") for t in turns[first:end]]
    for role, text, mark in shown:
        opening, body = head(role, mark), escaped(text)
        size += len(opening)
        if mark == "INST" and role == "assistant":
            marks.append((size, size + len(body)))
        parts += (opening, body, END)
        size += len(body) + len(END)
    return "".join(parts), marks


def _windows(schema: pa.Schema, budget: int, history: int) -> Callable:
    def cut(key: tuple, rows: list[tuple], out: Batches) -> Iterator[pa.RecordBatch]:
        """``rows``: (position, own, role, text, tokens) of one stretch, in order."""
        leading = rows[0] if rows[0][0] == 0 and rows[0][2] == "system" else None
        repeated = leading is not None and not leading[1]
        turns = rows[1:] if repeated else rows
        own = next((i for i, r in enumerate(turns) if r[1]), len(turns))
        tokens, plain = [r[4] for r in turns], [r[2:4] for r in turns]
        number = 0
        if leading is not None and not repeated:
            # the window that opens the conversation holds the system turn as a new turn; later ones repeat it and start their history behind it
            end = max(1, int(np.searchsorted(np.cumsum(tokens), budget, "right")))
            text, marks = _render(None, plain, 0, 0, end)
            yield from out.add((*key, number, text, marks), len(text))
            turns, tokens, plain, own, number = turns[1:], tokens[1:], plain[1:], end - 1, 1
        for past, first, end in spans(tokens, own, leading[4] if leading else 0, budget, history):
            text, marks = _render(leading[2:4] if leading else None, plain, past, first, end)
            yield from out.add((*key, number, text, marks), len(text))
            number += 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, held, key = Batches(schema), [], None
        for conv, stretch, *row in tuples(batches, "text"):
            if held and (conv, stretch) != key:
                yield from cut(key, held, out)
                held = []
            key = (conv, stretch)
            held.append(tuple(row))
        if held:
            yield from cut(key, held, out)
        yield from out.flush()

    return run


def windows(conversations: DataFrame, vocabulary: str, budget: int = BUDGET, history: int = HISTORY, stretch: int = STRETCH) -> DataFrame:
    """(conv_id, stretch, window, text, loss): the training windows of all conversations; ``loss`` has (start, end) in code points."""
    if history >= stretch:
        raise ValueError("a stretch must be longer than the history")
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    rows = conversations.select("conv_id", "turn", *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")])
    placed = running(rows, "conv_id", order, "tokens", lambda dealt: counted(dealt, vocabulary)).withColumn("stretch", F.expr(f"before div {stretch}"))
    opening = (F.col("position") == 0) & (F.col("role") == "system")
    columns = ["conv_id", "stretch", "position", "own", "role", "text", "tokens"]
    later = (F.col("before") + history >= (F.col("stretch") + 1) * stretch) & ~opening
    homes = F.when(later, F.array(F.struct(F.col("stretch").alias("s"), F.lit(True).alias("own")), F.struct((F.col("stretch") + 1).alias("s"), F.lit(False).alias("own"))))
    homes = homes.otherwise(F.array(F.struct(F.col("stretch").alias("s"), F.lit(True).alias("own"))))
    own = placed.withColumn("home", F.explode(homes)).withColumns({"stretch": F.col("home.s"), "own": F.col("home.own")}).select(*columns)
    # the system turn goes to every later stretch of a long conversation
    long = placed.filter("stretch > 0").groupBy(F.col("conv_id").alias("id")).agg(F.max("stretch").alias("last"))
    leading = placed.filter(opening).join(long, F.col("conv_id").eqNullSafe(F.col("id")))
    leading = leading.withColumn("stretch", F.explode(F.sequence(F.lit(1), "last"))).withColumn("own", F.lit(False)).select(*columns)
    dealt = own.unionByName(leading).repartition("conv_id", "stretch").sortWithinPartitions("conv_id", "stretch", "position")
    pair = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    schema = T.StructType([dealt.schema["conv_id"], T.StructField("stretch", T.LongType()), T.StructField("window", T.IntegerType()), T.StructField("text", T.StringType()), T.StructField("loss", T.ArrayType(pair))])
    return dealt.mapInArrow(_windows(arrow_schema(schema), budget, history), schema)


def parsed(text: str, loss: list[tuple[int, int]]) -> Iterator[tuple[str, str, str | None]]:
    """(role, text, learned) of each new turn of a window, from its characters and mask only; ``learned`` is the text under the mask."""
    masks = iter([*loss, None])
    mask = next(masks)
    for turn in _TURN.finditer(text):
        learned = None
        if mask is not None and turn.start(3) <= mask[0] and mask[1] <= turn.end(3):
            learned = unescaped(text[mask[0] : mask[1]])
            mask = next(masks)
        if turn[1] == "INST":
            yield unescaped(turn[2]), unescaped(turn[3]), learned
        elif learned is not None:
            raise ValueError("a repeated turn lies under the loss mask")
    if mask is not None:
        raise ValueError("the loss mask covers more than the text of a turn")


def _read(schema: pa.Schema) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Batches(schema)
        for conv, stretch, window, text, loss in tuples(batches, "text"):
            for k, turn in enumerate(parsed(text, [(x["start"], x["end"]) for x in loss])):
                yield from out.add((conv, stretch, window, k, *turn, 0 if k else len(text)), len(turn[1]))
        yield from out.flush()

    return run


def read_back(formatted: DataFrame) -> DataFrame:
    """(conv_id, stretch, window, number, role, text, learned, chars): the turns, in order inside their conversation's partition.

    ``learned`` is null outside the loss mask; ``chars``, the window's length, stands on its first new turn, else 0.
    """
    dealt = formatted.select("conv_id", "stretch", "window", "text", "loss").repartition("conv_id").sortWithinPartitions("conv_id", "stretch", "window")
    kinds = [("stretch", T.LongType()), ("window", T.IntegerType()), ("number", T.IntegerType()), ("role", T.StringType()), ("text", T.StringType()), ("learned", T.StringType()), ("chars", T.LongType())]
    schema = T.StructType([dealt.schema["conv_id"], *[T.StructField(n, t) for n, t in kinds]])
    return dealt.mapInArrow(_read(arrow_schema(schema)), schema)
