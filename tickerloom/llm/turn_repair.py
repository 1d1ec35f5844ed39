"""Conversation structure repair: cheapest edits that make roles alternate and remove faulty turns.

Every turn becomes one of 16 symbols: role class (system, user, assistant, other, by initial) times first fault (none,
truncated, blank, duplicate).  A grammar of Re-Pair rules is learnt over the symbol sequences of all conversations: in each
round Spark counts the adjacent pairs, and the most frequent ones that share no symbol become rules.  Each rule has one
min-plus transfer matrix between the four states of ``(s?(ua)+)?`` whose entries carry a cost and an audit
rope; matrices are made bottom-up, once, and shared by all conversations.  A conversation is then the product of its few remaining
symbols.

Ties go to the ASCII-least audit.  Audits of one span from one state to different states always differ and none is a prefix
of another (each ends in the letter of its last turn and has as many of those as the span has turns), so a rank of the four
entries of a row decides every tie of the products built on it: ropes are never compared, only joined.

The rules are bounded by ``max_rules``; what they leave uncompressed costs more products, never another result.

Defined cases: null role and text are one space; null conversation ids are one conversation; null turns come first; rows of one turn
go by role, then by md5 of role and text; of repeated rows all but the first are duplicates; an empty table gives no rows; other columns
are not read.  Equal role and text are told by 128-bit md5.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickerloom.llm import arrays as A
from tickerloom.llm.exchange import buckets, stored
from tickerloom.llm.ordered import Batches, arrow_schema, tuples

SPACES = " \t\n\v\f\r"
STATES, ACCEPTING = 4, (0, 3)  # 0: nothing yet, 1: after s, 2: after u, 3: after a
KEEP, REROLE, DELETE, INSERT = (0, "K"), (3, "R"), (4, "D"), (3, "I")
TRUNCATED_COST = 3
FAULTS = ("none", "truncated", "blank", "duplicate")
FIRST = ord("A")  # symbols are written as the letters A to P
BASE = 16
MAX_RULES, ROUNDS, PAIRS_A_ROUND = 512, 12, 64
SEGMENT = 1 << 20
CACHED = 20_000

_AFTER = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
_LEGAL = np.zeros((4, 4), bool)
for _p in ("su", "ua", "au"):
    _LEGAL["sua".index(_p[0]), "sua".index(_p[1])] = True


# ---- the algebra ---------------------------------------------------------------------------------------------


def _inserts() -> dict:
    """(cost, letters) of the cheapest insertions alone, by pair of states."""
    best = {(i, i): (0, "") for i in range(STATES)}
    for _ in range(STATES):
        for (i, k), (cost, letters) in list(best.items()):
            for after in (_AFTER["u"], _AFTER["a"]):
                if k in after:
                    best[i, after[k]] = min(best.get((i, after[k]), (99, "")), (cost + INSERT[0], letters + INSERT[1]))
    return best


def _turn(symbol: int) -> dict:
    """(cost, letters) of one turn with insertions before it, by pair of states."""
    role, fault = divmod(symbol, 4)
    own = {(i, i): DELETE for i in range(STATES)}
    if FAULTS[fault] in ("none", "truncated"):
        more = TRUNCATED_COST if FAULTS[fault] == "truncated" else 0
        moves = [(REROLE, _AFTER["u"]), (REROLE, _AFTER["a"])] + ([(KEEP, _AFTER["sua"[role]])] if role < 3 else [])
        for (cost, letter), after in moves:
            for i, j in after.items():
                own[i, j] = min(own.get((i, j), (99, "")), (cost + more, letter))
    out: dict = {}
    for (i, k), (a, x) in _inserts().items():
        for (k2, j), (b, y) in own.items():
            if k == k2:
                out[i, j] = min(out.get((i, j), (99, "")), (a + b, x + y))
    return out


class Matrices:
    """Transfer matrices of symbols and rules: cost, audit rope and the rank of a row's entries among themselves.

    A rope is a number: below ``len(letters)`` a leaf, else a pair of ropes.
    """

    def __init__(self, rules: list[tuple[int, int]]):
        self.letters, self.joined = [""], []
        self.of: list[list[list[tuple[int, int, int] | None]]] = []
        plain = [_turn(s) for s in range(BASE)]
        leaves: dict[str, int] = {"": 0}
        for m in plain:
            for _, x in m.values():
                if x not in leaves:
                    leaves[x] = len(self.letters)
                    self.letters.append(x)
        for m in plain:
            rows = []
            for i in range(STATES):
                place = {j: r for r, j in enumerate(sorted((j for k, j in m if k == i), key=lambda j: m[i, j][1]))}  # noqa: B023
                rows.append([(m[i, j][0], leaves[m[i, j][1]], place[j]) if (i, j) in m else None for j in range(STATES)])
            self.of.append(rows)
        for a, b in rules:
            self.of.append([self.step(row, self.of[b]) for row in self.of[a]])
        self.ending = _inserts()

    def join(self, a: int, b: int) -> int:
        if not a or not b:
            return a or b
        self.joined.append((a, b))
        return len(self.letters) + len(self.joined) - 1

    def step(self, row: list, matrix: list) -> list:
        """The row vector times the matrix; of equal costs the one of least rank, of entries through one state the matrix's rank."""
        best = []
        for j in range(STATES):
            found = [(e[0] + matrix[k][j][0], e[2], matrix[k][j][2], k) for k, e in enumerate(row) if e and matrix[k][j]]
            best.append(min(found) if found else None)
        place = {x[1:3]: r for r, x in enumerate(sorted((x for x in best if x), key=lambda x: x[1:3]))}
        return [(x[0], self.join(row[x[3]][1], matrix[x[3]][j][1]), place[x[1:3]]) if x else None for j, x in enumerate(best)]

    def audit(self, rope: int) -> str:
        out, todo, leaves = [], [rope], len(self.letters)
        while todo:
            r = todo.pop()
            if r < leaves:
                out.append(self.letters[r])
            else:
                a, b = self.joined[r - leaves]
                todo += (b, a)
        return "".join(out)

    def solve(self, symbols: np.ndarray) -> tuple[int, str]:
        """(cost, audit) of a compressed sequence; ropes made on the way are dropped again."""
        kept = len(self.joined)
        row: list = [(0, 0, 0), None, None, None]
        for s in symbols.tolist():
            row = self.step(row, self.of[s])
        ends = [(e[0] + self.ending[k, j][0], e[2], self.ending[k, j][1], k) for k, e in enumerate(row) if e for j in ACCEPTING if (k, j) in self.ending]
        cost, _, letters, k = min(ends)
        audit = self.audit(row[k][1]) + letters
        del self.joined[kept:]
        return cost, audit


# ---- the grammar ---------------------------------------------------------------------------------------------


def _matches(x: np.ndarray, a: int, b: int) -> np.ndarray:
    """Starts of disjoint occurrences of the pair, from the left."""
    at = np.flatnonzero((x[:-1] == a) & (x[1:] == b))
    if a != b or at.size < 2:
        return at
    new = np.concatenate(([True], np.diff(at) != 1))
    run = at[new][np.cumsum(new) - 1]
    return at[(at - run) % 2 == 0]


def compressed(x: np.ndarray, rules: list[tuple[int, int]]) -> np.ndarray:
    """The sequence after all rules in turn; -1 separates sequences."""
    for k, (a, b) in enumerate(rules):
        at = _matches(x, a, b)
        if at.size:
            x = x.copy()
            x[at] = BASE + k
            x = np.delete(x, at + 1)
    return x


def _symbols(texts: list[str]) -> np.ndarray:
    x = np.frombuffer("\n".join(texts).encode(), np.uint8).astype(np.int32) - FIRST
    x[x < 0] = -1
    return x


def _pair_counts(rules: list[tuple[int, int]]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], int] = {}
        for batch in batches:
            for part in A.slices(batch, "symbols"):
                texts, weights = part.column("symbols").to_pylist(), np.asarray(part.column("n").to_pylist(), np.int64)
                x = compressed(_symbols(texts), rules)
                if x.size < 2:
                    continue
                owner = np.cumsum(x == -1)
                pair = np.where((x[:-1] >= 0) & (x[1:] >= 0), x[:-1].astype(np.int64) << 32 | x[1:], -1)
                same = (x[:-1] == x[1:]) & (pair >= 0)
                # of a run of one symbol only every other pair can be replaced
                new = same & ~np.concatenate(([False], same[:-1]))
                place = np.arange(pair.size)
                begun = np.maximum.accumulate(np.where(new, place, 0))
                valid = (pair >= 0) & ~(same & ((place - begun) % 2 == 1))
                kinds, inverse = np.unique(pair[valid], return_inverse=True)
                counts = np.zeros(kinds.size, np.int64)
                np.add.at(counts, inverse, weights[owner[:-1][valid]])
                for k, c in zip(kinds.tolist(), counts.tolist(), strict=True):
                    key = (k >> 32, k & 0xFFFFFFFF)
                    total[key] = total.get(key, 0) + c
        if total:
            a, b = zip(*total, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int32()), pa.array(b, pa.int32()), pa.array(list(total.values()), pa.int64())], names=["a", "b", "n"])

    return run


def learn(sequences: DataFrame, max_rules: int = MAX_RULES, rounds: int = ROUNDS) -> list[tuple[int, int]]:
    """Re-Pair rules (left, right) over all ``symbols``, weighted by ``n``; rule k is symbol ``BASE + k``."""
    rules: list[tuple[int, int]] = []
    for _ in range(rounds):
        counts = sequences.mapInArrow(_pair_counts(rules), "a int, b int, n long").groupBy("a", "b").agg(F.sum("n").alias("n")).filter("n > 1")
        seen: set[int] = set()
        for a, b, _ in counts.orderBy(F.desc("n"), "a", "b").limit(PAIRS_A_ROUND).collect():
            if len(rules) < max_rules and not {a, b} & seen:
                rules.append((a, b))
                seen |= {a, b}
        if not seen or len(rules) >= max_rules:
            break
    return rules


# ---- turns and sequences ---------------------------------------------------------------------------------------


def _first_fault(text: Column) -> Column:
    """The fault of a turn by its text alone: 0 none, 1 truncated, 2 blank."""
    ended = F.rtrim(text, F.lit(SPACES))
    return F.when(ended == "", 2).when(F.right(ended, F.lit(1)).isin(".", "!", "?"), 0).otherwise(1)


def _role_class(role: Column) -> Column:
    initial = F.left(role, F.lit(1))
    return F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)


def plain(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) without nulls in role and text."""
    return turns.select("conv_id", "turn", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")])


def _print(role: str = "role", text: str = "text") -> Column:
    return F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"))


def _letter(symbol: Column) -> Column:
    return F.char(symbol + FIRST)


def _segments(schema: pa.Schema) -> Callable:
    """Joins the symbols of a conversation's rows, already in order, into strings of bounded length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        place = TaskContext.get().partitionId() << 32
        out, key, begun, held, size = Batches(schema), None, False, [], 0
        for conv, symbols in tuples(batches):
            if begun and (conv != key or size >= SEGMENT):
                yield from out.add((key, place, "".join(held)), size)
                place, held, size = place + 1, [], 0
            key, begun = conv, True
            held.append(symbols)
            size += len(symbols)
        if begun:
            yield from out.add((key, place, "".join(held)), size)
        yield from out.flush()

    return run


def sequences(turns: DataFrame) -> DataFrame:
    """(conv_id, symbols, gaps) of each conversation: one letter a turn, in order, and the numbers its turns leave out."""
    rows = turns.select("conv_id", "turn", "role", _first_fault(F.col("text")).alias("fault"), _print().alias("print"))
    # equal rows meet before any shuffle, so a turn repeated without end is one row a task
    rows = rows.groupBy("conv_id", "turn", "print").agg(F.count(F.lit(1)).alias("n"), F.first("role").alias("role"), F.first("fault").alias("fault"))
    rows = stored(rows)
    order = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    firsts = rows.groupBy(F.col("conv_id").alias("c"), F.col("print").alias("p")).agg(F.min(order).alias("first"))
    met = rows.join(firsts, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("print") == F.col("p")))
    role = _role_class(F.col("role")) * 4
    again = _letter(role + F.when(F.col("fault") == 2, 2).otherwise(3))
    first = F.when(F.col("turn").eqNullSafe(F.col("first.turn")), _letter(role + F.col("fault"))).otherwise(again)
    met = met.select("conv_id", "turn", "role", "print", F.concat(first, F.repeat(again, (F.col("n") - 1).cast("int"))).alias("symbols"))
    by = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role"), F.col("print")]
    dealt = met.repartitionByRange(buckets(turns.sparkSession), *by).sortWithinPartitions(*by).select("conv_id", "symbols")
    schema = T.StructType([dealt.schema["conv_id"], T.StructField("place", T.LongType()), T.StructField("part", T.StringType())])
    parts = dealt.mapInArrow(_segments(arrow_schema(schema)), schema)
    joined = parts.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("place", "part"))).alias("parts"))
    joined = joined.select("conv_id", F.array_join(F.col("parts.part"), "").alias("symbols"))
    wide = lambda f: f("turn").cast("decimal(38,0)")
    gaps = rows.groupBy(F.col("conv_id").alias("c")).agg(F.coalesce(wide(F.max) - wide(F.min) + 1 - F.count_distinct("turn"), F.lit(0)).cast("decimal(38,0)").alias("gaps"))
    gaps = gaps.withColumn("gaps", F.expr("try_cast(gaps as long)"))
    return joined.join(gaps, F.col("conv_id").eqNullSafe(F.col("c"))).drop("c")


def _solved(rules: list[tuple[int, int]], schema: pa.Schema) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrices, out = Matrices(rules), Batches(schema)
        known: OrderedDict[str, tuple] = OrderedDict()
        for conv, symbols, gaps in tuples(batches, "symbols"):
            result = known.get(symbols)
            if result is None:
                x = _symbols([symbols])
                role = x >> 2
                result = tuple(int((x % 4 == f).sum()) for f in (2, 3, 1)) + (int((~_LEGAL[role[:-1], role[1:]]).sum()),) + matrices.solve(compressed(x, rules))
                if len(symbols) < 100:
                    known[symbols] = result
                    if len(known) > CACHED:
                        known.popitem(last=False)
            yield from out.add((conv, gaps, *result), len(symbols))
        yield from out.flush()

    return run


RESULT = [(n, T.LongType()) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")] + [("audit", T.StringType())]


def audits(turns: DataFrame, max_rules: int = MAX_RULES) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit) of each conversation of ``plain`` turns.

    ``audit`` has one letter an edit, in order: Keep, Rerole, Delete, Insert.
    """
    found = stored(sequences(turns))
    rules = learn(found.groupBy("symbols").agg(F.count(F.lit(1)).alias("n")), max_rules)
    schema = T.StructType([found.schema["conv_id"], *[T.StructField(n, t) for n, t in RESULT]])
    return found.select("conv_id", "symbols", "gaps").mapInArrow(_solved(rules, arrow_schema(schema)), schema)


# ---- the repaired turns --------------------------------------------------------------------------------------


def _edited(schema: pa.Schema) -> Callable:
    class Walk:
        """The edits of one conversation against its turns as they come."""

        def __init__(self, conv, audit: str):
            self.conv, self.audit, self.at, self.state, self.place = conv, audit, 0, 0, 0

        def emit(self, role: str, text: str, edit: str) -> tuple:
            self.state = _AFTER[role[0]][self.state]
            self.place += 1
            return (self.conv, self.place - 1, role, text, edit)

        def wanted(self) -> str:
            return "assistant" if self.state == 2 else "user"

        def inserts(self) -> Iterator[tuple]:
            while self.at < len(self.audit) and self.audit[self.at] == "I":
                self.at += 1
                yield self.emit(self.wanted(), "", "I")

        def turn(self, role: str, text: str) -> Iterator[tuple]:
            yield from self.inserts()
            edit = self.audit[self.at]
            self.at += 1
            if edit != "D":
                yield self.emit(role if edit == "K" else self.wanted(), text, edit)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, walk = Batches(schema), None
        for conv, head, audit, role, text in tuples(batches, "text"):
            if head:
                for row in walk.inserts() if walk else ():
                    yield from out.add(row)
                walk = Walk(conv, audit)
            else:
                for row in walk.turn(role, text):
                    yield from out.add(row, len(text))
        for row in walk.inserts() if walk else ():
            yield from out.add(row)
        yield from out.flush()

    return run


def repaired(turns: DataFrame, found: DataFrame) -> DataFrame:
    """(conv_id, place, role, text, edit): the turns after the edits of ``found`` (``audits`` of the same turns), in order inside a partition.

    A conversation passes through one task as a sorted stream: its audit is one cell, its turns are never gathered.
    """
    empty = lambda kind: F.lit(None).cast(kind)
    rows = turns.select("conv_id", F.lit(False).alias("head"), "turn", "role", _print().alias("print"), empty("string").alias("audit"), "text")
    heads = found.select("conv_id", F.lit(True).alias("head"), empty(turns.schema["turn"].dataType).alias("turn"), empty("string").alias("role"), empty("string").alias("print"), "audit", empty("string").alias("text"))
    by = [F.col("conv_id"), F.col("head").desc(), F.col("turn").asc_nulls_first(), F.col("role"), F.col("print")]
    dealt = rows.unionByName(heads).repartition("conv_id").sortWithinPartitions(*by).select("conv_id", "head", "audit", "role", "text")
    kinds = [("place", T.LongType()), ("role", T.StringType()), ("text", T.StringType()), ("edit", T.StringType())]
    schema = T.StructType([dealt.schema["conv_id"], *[T.StructField(n, t) for n, t in kinds]])
    return dealt.mapInArrow(_edited(arrow_schema(schema)), schema)
