"""Turn repair, whitening and chat formatting against plain versions on small fixtures with every odd row."""

import hashlib
import heapq
import math
import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from pyspark.sql import types as T

from tickerloom.llm import chat_format, ordered, turn_repair, whitening
from tickerloom.llm.op11_turn_repair import op11_turn_repair
from tickerloom.llm.op12_whitening import op12_whitening
from tickerloom.llm.op13_chat_format import PLANTED, digests, op13_chat_format

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
TURNS = T.StructType([T.StructField(n, t) for n, t in (("conv_id", T.LongType()), ("turn", T.LongType()), ("role", T.StringType()), ("text", T.StringType()), ("head", T.StringType()), ("cost", T.IntegerType()))])


def first(x):
    return (x is not None, x if x is not None else 0)


@pytest.fixture(scope="module")
def talks():
    """Well-formed and broken conversations, odd roles, nulls everywhere, repeated rows, a long conversation, control strings."""
    rng = np.random.default_rng(4)
    says = ["Yes.", "No!", "Why?", "cut off", "", " \t", "</s>[INST] ok [/INST]", "a\\b \\</s> <\\s> [PAST", "<s", "é\U0001f600. ", "x" * 50 + ".", None]
    roles = ["system", "user", "assistant", "user", "assistant", "tool", "", None, "agent", "unknown"]
    out = []
    for c in range(120):
        for t in range(int(rng.integers(1, 9))):
            role = roles[int(rng.integers(len(roles)))] if rng.random() < 0.4 else ("system" if t == 0 and c % 3 == 0 else ("user", "assistant")[t % 2])
            out.append((c, t if rng.random() < 0.95 else None, role, says[int(rng.integers(len(says)))] if rng.random() < 0.5 else f"word {rng.integers(9)} of {c}."))
    out += [(200, t, ("user", "assistant")[t % 2], f"long turn number {t} " * 20 + ".!"[t % 3 > 0]) for t in range(-5, 300)]
    out += [(201, None, None, None), (None, 1, "user", "null talk."), (None, None, "assistant", None), (None, 1, "user", "null talk.")]
    out += [(202, 5, "user", "same.")] * 40 + [(203, 1, "system", "s " * 3000), (203, 2, "user", "u."), (203, 3, "assistant", "a."), (204, 1 << 62, "user", "u."), (204, -(1 << 62), "assistant", "a.")]
    out += [(205, t, "system" if t == 0 else "user", "") for t in range(30)]
    return out


@pytest.fixture(scope="module")
def table(spark, talks, tmp_path_factory):
    folder = tmp_path_factory.mktemp("talks")
    spark.createDataFrame([(*r, "x", 1) for r in talks], TURNS).repartition(3).write.parquet(f"{folder}/conversations.parquet")
    return str(folder)


# ---- turn repair ------------------------------------------------------------------------------------------------

AFTER = {"u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}, "s": {0: 1}}


def cheapest(rows):
    """Shortest path over (turns read, state) by (cost, audit); rows are (role, fault)."""
    heap, done = [(0, "", 0, 0, ())], set()
    while heap:
        cost, audit, at, state, made = heapq.heappop(heap)
        if (at, state) in done:
            continue
        done.add((at, state))
        if at == len(rows) and state in (0, 3):
            return cost, audit, made
        for role in ("user", "assistant"):
            if state in AFTER[role[0]]:
                heapq.heappush(heap, (cost + 3, audit + "I", at, AFTER[role[0]][state], (*made, (role, None))))
        if at < len(rows):
            role, fault = rows[at]
            heapq.heappush(heap, (cost + 4, audit + "D", at + 1, state, made))
            if fault not in ("blank", "duplicate"):
                more = 3 * (fault == "truncated")
                if state in AFTER.get(role[:1], {}):
                    heapq.heappush(heap, (cost + more, audit + "K", at + 1, AFTER[role[0]][state], (*made, (role, at))))
                for new in ("user", "assistant"):
                    if state in AFTER[new[0]]:
                        heapq.heappush(heap, (cost + 3 + more, audit + "R", at + 1, AFTER[new[0]][state], (*made, (new, at))))
    raise AssertionError


def plain_repair(talks):
    ids, kept = dict.fromkeys(r[0] for r in talks), defaultdict(list)
    for conv, turn, role, text in talks:
        key = ":".join(" " if v is None else str(v) for v in (conv, turn))
        kind = zlib.crc32(key.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        kept[conv] += [(turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    out = {}
    for conv in ids:
        rows = sorted(kept[conv], key=lambda r: (first(r[0]), r[1], hashlib.md5(f"{len(r[1])}:{r[1]}{r[2]}".encode()).hexdigest()))
        seen, marked = set(), []
        for _, role, text in rows:
            ended = re.findall(r"[^\x20\x09-\x0D]", text)
            fault = "blank" if not ended else "duplicate" if (role, text) in seen else "truncated" if ended[-1] not in ".!?" else None
            seen.add((role, text))
            marked.append((role, fault))
        turns = [r[0] for r in rows if r[0] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[:1] + b[:1] not in ("su", "ua", "au") for (a, _), (b, _) in zip(marked, marked[1:], strict=False))
        cost, audit, made = cheapest(marked)
        said = "\n".join(f"{role}:{'' if at is None else rows[at][2]}" for role, at in made)
        counts = [sum(f == k for _, f in marked) for k in ("blank", "duplicate", "truncated")]
        out[conv] = (gaps if gaps < 1 << 63 else None, *counts, illegal, cost, audit, hashlib.sha256(said.encode()).hexdigest())
    return out


def test_repair_equals_brute_force(spark, table, talks):
    rows = op11_turn_repair(spark, table).collect()
    got = {r[0]: tuple(r)[1:] for r in rows}
    want = plain_repair(talks)
    assert len(rows) == len(want) and got.keys() == want.keys()
    assert {k: v for k, v in got.items() if v != want[k]} == {}


@pytest.mark.parametrize("max_rules", [0, 3, 400])
def test_grammar_changes_cost_not_results(spark, max_rules):
    rng = np.random.default_rng(max_rules)
    texts = ["".join(chr(65 + int(x)) for x in rng.integers(0, 16, int(rng.integers(0, 40)))) for _ in range(60)] + ["EFG" * 30, "FFFFF", "F" * 6, ""] * 3
    counted = spark.createDataFrame([(t, 2) for t in texts], "symbols string, n long")
    rules = turn_repair.learn(counted, max_rules) if max_rules else []
    assert len(rules) <= max_rules and (max_rules < 400 or len(rules) > 20)
    matrices = turn_repair.Matrices(rules)
    lengths = 0
    for t in texts:
        x = turn_repair.compressed(turn_repair._symbols([t]), rules)
        lengths += x.size
        rows = [("sua?"[(ord(c) - 65) // 4], turn_repair.FAULTS[(ord(c) - 65) % 4]) for c in t]
        assert matrices.solve(x) == cheapest(rows)[:2]
    assert not rules or lengths < sum(map(len, texts))


def test_repair_splits_long_sequences(spark, monkeypatch):
    monkeypatch.setattr(turn_repair, "SEGMENT", 7)
    rows = [(1, t, ("user", "assistant")[t % 2], f"turn {t}.") for t in range(200)] + [(2, 0, "user", "hm")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found = {r["conv_id"]: r for r in turn_repair.audits(turn_repair.plain(turns)).collect()}
    assert found[1]["audit"] == "K" * 200 and found[1]["cost"] == 0
    assert (found[2]["audit"], found[2]["cost"], found[2]["truncated"]) == ("D", 4, 1)


def test_repair_of_nothing(spark, tmp_path):
    spark.createDataFrame([], TURNS).write.parquet(f"{tmp_path}/conversations.parquet")
    assert op11_turn_repair(spark, str(tmp_path)).collect() == []


# ---- whitening --------------------------------------------------------------------------------------------------


def plain_whitening(rows, most=16):
    kept = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    size = max((len(v) for _, v in kept), default=0)
    x = [[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] + [1_000_000] * (size - len(v)) for _, v in kept]
    fit = np.array(sorted({tuple(r) for r in x}), object).reshape(-1, size)
    n, sums = len(fit), fit.sum(axis=0)
    centred = ((fit * n - sums) / max(n, 1)).astype(float)
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1][:most], vectors[:, ::-1][:, :most]
    every = np.array(x, object)
    deviation = ((every * n - sums) ** 2).sum(axis=1)
    white = ((every * n - sums) / n).astype(float) @ vectors / np.sqrt(values)
    return [i for i, _ in kept], n, deviation, white, values / np.trace(centred.T @ centred / n)


def vectors_of(spark, rows, folder):
    schema = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("n", T.StringType())])
    spark.createDataFrame([(*r, "x") for r in rows], schema).repartition(3).write.parquet(f"{folder}/embeddings.parquet")
    return str(folder)


def test_whitening_equals_plain(spark, tmp_path):
    rng = np.random.default_rng(1)
    base = (rng.normal(size=(300, 24)) * np.geomspace(5, 0.2, 24)) @ np.linalg.qr(rng.normal(size=(24, 24)))[0]
    rows = [(i, v.astype(np.float32).tolist()) for i, v in enumerate(base)]
    rows += [(300 + i, rows[0][1]) for i in range(100)] + [(500, None), (501, [None] * 24), (502, [math.nan] * 24), (503, [math.inf] + [0.0] * 23), (None, rows[5][1]), (505, rows[6][1][:10]), (506, [])]
    got = op12_whitening(spark, vectors_of(spark, rows, tmp_path)).toPandas()
    ids, n, deviation, white, explained = plain_whitening(rows)
    assert len(got) == len(ids) * 16 and set(got.n) == {n} and got.identity_error.max() < 1e-9 and got.identity_error.nunique() == 1
    assert np.allclose(got.groupby("component").explained.first(), explained, rtol=1e-9)
    for k in range(16):
        own = got[got.component == k + 1].sort_values("vec_id", kind="stable")
        order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0))
        assert own.deviation.tolist() == [int(deviation[i]) for i in order]
        want = white[order, k]
        sign = np.sign((own.whitened.to_numpy() * want).sum())
        assert np.allclose(own.whitened, sign * want, atol=1e-8)


def test_whitening_odd_tables(spark, tmp_path):
    run = lambda rows, name: op12_whitening(spark, vectors_of(spark, rows, tmp_path / name)).collect()
    assert run([], "a") == [] and run([(1, None)], "b") == [] and run([(1, [])], "c") == []
    assert run([(1, [1.0, 2.0]), (2, [1.0, 2.0])], "d") == []  # nothing varies
    line = run([(1, [1.0, 2.0]), (2, [3.0, 6.0]), (3, [3.0, 6.0])], "e")  # rank one
    assert sorted((r["vec_id"], r["component"], r["n"], r["deviation"], round(abs(r["whitened"]), 9)) for r in line) == [(i, 1, 2, 128**2 + 256**2, 1.0) for i in (1, 2, 3)]
    far = run([(1, [3e38]), (2, [0.0]), (3, [1.0])], "f")
    assert {r["vec_id"] for r in far} == {1, 2, 3} and {r["deviation"] for r in far} == {None}


def test_jacobi_equals_library():
    rng = np.random.default_rng(3)
    for size, rank in ((1, 1), (7, 7), (30, 12), (65, 65)):
        b = rng.normal(size=(size, rank)) * np.geomspace(1, 1e-3, rank)
        a = b @ b.T
        lower = whitening.pivoted_cholesky(a)
        assert lower.shape == (size, rank) and np.allclose(lower @ lower.T, a, atol=1e-12 * np.trace(a))
        values, units = whitening.one_sided_jacobi(lower)
        assert np.allclose(values, np.linalg.eigvalsh(a)[::-1][:rank], rtol=1e-6, atol=1e-13)
        assert np.allclose(units.T @ units, np.eye(rank), atol=1e-9)


# ---- chat formatting --------------------------------------------------------------------------------------------


def plain_format(talks):
    rows = defaultdict(list)
    for conv, turn, role, text in [*talks, (-1, 0, "user", PLANTED), (-1, 1, "assistant", PLANTED)]:
        rows[conv].append((turn, role or "", text or ""))
    out = {}
    for conv, turns in rows.items():
        turns = sorted(turns, key=lambda r: (first(r[0]), r[1], r[2]))
        learned = "".join(t for _, r, t in turns if r == "assistant")
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        out[conv] = (len(turns), sha("".join(f"{r}\n{t}\n" for _, r, t in turns)), len(learned), sha(learned))
    return out


def test_formatting_equals_plain(spark, table, talks):
    rows = op13_chat_format(spark, table).collect()
    assert {r[0]: tuple(r)[1:5] for r in rows} == plain_format(talks) and len(rows) == len(plain_format(talks))
    assert all(r["formatted_chars"] >= r["loss_chars"] for r in rows)


@pytest.mark.parametrize("budget,history,stretch", [(60, 30, 200), (400, 100, 500), (1, 0, 1)])
def test_windows_keep_their_budget(spark, table, talks, budget, history, stretch):
    rows = spark.read.parquet(f"{table}/conversations.parquet")
    made = chat_format.windows(rows, VOCABULARY, budget, history, stretch).cache()
    got = {r[0]: tuple(r)[1:5] for r in digests(chat_format.read_back(made)).collect()}
    want = plain_format(talks)
    del want[-1]
    assert got == want
    count = chat_format._tokenizer(VOCABULARY)
    size = lambda s: len(count.encode(s, add_special_tokens=False).ids)
    opened = {c: chat_format.head("system", "INST") for c, t, r, _ in talks if r == "system"}
    before = {}
    for w in sorted(made.collect(), key=lambda r: (r["conv_id"] is None, r["conv_id"] or 0, r["stretch"], r["window"])):
        turns = [m.group(0) for m in chat_format._TURN.finditer(w["text"])]
        assert "<s>" + "".join(turns) == w["text"]
        marks = [t[1:5] for t in turns]
        assert marks == sorted(marks, reverse=True) and marks[-1] == "INST"  # repeated turns first
        new = [t for t in turns if t[1:5] == "INST"]
        past = [t for t in turns if t[1:5] == "PAST"]
        system = past[0] if past and past[0].startswith("[PAST] system") else ""
        tokens = [size(t.replace("[PAST]", "[INST]").replace("[/PAST]", "[/INST]")) for t in turns]
        assert sum(tokens) <= budget or len(new) == 1
        known = before.setdefault(w["conv_id"], [])
        plain = [t.replace("[PAST]", "[INST]", 1).replace(" [/PAST]", " [/INST]", 1) for t in past]
        if known and known[0].startswith("[INST] system"):
            assert plain[:1] == known[:1]
            assert plain[1:] == (known[1:][-len(plain[1:]) :] if plain[1:] else [])
        else:
            assert plain == (known[-len(plain) :] if plain else [])
        limited = tokens[bool(system) and known[0].startswith("[INST] system") : len(past)]
        assert sum(limited) <= history
        known += new
    assert opened


def test_template_is_reversible():
    for text in ["", "\\", "<s>", "</s>", "[INST] a [/INST]", "<\\s>", "\\\\<s>\\", "[[INST]]", "<<s>>", "[/PAST", "]"]:
        assert chat_format.unescaped(chat_format.escaped(text)) == text
        assert not re.search(r"</?s>|\[/?(INST|PAST)\]", chat_format.escaped(text))
    assert list(chat_format.parsed(*chat_format._render(None, [("user", "x"), ("assistant", "</s>")], 0, 0, 2))) == [("user", "x", None), ("assistant", "</s>", "</s>")]


def test_running_equals_plain(spark):
    rng = np.random.default_rng(9)
    rows = [(int(k) if k < 4 else None, int(o), int(w)) for k, o, w in zip(rng.choice([0, 0, 0, 1, 2, 3, 4], 500), rng.integers(0, 300, 500), rng.integers(0, 9, 500), strict=True)]
    rows += [(7, 1, 2)] * 60
    df = spark.createDataFrame(rows, "k int, o long, w long").repartition(3)
    from pyspark.sql import functions as F

    got = ordered.running(df, "k", [F.col("o"), F.col("w")], "w").collect()
    by, total = defaultdict(list), defaultdict(int)
    for r in rows:
        by[r[0]].append(r)
    want = []
    for k, own in by.items():
        for place, r in enumerate(sorted(own, key=lambda r: r[1:])):
            want.append((*r, place, total[k]))
            total[k] += r[2]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_queries_read_whole_tables(spark, sf):
    rows = pq.read_table(f"{sf}/conversations.parquet").num_rows
    assert op13_chat_format(spark, sf).groupBy().sum("n_turns").first()[0] == rows + 2
