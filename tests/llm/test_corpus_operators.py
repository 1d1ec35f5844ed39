"""The corpus operators against plain versions on small fixtures with every odd row."""

import hashlib
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from tickerloom.llm import arrays, bpe, decontaminate, exchange, jaccard_join, licences, pieces, quality_fm, quality_rules, substrings, suffixes, token_files, toxicity

WORDS = r"[^\x20\x09-\x0D]+"
SCHEMA = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("chunk", T.StringType()), T.StructField("node", T.IntegerType()), T.StructField("score", T.DoubleType())]
)
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def sentence(rng, n):
    return " ".join("".join(rng.choice(list("abcdefgé"), rng.integers(2, 8))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    """Copies, near copies, shared passages, repeats inside a document, nulls, empties, a very long text, ties."""
    rng = np.random.default_rng(0)
    passage, base = sentence(rng, 40), sentence(rng, 120)
    out = []
    for i in range(30):
        out.append((i, sentence(rng, int(rng.integers(1, 200)))))
    for i in range(30, 45):  # near copies of one text
        w = base.split()
        w[int(rng.integers(len(w)))] = f"other{i}"
        out.append((i, " ".join(w)))
    for i in range(45, 60):  # a passage in texts of their own
        out.append((i, f"{sentence(rng, 30)}\n{passage}\t{sentence(rng, 30)}"))
    out += [(60 + k, out[k][1]) for k in range(8)]  # exact copies
    out += [(70, f"{passage} {passage} {passage}"), (71, "x " * 400), (72, "ab" * 3000), (73, " ".join(r[1] for r in out[:25]) * 3)]
    out += [(74, None), (75, ""), (76, " \n\t "), (77, "one two three"), (78, "One TWO three"), (79, "É é É é " * 30), (None, base), (80, passage.upper()), (3, out[3][1]), (3, out[3][1])]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, "c", 1, 0.5) for i, t in rows], SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def order(i):
    return (1 << 62) if i is None else i


def test_substrings_equal_brute_force(docs, rows, nothing, monkeypatch):
    monkeypatch.setattr("tickerloom.llm.exchange.CHUNK_BYTES", 3000)
    n = 20
    first = {}
    for i, t in rows:
        w = re.findall(WORDS, t or "")
        for p in range(len(w) - n + 1):
            key = tuple(w[p : p + n])
            first[key] = min(first.get(key, (order(i), p)), (order(i), p))
    expected = []
    for i, t in rows:
        w = re.findall(WORDS, t or "")
        gone = set()
        for p in range(len(w) - n + 1):
            if first[tuple(w[p : p + n])] < (order(i), p):
                gone |= set(range(p, p + n))
        expected.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    for start in (10, 5):
        got = [tuple(r) for r in substrings.deduplicate(docs, start=start).collect()]
        assert sorted(got, key=str) == sorted(expected, key=str)
    assert substrings.deduplicate(nothing).collect() == []


@pytest.mark.parametrize("hot", [2, 512])
def test_repeated_strings_equal_brute_force(docs, rows, nothing, monkeypatch, hot):
    monkeypatch.setattr(suffixes, "HOT", hot)
    n = 50
    raw = [(i, (t or "").encode()) for i, t in rows]
    first = {}
    for i, b in raw:
        for p in range(len(b) - n + 1):
            first[b[p : p + n]] = min(first.get(b[p : p + n], order(i)), order(i))
    expected = []
    for i, b in raw:
        gone = bytearray(len(b))
        for p in range(len(b) - n + 1):
            if first[b[p : p + n]] < order(i):
                gone[p : p + n] = b"\x01" * n
        spans = sum(1 for k in range(len(b)) if gone[k] and not (k and gone[k - 1]))
        expected.append((i, len(b), sum(gone), spans, bytes(x for x, g in zip(b, gone, strict=True) if not g)))
    got = [tuple(r)[:4] + (bytes(r.kept),) for r in suffixes.deduplicate(docs).collect()]
    assert sorted(got, key=str) == sorted(expected, key=str)
    assert suffixes.deduplicate(nothing).collect() == []


def test_merged_transforms_give_the_prefix_blocks():
    rng = np.random.default_rng(1)
    contents = [bytes(rng.integers(97, 99, rng.integers(60, 300)).astype(np.uint8)) + bytes(rng.integers(97, 123, 40).astype(np.uint8)) for _ in range(30)]
    contents += [b"ab" * 80, b"xx" + b"ab" * 70]
    docs = np.arange(len(contents))
    got = set(zip(*(x.tolist() for x in suffixes.late_windows(contents, docs, 20)), strict=True))
    first = {}
    for i, c in enumerate(contents):
        for p in range(len(c) - 19):
            first.setdefault(c[p : p + 20], i)
    assert got == {(i, p) for i, c in enumerate(contents) for p in range(len(c) - 19) if first[c[p : p + 20]] < i}


def shingles(t):
    w = re.findall(WORDS, re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


@pytest.mark.parametrize("frequent", [32, 2])
def test_components_equal_brute_force(docs, rows, nothing, monkeypatch, frequent):
    monkeypatch.setattr(jaccard_join, "FREQUENT", frequent)
    sets = [shingles(t) for _, t in rows]
    parent = [order(i) for i, _ in rows]
    changed = True
    links = [(a, b) for a in range(len(rows)) for b in range(a) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in links:
            low = min(parent[a], parent[b])
            changed |= parent[a] != low or parent[b] != low
            parent[a] = parent[b] = low
    expected = [(i, len(s), None if p == 1 << 62 else p) for (i, _), s, p in zip(rows, sets, parent, strict=True)]
    got = [tuple(r) for r in jaccard_join.components(docs).collect()]
    assert sorted(got, key=str) == sorted(expected, key=str)
    assert jaccard_join.components(nothing).collect() == []


@pytest.mark.parametrize("pack", [1 << 18, 1500])
def test_large_groups_are_compared_in_packs(spark, monkeypatch, pack):
    """Sets of one family, some linked, some not: all links are found, and pairs are not made signature by signature."""
    monkeypatch.setattr(jaccard_join, "PACK", pack)
    rng = np.random.default_rng(5)
    family = rng.integers(0, 2**64, 60, dtype=np.uint64)
    sets = []
    for k in range(90):
        own = rng.integers(0, 2**64, 12, dtype=np.uint64)
        sets.append(np.unique(np.concatenate((rng.choice(family, 40 + k % 17, replace=False), own[: k % 3]))))
    count = {t: sum(t in s for s in sets) for t in np.unique(np.concatenate(sets))}
    rows = [(k, k, k, int(s.size), int(s.size), k, bytearray(s.tobytes()), jaccard_join.signatures(s, np.array([count[t] for t in s])).view(np.int64).tolist()) for k, s in enumerate(sets)]
    nodes = spark.createDataFrame(rows, jaccard_join.NODE_SCHEMA)
    parent = list(range(len(sets)))
    for a in range(len(sets)):
        for b in range(a):
            both = np.intersect1d(sets[a], sets[b]).size
            if 100 * both >= 80 * (sets[a].size + sets[b].size - both):
                low, high = sorted((parent[a], parent[b]))
                parent = [low if p == high else p for p in parent]
    assert 1 < len(set(parent)) < len(sets)
    got = {k: k for k in range(len(sets))} | {r.node: r.component for r in jaccard_join.links(nodes).collect()}
    assert [got[k] for k in range(len(sets))] == parent

    index = nodes.selectExpr("node", "n", "explode(signatures) as sig")
    rows = index.join(index.groupBy("sig").count().selectExpr("sig", "count as size"), "sig").withColumn("c", F.col("node"))
    where = jaccard_join.regions(rows)
    assert where.count() == where.select("node").distinct().count() == len(sets)
    assert where.groupBy("pack").agg(F.count("*").alias("k")).agg(F.max("k")).first()[0] * jaccard_join.PACK_NODE <= 8 * pack
    assert where.select("pack").distinct().count() < len(sets)


def test_signatures_meet_for_every_linked_pair():
    """The prefix rule itself: sets at the border of the threshold share a signature, whatever is frequent."""
    rng = np.random.default_rng(2)
    for n in (1, 2, 5, 7, 8, 9, 10, 11, 20, 31, 32, 40, 41, 127, 128, 160, 161, 500, 640, 641, 2048):
        pool = np.unique(rng.integers(0, 2**64, 3 * n + 20, dtype=np.uint64))
        count = dict(zip(pool.tolist(), rng.choice([2, 20, 40, 900, 2000, 10**6], pool.size).tolist(), strict=True))
        a = np.sort(rng.choice(pool, n, replace=False))
        for m in range(int(np.ceil(0.8 * n)), n + 1):
            if m in (int(np.ceil(0.8 * n)), n) or rng.random() < 0.05:
                kept = rng.choice(a, m, replace=False)
                room = int(m / 0.8 - n) if m / 0.8 >= n else 0
                more = rng.choice(np.setdiff1d(pool, a), room, replace=False) if room else a[:0]
                b = np.sort(np.concatenate((kept, more)))
                alone = set(np.setxor1d(a, b)[::2].tolist())  # tokens of one set only may be in no other set at all
                s, t = (jaccard_join.signatures(x, np.array([1 if v in alone else count[v] for v in x.tolist()])) for x in (a, b))
                assert np.intersect1d(s, t).size, (n, m)


def test_decontamination(spark, nothing):
    item = " ".join(f"w{i}" for i in range(30))
    near = " ".join(f"w{i}" if i != 2 else "zz" for i in range(30))
    far = " ".join(f"w{i}" if i % 6 else "zz" for i in range(30))
    docs = spark.createDataFrame(
        [(1, "pre " * 500 + item.upper() + " post" * 500, "x"), (1, item, "x"), (2, f"a {near} b", "x"), (3, far, "x"), (4, None, "x"), (5, "", "x"), (6, "short one", "x"), (None, item, "x")], "doc_id long, text string, item_id string"
    )
    items = spark.createDataFrame([(9, item, 1), (9, item, 1), (8, None, 1), (7, "", 1), (6, "Short  ONE", 1)], "item_id long, text string, doc_id int")
    got = {(r.doc_id, r.item_id): (r.item_shingles, r.found) for r in decontaminate.contaminated(docs, items).collect()}
    assert got == {(1, 9): (26, 26), (2, 9): (26, 23), (None, 9): (26, 26), (6, 6): (1, 1)}
    assert decontaminate.contaminated(nothing, items).collect() == []
    assert decontaminate.contaminated(docs, items.limit(0)).collect() == []


def test_bpe_equals_the_library(docs, rows, nothing):
    library = Tokenizer.from_file(VOCABULARY)
    got = sorted(((r.doc_id, r.n_tokens, np.frombuffer(r.ids, "<u4").tolist(), r.decoded) for r in bpe.encode_and_decode(docs, VOCABULARY).collect()), key=str)
    expected = []
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        expected.append((i, len(ids), ids, library.decode(ids, skip_special_tokens=False)))
    assert got == sorted(expected, key=str)
    assert bpe.encode_and_decode(nothing, VOCABULARY).collect() == []


def test_bpe_on_odd_characters():
    library = Tokenizer.from_file(VOCABULARY)
    own = bpe.Bpe(open(VOCABULARY, encoding="utf-8").read())
    texts = ["a<|endoftext|>b  <|endoftext|>", "\r\n\t \x1c\x85 　x​", "日本語 ½²३ é 🎉", "I'll don't 'S", "a" * 5000, " " * 300 + "x", "\x00\x01"]
    texts += ["".join("a" + chr(k) for k in range(s, s + 500) if not 0xD800 <= k < 0xE000) for s in range(0, 0x20000, 500)]
    for t, p in zip(texts, own.encode_texts(texts), strict=True):
        assert np.frombuffer(p, "<u4").tolist() == library.encode(t, add_special_tokens=False).ids
        assert own.decode(p) == t


def test_token_files_round_trip(docs, rows, nothing):
    library = Tokenizer.from_file(VOCABULARY)
    got = sorted((tuple(r)[1:3] + (r.doc_id, zlib.crc32(r.ids)) for r in token_files.read_tokens(token_files.write_tokens(docs, VOCABULARY)).collect()), key=lambda r: r[0])
    ids = {}
    for i, t in rows:
        ids.setdefault(i, []).append(library.encode(t or "", add_special_tokens=False).ids + [0])
    start = 0
    for at, n, doc, crc in got:
        mine = [x for x in ids[doc] if len(x) == n and zlib.crc32(np.array(x, "<u4").tobytes()) == crc]
        assert at == start and mine
        start += n
    keys = [-1 if r[2] is None else r[2] for r in got]
    assert keys == sorted(keys) and len(got) == len(rows)
    assert token_files.read_tokens(token_files.write_tokens(nothing, VOCABULARY)).collect() == []


def test_token_blocks_and_checksums():
    rng = np.random.default_rng(3)
    for n in (0, 1, 4096, 9000):
        ids = np.where(rng.random(n) < 0.5, rng.integers(0, 65534, n), 7).astype(np.int32)
        data = token_files.write_segment(np.array([5]), np.array([n]), ids)
        assert (token_files.read_segment(data)[2] == ids).all()
    assert len(data) < 2 * 9000 * 0.9
    with pytest.raises(ValueError):
        token_files.read_segment(data[:-200] + bytes(x ^ 255 for x in data[-200:]))
    with pytest.raises(ValueError):
        token_files.read_segment(b"x" + data)


def test_pieces_by_bytes_equal_the_library():
    """Cuts by array operations against the library over whole texts: contractions, white space, added tokens, long pieces, zero bytes."""
    own, library = pieces.Pieces(open(VOCABULARY, encoding="utf-8").read()), Tokenizer.from_file(VOCABULARY)
    texts = ["", None, " ", "\n x", "it's 's 's's're'rest don'tx 'll'", "''s", "'", "a<|endoftext|>b  <|endoftext|>", "<|endoftext|>", "\r\n\t \x1c\x85\xa0\u3000x\u200b"]
    texts += ["x" * 15, "x" * 16, "x" * 14 + "\x00", "x" * 15 + "\x00", "a", "a\x00", "a" * 5000, " " * 300 + "x", "日本語 ½²३ é 🎉"]
    texts += ["".join("a" + chr(k) for k in range(s, s + 500) if not 0xD800 <= k < 0xE000) for s in range(0, 0x20000, 500)]
    rng, letters = np.random.default_rng(11), list("ab1 '  \n\tstrevmld!é\u3000\xa0\x85½'𝔸\x00")
    texts += ["".join(rng.choice(letters, rng.integers(0, 40))) for _ in range(3000)]
    for some in (texts, texts[::-1], [], [None]):
        ids, sizes = own.encode(*arrays.flat(pa.array(some, pa.string())), 0)
        expected = [[*library.encode(t or "", add_special_tokens=False).ids, 0] for t in some]
        assert sizes.tolist() == [len(e) for e in expected] and ids.tolist() == [i for e in expected for i in e]


def test_token_segments_share_their_tables():
    """Blocks begin with what the whole segment teaches; ids beyond the format are refused; carries run into written words."""
    rng = np.random.default_rng(5)
    ids = np.tile(rng.permutation(2000), 30).astype(np.int32)
    data = token_files.write_segment(np.array([1, 2]), np.array([40_000, 20_000]), ids)
    docs, sizes, back = token_files.read_segment(data)
    assert (back == ids).all() and docs.tolist() == [1, 2] and sizes.tolist() == [40_000, 20_000]
    assert len(data) < ids.size / 4
    with pytest.raises(ValueError, match="65535"):
        token_files.write_segment(np.array([1]), np.array([2]), np.array([3, 65_535], np.int32))
    damaged = bytearray(data)
    damaged[56 + 2 * 16 + -(-ids.size // token_files.BLOCK) * 8 + 20] ^= 1
    with pytest.raises(ValueError, match="tables"):
        token_files.read_segment(bytes(damaged))
    for n in (300_000, 2049):
        ids = np.minimum(rng.geometric(0.01, n) * rng.integers(1, 60, n), 65_534).astype(np.int32)
        assert (token_files.read_segment(token_files.write_segment(np.array([1]), np.array([n]), ids))[2] == ids).all()


def test_rule_counts_equal_brute_force(docs, rows, nothing):
    model = quality_rules.Regression()
    got = sorted((tuple(r)[:7] for r in quality_rules.judge(docs, model).collect()), key=str)
    expected = []
    for i, t in rows:
        t = t or ""
        w = re.findall(WORDS, t)
        times = {}
        for p in range(len(w) - 2):
            times.setdefault(tuple(w[p : p + 3]), []).append(p)
        repeated = {p + k for ps in times.values() if len(ps) > 1 for p in ps for k in range(3)}
        seen, again = set(), 0
        for line in t.split("\n"):
            if re.search(WORDS, line):
                again += line in seen
                seen.add(line)
        expected.append((i, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), again, len(repeated), len(w) < 50 or 100 * len(repeated) > 50 * len(w)))
    assert got == sorted(expected, key=str)
    assert quality_rules.judge(nothing, model).collect() == []


def test_machine_pairs_equal_the_direct_sum():
    rng = np.random.default_rng(4)
    m = quality_fm.Machine()
    m.v = rng.normal(0, 1, m.v.shape).astype(np.float32)
    cols, x = np.array([3, 9, 70]), np.array([0.5, -1.0, 2.0], np.float32)
    direct = sum(float(m.v[cols[i]] @ m.v[cols[j]]) * x[i] * x[j] for i in range(3) for j in range(i))
    assert m.raw(np.array([0, 3]), cols, x)[0][0] == pytest.approx(direct, rel=1e-4)


def _labelled(spark, good, bad, column):
    rng = np.random.default_rng(5)
    texts = [(i, (bad if i % 4 == 0 else good)(rng)) for i in range(400)]
    docs = spark.createDataFrame([*texts, (1000, None), (1001, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 != 0), int(i % 4 == 0)) for i in range(300)] + [(None, 1, 0), (5, None, None)], "doc_id long, quality int, toxic int")
    return docs, labels, column


def test_quality_models_on_held_out_rows(spark):
    from pyspark.sql import functions as F

    noisy = lambda rng: " ".join(w + "###" for w in sentence(rng, 80).split())
    docs, labels, _ = _labelled(spark, lambda rng: sentence(rng, 80), noisy, "quality")
    machine = quality_fm.train(docs, labels, F.col("doc_id") < 300)
    scores = {r.doc_id: r.score for r in quality_fm.score(docs, machine).collect()}
    assert len(scores) == 402 and all(0 <= s <= 1 for s in scores.values())
    assert all((scores[i] >= 0.3) == (i % 4 != 0) for i in range(300, 400))
    kept = {r.doc_id for r in quality_rules.judge(docs, quality_rules.train(docs, labels)).filter("kept").collect()}
    assert {i for i in range(300, 400) if i in kept} == {i for i in range(300, 400) if i % 4}
    blank = quality_fm.score(docs, quality_fm.train(docs, labels.limit(0), F.lit(True)))
    assert blank.count() == 402


def test_toxicity_catches_unseen_misspellings(spark):
    from pyspark.sql import functions as F

    ends = ["ing", "er", "ed", "ly", "s", "ness", "ish", "ful"]

    def bad(rng):
        w = sentence(rng, 60).split()
        for _ in range(3):
            w.insert(int(rng.integers(len(w))), "grumbol" + ends[int(rng.integers(6))])
        return " ".join(w)

    docs, labels, _ = _labelled(spark, lambda rng: sentence(rng, 60), bad, "toxic")
    more = spark.createDataFrame([(2000, "abc def grumbolfull grumbolzed abc"), (2001, "abc def abc")], "doc_id long, text string")
    model = toxicity.train(docs, labels, F.col("doc_id") < 300)
    scores = {r.doc_id: r.score for r in toxicity.score(docs.unionByName(more), model).collect()}
    assert np.mean([(scores[i] >= 0.7) == (i % 4 == 0) for i in range(300, 400)]) > 0.95
    assert scores[2000] >= 0.7 and scores[2001] < 0.7 and scores[1000] < 0.5 and scores[1001] < 0.5
    prior = {r.doc_id: r.score for r in toxicity.score(docs, toxicity.train(docs, labels.limit(0), F.lit(True))).collect()}
    assert len(prior) == 402


def test_licence_scan(spark, nothing):
    rng = np.random.default_rng(6)
    plain = [(i, "\n".join(sentence(rng, 12) for _ in range(6))) for i in range(40)]
    docs = spark.createDataFrame(
        plain + [(100, "hello there\nReleased under the MIT License.\n\nbye"), (101, "// Licensed under the Apache License, Version 2.0 //\nAll rights reserved."), (102, "Distributed under the terms of the Wobble Thing License, version 2."), (103, None), (104, ""), (104, "")],
        "doc_id long, text string",
    )
    model = licences.train(docs)
    got = {r.doc_id: r for r in licences.scan(docs, model).collect()}
    assert got[100].families == ["mit"] and got[100].first_family == "mit" and got[100].n_paragraphs == 3
    assert got[101].families == ["all-rights-reserved", "apache-2.0"] and got[101].first_family == "apache-2.0"
    assert got[102].families == [] and got[102].n_unknown == 1
    assert got[103].families == [] and got[103].first_family is None and got[103].n_paragraphs == 0
    assert all(got[i].n_licensed == 0 for i in range(40))
    assert licences.scan(nothing, model).collect() == []


def test_licence_scan_reads_wrapped_notices_titles_and_tags(spark):
    rng = np.random.default_rng(6)
    plain = [(i, "\n".join(sentence(rng, 12) for _ in range(6))) for i in range(40)]
    gnu = "This {} is free software{} you can redistribute it and/or modify\n{}it under the terms of the GNU {}General Public License as published by\n{}the Free Software Foundation"
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy\n{0}of this software and associated documentation files (the \"Software\"), to deal\n{0}in the Software without restriction"
    notices = {
        "Copyright (c) 2020 A\n\n" + mit.format(""): ["mit"],
        "// " + mit.format("// "): ["mit"],
        "/*\n * " + mit.format(" * ") + "\n */": ["mit"],
        mit.format("").replace("\n", " ") + " " + sentence(rng, 150): ["mit"],
        "Redistribution and use in source and binary forms, with or without\r\nmodification, are permitted provided that the following conditions\r\nare met:": ["bsd"],
        gnu.format("program", ":", "", "", ""): ["gpl"],
        "# " + gnu.format("program", ":", "# ", "", "# "): ["gpl"],
        gnu.format("program", ":", "", "Affero ", ""): ["agpl"],
        gnu.format("library", ";", "", "Lesser ", ""): ["lgpl"],
        "Licensed under the Apache\nLicense, Version 2.0.\nReleased under the\nMIT License.": ["apache-2.0", "mit"],
        "MIT License": ["mit"],
        "The MIT License (MIT)": ["mit"],
        "Apache License\nVersion 2.0, January 2004": ["apache-2.0"],
        "GNU GENERAL PUBLIC LICENSE\nVersion 2, June 1991": ["gpl"],
        "SPDX-License-Identifier: GPL-2.0-only": ["gpl"],
        "/* SPDX-License-Identifier: MPL-2.0 */": ["mpl"],
        "# SPDX-License-Identifier: (LGPL-2.1+ OR BSD-2-Clause)": ["bsd", "lgpl"],
        "SPDX-License-Identifier: CC-BY-SA-4.0": ["cc-by-sa"],
    }
    unsure = ["Wobble License", "Licensed under", "Distributed under the terms\nof the Wobble Thing\nLicense, version 2."]
    docs = spark.createDataFrame(plain + [(100 + i, t) for i, t in enumerate([*notices, *unsure])], "doc_id long, text string")
    got = {r.doc_id: r for r in licences.scan(docs, licences.train(docs)).collect()}
    assert {t: got[100 + i].families for i, t in enumerate(notices)} == notices
    assert [got[100 + i].n_licensed for i in (1, 10, 13)] == [2, 1, 1] and got[109].first_family == "apache-2.0"
    assert all(got[100 + len(notices) + i].families == [] and got[100 + len(notices) + i].n_unknown > 0 for i in range(len(unsure)))
    assert all(got[i].n_licensed == 0 and got[i].n_unknown == 0 for i in range(40))


def test_pipeline_stages_equal_plain_versions(spark, sf):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{sf}/documents.parquet").cache()
    kept = P.near_duplicates(spark, docs, sf)
    groups = {r.doc_id: r.component_id for r in jaccard_join.components(docs).collect()}
    assert {r.doc_id for r in kept.collect()} == {i for i, c in groups.items() if i == c}
    cut = {r.doc_id: r for r in P.repeated_strings(spark, docs, sf).collect()}
    first = {}
    rows = sorted((r.doc_id, (r.text or "").encode()) for r in docs.collect())
    for i, b in rows:
        for p in range(len(b) - 49):
            first.setdefault(b[p : p + 50], i)
    for i, b in rows:
        gone = bytearray(len(b))
        for p in range(len(b) - 49):
            if first[b[p : p + 50]] < i:
                gone[p : p + 50] = b"\x01" * 50
        left = bytes(x for x, g in zip(b, gone, strict=True) if not g).decode("utf-8", "ignore")
        assert cut[i].text == left and (not any(gone) or cut[i].n_chars == len(left))
    held = {r.doc_id for r in decontaminate.contaminated(docs, spark.read.parquet(f"{sf}/benchmark.parquet")).collect()}
    assert {r.doc_id for r in P.decontamination(spark, docs, sf).collect()} == {i for i, _ in rows} - held
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    good = {r.doc_id for r in P.quality(spark, docs, sf).join(labels, "doc_id").filter("quality = 1").select("doc_id").collect()}
    clean = {r.doc_id for r in labels.filter("quality = 1").collect()} & {i for i, _ in rows}
    assert len(good) >= 0.97 * len(clean)
    last = P.tokens(spark, docs.limit(5), sf).collect()
    by = {r.doc_id: r.text for r in docs.collect()}
    assert all(r.decoded_sha256 == hashlib.sha256(by[r.doc_id].encode()).hexdigest() for r in last)
    assert [n for n, _ in P.STAGES] == ["quality", "near_duplicates", "repeated_strings", "decontamination", "tokens"]
    for _, stage in P.STAGES:
        assert stage(spark, docs.limit(0), sf).collect() == []


def test_pipeline_decides_by_id_and_text(spark, sf):
    import corpus_pipeline as P

    rng = np.random.default_rng(12)
    a, b, c, d = (sentence(rng, 40) for _ in range(4))
    item = spark.read.parquet(f"{sf}/benchmark.parquet").filter("length(text) > 100").orderBy("item_id").first().text
    frame = lambda rows: spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = P.near_duplicates(spark, frame([(3, a), (3, a), (5, a), (5, b), (None, a), (None, c), (None, c), (None, d), (8, ""), (8, "")]), sf)
    assert sorted(((r.doc_id or 0, r.text) for r in kept.collect())) == sorted([(3, a), (5, b), (0, c), (0, d), (8, ""), (8, "")])
    clean = P.decontamination(spark, frame([(None, item), (None, a), (7, f"{b} {item}"), (7, c), (9, item)]), sf)
    assert sorted(((r.doc_id or 0, r.text) for r in clean.collect())) == sorted([(0, a), (7, c)])


def test_components_of_null_ids_do_not_chain_and_shared_passages_make_no_nodes(spark):
    def words(tag, n):
        return [f"{tag}{i}" for i in range(n)]

    a, b = words("a", 60), words("b", 60)
    near = [" ".join([*x[:-1], "zz"]) for x in (a, b)]
    rows = [(1, " ".join(a)), (None, near[0]), (None, near[1]), (3, " ".join(b)), (None, " ".join(words("c", 9))), (5, near[0]), (5, "alone " + " ".join(words("d", 9)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.components(docs).collect()), key=str)
    assert got == sorted([(1, 56, 1), (None, 56, 1), (None, 56, 3), (3, 56, 3), (None, 5, None), (5, 56, 1), (5, 6, 5)], key=str)

    passage = words("p", 40)
    mixed = spark.createDataFrame([(d, " ".join([*passage, *words(f"own{d}_", 20)])) for d in range(30)], "doc_id long, text string")
    _, packs = exchange.settled(spark, lambda: jaccard_join.set_tables(mixed, 80, "doc_id", "text"))
    assert jaccard_join.node_table(packs).count() == 0


def test_settled_deletes_what_it_was_made_from(spark):
    inner = []

    def make():
        inner.append(exchange.stored(spark.range(5)))
        inner.append(exchange.chunked(spark.createDataFrame([(1, "x")], "doc_id long, text string")))
        return inner[0].withColumn("twice", 2 * inner[0]["id"])

    folders = [exchange.settled(spark, lambda: exchange.settled(spark, make))]
    assert sorted(r.twice for r in folders[0].collect()) == [0, 2, 4, 6, 8]
    with pytest.raises(Exception):
        inner[0].collect()
    assert not [t for t in spark.catalog.listTables() if t.name in str(inner[1]._jdf.queryExecution().analyzed())]


def test_workers_give_back_what_a_task_met(spark, docs):
    import pyarrow as pa

    def left(batches):
        for _ in batches:
            pass
        yield pa.RecordBatch.from_arrays([pa.array([sum(len(v.cache) for v in bpe._LOADED.values())], pa.int64())], names=["n"])

    bpe.encode_and_decode(docs, VOCABULARY).count()
    bpe.encode_and_decode(docs, VOCABULARY).agg(F.sum("n_tokens")).collect()
    assert {r.n for r in spark.range(64).repartition(8).mapInArrow(left, "n long").collect()} == {0}


def test_quality_scores_large_batches_in_small_slices():
    import tracemalloc

    import pyarrow as pa

    words = [f"word{i * 7919 % 4001}" for i in range(4000)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(80), pa.int64()), pa.array([" ".join(words[i:] + words[:i]) for i in range(80)])], names=["doc_id", "text"])
    size, machine = batch.column("text").nbytes, quality_fm.Machine()
    whole = machine.score(*quality_fm.features(quality_fm.Slice(batch.column("text"))))
    parts = list(quality_fm.A.slices(batch, "text", quality_fm.SLICE_BYTES))
    tracemalloc.start()
    cut = [machine.score(*quality_fm.features(quality_fm.Slice(p.column("text")))) for p in parts]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (np.concatenate(cut) == whole).all() and size > 2_400_000 and peak < 20 * size


def test_pipeline_stages_read_small_batches(spark, sf):
    import corpus_pipeline as P

    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    P.tokens(spark, spark.read.parquet(f"{sf}/documents.parquet"), sf)
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) == P.BATCH_BYTES
