import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

from tickerloom.functions.columns import clean_lines, one_spaced
from tickerloom.operators import postings
from tickerloom.operators import retrieval as rt
from tickerloom.operators import text as tx

TEXTS = [
    "Rain, RAINS rained; the raining wind-swept 2001s", "", None, "the of and", "x", "ends", "ss s es ed", "inged classes glasses flies",
    "café naïve İstanbul K 12,5% ﬁne", "…—", "a1 the1 1the", "words\nover\tlines", "edges", "Straße ΑΣ", "😀rain😀", "rain " * 300, "running" + "́",
]


def test_counts_are_those_of_terms(spark):
    """Array operations find, stop and stem the words of a text as the column functions do, also at the borders of texts in one buffer."""
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, text string")
    rows = df.select("i", F.lower("text").alias("lower"), F.coalesce(rt.terms(F.col("text")), F.array().cast("array<string>")).alias("t")).orderBy("i").collect()
    for lower in (pa.array([r["lower"] for r in rows]), pa.chunked_array([pa.array(["before"] + [r["lower"] for r in rows])]).chunk(0).slice(1)):
        terms, code, text, tf, size = postings.counted(lower)
        assert terms.to_pylist() == sorted(terms.to_pylist()) and size.tolist() == [len(r["t"]) for r in rows]
        found = {(int(i), terms[int(c)].as_py()): int(n) for c, i, n in zip(code, text, tf, strict=True)}
        assert found == {(r["i"], w): r["t"].count(w) for r in rows for w in r["t"]}


def test_blocks_hold_every_posting_once():
    lower = pa.array([t.lower() if t is not None else None for t in TEXTS * 20])
    blocks, size = postings.listed(lower, 7, 3)
    assert blocks.column("term").to_pylist() == sorted(blocks.column("term").to_pylist()) and pc.max(blocks.column("n")).as_py() == 3
    got = {(b["term"], p >> 32, p & 0xFFFFFFFF) for b in blocks.to_pylist() for p in b["postings"]}
    terms, code, text, tf, _ = postings.counted(lower)
    assert got == {(terms[int(c)].as_py(), int(i) + 7, int(n)) for c, i, n in zip(code, text, tf, strict=True)} and len(size) == len(lower)
    assert pc.sum(blocks.column("n")).as_py() == len(got)
    weight = lambda p: (p & 0xFFFFFFFF) / ((p & 0xFFFFFFFF) + 1) / (1 + np.log(size[(p >> 32) - 7].as_py()))
    assert all(weight(p) <= b["peak"] for b in blocks.to_pylist() for p in b["postings"])
    assert postings.listed(pa.array(["", None]), 0, 3)[0].num_rows == 0


def test_segments_are_listed_in_bounded_batches():
    names = ["chunk_id", "lower"]
    batches = [pa.RecordBatch.from_arrays([pa.array([f"{k}-{i}" for i in range(n)], pa.string()), pa.array(["x" * (i % 7) if i % 5 else None for i in range(n)], pa.string())], names) for k, n in enumerate((3, 1, 0, 40, 5, 100))]
    for limit in (1, 10, 60, 10**6):
        out = list(postings.gathered(iter(batches), limit))
        assert [x for b in out for x in b.column("chunk_id").to_pylist()] == [x for b in batches for x in b.column("chunk_id").to_pylist()]
        assert max((pc.sum(pc.binary_length(b.column("lower"))).as_py() or 0) for b in out) < limit + 7
    assert len(out) == 1


def test_index_names_a_chunk_once(spark):
    """A posting is a number; what it stands for is stored once a chunk, and no posting is gathered by Spark."""
    chunks = spark.range(200).selectExpr("concat('chunk-', id) AS chunk_id", "array('AA') AS tickers", "timestamp'2001-01-01' AS published", "'news' AS source_type", "concat('rain wind w', id % 9) AS text")
    index = postings.build(chunks)
    assert "chunk_id" not in index.blocks.columns and dict(index.blocks.dtypes)["postings"] == "array<bigint>"
    assert index.members.count() == 200 and index.members.select("segment", "no").distinct().count() == 200
    assert index.blocks.agg(F.sum(F.size("postings"))).first()[0] == 600


def test_a_text_is_cut_once(spark):
    """No filter cleans, marks or cuts a text a second time."""
    docs = spark.range(3).select(F.col("id").cast("string").alias("document_id"), F.concat(F.lit("Item 1. x"), F.col("id").cast("string")).alias("raw"))
    docs = docs.select("document_id", clean_lines(F.col("raw")).alias("text"), F.lit("h").alias("content_hash"))
    plan = tx.chunk_documents(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("{1,188}") == 1 and plan.count("split(regexp_replace(") == 1 and plan.count("transform(split(") == 1


def test_clean_texts_pass_and_others_are_cleaned(spark):
    rows = [("",), (None,), (" ",), ("\n",), ("a b\nc",)] + [(x + s + y + e,) for s in " \n\t\r\x0b\x0c\x1c\x1f\x85\xa0  　​" for x in ("", "a ", "é") for y in ("", "b", "\n") for e in ("", " ", "\n", "d")]
    df = spark.createDataFrame(rows, "t string")
    lines = F.transform(F.split("t", r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"), one_spaced)
    whole = F.array_join(F.filter(lines, lambda x: x != ""), "\n")
    assert df.filter(~whole.eqNullSafe(clean_lines(F.col("t")))).count() == 0


def test_dot_is_a_fold(spark):
    """A product of long vectors stays small enough to be compiled; sums are those of the terms in order."""
    rng = np.random.default_rng(4)
    a, b = rng.normal(size=(2, 64)).astype(np.float32)
    df = spark.createDataFrame([(a.tolist(), b.tolist()), (None, b.tolist())], "a array<float>, b array<float>")
    out = df.select(rt.dot(F.col("a"), F.col("b"), 64).alias("s"))
    want = 0.0
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        want += x * y
    assert [r["s"] for r in out.collect()] == [want, None]
    assert out._jdf.queryExecution().optimizedPlan().toString().count(" * ") == 1


def test_a_search_reads_the_index_once(spark):
    """The lists of the asked words are taken out in one pass; what follows reads only these."""
    chunks = spark.range(60).selectExpr("concat('c', id) AS chunk_id", "array('AA') AS tickers", "timestamp'2001-01-01' AS published", "'news' AS source_type", "concat('rain wind w', id % 9) AS text")
    index = postings.build(chunks)
    asked = spark.sql("SELECT 'q' AS query_id, 'AA' AS ticker, 'rain w3' AS query, timestamp'2001-02-01' AS as_of, array('news') AS source_types")
    reads = []

    class Watched:
        members = index.members
        blocks = property(lambda self: reads.append(1) or index.blocks)

    assert postings.search(asked, Watched(), chunks, 3).count() == 3 and len(reads) == 1
    taken = postings.lists_of(postings.asked_terms(postings.parsed(asked)), index)
    assert {r["term"] for r in taken.blocks.collect()} == {"rain", "w3"}
