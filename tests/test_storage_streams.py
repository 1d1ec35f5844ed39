import datetime as dt

import pytest
from pyspark.sql import functions as F

from tickerloom.operators import storage as st
from tickerloom.sources import filings as fl
from tickerloom.sources import jsonl
from tickerloom.streaming import increments as inc


def test_inventory_identity_and_twins(spark, tmp_path):
    df = spark.createDataFrame([(1, "a")], "id int, v string")
    st.write_table(df, str(tmp_path / "t.parquet"))
    (tmp_path / "x.csv").write_text("a\n")
    (tmp_path / "x.parquet").write_bytes(b"p")
    (tmp_path / "y.csv").write_text("b\n")
    files = st.file_inventory(spark, str(tmp_path)).filter(~F.col("path").contains("t.parquet"))
    kept = {r["path"].rsplit("/", 1)[1] for r in st.drop_csv_twins(files).collect()}
    assert kept == {"x.parquet", "y.csv"}
    one, two = (st.snapshot_identity(f).first()[0] for f in (files, files.withColumn("sha256", F.lit("0"))))
    assert one.startswith("ss_") and len(one) == 23 and one != two
    st.convert_parquet_to_csv(spark, str(tmp_path / "t.parquet"), str(tmp_path / "out"))
    assert spark.read.csv(str(tmp_path / "out"), header=True).count() == 1
    with pytest.raises(ValueError):
        st.replace_all(df.filter("false"), str(tmp_path / "none"))


def test_files_are_hashed_in_parts(spark, tmp_path):
    import hashlib

    from tickerloom.sources import files

    (tmp_path / "a" / "b").mkdir(parents=True)
    bodies = {"a/one": b"x" * 10, "a/b/two": bytes(range(256)) * 5, "a/none": b"", "three": b"y" * 100}
    for name, body in bodies.items():
        (tmp_path / name).write_bytes(body)

    def digest(body):
        parts = [hashlib.sha256(body[i : i + 100]).digest() for i in range(0, max(1, len(body)), 100)]
        return parts[0].hex() if len(parts) == 1 else hashlib.sha256(b"".join(parts)).hexdigest()

    got = files.file_inventory(spark, str(tmp_path), part_bytes=100)
    assert {r["path"].removeprefix(f"{tmp_path}/"): (r["bytes"], r["sha256"]) for r in got.collect()} == {n: (len(b), digest(b)) for n, b in bodies.items()}
    before = got.cache()
    before.count()
    (tmp_path / "three").write_bytes(b"z" * 100)
    (tmp_path / "four").write_bytes(b"")
    (tmp_path / "a" / "one").unlink()
    after = files.file_inventory(spark, str(tmp_path), part_bytes=100)
    assert {(r["path"].removeprefix(f"{tmp_path}/"), r["kind"]) for r in files.inventory_conflicts(before, after).collect()} == {("three", "changed"), ("four", "new"), ("a/one", "missing")}


def test_file_beyond_two_gigabytes(spark, tmp_path):
    from tickerloom.sources import files

    with (tmp_path / "large").open("wb") as f:
        f.truncate((2 << 30) + 5)  # sparse: no room on the disk
    row = files.file_inventory(spark, str(tmp_path)).first()
    assert row["bytes"] == (2 << 30) + 5 and len(row["sha256"]) == 64


def test_identity_is_of_the_multiset(spark):
    of = lambda rows: st.snapshot_identity(spark.createDataFrame(rows, "path string, sha256 string").repartition(3)).first()[0]
    assert of([("a", "1"), ("b", "2")]) == of([("b", "2"), ("a", "1")])
    assert len({of([("a", "1")]), of([("a", "1")] * 2), of([("a", "1"), ("b", "2")]), of([])}) == 4


def test_identity_hashes_every_entry_in_order(spark):
    import hashlib

    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    rows = [(f"p{i % 900}", str(i % 1800)) for i in range(2700)]
    ranges = {}
    for h in sorted(digest(f"{p}:{s}") for p, s in rows):
        ranges.setdefault(h[:2], []).append(h)
    want = "ss_" + digest("".join(digest("".join(ranges[r])) for r in sorted(ranges)))[:20]
    assert st.snapshot_identity(spark.createDataFrame(rows, "path string, sha256 string").repartition(5)).first()[0] == want


def test_table_specs(spark):
    from tickerloom.sources import files

    rows = files.table_specs({"t": spark.range(3), "u": spark.createDataFrame([("x", 1.0)], "a string, b double")}).collect()
    assert [(r["table"], r["rows"]) for r in rows] == [("t", 3), ("u", 1)] and '"bigint"' in rows[0]["columns"]


def test_verification_finds_changed_rows(spark):
    a = spark.createDataFrame([(1, float("nan")), (2, 1.0), (2, 1.0)], "id int, v double")
    assert {r["side"]: r["n"] for r in st.content_differences(a, a).collect()} == {"missing": 0, "extra": 0}
    b = spark.createDataFrame([(1, float("nan")), (2, 1.0)], "id int, v double")
    assert {r["side"]: r["n"] for r in st.content_differences(a, b).collect()} == {"missing": 1, "extra": 0}


def test_pinned_snapshot(spark, tmp_path):
    df = spark.createDataFrame([(1,), (2,)], "id int")
    st.write_table(df, f"{tmp_path}/version=ss_1")
    assert st.read_snapshot(spark, str(tmp_path), "ss_1", 2, ["id"]).count() == 2
    with pytest.raises(ValueError):
        st.read_snapshot(spark, str(tmp_path), "ss_1", 3, ["id"])


def test_bulk_fact_files(spark, tmp_path):
    d = tmp_path / "2024q1"
    d.mkdir()
    (d / "sub.txt").write_text("adsh\tcik\tname\tform\tperiod\tfy\tfp\tfiled\na1\t320193\tX\t10-K\t20231231\t2023\tFY\t20240201\na2\t5\tY\t10-K\t20231231\t2023\tFY\t20240201\n")
    head = "adsh\ttag\tversion\tddate\tqtrs\tuom\tsegments\tcoreg\tvalue\n"
    rows = ["a1\tRevenues\tus-gaap/2023\t20231231\t4\tUSD\t\t\t100", "a1\tRevenues\tus-gaap/2023\t20231231\t4\tUSD\tSeg=A\t\t7", "a1\tAssets\tus-gaap/2023\t20231231\t0\tUSD\t\t\t55", "a1\tAssets\tcustom\t20231231\t0\tUSD\t\t\t9", "a2\tAssets\tus-gaap/2023\t20231231\t0\tUSD\t\t\t9"]
    (d / "num.txt").write_text(head + "\n".join(rows) + "\n")
    sub, num = fl.read_bulk(spark, str(tmp_path))
    ciks = spark.createDataFrame([("AAPL", 320193)], "ticker string, issuer_cik bigint")
    got = {r["concept"]: r for r in fl.bulk_facts(sub, num.withColumn("ingest_seq", F.monotonically_increasing_id()), ciks, ["Revenues", "Assets"]).collect()}
    assert set(got) == {"Revenues", "Assets"}
    assert got["Revenues"]["start"] == dt.date(2023, 1, 1) and got["Revenues"]["val"] == 100.0 and got["Assets"]["start"] is None


def test_jsonl_file(spark, tmp_path):
    p = tmp_path / "d.jsonl"
    p.write_text('{"document_id": "a", "tickers": ["X"], "published_at": "2020-01-01T00:00:00Z"}\n\n[1]\n{bad\n')
    rec = jsonl.query_records(jsonl.read_jsonl(spark, str(p))).collect()
    assert sorted((r["problem"] or "ok") for r in rec) == ["not_an_object", "not_json", "ok"]
    assert [r["tickers"] for r in rec if r["document_id"] == "a"] == [["X"]]


def test_incremental_embedding_and_snapshot_upsert(spark, tmp_path):
    src = tmp_path / "src"
    schema = "chunk_id string, ticker string, risk_profile string, as_of string, stance string"

    def land(n, rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(src))

    def run():
        s = spark.readStream.schema(schema).parquet(str(src))
        inc.run_available(s, str(tmp_path / "c1"), inc.embed_new(lambda d: d.select("chunk_id", F.length("chunk_id").alias("v")), str(tmp_path / "vec"))).awaitTermination()
        inc.run_available(s, str(tmp_path / "c2"), inc.upsert_snapshots(str(tmp_path / "snap"))).awaitTermination()

    land(0, [("c1", "A", "growth", "2020-01-01", "MONITOR"), ("c2", "B", "growth", "2020-01-01", "MONITOR")])
    run()
    land(1, [("c2", "B", "growth", "2020-01-02", "CAUTION"), ("c3", "C", "growth", "2020-01-02", "EXPLORE")])
    run()
    assert sorted(r[0] for r in spark.read.parquet(str(tmp_path / "vec")).select("chunk_id").collect()) == ["c1", "c2", "c3"]
    final = {r["ticker"]: r["stance"] for r in inc.read_newest(spark, str(tmp_path / "snap"), inc.SNAPSHOT_KEYS).collect()}
    assert final == {"A": "MONITOR", "B": "CAUTION", "C": "EXPLORE"}


def test_open_trailing_windows_come_out_and_are_updated(spark, tmp_path):
    schema = "ticker string, score double, relevance double, ts timestamp"

    def run(rows):
        frame = spark.createDataFrame(rows, "ticker string, score double, relevance double, t string")
        frame.select("ticker", "score", "relevance", F.col("t").cast("timestamp").alias("ts")).write.mode("append").parquet(f"{tmp_path}/in")
        stream = inc.trailing_sentiment(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), "ts")
        return inc.newest_windows(stream, f"{tmp_path}/out", f"{tmp_path}/ckpt").collect()

    first = run([("A", 1.0, 1.0, "2024-05-01 10:00:00"), ("A", 0.0, 1.0, "2024-05-01 10:00:00"), ("B", 0.5, 1.0, "2024-05-01 11:00:00")])
    assert sorted((r.ticker, r.article_count) for r in first) == [("A", 2)] * 7 + [("B", 1)] * 7
    second = run([("A", 0.5, 1.0, "2024-05-01 12:00:00"), ("C", -1.0, 1.0, "2024-05-01 13:00:00")])
    assert sorted((r.ticker, r.article_count) for r in second) == [("A", 3)] * 7 + [("B", 1)] * 7 + [("C", 1)] * 7
    assert len({(r.as_of, r.ticker) for r in second}) == 21


def windows(spark, rows):
    return spark.createDataFrame(rows, "as_of string, ticker string, n int").withColumn("as_of", F.col("as_of").cast("timestamp"))


def test_a_batch_writes_only_its_days_and_replays(spark, tmp_path):
    store = str(tmp_path / "w")
    write = inc.upsert_windows(store)
    read = lambda: sorted((str(r["as_of"])[:10], r["ticker"], r["n"]) for r in inc.read_newest(spark, store, inc.WINDOW_KEYS).collect())
    files = lambda: {str(p): p.stat().st_mtime_ns for p in tmp_path.rglob("*.parquet")}
    write(windows(spark, [("2024-01-01", "A", 1), ("2024-01-02", "A", 1), ("2024-01-02", "B", 1)]), 0)
    before = files()
    late = windows(spark, [("2024-01-02", "A", 2), ("2024-01-03", "A", 2)])
    write(late, 1)
    want = [("2024-01-01", "A", 1), ("2024-01-02", "A", 2), ("2024-01-02", "B", 1), ("2024-01-03", "A", 2)]
    assert read() == want and {p: t for p, t in files().items() if p in before} == before
    write(late, 1)
    assert read() == want and inc.deltas(spark, store) == {"2024-01-01": [0], "2024-01-02": [0, 1], "2024-01-03": [1]}


def test_compaction_keeps_the_newest_rows(spark, tmp_path):
    store = str(tmp_path / "w")
    write = inc.delta_writer(store, inc.WINDOW_KEYS, F.to_date("as_of"), most=3)
    for n in range(6):
        write(windows(spark, [("2024-01-01", "A", n), ("2024-01-01", f"T{n}", n), (f"2024-02-0{n + 1}", "B", n)]), n)
    assert inc.deltas(spark, store)["2024-01-01"] == [3, 4, 5]  # merged once, when the fourth delta came
    rows = {(str(r["as_of"])[:10], r["ticker"]): r["n"] for r in inc.read_newest(spark, store, inc.WINDOW_KEYS).collect()}
    assert rows == {("2024-01-01", "A"): 5} | {("2024-01-01", f"T{n}"): n for n in range(6)} | {(f"2024-02-0{n + 1}", "B"): n for n in range(6)}
    # a compaction that stopped before it dropped the old deltas is finished later, with the same rows
    write(windows(spark, [("2024-01-01", "A", 9)]), 4)
    assert inc.compact(spark, store, inc.WINDOW_KEYS, most=1) == ["2024-01-01"] and inc.deltas(spark, store)["2024-01-01"] == [5]


def test_refreshed_snapshots(spark, tmp_path):
    from tickerloom.plans import jobs

    kind = "ticker string, risk_profile string, as_of string, stance string"
    store = str(tmp_path / "s")
    jobs.refresh_snapshots(spark, store, 0, spark.createDataFrame([("A", "g", "1", "x"), ("A", "g", "2", "y"), ("B", "g", "1", "z")], kind))
    rows = jobs.refresh_snapshots(spark, store, 1, spark.createDataFrame([("A", "g", "3", "w")], kind)).collect()
    assert sorted(tuple(r) for r in rows) == [("A", "g", "3", "w"), ("B", "g", "1", "z")]
