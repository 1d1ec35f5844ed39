import datetime as dt
import re

from pyspark.sql import functions as F

from tickerloom.functions.html import with_visible_text
from tickerloom.operators import evalmetrics as em
from tickerloom.operators import explain as ex
from tickerloom.operators import retrieval as rt
from tickerloom.operators import sentiment as se
from tickerloom.operators import snapshots as sn
from tickerloom.operators import text as tx


def column(spark, value, fn):
    return spark.createDataFrame([(value,)], "v string").select(fn(F.col("v"))).first()[0]


def test_visible_text(spark):
    pages = {
        "<html><head><title>x</title></head><body><p>One <b>two</b></p><div style='display:none'>no</div><input hidden>"
        "<table><tr><td>a</td><td>b</td></tr></table><script>s()</script>Tail &amp; end</body></html>": "One two\na b\nTail & end",
        "<div hidden>a<p>b</p><br>c</div>d": "d",
        "<div>a<span hidden>b</div>c": "a\nc",
        "a</p>b<br/>c": "ab\nc",
        "<ix:header><p>x</p></ix:header>y<style>p{}</style><!-- z -->w": "yw",
        "<p style=\"color:red; visibility : collapse !important\">x</p><p style='/*display:none*/'>y</p>": "y",
        "<p title='a > hidden b'>q</p><p data-x=\"1\"hidden>r</p>": "q",
        "1 &lt; 2 &#65;&#x1F600; &unknown; & &eacute;": "1 < 2 A\U0001f600 &unknown; & é",
        "<noscript>n</noscript><template>t<div>u</div></template>v <hr hidden> w": "v w",
        "plain  text": "plain  text",
        "a < b": "a < b",
    }
    rows = spark.createDataFrame([*[(h,) for h in pages], (None,), ("",)], "html string")
    got = {r.html: r.text for r in with_visible_text(rows, "html", "text").collect()}
    assert got == {**pages, None: None, "": ""}


def test_long_page_is_one_fold(spark):
    body = "".join(f"<div class='c{i}'><p>w{i}</p><span hidden>h{i}</span></div>" for i in range(3000))
    row = with_visible_text(spark.createDataFrame([(body,)], "html string"), "html", "text").first()
    assert row.text == "\n".join(f"w{i}" for i in range(3000))


REFERENCES = [
    "it&#146;s &#147;ok&#148; &#151; x",
    "A&nbsp B &copy 2020 &amp C",
    "a&#0;b&#x80;c&#55296;d&#1114112;e&#1;f&#128512;g&#99999999999;h&#xD800;i&#x00000041;j&#xFDD0;k&#129;",
    "&notit; &notin; &ampx &#x;&#; &;& &CounterClockwiseContourIntegral; &acE; &copy2020; &unknown; &amp;amp;",
]


def test_references_follow_the_standard(spark):
    import html

    rows = spark.createDataFrame([(x,) for x in REFERENCES], "html string")
    got = {r.html: r.text for r in with_visible_text(rows, "html", "text").collect()}
    assert got == {x: " ".join(html.unescape(x).split()) for x in REFERENCES}


def test_visible_text_and_its_twin(spark):
    """Both read odd pages alike: raw blocks, unclosed and crossed elements, attributes, references."""
    import duckdb
    import pandas as pd

    from tickerloom.functions.columns import sha
    from tickerloom.plans.html_sql import PAGE_TEXT

    pages = {
        "<script>var s='</style>';secret</script>after": "after",
        "<style>a</script>b</style>c": "c",
        "<SCRIPT>x</script >y<script>never closed": "y",
        "<p>a<p>b<p>c</p></p>d</p>e": "a\nb\nc\nd\ne",
        "<div hidden><div hidden>a</div>b</div>c": "c",
        "<b><i>x</b>y</i>z<p hidden=''>q</p><p title=\"hidden\">r</p>": "xyz\nr",
        "<p style='/* */display:none'>n</p><p STYLE=\"color:red;VISIBILITY:hidden;\">n</p>m": "m",
        "a&lt;p&gt;b<br>&nbsp;&nbsp;c<!-- x --><!doctype y>d": "a<p>b\ncd",
        "plain": "plain",
        "a <b": "a <b",
    }
    pages |= {x: None for x in REFERENCES}
    own = with_visible_text(spark.createDataFrame([*enumerate(pages)], "page_id long, html string"), "html", "text")
    for r in own.collect():
        assert pages[r.html] in (None, r.text)
    got = {tuple(r) for r in own.select("page_id", F.length("text"), sha(F.col("text"))).collect()}
    con = duckdb.connect()
    con.register("pages", pd.DataFrame([*enumerate(pages)], columns=["page_id", "html"]))
    assert got == set(con.execute(PAGE_TEXT).fetchall())


def test_many_pieces_in_one_page(spark):
    body = "".join(f"<p>w{i}<b>&amp;</b>" for i in range(20_000))
    row = with_visible_text(spark.createDataFrame([(body,)], "html string"), "html", "text").first()
    assert row.text == "\n".join(f"w{i}&" for i in range(20_000))


def test_canonical_url(spark):
    url = "HTTPS://News.Example.com/a/b//?utm_source=x&id=7&empty=&GCLID=1&q=a+b#frag"
    assert column(spark, url, tx.canonical_url) == "https://news.example.com/a/b?id=7&q=a+b"
    assert column(spark, "ftp://x.com/a", tx.canonical_url) is None
    assert column(spark, "http:///a", tx.canonical_url) is None


def sequential_chunks(text, size=220, overlap=32):
    import re

    spans = [m.span() for m in re.finditer(r"\S+", text)]
    out = []
    for start in range(0, len(spans), size - overlap):
        stop = min(start + size, len(spans))
        out.append((spans[start][0], spans[stop - 1][1], stop - start))
        if stop == len(spans):
            break
    return out


def test_chunks_cover_the_text_as_a_sequential_cut_does(spark):
    texts = [" ".join(f"w{i}" for i in range(n)) for n in (1, 31, 188, 219, 220, 221, 252, 253, 376, 408, 409, 1000)]
    docs = spark.createDataFrame([(str(i), t, "h") for i, t in enumerate(texts)], "document_id string, text string, content_hash string")
    got = {}
    for r in tx.chunk_documents(docs).collect():
        got.setdefault(r["document_id"], []).append((r["start_char"], r["end_char"], r["token_count"]))
    for i, t in enumerate(texts):
        assert sorted(got[str(i)]) == sequential_chunks(t), len(t.split())


def test_sections(spark):
    text = "Lead in\nItem 1. Business\nwe do\nPart II Item 7A. Risk\nmore"
    docs = spark.createDataFrame([("d", text, "h")], "document_id string, text string, content_hash string")
    rows = [(r["section"], r["section_start"]) for r in tx.sections(docs).orderBy("section_start").collect()]
    assert rows == [("Document", 0), ("Item 1. Business", 8), ("Part II Item 7A. Risk", text.index("Part II"))]


def test_attribution_needs_a_single_named_ticker(spark):
    docs = spark.createDataFrame(
        [("d", "news", "u", "p", dt.datetime(2020, 1, 1), ["APL", "MSF"], "Apple rose. Apple and Microsoft fell. NASDAQ: MSF gained!")],
        "document_id string, source_type string, source_url string, published_at string, available timestamp, tickers array<string>, text string",
    )
    u = spark.createDataFrame([("APL", "Apple Inc."), ("MSF", "The Microsoft Corporation")], "ticker string, name string")
    got = {r["ticker"]: (r["text"], r["status"]) for r in tx.attributed_text(docs, u).collect()}
    assert got == {"APL": ("Apple rose.", "pending"), "MSF": ("NASDAQ: MSF gained!", "pending")}


def test_news_signal_formula(spark):
    now = dt.datetime(2026, 1, 10, 12)
    rows = [
        ("A", 0.5, 0.8, now - dt.timedelta(hours=24), "u1", 1),
        ("A", -0.2, 0.4, now - dt.timedelta(hours=2), "u2", 2),
        ("A", 0.9, 0.9, now - dt.timedelta(hours=1), "u1", 3),  # newer copy of the first story
        ("A", 0.9, 0.05, now, "u4", 4),  # below the floor
        ("A", 0.9, 0.9, now + dt.timedelta(hours=1), "u5", 5),  # not known yet
        ("B", 0.9, 0.9, now, "u6", 6),  # one article: abstains
    ]
    r = spark.createDataFrame(rows, "ticker string, score double, relevance double, published timestamp, url string, ingest_seq int")
    r = r.select("*", F.col("published").alias("available"), F.lit("").alias("content_hash"), F.lit("").alias("article_id"), F.lit("marketaux").alias("source"), F.lit(False).alias("relevance_assumed"))
    t = spark.createDataFrame([("A",), ("B",)], "ticker string")
    got = {x["ticker"]: x["news"] for x in se.news_signals(r, t, F.lit(now)).collect()}
    w1, w2 = 0.5 ** (1 / 24) * 0.9, 0.5 ** (2 / 24) * 0.4
    assert got["B"] is None and got["A"]["article_count"] == 2
    assert abs(got["A"]["score"] - (w1 * 0.9 - w2 * 0.2) / (w1 + w2)) < 1e-12


def test_rank_fusion_prefers_shared_hits_and_keeps_similarity(spark):
    v = spark.createDataFrame([("q", "c1", "h1", 0, 0.9), ("q", "c2", "h2", 1, 0.8)], "query_id string, chunk_id string, content_hash string, rank int, similarity double")
    k = spark.createDataFrame([("q", "k2", "h2", 0), ("q", "c3", "h3", 1)], "query_id string, chunk_id string, content_hash string, rank int")
    rows = rt.fuse(v, k, 5).orderBy("rank").collect()
    assert [r["chunk_id"] for r in rows] == ["c2", "c1", "c3"]
    assert rows[0]["similarity"] == 0.8


def test_query_language(spark):
    q = spark.createDataFrame([('apples OR pears growing -bananas "red wine"',)], "query string")
    r = rt.query_terms(q).first()
    assert r["required"] == [["appl", "pear"], ["grow"]] and r["excluded"] == ["banana"] and r["phrases"] == ["red wine"]


def test_guard_and_template(spark):
    ev = F.array(F.struct(F.lit("T").alias("title"), F.lit("news").alias("source_type"), F.lit("2020-01-02T00:00:00Z").alias("published_at"), F.lit("made $5 million").alias("snippet"), F.lit("u").alias("source_url")))
    df = spark.range(1).select(
        F.lit("A").alias("ticker"), ev.alias("evidence"), F.lit("Buy now, it cost $7 million").alias("rewrite"),
        F.struct(F.lit("MONITOR").alias("baseline_stance"), F.lit("MONITOR").alias("news_aware_stance"), F.lit(False).alias("provisional"), F.array(F.lit("why")).alias("decision_trace")).alias("signal"),
    )
    x = ex.explain(df).first()["explanation"]
    assert x["text"] == "Monitor — keep on your radar for A.\nWhy this signal:\n- why\nSupporting evidence:\n[1] T — news, 2020-01-02\n    “made $5 million”"
    assert not x["abstained"] and len(x["caveats"]) == 3
    assert len(df.select(ex.violations(F.col("rewrite"), F.col("evidence")).alias("v")).first()["v"]) == 2
    fine = ex.explain(df.withColumn("rewrite", F.lit("Made $5 million."))).first()["explanation"]["text"]
    assert fine == "Made $5 million."


def test_confident_return(spark):
    rows = [(None, None, None), (3.0, -1.0, 5.0), (0.4, 0.1, 0.9), (3.0, 1.0, 5.0)]
    df = spark.createDataFrame(rows, "return_10d double, lower double, upper double").select(F.struct("*").alias("f"))
    value, sure = sn.confident_return(F.col("f"))
    assert [tuple(r) for r in df.select(value, sure).collect()] == [(0.0, False), (0.0, False), (0.0, False), (3.0, True)]


def test_retrieval_metrics(spark):
    ranked = spark.createDataFrame([("q", i, n) for n, i in enumerate("abcde")], "query_id string, item string, rank int")
    pool = spark.createDataFrame([("q", i, s) for i, s in zip("abcdefg", (0.9, 0.1, 0.8, 0.2, 0.3, 0.7, 0.6))] + [("z", "a", 0.1)], "query_id string, item string, score double")
    m = {r["query_id"]: r for r in em.query_metrics(ranked, pool).collect()}
    assert abs(m["q"]["precision_3"] - 2 / 3) < 1e-12 and m["q"]["recall_1"] == 0.25 and m["q"]["recall_3"] == 0.5
    assert m["z"]["recall_5"] is None and m["z"]["precision_1"] == 0.0


def test_claims_skip_scaffolding(spark):
    text = "Lead line\nWhy this signal:\n- First claim is here. Second claim follows now.\n[1] T — news\n    “A quoted sentence here.”\n- Note: skip this one please"
    got = column(spark, text, em.claims)
    assert got == ["First claim is here.", "Second claim follows now.", "A quoted sentence here."]


def test_name_hits_equal_a_search_per_name(spark):
    names = {"AA": "The Alpha Beta Corporation", "AB": "Alpha Gamma Inc.", "BB": "Beta", "CC": "Foo & Bar Co.", "DD": "Ab Inc", "EE": "Alpha Alpha Ltd"}
    short = {"AA": "alpha beta", "AB": "alpha gamma", "BB": "beta", "CC": "foo & bar", "DD": "ab inc", "EE": "alpha alpha"}
    universe = spark.createDataFrame(list(names.items()), "ticker string, name string")
    texts = ["ALPHA beta rose", "alphabeta, Alpha  Beta", "Beta-alpha gamma; beta", "Foo & Bar and foo and bar", "alpha alpha alpha beta", "ab", "the AB Inc", "", None, "alpha", "x_beta beta"]
    rows = [(i, "BB", t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "document_id long, ticker string, text string")
    expected = set()
    for i, _, t in rows:
        for ticker, name in short.items():
            expected |= {(i, ticker, m.start()) for m in re.finditer(rf"(?<!\w)(?={re.escape(name)}(?!\w))", (t or "").lower())}
    hits = se.name_hits(df, universe, ["document_id"]).collect()
    assert len(hits) == len(expected)
    assert {(h["document_id"], h["other"]) for h in hits} == {(i, o) for i, o, _ in expected}
    got = {tuple(r) for r in se.contaminated(df, universe).collect()}
    assert got == {(i, "BB", o) for i, o, _ in expected if o != "BB"}
    assert se.contaminated(df, universe.limit(0)).collect() == []


def test_texts_meet_names_without_a_shuffle_by_ticker(spark):
    """Letters that equal ASCII ones only in some cases still attribute; only tags are dealt by ticker."""
    universe = spark.createDataFrame([("AAA", "Kiska Inc."), ("BBB", "Öl & Gas plc"), ("CCC", "Co"), ("DDD", "Sil\\ne Corp"), ("EEE", None)], "ticker string, name string")
    tags = ["AAA", "BBB", "CCC", "DDD", "EEE"]
    rows = [
        ("1", "Kiska rose. KISKA\n\nöL & GAS fell.", "Kiska rose. KISKA", "öL & GAS fell.", "", "", ""),
        ("2", "KİSKA up. kiſka down. kıska too. Kiskas not", "KİSKA up. kiſka down. kıska too.", "", "", "", ""),
        ("3", "Co. is short. $CCC is not. sil\\ne (EEE) both. xDDD none. DDD", "", "", "$CCC is not.", "DDD", ""),
        ("4", "NYSE: EEE. Kiska and Gas. (EEE) again! EEEs", "Kiska and Gas.", "", "", "", "NYSE: EEE. (EEE) again!"),
        ("5", "nothing here", "", "", "", "", ""),
    ]
    docs = spark.createDataFrame([(r[0], "news", "u", "p", "a", tags, r[1]) for r in rows], "document_id string, source_type string, source_url string, published_at string, available string, tickers array<string>, text string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = tx.attributed_text(docs, universe)
        plan = got._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
        texts = {(r.document_id, r.ticker): r.text for r in got.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert texts == {(r[0], t): r[2 + i] for r in rows for i, t in enumerate(tags)}
    exchanges = re.findall(r"\) Exchange\nInput \[\d+\]: \[(.*)\]\nArguments: hashpartitioning\((.*?), \d+\)", plan)
    assert exchanges and not [e for e in exchanges if re.fullmatch(r"ticker#\d+", e[1]) and re.search(r"\b(text|_s)#", e[0])]
