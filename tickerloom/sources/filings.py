"""Filing lists, filing documents and XBRL facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickerloom.functions.columns import sha
from tickerloom.sources.landing import keep_last

# --- fixed values -------------------------------------------------------------------
EASTERN = "America/New_York"
ACCESSION = r"^\d{10}-\d{2}-\d{6}$"
DOMESTIC_ANNUAL, FOREIGN_ANNUAL = "10-K", ["20-F", "40-F"]
FORMS = ["10-K", "10-Q", "20-F", "40-F", "8-K", "6-K"]
FACT_FORMS = ["10-K", "10-K/A", "10-Q", "10-Q/A", "20-F", "20-F/A", "40-F", "40-F/A"]
CURRENT_DAYS = 90
NORMALIZATION_VERSION = 2
FILING_COLUMNS = ["accessionNumber", "form", "filingDate", "reportDate", "acceptanceDateTime", "primaryDocument"]
# extra CIKs of issuers whose filings sit under a former number
CIK_ALIASES = [("XOM", 34088)]


def filing_rows(tables: DataFrame, *keys: str) -> DataFrame:
    """Parallel arrays to rows; short arrays pad with null. ``arrays_zip`` does the padding."""
    zipped = F.arrays_zip(*[F.col(c) for c in FILING_COLUMNS])
    rows = tables.select(*keys, F.explode(zipped).alias("r")).select(*keys, "r.*")
    return rows.filter(F.col("accessionNumber").isNotNull())


def acceptance_time(raw: Column, filed: Column) -> Column:
    """UTC instant; a stamp without zone is Eastern time, a missing one is the end of the filing day."""
    zoned = raw.rlike(r"(Z|[+-]\d{2}:?\d{2})$")
    local = F.to_utc_timestamp(F.try_to_timestamp(raw), EASTERN)
    end_of_day = F.to_utc_timestamp(F.try_to_timestamp(F.concat(filed, F.lit(" 23:59:59.999999"))), EASTERN)
    return F.when(F.coalesce(raw, F.lit("")) == "", end_of_day).when(zoned, F.try_to_timestamp(raw)).otherwise(local)


def select_filings(rows: DataFrame, as_of: Column) -> DataFrame:
    """Filings to read per issuer: two annual, four quarterly (domestic only), all current ones of 90 days.

    Ranks run per (cik, form); only the ranked heads are shuffled for the capped forms, and
    the issuer class comes from one struct maximum.
    """
    accepted = acceptance_time(F.col("acceptanceDateTime"), F.col("filingDate"))
    known = rows.withColumn("accepted", accepted).filter(
        F.col("form").isin(*FORMS) & (F.col("accepted") <= as_of) & F.col("accessionNumber").rlike(ACCESSION)
    )
    known = keep_last(known.withColumn("_seq", F.col("accepted")), ["cik", "accessionNumber"], "_seq")
    annual = F.col("form").isin(DOMESTIC_ANNUAL, *FOREIGN_ANNUAL)
    newest = known.filter(annual).groupBy("cik").agg(F.max_by("form", F.struct("accepted", "accessionNumber")).alias("annual_form"))
    j = known.join(newest, "cik", "left")
    foreign = F.coalesce(F.col("annual_form").isin(*FOREIGN_ANNUAL), F.lit(False))
    kind = F.when(foreign, F.col("annual_form")).otherwise(DOMESTIC_ANNUAL)
    w = Window.partitionBy("cik", "form").orderBy(F.desc("accepted"), F.desc("accessionNumber"))
    # two literal limits, so that heads are taken before the shuffle
    quarterly = j.filter(~foreign & (F.col("form") == "10-Q")).withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= 4)
    yearly = j.filter((F.col("form") == kind) & (F.col("form") != "10-Q")).withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= 2)
    capped = quarterly.unionByName(yearly).drop("_rn")
    current = F.when(foreign, "6-K").otherwise("8-K")
    recent = j.filter((F.col("form") == current) & (F.col("accepted") >= as_of - F.make_dt_interval(F.lit(CURRENT_DAYS))))
    return capped.unionByName(recent).drop("annual_form")


def filing_documents(selected: DataFrame, texts: DataFrame) -> DataFrame:
    """Document rows of selected filings (cik, ticker, issuer) joined with their normalised text."""
    j = selected.join(texts.select("cik", "accessionNumber", "text"), ["cik", "accessionNumber"])
    stamp = F.date_format("accepted", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    accession = F.replace("accessionNumber", F.lit("-"), F.lit(""))
    return j.filter(F.col("text") != "").select(
        F.concat_ws(":", F.lit("sec"), "cik", "accessionNumber").alias("document_id"),
        F.lit("sec").alias("source_type"),
        F.lit("SEC EDGAR").alias("provider"),
        F.array("ticker").alias("tickers"),
        stamp.alias("published_at"),
        stamp.alias("available_at"),
        F.concat(F.lit("https://www.sec.gov/Archives/edgar/data/"), F.col("cik").cast("string"), F.lit("/"), accession, F.lit("/"), F.col("primaryDocument")).alias("source_url"),
        F.concat(F.col("issuer"), F.lit(" "), F.col("form"), F.lit(" ("), F.col("filingDate"), F.lit(")")).alias("title"),
        "text",
        sha(F.col("text")).alias("content_hash"),
        "cik",
        F.lit(NORMALIZATION_VERSION).alias("normalization_version"),
        "form",
        F.col("filingDate").alias("filing_date"),
    )


def merge_filings(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Keyed merge: text is replaced only where its normalisation version changed; tickers are united."""
    a, b = existing.alias("a"), incoming.alias("b")
    j = a.join(b, F.col("a.document_id") == F.col("b.document_id"), "outer")
    redo = F.col("a.document_id").isNull() | (F.col("a.normalization_version") != F.col("b.normalization_version"))
    fresh = F.col("b.document_id").isNotNull() & F.coalesce(redo, F.lit(False))
    out = []
    for c in existing.columns:
        old, new = F.col(f"a.{c}"), F.col(f"b.{c}")
        if c == "tickers":
            none = F.array().cast("array<string>")
            out.append(F.array_sort(F.array_union(F.coalesce(old, none), F.coalesce(new, none))).alias(c))
        elif c in ("text", "content_hash", "normalization_version"):
            out.append(F.when(fresh, new).otherwise(old).alias(c))
        else:
            out.append(F.coalesce(old, new).alias(c))
    return j.select(*out)


# --- facts --------------------------------------------------------------------------


def read_bulk(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """The sub and num tables of unpacked quarterly data sets (all text columns, split-based scan)."""
    options = {"sep": "\t", "header": True, "quote": "", "nullValue": "\x00"}
    sub = spark.read.options(**options).csv(f"{folder}/*/sub.txt").select("adsh", "cik", "form", "fy", "fp", "filed")
    num = spark.read.options(**options).csv(f"{folder}/*/num.txt")
    return sub, num


def bulk_facts(sub: DataFrame, num: DataFrame, ciks: DataFrame, concepts: list[str]) -> DataFrame:
    """Consolidated annual and instant USD facts of known issuers; last record per key wins."""
    filings = sub.filter(F.col("form").isin(*FACT_FORMS)).join(ciks, F.col("cik").cast("bigint") == ciks["issuer_cik"])
    empty = lambda name: F.coalesce(F.col(name), F.lit("")) == ""
    keep = (
        F.col("tag").isin(*concepts) & (F.col("uom") == "USD") & F.col("qtrs").isin("0", "4")
        & F.col("version").startswith("us-gaap/") & empty("coreg") & ~empty("value")
    )
    if "segments" in num.columns:
        keep = keep & empty("segments")
    end = F.to_date("ddate", "yyyyMMdd")
    j = num.filter(keep).join(filings, "adsh")
    rows = j.select(
        "ticker",
        F.col("issuer_cik").alias("cik"),
        F.col("tag").alias("concept"),
        F.when(F.col("qtrs") == "4", F.date_add(F.add_months(end, -12), 1)).alias("start"),
        end.alias("end"),
        F.col("value").cast("double").alias("val"),
        "form",
        F.expr("try_cast(fy AS int)").alias("fy"),
        F.when(F.col("fp") != "", F.col("fp")).alias("fp"),
        F.to_date("filed", "yyyyMMdd").alias("filed"),
        F.col("adsh").alias("accn"),
        "ingest_seq",
    )
    return keep_last(rows, ["accn", "concept", "start", "end"], "ingest_seq")


def missing_quarters(present: DataFrame) -> DataFrame:
    """Quarters absent between the first and last present one (column q as 2020q1)."""
    n = F.substring("q", 1, 4).cast("int") * 4 + F.substring("q", 6, 1).cast("int") - 1
    have = present.select(n.alias("n")).distinct()
    span = have.agg(F.sequence(F.min("n"), F.max("n")).alias("s")).select(F.explode("s").alias("n"))
    gap = span.join(have, "n", "left_anti")
    return gap.select(F.concat(F.floor(F.col("n") / 4).cast("string"), F.lit("q"), (F.col("n") % 4 + 1).cast("string")).alias("q"))


def fact_coverage(tickers: DataFrame, ciks: DataFrame, facts: DataFrame) -> DataFrame:
    n = facts.groupBy("ticker").agg(F.count(F.lit(1)).alias("facts"))
    mapped = ciks.select("ticker", F.lit(True).alias("_m")).distinct()
    j = tickers.join(n, "ticker", "left").join(mapped, "ticker", "left")
    status = F.when(F.col("facts") > 0, "collected").when(F.col("_m"), "no_supported_facts").otherwise("failed")
    return j.select("ticker", status.alias("status"), F.coalesce("facts", F.lit(0)).alias("facts"))


def ambiguous_tickers(entries: DataFrame) -> DataFrame:
    """Tickers the issuer list maps to more than one number."""
    per = entries.groupBy(F.upper("ticker").alias("ticker")).agg(F.min("cik").alias("low"), F.max("cik").alias("high"))
    return per.filter("low <> high")


def issuer_map(entries: DataFrame, universe: DataFrame) -> DataFrame:
    """(ticker, issuer_cik) of universe stocks, former numbers added; raises for an ambiguous list."""
    if not ambiguous_tickers(entries).isEmpty():
        raise ValueError("The issuer list maps a ticker to two numbers")
    stocks = universe.filter("asset_type = 'stock'").select(F.upper("ticker").alias("ticker"))
    direct = entries.select(F.upper("ticker").alias("ticker"), F.col("cik").alias("issuer_cik")).distinct().join(stocks, "ticker", "left_semi")
    extra = entries.sparkSession.createDataFrame(CIK_ALIASES, "ticker string, issuer_cik bigint").join(stocks, "ticker", "left_semi")
    return direct.unionByName(extra.select("ticker", F.col("issuer_cik").cast(direct.schema["issuer_cik"].dataType)))


COMPANY_FACTS = "struct<facts:struct<`us-gaap`:map<string,struct<units:map<string,array<struct<start:string,end:string,val:double,form:string,fy:int,fp:string,filed:string,accn:string>>>>>>>"


def flatten_company_facts(documents: DataFrame) -> DataFrame:
    """Nested company facts (ticker, json) to one row per USD value with an end and a filing date."""
    parsed = documents.select("ticker", F.from_json("json", COMPANY_FACTS).alias("d"))
    concepts = parsed.select("ticker", F.explode(F.col("d.facts.`us-gaap`")).alias("concept", "c"))
    values = concepts.select("ticker", "concept", F.explode(F.try_element_at("c.units", F.lit("USD"))).alias("v"))
    return values.select("ticker", "concept", "v.*").filter(
        F.col("form").isin(*FACT_FORMS) & F.col("end").isNotNull() & F.col("filed").isNotNull()
    )


def stored_facts(table: DataFrame) -> DataFrame:
    """Stored fact columns under the names the signal reads."""
    return table.withColumnsRenamed({"start_date": "start", "end_date": "end", "value": "val", "filed_date": "filed"})
