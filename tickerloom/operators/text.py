"""Preparation of news and filing text: validation, revisions, syndication, sections, chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickerloom.domain import CHUNK_TOKENS, OVERLAP_TOKENS
from tickerloom.functions.columns import clean_lines, first_text, sha
from tickerloom.functions.html import with_visible_text
from tickerloom.session import cut_lineage

# --- fixed values -------------------------------------------------------------------
ZONED = r"(Z|[+-]\d{2}:?\d{2})$"
TRACKING = r"^(?i)(utm_.*|fbclid|gclid)$"
HEADING = r"(?imd)^(?:part\s+[ivx]+[. \t]*)?item\s+\d+[a-z]?[. :\t-]*[^\n]{0,120}$"
LEGAL_SUFFIX = r"(?i)[,\s]+(?:incorporated|inc\.?|corporation|corp\.?|company|co\.?|plc|ltd\.?)(?:[,\s].*)?$"
SENTENCE_BREAK = r"(?<=[.!?])\s+|\n+"
BOILERPLATE = {
    "cover": r"(?i)SECURITIES AND EXCHANGE COMMISSION",
    "toc": r"(?i)Table of Contents",
    "signatures": r"(?i)Pursuant to the requirements of",
}


def zoned_timestamp(value: Column) -> Column:
    """Timestamp of a stamp that names its zone; null for naive or malformed text."""
    return F.when(value.rlike(ZONED), F.try_to_timestamp(value))


def canonical_url(url: Column) -> Column:
    """Normal form of an http(s) URL without tracking parameters and fragment; null otherwise."""
    scheme = F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    rest = F.regexp_replace(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(.*)$", 1), r"#.*$", "")
    host = F.lower(F.regexp_extract(rest, r"^([^/?]*)", 1))
    path = F.regexp_replace(F.regexp_extract(rest, r"^[^/?]*([^?]*)", 1), r"/+$", "")
    pairs = F.split(F.regexp_extract(rest, r"\?(.*)$", 1), "&")

    def usable(p: Column) -> Column:
        key = F.substring_index(p, "=", 1)
        value = F.when(p.contains("="), F.regexp_replace(p, r"^[^=]*=", "")).otherwise("")
        return (value != "") & ~F.try_url_decode(key).rlike(TRACKING)

    def encoded(part: Column) -> Column:
        text = F.url_encode(F.try_url_decode(part))
        return F.replace(F.replace(text, F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))

    def again(p: Column) -> Column:
        key, value = F.substring_index(p, "=", 1), F.regexp_replace(p, r"^[^=]*=", "")
        return F.concat(encoded(key), F.lit("="), encoded(value))

    query = F.array_join(F.transform(F.filter(pairs, usable), again), "&")
    full = F.concat(scheme, F.lit("://"), host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))
    return F.when(scheme.isin("http", "https") & (host != ""), full)


def screened(records: DataFrame, tickers: DataFrame, as_of: Column, html_bodies: bool = True) -> DataFrame:
    """Raw records with parsed fields and ``reason``; null reason means accepted.

    Ticker membership is a semi-join on exploded tags, so the universe may be of any size.
    ``ingest_seq`` must be unique per record.
    """
    tagged = records.select("ingest_seq", F.explode("tickers").alias("ticker"))
    known = (
        tagged.join(tickers.select("ticker"), "ticker", "left_semi")
        .groupBy("ingest_seq")
        .agg(F.array_sort(F.collect_set("ticker")).alias("kept_tickers"))
    )
    d = records
    if html_bodies:
        marked = (F.col("source_type") == "news") & F.col("text").rlike(r"<|&[A-Za-z#]")
        d = with_visible_text(d.withColumn("_markup", F.when(marked, F.col("text"))), "_markup", "_seen")
        d = d.withColumn("text", F.coalesce("_seen", "text")).drop("_markup", "_seen")
    body = F.when(
        F.col("source_type") == "news",
        F.concat_ws("\n", first_text(F.trim("title")), first_text(F.trim(F.coalesce("text", F.lit(""))))),
    ).otherwise(F.coalesce("text", F.lit("")))
    d = d.join(known, "ingest_seq", "left").select(
        "*",
        zoned_timestamp(F.col("published_at")).alias("published"),
        zoned_timestamp(F.col("available_at")).alias("available"),
        zoned_timestamp(F.col("fetched_at")).alias("fetched"),
        F.when(F.col("updated_at").isNotNull(), zoned_timestamp(F.col("updated_at"))).alias("updated"),
        canonical_url(F.col("source_url")).alias("canonical_url"),
        # made by a generator, so that a filter on the reason does not clean the text a second time
        F.explode(F.array(clean_lines(body))).alias("body"),
    )
    invalid = F.lit("invalid_source_record")
    unordered = (F.col("available") < F.col("published")) | (F.col("fetched") < F.col("available"))
    missing_time = F.col("published").isNull() | F.col("available").isNull() | F.col("fetched").isNull()
    reason = (
        F.when(missing_time | unordered, invalid)
        .when(F.col("available") > as_of, "not_available_at_cutoff")
        .when(F.col("kept_tickers").isNull(), invalid)
        .when(F.col("canonical_url").isNull() | (F.col("body") == ""), invalid)
        .when(F.col("updated_at").isNotNull() & F.col("updated").isNull(), invalid)
        .when(F.coalesce("updated", "available") > as_of, "revision_after_cutoff")
    )
    return d.withColumn("reason", reason)


def rejected(screen: DataFrame) -> DataFrame:
    return screen.filter(F.col("reason").isNotNull()).select("document_id", "reason")


def newest_revisions(screen: DataFrame) -> DataFrame:
    """Newest known revision per source article; the first arrival wins equal times.

    max_by over an order struct combines map-side, so a hot article costs one row per task.
    """
    accepted = screen.filter(F.col("reason").isNull())
    revision = F.coalesce("updated", "available")
    key = [F.col("provider").alias("_p"), F.coalesce(first_text(F.col("provider_id")), F.col("document_id")).alias("_i")]
    fields = [c for c in accepted.columns if c != "reason"]
    return (
        accepted.groupBy(*key)
        .agg(
            F.max_by(F.struct(*fields), F.struct(revision, -F.col("ingest_seq"))).alias("d"),
            F.min("ingest_seq").alias("position"),
        )
        .select("d.*", "position")
    )


def syndicated(revisions: DataFrame) -> DataFrame:
    """One document per (source_type, canonical_url), merged from all its copies.

    Tickers and sentiment entries merge through (group, ticker) rows first, so the arrays
    built at the end are bounded by the universe, however many copies a story has.
    """
    key = ["source_type", "canonical_url"]
    order = F.struct(F.coalesce("content_available", F.lit(False)), F.length("body"), -F.col("position"))
    fields = [c for c in revisions.columns if c not in (*key, "tickers", "kept_tickers", "provider_sentiment", "available", "fetched")]
    chosen = revisions.groupBy(*key).agg(
        F.max_by(F.struct(*fields), order).alias("d"),
        F.max("available").alias("available"),
        F.max("fetched").alias("fetched"),
        F.count(F.lit(1)).alias("source_count"),
        F.bool_or(F.col("provider_sentiment").isNotNull()).alias("_scored"),
    )
    per_ticker = (
        revisions.select(*key, "position", "provider_sentiment", F.explode("kept_tickers").alias("ticker"))
        .groupBy(*key, "ticker")
        .agg(F.count(F.lit(1)).alias("_n"))
        .groupBy(*key)
        .agg(F.array_sort(F.collect_list("ticker")).alias("tickers"))
    )
    entries = (
        revisions.select(*key, "position", F.explode("provider_sentiment").alias("ticker", "payload"))
        .groupBy(*key, "ticker")
        .agg(F.max_by("payload", "position").alias("payload"))
        .groupBy(*key)
        .agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("ticker", "payload")))).alias("provider_sentiment"))
    )
    merged = chosen.join(per_ticker, key).join(entries, key, "left")
    return merged.select(
        *key,
        *[F.col(f"d.{c}").alias(c) for c in fields if c not in ("text", "content_hash", "body", "position")],
        F.col("d.body").alias("text"),
        sha(F.col("d.body")).alias("content_hash"),
        F.col("d.content_hash").alias("source_content_hash"),
        "tickers",
        "provider_sentiment",
        "available",
        "fetched",
        "source_count",
    )


def document_sources(revisions: DataFrame, documents: DataFrame) -> DataFrame:
    """(document_id, source_document_id) rows; a long table, because one story may have any number of copies."""
    chosen = documents.select("source_type", "canonical_url", "document_id")
    copies = revisions.select("source_type", "canonical_url", F.col("document_id").alias("source_document_id"))
    return chosen.join(copies, ["source_type", "canonical_url"]).select("document_id", "source_document_id")


def prepare_documents(records: DataFrame, tickers: DataFrame, as_of: Column, html_bodies: bool = True) -> DataFrame:
    # three aggregates read the revisions, so they are stored once
    return syndicated(cut_lineage(newest_revisions(screened(records, tickers, as_of, html_bodies))))


# --- sections and chunks ------------------------------------------------------------


def sections(documents: DataFrame) -> DataFrame:
    """Part/Item sections with their start offset; the lead-in is called Document."""
    mark = "\x01"
    marked = F.regexp_replace("text", HEADING, mark + "$0")
    # outer: else a filter on the size of the parts is inferred, which cleans and marks the text a second time
    parts = documents.withColumn("_parts", F.split(marked, mark, -1)).select(
        "*", F.posexplode_outer("_parts").alias("_i", "part_text")
    )
    start = F.aggregate(F.slice("_parts", 1, F.col("_i")), F.lit(0), lambda acc, p: acc + F.length(p))
    named = parts.withColumn("section_start", start).filter(F.col("part_text") != "")
    title = F.trim(F.regexp_extract("part_text", HEADING, 0))
    return named.withColumn("section", F.when(F.col("section_start") == 0, "Document").otherwise(title)).drop("_parts", "_i")


def chunk_documents(documents: DataFrame, tokens: int = CHUNK_TOKENS, overlap: int = OVERLAP_TOKENS) -> DataFrame:
    """Overlapping whitespace-token chunks with character offsets into the document text.

    The text is cut into steps of (tokens - overlap) by one regular expression; a chunk is
    a step plus the first ``overlap`` tokens of the next.  Work is linear in the text.
    """
    step = tokens - overlap
    step_re = rf"(?U)(?:\s*+\S++){{1,{step}}}+"
    head_re = rf"(?U)^(?:\s*+\S++){{1,{overlap}}}+"
    # made by a generator, so that the filter on their number does not cut the text again
    s = sections(documents).withColumn("_steps", F.explode(F.array(F.regexp_extract_all("part_text", F.lit(step_re), F.lit(0)))))
    n = F.size("_steps")
    last_words = F.size(F.regexp_extract_all(F.element_at("_steps", -1), F.lit(r"(?U)\S+"), F.lit(0)))
    count = F.when(n == 0, 0).when((n > 1) & (last_words <= overlap), n - 1).otherwise(n)
    # running end offset of every step
    ends = F.aggregate(
        "_steps",
        F.array().cast("array<int>"),
        lambda acc, p: F.array_append(acc, F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0)) + F.length(p)),
    )
    s = s.filter(n > 0).withColumn("_count", count).withColumn("_ends", ends)
    s = s.withColumn("_k", F.explode(F.sequence(F.lit(0), F.col("_count") - 1)))
    own = F.element_at("_steps", F.col("_k") + 1)
    following = F.coalesce(F.try_element_at("_steps", F.col("_k") + 2), F.lit(""))
    tail = F.regexp_extract(following, head_re, 0)
    before = F.when(F.col("_k") == 0, 0).otherwise(F.element_at("_ends", F.greatest(F.col("_k"), F.lit(1))))
    lead = F.length(F.regexp_extract(own, r"(?U)^\s*", 0))
    s = s.select(
        "*",
        (F.col("section_start") + before + lead).alias("start_char"),
        (F.col("section_start") + F.element_at("_ends", F.col("_k") + 1) + F.length(tail)).alias("end_char"),
        F.size(F.regexp_extract_all(F.concat(own, tail), F.lit(r"(?U)\S+"), F.lit(0))).alias("token_count"),
    )
    text = F.substring(F.col("text"), F.col("start_char") + 1, F.col("end_char") - F.col("start_char"))
    identity = F.concat_ws(":", "document_id", "content_hash", "start_char", "end_char")
    return s.select(
        sha(identity).alias("chunk_id"),
        *[c for c in documents.columns if c not in ("text", "content_hash")],
        F.col("content_hash").alias("document_hash"),
        "section",
        "start_char",
        "end_char",
        "token_count",
        text.alias("text"),
        sha(text).alias("content_hash"),
    )


def article_chunk(documents: DataFrame) -> DataFrame:
    """One chunk per short article and the text to embed for it."""
    return documents.select(
        F.concat(F.lit("extra:"), F.col("document_id")).alias("chunk_id"),
        *documents.columns,
        F.concat_ws(". ", first_text(F.col("title")), F.col("text")).alias("embed_text"),
    )


def evidence_union(frozen: DataFrame, extra: DataFrame) -> DataFrame:
    return frozen.unionByName(extra, allowMissingColumns=True)


# --- attribution --------------------------------------------------------------------


def quoted(text: Column) -> Column:
    return F.concat(F.lit(r"\Q"), text, F.lit(r"\E"))


def company_pattern(ticker: Column, name: Column) -> Column:
    """Regular expression that finds a company by name or by explicit symbol notation.

    A row of alternatives, each with the least length its plain text needs: the full and the short name
    (any case, as whole words), the cash-tag, bracket and exchange notations, and the bare symbol.
    """
    article_free = F.regexp_replace(name, r"(?i)^the\s+", "")
    brief = F.trim(F.regexp_replace(article_free, LEGAL_SUFFIX, ""))
    rows = [
        (name, 4, r"(?iU:\b", r"\b)"),
        (brief, 4, r"(?iU:\b", r"\b)"),
        (ticker, 0, r"\$", r"\b"),
        (ticker, 0, r"\(", r"\)"),
        (ticker, 0, r"(?:NASDAQ|NYSE):\s*", r"\b"),
        (ticker, 3, "(?<![A-Za-z0-9])", "(?![A-Za-z0-9])"),
    ]
    return F.array_join(
        F.array_compact(F.array(*[F.when(F.length(plain) >= least, F.concat(F.lit(front), quoted(plain), F.lit(back))) for plain, least, front, back in rows])), "|"
    )


def sentences(text: Column) -> Column:
    return F.split(text, SENTENCE_BREAK)


def company_names(universe: DataFrame) -> DataFrame:
    """(ticker, pattern, brief, plain): what finds a company in a text, and its short name in lower case for ``may_name``."""
    name, ticker = F.col("name"), F.col("ticker")
    brief = F.trim(F.regexp_replace(F.regexp_replace(name, r"(?i)^the\s+", ""), LEGAL_SUFFIX, ""))
    plain = F.rlike(F.concat(name, ticker), F.lit(r"^[ -\[\]-~]*$"))
    return universe.select("ticker", company_pattern(ticker, name).alias("pattern"), F.lower(brief).alias("brief"), F.coalesce(plain, F.lit(False)).alias("plain"))


def may_name(text: Column, lowered: Column, company: Column) -> Column:
    """False only where the company's pattern finds nothing in the text: neither its symbol nor its short name is there.

    The long name holds the short one.  Names that are not plain ASCII, and texts with a letter that equals an ASCII one
    only in some cases, are left to the pattern.
    """
    folds = F.contains(text, F.lit("\u0130")) | F.contains(text, F.lit("\u0131")) | F.contains(text, F.lit("\u017f"))
    return F.contains(text, company["ticker"]) | F.contains(lowered, company["brief"]) | ~company["plain"] | folds


def attributed_text(documents: DataFrame, universe: DataFrame) -> DataFrame:
    """Per (news document, ticker): the sentences that name this ticker and no other tagged one.

    Only tags meet the names; a text is searched for plain strings first, and patterns are tried on sentences that hold one.
    """
    news = documents.filter(F.col("source_type") == "news")
    tagged = news.select("document_id", "source_url", "published_at", "available", F.explode("tickers").alias("ticker"))
    tags = news.select("document_id", "tickers", F.posexplode("tickers").alias("at", "ticker")).join(company_names(universe), "ticker")
    named = tags.groupBy("document_id", "tickers").agg(F.collect_set(F.struct("at", "ticker", "pattern", "brief", "plain")).alias("names"))
    texts = news.select("document_id", "tickers", "text", F.lower("text").alias("lowered")).join(named, ["document_id", "tickers"])
    met = texts.select("document_id", "text", "lowered", F.explode("names").alias("company")).filter(may_name(F.col("text"), F.col("lowered"), F.col("company")))
    numbered = F.transform(sentences(F.col("text")), lambda s, i: F.named_struct(F.lit("pos"), i, F.lit("sentence"), s))
    names = lambda x: may_name(x["sentence"], F.lower(x["sentence"]), F.col("company")) & F.rlike(x["sentence"], F.col("company.pattern"))
    hits = met.select("document_id", F.col("company.ticker").alias("ticker"), F.explode(F.filter(numbered, names)).alias("h")).select("document_id", "ticker", "h.*")
    single = (
        hits.groupBy("document_id", "pos")
        .agg(F.count(F.lit(1)).alias("n"), F.max("ticker").alias("ticker"), F.max("sentence").alias("sentence"))
        .filter("n = 1")
    )
    joined = single.groupBy("document_id", "ticker").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "sentence"))), lambda x: x["sentence"]), " ").alias("text")
    )
    out = tagged.join(joined, ["document_id", "ticker"], "left").withColumn("text", F.coalesce("text", F.lit("")))
    status = F.when(F.col("text") != "", "pending").otherwise("unavailable_ambiguous_attribution")
    return out.withColumn("status", status)


def unscored(inputs: DataFrame, cache: DataFrame) -> DataFrame:
    """Distinct pending texts whose hash is not in the score cache."""
    pending = inputs.filter("status = 'pending'").select(sha(F.col("text")).alias("input_hash"), "text")
    return pending.groupBy("input_hash").agg(F.any_value("text").alias("text")).join(cache, "input_hash", "left_anti")


def scored(inputs: DataFrame, cache: DataFrame) -> DataFrame:
    """Attach cached model scores (input_hash, score, positive, negative, neutral, input_tokens)."""
    keyed = inputs.withColumn("input_hash", F.when(F.col("status") == "pending", sha(F.col("text"))))
    j = keyed.join(cache, "input_hash", "left")
    status = F.when((F.col("status") == "pending") & F.col("score").isNotNull(), "scored").when(
        F.col("status") == "pending", "not_run"
    ).otherwise(F.col("status"))
    return j.withColumn("status", status).withColumn("input_truncated", F.col("input_tokens") > 512)


def preparation_manifest(screen: DataFrame, documents: DataFrame, chunks: DataFrame, inputs: DataFrame) -> DataFrame:
    """One row of counts; each count is its own aggregate."""
    one = screen.agg(
        F.count(F.lit(1)).alias("records"),
        *[
            F.count_if(F.col("reason") == r).alias(r)
            for r in ("not_available_at_cutoff", "revision_after_cutoff", "invalid_source_record")
        ],
    )
    count = F.count(F.lit(1))
    return one.select(
        "*",
        documents.agg(count).scalar().alias("documents"),
        chunks.agg(count).scalar().alias("chunks"),
        inputs.agg(count).scalar().alias("sentiment_inputs"),
        inputs.agg(F.count_if(F.col("status") == "pending")).scalar().alias("sentiment_pending"),
        F.lit(CHUNK_TOKENS).alias("chunk_tokens"),
        F.lit(OVERLAP_TOKENS).alias("overlap_tokens"),
    )


def snippet(text: Column, size: int = 500) -> Column:
    """Tags dropped, common character references resolved, blanks collapsed, first characters."""
    t = F.regexp_replace(text, r"<[^>]+>", " ")
    for entity, plain in (
        ("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&amp;", "&"),
    ):
        t = F.replace(t, F.lit(entity), F.lit(plain))
    return F.substring(F.trim(F.regexp_replace(t, r"[ \t]+", " ")), 1, size)


# --- text gate ----------------------------------------------------------------------


def source_problems(records: DataFrame, tickers: DataFrame, cutoff: Column) -> DataFrame:
    """(kind, id) rows of every broken source rule."""
    p, a, f, u = (zoned_timestamp(F.col(n)) for n in ("published_at", "available_at", "fetched_at", "updated_at"))
    invalid = p.isNull() | a.isNull() | f.isNull()
    kinds = F.array_compact(
        F.array(
            F.when(invalid, "source_timestamp_invalid"),
            F.when(~invalid & ~((p <= a) & (a <= f) & (f <= cutoff)), "source_timestamp_order"),
            F.when(~invalid & (u > a), "revision_not_yet_available"),
            F.when(sha(F.col("text")) != F.col("content_hash"), "source_content_hash"),
            F.when(F.size("tickers") == 0, "source_tickers"),
        )
    )
    rules = records.select(F.explode(kinds).alias("kind"), F.col("document_id").alias("id"))
    twice = (
        records.groupBy("document_id")
        .agg(F.count(F.lit(1)).alias("n"))
        .filter("n > 1")
        .select(F.lit("duplicate_source_id").alias("kind"), F.col("document_id").alias("id"))
    )
    foreign = (
        records.select(F.col("document_id").alias("id"), F.explode("tickers").alias("ticker"))
        .join(tickers.select("ticker"), "ticker", "left_anti")
        .select(F.lit("source_tickers").alias("kind"), "id")
        .distinct()
    )
    return rules.unionByName(twice).unionByName(foreign)


def document_problems(documents: DataFrame, links: DataFrame, records: DataFrame) -> DataFrame:
    """Prepared documents against the sources they were merged from."""
    source = records.select(
        F.col("document_id").alias("source_document_id"),
        zoned_timestamp(F.col("available_at")).alias("_av"),
        F.col("tickers").alias("_t"),
    )
    j = links.join(source, "source_document_id", "left")
    merged = j.groupBy("document_id").agg(
        F.count_if(F.col("_av").isNull() & F.col("_t").isNull()).alias("_unknown"), F.max("_av").alias("_max")
    )
    union = j.select("document_id", F.explode("_t").alias("t")).distinct()
    have = documents.select("document_id", F.explode("tickers").alias("t"))
    extra = have.join(union, ["document_id", "t"], "left_anti").select(F.lit("merged_tickers").alias("kind"), F.col("document_id").alias("id"))
    d = documents.join(merged, "document_id", "left")
    kinds = F.array_compact(
        F.array(
            F.when(F.coalesce(F.col("_unknown"), F.lit(1)) > 0, "unknown_source_reference"),
            F.when(F.col("available") != F.col("_max"), "merged_availability"),
            F.when(sha(F.col("text")) != F.col("content_hash"), "prepared_content_hash"),
        )
    )
    rules = d.select(F.explode(kinds).alias("kind"), F.col("document_id").alias("id"))
    urls = (
        documents.groupBy("source_type", "canonical_url")
        .agg(F.count(F.lit(1)).alias("n"), F.min("document_id").alias("id"))
        .filter("n > 1")
        .select(F.lit("duplicate_canonical_url").alias("kind"), "id")
    )
    return rules.unionByName(extra.distinct()).unionByName(urls)


def chunk_problems(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """Chunks against their parent documents, and documents without chunks."""
    parents = documents.select(
        "document_id",
        F.col("text").alias("_text"),
        F.col("content_hash").alias("_hash"),
        *[F.col(c).alias(f"_{c}") for c in ("source_url", "source_type", "tickers", "available")],
    )
    j = chunks.join(parents, "document_id", "left")
    a, b = F.col("start_char"), F.col("end_char")
    inside = (a >= 0) & (a < b) & (b <= F.length("_text"))
    same = F.substring(F.col("_text"), a + 1, b - a) == F.col("text")
    identity = sha(F.concat_ws(":", "document_id", "_hash", "start_char", "end_char"))
    orphan = F.col("_text").isNull()
    kinds = F.array_compact(
        F.array(
            F.when(orphan, "chunk_missing_parent"),
            F.when(~orphan & ~(inside & same), "chunk_offset"),
            F.when(~orphan & (F.col("chunk_id") != identity), "chunk_identity"),
            F.when(~F.col("token_count").between(1, CHUNK_TOKENS), "declared_token_bound"),
            *[
                F.when(~orphan & ~F.col(c).eqNullSafe(F.col(f"_{c}")), f"chunk_{c}")
                for c in ("source_url", "source_type", "tickers", "available")
            ],
        )
    )
    rules = j.select(F.explode(kinds).alias("kind"), F.col("chunk_id").alias("id"))
    twice = (
        chunks.groupBy("chunk_id")
        .agg(F.count(F.lit(1)).alias("n"))
        .filter("n > 1")
        .select(F.lit("duplicate_chunk_id").alias("kind"), F.col("chunk_id").alias("id"))
    )
    empty = documents.join(chunks.select("document_id"), "document_id", "left_anti").select(
        F.lit("document_without_chunks").alias("kind"), F.col("document_id").alias("id")
    )
    return rules.unionByName(twice).unionByName(empty)


def corpus_profile(chunks: DataFrame) -> DataFrame:
    """One row: chunks, exact copies in excess, lead-in chunks, boilerplate markers."""
    # one pass: counted by text first, so that copies are known
    n = F.count(F.lit(1)).alias("n")
    lead = F.count_if(F.col("section") == "Document").alias("lead_in_chunks")
    per = chunks.groupBy("content_hash").agg(n, lead, *[F.count_if(F.col("text").rlike(p)).alias(k) for k, p in BOILERPLATE.items()])
    sums = [F.coalesce(F.sum(k), F.lit(0)).alias(k) for k in ("lead_in_chunks", *BOILERPLATE)]
    return per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("chunks"), *sums, F.sum(F.col("n") - 1).alias("exact_duplicates_excess"))


def sentiment_problems(scores: DataFrame, documents: DataFrame) -> DataFrame:
    """(kind, id) of score rows that break provenance, range, probability or coverage rules."""
    news = documents.filter("source_type = 'news'")
    pairs = news.select("document_id", F.explode("tickers").alias("ticker"), F.col("source_url").alias("_url"), F.col("published_at").alias("_pub"))
    j = scores.join(pairs, ["document_id", "ticker"], "left")
    done = F.col("status") == "scored"
    total = F.col("positive") + F.col("negative") + F.col("neutral")
    sound = (F.abs(total - 1) <= 1e-5) & (F.abs(F.col("score") - (F.col("positive") - F.col("negative"))) <= 1e-6)
    kinds = F.array_compact(
        F.array(
            F.when(F.col("_pub").isNull(), "sentiment_parent"),
            F.when((F.col("source_url") != F.col("_url")) | (F.col("published_at") != F.col("_pub")), "sentiment_provenance"),
            F.when(done & ~F.coalesce(F.col("score").between(-1.0, 1.0), F.lit(False)), "sentiment_score"),
            F.when(done & ~F.coalesce(sound, F.lit(False)), "sentiment_probabilities"),
            F.when(~done & F.col("score").isNotNull(), "missing_sentiment_not_null"),
        )
    )
    identity = F.concat_ws(":", "document_id", "ticker").alias("id")
    rules = j.select(F.explode(kinds).alias("kind"), identity)
    absent = pairs.join(scores.select("document_id", "ticker"), ["document_id", "ticker"], "left_anti")
    return rules.unionByName(absent.select(F.lit("missing_sentiment_association").alias("kind"), identity))


def coverage_problems(documents: DataFrame, coverage: DataFrame) -> DataFrame:
    """Filing documents whose issuer number differs from the coverage record of their ticker."""
    tagged = documents.filter("source_type = 'sec'").select("document_id", "cik", F.explode("tickers").alias("ticker"))
    j = tagged.join(coverage.select("ticker", F.col("cik").alias("_cik")), "ticker", "left")
    return j.filter(~F.col("cik").eqNullSafe(F.col("_cik"))).select(F.lit("coverage_cik").alias("kind"), F.col("document_id").alias("id")).distinct()
