"""Grounded, cited explanations of a signal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickerloom.functions.columns import first_text, kept

# --- fixed values: wording and guard patterns ------------------------------------------
BANNED = [
    r"\bstrong buy\b",
    r"\bbuy now\b",
    r"\bsell now\b",
    r"\byou should (buy|sell)\b",
    r"\b(guaranteed|surefire|can'?t lose|risk[- ]free)\b",
    r"\bbuy more\b",
    r"\bdump\b",
]
MONEY = r"(?i)\$\s?\d[\d,]*(?:\.\d+)?\s?(?:billion|million|bn|m|k)?"
CAVEATS = [
    "This 10-day forecast is a development-fold estimate, not a guaranteed prediction.",
    "Signals guide research priority (Explore / Monitor / Caution), not trading decisions.",
    "News sentiment comes from a third-party provider and is experimental.",
]
PROVISIONAL_CAVEAT = (
    "This news-driven change of stance is experimental and not yet validated against historical performance."
)
PROVISIONAL_NOTE = (
    "- Note: recent news changed this from the forecast-only stance; treat it as experimental/provisional pending validation."
)
LEADS = {
    "EXPLORE": "Explore — worth a closer look",
    "MONITOR": "Monitor — keep on your radar",
    "CAUTION": "Caution — higher risk, research carefully",
}


def template(ticker: Column, stance: Column, trace: Column, provisional: Column, evidence: Column) -> Column:
    """Explanation text; ``evidence`` is an array of structs title, source_type, published_at, snippet."""
    lead = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in LEADS.items() for x in kv]), stance), stance)
    has_evidence = F.coalesce(F.size(evidence), F.lit(0)) > 0

    def cited(ev: Column, i: Column) -> Column:
        day = F.substring(F.coalesce(ev["published_at"], F.lit("")), 1, 10)
        head = F.concat(
            F.lit("["), (i + 1).cast("string"), F.lit("] "), F.coalesce(first_text(ev["title"]), F.lit("(untitled)")),
            F.lit(" — "), F.coalesce(ev["source_type"], F.lit("source")),
            F.when(day != "", F.concat(F.lit(", "), day)).otherwise(""),
        )
        quote = F.when(first_text(ev["snippet"]).isNotNull(), F.concat(F.lit("\n    “"), ev["snippet"], F.lit("”")))
        return F.concat(head, F.coalesce(quote, F.lit("")))

    none = F.concat(
        F.lit("No recent news or filing evidence was found for "), ticker,
        F.lit("; this explanation reflects the deterministic signal only."),
    )
    lines = F.concat(
        F.array(F.concat(lead, F.lit(" for "), ticker, F.lit("."))),
        kept(F.when(F.size(trace) > 0, "Why this signal:")),
        F.transform(trace, lambda t: F.concat(F.lit("- "), t)),
        kept(F.when(provisional, PROVISIONAL_NOTE)),
        F.when(has_evidence, F.concat(F.array(F.lit("Supporting evidence:")), F.transform(evidence, cited))).otherwise(F.array(none)),
    )
    return F.array_join(lines, "\n")


def violations(text: Column, evidence: Column) -> Column:
    """Guard findings: advice wording, and money amounts the evidence does not hold."""
    lowered = F.lower(text)
    advice = kept(
        *[F.when(lowered.rlike(p), F.lit(f"contains advice language matching /{p}/")) for p in BANNED]
    )
    blob = F.array_join(
        F.transform(evidence, lambda e: F.concat(F.coalesce(e["snippet"], F.lit("")), F.lit(" "), F.coalesce(e["title"], F.lit("")))), " "
    )
    amounts = F.transform(F.regexp_extract_all(text, F.lit(MONEY), F.lit(0)), F.trim)
    invented = F.filter(amounts, lambda a: ~F.contains(F.coalesce(blob, F.lit("")), a))
    named = F.transform(invented, lambda a: F.concat(F.lit("cites a financial figure not present in evidence: "), a))
    return F.concat(advice, named)


def explain(df: DataFrame) -> DataFrame:
    """Add ``explanation`` to rows with ticker, signal and evidence (and an optional ``rewrite``).

    An offered rewrite replaces the template only when the guard finds nothing in it.
    """
    s = F.col("signal")
    stance = F.coalesce(s["news_aware_stance"], s["baseline_stance"])
    text = template(F.col("ticker"), stance, s["decision_trace"], s["provisional"], F.col("evidence"))
    d = df.withColumn("_template", text)
    chosen = F.col("_template")
    if "rewrite" in df.columns:
        clean = (F.size(violations(F.col("rewrite"), F.col("evidence"))) == 0) & (F.col("rewrite") != "")
        chosen = F.when(clean, F.col("rewrite")).otherwise(chosen)
    citations = F.transform(
        "evidence",
        lambda e: F.named_struct(
            F.lit("title"), e["title"], F.lit("source_type"), e["source_type"],
            F.lit("published_at"), e["published_at"], F.lit("source_url"), e["source_url"],
        ),
    )
    caveats = F.concat(
        F.array(*[F.lit(x) for x in CAVEATS]), kept(F.when(s["provisional"], PROVISIONAL_CAVEAT))
    )
    explanation = F.struct(
        chosen.alias("text"),
        citations.alias("citations"),
        (F.coalesce(F.size("evidence"), F.lit(0)) <= 0).alias("abstained"),
        caveats.alias("caveats"),
    )
    return d.withColumn("explanation", explanation).drop("_template")
