"""JSON-lines records: checked objects, typed projection, quarantine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """(path, line, payload, problem): one row per non-blank line; a line must hold one object."""
    lines = spark.read.text(path, wholetext=False).select("value", F.input_file_name().alias("path"))
    return check_lines(lines)


def check_lines(lines: DataFrame) -> DataFrame:
    parsed = F.try_parse_json("value")
    kind = F.schema_of_variant(parsed)
    ok = F.coalesce(kind.startswith("OBJECT"), F.lit(False))
    d = lines.filter(F.trim("value") != "")
    return d.withColumn("problem", F.when(parsed.isNull(), "not_json").when(~ok, "not_an_object"))


TEXT_FIELDS = ["document_id", "source_type", "provider", "provider_id", "source_url", "title", "content_hash"]
TIME_FIELDS = ["published_at", "available_at", "fetched_at", "updated_at"]


def query_records(lines: DataFrame) -> DataFrame:
    """Typed projection of good lines with the full payload; bad stamps are reported in ``problem``."""
    v = F.try_parse_json("value")
    text = [F.try_variant_get(v, f"$.{n}", "string").alias(n) for n in TEXT_FIELDS]
    raw = {n: F.try_variant_get(v, f"$.{n}", "string") for n in TIME_FIELDS}
    zoned = r"(Z|[+-]\d{2}:?\d{2})$"
    stamps = [F.when(c.rlike(zoned), F.try_to_timestamp(c)).alias(n) for n, c in raw.items()]
    bad = F.lit(False)
    for c in raw.values():
        bad = bad | (c.isNotNull() & (~c.rlike(zoned) | F.try_to_timestamp(c).isNull()))
    problem = F.coalesce(F.col("problem"), F.when(bad, "stamp_without_zone"))
    return lines.select(
        *text, F.try_variant_get(v, "$.tickers", "array<string>").alias("tickers"), *stamps, F.col("value").alias("payload"), problem.alias("problem")
    )
