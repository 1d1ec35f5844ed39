"""Sinks, merges, versioned tables and their verification."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickerloom.functions.columns import sha
from tickerloom.operators.blocks import session_numbers
from tickerloom.sources.files import file_inventory  # noqa: F401


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition: list[str] | None = None, sort: list[str] | None = None, mode: str = "error") -> None:
    """One sink for Parquet, CSV and JSON; ``sort`` orders rows inside files, standing in for an index."""
    d = df.sortWithinPartitions(*sort) if sort else df
    w = d.write.mode(mode).format(fmt)
    if fmt == "csv":
        w = w.option("header", True)
    if partition:
        w = w.partitionBy(*partition)
    w.save(path)


def convert_parquet_to_csv(spark: SparkSession, source: str, target: str) -> None:
    write_table(spark.read.parquet(source), target, "csv", mode="overwrite")


def upsert(existing: DataFrame, incoming: DataFrame, keys: list[str], keep_first: list[str] | None = None) -> DataFrame:
    """Merged rows with ``change`` (inserted, updated, kept); ``keep_first`` columns stay once set."""
    a, b = existing.alias("a"), incoming.alias("b")
    on = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    condition = on[0]
    for c in on[1:]:
        condition = condition & c
    a = existing.withColumn("_old", F.lit(True)).alias("a")
    b = incoming.withColumn("_new", F.lit(True)).alias("b")
    j = a.join(b, condition, "outer")
    new = F.col("b._new").isNotNull()
    out = []
    for c in existing.columns:
        old, fresh = F.col(f"a.{c}"), F.col(f"b.{c}")
        if c in keys:
            out.append(F.coalesce(fresh, old).alias(c))
        elif keep_first and c in keep_first:
            out.append(F.coalesce(old, fresh).alias(c))
        else:
            out.append(F.when(new, fresh).otherwise(old).alias(c))
    change = F.when(new & F.col("a._old").isNull(), "inserted").when(new, "updated").otherwise("kept")
    return j.select(*out, change.alias("change"))


def change_counts(merged: DataFrame) -> DataFrame:
    return merged.agg(
        *[F.count_if(F.col("change") == n).alias(n) for n in ("inserted", "updated", "kept")]
    )


def new_batches(batches: DataFrame, stored: DataFrame) -> DataFrame:
    """Batches not stored yet; a known key with another source hash is marked as a conflict."""
    keys = ["model", "generated_at"]
    known = stored.select(*keys, F.col("source_sha256").alias("_h"))
    j = batches.join(known, keys, "left")
    status = F.when(F.col("_h").isNull(), "new").when(F.col("_h") == F.col("source_sha256"), "already_imported").otherwise("conflict")
    return j.withColumn("status", status).drop("_h")


def replace_all(df: DataFrame, path: str) -> int:
    """Overwrite a table, refusing an empty replacement; returns the row count."""
    n = df.count()
    if n == 0:
        raise ValueError("Refusing to replace a table with no rows")
    df.write.mode("overwrite").parquet(path)
    return n


# --- inventory and identity -------------------------------------------------------------


def drop_csv_twins(files: DataFrame) -> DataFrame:
    """Inventory without CSV files that have a Parquet twin of the same name."""
    stem = F.regexp_replace("path", r"\.(csv|parquet)$", "")
    twins = files.filter(F.col("path").endswith(".parquet")).select(stem.alias("_s"))
    d = files.withColumn("_s", F.when(F.col("path").endswith(".csv"), stem))
    return d.join(twins, "_s", "left_anti").drop("_s").select(*files.columns)


def content_identity(entries: Column) -> Column:
    """Aggregate: order-free identity of a multiset of texts.

    Every entry's SHA-256 is read as eight numbers of 32 bits; the sums of each, with the count, identify the multiset.  Sums combine before any
    shuffle, so nothing is gathered, however many entries there are.
    """
    h = sha(entries)
    limbs = [F.conv(F.substring(h, 8 * i + 1, 8), 16, 10).cast("decimal(20,0)") for i in range(8)]
    sums = [F.coalesce(F.sum(x), F.lit(0)).cast("decimal(38,0)").cast("string") for x in limbs]
    return sha(F.concat_ws(":", F.count(h).cast("string"), *sums))


def _range_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(r, rh): one running SHA-256 over the sorted entries of each range."""
    done, current, running = [], None, None
    for batch in batches:
        for r, h in zip(batch.column("r").to_pylist(), batch.column("h").to_pylist(), strict=True):
            if r != current:
                if current is not None:
                    done.append((current, running.hexdigest()))
                current, running = r, hashlib.sha256()
            running.update(h.encode())
    if current is not None:
        done.append((current, running.hexdigest()))
    yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in done], pa.string()) for i in range(2)], names=["r", "rh"])


def snapshot_identity(manifest: DataFrame) -> DataFrame:
    """(version): content identity of a manifest of (path, sha256): a hash of per-prefix hashes in order.

    Entries are hashed, dealt to 256 ranges by their first two digits and sorted; each range is one running hash over its
    stream, so no entry list is held.
    """
    keyed = manifest.select(sha(F.concat_ws(":", "path", "sha256")).alias("h")).select(F.substring("h", 1, 2).alias("r"), "h")
    ranges = keyed.repartition("r").sortWithinPartitions("r", "h").mapInArrow(_range_hashes, "r string, rh string")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("r", "rh"))), lambda x: x["rh"])
    return ranges.agg(F.concat(F.lit("ss_"), F.substring(sha(F.array_join(ordered, "")), 1, 20)).alias("version"))


def numbered_rows(df: DataFrame, key: str, order: str, period: Column) -> DataFrame:
    """Adds ``source_row`` (from 1) in the given order, numbered in two steps."""
    n = session_numbers(df.withColumn("_all", F.lit(key)), "_all", order, "_no", period)
    return n.withColumn("source_row", F.col("_no") + 1).drop("_no", "_all")


def content_differences(left: DataFrame, right: DataFrame) -> DataFrame:
    """(side, n): rows of one table missing from the other, copies counted; NaN equals NaN."""
    if [f.simpleString() for f in left.schema] != [f.simpleString() for f in right.schema]:
        raise ValueError("Tables differ in schema")
    a = left.exceptAll(right).agg(F.count(F.lit(1)).alias("n")).withColumn("side", F.lit("missing"))
    b = right.exceptAll(left).agg(F.count(F.lit(1)).alias("n")).withColumn("side", F.lit("extra"))
    return a.unionByName(b)


def lossy_values(df: DataFrame, nanos: str, day_ms: str, number: str, text: str) -> DataFrame:
    """(kind, id) rows whose conversion would lose information."""
    kinds = F.array_compact(
        F.array(
            F.when(F.col(nanos) % 1000 != 0, "sub_microsecond"),
            F.when(F.col(day_ms) % 86400000 != 0, "date_not_midnight"),
            F.when(F.abs(F.col(number).cast("decimal(38,0)")) > F.lit(9223372036854775807), "int64_overflow"),
            F.when(F.contains(F.col(text), F.lit("\x00")), "nul_in_text"),
        )
    )
    return df.select("id", F.explode(kinds).alias("kind"))


def manifest_problems(manifest: DataFrame, counts: DataFrame, hashes: DataFrame) -> DataFrame:
    """Declared rows and hashes per dataset against the measured ones."""
    j = manifest.join(counts.withColumnRenamed("rows", "_rows"), "dataset", "left").join(hashes.withColumnRenamed("sha256", "_sha"), "dataset", "left")
    kinds = F.array_compact(
        F.array(
            F.when(~F.col("rows").eqNullSafe(F.col("_rows")), "row_count"), F.when(~F.col("sha256").eqNullSafe(F.col("_sha")), "source_hash")
        )
    )
    return j.select("dataset", F.explode(kinds).alias("kind"))


def read_snapshot(spark: SparkSession, root: str, version: str, expected_rows: int, columns: list[str]) -> DataFrame:
    """A pinned version only: completeness marker, column order and row count must fit."""
    df = spark.read.parquet(f"{root}/version={version}")
    if df.columns != columns:
        raise ValueError("Snapshot columns differ from the contract")
    if df.count() != expected_rows:
        raise ValueError("Snapshot row count differs from the manifest")
    return df


def forecast_item_problems(rows: DataFrame) -> DataFrame:
    """(kind, ticker) of forecast rows that break the stored constraints."""
    lo, p, hi = F.col("lower_return"), F.col("predicted_return_10d"), F.col("upper_return")
    kinds = F.array_compact(
        F.array(
            F.when(~((lo <= p) & (p <= hi)), "interval_not_ordered"),
            F.when(F.abs(F.col("uncertainty_width_pp") - 100 * (hi - lo)) > 1e-7, "width_mismatch"),
            F.when(F.col("calibration_latest_outcome") >= F.col("date"), "calibration_after_origin"),
        )
    )
    return rows.select("ticker", F.explode(kinds).alias("kind"))


def batch_consistency(rows: DataFrame, today: Column) -> DataFrame:
    """One row: may the batch be served?"""
    d = rows.agg(
        F.count_distinct("model").alias("models"),
        F.count_distinct("nominal_coverage").alias("coverages"),
        F.count_distinct("generated_at").alias("stamps"),
        (F.count(F.lit(1)) - F.count_distinct("ticker")).alias("repeated_tickers"),
        F.count_if(F.datediff(today, "date") < 0).alias("future_origins"),
    )
    ok = (F.col("models") == 1) & (F.col("coverages") == 1) & (F.col("stamps") == 1) & (F.col("repeated_tickers") == 0) & (F.col("future_origins") == 0)
    return d.withColumn("consistent", ok)
