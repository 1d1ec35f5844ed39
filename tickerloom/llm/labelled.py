"""Labelled rows for training: a bounded, deterministic sample, with features made on the executors.

``train_rows`` bounds what reaches the driver whatever the corpus: the labelled rows of least id hash.
Labels choose rows and give targets; they, lang, source and doc_id are never inputs of a score.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``."""
    return F.crc32(doc_id.cast("string").cast("binary")) % F.lit(parts)


def sample(docs: DataFrame, labels: DataFrame, label: str, usable: Column, train_rows: int, features: Callable, schema: str, each_class: bool = False) -> pd.DataFrame:
    """Pandas frame of (doc_id, y, features) of at most ``train_rows`` labelled rows for which ``usable`` holds.

    With ``each_class`` the bound holds for each of the labels 0 and 1.  Conflicting or repeated labels of one id count as their maximum; rows without a label are left out.
    """
    own = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).filter(F.col("y").isNotNull() & F.col("doc_id").isNotNull())
    known = own.filter(usable).groupBy("doc_id").agg(F.max("y").alias("y"))
    least = lambda part: part.orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows)
    chosen = least(known.filter("y = 1")).unionByName(least(known.filter("y = 0"))) if each_class else least(known)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = texts.join(chosen, "doc_id").mapInArrow(features, f"doc_id long, y int, {schema}")
    return rows.toPandas().sort_values("doc_id", kind="stable").reset_index(drop=True)

