"""Files as byte ranges: a data source that hashes every file in parts of bounded size, so no cell holds a file.

A file of one part has the plain SHA-256 of its bytes; a longer one the SHA-256 of its parts' digests in order.  Part sizes are fixed,
so the digest depends on the bytes alone.  Files are opened where the tasks run, through the file systems that
Arrow knows (local and mounted folders, HDFS, S3, GCS).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

PART_BYTES = 128 << 20
BLOCK_BYTES = 1 << 20
PARTS_SCHEMA = "path string, bytes long, part int, parts int, digest binary"


def _opened(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri.replace("file:/", "file:///", 1) if uri.startswith("file:/") and not uri.startswith("file://") else uri)


class Range(InputPartition):
    def __init__(self, path: str, size: int, part: int, parts: int):
        self.path, self.size, self.part, self.parts = path, size, part, parts


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder, self.part_bytes = options["path"], int(options.get("partbytes", PART_BYTES))

    def partitions(self) -> list[Range]:
        system, root = _opened(self.folder)
        found = system.get_file_info(fs.FileSelector(root, recursive=True))
        out = []
        for f in found:
            if f.is_file:
                parts = max(1, -(-f.size // self.part_bytes))
                out += [Range(f.path, f.size, k, parts) for k in range(parts)]
        return out

    def read(self, partition: Range) -> Iterator[tuple]:
        system, _ = _opened(self.folder)
        left = min(self.part_bytes, partition.size - partition.part * self.part_bytes)
        digest = hashlib.sha256()
        with system.open_input_file(partition.path) as stream:
            stream.seek(partition.part * self.part_bytes)
            while left > 0:
                block = stream.read(min(BLOCK_BYTES, left))
                if not block:
                    raise OSError(f"{partition.path} became shorter while it was read")
                digest.update(block)
                left -= len(block)
        yield (partition.path, partition.size, partition.part, partition.parts, digest.digest())


class FileParts(DataSource):
    @classmethod
    def name(cls) -> str:
        return "file_parts"

    def schema(self) -> str:
        return PARTS_SCHEMA

    def reader(self, schema) -> _Reader:
        return _Reader(self.options)


def file_parts(spark: SparkSession, folder: str, part_bytes: int = PART_BYTES) -> DataFrame:
    """(path, bytes, part, parts, digest) of every file below a folder; a task hashes one part."""
    spark.dataSource.register(FileParts)
    return spark.read.format("file_parts").option("path", folder).option("partbytes", str(part_bytes)).load()


def file_inventory(spark: SparkSession, folder: str, part_bytes: int = PART_BYTES) -> DataFrame:
    """(path, bytes, sha256) of every file below a folder, of any size."""
    parts = file_parts(spark, folder, part_bytes)
    each = parts.groupBy("path", "bytes").agg(F.max("parts").alias("parts"), F.array_sort(F.collect_list(F.struct("part", "digest")))["digest"].alias("digests"))
    whole = F.aggregate("digests", F.lit(b""), lambda a, d: F.concat(a, d))
    return each.select("path", "bytes", F.when(F.col("parts") == 1, F.lower(F.hex(F.element_at("digests", 1)))).otherwise(F.sha2(whole, 256)).alias("sha256"))


def inventory_conflicts(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path, kind): files that are new, missing or changed in size or content between two inventories."""
    a, b = (d.select("path", F.struct("bytes", "sha256").alias(n)) for d, n in ((before, "a"), (after, "b")))
    kind = F.when(F.col("a").isNull(), "new").when(F.col("b").isNull(), "missing").when(F.col("a") != F.col("b"), "changed")
    return a.join(b, "path", "full").select("path", kind.alias("kind")).filter("kind is not null")


def table_specs(tables: dict[str, DataFrame]) -> DataFrame:
    """(table, rows, columns): row count and (name, type) list of each table, counted in one job per table."""
    rows = None
    for name, df in sorted(tables.items()):
        columns = F.array(*[F.struct(F.lit(f.name).alias("name"), F.lit(f.dataType.simpleString()).alias("type")) for f in df.schema.fields])
        spec = df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table"), "rows", F.to_json(columns).alias("columns"))
        rows = spec if rows is None else rows.unionByName(spec)
    return rows
