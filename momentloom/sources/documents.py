"""Readers of files that hold one document each, and of folders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_json_documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One row a file; a file that can't be read as the schema has nulls and its text in _corrupt_record."""
    kind = T._parse_datatype_string(schema).add("_corrupt_record", "string")
    return spark.read.schema(kind).option("multiLine", True).option("mode", "PERMISSIVE").json(path)


def parse_tolerant(df: DataFrame, text: str, schema: str) -> DataFrame:
    """Adds parsed: the struct that a JSON text holds; rows whose text can't be read are dropped."""
    kind = f"{schema}, _bad string"
    parsed = F.from_json(text, kind, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    return df.withColumn("parsed", parsed).filter("parsed is not null and parsed._bad is null")


def folder_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, bytes, changed) of the files below path; contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    return files.select("path", F.col("length").alias("bytes"), F.col("modificationTime").alias("changed"))


def folder_sizes(files: DataFrame, root: str = "", path: str = "path", bytes_: str = "bytes", changed: str = "changed") -> DataFrame:
    """folder, bytes, files, newest: for root and each folder below it that a file lies in or under.

    bytes and files count everything below a folder, at any depth; newest looks at a folder's own files
    and those of its direct folders only (a folder changes as its files do), and is null without any. A
    file counts once for each folder above it, in one pass: sums and maxima combine before the shuffle,
    so that the root costs a row a task. Paths are texts with / between names; those outside root, null
    paths and null sizes count for nothing. A file listed twice counts twice.
    """
    inner = F.substring(F.col(path), len(root) + 1, 1 << 20) if root else F.col(path)
    names = F.split(inner, "/", -1)
    inside = files.filter(F.col(path).isNotNull() & F.startswith(path, F.lit(root)) if root else F.col(path).isNotNull())
    depth = F.size("names") - 1  # folders on the way to the file
    above = F.explode(F.transform(F.sequence(F.lit(0), depth), lambda k: F.struct(F.array_join(F.slice("names", 1, k), "/").alias("folder"), (depth - k).alias("below"))))
    rows = inside.select(names.alias("names"), F.col(bytes_).alias("bytes"), F.col(changed).alias("changed")).select(above.alias("a"), "bytes", "changed")
    near = F.col("a.below") <= 1
    found = rows.groupBy("a.folder").agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"), F.count("*").alias("files"), F.max(F.when(near, F.col("changed"))).alias("newest"))
    return found.select(F.concat(F.lit(root), "folder").alias("folder"), "bytes", "files", "newest")
