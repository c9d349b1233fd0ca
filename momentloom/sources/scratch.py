"""Tables that a query writes for itself: cut lineage, keep a dealing of rows, go when the driver ends."""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_folder(spark: SparkSession) -> str:
    """The shared folder that the cluster names; a temporary one only for local masters (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="momentloom-")
        spark.sparkContext.setCheckpointDir(found)
    return found


_tables: list[tuple[SparkSession, str]] = []


def remove_tables() -> None:
    """Removes what written has left; runs when the driver's process ends, and may be called once results have been read."""
    while _tables:
        spark, path = _tables.pop()
        with contextlib.suppress(Exception):
            p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the scratch folder: computed once, columns pruned on reading, safe from lost executors."""
    path = f"{scratch_folder(df.sparkSession)}/momentloom-core/{uuid.uuid4().hex}"
    df.write.parquet(path)
    if not _tables:
        atexit.register(remove_tables)
    _tables.append((df.sparkSession, path))
    return df.sparkSession.read.schema(df.schema).parquet(path)
