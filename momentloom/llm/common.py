"""What the operators of this folder share: reading, materialising, text as bytes."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextvars import ContextVar
from typing import Any

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The ASCII white space that separates words in every contract here.
ASCII_SPACE = "\x20\x09\x0a\x0b\x0c\x0d"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; documents are dealt over all cores where their files have fewer splits than that (a small table is one row group)."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if name == "documents" and df.rdd.getNumPartitions() < cores else df


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names; a temporary one only where none is set and all runs in one process (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="momentloom-")
        spark.sparkContext.setCheckpointDir(found)
    return found


_written: list[tuple[SparkSession, str]] = []
#: Those of this thread since settled began; None outside it.
_own: ContextVar[list[tuple[SparkSession, str]] | None] = ContextVar("_own", default=None)


def _remove(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def remove_table(df: DataFrame) -> None:
    """Removes a table that materialise has written, once nothing will read it any more."""
    found = {os.path.dirname(f) for f in df.inputFiles()}
    for spark, path in list(_written):
        if any(f.rstrip("/").endswith(path.split(":", 1)[-1].rstrip("/")) for f in found):
            _remove(spark, path)
            _written.remove((spark, path))


def remove_written() -> None:
    """Removes the tables written so far. For long sessions, once the results that read them have been read; the driver's end does it as well."""
    while _written:
        _remove(*_written.pop())


#: With it a query's shuffle files go when the query ends; else when the driver happens to collect its garbage, and until then those of all queries add up.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def _shuffles_removed(spark: SparkSession) -> Iterator[None]:
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def materialise(df: DataFrame) -> DataFrame:
    """Write df once as a table in the shared checkpoint folder and read it back.

    Cuts lineage: a lost executor costs a re-read instead of the computation. What was
    shuffled for the table is removed once it is written. The
    folder is removed by remove_table, remove_written, or when the driver's process ends.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/momentloom/{uuid.uuid4().hex}"
    with _shuffles_removed(spark):
        df.write.parquet(path)
    if not _written:
        atexit.register(remove_written)
    _written.append((spark, path))
    if (own := _own.get()) is not None:
        own.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def settled(make: Callable[[], DataFrame]) -> DataFrame:
    """The result of make as a written table; the tables that make has written on the way are removed."""
    token = _own.set(own := [])
    try:
        found = materialise(make())
    finally:
        _own.reset(token)
    for way in own[:-1]:
        if way in _written:
            _remove(*way)
            _written.remove(way)
    if (outer := _own.get()) is not None:
        outer.append(own[-1])
    return found


def as_bytes(column: pa.Array) -> list[bytes]:
    """The texts of an Arrow string column as UTF-8; null as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def as_texts(column: pa.Array) -> list[str]:
    return [x or "" for x in column.to_pylist()]


def release_memory() -> None:
    """Hand memory that nothing uses any more back to the system: workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(Exception):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


#: What drops the caches that a worker keeps from task to task, see free_caches.
_droppers: list[Callable[[], object]] = []


def kept_in_worker(drop: Callable[[], object]) -> None:
    """Names the function that drops a cache of this worker process."""
    if drop not in _droppers:
        _droppers.append(drop)


def free_caches() -> None:
    """Drops what other operators have kept in this worker: a stage that needs no such cache begins with it, as workers outlive stages."""
    for drop in _droppers:
        drop()
    release_memory()


def after_free_caches(df: DataFrame) -> DataFrame:
    """The same rows; the workers that pass them on have dropped their caches, so that what follows on these executors has the memory."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        free_caches()
        yield from batches

    return df.mapInArrow(run, df.schema)


def slices(batches: Iterable[pa.RecordBatch], column: str, limit: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches so that a slice holds about limit bytes of column (one row at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        at = batch.schema.get_field_index(column)
        start = size = 0
        for i, n in enumerate(pc.binary_length(batch.column(at)).to_pylist()):
            if size and size + (n or 0) > limit:
                yield batch.slice(start, i - start)
                start, size = i, 0
            size += n or 0
        yield batch.slice(start)
    release_memory()


#: Longer strings are worked on but not remembered, so that a cache of so many entries has a bounded size.
LONGEST_REMEMBERED = 64


def remembered(wanted: Iterable[str], known: dict[str, Any], before: dict[str, Any], work: Callable[[list[str]], list[Any]]) -> dict[str, Any]:
    """What work gives for each wanted string: from known or the older generation before, else worked out; short strings are then known."""
    absent = [w for w in wanted if w not in known]
    missing = []
    for w in absent:
        if w in before:
            known[w] = before[w]
        else:
            missing.append(w)
    if not missing:
        return known
    new = dict(zip(missing, work(missing), strict=True))
    long = {w: x for w, x in new.items() if len(w) > LONGEST_REMEMBERED}
    if not long:
        known.update(new)
        return known
    known.update((w, x) for w, x in new.items() if w not in long)
    return {**{w: known[w] for w in wanted if w not in long}, **long}


def crc_mod(doc_id: str, modulus: int) -> F.Column:
    """crc32 of doc_id as text, modulo modulus; a null id counts as an empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(modulus))
