"""Sound files as a data source: samples of 16-bit mono WAV files, read by byte ranges.

A partition is a range of samples of one file, so that an hour of sound is many tasks and a
range of it reads only its bytes. Headers are read while partitions are planned, a few
dozen bytes a file. Ranges come as options or from filters on idx and path:

    spark.dataSource.register(WavSource)
    spark.read.format("wav").option("path", folder).load().filter("idx between 16000 and 31999")

Filters are pushed where spark.sql.python.filterPushdown.enabled is set; they hold either
way. Paths go through pyarrow's file systems: local ones, hdfs://, s3://, gs://.

A file that is no such WAV file, or empty, has no samples; a data chunk that claims more bytes than the
file has ends with the file. An empty folder has no rows.
"""

from __future__ import annotations

import fnmatch
import os
import posixpath
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from momentloom.operators.scoring import rms

#: Samples of a partition, and of a batch that it hands out.
SPLIT, BATCH = 1 << 22, 1 << 18
SCHEMA = "path string, idx long, v short"


@dataclass
class Sound:
    """Where the samples of a file lie."""

    path: str
    at: int
    samples: int
    rate: int


@dataclass
class SampleRange(InputPartition):
    path: str
    at: int
    first: int
    end: int


def header(path: str, size: int, file: Any) -> Sound:
    """Reads the chunk heads of a RIFF file; only these bytes, whatever lies between."""
    none = Sound(path, 0, 0, 0)

    def take(at: int, n: int) -> bytes:
        file.seek(at)
        return file.read(n)

    head = take(0, 12)
    if head[:4] != b"RIFF" or head[8:] != b"WAVE":
        return none
    at, rate = 12, 0
    while at + 8 <= size:
        name, n = (h := take(at, 8))[:4], int.from_bytes(h[4:], "little")
        if name == b"fmt ":
            f = take(at + 8, 16)
            coding, channels, rate, bits = (int.from_bytes(f[a:b], "little") for a, b in ((0, 2), (2, 4), (4, 8), (14, 16)))
            if (coding, channels, bits) != (1, 1, 16):
                return none
        elif name == b"data":
            return Sound(path, at + 8, min(n, size - at - 8) // 2, rate) if rate else none
        at += 8 + n + n % 2
    return none


class WavReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"] if "://" in options["path"] else os.path.abspath(options["path"].removeprefix("file:"))
        self.pattern = options.get("pathglobfilter", "*")
        self.first = int(options.get("first", 0))
        self.end = int(options["end"]) if "end" in options else None
        self.split = int(options.get("split", SPLIT))
        self.only: set[str] | None = None

    def open(self, path: str) -> Any:
        fs, inner = pafs.FileSystem.from_uri(path)
        return fs.open_input_file(inner)

    def files(self) -> Iterator[tuple[str, int]]:
        """(path, bytes) of the file, or of the files below the folder, that the pattern names."""
        fs, inner = pafs.FileSystem.from_uri(self.path)
        info = fs.get_file_info(inner)
        found = [info] if info.type == pafs.FileType.File else fs.get_file_info(pafs.FileSelector(inner, recursive=True, allow_not_found=True))
        prefix = self.path[: len(self.path) - len(inner)] if self.path.endswith(inner) else ""
        for f in sorted((f for f in found if f.type == pafs.FileType.File), key=lambda f: f.path):
            if fnmatch.fnmatch(posixpath.basename(f.path), self.pattern) and (self.only is None or prefix + f.path in self.only):
                yield prefix + f.path, f.size

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Ranges of idx narrow what is read, equal paths which files; all filters stay with Spark as well."""
        for f in filters:
            column = getattr(f, "attribute", None)
            if column == ("idx",) and isinstance(f, GreaterThan | GreaterThanOrEqual):
                self.first = max(self.first, f.value + isinstance(f, GreaterThan))
            elif column == ("idx",) and isinstance(f, LessThan | LessThanOrEqual):
                self.end = min(x for x in (self.end, f.value + isinstance(f, LessThanOrEqual)) if x is not None)
            elif column == ("idx",) and isinstance(f, EqualTo):
                self.first, self.end = max(self.first, f.value), min(x for x in (self.end, f.value + 1) if x is not None)
            elif column == ("path",) and isinstance(f, EqualTo | In):
                own = set(f.value) if isinstance(f, In) else {f.value}
                self.only = own if self.only is None else self.only & own
            yield f

    def partitions(self) -> Sequence[InputPartition]:
        out = []
        for path, size in self.files():
            with self.open(path) as file:
                s = header(path, size, file)
            end = s.samples if self.end is None else min(s.samples, self.end)
            out += [SampleRange(path, s.at, a, min(a + self.split, end)) for a in range(max(0, self.first), end, self.split)]
        return out or [SampleRange("", 0, 0, 0)]

    def read(self, partition: SampleRange) -> Iterator[pa.RecordBatch]:
        if partition.first >= partition.end:
            return
        with self.open(partition.path) as file:
            file.seek(partition.at + 2 * partition.first)
            for a in range(partition.first, partition.end, BATCH):
                n = min(BATCH, partition.end - a)
                v = np.frombuffer(file.read(2 * n), "<i2")
                yield pa.RecordBatch.from_arrays([pa.DictionaryArray.from_arrays(np.zeros(n, np.int32), pa.array([partition.path])).dictionary_decode(), pa.array(np.arange(a, a + n)), pa.array(v)], ["path", "idx", "v"])


class WavSource(DataSource):
    """Options: path (a file or a folder), pathGlobFilter, first and end (samples), split (samples of a partition)."""

    @classmethod
    def name(cls) -> str:
        return "wav"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: Any) -> WavReader:
        return WavReader({k.lower(): v for k, v in self.options.items()})


def read_pcm(spark: SparkSession, path: str, first: int = 0, end: int | None = None, split: int = SPLIT, pattern: str = "*") -> DataFrame:
    """Samples (path, idx, v) from first up to end of the files at path."""
    spark.dataSource.register(WavSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    reader = spark.read.format("wav").option("path", path).option("first", str(first)).option("split", str(split)).option("pathGlobFilter", pattern)
    return (reader if end is None else reader.option("end", str(end))).load()


def frame_hop(rate: int, fps: float) -> int:
    """Samples of a frame: whole ones, so that hops drift against true frames where fps doesn't divide rate."""
    return max(1, int(rate / fps))


def frame_rms(samples: DataFrame, key: list[str], hop: int, first: int = 0, index: str = "idx", value: str = "v", full_scale: float = 32768.0) -> DataFrame:
    """key, frame and rms: of each hop samples from first on, the root of the mean square (of values over full_scale) plus 1e-9. A last hop that isn't full has none.

    Samples before first don't count, null values are no samples. Sums combine before the shuffle.
    """
    own = samples.filter((F.col(index) >= first) & F.col(value).isNotNull())
    whole = samples.schema[value].dataType.typeName() in ("byte", "short", "integer", "long")
    v = F.col(value).cast("long" if whole else "double")
    sums = own.groupBy(*key, F.floor((F.col(index) - first) / hop).alias("frame")).agg(F.sum(v * v).alias("sq"), F.count("*").alias("n"))
    return sums.filter(F.col("n") >= hop).select(*key, "frame", rms(F.col("sq") / (full_scale * full_scale), F.col("n")).alias("rms"))
