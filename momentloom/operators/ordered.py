"""What depends on the rows before, without a key in memory: folds over batches, scans and sums over ranges.

A fold takes a key's rows in order, a batch at a time, and carries a small state; memory is a batch and
the state, however long the key. Where the state of a stretch of rows can be worked out from nothing (sums,
averages), ranges of the order are folded side by side instead, so that one key fills many tasks.

A null key is a key like others; empty tables give empty ones; rows that agree in key and order come in any order.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any, Protocol

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from momentloom.sources.scratch import written


class Fold(Protocol):
    """State of one key. feed gets its next rows, in order, end is called after the last; both give result rows (key columns are added)."""

    def feed(self, rows: pa.RecordBatch) -> pa.RecordBatch | None: ...

    def end(self) -> pa.RecordBatch | None: ...


def key_changes(batch: pa.RecordBatch, key: list[str]) -> list[int]:
    """Where a batch's rows begin another key, from 0."""
    if batch.num_rows < 2:
        return [0] * bool(batch.num_rows)
    new = np.zeros(batch.num_rows - 1, bool)
    for k in key:
        c = batch.column(batch.schema.get_field_index(k))
        a, b = c.slice(0, len(c) - 1), c.slice(1)
        differ = pc.fill_null(pc.not_equal(a, b), False).to_numpy(zero_copy_only=False)
        new |= differ | (a.is_null().to_numpy(zero_copy_only=False) != b.is_null().to_numpy(zero_copy_only=False))
    return [0, *(np.flatnonzero(new) + 1).tolist()]


def fold_in_order(df: DataFrame, key: list[str], order: list[str], make: Callable[[], Fold], fields: str) -> DataFrame:
    """The key columns and fields of what folds give, one made for each key. One shuffle, by the key."""
    schema = T.StructType([*(df.schema[k] for k in key), *T._parse_datatype_string(fields).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fold: Fold | None = None
        last: tuple[Any, ...] | None = None
        heads: list[pa.Array] = []

        def keyed(out: pa.RecordBatch | None) -> Iterator[pa.RecordBatch]:
            if out is not None and out.num_rows:
                own = [h.take(pa.array(np.zeros(out.num_rows, np.int64))) for h in heads]
                yield pa.RecordBatch.from_arrays([*own, *out.columns], schema.names)

        for batch in batches:
            starts = key_changes(batch, key)
            for a, z in zip(starts, [*starts[1:], batch.num_rows], strict=True):
                rows = batch.slice(a, z - a)
                own = [rows.column(rows.schema.get_field_index(k)).slice(0, 1) for k in key]
                now = tuple(x[0].as_py() for x in own)
                if fold is None or now != last:
                    if fold is not None:
                        yield from keyed(fold.end())
                    fold, last, heads = make(), now, own
                yield from keyed(fold.feed(rows))
        if fold is not None:
            yield from keyed(fold.end())

    return df.repartition(*key).sortWithinPartitions(*key, *order).mapInArrow(run, schema)


def in_ranges(df: DataFrame, key: list[str], order: list[Column], name: str) -> DataFrame:
    """df dealt by ranges of the key and the order, with the range's number as name, as a written table: all rows of a key in a lower range come before.

    Adaptive execution decides on the number of ranges by their bytes, so that small tables are one and a large key is many.
    """
    return written(df.repartitionByRange(*(F.col(k).asc_nulls_first() for k in key), *order).withColumn(name, F.spark_partition_id()))


def averages(x: np.ndarray, alpha: float, start: float = 0.0, block: int = 128) -> np.ndarray:
    """acc += alpha * (x - acc) from start, all values of acc: blocks by a matrix, and a carry from block to block."""
    n, keep = len(x), 1.0 - alpha
    if not n:
        return np.zeros(0)
    age = np.arange(block)[:, None] - np.arange(block)[None, :]
    weigh = np.where(age >= 0, alpha * keep ** np.maximum(age, 0), 0.0)
    padded = np.concatenate([x, np.zeros(-n % block)]).reshape(-1, block)
    inside = padded @ weigh.T
    carry, whole = np.empty(len(padded)), keep**block
    for k, last in enumerate(inside[:, -1].tolist()):
        carry[k] = start
        start = last + whole * start
    return (inside + carry[:, None] * keep ** np.arange(1, block + 1)).reshape(-1)[:n]


def exponential_average(df: DataFrame, key: list[str], order: list[str], value: str, alpha: float, name: str = "average") -> DataFrame:
    """key, order and name, the averages in order: acc += alpha * (value - acc), from 0. A null value keeps the average.

    A scan in two levels: a range of rows turns the average before it, acc, into (1 - alpha) ** n * acc + b; the ranges'
    (n, b), a few numbers each, are composed in order, and each range is then worked out from what comes in. order
    must tell a key's rows apart.
    """
    names = [*key, *order]
    dealt = in_ranges(df.select(*names, F.col(value).cast("double").alias("_value")), key, [F.col(c) for c in order], "_range")

    def values(t: pa.Table) -> tuple[pa.Table, np.ndarray, np.ndarray]:
        t = t.sort_by([(c, "ascending") for c in order])
        there = t["_value"].is_valid().to_numpy()
        return t, there, t["_value"].to_numpy()[there].astype(float)

    def summed(t: pa.Table) -> pa.Table:
        t, _, x = values(t)
        b = averages(x, alpha)
        return t.slice(0, 1).select([*key, "_range"]).append_column("n", pa.array([len(x)])).append_column("b", pa.array([float(b[-1]) if len(b) else 0.0]))

    kinds = [df.schema[k] for k in key]
    head = [*kinds, T.StructField("_range", T.IntegerType())]
    sums = dealt.groupBy(*key, "_range").applyInArrow(summed, T.StructType([*head, T.StructField("n", T.LongType()), T.StructField("b", T.DoubleType())]))
    step = lambda s, x: F.struct((x["b"] + F.pow(F.lit(1.0 - alpha), x["n"]) * s["acc"]).alias("acc"), F.concat(s["out"], F.array(F.struct(x["_range"].alias("_range"), s["acc"].alias("before")))).alias("out"))
    begin = F.expr("named_struct('acc', 0.0D, 'out', cast(array() as array<struct<_range:int,before:double>>))")
    # A key has a row for each range that it reaches into.
    starts = sums.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("_range", "n", "b"))).alias("all")).select(*key, F.inline(F.aggregate("all", begin, step)["out"]))

    def applied(rows: pa.Table, before: pa.Table) -> pa.Table:
        t, there, x = values(rows)
        start = before["before"][0].as_py()
        acc = np.concatenate([[start], averages(x, alpha, start)])[np.cumsum(there)]
        return t.select(names).append_column(name, pa.array(acc))

    schema = T.StructType([*(df.schema[c] for c in names), T.StructField(name, T.DoubleType())])
    return dealt.groupBy(*key, "_range").cogroup(starts.groupBy(*key, "_range")).applyInArrow(applied, schema)


def ranges_before(df: DataFrame, key: list[str], order: list[Column], value: Column, name: str) -> DataFrame:
    """Adds name: the sum of value over a key's rows before this one in order, without a task that holds a whole key.

    Sums run within a range, and those of the ranges before, a few numbers for each, are added. order must tell all rows of a key apart.
    """
    dealt = in_ranges(df.withColumn("_value", value), key, order, "_range")
    totals = dealt.groupBy(*key, "_range").agg(F.sum("_value").alias("_total"))
    w = Window.partitionBy(*key).orderBy("_range")
    before = F.coalesce(F.sum("_total").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = totals.select(*(F.col(k).alias(f"_of_{k}") for k in key), F.col("_range").alias("_of_range"), before.alias("_start"))
    own = Window.partitionBy(*key, "_range").orderBy(*order)
    inner = F.coalesce(F.sum("_value").over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    same = F.col("_range") == F.col("_of_range")
    for k in key:
        same = same & F.col(k).eqNullSafe(F.col(f"_of_{k}"))
    return dealt.withColumn("_inner", inner).join(starts, same).withColumn(name, F.col("_inner") + F.col("_start")).select(*df.columns, name)


def places(df: DataFrame, key: list[str], order: list[Column], name: str = "place") -> DataFrame:
    """Adds name: a row's number in its key's order, from 1, over ranges (see ranges_before)."""
    return ranges_before(df, key, order, F.lit(1).cast("long"), name).withColumn(name, (F.col(name) + 1).cast("long"))
