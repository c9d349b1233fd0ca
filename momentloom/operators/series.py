"""Operators on irregular series: as-of lookup, resampling, rolling measures, runs.

Every operator is keyed (a clip, a track) and ordered by integers, so that ties are exact.
One shuffle by the key serves a whole chain of these operators. A null key is a key like others,
empty tables give empty ones; of rows that agree in key and order either may come first.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import fold_in_order


def stride_sample(df: DataFrame, index: str, fps: Column, target: Column) -> DataFrame:
    """Every max(1, round(fps / target))-th row, halves to even."""
    return df.filter(F.pmod(F.col(index), F.greatest(F.lit(1), F.bround(fps / target, 0).cast("long"))) == 0)


def asof_nearest(spine: DataFrame, samples: DataFrame, key: list[str], at: str, value: str) -> DataFrame:
    """Adds to each spine row the value of the nearest sample in time; of two as near, the earlier.

    One union and one pass of windows over it, no join: the plan has one shuffle by key. Rows
    beyond the ends take the end's sample; a key without samples gets null. Sample
    times are unique for a key.
    """
    names = [c for c in spine.columns if c not in (*key, at)]
    both = spine.select(*key, at, F.struct(*names).alias("_row"), F.lit(None).cast(samples.schema[value].dataType).alias("_v"), F.lit(1).alias("_side")).unionByName(
        samples.select(*key, at, F.lit(None).cast(spine.select(F.struct(*names).alias("s")).schema["s"].dataType).alias("_row"), F.col(value).alias("_v"), F.lit(0).alias("_side"))
    )
    order = Window.partitionBy(*key).orderBy(at, "_side")
    sample = F.when(F.col("_side") == 0, F.struct(F.col(at).alias("t"), F.col("_v").alias("v")))
    before = F.last(sample, True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first(sample, True).over(order.rowsBetween(1, Window.unboundedFollowing))
    found = both.withColumns({"_p": before, "_n": after}).filter("_side = 1")
    earlier = F.col("_n").isNull() | (F.col("_p").isNotNull() & ((F.col(at) - F.col("_p.t")) <= (F.col("_n.t") - F.col(at))))
    return found.select(*key, at, *(F.col("_row")[n].alias(n) for n in names), F.when(earlier, F.col("_p.v")).otherwise(F.col("_n.v")).alias(value))


def bracket(spine: DataFrame, samples: DataFrame, key: list[str], at: str, value: str) -> DataFrame:
    """Adds the samples around each spine row: p_t, p_v (at or before) and n_t, n_v (at or after)."""
    both = spine.select(*key, at, F.lit(None).cast(samples.schema[value].dataType).alias("_v"), F.lit(1).alias("_s")).unionByName(samples.select(*key, at, F.col(value).alias("_v"), F.lit(0).alias("_s")))
    w = Window.partitionBy(*key).orderBy(at)
    sample = F.when(F.col("_s") == 0, F.struct(F.col(at).alias("t"), F.col("_v").alias("v")))
    found = both.withColumns({"_p": F.last(sample, True).over(w.rangeBetween(Window.unboundedPreceding, 0)), "_n": F.first(sample, True).over(w.rangeBetween(0, Window.unboundedFollowing))})
    return found.filter("_s = 1").select(*key, at, F.col("_p.t").alias("p_t"), F.col("_p.v").alias("p_v"), F.col("_n.t").alias("n_t"), F.col("_n.v").alias("n_v"))


def interpolate_hold(brackets: DataFrame, at: str, hold_over: int) -> DataFrame:
    """value between the bracketing samples: linear, flat beyond the ends, the earlier one where the gap is over hold_over."""
    gap = F.col("n_t") - F.col("p_t")
    between = F.col("p_v") + (F.col("n_v") - F.col("p_v")) * (F.col(at) - F.col("p_t")) / F.nullif(gap, F.lit(0))
    value = F.when(F.col("p_t").isNull(), F.col("n_v")).when(F.col("n_t").isNull() | (gap == 0) | (gap > hold_over), F.col("p_v")).otherwise(between)
    return brackets.withColumn("value", value)


def visible_within(brackets: DataFrame, at: str, reach: int) -> DataFrame:
    """visible: whether a sample lies within reach of the row."""
    near = F.least(F.col(at) - F.col("p_t"), F.col("n_t") - F.col(at))
    return brackets.withColumn("visible", F.coalesce(near <= reach, F.lit(False)))


def rolling_std(df: DataFrame, key: list[str], order: list[str], value: str, rows: int, name: str) -> DataFrame:
    """Population deviation of the last `rows` samples, fewer at the head."""
    return df.withColumn(name, F.stddev_pop(value).over(Window.partitionBy(*key).orderBy(*order).rowsBetween(1 - rows, 0)))


def causal_peak(df: DataFrame, key: list[str], order: list[str], value: str, rows: int, name: str) -> DataFrame:
    """Largest of the last `rows` samples."""
    return df.withColumn(name, F.max(value).over(Window.partitionBy(*key).orderBy(*order).rowsBetween(1 - rows, 0)))


def runs(df: DataFrame, key: list[str], order: str, state: str) -> DataFrame:
    """Runs of equal state over consecutive indexes: key, state, first, end (exclusive)."""
    w = Window.partitionBy(*key).orderBy(order)
    new = (~F.col(state).eqNullSafe(F.lag(state).over(w)) | F.lag(order).over(w).isNull() | (F.col(order) != F.lag(order).over(w) + 1)).cast("int")
    return df.withColumn("_new", new).withColumn("_run", F.sum("_new").over(w)).groupBy(*key, "_run").agg(F.first(state).alias(state), F.min(order).alias("first"), (F.max(order) + 1).alias("end")).drop("_run")


def long_runs(found: DataFrame, state: str, wanted: Column, least: int) -> DataFrame:
    """Runs in the wanted state of at least `least` rows."""
    return found.filter((F.col(state) == wanted) & (F.col("end") - F.col("first") >= least))


def absorb_short_runs(found: DataFrame, key: list[str], state: str, least: Column) -> DataFrame:
    """Runs shorter than least go to the run before; equal neighbours then merge; a key's first run stays."""
    w = Window.partitionBy(*key).orderBy("first")
    kept = found.withColumn("_last", F.max("end").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    kept = kept.withColumn("_n", F.row_number().over(w)).filter((F.col("_n") == 1) | (F.col("end") - F.col("first") >= least))
    kept = kept.withColumn("_new", (~F.col(state).eqNullSafe(F.lag(state).over(w)) | (F.col("_n") == 1)).cast("int")).withColumn("_run", F.sum("_new").over(w))
    merged = kept.groupBy(*key, "_run").agg(F.first(state).alias(state), F.min("first").alias("first"), F.max("_last").alias("_last"))
    return merged.select(*key, state, "first", F.coalesce(F.lead("first").over(w), F.col("_last")).alias("end"))


def expand_states(states: DataFrame, spine: DataFrame, key: list[str], index: str, state: str, default: Column) -> DataFrame:
    """The state of each spine row: of the run [first, end) that holds it, else the default. Empty runs give nothing."""
    frames = states.filter("first < end").select(*key, F.explode(F.sequence("first", F.col("end") - 1)).alias(index), state)
    return spine.join(frames, [*key, index], "left").withColumn(state, F.coalesce(state, default))


def changes_only(df: DataFrame, key: list[str], order: list[str], value: str) -> DataFrame:
    """Rows whose value differs from the row before, and each key's first."""
    before = F.lag(F.struct(value)).over(Window.partitionBy(*key).orderBy(*order))
    return df.withColumn("_b", before).filter(F.col("_b").isNull() | ~F.col("_b")[value].eqNullSafe(F.col(value))).drop("_b")


def throttled(df: DataFrame, key: list[str], order: list[str], fraction: str, step: int) -> DataFrame:
    """Rows whose fraction (an integer) has advanced by step since the last row that was let through; the first of each key counts from 0.

    Reports without a fraction are not let through.
    """

    names = [*key, *order, fraction]

    class Throttle:
        def __init__(self) -> None:
            self.last = 0

        def feed(self, rows: pa.RecordBatch) -> pa.RecordBatch:
            own = rows.filter(rows[fraction].is_valid())
            values, kept, at = own[fraction].to_numpy(), [], 0
            while (ahead := np.flatnonzero(values[at:] - self.last >= step)).size:
                at += int(ahead[0])
                self.last = int(values[at])
                kept.append(at)
            return own.select([*order, fraction]).take(pa.array(kept, pa.int64()))

        def end(self) -> None:
            return None

    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in (*order, fraction))
    return fold_in_order(df.select(*names), key, order, Throttle, kinds)
