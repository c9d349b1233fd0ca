"""Folds over batches, scans and sums over ranges: the same whatever the batch, however long the key."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from momentloom.operators import folds, ordered, registry, series


@pytest.fixture
def many_ranges(spark):
    """Small ranges, so that a key lies in many."""
    names = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "7"}
    before = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.set(k, v)


def plain_average(x, alpha):
    acc, out = 0.0, []
    for v in x:
        acc += alpha * (v - acc) if v is not None else 0.0
        out.append(acc)
    return out


def test_blocks_of_an_average_equal_the_fold():
    rng = np.random.default_rng(1)
    for n, alpha in ((0, 0.1), (1, 0.5), (127, 0.08), (128, 1.0), (1000, 1e-4), (3000, 0.999)):
        x = rng.normal(5, 100, n)
        assert np.allclose(ordered.averages(x, alpha), plain_average(x.tolist(), alpha), rtol=1e-12, atol=1e-9)
    assert np.allclose(ordered.averages(np.ones(300), 0.1, 7.0)[[0, 299]], [6.4, 1 + 6 * 0.9**300])


def test_one_long_key_is_averaged_in_several_tasks(many_ranges):
    spark, n = many_ranges, 400_000
    df = spark.range(n).select(F.lit(1).alias("k"), "id", F.when(F.col("id") % 97 != 0, F.pmod(F.col("id") * 7919, F.lit(1009)).cast("double")).alias("v"))
    found = ordered.exponential_average(df, ["k"], ["id"], "v", 0.01)
    tasks = found.withColumn("p", F.spark_partition_id()).groupBy("p").count().filter("count > 0").count()
    got = [r.average for r in found.orderBy("id").collect()]
    want = plain_average([None if k % 97 == 0 else float(k * 7919 % 1009) for k in range(n)], 0.01)
    assert tasks > 2 and np.allclose(got, want, rtol=0, atol=1e-9)


def test_averages_and_places_of_many_keys(many_ranges):
    rng = random.Random(2)
    rows = [(rng.choice([1, 2, None]), i, None if rng.random() < 0.1 else rng.random() * 50, "x", 0) for i in range(900)] + [(3, 0, None, "x", 0)]
    df = many_ranges.createDataFrame(rows, "k long, i long, v double, average string, n int")
    want = {}
    for k in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == k), key=lambda r: r[1])
        for place, (r, a) in enumerate(zip(own, plain_average([r[2] for r in own], 0.3), strict=True), 1):
            want[k, r[1]] = round(a, 9), place
    found = ordered.exponential_average(df.drop("average"), ["k"], ["i"], "v", 0.3).collect()
    assert {(r.k, r.i): round(r.average, 9) for r in found} == {k: v[0] for k, v in want.items()}
    placed = ordered.places(df, ["k"], [F.col("i")])
    assert placed.columns == [*df.columns, "place"] and {(r.k, r.i): r.place for r in placed.collect()} == {k: v[1] for k, v in want.items()}
    for empty in (ordered.exponential_average(df.filter("false"), ["k"], ["i"], "v", 0.3), ordered.places(df.filter("false"), ["k"], [F.col("i")])):
        assert empty.count() == 0


def test_reclaim_takes_the_oldest_of_each_volume(many_ranges):
    rng = random.Random(4)
    rows = [(rng.choice(["a", None]), k, rng.randint(0, 99), rng.randint(1, 50), "x") for k in range(400)]
    df = many_ranges.createDataFrame(rows, "volume string, job_id long, newest_s long, bytes long, _inner string")
    got = sorted(r.job_id for r in registry.reclaim(df, ["volume"], F.lit(1000)).collect())
    want, freed = [], {}
    for v, k, _, size, _ in sorted(rows, key=lambda r: (r[2], r[1])):
        if freed.get(v, 0) < 1000:
            want.append(k)
        freed[v] = freed.get(v, 0) + size
    assert got == sorted(want)


@pytest.mark.parametrize("size", ["1", "100", "10000"])
def test_a_long_clip_is_one_whatever_the_batch(spark, size):
    """A clip of 3,000 frames and two short ones, one of them without a key, beside a plain run of the folds."""
    n = 3000 if size != "1" else 400
    rng = random.Random(6)
    rows = [(clip, f, t, 0.05 * ((f // 60 + t) % 2), rng.random() < 0.97, 0.3 + 0.4 * t, 0.4, 0.1, 0.2) for clip, k in ((1, n), (2, 50), (None, 60)) for f in range(k) for t in (0, 1)]
    df = spark.createDataFrame(rows, "clip long, frame long, tid long, activity double, visible boolean, cx double, cy double, w double, h double").repartition(3)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    try:
        states = {(r.clip, r.f0): (r.f1, r.mode, r.tids) for r in folds.speaker_states(df, ["clip"]).collect()}
        tracks = folds.assign_tracks(df.select("clip", (F.col("frame") * 33).alias("t_ms"), (F.col("frame") * 2 + F.col("tid")).alias("det"), (F.col("cx") + F.col("frame") * 1e-5).alias("cx"), "cy", "w", F.col("activity").alias("openness")), ["clip"])
        merged = {r.clip: r.n for r in folds.merge_fragments(tracks, ["clip"]).groupBy("clip").agg(F.countDistinct("tid").alias("n")).collect()}
        box = F.struct("tid", "cx", "cy", "w", "h", "visible")
        frames = df.groupBy("clip", "frame").agg(F.array_sort(F.collect_list(box)).alias("boxes")).select("clip", "frame", (F.col("frame") % 700 == 699).alias("cut"), F.when(F.col("frame") % 500 < 250, "split").otherwise("single").alias("mode"), F.expr("if(frame % 500 < 250, boxes, slice(boxes, 1, 1))").alias("boxes"), F.expr("cast(array() as array<array<double>>)").alias("coarse"))
        path = folds.camera_path(frames, ["clip"]).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    from tests.test_operators import fed, frames_of

    for clip, k in ((1, n), (2, 50), (None, 60)):
        own = fed(folds.States(), frames_of([r[1:] for r in rows if r[0] == clip]))
        assert {f0: v for (c, f0), v in states.items() if c == clip} == {r.f0: (r.f1, r.mode, list(r.tids)) for r in own.itertuples()}
        assert merged[clip] == 2 and {r.frame for r in path if r.clip == clip} == set(range(k))
    drift = [r.h for r in sorted((r for r in path if r.clip == 1 and r.mode == "single"), key=lambda r: r.frame)]
    assert len(set(drift)) > 1 and all(0 < h <= 1080 for h in drift)


def test_folds_of_nothing_and_throttle_in_batches(spark):
    df = spark.createDataFrame([], "k long, t_ms long, det long, cx double, cy double, w double, openness double")
    assert folds.assign_tracks(df, ["k"]).count() == 0 and folds.merge_fragments(folds.assign_tracks(df, ["k"]), ["k"]).count() == 0
    rows = spark.createDataFrame([(k, i, i * 3 if i % 5 else None, "x") for k in (1, None) for i in range(200)], "k long, i long, v long, last string")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = [r.v for r in series.throttled(rows, ["k"], ["i"], "v", 100).orderBy("k", "i").collect()]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert got == [102, 204, 306, 408, 513] * 2


def test_keys_are_told_apart_in_batches():
    b = pa.record_batch({"a": pa.array([1, 1, None, None, 2, 2]), "b": pa.array(["x", "y", "y", "y", None, None])})
    assert ordered.key_changes(b, ["a", "b"]) == [0, 1, 2, 4] and ordered.key_changes(b.slice(0, 0), ["a"]) == [] and ordered.key_changes(b.slice(0, 1), ["a"]) == [0]
