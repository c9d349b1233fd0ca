"""Streams with timers, and what nulls do to them."""

import time

import pytest
from pyspark.sql import functions as F

from momentloom.operators import registry, series
from momentloom.plans.registry_queries import DRAIN_NOW, task_events
from momentloom.streaming import progress, timers

SF = "/root/testdata/sf0.001"


@pytest.fixture
def rocks(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    timers.use_timers(spark)
    yield spark
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


class Run:
    """A stream of files: each call of step adds rows as one file and runs until all is read; the rows that came out."""

    def __init__(self, spark, folder, schema, make):
        self.spark, self.folder, self.schema, self.make, self.n = spark, folder, schema, make, 0
        self.seen = 0

    def step(self, rows):
        self.n += 1
        self.spark.createDataFrame(rows, self.schema).coalesce(1).write.mode("append").parquet(str(self.folder / "in"))
        stream = self.make(self.spark.readStream.schema(self.schema).parquet(str(self.folder / "in")))
        q = stream.writeStream.format("parquet").option("path", str(self.folder / "out")).option("checkpointLocation", str(self.folder / "c")).trigger(availableNow=True).start()
        q.awaitTermination()
        out = self.spark.read.parquet(str(self.folder / "out")).collect()
        new, self.seen = out, len(out)
        return sorted(map(tuple, new))


def test_a_silent_key_becomes_an_error(rocks, tmp_path):
    schema = "job long, at long, state string"
    (tmp_path / "in").mkdir()
    stream = timers.idle_stream(rocks.readStream.schema(schema).parquet(str(tmp_path / "in")), "job", "at", "state", quiet_ms=8000)
    q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="300 milliseconds").start()

    def feed(rows):
        rocks.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    def out():
        return sorted(map(tuple, rocks.read.schema("job long, state string, last_ms long, error string").parquet(str(tmp_path / "out")).collect())) if (tmp_path / "out").exists() else []

    try:
        feed([(1, 10, "rendering"), (2, 10, "rendering"), (3, 5, "rendering"), (3, 11, "done"), (4, 12, "awaiting_approval"), (None, 1, "x"), (5, 1, None)])
        feed([(2, 20, "rendering")])
        # No further row comes: the timers alone make the error rows.
        end = time.time() + 60
        while len(rows := out()) < 2 and time.time() < end and q.isActive:
            time.sleep(0.5)
        assert [r[:3] for r in rows] == [(1, "error", 10), (2, "error", 20)] and all("no sign of life" in r[3] for r in rows), q.exception()
        feed([(1, 30, "rendering"), (1, 31, "cancelled")])
        time.sleep(3)
        assert len(out()) == 2
    finally:
        q.stop()


def test_deadlines_equal_their_batch_twin(rocks, tmp_path):
    events = task_events(rocks, SF).withColumn("at", F.timestamp_millis("at_ms")).filter(F.col("at_ms") <= DRAIN_NOW)
    rows = events.orderBy("at_ms").collect()
    cut = [rows[k * len(rows) // 3 : (k + 1) * len(rows) // 3] for k in range(3)]
    run = Run(rocks, tmp_path, "task long, at timestamp, kind string", lambda df: timers.deadline_stream(df, "task", "at", "kind", 3_600_000, "0 seconds"))
    for part in cut:
        got = run.step([(r.task, r.at, r.kind) for r in part])
    want = registry.drained(task_events(rocks, SF), "task", "at_ms", "kind", 3_600_000, F.lit(rows[-1].at_ms)).collect()
    assert sorted(map(tuple, want)) == got and {r[1] for r in got} == {"done", "timeout"}


def test_a_late_finish_is_dropped(rocks, tmp_path):
    minute = 60_000
    row = lambda task, at, kind: (task, (at + 1000) * minute, kind)
    as_rows = lambda rows: rocks.createDataFrame(rows, "task long, ms long, kind string").select("task", F.timestamp_millis("ms").alias("at"), "kind").collect()
    run = Run(rocks, tmp_path, "task long, at timestamp, kind string", lambda df: timers.deadline_stream(df, "task", "at", "kind", 10 * minute, "1 minute"))
    run.step(as_rows([row(1, 0, "start"), row(2, 1, "start"), row(3, 2, "finish"), row(4, 0, "start"), row(4, 3, "finish"), row(4, 4, "finish")]))
    run.step(as_rows([row(9, 30, "start"), row(None, 3, "start")]))
    got = run.step(as_rows([row(1, 31, "finish"), row(9, 33, "finish"), row(9, 34, "finish")]))
    assert [(r[0], r[1], r[2] // minute - 1000) for r in got] == [(1, "timeout", 10), (2, "timeout", 11), (4, "done", 3), (9, "done", 33)]


def test_drained_edges(spark):
    df = spark.createDataFrame([(1, 5, "start"), (1, 5, "start"), (1, 9, "finish"), (2, None, "start"), (None, 1, "start"), (3, 4, None), (4, 1, "finish"), (5, 100, "start")], "task long, at_ms long, kind string").withColumn("outcome", F.lit("x"))
    assert [tuple(r) for r in registry.drained(df, "task", "at_ms", "kind", 10, F.lit(50)).collect()] == [(1, "done", 9)]
    assert registry.drained(df.filter("false"), "task", "at_ms", "kind", 10, F.lit(50)).count() == 0


def test_nulls_in_streams_are_as_in_batches(spark, tmp_path):
    rows = [(1, 1, None), (1, 2, None), (1, 3, 5), (1, 4, 5), (1, 5, None), (2, 1, 7), (2, 2, 100), (2, 3, None), (2, 4, 190), (2, 5, 200)]
    spark.createDataFrame(rows, "k long, i long, v long").coalesce(1).write.parquet(str(tmp_path / "in"))
    batch = spark.read.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k long, i long, v long").parquet(str(tmp_path / "in"))
    for name, made, want in (("a", progress.change_stream(stream, "k", "i", "v"), series.changes_only(batch, ["k"], ["i"], "v")), ("b", progress.throttle_stream(stream, "k", "i", "v", 90), series.throttled(batch, ["k"], ["i"], "v", 90))):
        made.writeStream.format("parquet").option("path", str(tmp_path / name)).option("checkpointLocation", str(tmp_path / f"{name}_c")).trigger(availableNow=True).start().awaitTermination()
        key = lambda r: tuple((x is None, x) for x in r)
        assert sorted(map(tuple, spark.read.parquet(str(tmp_path / name)).collect()), key=key) == sorted(map(tuple, want.collect()), key=key)
