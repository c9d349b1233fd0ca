"""Queries over clips that SQL can't express: tests hold them against small scenarios and plain loops."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from momentloom.operators import folds as D
from momentloom.sources.tables import track_samples

SQL: dict[str, str] = {}
KEY = ["clip_id"]


def _detections(spark, sf_dir):
    t = track_samples(spark, sf_dir)
    unit = lambda c: F.col(c) / 1000.0
    return t.select(*KEY, (F.expr("t_ms div 100") * 100).alias("t_ms"), F.col("event_id").alias("det"), unit("cx").alias("cx"), unit("cy").alias("cy"), unit("w").alias("w"), F.when(F.col("mouth") % 9 != 0, F.col("mouth") / 1e4).alias("openness"))


def track_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.assign_tracks(_detections(spark, sf_dir), KEY).select(*KEY, "t_ms", "det", "tid", "openness")


def fragment_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.merge_fragments(D.assign_tracks(_detections(spark, sf_dir), KEY), KEY).select(*KEY, "t_ms", "det", "tid")


def speaker_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    share = lambda c: (F.col(c) / 1000.0).alias(c)
    t = track_samples(spark, sf_dir).select(*KEY, F.col("idx").alias("frame"), "tid", (F.col("mouth") / 1e6).alias("activity"), (F.col("mouth") % 11 != 0).alias("visible"), *map(share, ("cx", "cy", "w", "h")))
    return D.speaker_states(t, KEY)


def camera_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each clip's frames the two leftmost tracks are shown, both or the first or none by turns of 25 frames; every fifth sample is a coarse face, every fortieth frame a cut."""
    t = track_samples(spark, sf_dir)
    box = F.struct("cx", F.struct("tid", *((F.col(c) / 1000.0).alias(c) for c in ("cx", "cy", "w", "h")), (F.col("mouth") % 13 != 0).alias("visible")).alias("b"))
    coarse = F.when(F.col("event_id") % 5 == 0, F.array(*(F.col(c) / 1000.0 for c in ("cx", "cy", "w", "h"))))
    g = t.groupBy(*KEY, F.col("idx").alias("frame")).agg(F.array_sort(F.collect_list(box)).alias("all"), F.array_sort(F.collect_list(coarse)).alias("coarse"))  # as many as a clip has tracks
    turn = F.expr("frame div 25 % 3")
    mode = F.when((turn == 0) & (F.size("all") >= 2), "split").otherwise("single")
    shown = F.when(mode == "split", 2).when(turn == 1, 1).otherwise(0)
    rows = g.select(*KEY, "frame", (F.col("frame") % 40 == 39).alias("cut"), mode.alias("mode"), F.transform(F.slice("all", 1, shown), lambda x: x["b"]).alias("boxes"), "coarse")
    return D.camera_path(rows, KEY)


QUERIES = {f.__name__: f for f in (track_assign, fragment_merge, speaker_states, camera_path)}
