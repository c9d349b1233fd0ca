"""Tables as Parquet, and the inputs that the queries derive from them by integer rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df dealt over all cores where its files leave some idle; tables whose rows lie evenly in their splits stay as they are.

    A small table has fewer splits than there are cores. In a larger one all rows of a row group go to one split, and the
    other splits of its bytes are empty: a table of one row group would be the work of one task, whatever its size. How
    many rows a split has is read from the files' footers.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() < cores:
        return df.repartition(cores)
    rows = [r["count"] for r in df.select(F.spark_partition_id().alias("split")).groupBy("split").count().collect()]
    if max(rows, default=0) * cores <= 2 * sum(rows):
        return df
    return df.repartition(cores * min(4, 1 + sum(rows) // (cores * ROWS_EACH)))


#: Rows of documents that are worth a task of their own.
ROWS_EACH = 5_000


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents"))


#: Tracks of a clip.
CLIP_TRACKS = 4


def track_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as samples of tracks: a track a user, CLIP_TRACKS of them a clip; boxes in thousandths, a sample every 100 ms with gaps."""
    e = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "value")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = e.withColumn("idx", F.row_number().over(w) - 1)
    return e.select(
        F.expr(f"user_id div {CLIP_TRACKS}").alias("clip_id"),
        F.col("user_id").alias("tid"),
        F.col("idx").cast("long").alias("idx"),
        (F.col("idx") * 100 + F.expr("idx div 7") * 700 + F.expr("idx div 20") * 2500).cast("long").alias("t_ms"),
        (F.col("event_id") * 37 % 1000).alias("cx"),
        (F.col("event_id") * 53 % 1000).alias("cy"),
        (F.col("event_id") * 11 % 150 + 10).alias("w"),
        (F.col("event_id") * 13 % 300 + 50).alias("h"),
        F.round(F.col("value") * 100).cast("long").alias("mouth"),
        "event_id",
    )


TRACKS_SQL = f"""tracks AS (
  SELECT user_id // {CLIP_TRACKS} AS clip_id, user_id AS tid, idx, idx * 100 + (idx // 7) * 700 + (idx // 20) * 2500 AS t_ms,
    event_id * 37 % 1000 AS cx, event_id * 53 % 1000 AS cy, event_id * 11 % 150 + 10 AS w, event_id * 13 % 300 + 50 AS h,
    CAST(round(value * 100) AS BIGINT) AS mouth, event_id
  FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS idx FROM events))"""


def frame_spine(tracks: DataFrame, step_ms: int = 333) -> DataFrame:
    """A row for each track and frame, a frame every step_ms from the start to a second after the last sample."""
    ends = tracks.groupBy("clip_id", "tid").agg(F.max("t_ms").alias("last"))
    return ends.select("clip_id", "tid", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(last + 1000) div {step_ms}"))).alias("frame")).withColumn("t_ms", F.col("frame") * step_ms)


SPINE_SQL = """spine AS (
  SELECT clip_id, tid, frame, frame * 333 AS t_ms
  FROM (SELECT clip_id, tid, unnest(range(0, (max(t_ms) + 1000) // 333 + 1)) AS frame FROM tracks GROUP BY clip_id, tid))"""
