"""Queries over texts as sound: a sample a character, sixteen thousand a second."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from momentloom.operators import scoring as C
from momentloom.sources.sound import frame_hop, frame_rms
from momentloom.sources.tables import documents

QUERIES, SQL = {}, {}
#: 533 samples, so that thirty frames are ten samples short of a second.
HOP = frame_hop(16_000, 30)

SAMPLES = r"""c AS (SELECT doc_id, unnest(string_split(text, '')) AS ch, generate_subscripts(string_split(text, ''), 1) - 1 AS idx FROM documents),
smp AS (SELECT doc_id, idx, (unicode(ch) * 257 + idx * 13) % 20001 - 10000 AS v FROM c WHERE ch <> '')"""
FRAMES = f"""{SAMPLES}, fr AS (SELECT doc_id, idx // {HOP} AS frame, sqrt(sum(v * v) / (32768.0::DOUBLE * 32768.0::DOUBLE) / count(*)::DOUBLE + 1e-9) AS rms FROM smp GROUP BY doc_id, idx // {HOP} HAVING count(*) = {HOP})"""


def text_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = documents(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "")).alias("idx", "ch")).filter("ch != ''")
    return c.select("doc_id", F.col("idx").cast("long").alias("idx"), ((F.ascii("ch") * 257 + F.col("idx") * 13) % 20001 - 10000).alias("v"))


def frame_loudness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rms of each whole frame of a text's sound."""
    return frame_rms(text_samples(spark, sf_dir), ["doc_id"], HOP).withColumn("rms", F.round("rms", 9))


SQL["frame_loudness"] = f"WITH {FRAMES} SELECT doc_id, frame, round(rms, 9) AS rms FROM fr"


def frames_with_sound(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames and those over the threshold that a text's own quiet frames give."""
    frames = frame_rms(text_samples(spark, sf_dir), ["doc_id"], HOP)
    over = frames.groupBy("doc_id").agg(C.sound_threshold(F.percentile("rms", F.lit(0.25))).alias("th"))
    return frames.join(over, "doc_id").groupBy("doc_id").agg(F.count("*").alias("frames"), F.count_if(F.col("rms") > F.col("th")).alias("sounding"), F.round(F.first("th"), 9).alias("threshold"))


SQL["frames_with_sound"] = f"""WITH {FRAMES}, th AS (SELECT doc_id, greatest(0.01, quantile_cont(rms, 0.25) * 1.8) AS th FROM fr GROUP BY doc_id)
SELECT doc_id, count(*) AS frames, count(*) FILTER (WHERE rms > th) AS sounding, round(any_value(th), 9) AS threshold FROM fr JOIN th USING (doc_id) GROUP BY doc_id"""

QUERIES |= {f.__name__: f for f in (frame_loudness, frames_with_sound)}
