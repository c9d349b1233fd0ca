"""Rectangles, crops and faces, as column arithmetic. Boxes are centre and size in whole units.

Column functions give null where an input is null, but for rect_iou and same_face, where a box with a null
shares nothing and is no face. Functions of tables treat a null key as a key like others (nearest_face, a join, leaves null
keys out), pass over null numbers as SQL's aggregates do, count repeated rows as often as they come and give empty tables for empty ones. Columns
beside those named are not read, and are kept by first_of_same_faces alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _given(value: Column, *inputs: Column) -> Column:
    """value where all inputs are there, else null: least and greatest pass nulls over."""
    there = F.lit(True)
    for x in inputs:
        there = there & x.isNotNull()
    return F.when(there, value)


def rect_iou(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Share of the union that two rectangles (x, y, w, h from the left upper corner) have in common; 0 without area."""
    wide = F.greatest(F.least(a["x"] + a["w"], b["x"] + b["w"]) - F.greatest(a["x"], b["x"]), F.lit(0))
    high = F.greatest(F.least(a["y"] + a["h"], b["y"] + b["h"]) - F.greatest(a["y"], b["y"]), F.lit(0))
    common = wide * high
    share = F.try_divide(common.cast("double"), a["w"] * a["h"] + b["w"] * b["h"] - common)
    return F.coalesce(_given(share, *(box[c] for box in (a, b) for c in "xywh")), F.lit(0.0))


#: Fixed values, by mode (one face, two): the face's share of the height and its place on it (hundredths), and the output's height.
FACE_SHARE, FACE_PLACE, OUT_HEIGHT = {"single": 35, "split": 42}, {"single": 42, "split": 46}, {"single": 1920, "split": 960}


def crop_height(face_h: Column, src_h: int, mode: str = "single", zoom_tenths: int = 9, most_upscale: int = 4) -> Column:
    """Height of the crop that gives a face its share of the picture, from 1.8 faces (or the upscale limit) to the source's height; where these cross, the latter wins."""
    floor = min(OUT_HEIGHT[mode] / max(1, most_upscale), src_h)
    ideal = face_h * 1000.0 / (FACE_SHARE[mode] * zoom_tenths)
    return _given(F.least(F.greatest(ideal, F.greatest(face_h * 1.8, F.lit(float(floor)))), F.lit(float(src_h))), face_h)


def crop_centre(cy: Column, height: Column, mode: str = "single") -> Column:
    """Where the crop's centre lies, so that the face is at its place on it."""
    return cy + (50 - FACE_PLACE[mode]) * height / 100


def crop_rect(cx: Column, cy: Column, height: Column, src_w: int, src_h: int, aspect: float) -> dict[str, Column]:
    """The crop of that height around a point, made small enough and moved to lie inside the source."""
    h = F.least(height, F.lit(min(float(src_h), src_w / aspect)))
    w = h * aspect
    rect = {"x": F.least(F.greatest(cx - w / 2, F.lit(0.0)), src_w - w), "y": F.least(F.greatest(cy - h / 2, F.lit(0.0)), src_h - h), "w": w, "h": h}
    return {k: _given(v, cx, cy, height) for k, v in rect.items()}


def same_face(a: dict[str, Column], b: dict[str, Column], share: float = 0.5) -> Column:
    """Whether the centres are nearer than a share of the wider face."""
    near = F.hypot(a["cx"] - b["cx"], a["cy"] - b["cy"]) < share * F.greatest(a["w"], b["w"])
    return F.coalesce(_given(near, a["w"], b["w"]), F.lit(False))


def first_of_same_faces(boxes: DataFrame, key: list[str], order: str) -> DataFrame:
    """Boxes of a frame without those that are the same face as an earlier kept one (a fold over the frame's few boxes)."""
    item = F.struct(order, "cx", "cy", "w", F.struct(*boxes.columns).alias("row"))
    kind = boxes.select(item.alias("x")).schema["x"].dataType.simpleString()
    kept = F.aggregate(
        F.array_sort(F.collect_list(item)), F.expr(f"cast(array() as array<{kind}>)"), lambda acc, x: F.when(F.exists(acc, lambda k: same_face({c: k[c] for c in ("cx", "cy", "w")}, {c: x[c] for c in ("cx", "cy", "w")})), acc).otherwise(F.concat(acc, F.array(x)))
    )
    return boxes.groupBy(*key).agg(kept.alias("_k")).select(F.explode("_k").alias("x")).select("x.row.*")


def moving_tracks(samples: DataFrame, clip: list[str], tid: str, least: int = 20, most_spread: float = 0.004, most_width: float = 0.045) -> DataFrame:
    """Tracks (n, spread of the centre, mean width) of samples (cx, cy, w as shares) that are no still pictures: those of fewer than least samples, that move or that are wide; all of a clip's where all are still."""
    t = samples.groupBy(*clip, tid).agg(F.count("*").alias("n"), F.round(F.sqrt(F.var_pop("cx") + F.var_pop("cy")), 6).alias("spread"), F.round(F.avg("w"), 6).alias("width"))
    still = (F.col("n") >= least) & (F.col("spread") < most_spread) & (F.col("width") < most_width)
    return t.withColumn("_every_still", F.min(still).over(Window.partitionBy(*clip))).filter(~still | F.col("_every_still")).drop("_every_still")


def landmark_box(points: DataFrame, key: list[str]) -> DataFrame:
    """Centre and size of the box around points (x, y)."""
    g = points.groupBy(*key).agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    return g.select(*key, ((F.col("x0") + F.col("x1")) / 2).alias("cx"), ((F.col("y0") + F.col("y1")) / 2).alias("cy"), (F.col("x1") - F.col("x0")).alias("w"), (F.col("y1") - F.col("y0")).alias("h"))


def openness(upper: tuple[Column, Column], lower: tuple[Column, Column], top: tuple[Column, Column], chin: tuple[Column, Column]) -> Column:
    """Distance of the lips over the height of the face."""
    gap = lambda p, q: F.sqrt((p[0] - q[0]) * (p[0] - q[0]) + (p[1] - q[1]) * (p[1] - q[1]))
    return gap(upper, lower) / (gap(top, chin) + 1e-6)


def nearest_face(stale: DataFrame, faces: DataFrame, key: list[str]) -> DataFrame:
    """For each row (cx, cy) the face of its key that is nearest, by squared distance; ties go to the smaller face_id."""
    both = stale.join(faces.select(*key, "face_id", F.col("cx").alias("fx"), F.col("cy").alias("fy")), key)
    d = (F.col("fx") - F.col("cx")) * (F.col("fx") - F.col("cx")) + (F.col("fy") - F.col("cy")) * (F.col("fy") - F.col("cy"))
    return both.withColumn("d", d).groupBy(*key, "row_id").agg(F.min(F.struct("d", "face_id")).alias("m")).select(*key, "row_id", F.col("m.face_id").alias("face_id"), F.col("m.d").alias("distance2"))


def correlation(pairs: DataFrame, key: list[str], a: str, b: str) -> DataFrame:
    """Normalised correlation of two series of a key; 0 where one of them is constant."""
    return pairs.groupBy(*key).agg(F.coalesce(F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b)), F.lit(0.0)).alias("ncc"))
