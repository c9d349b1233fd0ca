"""Queries over derived boxes and over halves of embeddings as halves of frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from momentloom.operators import geometry as R
from momentloom.sources.tables import TRACKS_SQL, table, track_samples

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


PAIR = f"{TRACKS_SQL}, pr AS (SELECT a.clip_id, a.idx, a.tid AS a, b.tid AS b, a.cx AS ax, a.cy AS ay, a.w AS aw, a.h AS ah, b.cx AS bx, b.cy AS by_, b.w AS bw, b.h AS bh FROM tracks a JOIN tracks b ON a.clip_id = b.clip_id AND a.idx = b.idx AND a.tid < b.tid)"


def _pairs(spark, sf_dir):
    """Boxes of two tracks of a clip at the same sample: a clip has few tracks, so a sample few pairs."""
    t = track_samples(spark, sf_dir)
    a = t.select("clip_id", "idx", F.col("tid").alias("a"), F.col("cx").alias("ax"), F.col("cy").alias("ay"), F.col("w").alias("aw"), F.col("h").alias("ah"))
    b = t.select("clip_id", "idx", F.col("tid").alias("b"), F.col("cx").alias("bx"), F.col("cy").alias("by_"), F.col("w").alias("bw"), F.col("h").alias("bh"))
    return a.join(b, ["clip_id", "idx"]).filter("a < b")


@query(f"""WITH {PAIR}, i AS (SELECT *, greatest(least(ax + aw, bx + bw) - greatest(ax, bx), 0) * greatest(least(ay + ah, by_ + bh) - greatest(ay, by_), 0) AS c FROM pr)
SELECT clip_id, idx, a, b, c::DOUBLE / (aw * ah + bw * bh - c) AS iou FROM i WHERE c > 0""")
def rect_iou(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    p = _pairs(spark, sf_dir).withColumn("iou", R.rect_iou({"x": c("ax"), "y": c("ay"), "w": c("aw"), "h": c("ah")}, {"x": c("bx"), "y": c("by_"), "w": c("bw"), "h": c("bh")}))
    return p.filter("iou > 0").select("clip_id", "idx", "a", "b", "iou")


H1 = "least(greatest({h} * 1000.0::DOUBLE / 315, greatest({h} * 1.8::DOUBLE, 480.0)), 1000.0::DOUBLE)"
H2 = "least(greatest({h} * 1000.0::DOUBLE / 378, greatest({h} * 1.8::DOUBLE, 240.0)), 1000.0::DOUBLE)"


@query(f"""WITH {TRACKS_SQL}, t AS (SELECT *, {H1.format(h='h')} AS h1, {H2.format(h='h')} AS h2 FROM tracks)
SELECT clip_id, tid, idx, h1 AS single_h, cy + 8 * h1 / 100 AS single_y, h2 AS split_h, cy + 4 * h2 / 100 AS split_y FROM t""")
def crop_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Height and centre of the crop of a face, for a picture of one and of two."""
    one, two = R.crop_height(F.col("h"), 1000), R.crop_height(F.col("h"), 1000, "split")
    return track_samples(spark, sf_dir).select("clip_id", "tid", "idx", one.alias("single_h"), R.crop_centre(F.col("cy"), one).alias("single_y"), two.alias("split_h"), R.crop_centre(F.col("cy"), two, "split").alias("split_y"))


@query(f"""WITH {PAIR}, z AS (SELECT *, {H2.format(h='ah')} AS g1, {H2.format(h='bh')} AS g2 FROM pr),
v AS (SELECT *, ay + 4 * g1 / 100 AS ya, by_ + 4 * g2 / 100 AS yb, least(g1, 1000 / 1.125::DOUBLE) AS h1, least(g2, 1000 / 1.125::DOUBLE) AS h2 FROM z),
w AS (SELECT *, h1 * 1.125::DOUBLE AS w1, h2 * 1.125::DOUBLE AS w2 FROM v),
r AS (SELECT *, least(greatest(ax - w1 / 2, 0.0), 1000 - w1) AS x1, least(greatest(ya - h1 / 2, 0.0), 1000 - h1) AS y1, least(greatest(bx - w2 / 2, 0.0), 1000 - w2) AS x2, least(greatest(yb - h2 / 2, 0.0), 1000 - h2) AS y2 FROM w),
i AS (SELECT *, greatest(least(x1 + w1, x2 + w2) - greatest(x1, x2), 0) * greatest(least(y1 + h1, y2 + h2) - greatest(y1, y2), 0) AS c FROM r)
SELECT clip_id, idx, a, b, floor(coalesce(c / nullif(w1 * h1 + w2 * h2 - c, 0), 0) * 1e6 + 0.5) / 1e6 AS iou FROM i""")
def split_iou(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlap of the crops that a split picture would make of two faces."""
    c = F.col

    def crop(x: str, y: str, h: str):
        height = R.crop_height(c(h), 1000, "split")
        return R.crop_rect(c(x), R.crop_centre(c(y), height, "split"), height, 1000, 1000, 1.125)

    return _pairs(spark, sf_dir).select("clip_id", "idx", "a", "b", (F.floor(R.rect_iou(crop("ax", "ay", "ah"), crop("bx", "by_", "bh")) * 1e6 + 0.5) / 1e6).alias("iou"))


@query(f"""WITH RECURSIVE {TRACKS_SQL}, l AS (SELECT clip_id, idx, list({{'tid': tid, 'cx': cx, 'cy': cy, 'w': w}} ORDER BY tid) AS xs FROM tracks GROUP BY clip_id, idx),
k AS (SELECT clip_id, idx, unnest(list_reduce(list_transform(xs, lambda x: [x]), lambda acc, x: CASE WHEN len(list_filter(acc, lambda y: sqrt(((y.cx - x[1].cx)::DOUBLE) ** 2 + ((y.cy - x[1].cy)::DOUBLE) ** 2) < 0.5 * greatest(y.w, x[1].w))) > 0 THEN acc ELSE list_concat(acc, x) END)) AS x FROM l)
SELECT clip_id, idx, x.tid AS tid FROM k""")
def distinct_faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = track_samples(spark, sf_dir).select("clip_id", "idx", "tid", "cx", "cy", "w")
    return R.first_of_same_faces(t, ["clip_id", "idx"], "tid").select("clip_id", "idx", "tid")


@query(f"""WITH {TRACKS_SQL}, f AS (SELECT clip_id, idx, tid AS face_id, cx AS fx, cy AS fy, w, h FROM tracks WHERE mouth > 1500 AND w > 0 AND h > 0),
s AS (SELECT clip_id, idx, tid AS row_id, cx, cy FROM tracks WHERE mouth <= 1500)
SELECT clip_id, idx, row_id, arg_min(face_id, (d, face_id)) AS face_id, min(d) AS distance2 FROM (SELECT s.clip_id, s.idx, row_id, face_id, (fx - cx) * (fx - cx) + (fy - cy) * (fy - cy) AS d FROM s JOIN f ON s.clip_id = f.clip_id AND s.idx = f.idx) GROUP BY clip_id, idx, row_id""")
def coarse_reacquire(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Invisible tracks take the nearest valid face of the frame."""
    t = track_samples(spark, sf_dir)
    faces = t.filter("mouth > 1500 and w > 0 and h > 0").select("clip_id", "idx", F.col("tid").alias("face_id"), "cx", "cy")
    return R.nearest_face(t.filter("mouth <= 1500").select("clip_id", "idx", F.col("tid").alias("row_id"), "cx", "cy"), faces, ["clip_id", "idx"])


@query(f"WITH {TRACKS_SQL} SELECT clip_id, idx, arg_max(tid, (w * h, -tid)) AS tid, max(w * h) AS area FROM tracks GROUP BY clip_id, idx")
def largest_face(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = track_samples(spark, sf_dir).groupBy("clip_id", "idx").agg(F.max(F.struct((F.col("w") * F.col("h")).alias("area"), (-F.col("tid")).alias("neg"))).alias("m"))
    return g.select("clip_id", "idx", (-F.col("m.neg")).alias("tid"), F.col("m.area").alias("area"))


def _points(spark, sf_dir):
    """Dimensions of embeddings as points, two a point, in ten-thousandths."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("k", "v")).withColumn("v", F.floor(F.col("v").cast("double") * 10000).cast("long"))
    return e


PTS = "pts AS (SELECT vec_id, unnest(range(0, len(embedding))) AS k, floor(unnest(embedding)::DOUBLE * 10000)::BIGINT AS v FROM embeddings)"


@query(f"""WITH {PTS}, p AS (SELECT a.vec_id, a.v AS x, b.v AS y FROM pts a JOIN pts b ON a.vec_id = b.vec_id AND b.k = a.k + 1 AND a.k % 2 = 0)
SELECT vec_id, (min(x) + max(x)) / 2.0::DOUBLE AS cx, (min(y) + max(y)) / 2.0::DOUBLE AS cy, max(x) - min(x) AS w, max(y) - min(y) AS h FROM p GROUP BY vec_id""")
def landmark_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _points(spark, sf_dir)
    p = e.groupBy("vec_id", F.expr("k div 2").alias("p")).agg(F.max(F.when(F.col("k") % 2 == 0, F.col("v"))).alias("x"), F.max(F.when(F.col("k") % 2 == 1, F.col("v"))).alias("y"))
    return R.landmark_box(p, ["vec_id"])


@query("SELECT vec_id, floor(sqrt((e[1] - e[3]) ** 2 + (e[2] - e[4]) ** 2) / (sqrt((e[5] - e[7]) ** 2 + (e[6] - e[8]) ** 2) + 1e-6) * 1e5 + 0.5) / 1e5 AS openness FROM (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings)")
def mouth_openness(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = lambda k: F.get("embedding", F.lit(k)).cast("double")
    value = R.openness((e(0), e(1)), (e(2), e(3)), (e(4), e(5)), (e(6), e(7)))
    return table(spark, sf_dir, "embeddings").select("vec_id", (F.floor(value * 1e5 + 0.5) / 1e5).alias("openness"))


@query(f"""WITH {PTS}, h AS (SELECT a.vec_id, a.v AS x, b.v AS y FROM pts a JOIN pts b ON a.vec_id = b.vec_id AND b.k = a.k + 32 AND a.k < 32)
SELECT vec_id, floor(coalesce(covar_pop(x, y) / nullif(stddev_pop(x) * stddev_pop(y), 0), 0) * 1e6 + 0.5) / 1e6 AS ncc FROM h GROUP BY vec_id""")
def halves_ncc(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _points(spark, sf_dir).withColumn("p", F.col("k") % 32)
    h = e.groupBy("vec_id", "p").agg(F.max(F.when(F.col("k") < 32, F.col("v"))).alias("x"), F.max(F.when(F.col("k") >= 32, F.col("v"))).alias("y"))
    return R.correlation(h, ["vec_id"], "x", "y").select("vec_id", (F.floor(F.col("ncc") * 1e6 + 0.5) / 1e6).alias("ncc"))


@query(f"WITH {PTS} SELECT vec_id, floor(stddev_pop(v) * 1e4 + 0.5) / 1e4 AS spread, stddev_pop(v) < 1245 AS uniform FROM pts GROUP BY vec_id")
def uniform_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _points(spark, sf_dir).groupBy("vec_id").agg(F.stddev_pop("v").alias("s"))
    return g.select("vec_id", (F.floor(F.col("s") * 1e4 + 0.5) / 1e4).alias("spread"), (F.col("s") < 1245).alias("uniform"))


@query(f"""WITH {PTS}, h AS (SELECT a.vec_id, a.v AS x, b.v AS y FROM pts a JOIN pts b ON a.vec_id = b.vec_id AND b.k = a.k + 32 AND a.k < 32),
q AS (SELECT vec_id, coalesce(covar_pop(x, y) / nullif(stddev_pop(x) * stddev_pop(y), 0), 0) > 0.2 AS alike FROM h GROUP BY vec_id), u AS (SELECT vec_id, stddev_pop(v) < 1245 AS uniform FROM pts GROUP BY vec_id)
SELECT vec_id, list_filter([CASE WHEN alike THEN 'halves_alike' END, CASE WHEN uniform THEN 'uniform' END], lambda x: x IS NOT NULL) AS flags, NOT (alike OR uniform) AS passed FROM q JOIN u USING (vec_id)""")
def qa_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Defects of each frame; a frame without any passes."""
    both = halves_ncc(spark, sf_dir).join(uniform_frames(spark, sf_dir), "vec_id")
    flags = F.array_compact(F.array(F.when(F.col("ncc") > 0.2, "halves_alike"), F.when(F.col("uniform"), "uniform")))
    return both.select("vec_id", flags.alias("flags"), (F.size(flags) == 0).alias("passed"))
