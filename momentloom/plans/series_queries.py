"""Queries over track samples: lookups, resampling, activity, runs, streams' batch twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from momentloom.operators import geometry as R
from momentloom.operators import ordered as O
from momentloom.operators import series as S
from momentloom.sources.tables import SPINE_SQL, TRACKS_SQL, frame_spine, track_samples

QUERIES, SQL = {}, {}
KEY = ["clip_id", "tid"]


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query(f"""WITH {TRACKS_SQL} SELECT clip_id, tid, idx, cx FROM tracks WHERE idx % 3 = 0""")
def stride_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.stride_sample(track_samples(spark, sf_dir), "idx", F.lit(30.0), F.lit(10.0)).select("clip_id", "tid", "idx", "cx")


@query(f"""WITH {TRACKS_SQL}, {SPINE_SQL},
p AS (SELECT s.*, t.t_ms AS pt, t.cx AS pc FROM spine s ASOF LEFT JOIN tracks t ON s.tid = t.tid AND s.t_ms >= t.t_ms),
n AS (SELECT p.*, t.t_ms AS nt, t.cx AS nc FROM p ASOF LEFT JOIN tracks t ON p.tid = t.tid AND p.t_ms < t.t_ms)
SELECT clip_id, tid, frame, t_ms, CASE WHEN nt IS NULL OR (pt IS NOT NULL AND t_ms - pt <= nt - t_ms) THEN pc ELSE nc END AS cx FROM n""")
def asof_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = track_samples(spark, sf_dir)
    return S.asof_nearest(frame_spine(t), t, KEY, "t_ms", "cx").select("clip_id", "tid", "frame", "t_ms", "cx")


BRACKET_SQL = f"""WITH {TRACKS_SQL}, {SPINE_SQL},
p AS (SELECT s.*, t.t_ms AS pt, t.cx AS pc FROM spine s ASOF LEFT JOIN tracks t ON s.tid = t.tid AND s.t_ms >= t.t_ms),
b AS (SELECT p.*, t.t_ms AS nt, t.cx AS nc FROM p ASOF LEFT JOIN tracks t ON p.tid = t.tid AND p.t_ms <= t.t_ms)"""


@query(f"""{BRACKET_SQL}
SELECT clip_id, tid, t_ms, CASE WHEN pt IS NULL THEN nc::DOUBLE WHEN nt IS NULL OR nt = pt OR nt - pt > 1000 THEN pc
  ELSE pc + (nc - pc) * (t_ms - pt) / (nt - pt)::DOUBLE END AS cx FROM b""")
def interp_hold(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = track_samples(spark, sf_dir).withColumn("cx", F.col("cx").cast("double"))
    found = S.interpolate_hold(S.bracket(frame_spine(t), t, KEY, "t_ms", "cx"), "t_ms", 1000)
    return found.select("clip_id", "tid", "t_ms", F.col("value").alias("cx"))


@query(f"""{BRACKET_SQL}
SELECT clip_id, tid, t_ms, coalesce(least(t_ms - pt, nt - t_ms) <= 500, false) AS visible FROM b""")
def track_visibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = track_samples(spark, sf_dir)
    return S.visible_within(S.bracket(frame_spine(t), t, KEY, "t_ms", "cx"), "t_ms", 500).select("clip_id", "tid", "t_ms", "visible")


@query(f"""WITH {TRACKS_SQL}
SELECT clip_id, tid, idx, round(stddev_pop(mouth) OVER (PARTITION BY clip_id, tid ORDER BY idx ROWS BETWEEN 5 PRECEDING AND CURRENT ROW), 6) AS activity FROM tracks""")
def rolling_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.rolling_std(track_samples(spark, sf_dir), KEY, ["idx"], "mouth", 6, "activity").select("clip_id", "tid", "idx", F.round("activity", 6).alias("activity"))


@query(f"""WITH {TRACKS_SQL}
SELECT clip_id, tid, idx, max(mouth) OVER (PARTITION BY clip_id, tid ORDER BY idx ROWS BETWEEN 37 PRECEDING AND CURRENT ROW) AS peak FROM tracks""")
def causal_peak(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.causal_peak(track_samples(spark, sf_dir), KEY, ["idx"], "mouth", 38, "peak").select("clip_id", "tid", "idx", "peak")


@query(f"""WITH RECURSIVE {TRACKS_SQL}, ema AS (
  SELECT clip_id, tid, idx, 0.08 * mouth::DOUBLE AS acc FROM tracks WHERE idx = 0
  UNION ALL SELECT t.clip_id, t.tid, t.idx, e.acc + 0.08 * (t.mouth::DOUBLE - e.acc) FROM ema e JOIN tracks t ON t.tid = e.tid AND t.idx = e.idx + 1)
SELECT clip_id, tid, idx, round(acc, 4) AS average FROM ema""")
def ema_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = O.exponential_average(track_samples(spark, sf_dir), KEY, ["idx"], "mouth", 0.08)
    return found.withColumn("average", F.round("average", 4))


@query(f"""WITH {TRACKS_SQL},
s AS (SELECT clip_id, tid, count(*) AS n, round(sqrt(var_pop(cx / 1000.0) + var_pop(cy / 1000.0)), 6) AS spread, round(avg(w / 1000.0), 6) AS width FROM tracks GROUP BY clip_id, tid),
m AS (SELECT *, n >= 20 AND spread < 0.4 AND width < 0.085 AS still FROM s)
SELECT clip_id, tid, n, spread, width FROM (SELECT *, bool_and(still) OVER (PARTITION BY clip_id) AS every FROM m) WHERE NOT still OR every""")
def static_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tracks that are not still; all of a clip's where all are still. Thresholds fit the derived boxes."""
    share = track_samples(spark, sf_dir).select(*KEY, *((F.col(c) / 1000).alias(c) for c in ("cx", "cy", "w")))
    return R.moving_tracks(share, ["clip_id"], "tid", most_spread=0.4, most_width=0.085)


@query(f"""WITH {TRACKS_SQL},
s AS (SELECT clip_id, tid, count(*) AS n, sum(mouth)::BIGINT AS activity, sum(cx)::BIGINT AS sx FROM tracks GROUP BY clip_id, tid),
top4 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY clip_id ORDER BY n DESC, tid) AS r FROM s) WHERE r <= 4 AND n >= 5),
top2 AS (SELECT *, row_number() OVER (PARTITION BY clip_id ORDER BY activity DESC, tid) AS a FROM top4)
SELECT clip_id, tid, n, activity, row_number() OVER (PARTITION BY clip_id ORDER BY sx / n::DOUBLE, tid) AS place FROM top2 WHERE a <= 2""")
def top_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four tracks of most samples, of these the two of most activity, from left to right."""
    s = track_samples(spark, sf_dir).groupBy(*KEY).agg(F.count("*").alias("n"), F.sum("mouth").alias("activity"), F.sum("cx").alias("sx"))
    clip = Window.partitionBy("clip_id")
    top = s.withColumn("r", F.row_number().over(clip.orderBy(F.desc("n"), "tid"))).filter("r <= 4 and n >= 5")
    two = top.withColumn("a", F.row_number().over(clip.orderBy(F.desc("activity"), "tid"))).filter("a <= 2")
    return two.select("clip_id", "tid", "n", "activity", F.row_number().over(clip.orderBy(F.col("sx") / F.col("n"), "tid")).cast("long").alias("place"))


STATES_SQL = f"""{TRACKS_SQL}, st AS (SELECT clip_id, tid, idx, CASE WHEN mouth > 6000 THEN 'split' WHEN mouth > 2500 THEN 'single' ELSE 'none' END AS mode FROM tracks),
flag AS (SELECT *, CASE WHEN lag(mode) OVER w IS DISTINCT FROM mode THEN 1 ELSE 0 END AS new FROM st WINDOW w AS (PARTITION BY clip_id, tid ORDER BY idx)),
num AS (SELECT *, sum(new) OVER (PARTITION BY clip_id, tid ORDER BY idx) AS run FROM flag),
runs_ AS (SELECT clip_id, tid, any_value(mode) AS mode, min(idx) AS first, max(idx) + 1 AS "end" FROM num GROUP BY clip_id, tid, run)"""


def _states(spark: SparkSession, sf_dir: str) -> DataFrame:
    mode = F.when(F.col("mouth") > 6000, "split").when(F.col("mouth") > 2500, "single").otherwise("none")
    return S.runs(track_samples(spark, sf_dir).withColumn("mode", mode), KEY, "idx", "mode")


@query(f"""WITH {STATES_SQL} SELECT clip_id, tid, mode, first, "end" FROM runs_""")
def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _states(spark, sf_dir)


@query(f"""WITH {STATES_SQL} SELECT clip_id, tid, first, "end" FROM runs_ WHERE mode = 'none' AND "end" - first >= 4""")
def long_absence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.long_runs(_states(spark, sf_dir), "mode", F.lit("none"), 4).select("clip_id", "tid", "first", "end")


@query(f"""WITH {STATES_SQL},
k AS (SELECT *, row_number() OVER (PARTITION BY tid ORDER BY first) AS n, max("end") OVER (PARTITION BY tid) AS fin FROM runs_),
l AS (SELECT * FROM k WHERE n = 1 OR "end" - first >= CASE WHEN mode = 'split' THEN 2 ELSE 3 END),
f AS (SELECT *, CASE WHEN lag(mode) OVER (PARTITION BY tid ORDER BY first) IS DISTINCT FROM mode THEN 1 ELSE 0 END AS new FROM l),
g AS (SELECT *, sum(new) OVER (PARTITION BY tid ORDER BY first) AS run FROM f),
m AS (SELECT clip_id, tid, any_value(mode) AS mode, min(first) AS first, max(fin) AS fin FROM g GROUP BY clip_id, tid, run)
SELECT clip_id, tid, mode, first, coalesce(lead(first) OVER (PARTITION BY tid ORDER BY first), fin) AS "end" FROM m""")
def min_duration_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.absorb_short_runs(_states(spark, sf_dir), KEY, "mode", F.when(F.col("mode") == "split", 2).otherwise(3))


@query(f"""WITH {STATES_SQL}, shown AS (SELECT * FROM runs_ WHERE mode <> 'none')
SELECT t.clip_id, t.tid, t.idx, coalesce(s.mode, 'single') AS mode FROM tracks t LEFT JOIN shown s ON t.tid = s.tid AND t.idx >= s.first AND t.idx < s."end" """)
def state_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    states = _states(spark, sf_dir).filter("mode != 'none'")
    spine = track_samples(spark, sf_dir).select("clip_id", "tid", "idx")
    return S.expand_states(states, spine, KEY, "idx", "mode", F.lit("single"))


@query(f"""WITH {TRACKS_SQL} SELECT clip_id, idx, bool_or(mouth > 2500) AS any_visible FROM tracks GROUP BY clip_id, idx""")
def any_visible(spark: SparkSession, sf_dir: str) -> DataFrame:
    return track_samples(spark, sf_dir).groupBy("clip_id", "idx").agg(F.bool_or(F.col("mouth") > 2500).alias("any_visible"))


@query(f"""WITH {STATES_SQL}, ends AS (SELECT clip_id, tid, max(idx) AS hi FROM tracks GROUP BY clip_id, tid),
e AS (SELECT clip_id, tid, unnest(range(0, 5)) * hi // 4 AS idx FROM ends),
m AS (SELECT clip_id, tid, (first + "end") // 2 AS idx FROM runs_ WHERE mode = 'split')
SELECT DISTINCT clip_id, tid, idx FROM (SELECT * FROM e UNION ALL SELECT * FROM m)""")
def sample_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five even positions of each track, and the middles of its split runs."""
    hi = track_samples(spark, sf_dir).groupBy(*KEY).agg(F.max("idx").alias("hi"))
    even = hi.select(*KEY, F.expr("explode(transform(sequence(0, 4), k -> k * hi div 4))").alias("idx"))
    middle = _states(spark, sf_dir).filter("mode = 'split'").select(*KEY, F.expr("(first + end) div 2").alias("idx"))
    return even.unionByName(middle).distinct()


@query(f"""WITH RECURSIVE {TRACKS_SQL}, r AS (SELECT tid, idx, least(10000, idx * idx * 3 + mouth % 90) AS frac FROM tracks),
f AS (SELECT tid, -1::BIGINT AS idx, 0::BIGINT AS frac FROM tracks GROUP BY tid
  UNION ALL SELECT f.tid, n.idx, n.frac FROM f, LATERAL (SELECT r.idx, r.frac FROM r WHERE r.tid = f.tid AND r.idx > f.idx AND r.frac - f.frac >= 100 ORDER BY r.idx LIMIT 1) n)
SELECT tid, idx, frac FROM f WHERE idx >= 0""")
def progress_throttle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports of progress (ten-thousandths) that advance by a hundredth or more."""
    r = track_samples(spark, sf_dir).select("tid", "idx", F.least(F.lit(10000), F.col("idx") * F.col("idx") * 3 + F.col("mouth") % 90).cast("long").alias("frac"))
    return S.throttled(r, ["tid"], ["idx"], "frac", 100)


@query(f"""WITH {TRACKS_SQL}, b AS (SELECT tid, idx, mouth // 1000 AS snapshot, lag(mouth // 1000) OVER (PARTITION BY tid ORDER BY idx) AS before FROM tracks)
SELECT tid, idx, snapshot FROM b WHERE before IS DISTINCT FROM snapshot""")
def change_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = track_samples(spark, sf_dir).select("tid", "idx", F.expr("mouth div 1000").alias("snapshot"))
    return S.changes_only(t, ["tid"], ["idx"], "snapshot")


@query("""SELECT user_id, max(epoch_us(ts) // 1000)::BIGINT AS last_ms, max(epoch_us(ts) // 1000) < epoch_ms(TIMESTAMP '2024-01-31 00:00:00') - 900000 * 96 AS idle FROM events GROUP BY user_id""")
def inactivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys without an event for a day (96 times 900 s) before a fixed now."""
    from momentloom.sources.tables import table

    ms = F.expr("timestampdiff(MILLISECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', ts)")
    now = F.expr("timestampdiff(MILLISECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', TIMESTAMP_NTZ '2024-01-31 00:00:00')")
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.max(ms).alias("last_ms")).withColumn("idle", F.col("last_ms") < now - 900000 * 96)
