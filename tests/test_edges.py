"""Nulls, repeated rows, empty tables and columns whose names operators use themselves."""

import pytest
from pyspark.sql import functions as F

from momentloom.operators import captions, geometry, registry, scoring, segments

CLASH = "_x string, _n int, _p int, _s int, _v int, _r int, _k int, _row string, _all int, _next int"


def with_clashes(df):
    for field in CLASH.split(", "):
        name, kind = field.split()
        if name not in df.columns:
            df = df.withColumn(name, F.lit("7").cast(kind))
    return df


def test_jobs_with_nulls_and_empty_tables(spark):
    rows = [(1, "rendering", 0), (1, "rendering", 0), (2, "rendering", None), (3, None, 0), (None, "done", 0), (4, "awaiting_approval", 0)]
    jobs = with_clashes(spark.createDataFrame(rows, "job_id long, state string, active_s long"))
    shown = sorted(((r.job_id, r.shown) for r in registry.stale(jobs, F.lit(5000)).collect()), key=str)
    assert shown == sorted([(1, "error"), (1, "error"), (2, "rendering"), (3, "error"), (None, "done"), (4, "awaiting_approval")], key=str)
    live = spark.createDataFrame([(None, "rendering"), (3, "rendering")], "job_id long, state string")
    found = sorted(((r.job_id, r.deletable) for r in registry.deletable(jobs, live, F.lit(5000)).collect()), key=str)
    assert found == sorted([(1, True), (1, True), (2, False), (3, False), (None, True), (4, False)], key=str)
    none = jobs.filter("false")
    assert registry.stale(none, F.lit(0)).count() == registry.deletable(none, live, F.lit(0)).count() == 0
    folders = spark.createDataFrame([("a", 1, 10), ("a", None, 10), ("b", 99, 10)], "volume string, newest_s long, bytes long")
    assert [r.newest_s for r in registry.expired(folders, F.lit(86_450), 1).collect()] == [1] and registry.expired(folders, F.lit(10**9), 0).count() == 0
    reclaimed = registry.reclaim(with_clashes(spark.createDataFrame([(None, 1, 1, None), (None, 2, 2, 8), (None, 3, 3, 8)], "volume string, newest_s long, job_id long, bytes long")), ["volume"], F.lit(5))
    assert sorted(r.job_id for r in reclaimed.collect()) == [1, 2]


def test_texts_of_settings_and_names(spark):
    df = spark.createDataFrame([(None,), ("",), (" 7 ",), ("x",)], "t string")
    got = [tuple(r) for r in df.select(registry.setting(F.col("t"), "int", 5), registry.cpu_quota(F.col("t")), registry.slug(F.col("t")), registry.frame_rate(F.col("t"))).collect()]
    assert got == [(5, None, None, 30.0), (5, None, "video", 30.0), (7, None, "7", 30.0), (5, None, "x", 30.0)]


def test_boxes_with_nulls(spark):
    df = spark.createDataFrame([(0.0, 0.0, 2.0, 2.0), (None, 0.0, 2.0, 2.0), (0.0, 0.0, 0.0, 0.0)], "x double, y double, w double, h double")
    own, other = {c: F.col(c) for c in "xywh"}, {c: F.lit(v) for c, v in zip("xywh", (1.0, 0.0, 2.0, 2.0), strict=True)}
    assert [round(r[0], 6) for r in df.select(geometry.rect_iou(own, other)).collect()] == [round(1 / 3, 6), 0.0, 0.0]
    rect = geometry.crop_rect(F.col("x"), F.col("y"), geometry.crop_height(F.col("h"), 1080), 1920, 1080, 0.5)
    assert [r[0] is None for r in df.select(rect["x"]).collect()] == [False, True, False]
    faces = with_clashes(spark.createDataFrame([(1, 0, 10, 10, 4), (1, 1, 11, 10, 4), (1, 2, None, 10, 4), (None, 0, 1, 1, 1), (None, 0, 1, 1, 1)], "f long, n long, cx long, cy long, w long"))
    kept = geometry.first_of_same_faces(faces, ["f"], "n")
    assert sorted((str(r.f), r.n) for r in kept.collect()) == [("1", 0), ("1", 2), ("None", 0)] and kept.columns == faces.columns
    tracks = spark.createDataFrame([(None, 1, 0.5, 0.5, 0.01)] * 25 + [(2, 1, 0.5, None, 0.01)], "clip long, tid long, cx double, cy double, w double")
    assert geometry.moving_tracks(tracks, ["clip"], "tid").count() == 2 and geometry.moving_tracks(tracks.filter("false"), ["clip"], "tid").count() == 0
    pairs = spark.createDataFrame([(None, 1.0, 2.0), (None, 2.0, 4.0), (1, 3.0, None), (2, 1.0, 1.0)], "k long, a double, b double")
    assert {r.k: r.ncc and round(r.ncc, 6) for r in geometry.correlation(pairs, ["k"], "a", "b").collect()} == {None: 1.0, 1: 0.0, 2: 0.0}
    assert geometry.landmark_box(pairs.select("k", F.col("a").alias("x"), F.col("b").alias("y")).filter("false"), ["k"]).count() == 0


def test_documents_with_nulls_and_clashing_columns(spark):
    text = " ".join(f"word{k} goes on and on here." for k in range(60))
    docs = with_clashes(spark.createDataFrame([(1, text, 3), (None, text, 3), (2, None, 3), (3, "", 3)], "doc_id long, text string, segs int").drop("segs"))
    arrays = segments.with_target(segments.segment_arrays(docs))
    assert {r.doc_id: r.target for r in arrays.filter("doc_id is not null").select("doc_id", "target").collect()} == {1: 4, 2: None, 3: None}
    windows = segments.candidate_windows(arrays, ("target",))
    assert {r.doc_id for r in windows.collect()} == {1, None} and windows.columns[:2] == ["doc_id", "target"]
    scored = scoring.weighted_score(scoring.lexical_features(windows), F.lit(0.3))
    assert segments.ranked(segments.drop_weak_tail(segments.suppress_overlaps(scored.select("doc_id", "j0", "start_ms", "end_ms", "score")))).filter("rank = 1").count() == 2
    for f in (segments.timed_words, segments.timed_segments):
        assert f(docs.filter("false")).count() == 0


@pytest.mark.parametrize("null_key", [False, True])
def test_captions_of_clips_with_nulls(spark, null_key):
    docs = with_clashes(spark.createDataFrame([(1, "One two. Three four five.", 0), (2, None, 0), (None, "x y", 0)], "doc_id long, text string, clips int").drop("clips"))
    clips = spark.createDataFrame([(1, 1, 0, 5000), (2, 1, 0, 5000), (None, 1, 0, 5000), (9, 1, 0, 5000)], "doc_id long, clip long, t0 long, t1 long")
    words = captions.clip_words(docs, clips)
    assert {r.doc_id for r in words.collect()} == {1}
    words = words.withColumn("doc_id", F.when(F.lit(null_key), F.lit(None).cast("long")).otherwise(F.col("doc_id")))
    lines = captions.caption_lines(words)
    assert lines.count() == 5 and lines.columns == ["doc_id", "clip", "i", "w", "s_ms", "e_ms", "line", "text"]
    events = captions.caption_events(lines)
    assert events.count() == 5 and captions.overlap_flags(events, ["doc_id", "clip"]).count() == 0
    for f in (captions.caption_lines, lambda w: captions.caption_events(captions.caption_lines(w))):
        assert f(words.filter("false")).count() == 0


def test_batches_and_prompts_edges(spark):
    df = with_clashes(spark.createDataFrame([(1, k, k * 1000, k * 1000 + 75_500, "t") for k in range(11)] + [(None, 0, 0, 500, None)], "doc_id long, j0 long, start_ms long, end_ms long, text string"))
    batched = scoring.batches_of(df, ["doc_id"], ["j0"])
    assert batched.filter("batch = 1").count() == 1 and scoring.batches_of(df.filter("false"), ["doc_id"], ["j0"]).count() == 0
    got = {(r.doc_id, r.batch): r.prompt for r in scoring.prompts(batched, ["doc_id"], "j0").collect()}
    assert got[1, 1] == "## 10 (76 s)\nt" and len(got) == 3
    assert scoring.top_slice(df.withColumn("score", F.lit(1.0)).drop("_r"), ["doc_id"], "score", ["j0"], F.lit(3)).count() == 4
