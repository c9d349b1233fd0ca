"""Invariants and scenarios, each with a control that must come out the other way."""

import random

import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from momentloom.operators import captions, folds, names, registry, segments, series


def test_windows_are_within_bounds_and_kept_ones_apart(spark):
    rows = [(1, j, j * 10_000, j * 10_000 + 9_500, 5, "a b c d e.") for j in range(60)]
    s = spark.createDataFrame(rows, "doc_id long, j long, start_ms long, end_ms long, n_words long, text string")
    w = segments.candidate_windows(segments.gathered(s)).collect()
    assert w and all(75_000 <= r.end_ms - r.start_ms <= 100_000 for r in w)
    kept = segments.suppress_overlaps(segments.candidate_windows(segments.gathered(s)).withColumn("score", F.lit(50.0))).collect()
    assert 1 < len(kept) < len(w)
    for a in kept:
        for b in kept:
            if a.j0 < b.j0:
                common = max(0, min(a.end_ms, b.end_ms) - max(a.start_ms, b.start_ms))
                assert 10 * common <= 3 * (a.end_ms - a.start_ms + b.end_ms - b.start_ms - common)


def test_fallback_window_without_natural_end(spark):
    rows = [(1, j, j * 10_000, j * 10_000 + 9_900, 2, "no stop") for j in range(12)]
    s = spark.createDataFrame(rows, "doc_id long, j long, start_ms long, end_ms long, n_words long, text string")
    first = segments.candidate_windows(segments.gathered(s)).orderBy("j0").first()
    assert (first.j0, first.j1, first.natural) == (0, 9, False)


def test_target_counts(spark):
    df = spark.createDataFrame([(m * 60_000,) for m in (1, 30, 70, 120, 600)], "d long")
    assert [r[0] for r in df.select(segments.target_count(F.col("d"))).collect()] == [4, 12, 28, 48, 60]


def test_weak_tail_is_kept_where_little_else_is(spark):
    rows = [(1, k, s) for k, s in enumerate([80.0, 70.0, 60.0, 50.0, 20.0])] + [(2, k, s) for k, s in enumerate([80.0, 20.0, 10.0])]
    got = segments.drop_weak_tail(spark.createDataFrame(rows, "doc_id long, j0 long, score double")).groupBy("doc_id").count().collect()
    assert dict(got) == {1: 4, 2: 3}


def test_no_two_caption_slots_overlap(spark):
    rows = [(1, 1, i, "W", max(0, i * 300 - (200 if i % 4 == 3 else 0)), i * 300 + 250, i // 4, "W") for i in range(24)]
    e = captions.caption_events(spark.createDataFrame(rows, "doc_id long, clip long, i long, w string, s_ms long, e_ms long, line long, text string")).orderBy("start_ms").collect()
    assert e and all(a.end_ms <= b.start_ms for a, b in zip(e, e[1:], strict=False))
    assert captions.overlap_flags(spark.createDataFrame([(1, 0, 500), (1, 400, 900)], "k long, start_ms long, end_ms long"), ["k"]).count() == 1


def test_asof_ties_go_to_the_earlier_sample(spark):
    spine = spark.createDataFrame([(1, 50, "x"), (1, 51, "y"), (1, 500, "z"), (2, 5, "n")], "k long, t long, name string")
    samples = spark.createDataFrame([(1, 0, 10), (1, 100, 20)], "k long, t long, v long")
    got = {r.name: r.v for r in series.asof_nearest(spine, samples, ["k"], "t", "v").collect()}
    assert got == {"x": 10, "y": 20, "z": 20, "n": None}


def test_gap_is_bridged_or_held(spark):
    spine = spark.createDataFrame([(1, t) for t in (500, 3000)], "k long, t long")
    samples = spark.createDataFrame([(1, 0, 0.0), (1, 1000, 1.0), (1, 6000, 9.0)], "k long, t long, v double")
    got = {r.t: r.value for r in series.interpolate_hold(series.bracket(spine, samples, ["k"], "t", "v"), "t", 1000).collect()}
    assert got == {500: 0.5, 3000: 1.0}


def test_short_runs_are_absorbed_as_a_plain_fold_does(spark):
    rng = random.Random(3)
    rows, want = [], {}
    for k in range(20):
        states = [rng.choice("ab") for _ in range(60)]
        rows += [(k, i, s) for i, s in enumerate(states)]
        merged: list[list] = []
        i = 0
        while i < 60:
            e = i
            while e < 60 and states[e] == states[i]:
                e += 1
            if merged and (e - i < 2 or merged[-1][2] == states[i]):
                merged[-1][1] = e
            else:
                merged.append([i, e, states[i]])
            i = e
        want[k] = [tuple(m) for m in merged]
    df = series.absorb_short_runs(series.runs(spark.createDataFrame(rows, "k long, i long, s string"), ["k"], "i", "s"), ["k"], "s", F.lit(2))
    got: dict = {k: [] for k in want}
    for r in df.orderBy("k", "first").collect():
        got[r.k].append((r.first, r.end, r.s))
    assert got == want


def fed(fold, rows, size=None):
    """What a fold gives for rows (a pandas frame in order), fed in batches of size."""
    t = pa.Table.from_pandas(rows, preserve_index=False).combine_chunks()
    out = [fold.feed(b) for b in t.to_batches(max_chunksize=size or max(1, t.num_rows))]
    return pd.concat([x.to_pandas() for x in [*out, fold.end()] if x is not None], ignore_index=True)


def test_fragments_join_and_a_far_one_does_not(spark):
    rows = [(1, t * 200, k, x, 0.5, 0.1, tid) for tid, x, start in ((0, 0.50, 0), (1, 0.52, 19), (2, 0.90, 19)) for k, t in enumerate(range(start, start + 10))]
    df = spark.createDataFrame(rows + [(None, *r[1:]) for r in rows], "_a long, t_ms long, det long, cx double, cy double, w double, tid long").withColumn("host", F.lit("x"))
    out = folds.merge_fragments(df.withColumnRenamed("_a", "clip"), ["clip"]).groupBy("clip", "tid").count().collect()
    assert sorted((r.clip is None, r["count"]) for r in out) == [(False, 10), (False, 20), (True, 10), (True, 20)]


def frames_of(rows):
    """rows (frame, tid, activity, visible, cx, cy, w, h) as the states' fold gets them: a row a frame, and the pair of most activity."""
    df = pd.DataFrame(rows, columns=["frame", "tid", "activity", "visible", "cx", "cy", "w", "h"]).drop_duplicates(["frame", "tid"])
    total, left = df.groupby("tid")["activity"].sum(), df.groupby("tid")["cx"].mean()
    pair = sorted(total.index, key=lambda t: (-total[t], t))[:2]
    shown = sorted(pair, key=lambda t: left[t])
    faces = df.sort_values(["frame", "tid"]).groupby("frame")[["tid", "activity", "visible", "cx", "cy", "w", "h"]].apply(lambda g: g.to_dict("records"))
    return pd.DataFrame({"frame": faces.index, "faces": faces.tolist(), "pair": [pair] * len(faces), "shown": [shown] * len(faces)})


def states_of(n, tracks, visible=None, size=None):
    """tracks: tid -> (activity by frame, (cx, cy, w, h)); visible: tid -> by frame."""
    rows = [(f, t, act(f), visible is None or visible[t](f), *box) for t, (act, box) in tracks.items() for f in range(n)]
    runs = fed(folds.States(), frames_of(rows), size)
    return runs, lambda f: next((r.mode, list(r.tids)) for r in runs.itertuples() if r.f0 <= f < r.f1)


def test_dialogue_splits_then_rests_on_one():
    left, right, middle = (0.20, 0.40, 0.12, 0.22), (0.80, 0.40, 0.12, 0.22), (0.50, 0.40, 0.12, 0.22)
    turn = lambda k: lambda f: 0.05 if f < 180 and (f // 45) % 2 == k or f >= 180 and k == 0 else 0.0
    _, at = states_of(360, {0: (turn(0), left), 1: (turn(1), right)})
    assert at(90) == ("split", [0, 1]) and at(270) == ("single", [0])
    _, at = states_of(360, {0: (lambda f: 0.05 * (f < 60), left), 1: (lambda f: 0.04 * (f < 60), right), 2: (lambda f: 0.06 * (f >= 120), middle)})
    assert at(240) == ("single", [2])


def test_same_place_and_like_crops_never_split():
    for one, two, far in (((0.5, 0.4, 0.14, 0.28), 0.56, 0.85), ((0.38, 0.4, 0.10, 0.30), 0.515, 0.85)):
        both = lambda x: {0: (lambda f: 0.05, one), 1: (lambda f: 0.045, (x, *one[1:]))}  # noqa: E731, B023
        runs, _ = states_of(300, both(two))
        assert set(runs["mode"]) == {"single"} and len(runs) <= 2
        assert "split" in set(states_of(300, both(far))[0]["mode"])
    assert folds.crops_shared((0.38, 0.4, 0.10, 0.30), (0.515, 0.4, 0.10, 0.30), 1920, 1080) > 0.5


def test_absences():
    face = (0.7, 0.4, 0.12, 0.22)
    _, at = states_of(450, {0: (lambda f: 0.05, face)}, {0: lambda f: not (90 <= f < 114 or 240 <= f < 360)})
    assert at(102) == ("single", [0]) and at(300) == ("single", []) and at(390) == ("single", [0])
    gone = lambda f: 150 <= f < 450
    pair = {0: (lambda f: 0.05 * (not gone(f)), (0.30, 0.4, 0.12, 0.22)), 1: (lambda f: 0.04 * (not gone(f)), (0.75, 0.4, 0.12, 0.22))}
    seen = {0: lambda f: not gone(f), 1: lambda f: not gone(f)}
    _, at = states_of(600, pair, seen)
    assert at(300)[1] == [] and at(60)[1] != [] and at(540)[1] != []
    _, at = states_of(600, pair | {2: (lambda f: 0.03 * gone(f), (0.50, 0.4, 0.06, 0.11))}, seen | {2: gone})
    assert at(300) == ("single", [2])


def path_of(frames, src_w=1280.0, src_h=720.0):
    """frames: (cut, mode, [(tid, cx, cy, w, h, visible)], coarse) in order."""
    box = lambda b: dict(zip(("tid", "cx", "cy", "w", "h", "visible"), b, strict=True))
    rows = [(f, cut, mode, [box(b) for b in boxes], coarse) for f, (cut, mode, boxes, coarse) in enumerate(frames)]
    path = fed(folds.Camera(src_w, src_h), pd.DataFrame(rows, columns=["frame", "cut", "mode", "boxes", "coarse"]), 97)
    assert ((path["x"] >= -1e-6) & (path["x"] + path["w"] <= src_w + 1e-5) & (path["y"] >= -1e-6) & (path["y"] + path["h"] <= src_h + 1e-5)).all()
    return path, (path["x"] + path["w"] / 2).tolist()


def test_camera_eases_out_when_the_face_is_lost():
    face = [(0, 0.75, 0.4, 0.12, 0.22, True)]
    _, centre = path_of([(False, "single", face if f < 150 or f >= 330 else [], []) for f in range(450)])
    assert all(abs(b - a) <= 0.03 * 1280 + 1e-3 for a, b in zip(centre[149:329], centre[150:330], strict=True))
    assert abs(centre[315] - 640) < 128 and abs(centre[331] - 960) < 60


def test_camera_takes_a_coarse_face_for_a_stale_track():
    stale, coarse = lambda seen: [(0, 0.25, 0.40, 0.05, 0.10, seen)], [(0.75, 0.40, 0.18, 0.32)]
    _, centre = path_of([(False, "single", stale(False), coarse)] * 90)
    assert centre[0] > 0.65 * 1280
    _, centre = path_of([(f == 30, "single", stale(True), coarse) for f in range(90)])
    assert centre[29] < 0.35 * 1280 and centre[30] > 0.65 * 1280
    _, centre = path_of([(f == 30, "single", stale(True), coarse + [(0.5, 0.4, 0.1, 0.1)]) for f in range(90)])
    assert centre[30] < 0.35 * 1280
    _, centre = path_of([(False, "single", [], coarse)] * 3)
    assert centre[0] > 0.65 * 1280


def test_camera_splits_snaps_and_drifts():
    two = [(0, 0.2, 0.4, 0.1, 0.2, True), (1, 0.8, 0.4, 0.1, 0.2, True)]
    path, _ = path_of([(False, "split", two, [])] * 10 + [(False, "single", two[:1], [])] * 700)
    assert path["slot"].tolist() == [0, 1] * 10 + [0] * 700
    assert ((path["w"] / path["h"] - 1.125).abs() < 1e-6)[:20].all() and ((path["w"] / path["h"] - 0.5625).abs() < 1e-6)[20:].all()
    h = path["h"].tolist()[20:]
    assert h[0] < h[14] and abs(h[15] - h[170]) < 1e-6 and abs(h[650] / h[170] - 0.95) < 1e-6  # punch-in wears off, then drift
    assert abs(path["h"][18] / path["h"][0] - 1.035 / (1 + 0.035 * (1 - 9 / 15))) < 1e-6


def test_registry_texts(spark):
    df = spark.createDataFrame([("600000 100000",), ("150000 100000",), ("max 100000",), ("invalid",)], "q string")
    assert [r[0] for r in df.select(registry.cpu_quota(F.col("q"))).collect()] == [6, 2, None, None]
    df = spark.createDataFrame([("Été à la_mer!",), ("!!!",)], "t string")
    assert [r[0] for r in df.select(registry.slug(F.col("t"))).collect()] == ["été-à-la-mer", "video"]


def test_tracker_keeps_two_faces_apart():
    rows = [(t * 100, 2 * t + k, 0.3 + 0.4 * k + 0.01 * t, 0.5, 0.1, None) for t in range(10) for k in (0, 1)]
    out = fed(folds.Tracks(), pd.DataFrame(rows, columns=["t_ms", "det", "cx", "cy", "w", "openness"]).sort_values(["t_ms", "det"]))
    assert out["tid"].nunique() == 2 and all(out["tid"] == out["det"] % 2)


def test_streams_equal_their_batch_twins(spark, tmp_path):
    from momentloom.streaming import progress

    rows = [(k, i, i * i * (k + 1)) for k in range(3) for i in range(12)]
    df = spark.createDataFrame(rows, "tid long, idx long, frac long")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    for name, made, want in (
        ("throttle", progress.throttle_stream(stream, "tid", "idx", "frac", 20), series.throttled(df, ["tid"], ["idx"], "frac", 20)),
        ("change", progress.change_stream(stream, "tid", "idx", "frac"), series.changes_only(df, ["tid"], ["idx"], "frac")),
    ):
        made.writeStream.format("parquet").option("path", str(tmp_path / name)).option("checkpointLocation", str(tmp_path / f"{name}_c")).trigger(availableNow=True).start().awaitTermination()
        got = spark.read.parquet(str(tmp_path / name))
        assert sorted(map(tuple, got.select("tid", "idx", "frac").collect())) == sorted(map(tuple, want.select("tid", "idx", "frac").collect()))


def test_sound_is_read_and_cut(spark, tmp_path):
    import struct

    from momentloom.sources.documents import read_json_documents
    from momentloom.sources.sound import read_pcm

    v = list(range(-50, 50))
    data = struct.pack(f"<{len(v)}h", *v)
    (tmp_path / "a.wav").write_bytes(b"RIFF" + struct.pack("<I", 36 + len(data)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, 16000, 32000, 2, 16) + b"data" + struct.pack("<I", len(data)) + data)
    got = read_pcm(spark, str(tmp_path / "a.wav"), 10, 20).orderBy("idx").collect()
    assert [(r.idx, r.v) for r in got] == [(k, v[k]) for k in range(10, 20)]
    (tmp_path / "good.json").write_text('{"id": 1}')
    (tmp_path / "bad.json").write_text('{"id": ')
    rows = read_json_documents(spark, str(tmp_path / "*.json"), "id long").collect()
    assert sorted((r.id is None, r._corrupt_record is None) for r in rows) == [(False, True), (True, False)]


def test_scorers_by_name_fall_back(spark):
    import pandas as pd

    from momentloom.operators import scoring

    windows = spark.createDataFrame([(1, 0, "a"), (1, 3, "bb"), (2, 0, "ccc")], "doc_id long, j0 long, text string")
    local = windows.select("doc_id", "j0", F.lit(7.0).alias("score"))

    class Length(scoring.Scorer):
        def score(self, frame):
            return pd.DataFrame({"doc_id": frame["doc_id"], "j0": frame["j0"], "score": frame["text"].str.len() * 60.0})[frame["doc_id"] == 1]

    class Broken(scoring.Scorer):
        def score(self, frame):
            raise RuntimeError("no answer")

    def absent():
        raise ValueError("no key")

    for name, make in (("length", Length), ("broken", Broken), ("absent", absent)):
        scoring.register_scorer(name, make)
    got = lambda name: sorted((r.doc_id, r.j0, r.score, r.provider) for r in scoring.scored_by(name, windows, local).collect())
    assert got("length") == [(1, 0, 60.0, "length"), (1, 3, 100.0, "length"), (2, 0, 7.0, "local")]
    for name in ("broken", "absent", "unknown"):
        assert got(name) == [(1, 0, 7.0, "local"), (1, 3, 7.0, "local"), (2, 0, 7.0, "local")]


def test_names_stay_free(spark):
    rows = [(0, "v", "a"), (1, "v", "a"), (2, "v", "a_2"), (3, "v", "a"), (4, "w", "a"), (5, "v", "b_2_3"), (6, "v", "a_2")]
    df = spark.createDataFrame(rows, "k long, folder string, stem string")
    got = {r.k: r.name for r in names.unique_names(df, ["folder"], "stem", ["k"], ".mp4").collect()}
    assert got == {0: "a.mp4", 1: "a_2.mp4", 2: "a_2_2.mp4", 3: "a_3.mp4", 4: "a.mp4", 5: "b_2_3.mp4", 6: "a_2_3.mp4"}


def test_error_texts_and_quotas(spark):
    rows = [("\x1b[0;31mERROR:\x1b[0m <urlopen error [WinError 10013] forbidden by its access permissions>", "DownloadError", "no network permission"), ("CUDA failed: out of memory", "RuntimeError", "out of memory"), ("x", "MemoryError", "out of memory"), (" odd ", "KeyError", "KeyError: odd"), ("odd", None, "odd"), ("No space left on device", "OSError", "disk full | OSError: No space left on device"), (None, None, "")]
    df = spark.createDataFrame([r[:2] for r in rows], "m string, k string")
    assert [r[0] for r in df.select(registry.error_class(F.col("m"), F.col("k"))).collect()] == [r[2] for r in rows]
    df = spark.createDataFrame([(x,) for x in ("0 100000", "-5 100", "100 0", "max 1", "", None, "7")], "q string")
    assert [r[0] for r in df.select(registry.cpu_quota(F.col("q"))).collect()] == [1, 1, None, None, None, None, None]


def test_lines_break_behind_quoted_stops(spark):
    words = [("one", 0), ('two."', 300), ("three", 600), ("four", 900)]
    df = spark.createDataFrame([(1, 1, i, w, s, s + 250) for i, (w, s) in enumerate(words)], "doc_id long, clip long, i long, w string, s_ms long, e_ms long")
    got = captions.caption_lines(df).orderBy("i").collect()
    assert [r.line for r in got] == [0, 0, 1, 1] and got[0].text == captions.MARKED + "one " + captions.PLAIN + 'two."'


def test_running_sums_and_seeds_of_long_documents(spark):
    text = " ".join(f"w{k} and more words." for k in range(3000))
    df = spark.createDataFrame([(1, text), (1, text), (None, "a. b. c."), (2, None), (3, "")], "doc_id long, text string")
    rows = segments.timed_segments(df).filter("doc_id = 1").orderBy("j").collect()
    assert len(rows) == 6000 and all(a.start_ms == b.start_ms == (a.j * 4) * 350 + a.j * 100 + a.j // 2 * 500 for a, b in zip(rows[::2], rows[1::2], strict=True))
    assert segments.timed_segments(df).filter("doc_id is null").count() == 3
    assert segments.candidate_windows(segments.segment_arrays(df)).filter("doc_id = 1").count() > 100


def test_titles_of_any_script(spark):
    from momentloom.operators.scoring import title_of

    df = spark.createDataFrame([("«Привет, МИР!» Да.",), ("7 ways 9!",), ("...",), ("",), (" ".join("abcdefghijk"),)], "t string")
    assert [r[0] for r in df.select(title_of(F.col("t"))).collect()] == ["Привет, мир!» да", "7 ways 9", "Untitled moment", "Untitled moment", "A b c d e f g h i…"]


def test_subtitle_files_are_written(spark, tmp_path):
    lines = spark.createDataFrame([(1, 1, 0, "Dialogue: 0,0:00:00.00,0:00:01.00,Cap,,0,0,0,,A"), (1, 1, 1, "Dialogue: 0,0:00:01.00,0:00:02.00,Cap,,0,0,0,,B")], "doc_id long, clip long, i long, line string")
    captions.write_subtitles(lines, str(tmp_path / "out"))
    (path,) = (tmp_path / "out").glob("doc_id=1/clip=1/*.txt")
    text = path.read_text(encoding="utf-8-sig")
    assert text.startswith("[Script Info]") and [x[-1] for x in text.splitlines() if x.startswith("Dialogue")] == ["A", "B"]


def test_energy_against_plain_quantiles(spark):
    import numpy as np

    from momentloom.operators import scoring

    rng = random.Random(12)
    bins, windows, want = [], [], {}
    for d in range(6):
        own = {b: rng.choice([0.0005, rng.random()]) for b in range(rng.randint(0, 5), 400) if rng.random() < 0.6} if d else {}
        bins += [(d, b, v) for b, v in own.items()]
        loud = [v for v in own.values() if v > 0.001]
        base = float(np.median(loud)) if loud else 0.01
        for j in range(5):
            start = rng.randint(0, 45_000)
            end = start + rng.randint(0, 9_000)
            inside = [v for b, v in own.items() if start // 100 <= b < end // 100]
            want[d, j] = min(1.0, max(0.0, (float(np.percentile(inside, 95)) / (base + 1e-9) - 1) / 3)) if inside else 0.3
            windows.append((d, j, start, end))
    w = spark.createDataFrame(windows, "doc_id long, j0 long, start_ms long, end_ms long")
    got = {(r.doc_id, r.j0): r.energy for r in scoring.window_energy(w, spark.createDataFrame(bins, "doc_id long, bin long, rms double")).collect()}
    assert got.keys() == want.keys() and [(k, got[k], want[k]) for k in want if abs(got[k] - want[k]) > 2e-6] == []
