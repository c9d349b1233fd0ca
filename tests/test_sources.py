"""Sound by ranges, folders at every depth."""

import os
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from momentloom.sources import documents, sound


def wav(path, v, rate=16_000, before=b"", claim=None, bits=16):
    data = np.asarray(v, "<i2").tobytes()
    head = b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, rate, rate * 2, 2, bits) + before
    path.write_bytes(b"RIFF" + struct.pack("<I", 4 + len(head) + 8 + len(data)) + head + b"data" + struct.pack("<I", len(data) if claim is None else claim) + data)


class Counting(sound.WavReader):
    """A reader that counts the bytes it takes."""

    taken = 0

    def open(self, path):
        file, own = open(path, "rb", buffering=0), self

        class Counted:
            def __enter__(self):
                return self

            def __exit__(self, *a):
                file.close()

            def seek(self, at):
                file.seek(at)

            def read(self, n):
                out = file.read(n)
                own.taken += len(out)
                return out

        return Counted()


def test_a_range_of_an_hour_reads_only_its_bytes(tmp_path):
    hour = tmp_path / "hour.wav"
    with hour.open("wb") as f:
        n = 3600 * 16_000
        f.write(b"RIFF" + struct.pack("<I", 36 + 2 * n) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, 16_000, 32_000, 2, 16) + b"data" + struct.pack("<I", 2 * n))
        f.seek(44 + 2 * 40_000_000)
        f.write(np.arange(1000, dtype="<i2").tobytes())
        f.truncate(44 + 2 * n)
    reader = Counting({"path": str(hour), "first": "39999990", "end": "40000700", "split": "500"})
    parts = reader.partitions()
    assert len(parts) == 2 and reader.taken < 100
    rows = [x for p in parts for b in reader.read(p) for x in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
    assert rows == [(k, max(0, k - 40_000_000)) for k in range(39_999_990, 40_000_700)]
    assert reader.taken < 100 + 2 * 710 + 1
    from pyspark.sql.datasource import GreaterThan, LessThanOrEqual

    narrowed = Counting({"path": str(hour)})
    assert len(narrowed.partitions()) == -(-3600 * 16_000 // sound.SPLIT)
    assert len(list(narrowed.pushFilters([GreaterThan(("idx",), 99), LessThanOrEqual(("idx",), 199)]))) == 2
    assert [(p.first, p.end) for p in narrowed.partitions()] == [(100, 200)]


def test_sound_in_spark(spark, tmp_path):
    rng = np.random.default_rng(1)
    a, b = rng.integers(-30_000, 30_000, 5000), rng.integers(-300, 300, 800)
    wav(tmp_path / "a.wav", a)
    wav(tmp_path / "b.wav", b, before=b"LIST" + struct.pack("<I", 3) + b"abc\0", claim=1 << 30)
    wav(tmp_path / "empty.wav", [])
    wav(tmp_path / "eight.wav", b, bits=8)
    (tmp_path / "odd.wav").write_bytes(b"no sound")
    (tmp_path / "none.wav").write_bytes(b"")
    (tmp_path / "deep").mkdir()
    wav(tmp_path / "deep" / "c.wav", b[:7])
    df = sound.read_pcm(spark, str(tmp_path), split=700)
    got = {k: [] for k in ("a.wav", "b.wav", "c.wav")}
    for r in df.collect():
        got[os.path.basename(r.path)].append((r.idx, r.v))
    assert {k: [v for _, v in sorted(x)] for k, x in got.items()} == {"a.wav": a.tolist(), "b.wav": b.tolist(), "c.wav": b[:7].tolist()}
    own = f"file://{tmp_path}/a.wav"
    some = sound.read_pcm(spark, own).filter("idx >= 1000 and idx < 1234")
    assert some.rdd.getNumPartitions() == 1 and sorted(r.v for r in some.collect()) == sorted(a[1000:1234].tolist())
    assert sound.read_pcm(spark, own, 4990, 9999).count() == 10 and sound.read_pcm(spark, own, 9000).count() == 0
    (tmp_path / "void").mkdir()
    assert sound.read_pcm(spark, str(tmp_path / "void")).count() == 0


def test_frame_rms_equals_numpy_at_hop_533(spark, tmp_path):
    v = np.random.default_rng(2).integers(-32_768, 32_767, 16_000 * 3)
    wav(tmp_path / "a.wav", v)
    t0, fps, hop = 0.25, 30, sound.frame_hop(16_000, 30)
    first = int(t0 * 16_000)
    x = v[first:].astype(np.float64) / 32768
    want = np.sqrt((x[: len(x) // hop * hop].reshape(-1, hop) ** 2).mean(1) + 1e-9)
    got = sorted(sound.frame_rms(sound.read_pcm(spark, str(tmp_path / "a.wav"), first), ["path"], hop, first).collect(), key=lambda r: r.frame)
    assert hop == 533 and [r.frame for r in got] == list(range(len(want))) and np.allclose([r.rms for r in got], want, rtol=1e-12)


def test_folders_count_all_below_and_the_newest_near(spark, tmp_path):
    for name, size, at in (("a/x", 5, 100), ("a/b/y", 7, 300), ("a/b/c/z", 11, 900), ("top", 1, 50), ("d/e/f/g/w", 13, 700)):
        p = tmp_path / "root" / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(b"." * size)
        os.utime(p, (at, at))
    root = f"file:{tmp_path}/root/"
    files = documents.folder_files(spark, str(tmp_path / "root"))
    got = {r.folder.removeprefix(root): (r.bytes, r.files, r.newest and int(r.newest.timestamp())) for r in documents.folder_sizes(files, root).collect()}
    plain = {}
    for folder, _, _ in os.walk(tmp_path / "root"):
        own = [(os.path.join(d, f), d) for d, _, fs in os.walk(folder) for f in fs]
        near = [os.stat(f).st_mtime for f, d in own if d == folder or os.path.dirname(d) == folder]
        plain[os.path.relpath(folder, tmp_path / "root").replace(".", "", 1)] = (sum(os.path.getsize(f) for f, _ in own), len(own), int(max(near)) if near else None)
    assert got == plain


@pytest.mark.parametrize("rows", [[], [(None, 5, 1), ("w/a", None, None), ("w/a", 3, 2), ("w/a", 3, 2), ("other/b", 9, 9)]])
def test_folder_edges(spark, rows):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "path string, bytes long, changed long, folder int, names string")
    got = [tuple(r) for r in documents.folder_sizes(df, "w/").collect()]
    assert got == ([("w/", 6, 3, 2)] if rows else [])


def test_frame_rms_edges(spark):
    df = spark.createDataFrame([(1, 0, 100, "x"), (1, 1, None, "x"), (1, 2, 100, "x"), (1, 3, 7, "x"), (None, 0, 3, "x")], "k long, idx long, v short, frame string")
    got = {(r.k, r.frame): r.rms for r in sound.frame_rms(df, ["k"], 2).collect()}
    assert list(got) == [(1, 1)] and abs(got[1, 1] - ((100**2 + 49) / 2 / 32768**2 + 1e-9) ** 0.5) < 1e-12
    assert sound.frame_rms(df.filter("false"), ["k"], 2).count() == 0
    assert sound.frame_rms(df.withColumn("v", F.col("v").cast("double")), ["k"], 1).count() == 4


def test_speech_mask_against_a_plain_loop():
    from momentloom.operators import sound as masks

    rng = np.random.default_rng(3)
    for rate, fps, n in ((160, 30, 90), (16_000, 30, 40), (160, 200, 30)):
        hop = max(1, rate // fps)
        start = np.sort(rng.integers(-500, 3500, 12))
        end = start + rng.integers(0, 400, 12)
        samples = rng.integers(-200, 200, int(rate * n / fps) - 7) * (rng.random(int(rate * n / fps) - 7) < 0.3)
        want = [False] * n
        for a, z in zip(start.tolist(), end.tolist(), strict=True):
            for f in range(max(0, int(a * fps / 1000)), min(n, -(-z * fps // 1000) + 1)):
                want[f] = True
        levels = [np.sqrt((samples[k * hop : (k + 1) * hop] ** 2.0).mean() + 1e-9) for k in range(min(n, len(samples) // hop))]
        for f, level in enumerate(levels):
            want[f] = want[f] or bool(level > max(0.01, np.percentile(levels, 25) * 1.8))
        assert masks.speech_mask(start, end, samples, n, fps, rate).tolist() == want
    none = np.zeros(0, np.int64)
    assert not masks.speech_mask(none, none, none, 5, 30, 160).any() and masks.speech_mask(none, none, none, 0, 30, 160).tolist() == []
