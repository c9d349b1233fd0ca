"""Clips and windows of many texts at once against plain steps for each of them."""

import numpy as np
import pyarrow as pa
import pytest

from momentloom.operators import captions, moments, scoring, sound
from momentloom.plans import candidate_queries


@pytest.fixture(scope="module")
def clips():
    r = np.random.default_rng(5)
    words = ['"so,"', "Straße!", "{a}\\", 'wait."', "o", "ΟΔΟΣ", "then.", "wonderful,", "ok?\"\"", "İn"]
    texts = moments.Texts([None, "", *(" ".join(r.choice(words, n)).encode() for n in (1, 40, 300)), b" \n"])
    doc = np.array([0, 2, 3, 4, 4, 4, 5, 1], np.int64)
    return texts, doc, np.array([0, 0, 1_010, -500, 60_000, 10**13, 7, 0]), np.array([9, 250, 9_000, 70_000, 99_990, 10**13 + 5, 9, 0])


def own_words(texts, doc, t0, t1):
    """The words of a clip in capitals, and when they start and end in it."""
    at = texts.at[texts.edges[doc] : texts.edges[doc + 1]].tolist()
    words = texts.text(texts.edges[doc], texts.edges[doc + 1]).split(" ")
    clamp = lambda x: min(max(x - t0, 0), t1 - t0)
    return [(w.upper(), clamp(s), clamp(s + 250)) for w, s in zip(words, at, strict=False) if s >= t0 - 200 and s + 250 <= t1 + 200]


def lines_of(words):
    out = []
    for w, s, e in words:
        line = out[-1] if out else []
        if not line or s - line[-1][2] > 600 or len(line) >= 4 or sum(len(x[0]) + 1 for x in line) + len(w) > 18 or (line[-1][0].rstrip('"')[-1:] in {".", "!", "?", ","} and len(line) >= 2):
            out.append([])
        out[-1].append((w, s, e))
    return out


def events_of(words):
    flat = [(k, x, line) for line in lines_of(words) for k, x in enumerate(line)]
    for i, (k, (w, s, e), line) in enumerate(flat):
        after = flat[i + 1][1][1] if i + 1 < len(flat) else None
        end = min(x for x in (line[k + 1][1] if k + 1 < len(line) else e, after) if x is not None)
        if end - s >= 20 or after is None or after - s >= 20:
            shown = [x[0].translate(str.maketrans("{}\\", "()/")) for x in line]
            yield i, w, s, end if end - s >= 20 else s + 20, " ".join((captions.MARKED if q == k else captions.PLAIN) + x for q, x in enumerate(shown))


def test_events_of_clips_at_once(clips):
    want = [(c, i, w, s, e, text) for c, own in enumerate(zip(*clips[1:], strict=True)) for i, w, s, e, text in events_of(own_words(clips[0], *map(int, own)))]
    clip, _, i, w, start, end, text = captions.EVENTS[1](*clips)
    assert list(zip(clip.tolist(), i.tolist(), w.to_pylist(), start.tolist(), end.tolist(), text.to_pylist(), strict=True)) == want and len(want) > 250


def test_lines_and_times_of_clips_at_once(clips):
    clip, _, i, _, start, end, text = captions.EVENTS[1](*clips)
    clock = lambda ms: captions.clock_of(round(ms / 10))
    want = [f"Dialogue: 0,{clock(s)},{clock(e)},Cap,,0,0,0,,{t}" for s, e, t in zip(start.tolist(), end.tolist(), text.to_pylist(), strict=True)]
    assert captions.SUBTITLES[1](*clips)[2].to_pylist() == want


def test_files_of_clips_at_once(clips):
    clip, _, lines = captions.SUBTITLES[1](*clips)
    want = {c: "﻿" + captions.HEADER + "\n".join(x for x, k in zip(lines.to_pylist(), clip.tolist(), strict=True) if k == c) + "\n" for c in clip.tolist()}
    files = captions.FILES[1](*clips)
    assert dict(zip(files[0].tolist(), files[1].to_pylist(), strict=True)) == want and len(want) == 4


def test_overlaps_of_clips_at_once(clips):
    clip, _, i, _, start, end, _ = captions.EVENTS[1](*clips)
    want = []
    for c in sorted(set(clip.tolist())):
        own = sorted((s, e + 200 * (k % 4 == 3)) for x, k, s, e in zip(clip.tolist(), i.tolist(), start.tolist(), end.tolist(), strict=True) if x == c)
        found = [(e, s) for (_, e), (s, _) in zip(own, own[1:], strict=False) if e - s > 11]
        want += [(c, n + 1, f"{e}-{s}" if n < 3 else "suppressed") for n, (e, s) in enumerate(found[:4])]
    got = captions.late_overlaps(*clips)
    assert list(zip(got[0].tolist(), got[1].tolist(), got[2], strict=True)) == want and len(want) > 6


def test_each_time_of_lines_is_read_once(monkeypatch):
    read, found = captions._read_time, []
    monkeypatch.setattr(captions, "_read_time", lambda x: found.append(x) or read(x))
    good = ["Dialogue: 0,0:00:01.00,0:00:02.50,x,y", "Dialogue: 12,100:02:03.04,0:00:01.00,"]
    bad = ["Dialogue: 0,0:00:01.00,0:00:02.50", "Dialogue: 0,0:00:01.00,0:0:02.50,x", " Dialogue: 0,0:00:01.00,0:00:02.50,x", "", "Dialogue: ٣,0:00:01.00,0:00:02.50,x", "a,b,c,d"]
    lines = pa.array([*good, *bad, *good * 500])
    at, start, end = captions.times_of(lines)
    want = [(k, m) for k, m in enumerate(map(captions.DIALOGUE.match, lines.to_pylist())) if m]
    assert at.tolist() == [k for k, _ in want] and start[:2].tolist() == [1000, 360_123_040] and end[:2].tolist() == [2500, 1000] and len(found) < 20


def test_speech_of_clips_at_once_is_that_of_their_samples():
    r = np.random.default_rng(7)
    n = np.array([0, 7, 400, 90])
    levels = [r.random(k) for k in (0, 7, 333, 90)]
    words = [(c, s, s + 250) for c in range(4) for s in range(-700, 3000, 1700)]
    clip, start, end = np.array(words).T
    want = [[*sound.speech_mask(start[clip == c], end[clip == c], np.zeros(0), k, 30, 160)] for c, k in enumerate(n)]
    for own, level in zip(want, levels, strict=True):
        floor = max(0.01, np.quantile(level, 0.25) * 1.8) if len(level) else 0
        own[: len(level)] = [a or b > floor for a, b in zip(own[: len(level)], level, strict=True)]
    got = sound.speech_masks(clip, start, end, np.concatenate(levels), np.array([len(x) for x in levels]), n, 30)
    assert got.tolist() == [x for own in want for x in [*own, False]]


def test_frames_have_the_squares_of_their_samples():
    start, value = np.array([40, 700, 1_333, 90_000]), np.array([7, 199, 0, 37])
    clip, s, v = np.repeat([0, 1], 4), np.tile(start, 2), np.tile(value, 2)
    first, hops = np.array([0, 13]), np.array([60, 2900])
    samples = np.zeros(20_000, np.int64)
    for at, x in zip(start, value, strict=True):
        own = np.arange(at // 100 * 16, ((at + 249) // 100 + 1) * 16)
        samples[own] = ((x + own * 13) % 200) ** 2
    want = [samples[f + h * 5 : f + h * 5 + 5].sum() for f, n in zip(first, hops, strict=True) for h in range(n)]
    assert candidate_queries._frame_squares(clip, s, v, first, hops).tolist() == want


def test_marks_are_counted_in_all_texts_at_once():
    lexicon = scoring.Lexicon(emotion=("aaa", "İN".lower(), "", "a b"), opinion=("όσος", "aaa"), story=("aa", "a a", "b", ""), practical=("ς", "ab"), hooks=())
    texts = moments.Texts([("AAA aaaa ÓΣΟΣ όΣος İN ab? " * 60).encode(), None, ("Aaa AAA. " * 500).encode(), b"aaa"])
    a, last = texts.windows
    got = scoring.WindowFeatures(lexicon)(texts)
    assert len(a) > 4
    for k, (x, z) in enumerate(zip(texts.first[a], texts.end[last], strict=True)):
        low = texts.text(x, z).lower()
        words, n = low.split(" "), z - x
        emotion, opinion = (sum(map(words.count, {*own} - {""})) for own in (lexicon.emotion, lexicon.opinion))
        story = sum(low.count(m) for m in ("aa", "a a", "b"))
        want = emotion / (n / 60), opinion / (n / 80), story / 3, (low.count("ς") + low.count("ab")) / 3, low.count("?") / 3
        assert [got[f][k] for f in ("emotion", "opinion", "story", "practical", "questions")] == [min(1.0, x) for x in want]
