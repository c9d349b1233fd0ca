"""Operators whose rows depend on all rows before: tracking, merging, speaker states, camera path.

Each is a fold over one clip's rows in order (see ordered.py): a clip is taken in batches of
any size with a small state in between, so that a clip's length doesn't matter to memory or to the result. A null
key is a clip like others, an empty table has no clips, and columns beside those named are not read.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass
from math import hypot
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordered import fold_in_order

#: Fixed values. Distances and times of the tracker (share of the picture's width; ms).
MATCH, MERGE_GAP, MERGE_SHARE = 0.18, 3000, 1.5


def _table(**columns: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


def _lists(rows: pa.RecordBatch, *names: str) -> Iterator[tuple]:
    return zip(*(rows[n].to_pylist() for n in names), strict=True)


class Tracks:
    """Rows (t_ms, det, cx, cy, w, openness) in time order get a track each: t_ms, det, tid, openness, cx, cy, w.

    A detection goes to the nearest track whose last centre is nearer than MATCH and
    that has no sample at this time yet; ties go to the older track, and what is near
    none opens a track. A missing openness repeats the track's last, at first 0. The state has a few numbers a track.
    """

    fields = "t_ms long, det long, tid long, openness double, cx double, cy double, w double"

    def __init__(self) -> None:
        self.x, self.y, self.seen, self.last = np.zeros(0), np.zeros(0), np.zeros(0, np.int64), []

    def feed(self, rows: pa.RecordBatch) -> pa.RecordBatch:
        tids, opens = [], []
        for t, cx, cy, mouth in _lists(rows, "t_ms", "cx", "cy", "openness"):
            d = np.where(self.seen == t, np.inf, np.sqrt((self.x - cx) ** 2 + (self.y - cy) ** 2))
            k = int(d.argmin()) if len(d) else 0
            if not len(d) or not d[k] < MATCH:
                k = len(self.x)
                self.x, self.y, self.seen = np.append(self.x, cx), np.append(self.y, cy), np.append(self.seen, t)
                self.last.append(0.0)
            self.x[k], self.y[k], self.seen[k] = cx, cy, t
            if mouth is not None and mouth == mouth:
                self.last[k] = mouth
            tids.append(k)
            opens.append(self.last[k])
        return _table(t_ms=rows["t_ms"], det=rows["det"], tid=pa.array(tids, pa.int64()), openness=pa.array(opens, pa.float64()), cx=rows["cx"], cy=rows["cy"], w=rows["w"])

    def end(self) -> None:
        return None


def assign_tracks(detections: DataFrame, key: list[str]) -> DataFrame:
    """key and what Tracks gives, from detections (key, t_ms, det, cx, cy, w, openness)."""
    kinds = {"t_ms": "long", "det": "long", "cx": "double", "cy": "double", "w": "double", "openness": "double"}
    return fold_in_order(detections.select(*key, *(F.col(c).cast(k).alias(c) for c, k in kinds.items())), key, ["t_ms", "det"], Tracks, Tracks.fields)


class Hosts:
    """Fragments (tid, start, cx, cy, w at the start, and end_ms, end_x, end_y, end_w) in the order of their starts get the host that they continue: tid, host.

    The first host whose gap is from 0 to MERGE_GAP (not included) and whose last centre is nearer than MATCH or
    MERGE_SHARE widths; else a fragment is a host of its own.
    """

    fields = "tid long, host long"

    def __init__(self) -> None:
        self.ends: list[tuple[float, float, float, int]] = []

    def feed(self, rows: pa.RecordBatch) -> pa.RecordBatch:
        found = []
        for start, cx, cy, w, *end in _lists(rows, "start", "cx", "cy", "w", "end_x", "end_y", "end_w", "end_ms"):
            fits = (k for k, (x, y, wide, seen) in enumerate(self.ends) if 0 <= start - seen < MERGE_GAP and hypot(x - cx, y - cy) < max(MATCH, MERGE_SHARE * max(wide, w)))
            k = next(fits, len(self.ends))
            self.ends[k : k + 1] = [tuple(end)]
            found.append(k)
        return _table(tid=rows["tid"], host=pa.array(found, pa.int64()))

    def end(self) -> None:
        return None


def merge_fragments(tracks: DataFrame, key: list[str]) -> DataFrame:
    """tracks (key, t_ms, det, tid, cx, cy, w) with tid numbered anew, from 0: tracks that begin shortly after another one ended, near its last place, continue it.

    Heads and tails of the tracks are aggregates; the fold sees one row a track.
    """
    at, here = F.struct("t_ms", "det"), F.struct("t_ms", "det", "cx", "cy", "w")
    f = tracks.groupBy(*key, "tid").agg(F.min_by(here, at).alias("a"), F.max_by(here, at).alias("z"))
    rows = f.select(*key, F.col("tid").cast("long").alias("tid"), F.col("a.t_ms").alias("start"), F.col("a.det").alias("det"), *(F.col(f"a.{c}").cast("double").alias(c) for c in ("cx", "cy", "w")), F.col("z.t_ms").alias("end_ms"), *(F.col(f"z.c{c}").cast("double").alias(f"end_{c}") for c in "xy"), F.col("z.w").cast("double").alias("end_w"))
    hosts = fold_in_order(rows, key, ["start", "det"], Hosts, Hosts.fields).withColumnsRenamed({k: f"_{k}" for k in (*key, "tid", "host")})
    same = F.col("tid") == F.col("_tid")
    for k in key:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return tracks.join(hosts, same).select(*(F.col("_host").alias("tid") if c == "tid" else c for c in tracks.columns))


#: Fixed values. Speaker states: activity, ratio of peaks, look-back, least run of one and of two, absence (frames at 30 a second).
ACTIVE, RATIO, LOOK_BACK, SINGLE_RUN, SPLIT_RUN, ABSENT = 0.010, 3.0, 38, 45, 30, 30
#: Two faces are apart beyond so many widths of the wider one, if their crops share no more than this.
DISTINCT, MOST_SHARED = 1.3, 0.30
#: Fixed values. Crops: the face's share of the height, where on it the face is, width over height, and the output's height; all for one face and for two.
FACE_SHARE, FACE_PLACE = {"single": 0.35, "split": 0.42}, {"single": 0.42, "split": 0.46}
ASPECT, OUT_HEIGHT = {"single": 1080 / 1920, "split": 1080 / 960}, {"single": 1920.0, "split": 960.0}
ZOOM, MOST_UPSCALE, HEADROOM = 0.9, 4.0, 1.8


def aim_at(face, mode: str, src_w: float, src_h: float):
    """Centre and height of the crop for faces (cx, cy, w, h as shares of the source), numbers or arrays.

    The crop gives the face its share of the height, from HEADROOM faces or the upscale limit up to
    the source's height, and lies so that the face is at its place.
    """
    h = face[3] * src_h
    least = min(OUT_HEIGHT[mode] / max(1.0, MOST_UPSCALE), src_h)
    height = np.minimum(np.maximum(h / (FACE_SHARE[mode] * ZOOM), np.maximum(HEADROOM * h, least)), src_h)
    return face[0] * src_w, face[1] * src_h + (0.5 - FACE_PLACE[mode]) * height, height


def crop_inside(aim, mode: str, src_w: float, src_h: float):
    """The crop (x, y, w, h) of an aim, made small enough and moved to lie inside the source."""
    height = np.minimum(aim[2], min(src_h, src_w / ASPECT[mode]))
    width = height * ASPECT[mode]
    return np.clip(aim[0] - width / 2, 0, src_w - width), np.clip(aim[1] - height / 2, 0, src_h - height), width, height


def crops_shared(a, b, src_w: float, src_h: float):
    """Share of the union that the two crops of a split picture have in common."""
    p, q = (crop_inside(aim_at(x, "split", src_w, src_h), "split", src_w, src_h) for x in (a, b))
    common = np.maximum(np.minimum(p[0] + p[2], q[0] + q[2]) - np.maximum(p[0], q[0]), 0) * np.maximum(np.minimum(p[1] + p[3], q[1] + q[3]) - np.maximum(p[1], q[1]), 0)
    return common / (p[2] * p[3] + q[2] * q[3] - common)


class Runs:
    """Runs (first, end, state) of states told frame by frame; one shorter than its least goes to the run before, but for the first."""

    def __init__(self, first: int):
        self.own: list[Any] | None = None  # the run under way: first frame and state
        self.kept: list[Any] | None = None
        self.at = first
        self.out: list[tuple[int, int, tuple]] = []

    def tell(self, state: tuple) -> None:
        if self.own is None or self.own[1] != state:
            self._close()
            self.own = [self.at, state]
        self.at += 1

    def _close(self) -> None:
        if self.own is None:
            return
        first, state = self.own
        least = SPLIT_RUN if state[0] == "split" else SINGLE_RUN
        if self.kept and (self.at - first < least or self.kept[2] == state):
            self.kept[1] = self.at
        else:
            if self.kept:
                self.out.append(tuple(self.kept))
            self.kept = [first, self.at, state]

    def taken(self, last: bool = False) -> list[tuple[int, int, tuple]]:
        """The runs that nothing can change any more."""
        if last:
            self._close()
            self.out += [tuple(self.kept)] if self.kept else []
        out, self.out = self.out, []
        return out


class States:
    """Runs (f0, f1, mode, tids) from rows (frame, faces, pair, single) of a clip, a row a frame; frames count from the clip's first.

    faces lists the tracks in order as tid, activity, visible, cx, cy, w, h; pair has the two tracks of most activity, the most active one
    first, and shown the same from left to right.
    A frame shows both where both have
    peaked lately at like heights, are visible and stand apart, in their faces and in their crops; else who speaks
    now; else what the frame before showed. A picture of two that no longer stand apart
    falls back to who is most active, or to its first. Who is not visible hands over to the most active
    visible track; without any, nobody is aimed at in a long absence of all, and else the
    frame before goes on. Short runs go to the run before. Frames without rows show nobody.
    Frames of an absence wait until it is long or over, so that at most ABSENT frames are held.
    """

    fields = "f0 long, f1 long, mode string, tids array<long>"

    def __init__(self, src_w: float = 1920.0, src_h: float = 1080.0):
        self.src = src_w, src_h
        self.peaks: tuple[deque, deque] = deque(maxlen=LOOK_BACK), deque(maxlen=LOOK_BACK)
        self.waiting: list[tuple] = []
        self.gone = False
        self.runs: Runs | None = None
        self.before: tuple | None = None

    def feed(self, rows: pa.RecordBatch) -> pa.RecordBatch:
        for frame, faces, pair, shown in _lists(rows, "frame", "faces", "pair", "shown"):
            if self.runs is None:
                self.runs, self.next, self.before = Runs(frame), frame, ("single", (pair[0],))
            for _ in range(frame - self.next):
                self._frame({}, pair, shown)
            self._frame({x["tid"]: x for x in reversed(faces)}, pair, shown)
            self.next = frame + 1
        return self._result(self.runs.taken())

    def end(self) -> pa.RecordBatch:
        self._release(False)
        return self._result(self.runs.taken(True))

    @staticmethod
    def _result(runs: list[tuple[int, int, tuple]]) -> pa.RecordBatch:
        first, end, mode, tids = zip(*((a, z, s[0], list(s[1])) for a, z, s in runs), strict=True) if runs else ((), (), (), ())
        return _table(f0=pa.array(first, pa.int64()), f1=pa.array(end, pa.int64()), mode=pa.array(mode, pa.string()), tids=pa.array(tids, pa.list_(pa.int64())))

    def _frame(self, faces: dict[int, dict], pair: list[int], shown: list[int]) -> None:
        seen = {t: x["activity"] or 0.0 for t, x in sorted(faces.items()) if x["visible"]}
        a, b = (faces.get(t) for t in (pair * 2)[:2])
        own = ((x or {}).get("activity") or 0.0 for x in (a, b))
        for peak, value in zip(self.peaks, own, strict=True):
            peak.append(value)
        apart = both = False
        if len(pair) > 1 and all(x and x["visible"] for x in (a, b)):
            place = [[x[c] for c in ("cx", "cy", "w", "h")] for x in (a, b)]
            far = hypot(a["cx"] - b["cx"], a["cy"] - b["cy"]) > DISTINCT * max(a["w"], b["w"])
            apart = far and crops_shared(*place, *self.src) <= MOST_SHARED
            low, high = sorted(map(max, self.peaks))
            both = apart and low > ACTIVE and high / (low + 1e-9) < RATIO
        item = seen, tuple(shown), apart, both, len(pair) > 1
        if seen:
            self._release(False)
            self.gone = False
            self._decide(item, False)
        elif self.gone:
            self._decide(item, True)
        else:
            self.waiting.append(item)
            if len(self.waiting) == ABSENT:
                self.gone = True
                self._release(True)

    def _release(self, gone: bool) -> None:
        for item in self.waiting:
            self._decide(item, gone)
        self.waiting = []

    def _decide(self, item: tuple, gone: bool) -> None:
        seen, pair, apart, both, several = item
        if not several:
            self.runs.tell(("single", () if gone else pair[:1]))
            return
        best = max(seen, key=seen.get) if seen else None  # of equal ones the first
        lead = ("single", (best,)) if seen else None
        now = ("split", pair) if both else lead if seen and seen[best] > ACTIVE else self.before
        if now[0] == "split" and not apart:
            now = lead or ("single", () if gone else now[1][:1])
        if now[0] == "single" and now[1] and now[1][0] not in seen:
            now = lead or (("single", ()) if gone else self.before)
        self.runs.tell(now)
        self.before = now


def speaker_states(rows: DataFrame, key: list[str], src_w: float = 1920.0, src_h: float = 1080.0) -> DataFrame:
    """key and runs (f0, f1, mode, tids) from rows (key, frame, tid, activity, visible, cx, cy, w, h); see States. Repeated rows of a frame and track count once.

    Who makes a conversation is an aggregate of the clip; a frame's faces, as many as it has tracks, are one row.
    """
    once = rows.groupBy(*key, F.col("frame").cast("long").alias("frame"), F.col("tid").cast("long").alias("tid")).agg(F.first(F.struct(*(F.col(c).cast("double").alias(c) for c in ("activity", "cx", "cy", "w", "h")), F.col("visible").alias("visible"))).alias("x"))
    total = once.groupBy(*key, "tid").agg(F.sum("x.activity").alias("total"), F.avg("x.cx").alias("left"))
    top = F.slice(F.array_sort(F.collect_list(F.struct((-F.coalesce("total", F.lit(0.0))).alias("total"), "tid", "left"))), 1, 2)
    two = total.groupBy(*key).agg(top.alias("top"))  # a row for each track
    # Of equal places the more active one is the left one.
    order = F.array_sort(F.transform("top", lambda x, i: F.struct(x["left"].alias("left"), i.alias("i"), x["tid"].alias("tid"))))
    two = two.select(*(F.col(k).alias(f"_{k}") for k in key), F.transform("top", lambda x: x["tid"]).alias("pair"), F.transform(order, lambda x: x["tid"]).alias("shown"))
    same = F.lit(True)
    for k in key:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    faces = F.array_sort(F.collect_list(F.struct("tid", "x.activity", "x.visible", "x.cx", "x.cy", "x.w", "x.h")))
    frames = once.groupBy(*key, "frame").agg(faces.alias("faces")).join(two, same).select(*key, "frame", "faces", "pair", "shown")
    return fold_in_order(frames, key, ["frame"], lambda: States(src_w, src_h), States.fields)


#: Fixed values. The camera: dead zone and ramp (of the crop's height), rates, most move a frame (of the width), height's rate and zone, punch and drift, and how long coarse faces are trusted after a cut.
DEAD, RAMP, STILL, SLOW, FAST, MOST_MOVE = 0.015, 0.12, 0.02, 0.05, 0.32, 0.03
HEIGHT_RATE, HEIGHT_ZONE, PUNCH, PUNCH_S, DRIFT, DRIFT_FROM, DRIFT_TO, REACQUIRE_S = 0.05, 0.02, 1.035, 0.5, 0.05, 6.0, 20.0, 0.75
SLOTS = 2


def _filled(values: np.ndarray, known: np.ndarray, before: Any) -> np.ndarray:
    """values where known, else the last known one, at first before."""
    place = np.maximum.accumulate(np.where(known, np.arange(len(values)), -1))
    return np.where(place >= 0, values[np.maximum(place, 0)], before)


@dataclass
class Shots:
    """A batch of frames as arrays: what is shown, where its faces are, and what the coarse detector says."""

    frame: np.ndarray
    cut: np.ndarray
    split: np.ndarray
    tids: np.ndarray  # frames x SLOTS, -1 for none
    face: np.ndarray  # frames x SLOTS x (cx, cy, w, h)
    seen: np.ndarray  # frames x SLOTS
    coarse: np.ndarray  # frames x most faces x (cx, cy, w, h), nan for none

    @classmethod
    def of(cls, rows: pa.RecordBatch) -> Shots:
        n = rows.num_rows
        boxes = [list(b or ())[:SLOTS] for b in rows["boxes"].to_pylist()]
        faces = [[c[:4] for c in own or () if c is not None and len(c) >= 4 and c[2] > 0 and c[3] > 0] for own in rows["coarse"].to_pylist()]
        at = [(f, k, b) for f, own in enumerate(boxes) for k, b in enumerate(own)]
        i, k = (np.array([x[m] for x in at], np.int64) for m in (0, 1))
        tids, face, seen = np.full((n, SLOTS), -1, np.int64), np.full((n, SLOTS, 4), np.nan), np.zeros((n, SLOTS), bool)
        if at:
            tids[i, k], seen[i, k] = [b["tid"] for *_, b in at], [bool(b["visible"]) for *_, b in at]
            face[i, k] = [[b[c] for c in ("cx", "cy", "w", "h")] for *_, b in at]
        coarse = np.full((n, max(1, *map(len, faces), 1), 4), np.nan)
        for f, own in enumerate(faces):
            coarse[f, : len(own)] = own or coarse[f, :0]
        cut = np.array([bool(c) for c in rows["cut"].to_pylist()], bool)
        return cls(rows["frame"].to_numpy(), cut, np.array([m == "split" for m in rows["mode"].to_pylist()], bool), tids, face, seen, coarse)

    def aims(self, trusted: np.ndarray, src_w: float, src_h: float) -> np.ndarray:
        """frames x SLOTS x (x, y, height) to look at, nan for slots without. One face that is not seen, or, as long as coarse faces are trusted, a lone coarse one beside it, gives way to the nearest coarse face; nobody, to the largest."""
        shown, near = (self.tids >= 0).sum(1), self.coarse[:, :, 2]
        many = (~np.isnan(near)).sum(1)
        row = np.arange(len(shown))
        largest = np.nan_to_num(self.coarse[:, :, 2] * self.coarse[:, :, 3], nan=-1.0).argmax(1)
        apart = ((self.coarse[:, :, :2] - self.face[:, :1, :2]) ** 2).sum(2)
        nearest = np.nan_to_num(apart, nan=np.inf).argmin(1)
        face = self.face.copy()
        alone = ~self.split & (shown == 1) & (many > 0) & (~self.seen[:, 0] | (trusted & (many == 1)))
        face[alone, 0] = self.coarse[row, nearest][alone]
        nobody = ~self.split & (shown == 0) & (many > 0)
        face[nobody, 0] = self.coarse[row, largest][nobody]
        by_mode = [np.stack(aim_at(np.moveaxis(face, 2, 0), mode, src_w, src_h), 2) for mode in ("single", "split")]
        out = np.where(self.split[:, None, None], by_mode[1], by_mode[0])
        out[(shown == 0) & ~nobody, 0] = src_w / 2, src_h / 2, src_h
        return out


class Camera:
    """Crops (frame, slot, mode, x, y, w, h) from rows (frame, cut, mode, boxes, coarse), a row for each frame.

    boxes lists the tracks shown as tid, cx, cy, w, h, visible (shares of the source; two for
    a split picture, none for nobody), coarse the faces of an independent detector as
    (cx, cy, w, h). The camera snaps when mode or tracks change or the scene cuts, but eases out when
    the tracks are only lost; else each crop follows its aim with a dead zone and a limit on
    its speed. A snap starts a punch-in that wears off and, on one face, a slow drift
    inwards. For REACQUIRE_S after a cut a lone coarse face wins over the track. Crops lie inside the source.

    All but the easing is arrays over a batch: where pictures change, since when, what to aim at, how far to zoom. The
    easing is a recursion over frames, on the crops of both slots at once.
    """

    fields = "frame long, slot int, mode string, x double, y double, w double, h double"

    def __init__(self, src_w: float = 1920.0, src_h: float = 1080.0, fps: float = 30.0):
        self.src_w, self.src_h, self.fps = src_w, src_h, fps
        self.shown: np.ndarray | None = None  # split and tids of the last frame
        self.started = self.cut_at = -(1 << 40)
        self.crops = np.full((SLOTS, 3), np.nan)

    def feed(self, rows: pa.RecordBatch) -> pa.RecordBatch:
        s = Shots.of(rows)
        shown = np.column_stack([s.split, s.tids])
        before = np.concatenate([shown[:1] + 1 if self.shown is None else self.shown[None], shown[:-1]])
        first = np.zeros(len(shown), bool)
        first[0] = self.shown is None
        changed = (shown != before).any(1)
        # A picture whose tracks are lost, without a cut, goes on from the crop that it had.
        lost = changed & (s.tids < 0).all(1) & ~s.cut & ~first
        snap = (changed & ~lost) | s.cut | first
        started, cut_at = _filled(s.frame, snap, self.started), _filled(s.frame, s.cut, self.cut_at)
        aims = s.aims(s.frame < cut_at + max(1, round(REACQUIRE_S * self.fps)), self.src_w, self.src_h)
        eased = self._eased(aims, snap, lost)
        self.shown, self.started, self.cut_at = shown[-1], int(started[-1]), int(cut_at[-1])

        since = (s.frame - started) / self.fps
        punch = 1 + (PUNCH - 1) * np.maximum(0.0, 1 - since / PUNCH_S)
        drift = np.where(s.split, 1.0, 1 - DRIFT * np.clip((since - DRIFT_FROM) / (DRIFT_TO - DRIFT_FROM), 0, 1))
        aim = np.moveaxis(eased, 2, 0) * np.stack([np.ones((len(since), SLOTS))] * 2 + [np.repeat((drift / punch)[:, None], SLOTS, 1)])
        by_mode = [np.stack(np.broadcast_arrays(*crop_inside(aim, mode, self.src_w, self.src_h)), 2) for mode in ("single", "split")]
        crops = np.where(s.split[:, None, None], by_mode[1], by_mode[0])
        at, slot = np.nonzero(~np.isnan(eased[:, :, 0]))
        found = np.round(crops[at, slot], 6)
        mode = np.where(s.split[at], "split", "single")
        return _table(frame=pa.array(s.frame[at]), slot=pa.array(slot, pa.int32()), mode=pa.array(mode.tolist(), pa.string()), **{c: pa.array(found[:, k]) for k, c in enumerate("xywh")})

    def _eased(self, aims: np.ndarray, snap: np.ndarray, lost: np.ndarray) -> np.ndarray:
        out, own = np.empty_like(aims), self.crops
        most = MOST_MOVE * self.src_w
        for f in range(len(aims)):
            to = aims[f]
            if snap[f]:
                own = to.copy()
            else:
                if lost[f]:
                    own = np.where(np.arange(SLOTS)[:, None] == 0, own, np.nan)
                height = own[:, 2:]
                err = to - own
                over = np.abs(err[:, :2]) - DEAD * height
                rate = np.where(over < 0, STILL, SLOW + (FAST - SLOW) * np.minimum(1.0, over / np.maximum(RAMP * height, 1e-6)))
                move = np.clip(rate * err[:, :2], -most, most)
                grow = np.where(np.abs(err[:, 2:]) > HEIGHT_ZONE * height, HEIGHT_RATE * err[:, 2:], 0.0)
                # A crop without an aim of its own stays.
                own = own + np.nan_to_num(np.concatenate([move, grow], 1))
            out[f] = own
        self.crops = own
        return out

    def end(self) -> None:
        return None


def camera_path(frames: DataFrame, key: list[str], src_w: float = 1920.0, src_h: float = 1080.0, fps: float = 30.0) -> DataFrame:
    """key and what Camera gives, from rows (key, frame, cut, mode, boxes, coarse), a row for each frame of a clip."""
    return fold_in_order(frames.select(*key, F.col("frame").cast("long").alias("frame"), "cut", "mode", "boxes", "coarse"), key, ["frame"], lambda: Camera(src_w, src_h, fps), Camera.fields)
