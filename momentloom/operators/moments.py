"""From texts to ranked moments and clips within documents' rows: many texts at once as numpy arrays, nothing is shuffled.

The same as the chain of segments.py and scoring.py, from segment_arrays to ranked, for documents whose id no other row
has; in_rows tells them apart and leaves the others to that chain.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Callable, Iterable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import segments as G

#: Bytes that are white space, and that end a sentence.
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_STOP = np.isin(np.arange(256), [ord(c) for c in G.STOPS])
#: Keeps the times of one text apart from those of the next.
APART = 1 << 40


class Texts:
    """Timed words and sentences of texts, one text after the other: text d has the words from edges[d] up to edges[d + 1] and the sentences from sentence_edges[d] on.

    Times are those of segments.timed and segments.sentence_places.
    """

    def __init__(self, texts: list[bytes | None]):
        data = np.frombuffer(b" ".join([x or b"" for x in texts]) + b" ", np.uint8)
        ink = ~_SPACE[data]
        turns = np.flatnonzero(np.diff(ink, prepend=False))
        #: The words, in bytes of all texts, from first up to behind the last.
        self.low, self.high = turns[::2], turns[1::2]
        self.data = data
        kept = ink.copy()
        kept[1:] |= ink[:-1]
        #: The same bytes with one blank behind each word and nothing else between words, and where words begin there.
        self.packed = np.where(ink, data, 32).astype(np.uint8)[kept].tobytes()
        self.offsets = np.append(0, np.cumsum(self.high - self.low + 1))
        begin = np.cumsum([0, *(len(x or b"") + 1 for x in texts)])
        self.edges = np.searchsorted(self.low, begin)
        n = np.diff(self.edges)
        stops = _STOP[data[self.high - 1]].astype(np.int64)
        before = np.cumsum(stops) - stops
        j = before - np.repeat(np.append(before, 0)[self.edges[:-1]], n)
        self.at = (np.arange(len(self.low)) - np.repeat(self.edges[:-1], n)) * G.WORD_STEP + j * G.SENTENCE_GAP + j // 2 * G.PAIR_GAP
        begins = np.append(True, stops[:-1] > 0)[: len(stops)]
        begins[self.edges[:-1][n > 0]] = True
        self.first = np.flatnonzero(begins)
        self.end = np.append(self.first[1:], len(self.low))[: len(self.first)]
        self.sentence_edges = np.searchsorted(self.first, self.edges)
        self.doc = np.repeat(np.arange(len(texts)), np.diff(self.sentence_edges))
        self.start, self.stop = self.at[self.first], self.at[self.end - 1] + G.WORD_LENGTH
        lasts = self.sentence_edges[1:][n > 0] - 1
        gap = np.append(self.start[1:], 0)[: len(self.first)] - self.stop
        gap[lasts] = 999_000
        self.natural = gap >= G.PAUSE
        #: When the last sentence of each text ends; 0 without words.
        self.duration = np.zeros(len(texts), np.int64)
        self.duration[n > 0] = self.stop[lasts]
        for d in np.flatnonzero(self.duration >= G.WINDOW_LEAST).tolist():  # shorter ones have no windows
            self.natural[self.sentence_edges[d + 1] - 1] &= G.TERMINAL_WORD.search(self.text(self.edges[d + 1] - 1, self.edges[d + 1])) is not None

    def text(self, a: int, z: int) -> str:
        return self.packed[self.offsets[a] : max(self.offsets[a], self.offsets[z] - 1)].decode()

    @functools.cached_property
    def small(self) -> tuple[bytes, np.ndarray]:
        """All words in small letters, with a blank before, between and behind them, and the places of these blanks."""
        return self._changed(str.lower)

    @functools.cached_property
    def capitals(self) -> tuple[bytes, np.ndarray]:
        """The same in capitals."""
        return self._changed(str.upper)

    def _changed(self, change: Callable[[str], str]) -> tuple[bytes, np.ndarray]:
        # What becomes of a letter hangs on no letter beyond a blank, and no letter becomes a blank.
        made = (" " + change(self.packed.decode())).encode()
        return made, np.flatnonzero(np.frombuffer(made, np.uint8) == 32)

    @functools.cached_property
    def words(self) -> pa.Array:
        return without_blanks(b" " + self.packed, self.offsets)

    @functools.cached_property
    def _apart(self) -> np.ndarray:
        return self.at + np.repeat(np.arange(len(self.duration)) * APART, np.diff(self.edges))

    def between(self, doc: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places (from, up to) of the words of these texts that start from first to last (ms)."""
        place = lambda at, side: np.searchsorted(self._apart, np.clip(at, -1, self.duration[doc] + 1) + doc * APART, side)
        a = place(first, "left")
        return a, np.maximum(a, place(last, "right"))

    def lengths(self) -> np.ndarray:
        """Code points of each word."""
        points = np.append(0, np.cumsum((self.data & 0xC0) != 0x80))
        return points[self.high] - points[self.low]

    @functools.cached_property
    def windows(self) -> tuple[np.ndarray, np.ndarray]:
        """First and last sentences of windows (segments.window_places)."""
        start, end = self.start + self.doc * APART, self.stop + self.doc * APART
        after = np.searchsorted(start, start + G.SEED_STEP).tolist()
        edges, seeds = self.sentence_edges.tolist(), []
        for d in np.flatnonzero(self.duration >= G.WINDOW_LEAST).tolist():
            k, z = edges[d], edges[d + 1]
            while k < z:
                seeds.append(k)
                k = after[k]
        at = np.array(seeds, np.int64)
        most = G.WINDOW_MOST // G.WORD_STEP + 2
        low = np.maximum(np.searchsorted(end, start[at] + G.WINDOW_LEAST, "left"), at)
        high = np.minimum(np.searchsorted(end, start[at] + G.WINDOW_MOST, "right"), at + most)
        natural = np.append(-1, np.flatnonzero(self.natural))
        stop = natural[np.searchsorted(natural, high, "left") - 1]
        there = high > low
        return at[there], np.where(stop >= low, stop, high - 1)[there]


def without_blanks(text: bytes, blanks: np.ndarray) -> pa.Array:
    """The words between the blanks of text, a blank before and behind each, as an Arrow array."""
    data = text.translate(None, b" ")
    return pa.LargeStringArray.from_buffers(len(blanks) - 1, pa.py_buffer(blanks - np.arange(len(blanks))), pa.py_buffer(data))


def rows_of_slices(df: DataFrame, fields: str, make: Callable[[Texts], tuple], keep: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (keep and fields) that follow from texts, a few MB of them at once: make gives for each row the text's place and then the fields' columns, numpy arrays, lists or Arrow arrays."""
    names, kinds = zip(*(x.split() for x in fields.split(", ")), strict=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in G.cut_by_size(batch, np.asarray(pc.fill_null(pc.binary_length(batch.column(1)), 0))):
                at, *columns = make(Texts(b.column(1).cast(pa.binary()).to_pylist()))
                made = [G.column(c, kind) for c, kind in zip(columns, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), *made], [keep, *names])

    schema = T.StructType([df.schema[keep]] + [T.StructField(n, G.SPARK_KINDS[k]) for n, k in zip(names, kinds, strict=True)])
    return df.select(keep, df[text].cast("string").alias("_text")).mapInArrow(run, schema)


def in_rows(docs: DataFrame, alone: Callable[[DataFrame], DataFrame], together: Callable[[DataFrame], DataFrame], key: str = "doc_id") -> DataFrame:
    """alone(docs) where each row has an id of its own; rows whose id (null among them) others have too count as one document and go through together."""
    repeated = docs.groupBy(key).agg(F.count("*").alias("_n")).filter("_n > 1").select(F.col(key).alias("_key"))
    if repeated.isEmpty():
        return alone(docs)
    same = docs[key].eqNullSafe(F.col("_key"))
    return alone(docs.join(repeated, same, "left_anti")).unionByName(together(docs.join(repeated, same, "left_semi")))


def by_score(doc: np.ndarray, score: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of windows by text, score from the top and start, and the place of each in its text's order (from 0). Starts rise with the sentences' numbers."""
    order = np.lexsort((start, -score, doc))
    return order, places(doc[order])


def places(doc: np.ndarray) -> np.ndarray:
    """The number of each row within its text, of rows in the texts' order."""
    return np.arange(len(doc)) - np.searchsorted(doc, doc)


def targets(duration: np.ndarray) -> np.ndarray:
    """segments.target_count."""
    return np.clip(np.rint(duration / 60_000.0 * 0.4).astype(np.int64), 4, 60)


def without_overlaps(doc: np.ndarray, start: np.ndarray, end: np.ndarray, order: np.ndarray) -> np.ndarray:
    """segments.suppress_overlaps: the kept ones of order. Windows are in the texts' order; those that may overlap are few places apart, as seeds keep their distance."""
    near = [[] for _ in range(len(doc))]
    for d in range(1, -(-G.WINDOW_MOST // G.SEED_STEP)):
        common = np.minimum(end[:-d], end[d:]) - np.maximum(start[:-d], start[d:])
        union = (end[:-d] - start[:-d]) + (end[d:] - start[d:]) - common
        for k in np.flatnonzero((doc[:-d] == doc[d:]) & (common > 0) & (10 * common > G.MOST_OVERLAP_TENTHS * union)).tolist():
            near[k].append(k + d)
            near[k + d].append(k)
    out, gone = [], bytearray(len(doc))
    for k in order.tolist():
        if not gone[k]:
            out.append(k)
            for x in near[k]:
                gone[x] = 1
    return np.array(out, np.int64)


class Moments:
    """Windows of texts with scores, in the texts' order: doc, j0, start, end, score; kept, cut and ranked are places of those that each further step leaves, by score."""

    def __init__(self, texts: Texts, scored: Callable[[Texts], np.ndarray]):
        first, last = texts.windows
        self.texts = texts
        self.doc, self.start, self.end = texts.doc[first], texts.start[first], texts.stop[last]
        self.j0 = first - texts.sentence_edges[self.doc]
        self.score = scored(texts)
        self.target = targets(texts.duration)[self.doc]
        self.order, self.place = by_score(self.doc, self.score, self.start)

    @functools.cached_property
    def kept(self) -> np.ndarray:
        return without_overlaps(self.doc, self.start, self.end, self.order)

    @functools.cached_property
    def ranked(self) -> tuple[np.ndarray, np.ndarray]:
        """Windows that are left of the target's number without a weak tail (segments.drop_weak_tail), and their ranks."""
        cut = self.kept[places(self.doc[self.kept]) < self.target[self.kept]]
        doc, strong = self.doc[cut], self.score[cut] >= 35.0
        n = len(self.texts.duration)
        few = np.bincount(doc, strong, n) < np.minimum(np.bincount(doc, minlength=n), 4)
        left = cut[strong | few[doc]]
        return left, places(self.doc[left]) + 1

    def rows(self, at: np.ndarray, *columns: str) -> tuple[Any, ...]:
        return self.doc[at], *(getattr(self, c)[at] for c in columns)

    def clips(self, ranks: Iterable[int]) -> Iterator[tuple[int, int, int, int]]:
        """Place of the text, rank, t0 and t1 of the windows of these ranks, in the texts' order."""
        at, rank = self.ranked
        own = np.isin(rank, list(ranks))
        return zip(*(x.tolist() for x in (self.doc[at[own]], rank[own], self.start[at[own]], self.end[at[own]])), strict=True)


def rows_of_ranked_clips(moments: Moments, ranks: Iterable[int], make: Callable[..., tuple]) -> tuple[Any, ...]:
    """Columns as rows_of_slices wants them, clip and what make(texts, doc, t0, t1) gives of all clips at once: the clip's place for each row, and then columns (see captions.rows_of_clips)."""
    at, rank = moments.ranked
    own = np.isin(rank, list(ranks))
    at, rank = at[own], rank[own]
    place, *columns = make(moments.texts, moments.doc[at], moments.start[at], moments.end[at])
    return moments.doc[at][place], rank[place], *columns
