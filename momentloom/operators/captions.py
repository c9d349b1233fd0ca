"""Caption events: words of a clip, lines, slots on the screen that don't overlap, and subtitle text.

Documents without clips or without text, and clips without words, have no rows; null ids join nothing. Rows
that repeat a document repeat its clips' words, lines and events.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .moments import Texts, places, without_blanks
from .segments import SPARK_KINDS, WORD_LENGTH, bound, column, cut_by_size, unpacked

#: Words and characters of a line, the pause that ends one, how far words may stick out of a clip, the shortest slot (ms).
LINE_WORDS, LINE_CHARS, LINE_PAUSE, MARGIN, SHORTEST = 4, 18, 600, 200, 20


#: Marks that end a line of two words or more, and what a subtitle renderer would act on (see subtitle_text).
_STOPS, REPLACED = np.isin(np.arange(256), [ord(c) for c in ".!?,"]), bytes.maketrans(b"{}\\", b"()/")
#: Clips are keyed so.
KEY = ["doc_id", "clip"]


def with_clips(docs: DataFrame, clips: DataFrame) -> DataFrame:
    """docs that have clips (doc_id, clip, t0, t1 in ms) with clips, an array of them: as many as a document has approved ones. Texts are shuffled once.

    The number of partitions is given: rows are few bytes and much work, and where it is left open they would be put together by bytes.
    """
    spark = docs.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    own = clips.repartition(n, "doc_id").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("clip", "t0", "t1"))).alias("clips"))
    return docs.repartition(n, "doc_id").join(own, "doc_id")


def rows_of_clips(docs: DataFrame, clips: DataFrame, fields: str, make: Callable[..., tuple]) -> DataFrame:
    """doc_id, clip and fields of clips, from a few MB of texts at once, in the documents' rows: make(texts, doc, t0, t1) gives the fields' columns of all their clips (each clip's text, start and end), and before these each row's clip."""
    names, kinds = zip(*(x.split() for x in fields.split(", ")), strict=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in cut_by_size(batch, np.asarray(pc.fill_null(pc.binary_length(batch.column(1)), 0))):
                own = b.column(2)
                doc = np.repeat(np.arange(b.num_rows), np.diff(own.offsets.to_numpy()))
                clip, t0, t1 = own.flatten().flatten()
                place, *columns = make(Texts(b.column(1).cast(pa.binary()).to_pylist()), doc, t0.to_numpy(), t1.to_numpy())
                place = pa.array(place, pa.int64())
                made = [column(c, k) for c, k in zip(columns, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(doc)).take(place), clip.take(place), *made], ["doc_id", "clip", *names])

    schema = T.StructType([docs.schema["doc_id"], T.StructField("clip", T.LongType()), *(T.StructField(n, SPARK_KINDS[k]) for n, k in zip(names, kinds, strict=True))])
    own = F.transform("clips", lambda c: F.struct(*(c[x].cast("long").alias(x) for x in ("clip", "t0", "t1"))))
    return with_clips(docs, clips).select("doc_id", F.col("text").cast("string").alias("_text"), own.alias("_clips")).mapInArrow(run, schema)


def rows_between(a: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers from a up to z of each pair, one pair after the other, and before them the pair of each."""
    pair = np.repeat(np.arange(len(a)), z - a)
    return pair, np.arange(len(pair)) + (z - np.cumsum(z - a))[pair]


class ClipWords:
    """The words of clips of texts (with a margin), one clip after the other: their clip, number in it, place in the texts, and when they start and end in the clip, clamped."""

    def __init__(self, texts: Texts, doc: np.ndarray, t0: np.ndarray, t1: np.ndarray):
        self.texts = texts
        self.clip, self.word = rows_between(*texts.between(doc, t0 - MARGIN, t1 + MARGIN - WORD_LENGTH))
        self.i = places(self.clip)
        t0, length = t0[self.clip], (t1 - t0)[self.clip]
        clamp = lambda x: np.minimum(np.maximum(x - t0, 0), length)
        self.start, self.end = clamp(texts.at[self.word]), clamp(texts.at[self.word] + WORD_LENGTH)
        self.first = self.i == 0

    @functools.cached_property
    def capitals(self) -> pa.Array:
        """All words of the texts in capitals."""
        return without_blanks(*self.texts.capitals)

    def strings(self, at: np.ndarray | slice = slice(None)) -> pa.Array:
        return self.capitals.take(pa.array(self.word[at]))

    @functools.cached_property
    def heads(self) -> np.ndarray:
        """The first words of lines (see caption_lines). How long a line is follows from where it begins, LINE_WORDS at most; so lines follow each other from the first word on."""
        text, blanks = self.texts.capitals
        data = np.frombuffer(text, np.uint8)
        chars = np.diff(np.cumsum((data & 0xC0) != 0x80)[blanks])[self.word] - 1
        last = blanks[1:] - 1
        while (quoted := data[last] == ord('"')).any():
            last = last - quoted
        stop = _STOPS[data[last]][self.word]
        apart = self.first.copy()
        apart[1:] |= self.start[1:] - self.end[:-1] > LINE_PAUSE
        n = len(chars)
        size, goes_on, whole = np.ones(n, np.int64), np.ones(n, bool), chars.copy()
        for k in range(1, LINE_WORDS):
            goes_on[n - k :] = False
            whole[: n - k] += 1 + chars[k:]
            goes_on[: n - k] &= ~apart[k:] & (whole[: n - k] <= LINE_CHARS)
            if k >= 2:
                goes_on[: n - k] &= ~stop[k - 1 : n - 1]
            size += goes_on
        after, at, out = (np.arange(n) + size).tolist(), 0, []
        while at < n:
            out.append(at)
            at = after[at]
        return np.array(out, np.int64)

    @functools.cached_property
    def row(self) -> np.ndarray:
        """Which of all lines each word is in."""
        turns = np.zeros(len(self.clip), np.int64)
        turns[self.heads] = 1
        return np.cumsum(turns) - 1

    @functools.cached_property
    def line(self) -> np.ndarray:
        """Which line of its clip each word is in."""
        return self.row - self.row[np.maximum.accumulate(np.where(self.first, np.arange(len(self.first)), 0))]

    def marked(self, at: np.ndarray) -> list[pa.Array]:
        """For each of these words the parts of the text of its line, with it marked."""
        text, blanks = self.texts.capitals
        shown = without_blanks(text.translate(REPLACED), blanks)
        # How a word in a line is begun: plain and marked, without a blank before it and with one.
        begun = pa.array([PLAIN, MARKED, " " + PLAIN, " " + MARKED], pa.large_string())
        head = self.heads[self.row[at]]
        size = np.diff(np.append(self.heads, len(self.word)))[self.row[at]]
        out = []
        for k in range(LINE_WORDS):
            gone = k >= size
            out.append(begun.take(pa.array((head + k == at) + 2 * (k > 0), mask=gone)))
            out.append(shown.take(pa.array(self.word[np.where(gone, 0, head + k)], mask=gone)))
        return out

    @functools.cached_property
    def slots(self) -> tuple[np.ndarray, np.ndarray]:
        """The words with slots, and where the slots of all would end (see caption_events)."""
        last = np.append(self.first[1:], True)[: len(self.first)]
        after = np.append(self.start[1:], 0)[: len(last)]
        own = np.where(~last & (np.append(self.row[1:], -1)[: len(last)] == self.row), after, self.end)
        own = np.where(last, own, np.minimum(own, after))
        short = own - self.start < SHORTEST
        return np.flatnonzero(~short | last | (after - self.start >= SHORTEST)), np.where(short, self.start + SHORTEST, own)


def together(*parts: pa.Array | str) -> pa.Array:
    """Texts of parts, one behind the other, without those that are null."""
    wide = [pa.scalar(x, pa.large_string()) if isinstance(x, str) else x.cast(pa.large_string()) for x in (*parts, "")]
    return pc.binary_join_element_wise(*wide, null_handling="skip")


def _words(*clips: Any) -> tuple:
    x = ClipWords(*clips)
    return x.clip, x.i, x.texts.words.take(pa.array(x.word)), x.start, x.end


#: Fields and what makes them of clips, as rows_of_clips wants them.
WORDS = "i long, w string, s_ms long, e_ms long", _words


def clip_words(docs: DataFrame, clips: DataFrame) -> DataFrame:
    """doc_id, clip, i, w, s_ms, e_ms: words inside each clip (with a margin), in capitals, numbered, times relative to it and clamped."""
    return rows_of_clips(docs, clips, *WORDS).withColumn("w", F.upper("w"))


def _lines(*clips: Any) -> tuple:
    x = ClipWords(*clips)
    return x.clip, x.i, x.strings(), x.start, x.end, x.line, together(*x.marked(np.arange(len(x.i))))


LINES = "i long, w string, s_ms long, e_ms long, line long, text string", _lines


def lined_words(docs: DataFrame, clips: DataFrame) -> DataFrame:
    """caption_lines of clip_words, worked out in a document's row: nothing is shuffled but texts and clips, and rows that repeat a document repeat its clips' lines."""
    return rows_of_clips(docs, clips, *LINES)


def _events(*clips: Any) -> tuple:
    x = ClipWords(*clips)
    at, until = x.slots
    return x.clip[at], x.line[at], x.i[at], x.strings(at), x.start[at], until[at], together(*x.marked(at))


EVENTS = "line long, i long, w string, start_ms long, end_ms long, text string", _events


def events_of_clips(docs: DataFrame, clips: DataFrame) -> DataFrame:
    """caption_events of caption_lines of clip_words, in a document's row (see lined_words)."""
    return rows_of_clips(docs, clips, *EVENTS)


def late_overlaps(*clips: Any, slack: int = 11, most: int = 3) -> tuple:
    """overlap_flags of clips' slots with every fourth end put 200 ms too late."""
    x = ClipWords(*clips)
    at, until = x.slots
    clip, start, end = x.clip[at], x.start[at], until[at] + np.where(x.i[at] % 4 == 3, 200, 0)
    order = np.lexsort((end, start, clip))
    clip, start, end = clip[order], start[order], end[order]
    found = np.flatnonzero((clip[:-1] == clip[1:]) & (end[:-1] - start[1:] > slack))
    n = places(clip[found])
    found, n = found[n <= most], n[n <= most]
    return clip[found], n + 1, [f"{e}-{s}" if k < most else "suppressed" for k, e, s in zip(n.tolist(), end[found].tolist(), start[found + 1].tolist(), strict=True)]


def _dialogue(*clips: Any) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    x = ClipWords(*clips)
    at, until = x.slots
    return x.clip[at], x.i[at], together("Dialogue: 0,", clocks(x.start[at]), ",", clocks(until[at]), ",Cap,,0,0,0,,", *x.marked(at))


SUBTITLES = "i long, line string", _dialogue


def subtitles_of_clips(docs: DataFrame, clips: DataFrame) -> DataFrame:
    """subtitle_lines of events_of_clips, in a document's row."""
    return rows_of_clips(docs, clips, *SUBTITLES)


def _files(*clips: Any) -> tuple[np.ndarray, pa.Array]:
    clip, _, lines = _dialogue(*clips)
    first = np.flatnonzero(np.diff(clip, prepend=-1))
    own = pa.LargeListArray.from_arrays(pa.array(np.append(first, len(clip))), lines)
    return clip[first], together("\ufeff" + HEADER, pc.binary_join(own, pa.scalar("\n", pa.large_string())), "\n")


FILES = "content string", _files


def files_of_clips(docs: DataFrame, clips: DataFrame) -> DataFrame:
    """subtitle_files of subtitles_of_clips, in a document's row: a clip's file is put together where its words are."""
    return rows_of_clips(docs, clips, *FILES)


def times_of(lines: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The lines that parse_subtitles keeps, and their start_ms and end_ms. Times are fields of a line, of which many are equal: each is read once."""
    parts = pc.split_pattern(lines, ",", max_splits=3)
    n = np.diff(parts.offsets.to_numpy())
    at = np.flatnonzero(n == 4)
    first = parts.offsets.to_numpy()[at]
    there, found = np.ones(len(at), bool), []
    for k, read in enumerate((_read_kind, _read_time, _read_time)):
        own = parts.values.take(pa.array(first + k)).dictionary_encode()
        value = np.array(list(map(read, own.dictionary.to_pylist())), np.int64)[own.indices.to_numpy()]
        there &= value >= 0
        found.append(value)
    return at[there], found[1][there], found[2][there]


def _read_kind(text: str) -> int:
    """0 for what a line of subtitle_lines begins with, else -1."""
    return 0 if DIALOGUE_KIND.fullmatch(text) else -1


def _read_time(text: str) -> int:
    """Milliseconds of a time; -1 of anything else."""
    m = DIALOGUE_TIME.fullmatch(text)
    if not m:
        return -1
    hours, minutes, seconds, hundredths = map(int, m.groups())
    return ((hours * 60 + minutes) * 60 + seconds) * 1000 + hundredths * 10


def _read_back(*clips: Any) -> tuple:
    clip, i, lines = _dialogue(*clips)
    at, start, end = times_of(lines)
    return clip[at], i[at], start, end


#: parse_subtitles of subtitles_of_clips: lines are read where they are made.
READ_BACK = "i long, start_ms long, end_ms long", _read_back


def caption_lines(words: DataFrame, key: list[str] = KEY) -> DataFrame:
    """Adds line and text, the line with this word marked: a fold over a clip's few hundred words with the open line's size, length and last word as state.

    Of words (key, i, w, s_ms, e_ms) repeated ones are words of the line as well; null keys are a clip like others.
    """
    item = F.struct("i", "w", "s_ms", "e_ms")
    start = F.expr("named_struct('n', 0, 'chars', 0, 'line', -1L, 'e', 0L, 'stop', false, 'out', cast(array() as array<bigint>))")

    def step(s: Column, x: Column) -> Column:
        size = F.char_length(x["w"])
        new = (s["n"] == 0) | (x["s_ms"] - s["e"] > LINE_PAUSE) | (s["n"] >= LINE_WORDS) | (s["chars"] + 1 + size > LINE_CHARS) | (s["stop"] & (s["n"] >= 2))
        line = F.when(new, s["line"] + 1).otherwise(s["line"])
        return F.struct(
            F.when(new, 1).otherwise(s["n"] + 1).alias("n"), F.when(new, size).otherwise(s["chars"] + 1 + size).alias("chars"), line.alias("line"), x["e_ms"].alias("e"), x["w"].rlike('[.!?,]"*$').alias("stop"), F.concat(s["out"], F.array(line)).alias("out")
        )

    g = words.groupBy(*key).agg(F.array_sort(F.collect_list(item)).alias("ws"))
    lined = bound(F.col("ws"), lambda ws: F.zip_with(ws, F.aggregate(ws, start, step)["out"], lambda x, n: F.struct(*(x[c].alias(c) for c in ("i", "w", "s_ms", "e_ms")), n.alias("line"))))
    # A line's words are gathered once, LINE_WORDS at most; rows are dealt by the clip already.
    line = Window.partitionBy(*key, "line").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    own = F.collect_list(F.struct("i", subtitle_text(F.col("w")).alias("w"))).over(line)
    rows = unpacked(g, key, lined, "line").withColumn("_own", own)
    return rows.withColumn("text", F.array_join(F.transform("_own", lambda x: F.concat(F.when(x["i"] == F.col("i"), MARKED).otherwise(PLAIN), x["w"])), " ")).drop("_own")


def caption_events(lined: DataFrame, key: list[str] = KEY) -> DataFrame:
    """A slot for each word: to the next word of its line, else its end; then cut at the next slot, too short ones stretched or dropped."""
    line = Window.partitionBy(*key, "line").orderBy("i")
    slots = lined.withColumn("end_ms", F.coalesce(F.lead("s_ms").over(line), F.col("e_ms")))
    after = F.lead("s_ms").over(Window.partitionBy(*key).orderBy("s_ms", "i"))
    cut = slots.withColumn("_next", after).withColumn("end_ms", F.least("end_ms", F.coalesce("_next", "end_ms")))
    short = F.col("end_ms") - F.col("s_ms") < SHORTEST
    cut = cut.filter(~short | F.col("_next").isNull() | (F.col("_next") - F.col("s_ms") >= SHORTEST))
    return cut.select(*key, "line", "i", "w", F.col("s_ms").alias("start_ms"), F.when(short, F.col("s_ms") + SHORTEST).otherwise(F.col("end_ms")).alias("end_ms"), "text")


def overlap_flags(events: DataFrame, key: list[str], slack: int = 11, most: int = 3) -> DataFrame:
    """The first `most` neighbours of each key that overlap by more than slack, and a row that says more were suppressed."""
    w = Window.partitionBy(*key).orderBy("start_ms", "end_ms")
    found = events.withColumn("_next", F.lead("start_ms").over(w)).filter(F.col("end_ms") - F.col("_next") > slack)
    found = found.withColumn("n", F.row_number().over(w).cast("long")).filter(F.col("n") <= most + 1)
    return found.select(*key, "n", F.when(F.col("n") > most, F.lit("suppressed")).otherwise(F.concat_ws("-", "end_ms", "_next")).alias("flag"))


#: How a subtitle renderer is told to mark a word, and to end that.
MARKED, PLAIN = "{\\c&H00E5FF&\\fscx108\\fscy108}", "{\\c&HFFFFFF&\\fscx100\\fscy100}"


def clock(ms: Column) -> Column:
    """h:mm:ss.cc, hundredths rounded half to even."""
    cs = F.bround(ms / 10.0, 0).cast("long")
    return F.format_string("%d:%02d:%02d.%02d", F.floor(cs / 360000), F.floor(cs / 6000) % 60, F.floor(cs / 100) % 60, cs % 100)


def clock_of(cs: int) -> str:
    """clock, of hundredths."""
    return f"{cs // 360000}:{cs // 6000 % 60:02d}:{cs // 100 % 60:02d}.{cs % 100:02d}"


def clocks(ms: np.ndarray) -> pa.Array:
    """clock, of many times, each of them once."""
    cs = pa.array(np.rint(ms / 10).astype(np.int64)).dictionary_encode()
    return pa.array(list(map(clock_of, cs.dictionary.to_pylist())), pa.large_string()).take(cs.indices)


def seconds_clock(seconds: Column) -> Column:
    s = seconds.cast("long")
    return F.format_string("%d:%02d:%02d", F.floor(s / 3600), F.floor(s / 60) % 60, s % 60)


def subtitle_text(w: Column) -> Column:
    """Braces and backslashes that a subtitle renderer would act on, replaced."""
    return F.translate(w, "{}\\", "()/")


def subtitle_lines(events: DataFrame, key: list[str] = KEY) -> DataFrame:
    return events.select(*key, "i", F.concat(F.lit("Dialogue: 0,"), clock(F.col("start_ms")), F.lit(","), clock(F.col("end_ms")), F.lit(",Cap,,0,0,0,,"), F.col("text")).alias("line"))


#: The head of a subtitle file.
HEADER = """[Script Info]
ScriptType: v4.00+
PlayResX: 1080
PlayResY: 1920
WrapStyle: 2
ScaledBorderAndShadow: yes

[V4+ Styles]
Format: Name, Fontname, Fontsize, PrimaryColour, SecondaryColour, OutlineColour, BackColour, Bold, Italic, Underline, StrikeOut, ScaleX, ScaleY, Spacing, Angle, BorderStyle, Outline, Shadow, Alignment, MarginL, MarginR, MarginV, Encoding
Style: Cap,Arial,78,&H00FFFFFF,&H00FFFFFF,&H00101010,&H96000000,-1,0,0,0,100,100,1,0,1,6,2,2,60,60,500,1

[Events]
Format: Layer, Start, End, Style, Name, MarginL, MarginR, MarginV, Effect, Text
"""


def subtitle_files(lines: DataFrame, key: list[str] = KEY) -> DataFrame:
    """key and content: the whole subtitle file of a clip, with a byte order mark, the header and its lines in order."""
    own = lines.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("i", "line"))).alias("l"))  # a clip's lines
    return own.select(*key, F.concat(F.lit("\ufeff" + HEADER), F.array_join(F.transform("l", lambda x: x["line"]), "\n"), F.lit("\n")).alias("content"))


def write_subtitles(lines: DataFrame, path: str, key: list[str] = KEY) -> None:
    """A folder for each clip, with its subtitle file as text; the commit of Spark's writer makes them appear at once."""
    subtitle_files(lines, key).withColumnRenamed("content", "value").write.partitionBy(*key).option("lineSep", "\n").text(path)


#: A line of subtitle_lines: hours, minutes, seconds and hundredths of its start and of its end.
_TIME = r"(\d+):(\d\d):(\d\d)\.(\d\d)"
DIALOGUE = re.compile(rf"Dialogue: \d+,{_TIME},{_TIME},", re.ASCII)
DIALOGUE_KIND, DIALOGUE_TIME = re.compile(r"Dialogue: \d+", re.ASCII), re.compile(_TIME, re.ASCII)


def parse_subtitles(lines: DataFrame, line: str = "line") -> DataFrame:
    """start_ms and end_ms of Dialogue lines; other lines are dropped."""
    pattern = "^" + DIALOGUE.pattern
    part = lambda k: F.regexp_extract(line, pattern, k).cast("long")
    at = lambda k: ((part(k) * 60 + part(k + 1)) * 60 + part(k + 2)) * 1000 + part(k + 3) * 10
    return lines.filter(F.col(line).rlike(pattern)).withColumns({"start_ms": at(1), "end_ms": at(5)})
