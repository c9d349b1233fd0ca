"""Timed text: sentences, words and segments of documents, windows over segments, ranking.

Null and empty texts have no sentences and so no rows; repeated rows give rows of their own up to
the windows, and count as windows of one document where windows are ranked or suppressed by doc_id. A null
doc_id is a document like others. Other columns of documents are not read.
"""

from __future__ import annotations

import itertools
import operator
import re
from collections.abc import Callable, Iterable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Milliseconds: a word's step and length, what a sentence adds, and what every other sentence adds.
WORD_STEP, WORD_LENGTH, SENTENCE_GAP, PAIR_GAP = 350, 250, 100, 500
#: Milliseconds: distance of seeds, least and most length of a window, a pause that ends one.
SEED_STEP, WINDOW_LEAST, WINDOW_MOST, PAUSE = 25_000, 75_000, 100_000, 300
#: Share of the union, in tenths, that two kept windows may have in common.
MOST_OVERLAP_TENTHS = 3
SENTENCE_END = r"(?<=[.!?])\s+"
TERMINAL = r"[.!?…][\"'”’)]?$"
#: The same at a word's end; words are what white space of Java's patterns leaves, and the next sentence begins behind one that ends so.
TERMINAL_WORD, WORD, WHITE, STOPS = re.compile(r"[.!?…][\"'”’)]?\Z"), re.compile(r"[^ \t-\r]+"), re.compile(r"[ \t-\r]"), frozenset(".!?")


def sentences(text: Column) -> Column:
    """Sentences end at . ! or ? before white space; blank ones are dropped."""
    return F.filter(F.split(text, SENTENCE_END), lambda s: F.trim(F.regexp_replace(s, r"\s+", " ")) != "")


def words_of(sentence: Column) -> Column:
    return F.filter(F.split(sentence, r"\s+"), lambda w: w != "")


def unpacked(df: DataFrame, key: list[str], array: Column, field: str) -> DataFrame:
    """key and the fields of an array's structs, a row each; field is null in none of them.

    The outer form, as the plain one makes the optimizer test the array's size below, where it works the array out once more.
    """
    return df.select(*key, F.inline_outer(array)).filter(F.col(field).isNotNull())


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value worked out once: a column that is named in a lambda is put in its place and worked out at every step."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


#: Bytes of text that a task works on at once.
SLICE = 2 << 20
SPARK_KINDS = {"long": T.LongType(), "double": T.DoubleType(), "boolean": T.BooleanType(), "string": T.StringType()}
KINDS = {"long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string()}


def cut_by_size(batch: pa.RecordBatch, sizes: np.ndarray, limit: int = SLICE) -> Iterator[pa.RecordBatch]:
    """A batch in slices of about limit bytes, by the sizes of its rows; a row at least."""
    part = np.cumsum(sizes) // limit
    edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for a, z in itertools.pairwise(edges):
        if z > a:
            yield batch.slice(a, z - a)


def column(values: Any, kind: str) -> pa.Array:
    """A list, a numpy array or an Arrow array as an Arrow array of this kind."""
    return values.cast(KINDS[kind]) if isinstance(values, pa.Array) else pa.array(values, KINDS[kind])


def joined(parts: list[Any], kind: pa.DataType) -> pa.Array:
    """Lists or numpy arrays, one after the other, as an Arrow array."""
    if parts and isinstance(parts[0], np.ndarray):
        return pa.array(np.concatenate(parts)).cast(kind)
    return pa.array(list(itertools.chain.from_iterable(parts)), kind)


def rows_of_texts(df: DataFrame, keep: list[str], fields: str, make: Callable[..., Iterable], text: str = "text", others: tuple[str, ...] = ()) -> DataFrame:
    """Rows that follow from a text: the columns keep of its row, and fields ("name kind, ...").

    make(text, *others) gives the fields' columns, lists or numpy arrays of one length. Nothing is
    shuffled, and a task holds the rows of a few MB of text at a time.
    """
    names, kinds = zip(*(x.split() for x in fields.split(", ")), strict=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in cut_by_size(batch, np.asarray(pc.fill_null(pc.binary_length(batch.column(len(keep))), 0))):
                made = [tuple(make(*x)) for x in zip(*(c.to_pylist() for c in b.columns[len(keep) :]), strict=True)]
                at = pa.array(np.repeat(np.arange(len(made)), [len(x[0]) for x in made]))
                columns = [joined([x[k] for x in made], KINDS[kind]) for k, kind in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays([*(c.take(at) for c in b.columns[: len(keep)]), *columns], [*keep, *names])

    schema = T.StructType([df.schema[c] for c in keep] + [T.StructField(n, SPARK_KINDS[k]) for n, k in zip(names, kinds, strict=True)])
    return df.select(*keep, df[text].cast("string").alias("_text"), *others).mapInArrow(run, schema)


def timed(text: str | None) -> tuple[list[str], np.ndarray, np.ndarray]:
    """A text's words, the number of each one's sentence, and when it starts (ms).

    A sentence ends with a word that ends in a stop, so that every sentence has words.
    """
    words = WORD.findall(text or "")
    stops = np.fromiter(map(STOPS.__contains__, map(operator.itemgetter(-1), words)), np.int64, len(words))
    j = np.cumsum(stops) - stops
    return words, j, np.arange(len(words)) * WORD_STEP + j * SENTENCE_GAP + j // 2 * PAIR_GAP


def timed_words(docs: DataFrame) -> DataFrame:
    """doc_id, k (word number), j (sentence number), w, s_ms, e_ms. Without a shuffle: a row's words are numbered in the row. Null and empty texts have none; repeated rows stay apart."""

    def words(text: str | None) -> Iterable:
        own, j, start = timed(text)
        return np.arange(len(own)), j, own, start, start + WORD_LENGTH

    return rows_of_texts(docs, ["doc_id"], "k long, j long, w string, s_ms long, e_ms long", words)


def sentence_places(words: list[str], j: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of each sentence of timed words: its first word and the one behind its last, start_ms, end_ms, gap_ms and natural.

    Only a text's last sentence may end without a stop.
    """
    first = np.flatnonzero(np.diff(j, prepend=-1))
    end = np.append(first[1:], len(words)) if len(first) else first
    starts, ends = at[first], at[end - 1] + WORD_LENGTH
    gap = np.append(starts[1:] - ends[:-1], 999_000)[: len(first)]
    natural = gap >= PAUSE
    natural[-1:] &= TERMINAL_WORD.search(words[-1] if words else "") is not None
    return first, end, starts, ends, gap, natural


def sentence_columns(text: str | None) -> tuple[Any, ...]:
    """Columns j, start_ms, end_ms, n_words, text, gap_ms and natural of a text's sentences."""
    words, j, at = timed(text)
    first, end, starts, ends, gap, natural = sentence_places(words, j, at)
    texts = [" ".join(words[a:z]) for a, z in zip(first.tolist(), end.tolist(), strict=True)]
    return np.arange(len(first)), starts, ends, end - first, texts, gap, natural


#: What segs holds of a sentence.
SEGMENT = "j long, start_ms long, end_ms long, n_words long, text string, gap_ms long, natural boolean"


def segment_arrays(docs: DataFrame) -> DataFrame:
    """docs with segs: the sentences that have words as structs j, start_ms, end_ms, n_words, text, gap_ms, natural (see with_gaps).

    All of it within a document's row, without a shuffle. Null and empty texts have an empty array.
    """
    fields = [x.split() for x in SEGMENT.split(", ")]
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in cut_by_size(batch, np.asarray(pc.fill_null(pc.binary_length(batch.column(at)), 0))):
                made = [sentence_columns(x) for x in b.column(at).to_pylist()]
                inner = pa.StructArray.from_arrays([joined([x[k] for x in made], KINDS[kind]) for k, (_, kind) in enumerate(fields)], [n for n, _ in fields])
                edges = pa.array(np.cumsum([0, *(len(x[0]) for x in made)]), pa.int32())
                yield pa.RecordBatch.from_arrays([*b.columns, pa.ListArray.from_arrays(edges, inner)], [*b.schema.names, "segs"])

    own = docs.withColumn("text", F.col("text").cast("string"))
    segment = T.StructType([T.StructField(n, SPARK_KINDS[k]) for n, k in fields])
    return own.mapInArrow(run, T.StructType([*own.schema.fields, T.StructField("segs", T.ArrayType(segment))]))


def timed_segments(docs: DataFrame) -> DataFrame:
    """doc_id, j, start_ms, end_ms, n_words, text: a row for each sentence with words, times from its words' numbers."""
    return unpacked(segment_arrays(docs), ["doc_id"], F.col("segs"), "j").drop("gap_ms", "natural")


def with_gaps(segments: DataFrame) -> DataFrame:
    """Adds gap_ms to the next segment (999 s after the last), and natural: terminal punctuation and a pause."""
    w = Window.partitionBy("doc_id").orderBy("j")
    gap = F.coalesce(F.lead("start_ms").over(w) - F.col("end_ms"), F.lit(999_000))
    return segments.withColumn("gap_ms", gap).withColumn("natural", F.col("text").rlike(TERMINAL) & (F.col("gap_ms") >= PAUSE))


def gathered(segments: DataFrame) -> DataFrame:
    """Segments that come as rows, one row a document: doc_id and segs in order."""
    return with_gaps(segments).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("j", "start_ms", "end_ms", "natural", "text"))).alias("segs"))


def seed_places(starts: list[int]) -> list[int]:
    """Positions of seeds: the first segment, then each that starts SEED_STEP or more after the last seed."""
    out, last = [], -SEED_STEP
    for k, start in enumerate(starts):
        if start - last >= SEED_STEP:
            out.append(k)
            last = start
    return out


def of_arrays(arrays: DataFrame, keep: list[str], fields: str, make: Callable[[dict[str, Any]], Iterable], names: tuple[str, ...]) -> DataFrame:
    """Rows (keep and fields) that follow from the segs of each row: make gets the named parts of its segments, numbers as numpy arrays and texts as lists."""
    out, kinds = zip(*(x.split() for x in fields.split(", ")), strict=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = batch.column(len(keep))
            ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(whole.values.field("text")), 0))) if "text" in names else np.arange(1, len(whole.values) + 1) * 8
            sizes = np.diff(np.append(0, ends)[whole.offsets.to_numpy()])
            for b in cut_by_size(batch, sizes):
                segs = b.column(len(keep))
                edges = segs.offsets.to_numpy()
                values = segs.values.slice(edges[0], edges[-1] - edges[0])
                edges = (edges - edges[0]).tolist()
                parts = {n: values.field(n).to_pylist() if n == "text" else pc.fill_null(values.field(n), False if n == "natural" else 0).to_numpy(zero_copy_only=False) for n in names}
                made = [tuple(make({n: x[a:z] for n, x in parts.items()})) for a, z in itertools.pairwise(edges)]
                at = pa.array(np.repeat(np.arange(len(made)), [len(x[0]) for x in made]))
                columns = [joined([x[k] for x in made], KINDS[kind]) for k, kind in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays([*(c.take(at) for c in b.columns[: len(keep)]), *columns], [*keep, *out])

    own = arrays.select(*keep, F.coalesce(F.transform("segs", lambda x: F.struct(*(x[n].alias(n) for n in names))), F.array()).alias("segs"))
    schema = T.StructType([arrays.schema[c] for c in keep] + [T.StructField(n, SPARK_KINDS[k]) for n, k in zip(out, kinds, strict=True)])
    return own.mapInArrow(run, schema)


def seed_starts(arrays: DataFrame) -> DataFrame:
    def seeds(x: dict[str, Any]) -> Iterable:
        at = np.array(seed_places(x["start_ms"].tolist()), np.int64)
        return x["j"][at], x["start_ms"][at]

    return of_arrays(arrays, ["doc_id"], "j long, start_ms long", seeds, ("j", "start_ms"))


def window_places(j: np.ndarray, start: np.ndarray, end: np.ndarray, natural: np.ndarray) -> list[tuple[int, int, int]]:
    """(first, last, end) of windows in a document's segments: from each seed to the last natural end within bounds, else the last end within bounds; its texts are those from first up to end.

    A window holds at most WINDOW_MOST / WORD_STEP segments with a word each. Segment ends do not decrease within a document.
    """
    most = WINDOW_MOST // WORD_STEP + 2
    at = np.array(seed_places(start.tolist()), np.int64)
    low = np.maximum(np.searchsorted(end, start[at] + WINDOW_LEAST, "left"), at)
    high = np.minimum(np.searchsorted(end, start[at] + WINDOW_MOST, "right"), at + most)
    stops = np.append(-1, np.flatnonzero(natural))
    stop = stops[np.searchsorted(stops, high, "left") - 1]
    last = np.where(stop >= low, stop, high - 1)
    upto = np.minimum(np.searchsorted(j, j[np.maximum(last, 0)], "right"), at + most) if len(at) else at
    there = high > low
    return list(zip(at[there].tolist(), last[there].tolist(), upto[there].tolist(), strict=True))


def candidate_windows(arrays: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the columns named in keep, j0, j1, start_ms, end_ms, natural, text: a row for each window (see window_places) of documents with segs (segment_arrays or gathered)."""

    def windows(x: dict[str, Any]) -> Iterable:
        found = window_places(x["j"], x["start_ms"], x["end_ms"], x["natural"])
        first, last = (np.array([w[k] for w in found], np.int64) for k in range(2))
        texts = [" ".join(t for t in x["text"][a:z] if t is not None) for a, _, z in found]
        return x["j"][first], x["j"][last], x["start_ms"][first], x["end_ms"][last], x["natural"][last], texts

    return of_arrays(arrays, ["doc_id", *keep], "j0 long, j1 long, start_ms long, end_ms long, natural boolean, text string", windows, ("j", "start_ms", "end_ms", "natural", "text"))


def with_target(arrays: DataFrame) -> DataFrame:
    """Adds duration_ms, the end of a document's last segment, and target, the windows that it is to give; both are null without segments."""
    last = F.get("segs", F.size("segs") - 1)["end_ms"]
    return arrays.withColumn("duration_ms", last).withColumn("target", F.when(last.isNotNull(), target_count(last)))


def target_count(duration_ms: Column) -> Column:
    """Windows wanted: 0.4 a minute, halves to even, from 4 to 60."""
    return F.least(F.greatest(F.bround(duration_ms / 60_000.0 * 0.4, 0).cast("long"), F.lit(4)), F.lit(60))


def overlaps_too_much(a: Column, b: Column) -> Column:
    """Whether intervals share more than MOST_OVERLAP_TENTHS tenths of their union, in integers."""
    common = F.greatest(F.least(a["end_ms"], b["end_ms"]) - F.greatest(a["start_ms"], b["start_ms"]), F.lit(0))
    union = (a["end_ms"] - a["start_ms"]) + (b["end_ms"] - b["start_ms"]) - common
    return 10 * common > MOST_OVERLAP_TENTHS * union


def interval_pairs(windows: DataFrame) -> DataFrame:
    """Pairs of a document's windows that overlap, with the common and joint length.

    Windows are dealt into time bins of the longest length, so that the join has an
    equality; a pair is taken in the first bin that both touch.
    """
    bins = F.sequence(F.expr(f"start_ms div {WINDOW_MOST}"), F.expr(f"end_ms div {WINDOW_MOST}"))
    w = windows.select("doc_id", "j0", "start_ms", "end_ms", F.explode(bins).alias("bin"))
    o = w.select("doc_id", "bin", F.col("j0").alias("k0"), F.col("start_ms").alias("s2"), F.col("end_ms").alias("e2"))
    common = F.least("end_ms", "e2") - F.greatest("start_ms", "s2")
    p = w.join(o, ["doc_id", "bin"]).filter((F.col("j0") < F.col("k0")) & (common > 0) & (F.expr(f"greatest(start_ms, s2) div {WINDOW_MOST}") == F.col("bin")))
    return p.select("doc_id", "j0", "k0", common.alias("common_ms"), (F.col("end_ms") - F.col("start_ms") + F.col("e2") - F.col("s2") - common).alias("union_ms"))


def suppress_overlaps(windows: DataFrame, score: str = "score") -> DataFrame:
    """Greedy non-maximum suppression: by score from the top (then start, then j0) a window is kept if it overlaps no kept one too much.

    A fold over the sorted windows of one document, whose number is bounded by its seeds.
    """
    item = F.struct((-F.col(score)).alias("neg"), "start_ms", "j0", "end_ms", F.struct(*[c for c in windows.columns if c != "doc_id"]).alias("row"))
    kind = windows.select(item.alias("x")).schema["x"].dataType.simpleString()
    start = F.expr(f"cast(array() as array<{kind}>)")
    kept = F.aggregate(F.array_sort(F.collect_list(item)), start, lambda acc, x: F.when(F.exists(acc, lambda k: overlaps_too_much(k, x)), acc).otherwise(F.concat(acc, F.array(x))))
    return windows.groupBy("doc_id").agg(kept.alias("kept")).select("doc_id", F.explode("kept").alias("x")).select("doc_id", "x.row.*")


def drop_weak_tail(windows: DataFrame, score: str = "score", least_score: float = 35.0, least: int = 4) -> DataFrame:
    """Windows of least_score or more, if at least min(all, least) are left; else all."""
    w = Window.partitionBy("doc_id")
    strong = F.count_if(F.col(score) >= least_score).over(w)
    return windows.withColumn("_strong", strong).withColumn("_all", F.count("*").over(w)).filter((F.col(score) >= least_score) | (F.col("_strong") < F.least("_all", F.lit(least)))).drop("_strong", "_all")


def ranked(windows: DataFrame, score: str = "score") -> DataFrame:
    return windows.withColumn("rank", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc(score), "start_ms", "j0")).cast("long"))
