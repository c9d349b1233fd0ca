"""Removal of sentences that repeated runs of sentences cover."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import as_texts, materialise, slices

#: A sentence: up to closing punctuation before white space, or up to a line's end; what follows of white space belongs to it.
SENTENCE = re.compile(r"\S(?:[^\n.!?]|[.!?](?!\s))*(?:[.!?](?=\s))?\s*")
#: A sentence of more words is cut; a word of more than four times as many characters counts as several.
LONGEST = 16
#: A cut is where the hash of two words is least among so many words on either side.
REACH = 3
#: So many characters of a word count as a word.
WORD_CHARS = 8
UNIT = re.compile(r"\S+\s*")


def cuts(hashes: list[int]) -> list[int]:
    """Where to cut, decided by the hashes around: behind least ones, then behind the least in what is longer than 2 * REACH + 1.

    Pieces have more than REACH units. Only far from any least one (repeated words) does counting decide.
    """
    n, least = len(hashes), REACH + 1
    ends = [0]
    for k in range(REACH, n - least):
        h = hashes[k]
        if h < min(hashes[k + 1 : k + least]) and h <= min(hashes[k - REACH : k]) and k + 1 - ends[-1] >= least:
            ends.append(k + 1)
    ends.append(n)
    out = []
    todo = list(zip(ends, ends[1:], strict=False))
    while todo:
        a, z = todo.pop()
        if a:
            out.append(a)
        if z - a > 32 * least:
            out += range(a + least, z - least, least)
        elif z - a >= 2 * least:
            own = hashes[a + REACH : z - least]
            k = a + least + own.index(min(own))
            todo += [(a, k), (k, z)]
    return sorted(set(out))


def _units(sentence: str, longest: int) -> list[str]:
    """Words with the white space after them; long ones in pieces whose ends their characters decide."""
    out = []
    for w in UNIT.findall(sentence):
        if len(w) <= 4 * longest:
            out.append(w)
        else:
            at = [0, *cuts([zlib.crc32(w[max(0, k - REACH) : k + 1].lower().encode("utf-8", "replace")) for k in range(len(w))]), len(w)]
            out += [w[a:z] for a, z in zip(at, at[1:], strict=False)]
    return out


def sentences(text: str, longest: int = LONGEST) -> tuple[str, list[str]]:
    """(leading white space, sentences); together they are the text. Long sentences are cut where their words decide."""
    head = text[: len(text) - len(text.lstrip())]
    out = []
    for s in SENTENCE.findall(text[len(head) :]):
        units = _units(s, longest) if len(s) > 2 * longest else ()
        if len(units) <= longest:
            out.append(s)
        else:
            single = [zlib.crc32(u.strip().lower().encode("utf-8", "replace")) for u in units]
            at = [0, *cuts([(x * 0x9E3779B1 ^ y * 0x85EBCA77) & 0xFFFFFFFF for x, y in zip(single, [0, *single], strict=False)]), len(units)]
            out += ["".join(units[a:z]) for a, z in zip(at, at[1:], strict=False)]
    return head, out


def sizes(words: list[list[str]]) -> list[int]:
    """Words of each sentence; long words count by their characters."""
    return [sum([len(w) // WORD_CHARS or 1 for w in x]) for x in words]


def run_ends(size: list[int], run: int, least: int) -> list[int]:
    """For each first sentence the end of the shortest run of at least run sentences that reaches the least size; shorter where none does."""
    out, end, total = [], 0, 0
    for k, own in enumerate(size):
        while end < len(size) and (end - k < run or total < least):
            total += size[end]
            end += 1
        if end - k < run or total < least:
            break
        out.append(end)
        total -= own
    return out


def _runs(run: int, min_words: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "t", 2 << 20):
            row, pos, key = [], [], []
            for r, text in enumerate(as_texts(b.column(2))):
                words = [x.lower().split() for x in sentences(text)[1]]
                flat = [" ".join(x) for x in words]
                for k, end in enumerate(run_ends(sizes(words), run, min_words)):
                    row.append(r)
                    pos.append(k)
                    key.append(xxhash.xxh3_64_intdigest("\n".join(flat[k:end])))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row, pa.int64())), b.column(1).take(pa.array(row, pa.int64())), pa.array(pos, pa.int32()), pa.array(np.array(key, np.uint64).view(np.int64))], ["i", "h", "pos", "run"])

    return work


def _removed(run: int, min_words: int, names: list[str], carried: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "t", 2 << 20):
            total, gone, gone_words, kept, spans = [], [], [], [], []
            for text, starts in zip(as_texts(b.column(1)), b.column(2).to_pylist(), strict=True):
                head, parts = sentences(text)
                ends = run_ends(sizes([x.split() for x in parts]), run, min_words) if starts else ()
                covered = {k for s in starts or () for k in range(s, ends[s])}
                total.append(len(parts))
                gone.append(len(covered))
                gone_words.append(sum(len(parts[k].split()) for k in covered))
                kept.append(head + "".join([x for k, x in enumerate(parts) if k not in covered]) if covered else text)
                first = [k for k in sorted(covered) if k - 1 not in covered]
                ends = [k + 1 for k in sorted(covered) if k + 1 not in covered]
                spans.append([(a, e, "".join(parts[a:e]).strip()) for a, e in zip(first, ends, strict=True)])
            arrays = [pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(gone_words, pa.int64()), pa.array(kept, pa.string())]
            span = pa.array([[{"first": a, "end": e, "text": t} for a, e, t in x] for x in spans], pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32()), ("text", pa.string())])))
            yield pa.RecordBatch.from_arrays([b.column(0), *arrays, span, *(b.column(3 + k) for k in range(carried))], names)

    return work


def dedup_substrings(df: DataFrame, ids: str = "doc_id", text: str = "text", run: int = 3, min_words: int = 1, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of df: the id column, n_sentences, n_removed, removed_words, kept and removed.

    Every run of `run` consecutive sentences is hashed (words in lower case, white space aside); with min_words
    over 1, from every sentence the shortest run of at least `run` that has so many words (long words count by characters), which
    leaves short repeats alone. Of runs that occur more than once, in one
    text or in several, the first by (id, text hash, position) stays; sentences that another
    occurrence covers go. kept is the rest of the text, unchanged where nothing goes;
    removed lists the spans that go (first and end as sentence numbers, and the text).
    Null and empty texts have no sentences and are kept as empty; rows that agree in id and
    text are one text, treated alike; null ids sort first. Columns named in keep come along, others are not read.

    Counts are combined before the shuffle, so a passage that a third of all rows hold
    costs a row for each task; the occurrences of repeated runs meet the counts in joins that
    adaptive execution can split. Runs are compared by 64-bit hashes.
    """
    base = df.select(F.col(ids).alias("i"), F.col(text).cast("string").alias("t"), *(F.col(c).alias(f"x{k}") for k, c in enumerate(keep))).withColumn("h", F.xxhash64("t"))
    kind = df.schema[ids].dataType
    schema = T.StructType([T.StructField("i", kind), T.StructField("h", T.LongType()), T.StructField("pos", T.IntegerType()), T.StructField("run", T.LongType())])
    # Written once: the runs are counted, and those of repeated ones are read again.
    runs = materialise(base.select("i", "h", "t").mapInArrow(_runs(run, min_words), schema))
    often = runs.groupBy("run").agg(F.count("*").alias("c")).filter("c > 1").select("run")
    repeated = materialise(runs.join(often, "run"))
    first = repeated.groupBy("run").agg(F.min(F.struct("i", "h", "pos")).alias("f")).select("run", F.col("f.i").alias("fi"), F.col("f.h").alias("fh"), F.col("f.pos").alias("fp"))
    later = repeated.join(first, "run").filter(~(F.col("i").eqNullSafe(F.col("fi")) & (F.col("h") == F.col("fh")) & (F.col("pos") == F.col("fp"))))
    starts = later.groupBy("i", "h").agg(F.collect_set("pos").alias("starts")).select(F.col("i").alias("i2"), F.col("h").alias("h2"), "starts")
    joined = base.join(starts, F.col("i").eqNullSafe(F.col("i2")) & (F.col("h") == F.col("h2")), "left").select("i", "t", "starts", *(f"x{k}" for k in range(len(keep))))
    span = T.StructType([T.StructField("first", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("text", T.StringType())])
    names = [ids, "n_sentences", "n_removed", "removed_words", "kept", "removed", *keep]
    out = T.StructType([T.StructField(ids, kind), *(T.StructField(x, T.LongType()) for x in names[1:4]), T.StructField("kept", T.StringType()), T.StructField("removed", T.ArrayType(span)), *(T.StructField(c, df.schema[c].dataType) for c in keep)])
    return joined.mapInArrow(_removed(run, min_words, names, len(keep)), out)
