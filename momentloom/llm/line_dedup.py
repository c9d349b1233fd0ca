"""Line dedup across documents, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ASCII_SPACE

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_keys(text: Column) -> Column:
    """The keys of a text's lines: without ASCII white space at both ends, A-Z lower-cased (other letters kept)."""
    ascii_only = F.octet_length(text) == F.char_length(text)
    low = F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.transform(F.split(low, "\n", -1), lambda line: F.trim(line, F.lit(ASCII_SPACE)))


def dedup_lines(df: DataFrame, ids: str = "doc_id", text: str = "text", min_docs: int = 10, min_chars: int = 1, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of df: the id column, n_lines, n_dropped and kept (the text without dropped lines).

    Lines are what \\n separates; a null or empty text is one empty line. A key (see
    line_keys) of min_chars code points or more that min_docs rows hold loses all its
    lines in every row. Every row counts as a document, repeated rows too; null ids are
    ids like others. Keys are compared by two 64-bit hashes. Columns
    named in keep come along under their names; others are not read, so names can't clash.

    Counting takes a document's distinct keys and combines before the shuffle, so a line
    that a third of all rows hold costs a row for each task. Only the positions of dropped
    lines are joined back to the texts, by id and text hash; texts are shuffled once.
    """
    base = df.select(F.col(ids).alias("i"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t"), F.struct(F.lit(0).alias("none"), *(F.col(c) for c in keep)).alias("x"))
    keyed = base.select("i", "x", F.xxhash64("t").alias("h"), F.split("t", "\n", -1).alias("lines"))

    # Keys are exploded before they are hashed: functions of rows are compiled, those inside transform() are not.
    a, b, counts = F.xxhash64("k").alias("a"), F.xxhash64(F.lit(1), "k").alias("b"), F.char_length("k") >= min_chars
    once = base.select(F.explode(F.array_distinct(line_keys(F.col("t")))).alias("k")).filter(counts).select(a, b)
    common = once.groupBy("a", "b").agg(F.count("*").alias("n")).filter(F.col("n") >= min_docs).select("a", "b")
    lines = base.select("i", F.xxhash64("t").alias("h"), F.posexplode(line_keys(F.col("t"))).alias("pos", "k")).filter(counts).select("i", "h", "pos", a, b)
    dropped = lines.join(common, ["a", "b"], "left_semi").groupBy("i", "h").agg(F.collect_set("pos").alias("drop"))
    dropped = dropped.select(F.col("i").alias("i2"), F.col("h").alias("h2"), "drop")
    joined = keyed.join(dropped, F.col("i").eqNullSafe(F.col("i2")) & (F.col("h") == F.col("h2")), "left")
    return joined.select(
        F.col("i").alias(ids),
        F.size("lines").cast("long").alias("n_lines"),
        F.when(F.col("drop").isNull(), 0).otherwise(F.size("drop")).cast("long").alias("n_dropped"),
        F.array_join(
            F.when(F.col("drop").isNull(), F.col("lines")).otherwise(F.transform(F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("drop")), lambda p: F.get("lines", p))), "\n"
        ).alias("kept"),
        *(F.col(f"x.{c}") for c in keep),
    )
