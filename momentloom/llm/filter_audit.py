"""Audit of filters that overlap: what each removes in every order, and its Shapley share.

A document fails some of the five filters A to E; the set is a mask of five bits. All
figures of a part follow from how many documents have each of its 32 masks, so texts are
read once and what meets are counts.

The removal polynomial of a part is the multilinear extension of "documents removed by a set
of filters": with x_f the share in which filter f is applied,
    r(x) = sum over masks m of n_m * (1 - product of (1 - x_f) over f in m).
At a corner (every x_f 0 or 1) it is what that set of filters removes. The Shapley value of a
filter is the integral over t of its partial derivative at (t, ..., t).
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from itertools import permutations
from math import factorial

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise

FILTERS = "ABCDE"
ORDERS = tuple("".join(p) for p in permutations(FILTERS))
#: The last filter's bit; the others are told from a row's own text.
COPY = 1 << FILTERS.index("E")
#: Spread of rows without an id over the tasks of the join with labels.
SALTS = 64


def words_of(text: Column) -> Column:
    """The maximal runs of what is not ASCII white space."""
    return F.array_remove(F.split(F.translate(text, "\t\n\x0b\x0c\r", "     "), " ", -1), "")


def text_masks(df: DataFrame, text: str, mask: str) -> DataFrame:
    """df with the column mask: bits of the filters A to D that the text fails. Null counts as empty."""
    t = F.coalesce(F.col(text), F.lit(""))
    measured = df.withColumn(mask, F.struct(words_of(t).alias("words"), F.char_length(t).alias("chars"), F.regexp_count(t, F.lit("[A-Z]")).alias("capitals"), t.rlike(r"[#$%&*|]").alias("signs")))
    m = F.col(mask)
    measured = measured.withColumn(mask, F.struct(F.size(m["words"]).alias("n"), F.size(F.array_distinct(m["words"])).alias("distinct"), m["chars"].alias("chars"), m["capitals"].alias("capitals"), m["signs"].alias("signs")))
    fails = [m["n"] < 100, 100 * m["distinct"] < 80 * m["n"], 100 * m["capitals"].cast("long") > 10 * m["chars"].cast("long"), m["signs"]]
    return measured.withColumn(mask, sum((F.when(f, 1 << k).otherwise(0) for k, f in enumerate(fails)), F.lit(0)))


def removal_polynomial(counts: list[int]) -> list[int]:
    """Coefficients by monomial (a mask of the filters whose x it holds) of r(x), from counts by mask."""
    out = [0] * len(counts)
    for s in range(1, len(counts)):
        out[s] = (-1) ** (s.bit_count() + 1) * sum(n for m, n in enumerate(counts) if m & s == s)
    return out


def at_corner(polynomial: list[int], chosen: int) -> int:
    """The polynomial where x is 1 for the filters of the mask chosen and 0 for the others."""
    return sum(a for s, a in enumerate(polynomial) if s & ~chosen == 0)


def partial_on_diagonal(polynomial: list[int], which: int) -> list[int]:
    """Coefficients by power of t of the derivative in filter number which, at (t, ..., t)."""
    out = [0] * len(polynomial).bit_length()
    for s, a in enumerate(polynomial):
        if s >> which & 1:
            out[s.bit_count() - 1] += a
    return out


def integral(powers: list[int]) -> Fraction:
    """Over t from 0 to 1, exactly."""
    return sum((Fraction(a, k + 1) for k, a in enumerate(powers)), Fraction(0))


def audit_rows(part: str, counts: list[int], good: list[int], toxic: list[int]) -> list[tuple]:
    """A part's rows for all orders and steps, from its documents by mask: all, those labelled good, and toxic."""
    polynomials = [removal_polynomial(x) for x in (counts, good, toxic)]
    corners = [[at_corner(p, s) for s in range(len(counts))] for p in polynomials]
    total = sum(counts)
    shapley = [integral(partial_on_diagonal(polynomials[0], k)) * factorial(len(FILTERS)) for k in range(len(FILTERS))]
    assert all(x.denominator == 1 for x in shapley)
    rows = []
    for order in ORDERS:
        before = 0
        for step, letter in enumerate(order, 1):
            k = FILTERS.index(letter)
            after = before | 1 << k
            removed, good_lost, toxic_lost = (c[after] - c[before] for c in corners)
            fails = corners[0][1 << k]
            unique = corners[0][-1] - corners[0][len(counts) - 1 & ~(1 << k)]
            rows.append((part, order, step, total - corners[0][after], removed, fails - removed, unique, good_lost, toxic_lost, int(shapley[k])))
            before = after
    return rows


AUDIT = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def _audit(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [x.split()[0] for x in AUDIT.split(", ")]
    for frame in frames:
        for part, cells in zip(frame["part"], frame["cells"], strict=True):
            by = {c["mask"]: c for c in cells}
            counts = [[int(by[m][x]) if m in by else 0 for m in range(1 << len(FILTERS))] for x in ("n", "good", "toxic")]
            yield pd.DataFrame(audit_rows(part, *counts), columns=names)


def mask_counts(df: DataFrame, labels: DataFrame, ids: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """(part, mask, n, good, toxic): documents of each part by the filters they fail, all and those labelled so.

    Filter E fails where the same text stands under a smaller id anywhere in the table.
    Rows of one id and text are as many documents and don't make each other copies; a row
    without an id has no smaller one and is none for others, and has no label. An id that
    labels names twice has what either row says; null labels say nothing.

    Rows are a few numbers once the texts are read. Copies are combined before every
    shuffle: a text or an id that a third of all rows hold costs a row a task.
    """
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    base = df.select(F.col(ids).alias("i"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("p"), t.alias("t"))
    own = text_masks(base, "t", "m").select("i", "p", "m", F.xxhash64("t").alias("h1"), F.xxhash64(F.lit(1), "t").alias("h2"))
    own = own.groupBy("i", "p", "m", "h1", "h2").agg(F.count("*").alias("n"))
    said = labels.filter(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("i"))
    said = said.agg(F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"), F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("bad")).withColumn("salt", F.lit(0))
    # Null ids match nothing; the salt spreads them over the join's tasks.
    own = own.withColumn("salt", F.when(F.col("i").isNull(), F.pmod("h1", F.lit(SALTS)).cast("int")).otherwise(0))
    own = own.join(said, ["i", "salt"], "left").select("i", "p", "m", "h1", "h2", "n", *((F.col("n") * F.coalesce(x, F.lit(0))).alias(x) for x in ("good", "bad")))
    # One row a text and part: all its documents, and those of the smallest id, which is one row of own.
    figures = F.struct("n", "good", "bad")
    texts = own.groupBy("h1", "h2", "m", "p").agg(
        *(F.sum(x).alias(x) for x in ("n", "good", "bad")),
        *(F.coalesce(F.sum(F.when(F.col("i").isNull(), F.col(x))), F.lit(0)).alias(f"{x}_none") for x in ("n", "good", "bad")),
        F.min(F.when(F.col("i").isNotNull(), F.struct("i", figures.alias("f")))).alias("first"),
    )
    texts = materialise(texts)
    least = texts.groupBy("h1", "h2").agg(F.min("first.i").alias("least"))
    texts = texts.join(least, ["h1", "h2"])
    is_first = F.coalesce(F.col("first.i") == F.col("least"), F.lit(False))
    original = F.struct(*((F.col(f"{x}_none") + F.when(is_first, F.col(f"first.f.{x}")).otherwise(0)).alias(x) for x in ("n", "good", "bad")))
    both = texts.withColumn("o", original).select("p", F.explode(F.array(F.struct("m", *(F.col(f"o.{x}").alias(x) for x in ("n", "good", "bad"))), F.struct((F.col("m") + COPY).alias("m"), *((F.col(x) - F.col(f"o.{x}")).alias(x) for x in ("n", "good", "bad"))))).alias("c"))
    return both.groupBy(F.col("p").alias("part"), F.col("c.m").alias("mask")).agg(F.sum("c.n").alias("n"), F.sum("c.good").alias("good"), F.sum("c.bad").alias("toxic"))


def filter_audit(df: DataFrame, labels: DataFrame, ids: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """For each part, all 120 orders of the five filters and every step: what the step's filter does there.

    Columns: part, filter_order, step, kept, removed, redundant, unique_fails, good_lost,
    toxic_lost, shapley (the filter's removed summed over all orders, so 120 times its
    Shapley value). Null and empty parts are one; a table without rows has no parts and no result
    rows; without labels nothing good or toxic is lost. Other columns are not read.
    What reaches a Python worker is one row of at most 32 counts a part.
    """
    cells = mask_counts(df, labels, ids, text, part).groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))
    return cells.mapInPandas(_audit, AUDIT)
