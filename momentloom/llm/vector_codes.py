"""Product quantisation of vectors by Lloyd rounds with Hamerly's bounds, in exact integers.

Vectors become integers and are cut into equal parts; each part position has a codebook. A
row keeps, for each part, its entry, an upper bound of the distance to it and a lower bound of
the distance to every other entry. When entries move, the bounds move with them; only where
they no longer decide strictly is a part held against all entries again. Bounds are
rounded outwards at every step, so a part that is passed over has one nearest entry, and a
tie always ends in the full scan, which takes the lower index.

Rounds are written tables (vectors as integers and their bounds). A round sends its partial
sums, at most parts x entries rows a task, through a shuffle; the codebooks (parts x
entries x values a part, whatever the input) are all that the driver holds.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, release_memory, remove_table

#: Larger integers could overflow the sums of squares.
LARGEST = 1 << 24
#: Rows worked on at once.
ROWS = 4096
#: A label with so large a share of the rows is joined by broadcast; there are at most so many of these.
HEAVY = 1000


def integer_vectors(df: DataFrame, ids: str, vector: str, label: str, scale: int) -> DataFrame:
    """(i, l, x): floor(scale * component) of the rows whose vector is whole and finite."""
    bad = F.exists(vector, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf"))))
    whole = df.filter(F.col(vector).isNotNull()).filter(~F.coalesce(bad, F.lit(False)))
    too_large = F.raise_error(F.lit(f"a vector component is too large: its integer must stay under {LARGEST}"))
    x = F.transform(vector, lambda v: F.when(F.abs(v.cast("double") * scale) < LARGEST, F.floor(v.cast("double") * scale).cast("int")).otherwise(too_large))
    return whole.select(F.col(ids).alias("i"), F.col(label).alias("l"), x.alias("x"))


def up(x: np.ndarray) -> np.ndarray:
    return np.nextafter(x, np.inf)


def down(x: np.ndarray) -> np.ndarray:
    return np.nextafter(x, -np.inf)


def root_below(squared: np.ndarray) -> np.ndarray:
    """No more than the root of exact integers."""
    return down(np.sqrt(np.maximum(down(squared.astype(np.float64)), 0.0)))


def squares(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Squared distances of rows and entries, exact integers (sums stay under 2 ** 53: LARGEST squared times 4 times the values)."""
    if 16 * x.shape[1] * max(int(np.abs(x).max(initial=0)), int(np.abs(book).max(initial=0))) ** 2 < 1 << 53:
        x, book = x.astype(np.float64), book.astype(np.float64)
    return ((x * x).sum(1)[:, None] - 2 * (x @ book.T) + (book * book).sum(1)[None, :]).astype(np.int64)


def to_own(x: np.ndarray, book: np.ndarray, code: np.ndarray) -> np.ndarray:
    d = x - book[code]
    return (d * d).sum(1)


class Books:
    """The codebooks of all part positions: now, and how far their entries lie from those of the round before."""

    def __init__(self, now: np.ndarray, before: np.ndarray | None = None):
        self.now = now  # parts x entries x values
        self.first = before is None
        parts, entries, _ = now.shape
        moved = np.zeros((parts, entries)) if self.first else up(np.sqrt(((now - before) ** 2).sum(2).astype(np.float64)))
        self.moved = up(moved) * (moved > 1e-300)
        # The furthest move among the other entries: the largest of all, or for that entry the second largest.
        order = np.sort(self.moved, 1)
        top = order[:, -1:]
        second = order[:, -2:-1] if entries > 1 else np.zeros((parts, 1))
        self.others = np.where((self.moved == top) & ((self.moved == top).sum(1, keepdims=True) == 1), second, top)
        # A vector nearer to its entry than half the way to the next entry has no other nearest one.
        self.half = np.full((parts, entries), np.inf)
        for p, book in enumerate(now if entries > 1 else ()):
            apart = squares(book, book)
            np.fill_diagonal(apart, np.iinfo(np.int64).max)
            self.half[p] = down(root_below(apart.min(1)) / 2)

    def assign(self, p: int, x: np.ndarray, code: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> int:
        """Brings the codes and bounds of part position p up to date, in place; the number of full scans."""
        book = self.now[p]
        if self.first:
            scan = np.arange(len(x))
        else:
            upper[:] = up(upper + self.moved[p][code])
            lower[:] = down(lower - self.others[p][code])
            bound = np.maximum(lower, self.half[p][code])
            scan = np.flatnonzero(~(upper < bound))
            upper[scan] = up(np.sqrt(up(to_own(x[scan], book, code[scan]).astype(np.float64))))
            scan = scan[~(upper[scan] < bound[scan])]
        if len(scan):
            d = squares(x[scan], book)
            code[scan] = best = d.argmin(1)
            upper[scan] = up(np.sqrt(up(d[np.arange(len(scan)), best].astype(np.float64))))
            d[np.arange(len(scan)), best] = np.iinfo(np.int64).max
            lower[scan] = root_below(d.min(1)) if d.shape[1] > 1 else np.inf
        return len(scan)


def _rows(b: pa.RecordBatch, column: str, width: int, kind: type) -> np.ndarray:
    """A writable matrix of an Arrow column of equal lists."""
    return np.array(b.column(b.schema.get_field_index(column)).flatten().to_numpy(zero_copy_only=False), kind).reshape(b.num_rows, width)


def _lists(matrix: np.ndarray, kind: pa.DataType) -> pa.Array:
    rows, width = matrix.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(0, rows * width + 1, width) if width else np.zeros(rows + 1), pa.int32()), pa.array(matrix.reshape(-1), kind))


STATE = "i {}, l {}, x array<int>, code array<int>, upper array<double>, lower array<double>, scans int"


def _assigned(books, parts: int, dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b: Books = books.value
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                rows = batch.slice(at, ROWS)
                x = _rows(rows, "x", dim, np.int64)
                code, scans = np.zeros((len(x), parts), np.int64), np.zeros(len(x), np.int64)
                upper, lower = np.zeros((len(x), parts)), np.zeros((len(x), parts))
                if not b.first:
                    code, upper, lower = _rows(rows, "code", parts, np.int64), _rows(rows, "upper", parts, np.float64), _rows(rows, "lower", parts, np.float64)
                n = 0
                for p, own in enumerate(np.split(x, parts, 1)):
                    n += b.assign(p, own, code[:, p], upper[:, p], lower[:, p])
                scans[:1] = n
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0), rows.column(1), _lists(x, pa.int32()), _lists(code, pa.int32()), _lists(upper, pa.float64()), _lists(lower, pa.float64()), pa.array(scans, pa.int32())], ["i", "l", "x", "code", "upper", "lower", "scans"]
                )
        release_memory()

    return run


def _sums(parts: int, entries: int, dim: int):
    """A task's (part, code, n, sums of the components), one row an entry that has parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros((parts, entries, dim // parts), np.int64), np.zeros((parts, entries), np.int64)
        for batch in batches:
            x, code = _rows(batch, "x", dim, np.int64), _rows(batch, "code", parts, np.int64)
            for p, own in enumerate(np.split(x, parts, 1)):
                np.add.at(total[p], code[:, p], own)
                count[p] += np.bincount(code[:, p], minlength=entries)
        at = np.argwhere(count)
        yield pa.RecordBatch.from_arrays([pa.array(at[:, 0], pa.int32()), pa.array(at[:, 1], pa.int32()), pa.array(count[count > 0]), _lists(total[count > 0], pa.int64())], ["p", "code", "n", "sums"])

    return run


def _final(books, parts: int, dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = books.value.now
        for batch in batches:
            x, code = _rows(batch, "x", dim, np.int64), _rows(batch, "code", parts, np.int64)
            error = sum((to_own(own, now[p], code[:, p]) for p, own in enumerate(np.split(x, parts, 1))), np.zeros(len(x), np.int64))
            text = [bytes(c).hex() if now.shape[1] <= 256 else "".join(f"{v:04x}" for v in c) for c in code.tolist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(text, pa.string()), pa.array(error, pa.int64())], ["i", "l", "code", "error"])

    return run


def codebooks_text(books: np.ndarray) -> str:
    """All components in decimal, by part, entry and place, joined by commas."""
    return ",".join(map(str, books.reshape(-1).tolist()))


def moved_books(state: DataFrame, now: np.ndarray) -> np.ndarray:
    """Each entry as the floored mean of its parts, unused ones as they are."""
    parts, entries, width = now.shape
    sums = state.select("x", "code").mapInArrow(_sums(parts, entries, parts * width), "p int, code int, n long, sums array<long>")
    sums = sums.groupBy("p", "code").agg(F.sum("n").alias("n"), F.array(*(F.sum(F.get("sums", F.lit(k))) for k in range(width))).alias("sums"))
    after = now.copy()
    for r in sums.collect():  # at most parts x entries rows
        after[r.p, r.code] = np.array(r.sums, np.int64) // r.n
    return after


def vector_codes(df: DataFrame, ids: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024) -> DataFrame:
    """One row per whole vector: ids, code, error, label_error and codebooks_sha256.

    Rows whose vector is null or holds a null or non-finite component go. A codebook starts
    as the parts of the vectors with the entries smallest ids (of all, if there are fewer;
    null ids come last, equal ids in the order of their vectors). error is the squared
    distance, label_error its sum over the rows of an equal label (nulls together); code
    has two hex digits a part (four beyond 256 entries).

    The vectors' length is that of the first of these; a vector of another length stays, with null
    code and error. A length that parts doesn't divide, or a component of 2 ** 24 / scale
    or more, raises. Repeated rows count each. No rows give no rows. Other columns are not read.
    """
    spark = df.sparkSession
    whole = integer_vectors(df, ids, vector, label, scale)
    first = lambda df: df.orderBy(F.col("i").asc_nulls_last(), "x").select("x").limit(entries).collect()
    start = first(whole)
    if not start:
        return whole.select(F.col("i").alias(ids), F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256"))
    dim = len(start[0].x)
    if dim % parts:
        raise ValueError(f"vectors of {dim} components can't be cut into {parts} equal parts")
    fitting = whole.filter(F.size("x") == dim)
    chosen = start if all(len(r.x) == dim for r in start) else first(fitting)
    now = np.array([r.x for r in chosen], np.int64).reshape(len(chosen), parts, dim // parts).transpose(1, 0, 2).copy()
    schema = STATE.format(df.schema[ids].dataType.simpleString(), df.schema[label].dataType.simpleString())
    books, state = Books(now), fitting
    for k in range(rounds + 1):
        sent = spark.sparkContext.broadcast(books)  # parts x entries x values
        older, state = state, materialise(state.mapInArrow(_assigned(sent, parts, dim), schema))
        if k:
            remove_table(older)
        if k < rounds:
            now = moved_books(state, books.now)
            books = Books(now, books.now)
    sent = spark.sparkContext.broadcast(books)
    coded = state.select("i", "l", "x", "code").mapInArrow(_final(sent, parts, dim), f"i {schema.split(',')[0][2:]}, l {df.schema[label].dataType.simpleString()}, code string, error long")
    other = whole.filter(F.size("x") != dim).select("i", "l", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
    coded = materialise(coded.unionByName(other))
    sums = coded.groupBy("l").agg(F.sum("error").alias("label_error"), F.count("*").alias("n"))
    n = coded.count()
    # Labels of a thousandth of the rows or more are at most a thousand: broadcast. No other label is a large group.
    sums = materialise(sums.withColumn("heavy", F.col("n") * HEAVY >= n))
    heavy = F.broadcast(sums.filter("heavy").select(F.col("l").alias("l2"), F.col("label_error").alias("e2"), F.lit(True).alias("hit")))
    light = sums.filter("not heavy").select(F.col("l").alias("l3"), F.col("label_error").alias("e3"))
    found = coded.join(heavy, F.col("l").eqNullSafe(F.col("l2")), "left")
    big, small = found.filter("hit").withColumn("label_error", F.col("e2")), found.filter("hit is null").join(light, F.col("l").eqNullSafe(F.col("l3")), "left").withColumn("label_error", F.col("e3"))
    digest = hashlib.sha256(codebooks_text(books.now).encode()).hexdigest()
    return big.select("i", "code", "error", "label_error").unionByName(small.select("i", "code", "error", "label_error")).select(F.col("i").alias(ids), "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
