"""Exact Jaccard self-join of documents on word shingles, in size-banded tiles.

A document's set of shingles is hashed to 64-bit values. Sets are dealt into size
bands; within a band (and between neighbours) two sets that reach the threshold differ
in at most d elements. Each set is cut by hash into more than d parts, so two similar
sets agree in a whole part: they meet in that part's tile. Pairs from the tiles are
bounded from above by the bit counts of hashed parity bitmaps, and what passes is
decided by the intersection of the sorted arrays. A bitmap has a bit for each element at
least: in a smaller one every pair of long sets would pass, and their number, each with two
whole sets, grows with the square of the input.

Tiles don't emit their pairs. First every member is compared with its tile's leader, the
member that lies in most tiles of all, and links are contracted to components. Only tiles
that still hold several components go on: their members, in blocks of bounded size, are
held against each other by bit counts, and only pairs of different components that may
link leave the block, to be decided exactly. So no link between components is lost.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ASCII_SPACE, as_bytes, free_caches, materialise, remove_table, slices
from .components import components

#: Fewest bits of a set's bitmap.
BITS = 1024
#: Most bits that go with a set to each of its blocks; a pair that leaves a block is held against the whole bitmaps.
BLOCK_BITS = 4096
#: Members of a tile in a block, on average; larger tiles are compared block by block.
BLOCK = 2000
#: Most bits of the filter that tells which texts are wanted (8 MB).
FILTER_BITS = 1 << 26
#: Bytes of text that are hashed at once.
SLICE = 1 << 18
#: Share of sets that may need tiles of empty parts.
RARE = 1e-7
SPACE = re.compile(rb"[\x20\x09-\x0d]")
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(ASCII_SPACE.encode())] = True
_PRIME = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads all bits (two multiply-xorshift rounds)."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(29))
    x = x * _PRIME
    return x ^ (x >> np.uint64(32))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2 ** 64."""
    odd = 0xDA942042E4DD58B5
    back = pow(odd, -1, 1 << 64)
    with np.errstate(over="ignore"):
        return tuple(np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n - 1, x, np.uint64))]) for x in (odd, back))


_usual_powers = cache(lambda: _powers(2 * SLICE))


def _word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words, place of each text's first word and the end)."""
    sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    raw = np.frombuffer(b" " + b" ".join(texts) + b" ", np.uint8)
    low = raw + ((raw >= 65) & (raw <= 90)).astype(np.uint8) * np.uint8(32)
    turn = np.diff((~_IS_SPACE[low]).astype(np.int8))
    starts, ends = np.flatnonzero(turn == 1) + 1, np.flatnonzero(turn == -1) + 1
    up, down = _usual_powers() if len(low) < 2 * SLICE else _powers(len(low) + 1)
    total = np.zeros(len(low) + 1, np.uint64)
    np.cumsum((low.astype(np.uint64) + np.uint64(1)) * up[: len(low)], out=total[1:])
    words = mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    return words, np.searchsorted(starts, np.concatenate([[0], np.cumsum(sizes)]) + 1)


def _long_text_hashes(text: bytes) -> np.ndarray:
    """The hashes of a long text's words, worked out in pieces that end at white space: some forty bytes of memory for each byte of a piece, not of the text."""
    out, at = [], 0
    while at < len(text):
        gap = SPACE.search(text, at + SLICE)
        end = gap.start() if gap else len(text)
        out.append(_word_hashes([text[at:end]])[0])
        at = end
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def shingle_sets(texts: list[bytes], width: int) -> list[np.ndarray]:
    """The sorted distinct 64-bit shingles of each text.

    A-Z are lower-cased, words are runs of what is not ASCII white space; a text with
    fewer words than width has its whole sequence as one shingle, one without words none.
    """
    if sum(map(len, texts)) > 2 * SLICE:
        parts = [_long_text_hashes(t) for t in texts]
        words, first = np.concatenate(parts), np.concatenate([[0], np.cumsum([len(x) for x in parts])])
    else:
        words, first = _word_hashes(texts)
    joined = np.zeros(max(0, len(words) - width + 1), np.uint64)
    for k in range(width):
        joined = mix(joined * _PRIME + words[k : len(words) - width + 1 + k]) if len(joined) else joined
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= width:
            out.append(np.unique(joined[a : b - width + 1]))
        elif b > a:
            one = np.uint64([width + b - a])
            for w in words[a:b]:
                one = mix(one * _PRIME + w)
            out.append(one)
        else:
            out.append(np.empty(0, np.uint64))
    return out


def links_at(a: int, b: int, threshold: int) -> int:
    """Most elements in which sets of a and b elements may differ and still link."""
    return (a + b) * (100 - threshold) // (100 + threshold)


def _parts(low: int, differ: int) -> tuple[int, int]:
    """(parts, slack) for sets of low elements at least that differ in at most differ.

    slack parts are added so that sets with at most slack empty parts agree in one that
    holds something. A set with more has all its elements in differ parts; the chance of that is at most
    C(parts, differ) * (differ / parts) ** low, and slack brings it down to RARE: the few such sets
    use their empty parts as tiles as well.
    """
    slack = 0
    while differ and slack < 16 + 2 * differ:
        parts = differ + 1 + slack
        chance = math.lgamma(parts + 1) - math.lgamma(differ + 1) - math.lgamma(slack + 2) + low * math.log(differ / parts)
        if chance < math.log(RARE):
            break
        slack += 1
    return differ + 1 + slack, slack


@cache
def schemes(size: int, threshold: int) -> tuple[tuple[int, int, int], ...]:
    """(scheme, parts, slack) of each scheme that a set of size elements takes part in.

    Bands grow by half; an even scheme is for pairs within a band, an odd one for pairs of
    a band and the next, for which only the sizes near their border come in question.
    """
    found = []
    low, band = 1, 0
    while low <= size:
        high = max(low, low * 3 // 2)
        if size <= high:
            found.append((2 * band, *_parts(low, links_at(high, high, threshold))))
        smallest, largest = -(-threshold * (high + 1) // 100), 100 * high // threshold
        if smallest <= high and smallest <= size <= largest:
            found.append((2 * band + 1, *_parts(smallest, links_at(high, largest, threshold))))
        low, band = high + 1, band + 1
    return tuple(found)


def tiles(shingles: np.ndarray, threshold: int) -> np.ndarray:
    """The tiles of a set: a hash of scheme, part and the part's elements, for each part that counts."""
    out = []
    spread = mix(shingles + _PRIME)
    for scheme, parts, slack in schemes(len(shingles), threshold):
        part = ((spread >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(spread[order])])
        edge = np.searchsorted(part[order], np.arange(parts + 1))
        count = np.diff(edge)
        salt = np.uint64(scheme) << np.uint64(40) | np.arange(parts, dtype=np.uint64)
        tile = mix(total[edge[1:]] - total[edge[:-1]] + mix(salt + _PRIME))
        out.append(tile if int((count == 0).sum()) > slack else tile[count > 0])
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def parity_bitmap(shingles: np.ndarray, size: int = BITS) -> bytes:
    """size bits, a power of two: whether an odd number of elements hash to each. Two bitmaps differ in no more bits than their sets in elements."""
    return np.packbits(np.bincount((shingles & np.uint64(size - 1)).astype(np.int64), minlength=size).astype(np.uint8) & 1).tobytes()


def set_bits(shingles: np.ndarray) -> bytes:
    """A parity bitmap with a bit for each element at least; of a long set, BLOCK_BITS bits and the whole bitmap behind them."""
    size = max(BITS, 1 << max(0, len(shingles) - 1).bit_length())
    return parity_bitmap(shingles, min(size, BLOCK_BITS)) + (parity_bitmap(shingles, size) if size > BLOCK_BITS else b"")


def _set_key(shingles: np.ndarray) -> tuple[int, int]:
    h = xxhash.xxh3_128_intdigest(shingles.tobytes())
    return (h >> 64) - (1 << 63), (h & (1 << 64) - 1) - (1 << 63)


def _profiles(width: int, bits: Callable[[np.ndarray], bytes]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        free_caches()
        for b in slices(batches, "t", SLICE):
            sets = shingle_sets(as_bytes(b.column(1)), width)
            keys = [_set_key(s) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64()), pa.array(map(bits, sets), pa.binary())], ["i", "n", "h1", "h2", "bits"]
            )

    return run


def _tile_rows(width: int, threshold: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # a partition's sets, one integer each: copies emit their tiles once
        for b in slices(batches, "t", SLICE):
            found, nodes = [], []
            for s in shingle_sets(as_bytes(b.column(0)), width):
                h1, h2 = _set_key(s)
                if len(s) and (key := hash((h1, h2))) not in seen:
                    seen.add(key)
                    t = tiles(s, threshold)
                    found.append(t)
                    nodes.append(np.full(len(t), h1, np.int64))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64)), pa.array(np.concatenate(nodes))], ["tile", "node"])

    return run


def _wanted_bits(ids: DataFrame, column: str, n: int) -> np.ndarray:
    """A Bloom filter of n 64-bit ids with two bits each, as 64-bit words: sixteen bits for each id, FILTER_BITS at most."""
    size = 1 << min(FILTER_BITS.bit_length() - 1, max(12, (16 * n - 1).bit_length()))
    place = F.explode(F.array(*(F.pmod(F.xxhash64(F.lit(k), column), F.lit(size)) for k in range(2))))
    words = ids.select(place.alias("at")).groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at % 64 as int))")).alias("bits")).toPandas()
    out = np.zeros(size >> 6, np.int64)
    out[words["word"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64)
    return out.view(np.uint64)


def _sets(width: int, bits):
    """Sets of the rows (t, p0, p1) whose two hashes are in the filter; the others pass without work."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = bits.value
        mask = np.int64(len(own) * 64 - 1)
        for batch in batches:
            at = [batch.column(k).to_numpy() & mask for k in (1, 2)]
            there = np.logical_and(*((own[x >> 6] >> (x & 63).astype(np.uint64)) & np.uint64(1) for x in at))
            for b in slices([batch.filter(pa.array(there))], "t", SLICE):
                sets = shingle_sets(as_bytes(b.column(0)), width)
                keys = [_set_key(s) for s in sets]
                yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["h1", "h2", "s"])

    return run


#: (bits of x, bits of y, sum of their sizes, threshold) -> whether they may link; bits as rows of 64-bit words.
MayLink = Callable[[np.ndarray, np.ndarray, np.ndarray, int], np.ndarray]


def parity_bound(x: np.ndarray, y: np.ndarray, total: np.ndarray, threshold: int) -> np.ndarray:
    """Whether parity bitmaps allow enough common elements: 2 * overlap <= total - differ, and a link needs (100 + threshold) * overlap >= threshold * total."""
    differ = np.bitwise_count(x ^ y).sum(1).astype(np.int64)
    return (100 + threshold) * (total - differ) >= 2 * threshold * total


def _folded(bits: np.ndarray, n: int) -> np.ndarray:
    """Parity bitmaps in n words each: half the bits are the two halves' exclusive or."""
    while bits.shape[-1] > n:
        half = bits.shape[-1] // 2
        bits = bits[..., :half] ^ bits[..., half:]
    return bits


def set_bound(x: np.ndarray, y: np.ndarray, total: np.ndarray, threshold: int) -> np.ndarray:
    """parity_bound of what set_bits makes, in the smaller one's size."""
    short = BLOCK_BITS // 64
    x, y = (z[..., short:] if z.shape[-1] > short else z for z in (x, y))
    n = min(x.shape[-1], y.shape[-1])
    return parity_bound(_folded(x, n), _folded(y, n), total, threshold)


def _words(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A binary column of equal lengths as rows of 64-bit words."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(len(column), -1)


def _least_words(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A column of bitmaps as rows of 64-bit words, folded to the smallest one's size."""
    sizes = pc.binary_length(column).to_numpy()
    if sizes.min() == sizes.max():
        return _words(column)
    out = np.empty((len(column), sizes.min() // 8), np.uint64)
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        out[at] = _folded(_words(column.take(pa.array(at))), out.shape[1])
    return out


def _bounded(threshold: int, may_link: MayLink):
    """Keeps the pairs that may link by their bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 4096):
                b = batch.slice(k, 4096)
                x, y = (b.column(b.schema.get_field_index(c)) for c in ("bits_a", "bits_b"))
                total = sum(b.column(b.schema.get_field_index(c)).to_numpy() for c in ("n_a", "n_b"))
                keep = np.zeros(b.num_rows, bool)
                sizes = np.stack([pc.binary_length(z).to_numpy() for z in (x, y)], 1)
                for size in np.unique(sizes, axis=0):
                    at = np.flatnonzero((sizes == size).all(1))
                    keep[at] = may_link(*(_words(z.take(pa.array(at))) for z in (x, y)), total[at], threshold)
                yield b.select(["a", "b", "h1_a", "h2_a", "h1_b", "h2_b"]).filter(pa.array(keep))

    return run


def _close_in_blocks(threshold: int, may_link: MayLink):
    """From rows sorted by (tile, bi, bj): pairs of different labels that may link by their bits.

    A group is a block (bi = bj) or two blocks of a tile; one group is in memory at a time.
    """

    def close(rows: list[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        t = pa.Table.from_batches(rows).combine_chunks()
        own, node, n, label = (t[c].to_numpy() for c in ("own", "node", "n", "label"))
        bits = _least_words(t["bits"])
        crossed = t["bi"][0].as_py() != t["bj"][0].as_py()
        for k in range(len(n) - 1):
            keep = label[k + 1 :] != label[k]
            if crossed:
                keep &= own[k + 1 :] != own[k]
            total = n[k] + n[k + 1 :]
            keep &= (100 * np.minimum(n[k], n[k + 1 :])) >= threshold * np.maximum(n[k], n[k + 1 :])
            at = np.flatnonzero(keep)
            if len(at):
                at = at[may_link(bits[k + 1 + at], bits[k], total[at], threshold)]
                if len(at):
                    yield np.minimum(node[k], node[k + 1 + at]), np.maximum(node[k], node[k + 1 + at])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def groups() -> Iterator[list[pa.RecordBatch]]:
            rows: list[pa.RecordBatch] = []
            last = None
            for b in batches:
                key = list(zip(*(b.column(k).to_pylist() for k in range(3)), strict=True))
                start = 0
                for k in range(b.num_rows + 1):
                    if k < b.num_rows and key[k] == last:
                        continue
                    if k > start:
                        rows.append(b.slice(start, k - start))
                    start = k
                    if k < b.num_rows:
                        if rows:
                            yield rows
                        rows, last = [], key[k]
            if rows:
                yield rows

        seen: set[tuple[int, int]] = set()  # pairs meet in many tiles; a partition sends one out once, as far as this bound goes
        for rows in groups():
            for x, y in close(rows):
                new = [p for p in zip(x.tolist(), y.tolist(), strict=True) if p not in seen]
                if len(seen) > 50_000:
                    seen.clear()
                seen.update(new)
                if new:
                    yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in new], pa.int64()), pa.array([p[1] for p in new], pa.int64())], ["x", "y"])

    return run


def _verified(threshold: int):
    """Keeps the pairs whose sorted arrays intersect in enough elements."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                b = batch.slice(k, 256)
                keep = []
                for x, y in zip(*(b.column(b.schema.get_field_index(c)).to_pylist() for c in ("s_a", "s_b")), strict=True):
                    p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                    if len(p) > len(q):
                        p, q = q, p
                    at = np.searchsorted(q, p)
                    common = int((q[np.minimum(at, len(q) - 1)] == p).sum()) if len(q) else 0
                    keep.append(common > 0 and 100 * common >= threshold * (len(p) + len(q) - common))
                yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def jaccard_components(df: DataFrame, ids: str = "doc_id", text: str = "text", width: int = 5, threshold: int = 80, block: int = BLOCK) -> DataFrame:
    """One row per row of df: the id column, n_shingles and component_id.

    Documents whose sets of width-word shingles reach the Jaccard similarity
    threshold / 100 link; component_id is the smallest id reachable, the row's own for
    a document without links. Null and empty texts have no shingles and no links;
    repeated rows are copies of each other; rows without an id count shingles but link
    nothing and have no component. Other columns of df are not read.

    Equal sets are one node, so copies cost a profile each and nothing more. Written
    tables: the profiles (about 170 bytes a document, and up to two bits a shingle), the tiles with several members, the
    links. A block of a tile is compared in one task, at most a few thousand bitmaps. No set of texts is shuffled but those of candidates.
    """
    base, profiles = profile_table(df, ids, text, width, set_bits)
    nodes = set_nodes(profiles)
    rows = base.filter("i is not null").select("t").mapInArrow(_tile_rows(width, threshold), "tile long, node long")
    return components_of_tiles(base, profiles, nodes, rows, width, threshold, block, set_bound, BLOCK_BITS // 8).select(F.col("i").alias(ids), "n_shingles", "component_id")


def profile_table(df: DataFrame, ids: str, text: str, width: int, bits: Callable[[np.ndarray], bytes]) -> tuple[DataFrame, DataFrame]:
    """(i, t) of df, and a written table of each row's set: (i, n, h1, h2, bits), its size, its hash and what bits makes of it."""
    base = df.select(F.col(ids).alias("i"), F.col(text).cast("string").alias("t"))
    fields = [T.StructField("i", df.schema[ids].dataType), *(T.StructField(x, T.LongType()) for x in ("n", "h1", "h2")), T.StructField("bits", T.BinaryType())]
    return base, materialise(base.mapInArrow(_profiles(width, bits), T.StructType(fields)))


def set_nodes(profiles: DataFrame) -> DataFrame:
    """Equal sets as one node: the smallest id stands for all."""
    named = profiles.filter("n > 0 and i is not null")
    return materialise(named.groupBy("h1", "h2", "n").agg(F.min("i").alias("rep"), F.first("bits").alias("bits")))


def components_of_tiles(base: DataFrame, profiles: DataFrame, nodes: DataFrame, rows: DataFrame, width: int, threshold: int, block: int, may_link: MayLink, block_bytes: int | None = None) -> DataFrame:
    """(i, n_shingles, component_id) of each profile, given rows (tile, node) in which all pairs that link share a tile.

    block_bytes: so many of a set's bits go to its blocks, if not all. Tables that the result doesn't read are removed.
    """
    w = Window.partitionBy("tile").orderBy("node")
    members = rows.select("tile", "node", F.first("node").over(w).alias("first"), F.lag("node").over(w).alias("before"))
    # One row for each member but the first: what tiles of one member had is gone here.
    others = materialise(members.filter("node != first and node != before").select("tile", "first", "node"))
    members = others.select("tile", "node").unionByName(others.select("tile", F.col("first").alias("node")).distinct())
    degree = members.groupBy("node").agg(F.count("*").alias("d"))
    leaders = materialise(members.join(degree, "node").groupBy("tile").agg(F.max(F.struct("d", "node"))["node"].alias("leader"), F.count("*").alias("size")))
    held = members.join(leaders, "tile").filter("node != leader")
    pairs = held.select(F.col("leader").alias("x"), F.col("node").alias("y")).distinct()
    # Different sets under one 64-bit node value are candidates too.
    clash = nodes.groupBy("h1").agg(F.count("*").alias("c")).filter("c > 1").select(F.col("h1").alias("x"), F.col("h1").alias("y"))
    links = exact_links(base, nodes, pairs.unionByName(clash), width, threshold, may_link)
    named = nodes.select(F.col("h1").alias("node"), "n", F.substring("bits", 1, block_bytes).alias("bits") if block_bytes else "bits", "rep").join(components(links).withColumnRenamed("node", "rep"), "rep", "left")
    named = materialise(named.select("node", "n", "bits", F.xxhash64(F.coalesce("label", "rep")).alias("label")))
    # The leader has been compared with all: what is left of a tile is the rest, if it has several components.
    rest = held.filter("size > 2").select("tile", "node", "size").join(named.select("node", "label"), "node")
    several = rest.groupBy("tile").agg(F.min("label").alias("l"), F.max("label").alias("m")).filter("l != m").select("tile")
    rest = rest.join(several, "tile").withColumn("blocks", F.ceil(F.col("size") / block)).withColumn("own", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    rest = rest.select("tile", "node", "own", F.explode(F.sequence(F.lit(0), (F.col("blocks") - 1).cast("int"))).alias("other")).select("tile", F.least("own", "other").alias("bi"), F.greatest("own", "other").alias("bj"), "own", "node")
    rest = rest.join(named, "node").select("tile", "bi", "bj", "own", "node", "n", "label", "bits")
    rest = rest.repartition("tile", "bi", "bj").sortWithinPartitions("tile", "bi", "bj")
    pairs = rest.mapInArrow(_close_in_blocks(threshold, may_link), "x long, y long").distinct()
    more = exact_links(base, nodes, pairs, width, threshold, may_link)
    labels = components(links.unionByName(more))
    for done in (others, leaders, named, links, more):
        remove_table(done)
    label = labels.select(F.col("node").alias("rep"), "label")
    classes = nodes.select(F.col("h1").alias("c1"), F.col("h2").alias("c2"), F.col("n").alias("cn"), "rep").join(label, "rep", "left")
    found = profiles.join(classes, (profiles["h1"] == classes["c1"]) & (profiles["h2"] == classes["c2"]) & (profiles["n"] == classes["cn"]) & profiles["i"].isNotNull(), "left")
    return found.select("i", F.col("n").alias("n_shingles"), F.when(F.col("i").isNotNull(), F.coalesce("label", "rep", "i")).alias("component_id"))


def exact_links(base: DataFrame, nodes: DataFrame, pairs: DataFrame, width: int, threshold: int, may_link: MayLink) -> DataFrame:
    """(a, b), a written table: the representatives of the pairs (x, y) of node values whose sets link; most others go by their bits."""

    def side(s: str, key: str) -> DataFrame:
        return nodes.select(F.col("h1").alias(key), F.col("h2").alias(f"h2_{s}"), F.col("n").alias(f"n_{s}"), F.col("rep").alias(s), F.col("bits").alias(f"bits_{s}"))

    kind = nodes.schema["rep"].dataType
    both = pairs.join(side("a", "x"), "x").join(side("b", "y"), "y").filter("a != b").filter(f"100 * least(n_a, n_b) >= {threshold} * greatest(n_a, n_b)")
    both = both.withColumnsRenamed({"x": "h1_a", "y": "h1_b"})
    schema = T.StructType([T.StructField("a", kind), T.StructField("b", kind), *(T.StructField(x, T.LongType()) for x in ("h1_a", "h2_a", "h1_b", "h2_b"))])
    close = materialise(both.mapInArrow(_bounded(threshold, may_link), schema))
    wanted = close.select(F.col("a").alias("i")).unionByName(close.select(F.col("b").alias("i"))).distinct()
    # Texts are not shuffled to find the candidates': a filter of bounded size tells which may be wanted. Where so
    # many are wanted that the filter would let most texts through, a join finds them.
    n = wanted.count()
    texts = base.filter("i is not null") if 8 * n <= FILTER_BITS else base.join(wanted, "i", "left_semi")
    bits = base.sparkSession.sparkContext.broadcast(_wanted_bits(wanted, "i", n))
    sets = texts.select("t", F.xxhash64(F.lit(0), "i").alias("p0"), F.xxhash64(F.lit(1), "i").alias("p1")).mapInArrow(_sets(width, bits), "h1 long, h2 long, s binary")
    sets = sets.groupBy("h1", "h2").agg(F.first("s").alias("s"))
    a = sets.select(F.col("h1").alias("h1_a"), F.col("h2").alias("h2_a"), F.col("s").alias("s_a"))
    b = sets.select(F.col("h1").alias("h1_b"), F.col("h2").alias("h2_b"), F.col("s").alias("s_b"))
    held = close.join(a, ["h1_a", "h2_a"]).join(b, ["h1_b", "h2_b"]).select("a", "b", "s_a", "s_b")
    links = materialise(held.mapInArrow(_verified(threshold), T.StructType([T.StructField("a", kind), T.StructField("b", kind)])))
    remove_table(close)
    return links
