"""Language-model scoring by context-tree weighting over binary-decomposed bytes.

A text is its words in lower case, each coded byte by byte and closed by a space, and an
end. A byte is eight binary decisions. Each decision has a context tree: the context is
the DEPTH bytes before it, across words; before a text's first byte stand spaces. A node
estimates the decision by Krichevsky and Trofimov from its counts, and mixes its estimate
with its children's by half and half; with all training counts known that gives each node
a posterior weight, so that the probability of a byte is a fixed mixture of the estimates
of all depths. All contexts that the training texts hold are in the tree.

The tree is cut below its first ROOT bytes: a subtree lies in one group of subtrees, and
what is above has at most 256 ** (ROOT - 1) contexts, however large the input.

Words, for the base score, go the same way as grams, as 64-bit hashes: at a thousand million
distinct words the chance of one clash is three in a hundred.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import as_bytes, crc_mod, materialise, slices

#: Longest context in bytes. START stands before a text, STOP after a word; END is the text's end as a word.
DEPTH = 7
START = STOP = 0x20
END = b"\n"
#: Subtrees begin at this depth; most groups that they are dealt to.
ROOT, MOST_GROUPS = 3, 1 << 14
#: Bytes of text in a block of documents, the unit in which words get their scores; most partitions for blocks.
BLOCK, MOST_PARTS = 8 << 20, 20_000
#: Grams that a task holds before it sums equal ones; a slice's bytes.
GRAMS, SLICE = 2_000_000, 1 << 20


def tokens(text: bytes) -> list[bytes]:
    """Words in lower case (A-Z), then the end."""
    return [*text.lower().split(), END]


def joined(words: list[bytes]) -> bytes:
    """The bytes to code: each token and STOP."""
    return b" ".join(words) + bytes([STOP])


def stream(text: bytes) -> bytes:
    return joined(tokens(text))


def contexts(words: list[bytes], depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each byte to code (a marked word's own, then STOP): which word, the byte, and keys[d] of the d bytes before it.

    A key packs its bytes and their number into 64 bits; -1 beyond the word's mark.
    """
    raw = np.frombuffer(b"".join(w[:1] + b" " + w[1:] + b" " for w in words), np.uint8)
    size = np.fromiter((len(w) + 2 for w in words), np.int64, len(words))
    first = np.cumsum(size) - size
    word = np.repeat(np.arange(len(words)), size)
    offset = np.arange(len(raw)) - np.repeat(first, size)
    at = np.flatnonzero(offset > 1)
    keys = np.full((depth + 1, len(at)), -1, np.int64)
    keys[0] = 0
    run = np.zeros(len(at), np.int64)
    for d in range(1, depth + 1):
        there = offset[at] >= d
        run = run | (raw[np.maximum(at - d, 0)].astype(np.int64) << (8 * (d - 1)))
        keys[d, there] = run[there] | (d << 56)
    return word[at], raw[at], keys


def _log_kt(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov probability of a zeros and b ones in any order."""
    return _log_gamma_half(a) + _log_gamma_half(b) - _log_factorial(a + b)


def _stirling(x: np.ndarray) -> np.ndarray:
    """Log gamma for x >= 0.5, by shifting the argument by eight."""
    shift = np.ones_like(x)
    for k in range(8):
        shift = shift * (x + k)
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y**3) - np.log(shift)


def _log_gamma_half(n: np.ndarray) -> np.ndarray:
    return _stirling(n + 0.5) - 0.5723649429247001


def _log_factorial(n: np.ndarray) -> np.ndarray:
    return _stirling(n + 1.0)


class ContextTree:
    """Log10 probabilities of all bytes after each context: a small tree held whole, which tests compare with."""

    def __init__(self, keys: np.ndarray, table: np.ndarray):
        self.keys, self.table = keys, table

    def word_scores(self, words: list[bytes]) -> np.ndarray:
        """Log10 probability of each marked word with its end."""
        if not words:
            return np.zeros(0)
        word, byte, keys = contexts(words)
        row = np.full(len(byte), np.searchsorted(self.keys, 0))
        live = np.arange(len(byte))
        for d in range(1, DEPTH + 1):
            live = live[keys[d, live] >= 0]
            at = np.minimum(np.searchsorted(self.keys, keys[d, live]), len(self.keys) - 1)
            found = self.keys[at] == keys[d, live]
            live, at = live[found], at[found]
            row[live] = at
        return np.bincount(word, self.table[row, byte].astype(np.float64), len(words))


def weigh(keys: np.ndarray, bytes_: np.ndarray, counts: np.ndarray) -> ContextTree:
    """The tree of contexts `keys` (closed under dropping the oldest byte, key 0 in it) from (context, byte, count)."""
    kept = np.unique(np.concatenate([keys, np.zeros(1, np.int64)]))
    n = len(kept)
    # ones[c, b] of binary node b (1..255, a byte's leading bits): how often a one comes next, seen[c, b]: how often it is reached.
    leaves = np.zeros((n, 256))
    np.add.at(leaves, (np.searchsorted(kept, keys), bytes_), counts)
    level = leaves
    seen, ones = np.zeros((n, 256), np.float64), np.zeros((n, 256), np.float64)
    for bit in range(7, -1, -1):
        pair = level.reshape(n, 1 << bit, 2)
        seen[:, 1 << bit : 2 << bit], ones[:, 1 << bit : 2 << bit] = pair.sum(2), pair[:, :, 1]
        level = pair.sum(2)
    del leaves, level, pair
    depth = kept >> 56
    parent_key = np.where(depth > 1, (kept & ((np.int64(1) << (8 * np.maximum(depth - 1, 0))) - 1)) | ((depth - 1) << 56), 0)
    parent = np.searchsorted(kept, parent_key)
    parent[kept == 0] = -1
    # What no kept child holds of a node's counts is one more child.
    rest_seen, rest_ones = seen.copy(), ones.copy()
    child = np.flatnonzero(parent >= 0)
    np.subtract.at(rest_seen, parent[child], seen[child])
    np.subtract.at(rest_ones, parent[child], ones[child])
    has_child = np.bincount(parent[child], minlength=n) > 0
    below = _log_kt(rest_seen - rest_ones, rest_ones)
    own = _log_kt(seen - ones, ones)
    kt = (ones + 0.5) / (seen + 1)
    stay = np.ones((n, 256))
    for d in range(int(depth.max()), -1, -1):
        rows = np.flatnonzero(depth == d)
        inner = rows[has_child[rows]]
        a, b = own[inner], below[inner]
        stay[inner] = 1 / (1 + np.exp(np.clip(b - a, -700, 700)))
        own[inner] = np.logaddexp(a, b) - np.log(2)
        if d:
            np.add.at(below, parent[rows], own[rows])
    del own, below
    rest = (rest_ones + 0.5) / (rest_seen + 1)
    del rest_seen, rest_ones, seen, ones
    mixed, weight = np.zeros((n, 256)), np.zeros((n, 256))
    p = np.zeros((n, 256))
    for d in range(int(depth.max()) + 1):
        rows = np.flatnonzero(depth == d)
        up = parent[rows]
        before, left = (mixed[up], weight[up]) if d else (np.zeros((len(rows), 256)), np.ones((len(rows), 256)))
        mixed[rows] = before + left * stay[rows] * kt[rows]
        weight[rows] = left * (1 - stay[rows])
        p[rows] = mixed[rows] + weight[rows] * rest[rows]
    del mixed, weight, rest, stay, kt
    log = np.zeros((n, 1))
    for bit in range(8):
        one = np.clip(p[:, 1 << bit : 2 << bit], 1e-12, 1 - 1e-12)
        log = np.stack([log + np.log10(1 - one), log + np.log10(one)], axis=2).reshape(n, 2 << bit)
    return ContextTree(kept, log.astype(np.float32))


def grams(streams: list[bytes]) -> np.ndarray:
    """For each byte to code the DEPTH bytes before it, the nearest in the highest place, and the byte in the lowest: sorted, they are a tree."""
    pad = bytes([START]) * DEPTH
    raw = b"".join(pad + s for s in streams)
    if not raw:
        return np.zeros(0, np.uint64)
    # Windows of DEPTH + 1 bytes as 64-bit numbers: the byte to code comes highest and is turned to the lowest place.
    window = np.array(np.ndarray(len(raw) - DEPTH, "<u8", raw, strides=(1,)), np.uint64)
    out = window << np.uint64(8) | window >> np.uint64(56)
    first = np.cumsum(np.fromiter((len(s) + DEPTH for s in streams), np.int64, len(streams)))[:-1]
    keep = np.ones(len(out), bool)
    keep[(first[:, None] + np.arange(-DEPTH, 0)).ravel()] = False
    return out[keep]


def counted_keys(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and how often each occurs."""
    keys = np.sort(keys)
    new = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[new], np.diff(np.append(new, len(keys)))


def summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sums of their n, from parts of distinct keys in order."""
    if len(parts) == 1:
        return parts[0]
    keys, _ = counted_keys(np.concatenate([k for k, _ in parts])) if parts else (np.zeros(0, np.uint64), None)
    total = np.zeros(len(keys), np.int64)
    for k, n in parts:
        total[np.searchsorted(keys, k)] += n
    return keys, total


class BlockGrams:
    """The distinct grams of a block and how often its training texts hold them."""

    def __init__(self):
        self.raw: dict[bool, list[np.ndarray]] = {False: [], True: []}
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, streams: list[bytes], held: list[bool]) -> None:
        for h, own in self.raw.items():
            own.append(grams([s for s, x in zip(streams, held, strict=True) if x == h]))
            if sum(map(len, own)) > GRAMS:
                self._count(h)
        if sum(len(k) for k, _ in self.parts) > 4 * GRAMS:
            self.parts = [summed(self.parts)]

    def _count(self, h: bool) -> None:
        keys, n = counted_keys(np.concatenate(self.raw[h])) if self.raw[h] else ((), ())
        self.raw[h] = []
        if len(keys):
            self.parts.append((keys, np.zeros_like(n) if h else n))

    def done(self) -> tuple[np.ndarray, np.ndarray]:
        self._count(False)
        self._count(True)
        self.parts = [summed(self.parts)]
        return self.parts[0]


def gram_groups(keys: np.ndarray, groups: int) -> np.ndarray:
    """The group of each gram; a group holds whole subtrees."""
    return ((keys >> np.uint64(64 - 8 * ROOT)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)) % np.uint64(groups)


def word_groups(hashes: np.ndarray, groups: int) -> np.ndarray:
    return hashes % np.uint64(groups)


def by_group(g: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(group, places of its keys in order) from the keys' groups."""
    order = np.argsort(g, kind="stable")
    first = np.flatnonzero(np.append(True, np.diff(g[order].astype(np.int64)) != 0)) if len(g) else []
    for a, z in zip(first, [*first[1:], len(g)], strict=True):
        yield int(g[order[a]]), order[a:z]


def word_hashes(words: Iterable[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64)


def packed(x: np.ndarray) -> bytes:
    """Numbers in order as compressed bytes of their differences, the like places together."""
    step = np.diff(x, prepend=x.dtype.type(0))
    return len(x).to_bytes(8, "little") + pa.compress(step.view(np.uint8).reshape(-1, x.itemsize).T.tobytes(), codec="zstd", asbytes=True)


def unpacked(b: bytes, kind: type) -> np.ndarray:
    n, size = int.from_bytes(b[:8], "little"), np.dtype(kind).itemsize
    raw = pa.decompress(b[8:], decompressed_size=n * size, codec="zstd", asbytes=True)
    return np.cumsum(np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, n).T).view(kind).ravel(), dtype=kind)


def packed_counts(n: np.ndarray) -> bytes:
    """Counts as compressed bytes, the like places together."""
    return pa.compress(n.astype("<i8").view(np.uint8).reshape(-1, 8).T.tobytes(), codec="zstd", asbytes=True)


def unpacked_counts(b: bytes, n: int) -> np.ndarray:
    raw = pa.decompress(b, decompressed_size=8 * n, codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, n).T).view("<i8").ravel()


def packed_places(at: np.ndarray, size: int) -> bytes:
    """Ascending places below size: a bit for each of size where many are taken, else the steps between them; no more bytes than a few for each place."""
    if 8 * len(at) >= size:
        mask = np.zeros(size, bool)
        mask[at] = True
        return b"m" + pa.compress(np.packbits(mask).tobytes(), codec="zstd", asbytes=True)
    return b"s" + packed(at.astype(np.uint32))


def unpacked_places(b: bytes, size: int) -> np.ndarray:
    if b[:1] == b"m":
        return np.flatnonzero(np.unpackbits(np.frombuffer(pa.decompress(b[1:], decompressed_size=-(-size // 8), codec="zstd", asbytes=True), np.uint8), count=size))
    return unpacked(b[1:], np.uint32)


def packed_prices(p: np.ndarray) -> bytes:
    """Prices in three bytes each (sixteen bits of precision), the like places together and compressed."""
    kept = p.astype("<f4").view("<u4") + np.uint32(0x80)
    return pa.compress(kept.view(np.uint8).reshape(-1, 4)[:, 1:].T.tobytes(), codec="zstd", asbytes=True)


def unpacked_prices(b: bytes, n: int) -> np.ndarray:
    out = np.zeros((n, 4), np.uint8)
    out[:, 1:] = np.frombuffer(pa.decompress(b, decompressed_size=3 * n, codec="zstd", asbytes=True), np.uint8).reshape(3, n).T
    return out.view("<f4").ravel()


_SMALL = 1 << 12
_HALVES, _FACTORIALS = _log_gamma_half(np.arange(_SMALL, dtype=float)), _log_factorial(np.arange(_SMALL, dtype=float))


def _log_kt_counts(seen: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """_log_kt of whole numbers, most of them small."""
    small = np.minimum(seen, _SMALL - 1).astype(np.int64)
    one = np.minimum(ones, small).astype(np.int64)
    out = _HALVES[small - one] + _HALVES[one] - _FACTORIALS[small]
    large = np.flatnonzero(seen >= _SMALL)
    out[large] = _log_kt(seen[large] - ones[large], ones[large])
    return out


@dataclass
class Level:
    """Binary nodes of all contexts of a depth: ids (context << 8 | node), counts, log weighted probability, posterior weight of the own estimate."""

    ids: np.ndarray
    seen: np.ndarray
    ones: np.ndarray
    own: np.ndarray
    stay: np.ndarray | float
    up: np.ndarray | None = None

    def sums(self) -> tuple[np.ndarray, ...]:
        """(ids, seen, ones, log probability of the children) of the parents."""
        ids, self.up = np.unique((self.ids >> np.uint64(16) << np.uint64(8)) | (self.ids & np.uint64(255)), return_inverse=True)
        return ids, *(np.bincount(self.up, x, len(ids)) for x in (self.seen, self.ones, self.own))

    def mixed(self, above: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """(probability of a one so far, weight left) from those of the parents."""
        before, left = (x[self.up] for x in above)
        return before + left * self.stay * (self.ones + 0.5) / (self.seen + 1), left * (1 - self.stay)


def inner(ids: np.ndarray, seen: np.ndarray, ones: np.ndarray, below: np.ndarray) -> Level:
    kt = _log_kt_counts(seen, ones)
    return Level(ids, seen, ones, np.logaddexp(kt, below) - np.log(2), 1 / (1 + np.exp(np.clip(below - kt, -700, 700))))


def grow(keys: np.ndarray, n: np.ndarray) -> tuple[list[Level], list[np.ndarray]]:
    """Levels ROOT to DEPTH of the subtrees of distinct sorted grams, and for each of the eight bits its node at DEPTH."""
    parts, at, start = [], [], 0
    byte = keys & np.uint64(255)
    for k in range(8):
        prefix = keys >> np.uint64(8 - k)
        first = np.append(True, prefix[1:] != prefix[:-1])
        new = np.flatnonzero(first)
        bit = (byte >> np.uint64(7 - k) & np.uint64(1)).astype(float)
        parts.append(((keys[new] & ~np.uint64(255)) | np.uint64(1 << k) | byte[new] >> np.uint64(8 - k), np.add.reduceat(n, new), np.add.reduceat(n * bit, new)))
        at.append(np.cumsum(first) - 1 + start)
        start += len(new)
    ids, seen, ones = (np.concatenate([p[k] for p in parts]) for k in range(3))
    levels = [Level(ids, seen, ones, _log_kt_counts(seen, ones), 1.0)]
    for _ in range(DEPTH - ROOT):
        levels.append(inner(*levels[-1].sums()))
    return levels[::-1], at


def crown(ids: np.ndarray, seen: np.ndarray, ones: np.ndarray, below: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, probability so far, weight left) at depth ROOT - 1 from the sums of the subtrees; at most 256 ** ROOT of each."""
    levels = [inner(ids, seen, ones, below)]
    for _ in range(ROOT - 1):
        levels.append(inner(*levels[-1].sums()))
    root = levels.pop()
    state = root.stay * (root.ones + 0.5) / (root.seen + 1), 1 - root.stay
    for level in levels[::-1]:
        state = level.mixed(state)
    return ids, *state


def priced_grams(keys: np.ndarray, n: np.ndarray, top: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    """Log10 probability of each gram's byte after its context."""
    levels, at = grow(keys, n)
    above = levels[0].sums()[0]
    place = np.searchsorted(top[0], above)
    state = top[1][place], top[2][place]
    for level in levels:
        state = level.mixed(state)
    one = np.clip(state[0], 1e-12, 1 - 1e-12)
    yes, no = np.log10(one), np.log10(1 - one)
    out = np.zeros(len(keys))
    for k in range(8):
        out += np.where(keys >> np.uint64(7 - k) & np.uint64(1) == 1, yes[at[k]], no[at[k]])
    return out


#: What a group gives: sums for the tree above (or, as id -1, a word group's tokens and distinct words), and a row of its keys with what each block asks for.
_GROUP = "id long, seen double, ones double, below double, keys binary, n binary, g int, blocks array<int>, places array<binary>"


def _summed_group(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
    """A group's keys over all blocks. Of grams (g >= 0) the places of each block's and the sums for the tree above, of words each block's counts and the totals."""
    g = key[0].as_py()
    every = [unpacked(k, np.uint64) for k in rows["keys"].to_pylist()]
    counts = np.concatenate([unpacked(c, np.int64) for c in rows["n"].to_pylist()])
    # One sort for all blocks; a block's keys are sorted already, so its places among all are sorted too.
    keys, at = np.unique(np.concatenate(every), return_inverse=True)
    n = np.zeros(len(keys), np.int64)
    np.add.at(n, at, counts)
    own = np.split(at, np.cumsum([len(k) for k in every])[:-1])
    places = [packed_counts(n[x]) if g < 0 else packed_places(x, len(keys)) for x in own]
    if g < 0:
        ids, sums = np.array([-1]), [np.array([float(x)]) for x in (n.sum(), (n > 0).sum(), 0)]
    else:
        ids, *sums = grow(keys, n.astype(float))[0][0].sums()
    none = [None] * len(ids)
    cols = [pa.array([None, *ids.tolist()], pa.int64()), *(pa.array([None, *x.tolist()], pa.float64()) for x in sums)]
    cols += [pa.array([packed(keys) if g >= 0 else None, *none], pa.binary()), pa.array([packed(n) if g >= 0 else None, *none], pa.binary())]
    cols += [pa.array([g, *none], pa.int32()), pa.array([rows["b"].to_pylist(), *none], pa.list_(pa.int32())), pa.array([places, *none], pa.list_(pa.binary()))]
    return pa.table(cols, names=["id", "seen", "ones", "below", "keys", "n", "g", "blocks", "places"])


def _answers(top):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(b, g, p): the prices of a block's grams of a group, or the counts of its words, in the order of its keys."""
        for batch in batches:
            for r in range(batch.num_rows):
                row = batch.slice(r, 1).to_pylist()[0]
                if row["g"] < 0:
                    out = row["places"]
                else:
                    keys = unpacked(row["keys"], np.uint64)
                    p = priced_grams(keys, unpacked(row["n"], np.int64).astype(float), top.value).astype(np.float32)
                    out = []
                    for m in row["places"]:
                        out.append(packed_prices(p[unpacked_places(m, len(keys))]))
                for b, x in zip(row["blocks"], out, strict=True):
                    yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([row["g"]], pa.int32()), pa.array([x], pa.binary())], ["b", "g", "p"])

    return run


def block_answers(dealt: DataFrame, groups: int) -> tuple[DataFrame, int, int]:
    """(b, g, p) for dealt texts (t, held, b), a block's rows one after the other in a partition; training tokens and distinct ones."""

    def found(b: int, own: BlockGrams, words: Counter) -> pa.RecordBatch:
        keys, n = own.done()
        rows = [(g, packed(keys[at]), packed(n[at])) for g, at in by_group(gram_groups(keys, groups))]
        hashes = word_hashes(words)
        order = np.argsort(hashes)
        keys, n = hashes[order], np.fromiter(words.values(), np.int64, len(words))[order]
        rows += [(-1 - g, packed(keys[at]), packed(n[at])) for g, at in by_group(word_groups(keys, groups))]
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([b] * len(rows), pa.int32()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())], ["g", "b", "keys", "n"])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, own, words = None, BlockGrams(), Counter()
        for x in slices(batches, "t", SLICE):
            texts, held, block = as_bytes(x.column(0)), x.column(1).to_pylist(), x.column(2).to_numpy()
            cut = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(block)]
            for a, z in zip(cut, cut[1:], strict=False):
                if block[a] != last and last is not None:
                    yield found(last, own, words)
                    own, words = BlockGrams(), Counter()
                last = int(block[a])
                split = [tokens(t) for t in texts[a:z]]
                for w, h in zip(split, held[a:z], strict=True):
                    words.update(dict.fromkeys(w, 0) if h else w)
                own.add([joined(w) for w in split], held[a:z])
        if last is not None:
            yield found(last, own, words)

    parts = dealt.select("t", "held", "b").sortWithinPartitions("b").mapInArrow(counted, "g int, b int, keys binary, n binary")
    trees = materialise(parts.groupBy("g").applyInArrow(_summed_group, _GROUP))
    every, distinct = trees.filter("id = -1").agg(F.coalesce(F.sum("seen"), F.lit(0.0)), F.coalesce(F.sum("ones"), F.lit(0.0))).first()
    sums = trees.filter("id >= 0").groupBy("id").agg(*(F.sum(c).alias(c) for c in ("seen", "ones", "below"))).orderBy("id").toPandas()  # 256 ** ROOT rows at most
    ids = sums["id"].to_numpy(np.int64).astype(np.uint64)
    top = crown(ids, *(sums[c].to_numpy(float) for c in ("seen", "ones", "below"))) if len(ids) else (ids, np.zeros(0), np.zeros(0))
    answers = trees.filter("blocks is not null").select("keys", "n", "g", "blocks", "places").mapInArrow(_answers(dealt.sparkSession.sparkContext.broadcast(top)), "b int, g int, p binary")
    return answers, int(every), int(distinct)


class BlockTexts:
    """A block's texts as places of their tokens among its distinct words, and as streams."""

    def __init__(self, texts: Iterator[list[bytes]]):
        self.place: dict[bytes, int] = {}
        self.tokens: list[np.ndarray] = []
        self.streams: list[list[bytes]] = []
        self.grams = BlockGrams()
        for part in texts:
            split = [tokens(t) for t in part]
            for own in split:
                for w in set(own).difference(self.place):
                    self.place[w] = len(self.place)
                self.tokens.append(np.fromiter(map(self.place.__getitem__, own), np.int32, len(own)))
            self.streams.append([joined(own) for own in split])
            self.grams.add(self.streams[-1], [False] * len(part))

    def counts(self, answers: dict[int, bytes], groups: int) -> np.ndarray:
        """How often training texts hold each distinct word."""
        hashes = word_hashes(self.place)
        order = np.argsort(hashes)
        out = np.zeros(len(hashes), np.int64)
        for g, at in by_group(word_groups(hashes[order], groups)):
            out[order[at]] = unpacked_counts(answers[-1 - g], len(at))
        return out

    def scores(self, answers: dict[int, bytes], groups: int) -> Iterator[tuple[float, int]]:
        """(log10 probability, bytes coded) of each text."""
        keys, _ = self.grams.done()
        p = np.full(len(keys), np.nan, np.float32)
        for g, at in by_group(gram_groups(keys, groups)):
            p[at] = unpacked_prices(answers[g], len(at))
        for streams in self.streams:
            gram = grams(streams)
            order = np.argsort(gram)
            gram = gram[order]
            new = np.append(True, gram[1:] != gram[:-1])
            price = np.empty(len(gram))
            price[order] = p[np.searchsorted(keys, gram[new])][np.cumsum(new) - 1]
            size = np.fromiter(map(len, streams), np.int64, len(streams))
            yield from zip(np.add.reduceat(price, np.cumsum(size) - size).tolist(), size.tolist(), strict=True)


def score_texts(df: DataFrame, ids: str = "doc_id", text: str = "text", hold_out: tuple[int, int] = (7, 2), block: int = BLOCK) -> DataFrame:
    """One row per row of df: the id column, held_out, n_tokens, n_known, train_tokens, base_score, score and bits_per_byte.

    Learns from rows whose crc32(id) mod hold_out[0] is not hold_out[1]. base_score is
    the sum of log10((c + 1) / (N + V + 1)) over the tokens, score the model's log10 probability of
    the text, bits_per_byte its code length for each byte coded. Null and empty texts are
    one end; repeated rows count and score as they are; a null id counts as an empty text for
    the hold-out. Without training rows N, V and all counts are 0.

    Documents are dealt by hash into blocks of about `block` bytes. A block counts its distinct grams and
    words, packed by groups of subtrees and of word hashes; groups sum them over all
    blocks and answer each block with the prices and counts of its own. So a frequent word costs a
    few bytes for each block, and neither a vocabulary nor a text collection is held
    anywhere but in groups and blocks. Rows that agree in id and text lie in one block.
    """
    spark = df.sparkSession
    kind = df.schema[ids].dataType
    base = df.select(F.col(ids).alias("i"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t"))
    (total,) = base.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()
    blocks = max(1, -(-total // block))
    base = base.withColumn("held", crc_mod("i", hold_out[0]) == hold_out[1])

    groups = max(32, min(2 * blocks, MOST_GROUPS))
    # One shuffle of the texts serves both the counts of a block and its scores.
    parts = max(min(blocks, MOST_PARTS), int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = base.select("i", "t", "held", F.pmod(F.xxhash64("i", "t"), F.lit(blocks)).cast("int").alias("b")).repartition(parts, "b")
    answers, train_tokens, vocabulary = block_answers(dealt, groups)
    most = np.log10(train_tokens + vocabulary + 1)

    def score(key, docs: pa.Table, answer: pa.Table) -> pa.Table:
        texts = docs.select(["t"]).set_column(0, "t", docs["t"].cast(pa.binary())).combine_chunks().to_batches()
        own = BlockTexts([t or b"" for t in x.column(0).to_pylist()] for x in slices(texts, "t", SLICE))
        by = dict(zip(answer["g"].to_pylist(), answer["p"].to_pylist(), strict=True))
        c = own.counts(by, groups)
        size = np.fromiter(map(len, own.tokens), np.int64, len(own.tokens))
        at, first = np.concatenate(own.tokens), np.cumsum(size) - size
        known, base_score = np.add.reduceat((c > 0)[at].astype(np.int64), first), np.add.reduceat((np.log10(c + 1.0) - most)[at], first)
        found = list(own.scores(by, groups))
        scores = np.array([x for x, _ in found])
        bits = -scores / np.log10(2) / np.array([n for _, n in found])
        return pa.table([docs["i"], docs["held"], pa.array(size), pa.array(known), pa.array(np.full(len(size), train_tokens)), pa.array(base_score), pa.array(scores), pa.array(bits)], names=schema.names)

    schema = T.StructType([T.StructField(ids, kind), T.StructField("held_out", T.BooleanType()), *(T.StructField(x, T.LongType()) for x in ("n_tokens", "n_known", "train_tokens")), *(T.StructField(x, T.DoubleType()) for x in ("base_score", "score", "bits_per_byte"))])
    return dealt.groupBy("b").cogroup(answers.groupBy("b")).applyInArrow(score, schema)
