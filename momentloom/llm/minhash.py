"""Near duplicates by MinHash: universal hash minima, bands, signatures, exact sets, components.

A set's signature has one minimum for each of many universal hash functions of its shingles'
64-bit hashes. Four neighbouring minima make a band; sets that agree in a band meet. With
so many bands a pair at the threshold meets in none with a chance of at most MISSED. A
pair that meets goes on if enough minima agree, with a bound that drops a pair at the threshold
with a chance of at most MISSED too, and is then decided by its two whole sets. Links are
contracted by alternating large-star and small-star steps.

The number of minima leaves pairs well below the threshold in; a parity bitmap beside the signature
(see jaccard.py) bounds the overlap from above, so that these go before whole sets are read.

Members of a band's bucket are first held against one of them, then only buckets that still
have several components are compared, in blocks (see jaccard.py): no bucket emits its pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .jaccard import BLOCK, components_of_tiles, mix, parity_bitmap, parity_bound, profile_table, set_nodes

#: Minima in a band: sixteen bits each, so that a band is a 64-bit word.
BAND = 4
#: Most chance that a pair at the threshold shares no band, or is dropped by its signatures.
MISSED = 1e-10
#: Elements hashed at once: a long set is hashed in pieces.
PIECE = 1 << 16


@cache
def bands(threshold: int) -> int:
    """Bands that a pair of similarity threshold / 100 needs."""
    return 1 if threshold >= 100 else math.ceil(math.log(MISSED) / math.log1p(-((threshold / 100) ** BAND)))


@cache
def least_agreeing(threshold: int) -> int:
    """Fewer agreeing minima than this have a chance of at most MISSED for a pair of similarity threshold / 100."""
    n, p = BAND * bands(threshold), threshold / 100
    below = 0.0
    for k in range(n + 1):
        below += math.comb(n, k) * p**k * (1 - p) ** (n - k)
        if below > MISSED:
            return k
    return n


@cache
def universal(n: int) -> tuple[np.ndarray, np.ndarray]:
    """n functions x -> a * x + b modulo 2 ** 64, with odd a, from a fixed seed."""
    rng = np.random.Generator(np.random.PCG64(20))
    a, b = rng.integers(0, 1 << 63, (2, n), np.uint64)
    return a * np.uint64(2) + np.uint64(1), b


def signature(shingles: np.ndarray, threshold: int) -> bytes:
    """Sixteen mixed bits of each minimum, four to a 64-bit word; of an empty set, zeros."""
    a, b = universal(BAND * bands(threshold))
    least = np.full(len(a), np.iinfo(np.uint64).max)
    rows = max(1, PIECE // len(a))
    for at in range(0, len(shingles), rows):
        np.minimum(least, (shingles[at : at + rows, None] * a + b).min(0), out=least)
    return (mix(least) & np.uint64(0xFFFF)).astype("<u2").tobytes() if len(shingles) else bytes(2 * len(a))


def signature_bound(x: np.ndarray, y: np.ndarray, total: np.ndarray, threshold: int) -> np.ndarray:
    """Whether enough minima agree, and the bitmaps behind them allow enough common elements."""
    n = bands(threshold)
    keep = parity_bound(x[..., n:], y[..., n:], total, threshold)
    at = np.flatnonzero(keep)
    lanes = lambda words: np.ascontiguousarray(words[..., :n]).view(np.uint16)
    keep[at] = (lanes(x[at]) == lanes(y[at] if y.ndim > 1 else y)).sum(-1) >= least_agreeing(threshold)
    return keep


def _buckets(threshold: int):
    """(tile, node) for each band of each node: a hash of the band's number and its minima."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = bands(threshold)
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                b = batch.slice(at, 2048)
                words = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint64).reshape(b.num_rows, -1)[:, :n]
                tile = mix(words + mix(np.arange(1, n + 1, dtype=np.uint64)))
                yield pa.RecordBatch.from_arrays([pa.array(tile.reshape(-1).view(np.int64)), pa.array(np.repeat(b.column(0).to_numpy(), n))], ["tile", "node"])

    return run


def minhash_components(df: DataFrame, ids: str = "doc_id", text: str = "text", width: int = 5, threshold: int = 80, block: int = BLOCK) -> DataFrame:
    """One row per row of df: ids, n_shingles, component_id and kept (whether it is the one its component keeps).

    Documents whose sets of width-word shingles reach the Jaccard similarity
    threshold / 100 link; component_id is the smallest id reachable, the row's own for
    a document without links. A link at the threshold itself is missed with a chance of
    at most 2 * MISSED, a closer one with less; none is added, as whole sets decide. Null and empty
    texts have no shingles and no links; repeated rows are copies of each other and of one id, so
    kept alike; rows without an id link nothing, have no component and are kept. Other
    columns of df are not read.

    Equal sets are one node. Written tables: a profile of two bytes a hash function for each
    document and node (256 at 0.85) and a bitmap of 128, the buckets with several members, the links.
    """
    base, profiles = profile_table(df, ids, text, width, lambda s: signature(s, threshold) + parity_bitmap(s))
    nodes = set_nodes(profiles)
    rows = nodes.select("h1", "bits").mapInArrow(_buckets(threshold), "tile long, node long")
    found = components_of_tiles(base, profiles, nodes, rows, width, threshold, block, signature_bound)
    return found.select(F.col("i").alias(ids), "n_shingles", "component_id", F.coalesce(F.col("i") == F.col("component_id"), F.lit(True)).alias("kept"))
