"""Sum-of-squares packing of tokenised documents into sequences of bounded length."""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from .bpe import ChunkCache, RankEncoder
from .common import as_texts, free_caches, kept_in_worker, materialise, slices

#: Pieces that one task packs; more pieces make more shards, of this size at most on average.
SHARD = 50_000
#: Shards are this far apart in sequence numbers; a shard opens fewer sequences than it has pieces.
SHARD_STRIDE = 1 << 32


class DocumentTokens:
    """Ids of whole texts by a tokenizers file, remembered by chunk.

    ranks names the same vocabulary as a rank file: chunks are then encoded from ranks,
    which gives the same ids in a third of the time (tests hold both against each other,
    so op2's ids are those of the tokenizers file, made from the same vocabulary's ranks).
    Texts that hold an added token's string always go through the tokenizers file.
    """

    def __init__(self, path: str, ranks: str | None):
        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.cache = ChunkCache(RankEncoder(ranks).encode if ranks else self.encode_all)

    def encode_all(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Packed ids: little-endian, unsigned, 32 bits."""
        whole = [i for i, t in enumerate(texts) if any(s in t for s in self.special)]
        if not whole:
            return self.cache.encode(texts)
        found = dict(zip(whole, self.encode_all([texts[i] for i in whole]), strict=True))
        rest = iter(self.cache.encode([t for i, t in enumerate(texts) if i not in found]))
        return [found[i] if i in found else next(rest) for i in range(len(texts))]


_made: dict[tuple, DocumentTokens] = {}


def document_tokens(path: str, ranks: str | None) -> DocumentTokens:
    """The worker's own tokens, made once a process, or again after free_caches."""
    if (path, ranks) not in _made:
        free_caches()
        kept_in_worker(_made.clear)
        _made[path, ranks] = DocumentTokens(path, ranks)
    return _made[path, ranks]


def token_pieces(df: DataFrame, ids: str = "doc_id", text: str = "text", path: str | None = None, ranks: str | None = None, end: int = 2, capacity: int = 1024, with_ids: bool = False) -> DataFrame:
    """One row per piece: id column, piece, start, length, ids_crc32 (and ids).

    A document is its ids and then `end`; a null or empty text is `end` alone. Only
    longer documents are cut: the first piece takes what is over full pieces. Repeated
    rows are pieces of their own; other columns of df are not read.
    """
    if path is None:
        path, ranks = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")
    last = np.array([end], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = document_tokens(path, ranks)
        for b in slices(batches, "t"):
            rows: list[tuple] = []
            for i, packed in enumerate(tokens.encode(as_texts(b.column(1)))):
                packed += last
                n = len(packed) // 4
                start, stop = 0, (n - 1) % capacity + 1
                piece = 0
                while start < n:
                    part = packed[4 * start : 4 * stop]
                    rows.append((i, piece, start, stop - start, zlib.crc32(part), part if with_ids else None))
                    start, stop, piece = stop, stop + capacity, piece + 1
            c = list(zip(*rows, strict=True))
            out = [b.column(0).take(pa.array(c[0], pa.int64())), pa.array(c[1], pa.int32()), *(pa.array(x, pa.int64()) for x in c[2:5])]
            yield pa.RecordBatch.from_arrays(out + [pa.array(c[5], pa.binary())] * with_ids, names)

    schema = T.StructType([T.StructField(ids, df.schema[ids].dataType), T.StructField("piece", T.IntegerType()), *(T.StructField(x, T.LongType()) for x in ("start", "length", "ids_crc32"))] + [T.StructField("ids", T.BinaryType())] * with_ids)
    names = schema.names
    return df.select(df[ids], df[text].cast("string").alias("t")).mapInArrow(run, schema)


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of each length, in the order given.

    count[g] is the number of open sequences with gap g. A piece goes where the sum of
    count[g] ** 2 over the gaps 1..capacity-1 becomes smallest, ties to the smallest gap.
    A new sequence is opened only for a piece that fits in no open one: with lengths
    from long to short that leaves 0.1 % over the lower bound, where the choice of a new
    sequence by the same sum left 2 %.
    """
    none = np.iinfo(np.int64).max
    count = np.zeros(capacity + 1, np.int64)
    open_at: list[list[int]] = [[] for _ in range(capacity + 1)]
    sequence, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    opened = 0
    for i, n in enumerate(lengths.tolist()):
        gap = capacity
        if n < capacity:
            # Gap g >= n loses one, gap g - n gains one; gap 0 is closed and not counted.
            change = 2 * (count[: capacity - n] - count[n:capacity]) + 2
            change[0] = 1 - 2 * count[n]
            change[count[n:capacity] == 0] = none
            best = int(change.argmin())
            if change[best] < none:
                gap = best + n
        if gap < capacity:
            s = open_at[gap].pop()
            count[gap] -= 1
        else:
            s = opened
            opened += 1
        sequence[i], offset[i] = s, capacity - gap
        if gap > n:
            open_at[gap - n].append(s)
            count[gap - n] += 1
    return sequence, offset


def pack(pieces: DataFrame, capacity: int = 1024, shard: int = SHARD) -> DataFrame:
    """Adds sequence_id and offset to the pieces, each of at most capacity tokens.

    Full pieces are sequences of their own. The others are dealt at random over as many
    shards as their number asks for, and each shard is packed from its longest piece
    down, so that a task holds a bounded number of pieces at any size and the loss is
    the few sequences that each shard leaves open. pieces is written once, as its count
    decides the shards. An empty table gives none; extra columns are kept.
    """
    # The row's number is written with it, so that equal rows part ways and a retried task deals them alike.
    pieces = materialise(pieces.withColumn("_row", F.monotonically_increasing_id()))
    shards = max(1, -(-pieces.count() // shard))
    keyed = pieces.withColumn("_shard", F.pmod(F.xxhash64("_row"), F.lit(shards))).drop("_row")
    schema = T.StructType(keyed.schema.fields + [T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def run(table: pa.Table) -> pa.Table:
        lengths = table["length"].to_numpy()
        order = np.lexsort((*(table[c].to_numpy() for c in ("ids_crc32", "start")), -lengths))
        sequence, offset = np.empty(len(order), np.int64), np.empty(len(order), np.int64)
        sequence[order], offset[order] = sum_of_squares(lengths[order], capacity)
        first = int(table["_shard"][0].as_py()) * SHARD_STRIDE
        return table.append_column("sequence_id", pa.array(sequence + first)).append_column("offset", pa.array(offset))

    return keyed.groupBy("_shard").applyInArrow(run, schema).drop("_shard")
