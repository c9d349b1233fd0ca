"""Byte-level BPE through sentencepiece: a model serialised from a rank file.

Every byte b of a text becomes the character U+0100 + b, every vocabulary entry the
string of its bytes' characters, scored by its negative rank. With identity
normalisation sentencepiece then merges the adjacent pair of the lowest rank, the
leftmost first, as a byte-level BPE does. Pre-tokens are kept apart by a character
that no piece holds. Decoding maps ids back to their bytes.
"""

from __future__ import annotations

import base64
import re
import struct
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import as_bytes, remembered, slices

#: First character of the byte alphabet, and the one that separates pre-tokens.
BYTE_BASE, SEPARATOR = 0x100, "Ȁ"
CHUNK_END = re.compile(r"(?<=\S)(?= )")
SPACE_BEFORE_SPACE = re.compile(r"(?:\s|^) ")
#: Chunks of a generation that a worker remembers.
CACHE = 120_000


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, value: bytes | int | float) -> bytes:
    """A protobuf field: bytes, an integer (varint) or a float (32 bits)."""
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value)


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from lines of base64 and rank."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def to_characters(raw: bytes) -> str:
    return (np.frombuffer(raw, np.uint8).astype("<u2") + np.uint16(BYTE_BASE)).tobytes().decode("utf-16-le")


def model_proto(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece BPE model; piece i is the token of the i-th rank, the last one unknown."""
    normal, unknown, bpe = 1, 2, 2
    pieces = [_field(1, to_characters(t).encode()) + _field(2, float(-r)) + _field(3, normal) for t, r in sorted(ranks.items(), key=lambda x: x[1])]
    pieces.append(_field(1, b"\xe2\x96\x81unknown") + _field(2, 0.0) + _field(3, unknown))
    trainer = _field(3, bpe) + _field(4, len(pieces)) + _field(40, len(ranks)) + b"".join(_field(n, (1 << 64) - 1) for n in (41, 42, 43))
    normalizer = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(_field(1, p) for p in pieces) + _field(2, trainer) + _field(3, normalizer)


class ChunkCache:
    """Encodes texts chunk by chunk, where a chunk ends before each space that follows a non-space.

    A pre-token never starts inside such a boundary's left side and ends on its right,
    so the chunks' ids, joined, are the text's ids. encode_missing gets the chunks
    not seen yet and returns the packed ids of each. Short chunks are remembered in two
    generations of about size each: what is in use moves on, the rest is forgotten.
    """

    def __init__(self, encode_missing: Callable[[list[str]], list[bytes]], size: int = CACHE):
        self.encode_missing, self.size = encode_missing, size
        self.known: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}

    @staticmethod
    def chunks(text: str) -> list[str]:
        if SPACE_BEFORE_SPACE.search(text):
            return CHUNK_END.split(text)
        parts = text.split(" ")
        return [parts[0], *map(" ".__add__, parts[1:])]

    def encode(self, texts: list[str]) -> list[bytes]:
        cut = [self.chunks(t) for t in texts]
        if len(self.known) > self.size:
            self.known, self.before = {}, self.known
        found = remembered(set().union(*cut), self.known, self.before, self.encode_missing)
        return [b"".join(map(found.__getitem__, chunks)) for chunks in cut]


class ByteBPE:
    """Encoder and decoder for one rank file. Without special tokens."""

    def __init__(self, path: str, pattern: str = public_tokenizers.PATTERN):
        self.ranks = read_ranks(path)
        in_order = sorted(self.ranks.items(), key=lambda x: x[1])
        self.id_of = np.array([r for _, r in in_order] + [0], "<u4")
        self.bytes_of = {r: t for t, r in in_order}
        self.pattern = regex.compile(pattern)
        self.pieces = sentencepiece.SentencePieceProcessor(model_proto=model_proto(self.ranks))
        self.cache = ChunkCache(self.encode_chunks)

    def encode_chunks(self, chunks: list[str]) -> list[bytes]:
        """Packed ids (little-endian, unsigned, 32 bits) of each chunk."""
        split = [self.pattern.findall(c) for c in chunks]
        new = [x.encode() for x in {x for s in split for x in s}]
        ids = {}
        merge = []
        for raw in new:
            if raw in self.ranks:
                ids[raw] = struct.pack("<I", self.ranks[raw])
            else:
                merge.append(raw)
        for k in range(0, len(merge), 2000):
            part = merge[k : k + 2000]
            flat = np.asarray(self.pieces.encode(SEPARATOR.join(map(to_characters, part))), np.int64)
            ends = np.flatnonzero(flat == len(self.ranks))
            packed = self.id_of[flat]
            for raw, run in zip(part, np.split(packed, ends), strict=True):
                ids[raw] = run.tobytes()
            for raw in part[1:]:
                ids[raw] = ids[raw][4:]
        return [b"".join([ids[x.encode()] for x in s]) for s in split]

    def encode(self, texts: list[str]) -> list[bytes]:
        return self.cache.encode(texts)

    def decode(self, packed: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(packed, "<u4").tolist()))


_made: dict[tuple[str, str], ByteBPE] = {}


def byte_bpe(path: str, pattern: str) -> ByteBPE:
    """The worker's own encoder, made once a process."""
    key = (path, pattern)
    if key not in _made:
        _made[key] = ByteBPE(path, pattern)
    return _made[key]


class RankEncoder:
    """Packed ids of strings by a rank file, through tiktoken; its pattern matcher overflows on long runs of blanks, so long strings go through ByteBPE."""

    LONG = 2000

    def __init__(self, path: str):
        self.path = path
        self.by_rank = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(path), special_tokens={})

    def encode(self, strings: list[str], code: str = "I") -> list[bytes]:
        """Ids as unsigned 32-bit numbers, or as another array type code says."""
        encode = self.by_rank.encode_ordinary
        return [array(code, encode(s) if len(s) <= self.LONG else self.long_ids(s)).tobytes() for s in strings]

    def long_ids(self, s: str) -> list[int]:
        return np.frombuffer(byte_bpe(self.path, public_tokenizers.PATTERN).encode_chunks([s])[0], "<u4").tolist()


def bpe_encode(df: DataFrame, ids: str = "doc_id", text: str = "text", path: str | None = None, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """One row per row of df: the id column and `ids`, the packed ids of the whole text.

    Null and empty texts have empty ids; repeated rows stay repeated; other columns of
    df are not read. Memory: a slice of a few MB of text and a bounded cache a worker.
    """
    path = path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(path, pattern)
        for b in slices(batches, "t"):
            texts = [x or "" for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(bpe.encode(texts), pa.binary())], [ids, "ids"])

    schema = T.StructType([T.StructField(ids, df.schema[ids].dataType), T.StructField("ids", T.BinaryType())])
    return df.select(df[ids], df[text].cast("string").alias("t")).mapInArrow(run, schema)


def bpe_decode(df: DataFrame, ids: str = "doc_id", path: str | None = None, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """Adds `decoded`, the bytes that the packed `ids` stand for; null ids as empty ones."""
    path = path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(path, pattern)
        for b in slices(batches, "ids", 8 << 20):
            packed = as_bytes(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(packed, pa.binary()), pa.array(map(bpe.decode, packed), pa.binary())], [ids, "ids", "decoded"])

    schema = T.StructType([T.StructField(ids, df.schema[ids].dataType), T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.BinaryType())])
    return df.select(df[ids], df["ids"]).mapInArrow(run, schema)
