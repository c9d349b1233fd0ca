"""Media columns: baseline JPEG written for bytes, and read by its scan's DC values.

A payload of bytes is stored as a grey baseline JPEG with one 8 x 8 block a byte: the
block's DC value is the byte (quantised by 8, so that a step is one grey level), there
are no AC values, and each row of blocks is a restart interval. Reading parses the markers,
decodes the Huffman codes of the scans and keeps each block's DC value, which is the
thumbnail of an eighth of the size; for a stored payload it is the payload, bit for bit.

The reader takes any baseline file of 8 bits (several components, subsampling, AC
values, scans with and without restarts). Restart intervals are decoded side by side.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import as_bytes, slices

#: A payload is padded to a multiple of this many bytes.
UNIT = 576
#: Blocks a row: a narrow picture for usual texts, a wide one beyond what the height allows.
NARROW, WIDE = 24, 576
MOST_ROWS = 8191
#: Fixed values of the format: the order of the 64 values of a block in a scan.
ZIGZAG = [
    0, 1, 8, 16, 9, 2, 3, 10, 17, 24, 32, 25, 18, 11, 4, 5, 12, 19, 26, 33, 40, 48, 41, 34, 27, 20, 13, 6, 7, 14, 21, 28,
    35, 42, 49, 56, 57, 50, 43, 36, 29, 22, 15, 23, 30, 37, 44, 51, 58, 59, 52, 45, 38, 31, 39, 46, 53, 60, 61, 54, 47, 55, 62, 63,
]
#: DC codes of four bits for the categories 0..9; the one AC code is the end of a block.
DC_BITS, END_OF_BLOCK = 4, 0


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 255, marker, len(body) + 2) + body


@cache
def _header(width: int, height: int) -> bytes:
    """All up to the scan's data for a grey picture of width x height blocks."""
    dc = bytes([0] * (DC_BITS - 1) + [10] + [0] * (16 - DC_BITS)) + bytes(range(10))
    ac = bytes([1] + [0] * 15) + bytes([END_OF_BLOCK])
    frame = struct.pack(">BHHB", 8, 8 * height, 8 * width, 1) + bytes([1, 0x11, 0])
    return b"".join(
        [b"\xff\xd8", _segment(0xDB, bytes([0] + [8] * 64)), _segment(0xC0, frame), _segment(0xC4, b"\x00" + dc), _segment(0xC4, b"\x10" + ac), _segment(0xDD, struct.pack(">H", width)), _segment(0xDA, bytes([1, 1, 0, 0, 63, 0]))]
    )


@cache
def _codes() -> tuple[np.ndarray, np.ndarray]:
    """(bits, length) of a block whose DC value differs by d, at index d + 255."""
    bits, length = np.zeros(511, np.int64), np.zeros(511, np.int64)
    for d in range(-255, 256):
        size = abs(d).bit_length()
        extra = d if d >= 0 else d + (1 << size) - 1
        bits[d + 255] = ((size << size) | extra) << 1  # and the end of the block, one 0
        length[d + 255] = DC_BITS + size + 1
    return bits, length


def _scan(blocks: np.ndarray) -> bytes:
    """Entropy-coded data of rows of blocks, a restart interval each."""
    rows, width = blocks.shape
    bits, length = _codes()
    at = np.diff(blocks.astype(np.int64), axis=1, prepend=128) + 255
    code, size = bits[at], length[at]
    ends = np.cumsum(size, axis=1)
    row_bytes = (ends[:, -1] + 7) // 8
    first = np.concatenate([[0], np.cumsum(row_bytes)])
    start = ends - size + first[:-1, None] * 8
    # A code has 14 bits at most: it lies in three bytes.
    word = (code << (24 - size - (start & 7))).ravel()
    byte = (start >> 3).ravel()
    n = int(first[-1]) + 3
    data = sum(np.bincount(byte + k, (word >> (16 - 8 * k)) & 255, n) for k in range(3)).astype(np.uint8)[:-3]
    pad = row_bytes * 8 - ends[:, -1]
    data[first[1:] - 1] |= ((1 << pad) - 1).astype(np.uint8)
    # Zero bytes after 255, restart markers between rows.
    stuffed = np.cumsum(data == 255)
    row = np.repeat(np.arange(rows), row_bytes)
    place = np.arange(len(data)) + stuffed - (data == 255) + 2 * row
    out = np.zeros(int(place[-1]) + 1 + int(data[-1] == 255), np.uint8)
    out[place] = data
    marker = place[first[1:-1]] - 2
    out[marker] = 255
    out[marker + 1] = 0xD0 + np.arange(rows - 1) % 8
    return out.tobytes()


def write_jpeg(payload: bytes) -> bytes:
    """A payload (a multiple of UNIT bytes, not empty) as one picture, or several in a row where one can't hold it."""
    out = []
    for start in range(0, len(payload), WIDE * MOST_ROWS):
        part = np.frombuffer(payload, np.uint8)[start : start + WIDE * MOST_ROWS]
        width = NARROW if len(part) <= NARROW * MOST_ROWS else WIDE
        blocks = part.reshape(-1, width)
        out += [_header(width, len(blocks)), _scan(blocks), b"\xff\xd9"]
    return b"".join(out)


class Tables:
    """A scan component's two Huffman tables as lookups by the next 16 bits."""

    def __init__(self, dc: tuple[bytes, bytes], ac: tuple[bytes, bytes]):
        self.dc_value, self.dc_size = self._lookup(*dc)
        self.ac_value, self.ac_size = self._lookup(*ac)
        # Where code, value and an end of block at once fit into 16 bits: the difference and all their bits.
        top = np.arange(1 << 16, dtype=np.int64)
        size, code = self.dc_value.astype(np.int64), self.dc_size.astype(np.int64)
        fits = (code > 0) & (code + size <= 15)
        shift = np.where(fits, 16 - code - size, 0)
        extra = (top >> shift) & ((1 << size) - 1)
        self.diff = np.where(extra >> np.maximum(size - 1, 0) & 1, extra, extra - (1 << size) + 1) * (size > 0)
        rest = (top << np.where(fits, code + size, 0)) & 0xFFFF
        left = 16 - code - size
        ends = fits & (self.ac_value[rest] == END_OF_BLOCK) & (self.ac_size[rest] > 0) & (self.ac_size[rest] <= left)
        self.whole = np.where(ends, code + size + self.ac_size[rest], 0)

    @staticmethod
    def _lookup(counts: bytes, symbols: bytes) -> tuple[np.ndarray, np.ndarray]:
        value, size = np.zeros(1 << 16, np.uint8), np.zeros(1 << 16, np.uint8)
        at = k = 0
        for bits, n in enumerate(counts, 1):
            for s in symbols[k : k + n]:
                to = at + (1 << (16 - bits))
                value[at:to], size[at:to] = s, bits
                at = to
            k += n
        return value, size


@cache
def _tables(dc: tuple[bytes, bytes], ac: tuple[bytes, bytes]) -> Tables:
    return Tables(dc, ac)


def _words(data: np.ndarray) -> np.ndarray:
    """The 32 bits from each byte on."""
    d = np.concatenate([data, np.full(8, 255, np.uint8)]).astype(np.uint32)
    return (d[:-3] << 24 | d[1:-2] << 16 | d[2:-1] << 8 | d[3:]).astype(np.int64)


def _decode(data: np.ndarray, starts: np.ndarray, layout: list[tuple[int, Tables]], units: np.ndarray) -> list[list[np.ndarray]]:
    """DC values of the intervals that start at bytes starts, side by side.

    layout: component and tables of each block of a unit; units: how many each interval
    has. Gives for each component a list of arrays, one for each of its blocks in turn.
    """
    words = _words(data)
    pos = starts.astype(np.int64) * 8
    last = {c: np.zeros(len(starts), np.int64) for c, _ in layout}
    out: dict[int, list[np.ndarray]] = {c: [] for c, _ in layout}
    top = len(words) * 8 - 1
    for step in range(int(units.max(initial=0))):
        live = units > step
        everyone = bool(live.all())
        for c, t in layout:
            bits = (words[pos >> 3] >> (16 - (pos & 7))) & 0xFFFF
            size = t.whole[bits]
            diff = t.diff[bits]
            if not everyone:
                size, diff = np.where(live, size, 1), np.where(live, diff, 0)
            if size.all():
                pos = np.minimum(pos + size, top) if not everyone else pos + size
            else:
                slow = np.flatnonzero(size == 0)
                moved, slow_diff = _decode_slow(words, pos[slow], t)
                pos = pos + size
                pos[slow], diff = moved, diff.copy()
                diff[slow] = slow_diff
            last[c] = last[c] + diff
            out[c].append(last[c])
    return [out[c] for c in sorted(out)]


def _decode_slow(words: np.ndarray, pos: np.ndarray, t: Tables) -> tuple[np.ndarray, np.ndarray]:
    """One block of each position with any AC values: the positions after it and the DC differences."""

    def peek(p: np.ndarray, n: int) -> np.ndarray:
        return (words[p >> 3] >> (32 - n - (p & 7))) & ((1 << n) - 1)

    bits = peek(pos, 16)
    if not t.dc_size[bits].all():
        raise ValueError("no Huffman code of the table")
    size = t.dc_value[bits].astype(np.int64)
    pos = pos + t.dc_size[bits]
    extra = peek(pos, 16) >> (16 - size)
    diff = np.where(extra >> np.maximum(size - 1, 0) & 1, extra, extra - (1 << size) + 1) * (size > 0)
    pos = pos + size
    k = np.ones(len(pos), np.int64)
    todo = np.arange(len(pos))
    while len(todo):
        bits = peek(pos[todo], 16)
        if not t.ac_size[bits].all():
            raise ValueError("no Huffman code of the table")
        symbol = t.ac_value[bits].astype(np.int64)
        pos[todo] += t.ac_size[bits] + (symbol & 15)
        run, value = symbol >> 4, symbol & 15
        end = (value == 0) & (run != 15)
        k[todo] += run + 1
        todo = todo[~end & (k[todo] < 64)]
    return pos, diff


class Picture:
    """What the markers of one picture say, and its entropy-coded bytes."""

    def __init__(self, raw: bytes, at: int):
        self.quant: dict[int, int] = {}
        self.huffman: dict[int, tuple[bytes, bytes]] = {}
        self.restart = 0
        self.parts: list[dict] = []
        if raw[at : at + 2] != b"\xff\xd8":
            raise ValueError("no start of image")
        at += 2
        while True:
            while raw[at : at + 1] == b"\xff" and raw[at + 1 : at + 2] == b"\xff":
                at += 1
            if raw[at : at + 1] != b"\xff" or at + 1 >= len(raw):
                raise ValueError("no marker where one is due")
            marker = raw[at + 1]
            if marker == 0xD9:
                self.end = at + 2
                return
            n = struct.unpack(">H", raw[at + 2 : at + 4])[0]
            body, at = raw[at + 4 : at + 2 + n], at + 2 + n
            if marker == 0xDB:
                self._quantisers(body)
            elif marker == 0xC4:
                self._huffman(body)
            elif marker == 0xC0:
                _, self.height, self.width, count = struct.unpack(">BHHB", body[:6])
                self.components = {body[6 + 3 * k]: (body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(count)}
            elif 0xC1 <= marker <= 0xCF and marker != 0xCC and marker != 0xC8:
                raise ValueError("not a baseline picture")
            elif marker == 0xDD:
                self.restart = struct.unpack(">H", body)[0]
            elif marker == 0xDA:
                at = self._start_of_scan(raw, body, at)

    def _quantisers(self, body: bytes) -> None:
        k = 0
        while k < len(body):
            wide = body[k] >> 4
            self.quant[body[k] & 15] = int.from_bytes(body[k + 1 : k + 2 + wide], "big")  # of DC, the first in the order of a scan
            k += 1 + 64 * (1 + wide)

    def _huffman(self, body: bytes) -> None:
        k = 0
        while k < len(body):
            n = sum(body[k + 1 : k + 17])
            self.huffman[body[k]] = (body[k + 1 : k + 17], body[k + 17 : k + 17 + n])
            k += 17 + n

    def _start_of_scan(self, raw: bytes, body: bytes, at: int) -> int:
        end = at
        while True:
            end = raw.find(b"\xff", end)
            if end < 0:
                raise ValueError("a scan without end")
            if end + 1 < len(raw) and (raw[end + 1] == 0 or 0xD0 <= raw[end + 1] <= 0xD7):
                end += 2
            else:
                break
        chosen = [(body[1 + 2 * k], self.huffman[body[2 + 2 * k] >> 4], self.huffman[16 | body[2 + 2 * k] & 15]) for k in range(body[0])]
        self.parts.append({"components": chosen, "data": raw[at:end], "restart": self.restart})
        return end

    def units(self, part: dict) -> tuple[int, int, int]:
        """Units of a scan in a row, in a column, and in an interval."""
        most_h = max(h for h, _, _ in self.components.values())
        most_v = max(v for _, v, _ in self.components.values())
        if len(part["components"]) == 1:
            h, v, _ = self.components[part["components"][0][0]]
            across, down = -(-(-(-self.width * h // most_h)) // 8), -(-(-(-self.height * v // most_v)) // 8)
        else:
            across, down = -(-self.width // (8 * most_h)), -(-self.height // (8 * most_v))
        return across, down, part["restart"] or across * down


def _intervals(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a scan without stuffing and markers, and where each interval starts."""
    d = np.frombuffer(data, np.uint8)
    ff = np.flatnonzero(d[:-1] == 255)
    after = d[ff + 1]
    keep = np.ones(len(d), bool)
    keep[ff[after == 0] + 1] = False
    marks = ff[(after >= 0xD0) & (after <= 0xD7)]
    keep[marks] = keep[marks + 1] = False
    gone = np.cumsum(~keep)
    return d[keep], np.concatenate([[0], marks + 2 - gone[marks + 1]]).astype(np.int64)


def read_thumbnails(files: list[bytes]) -> list[list[np.ndarray]]:
    """The DC-only luminance thumbnail of each picture of each file, as arrays of 0..255.

    The scans of all files with the same tables and units are decoded at once.
    """
    pictures: list[list[Picture]] = []
    for raw in files:
        at, found = 0, []
        while at < len(raw):
            found.append(Picture(raw, at))
            at = found[-1].end
        pictures.append(found)
    jobs: dict[tuple, list[tuple[Picture, dict]]] = {}
    for p in (p for found in pictures for p in found):
        luma = next(iter(p.components))
        for part in p.parts:
            if luma in [c for c, _, _ in part["components"]]:
                alone = len(part["components"]) == 1
                layout = tuple((k, dc, ac, 1 if alone else p.components[c][0] * p.components[c][1]) for k, (c, dc, ac) in enumerate(part["components"]))
                jobs.setdefault(layout, []).append((p, part))
    done: dict[int, np.ndarray] = {}
    for layout, own in jobs.items():
        blocks = [(k, _tables(dc, ac)) for k, dc, ac, n in layout for _ in range(n)]
        split = [_intervals(part["data"]) for _, part in own]
        base = np.concatenate([[0], np.cumsum([len(d) for d, _ in split])])
        starts = np.concatenate([s + b for (_, s), b in zip(split, base[:-1], strict=True)])
        units = []
        for (p, part), (_, s) in zip(own, split, strict=True):
            across, down, each = p.units(part)
            n = -(-across * down // each)
            if n != len(s):
                raise ValueError("a scan has not the intervals that its frame asks for")
            units += [each] * (n - 1) + [across * down - each * (n - 1)]
        lengths = np.array(units)
        values = _decode(np.concatenate([d for d, _ in split]), starts, blocks, lengths)
        k = 0
        for (p, part), (_, s) in zip(own, split, strict=True):
            which = [c for c, _, _ in part["components"]].index(next(iter(p.components)))
            done[id(p)] = _arrange(p, part, [v[k : k + len(s)] for v in values[which]], lengths[k : k + len(s)])
            k += len(s)
    return [[done[id(p)] for p in found] for found in pictures]


def _arrange(p: Picture, part: dict, values: list[np.ndarray], units: np.ndarray) -> np.ndarray:
    """DC values in the order of a scan, as the picture of luminance blocks."""
    h, v, q = p.components[next(iter(p.components))]
    across, down, _ = p.units(part)
    per = 1 if len(part["components"]) == 1 else h * v
    stack = np.stack(values, axis=1)  # interval, unit and block
    flat = stack[:, : units[0] * per].reshape(-1, per) if (units == units[0]).all() else np.concatenate([row[: n * per].reshape(-1, per) for row, n in zip(stack, units, strict=True)])
    if per == 1:
        grid = flat.reshape(down, across)
    else:
        grid = flat.reshape(down, across, v, h).transpose(0, 2, 1, 3).reshape(down * v, across * h)
    most_h, most_v = max(x[0] for x in p.components.values()), max(x[1] for x in p.components.values())
    wide, high = -(-p.width * h // (8 * most_h)), -(-p.height * v // (8 * most_v))
    return np.clip((grid[:high, :wide] * p.quant[q] + 4) // 8 + 128, 0, 255).astype(np.uint8)


def thumbnail_hash(picture: np.ndarray) -> int:
    """64 bits: which of 8 x 8 cells (means over the thumbnail, as even as they can be) lie over the mean of all cells."""

    def halves(n: int) -> np.ndarray:
        return np.arange(9) * n // 8

    rows, columns = halves(picture.shape[0]), halves(picture.shape[1])
    total = np.zeros((picture.shape[0] + 1, picture.shape[1] + 1), np.int64)
    total[1:, 1:] = picture.astype(np.int64).cumsum(0).cumsum(1)
    area = np.maximum(np.outer(np.diff(rows), np.diff(columns)), 1)
    cells = np.diff(np.diff(total[np.ix_(rows, columns)], axis=0), axis=1) / area
    return int.from_bytes(np.packbits(cells > cells.mean()).tobytes(), "big")


def payload_of(text: bytes) -> bytes:
    """The text, and bytes 255 up to a positive multiple of UNIT."""
    return text + b"\xff" * (-len(text) % UNIT if text else UNIT)


def store_media(df: DataFrame, ids: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of df: the id column, n_bytes (of the text) and media, the JPEG bytes that hold it.

    A null or empty text is a payload of padding alone. Very long texts take several
    pictures in a row. Repeated rows stay; other columns of df are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "t", 1 << 20):
            texts = as_bytes(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array([write_jpeg(payload_of(t)) for t in texts], pa.binary())], [ids, "n_bytes", "media"])

    schema = T.StructType([T.StructField(ids, df.schema[ids].dataType), T.StructField("n_bytes", T.LongType()), T.StructField("media", T.BinaryType())])
    return df.select(df[ids], df[text].cast("string").alias("t")).mapInArrow(run, schema)


def read_media(df: DataFrame, keep: tuple[str, ...] = ("doc_id", "n_bytes"), media: str = "media") -> DataFrame:
    """The kept columns, and of each row's pictures: width, height, thumbnail (bytes, row by row), thumbnail_hash and tail_crc32 (of the last 32 bytes of the thumbnail); media too.

    width and height are of the first picture, the hash is of all thumbnails one below
    the other where they are equally wide, else of the first. A null media gives nulls;
    bytes that are no baseline JPEG raise ValueError.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, media, 2 << 20):
            at = b.schema.get_field_index(media)
            raw = b.column(at).to_pylist()
            there = [k for k, x in enumerate(raw) if x is not None]
            rows: list[tuple] = [(None,) * 5] * len(raw)
            for k, found in zip(there, read_thumbnails([raw[k] for k in there]), strict=True):
                payload = b"".join(x.tobytes() for x in found)
                whole = np.concatenate(found) if len({x.shape[1] for x in found}) == 1 else found[0]
                rows[k] = (found[0].shape[1] * 8, found[0].shape[0] * 8, payload, f"{thumbnail_hash(whole):016x}", zlib.crc32(payload[-32:]))
            c = list(zip(*rows, strict=True))
            arrays = [pa.array(c[0], pa.int32()), pa.array(c[1], pa.int32()), pa.array(c[2], pa.binary()), pa.array(c[3], pa.string()), pa.array(c[4], pa.int64())]
            yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index(k)) for k in (*keep, media)] + arrays, schema.names)

    own = [T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType()), T.StructField("thumbnail", T.BinaryType()), T.StructField("thumbnail_hash", T.StringType()), T.StructField("tail_crc32", T.LongType())]
    schema = T.StructType([df.schema[k] for k in (*keep, media)] + own)
    return df.select(*keep, media).mapInArrow(run, schema)
