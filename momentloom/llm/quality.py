"""Quality rules: counts of a text, and how public vocabularies' tokens fit its words.

Each vocabulary gives three measures of a text: characters a token, the share of tokens
that are single bytes (byte fallback), and the entropy of its tokens. Entropy grows with
a text's length, so it is held against what good texts of that length have. Bands
around good texts, for each language or else script, decide which texts are rejected.
"""

from __future__ import annotations

import itertools
import re
from array import array
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import RankEncoder, read_ranks
from .common import ASCII_SPACE, as_texts, crc_mod, free_caches, kept_in_worker, materialise, remembered, slices

SYMBOLS = "#*$%&|<>"
#: Words of a generation whose ids a worker remembers.
CACHE = 200_000
#: The vocabularies that measure: a name for the columns, and the file.
VOCABULARIES = (("piece", "piece_bpe_32k.model"), ("byte", "byte_bpe_multi_50k.tiktoken"))
MEASURES = ("tokens", "chars_per_token", "byte_share", "entropy")
#: A band ends so many times as far from the median as the tail that holds TAIL of the good texts begins.
REACH, TAIL = 3.5, 0.05
#: Good texts that a language or a script must have for a band of its own.
LEAST_ROWS = 40


def _encoder(path: str) -> tuple[np.ndarray, Callable[[list[str]], list[bytes]]]:
    """Which tokens of a vocabulary are single bytes, and its ids of words, each encoded by itself, as unsigned 16-bit numbers."""
    if path.endswith(".model"):
        pieces = sentencepiece.SentencePieceProcessor(model_file=path)
        single = np.array([pieces.is_byte(i) for i in range(pieces.get_piece_size())])
        return single, lambda words: [array("H", x).tobytes() for x in pieces.encode(words, num_threads=1)]
    ranks = read_ranks(path)
    single = np.zeros(max(ranks.values()) + 1, bool)
    single[[r for t, r in ranks.items() if len(t) == 1]] = True
    encoder = RankEncoder(path)
    return single, lambda words: encoder.encode([" " + w for w in words], "H")


class Fertility:
    """Measures of texts under vocabularies; short words' ids are remembered."""

    def __init__(self, paths: tuple[str, ...]):
        self.encoders = [_encoder(p) for p in paths]
        self.known: dict[str, tuple[bytes, ...]] = {}
        self.before: dict[str, tuple[bytes, ...]] = {}

    def ids(self, words: list[str]) -> list[tuple[bytes, ...]]:
        return list(zip(*(encode(words) for _, encode in self.encoders), strict=True))

    def measures(self, words: dict[str, int], chars: int) -> list[tuple[int, float, float, float]]:
        """For each vocabulary (tokens, characters a token, single-byte share, entropy in bits) of words and how often they occur; of no words 0."""
        return self.measures_of([words], [chars])[0]

    def measures_of(self, texts: list[dict[str, int]], chars: list[int]) -> list[list[tuple[int, float, float, float]]]:
        """measures of several texts at once: words that are not known are encoded in one call of each vocabulary, and tokens of all texts are sorted together."""
        if len(self.known) > CACHE:
            self.known, self.before = {}, self.known
        found = remembered(set().union(*texts), self.known, self.before, self.ids)
        own = [found[w] for words in texts for w in words]
        times = np.fromiter(itertools.chain.from_iterable(words.values() for words in texts), np.int64, len(own))
        text = np.repeat(np.arange(len(texts)), list(map(len, texts)))
        return list(zip(*(self._measure([x[k] for x in own], times, text, single, chars) for k, (single, _) in enumerate(self.encoders)), strict=True))

    @staticmethod
    def _measure(own: list[bytes], times: np.ndarray, text: np.ndarray, single: np.ndarray, chars: list[int]) -> list[tuple[int, float, float, float]]:
        each = np.fromiter(map(len, own), np.int64, len(own)) // 2
        ids = np.frombuffer(b"".join(own), np.uint16)
        times, key = np.repeat(times, each), np.repeat(text, each) << 16 | ids
        order = np.argsort(key)
        key, times = key[order], times[order]
        first = np.flatnonzero(np.diff(key, prepend=-1))
        sums = np.add.reduceat(times, first) if len(first) else times
        text, ids = key[first] >> 16, key[first] & 0xFFFF
        n = np.bincount(text, sums, len(chars)).astype(np.int64)
        bytes_ = np.bincount(text, sums * single[ids], len(chars))
        p = sums / n[text]
        terms = p * np.log2(p)
        edges = np.searchsorted(text, np.arange(len(chars) + 1)).tolist()
        return [(k, c / k, x / k, max(0.0, -float(terms[a:z].sum()))) if k else (0, 0.0, 0.0, 0.0) for k, c, x, (a, z) in zip(n.tolist(), chars, bytes_.tolist(), itertools.pairwise(edges), strict=True)]


_made: dict[tuple[str, ...], Fertility] = {}


def fertility(paths: tuple[str, ...]) -> Fertility:
    """The worker's own measures, made once a process."""
    if paths not in _made:
        free_caches()
        kept_in_worker(_made.clear)
        _made[paths] = Fertility(paths)
    return _made[paths]


def numbered(words: list[str]) -> tuple[dict[str, int], np.ndarray]:
    """Numbers of distinct words in the order in which they come, and each word's number."""
    number: defaultdict[str, int] = defaultdict()
    number.default_factory = number.__len__
    return number, np.fromiter(map(number.__getitem__, words), np.int64, len(words))


def repeated_window_words(words: list[str], width: int = 3) -> int:
    """Words that lie in windows of width words which the text holds twice or more."""
    return _in_repeated_windows(*numbered(words), width)


def _in_repeated_windows(number: dict[str, int], x: np.ndarray, width: int = 3) -> int:
    if len(x) <= width or len(number) == len(x):
        return 0
    window = x[: len(x) - width + 1]
    for k in range(1, width):
        # Numbers of the windows so far, then of those with one word more: both stay below the text's length.
        if len(number) * (int(window.max()) + 1) >= 1 << 62:
            window = np.unique(window, return_inverse=True)[1]
        window = window * len(number) + x[k : len(x) - width + 1 + k]
    order = np.sort(window)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return 0
    at = np.searchsorted(twice, window)
    found = twice[np.minimum(at, len(twice) - 1)] == window
    inside = np.zeros(len(x), bool)
    for k in range(width):
        inside[k : len(found) + k] |= found
    return int(inside.sum())


WORD = re.compile(r"[^\x20\x09-\x0D]+")


def counts(text: str) -> tuple[list[str], int, int, int, int]:
    """(words, word_chars, n_symbols, n_dup_lines, n_repeat_words) of a whole text."""
    return counted(text)[1:]


def counted(text: str) -> tuple[dict[str, int], list[str], int, int, int, int]:
    """How often each word occurs, and counts of the text; words are numbered once for both."""
    words = WORD.findall(text)
    number, x = numbered(words)
    times = dict(zip(number, np.bincount(x, minlength=len(number)).tolist(), strict=True))
    chars = len("".join(words))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [s for s in text.split("\n") if s.strip(ASCII_SPACE)]
    return times, words, chars, symbols, len(lines) - len(set(lines)), _in_repeated_windows(number, x)


def script(text: str) -> str:
    """The script of most of the text's distinct letters: latin, greek, cyrillic, han or other."""
    seen = Counter(_script_of(c) for c in set(text) if c.isalpha())
    return max(seen, key=lambda k: (seen[k], k)) if seen else "other"


def _script_of(c: str) -> str:
    n = ord(c)
    for name, ranges in SCRIPTS.items():
        if any(a <= n <= b for a, b in ranges):
            return name
    return "other"


#: Code point ranges of scripts.
SCRIPTS = {
    "latin": [(0x41, 0x24F), (0x1E00, 0x1EFF)],
    "greek": [(0x370, 0x3FF)],
    "cyrillic": [(0x400, 0x52F)],
    "han": [(0x3040, 0x30FF), (0x3400, 0x9FFF)],
}


@dataclass(frozen=True)
class Band:
    """Limits of one vocabulary's measures. Entropy is held against rise, a quadratic of the tokens' binary logarithm between shortest and longest."""

    chars: tuple[float, float]
    most_bytes: float
    rise: tuple[float, float, float]
    lengths: tuple[float, float]
    entropy: tuple[float, float]

    def above_expected(self, tokens: np.ndarray | float, entropy: np.ndarray | float) -> np.ndarray | float:
        x = np.clip(np.log2(np.maximum(tokens, 1)), *self.lengths)
        return entropy - (self.rise[0] + self.rise[1] * x + self.rise[2] * x * x)

    def holds(self, tokens: int, chars: float, byte_share: float, entropy: float) -> bool:
        if not self.chars[0] <= chars <= self.chars[1] or byte_share > self.most_bytes:
            return False
        return bool(self.entropy[0] <= self.above_expected(tokens, entropy) <= self.entropy[1])


Bands = dict[str, tuple[Band, ...]]


def _around(low: float, middle: float, high: float, least: float) -> tuple[float, float]:
    """Limits around the median, REACH times as far off as the tails begin, and least at least."""
    return middle - max(least, REACH * (middle - low)), middle + max(least, REACH * (high - middle))


#: The curve of entropy is fitted on binary logarithms less this, which keeps the sums of their powers apart.
MIDDLE = 10.0


def _rise(r: Row) -> tuple[float, float, float]:
    """The least-squares quadratic from sums of powers; the mean where there are fewer than three lengths."""
    if r.lengths < 3:
        return r.e0 / r.n, 0.0, 0.0
    powers = [r.n, r.x1, r.x2, r.x3, r.x4]
    a, b, c = np.linalg.lstsq(np.array([powers[k : k + 3] for k in range(3)], float), np.array([r.e0, r.e1, r.e2], float), rcond=None)[0].tolist()
    return a - b * MIDDLE + c * MIDDLE**2, b - 2 * c * MIDDLE, c


def _paths(vocabularies: tuple[tuple[str, str], ...]) -> tuple[str, ...]:
    return tuple(p if "/" in p else public_tokenizers.path(p) for _, p in vocabularies)


def _measured(vocabularies: tuple[tuple[str, str], ...], bands: Bands | None, names: list[str], extra: int):
    paths = _paths(vocabularies)
    kinds = [pa.int64()] * 5 + [pa.int64(), pa.float64(), pa.float64(), pa.float64()] * len(paths) + [pa.string(), pa.bool_(), pa.bool_()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = fertility(paths)
        for b in slices(batches, "t"):
            rows, texts = [], as_texts(b.column(1))
            of = [(times, len(words), own) for times, words, *own in map(counted, texts)]
            measures = known.measures_of([times for times, *_ in of], [own[0] for *_, own in of])
            for t, language, (_, n, own), found in zip(texts, b.column(2).to_pylist(), of, measures, strict=True):
                failed = n < 50 or 100 * own[3] > 50 * n
                kind = language if bands and language in bands else script(t)
                kept = not failed and all(band.holds(*m) for band, m in zip((bands or {}).get(kind, ()), found, strict=False))
                rows.append((n, *own, *(x for m in found for x in m), kind, failed, kept))
            arrays = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), *arrays, *(b.column(3 + k) for k in range(extra))], names)

    return run


def quality_rules(df: DataFrame, ids: str = "doc_id", text: str = "text", lang: str | None = "lang", bands: Bands | None = None, vocabularies: tuple[tuple[str, str], ...] = VOCABULARIES, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of df: the id column, counts, each vocabulary's measures and verdicts of the whole text.

    base_failed: under 50 words, or over half of them in repeated windows. kept: not
    base_failed, and all measures within the bands of the text's language, else of its
    script (see fit_bands); what neither has bands for is kept by them. band names the
    bands that decided. Null and empty texts have no words and fail; a null or
    unknown language goes by script. Repeated rows stay. Columns named in keep come
    along, others are not read.
    """
    columns = [f"{v}_{m}" for v, _ in vocabularies for m in MEASURES]
    names = [ids, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", *columns, "band", "base_failed", "kept", *keep]
    sparks = [T.LongType()] * 5 + [T.LongType(), T.DoubleType(), T.DoubleType(), T.DoubleType()] * len(vocabularies) + [T.StringType(), T.BooleanType(), T.BooleanType()]
    schema = T.StructType([T.StructField(ids, df.schema[ids].dataType)] + [T.StructField(n, k) for n, k in zip(names[1:], sparks, strict=False)] + [T.StructField(c, df.schema[c].dataType) for c in keep])
    return _input(df, ids, text, lang, keep).mapInArrow(_measured(vocabularies, bands, names, len(keep)), schema)


def _input(df: DataFrame, ids: str, text: str, lang: str | None, keep: tuple[str, ...] = ()) -> DataFrame:
    language = df[lang].cast("string") if lang and lang in df.columns else F.lit(None).cast("string")
    return df.select(df[ids], df[text].cast("string").alias("t"), language.alias("l"), *(df[c].alias(f"x{k}") for k, c in enumerate(keep)))


def fit_bands(docs: DataFrame, labels: DataFrame, ids: str = "doc_id", text: str = "text", lang: str | None = "lang", label: str = "quality", hold_out: tuple[int, int] = (5, 0), vocabularies: tuple[tuple[str, str], ...] = VOCABULARIES) -> Bands:
    """Bands around documents that are labelled good, for each language and each script that has LEAST_ROWS of them (see bands_of)."""
    own = docs.select(ids, F.col(text).alias("text"), (F.col(lang) if lang and lang in docs.columns else F.lit(None)).cast("string").alias("_l"))
    picked = own.join(_good(labels, ids, label, hold_out), ids, "left_semi")
    return bands_of(materialise(quality_rules(picked, ids, "text", None, None, vocabularies, ("_l",))), labels, ids, "_l", label, hold_out, vocabularies)


def _good(labels: DataFrame, ids: str, label: str, hold_out: tuple[int, int]) -> DataFrame:
    return labels.filter(F.col(label) == 1).select(ids).filter(F.col(ids).isNotNull()).filter(crc_mod(ids, hold_out[0]) != hold_out[1]).distinct()


def bands_of(measured: DataFrame, labels: DataFrame, ids: str = "doc_id", lang: str = "lang", label: str = "quality", hold_out: tuple[int, int] = (5, 0), vocabularies: tuple[tuple[str, str], ...] = VOCABULARIES) -> Bands:
    """Bands from measured documents (quality_rules without bands, with their language).

    Learns from all documents that are labelled good, whose crc32(id) mod hold_out[0] is not
    hold_out[1] and that pass the base rule; where an id repeats, from its least row. Sums and quantiles are worked
    out by Spark, quantiles of values rounded to thousandths (shares to ten-thousandths), so that
    a group's state is bounded; a row for each language or script reaches the driver. Without labels there are no bands.
    """
    columns = [f"{v}_{m}" for v, _ in vocabularies for m in MEASURES]
    rows = measured.filter("not base_failed").join(_good(labels, ids, label, hold_out), ids, "left_semi")
    one = rows.groupBy(ids).agg(F.min(F.struct(F.col(lang).alias("l"), F.col("band").alias("s"), *columns)).alias("m")).select("m.*")
    # Without bands the column band holds the script. A language that is called like a script goes before it.
    each = F.explode(F.array(*(F.struct(F.lit(v).alias("v"), *(F.col(f"{v}_{m}").alias(m) for m in MEASURES)) for v, _ in vocabularies))).alias("m")
    keyed = one.select(F.explode(F.array(F.struct(F.lit(0).alias("kind"), F.col("s").alias("name")), F.struct(F.lit(1).alias("kind"), F.col("l").alias("name")))).alias("k"), *columns).select("k.*", each).select("kind", "name", "m.*").filter("name is not null")
    x = F.log2(F.greatest("tokens", F.lit(1)).cast("double"))
    keyed = keyed.withColumn("x", x).withColumn("y", x - MIDDLE)
    tails = F.array(*(F.lit(q) for q in (TAIL, 0.5, 1 - TAIL)))
    sums = [F.sum(F.pow("y", F.lit(k))).alias(f"x{k}") for k in range(1, 5)] + [F.sum(F.col("entropy") * F.pow("y", F.lit(k))).alias(f"e{k}") for k in range(3)]
    first = keyed.groupBy("kind", "name", "v").agg(
        F.count("*").alias("n"), *sums, F.min("x").alias("low"), F.max("x").alias("high"), F.approx_count_distinct("tokens").alias("lengths"),
        F.percentile(F.round("chars_per_token", 3), tails).alias("chars"), F.percentile(F.round("byte_share", 4), tails).alias("bytes"),
    ).filter(F.col("n") >= LEAST_ROWS).collect()
    if not first:
        return {}
    rises = {(r.kind, r.name, r.v): _rise(r) for r in first}
    curves = measured.sparkSession.createDataFrame([(*k, *map(float, c)) for k, c in rises.items()], "kind int, name string, v string, a double, b double, c double")
    above = F.col("entropy") - (F.col("a") + F.col("b") * F.col("x") + F.col("c") * F.col("x") * F.col("x"))
    second = keyed.join(F.broadcast(curves), ["kind", "name", "v"]).groupBy("kind", "name", "v").agg(F.percentile(F.round(above, 3), tails).alias("above"))
    entropy = {(r.kind, r.name, r.v): _around(*r.above, 0.1) for r in second.collect()}
    made = {(r.kind, r.name, r.v): Band(_around(*r.chars, 0.05), _around(*r.bytes, 0.02)[1], rises[r.kind, r.name, r.v], (r.low, r.high), entropy[r.kind, r.name, r.v]) for r in first}
    return {name: tuple(made[kind, name, v] for v, _ in vocabularies) for kind, name in sorted({(r.kind, r.name) for r in first})}


def judged(measured: DataFrame, bands: Bands, lang: str = "lang", vocabularies: tuple[tuple[str, str], ...] = VOCABULARIES) -> DataFrame:
    """measured (quality_rules without bands) with the verdicts that bands give: the same as quality_rules with them, from the measures alone."""
    if not bands:
        return measured
    kind = "struct<low: double, high: double, most: double, a: double, b: double, c: double, from: double, upto: double, least: double, greatest: double>"
    limits = lambda b: (*b.chars, b.most_bytes, *b.rise, *b.lengths, *b.entropy)
    rows = [(name, *(tuple(map(float, limits(b))) for b in own)) for name, own in bands.items()]
    table = measured.sparkSession.createDataFrame(rows, ", ".join(["_name string", *(f"_{v} {kind}" for v, _ in vocabularies)]))
    ok = ~F.col("base_failed")
    for v, _ in vocabularies:
        of = lambda n, v=v: F.col(f"_{v}.{n}")
        x = F.least(F.greatest(F.log2(F.greatest(F.col(f"{v}_tokens"), F.lit(1)).cast("double")), of("from")), of("upto"))
        over = F.col(f"{v}_entropy") - (of("a") + of("b") * x + of("c") * x * x)
        holds = F.col(f"{v}_chars_per_token").between(of("low"), of("high")) & (F.col(f"{v}_byte_share") <= of("most")) & over.between(of("least"), of("greatest"))
        ok = ok & (F.col(f"_{v}").isNull() | holds)
    own = measured.withColumn("band", F.when(F.col(lang).isin(list(bands)), F.col(lang)).otherwise(F.col("band")))
    found = own.join(F.broadcast(table), F.col("band") == F.col("_name"), "left")
    return found.withColumn("kept", ok).select(measured.columns)
