"""Scores of windows: words and phrases of their text, energy of their sound, and outside scores."""

from __future__ import annotations

import functools
import itertools
import logging
import operator
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .moments import Texts, rows_of_slices
from .segments import SENTENCE_END, WHITE, bound, sentence_places, sentences, timed, unpacked, words_of


@dataclass(frozen=True)
class Lexicon:
    """What the local score looks for: patterns in the opening, whole words, and parts of text. The defaults are a short English list of our own; callers bring theirs."""

    hooks: tuple[str, ...] = ("(^| )(why|how|what) ", "(^| )(nobody|no one|never|secret)( |$)", "(^| )(mistake|mistakes|truth|myth)( |$)", "[0-9]+ (ways|reasons|steps)", "[?]")
    emotion: tuple[str, ...] = ("love", "hate", "fear", "afraid", "happy", "angry", "sad", "amazing", "terrible", "wonderful")
    opinion: tuple[str, ...] = ("think", "believe", "should", "must", "wrong", "right", "best", "worst", "overrated")
    story: tuple[str, ...] = ("once", "then", "suddenly", "finally", "remember when", "turned out")
    practical: tuple[str, ...] = ("step", "how to", "tip", "method", "instead of", "try this")


#: Shares of hook, emotion, opinion, story, practical, questions, quotable and energy in the score.
WEIGHTS = {"hook": 0.30, "emotion": 0.14, "opinion": 0.13, "story": 0.10, "practical": 0.09, "questions": 0.06, "quotable": 0.10, "energy": 0.08}
NEUTRAL_ENERGY = 0.3
log = logging.getLogger(__name__)


def _capped(x: Column) -> Column:
    return F.when(x.isNotNull(), F.least(F.lit(1.0), x.cast("double")))


#: What is counted of a text.
COUNTS = ("n", "emotion", "opinion", "story", "practical", "questions", "short")


#: Words whose counts are remembered, some more than that while a text is read.
REMEMBERED = 200_000
#: Fewer words than that are not worth a column.
FEW = 100


class WordCounts(dict):
    """Numbers of words; table holds beside each what a lexicon counts of it in small letters: emotion, opinion, story and practical marks without white space, question marks.

    Such marks lie within words, so that a text's counts are sums over its words. An empty mark is nowhere.
    """

    def __init__(self, lexicon: Lexicon):
        super().__init__()
        self.names = frozenset(lexicon.emotion), frozenset(lexicon.opinion)
        self.marks = [[m for m in names if m and not WHITE.search(m)] for names in (lexicon.story, lexicon.practical)]
        #: Marks with white space, which are looked for in whole texts, and where they count in COUNTS.
        self.wide = [(at, m) for at, names in ((3, lexicon.story), (4, lexicon.practical)) for m in names if WHITE.search(m)]
        self.table = np.zeros((1 << 12, 5), np.int64)

    def __missing__(self, word: str | bytes) -> int:
        self.learn([word])
        return self[word]

    def learn(self, words: list[str] | list[bytes]) -> None:
        """Counts words that are not known yet, each once: many by columns, few one by one."""
        k = len(self)
        while k + len(words) > len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        # Words hold no white space, and small letters don't hang on what is beyond it.
        whole = b"\n".join(words).decode() if isinstance(words[0], bytes) else "\n".join(words)
        low = whole.lower().split("\n")
        own = self.table[k : k + len(words)]
        if len(words) < FEW:
            own[:] = [[*(w in names for names in self.names), *(sum(map(w.count, marks)) for marks in self.marks), w.count("?")] for w in low]
        else:
            column = pa.array(low, pa.string())
            for at, names in enumerate(self.names):
                own[:, at] = pc.is_in(column, pa.array(sorted(names), pa.string())).to_numpy(zero_copy_only=False)
            for at, marks in enumerate([*self.marks, ["?"]], 2):
                own[:, at] = sum((pc.count_substring(column, m).to_numpy() for m in marks), np.zeros(len(low), np.int64))
        self.update(zip(words, range(k, k + len(words)), strict=True))

    def spans(self, words: list[str] | list[bytes], first: np.ndarray, end: np.ndarray, a: np.ndarray, z: np.ndarray, text: Callable[[int, int], str]) -> np.ndarray:
        """COUNTS of spans of sentences, a row each: sentences are words from first up to end, spans are sentences from a up to z; text gives the text from a word up to another."""
        if len(self) > REMEMBERED:
            self.clear()
        new = list(set(words).difference(self))
        if new:
            self.learn(new)
        at = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        sums = np.zeros((len(words) + 1, 5), np.int64)
        np.cumsum(self.table[at], 0, out=sums[1:])
        size = end - first
        short = np.append(0, np.cumsum((size >= 4) & (size <= 12)))
        edges = np.append(first, len(words))
        low, high = edges[a], edges[z]
        out = np.column_stack([high - low, sums[high] - sums[low], short[z] - short[a]])
        if self.wide:
            for row, x, y in zip(out, low.tolist(), high.tolist(), strict=True):
                own = text(x, y).lower()
                for k, m in self.wide:
                    row[k] += own.count(m)
        return out


def counter(lexicon: Lexicon) -> Callable[[str], list[int]]:
    """Gives COUNTS of texts: tokens, those in word lists, marks (side by side, letter for letter; an empty one nowhere), question marks, and sentences of 4 to 12 words."""
    known = WordCounts(lexicon)

    def counted(text: str) -> list[int]:
        words, j, at = timed(text)
        first, end, *_ = sentence_places(words, j, at)
        return known.spans(words, first, end, np.array([0]), np.array([len(first)]), lambda a, z: text)[0].tolist()

    return counted


def text_counts(text: Column, lexicon: Lexicon) -> Column:
    """COUNTS of texts, put in small letters, as a struct; null for a null text."""

    @F.arrow_udf("struct<" + ", ".join(f"{c}: int" for c in COUNTS) + ">")
    def counted(texts: pa.Array) -> pa.Array:
        rows = list(map(counter(lexicon), (x or "" for x in texts.to_pylist())))
        fields = [pa.array([r[k] for r in rows], pa.int32()) for k in range(len(COUNTS))]
        return pa.StructArray.from_arrays(fields, list(COUNTS), mask=texts.is_null())

    return counted(text)


def lexical_features(windows: DataFrame, text: str = "text", lexicon: Lexicon = Lexicon()) -> DataFrame:  # noqa: B008
    """Adds hook, emotion, opinion, story, practical, questions and quotable, from 0 to 1. Null texts have null features, empty ones 0."""
    # Blank sentences are at a text's end only, so that its opening is in its first two pieces.
    pieces = F.filter(F.slice(F.split(F.col(text), SENTENCE_END, 3), 1, 2), lambda s: s.rlike(r"\S"))
    return _features(windows.withColumns({"_counts": text_counts(F.col(text), lexicon), "_opening": F.array_join(pieces, " ")}), lexicon, "_counts.").drop("_counts", "_opening")


def _features(found: DataFrame, lexicon: Lexicon, prefix: str) -> DataFrame:
    """The features from COUNTS in columns of that prefix and _opening, the first two sentences."""
    of = lambda k: F.col(f"{prefix}{k}").cast("double")
    n = F.greatest(of("n"), F.lit(1.0))
    opening = found.withColumn("_opening", F.lower("_opening"))
    hooks = sum((F.col("_opening").rlike(p).cast("int") for p in lexicon.hooks), F.lit(0)).cast("double")
    return opening.withColumns(
        {
            "hook": _capped(hooks / 2), "emotion": _capped(of("emotion") / (n / 60)), "opinion": _capped(of("opinion") / (n / 80)), "story": _capped(of("story") / 3),
            "practical": _capped(of("practical") / 3), "questions": _capped(of("questions") / 3), "quotable": _capped(of("short") / 4),
        }
    )


#: What WindowFeatures gives, in order.
FEATURES = ("hook", "emotion", "opinion", "story", "practical", "questions", "quotable")


def found_at(text: bytes, mark: bytes) -> np.ndarray:
    """Where mark is in text, side by side as bytes.count counts."""
    if any(mark.endswith(mark[:k]) for k in range(1, len(mark))):
        return np.array([m.start() for m in re.finditer(re.escape(mark), text)], np.int64)
    data = np.frombuffer(text, np.uint8)
    n = max(0, len(data) - len(mark) + 1)
    there = data[:n] == mark[0]
    for k in range(1, len(mark)):
        there &= data[k : k + n] == mark[k]
    return np.flatnonzero(there)


class WindowFeatures:
    """The features of the windows of texts, from 0 to 1, a column each: windows overlap, so words and marks are looked for once in all texts and a window has those that lie in it.

    Hooks are searched by RE2, as DuckDB does; what it can't express (a look behind or ahead) raises.
    """

    def __init__(self, lexicon: Lexicon):
        self.lexicon = lexicon
        inside = lambda names: [m for m in names if m and not WHITE.search(m)]
        # A whole word is sought with the blank before it, and the one behind it is another's as well.
        self.names = [[f" {w}".encode() for w in {*inside(names)}] for names in (lexicon.emotion, lexicon.opinion)]
        self.marks = [[m.encode() for m in inside(names)] for names in (lexicon.story, lexicon.practical, ("?",))]
        self.wide = [[m for m in names if WHITE.search(m)] for names in (lexicon.story, lexicon.practical)]

    def __call__(self, texts: Texts) -> dict[str, np.ndarray]:
        a, last = texts.windows
        small, blanks = texts.small
        low, high = texts.first[a], texts.end[last]
        size = texts.end - texts.first
        short = np.append(0, np.cumsum((size >= 4) & (size <= 12)))
        inside = lambda at: np.searchsorted(at, blanks[high]) - np.searchsorted(at, blanks[low])
        counted = lambda places: sum(map(inside, places), np.zeros(len(a), np.int64))
        emotion, opinion = (counted(self.whole(small, w) for w in names) for names in self.names)
        story, practical, questions = (counted(found_at(small, m) for m in marks) for marks in self.marks)
        for counts, marks in zip((story, practical), self.wide, strict=True):
            for k, (x, y) in enumerate(zip(low.tolist(), high.tolist(), strict=True) if marks else ()):
                own = texts.text(x, y).lower()
                counts[k] += sum(map(own.count, marks))
        ends = blanks[texts.end[np.minimum(a + 1, last)]]
        opening = pa.array([small[x:y] for x, y in zip((blanks[low] + 1).tolist(), ends.tolist(), strict=True)], pa.binary()).cast(pa.string())
        hooks = sum((pc.match_substring_regex(opening, p).to_numpy(zero_copy_only=False).astype(float) for p in self.lexicon.hooks), np.zeros(len(a)))
        n = np.maximum(high - low, 1.0)
        raw = (hooks / 2, emotion / (n / 60), opinion / (n / 80), story / 3, practical / 3, questions / 3, (short[last + 1] - short[a]) / 4)
        return {name: np.minimum(1.0, x) for name, x in zip(FEATURES, raw, strict=True)}

    @staticmethod
    def whole(small: bytes, word: bytes) -> np.ndarray:
        at = found_at(small, word)
        return at[np.frombuffer(small, np.uint8)[at + len(word)] == 32]


def total_score(features: dict[str, np.ndarray], energy: float) -> np.ndarray:
    """The score of weighted_score, as numpy."""
    total = sum(((features[k] if k != "energy" else energy) * w for k, w in WEIGHTS.items()), np.zeros(len(features["hook"]))) * 100
    return np.minimum(np.floor(total * 10 + 0.5) / 10, 99.0)


def featured_windows(docs: DataFrame, lexicon: Lexicon, texts: bool = False) -> DataFrame:
    """The windows of documents (doc_id, text; see segments.candidate_windows) with duration_ms (the end of the last sentence) and the features of their texts; the text only if it is asked for.

    All of it within a document's row.
    """
    features = WindowFeatures(lexicon)

    def windows(t: Texts) -> tuple:
        a, last = t.windows
        d = t.doc[a]
        whole = [[t.text(x, y) for x, y in zip(t.first[a].tolist(), t.end[last].tolist(), strict=True)]] if texts else []
        return d, a - t.sentence_edges[d], last - t.sentence_edges[d], t.start[a], t.stop[last], t.natural[last], t.duration[d], *features(t).values(), *whole

    fields = "j0 long, j1 long, start_ms long, end_ms long, natural boolean, duration_ms long, " + ", ".join(f"{c} double" for c in FEATURES) + ", text string" * texts
    return rows_of_slices(docs, fields, windows)


def weighted_score(features: DataFrame, energy: Column) -> DataFrame:
    """Adds score (0 to 99, tenths) and reason, the two strongest axes (questions is none of them; ties keep their order)."""
    axes = [k for k in WEIGHTS if k not in ("questions", "energy")] + ["energy"]
    f = features.withColumn("energy", energy.cast("double"))
    total = sum((F.col(k) * w for k, w in WEIGHTS.items()), F.lit(0.0)) * 100
    order = F.array_sort(F.array(*(F.struct((-F.col(k)).alias("v"), F.lit(i).alias("i"), F.lit(k).alias("k")) for i, k in enumerate(axes))))
    return f.withColumn("score", F.least(F.floor(total * 10 + 0.5) / 10, F.lit(99.0))).withColumn("reason", F.concat_ws(" + ", F.get(order, F.lit(0))["k"], F.get(order, F.lit(1))["k"]))


def hook_of(text: Column, most: int = 140) -> Column:
    """The text's first sentence, else its first 90 characters; cut to most for showing."""
    first = F.coalesce(F.trim(F.get(sentences(text), F.lit(0))), F.substring(text, 1, 90))
    return F.substring(first, 1, most)


def reason_text(axes: Column) -> Column:
    """What the two strongest axes ("a + b") are told as."""
    return F.concat(F.lit("strong "), axes, F.lit(" signals (heuristic)"))


#: Fixed value: the title of a text without words.
NO_TITLE = "Untitled moment"


def title_of(text: Column, words: int = 9) -> Column:
    """The first sentence's words up to nine, with an ellipsis if there are more, without what are no letters or digits at its ends; its first letter is a capital, the others are small.

    The capital is one letter: that of ß is ẞ, and what has only capitals of several letters stays.
    """
    bare = F.regexp_replace(hook_of(text, 1 << 20), r"^[^\p{L}\p{N}_]+|[^\p{L}\p{N}_]+$", "")
    w = words_of(bare)
    cut = F.when(F.size(w) > words, F.concat(F.array_join(F.slice(w, 1, words), " "), F.lit("…"))).otherwise(bare)
    first = F.substring(cut, 1, 1)
    capital = F.when(first == "ß", F.lit("ẞ")).when(F.char_length(F.upper(first)) > 1, first).otherwise(F.upper(first))
    return F.when(cut == "", F.lit(NO_TITLE)).otherwise(F.concat(capital, F.lower(F.substring(cut, 2, 1 << 20))))


def rms(squares: Column, n: Column) -> Column:
    """Root of the mean square, kept off zero."""
    return F.sqrt(squares / n + 1e-9)


def rms_bins(samples: DataFrame, key: list[str], bin_: str, value: str, full: int | None = None) -> DataFrame:
    """rms of each bin's samples; bins of fewer than `full` samples are dropped where it is given."""
    g = samples.groupBy(*key, bin_).agg(F.count("*").alias("n"), F.sum(F.col(value) * F.col(value)).alias("sq"))
    g = g.filter(F.col("n") == full) if full else g
    return g.select(*key, bin_, rms(F.col("sq"), F.col("n")).alias("rms"))


def sound_threshold(quartile: Column) -> Column:
    """The rms above which there is sound, from the first quartile of all."""
    return F.greatest(F.lit(0.01), quartile * 1.8)


def _quantile(ordered: Column, p: float) -> Column:
    """Of an ascending array, linear between neighbours; null of an empty one."""
    at = (F.size(ordered) - 1) * F.lit(p)
    low, high = F.get(ordered, F.floor(at).cast("int")), F.get(ordered, F.ceil(at).cast("int"))
    part = at - F.floor(at)
    return F.when(F.size(ordered) > 0, F.when(part == 0, low).otherwise(low * (1 - part) + high * part))


def window_energies(df: DataFrame, windows: str = "windows", bins: str = "bins", bin_ms: int = 100) -> DataFrame:
    """Adds energies, in the order of windows: how far the 95th percentile of a window's bins is over the median of all bins that sound; 0.3 without bins.

    bins are structs (bin, rms) in order, windows have start_ms and end_ms. It all happens in a row: bins are laid
    out one for each step of time, so that a window is a slice of them.
    """
    step = F.lit(bin_ms)
    start = lambda w: F.floor(w["start_ms"] / step)

    def laid_out(own: Column) -> Column:
        gap = lambda x, i: F.coalesce(F.get(own, i + 1)["bin"] - x["bin"] - 1, F.lit(0)).cast("int")
        dense = F.flatten(F.transform(own, lambda x, i: F.concat(F.array(x["rms"]), F.array_repeat(F.lit(None).cast("double"), gap(x, i)))))
        sounding = F.array_sort(F.filter(F.transform(own, lambda x: x["rms"]), lambda v: v > 0.001))
        return F.struct(dense.alias("dense"), F.coalesce(F.get(own, F.lit(0))["bin"], F.lit(0)).alias("first"), F.coalesce(bound(sounding, lambda v: _quantile(v, 0.5)), F.lit(0.01)).alias("base"))

    def energies(d: Column) -> Column:
        def energy(w: Column) -> Column:
            a = F.greatest(start(w) - d["first"], F.lit(0)).cast("int")
            z = F.greatest(F.floor(w["end_ms"] / step) - d["first"], F.lit(0)).cast("int")
            inside = F.array_sort(F.filter(F.slice(d["dense"], a + 1, F.greatest(z - a, F.lit(0))), lambda v: v.isNotNull()))
            # least and greatest pass nulls over, so a window without bins is told apart before.
            over = lambda v: F.greatest(F.lit(0.0), F.least(F.lit(1.0), (_quantile(v, 0.95) / (d["base"] + 1e-9) - 1) / 3))
            found = bound(inside, lambda v: F.when(F.size(v) > 0, over(v)).otherwise(NEUTRAL_ENERGY))
            return F.floor(found * 1e6 + 0.5) / 1e6

        return F.transform(windows, energy)

    return df.withColumn("energies", bound(bound(F.col(bins), laid_out), energies))


def quantile_of(values: np.ndarray, p: float, of: Callable = float) -> float:
    """numpy's linear quantile of values (one at least), from the two that it lies between; its own takes many steps for few values. of is a rising function that is applied to these two."""
    at = p * (len(values) - 1)
    k = int(at)
    own = np.partition(values, [k, min(k + 1, len(values) - 1)])
    low, high, part = float(of(own[k])), float(of(own[min(k + 1, len(values) - 1)])), at - k
    return high - (high - low) * (1 - part) if part >= 0.5 else low + (high - low) * part


def energies_of(bins: np.ndarray, rms: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The same for one document as numpy arrays: its bins in order, and where its windows start and end, in bins."""
    if not len(start):
        return np.zeros(0)
    loud = rms[rms > 0.001]
    base = (quantile_of(loud, 0.5) if len(loud) else 0.01) + 1e-9
    inside = zip(np.searchsorted(bins, start).tolist(), np.searchsorted(bins, end).tolist(), strict=True)
    raw = [min(1.0, max(0.0, (quantile_of(rms[a:z], 0.95) / base - 1) / 3)) if z > a else NEUTRAL_ENERGY for a, z in inside]
    return np.floor(np.array(raw, float) * 1e6 + 0.5) / 1e6


def energies_of_squares(squares: np.ndarray, samples: int, spans: list[tuple[int, int]]) -> np.ndarray:
    """The same from each bin's sum of squares of so many samples, for windows that are spans of bins. Roots are taken of quantiles' neighbours only."""
    root = lambda x: np.sqrt(x / samples + 1e-9)
    quantile = lambda own, p: quantile_of(own, p, root)
    loud = squares[root(squares) > 0.001]
    base = (quantile(loud, 0.5) if len(loud) else 0.01) + 1e-9
    raw = [min(1.0, max(0.0, (quantile(squares[a:z], 0.95) / base - 1) / 3)) if z > a else NEUTRAL_ENERGY for a, z in spans]
    return np.floor(np.array(raw, float) * 1e6 + 0.5) / 1e6


def window_energy(windows: DataFrame, bins: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, j0 and energy for windows and bins (bin, rms) that come as rows: both are gathered by key, one shuffle each, and measured in a row (see window_energies)."""
    w = windows.groupBy(key).agg(F.collect_list(F.struct("j0", "start_ms", "end_ms")).alias("windows"))
    b = bins.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("bin", "rms"))).alias("bins"))
    both = w.join(b, key, "left").withColumn("bins", F.coalesce("bins", F.expr("cast(array() as array<struct<bin:bigint,rms:double>>)")))
    return energy_rows(window_energies(both), key)


def energy_rows(measured: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, j0 and energy, a row for each window."""
    return unpacked(measured, [key], F.zip_with("windows", "energies", lambda w, e: F.struct(w["j0"].alias("j0"), e.alias("energy"))), "j0")


def clamp_score(raw: Column) -> Column:
    """A score as text, number or nothing, from 0 to 100; what is no number is 0."""
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.coalesce(raw.try_cast("double"), F.lit(0.0))))


def parse_replies(replies: DataFrame, key: str, text: str, valid_from: int, valid_to: int) -> DataFrame:
    """Rows of a model's replies: the first [ to the last ] as a list of objects with id, score, title, hook and reason.

    Ids outside the batch or no numbers are skipped, fractions of an id cut off, a later object of an id wins; title, hook and reason
    are cut to 80, 140 and 200 characters, and a missing title is NO_TITLE. A reply without a list or without a valid id is one row
    with error that says so and nulls beside it; the other rows have a null error.
    """
    body = F.regexp_extract(text, r"(?s)\[.*\]", 0)
    items = F.from_json(body, "array<struct<id:string,score:string,title:string,hook:string,reason:string>>")
    cut = lambda c, n: F.substring(F.coalesce(c, F.lit("")), 1, n)
    row = lambda x, k: F.struct(x["id"].try_cast("double").try_cast("long").alias("id"), k.alias("pos"), clamp_score(x["score"]).alias("score"), F.coalesce(F.nullif(cut(x["title"], 80), F.lit("")), F.lit(NO_TITLE)).alias("title"), cut(x["hook"], 140).alias("hook"), cut(x["reason"], 200).alias("reason"))
    valid = F.filter(F.transform(items, row), lambda x: x["id"].between(valid_from, valid_to))
    last = lambda xs: F.filter(xs, lambda x: ~F.exists(xs, lambda y: (y["id"] == x["id"]) & (y["pos"] > x["pos"])))
    error = F.when(body == "", "no list").when(F.coalesce(F.size(valid), F.lit(0)) <= 0, "no valid id")
    found = replies.withColumn("_x", F.when(error.isNull(), bound(valid, last))).withColumn("error", error)
    return found.select(key, "error", F.inline_outer("_x")).select(key, "id", "score", "title", "hook", "reason", "error")


def override_scores(local: DataFrame, remote: DataFrame, key: list[str], provider: str, order: str | None = None) -> DataFrame:
    """Local rows, with the score of the remote row of the same key where there is one; provider says whose it is.

    Of remote rows that repeat a key the last by the column order counts, without one the highest score; null
    remote scores and null keys override nothing. Repeated local rows all stay.
    """
    of = [F.col(k).alias(f"_remote_{k}") for k in key]
    best = F.max("score") if order is None else F.max_by("score", order)
    r = remote.filter(F.col("score").isNotNull()).groupBy(*of).agg(best.alias("_remote_score"))
    same = [F.col(k) == F.col(f"_remote_{k}") for k in key]
    found = local.join(r, functools.reduce(operator.and_, same), "left")
    found = found.withColumn("provider", F.when(F.col("_remote_score").isNull(), "local").otherwise(provider)).withColumn("score", F.coalesce("_remote_score", "score"))
    return found.drop("_remote_score", *(f"_remote_{k}" for k in key))


def batches_of(df: DataFrame, key: list[str], order: list, size: int = 10) -> DataFrame:
    """Adds batch: rows of a key in groups of size, in order."""
    return df.withColumn("batch", F.floor((F.row_number().over(Window.partitionBy(*key).orderBy(*order)) - 1) / size).cast("long"))


def prompts(batched: DataFrame, key: list[str], order: str) -> DataFrame:
    """One text for each batch: a header with the rounded length and the text of each window, in order."""
    part = F.concat(F.lit("## "), F.col(order).cast("string"), F.lit(" ("), F.bround((F.col("end_ms") - F.col("start_ms")) / 1000.0, 0).cast("long").cast("string"), F.lit(" s)\n"), F.col("text"))
    g = batched.groupBy(*key, "batch").agg(F.array_sort(F.collect_list(F.struct(order, part.alias("part")))).alias("parts"))  # as many as a batch holds
    return g.select(*key, "batch", F.array_join(F.transform("parts", lambda x: x["part"]), "\n\n").alias("prompt"))


def top_slice(df: DataFrame, key: list[str], score: str, ties: list[str], k: Column) -> DataFrame:
    """The k rows of the highest score of each key."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc(score), *ties))).filter(F.col("_r") <= k).drop("_r")


class Scorer:
    """A scorer of windows that callers plug in: score() gets a pandas frame of one batch and returns one row for each window it scores.

    A batch has at most BATCH windows of one source, with its key columns (doc_id and j0 by default), text and batch; the result
    has those keys and score, and may have title, hook and reason. What it raises, and a batch without a
    single valid row, fail the batch and with it all of the source's outside scores.
    """

    def score(self, frame: pd.DataFrame) -> pd.DataFrame:
        raise NotImplementedError


#: Fixed value: windows of a request.
BATCH = 10
_scorers: dict[str, Callable[[], Scorer]] = {}


def register_scorer(name: str, make: Callable[[], Scorer]) -> None:
    """Makes a scorer known by name; make() may raise where it isn't available, say without a key."""
    _scorers[name] = make


def available(name: str) -> Scorer | None:
    """The scorer of that name; none where the name is unknown or it can't be made."""
    make = _scorers.get(name)
    try:
        return make() if make else None
    except Exception as error:  # any fault of a plugged-in scorer means the local score
        log.warning("scorer %r is not available (%s), local scores stay", name, error)
        return None


def batch_scores(scorer: Scorer, windows: DataFrame, source: str = "doc_id", ident: str = "j0", order: list[Column] | None = None, size: int = BATCH) -> DataFrame:
    """What the scorer says, batch by batch: source, batch, ident, score, title, hook, reason, failed.

    The windows of a source go to it in batches of size, in order (by ident, if none is given). A
    failed batch is one row with nulls and what went wrong in failed. Rows for windows outside the batch are
    dropped, of several for one the last counts; texts are cut to 80, 140 and 200 characters. A source's rows follow
    each other in a task, so that batches are cut from them as they come, without a group for each.
    """
    kinds = {f.name: f.dataType.simpleString() for f in windows.schema}
    schema = f"{source} {kinds[source]}, batch long, {ident} {kinds[ident]}, score double, title string, hook string, reason string, failed string"
    names = [x.split()[0] for x in schema.split(", ")]
    arrow = [to_arrow_type(windows.schema[source].dataType), pa.int64(), to_arrow_type(windows.schema[ident].dataType), pa.float64(), *[pa.string()] * 4]

    def said(own: pd.DataFrame, of_source: object, batch: int) -> dict[str, list]:
        n = len(own)
        try:
            found = scorer.score(own)
            inside = set(own[ident].tolist())
            last = {x: k for k, x in enumerate(found[ident].tolist()) if x in inside}
            if not last:
                raise ValueError("no valid id")
            at = sorted(last.values())
            of = lambda c: found[c].iloc[at]
            out = {ident: of(ident).tolist(), "score": pd.to_numeric(of("score"), errors="coerce").fillna(0.0).clip(0, 100).tolist()}
            for name, most in (("title", 80), ("hook", 140), ("reason", 200)):
                out[name] = of(name).fillna("").astype(str).str[:most].tolist() if name in found.columns else [""] * len(at)
            n, out["failed"] = len(at), [None] * len(at)
        except Exception as error:  # carried as data: what becomes of the source is decided once all its batches are in
            n, out = 1, {ident: [None], "score": [None], "title": [None], "hook": [None], "reason": [None], "failed": [f"{type(error).__name__}: {error}"]}
        return {**out, source: [of_source] * n, "batch": [batch] * n}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for b in itertools.chain(batches, [None]):
            rows = pa.Table.from_batches([x for x in (rest, b) if x is not None]).combine_chunks() if rest is not None or b is not None else None
            if rows is None or not rows.num_rows:
                continue
            # A batch begins where the count within it starts again; the last one may go on in the next rows.
            starts = np.flatnonzero(rows.column("_at").to_numpy() % size == 1).tolist() if size > 1 else list(range(rows.num_rows))
            whole = starts if b is None else starts[:-1]
            ends = [*starts[1:], rows.num_rows]
            shown = rows.drop_columns(["_at"])
            # Whole numbers with a null among them become floats in pandas, which must not reach other batches.
            frame = None if any(c.null_count for c in shown.columns) else shown.to_pandas()
            part = lambda a, z: shown.slice(a, z - a).to_pandas() if frame is None else frame.iloc[a:z].reset_index(drop=True)  # noqa: B023, E731
            made = [said(part(a, z), rows[source][a].as_py(), rows["batch"][a].as_py()) for a, z in zip(whole, ends, strict=False)]
            if made:
                columns = {n: list(itertools.chain.from_iterable(x[n] for x in made)) for n in names}
                yield pa.RecordBatch.from_arrays([pa.array(columns[n], k, from_pandas=True) for n, k in zip(names, arrow, strict=True)], names)
            rest = None if b is None else rows.slice(starts[-1]).to_batches()[0]

    by = order or [F.col(ident)]
    columns = [c for c in windows.columns if c not in ("batch", "_at")]
    at = F.row_number().over(Window.partitionBy(source).orderBy(*by))
    batched = batches_of(windows.filter(F.col(ident).isNotNull()), [source], by, size).withColumn("_at", at).select(*columns, "batch", "_at")
    return batched.repartition(source).sortWithinPartitions(source, "_at").mapInArrow(run, schema)


def whole_sources(scores: DataFrame, source: str = "doc_id") -> DataFrame:
    """The rows of batch_scores of the sources none of whose batches failed: all of a source or nothing."""
    failed = F.max("failed").over(Window.partitionBy(source))  # a source has as many rows as it has windows
    return scores.withColumn("_any", failed).filter("_any is null").drop("_any", "failed")


def scored_by(name: str, windows: DataFrame, local: DataFrame, order: list[Column] | None = None, size: int = BATCH) -> DataFrame:
    """local scores (doc_id, j0, score), overridden by those of the named scorer for windows (doc_id, j0, text); provider says whose a row's score is.

    An unknown name, a scorer that can't be made, and sources of which a batch fails keep the local scores.
    """
    scorer = available(name)
    if scorer is None:
        return local.withColumn("provider", F.lit("local"))
    remote = whole_sources(batch_scores(scorer, windows, order=order, size=size))
    return override_scores(local, remote.select("doc_id", "j0", "score"), ["doc_id", "j0"], name)
