"""Toxicity by a noisy channel: disguised words are restored, then the restored text is scored."""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import as_texts, crc_mod, kept_in_worker, materialise, slices

#: The letters that the language model knows; 0 is a word's border, the last number any other letter.
LETTERS = "abcdefghijklmnopqrstuvwxyz" + "".join(map(chr, range(0xDF, 0x100)))
SIZE = len(LETTERS) + 2
#: Characters that stand for letters.
STANDS_FOR = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e"}
#: Costs (negative natural logarithms) of what the channel does to a letter.
COST_KEPT, COST_STANDS, COST_ADDED, COST_ADDED_DIGIT, COST_REPEAT = 0.05, 1.0, 1.2, 5.0, 0.7
#: Words, and beginnings of words, are features; a beginning ends after so many letters.
PREFIXES = (4, 5, 6)
CACHE = 200_000
#: Four or more single characters with blanks between them.
SPACED = re.compile(r"(?<!\S)(?:\S ){3,}\S(?!\S)")
#: Longer words (texts without spaces, long runs of single letters) are restored in pieces of so many characters.
PIECE = 64
#: Toxic rows that must hold a feature, and their share, before it weighs; least log odds that weigh.
LEAST_ROWS, LEAST_SHARE, LEAST_ODDS = 3.0, 0.004, 3.0
#: The bias of a model that has seen no toxic rows, and how many standard errors a fitted one is lowered.
NO_BIAS, CAUTION = -4.0, 2.0
#: A blank between pieces of so many characters may be one that the channel put into a word; costs of such a blank, between single letters and else.
SHORT, COST_BLANK_LETTERS, COST_BLANK = 4, 1.0, 5.0


class CharacterModel:
    """Log probabilities of a letter after two, from counts of triples smoothed by shorter contexts."""

    def __init__(self, counts: dict[int, int]):
        c = np.zeros(SIZE**3)
        c[list(counts.keys())] = list(counts.values())
        c = c.reshape(SIZE, SIZE, SIZE)
        one = c.sum((0, 1)) + 0.5
        two = c.sum(0)
        p1 = one / one.sum()
        p2 = (two + 5 * p1) / (two.sum(1, keepdims=True) + 5)
        p3 = (c + 5 * p2[None]) / (c.sum(2, keepdims=True) + 5)
        self.log = np.log(p3)

    def __getstate__(self):
        return self.log.astype(np.float32)

    def __setstate__(self, log):
        self.log = log


_INDEX = {c: k + 1 for k, c in enumerate(LETTERS)}


def _number(c: str) -> int:
    return _INDEX.get(c, SIZE - 1 if c.isalpha() else 0)


def _letter_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(triple, count) of a partition's texts in lower case."""
    table = np.array([_number(chr(k)) if not 0xD800 <= k < 0xE000 else 0 for k in range(1 << 16)], np.int64)
    total = np.zeros(SIZE**3, np.int64)
    for b in slices(batches, "t", 1 << 20):
        text = "  ".join(as_texts(b.column(0))).lower()
        points = np.frombuffer(f"  {text} ".encode("utf-32-le", "replace"), np.uint32)
        x = np.where(points < 1 << 16, table[np.minimum(points, (1 << 16) - 1)], 0)
        code = (x[:-2] * SIZE + x[1:-1]) * SIZE + x[2:]
        total += np.bincount(code[(x[1:-1] > 0) | (x[2:] > 0)], minlength=SIZE**3)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["triple", "n"])


def character_model(df: DataFrame, text: str = "text") -> CharacterModel:
    """Counts triples of letters over all texts. What reaches the driver is at most SIZE ** 3 sums.

    Null and empty texts count nothing, repeated rows count as often as they occur; of an empty
    table all letters are alike. Other columns are not read.
    """
    rows = df.select(F.col(text).cast("string").alias("t")).mapInArrow(_letter_counts, "triple long, n long").groupBy("triple").agg(F.sum("n").alias("n")).toPandas()
    return CharacterModel(dict(zip(rows["triple"].tolist(), rows["n"].tolist(), strict=True)))


def hypotheses(word: str) -> list[list[tuple[str, float]]]:
    """The lattice of a word, or of pieces with single blanks between them: for each character the letters it may stand for (or none) and their costs. A blank is a border or nothing."""
    out = []
    single = [len(x) == 1 for x in word.split(" ")]
    gap = 0
    for k, c in enumerate(word):
        own: list[tuple[str, float]] = []
        if c == " ":
            gap += 1
            out.append([(" ", 0.0), ("", COST_BLANK_LETTERS if single[gap - 1] and single[gap] else COST_BLANK)])
            continue
        if c.isalpha():
            own.append((c, COST_KEPT))
            if k and word[k - 1] == c:
                own.append(("", COST_REPEAT))
        for letter in STANDS_FOR.get(c, ""):
            own.append((letter, COST_STANDS))
        if not c.isalpha():
            own.append(("", COST_ADDED_DIGIT if c.isdigit() else COST_ADDED))
        out.append(own)
    return out


def restore(word: str, model: CharacterModel) -> str:
    """The most likely letters of a disguised word, or the words of pieces with blanks: Viterbi over states of the last two letters."""
    log = model.log
    best: dict[tuple[int, int], tuple[float, str]] = {(0, 0): (0.0, "")}
    for options in hypotheses(word):
        step: dict[tuple[int, int], tuple[float, str]] = {}
        for (a, b), (cost, done) in best.items():
            for letter, own in options:
                if letter:
                    n = 0 if letter == " " else _number(letter)
                    state, to, text = (b, n), cost + own - float(log[a, b, n]), done + letter
                else:
                    state, to, text = (a, b), cost + own, done
                if state not in step or (to, text) < step[state]:
                    step[state] = (to, text)
        best = step
    return min((cost - float(log[a, b, 0]), done) for (a, b), (cost, done) in best.items())[1]


def stripped(word: str) -> str:
    """The word without the signs at its ends, but for signs that may stand for a letter: before a letter or digit, and behind a word that has letters and other characters already."""
    start, end = 0, len(word)
    while start < end and not word[start].isalnum() and not (word[start] in STANDS_FOR and start + 1 < end and word[start + 1].isalnum()):
        start += 1
    while end > start and not word[end - 1].isalnum():
        end -= 1
    if any(map(str.isalpha, word[start:end])) and not word[start:end].isalpha():
        while end < len(word) and word[end] in STANDS_FOR:
            end += 1
    return word[start:end]


def disguised(word: str) -> bool:
    """Whether a stripped word has letters and what is no letter, or the same letter twice in a row."""
    if word.isalpha():
        return any(map(str.__eq__, word, word[1:]))
    return any(map(str.isalpha, word))


class Restorer:
    """Words of a text, restored; a worker remembers short words that it has seen, in two generations, so that frequent ones stay known."""

    def __init__(self, model: CharacterModel):
        self.model = model
        self.known: dict[str, str] = {}
        self.before: dict[str, str] = {}
        self.joins: dict[tuple[str, str], bool] = {}

    def word(self, raw: str) -> str:
        found = self.known.get(raw)
        if found is None:
            found = self.before.get(raw)
            if found is None:
                found = stripped(raw)
                if disguised(found):
                    found = restore(found, self.model)
            self.remember(raw, found)
        return found

    def remember(self, raw: str, found: str) -> None:
        if len(self.known) >= CACHE:
            self.known, self.before = {}, self.known
        self.known[raw] = found

    def pieces(self, raw: str) -> set[str]:
        return {self.word(raw[k : k + PIECE]) for k in range(0, len(raw), PIECE)}

    def joined(self, x: str, y: str) -> bool:
        """Whether two short pieces may be one word: both are single, or they are likelier together. That hangs on the two letters on either side."""
        if not (x[-1].isalpha() or x[-1] in STANDS_FOR) or not (y[0].isalpha() or y[0] in STANDS_FOR):
            return False
        if len(x) == len(y) == 1:
            return True
        side = x[-2:], y[:2]
        found = self.joins.get(side)
        if found is None:
            log = self.model.log
            a, b = map(_number, x[-2:].rjust(2))
            c, d = map(_number, y[:2].ljust(2))
            together = log[a, b, c] + log[b, c, d]
            apart = log[a, b, 0] + log[b, 0, c] + log[0, c, d]
            if len(self.joins) >= CACHE:
                self.joins.clear()
            found = self.joins[side] = bool(together - COST_BLANK > apart)
        return found

    def spaced(self, raw: list[str]) -> Iterator[str]:
        """Stretches of short pieces around neighbours that may be one word, in parts of at most PIECE characters."""
        # A longer piece counts beside one or two letters: the rest of a word.
        short = lambda x, y: len(x) <= SHORT or len(x) <= 2 * SHORT and len(y) <= 2
        pairs = {(x, y) for x, y in set(zip(raw, raw[1:], strict=False)) if short(x, y) and short(y, x) and self.joined(x, y)}
        at = [k for k, p in enumerate(zip(raw, raw[1:], strict=False)) if p in pairs] if pairs else []
        low = k = 0
        while k < len(at):
            a, z = at[k], at[k] + 2
            size = len(raw[a]) + len(raw[a + 1])
            while a > low and short(raw[a - 1], raw[a]) and size + len(raw[a - 1]) < PIECE // 2:
                a -= 1
                size += len(raw[a]) + 1
            while z < len(raw) and (short(raw[z], raw[z - 1]) or (raw[z - 1], raw[z]) in pairs) and size + len(raw[z]) < PIECE:
                size += len(raw[z]) + 1
                z += 1
            if z - a > 2 or len(raw[a]) + len(raw[a + 1]) > 2:
                yield " ".join(raw[a:z])
            # A stretch that goes on behind its end is taken up from its middle, so that no word is cut.
            goes_on = z < len(raw) and (raw[z - 1], raw[z]) in pairs
            low = max(low + 1, (a + z) // 2) if goes_on else z
            while k < len(at) and at[k] < low - (not goes_on):
                k += 1


    def words(self, text: str) -> set[str]:
        """Distinct restored words; words that stand in pieces or as single letters are found by leaving blanks out."""
        raw = text.lower().split()
        found = set()
        for w in set(raw):
            if len(w) <= PIECE:
                found.add(self.word(w))
            else:
                found |= self.pieces(w)
        stretches = set(self.spaced(raw))
        # A word of one letter before a spaced word looks like its first letter: both readings count.
        stretches |= {" ".join(x.split()[1:]) for s in stretches for x in SPACED.findall(s)}
        for stretch in stretches:
            own = self.known.get(stretch)
            if own is None:
                own = self.before.get(stretch)
                if own is None:
                    own = restore(stretch, self.model)
                self.remember(stretch, own)
            found.update(own.split(" "))
        found.discard("")
        return found


_restorers: dict[bytes, Restorer] = {}


def restorer_of(letters: CharacterModel) -> Restorer:
    """The worker's own restorer for these letters: words that a task has restored are known to the next ones, of all stages."""
    key = hashlib.sha1(np.ascontiguousarray(letters.log, np.float32).tobytes()).digest()
    if key not in _restorers:
        kept_in_worker(_restorers.clear)
        _restorers.clear()
        _restorers[key] = Restorer(letters)
    return _restorers[key]


def features(word: str) -> list[str]:
    return [word] + [word[:n] + "-" for n in PREFIXES if len(word) > n]


def _feature_counts(model: CharacterModel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        good, bad, restorer = Counter(), Counter(), restorer_of(model)
        for b in slices(batches, "t"):
            for t, label in zip(as_texts(b.column(0)), b.column(1).to_pylist(), strict=True):
                (bad if label else good).update({f for w in restorer.words(t) for f in features(w)})
        names = list(good.keys() | bad.keys())
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([bad[n] for n in names], pa.int64()), pa.array([good[n] for n in names], pa.int64())], ["f", "bad", "good"])

    return run


class ToxicityModel:
    """The character model, the counts (toxic rows, other rows) of weighty features, the numbers of rows, and the bias of a logistic score."""

    def __init__(self, letters: CharacterModel, counts: dict[str, tuple[int, int]], rows: tuple[int, int], bias: float):
        self.letters, self.counts, self.rows, self.bias = letters, counts, rows, bias

    def weight(self, feature: str, without: int | None = None) -> float:
        """Smoothed log odds of a feature; 0 for one that does not weigh. without leaves one row of that label out."""
        bad, good = self.counts.get(feature, (0, 0))
        all_bad, all_good = self.rows
        if without == 1:
            bad, all_bad = bad - 1, all_bad - 1
        elif without == 0:
            good, all_good = good - 1, all_good - 1
        if bad < max(LEAST_ROWS, LEAST_SHARE * all_bad):
            return 0.0
        odds = float(np.log((bad + 0.5) / (all_bad + 1)) - np.log((good + 0.5) / (all_good + 1)))
        return odds if odds >= LEAST_ODDS else 0.0

    def word_weight(self, word: str, without: int | None = None) -> float:
        return max((self.weight(f, without) for f in features(word)), default=0.0)


def fitted_bias(sums: np.ndarray, toxic: np.ndarray, share: float) -> float:
    """The bias of the greatest likelihood for texts of these sums of weights, where share of all texts is toxic."""
    if not toxic.any() or toxic.all():
        return NO_BIAS
    low, high = -50.0, 50.0
    for _ in range(60):
        bias = (low + high) / 2
        p = 1 / (1 + np.exp(-np.clip(sums + bias, -60, 60)))
        if share * (1 - p[toxic]).mean() > (1 - share) * p[~toxic].mean():
            low = bias
        else:
            high = bias
    return (low + high) / 2


def cautious_bias(sums: np.ndarray, toxic: np.ndarray, share: float) -> float:
    """The fitted bias less CAUTION standard errors (from the likelihood's curvature): few labelled rows tell little about how rare toxic texts are."""
    bias = fitted_bias(sums, toxic, share)
    if not toxic.any() or toxic.all():
        return bias
    p = 1 / (1 + np.exp(-np.clip(sums + bias, -60, 60)))
    spread = len(sums) * (share * (p * (1 - p))[toxic].mean() + (1 - share) * (p * (1 - p))[~toxic].mean())
    return bias - CAUTION / float(np.sqrt(max(spread, 1e-9)))


def _sums(broadcast):
    """(sum of the weights of a labelled text without its own row, label)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = broadcast.value
        restorer = restorer_of(m.letters)
        for b in slices(batches, "t"):
            labels = b.column(1).to_pylist()
            sums = [sum(m.word_weight(w, label) for w in restorer.words(t)) for t, label in zip(as_texts(b.column(0)), labels, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(sums, pa.float64()), pa.array(labels, pa.int32())], ["s", "l"])

    return run


def fit_toxicity(docs: DataFrame, labels: DataFrame, ids: str = "doc_id", text: str = "text", label: str = "toxic", hold_out: tuple[int, int] = (5, 0), most_rows: int = 6000) -> ToxicityModel:
    """Learns from at most most_rows toxic and twice as many other labelled documents (a bounded
    sample in the order of the ids' hashes, equal texts once) whose crc32(id) mod hold_out[0]
    is not hold_out[1].

    A feature's weight is its smoothed log odds; features weigh that LEAST_ROWS toxic rows and
    LEAST_SHARE of them hold and whose log odds are LEAST_ODDS or more, so that a word must be
    some twenty times as frequent in toxic texts. As each takes LEAST_SHARE of the toxic rows, their
    number follows a text's length, not the table's. The bias is that of the greatest likelihood for the
    sample's texts, each weighed without its own row, at the share of toxic rows among the
    labels, lowered by CAUTION standard errors. The letters' counts cover all documents.

    Null and empty texts have no features; labels that are null or neither 0 nor 1, and null ids, are not learned
    from; of several labels of an id the highest counts. Without toxic rows nothing weighs.
    """
    letters = character_model(docs, text)
    own = labels.select(F.col(ids), F.col(label).cast("int").alias("l")).filter(f"l in (0, 1) and {ids} is not null").filter(crc_mod(ids, hold_out[0]) != hold_out[1]).groupBy(ids).agg(F.max("l").alias("l"))
    sample = own.filter("l = 1").orderBy(F.xxhash64(ids), ids).limit(most_rows).unionByName(own.filter("l = 0").orderBy(F.xxhash64(ids), ids).limit(2 * most_rows))
    rows = docs.select(ids, F.col(text).cast("string").alias("t")).join(F.broadcast(sample), ids)  # at most 3 * most_rows ids
    rows = materialise(rows.groupBy(F.xxhash64("t").alias("h")).agg(F.first("t").alias("t"), F.max("l").alias("l")).select("t", "l"))
    found = rows.mapInArrow(_feature_counts(letters), "f string, bad long, good long").groupBy("f").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    n = {r["l"]: r["count"] for r in rows.groupBy("l").count().collect()}
    bad, good = n.get(1, 0), n.get(0, 0)
    odds = F.log((F.col("bad") + 0.5) / (bad + 1.0)) - F.log((F.col("good") + 0.5) / (good + 1.0))
    # A row less may lift a feature's odds; those near the limit are taken along.
    chosen = found.filter((F.col("bad") >= max(LEAST_ROWS, LEAST_SHARE * bad)) & (odds >= LEAST_ODDS - 1.2)).toPandas()
    counts = {f: (int(a), int(b)) for f, a, b in zip(chosen["f"], chosen["bad"], chosen["good"], strict=True)}
    model = ToxicityModel(letters, counts, (bad, good), NO_BIAS)
    sums = rows.mapInArrow(_sums(docs.sparkSession.sparkContext.broadcast(model)), "s double, l int").toPandas()  # two numbers a sampled text
    (toxic, every) = own.agg(F.count_if(F.col("l") == 1), F.count("*")).first()
    model.bias = cautious_bias(sums["s"].to_numpy(float), sums["l"].to_numpy() == 1, toxic / max(1, every))
    return model


def score_toxicity(docs: DataFrame, model: ToxicityModel, ids: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: the id column, score and hits (how many distinct words weigh something).

    The score is the logistic of the bias and of the weights of the restored text's distinct
    words. Null and empty texts get the bias alone. Only the text is an input.
    """
    broadcast = docs.sparkSession.sparkContext.broadcast(model)  # the weighty features and SIZE ** 3 numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = broadcast.value
        restorer = restorer_of(m.letters)
        weight: dict[str, float] = {}
        for b in slices(batches, "t"):
            score, hits = [], []
            for t in as_texts(b.column(1)):
                total, n = m.bias, 0
                for w in restorer.words(t):
                    x = weight.get(w)
                    if x is None:
                        if len(weight) >= CACHE:
                            weight.clear()
                        x = weight[w] = m.word_weight(w)
                    if x:
                        total += x
                        n += 1
                score.append(total)
                hits.append(n)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(1 / (1 + np.exp(-np.array(score)))), pa.array(hits, pa.int64())], [ids, "score", "hits"])

    schema = T.StructType([T.StructField(ids, docs.schema[ids].dataType), T.StructField("score", T.DoubleType()), T.StructField("hits", T.LongType())])
    return docs.select(docs[ids], docs[text].cast("string").alias("t")).mapInArrow(run, schema)
