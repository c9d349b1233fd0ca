"""Quality classifier: gradient-boosted trees over histograms of document statistics.

Trees are grown level by level on binned features and flattened into arrays, so that a
batch of documents goes through all trees by array lookups.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import as_bytes, crc_mod, slices
from .quality import repeated_window_words

STATISTICS = [
    "log_words", "word_length", "distinct_words", "repeated_words", "upper_share", "digit_share", "symbol_share", "stop_share", "comma_share",
    "bang_share", "bar_share", "high_byte_share", "newline_share", "words_a_sentence", "repeated_lines", "words_a_line", "byte_entropy", "top_word_share", "other_share", "odd_word_ends",
]
_KIND = np.zeros(256, np.int64)
for _k, _chars in enumerate(("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "#*$%&<>@^~_=+{}[]\\", ".", ",;:", "!?", "|", "\n"), 1):
    _KIND[[ord(c) for c in _chars]] = _k
_KIND[128:] = 9
_KIND[[ord(c) for c in "\"'()-/`"]] = 10


def statistics(text: bytes) -> list[float]:
    """The STATISTICS of a text; of an empty one all 0."""
    words = text.split()
    if not words:
        return [0.0] * len(STATISTICS)
    raw = np.frombuffer(text, np.uint8)
    histogram = np.bincount(raw, minlength=256)
    kinds = np.bincount(_KIND, histogram, 11)
    n, chars = len(words), len(raw)
    p = histogram[histogram > 0] / chars
    lines = [x for x in text.split(b"\n") if x.strip()]
    low = [w.lower() for w in words]
    count: dict[bytes, int] = {}
    for w in low:
        count[w] = count.get(w, 0) + 1
    ends = sum(w[-1] in b"#*$%&<>@^~_=+|" for w in words)
    return [
        float(np.log1p(n)), (chars - n) / n, len(count) / n, repeated_window_words(low) / n, kinds[1] / chars, kinds[2] / chars, kinds[3] / chars, kinds[4] / n, kinds[5] / n,
        kinds[6] / n, kinds[7] / n, kinds[9] / chars, kinds[8] / n, n / (kinds[4] + kinds[6] + 1), 1 - len(set(lines)) / len(lines), n / len(lines), float(-(p * np.log2(p)).sum()), max(count.values()) / n, kinds[10] / chars, ends / n,
    ]


class Trees:
    """Flat arrays: a node's feature, threshold and left child (the right one follows it); a leaf is its own child."""

    def __init__(self, feature: np.ndarray, threshold: np.ndarray, child: np.ndarray, value: np.ndarray, roots: np.ndarray, depth: int, base: float):
        self.feature, self.threshold, self.child, self.value, self.roots, self.depth, self.base = feature, threshold, child, value, roots, depth, base

    def margin(self, x: np.ndarray) -> np.ndarray:
        at = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            leaf = self.child[at] < 0
            at = np.where(leaf, at, self.child[at] + (x[rows, self.feature[at]] > self.threshold[at]))
        return self.base + self.value[at].sum(1)

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x)))


def fit_trees(x: np.ndarray, y: np.ndarray, rounds: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, smooth: float = 2.0, least: int = 10) -> Trees:
    """Boosts trees on the logistic loss (gain by first and second derivatives over histograms)."""
    prior = min(max(float(y.mean()) if len(y) else 0.5, 1e-3), 1 - 1e-3)
    base = float(np.log(prior / (1 - prior)))
    features = x.shape[1]
    edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, bins + 1)[1:-1])) if len(x) else np.zeros(0) for k in range(features)]
    binned = np.stack([np.searchsorted(e, x[:, k], side="left") for k, e in enumerate(edges)], axis=1) if len(x) else np.zeros((0, features), np.int64)
    margin = np.full(len(y), base)
    nodes: list[list] = []  # feature, threshold, child, value
    roots = []
    for _ in range(rounds if len(np.unique(y)) == 2 else 0):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, p * (1 - p)
        roots.append(len(nodes))
        nodes.append([0, 0.0, -1, 0.0])
        where = np.full(len(y), roots[-1])
        open_nodes = [roots[-1]]
        for level in range(depth + 1):
            new = []
            for node in open_nodes:
                own = np.flatnonzero(where == node)
                total_g, total_h = g[own].sum(), h[own].sum()
                nodes[node][3] = float(rate * total_g / (total_h + smooth))
                if level == depth or len(own) < 2 * least:
                    continue
                flat = (binned[own] + np.arange(features) * bins).ravel()
                size = features * bins
                gs, hs, ns = (np.bincount(flat, np.repeat(w, features), size).reshape(features, bins).cumsum(1) for w in (g[own], h[own], np.ones(len(own))))
                gain = gs**2 / (hs + smooth) + (total_g - gs) ** 2 / (total_h - hs + smooth) - total_g**2 / (total_h + smooth)
                gain[(ns < least) | (len(own) - ns < least)] = 0
                f, cut = np.unravel_index(int(gain.argmax()), gain.shape)
                if gain[f, cut] <= 1e-6 or cut >= len(edges[f]):
                    continue
                nodes[node][:3] = [int(f), float(edges[f][cut]), len(nodes)]
                where[own] = len(nodes) + (binned[own, f] > cut)
                new += [len(nodes), len(nodes) + 1]
                nodes += [[0, 0.0, -1, 0.0], [0, 0.0, -1, 0.0]]
            open_nodes = new
        margin += np.array([n[3] for n in nodes])[where]
    c = list(zip(*nodes, strict=True)) if nodes else [[], [], [], []]
    return Trees(np.array(c[0], np.int64), np.array(c[1], float), np.array(c[2], np.int64), np.array(c[3], float), np.array(roots, np.int64), depth, base)


def document_statistics(df: DataFrame, ids: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of df: the id column and stats, the STATISTICS of the whole text as an array. Null texts count as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "t"):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([statistics(t) for t in as_bytes(b.column(1))], pa.list_(pa.float64()))], [ids, "stats"])

    schema = T.StructType([T.StructField(ids, df.schema[ids].dataType), T.StructField("stats", T.ArrayType(T.DoubleType()))])
    return df.select(df[ids], df[text].cast("string").alias("t")).mapInArrow(run, schema)


def fit_quality(docs: DataFrame, labels: DataFrame, ids: str = "doc_id", text: str = "text", label: str = "quality", hold_out: tuple[int, int] = (4, 2), most_rows: int = 12_000) -> Trees:
    """Learns from at most most_rows labelled documents of either class (a bounded sample, in the
    order of the ids' hashes) whose crc32(id) mod hold_out[0] is not hold_out[1].

    Only their statistics reach the driver, one row an id: where an id repeats, the least (null and
    empty texts have statistics too). Rows with a null id or another label don't count;
    with labels of one class, or none, the score is their share (kept off 0 and 1), or 0.5.
    """
    own = labels.select(F.col(ids), F.col(label).cast("int").alias("l")).filter(f"l in (0, 1) and {ids} is not null").filter(crc_mod(ids, hold_out[0]) != hold_out[1]).groupBy(ids).agg(F.min("l").alias("l"))
    sizes = {r["l"]: r["count"] for r in own.groupBy("l").count().collect()}
    sample = own.filter("l = 1").orderBy(F.xxhash64(ids), ids).limit(most_rows).unionByName(own.filter("l = 0").orderBy(F.xxhash64(ids), ids).limit(most_rows))
    chosen = F.broadcast(sample)  # at most 2 * most_rows ids
    stats = document_statistics(docs.join(chosen, ids, "left_semi"), ids, text).groupBy(ids).agg(F.min("stats").alias("stats"))
    rows = stats.join(chosen, ids).select("stats", "l").toPandas()
    x = np.array(rows["stats"].tolist(), float).reshape(len(rows), len(STATISTICS))
    y = rows["l"].to_numpy(float)
    trees = fit_trees(x, y)
    # Where the sample evens out the classes, the shares in all labels come back.
    taken = {k: min(v, most_rows) for k, v in sizes.items()}
    if len(sizes) == 2:
        trees.base += float(np.log(sizes[1] / taken[1]) - np.log(sizes[0] / taken[0]))
    return trees


def score_quality(docs: DataFrame, trees: Trees, ids: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: the id column and score, the probability of label 1. Only the text is an input; null texts score as empty ones, repeated rows stay."""
    model = docs.sparkSession.sparkContext.broadcast(trees)  # of a fixed number of nodes at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "t"):
            x = np.array([statistics(t) for t in as_bytes(b.column(1))], float).reshape(b.num_rows, len(STATISTICS))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.value.probability(x))], [ids, "score"])

    schema = T.StructType([T.StructField(ids, docs.schema[ids].dataType), T.StructField("score", T.DoubleType())])
    return docs.select(docs[ids], docs[text].cast("string").alias("t")).mapInArrow(run, schema)
