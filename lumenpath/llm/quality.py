"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics are counted for all rows of a run at once (see arrays.py). Trees are grown on quantile bins of a bounded sample with logistic loss, level by level,
as complete binary trees; they are flattened into arrays, and rows walk down all trees by vectorised indexing.

Null text: statistics of an empty one. Repeated rows are scored each. Further columns are ignored by `scores`, kept by `keep_good`.
Labels of one class only, or none: every score is that class's share (1 without labels).
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenpath.llm.arrays import Words, distinct, row_sums, runs, text_column, windows
from lumenpath.llm.samples import labelled_texts
from lumenpath.llm.sparkutil import fresh, ship

#: The bound of the sample.
TRAIN_ROWS = 20_000
TREES, DEPTH, BINS, RATE, L2 = 100, 4, 64, 0.12, 1.0

_CLASSES = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "lower": b"abcdefghijklmnopqrstuvwxyz",
    "digit": b"0123456789",
    "symbol": b"#*$%&|<>",
    "mark": b"!?",
    "stop": b".,;:",
    "other": b"\"'()[]{}@/\\^_`~+=-",
    "line": b"\n",
    "high": bytes(range(0xC0, 0x100)),
}
STATISTICS = ["log_bytes", "log_words", "log_lines", "word_bytes", "long_words", "longest_word", "one_byte_words", "distinct_words", "distinct_pairs", "distinct_triples", "distinct_lines", "words_a_line", *_CLASSES]
_KINDS = np.zeros((256, len(_CLASSES)), bool)
for _i, _bytes in enumerate(_CLASSES.values()):
    _KINDS[list(_bytes), _i] = True


def _lines(data: np.ndarray, offsets: np.ndarray, words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Lines with a word, and distinct ones among them, of each row; a line is known by its words."""
    n = len(offsets) - 1
    if not len(words):
        return np.zeros(n, np.int64), np.zeros(n, np.int64)
    breaks = np.cumsum(data == 10)[words.start]
    row = words.row_of()
    new = np.ones(len(words), bool)
    new[1:] = (breaks[1:] != breaks[:-1]) | (row[1:] != row[:-1])
    at = np.flatnonzero(new)
    place = np.arange(len(words)) - np.repeat(at, np.diff(np.append(at, len(words))))
    h = np.add.reduceat(words.hash * (place.astype(np.uint64) * np.uint64(2) + np.uint64(1)), at)
    return np.bincount(row[at], minlength=n), np.diff(distinct(row[at], h, n)[2])


def statistics(texts) -> np.ndarray:
    """(rows, STATISTICS)"""
    data, offsets = text_column(texts)
    out = np.zeros((len(offsets) - 1, len(STATISTICS)))
    for i, j in runs(offsets):
        own, at = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        words = Words(own, at, lower=True)
        size, n = np.diff(at), words.counts
        length = words.end - words.start
        per_word, per_byte = np.maximum(n, 1), np.maximum(size, 1)
        row = words.row_of()
        lines, new_lines = _lines(own, at, words)
        columns = [np.log1p(size), np.log1p(n), np.log1p(lines), row_sums(length, words.first) / per_word, row_sums((length > 12).astype(np.int64), words.first) / per_word]
        longest = np.zeros(j - i)
        if len(words):
            longest[n > 0] = np.maximum.reduceat(length, words.first[:-1][n > 0])
        columns += [longest, row_sums((length == 1).astype(np.int64), words.first) / per_word]
        columns.append(np.diff(distinct(row, words.hash, j - i)[2]) / per_word)
        for k in (2, 3):
            place, h = windows(words, k)
            columns.append(np.diff(distinct(row[place], h, j - i)[2]) / np.maximum(n - k + 1, 1))
        columns += [new_lines / np.maximum(lines, 1), n / np.maximum(lines, 1)]
        for kind in range(len(_CLASSES)):
            columns.append(row_sums(_KINDS[own, kind].astype(np.int64), at) / per_byte)
        out[i:j] = np.stack(columns, 1)
    return out


@dataclass
class Forest:
    """Complete binary trees: node k's children are 2k + 1 and 2k + 2; arrays of (trees, nodes)."""

    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray
    base: float
    names: list[str] = field(default_factory=lambda: list(STATISTICS))

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            while feature.size and node[:1].size and node[0] < len(feature):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            total += leaf[node - len(feature)]
        return 1 / (1 + np.exp(-total))


def grow(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH) -> Forest:
    n, width = x.shape
    inner = 2**depth - 1
    share = np.clip(y.mean(), 1e-6, 1 - 1e-6) if n else 1 - 1e-6
    base = float(np.log(share / (1 - share)))
    forest = Forest(np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1)), base)
    if n == 0 or y.min() == y.max():
        return forest
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(width)]
    binned = np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)], 1)  # bin b: edges[b - 1] < x <= edges[b]
    total, made = np.full(n, base), []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-total))
        g, h = p - y, np.maximum(p * (1 - p), 1e-9)
        node = np.zeros(n, np.int64)
        feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
        for level in range(depth):
            first, here = 2**level - 1, 2**level
            local = node - first
            gain = np.zeros((here, width))
            cut = np.zeros((here, width), np.int64)
            for f in range(width):
                key = local * BINS + binned[:, f]
                sums = [np.cumsum(np.bincount(key, w, here * BINS).reshape(here, BINS), 1) for w in (g, h)]
                gl, hl = (s[:, : max(1, len(edges[f]))] for s in sums)
                gt, ht = (s[:, -1:] for s in sums)
                split = gl**2 / (hl + L2) + (gt - gl) ** 2 / (ht - hl + L2) - gt**2 / (ht + L2)
                split[(hl < 1) | (ht - hl < 1)] = 0
                cut[:, f] = split.argmax(1)
                gain[:, f] = split.max(1)
            best = gain.argmax(1)
            for k in range(here):
                if gain[k, best[k]] > 1e-6 and len(edges[best[k]]):
                    feature[first + k] = best[k]
                    threshold[first + k] = edges[best[k]][cut[k, best[k]]]
            node = 2 * node + 1 + (x[np.arange(n), feature[node]] > threshold[node])
        local = node - inner
        leaf = -RATE * np.bincount(local, g, inner + 1) / (np.bincount(local, h, inner + 1) + L2)
        total += leaf[local]
        made.append((feature, threshold, leaf))
    return Forest(*(np.stack(c) for c in zip(*made, strict=True)), base)


def _statistics(batches):
    for batch in batches:
        x = statistics(batch.column("text"))
        yield pa.RecordBatch.from_arrays([batch.column("y"), pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))], ["y", "x"])


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = TRAIN_ROWS) -> Forest:
    """Trees for label = 1, learned from at most `rows` rows of labels (doc_id, label) and their documents."""
    ship(docs.sparkSession)
    own = labels.where(F.col(label).isNotNull()).select("doc_id", F.col(label).cast("int").alias("y"))
    found = labelled_texts(docs, own, rows).select("y", "text").mapInArrow(_statistics, "y int, x array<double>").collect()
    x = np.array([r["x"] for r in found]).reshape(len(found), len(STATISTICS))
    y = np.array([r["y"] for r in found], float)
    order = np.lexsort((*x.T, y)) if len(x) else slice(0)  # so that the order of partitions doesn't matter
    return grow(x[order], (y[order] == 1).astype(float))


def _score(shared):
    def run(batches):
        for batch in batches:
            s = shared.value.score(statistics(batch.column("text")))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("mark"), pa.array(s)], ["doc_id", "mark", "score"])

    return run


def scores(docs: DataFrame, forest: Forest) -> DataFrame:
    """(doc_id, mark, score) of each row; mark is a hash of the text, or null."""
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(forest)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("mark"), F.col("text").cast("string").alias("text"))
    return own.mapInArrow(_score(shared), "doc_id long, mark long, score double")


def _keep(shared, at: int, least: float):
    def run(batches):
        for batch in batches:
            good = shared.value.score(statistics(batch.column(at))) >= least
            yield batch.filter(pa.array(good))

    return run


def keep_good(docs: DataFrame, forest: Forest, least: float = 0.3) -> DataFrame:
    """The rows of docs whose score is at least `least`, in one pass, with all their columns."""
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(forest)
    (text,) = fresh(docs, "text_")
    names = [f"c{i}" for i in range(len(docs.columns))] + [text]
    own = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, names[:-1], strict=True)], F.col("text").cast("string").alias(text)) if dict(docs.dtypes)["text"] != "string" else docs.toDF(*names[:-1])
    at = docs.columns.index("text") if len(own.columns) == len(docs.columns) else len(docs.columns)
    return own.mapInArrow(_keep(shared, at, least), own.schema).select(*[F.col(n).alias(c) for c, n in zip(docs.columns, names[:-1], strict=True)])
