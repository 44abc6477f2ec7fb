"""A text classifier: averaged hashed subword embeddings and a linear softmax, trained by stochastic gradient descent in numpy.

Subwords are runs of 2, 3 and 4 bytes of the text in lower case, white space as one blank, hashed into BUCKETS rows of an
embedding table. A text is the average of its subwords' embeddings. Trained, table times softmax weights is one value
for each bucket and label, so scoring a text is a lookup and a sum, for all rows of a run at once.

What is learned from is counted where the texts are (`counted`): a whole text, and short passages of it, as counts of buckets. So a text of any
length sends at most BUCKETS counts, PIECE_BYTES bytes, for each piece, and no text is collected.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenpath.llm.arrays import RUN_BYTES, SPACE, runs, text_column

SIZES, BITS, WIDTH = (2, 3, 4), 14, 16
BUCKETS = 1 << BITS
#: Small samples are gone over so often that there are as many steps.
LEAST_STEPS = 1_500

_FOLD = np.arange(256, dtype=np.uint32)
_FOLD[ord("A") : ord("Z") + 1] += 32
_FOLD[SPACE] = 32


def _folded(data: np.ndarray) -> np.ndarray:
    code = _FOLD[data]
    if len(data) > 1:  # capitals of U+00C0 to U+00DE
        after = np.flatnonzero(data[:-1] == 0xC3) + 1
        after = after[(data[after] >= 0x80) & (data[after] <= 0x9E)]
        code[after] += 32
    return code


def subwords(data: np.ndarray, offsets: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each size: the bucket at each byte position (BUCKETS where no subword of the row starts), and the rows' counts."""
    n, out = len(data), []
    code = _folded(data)
    lengths = np.diff(offsets)
    for size in SIZES:
        bucket = np.full(n, BUCKETS, np.int32)
        if n >= size:
            h = code[: n - size + 1].copy()
            for j in range(1, size):
                h *= np.uint32(0x01000193)
                h ^= code[j : n - size + 1 + j]
            h += np.uint32(size)
            h *= np.uint32(0x9E3779B1)
            bucket[: n - size + 1] = (h >> np.uint32(32 - BITS)).astype(np.int32)
            for j in range(1, size):
                at = offsets[1:] - j
                bucket[at[at >= 0]] = BUCKETS
        out.append((bucket, np.maximum(lengths - size + 1, 0)))
    return out


#: What a piece takes at most: a bucket and a count, two bytes each (counts over 65,535 are that).
PIECE_BYTES = 4 * BUCKETS


def _histogram(data: np.ndarray) -> np.ndarray:
    """How often each bucket is in one text, RUN_BYTES of it at a time; the parts overlap by a subword."""
    total, most = np.zeros(BUCKETS, np.int64), max(SIZES)
    for i in range(0, len(data), RUN_BYTES):
        own = data[max(0, i - most) : i + RUN_BYTES]
        for size, (bucket, _) in zip(SIZES, subwords(own, np.array([0, len(own)])), strict=True):
            bucket = bucket[most + 1 - size :] if i else bucket
            total += np.bincount(bucket[bucket < BUCKETS], minlength=BUCKETS)
    return total


def _counts(text: bytes) -> bytes:
    """Buckets, ascending, and how often each is there."""
    total = _histogram(np.frombuffer(text, np.uint8))
    found = np.flatnonzero(total)
    return found.astype("<u2").tobytes() + np.minimum(total[found], 65_535).astype("<u2").tobytes()


def _uncounted(piece: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Buckets, and the share of each."""
    both = np.frombuffer(piece, "<u2")
    bucket, n = both[: len(both) // 2].astype(np.int64), both[len(both) // 2 :].astype(np.float32)
    return bucket, n / max(1.0, n.sum())


@dataclass
class Classifier:
    labels: list[str]
    value: np.ndarray  # of each bucket and label; the last row is zero
    bias: np.ndarray
    temperature: float
    #: A text is accepted if its best probability is at least this.
    threshold: float

    def posteriors(self, texts) -> np.ndarray:
        """Probabilities (rows, labels); the prior's for a text without subwords."""
        data, offsets = text_column(texts)
        out = np.zeros((len(offsets) - 1, len(self.labels)))
        for i, j in runs(offsets, 1 << 20):
            own, at = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
            if len(own) > RUN_BYTES:  # one long text
                every = _histogram(own)
                out[i] = every @ self.value[:-1].astype(float) / max(1, every.sum()) + self.bias
                continue
            total, count = np.zeros((j - i, len(self.labels))), np.zeros(j - i)
            solid = np.flatnonzero(np.diff(at))
            for bucket, n in subwords(own, at) if len(solid) else []:
                total[solid] += np.add.reduceat(self.value[bucket], at[solid], axis=0)
                count += n
            out[i:j] = total / np.maximum(count, 1)[:, None] + self.bias
        return softmax(out / self.temperature)


def softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(1, keepdims=True))
    return x / x.sum(1, keepdims=True)


def _pieces(text: str, short: int) -> list[bytes]:
    """The whole text, and some short passages of it, so that short texts are learned too; which ones, its own checksum decides."""
    out, words = [text.encode()], text.split()
    rng = np.random.default_rng(zlib.crc32(out[0]))
    for _ in range(short if len(words) > 8 else 0):
        n = int(rng.integers(1, 16))
        at = int(rng.integers(0, len(words) - min(n, len(words) - 1)))
        out.append(" ".join(words[at : at + n]).encode())
    return out


COUNTED = "y string, pieces array<binary>"


def counted(short: int):
    """Of (text, y): y, and the counts of the text's pieces."""

    def run(batches):
        for batch in batches:
            pieces = [[_counts(p) for p in _pieces(text or "", short)] for text in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("y"), pa.array(pieces, pa.list_(pa.binary()))], ["y", "pieces"])

    return run


def learned(rows: DataFrame, epochs: int = 6, short: int = 2) -> Classifier | None:
    """A classifier of y from rows (text, y), of which there should be a bounded number; None without rows."""
    found = rows.select(F.col("text").cast("string").alias("text"), F.col("y").cast("string").alias("y")).mapInArrow(counted(short), COUNTED).collect()
    return train([(r["y"], [bytes(p) for p in r["pieces"]]) for r in found], epochs) if found else None


def train(rows: list[tuple[str, list[bytes]]], epochs: int = 6, rate: float = 20.0, batch: int = 32, precision: float = 0.99, seed: int = 7) -> Classifier:
    """rows: (label, counts of the pieces). A tenth of them is held back for temperature and threshold."""
    labels = sorted({y for y, _ in rows})
    rng = np.random.default_rng(seed)
    number = {y: i for i, y in enumerate(labels)}
    rows = sorted(rows)
    rng.shuffle(rows)
    held, used = rows[: len(rows) // 10], rows[len(rows) // 10 :]
    examples = [(*_uncounted(p), number[y]) for y, pieces in used for p in pieces if p]
    table = (rng.random((BUCKETS, WIDTH), np.float32) - 0.5) / WIDTH
    weight, bias = np.zeros((WIDTH, len(labels)), np.float32), np.zeros(len(labels), np.float32)
    epochs = max(epochs, LEAST_STEPS * batch // max(1, len(examples)))
    steps, step = max(1, epochs * -(-len(examples) // batch)), 0
    for _ in range(epochs):
        order = rng.permutation(len(examples))
        for at in range(0, len(order), batch):
            some = [examples[k] for k in order[at : at + batch]]
            bucket, inverse = np.unique(np.concatenate([e[0] for e in some]), return_inverse=True)
            x = np.zeros((len(some), len(bucket)), np.float32)
            x[np.repeat(np.arange(len(some)), [len(e[0]) for e in some]), inverse] = np.concatenate([e[1] for e in some])
            mean = x @ table[bucket]
            slope = softmax(mean @ weight + bias).astype(np.float32)
            slope[np.arange(len(some)), [e[2] for e in some]] -= 1
            slope *= rate * (1 - step / steps) / len(some)
            back = slope @ weight.T
            weight -= mean.T @ slope
            bias -= slope.sum(0) * np.float32(0.01)
            table[bucket] -= x.T @ back
            step += 1
    value = np.zeros((BUCKETS + 1, len(labels)), np.float32)
    value[:-1] = table @ weight
    model = Classifier(labels, value, bias, 1.0, 0.0)
    return _calibrated(model, held, number, precision)


def _calibrated(model: Classifier, held: list, number: dict, precision: float) -> Classifier:
    pieces = [(_uncounted(p), number[y]) for y, own in held for p in own]
    if len(pieces) < 20:
        return model
    right = np.array([y for _, y in pieces])
    logit = np.stack([n @ model.value[bucket] + model.bias for (bucket, n), _ in pieces]).astype(float)
    grid = np.geomspace(0.25, 8, 41)
    loss = [-np.log(np.maximum(softmax(logit / t)[np.arange(len(right)), right], 1e-12)).mean() for t in grid]
    model.temperature = float(grid[int(np.argmin(loss))])
    p = softmax(logit / model.temperature)
    order = np.argsort(-p.max(1))
    hit = np.cumsum(p.argmax(1)[order] == right[order]) / np.arange(1, len(order) + 1)
    good = np.flatnonzero(hit >= precision)
    model.threshold = float(p.max(1)[order][good[-1]]) if len(good) else 1.0
    return model
