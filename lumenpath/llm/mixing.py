"""Mixing to target weights with soft memberships.

1. A classifier learned from a bounded sample of a labelled table (doc_id, domain) gives every document a posterior over domains.
2. Nonnegative document rates r are fitted so that the expected tokens of each domain, sum of r_i * tokens_i * posterior_i, match the targets:
   least squares by projected gradient with momentum. It is preconditioned by tokens, and drawn with a small weight to rate 1; a domain's
   miss counts relative to its share, so that a rare domain is fitted as well as a common one. What the fit misses in the end, and target
   domains that the classifier never saw, are told in a warning.
   An iteration is one pass over the posteriors: a document's rate follows from its posterior and the past residuals (one number for each domain
   and iteration), so rates are never stored or moved, and only sums of one number a domain come to the driver.
3. `sample` makes the rates take effect: floor(rate) copies, and one more with the rest as probability, decided by a hash of the document.

Null or empty text: no tokens; it has the prior's posterior, no influence on the fit, and its rate is what its posterior gives. Repeated rows are documents each;
the labelled sample has one of each doc_id. A very long text is counted a run at a time. Ties of domains go to the first in order. An empty table gives no rows. Without labelled rows every rate is 1. Further columns are ignored by `fit_rates`, kept by `sample`.
"""

from __future__ import annotations

import warnings

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenpath.llm.arrays import SPACE, row_sums, runs, text_column
from lumenpath.llm.samples import labelled_texts
from lumenpath.llm.sparkutil import checkpointed, fresh, ship
from lumenpath.llm.subwords import Classifier, learned

#: The bound of the labelled sample.
TRAIN_ROWS = 3_000
ITERATIONS, TOLERANCE, PULL = 60, 1e-4, 1e-3
#: Shares below this count as this; a gap over MISS of a domain's target is told.
LEAST_SHARE, MISS = 1e-6, 0.01
#: Rows that one task of an iteration passes over.
ROWS_PER_PART = 500_000


def _word_counts(texts) -> np.ndarray:
    every, offsets = text_column(texts)
    out = np.zeros(len(offsets) - 1, np.int64)
    for i, j in runs(offsets):
        data, at = every[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        solid = ~SPACE[data]
        begin = solid.copy()
        if len(data):
            begin[1:] &= ~solid[:-1]
            rows = at[:-1][at[1:] > at[:-1]]
            begin[rows] = solid[rows]
        out[i:j] = row_sums(begin.astype(np.int64), at)
    return out


def learn_domains(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Classifier | None:
    """A classifier of labels (doc_id, domain), from at most `rows` of its rows."""
    own = labels.where(F.col("domain").isNotNull()).select("doc_id", F.col("domain").cast("string").alias("y"))
    return learned(labelled_texts(docs, own, rows), epochs=10, short=0)


def _posteriors(shared):
    def run(batches):
        model = shared.value
        for batch in batches:
            p = model.posteriors(batch.column("text"))
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(p) + 1) * p.shape[1], pa.int32()), pa.array(p.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("mark"), pa.array(_word_counts(batch.column("text"))), flat], ["doc_id", "mark", "tokens", "posterior"])

    return run


def _matrix(column) -> np.ndarray:
    return column.values.to_numpy().reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def _rates(p: np.ndarray, past: list[tuple[np.ndarray, float]], step: float, least: float) -> tuple[np.ndarray, np.ndarray]:
    """The rates after the past iterations, and the point at which the next gradient is taken."""
    rate = ahead = np.full(len(p), max(1.0, least))
    for residual, momentum in past:
        new = np.maximum(least, ahead - step * (p @ residual + PULL * (ahead - 1)))
        ahead = new + momentum * (new - rate)
        rate = new
    return rate, ahead


def _totals(past, step, least):
    def run(batches):
        sums = None
        for batch in batches:
            p, tokens = _matrix(batch.column("posterior")), batch.column("tokens").to_numpy().astype(float)
            rate, ahead = _rates(p, past, step, least)
            part = np.concatenate([(ahead * tokens) @ p, (rate * tokens) @ p])
            sums = part if sums is None else sums + part
        if sums is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(sums)), pa.int32()), pa.array(sums)], ["at", "value"])

    return run


def _moments(batches):
    sums = None
    for batch in batches:
        p, tokens = _matrix(batch.column("posterior")), batch.column("tokens").to_numpy().astype(float)
        part = (p * tokens[:, None]).T @ p
        sums = part if sums is None else sums + part
    if sums is not None:
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(sums.size), pa.int32()), pa.array(sums.ravel())], ["at", "value"])


def _summed(df: DataFrame, run) -> np.ndarray:
    rows = df.mapInArrow(run, "at int, value double").groupBy("at").agg(F.sum("value").alias("value")).collect()
    out = np.zeros(len(rows))
    for r in rows:
        out[r["at"]] = r["value"]
    return out


def _final(labels: list[str], past, step, least):
    def run(batches):
        for batch in batches:
            p = _matrix(batch.column("posterior"))
            best = p.argmax(1)
            names = pa.array([labels[b] for b in best.tolist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("mark"), batch.column("tokens"), names, pa.array(p[np.arange(len(p)), best]), batch.column("posterior"), pa.array(_rates(p, past, step, least)[0])], ["doc_id", "mark", "tokens", "domain", "share", "posterior", "rate"])

    return run


_RATED = "doc_id long, mark long, tokens long, domain string, share double, posterior array<double>, rate double"


def fit_rates(docs: DataFrame, labels: DataFrame, weights: dict[str, float], rows: int = TRAIN_ROWS, budget: float | None = 1.0, least: float = 0.0) -> DataFrame:
    """doc_id, mark (a hash of the text), tokens, domain (the likeliest), share (its posterior), posterior (by sorted domain), rate.

    weights: the wished share of tokens of each domain (others: 0); budget: the mixture's tokens, as a multiple of those of docs, or None:
    as many as need no domain to shrink; least: no rate is below it (1: no document is dropped).
    """
    spark = docs.sparkSession
    ship(spark)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("mark"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    model = learn_domains(docs, labels, rows)
    if model is None:
        words = F.size(F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")).cast("long")
        return own.select("doc_id", "mark", words.alias("tokens"), F.lit(None).cast("string").alias("domain"), F.lit(0.0).alias("share"), F.array().cast("array<double>").alias("posterior"), F.lit(1.0).alias("rate"))
    shared = spark.sparkContext.broadcast(model)
    soft = checkpointed(own.mapInArrow(_posteriors(shared), "doc_id long, mark long, tokens long, posterior array<double>"))
    parts = max(2 * spark.sparkContext.defaultParallelism, soft.count() // ROWS_PER_PART)
    soft = soft.coalesce(parts)  # the posteriors are small beside the texts that they were made from
    n = len(model.labels)
    moments = _summed(soft, _moments)
    moments = moments.reshape(n, n) if moments.size else np.zeros((n, n))
    total = moments.sum() or 1.0  # posteriors sum to 1, so this is all tokens
    wished = np.array([max(0.0, weights.get(x, 0.0)) for x in model.labels])
    wished = wished / (wished.sum() or 1.0)
    unseen = sorted(x for x, w in weights.items() if w > 0 and x not in model.labels)
    if unseen:
        warnings.warn(f"mixing: no labelled document of {', '.join(unseen)}; the other targets share their weight", stacklevel=2)
    share = moments.sum(1) / total
    if budget is None:
        budget = max([1.0, *(share[wished > 0] / wished[wished > 0])])
    wished = budget * wished
    scale = 1 / np.maximum(share, LEAST_SHARE)
    step = 1 / (float(np.linalg.eigvalsh(moments / total * np.sqrt(np.outer(scale, scale))).max()) + PULL + 1e-12)
    past: list[tuple[np.ndarray, float]] = []
    t, last = 1.0, np.inf
    for k in range(ITERATIONS + 1):
        sums = _summed(soft, _totals(past, step, least))
        sums = sums / total if sums.size else np.zeros(2 * n)
        gaps = sums[n:] - wished
        gap = float(np.abs(gaps).max())
        if k == ITERATIONS or (past and (gap < TOLERANCE or abs(last - gap) < TOLERANCE * 1e-2)):
            break
        last = gap
        ahead = (1 + (1 + 4 * t * t) ** 0.5) / 2
        past.append(((sums[:n] - wished) * scale, (t - 1) / ahead))
        t = ahead
    missed = [f"{x} {w + g:.4f} for {w:.4f}" for x, w, g in zip(model.labels, wished, gaps, strict=True) if abs(g) > max(TOLERANCE, MISS * w)] if moments.any() else []
    if missed:
        warnings.warn(f"mixing: tokens as a multiple of those of docs miss their targets: {', '.join(missed)}", stacklevel=2)
    return soft.mapInArrow(_final(model.labels, past, step, least), _RATED)


def sample(docs: DataFrame, rated: DataFrame) -> DataFrame:
    """docs, each row as often as its rate says."""
    key, mark, rate, copy = fresh(docs, "key", "mark", "rate", "copy")
    rates = rated.select(F.col("doc_id").alias(key), F.col("mark").alias(mark), F.col("rate").alias(rate)).dropDuplicates([key, mark])
    own = docs.withColumn(key, F.col("doc_id").cast("long")).withColumn(mark, F.xxhash64("text"))
    joined = own.join(rates, own[key].eqNullSafe(rates[key]) & (own[mark] == rates[mark])).drop(rates[key]).drop(rates[mark])
    draw = F.pmod(F.xxhash64(F.lit("mix"), F.col(key), F.col(mark)), F.lit(1 << 30)) / float(1 << 30)
    times = (F.floor(rate) + F.when(draw < F.col(rate) - F.floor(rate), 1).otherwise(0)).cast("int")
    return joined.withColumn(copy, F.explode(F.array_repeat(F.lit(0), times))).select(*[F.col(f"`{c}`") for c in docs.columns])
