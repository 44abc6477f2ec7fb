"""Language-model scoring by cross-entropy difference.

Two bigram models, of a target (documents that a labelled table marks) and of the background (all documents), share one vocabulary: words that occur
COMMON times or more in the corpus; all others are one unknown word. They are matched: a document is scored by models that have not seen it (its own
counts are taken out of both), and the background's counts are scaled to the target's size, T tokens, so that smoothing weighs the same in both:
    p(w | v) = (s c(v, w) + M p(w)) / (s c(v) + M),   p(w) = (s c(w) + 1) / (T + V + 1),   s: 1 for the target, T / tokens for the background
A document's score is the mean over its words of log p_target - log p_background: higher is nearer to the target.

Counts are over all documents. A block of documents counts its own words and bigrams, the owners of hash ranges add the blocks' counts up and answer
each block in its own order, so frequent bigrams move once for each block and no table of the corpus is broadcast or collected.
Counts are kept by the hash range and 40 bits of the hash. Ranges grow in number with the blocks, so one holds about 6 million bigrams at
most, at any size; 6 of a million of them share a key with another, and are counted with it.

Null or empty text: n_words 0, score 0. Null doc_id: returned as null, no target. Repeated rows are documents each, and count each. A very long text is
hashed whole. Ties can't matter. Further columns are ignored. No target documents (other than the scored one): both models are uniform, score 0. An empty table gives no rows.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenpath.llm import blocks as B
from lumenpath.llm.arrays import U64, Words, mix, row_sums, runs, text_column
from lumenpath.llm.sparkutil import ship

COMMON, M = 3, 4.0
ROWS_PER_BLOCK = 2048
_UNKNOWN = U64(0x7F4A7C15F39CC060)
_MARKS, _TOTALS = -1, -2
#: What the models need of all words.
SIZES = ("n", "t", "n0", "t0", "v")


def _words(table: pa.Table, letters: pa.Table):
    """Hashes of the block's words, bounds of its documents, whether each word is in a target document."""
    data, offsets = text_column(table["text"])
    counts, hashes = [], []
    for i, j in runs(offsets):
        words = Words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], lower=True)
        counts.append(words.counts)
        hashes.append(words.hash)
    marks = [B.unpack(b, [np.int64])[0] for k, b in zip(letters["kind"].to_pylist(), letters["body"].to_pylist(), strict=True) if k == _MARKS]
    target = np.isin(table["doc_id"].to_numpy(), np.concatenate(marks)) if marks else np.zeros(table.num_rows, bool)
    n = np.concatenate(counts)
    return np.concatenate(hashes), np.append(0, np.cumsum(n)), np.repeat(target, n)


def _marks(table: pa.Table) -> pa.Table:
    return B.mail([B.reply(table["block"][0].as_py(), _MARKS, B.pack([table["doc_id"].to_numpy()]))])


def _pairs(h: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bigram that ends at each word, and which words have a word before them."""
    has = np.ones(len(h), bool)
    has[bounds[:-1][bounds[:-1] < len(h)]] = False
    pair = np.zeros(len(h), U64)
    pair[1:] = mix(h[:-1] * U64(0x9FB21C651E98DF25) + h[1:])
    return pair[has], has


def _keys(h: np.ndarray, n_buckets: int) -> np.ndarray:
    """A hash range and 40 bits of the hash: what counts are kept by."""
    return (B.bucket_of(h, n_buckets).astype(U64) << U64(40)) | (h & U64((1 << 40) - 1))


def _count(keys: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    found, inverse, n = np.unique(keys, return_inverse=True, return_counts=True)
    return found, n, np.bincount(inverse[target], minlength=len(found)), inverse


def _pack_counts(count: np.ndarray, target: np.ndarray) -> bytes:
    """Two columns of counts; most are one and none. The rest by byte planes, which compress well."""
    many = (count > 1) | (target > 0)
    values = np.stack([count[many], target[many]]).astype("<u4")
    return np.packbits(many).tobytes() + np.ascontiguousarray(values.view(np.uint8).reshape(-1, 4).T).tobytes()


def _unpack_counts(body: bytes, n: int) -> tuple[np.ndarray, np.ndarray]:
    flags = -(-n // 8)
    many = np.unpackbits(np.frombuffer(body, np.uint8, flags), count=n).astype(bool)
    values = np.ascontiguousarray(np.frombuffer(body, np.uint8, offset=flags).reshape(4, -1).T).view("<u4").reshape(2, -1)
    count, target = np.ones(n, np.int64), np.zeros(n, np.int64)
    count[many], target[many] = values
    return count, target


def _letters(found, n, in_target, block: int, n_buckets: int) -> pa.Table:
    """Keys (five bytes each), counts and counts in the target."""
    at = np.searchsorted(found >> U64(40), np.arange(n_buckets + 1, dtype=U64))
    out = []
    for b in np.flatnonzero(np.diff(at)).tolist():
        own = found[at[b] : at[b + 1]]
        body = B.pack([own.astype(np.uint32), (own >> U64(32)).astype(np.uint8)])
        out.append((b, block, 0, body + _pack_counts(n[at[b] : at[b + 1]], in_target[at[b] : at[b + 1]])))
    return B.mail(out)


def _sums(bodies: list[bytes]) -> tuple[list[int], np.ndarray, np.ndarray, np.ndarray]:
    """(keys of each letter, number of the key of each entry, its count in all, in the target) over one owner's letters."""
    owns, counts, targets = [], [], []
    for body in bodies:
        low, high = B.unpack(body, [np.uint32, np.uint8])
        count, target = _unpack_counts(body[8 + 5 * len(low) :], len(low))
        owns.append(low.astype(U64) | (high.astype(U64) << U64(32)))
        counts.append(count)
        targets.append(target)
    keys, inverse = np.unique(np.concatenate(owns), return_inverse=True)
    return [len(x) for x in owns], inverse, *(np.bincount(inverse, np.concatenate(x), len(keys)).astype(np.int64) for x in (counts, targets))


def _added(got: list[tuple[int, int, bytes]], bucket: int) -> list[tuple]:
    """To each block, in its own order: the counts of its keys in the whole corpus."""
    sizes, inverse, count, target = _sums([body for _, _, body in got])
    parts = np.split(inverse, np.cumsum(sizes)[:-1])
    return [B.reply(block, bucket, _pack_counts(count[at], target[at])) for (block, _, _), at in zip(got, parts, strict=True)]


def _answered(found: np.ndarray, replies: list[tuple[int, bytes]], n_buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Counts of the block's keys in all documents and in the target."""
    at = np.searchsorted(found >> U64(40), np.arange(n_buckets + 1, dtype=U64))
    count, target = np.ones(len(found)), np.zeros(len(found))
    for bucket, body in replies:
        a, z = int(at[bucket]), int(at[bucket + 1])
        count[a:z], target[a:z] = _unpack_counts(body, z - a)
    return count, target


def _post_words(n_buckets: int):
    def run(table: pa.Table, letters: pa.Table) -> pa.Table:
        if not table.num_rows:
            return B.mail([])
        h, _, target = _words(table, letters)
        found, n, t, _ = _count(_keys(h, n_buckets), target)
        return _letters(found, n, t, table["block"][0].as_py(), n_buckets)

    return run


def _sizes(table: pa.Table) -> pa.Table:
    """Of one owner's words: tokens, unknown tokens (in all, in the target) and vocabulary."""
    _, _, count, target = _sums(table["body"].to_pylist())
    rare = count < COMMON
    values = (count.sum(), target.sum(), count[rare].sum(), target[rare].sum(), (~rare).sum())
    return pa.table({k: pa.array([int(v)]) for k, v in zip(SIZES, values, strict=True)})


def _of(letters: pa.Table, first: int, n: int) -> list[tuple[int, bytes]]:
    return [(k - first, b) for k, b in zip(letters["kind"].to_pylist(), letters["body"].to_pylist(), strict=True) if first <= k < first + n]


def _known_words(h, target, letters, n_buckets):
    """Each word, or the unknown one; each word's number; counts of the numbered words; which of those are in the vocabulary."""
    found, _, _, inverse = _count(_keys(h, n_buckets), target)
    count, in_target = _answered(found, _of(letters, 0, n_buckets), n_buckets)
    common = count >= COMMON
    return np.where(common[inverse], h, _UNKNOWN), inverse, count, in_target, common


def _post_pairs(n_buckets: int):
    def run(table: pa.Table, letters: pa.Table) -> pa.Table:
        if not table.num_rows:
            return B.mail([])
        h, bounds, target = _words(table, letters)
        words, *_ = _known_words(h, target, letters, n_buckets)
        pair, has = _pairs(words, bounds)
        found, n, t, _ = _count(_keys(pair, n_buckets), target[has])
        return _letters(found, n, t, table["block"][0].as_py(), n_buckets)

    return run


def _own(keys: np.ndarray) -> np.ndarray:
    """How often each entry's key is there."""
    _, inverse, n = np.unique(keys, return_inverse=True, return_counts=True)
    return n[inverse]


def _score(n_buckets: int):
    def run(table: pa.Table, letters: pa.Table) -> pa.Table:
        if not table.num_rows:
            return _SCORED.empty_table()
        h, bounds, target = _words(table, letters)
        words, inverse, count, in_target, common = _known_words(h, target, letters, n_buckets)
        pair, has = _pairs(words, bounds)
        found, _, _, number = _count(_keys(pair, n_buckets), target[has])
        both = _answered(found, _of(letters, n_buckets, n_buckets), n_buckets)
        sizes = next(json.loads(body) for _, body in _of(letters, _TOTALS, 1))
        tokens, target_tokens, unknown_tokens, unknown_target, vocabulary = (sizes[k] for k in SIZES)
        n = np.diff(bounds)
        row = np.repeat(np.arange(len(n)), n)
        own_word = _own(row * (len(count) + 1) + np.where(common[inverse], inverse, len(count)))
        own_pair = _own(row[has] * len(found) + number)
        size = target_tokens - target * n[row]
        scale = size / np.maximum(tokens - n[row], 1)
        loss = []
        for uni, bi, unknown, seen, s in ((count, both[0], unknown_tokens, 1, scale), (in_target, both[1], unknown_target, target, np.ones(len(h)))):
            c = (np.where(common, uni, unknown)[inverse] - own_word * seen) * s
            pairs = (bi[number] - np.broadcast_to(seen, len(h))[has] * own_pair) * s[has]
            p = (c + 1) / (size + vocabulary + 1)
            before = np.zeros(len(h))
            before[1:] = c[:-1]
            p[has] = (pairs + M * p[has]) / (before[has] + M)
            loss.append(-row_sums(np.log(p), bounds))
        docs, per = table["doc_id"].to_numpy(), np.maximum(n, 1)
        return pa.table([pa.array(docs, mask=docs == B.NO_ID), pa.array(n), pa.array(loss[1] / per), pa.array(loss[0] / per), pa.array((loss[0] - loss[1]) / per)], schema=_SCORED)

    return run


_SCORED = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("target_loss", pa.float64()), ("background_loss", pa.float64()), ("score", pa.float64())])


def score(docs: DataFrame, targets: DataFrame, rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    """Per document: doc_id, n_words, target_loss and background_loss (nats a word), score (their difference; higher is nearer to the target).

    targets: (doc_id) of the target's documents.
    """
    ship(docs.sparkSession)
    n = max(1, -(-docs.count() // rows_per_block))
    n_buckets = B.buckets_for(n)
    block = lambda key: F.pmod(F.xxhash64(key), F.lit(n)).cast("int").alias("block")
    key, target = F.coalesce(F.col("doc_id").cast("long"), F.lit(B.NO_ID)), F.col("doc_id").cast("long")
    by_block = docs.select(block(key), key.alias("doc_id"), F.col("text").cast("string").alias("text")).groupBy("block")
    marks = targets.where(F.col("doc_id").isNotNull()).select(block(target), target.alias("doc_id")).groupBy("block").applyInArrow(_marks, B.MAIL)
    posted = by_block.cogroup(marks.groupBy("block")).applyInArrow(_post_words(n_buckets), B.MAIL)
    totals = posted.groupBy("bucket").applyInArrow(_sizes, ", ".join(f"{k} long" for k in SIZES)).agg(*[F.coalesce(F.sum(k), F.lit(0)).alias(k) for k in SIZES])
    to_all = totals.select(F.lit(0).alias("bucket"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("block"), F.lit(_TOTALS).alias("kind"), F.to_json(F.struct(*SIZES)).cast("binary").alias("body"))
    words = marks.unionByName(B.owners(posted, _added, with_bucket=True)).unionByName(to_all)
    pairs = B.owners(by_block.cogroup(words.groupBy("block")).applyInArrow(_post_pairs(n_buckets), B.MAIL), _added, with_bucket=True)
    letters = words.unionByName(pairs.withColumn("kind", F.col("kind") + n_buckets))
    return by_block.cogroup(letters.groupBy("block")).applyInArrow(_score(n_buckets), _SCORED_DDL)


_SCORED_DDL = "doc_id long, n_words long, target_loss double, background_loss double, score double"
