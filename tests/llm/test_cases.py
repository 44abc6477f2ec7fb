"""Repeated rows, columns with clashing names, texts of megabytes: each operator's defined results."""

import hashlib
import math
from collections import Counter

import public_tokenizers
from corpus_cases import SCHEMA
from pyspark.sql import functions as F

from lumenpath.llm import chat, jaccard, langid, lmscore, mixing, packing, quality, substring

CLASHES = ("block", "mark", "key", "root", "n", "n_words", "shard", "score", "letters", "rate", "copy", "domain", "posterior", "kept", "first", "set_id", "level", "size", "words", "component_id")
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def test_repeated_rows(spark):
    rows = [(1, "the same words of one row", "en", "s", 1)] * 30 + [(2, "the same words of one row", "en", "s", 1)] * 3 + [(None, None, None, None, None)] * 4 + [(3, "andere Worte hier", "de", "s", 1)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    labels = spark.createDataFrame([(1, "en"), (1, "en"), (3, "de")], "doc_id long, domain string")
    rated = mixing.fit_rates(docs, labels, {"en": 0.5, "de": 0.5}, budget=None, least=1.0)
    assert Counter(r.doc_id for r in rated.collect()) == {1: 30, 2: 3, None: 4, 3: 1}
    copies = Counter(r.doc_id for r in mixing.sample(docs, rated).collect())
    assert copies[1] % 30 == 0 and copies[1] >= 30 and copies[None] >= 4 and copies[3] >= 1  # equal rows are copied equally often
    pieces = packing.pack(docs, TOKENIZER).collect()
    sizes = {r.doc_id: r.doc_tokens for r in pieces}
    covered = Counter()
    for r in pieces:
        covered[r.doc_id] += r.length
    assert covered == {d: k * sizes[d] for d, k in ((1, 30), (2, 3), (None, 4), (3, 1))} and sizes[None] == 1
    assert Counter(r.doc_id for r in substring.duplicate_words(docs, 5).collect()) == {1: 30, 2: 3, None: 4, 3: 1}
    assert Counter((r.doc_id, r.component_id) for r in jaccard.jaccard_components(docs).collect()) == {(1, 1): 30, (2, 1): 3, (None, None): 4, (3, 3): 1}
    assert Counter(r.doc_id for r in jaccard.keep_one(docs).collect()) == {1: 1, None: 4, 3: 1}
    assert len({(r.doc_id, r.n_words, round(r.score, 9)) for r in lmscore.score(docs, spark.createDataFrame([(1,)], "doc_id long")).collect()}) == 4


def test_clashing_columns(spark, sample):
    rows = [r for r in sample if len(r[1] or "") < 3000][-45:]
    plain = spark.createDataFrame(rows, SCHEMA)
    clashing = plain.select("*", *[F.lit("clash").alias(c) for c in CLASHES])
    rowset = lambda df: Counter(tuple(map(str, r)) for r in df.collect())
    assert rowset(jaccard.jaccard_components(plain)) == rowset(jaccard.jaccard_components(clashing))
    kept = jaccard.keep_one(clashing)
    assert kept.columns == clashing.columns and rowset(kept.select(plain.columns)) == rowset(jaccard.keep_one(plain))
    assert rowset(substring.duplicate_words(plain)) == rowset(substring.duplicate_words(clashing))
    stripped = substring.strip_duplicates(clashing)
    assert stripped.columns == clashing.columns and rowset(stripped.select(plain.columns)) == rowset(substring.strip_duplicates(plain))
    targets = plain.where("doc_id % 3 = 0").select("doc_id")
    assert rowset(lmscore.score(plain, targets)) == rowset(lmscore.score(clashing, targets))
    model = langid.fit(clashing, F.lit(True))
    assert rowset(langid.identify(plain, model)) == rowset(langid.identify(clashing, model))
    assert sorted(r.length for r in packing.pack(plain, TOKENIZER).collect()) == sorted(r.length for r in packing.pack(clashing, TOKENIZER).collect())
    turns = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "assistant", "b")], "conv_id long, turn long, role string, text string")
    more = turns.select("*", *[F.lit("clash").alias(c) for c in ("turns", "parts", "at", "head", "t", "r", "x")])
    assert rowset(chat.digests(chat.examples(turns))) == rowset(chat.digests(chat.examples(more)))


def test_texts_of_megabytes(spark):
    """Three megabytes in one row: nothing is cut."""
    words = [f"word{i % 5000}x{i}" for i in range(200_000)]
    long = " ".join(words)
    docs = spark.createDataFrame([(1, long), (2, " ".join([*words[:195_000], "end"])), (3, "a short one")], "doc_id long, text string")
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(docs).collect()} == {1: (199_997, 1), 2: (194_998, 1), 3: (1, 3)}
    assert {r.doc_id: (r.n_words, r.n_removed) for r in substring.duplicate_words(docs).collect()} == {1: (200_000, 0), 2: (195_001, 195_000), 3: (3, 0)}
    scored = {r.doc_id: r for r in lmscore.score(docs, docs.where("doc_id = 1").select("doc_id")).collect()}
    assert scored[1].n_words == 200_000 and all(math.isfinite(r.score) for r in scored.values())
    assert quality.scores(docs, quality.fit(docs, spark.createDataFrame([(1, 1), (3, 0)], "doc_id long, quality int"))).count() == 3
    covered, sizes = Counter(), {}
    for r in packing.pack(docs, TOKENIZER).collect():
        covered[r.doc_id] += r.length
        sizes[r.doc_id] = r.doc_tokens
    assert covered == sizes and sizes[1] > 400_000
    turns = spark.createDataFrame([(1, 0, "user", long), (1, 1, "assistant", long + "\\</s>")], "conv_id long, turn long, role string, text string")
    got = chat.digests(chat.examples(turns)).first()
    assert got.loss_sha256 == hashlib.sha256((long + "\\</s>").encode()).hexdigest() and got.loss_chars == len(long) + 5
