import math
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
import public_tokenizers
from corpus_cases import WORD
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lumenpath.llm import mixing, quality
from lumenpath.llm.queries import MIXTURE, domains


def test_stages(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs.count()
        docs = corpus_pipeline.stored(stage(spark, docs, d), name)
        assert docs.columns == columns and docs.count()
        if name in ("quality", "near_duplicates"):
            assert docs.count() < before
        if name == "mixing":
            assert docs.count() >= before
        else:
            assert docs.count() == docs.select("doc_id").distinct().count()
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, d)
    assert packed.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()
    assert {r.n for r in packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).collect()} <= {2**k for k in range(12)}


def test_empty(spark, tmp_path):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, d)
        assert docs.count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, d).count() == 0


def plain_near(rows):
    """One row of each group of equal or linked five-word shingle sets (0.8), that of the smallest id; rows without words stay."""
    lower = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    words = [tuple(WORD.findall(lower(r.text))) for r in rows]
    sets = [{w[i : i + 5] for i in range(len(w) - 4)} or ({w} if w else set()) for w in words]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                root[find(i)] = find(j)
    groups = defaultdict(list)
    for i in range(len(rows)):
        groups[find(i)].append(i)
    keep = {min(own, key=lambda i: (rows[i].doc_id is None, rows[i].doc_id or 0)) if sets[own[0]] else i for own in groups.values() for i in own}
    return [rows[i] for i in sorted(keep)]


def plain_stripped(rows):
    """{doc_id: words that stay} without 13-word windows that a smaller id has."""
    first, every = {}, [(math.inf if r.doc_id is None else r.doc_id, WORD.findall(r.text or "")) for r in rows]
    for d, w in every:
        for k in range(len(w) - 12):
            key = tuple(w[k : k + 13])
            first[key] = min(first.get(key, math.inf), d)
    out = {}
    for d, w in every:
        gone = {k + j for k in range(len(w) - 12) if first[tuple(w[k : k + 13])] < d for j in range(13)}
        out[d] = [x for k, x in enumerate(w) if k not in gone]
    return out


def test_run_equals_plain_stages(spark, sample, tmp_path):
    """run() over a small table, stage by stage, with the fitted scores and rates as given."""
    from corpus_cases import SCHEMA

    rows = [r for r in sample if r[0] is not None and r[0] != 0][60:] + [(2000, "\n\t", None, None, 2), (2001, "\n\t", None, None, 2)]
    spark.createDataFrame(rows, SCHEMA).coalesce(3).write.parquet(f"{tmp_path}/documents.parquet")
    marks = [(r[0], int(len(r[1] or "") % 5 != 0), 0) for r in rows if r[0] % 2]
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs, labels = spark.read.parquet(f"{tmp_path}/documents.parquet"), spark.read.parquet(f"{tmp_path}/labels.parquet")
    made, now = {}, docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = made[name] = spark.createDataFrame(stage(spark, now, str(tmp_path)).collect(), now.schema)
    learn = labels.where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0)
    forest = quality.fit(docs, learn)
    good = {r.doc_id for r in quality.scores(docs, forest).where("score >= 0.3").collect()}
    assert 0 < len(good) < len(rows) and {r.doc_id for r in made["quality"].collect()} == good
    kept = made["quality"].collect()
    assert sorted(r.doc_id for r in plain_near(kept)) == sorted(r.doc_id for r in made["near_duplicates"].collect())
    unique = made["near_duplicates"].collect()
    want = plain_stripped(unique)
    stripped = made["repeated_passages"].collect()
    assert {r.doc_id: WORD.findall(r.text or "") for r in stripped} == want and len(stripped) == len(unique)
    assert any(len(want[r.doc_id]) < len(WORD.findall(r.text or "")) for r in unique)
    rated = mixing.fit_rates(made["repeated_passages"], domains(made["repeated_passages"], labels), MIXTURE, budget=None, least=1.0).collect()
    copies = Counter(r.doc_id for r in made["mixing"].collect())
    assert all(math.floor(r.rate) <= copies[r.doc_id] <= math.ceil(r.rate) and copies[r.doc_id] >= 1 for r in rated)
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    tokens = {r.doc_id: len(tokenizer.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in stripped}
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert all(p.doc_tokens == tokens[p.doc_id] for p in pieces)
    covered = defaultdict(int)
    for p in pieces:
        covered[p.doc_id] += p.length
    assert covered == {d: n * tokens[d] for d, n in copies.items()}
    full = Counter()
    for p in pieces:
        full[p.sequence_id] += p.length
    assert np.mean([n == 2048 for n in full.values()]) > 0.5
