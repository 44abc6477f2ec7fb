import math
import random

import pytest
from pyspark.sql import functions as F

from lumenpath.llm import topk
from lumenpath.llm.topk import top_k


def brute(rows, k=20):
    use = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, v in use:
        if i % 20 == 0:
            found = sorted((-sum(a * b for a, b in zip(v, w)), j) for j, w in use if j != i)[:k]  # noqa: B905
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(found)]
    return sorted(out)


def test_equals_brute_force(spark, monkeypatch):
    rng = random.Random(2)
    rows = [(i, [rng.gauss(0, 0.3) for _ in range(16)]) for i in range(300)]
    rows += [(i, rows[4][1]) for i in range(300, 380)]  # many equal vectors: ties by vec_id
    rows += [(400, None), (420, [None] * 16), (440, [float("nan")] * 16), (460, [float("inf")] + [0.0] * 15), (480, [1.0, -1.0]), (500, []), (None, [1.0] * 16)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("part", F.lit("clash"))
    exact = [(r.vec_id, r.embedding) for r in df.collect()]
    for shard, part in ((16_384, 2048), (64, 16)):
        monkeypatch.setattr(topk, "SHARD", shard)
        monkeypatch.setattr(topk, "PART", part)
        monkeypatch.setattr(topk, "QUERIES", 8)
        got = sorted(tuple(r) for r in top_k(df, F.col("vec_id") % 20 == 0).select("query_id", "rank", "vec_id", "score").collect())
        assert got == brute(exact)


def test_few_and_none(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (1, [0.5, 0.5])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in top_k(df, F.col("vec_id") % 20 == 0).collect()] == [(0, 1, 1, 64 * 32 + 128 * 32)]
    assert top_k(df.where("vec_id > 5"), F.col("vec_id") % 20 == 0).collect() == []


def test_scores_over_64_bits_raise(spark):
    big = [(0, [2.0**33, 0.0]), (1, [2.0**33, 1.0]), (2, [1.0, 1.0])]
    with pytest.raises(Exception, match="64 bits"):
        top_k(spark.createDataFrame(big, "vec_id long, embedding array<float>"), F.col("vec_id") % 20 == 0).collect()
    large = [(i, [float(2**18 + i), -float(2**17)]) for i in range(50)]  # over 2**53, below 2**63
    got = sorted(tuple(r) for r in top_k(spark.createDataFrame(large, "vec_id long, embedding array<float>"), F.col("vec_id") % 20 == 0).collect())
    assert got == brute(large)


def test_nulls_repeats_and_clashing_columns(spark):
    rows = [(0, [1.0]), (0, [2.0]), (None, [3.0]), (5, None), (7, [4.0]), (7, [4.0]), (20, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 as v", "2 as asks", "3 as `group`", "'x' as score")
    got = sorted(tuple(r) for r in top_k(df, F.col("vec_id") % 20 == 0, k=2).collect())
    assert [r for r in got if r[0] == 20] == [(20, 1, 0, 0), (20, 2, 0, 0)]
    assert all(r[2] != 0 for r in got if r[0] == 0) and all(r[3] in (0, 64 * 256, 128 * 256) for r in got)
