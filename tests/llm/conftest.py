import sys
from pathlib import Path

import pytest

sys.path[:0] = [str(Path(__file__).resolve().parents[2]), str(Path(__file__).resolve().parent)]

from corpus_cases import SCHEMA, WORD  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("cp")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def sample():
    """Documents of the test data, with copies, near copies, shared passages; also nulls, empty and odd texts, repeated rows."""
    import random

    import pyarrow.parquet as pq

    rows = pq.read_table("/root/testdata/sf0.001/documents.parquet").slice(0, 120).to_pylist()
    texts = [(r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"]) for r in rows]
    rng, n = random.Random(5), 1000
    base = max((r["text"] for r in rows), key=lambda t: len(WORD.findall(t)) if len(t) < 6000 else 0)
    for k in range(25):  # near copies of one text, and exact ones
        words = WORD.findall(base)[:150]
        for _ in range(k % 6):
            words[rng.randrange(len(words))] = f"edit{k}{rng.random():.4f}"
        texts.append((n + k, " ".join(words), "en", "hot", 1))
    passage = " ".join(f"shared{i}" for i in range(55))
    for k in range(6):
        texts.append((n + 100 + k, f"{rows[k]['text'][:300]}\n{passage}\n{rows[k + 9]['text'][:200]}", "en", "hot", 1))
    odd = [None, "", "   \n\t ", "one", "one two three", "Ünïcode 中文字 \U0001f600 words", "a " * 400, "x" * 70_000, " nbsp stays inside", "one two three"]
    texts += [(n + 200 + k, t, None, None, None) for k, t in enumerate(odd)]
    texts += [(None, rows[0]["text"], "fr", None, 5), (None, None, None, None, None), (0, rows[0]["text"], "fr", "src0", 9)]
    return texts


@pytest.fixture(scope="session")
def docs(spark, sample):
    return spark.createDataFrame(sample, SCHEMA).repartition(5).selectExpr("*", "'clash' AS block")


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
