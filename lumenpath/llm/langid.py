"""Language identification with a subword classifier and calibrated rejection.

The classifier learns from a bounded sample of labelled rows and then scores every text whole. `accepted` is false where the calibrated
probability is below the threshold at which held-back pieces reach the wished precision.

Null text, or a text without a letter: 'und', score 0, not accepted. Further columns are ignored. Repeated rows are scored each; the sample has one
of each doc_id. A very long text is counted and scored whole, about a megabyte at a time. Ties of labels go to the first in order.
No labelled rows: every text is 'und'. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenpath.llm.samples import labelled_texts
from lumenpath.llm.sparkutil import ship
from lumenpath.llm.subwords import Classifier, learned

UNKNOWN = "und"
#: The bound of the sample.
TRAIN_ROWS = 4_000


def fit(docs: DataFrame, learn: Column, label: str = "lang", rows: int = TRAIN_ROWS) -> Classifier | None:
    """A classifier of `label`, learned from at most `rows` rows of docs for which `learn` holds."""
    own = docs.where(learn & F.col(label).isNotNull() & F.col("text").isNotNull()).select("doc_id", F.col("text").cast("string").alias("text"), F.col(label).cast("string").alias("y"))
    ship(docs.sparkSession)
    return learned(labelled_texts(own, own.select("doc_id", "y"), rows))


def _predict(model):
    def run(batches):
        m: Classifier = model.value
        for batch in batches:
            letters = np.array(batch.column("letters").to_pylist(), bool)
            n = batch.num_rows
            if m is None:
                name, score = np.full(n, UNKNOWN, object), np.zeros(n)
                good = np.zeros(n, bool)
            else:
                p = m.posteriors(batch.column("text"))
                best = p.argmax(1)
                score = np.where(letters, np.clip(p[np.arange(n), best], 0, 1), 0.0)
                name = np.where(letters, np.array(m.labels, object)[best], UNKNOWN)
                good = letters & (score >= m.threshold)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(name.tolist(), pa.string()), pa.array(score, pa.float64()), pa.array(good)], ["doc_id", "lang_pred", "score", "accepted"])

    return run


def identify(docs: DataFrame, model: Classifier | None) -> DataFrame:
    """Per document: doc_id, lang_pred, score, accepted."""
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letters"))
    return own.mapInArrow(_predict(shared), "doc_id long, lang_pred string, score double, accepted boolean")
