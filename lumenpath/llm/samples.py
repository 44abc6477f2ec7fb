"""Bounded labelled samples that classifiers are fitted on.

A sample is the rows whose hashed ids are smallest, so it is the same at each run and its size never exceeds the bound.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def crc_mod(id_col: str, n: int) -> Column:
    """crc32 of the id as text, modulo n; null for a null id."""
    return F.crc32(F.col(id_col).cast("string")) % n


def smallest(df: DataFrame, by: str, rows: int) -> DataFrame:
    """At most `rows` rows of df, those with the smallest hash of `by`; only narrow rows should be passed.

    Of rows with one value of `by` a single one counts, that with the smallest other columns; rows with a null there don't.
    """
    rest = [c for c in df.columns if c != by]
    one = df.where(F.col(by).isNotNull()).groupBy(by).agg(F.min(F.struct(*rest)).alias("_rest")).select(by, "_rest.*") if rest else df.where(F.col(by).isNotNull()).distinct()
    return one.orderBy(F.xxhash64(by), by).limit(rows)


def labelled_texts(docs: DataFrame, labels: DataFrame, rows: int) -> DataFrame:
    """(label columns, text) of at most `rows` documents with a row in labels (doc_id, ...).

    The sample is broadcast, which its bound allows; the documents' texts stay where they are. Of documents with one id a single one counts, that whose
    text has the smallest hash, so the bound holds whatever ids repeat.
    """
    few = F.broadcast(smallest(labels, "doc_id", rows).withColumnRenamed("doc_id", "_of"))
    own = docs.select(F.col("doc_id").cast("long").alias("_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    names = [c for c in labels.columns if c != "doc_id"]
    found = own.join(few, own["_id"] == few["_of"]).groupBy("_id").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"), *[F.min(c).alias(c) for c in names])
    return found.select(*names, "text")
