"""Documents as streams. Expressions and rules look at one document at a time, so they run on streams as they are; counts by window need a watermark."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery


def read(spark: SparkSession, path: str, schema: T.StructType | str, form: str = "parquet", files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.format(form).schema(schema)
    return (reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader).load(path)


def windowed(df: DataFrame, time: str, size: str, late: str, *by: str) -> DataFrame:
    """Counts by tumbling window; rows later than `late` are dropped by the watermark, so state stays bounded."""
    own = df.withWatermark(time, late)
    return own.groupBy(F.window(time, size), *by).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), *by, "n")


def each_batch(df: DataFrame, work: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True) -> StreamingQuery:
    """work(frame, number) for each batch, such as validation and writing of its issues; restarts from the checkpoint."""
    writer = df.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
