"""What the operators share on the Spark side: shipping this package, checkpoints, row counts."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from lumenpath.shipping import ship

__all__ = ["checkpointed", "fresh", "read", "release", "shared_folder", "ship", "stored"]


def shared_folder(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir. Only where that is unset and all runs in one process, as in tests, a temporary folder is set."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        folder = context.getConf().get("spark.checkpoint.dir")
        if not folder and not context.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="lumenpath-cp"))
    return context.getCheckpointDir()


def release(spark: SparkSession) -> None:
    """Lets Spark's cleaner remove shuffle files that nothing refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def checkpointed(df: DataFrame) -> DataFrame:
    """df, written once to the shared checkpoint folder; its lineage ends there."""
    spark = df.sparkSession
    shared_folder(spark)
    out = df.checkpoint()
    del df
    release(spark)
    return out


def stored(df: DataFrame, name: str) -> DataFrame:
    """df, written once as Parquet in the shared folder and read again."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    del df
    release(spark)
    return spark.read.parquet(path)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names that no column of df has, made from those given."""
    have, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in have:
            name = f"_{name}"
        have.add(name.lower())
        out.append(name)
    return out


