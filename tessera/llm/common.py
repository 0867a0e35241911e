"""What the operators of this subpackage share: tables, checkpoints, word rules."""

from __future__ import annotations

import gc
import os
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The characters that separate words (fixed values of the word rule).
SPACE_CHARS = " \t\n\x0b\x0c\r"
#: The word rule ``[^\x20\x09-\x0D]+`` in Java's, RE2's and Python's syntax alike.
WORD = r"[^\x20\x09-\x0D]+"

BATCH_SETTING, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "4m"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where it is unset, one of our own on a single machine and an error on a cluster."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise ValueError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
        base = os.path.join(tempfile.gettempdir(), "checkpoints")
    return base.rstrip("/")


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """While it lasts, batches of BATCH_BYTES go to Python workers: whole texts make large batches of few rows, which both sides of the pipe hold."""
    before = spark.conf.get(BATCH_SETTING, None)
    spark.conf.set(BATCH_SETTING, BATCH_BYTES)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(BATCH_SETTING)
        else:
            spark.conf.set(BATCH_SETTING, before)


def checkpoint(df: DataFrame, most_parts: int | None = None) -> DataFrame:
    """Cut the lineage through a reliable checkpoint in the shared folder, of so many files at most."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(df.sparkSession))
    with small_batches(df.sparkSession):
        return (df.coalesce(most_parts) if most_parts else df).checkpoint(eager=True)


def scratch(spark: SparkSession, label: str) -> str:
    """A new path below this application's part of the shared folder; ``release`` removes them all."""
    return f"{shared_dir(spark)}/scratch-{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"


def release(spark: SparkSession) -> None:
    """Remove what this application has left in the shared folder. DataFrames of operators that were not written yet lose their input."""
    context = spark.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/scratch-{context.applicationId}")
    path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def drop_shuffles(spark: SparkSession) -> None:
    """Let the driver's JVM find the DataFrames that nothing refers to any more: Spark removes their shuffle files, which otherwise stay until a collection happens by itself."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def n_words(text: Column) -> Column:
    """How many words a text has; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def blocks_for(rows: int, per_block: int) -> int:
    """Into how many blocks to hash so many rows for about per_block rows in each."""
    return max(1, -(-rows // per_block))
