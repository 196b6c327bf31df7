"""Sinks that keep one small write per micro-batch and give the latest row per key on reading.

Each micro-batch writes its own ``batch=<n>`` directory in overwrite mode, so a batch that is run
again after a failure replaces itself.  :func:`compact` folds all batches so far into one base, which is
announced when it is complete; readers take the last base and the batches after it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stocklens.session import exists

#: About how many changes a task sorts by key.
ROWS_PER_PART = 250_000


def per_batch(transform: Callable[[DataFrame], DataFrame], folder: str) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that writes ``transform(batch)``."""

    def write(batch: DataFrame, number: int) -> None:
        transform(batch).write.mode("overwrite").parquet(f"{folder}/batches/batch={number}")

    return write


def run_available(stream: DataFrame, write: Callable[[DataFrame, int], None], state: str, mode: str) -> None:
    """Process everything that has arrived so far, then stop."""
    query = (
        stream.writeStream.outputMode(mode)
        .option("checkpointLocation", state)
        .foreachBatch(write)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def written(spark: SparkSession, folder: str, schema: T.StructType) -> DataFrame:
    """Rows of the last base and of the batches after it; none where nothing was written."""
    upto = _folded_upto(spark, folder)
    rows = spark.createDataFrame([], schema)
    if exists(spark, f"{folder}/batches"):
        with_batch = T.StructType([*schema.fields, T.StructField("batch", T.LongType())])
        batches = spark.read.schema(with_batch).parquet(f"{folder}/batches")
        rows = batches.filter(F.col("batch") > upto).drop("batch")  # by directory: older ones are not read
    if upto >= 0:
        rows = rows.unionByName(spark.read.schema(schema).parquet(f"{folder}/bases/{upto}"))
    return rows


def compact(
    spark: SparkSession, folder: str, schema: T.StructType, fold: Callable[[DataFrame], DataFrame]
) -> None:
    """Fold the last base and all later batches into a new base."""
    if not exists(spark, f"{folder}/batches"):
        return
    with_batch = T.StructType([*schema.fields, T.StructField("batch", T.LongType())])
    last = spark.read.schema(with_batch).parquet(f"{folder}/batches").agg(F.max("batch")).first()[0]
    if last is None or last <= _folded_upto(spark, folder):
        return
    fold(written(spark, folder, schema)).write.mode("overwrite").parquet(f"{folder}/bases/{last}")
    spark.range(1).select(F.lit(last).alias("upto")).write.mode("append").parquet(f"{folder}/folded")


def by_key(rows: DataFrame, key: str) -> DataFrame:
    """``rows`` dealt out by ``key`` in as many parts as they need, so a part grows in number, not in size.

    For latest rows per key, which are sorted in a task's memory; the rows are counted, so they should be stored.
    """
    parts = -(-rows.count() // ROWS_PER_PART)
    return rows.repartition(parts, key) if parts > 1 else rows


def _folded_upto(spark: SparkSession, folder: str) -> int:
    if not exists(spark, f"{folder}/folded"):
        return -1
    last = spark.read.schema("upto bigint").parquet(f"{folder}/folded").agg(F.max("upto")).first()[0]
    return -1 if last is None else last
