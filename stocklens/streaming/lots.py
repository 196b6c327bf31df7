"""The latest state of every lot over a feed of lot changes, and the space they use.

A change is a lot as it is after it, with a ``change_seq`` that rises per lot; a removed lot is a change without
a lot.  Folding takes the latest change of each lot, so it does not matter whether changes are delivered twice,
late or in any order, or a batch is run again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stocklens.functions.metrics import used_volume
from stocklens.streaming.feeds import by_key, compact, per_batch, run_available, written
from stocklens.streaming.utilization import lot_side

#: ``lot`` is missing where the lot was removed.
LOT_STATES = T.StructType(
    [
        T.StructField("inventory_id", T.LongType()),
        T.StructField("change_seq", T.LongType()),
        T.StructField(
            "lot",
            T.StructType(
                [
                    T.StructField("product_id", T.IntegerType()),
                    T.StructField("warehouse_id", T.IntegerType()),
                    T.StructField("storage_location", T.StringType()),
                    T.StructField("total_quantity", T.IntegerType()),
                ]
            ),
        ),
    ]
)


def lot_states(lots: DataFrame, seq: int) -> DataFrame:
    """Rows of lots as changes with the same ``change_seq``."""
    return lots.select("inventory_id", F.lit(seq).cast("bigint").alias("change_seq"), lot_side().alias("lot"))


def removed_lots(lots: DataFrame, seq: int) -> DataFrame:
    return lots.select(
        "inventory_id",
        F.lit(seq).cast("bigint").alias("change_seq"),
        F.lit(None).cast(LOT_STATES["lot"].dataType).alias("lot"),
    )


def latest_states(changes: DataFrame) -> DataFrame:
    """One row per lot: its latest change."""
    return by_key(changes, "inventory_id").groupBy("inventory_id").agg(
        F.max("change_seq").alias("change_seq"), F.max_by("lot", "change_seq").alias("lot")
    )


def stream_lot_states(spark: SparkSession, changes: str, lots: str, state: str, files_per_batch: int = 1000) -> None:
    """Follow the change files in ``changes``; each batch adds the latest change of every lot it names."""
    feed = spark.readStream.schema(LOT_STATES).option("maxFilesPerTrigger", files_per_batch).parquet(changes)
    run_available(feed, per_batch(latest_states, lots), state, "append")


def current_lots(spark: SparkSession, lots: str) -> DataFrame:
    """The lots there are, after all changes followed so far."""
    found = latest_states(written(spark, lots, LOT_STATES))
    return found.filter("lot is not null").select("inventory_id", "lot.*")


def space_of_lots(spark: SparkSession, locations: DataFrame, products: DataFrame, lots: str) -> DataFrame:
    """Used space of every location after all changes, 0 where no lot is."""
    used = used_volume(current_lots(spark, lots), products)
    joined = locations.select("warehouse_id", "location").join(used, ["warehouse_id", "location"], "left")
    return joined.select(
        "warehouse_id", "location", F.coalesce("used", F.lit(0)).cast("decimal(28,4)").alias("utilization")
    )


def compact_lots(spark: SparkSession, lots: str) -> None:
    """Fold the batches so far into one row per lot; a removed lot keeps its row, as changes may be late."""
    compact(spark, lots, LOT_STATES, latest_states)
