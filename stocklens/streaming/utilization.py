"""Used space per location over a feed of lot changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stocklens.streaming.feeds import compact, per_batch, run_available, written

_SIDE = T.StructType(
    [
        T.StructField("product_id", T.IntegerType()),
        T.StructField("warehouse_id", T.IntegerType()),
        T.StructField("storage_location", T.StringType()),
        T.StructField("total_quantity", T.IntegerType()),
    ]
)

#: A lot before and after a change: no ``before`` for a new lot, no ``after`` for a removed one.
LOT_CHANGES = T.StructType(
    [
        T.StructField("inventory_id", T.LongType()),
        T.StructField("before", _SIDE),
        T.StructField("after", _SIDE),
    ]
)


_TOTALS = T.StructType(
    [
        T.StructField("warehouse_id", T.IntegerType()),
        T.StructField("location", T.StringType()),
        T.StructField("space", T.DecimalType(28, 4)),
    ]
)


def lot_side(present: Column | None = None) -> Column:
    """The lot columns of a row as one side of a change."""
    side = F.struct(*[f.name for f in _SIDE])
    return side if present is None else F.when(present, side)


def space_changes(changes: DataFrame, products: DataFrame) -> DataFrame:
    """Signed volume per location: what left the old places and what came to the new ones.

    Units are summed per (location, product) before the join, so however often one product moves,
    it is one record per location there.
    """
    sides = F.array(
        F.struct(F.col("before").alias("lot"), F.lit(-1).alias("sign")),
        F.struct(F.col("after").alias("lot"), F.lit(1).alias("sign")),
    )
    moves = changes.select(F.explode(sides).alias("side")).filter(
        F.col("side.lot.storage_location").isNotNull()
    )
    units = (
        moves.select("side.lot.*", "side.sign")
        .groupBy("warehouse_id", F.col("storage_location").alias("location"), "product_id")
        .agg(F.sum(F.col("sign") * F.col("total_quantity")).alias("units"))
    )
    return (
        units.filter("units <> 0")
        .join(products.select("product_id", "volume"), "product_id")
        .groupBy("warehouse_id", "location")
        .agg(F.sum(F.col("volume") * F.col("units")).cast("decimal(28,4)").alias("space"))
    )


def stream_location_utilization(
    spark: SparkSession,
    products: DataFrame,
    changes: str,
    totals: str,
    state: str,
    files_per_batch: int = 1000,
) -> None:
    """Follow the change files in ``changes``; each batch adds one record per touched location."""
    feed = (
        spark.readStream.schema(LOT_CHANGES)
        .option("maxFilesPerTrigger", files_per_batch)
        .parquet(changes)
    )
    run_available(feed, per_batch(lambda b: space_changes(b, products), totals), state, "append")


def current_utilization(spark: SparkSession, locations: DataFrame, totals: str) -> DataFrame:
    """Used space of every location after all batches, 0 where no lot ever was."""
    used = written(spark, totals, _TOTALS).groupBy("warehouse_id", "location")
    used = used.agg(F.sum("space").alias("utilization"))
    return (
        locations.select("warehouse_id", "location")
        .join(used, ["warehouse_id", "location"], "left")
        .withColumn(
            "utilization", F.coalesce("utilization", F.lit(0)).cast("decimal(28,4)")
        )
    )


def compact_utilization(spark: SparkSession, totals: str) -> None:
    """Fold the batches so far into one record per location."""

    def fold(rows: DataFrame) -> DataFrame:
        summed = rows.groupBy("warehouse_id", "location").agg(F.sum("space").alias("space"))
        return summed.withColumn("space", F.col("space").cast("decimal(28,4)"))

    compact(spark, totals, _TOTALS, fold)
