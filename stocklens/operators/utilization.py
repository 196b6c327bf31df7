"""Stored space use of locations: full recalculation and refresh of touched locations."""

from __future__ import annotations

from collections import ChainMap
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stocklens.functions.metrics import used_volume

Tables = Mapping[str, DataFrame]

_KEY = ["warehouse_id", "location"]


def _typed(locations: DataFrame, value: Column) -> Column:
    return value.cast(locations.schema["utilization"].dataType)


def recalculate_utilization(tables: Tables) -> DataFrame:
    """All locations with their utilization computed from the lots in one grouped pass."""
    locations = tables["locations"]
    used = used_volume(tables["inventory"], tables["products"])
    return (
        locations.join(used, _KEY, "left")
        .withColumn("utilization", _typed(locations, F.coalesce("used", F.lit(0))))
        .select(*locations.columns)
    )


def with_utilization(tables: Tables) -> Tables:
    """The same tables with freshly computed ``locations.utilization``."""
    return ChainMap({"locations": recalculate_utilization(tables)}, tables)


def touched_locations(*lots: DataFrame) -> DataFrame:
    """Distinct (warehouse_id, location) of the given lot rows."""
    keys = None
    for df in lots:
        part = df.select("warehouse_id", F.col("storage_location").alias("location"))
        keys = part if keys is None else keys.unionByName(part)
    return keys.filter(F.col("location").isNotNull()).distinct()


def refresh_utilization(tables: Tables, touched: DataFrame) -> DataFrame:
    """``locations`` with only the ``touched`` keys recomputed from the current lots."""
    locations = tables["locations"]
    used = used_volume(_lots_in(tables["inventory"], touched), tables["products"])
    fresh = F.when(F.col("_touched"), F.coalesce("used", F.lit(0))).otherwise(F.col("utilization"))
    return (
        locations.join(touched.withColumn("_touched", F.lit(True)), _KEY, "left")
        .join(used, _KEY, "left")
        .withColumn("utilization", _typed(locations, fresh))
        .select(*locations.columns)
    )


def _lots_in(inventory: DataFrame, touched: DataFrame) -> DataFrame:
    keys = touched.select("warehouse_id", F.col("location").alias("storage_location"))
    return inventory.join(keys, ["warehouse_id", "storage_location"], "left_semi")


def utilization_on_insert(tables: Tables, new_lots: DataFrame) -> DataFrame:
    """Locations after ``new_lots`` were added; ``tables['inventory']`` already holds them."""
    return refresh_utilization(tables, touched_locations(new_lots))


def utilization_on_update(tables: Tables, before: DataFrame, after: DataFrame) -> DataFrame:
    """Locations after lots changed; both the old and the new place of a moved lot are refreshed."""
    return refresh_utilization(tables, touched_locations(before, after))


def utilization_on_delete(tables: Tables, removed: DataFrame) -> DataFrame:
    """Locations after lots were removed."""
    return refresh_utilization(tables, touched_locations(removed))
