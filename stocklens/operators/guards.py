"""Guards on new rows: space at the location, and staff working at their own site."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stocklens.functions.scale import in_ranges
from stocklens.operators.admission import VOLUME_UNIT, admit

Tables = Mapping[str, DataFrame]

# The texts of rejected rows.
NO_SPACE = "Error: Location capacity is not enough, insertion rejected"
WRONG_SITE = "Error: Operator does not belong to this warehouse"


def space_units(volume: Column) -> Column:
    """Space as a whole number of ten-thousandths; no volume takes no space."""
    return F.coalesce((volume * VOLUME_UNIT).cast("bigint"), F.lit(0).cast("bigint"))


#: Column of the space that one piece of a product takes, where it is a whole number of units.
UNIT_SPACE = "_unit_space"


def unit_space(products: DataFrame) -> list[Column]:
    """``UNIT_SPACE``, if volumes have no more decimals than units; else nothing."""
    kind = products.schema["volume"].dataType
    whole = isinstance(kind, T.DecimalType) and 10**kind.scale <= VOLUME_UNIT
    return [(F.col("volume") * VOLUME_UNIT).cast("bigint").alias(UNIT_SPACE)] if whole else []


def space_of(columns: Sequence[str], quantity: str) -> Column:
    """Space of so many pieces, by the products' ``UNIT_SPACE`` if it is among the columns."""
    if UNIT_SPACE in columns:
        return F.coalesce(F.col(UNIT_SPACE) * F.col(quantity), F.lit(0).cast("bigint"))
    return space_units(F.col("volume") * F.col(quantity))


def place_of(warehouse: str, location: str) -> Column:
    return F.concat(F.lit("place/"), F.col(warehouse), F.lit("/"), F.col(location))


def free_space(tables: Tables) -> DataFrame:
    """Room per location in space units; NULL where capacity or utilization is unknown."""
    room = ((F.col("capacity") - F.col("utilization")) * VOLUME_UNIT).cast("bigint")
    return tables["locations"].select("warehouse_id", "location", room.alias("free_space"))


def capacity_guard(tables: Tables, new_lots: DataFrame, order: str = "inventory_id") -> DataFrame:
    """``new_lots`` with ``rejection``: lots that no longer fit when put away in ``order``.

    Lots at an unknown location, without a location or without a volume pass.
    """
    lots = new_lots.withColumn("request_id", F.col(order).cast("bigint"))
    sized = (
        lots.join(tables["products"].select("product_id", "volume"), "product_id", "left")
        .join(
            free_space(tables).withColumnRenamed("location", "storage_location"),
            ["warehouse_id", "storage_location"],
            "left",
        )
        .withColumn("_space", space_units(F.col("volume") * F.col("total_quantity")))
    )
    ranged = in_ranges(sized, "request_id")
    known = F.col("volume").isNotNull() & F.col("total_quantity").isNotNull()
    demands = ranged.filter(F.col("storage_location").isNotNull()).select(
        "request_id",
        place_of("warehouse_id", "storage_location").alias("resource"),
        F.col("_space").alias("amount"),
        F.when(known, F.col("free_space")).alias("room"),
        "_range",
    )
    verdicts = admit(demands, single=True)
    return (
        ranged.join(verdicts, "request_id", "left")
        .withColumn("rejection", F.when(~F.col("accepted"), F.lit(NO_SPACE)))
        .select(*new_lots.columns, "rejection")
    )


def _sites(tables: Tables, person: str, site: str) -> DataFrame:
    return tables["employees"].select(F.col("employee_id").alias(person), F.col("warehouse_id").alias(site))


def inbound_operator_guard(tables: Tables, orders: DataFrame) -> DataFrame:
    """``orders`` with ``rejection`` where the operator is assigned to another site."""
    elsewhere = F.coalesce(F.col("_site") != F.col("warehouse_id"), F.lit(False))
    return (
        orders.join(_sites(tables, "operator", "_site"), "operator", "left")
        .withColumn("rejection", F.when(elsewhere, F.lit(WRONG_SITE)))
        .select(*orders.columns, "rejection")
    )


def outbound_operator_guard(tables: Tables, orders: DataFrame) -> DataFrame:
    """``orders`` with ``rejection`` where picker or packer is assigned to another site."""
    here = F.col("warehouse_id")
    # three-valued OR: one certain mismatch rejects, an unknown site alone does not
    elsewhere = (F.col("_picks_at") != here) | (F.col("_packs_at") != here)
    return (
        orders.join(_sites(tables, "picker", "_picks_at"), "picker", "left")
        .join(_sites(tables, "packer", "_packs_at"), "packer", "left")
        .withColumn("rejection", F.when(F.coalesce(elsewhere, F.lit(False)), F.lit(WRONG_SITE)))
        .select(*orders.columns, "rejection")
    )
