"""Grouped metrics: used space, sell-through and assignment checks for all keys at once."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stocklens.functions.columns import percent_half_up

Tables = Mapping[str, DataFrame]


def used_volume(inventory: DataFrame, products: DataFrame) -> DataFrame:
    """Space taken per (warehouse_id, location): sum of product volume times lot quantity.

    Lots are first summed per (warehouse, location, product), so the join with products moves one
    record per product of a location however many lots it has.
    """
    units = (
        inventory.filter(F.col("storage_location").isNotNull())
        .groupBy("warehouse_id", F.col("storage_location").alias("location"), "product_id")
        .agg(F.sum("total_quantity").alias("units"))
    )
    return (
        units.join(products.select("product_id", "volume"), "product_id")
        .groupBy("warehouse_id", "location")
        .agg(F.sum(F.col("volume") * F.col("units")).alias("used"))
    )


def location_utilization(tables: Tables) -> DataFrame:
    """Used volume of every location, 0 where nothing is stored."""
    used = used_volume(tables["inventory"], tables["products"])
    return (
        tables["locations"]
        .select("warehouse_id", "location")
        .join(used, ["warehouse_id", "location"], "left")
        .select(
            "warehouse_id",
            "location",
            F.coalesce("used", F.lit(0)).cast("decimal(22,4)").alias("utilization"),
        )
    )


def employee_in_warehouse(employees: DataFrame, pairs: DataFrame) -> DataFrame:
    """For each (employee_id, warehouse_id) pair: is that person active and assigned there?"""
    active = employees.filter(F.col("employment_status") == "active").select(
        "employee_id", "warehouse_id", F.lit(True).alias("_found")
    )
    return pairs.join(active, ["employee_id", "warehouse_id"], "left").withColumn(
        "is_in_warehouse", F.coalesce("_found", F.lit(False))
    ).drop("_found")


def _quantities(tables: Tables) -> tuple[DataFrame, DataFrame]:
    received = (
        tables["inbound_orders"]
        .filter(F.col("status") == "completed")
        .groupBy("product_id")
        .agg(F.sum("actual_quantity").alias("received"))
    )
    sold = (
        tables["outbound_orders"]
        .filter((F.col("status") == "shipped") & (F.col("outbound_type") == "sales"))
        .groupBy("product_id")
        .agg(F.sum("total_quantity").alias("sold"))
    )
    return received, sold


def sell_through_rate(tables: Tables, product_ids: DataFrame | None = None) -> DataFrame:
    """Shipped sales over completed receipts, as a percentage and as a sentence.

    ``product_ids`` (column ``product_id``) limits or extends the products; ids without any order
    get rate 0.  By default every product is reported.
    """
    source = tables["products"] if product_ids is None else product_ids
    wanted = source.select("product_id")
    received, sold = _quantities(tables)
    inbound = F.coalesce("received", F.lit(0))
    sales = F.coalesce("sold", F.lit(0))
    rate = F.when(inbound == 0, F.lit(0.0)).otherwise(percent_half_up(sales, inbound))
    shown_in = inbound.cast("decimal(22,4)").cast("string")
    shown_out = sales.cast("decimal(22,4)").cast("string")
    # fixed values: the two sentences
    none = F.concat(
        F.lit("Sell-through rate: 0% (No inbound inventory - Inbound: "),
        shown_in,
        F.lit(", Sales: "),
        shown_out,
        F.lit(")"),
    )
    some = F.concat(
        F.lit("Sell-through rate: "),
        rate.cast("decimal(22,2)").cast("string"),
        F.lit("% (Inbound: "),
        shown_in,
        F.lit(", Sales: "),
        shown_out,
        F.lit(")"),
    )
    return (
        wanted.join(received, "product_id", "left")
        .join(sold, "product_id", "left")
        .select(
            "product_id",
            inbound.alias("inbound_quantity"),
            sales.alias("sold_quantity"),
            rate.alias("rate"),
            F.when(inbound == 0, none).otherwise(some).alias("sentence"),
        )
    )


def sell_through_report(tables: Tables, product_ids: DataFrame | None = None) -> DataFrame:
    """The sentence with the product's name, or ``Unknown Product`` for ids without a product."""
    names = tables["products"].select("product_id", "product_name")
    return (
        sell_through_rate(tables, product_ids)
        .join(names, "product_id", "left")
        .select(
            "product_id",
            F.coalesce("product_name", F.lit("Unknown Product")).alias("product_name"),
            "sentence",
        )
    )
