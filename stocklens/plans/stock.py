"""Warehouse, product and stock views."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stocklens.functions.columns import day

Tables = Mapping[str, DataFrame]


def list_warehouses(tables: Tables) -> DataFrame:
    return tables["warehouses"].select("*")


def warehouse_utilization(tables: Tables) -> DataFrame:
    """Stored utilization and capacity per warehouse; refresh ``locations`` first.

    Locations are summed before the join, so names travel once per warehouse.
    """
    space = (
        tables["locations"]
        .groupBy("warehouse_id")
        .agg(
            F.sum("utilization").alias("warehouse_utilization"),
            F.sum("capacity").alias("warehouse_capacity"),
        )
    )
    return (
        tables["warehouses"]
        .select("warehouse_id", "warehouse_name")
        .join(space, "warehouse_id")
        .orderBy("warehouse_id")
    )


def warehouse_inventory_overview(tables: Tables, warehouse_id: int | None = None) -> DataFrame:
    """Products, stock value and units per warehouse; warehouses without stock show 0."""
    warehouses, lots = tables["warehouses"], tables["inventory"]
    if warehouse_id is not None:
        warehouses = warehouses.filter(F.col("warehouse_id") == warehouse_id)
        lots = lots.filter(F.col("warehouse_id") == warehouse_id)
    # one record per (warehouse, product) leaves the lots; distinct products become a plain count
    held = lots.groupBy("warehouse_id", "product_id").agg(F.sum("total_quantity").alias("units"))
    valued = held.join(tables["products"].select("product_id", "value"), "product_id", "left")
    totals = valued.groupBy("warehouse_id").agg(
        F.count("product_id").alias("product_count"),
        F.sum(F.col("units") * F.col("value")).alias("inventory_value"),
        F.sum("units").alias("total_units"),
    )
    return (
        warehouses.select("warehouse_id", "warehouse_name")
        .join(totals, "warehouse_id", "left")
        .na.fill(0, ["product_count", "inventory_value", "total_units"])
    )


def high_writeoff_rate_warehouses(tables: Tables) -> DataFrame:
    """Warehouses whose written-off quantity reaches 0.5 % of what they received."""
    lost = (
        tables["inventory_adjustments"]
        .filter(F.col("adjustment_type") == "write_off")
        .groupBy("warehouse_id")
        .agg(F.abs(F.sum("quantity_change")).alias("writeoff"))
    )
    arrived = (F.col("status") == "completed") | (
        (F.col("status") == "receiving") & (F.col("actual_quantity") != 0)
    )
    received = (
        tables["inbound_orders"]
        .filter(arrived)
        .groupBy("warehouse_id")
        .agg(F.sum("actual_quantity").alias("total_quantity"))
    )
    # writeoff / total >= 0.005 in whole numbers; a zero total has no ratio
    reached = (F.col("total_quantity") > 0) & (F.col("writeoff") * 200 >= F.col("total_quantity"))
    return (
        lost.join(received, "warehouse_id")
        .filter(reached)
        .join(
            tables["warehouses"].select("warehouse_id", "warehouse_name", "contact_person"),
            "warehouse_id",
        )
        .select("warehouse_id", "warehouse_name", "contact_person", "writeoff", "total_quantity")
    )


def list_products(tables: Tables) -> DataFrame:
    return (
        tables["products"]
        .select("product_id", "product_sku", "product_name", "category")
        .orderBy("product_id")
    )


def inventory_value(tables: Tables) -> DataFrame:
    """Units and value per stocked product (``product_id``, ``units``, ``sumvalue``, attributes)."""
    units = tables["inventory"].groupBy("product_id").agg(F.sum("total_quantity").alias("units"))
    return (
        tables["products"]
        .select("product_id", "product_name", "product_sku", "category", "value")
        .join(units, "product_id")
        .withColumn("sumvalue", F.col("value") * F.col("units"))
    )


def inventory_value_by_product(tables: Tables) -> DataFrame:
    return (
        inventory_value(tables)
        .select("product_id", "product_name", "product_sku", "sumvalue")
        .orderBy("product_id")
    )


def high_value_poor_selling(tables: Tables, as_of: dt.date | str) -> DataFrame:
    """Products worth more than their category's mean that shipped nothing for three months."""
    valued = inventory_value(tables)
    means = (
        valued.filter(F.col("category").isNotNull())
        .groupBy("category")
        .agg(F.sum("sumvalue").alias("_total"), F.count("sumvalue").alias("_products"))
    )
    since = F.add_months(day(as_of), -3).cast("timestamp_ntz")
    moving = (
        tables["outbound_orders"]
        .filter((F.col("status") == "shipped") & (F.col("shipped_time") >= since))
        .select("product_id")
        .distinct()
    )
    # sumvalue > total / products, without dividing
    above = F.col("sumvalue").cast("decimal(28,2)") * F.col("_products").cast(
        "decimal(10,0)"
    ) > F.col("_total")
    return (
        valued.join(means, "category")
        .filter(above)
        .join(moving, "product_id", "left_anti")
        .select(
            "product_name",
            "product_id",
            "category",
            (F.col("_total").cast("double") / F.col("_products")).alias("avgvalue"),
            "sumvalue",
        )
        .orderBy("product_id")
    )


def query_inventory(
    tables: Tables, warehouse_id: int | None = None, product_id: int | None = None
) -> DataFrame:
    """Lots, optionally of one warehouse and/or one product."""
    lots = tables["inventory"]
    if warehouse_id is not None:
        lots = lots.filter(F.col("warehouse_id") == warehouse_id)
    if product_id is not None:
        lots = lots.filter(F.col("product_id") == product_id)
    return lots.orderBy("inventory_id")


def expiring_items(tables: Tables, as_of: dt.date | str, days: int) -> DataFrame:
    """Lots that expire within ``days`` of ``as_of``; expired lots show negative days."""
    today = day(as_of)
    return (
        tables["inventory"]
        .filter(F.col("expiry_date") <= F.date_add(today, days))
        .select(
            "inventory_id",
            "product_id",
            "warehouse_id",
            "expiry_date",
            F.datediff("expiry_date", today).alias("days_to_expire"),
            "total_quantity",
        )
        .orderBy("expiry_date", "inventory_id")
    )


def category_inventory_overview(tables: Tables, category: str | None = None) -> DataFrame:
    """Products, lots, quantities, value and locked share per category, by value."""
    products = tables["products"]
    if category is not None:
        products = products.filter(F.col("category") == category)
    lots = (
        tables["inventory"]
        .groupBy("product_id")
        .agg(
            F.count("inventory_id").alias("lots"),
            F.sum("total_quantity").alias("total"),
            F.sum("locked_quantity").alias("locked"),
            F.sum("available_quantity").alias("available"),
        )
    )
    def total(column):
        return F.coalesce(F.sum(column), F.lit(0))

    grouped = (
        products.select("product_id", "category", "value")
        .join(lots, "product_id", "left")
        .groupBy("category")
        .agg(
            F.count("product_id").alias("sku_count"),
            total("lots").alias("inventory_locations"),
            total("total").alias("total_quantity"),
            total("locked").alias("locked_quantity"),
            total("available").alias("available_quantity"),
            total(F.col("total") * F.col("value")).alias("inventory_value"),
        )
    )
    worth = F.col("inventory_value").cast("double")
    share = F.col("locked_quantity") * 100.0 / F.nullif(F.col("total_quantity"), F.lit(0))
    return grouped.select(
        "*",
        (worth / F.col("sku_count")).alias("avg_value_per_sku"),
        F.coalesce(share, F.lit(0.0)).alias("lock_percentage"),
    ).orderBy(F.desc("inventory_value"), "category")
