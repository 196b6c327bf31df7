"""Batches of requests, new rows and changes that the catalog derives from whole tables."""

from __future__ import annotations

import datetime as dt
from collections import ChainMap
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stocklens.functions.columns import day
from stocklens.operators.alerts import INBOUND, OUTBOUND

Tables = Mapping[str, DataFrame]


def receive_open_orders(t: Tables) -> DataFrame:
    """Receive every open inbound order as expected, at the location of the product's weight class."""
    code = F.lpad(F.col("weight").cast("int").cast("string"), 2, "0")
    return (
        t["inbound_orders"]
        .filter(F.col("status").isin(*INBOUND.open_statuses))
        .join(t["products"].select("product_id", "weight"), "product_id")
        .select(
            F.col("inbound_id").alias("request_id"),
            "inbound_id",
            F.col("expected_quantity").alias("actual_quantity"),
            F.concat(F.lit("Z-"), code).alias("location"),
        )
    )


def ship_open_orders(t: Tables) -> DataFrame:
    """Ship every open outbound order from the first lot of its product."""
    first = t["inventory"].groupBy("product_id").agg(F.min("inventory_id").alias("inventory_id"))
    return (
        t["outbound_orders"]
        .filter(F.col("status").isin(*OUTBOUND.open_statuses))
        .join(first, "product_id", "left")
        .select(F.col("outbound_id").alias("request_id"), "inventory_id", "outbound_id")
    )


def split_every_lot(t: Tables) -> DataFrame:
    """Set all but three units of every lot apart at the same place."""
    return _parts_of_lots(t, F.col("storage_location"))


def move_every_lot(t: Tables) -> DataFrame:
    """Move all but three units of every lot to the next place of its site, the last place's to the first."""
    return _parts_of_lots(t, _places_on(1))


def move_parts_of_parts(t: Tables) -> DataFrame:
    """Move all but three units of every lot one place on, and half of each new lot one place further."""
    whole, lot = move_every_lot(t), F.col("source_id")
    first = whole.withColumns({"request_id": lot * 2, "source_request": F.lit(None).cast("bigint")})
    onward = _parts_of_lots(t, _places_on(2))
    second = onward.withColumns(
        {
            "request_id": lot * 2 + 1,
            "quantity": F.floor(F.col("quantity") / 2).cast("int"),
            "source_request": lot * 2,
            "source_id": F.lit(None).cast("bigint"),
        }
    )
    return first.unionByName(second)


def _parts_of_lots(t: Tables, target: Column) -> DataFrame:
    return t["inventory"].select(
        F.col("inventory_id").alias("request_id"),
        F.col("inventory_id").alias("source_id"),
        (F.col("total_quantity") - 3).alias("quantity"),
        F.col("product_id").alias("operator_id"),
        F.col("warehouse_id").alias("target_warehouse"),
        target.alias("target_location"),
    )


def _places_on(steps: int) -> Column:
    """The name of the place so many steps after a lot's, in a ring of fifty."""
    number = (F.substring("storage_location", 3, 2).cast("int") + steps - 1) % 50 + 1
    return F.concat(F.lit("Z-"), F.lpad(number.cast("string"), 2, "0"))


def drop_expired_lots(t: Tables, as_of: dt.date | str) -> DataFrame:
    return (
        t["inventory"]
        .filter(F.col("expiry_date") < day(as_of))
        .select(
            F.col("inventory_id").alias("request_id"),
            "inventory_id",
            F.col("product_id").alias("operator_id"),
        )
    )


def repeat_cancelled_inbound(t: Tables) -> DataFrame:
    return (
        t["inbound_orders"]
        .filter(F.col("status") == "cancelled")
        .withColumn("request_id", F.col("inbound_id"))
        .select(
            "request_id",
            "inbound_type",
            "product_id",
            "warehouse_id",
            "expected_quantity",
            "total_items",
            "operator",
            "notes",
        )
    )


def repeat_cancelled_outbound(t: Tables) -> DataFrame:
    return (
        t["outbound_orders"]
        .filter(F.col("status") == "cancelled")
        .withColumn("request_id", F.col("outbound_id"))
        .select(
            "request_id",
            "outbound_type",
            "product_id",
            "warehouse_id",
            "total_items",
            "total_quantity",
            "picker",
            "packer",
        )
    )


def status_after_each_adjustment(t: Tables) -> DataFrame:
    """A status change per adjustment for its operator; counts ask for a status that is not one."""
    kind = F.col("adjustment_type")
    return t["inventory_adjustments"].select(
        F.col("adjustment_id").alias("request_id"),
        F.col("operator").alias("employee_id"),
        F.when(kind == "write_off", "leave")
        .when(kind == "split", "active")
        .when(kind == "transfer", "terminated")
        .otherwise("on_site")
        .alias("new_status"),
    )


def redelivered_inbound(t: Tables) -> tuple[Tables, DataFrame]:
    """Completed orders as stored, and all orders delivered again as a careless batch."""
    orders = t["inbound_orders"]
    stored = ChainMap({"inbound_orders": orders.filter(F.col("status") == "completed")}, t)
    batch = (
        orders.withColumn("row_order", F.col("inbound_id"))
        .withColumn("inbound_type", F.when(F.col("status") != "cancelled", F.col("inbound_type")))
        .withColumn("status", F.when(F.col("status") != "pending", F.col("status")))
    )
    return stored, batch


def new_products_with_lots(t: Tables) -> tuple[Tables, dict[str, DataFrame]]:
    """Tables without every fourth product and its lots, and these as one careless delivery.

    Discontinued products come without a name.  Lots on hold are delivered for a place that is not there.
    """
    fourth = F.col("product_id") % 4 == 0
    products, lots = t["products"], t["inventory"]
    stored = ChainMap({"products": products.filter(~fourth), "inventory": lots.filter(~fourth)}, t)
    named = F.when(F.col("status") != "discontinued", F.col("product_name"))
    place = F.when(F.col("inventory_status") == "hold", "nowhere").otherwise(F.col("storage_location"))
    batches = {
        "inventory": lots.filter(fourth)
        .withColumn("row_order", F.col("inventory_id"))
        .withColumn("storage_location", place),
        "products": products.filter(fourth)
        .withColumn("row_order", F.col("product_id").cast("bigint"))
        .withColumn("product_name", named),
    }
    return stored, batches


def careless_tables(t: Tables) -> Tables:
    """The tables with typical entry mistakes, for the audits."""
    department, status = F.col("department"), F.col("employment_status")
    staff = (
        t["employees"]
        .withColumn(
            "employee_id",
            F.when(F.col("warehouse_id").isNull(), F.col("employee_id") - 1).otherwise(F.col("employee_id")),
        )
        .withColumn(
            "employee_number", F.when(status == "terminated", "EMP-LEFT").otherwise(F.col("employee_number"))
        )
        .withColumn("employee_name", F.when(status != "leave", F.col("employee_name")))
        .withColumn(
            "position",
            F.when(department == "system_admin", F.repeat("position", F.lit(8))).otherwise(F.col("position")),
        )
        .withColumn(
            "department", F.when(department == "quality_control", F.upper("department")).otherwise(department)
        )
    )
    orders = t["outbound_orders"]
    cancelled = F.col("status") == "cancelled"
    orders = orders.withColumn("outbound_type", F.when(~cancelled, F.col("outbound_type"))).withColumn(
        "status", F.when(F.col("status") == "packing", "boxed").otherwise(F.col("status"))
    )
    lots = t["inventory"].withColumn(
        "available_quantity",
        F.when(F.col("inventory_status") == "hold", F.col("total_quantity")).otherwise(
            F.col("available_quantity")
        ),
    )
    log = t["inventory_adjustments"].withColumn(
        "after_quantity",
        F.when(F.col("adjustment_type") == "write_off", -F.col("after_quantity")).otherwise(
            F.col("after_quantity")
        ),
    )
    return ChainMap(
        {
            "employees": staff,
            "outbound_orders": orders,
            "inventory": lots,
            "inventory_adjustments": log,
        },
        t,
    )
