"""Supplier views and the supplier month."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stocklens.functions.columns import month_bounds, percent_half_up, stamp

Tables = Mapping[str, DataFrame]


def product_suppliers(tables: Tables, product_id: int | None = None) -> DataFrame:
    """Suppliers of every product, or of one."""
    pairs = tables["supplier_products"].select("supplier_id", "product_id")
    if product_id is not None:
        pairs = pairs.filter(F.col("product_id") == product_id)
    names = tables["suppliers"].select("supplier_id", "supplier_name")
    return names.join(pairs, "supplier_id").select("supplier_id", "supplier_name", "product_id")


def supplier_products_detail(tables: Tables, supplier_id: int | None = None) -> DataFrame:
    """Supply terms and margin of active products with active suppliers."""
    suppliers = tables["suppliers"].filter(F.col("status") == "active")
    pairs = tables["supplier_products"]
    if supplier_id is not None:
        suppliers = suppliers.filter(F.col("supplier_id") == supplier_id)
        pairs = pairs.filter(F.col("supplier_id") == supplier_id)
    products = tables["products"].filter(F.col("status") == "active")
    price = (F.col("supply_price") * 100).cast("bigint")
    value = (F.col("product_market_value") * 100).cast("bigint")
    return (
        pairs.withColumnsRenamed(
            {
                "created_time": "supply_relationship_created",
                "last_updated": "supply_relationship_updated",
            }
        )
        .join(
            suppliers.select("supplier_id", "supplier_name", F.col("status").alias("supplier_status")),
            "supplier_id",
        )
        .join(
            products.select(
                "product_id",
                "product_sku",
                "product_name",
                "product_description",
                "category",
                "dimensions",
                "volume",
                "weight",
                F.col("value").alias("product_market_value"),
                F.col("status").alias("product_status"),
            ),
            "product_id",
        )
        .withColumn("profit_margin_percent", percent_half_up(value - price, price))
        .select(
            "supplier_id",
            "supplier_name",
            "supplier_status",
            "supplier_sku",
            "supply_price",
            "min_order_quantity",
            "lead_time_days",
            "is_preferred",
            "supply_relationship_created",
            "supply_relationship_updated",
            "product_id",
            "product_sku",
            "product_name",
            "product_description",
            "category",
            "dimensions",
            "volume",
            "weight",
            "product_market_value",
            "profit_margin_percent",
            "product_status",
        )
        .orderBy("supplier_name", "product_name", "supplier_id", "product_id")
    )


def misleading_suppliers(tables: Tables) -> DataFrame:
    """Suppliers with more than 20 % returns among receipts of the products they are preferred for.

    Receipts are counted per product before they meet the pairs: a product with very many receipts
    is one record in the join.
    """
    receipts = (
        tables["inbound_orders"]
        .groupBy("product_id")
        .agg(
            F.count("inbound_id").alias("receipts"),
            F.count_if(F.col("inbound_type") == "return").alias("returns"),
        )
    )
    preferred = tables["supplier_products"].filter("is_preferred").select("supplier_id", "product_id")
    counted = (
        preferred.join(receipts, "product_id")
        .groupBy("supplier_id")
        .agg(F.sum("receipts").alias("receipts"), F.sum("returns").alias("returns"))
        .filter((F.col("returns") > 0) & (F.col("returns") * 5 > F.col("receipts")))
    )
    return (
        tables["suppliers"]
        .select("supplier_id", "supplier_name")
        .join(counted.select("supplier_id"), "supplier_id")
    )


def supplier_monthly_report(
    tables: Tables, month: str, created_at: dt.datetime | str, inclusive_end: bool = False
) -> DataFrame:
    """Receipts, returns and quality score per active supplier in a ``YYYY-MM`` month.

    The last day counts only at midnight unless ``inclusive_end``.  A receipt is credited to every
    supplier of its product.
    """
    first, last = month_bounds(month)
    received = F.col("received_time")
    if inclusive_end:
        inside = (received >= stamp(first)) & (received < stamp(last + dt.timedelta(days=1)))
    else:
        inside = received.between(stamp(first), stamp(last))
    by_product = (
        tables["inbound_orders"]
        .filter((F.col("status") == "completed") & inside)
        .groupBy("product_id")
        .agg(
            F.sum("actual_quantity").alias("quantity"),
            F.count("*").alias("receipts"),
            F.count_if(F.col("inbound_type") == "return").alias("returns"),
        )
    )
    by_supplier = (
        tables["supplier_products"]
        .select("supplier_id", "product_id")
        .join(by_product, "product_id")
        .groupBy("supplier_id")
        .agg(
            F.coalesce(F.sum("quantity"), F.lit(0)).alias("quantity"),
            F.sum("receipts").alias("receipts"),
            F.sum("returns").alias("returns"),
        )
        .filter((F.col("quantity") > 0) | (F.col("returns") > 0))
    )
    good = F.col("receipts") - F.col("returns")
    return (
        tables["suppliers"]
        .filter(F.col("status") == "active")
        .select("supplier_id", "supplier_name")
        .join(by_supplier, "supplier_id")
        .select(
            F.lit(month).alias("report_month"),
            "supplier_id",
            "supplier_name",
            F.col("quantity").cast("decimal(22,4)").alias("total_inbound"),
            F.col("returns").alias("return_count"),
            percent_half_up(good, F.col("receipts")).cast("decimal(5,2)").alias("quality_score"),
            stamp(created_at).alias("created_at"),
        )
        .orderBy(F.desc("total_inbound"), "supplier_id")
    )


def report_summary(report: DataFrame, month: str) -> DataFrame:
    """One line about a month's report: its record count, or that there is nothing to report."""
    month_bounds(month)
    some = F.col("_records") > 0
    # fixed values: the texts
    return report.agg(F.count("*").alias("_records")).select(
        F.when(~some, F.lit("No data found for the specified period")).alias("message"),
        F.lit(f"Month: {month}").alias("period"),
        F.when(some, F.concat(F.lit("Records: "), F.col("_records"))).alias("summary"),
        F.when(
            ~some, F.lit("Please check if there are completed inbound orders for this month")
        ).alias("suggestion"),
    )
