"""Reports over delay alerts."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stocklens.operators.alerts import INBOUND, OUTBOUND, DelayRule, delay_alerts, sweep_delay_alerts

Tables = Mapping[str, DataFrame]


def _named(alerts: DataFrame, tables: Tables) -> DataFrame:
    return alerts.join(
        tables["warehouses"].select("warehouse_id", "warehouse_name"), "warehouse_id", "left"
    ).join(tables["products"].select("product_id", "product_name"), "product_id", "left")


def _delay_report(tables: Tables, rule: DelayRule, as_of: dt.datetime | str) -> DataFrame:
    alerts = delay_alerts(tables[rule.orders], rule, as_of)
    return (
        _named(alerts, tables)
        .select(
            rule.order_id,
            F.col("reference_number").alias("reference"),
            F.col("warehouse_name").alias("warehouse"),
            F.col("product_name").alias("product"),
            "delay_days",
            "alert_level",
            F.col("alert_message").alias("message"),
            "created_at",
        )
        .orderBy(F.desc("delay_days"), F.desc("created_at"), rule.order_id)
    )


def inbound_delay_report(tables: Tables, as_of: dt.datetime | str) -> DataFrame:
    return _delay_report(tables, INBOUND, as_of)


def outbound_delay_report(tables: Tables, as_of: dt.datetime | str) -> DataFrame:
    return _delay_report(tables, OUTBOUND, as_of)


def delay_alert_summary(tables: Tables, as_of: dt.datetime | str) -> DataFrame:
    level = F.col("alert_level")
    return (
        sweep_delay_alerts(tables, as_of)
        .groupBy("direction")
        .agg(
            F.count("*").alias("total_alerts"),
            F.count_if(level == "critical").alias("critical_alerts"),
            F.count_if(level == "warning").alias("warning_alerts"),
        )
        .orderBy("direction")
    )


def worst_delay_alert(tables: Tables, as_of: dt.datetime | str) -> DataFrame:
    """Per direction the alert with the longest delay; newest, then lowest order id, on ties.

    The maximum is taken before names are joined, so the joins see one row per direction.
    """
    alerts = sweep_delay_alerts(tables, as_of)
    record = F.struct(*[c for c in alerts.columns if c != "direction"])
    rank = F.struct("delay_days", "created_at", (-F.col("order_id")).alias("lowest"))
    worst = alerts.groupBy("direction").agg(F.max_by(record, rank).alias("worst"))
    return (
        _named(worst.select("direction", "worst.*"), tables)
        .select(
            "direction",
            "order_id",
            F.col("reference_number").alias("reference"),
            F.col("warehouse_name").alias("warehouse"),
            F.col("product_name").alias("product"),
            "delay_days",
            "alert_level",
            F.col("alert_message").alias("message"),
        )
        .orderBy("direction")
    )
