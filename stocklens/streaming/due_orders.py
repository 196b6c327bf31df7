"""Open orders kept over a feed of order changes, with the days on which they become late.

An alert comes due as time passes, not only when its order changes.  So the feed's state is not alerts but open
orders: each with the day on which it becomes a warning and the day on which it becomes critical.  The alert
table of any later day is then a filter on those days, without a new event.

A change is an order as it is after it, with a rising ``change_seq``; a removed order is a change without status.
Changes may be delivered twice, late or in any order: the latest per order counts.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stocklens.functions.columns import day
from stocklens.operators.alerts import RULES, DelayRule, delay_alerts
from stocklens.streaming.alerts import change_schema
from stocklens.streaming.feeds import by_key, compact, per_batch, run_available, written

_ABOUT = ("product_id", "warehouse_id", "status", "created_time")


def open_orders(changes: DataFrame, rule: DelayRule) -> DataFrame:
    """Per changed order its latest state: ``order`` and its due days, both missing once it is closed or removed."""
    is_open = F.coalesce(F.col("status").isin(*rule.open_statuses), F.lit(False))
    created = F.col("created_time").cast("date")
    order = F.when(is_open, F.struct(rule.order_type, *_ABOUT))
    rows = changes.select(
        rule.order_id,
        "change_seq",
        order.alias("order"),
        F.when(is_open, F.date_add(created, rule.warning_after + 1)).alias("warning_from"),
        F.when(is_open, F.date_add(created, rule.critical_after + 1)).alias("critical_from"),
    )
    return _latest(rows, rule.order_id)


def _latest(rows: DataFrame, key: str) -> DataFrame:
    about = F.struct(*[c for c in rows.columns if c != key])
    return by_key(rows, key).groupBy(key).agg(F.max_by(about, "change_seq").alias("_row")).select(key, "_row.*")


def stream_open_orders(
    spark: SparkSession, direction: str, changes: str, orders: str, state: str, files_per_batch: int = 1000
) -> None:
    """Follow the change files in ``changes`` and keep the open orders in ``orders`` current."""
    rule = RULES[direction]
    feed = (
        spark.readStream.schema(change_schema(direction))
        .option("maxFilesPerTrigger", files_per_batch)
        .parquet(changes)
    )
    run_available(feed, per_batch(lambda batch: open_orders(batch, rule), orders), state, "append")


def _schema(spark: SparkSession, direction: str) -> T.StructType:
    return open_orders(spark.createDataFrame([], change_schema(direction)), RULES[direction]).schema


def due_alerts(spark: SparkSession, direction: str, orders: str, as_of: dt.datetime | str) -> DataFrame:
    """The alert table of the day ``as_of``, from the open orders followed so far."""
    rule = RULES[direction]
    found = _latest(written(spark, orders, _schema(spark, direction)), rule.order_id)
    due = found.filter(F.col("warning_from") <= day(as_of))
    return delay_alerts(due.select(rule.order_id, "order.*"), rule, as_of)


def coming_due(spark: SparkSession, direction: str, orders: str, after: dt.datetime | str, until: dt.datetime | str) -> DataFrame:
    """Orders that become a warning or critical after one day and up to another, if nothing happens to them."""
    key = RULES[direction].order_id
    found = _latest(written(spark, orders, _schema(spark, direction)), key)
    steps = F.array(
        F.struct(F.lit("warning").alias("alert_level"), F.col("warning_from").alias("due")),
        F.struct(F.lit("critical").alias("alert_level"), F.col("critical_from").alias("due")),
    )
    due = found.filter("order is not null").select(key, F.explode(steps).alias("step")).select(key, "step.*")
    return due.filter((F.col("due") > day(after)) & (F.col("due") <= day(until)))


def compact_open_orders(spark: SparkSession, direction: str, orders: str) -> None:
    """Fold the feed so far into one row per order; a closed one keeps its row, as changes may be late."""
    compact(spark, orders, _schema(spark, direction), lambda rows: _latest(rows, RULES[direction].order_id))
