"""Delay alerts over a feed of order changes."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stocklens.operators.alerts import RULES, DelayRule, alert_columns, is_late
from stocklens.sources.schemas import TABLES
from stocklens.streaming.feeds import by_key, compact, per_batch, run_available, written


def change_schema(direction: str) -> T.StructType:
    """Order rows as they are after a change, with a rising ``change_seq``."""
    order = TABLES[f"{direction}_orders"].struct_type
    return T.StructType([T.StructField("change_seq", T.LongType()), *order.fields])


def _latest(changes: DataFrame, key: str) -> DataFrame:
    row = F.struct(*[c for c in changes.columns if c != key])
    return by_key(changes, key).groupBy(key).agg(F.max_by(row, "change_seq").alias("_row")).select(key, "_row.*")


def alert_changes(changes: DataFrame, rule: DelayRule, as_of: dt.datetime | str) -> DataFrame:
    """Per changed order its alert, or a row without alert that clears an earlier one."""
    late = F.coalesce(is_late(rule, as_of), F.lit(False))
    alert = F.when(late, F.struct(*alert_columns(rule, as_of)))
    needed = [rule.order_id, "change_seq", rule.order_type]
    needed += ["warehouse_id", "product_id", "status", "created_time"]
    return _latest(changes.select(*needed), rule.order_id).select(
        rule.order_id, "change_seq", alert.alias("alert")
    )


def stream_delay_alerts(
    spark: SparkSession,
    direction: str,
    changes: str,
    alerts: str,
    state: str,
    as_of: dt.datetime | str,
    files_per_batch: int = 1000,
) -> None:
    """Follow the change files in ``changes`` and keep the alert feed in ``alerts`` current."""
    rule = RULES[direction]
    feed = (
        spark.readStream.schema(change_schema(direction))
        .option("maxFilesPerTrigger", files_per_batch)
        .parquet(changes)
    )
    run_available(feed, per_batch(lambda b: alert_changes(b, rule, as_of), alerts), state, "append")


def _alert_feed(spark: SparkSession, direction: str) -> T.StructType:
    nothing = spark.createDataFrame([], change_schema(direction))
    return alert_changes(nothing, RULES[direction], "2000-01-01").schema


def current_alerts(spark: SparkSession, direction: str, alerts: str) -> DataFrame:
    """The alert table: the latest alert per order that has not been cleared."""
    key = RULES[direction].order_id
    rows = written(spark, alerts, _alert_feed(spark, direction))
    return _latest(rows, key).filter(F.col("alert").isNotNull()).select(key, "alert.*")


def compact_alerts(spark: SparkSession, direction: str, alerts: str) -> None:
    """Fold the feed so far into one row per order; a cleared order keeps its row, as changes may be late."""
    key = RULES[direction].order_id
    compact(spark, alerts, _alert_feed(spark, direction), lambda rows: _latest(rows, key))
