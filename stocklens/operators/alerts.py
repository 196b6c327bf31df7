"""Late-order alerts as a pure function of the orders and the date."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stocklens.functions.columns import day, stamp

Tables = Mapping[str, DataFrame]

#: What may happen to a stored alert.
OPENED, RAISED, UPDATED, CLEARED = "opened", "raised", "updated", "cleared"


@dataclass(frozen=True)
class AlertChanges:
    """A stored alert table after some orders changed, and the alerts that differ for it."""

    table: DataFrame
    #: the order, ``change``, and the alert's level and days before and after
    changes: DataFrame


@dataclass(frozen=True)
class DelayRule:
    direction: str
    open_statuses: tuple[str, ...]
    closed_statuses: tuple[str, ...]
    warning_after: int
    critical_after: int
    warning_ending: str
    critical_ending: str

    @property
    def order_id(self) -> str:
        return f"{self.direction}_id"

    @property
    def order_type(self) -> str:
        return f"{self.direction}_type"

    @property
    def orders(self) -> str:
        return f"{self.direction}_orders"

    @property
    def alerts(self) -> str:
        return f"{self.direction}_delay_alerts"


# Open statuses, day limits and message endings.
INBOUND = DelayRule(
    "inbound",
    ("pending", "receiving"),
    ("completed", "cancelled"),
    5,
    10,
    " days. follow up required.",
    " days. contact supplier immediately!",
)
OUTBOUND = DelayRule(
    "outbound",
    ("pending", "picking", "packing"),
    ("shipped", "cancelled"),
    3,
    7,
    " days.",
    " days. immediate action required!",
)
RULES = {"inbound": INBOUND, "outbound": OUTBOUND}


def is_late(rule: DelayRule, as_of: dt.datetime | str) -> Column:
    """Open and older than the warning limit, in calendar days.

    The age test is a bound on ``created_time`` itself, so it reaches the scan.
    """
    latest = F.date_sub(day(as_of), rule.warning_after).cast("timestamp_ntz")
    return F.col("status").isin(*rule.open_statuses) & (F.col("created_time") < latest)


def alert_columns(rule: DelayRule, as_of: dt.datetime | str) -> list[Column]:
    """What the alert of a late order says."""
    days = F.datediff(day(as_of), F.col("created_time").cast("date"))
    level = F.when(days > rule.critical_after, "critical").otherwise("warning")
    reference = F.concat(F.col(rule.order_type), F.lit("-"), F.col(rule.order_id))
    ending = F.when(days > rule.critical_after, rule.critical_ending).otherwise(rule.warning_ending)
    message = F.concat(
        level, F.lit(f": {rule.direction} order "), reference, F.lit(" delayed for "), days, ending
    )
    return [
        reference.alias("reference_number"),
        F.col("warehouse_id"),
        F.col("product_id"),
        days.alias("delay_days"),
        level.alias("alert_level"),
        message.alias("alert_message"),
        stamp(as_of).alias("created_at"),
    ]


def delay_alerts(orders: DataFrame, rule: DelayRule, as_of: dt.datetime | str) -> DataFrame:
    """One alert per open order older than the rule's limits."""
    return orders.filter(is_late(rule, as_of)).select(rule.order_id, *alert_columns(rule, as_of))


def inbound_delay_alerts(tables: Tables, as_of: dt.datetime | str) -> DataFrame:
    return delay_alerts(tables["inbound_orders"], INBOUND, as_of)


def outbound_delay_alerts(tables: Tables, as_of: dt.datetime | str) -> DataFrame:
    return delay_alerts(tables["outbound_orders"], OUTBOUND, as_of)


def sweep_delay_alerts(tables: Tables, as_of: dt.datetime | str) -> DataFrame:
    """Alerts of both directions over one snapshot, with ``direction`` and ``order_id``."""
    parts = [
        delay_alerts(tables[rule.orders], rule, as_of)
        .withColumnRenamed(rule.order_id, "order_id")
        .select(F.lit(rule.direction).alias("direction"), "*")
        for rule in RULES.values()
    ]
    return parts[0].unionByName(parts[1])


def alerts_after(
    stored: DataFrame, orders: DataFrame, rule: DelayRule, as_of: dt.datetime | str
) -> AlertChanges:
    """The ``stored`` alerts after ``orders``, and only these, were updated; ``orders`` as they are now.

    A closed order loses its alert.  A late open one gets one, or its days, level and message anew; what the alert
    says about the order itself stays as it was opened.  Other orders, and open ones that are not late, leave
    their alert alone.  Only the updated orders are judged, so a change costs what changed: the stored
    alerts are passed through by one join with it.
    """
    key = rule.order_id
    late = F.coalesce(is_late(rule, as_of), F.lit(False))
    closed = F.col("status").isin(*rule.closed_statuses)
    touched = orders.filter(late | closed).select(
        key, F.lit(True).alias("_touched"), F.when(late, F.struct(*alert_columns(rule, as_of))).alias("_new")
    )
    fresh = ("delay_days", "alert_level", "alert_message", "created_at")
    met = stored.join(touched, key, "left")
    again = F.col("_new").isNotNull()
    kept = met.filter(F.col("_touched").isNull() | again).select(
        *[
            F.when(again, F.col(f"_new.{c}")).otherwise(F.col(c)).cast(stored.schema[c].dataType).alias(c)
            if c in fresh
            else c
            for c in stored.columns
        ]
    )
    late_now = touched.filter(again)
    opened = late_now.join(stored.select(key), key, "left_anti")
    added = opened.select(key, "_new.*").select(
        *[F.col(c).cast(stored.schema[c].dataType).alias(c) for c in stored.columns]
    )
    raised = (F.col("alert_level") == "warning") & (F.col("_new.alert_level") == "critical")
    old, new, differ = ("alert_level", "delay_days"), ("_new.alert_level", "_new.delay_days"), F.lit(False)
    for before, after in zip(old, new, strict=True):
        differ |= ~F.col(before).eqNullSafe(F.col(after))

    def shown(change: Column | str, before: bool, after: bool) -> list[Column]:
        named = [F.lit(change) if isinstance(change, str) else change]
        columns = [named[0].alias("change")]
        for name in old:
            kind = stored.schema[name].dataType
            columns.append((F.col(name) if before else F.lit(None)).cast(kind).alias(f"{name}_before"))
        for name in old:
            kind = stored.schema[name].dataType
            columns.append((F.col(f"_new.{name}") if after else F.lit(None)).cast(kind).alias(f"{name}_after"))
        return columns

    cleared = met.filter(F.col("_touched") & ~again).select(key, *shown(CLEARED, True, False))
    renewed = met.filter(again & differ).select(
        key, *shown(F.when(raised, RAISED).otherwise(UPDATED), True, True)
    )
    first = opened.select(key, *shown(OPENED, False, True))
    return AlertChanges(kept.unionByName(added), cleared.unionByName(renewed).unionByName(first))


def sweep_changes(tables: Tables, as_of: dt.datetime | str) -> dict[str, AlertChanges]:
    """Both stored alert tables after every open order was looked at, by name of the table."""
    return {
        rule.alerts: alerts_after(
            tables[rule.alerts], tables[rule.orders].filter(F.col("status").isin(*rule.open_statuses)), rule, as_of
        )
        for rule in RULES.values()
    }
