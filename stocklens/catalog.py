"""Every query by name, over the domain tables mapped from a folder of star-schema files.

Values are shown in a portable form: decimals and doubles as doubles with four decimals, dates,
timestamps and whole numbers that may be missing as text.
"""

from __future__ import annotations

from collections import ChainMap
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stocklens import requests
from stocklens.functions import metrics
from stocklens.functions.columns import day
from stocklens.operators import alerts, commands, deletes, guards, rules, utilization
from stocklens.operators.ingest import IngestedTables, ingest_batch, ingest_tables
from stocklens.operators.utilization import with_utilization
from stocklens.plans import alert_reports, stock, suppliers, workforce
from stocklens.session import landed, run_folder
from stocklens.sources import layout, sinks, snapshots
from stocklens.sources.star_mapping import star_tables
from stocklens.sources.tables import load_tables, read_tables, write_tables
from stocklens.streaming import alerts as alert_stream
from stocklens.streaming import due_orders
from stocklens.streaming import lots as lot_stream
from stocklens.streaming import utilization as space_stream

Tables = Mapping[str, DataFrame]

AS_OF = "2001-08-01 00:00:00"
#: A day before it, and the days on which due alerts are read.
EARLIER = "2001-07-27 00:00:00"
DUE_DAYS = ("2001-07-20", "2001-07-27", "2001-08-06")
MONTH = "1998-03"
EXPIRY_DAYS = 10
#: What the queries for a single warehouse, product, ... ask for.
ONE = {"warehouse": 3, "product": 7, "supplier": 5, "employee": 11, "category": "ECONOMY"}


#: Whole-number columns with missing values, per query.
OPTIONAL_NUMBERS = {
    "employee_details": ("warehouse_id",),
    "outbound_operator_guard": ("picker", "packer"),
    "create_inbound_order": ("actual_quantity",),
    "create_outbound_order": ("picker", "packer"),
    "complete_inbound": ("new_inventory_id",),
    "complete_outbound": ("inventory_id",),
    "null_on_delete": ("first_reference", "second_reference"),
    "query_inventory": ("parent_inventory_id",),
    "inbound_orders_after_receipt": ("actual_quantity",),
    "details_of_one_employee": ("warehouse_id",),
    "split_parts_of_parts": ("source_id", "new_inventory_id"),
    "alerts_cleared_by_shipping": ("delay_days_before", "delay_days_after"),
    "alert_changes_by_sweep": ("delay_days_before", "delay_days_after"),
    "lots_after_parts_of_parts": ("parent_inventory_id",),
}


def portable(df: DataFrame, optional: tuple[str, ...] = ()) -> DataFrame:
    columns = []
    for f in df.schema:
        column = F.col(f"`{f.name}`")
        if f.name in optional:
            column = column.cast("string").alias(f.name)
        elif isinstance(f.dataType, T.DecimalType | T.DoubleType):
            column = F.round(column.cast("double"), 4).alias(f.name)
        elif isinstance(f.dataType, T.DateType | T.TimestampNTZType | T.TimestampType):
            column = column.cast("string").alias(f.name)
        columns.append(column)
    return df.select(*columns)


def _in_warehouse(t: Tables) -> DataFrame:
    """Asked for every (person, site) pair that an inbound order or an adjustment shows."""
    shown = [
        t[name].select(F.col("operator").alias("employee_id"), "warehouse_id")
        for name in ("inbound_orders", "inventory_adjustments")
    ]
    return metrics.employee_in_warehouse(t["employees"], shown[0].union(shown[1]).distinct())


def _sell_through_report(t: Tables) -> DataFrame:
    """Asked for every product an outbound order names and one id past the last product."""
    past = t["products"].agg((F.max("product_id") + 1).alias("product_id"))
    named = t["outbound_orders"].select("product_id")
    return metrics.sell_through_report(t, named.union(past).distinct())


def _stored(t: Tables, *names: str) -> Tables:
    """Commands work on stored tables: land the mapped ones they read more than once."""
    return ChainMap({name: landed(t[name], name) for name in names}, t)


def _sized(t: Tables) -> Tables:
    """Stored tables with the space use of their places, which is stored as well."""
    return _stored(with_utilization(t), "locations")


def _complete_inbound(t: Tables) -> DataFrame:
    t = _sized(_stored(t, "inbound_orders"))
    return commands.complete_inbound(t, requests.receive_open_orders(t), AS_OF).results


def _complete_outbound(t: Tables) -> DataFrame:
    t = _stored(t, "outbound_orders", "inventory")
    return commands.complete_outbound(t, requests.ship_open_orders(t), AS_OF).results


def _split(t: Tables) -> DataFrame:
    """The log rows of splitting every lot: new lots, what they came from, and quantities."""
    t = _sized(_stored(t, "inventory"))
    outcome = commands.split_inventory(t, requests.split_every_lot(t), AS_OF)
    return outcome.added["inventory_adjustments"]


def _move(t: Tables) -> commands.Outcome:
    """Lots pushed one place on through a ring of partly full places."""
    t = _sized(_stored(t, "inventory"))
    return commands.split_inventory(t, requests.move_every_lot(t), AS_OF)


def _moved(t: Tables) -> DataFrame:
    return _move(t).added["inventory_adjustments"].select(
        "adjustment_id", "warehouse_id", "inventory_id", "before_quantity", "after_quantity", "adjustment_reason"
    )


def _parts_of_parts(t: Tables) -> commands.Outcome:
    t = _sized(_stored(t, "inventory"))
    return commands.split_inventory(t, requests.move_parts_of_parts(t), AS_OF)


def _lots_after_parts(t: Tables) -> DataFrame:
    """Where every lot is, what it holds and what it came from, after parts of new lots moved on."""
    return _parts_of_parts(t).tables["inventory"].select(
        "inventory_id", "warehouse_id", "storage_location", "total_quantity", "available_quantity", "parent_inventory_id"
    )


def _with_stored_alerts(t: Tables, as_of: str) -> Tables:
    """The tables with both alert tables as they stood on a day."""
    stored = {rule.alerts: alerts.delay_alerts(t[rule.orders], rule, as_of) for rule in alerts.RULES.values()}
    return ChainMap({name: landed(df, name) for name, df in stored.items()}, t)


def _receipt_with_alerts(t: Tables) -> commands.Outcome:
    t = _with_stored_alerts(_sized(_stored(t, "inbound_orders")), AS_OF)
    return commands.complete_inbound(t, requests.receive_open_orders(t), AS_OF)


def _shipping_with_alerts(t: Tables) -> commands.Outcome:
    t = _with_stored_alerts(_stored(t, "outbound_orders", "inventory"), AS_OF)
    return commands.complete_outbound(t, requests.ship_open_orders(t), AS_OF)


def _changes_by_sweep(t: Tables) -> DataFrame:
    """What a sweep changes in the alerts of five days before."""
    t = _with_stored_alerts(_stored(t, "inbound_orders", "outbound_orders"), EARLIER)
    found = alerts.sweep_changes(t, AS_OF)
    parts = [
        found[rule.alerts].changes.withColumnRenamed(rule.order_id, "order_id").withColumn("direction", F.lit(rule.direction))
        for rule in alerts.RULES.values()
    ]
    return parts[0].unionByName(parts[1])


def _write_off(t: Tables) -> DataFrame:
    outcome = commands.write_off_lots(t, requests.drop_expired_lots(t, AS_OF), AS_OF)
    return outcome.added["inventory_adjustments"]


def _create_inbound(t: Tables) -> DataFrame:
    t = _stored(t, "inbound_orders")
    outcome = commands.create_inbound_orders(t, requests.repeat_cancelled_inbound(t), AS_OF)
    return outcome.added["inbound_orders"]


def _create_outbound(t: Tables) -> DataFrame:
    t = _stored(t, "outbound_orders")
    outcome = commands.create_outbound_orders(t, requests.repeat_cancelled_outbound(t), AS_OF)
    return outcome.added["outbound_orders"]


def _employee_status(t: Tables) -> DataFrame:
    return commands.update_employee_status(t, requests.status_after_each_adjustment(t)).results


def _ingest(t: Tables) -> DataFrame:
    stored, batch = requests.redelivered_inbound(_stored(t, "inbound_orders"))
    done = ingest_batch(stored, "inbound_orders", batch, AS_OF)
    accepted = done.accepted.select("inbound_id", "status", F.lit("").alias("violations"))
    return accepted.unionByName(
        done.rejected.select("inbound_id", "status", F.concat_ws(",", "violations").alias("violations"))
    )


def _delivered(t: Tables) -> IngestedTables:
    """Products and their lots delivered together into tables that lack them."""
    stored, batches = requests.new_products_with_lots(_stored(t, "inventory"))
    return ingest_tables(_sized(stored), batches, AS_OF)


def _tables_after_ingest(t: Tables) -> DataFrame:
    """Every row of the delivery with what is wrong with it, and every lot and product there is afterwards."""
    done, parts = _delivered(t), []
    for name, key in (("products", "product_id"), ("inventory", "inventory_id")):
        row = [F.lit(name).alias("table_name"), F.col(key).cast("bigint").alias("row_id")]
        parts.append(done.tables[name].select(*row, F.lit("").alias("violations")))
        parts.append(done.rejected[name].select(*row, F.concat_ws(",", "violations").alias("violations")))
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


def _capacity_guard(t: Tables) -> DataFrame:
    """All lots put away again, in id order, into empty locations."""
    return guards.capacity_guard(t, t["inventory"]).select("inventory_id", "rejection")


def _inbound_orders_after(t: Tables) -> DataFrame:
    """All inbound orders after the open ones were received."""
    t = _sized(_stored(t, "inbound_orders"))
    after = commands.complete_inbound(t, requests.receive_open_orders(t), AS_OF).tables
    return after["inbound_orders"].select("inbound_id", "status", "actual_quantity", "received_time")


def _complete_inbound_twice(t: Tables) -> DataFrame:
    """Space after the open orders were received and delivered once more, into what is left."""
    t = _sized(_stored(t, "inbound_orders", "inventory"))
    asked = requests.receive_open_orders(t)
    once = commands.complete_inbound(t, asked, AS_OF).tables
    once = _stored(once, "inventory", "inbound_orders", "locations")
    return _space(commands.complete_inbound(once, asked, AS_OF).tables["locations"])


def _space_after_outbound(t: Tables) -> DataFrame:
    t = _sized(_stored(t, "outbound_orders", "inventory"))
    return _space(commands.complete_outbound(t, requests.ship_open_orders(t), AS_OF).tables["locations"])


def _space_after_split(t: Tables) -> DataFrame:
    """Splitting within a place changes nothing there."""
    t = _sized(_stored(t, "inventory"))
    return _space(commands.split_inventory(t, requests.split_every_lot(t), AS_OF).tables["locations"])


def _after_write_off(t: Tables) -> Tables:
    t = with_utilization(t)
    return commands.write_off_lots(t, requests.drop_expired_lots(t, AS_OF), AS_OF).tables


def _lots_after_write_off(t: Tables) -> DataFrame:
    return _after_write_off(t)["inventory"].select(
        "inventory_id", "total_quantity", "locked_quantity", "available_quantity"
    )


def _staff_after_status(t: Tables) -> DataFrame:
    after = commands.update_employee_status(t, requests.status_after_each_adjustment(t)).tables
    return after["employees"].select("employee_id", "employment_status")


def _space_after_cascade(t: Tables) -> DataFrame:
    t = with_utilization(t)
    return _space(deletes.cascade_delete(t, _retired(t))["locations"])


def _kept_lots_after_cascade(t: Tables) -> DataFrame:
    return deletes.cascade_delete(t, _retired(t))["inventory"].select("inventory_id", "product_id", "warehouse_id")


def _on_insert(t: Tables) -> DataFrame:
    """Held lots are the new ones; untouched locations keep their stored 0."""
    return _space(utilization.utilization_on_insert(t, t["inventory"].filter("inventory_status = 'hold'")))


def _on_update(t: Tables) -> DataFrame:
    """Lots on hold were all moved to the first location of their warehouse."""
    before = t["inventory"]
    held = F.col("inventory_status") == "hold"
    place = F.when(held, "Z-01").otherwise(F.col("storage_location"))
    after = before.withColumn("storage_location", place)
    now = ChainMap({"inventory": after}, t)
    return _space(utilization.utilization_on_update(now, before.filter(held), after.filter(held)))


def _on_delete(t: Tables) -> DataFrame:
    """Expired lots were removed."""
    expired = F.col("expiry_date") < day(AS_OF)
    now = ChainMap({"inventory": t["inventory"].filter(~expired)}, t)
    return _space(utilization.utilization_on_delete(now, t["inventory"].filter(expired)))


def _space(locations: DataFrame) -> DataFrame:
    return locations.select("warehouse_id", "location", "utilization")


def _foreign_keys(t: Tables) -> DataFrame:
    t = _stored(t, "inbound_orders", "outbound_orders")
    made = {
        f"{rule.direction}_delay_alerts": alerts.delay_alerts(t[rule.orders], rule, AS_OF)
        for rule in alerts.RULES.values()
    }
    return rules.audit_foreign_keys(ChainMap(made, t))


def _retired(t: Tables) -> dict[str, DataFrame]:
    return {
        "warehouses": t["warehouses"].filter("status = 'inactive'").select("warehouse_id"),
        "suppliers": t["suppliers"].filter("status = 'inactive'").select("supplier_id"),
        "products": t["products"].filter("status = 'discontinued'").select("product_id"),
    }


def _cascade_delete(t: Tables) -> DataFrame:
    """Rows kept per table after inactive warehouses, suppliers and discontinued products go."""
    kept = deletes.cascade_delete(t, _retired(t))
    parts = [df.agg(F.count("*").alias("rows_kept")).withColumn("table_name", F.lit(n)) for n, df in kept.items()]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def _null_on_delete(t: Tables) -> DataFrame:
    """References left after inactive warehouses and terminated staff go."""
    gone = {
        "warehouses": t["warehouses"].filter("status = 'inactive'"),
        "employees": t["employees"].filter("employment_status = 'terminated'"),
    }
    kept = deletes.null_on_delete({n: t[n] for n in ("employees", "outbound_orders")}, gone)
    staff = kept["employees"].select(
        F.lit("employees").alias("table_name"),
        F.col("employee_id").cast("bigint").alias("row_id"),
        F.col("warehouse_id").alias("first_reference"),
        F.lit(None).cast("int").alias("second_reference"),
    )
    orders = kept["outbound_orders"].select(
        F.lit("outbound_orders").alias("table_name"),
        F.col("outbound_id").alias("row_id"),
        F.col("picker").alias("first_reference"),
        F.col("packer").alias("second_reference"),
    )
    return staff.unionByName(orders)


def _restrict_delete(t: Tables) -> DataFrame:
    """Staff who are not active any more but cannot be removed."""
    gone = t["employees"].filter("employment_status <> 'active'")
    return deletes.restrict_delete(t, {"employees": gone})["employees"]


def _rename_location(t: Tables) -> DataFrame:
    """Lots after the locations of inactive warehouses got new names."""
    closed = t["warehouses"].filter("status = 'inactive'").select("warehouse_id")
    renames = (
        t["locations"]
        .join(closed, "warehouse_id", "left_semi")
        .select("warehouse_id", "location", F.concat(F.lit("closed-"), "location").alias("new_location"))
    )
    lots = deletes.cascade_rename_location(t, renames)["inventory"]
    return lots.select("inventory_id", "warehouse_id", "storage_location")


def _careless(audit: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
    return lambda t: audit(requests.careless_tables(t))


ON_TABLES: dict[str, Callable[[Tables], DataFrame]] = {
    "list_warehouses": stock.list_warehouses,
    "warehouse_utilization": lambda t: stock.warehouse_utilization(with_utilization(t)),
    "warehouse_inventory_overview": stock.warehouse_inventory_overview,
    "high_writeoff_rate_warehouses": stock.high_writeoff_rate_warehouses,
    "list_products": stock.list_products,
    "product_suppliers": suppliers.product_suppliers,
    "supplier_products_detail": suppliers.supplier_products_detail,
    "high_value_poor_selling": lambda t: stock.high_value_poor_selling(t, AS_OF),
    "misleading_suppliers": suppliers.misleading_suppliers,
    "query_inventory": stock.query_inventory,
    "expiring_items": lambda t: stock.expiring_items(t, AS_OF, EXPIRY_DAYS),
    "employee_details": workforce.employee_details,
    "department_employee_stats": workforce.department_employee_stats,
    "warehouse_employee_distribution": workforce.warehouse_employee_distribution,
    "employee_operation_stats": workforce.employee_operation_stats,
    "employee_operation_stats_exact": workforce.employee_operation_stats_exact,
    "department_active_count": workforce.department_active_count,
    "inventory_value_by_product": stock.inventory_value_by_product,
    "category_inventory_overview": stock.category_inventory_overview,
    "inbound_delay_report": lambda t: alert_reports.inbound_delay_report(t, AS_OF),
    "outbound_delay_report": lambda t: alert_reports.outbound_delay_report(t, AS_OF),
    "delay_alert_summary": lambda t: alert_reports.delay_alert_summary(t, AS_OF),
    "worst_delay_alert": lambda t: alert_reports.worst_delay_alert(t, AS_OF),
    "location_utilization": metrics.location_utilization,
    "employee_in_warehouse": _in_warehouse,
    "sell_through_rate": metrics.sell_through_rate,
    "sell_through_report": _sell_through_report,
    "supplier_monthly_report": lambda t: suppliers.supplier_monthly_report(t, MONTH, AS_OF),
    "report_summary": lambda t: suppliers.report_summary(
        suppliers.supplier_monthly_report(t, MONTH, AS_OF), MONTH
    ),
    "inbound_delay_alerts": lambda t: alerts.inbound_delay_alerts(t, AS_OF),
    "outbound_delay_alerts": lambda t: alerts.outbound_delay_alerts(t, AS_OF),
    "sweep_delay_alerts": lambda t: alerts.sweep_delay_alerts(t, AS_OF),
    "recalculate_utilization": lambda t: utilization.recalculate_utilization(t),
    "utilization_on_insert": _on_insert,
    "utilization_on_update": _on_update,
    "utilization_on_delete": _on_delete,
    "capacity_guard": _capacity_guard,
    "inbound_operator_guard": lambda t: guards.inbound_operator_guard(t, t["inbound_orders"]).select(
        "inbound_id", "operator", "warehouse_id", "rejection"
    ),
    "outbound_operator_guard": lambda t: guards.outbound_operator_guard(
        t, t["outbound_orders"]
    ).select("outbound_id", "picker", "packer", "warehouse_id", "rejection"),
    "split_inventory": _split,
    "move_lots": _moved,
    "locations_after_moves": lambda t: _space(_move(t).tables["locations"]),
    "split_parts_of_parts": lambda t: _parts_of_parts(t).results,
    "lots_after_parts_of_parts": _lots_after_parts,
    "locations_after_parts_of_parts": lambda t: _space(_parts_of_parts(t).tables["locations"]),
    "alerts_after_receipt": lambda t: _receipt_with_alerts(t).tables["inbound_delay_alerts"],
    "alerts_after_shipping": lambda t: _shipping_with_alerts(t).tables["outbound_delay_alerts"],
    "alerts_cleared_by_shipping": lambda t: _shipping_with_alerts(t).alert_changes["outbound_delay_alerts"],
    "alert_changes_by_sweep": _changes_by_sweep,
    "write_off_lot": _write_off,
    "create_inbound_order": _create_inbound,
    "complete_inbound": _complete_inbound,
    "create_outbound_order": _create_outbound,
    "complete_outbound": _complete_outbound,
    "update_employee_status": _employee_status,
    "ingest_batch": _ingest,
    "tables_after_ingest": _tables_after_ingest,
    "locations_after_ingest": lambda t: _space(_delivered(t).tables["locations"]),
    "audit_primary_keys": _careless(rules.audit_primary_keys),
    "audit_unique": _careless(rules.audit_unique),
    "audit_not_null": _careless(rules.audit_not_null),
    "audit_enums": _careless(rules.audit_enums),
    "audit_checks": lambda t: rules.audit_checks(requests.careless_tables(with_utilization(t))),
    "audit_lengths": _careless(rules.audit_lengths),
    "audit_foreign_keys": _foreign_keys,
    "cascade_delete": _cascade_delete,
    "null_on_delete": _null_on_delete,
    "restrict_delete": _restrict_delete,
    "cascade_rename_location": _rename_location,
    "inbound_orders_after_receipt": _inbound_orders_after,
    "complete_inbound_twice": _complete_inbound_twice,
    "locations_after_outbound": _space_after_outbound,
    "locations_after_split": _space_after_split,
    "locations_after_write_off": lambda t: _space(_after_write_off(t)["locations"]),
    "lots_after_write_off": _lots_after_write_off,
    "staff_after_status_changes": _staff_after_status,
    "locations_after_cascade": _space_after_cascade,
    "lots_after_cascade": _kept_lots_after_cascade,
    "inventory_of_one_warehouse": lambda t: stock.warehouse_inventory_overview(t, ONE["warehouse"]),
    "suppliers_of_one_product": lambda t: suppliers.product_suppliers(t, ONE["product"]),
    "products_of_one_supplier": lambda t: suppliers.supplier_products_detail(t, ONE["supplier"]),
    "details_of_one_employee": lambda t: workforce.employee_details(t, ONE["employee"]),
    "operations_of_one_employee": lambda t: workforce.employee_operation_stats(t, ONE["employee"]),
    "staff_of_one_warehouse": lambda t: workforce.warehouse_employee_distribution(t, ONE["warehouse"]),
    "stock_of_one_category": lambda t: stock.category_inventory_overview(t, ONE["category"]),
}


def _read_tables(spark: SparkSession, folder: str) -> DataFrame:
    """Land the mapped tables and read them back by their declared schemas: rows and key sums."""
    landed = run_folder(spark, "tables")
    write_tables(dict(star_tables(spark, folder)), landed)
    parts = []
    for name, df in read_tables(spark, landed).items():
        number = df.columns[0]
        parts.append(
            df.agg(
                F.count("*").alias("row_count"),
                F.sum(F.col(number).cast("decimal(38,0)")).cast("double").alias("id_sum"),
            ).withColumn("table_name", F.lit(name))
        )
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def _read_whole_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Land the mapped tables and read them back: a digest over all columns of all rows of each table."""
    place = run_folder(spark, "tables")
    write_tables(dict(star_tables(spark, folder)), place)
    parts = []
    for name, df in read_tables(spark, place).items():
        text = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("?")) for c in df.columns])
        number = F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")
        parts.append(
            df.agg(F.count("*").alias("row_count"), F.sum(number).alias("row_digest")).withColumn("table_name", F.lit(name))
        )
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def _load_with_rejects(spark: SparkSession, folder: str) -> DataFrame:
    """Products and suppliers as text in which every fiftieth key is no number."""
    tables, place = star_tables(spark, folder), run_folder(spark, "text")
    keys = {"products": "product_id", "suppliers": "supplier_id"}
    for name, key in keys.items():
        spoiled = F.when(F.col(key) % 50 == 0, F.concat(F.lit("no-"), F.col(key))).otherwise(F.col(key).cast("string"))
        write_tables({name: tables[name].withColumn(key, spoiled)}, place, "csv")
    done = load_tables(spark, place, "csv", keys)
    rejected = done.rejects.select(
        "table_name", F.substring_index("record", ",", 1).alias("row_key"), F.lit(True).alias("rejected")
    )
    for name, key in keys.items():
        kept = done.tables[name].select(
            F.lit(name).alias("table_name"), F.col(key).cast("string").alias("row_key"), F.lit(False).alias("rejected")
        )
        rejected = rejected.unionByName(kept)
    return rejected


def _write_monthly_report(spark: SparkSession, folder: str) -> DataFrame:
    """The month written twice, next to another month, and read back."""
    tables, target = star_tables(spark, folder), run_folder(spark, "report")
    for month in (MONTH, "1998-04", MONTH):
        report = suppliers.supplier_monthly_report(tables, month, AS_OF)
        sinks.write_monthly_report(report, target, month)
    return sinks.read_monthly_report(spark, target).filter(F.col("report_month") == MONTH)


def _write_alerts(spark: SparkSession, folder: str) -> DataFrame:
    """Alerts of the day before, replaced by those of the day, read back."""
    tables, target = star_tables(spark, folder), run_folder(spark, "alerts")
    for as_of in ("2001-07-31 00:00:00", AS_OF):
        sinks.write_alerts(alerts.sweep_delay_alerts(tables, as_of), target)
    return sinks.read_alerts(spark, target)


def _publish_snapshot(spark: SparkSession, folder: str) -> DataFrame:
    """Lots of the latest published run, after the open orders were shipped from them."""
    tables, target = star_tables(spark, folder), run_folder(spark, "snapshots")
    names = ["inventory", "outbound_orders"]
    sinks.publish_snapshot({n: tables[n] for n in names}, target, "before", "2001-07-31 00:00:00")
    before = ChainMap(sinks.read_snapshot(spark, target, names), tables)
    after = commands.complete_outbound(before, requests.ship_open_orders(before), AS_OF).tables
    sinks.publish_snapshot({n: after[n] for n in names}, target, "after", AS_OF)
    lots = sinks.read_snapshot(spark, target, names)["inventory"]
    return lots.select("inventory_id", "total_quantity", "locked_quantity", "available_quantity", "last_updated")


def _from_layout(
    query: Callable[[Tables], DataFrame], closed_from: str, closed_until: str | None = None
) -> Callable[[SparkSession, str], DataFrame]:
    """A query over stored tables, of whose closed orders it needs some months."""

    def read(spark: SparkSession, folder: str) -> DataFrame:
        place = run_folder(spark, "layout")
        layout.write_layout(dict(star_tables(spark, folder)), place, buckets=4)
        return query(layout.open_layout(spark, place, closed_from, closed_until))

    return read


def _published_changes(spark: SparkSession, folder: str) -> str:
    """Lots and orders published before and after the open orders were shipped; what did not change is not written."""
    tables, target = star_tables(spark, folder), run_folder(spark, "changes")
    names = ["inventory", "outbound_orders"]
    snapshots.publish_changes({n: tables[n] for n in names}, target, "before", "2001-07-31 00:00:00")
    before = ChainMap(snapshots.read_run(spark, target, names), tables)
    after = commands.complete_outbound(before, requests.ship_open_orders(before), AS_OF).tables
    snapshots.publish_changes({n: after[n] for n in names}, target, "after", AS_OF)
    return target


def _lots_of(run: str | None) -> Callable[[SparkSession, str], DataFrame]:
    def read(spark: SparkSession, folder: str) -> DataFrame:
        lots = snapshots.read_run(spark, _published_changes(spark, folder), ["inventory"], run)["inventory"]
        return lots.select("inventory_id", "total_quantity", "locked_quantity", "available_quantity", "last_updated")

    return read


def _stream_delay_alerts(spark: SparkSession, folder: str) -> DataFrame:
    """A feed that opens every order and then brings it to its real state."""
    tables, root = star_tables(spark, folder), run_folder(spark, "alert-stream")
    found = []
    for rule in alerts.RULES.values():
        feed = f"{root}/{rule.direction}/changes"
        versions = F.explode(F.array(F.lit(1).cast("bigint"), F.lit(2).cast("bigint")))
        changes = tables[rule.orders].withColumn("change_seq", versions)
        first = F.col("change_seq") == 1
        changes.withColumn("status", F.when(first, "pending").otherwise(F.col("status"))).write.parquet(feed)
        target = f"{root}/{rule.direction}/alerts"
        alert_stream.stream_delay_alerts(
            spark, rule.direction, feed, target, f"{root}/{rule.direction}/state", AS_OF
        )
        current = alert_stream.current_alerts(spark, rule.direction, target)
        found.append(
            current.withColumnRenamed(rule.order_id, "order_id").withColumn("direction", F.lit(rule.direction))
        )
    return found[0].unionByName(found[1])


def _stream_due_alerts(spark: SparkSession, folder: str) -> DataFrame:
    """Alert tables of three days, from one feed of orders that open, change, close and go; each delivered twice."""
    tables, root = star_tables(spark, folder), run_folder(spark, "due-stream")
    found = []
    for rule in alerts.RULES.values():
        name = f"{root}/{rule.direction}"
        orders = landed(tables[rule.orders], rule.orders)
        first = orders.withColumns({"change_seq": F.lit(1).cast("bigint"), "status": F.lit("pending")})
        last = orders.withColumn("change_seq", F.lit(2).cast("bigint"))
        # every seventh order is removed: all that is left of it is its key
        gone = F.col(rule.order_id) % 7 == 0
        gone_rows = orders.filter(gone).select(rule.order_id, F.lit(3).cast("bigint").alias("change_seq"))
        removed = first.limit(0).unionByName(gone_rows, allowMissingColumns=True)
        for part in (removed, last, first, last):  # out of order, one of them twice
            part.write.mode("append").parquet(f"{name}/changes")
        due_orders.stream_open_orders(spark, rule.direction, f"{name}/changes", f"{name}/orders", f"{name}/state")
        for as_of in DUE_DAYS:
            due = due_orders.due_alerts(spark, rule.direction, f"{name}/orders", as_of)
            found.append(due.withColumnRenamed(rule.order_id, "order_id").withColumn("direction", F.lit(rule.direction)))
    result = found[0]
    for part in found[1:]:
        result = result.unionByName(part)
    return result


def _stream_lot_states(spark: SparkSession, folder: str) -> DataFrame:
    """Space from a feed of lots that arrive, ship what is available and go, delivered twice and backwards."""
    tables, root = star_tables(spark, folder), run_folder(spark, "lot-stream")
    lots = landed(tables["inventory"], "inventory")
    held = lots.filter("inventory_status = 'hold'")
    shipped = lots.withColumn("total_quantity", F.col("locked_quantity"))
    steps = [lot_stream.lot_states(lots, 1), lot_stream.lot_states(shipped, 2), lot_stream.removed_lots(held, 3)]
    for step in [*reversed(steps), *steps]:
        step.write.mode("append").parquet(f"{root}/changes")
    lot_stream.stream_lot_states(spark, f"{root}/changes", f"{root}/lots", f"{root}/state", files_per_batch=8)
    return lot_stream.space_of_lots(spark, tables["locations"], tables["products"], f"{root}/lots")


def _stream_location_utilization(spark: SparkSession, folder: str) -> DataFrame:
    """Lots arrive, ship what is available, and held ones are removed."""
    tables, root = star_tables(spark, folder), run_folder(spark, "space-stream")
    lots, side = landed(tables["inventory"], "inventory"), space_stream.lot_side()
    nothing = F.lit(None).cast(space_stream.LOT_CHANGES["before"].dataType)
    shipped = lots.withColumn("before", side).withColumn("total_quantity", F.col("locked_quantity"))
    held = F.col("inventory_status") == "hold"
    changes = [  # one set of files per step
        lots.select("inventory_id", nothing.alias("before"), side.alias("after")),
        shipped.select("inventory_id", "before", side.alias("after")),
        shipped.filter(held).select("inventory_id", side.alias("before"), nothing.alias("after")),
    ]
    for change in changes:
        change.write.mode("append").parquet(f"{root}/changes")
    space_stream.stream_location_utilization(
        spark, tables["products"], f"{root}/changes", f"{root}/totals", f"{root}/state"
    )
    return space_stream.current_utilization(spark, tables["locations"], f"{root}/totals")


WITH_STORAGE: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "read_tables": _read_tables,
    "write_monthly_report": _write_monthly_report,
    "write_alerts": _write_alerts,
    "publish_snapshot": _publish_snapshot,
    "stream_delay_alerts": _stream_delay_alerts,
    "stream_location_utilization": _stream_location_utilization,
    "read_whole_rows": _read_whole_rows,
    "load_with_rejects": _load_with_rejects,
    "poor_selling_from_layout": _from_layout(lambda t: stock.high_value_poor_selling(t, AS_OF), "2001-05"),
    "monthly_report_from_layout": _from_layout(
        lambda t: suppliers.supplier_monthly_report(t, MONTH, AS_OF), MONTH, MONTH
    ),
    "publish_changes": _lots_of(None),
    "lots_of_earlier_run": _lots_of("before"),
    "stream_due_alerts": _stream_due_alerts,
    "stream_lot_states": _stream_lot_states,
}


def _on_tables(query: Callable[[Tables], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, folder: query(star_tables(spark, folder))


def catalog() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Every query as a function of (session, folder of star-schema files)."""
    queries = {**{name: _on_tables(query) for name, query in ON_TABLES.items()}, **WITH_STORAGE}

    def shown(name: str) -> Callable[[SparkSession, str], DataFrame]:
        optional = OPTIONAL_NUMBERS.get(name, ())
        return lambda spark, folder: portable(queries[name](spark, folder), optional)

    return {name: shown(name) for name in queries}
