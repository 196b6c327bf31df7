"""Queries on small hand-written tables: filters, thresholds, empty inputs and missing values."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

import pytest
import small
from pyspark.sql import functions as F
from small import inbound, lot, outbound, person, place, product, warehouse

from stocklens.functions import metrics
from stocklens.functions.columns import month_bounds, percent_half_up
from stocklens.operators import alerts
from stocklens.operators.utilization import (
    recalculate_utilization,
    utilization_on_delete,
    utilization_on_insert,
    utilization_on_update,
    with_utilization,
)
from stocklens.plans import alert_reports, stock, suppliers, workforce

NOW = "2025-12-03"


def values(df, *columns):
    return [tuple(r[c] for c in columns) for r in df.collect()]


def used(locations):
    return {(r["warehouse_id"], r["location"]): r["utilization"] for r in locations.collect()}


def supplier(number, **more):
    return {"supplier_id": number, "supplier_name": f"S{number}", **more}


def supplies(supplier_id, product_id, **more):
    return {"supplier_id": supplier_id, "product_id": product_id, **more}


def test_empty_tables_give_empty_results(spark):
    t = small.tables(spark)
    for query in (
        stock.warehouse_utilization,
        stock.warehouse_inventory_overview,
        stock.high_writeoff_rate_warehouses,
        stock.inventory_value_by_product,
        stock.category_inventory_overview,
        suppliers.misleading_suppliers,
        suppliers.supplier_products_detail,
        workforce.employee_operation_stats,
        workforce.warehouse_employee_distribution,
        metrics.sell_through_rate,
        recalculate_utilization,
    ):
        assert query(t).count() == 0, query.__name__
    assert stock.high_value_poor_selling(t, NOW).count() == 0
    assert suppliers.supplier_monthly_report(t, "2025-11", NOW).count() == 0
    assert alerts.sweep_delay_alerts(t, NOW).count() == 0


def test_percent_rounds_half_away_from_zero(spark):
    rows = [(1, 8, 12.5), (1, 3, 33.33), (2, 3, 66.67), (1, 800, 0.13), (-1, 800, -0.13), (5, 0, None), (0, 5, 0.0)]
    df = spark.createDataFrame(rows, "n bigint, d bigint, want double")
    assert df.filter(~percent_half_up(F.col("n"), F.col("d")).eqNullSafe(F.col("want"))).count() == 0


@pytest.mark.parametrize("month", ["2025-13", "2025-00", "2025-1", "25-11", "2025/11", "", "2025-11 ", None])
def test_bad_months_are_refused(month):
    with pytest.raises(ValueError):
        month_bounds(month)


def test_month_bounds():
    assert month_bounds("2024-02") == (dt.date(2024, 2, 1), dt.date(2024, 2, 29))
    assert month_bounds("2025-12") == (dt.date(2025, 12, 1), dt.date(2025, 12, 31))


def test_overview_keeps_empty_warehouses_and_filters(spark):
    t = small.tables(
        spark,
        warehouses=[warehouse(1), warehouse(2)],
        products=[product(1, value=2.5), product(2, value=None)],
        inventory=[lot(1, 1, total=4), lot(2, 1, total=6), lot(3, 2, total=5), lot(4, 9, total=1)],
    )
    columns = ("warehouse_id", "product_count", "inventory_value", "total_units")
    got = values(stock.warehouse_inventory_overview(t).orderBy("warehouse_id"), *columns)
    assert got == [(1, 3, Decimal("25.00"), 16), (2, 0, Decimal("0.00"), 0)]
    assert values(stock.warehouse_inventory_overview(t, 2), *columns) == got[1:]
    assert values(stock.query_inventory(t, 1, 1), "inventory_id") == [(1,), (2,)]
    assert values(stock.query_inventory(t, product_id=2), "inventory_id") == [(3,)]


@pytest.mark.parametrize("lost, listed", [(5, True), (4, False)])
def test_write_off_threshold_is_inclusive(spark, lost, listed):
    log = {"adjustment_id": 1, "adjustment_type": "write_off", "warehouse_id": 1, "product_id": 1, "inventory_id": 1}
    t = small.tables(
        spark,
        warehouses=[warehouse(1), warehouse(2)],
        inventory_adjustments=[{**log, "quantity_change": -lost}, {**log, "adjustment_id": 2, "warehouse_id": 2, "quantity_change": -9}],
        inbound_orders=[
            inbound(1, status="completed", quantity=900),
            inbound(2, status="receiving", quantity=100),
            inbound(3, status="pending", quantity=5000),
            inbound(4, site=2, status="completed", quantity=0),
        ],
    )
    assert bool(stock.high_writeoff_rate_warehouses(t).count()) == listed


def test_slow_sellers_need_more_than_the_mean_and_no_recent_shipment(spark):
    t = small.tables(
        spark,
        products=[product(i, category="c", value=1) for i in (1, 2, 3, 4)]
        + [product(5, category=None), product(6, category="d")],
        inventory=[lot(1, 1, total=30), lot(2, 2, total=30), lot(3, 3, total=20), lot(4, 4, total=0), lot(5, 5), lot(6, 6)],
        outbound_orders=[
            outbound(1, 1, status="shipped", shipped_time="2025-09-03T00:00:00"),
            outbound(2, 2, status="shipped", shipped_time="2025-09-02T23:59:59"),
            outbound(3, 2, status="pending"),
        ],
    )
    assert values(stock.high_value_poor_selling(t, NOW), "product_id", "avgvalue") == [(2, 20.0)]


def test_expiring_items_include_expired_and_skip_unknown(spark):
    days = {1: "2025-12-01", 2: "2025-12-13", 3: "2025-12-14", 4: None}
    t = small.tables(spark, inventory=[lot(k, expiry_date=v) for k, v in days.items()])
    assert values(stock.expiring_items(t, NOW, 10), "inventory_id", "days_to_expire") == [(1, -2), (2, 10)]


def test_misleading_suppliers_use_preferred_pairs_only(spark):
    orders = [inbound(i, 1, "return" if i == 1 else "purchase") for i in range(1, 6)]  # exactly 20 %
    orders += [inbound(10 + i, 2, "return" if i == 1 else "purchase") for i in range(1, 5)]
    t = small.tables(
        spark,
        suppliers=[supplier(1), supplier(2), supplier(3)],
        supplier_products=[
            supplies(1, 1, is_preferred=True),
            supplies(2, 2, is_preferred=True),
            supplies(3, 2, is_preferred=False),
        ],
        inbound_orders=orders,
    )
    assert values(suppliers.misleading_suppliers(t), "supplier_id") == [(2,)]


def test_margin_and_activity_filters(spark):
    t = small.tables(
        spark,
        suppliers=[supplier(1), supplier(2, status="inactive")],
        products=[product(1, value=3), product(2, value=3), product(3, status="discontinued")],
        supplier_products=[
            supplies(1, 1, supply_price=8),
            supplies(1, 2, supply_price=0),
            supplies(1, 3, supply_price=1),
            supplies(2, 1, supply_price=1),
        ],
    )
    got = values(suppliers.supplier_products_detail(t), "supplier_id", "product_id", "profit_margin_percent")
    assert got == [(1, 1, -62.5), (1, 2, None)]
    assert suppliers.supplier_products_detail(t, 2).count() == 0


def test_month_report_bounds_credit_and_summary(spark):
    def got(number, when, kind="purchase", status="completed"):
        return inbound(number, 1, kind, status=status, quantity=10, received_time=when)

    t = small.tables(
        spark,
        suppliers=[supplier(1), supplier(2), supplier(3, status="inactive"), supplier(4)],
        supplier_products=[supplies(1, 1), supplies(2, 1), supplies(3, 1), supplies(4, 2)],
        inbound_orders=[
            got(1, "2025-11-01T00:00:00"),
            got(2, "2025-11-30T00:00:00", "return"),
            got(3, "2025-11-30T00:00:01"),
            got(4, "2025-11-15T00:00:00", status="receiving"),
            got(5, "2025-10-31T23:59:59"),
        ],
    )
    columns = ("supplier_id", "total_inbound", "return_count", "quality_score")
    report = suppliers.supplier_monthly_report(t, "2025-11", NOW)
    half = (Decimal("20.0000"), 1, Decimal("50.00"))
    assert values(report, *columns) == [(1, *half), (2, *half)]
    whole = suppliers.supplier_monthly_report(t, "2025-11", NOW, inclusive_end=True)
    assert values(whole, *columns)[0] == (1, Decimal("30.0000"), 1, Decimal("66.67"))
    assert values(suppliers.report_summary(report, "2025-11"), "message", "period", "summary") == [
        (None, "Month: 2025-11", "Records: 2")
    ]
    nothing = suppliers.supplier_monthly_report(t, "2024-01", NOW)
    line = suppliers.report_summary(nothing, "2024-01").first()
    assert line["message"] == "No data found for the specified period" and line["summary"] is None


def test_operations_count_a_shared_order_once(spark):
    t = small.tables(
        spark,
        warehouses=[warehouse(1)],
        employees=[person(1, 1), person(2, None), person(3, 1, employment_status="leave")],
        inbound_orders=[inbound(1, quantity=5), inbound(2, quantity=7)],
        outbound_orders=[
            outbound(1, quantity=3, picker=1, packer=1),
            outbound(2, quantity=4, picker=1, packer=2),
            outbound(3, quantity=9),
        ],
    )
    columns = ("employee_id", "total_outbound_operations", "total_inbound_quantity", "total_outbound_quantity")
    assert values(workforce.employee_operation_stats_exact(t), *columns) == [(1, 2, 12, 7), (2, 1, 0, 4)]
    assert values(workforce.employee_operation_stats(t, 1), *columns) == [(1, 2, 24, 14)]


def test_workforce_totals(spark):
    t = small.tables(
        spark,
        warehouses=[warehouse(1), warehouse(2)],
        employees=[person(1, 1), person(2, None), person(3, 1, department="system_admin", employment_status="leave")],
    )
    assert values(workforce.department_active_count(t), "department", "active_employees") == [
        ("Warehouse Ops", 2),
        ("System Admin", 0),
        ("TOTAL", 2),
    ]
    got = values(workforce.warehouse_employee_distribution(t), "warehouse_id", "total_employees", "admin_employees")
    assert got == [(1, 1, 0), (2, 0, 0)]
    assert values(workforce.employee_details(t), "employee_id", "warehouse_name") == [(1, "W1"), (2, None)]
    pairs = spark.createDataFrame([(1, 1), (1, 2), (2, 1), (3, 1), (9, 1)], "employee_id int, warehouse_id int")
    found = metrics.employee_in_warehouse(t["employees"], pairs).filter("is_in_warehouse")
    assert values(found, "employee_id", "warehouse_id") == [(1, 1)]


def test_sell_through_texts(spark):
    t = small.tables(
        spark,
        products=[product(1), product(2)],
        inbound_orders=[inbound(1, quantity=8, status="completed"), inbound(2, quantity=5)],
        outbound_orders=[
            outbound(1, quantity=1, status="shipped"),
            outbound(2, quantity=4, status="shipped", kind="transfer"),
            outbound(3, 2, quantity=4, status="shipped"),
        ],
    )
    ids = spark.createDataFrame([(1,), (2,), (7,)], "product_id int")
    got = values(metrics.sell_through_report(t, ids).orderBy("product_id"), "product_name", "sentence")
    nothing = "Sell-through rate: 0% (No inbound inventory - Inbound: 0.0000, Sales: {}.0000)"
    assert got == [
        ("P1", "Sell-through rate: 12.50% (Inbound: 8.0000, Sales: 1.0000)"),
        ("P2", nothing.format(4)),
        ("Unknown Product", nothing.format(0)),
    ]


@pytest.mark.parametrize("age, level", [(3, None), (5, None), (6, "warning"), (10, "warning"), (11, "critical")])
def test_inbound_alert_levels(spark, age, level):
    created = dt.datetime(2025, 12, 3, 23, 59) - dt.timedelta(days=age)
    rows = [inbound(1, kind="return", status=s, created_time=created) for s in ("receiving", "completed", "cancelled")]
    t = small.tables(spark, inbound_orders=[{**r, "inbound_id": i} for i, r in enumerate(rows, 1)])
    got = values(alerts.inbound_delay_alerts(t, NOW), "inbound_id", "alert_level", "reference_number", "delay_days")
    assert got == ([(1, level, "return-1", age)] if level else [])


def test_alert_reports(spark):
    old, older = "2025-11-29T08:00:00", "2025-11-25T08:00:00"
    t = small.tables(
        spark,
        warehouses=[warehouse(1)],
        outbound_orders=[
            outbound(4, created_time=older),
            outbound(2, created_time=older, status="packing"),
            outbound(3, created_time=old, status="picking"),
            outbound(5, created_time=older, status="shipped"),
        ],
    )
    report = values(alert_reports.outbound_delay_report(t, NOW), "outbound_id", "delay_days", "warehouse", "product", "message")
    assert report == [
        (2, 8, "W1", None, "critical: outbound order sales-2 delayed for 8 days. immediate action required!"),
        (4, 8, "W1", None, "critical: outbound order sales-4 delayed for 8 days. immediate action required!"),
        (3, 4, "W1", None, "warning: outbound order sales-3 delayed for 4 days."),
    ]
    assert values(alert_reports.delay_alert_summary(t, NOW), "direction", "total_alerts", "critical_alerts") == [
        ("outbound", 3, 2)
    ]
    assert values(alert_reports.worst_delay_alert(t, NOW), "order_id") == [(2,)]


def test_utilization_is_refreshed_where_lots_changed(spark):
    base = small.tables(
        spark,
        warehouses=[warehouse(1)],
        locations=[place(1, n, 100, 50) for n in "ABC"],
        products=[product(1, volume=2)],
        inventory=[lot(1, where="A", total=3), lot(2, where="B", total=4), lot(3, where=None)],
    )
    assert used(recalculate_utilization(base)) == {(1, "A"): 6, (1, "B"): 8, (1, "C"): 0}
    assert used(with_utilization(base)["locations"])[1, "B"] == 8
    new = small.table(spark, "inventory", [lot(1, where="A", total=3)])
    assert used(utilization_on_insert(base, new)) == {(1, "A"): 6, (1, "B"): 50, (1, "C"): 50}
    before = small.table(spark, "inventory", [lot(2, where="C")])
    after = small.table(spark, "inventory", [lot(2, where="B", total=4)])
    assert used(utilization_on_update(base, before, after)) == {(1, "A"): 50, (1, "B"): 8, (1, "C"): 0}
    assert used(utilization_on_delete(base, before)) == {(1, "A"): 50, (1, "B"): 50, (1, "C"): 0}
