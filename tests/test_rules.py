"""Audits, guards, ingest and deletes on small tables."""

from __future__ import annotations

from collections import ChainMap

import pytest
import small
from pyspark.sql import functions as F
from small import inbound, lot, outbound, person, place, product, warehouse

from stocklens import requests
from stocklens.functions import scale
from stocklens.operators import deletes, guards, ingest, rules
from stocklens.operators.alerts import INBOUND, delay_alerts
from stocklens.operators.ingest import ingest_batch
from stocklens.sources.schemas import TABLES
from stocklens.sources.sinks import append_rows
from stocklens.sources.star_mapping import star_tables
from stocklens.sources.tables import read_tables, write_tables

NOW = "2025-12-03"


def found(df):
    return {(r["table_name"], r["row_key"], r["rule"]) for r in df.collect()}


def test_keys_and_unique_values(spark):
    t = small.tables(
        spark,
        locations=[place(1, "A", 1), place(1, "A", 2), place(2, "A", 1), place(1, None, 1)],
        products=[product(1, product_sku="x"), product(2, product_sku="x"), product(3, product_sku=None), product(4, product_sku=None)],
    )
    assert found(rules.audit_primary_keys(t)) == {
        ("locations", "1/A", "key_repeated"),
        ("locations", "1/?", "key_missing"),
    }
    assert found(rules.audit_unique(t)) == {("products", "x", "product_sku_unique")}


def test_row_rules_fail_on_false_only(spark):
    t = small.tables(
        spark,
        locations=[place(1, "A", 0), place(1, "B", 5, 6), place(1, "C", 5, None)],
        employees=[person(1, 1, department="sales"), person(2, 1, employment_status=None, position="p" * 51)],
        inventory=[
            lot(1, total=5, locked=2) | {"available_quantity": 4},
            {"inventory_id": 2, "product_id": 1, "warehouse_id": 1, "total_quantity": None, "available_quantity": None},
            lot(3, total=1) | {"total_quantity": -1, "locked_quantity": -2, "available_quantity": 1},
        ],
        inbound_orders=[inbound(1) | {"operator": None, "expected_quantity": -1, "actual_quantity": None}],
    )
    assert found(rules.audit_not_null(t)) == {("inbound_orders", "1", "operator_required")}
    assert found(rules.audit_enums(t)) == {("employees", "1", "department_allowed")}
    assert found(rules.audit_lengths(t)) == {("employees", "2", "position_length")}
    assert found(rules.audit_checks(t)) == {
        ("locations", "1/A", "capacity_positive"),
        ("locations", "1/B", "utilization_within_capacity"),
        ("inventory", "1", "total_is_locked_plus_available"),
        ("inventory", "3", "total_not_negative"),
        ("inventory", "3", "locked_not_negative"),
        ("inbound_orders", "1", "expected_not_negative"),
    }


def test_foreign_keys_with_composite_self_and_alert_references(spark):
    t = small.tables(
        spark,
        warehouses=[warehouse(1), warehouse(1)],  # a repeated parent must not repeat its children
        locations=[place(1, "A", 1)],
        products=[product(1)],
        inventory=[
            lot(1),
            lot(2, where="B"),
            lot(3, where=None, parent_inventory_id=1),
            lot(4, site=2, parent_inventory_id=99),
        ],
        inbound_orders=[inbound(1, product_id=None, operator=5, created_time="2025-11-01T00:00:00")],
    )
    made = {"inbound_delay_alerts": delay_alerts(t["inbound_orders"], INBOUND, NOW)}
    gone = {**t, **made, "inbound_orders": t["inbound_orders"].limit(0)}
    assert found(rules.audit_foreign_keys({**t, **made})) == {
        ("inventory", "2", "warehouse_id_and_storage_location_in_locations"),
        ("inventory", "4", "warehouse_id_in_warehouses"),
        ("inventory", "4", "warehouse_id_and_storage_location_in_locations"),
        ("inventory", "4", "parent_inventory_id_in_inventory"),
        ("inbound_orders", "1", "operator_in_employees"),
    }
    assert ("inbound_delay_alerts", "1", "inbound_id_in_inbound_orders") in found(rules.audit_foreign_keys(gone))


def test_clean_tables_have_no_orphans(spark):
    t = small.tables(spark, warehouses=[warehouse(1)], locations=[place(1, "A", 5)], products=[product(1)], inventory=[lot(1)])
    audit = rules.audit_foreign_keys(t)
    assert audit.columns == ["table_name", "row_key", "rule"] and audit.count() == 0
    assert rules.orphan_keys(t).count() == 0
    # a key of two parts is not taken for another with the same letters
    t["locations"] = small.table(spark, "locations", [place(1, "1/A", 5), place(11, "A", 5)])
    assert found(rules.audit_foreign_keys(t)) == {
        ("inventory", "1", "warehouse_id_and_storage_location_in_locations"),
        ("locations", "11/A", "warehouse_id_in_warehouses"),
    }


def test_reference_counts():
    assert sum(len(t.references) for t in TABLES.values()) == 19
    assert sum(1 for t in TABLES.values() for c in t.columns if c.allowed) == 12


@pytest.mark.parametrize("rows_per_range", [200_000, 2])
def test_capacity_guard_in_order(spark, monkeypatch, rows_per_range):
    monkeypatch.setattr(scale, "ROWS_PER_RANGE", rows_per_range)
    t = small.tables(
        spark,
        locations=[place(1, "A", 10, 4), place(1, "B", 1, None)],
        products=[product(1, volume=0.5), product(2, volume=None)],
    )
    lots = [
        lot(1, total=8),  # 4 of the 6 left
        lot(2, total=5),  # 2.5 more do not fit
        lot(3, total=4),  # exactly full
        lot(4, total=1),
        lot(5, 2, total=999),  # no volume
        lot(6, where="Q", total=999),  # unknown place
        lot(7, where="B", total=999),  # unknown use
        lot(8, where=None, total=999),
    ]
    judged = guards.capacity_guard(t, small.table(spark, "inventory", lots))
    refused = sorted(r["inventory_id"] for r in judged.filter("rejection is not null").collect())
    assert refused == [2, 4]


def test_inbound_guard_null_cases(spark):
    t = small.tables(spark, employees=[person(1, 1), person(2, 2), person(3, None)])
    orders = [inbound(i, operator=p) for i, p in ((1, 1), (2, 2), (3, 3), (4, 99), (5, None))]
    judged = guards.inbound_operator_guard(t, small.table(spark, "inbound_orders", orders))
    assert [r["inbound_id"] for r in judged.filter("rejection is not null").collect()] == [2]


def test_ingest_fills_defaults_and_judges_in_order(spark, tmp_path):
    t = small.tables(
        spark,
        warehouses=[warehouse(1)],
        locations=[place(1, "A", 10)],
        products=[product(1)],
        inventory=[lot(1, total=0)],
    )
    schema = (
        "row_order bigint, inventory_id bigint, product_id int, warehouse_id int, "
        "storage_location string, total_quantity int, available_quantity int, parent_inventory_id bigint"
    )
    rows = [
        (1, 1, 1, 1, "A", 2, 2, None),  # key exists
        (2, 2, 1, 1, "A", 20, 20, None),  # no space, so the key stays free
        (3, 2, 1, 1, "A", 6, 6, None),
        (4, 2, 1, 1, "A", 1, 1, None),  # key taken now
        (5, 3, None, 1, "A", 2, 1, None),  # two rules broken
        (6, 4, 1, 1, "A", 4, 4, 2),  # exactly full, parent from this batch
        (7, 5, 1, 1, "Z", 1, 1, None),  # unknown place
        (8, 6, 1, 1, None, None, None, 77),  # unknown parent
    ]
    batch = spark.createDataFrame(rows, schema)
    done = ingest_batch(t, "inventory", batch, NOW, check_references=True)
    accepted = {r["inventory_id"]: r.asDict() for r in done.accepted.collect()}
    assert sorted(accepted) == [2, 4]
    assert accepted[2]["total_quantity"] == 6 and accepted[2]["unit"] == "pcs"
    assert accepted[2]["inventory_status"] == "normal" and accepted[2]["last_updated"] == small.NOW
    taken = "key_or_unique_value_taken_or_no_space"
    assert {r["row_order"]: r["violations"] for r in done.rejected.collect()} == {
        1: [taken],
        2: [taken],
        4: [taken],
        5: ["product_id_required", "total_is_locked_plus_available"],
        7: ["warehouse_id_and_storage_location_in_locations"],
        8: ["parent_inventory_id_in_inventory"],
    }
    write_tables({"inventory": t["inventory"]}, str(tmp_path))
    append_rows(done.accepted, f"{tmp_path}/inventory")
    stored = read_tables(spark, str(tmp_path), names=["inventory"])["inventory"]
    assert sorted(r["inventory_id"] for r in stored.collect()) == [1, 2, 4]
    loose = ingest_batch(t, "inventory", batch, NOW)
    assert sorted(r["inventory_id"] for r in loose.accepted.collect()) == [2, 4, 5, 6]


def test_ingest_unique_and_guarded_tables(spark):
    t = small.tables(spark, employees=[person(1, 1)])
    rows = [(1, 2, "E2"), (2, 3, "E1"), (3, 3, "E3"), (4, 4, "E2"), (5, 4, "E4")]
    batch = spark.createDataFrame(
        [(o, i, n, "N", "warehouse_ops") for o, i, n in rows],
        "row_order bigint, employee_id int, employee_number string, employee_name string, department string",
    )
    done = ingest_batch(t, "employees", batch, NOW)
    got = {(r["employee_id"], r["employee_number"]) for r in done.accepted.collect()}
    assert got == {(2, "E2"), (3, "E3"), (4, "E4")}
    orders = small.table(spark, "inbound_orders", [inbound(1), inbound(2, site=2)]).selectExpr("inbound_id as row_order", "*")
    assert [r[0] for r in ingest_batch(t, "inbound_orders", orders, NOW).accepted.collect()] == [1]


def test_deletes_cascade_null_and_restrict(spark):
    t = small.tables(
        spark,
        warehouses=[warehouse(1), warehouse(2)],
        locations=[place(1, "A", 1), place(2, "A", 1)],
        products=[product(1), product(2)],
        employees=[person(1, 1), person(2, 2), person(3, 2), person(4, 2)],
        inventory=[lot(1), lot(2, site=2), lot(3, site=2, parent_inventory_id=1), lot(4, 2, site=2)],
        inbound_orders=[inbound(1), inbound(2, site=2, operator=2)],
        outbound_orders=[outbound(1, site=2, picker=3, packer=2)],
        inventory_adjustments=[
            {"adjustment_id": i, "adjustment_type": "count", "warehouse_id": 2, "product_id": 1, "inventory_id": i, "operator": 4}
            for i in (1, 2)
        ],
    )

    def gone(name, *keys):
        return t[name].filter(t[name][TABLES[name].key[0]].isin(*keys))

    kept, refused = deletes.delete_rows(
        t, {"warehouses": gone("warehouses", 1), "products": gone("products", 2), "employees": gone("employees", 2, 3, 4)}
    )

    def ids(name, *columns):
        return sorted(tuple(r[c] for c in columns) for r in kept[name].collect())

    assert sorted(r[0] for r in refused["employees"].collect()) == [2, 4]
    assert ids("locations", "warehouse_id") == [(2,)]
    assert ids("products", "product_id") == [(1,)]
    assert [(r["inventory_id"], r["parent_inventory_id"]) for r in kept["inventory"].orderBy("inventory_id").collect()] == [
        (2, None),
        (3, None),
    ]
    assert ids("inbound_orders", "inbound_id") == [(2,)]
    assert ids("outbound_orders", "packer") == [(2,)]
    assert kept["outbound_orders"].first()["picker"] is None
    assert ids("inventory_adjustments", "adjustment_id") == [(2,)]
    assert {r["employee_id"]: r["warehouse_id"] for r in kept["employees"].collect()} == {1: None, 2: 2, 4: 2}


def test_rename_location_reaches_its_lots(spark):
    t = small.tables(
        spark, locations=[place(1, "A", 1), place(2, "A", 1)], inventory=[lot(1), lot(2, site=2), lot(3, where=None)]
    )
    renames = spark.createDataFrame([(1, "A", "Z")], "warehouse_id int, location string, new_location string")
    after = deletes.cascade_rename_location(t, renames)
    assert {(r[0], r[1]) for r in after["locations"].select("warehouse_id", "location").collect()} == {(1, "Z"), (2, "A")}
    got = {r["inventory_id"]: r["storage_location"] for r in after["inventory"].collect()}
    assert got == {1: "Z", 2: "A", 3: None}


def test_rename_may_not_take_a_name_in_use(spark):
    t = small.tables(spark, warehouses=[warehouse(1)], locations=[place(1, n, 10) for n in "ABC"])
    schema = "warehouse_id int, location string, new_location string"
    for renames in ([(1, "A", "B")], [(1, "A", "X"), (1, "B", "X")]):
        with pytest.raises(ValueError, match="would be named"):
            deletes.cascade_rename_location(t, spark.createDataFrame(renames, schema))
    with pytest.raises(ValueError, match="two new names"):
        deletes.cascade_rename_location(t, spark.createDataFrame([(1, "A", "X"), (1, "A", "Y")], schema))
    swapped = deletes.cascade_rename_location(t, spark.createDataFrame([(1, "A", "B"), (1, "B", "A"), (1, "A", "B")], schema))
    assert sorted(r["location"] for r in swapped["locations"].collect()) == ["A", "B", "C"]


def test_repeated_keys_do_not_repeat_rows(spark):
    t = small.tables(spark, warehouses=[warehouse(1)], employees=[person(1, 1)])
    gone = spark.createDataFrame([(1,), (1,)], "warehouse_id int")
    assert deletes.null_on_delete(t, {"warehouses": gone})["employees"].count() == 1


def test_deleted_lots_free_their_place(spark):
    t = small.tables(
        spark,
        warehouses=[warehouse(1)],
        locations=[place(1, "A", 50, 30), place(1, "B", 50, 7)],
        products=[product(1), product(2)],
        inventory=[lot(1, 1, total=10), lot(2, 2, total=20), lot(3, 2, where="B", total=7)],
    )
    gone = spark.createDataFrame([(1,)], "product_id int")
    left = deletes.cascade_delete(t, {"products": gone})["locations"]
    assert {r["location"]: float(r["utilization"]) for r in left.collect()} == {"A": 20.0, "B": 7.0}


def test_ingest_refuses_incomplete_keys(spark):
    t = small.tables(spark)
    rows = [(1, None, 1), (2, 1, None), (3, 1, 1)]
    batch = spark.createDataFrame(rows, "row_order bigint, supplier_id int, product_id int")
    done = ingest_batch(t, "supplier_products", batch, NOW)
    refused = {r["row_order"]: r["violations"] for r in done.rejected.collect()}
    assert "supplier_id_required" in refused[1] and "product_id_required" in refused[2]
    assert rules.audit_primary_keys({**t, "supplier_products": done.accepted}).count() == 0



def test_keys_are_counted_in_as_many_tasks_as_they_need(spark, monkeypatch):
    spread = []

    def noted(df, columns, *rest):
        spread.append(columns)
        return repartition(df, columns, *rest)

    kind = type(spark.range(1))
    repartition = kind.repartition
    rows = [(i // 2 if i < 4 else None if i < 7 else i, f"name {i}") for i in range(100)]
    staff = spark.createDataFrame(rows, "employee_id int, employee_name string")
    monkeypatch.setattr(rules, "KEYS_PER_TASK", 10)
    monkeypatch.setattr(kind, "repartition", noted)
    found = rules.audit_primary_keys({"employees": staff})
    assert spread == [10]
    assert {tuple(r)[1:] for r in found.collect()} == {("0", "key_repeated", 2), ("1", "key_repeated", 2), ("?", "key_missing", 3)}


def test_rows_of_a_batch_do_not_meet_the_stored_keys(spark, data, monkeypatch):
    landed_columns = []

    def noted(df, order):
        landed_columns.extend(df.columns)
        return scale.in_ranges(df, order)

    monkeypatch.setattr(ingest, "in_ranges", noted)
    stored, batch = requests.redelivered_inbound(star_tables(spark, data))
    ingest.ingest_batch(stored, "inbound_orders", batch, "2001-08-01 00:00:00")
    assert not [c for c in landed_columns if c.startswith("_taken")]


def test_whole_number_keys_are_met_as_numbers_and_others_as_text(spark):
    t = small.tables(spark, products=[product(7), product(8)], warehouses=[warehouse(1)], inventory=[lot(1, 7)])
    places = rules._places(t)
    assert places["products.product_id"][1] and not places["locations.warehouse_id/location"][1]
    asked = F.when(F.col("inventory_id") == 1, "9").otherwise("7")
    t = ChainMap({"inventory": t["inventory"].withColumn("product_id", asked)}, t)
    assert not rules._places(t)["products.product_id"][1]
    assert ("inventory", "1", "product_id_in_products") in found(rules.audit_foreign_keys(t))
    t = ChainMap({"inventory": t["inventory"].withColumn("product_id", F.lit("7"))}, t)
    assert ("inventory", "1", "product_id_in_products") not in found(rules.audit_foreign_keys(t))
