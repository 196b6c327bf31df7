"""Commands against a sequential simulation, their invariants, and their refusals."""

from __future__ import annotations

import random

import pytest
import small
from pyspark.sql import functions as F
from small import inbound, lot, outbound, person, place, product, warehouse

from stocklens import requests
from stocklens.functions import scale
from stocklens.functions.metrics import location_utilization
from stocklens.operators import admission, commands
from stocklens.operators.utilization import with_utilization
from stocklens.sources.star_mapping import star_tables

AS_OF = "2025-12-03"
SPLITS = (
    "request_id bigint, source_id bigint, quantity int, operator_id int, "
    "target_warehouse int, target_location string"
)
RECEIPTS = "request_id bigint, inbound_id bigint, actual_quantity int, location string"
SHIPMENTS = "request_id bigint, inventory_id bigint, outbound_id bigint"


@pytest.fixture(params=[200_000, 15], ids=["one-range", "many-ranges"])
def ranges(request, monkeypatch):
    monkeypatch.setattr(scale, "ROWS_PER_RANGE", request.param)


def by_id(df, key):
    return {r[key]: r.asDict() for r in df.collect()}


def site(spark, **more):
    rng = random.Random(5)
    return small.tables(
        spark,
        warehouses=[warehouse(1), warehouse(2)],
        locations=[place(w, n, 40 + 10 * i) for w in (1, 2) for i, n in enumerate("ABC")],
        products=[product(i, volume=v) for i, v in ((1, 1), (2, 2), (3, 0.5), (4, None))],
        employees=[person(1, 1), person(2, 2), person(3, None)],
        inventory=[
            lot(i, rng.randint(1, 4), rng.randint(1, 2), rng.choice("ABC"), rng.randint(2, 14), rng.randint(0, 2))
            for i in range(1, 13)
        ],
        **more,
    )


def simulate_splits(tables, requests):
    """One request after the other, straight from the rules."""
    lots = by_id(tables["inventory"], "inventory_id")
    places = {(r["warehouse_id"], r["location"]): r.asDict() for r in tables["locations"].collect()}
    used = {k: p["utilization"] for k, p in places.items()}
    volume = {r["product_id"]: r["volume"] for r in tables["products"].collect()}
    staff = {r["employee_id"] for r in tables["employees"].collect()}
    next_lot = max(lots) + 1
    log, verdicts, made = [], {}, {}
    for request, source, quantity, operator, target, where, *earlier in sorted(requests, key=lambda r: r[0]):
        verdicts[request] = False
        source = made.get(earlier[0]) if earlier and earlier[0] is not None else source
        old = lots.get(source)
        if old is None or quantity is None or quantity < 0 or operator not in staff | {None}:
            continue
        if target not in (1, 2) or (where is not None and (target, where) not in places):
            continue
        if quantity > old["available_quantity"]:
            continue
        size = (volume[old["product_id"]] or 0) * quantity
        here = (old["warehouse_id"], old["storage_location"])
        after = dict(used)
        if here in after:
            after[here] -= size
        if where is not None:
            full = after[target, where] + size > places[target, where]["capacity"]
            if full and volume[old["product_id"]] is not None:
                continue
            after[target, where] += size
        used = after
        verdicts[request] = True
        before = old["total_quantity"]
        old["total_quantity"] -= quantity
        old["available_quantity"] -= quantity
        made[request] = next_lot
        lots[next_lot] = {
            "product_id": old["product_id"],
            "warehouse_id": target,
            "storage_location": where,
            "total_quantity": quantity,
            "available_quantity": quantity,
            "parent_inventory_id": source,
        }
        log.append((next_lot, 0, quantity, f"split from {source}"))
        log.append((source, before, before - quantity, f"split to {next_lot}"))
        next_lot += 1
    return verdicts, lots, log


def split_requests():
    rng = random.Random(11)
    rows = []
    for i in range(90):
        where = rng.choice(["A", "B", "C", "C", None, "nowhere" if rng.random() < 0.2 else "A"])
        source = rng.randint(1, 13) if rng.random() < 0.7 else 3  # lot 3 is asked for most
        quantity = rng.choice([0, 1, 1, 2, 3, 5, -1, None])
        rows.append((i * 2, source, quantity, rng.choice([1, 2, None, 9]), rng.choice([1, 2, 2, 7]), where))
    return rows


def test_splits_equal_the_sequential_run(spark, ranges):
    tables, requests = with_utilization(site(spark)), split_requests()
    outcome = commands.split_inventory(tables, spark.createDataFrame(requests, SPLITS), AS_OF)
    verdicts, lots, log = simulate_splits(tables, requests)
    assert {r["request_id"]: r["accepted"] for r in outcome.results.collect()} == verdicts
    assert any(verdicts.values()) and not all(verdicts.values())
    state = by_id(outcome.tables["inventory"], "inventory_id")
    assert {k: (v["total_quantity"], v["available_quantity"]) for k, v in state.items()} == {
        k: (v["total_quantity"], v["available_quantity"]) for k, v in lots.items()
    }
    columns = ["inventory_id", "before_quantity", "after_quantity", "adjustment_reason"]
    added = outcome.added["inventory_adjustments"].orderBy("adjustment_id")
    assert [tuple(r) for r in added.select(*columns).collect()] == log
    ids = [r[0] for r in added.select("adjustment_id").collect()]
    assert ids == list(range(1, len(log) + 1))


CHAINED = f"{SPLITS}, source_request bigint"


def chained_requests(seed, count=140):
    """Splits of stored lots, of parts of them, of parts of parts, and of what never was."""
    rng = random.Random(seed)
    rows = []
    for i in range(count):
        earlier = rng.choice([None, 2 * rng.randrange(i + 1) - 2 if i else None, 2 * i - 2, 2 * i + 2 if rng.random() < 0.1 else None])
        where = rng.choice(["A", "B", "C", "C", None, "nowhere" if rng.random() < 0.1 else "A"])
        quantity = rng.choice([0, 1, 1, 1, 2, 3, -1 if rng.random() < 0.3 else 2, None if rng.random() < 0.2 else 1])
        source = rng.choice([*range(1, 13), 99]) if earlier is None else None
        rows.append((2 * i, source, quantity, rng.choice([1, 2, None]), rng.choice([1, 2, 2, 2]), where, earlier))
    return rows


@pytest.mark.parametrize("first", [1, 1 << 61], ids=["whole-numbers", "too-large"])
def test_splits_ask_only_for_what_can_be_refused(spark, monkeypatch, first):
    asked = []

    def admit(demands, single=False):
        asked.extend(demands.collect())
        return kept(demands, single)

    kept = commands.admit
    monkeypatch.setattr(commands, "admit", admit)
    tables = with_utilization(
        small.tables(
            spark,
            warehouses=[warehouse(1)],
            locations=[place(1, "A", 100), place(1, "B", 100), place(1, "C", 7)],
            products=[product(1)],
            employees=[person(1, 1)],
            inventory=[lot(1, where="A", total=40), lot(2, where="B", total=40)],
        )
    )
    rows = [
        (first, 1, 20, 1, 1, "B", None),
        (first + 1, None, 5, 1, 1, "C", first),
        (first + 2, None, 3, 1, 1, "C", first),  # C is full
        (first + 3, 2, 10, 1, 1, "A", None),
        (first + 4, None, 9, 1, 1, "B", first + 9),  # no such request
    ]
    outcome = commands.split_inventory(tables, spark.createDataFrame(rows, CHAINED), AS_OF)
    results = by_id(outcome.results, "request_id")
    assert [results[first + i]["accepted"] for i in range(5)] == [True, True, False, True, False]
    # the first makes what two others take and put at C; nothing can be refused at A or B, or of what no one takes
    per_request = {i: [r for r in asked if r["request_id"] == first + i] for i in range(5)}
    assert [len(per_request[i]) for i in range(5)] == [1, 2, 2, 0, 0]
    assert len({r["resource"] for r in asked}) == 2
    assert all(sum(r["_head"] for r in found) == 1 for found in per_request.values() if found)


def test_space_after_splits_needs_no_running_sums(spark):
    tables, requests = with_utilization(site(spark)), chained_requests(1)
    outcome = commands.split_inventory(tables, spark.createDataFrame(requests, CHAINED), AS_OF)
    plan = outcome.tables["locations"]._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" in plan and "REPARTITION_BY_COL" not in plan
    used = location_utilization(outcome.tables)
    keys = ["warehouse_id", "location"]
    stored = {tuple(r) for r in outcome.tables["locations"].select(*keys, F.col("utilization").cast("decimal(22,4)")).collect()}
    assert stored == {tuple(r) for r in used.select(*keys, "utilization").collect()}


@pytest.mark.parametrize("seed, at_once, per_range", [(1, 50_000, 200_000), (2, 0, 40)], ids=["at-once", "by-component"])
def test_splits_of_lots_made_in_the_batch(spark, monkeypatch, seed, at_once, per_range):
    monkeypatch.setattr(admission, "AT_ONCE", at_once)
    monkeypatch.setattr(scale, "ROWS_PER_RANGE", per_range)
    tables, requests = with_utilization(site(spark)), chained_requests(seed)
    outcome = commands.split_inventory(tables, spark.createDataFrame(requests, CHAINED), AS_OF)
    verdicts, lots, log = simulate_splits(tables, requests)
    results = by_id(outcome.results, "request_id")
    assert {i: r["accepted"] for i, r in results.items()} == verdicts
    accepted_parts = [r for r in requests if r[6] is not None and verdicts[r[0]]]
    assert len(accepted_parts) > 10
    names = ["total_quantity", "available_quantity", "warehouse_id", "storage_location", "product_id", "parent_inventory_id"]
    state = by_id(outcome.tables["inventory"], "inventory_id")
    assert {k: [v[n] for n in names] for k, v in state.items()} == {
        k: [v.get(n) for n in names] for k, v in lots.items()
    }
    columns = ["inventory_id", "before_quantity", "after_quantity", "adjustment_reason"]
    added = outcome.added["inventory_adjustments"].orderBy("adjustment_id")
    assert [tuple(r) for r in added.select(*columns).collect()] == log
    made = {i: r["new_inventory_id"] for i, r in results.items() if r["accepted"]}
    for request in requests:
        result, earlier = results[request[0]], request[6]
        if result["accepted"]:
            assert result["source_id"] == (made[earlier] if earlier is not None else request[1])
        elif earlier is not None and earlier not in made:
            assert result["reason"] == commands.NO_SOURCE
    assert_space(outcome.tables)


def test_a_part_of_a_part_equals_two_calls(spark):
    tables = with_utilization(site(spark))
    batch = [(1, 3, 2, 1, 2, "C", None), (2, None, 1, 1, 1, "A", 1), (3, None, 1, 1, 1, "A", 7), (4, None, 0, 1, 1, "A", 4)]
    once = commands.split_inventory(tables, spark.createDataFrame(batch, CHAINED), AS_OF)
    first = commands.split_inventory(tables, spark.createDataFrame([batch[0][:6]], SPLITS), AS_OF)
    new_lot = first.results.collect()[0]["new_inventory_id"]
    second = commands.split_inventory(
        first.tables, spark.createDataFrame([(2, new_lot, 1, 1, 1, "A")], SPLITS), AS_OF
    )
    for name in ("inventory", "inventory_adjustments", "locations"):
        assert sorted(once.tables[name].collect()) == sorted(second.tables[name].collect())
    reasons = {r["request_id"]: r["reason"] for r in once.results.collect()}
    assert reasons == {1: None, 2: None, 3: commands.NO_SOURCE, 4: commands.NO_SOURCE}


def test_deep_split_trees_take_few_rounds(spark, monkeypatch):
    tables = with_utilization(small.tables(
        spark,
        warehouses=[warehouse(1)],
        locations=[place(1, n, 5_000) for n in "AB"],
        products=[product(1)],
        employees=[person(1, 1)],
        inventory=[lot(1, where="A", total=300)],
    ))
    rows = [(i, 1 if i == 0 else None, 300 - i, 1, 1, "AB"[i % 2], i - 1 if i else None) for i in range(200)]
    landings = []
    land = commands.landed
    monkeypatch.setattr(commands, "landed", lambda df, *name: landings.append(name) or land(df, *name))
    outcome = commands.split_inventory(tables, spark.createDataFrame(rows, CHAINED), AS_OF)
    assert outcome.results.filter("accepted").count() == 200
    assert landings.count(("hops",)) <= 9
    left = by_id(outcome.tables["inventory"], "inventory_id")
    assert sum(v["total_quantity"] for v in left.values()) == 300
    assert left[201]["total_quantity"] == 101 and left[200]["total_quantity"] == 1


def assert_space(tables):
    """Stored space use is that of the lots."""
    stored = {(r["warehouse_id"], r["location"]): float(r["utilization"]) for r in tables["locations"].collect()}
    found = {(r["warehouse_id"], r["location"]): float(r["utilization"]) for r in with_utilization(tables)["locations"].collect()}
    assert stored == found


def test_split_invariants(spark, ranges):
    tables = with_utilization(site(spark))
    requests = spark.createDataFrame(split_requests(), SPLITS)
    outcome = commands.split_inventory(tables, requests, AS_OF)
    total = F.sum("total_quantity")
    assert outcome.tables["inventory"].agg(total).first() == tables["inventory"].agg(total).first()
    broken = "total_quantity <> locked_quantity + available_quantity or available_quantity < 0"
    assert outcome.tables["inventory"].filter(broken).count() == 0
    assert outcome.added["inventory_adjustments"].filter(
        "quantity_change <> after_quantity - before_quantity"
    ).count() == 0
    full = tables["locations"].filter("utilization > capacity").select("warehouse_id", "location")
    now = location_utilization(outcome.tables).withColumnRenamed("utilization", "now")
    over = tables["locations"].join(now, ["warehouse_id", "location"]).filter("now > capacity")
    assert over.join(full, ["warehouse_id", "location"], "left_anti").count() == 0


def test_split_keeps_or_inherits_status(spark):
    tables = small.tables(
        spark,
        warehouses=[warehouse(1)],
        locations=[place(1, "A", 100)],
        products=[product(1)],
        inventory=[lot(1, inventory_status="hold", unit="box", expiry_date="2026-01-01")],
    )
    asked = spark.createDataFrame([(1, 1, 4, None, 1, "A"), (2, 1, 4, None, -1, "A")], SPLITS)
    for inherit, status in ((False, "normal"), (True, "hold")):
        outcome = commands.split_inventory(tables, asked, AS_OF, inherit_status=inherit)
        new = small.dicts(outcome.added["inventory"])
        assert [(n["inventory_status"], n["unit"], n["parent_inventory_id"]) for n in new] == [(status, "box", 1)]
        reasons = {r["request_id"]: r["reason"] for r in outcome.results.collect()}
        assert reasons == {1: None, 2: "dropping a lot is a write-off request"}


def test_receipts_equal_the_sequential_run(spark, ranges):
    rng = random.Random(3)
    orders = [inbound(i, rng.choice([1, 2, 3, 4, None]), site=rng.randint(1, 2)) for i in range(1, 41)]
    tables = with_utilization(site(spark, inbound_orders=orders))
    requests = [
        (i, rng.randint(1, 42), rng.choice([1, 2, 5, 9, -1, None]), rng.choice(["A", "B", "B", None, "Q"]))
        for i in range(80)
    ]
    outcome = commands.complete_inbound(tables, spark.createDataFrame(requests, RECEIPTS), AS_OF)

    places = {(r["warehouse_id"], r["location"]): r.asDict() for r in tables["locations"].collect()}
    volume = {1: 1, 2: 2, 3: 0.5, 4: None}
    by_order = {o["inbound_id"]: o for o in orders}
    used = {k: float(p["utilization"]) for k, p in places.items()}
    want, last, next_lot = {}, {}, 13
    for request, order_id, quantity, where in requests:
        want[request] = None
        order = by_order.get(order_id)
        if order is None or quantity is None or quantity < 0 or order["product_id"] is None:
            continue
        key = (order["warehouse_id"], where)
        if where is not None and key not in places:
            continue
        size = volume[order["product_id"]]
        if where is not None and size is not None:
            if used[key] + size * quantity > places[key]["capacity"]:
                continue
            used[key] += size * quantity
        want[request], last[order_id] = next_lot, quantity
        next_lot += 1
    assert {r["request_id"]: r["new_inventory_id"] for r in outcome.results.collect()} == want
    state = by_id(outcome.tables["inbound_orders"], "inbound_id")
    for order_id, row in state.items():
        if order_id in last:
            assert (row["status"], row["actual_quantity"]) == ("completed", last[order_id])
            assert row["received_time"] == small.NOW
        else:
            assert row["status"] == "pending" and row["received_time"] is None
    new = by_id(outcome.added["inventory"], "inventory_id")
    assert all(n["unit"] == "pcs" and n["inventory_status"] == "normal" for n in new.values())
    assert all(n["locked_quantity"] == 0 and n["total_quantity"] == n["available_quantity"] for n in new.values())


def test_strict_receipt_closes_an_order_once(spark):
    orders = [inbound(1), inbound(2, status="completed"), inbound(3, status="cancelled")]
    tables = with_utilization(site(spark, inbound_orders=orders))
    requests = [(1, 1, 5, None), (2, 1, 5, None), (3, 2, 1, None), (4, 3, 1, None)]
    df = spark.createDataFrame(requests, RECEIPTS)
    strict = commands.complete_inbound(tables, df, AS_OF, strict=True).results
    assert {r["request_id"]: r["accepted"] for r in strict.collect()} == {1: True, 2: False, 3: False, 4: False}
    lax = commands.complete_inbound(tables, df, AS_OF).results
    assert all(r["accepted"] for r in lax.collect())


def test_shipments_equal_the_sequential_run(spark, ranges):
    rng = random.Random(9)
    orders = [outbound(i, quantity=rng.choice([1, 2, 3, 6, None])) for i in range(1, 61)]
    tables = site(spark, outbound_orders=orders)
    requests = [(i, 4 if rng.random() < 0.5 else rng.randint(1, 13), rng.randint(1, 62)) for i in range(70)]
    outcome = commands.complete_outbound(tables, spark.createDataFrame(requests, SHIPMENTS), AS_OF)
    lots = by_id(tables["inventory"], "inventory_id")
    amount = {o["outbound_id"]: o["total_quantity"] for o in orders}
    want, shipped = {}, set()
    for request, lot_id, order_id in requests:
        quantity = amount.get(order_id)
        ok = lot_id in lots and quantity is not None and quantity <= lots[lot_id]["available_quantity"]
        want[request] = ok
        if ok:
            lots[lot_id]["available_quantity"] -= quantity
            lots[lot_id]["total_quantity"] -= quantity
            shipped.add(order_id)
    assert {r["request_id"]: r["accepted"] for r in outcome.results.collect()} == want
    state = by_id(outcome.tables["inventory"], "inventory_id")
    for key, row in lots.items():
        assert state[key]["available_quantity"] == row["available_quantity"]
        assert state[key]["total_quantity"] == row["total_quantity"]
    after = by_id(outcome.tables["outbound_orders"], "outbound_id")
    assert {k for k, v in after.items() if v["status"] == "shipped"} == shipped


def test_strict_shipment_checks_order_and_lot(spark):
    orders = [
        outbound(1, product_id=1, site=1, quantity=1),
        outbound(2, product_id=2, site=1, quantity=1),
        outbound(3, product_id=1, site=2, quantity=1),
        outbound(4, product_id=1, site=1, quantity=1, status="shipped"),
    ]
    tables = small.tables(spark, outbound_orders=orders, inventory=[lot(1)])
    rows = [(i, 1, i) for i in range(1, 5)] + [(5, 1, 1)]
    strict = commands.complete_outbound(tables, spark.createDataFrame(rows, SHIPMENTS), AS_OF, strict=True)
    assert [r["request_id"] for r in strict.results.filter("accepted").collect()] == [1]


def test_write_off_empties_the_lot_once(spark):
    tables = small.tables(
        spark,
        employees=[person(1, 1)],
        inventory=[lot(1, total=10, locked=3), lot(2)],
        inventory_adjustments=[
            {"adjustment_id": 7, "adjustment_type": "count", "warehouse_id": 1, "product_id": 1, "inventory_id": 1}
        ],
    )
    rows = [(5, 1, 1), (2, 1, None), (3, 9, 1), (4, 2, 99)]
    requests = spark.createDataFrame(rows, "request_id bigint, inventory_id bigint, operator_id int")
    outcome = commands.write_off_lots(tables, requests, AS_OF)
    log = outcome.added["inventory_adjustments"].orderBy("adjustment_id").collect()
    assert [(r["adjustment_id"], r["before_quantity"], r["after_quantity"], r["quantity_change"]) for r in log] == [
        (8, 10, 0, -10),
        (9, 0, 0, 0),
    ]
    assert {r["adjustment_type"] for r in log} == {"write_off"}
    state = by_id(outcome.tables["inventory"], "inventory_id")
    assert [state[1][c] for c in ("total_quantity", "locked_quantity", "available_quantity")] == [0, 0, 0]
    assert state[2]["total_quantity"] == 10
    reasons = {r["request_id"]: r["reason"] for r in outcome.results.collect()}
    assert reasons == {2: None, 5: None, 3: "lot not found", 4: "operator not found"}


def test_new_orders_are_numbered_in_request_order(spark, ranges):
    tables = small.tables(
        spark,
        warehouses=[warehouse(1)],
        products=[product(1)],
        employees=[person(1, 1), person(2, 2), person(3, None)],
    )
    schema = (
        "request_id bigint, inbound_type string, product_id int, warehouse_id int, "
        "expected_quantity int, total_items int, operator int, notes string"
    )
    rows = [
        (i, "purchase" if i != 4 else "gift", 1 if i != 6 else 8, 1 if i != 8 else 5, -1 if i == 10 else 3, 1,
         {12: 2, 14: 3, 16: 99}.get(i, 1), None)
        for i in range(40, 0, -2)
    ]
    outcome = commands.create_inbound_orders(tables, spark.createDataFrame(rows, schema), AS_OF)
    results = by_id(outcome.results, "request_id")
    refused = {k: v["reason"] for k, v in results.items() if not v["accepted"]}
    assert refused == {
        4: "unknown order type",
        6: "product not found",
        8: "warehouse not found",
        10: "expected quantity is negative",
        12: "Error: Operator does not belong to this warehouse",
        16: "operator not found",
    }
    accepted = sorted(k for k, v in results.items() if v["accepted"])
    assert [results[k]["inbound_id"] for k in accepted] == list(range(1, len(accepted) + 1))
    assert {r["status"] for r in outcome.added["inbound_orders"].collect()} == {"pending"}


def test_outbound_guard_with_unknown_people(spark):
    tables = small.tables(
        spark, warehouses=[warehouse(1)], products=[product(1)], employees=[person(1, 1), person(2, 2), person(3, None)]
    )
    schema = (
        "request_id bigint, outbound_type string, product_id int, warehouse_id int, "
        "total_items int, total_quantity int, picker int, packer int"
    )
    people = {1: (1, 1), 2: (1, None), 3: (None, None), 4: (3, 1), 5: (2, None), 6: (None, 2), 7: (3, 2), 8: (1, 9)}
    rows = [(k, "sales", 1, 1, 1, 1, a, b) for k, (a, b) in people.items()]
    outcome = commands.create_outbound_orders(tables, spark.createDataFrame(rows, schema), AS_OF)
    assert sorted(r["request_id"] for r in outcome.results.filter("accepted").collect()) == [1, 2, 3, 4]


def test_status_changes_name_old_and_new(spark, ranges):
    tables = small.tables(spark, employees=[person(1, 1), person(2, 1, employment_status="leave")])
    rows = [(i, 1, ["leave", "terminated", "active"][i % 3]) for i in range(30)]
    rows += [(100, 2, "active"), (101, 9, "active"), (102, 2, "retired"), (103, 2, None)]
    requests = spark.createDataFrame(rows, "request_id bigint, employee_id int, new_status string")
    outcome = commands.update_employee_status(tables, requests)
    said = {r["request_id"]: r["message"] for r in outcome.results.collect()}
    assert said[0] == "Change employee status form active to leave"
    for i in range(1, 30):
        assert said[i] == f"Change employee status form {rows[i - 1][2]} to {rows[i][2]}"
    assert said[100] == "Change employee status form leave to active"
    assert said[101] == "Error: Employee does not exist"
    assert said[102] == said[103] == "unknown status"
    state = by_id(outcome.tables["employees"], "employee_id")
    assert (state[1]["employment_status"], state[2]["employment_status"]) == ("active", "active")


def test_chained_receipts_do_not_overfill(spark):
    t = small.tables(
        spark,
        warehouses=[warehouse(1)],
        locations=[place(1, "A", 10)],
        products=[product(1)],
        employees=[person(1, 1)],
        inbound_orders=[inbound(1, quantity=8), inbound(2, quantity=8)],
    )
    once = commands.complete_inbound(t, spark.createDataFrame([(1, 1, 8, "A")], RECEIPTS), AS_OF)
    assert [float(r["utilization"]) for r in once.tables["locations"].collect()] == [8.0]
    again = commands.complete_inbound(once.tables, spark.createDataFrame([(2, 2, 8, "A")], RECEIPTS), AS_OF)
    assert [r["accepted"] for r in again.results.collect()] == [False]
    assert [float(r["utilization"]) for r in again.tables["locations"].collect()] == [8.0]


def test_split_moves_space_between_places(spark):
    t = small.tables(
        spark,
        warehouses=[warehouse(1)],
        locations=[place(1, "A", 20, 10), place(1, "B", 7, 3)],
        products=[product(1)],
        employees=[person(1, 1)],
        inventory=[lot(1, total=10), lot(2, where="B", total=3)],
    )
    asked = [(1, 1, 4, 1, 1, "B"), (2, 1, 1, 1, 1, "B"), (3, 2, 2, 1, 1, "A"), (4, 1, 2, 1, 1, "B")]
    done = commands.split_inventory(t, spark.createDataFrame(asked, SPLITS), AS_OF)
    verdicts = {r["request_id"]: r["accepted"] for r in done.results.collect()}
    assert verdicts == {1: True, 2: False, 3: True, 4: True}
    space = {r["location"]: float(r["utilization"]) for r in done.tables["locations"].collect()}
    assert space == {"A": 6.0, "B": 7.0}



def test_requests_are_landed_without_what_only_reasons_look_at(spark, data, monkeypatch):
    landed_columns = []

    def noted(df, order):
        landed_columns.append(set(df.columns))
        return scale.in_ranges(df, order)

    monkeypatch.setattr(commands, "in_ranges", noted)
    t = star_tables(spark, data)
    commands.complete_inbound(t, requests.receive_open_orders(t), AS_OF)
    commands.complete_outbound(t, requests.ship_open_orders(t), AS_OF)
    assert not {"_status", "_order_product", "_lot_site", "_product", "_site", "_place"} & set.union(*landed_columns)
