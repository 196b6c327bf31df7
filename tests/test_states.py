"""State that commands, deliveries and feeds leave behind: alerts, several tables, due orders, lots."""

from __future__ import annotations

import random

import pytest
import small
from pyspark.sql import functions as F
from small import inbound, lot, outbound, person, place, product, warehouse

from stocklens.catalog import catalog
from stocklens.functions.metrics import location_utilization
from stocklens.operators import alerts, commands
from stocklens.operators.ingest import ingest_tables
from stocklens.operators.utilization import with_utilization
from stocklens.sources import schemas
from stocklens.streaming import due_orders
from stocklens.streaming import lots as lot_stream

NOW = "2025-12-03"


def rows(df):
    return sorted(tuple(map(str, r)) for r in df.select(*sorted(df.columns)).collect())


def days_ago(days):
    return f"2025-{'11' if days > 2 else '12'}-{(33 - days) if days > 2 else 3 - days:02d}T08:00:00"


def stored_alerts(spark, rule, orders, as_of):
    return alerts.delay_alerts(small.table(spark, rule.orders, orders), rule, as_of)


def simulated(rule, stored, orders, as_of_days):
    """The rule for one updated order after the other; ``orders``: id, status, days open."""
    table, changes = dict(stored), {}
    for order, status, days in orders:
        old = table.get(order)
        if status in rule.closed_statuses:
            if table.pop(order, None):
                changes[order] = ("cleared", *old, None, None)
        elif status in rule.open_statuses and days + as_of_days > rule.warning_after:
            level = "critical" if days + as_of_days > rule.critical_after else "warning"
            table[order] = (level, days + as_of_days)
            if old is None:
                changes[order] = ("opened", None, None, *table[order])
            elif old != table[order]:
                changes[order] = ("raised" if old[0] != level == "critical" else "updated", *old, *table[order])
    return table, changes


@pytest.mark.parametrize("rule", list(alerts.RULES.values()), ids=list(alerts.RULES))
def test_alerts_after_updates(spark, rule):
    make = inbound if rule is alerts.INBOUND else outbound
    rng = random.Random(3)
    old = [(i, rng.randint(0, 14)) for i in range(1, 200)]
    made = [make(i, created_time=days_ago(d)) for i, d in old]
    stored = stored_alerts(spark, rule, made, "2025-12-03")
    known = {r[rule.order_id]: (r["alert_level"], r["delay_days"]) for r in stored.collect()}
    assert known
    # two days later some are updated
    updated = [(i, rng.choice([*rule.open_statuses, *rule.closed_statuses, None]), d) for i, d in old if rng.random() < 0.6]
    changed = small.table(spark, rule.orders, [make(i, status=s, created_time=days_ago(d)) for i, s, d in updated])
    after = alerts.alerts_after(stored, changed, rule, "2025-12-05")
    table, changes = simulated(rule, known, updated, 2)
    assert after.table.columns == stored.columns
    assert {r[rule.order_id]: (r["alert_level"], r["delay_days"]) for r in after.table.collect()} == table
    assert {r[0]: tuple(r)[1:] for r in after.changes.collect()} == changes
    assert {c[0] for c in changes.values()} == {"opened", "raised", "updated", "cleared"}
    nothing = alerts.alerts_after(stored, changed.limit(0), rule, "2025-12-05")
    assert rows(nothing.table) == rows(stored) and nothing.changes.isEmpty()


def test_commands_clear_stored_alerts(spark):
    t = with_utilization(small.tables(
        spark,
        warehouses=[warehouse(1)],
        locations=[place(1, "A", 20)],
        products=[product(1)],
        employees=[person(1, 1)],
        inventory=[lot(1, total=10)],
        inbound_orders=[inbound(i, quantity=4, created_time=days_ago(12)) for i in (1, 2, 3, 4)],
        outbound_orders=[outbound(i, quantity=4, created_time=days_ago(9)) for i in (1, 2, 3)],
    ))
    plain = commands.complete_inbound(
        t, spark.createDataFrame([(1, 1, 4, "A")], "request_id bigint, inbound_id bigint, actual_quantity int, location string"), NOW
    )
    assert plain.alert_changes == {} and "inbound_delay_alerts" not in plain.tables
    both = {r.alerts: alerts.delay_alerts(t[r.orders], r, NOW) for r in alerts.RULES.values()}
    t = {**t, **both}
    asked = [(i, i, 4, "A") for i in (1, 2, 3)]  # the third does not fit
    receipts = spark.createDataFrame(asked, "request_id bigint, inbound_id bigint, actual_quantity int, location string")
    done = commands.complete_inbound(t, receipts, NOW)
    assert {r[0] for r in done.tables["inbound_delay_alerts"].collect()} == {3, 4}
    assert {(r["inbound_id"], r["change"]) for r in done.alert_changes["inbound_delay_alerts"].collect()} == {(1, "cleared"), (2, "cleared")}
    assert rows(done.tables["inbound_delay_alerts"]) == rows(alerts.delay_alerts(done.tables["inbound_orders"], alerts.INBOUND, NOW))
    shipments = spark.createDataFrame([(1, 1, 1), (2, 1, 2), (3, 1, 3)], "request_id bigint, inventory_id bigint, outbound_id bigint")
    sent = commands.complete_outbound(done.tables, shipments, NOW)
    assert {r[0] for r in sent.tables["outbound_delay_alerts"].collect()} == {3}
    assert {r[0] for r in sent.tables["inbound_delay_alerts"].collect()} == {3, 4}  # carried on
    assert [tuple(r)[:2] for r in sent.alert_changes["outbound_delay_alerts"].orderBy("outbound_id").collect()] == [
        (1, "cleared"),
        (2, "cleared"),
    ]


def test_parents_come_first():
    names = schemas.parents_first(reversed(schemas.TABLES))
    assert sorted(names) == sorted(schemas.TABLES)
    for place_, name in enumerate(names):
        assert all(r.parent in names[: place_ + 1] for r in schemas.TABLES[name].references)
    assert schemas.parents_first(["inventory", "products"]) == ["products", "inventory"]


def batch(spark, name, given):
    """Rows of a table with their place in the batch; columns not named are absent values."""
    made = [
        small.table(spark, name, [row]).withColumn("row_order", F.lit(i).cast("bigint")) for i, row in enumerate(given, 1)
    ]
    whole = made[0]
    for part in made[1:]:
        whole = whole.unionByName(part)
    return whole


def test_tables_are_ingested_parents_first(spark):
    t = with_utilization(small.tables(
        spark,
        warehouses=[warehouse(1)],
        locations=[place(1, "A", 10)],
        products=[product(1)],
        employees=[person(1, 1)],
        inventory=[lot(1, total=4)],
    ))
    done = ingest_tables(
        t,
        {
            "inventory_adjustments": batch(spark, "inventory_adjustments", [
                {"adjustment_id": n, "adjustment_type": "count", "warehouse_id": 2, "product_id": 2, "inventory_id": i, "operator": 7}
                for n, i in ((1, 2), (2, 3), (3, 99))
            ]),
            "inventory": batch(spark, "inventory", [
                lot(2, 2, 2, "B", 6),
                lot(3, 2, 2, "B", 5),  # no space after lot 2
                lot(4, 3, 1, "A", 1),  # its product is rejected
                lot(5, 1, 1, "A", 3, parent_inventory_id=2),  # parent of this batch
                lot(6, 1, 1, "A", 1, parent_inventory_id=3),  # its parent is rejected
                lot(7, 1, 1, "A", 1, parent_inventory_id=8),  # its parent comes later
                lot(8, 1, 1, "A", 1, parent_inventory_id=8),  # its own parent
                lot(9, 1, 1, "A", 0, parent_inventory_id=6),  # parent of a rejected parent
                lot(10, 1, 1, "A", 9, parent_inventory_id=5),  # no space, though its parent is there
            ]),
            "locations": batch(spark, "locations", [place(2, "B", 10), place(3, "B", 10)]),
            "products": batch(spark, "products", [product(2), product(3, product_name=None)]),
            "employees": batch(spark, "employees", [person(7, 2), person(8, 3)]),
            "warehouses": batch(spark, "warehouses", [warehouse(2), warehouse(3, warehouse_type="tent")]),
        },
        NOW,
    )
    got = {
        name: {r[1]: r["violations"] for r in df.select("row_order", schemas.TABLES[name].key[0], "violations").collect()}
        for name, df in done.rejected.items()
    }
    full = "key_or_unique_value_taken_or_no_space"
    orphan = "parent_inventory_id_in_inventory"
    assert got == {
        "warehouses": {3: ["warehouse_type_allowed"]},
        "locations": {3: ["warehouse_id_in_warehouses"]},
        "products": {3: ["product_name_required"]},
        "employees": {8: ["warehouse_id_in_warehouses"]},
        "inventory": {3: [full], 4: ["product_id_in_products"], 6: [orphan], 7: [orphan], 9: [orphan], 10: [full]},
        "inventory_adjustments": {2: ["inventory_id_in_inventory"], 3: ["inventory_id_in_inventory"]},
    }
    assert {r[0] for r in done.tables["inventory"].collect()} == {1, 2, 5, 8}
    assert rows(done.tables["locations"]) == rows(with_utilization(done.tables)["locations"])
    used = {(r["warehouse_id"], r["location"]): float(r["utilization"]) for r in done.tables["locations"].collect()}
    assert used == {(1, "A"): 8.0, (2, "B"): 6.0}
    assert [r[0] for r in done.tables["inventory_adjustments"].select("adjustment_id").collect()] == [1]
    assert set(done.accepted) == set(got)
    with pytest.raises(ValueError, match="no such tables"):
        ingest_tables(t, {"stock": t["inventory"]}, NOW)
    assert ingest_tables(t, {}, NOW).tables["inventory"].count() == 1


def versions(spark, changes):
    """Rows of inbound orders with a change number; None as an order: it was removed."""
    parts = []
    for seq, row in changes:
        key = row if isinstance(row, int) else None
        made = small.table(spark, "inbound_orders", [inbound(key) if key else row])
        if key:
            made = made.select(*[F.col(c) if c == "inbound_id" else F.lit(None).cast(made.schema[c].dataType).alias(c) for c in made.columns])
        parts.append(made.withColumn("change_seq", F.lit(seq).cast("bigint")))
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def test_alerts_come_due_without_events(spark, tmp_path):
    feed, target, state = (str(tmp_path / n) for n in ("changes", "orders", "state"))
    created = {1: 1, 2: 4, 3: 8, 4: 12, 5: 12, 6: 0}

    def order(number, **more):
        return inbound(number, created_time=days_ago(created[number]), **more)

    first = [(1, order(i)) for i in created]
    later = [(2, order(4, status="completed")), (3, order(4, status="receiving")), (2, 5), (2, order(6, status="cancelled"))]
    for part in ([later[1]], first, later, first, [later[0]]):  # late, twice and out of order
        versions(spark, part).coalesce(1).write.mode("append").parquet(feed)
        if len(part) > 4:
            due_orders.stream_open_orders(spark, "inbound", feed, target, state, files_per_batch=1)
    due_orders.stream_open_orders(spark, "inbound", feed, target, state, files_per_batch=1)
    now = small.table(spark, "inbound_orders", [order(1), order(2), order(3), order(4, status="receiving")])
    sizes = []
    for compacted in (False, True):
        for as_of in ("2025-11-20", NOW, "2025-12-06", "2025-12-20"):
            want = alerts.delay_alerts(now, alerts.INBOUND, as_of)
            assert rows(due_orders.due_alerts(spark, "inbound", target, as_of)) == rows(want)
            sizes.append(want.count())
        coming = due_orders.coming_due(spark, "inbound", target, NOW, "2025-12-06")
        assert {(r["inbound_id"], r["alert_level"]) for r in coming.collect()} == {(2, "warning"), (3, "critical")}
        if not compacted:
            due_orders.compact_open_orders(spark, "inbound", target)
    assert sizes[:4] == [0, 2, 3, 4]
    # a change that comes late after the fold is still late
    versions(spark, [(1, order(6))]).coalesce(1).write.mode("append").parquet(feed)
    due_orders.stream_open_orders(spark, "inbound", feed, target, state)
    assert due_orders.due_alerts(spark, "inbound", target, "2025-12-20").count() == 4
    assert due_orders.due_alerts(spark, "inbound", str(tmp_path / "nothing"), NOW).count() == 0


def test_lot_feed_delivered_twice_and_shuffled(spark, tmp_path):
    t = small.tables(
        spark,
        warehouses=[warehouse(1)],
        locations=[place(1, n, 100) for n in "ABC"],
        products=[product(1, volume=2.5), product(2, volume=None)],
    )
    rng = random.Random(9)
    state, feed = {}, []
    for seq in range(1, 120):
        number = rng.randint(1, 15)
        row = lot(number, rng.choice([1, 1, 2]), 1, rng.choice(["A", "B", "C", None]), rng.randint(0, 9))
        state[number] = row if rng.random() < 0.8 else None
        feed.append((number, seq, state[number]))
    keys = ("product_id", "warehouse_id", "storage_location", "total_quantity")
    changes = [(n, seq, tuple(r[k] for k in keys) if r else None) for n, seq, r in feed] * 2
    rng.shuffle(changes)
    source, target, marks = (str(tmp_path / n) for n in ("changes", "lots", "state"))
    for begin in range(0, len(changes), 60):
        part = spark.createDataFrame(changes[begin : begin + 60], lot_stream.LOT_STATES)
        part.coalesce(1).write.mode("append").parquet(source)
        if begin == 60:
            lot_stream.stream_lot_states(spark, source, target, marks, files_per_batch=1)
            lot_stream.compact_lots(spark, target)
    lot_stream.stream_lot_states(spark, source, target, marks, files_per_batch=1)
    final = small.table(spark, "inventory", [r for r in state.values() if r])
    for _ in range(2):
        assert {r[0] for r in lot_stream.current_lots(spark, target).collect()} == {n for n, r in state.items() if r}
        space = lot_stream.space_of_lots(spark, t["locations"], t["products"], target)
        assert rows(space) == rows(location_utilization({**t, "inventory": final}))
        lot_stream.compact_lots(spark, target)


def test_repeated_receipts_compute_lots_once(spark, data, monkeypatch):
    """Both deliveries find lots in stored steps; nothing derives them from the order lines again."""
    read, complete = [], commands.complete_inbound

    def spied(tables, *rest):
        read.append(tables["inventory"].inputFiles())
        return complete(tables, *rest)

    monkeypatch.setattr(commands, "complete_inbound", spied)
    assert catalog()["complete_inbound_twice"](spark, data).count()
    assert len(read) == 2 and not any("lineitem" in file for files in read for file in files)
