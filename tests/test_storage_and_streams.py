"""Readers, sinks and streams: repeated writes, formats, and stream state equal to the batch result."""

from __future__ import annotations

import datetime as dt
import os

import pytest
import small
from pyspark.sql import functions as F
from small import inbound, lot, outbound, place, product, warehouse

from stocklens import session
from stocklens.functions.metrics import location_utilization
from stocklens.operators.alerts import INBOUND, delay_alerts, sweep_delay_alerts
from stocklens.plans import stock, suppliers
from stocklens.session import landed, shared_folder
from stocklens.sources import layout, sinks, snapshots
from stocklens.sources.schemas import TABLES
from stocklens.sources.tables import load_tables, read_tables, register_views, write_tables
from stocklens.streaming import alerts as alert_stream
from stocklens.streaming import due_orders, feeds
from stocklens.streaming import utilization as space_stream

NOW = "2025-12-03"


def rows(df):
    return sorted((tuple(r) for r in df.select(*sorted(df.columns)).collect()), key=str)


def test_shared_folder_comes_from_the_session(spark):
    assert shared_folder(spark) == spark.conf.get("spark.checkpoint.dir")
    df = landed(spark.range(3).withColumn("x", F.lit(None).cast("decimal(5,2)")))
    assert df.inputFiles()[0].removeprefix("file://").startswith(shared_folder(spark))
    assert df.count() == 3 and df.schema["x"].dataType.simpleString() == "decimal(5,2)"


@pytest.mark.parametrize("fmt", ["parquet", "orc", "json", "csv"])
def test_tables_are_read_by_declared_schema(spark, tmp_path, fmt):
    t = small.tables(
        spark,
        warehouses=[warehouse(1, address="a, b")],
        inventory=[lot(1, expiry_date="2026-01-31"), lot(2, where=None)],
    )
    names = ["warehouses", "inventory", "suppliers"]
    write_tables({n: t[n] for n in names}, str(tmp_path), fmt)
    read = read_tables(spark, str(tmp_path), fmt, names)
    for name in names:
        assert read[name].schema == TABLES[name].struct_type
        assert rows(read[name]) == rows(t[name])
    register_views(read)
    assert spark.sql("select count(*) from inventory").first()[0] == 2


def test_date_column_keeps_the_day_of_a_time(spark, tmp_path):
    folder = tmp_path / "inventory"
    folder.mkdir()
    header = ",".join(c.name for c in TABLES["inventory"].columns)
    line = "1,1,1,A,5,0,5,pcs,2025-04-17 00:57:38,2026-05-21 12:21:56,normal,,2025-12-03 00:00:00"
    (folder / "part.csv").write_text(f"{header}\n{line}\n")
    got = read_tables(spark, str(tmp_path), "csv", ["inventory"])["inventory"].first()
    assert (got["production_date"], got["expiry_date"]) == (dt.date(2025, 4, 17), dt.date(2026, 5, 21))


def test_month_is_replaced_and_can_become_empty(spark, tmp_path):
    t = small.tables(
        spark,
        suppliers=[{"supplier_id": 1, "supplier_name": "S"}],
        supplier_products=[{"supplier_id": 1, "product_id": 1}],
        inbound_orders=[
            inbound(i, status="completed", quantity=5, received_time=f"2025-{m}-02T00:00:00")
            for i, m in ((1, 10), (2, 11), (3, 11))
        ],
    )
    folder = str(tmp_path / "report")

    def months():
        read = sinks.read_monthly_report(spark, folder)
        return {(r["report_month"], float(r["total_inbound"])) for r in read.collect()}

    for month in ("2025-10", "2025-11", "2025-11"):
        sinks.write_monthly_report(suppliers.supplier_monthly_report(t, month, NOW), folder, month)
    assert months() == {("2025-10", 5.0), ("2025-11", 10.0)}
    t["inbound_orders"] = t["inbound_orders"].filter("inbound_id = 1")
    sinks.write_monthly_report(suppliers.supplier_monthly_report(t, "2025-11", NOW), folder, "2025-11")
    assert months() == {("2025-10", 5.0)}
    with pytest.raises(ValueError):
        sinks.write_monthly_report(suppliers.supplier_monthly_report(t, "2025-11", NOW), folder, "2025-99")


def test_snapshots_leave_earlier_runs_alone(spark, tmp_path):
    folder = str(tmp_path / "snapshots")
    first = small.tables(spark, inventory=[lot(1)])
    second = {"inventory": small.table(spark, "inventory", [lot(1), lot(2)])}
    sinks.publish_snapshot({"inventory": first["inventory"]}, folder, "a", "2025-12-01")
    sinks.publish_snapshot(second, folder, "b", "2025-12-02")
    assert sinks.read_snapshot(spark, folder, ["inventory"])["inventory"].count() == 2
    assert sinks.read_snapshot(spark, folder, ["inventory"], "a")["inventory"].count() == 1
    with pytest.raises(Exception, match="(?i)already exists"):
        sinks.publish_snapshot(second, folder, "a", "2025-12-03")


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_layout_prunes_and_needs_no_shuffle_by_product(spark, tmp_path):
    folder = str(tmp_path / "layout")
    times = [f"2025-{m:02d}-10T00:00:00" for m in (7, 8, 9, 10, 11)]
    t = small.tables(
        spark,
        warehouses=[warehouse(1)],
        suppliers=[{"supplier_id": 1, "supplier_name": "S"}],
        supplier_products=[{"supplier_id": 1, "product_id": p} for p in range(9)],
        products=[product(p, category="c", value=p) for p in range(9)],
        inventory=[lot(p, p) for p in range(9)],
        inbound_orders=[inbound(i, i % 9, status="completed", quantity=i, received_time=times[i % 5]) for i in range(40)]
        + [inbound(100 + i, i % 9, created_time="2025-11-01T00:00:00") for i in range(5)],
        outbound_orders=[outbound(i, i % 3, status="shipped", shipped_time=times[i % 5]) for i in range(20)],
    )
    layout.write_layout(t, folder, buckets=3)
    whole = layout.open_layout(spark, folder)
    for name in TABLES:
        assert whole[name].columns == t[name].columns and rows(whole[name]) == rows(t[name]), name
    spark.sql(f"drop table {layout._registered(folder, 'inbound_orders')}")  # as another session finds it
    some = layout.open_layout(spark, folder, "2025-09", "2025-10")
    months = {(r["status"], r["received_time"] and r["received_time"].month) for r in some["inbound_orders"].collect()}
    assert months == {("completed", 9), ("completed", 10), ("pending", None)}

    report = suppliers.supplier_monthly_report(some, "2025-10", NOW)
    assert rows(report) == rows(suppliers.supplier_monthly_report(t, "2025-10", NOW)) and report.count() == 1
    selling = stock.high_value_poor_selling(layout.open_layout(spark, folder, "2025-09"), NOW)
    assert rows(selling) == rows(stock.high_value_poor_selling(t, NOW)) and selling.count()
    late = delay_alerts(whole["inbound_orders"], INBOUND, NOW)
    assert rows(late) == rows(delay_alerts(t["inbound_orders"], INBOUND, NOW)) and late.count() == 5
    for df, column in ((report, "closed_month"), (selling, "closed_month"), (late, "status")):
        filters = [line for line in plan_of(df).split("PartitionFilters: [")[1:] if column in line.split("]")[0]]
        assert filters, plan_of(df)
    units = whole["inbound_orders"].groupBy("product_id").agg(F.sum("actual_quantity"))
    assert "Exchange" not in plan_of(units) and "Bucketed: true" in plan_of(units)


def files_below(folder):
    return {os.path.join(d, n) for d, _, names in os.walk(folder) for n in names if n.endswith(".parquet")}


def test_only_changed_buckets_are_written(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(snapshots, "ROWS_PER_BUCKET", 20)
    folder = str(tmp_path / "runs")
    whole = [lot(i, total=i % 9, parent_inventory_id=i - 1 if i % 5 == 0 else None) for i in range(400)]
    orders = small.table(spark, "outbound_orders", [outbound(i) for i in range(30)])
    states = {
        "a": whole,
        "b": [*whole[:7], lot(7, total=99), *whole[8:]],  # one row differs
        "c": [*whole[:7], lot(7, total=99), *whole[8:100], *whole[101:], lot(400)],  # one gone, one new
        "d": [],
        "e": whole,
    }
    written, last = {}, set()
    for day_, (run, rows_) in enumerate(states.items(), 1):
        tables = {"inventory": small.table(spark, "inventory", rows_)}
        if run in "ac":
            tables["outbound_orders"] = orders
        snapshots.publish_changes(tables, folder, run, f"2025-12-0{day_}")
        now = files_below(f"{folder}/data")
        written[run], last = len(now - last), now

    def read(run=None):
        return snapshots.read_run(spark, folder, ["inventory", "outbound_orders"], run)

    assert written["a"] >= 20 and written["b"] == 1 and written["c"] <= 2 and written["d"] == 0 and written["e"] >= 18
    for run, rows_ in states.items():
        got = read(run)
        assert rows(got["inventory"]) == rows(small.table(spark, "inventory", rows_)), run
        assert rows(got["outbound_orders"]) == rows(orders)
    assert snapshots.last_run(spark, folder) == "e"
    with pytest.raises(ValueError, match="published already"):
        snapshots.publish_changes({"inventory": small.table(spark, "inventory", whole)}, folder, "b", "2025-12-09")

    assert sorted(snapshots.retire_runs(spark, folder, 2)) == ["a", "b", "c"]
    assert rows(read()["inventory"]) == rows(small.table(spark, "inventory", whole))
    assert read("d")["inventory"].count() == 0 and rows(read("d")["outbound_orders"]) == rows(orders)
    with pytest.raises(ValueError, match="not there"):
        read("a")
    left = {os.path.basename(os.path.dirname(os.path.dirname(f))) for f in files_below(f"{folder}/data/inventory")}
    assert left == {"e"}  # orders of run a are still needed, lots are not
    assert files_below(f"{folder}/data/outbound_orders")
    assert snapshots.retire_runs(spark, folder, 2) == []


def test_missing_values_change_a_digest(spark, tmp_path):
    folder = str(tmp_path / "runs")
    for run, row in (("a", lot(1, unit=None, where="pcs")), ("b", lot(1, unit="pcs", where=None))):
        snapshots.publish_changes({"inventory": small.table(spark, "inventory", [row])}, folder, run, "2025-12-01")
    got = snapshots.read_run(spark, folder, ["inventory"], "b")["inventory"].first()
    assert (got["unit"], got["storage_location"]) == ("pcs", None)


def test_broken_records_are_set_aside(spark, tmp_path):
    good = small.tables(spark, suppliers=[{"supplier_id": i, "supplier_name": f"S, {i}", "supply_cycle": i} for i in (1, 2)])
    for fmt in ("csv", "json"):
        write_tables({"suppliers": good["suppliers"]}, str(tmp_path / fmt), fmt)
    header = ",".join(TABLES["suppliers"].names)
    broken = ["x1,Name,info,3,active", "4,Name,info,soon,active", "5,Name", "6,Name,info,3,active,more"]
    (tmp_path / "csv" / "suppliers" / "more.csv").write_text("\n".join([header, *broken, "7,Good,info,3,active"]) + "\n")
    (tmp_path / "json" / "suppliers" / "more.json").write_text('{"supplier_id": 7}\n{"supplier_id": "x"}\n{not json\n')
    for fmt, records in (("csv", broken), ("json", ['{"supplier_id": "x"}', "{not json"])):
        done = load_tables(spark, str(tmp_path / fmt), fmt, ["suppliers"])
        assert sorted(r["supplier_id"] for r in done.tables["suppliers"].collect()) == [1, 2, 7]
        assert done.tables["suppliers"].schema == TABLES["suppliers"].struct_type
        assert sorted(r["record"] for r in done.rejects.collect()) == sorted(records)
        assert done.rejects.count() == len(records) and done.tables["suppliers"].count() == 3
        assert {(r["table_name"], os.path.basename(r["file"]).split(".")[0]) for r in done.rejects.collect()} == {("suppliers", "more")}


def test_old_alert_evaluations_are_removed(spark, tmp_path):
    target = str(tmp_path / "alerts")
    orders = small.tables(spark, inbound_orders=[inbound(1, created_time="2025-11-01T00:00:00")])
    for _ in range(3):
        sinks.write_alerts(sweep_delay_alerts(orders, NOW), target)
    assert len(sinks.retire_alerts(spark, target, 1)) == 2
    assert sinks.read_alerts(spark, target).count() == 1
    assert sinks.retire_alerts(spark, target, 0) == [] and len(os.listdir(f"{target}/runs")) == 1


def test_alert_stream_ends_at_the_batch_result(spark, tmp_path):
    feed, target, state = (str(tmp_path / n) for n in ("changes", "alerts", "state"))
    old = "2025-11-01T00:00:00"
    versions = [
        [(1, inbound(1, created_time=old)), (2, inbound(2, created_time=old)), (3, inbound(3, created_time=old))],
        [(6, inbound(1, created_time=old, status="completed")), (4, inbound(4, created_time="2025-11-26T00:00:00"))],
        # an older change of order 1 that arrives late, and two changes of order 2 in one file
        [(5, inbound(1, created_time=old)), (8, inbound(2, created_time=old, status="receiving")), (7, inbound(2, status="cancelled"))],
        [(9, inbound(3, created_time=old, status="cancelled"))],
    ]
    for number, version in enumerate(versions):
        part = small.table(spark, "inbound_orders", [r for _, r in version])
        seqs = {r["inbound_id"]: [s for s, x in version if x["inbound_id"] == r["inbound_id"]] for _, r in version}
        if any(len(v) > 1 for v in seqs.values()):
            pieces = [
                small.table(spark, "inbound_orders", [r]).withColumn("change_seq", F.lit(s).cast("bigint"))
                for s, r in version
            ]
            part = pieces[0]
            for piece in pieces[1:]:
                part = part.unionByName(piece)
        else:
            lookup = F.create_map(*[F.lit(x) for k, v in seqs.items() for x in (k, v[0])])
            part = part.withColumn("change_seq", lookup[F.col("inbound_id").cast("int")].cast("bigint"))
        part.coalesce(1).write.mode("append").parquet(feed)
        if number in (1, 3):  # the stream stops and starts again in between
            alert_stream.stream_delay_alerts(spark, "inbound", feed, target, state, NOW, files_per_batch=1)
    last = small.table(
        spark,
        "inbound_orders",
        [
            inbound(1, created_time=old, status="completed"),
            inbound(2, created_time=old, status="receiving"),
            inbound(3, created_time=old, status="cancelled"),
            inbound(4, created_time="2025-11-26T00:00:00"),
        ],
    )
    want = delay_alerts(last, INBOUND, NOW)
    assert rows(alert_stream.current_alerts(spark, "inbound", target)) == rows(want)
    assert {r["inbound_id"] for r in want.collect()} == {2, 4}
    alert_stream.compact_alerts(spark, "inbound", target)
    assert rows(alert_stream.current_alerts(spark, "inbound", target)) == rows(want)
    late = small.table(spark, "inbound_orders", [inbound(2, created_time=old, status="completed")])
    late.withColumn("change_seq", F.lit(20).cast("bigint")).coalesce(1).write.mode("append").parquet(feed)
    alert_stream.stream_delay_alerts(spark, "inbound", feed, target, state, NOW)
    alert_stream.compact_alerts(spark, "inbound", target)
    assert {r["inbound_id"] for r in alert_stream.current_alerts(spark, "inbound", target).collect()} == {4}
    assert alert_stream.current_alerts(spark, "inbound", str(tmp_path / "nothing")).count() == 0


def test_space_stream_ends_at_the_batch_result(spark, tmp_path):
    feed, totals, state = (str(tmp_path / n) for n in ("changes", "totals", "state"))
    t = small.tables(
        spark,
        warehouses=[warehouse(1)],
        locations=[place(1, n, 100) for n in "ABC"],
        products=[product(1, volume=2.5), product(2, volume=None)],
    )

    def change(*pairs):
        def side(row):
            keys = ("product_id", "warehouse_id", "storage_location", "total_quantity")
            return tuple(row[k] for k in keys) if row else None

        data = [((b or a)["inventory_id"], side(b), side(a)) for b, a in pairs]
        return spark.createDataFrame(data, space_stream.LOT_CHANGES)

    steps = [
        change((None, lot(1, total=10)), (None, lot(2, where="B", total=4)), (None, lot(3, 2, total=9))),
        change((lot(1, total=10), lot(1, where="B", total=10))),
        change((lot(2, where="B", total=4), None), (lot(1, where="B", total=10), lot(1, where="B", total=6))),
        change((None, lot(4, where=None, total=5))),
    ]
    for number, step in enumerate(steps):
        step.coalesce(1).write.mode("append").parquet(feed)
        if number in (1, 3):
            space_stream.stream_location_utilization(spark, t["products"], feed, totals, state, files_per_batch=1)
    final = small.table(spark, "inventory", [lot(1, where="B", total=6), lot(3, 2, total=9), lot(4, where=None, total=5)])
    want = location_utilization({**t, "inventory": final})
    got = space_stream.current_utilization(spark, t["locations"], totals)
    assert rows(got) == rows(want)
    assert {r["location"]: float(r["utilization"]) for r in got.collect()} == {"A": 0.0, "B": 15.0, "C": 0.0}
    space_stream.compact_utilization(spark, totals)
    assert rows(space_stream.current_utilization(spark, t["locations"], totals)) == rows(want)


def test_alert_table_is_whole_throughout(spark, tmp_path):
    target = str(tmp_path / "alerts")
    old = "2025-11-01T00:00:00"
    orders = small.tables(spark, inbound_orders=[inbound(1, created_time=old)])
    sinks.write_alerts(sweep_delay_alerts(orders, NOW), target)
    before = sinks.read_alerts(spark, target)
    closed = small.tables(spark, inbound_orders=[inbound(1, created_time=old, status="completed")])
    sinks.write_alerts(sweep_delay_alerts(closed, NOW), target)
    assert before.count() == 1  # a reader that began earlier still finds its table
    after = sinks.read_alerts(spark, target)
    assert after.count() == 0 and sorted(after.columns) == sorted(before.columns)


def test_shared_folder_is_demanded_and_cleared(spark, monkeypatch):
    kept = landed(spark.range(3))
    assert kept.count() == 3
    path = kept.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]
    other = session._STEPS.pop(spark.sparkContext.applicationId)
    session._STEPS[spark.sparkContext.applicationId] = [path]
    session.discard_steps(spark)
    assert not os.path.exists(path)
    session._STEPS[spark.sparkContext.applicationId] = [p for p in other if p != path]
    monkeypatch.setattr(type(spark.conf), "get", lambda self, key, default=None: default)
    monkeypatch.setattr(type(spark.sparkContext), "getCheckpointDir", lambda self: None)
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_folder(spark)


def test_buckets_of_a_layout_grow_in_number(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(layout, "ROWS_PER_BUCKET", 10)
    t = small.tables(spark, inventory=[lot(p, p) for p in range(45)], outbound_orders=[outbound(i) for i in range(12)])
    folder = str(tmp_path / "grown")
    layout.write_layout(t, folder, buckets=2)
    assert spark.read.parquet(f"{folder}/_about").first()["buckets"] == 5
    opened = layout.open_layout(spark, folder)
    for name in ("inventory", "outbound_orders"):
        assert rows(opened[name]) == rows(t[name]), name


def test_latest_rows_are_sorted_in_parts_that_grow_in_number(spark, monkeypatch):
    monkeypatch.setattr(feeds, "ROWS_PER_PART", 10)
    changes = spark.range(90).selectExpr("id % 30 as id", "id as change_seq", "id * 2 as what")
    found = due_orders._latest(changes, "id")
    assert "REPARTITION_BY_NUM" in plan_of(found) and "hashpartitioning(id" in plan_of(found) and ", 9)" in plan_of(found)
    assert sorted(tuple(r) for r in found.collect()) == [(i, 60 + i, 120 + 2 * i) for i in range(30)]


def test_a_published_table_is_computed_once(spark, tmp_path):
    computed = spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            computed.add(batch.num_rows)
            yield batch

    lots = small.tables(spark, inventory=[lot(i) for i in range(20)])["inventory"]
    state = lots.mapInArrow(seen, lots.schema)
    snapshots.publish_changes({"inventory": state}, str(tmp_path / "once"), "first", NOW)
    assert computed.value == 20
    assert rows(snapshots.read_run(spark, str(tmp_path / "once"), ["inventory"])["inventory"]) == rows(lots)
