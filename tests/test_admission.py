"""Admission in rounds gives what handling one request after the other gives."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from stocklens.functions import components as component_functions
from stocklens.functions import scale
from stocklens.functions.scale import (
    in_ranges,
    position_in_ranges,
    previous_value,
    running_sums,
    with_position,
)
from stocklens.operators import admission
from stocklens.operators.admission import admit

SCHEMA = "request_id bigint, resource string, amount bigint, room bigint"
KEYED = f"row bigint, {SCHEMA}"


def keyed(rows):
    """Demands in request order with a number of their own; requests may hold two."""
    return [(i, *row) for i, row in enumerate(rows)]


def one_after_the_other(rows):
    """Brute force, written from the rule alone."""
    used, verdicts = {}, {}
    for request in sorted({r[0] for r in rows}):
        mine = [r for r in rows if r[0] == request]
        ok = all(room is None or used.get(res, 0) + amount <= room for _, res, amount, room in mine)
        verdicts[request] = ok
        if ok:
            for _, res, amount, _ in mine:
                used[res] = used.get(res, 0) + amount
    return verdicts


def batch(seed, requests, resources, hot=False):
    """Requests that take from one resource and may give back to another."""
    rng = random.Random(seed)
    rooms = {f"r{i}": rng.randint(20, 120) for i in range(resources)}
    rows = []
    for i in range(requests):
        take = "r0" if hot and rng.random() < 0.4 else f"r{rng.randrange(resources)}"
        rows.append((i * 3, take, rng.randint(0, 40), None if rng.random() < 0.05 else rooms[take]))
        if rng.random() < 0.5:
            give = f"r{rng.randrange(resources)}"
            if give != take:
                rows.append((i * 3, give, -rng.randint(0, 30), None))
    return rows


#: So few open demands are folded in one stream; with none every component is found.
AT_ONCE, BY_COMPONENT = 50_000, 0


@pytest.mark.parametrize("rows_per_range, at_once", [(200_000, AT_ONCE), (40, BY_COMPONENT), (3, AT_ONCE)])
def test_same_as_sequential(spark, monkeypatch, rows_per_range, at_once):
    monkeypatch.setattr(admission, "AT_ONCE", at_once)
    rows = batch(7, 160, 12, hot=True)
    demands = in_ranges(spark.createDataFrame(keyed(rows), KEYED), "row", rows_per_range)
    got = {r[0]: r[1] for r in admit(demands).collect()}
    assert got == one_after_the_other(rows)


def test_many_components_same_as_sequential(spark, monkeypatch):
    monkeypatch.setattr(admission, "AT_ONCE", BY_COMPONENT)
    rows = batch(3, 500, 150)
    got = {r[0]: r[1] for r in admit(in_ranges(spark.createDataFrame(keyed(rows), KEYED), "row")).collect()}
    assert got == one_after_the_other(rows)


def moves(places, ring):
    """Every place is full; each request moves one unit on to the next place, in the order that works or not."""
    rows = []
    for i in range(places if ring else places - 1):
        to, came_from = f"p{i}", f"p{(i + 1) % places}"
        rows += [(2 * i + 1, to, 1, 0), (2 * i + 1, came_from, -1, None)]
    # a first request makes room at p0 (in a chain), the last ones find no room
    return [(0, "p0", -1, None), *rows, (9_000_000, "p5", 1, 0)]


@pytest.mark.parametrize("ring, at_once", [(False, BY_COMPONENT), (True, AT_ONCE)], ids=["chain", "ring"])
def test_rounds_do_not_follow_the_length_of_a_chain(spark, monkeypatch, ring, at_once):
    monkeypatch.setattr(admission, "AT_ONCE", at_once)
    rounds = {}
    judge, fold = admission._judge, admission._folded
    for places in (30, 1_000):
        count = rounds[places] = []
        monkeypatch.setattr(admission, "_judge", lambda *a, c=count: c.append("bounds") or judge(*a))
        monkeypatch.setattr(admission, "_folded", lambda *a, c=count: c.append("fold") or fold(*a))
        rows = moves(places, ring)
        demands = in_ranges(spark.createDataFrame(keyed(rows), KEYED), "row")
        got = {r[0]: r[1] for r in admit(demands).collect()}
        assert got == one_after_the_other(rows)
        assert sum(got.values()) == len(got) - 1
    assert rounds[30] == rounds[1_000] and len(rounds[30]) <= 3


@pytest.mark.parametrize("order", ["random", "in halves"])
def test_components_of_paths(spark, monkeypatch, order):
    """Stars around the smallest node, in about log2 of a path's length rounds whatever the order of ids."""
    size = 600
    ids = list(range(size))
    if order == "random":
        random.Random(2).shuffle(ids)
    elif order == "in halves":
        ids = [i // 2 + (size // 2) * (i % 2) for i in range(size)]
    links = [(ids[i], ids[i + 1]) for i in range(size - 1) if i != 400]
    links += [(7_000 + i, 9_999) for i in range(50)] + [(3, 3), (None, 4), (8_000, 8_000)]
    landings = []
    land = component_functions.landed
    monkeypatch.setattr(component_functions, "landed", lambda df, name: landings.append(name) or land(df, name))
    df = spark.createDataFrame(links, "a bigint, b bigint")
    got = {r["node"]: r["component"] for r in component_functions.components(df).collect()}
    first, second = ids[:401], ids[401:]
    want = {i: min(first) for i in first} | {i: min(second) for i in second}
    assert got == want | {i: 7_000 for i in [*range(7_000, 7_050), 9_999]}
    assert landings.count("small-stars") <= 11
    assert component_functions.components(df.limit(0)).count() == 0


@pytest.mark.parametrize("rows_per_range, at_once", [(200_000, AT_ONCE), (40, BY_COMPONENT)])
def test_single_demands_same_as_sequential(spark, monkeypatch, rows_per_range, at_once):
    monkeypatch.setattr(admission, "AT_ONCE", at_once)
    rows = list({r[0]: r for r in reversed(batch(11, 220, 6, hot=True))}.values())
    demands = in_ranges(spark.createDataFrame(rows, SCHEMA), "request_id", rows_per_range)
    got = {r[0]: r[1] for r in admit(demands, single=True).collect()}
    assert got == one_after_the_other(rows)


def test_later_small_request_fits_after_a_rejected_one(spark):
    rows = [(1, "a", 5, 10), (2, "a", 9, 10), (3, "a", 4, 10)]
    demands = in_ranges(spark.createDataFrame(rows, SCHEMA), "request_id", 40)
    for single in (True, False):
        got = {r[0]: r[1] for r in admit(demands, single).collect()}
        assert got == {1: True, 2: False, 3: True}


@pytest.mark.parametrize("ids", [(1, 2, 2), (1, None, 3)])
def test_request_ids_must_be_unique(spark, ids):
    df = spark.createDataFrame([(i,) for i in ids], "request_id bigint")
    with pytest.raises(ValueError, match="unique"):
        in_ranges(df, "request_id")


def test_positions_and_running_values(spark):
    rows = [(i * 7 % 101, "hot" if i % 3 else "cold", i) for i in range(101)]
    df = spark.createDataFrame(rows, "id bigint, key string, value bigint")
    placed = {r["id"]: r["position"] for r in with_position(df, ["id"]).collect()}
    assert placed == {key: place for place, key in enumerate(sorted(placed), 1)}
    ranged = in_ranges(df, "id", 10)
    assert ranged.select("_range").distinct().count() > 8
    some = ranged.filter("key = 'hot'")
    numbered = {r["id"]: r["position"] for r in position_in_ranges(some, "id").collect()}
    assert numbered == {key: place for place, key in enumerate(sorted(numbered), 1)}
    sums = running_sums(ranged, ["key"], "id", {"before": F.col("value")})
    last = previous_value(sums, "key", "id", "value", "last").collect()
    for r in last:
        earlier = sorted((x[0], x[2]) for x in rows if x[1] == r["key"] and x[0] < r["id"])
        assert r["before"] == sum(v for _, v in earlier)
        assert r["last"] == (earlier[-1][1] if earlier else None)


@pytest.mark.parametrize("rows_per_range", [200_000, 7], ids=["cold", "hot"])
def test_running_sums_move_rows_of_small_keys_once(spark, monkeypatch, rows_per_range):
    monkeypatch.setattr(scale, "ROWS_PER_RANGE", rows_per_range)
    monkeypatch.setattr(scale, "SLOTS", 5)
    rng = random.Random(5)
    rows = [(i, "a" if rng.random() < 0.5 else f"k{rng.randrange(40)}", rng.randint(-9, 9)) for i in range(300)]
    ranged = in_ranges(spark.createDataFrame(rows, "id bigint, key string, n bigint"), "id", 30)
    summed = running_sums(ranged, ["key"], "id", {"before": F.col("n")})
    assert {r["id"]: r["before"] for r in summed.collect()} == {
        i: sum(n for j, other, n in rows if j < i and other == key) for i, key, _ in rows
    }
    if rows_per_range == 200_000:
        plan = summed._jdf.queryExecution().executedPlan().toString()
        assert plan.split("Initial Plan")[-1].count("Exchange hashpartitioning") == 1


def test_ranges_are_told_without_moving_rows(spark):
    rows = spark.range(0, 40_000, 1, 8).select((F.col("id") * F.col("id")).alias("id"))
    ranged = in_ranges(rows, "id", 4_000)
    assert "Exchange" not in ranged._jdf.queryExecution().executedPlan().toString()
    found = ranged.groupBy("_range").agg(F.min("id").alias("a"), F.max("id").alias("b"), F.count("*").alias("n"))
    found = sorted(found.collect(), key=lambda r: r["_range"])
    assert all(before["b"] < after["a"] for before, after in zip(found, found[1:]))
    assert len(found) == 10 and max(r["n"] for r in found) <= 8_000
