"""Commands applied to a whole batch of requests.

A command takes the tables, a DataFrame of requests with a unique ``request_id`` and the time of the
run.  It returns an :class:`Outcome`: the new state of the tables, the rows it added, one result
row per request, and what happened to stored alerts where the tables hold any.  Requests take effect in
``request_id`` order, each entirely or not at all.
"""

from __future__ import annotations

import datetime as dt
from collections import ChainMap
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stocklens.functions.columns import stamp
from stocklens.functions.scale import in_ranges, position_in_ranges, previous_value, running_sums
from stocklens.operators.admission import admit
from stocklens.operators.alerts import INBOUND, OUTBOUND, DelayRule, alerts_after
from stocklens.operators.guards import (
    NO_SPACE,
    UNIT_SPACE,
    free_space,
    inbound_operator_guard,
    outbound_operator_guard,
    place_of,
    space_of,
    space_units,
    unit_space,
)
from stocklens.operators.utilization import refresh_utilization, touched_locations
from stocklens.session import landed
from stocklens.sources import schemas

Tables = Mapping[str, DataFrame]
When = dt.datetime | dt.date | str

NOT_ENOUGH_STOCK = "not enough available stock"
ORDER_CLOSED = "order is already closed"
NO_SOURCE = "source lot not found"


@dataclass(frozen=True)
class Outcome:
    tables: Tables
    results: DataFrame
    added: dict[str, DataFrame] = field(default_factory=dict)
    #: by alert table, where one is stored: the alerts that the command opened, raised, updated or cleared
    alert_changes: dict[str, DataFrame] = field(default_factory=dict)


def first_reason(*cases: tuple[Column, str]) -> Column:
    """The text of the first condition that holds."""
    return F.coalesce(*[F.when(condition, F.lit(text)) for condition, text in cases])


def conform(df: DataFrame, table: schemas.Table, as_of: When) -> DataFrame:
    """``df`` as rows of ``table``: declared order and types, defaults for absent columns."""
    columns = []
    for c in table.columns:
        if c.name in df.columns:
            value = F.col(c.name)
        elif c.default == schemas.AS_OF:
            value = stamp(as_of)
        else:
            value = F.lit(c.default)
        columns.append(value.cast(c.type).alias(c.name))
    return df.select(*columns)


def append(tables: Tables, name: str, rows: DataFrame) -> DataFrame:
    return tables[name].unionByName(rows.select(*tables[name].columns))


def _last_id(table: DataFrame, key: str) -> Column:
    return table.agg(F.coalesce(F.max(key), F.lit(0)).cast("bigint")).scalar()


def _known(table: DataFrame, key: str, name: str, flag: str) -> DataFrame:
    return table.select(F.col(key).alias(name), F.lit(True).alias(flag))


def _judged(
    ranged: DataFrame, demands: DataFrame, refusal: str, kept: tuple[str, ...], single: bool = False
) -> DataFrame:
    """The ``kept`` columns of ``ranged`` requests with ``accepted`` and the final ``reason``."""
    verdicts = admit(demands, single).withColumnRenamed("accepted", "_verdict")
    refused = F.col("reason").isNull() & ~F.coalesce("_verdict", F.lit(True))
    return landed(
        ranged.select("request_id", *kept, "reason", "_range")
        .join(verdicts, "request_id", "left")
        .withColumn("reason", F.when(refused, F.lit(refusal)).otherwise(F.col("reason")))
        .withColumn("accepted", F.col("reason").isNull())
        .drop("_verdict")
    )


def _once_per_order(ranged: DataFrame, key: str) -> DataFrame:
    """Demands that let each order be closed by one request only."""
    return ranged.filter(F.col("reason").isNull()).select(
        "request_id",
        F.concat(F.lit("order/"), F.col(key)).alias("resource"),
        F.lit(1).cast("bigint").alias("amount"),
        F.lit(1).cast("bigint").alias("room"),
        "_range",
    )


def _take_from_lots(lots: DataFrame, taken: DataFrame, touched_at: Column | None) -> DataFrame:
    """``lots`` reduced by ``taken`` (inventory_id, _taken) in total and available quantity."""
    hit = F.col("_taken").isNotNull()
    out = F.coalesce("_taken", F.lit(0))
    changed = lots.join(taken, "inventory_id", "left")
    for name in ("total_quantity", "available_quantity"):
        changed = changed.withColumn(name, (F.col(name) - out).cast("int"))
    if touched_at is not None:
        changed = changed.withColumn(
            "last_updated", F.when(hit, touched_at).otherwise(F.col("last_updated"))
        )
    return changed.select(*lots.columns)


def _with_space(
    tables: Tables, changed: dict[str, DataFrame], *lots: DataFrame, held: DataFrame | None = None
) -> Tables:
    """``tables`` after ``changed``, with the space use of the places of ``lots`` computed anew.

    ``held`` gives the lots with no more than space use needs, where all their columns take more work.
    """
    after = ChainMap(changed, tables)
    counted = after if held is None else ChainMap({"inventory": held}, after)
    return ChainMap({"locations": refresh_utilization(counted, touched_locations(*lots))}, after)


def _traced(asked: DataFrame) -> DataFrame:
    """Split requests with the stored lot (``root_id``) that their source comes from.

    ``source_request`` names an earlier request whose new lot is the source.  Such references form trees; each round
    jumps twice as far towards the root, so rounds follow the logarithm of their depth, and only what has not
    reached its root goes on.  A reference that is unknown, or not to an earlier request, leads to no lot.
    ``made_*`` tell what the source's request asked for.
    """
    earlier = F.col("source_request") < F.col("request_id")
    up = F.when(earlier, F.col("source_request"))
    own = F.when(F.col("source_request").isNull(), F.col("source_id"))
    onward = asked.filter("source_request is not null")
    parents = asked.select(
        F.col("request_id").alias("source_request"),
        F.col("target_warehouse").alias("made_warehouse"),
        F.col("target_location").alias("made_location"),
        F.col("quantity").alias("made_quantity"),
        up.alias("_up"),
        own.alias("_root"),
    )
    met = landed(
        onward.join(parents, "source_request", "left")
        .withColumns({"up": F.when(earlier, F.col("_up")), "root_id": F.when(earlier, F.col("_root"))})
        .drop("_up", "_root"),
        "met",
    )
    hops = met.select("request_id", "up", "root_id")
    roots = asked.filter("source_request is null")
    roots = roots.select("request_id", F.lit(None).cast("bigint").alias("up"), F.col("source_id").alias("root_id"))
    while not hops.filter("up is not null").isEmpty():
        further = hops.unionByName(roots).select(
            F.col("request_id").alias("up"), F.col("up").alias("_up"), F.col("root_id").alias("_root")
        )
        there = hops.filter("up is not null").join(further, "up", "left")
        there = there.select("request_id", F.col("_up").alias("up"), F.coalesce("root_id", "_root").alias("root_id"))
        hops = landed(hops.filter("up is null").unionByName(there), "hops")
    if not met.filter("up is not null").isEmpty():
        met = met.drop("root_id").join(hops.select("request_id", "root_id"), "request_id")
    direct = asked.filter("source_request is null").withColumns(
        {c: F.lit(None).cast(met.schema[c].dataType) for c in ("made_warehouse", "made_location", "made_quantity")}
    )
    direct = direct.withColumn("root_id", F.col("source_id"))
    return direct.unionByName(met.drop("up"))


def _without_source(judged: DataFrame) -> DataFrame:
    """Refused requests whose source was never made say so."""
    asks = F.col("source_request").isNotNull() & ~F.col("accepted")
    made = judged.filter("accepted").select(F.col("request_id").alias("source_request"), F.lit(True).alias("_made"))
    told = (
        judged.filter(asks)
        .join(made, "source_request", "left")
        .withColumn("reason", F.when(F.col("_made").isNull(), F.lit(NO_SOURCE)).otherwise(F.col("reason")))
        .drop("_made")
    )
    return judged.filter(~asks).unionByName(told)


#: Kinds of resources of a split, and how far ids may lie from 0 to be told apart with the kind in one whole number.
_KINDS = ("place", "lot", "made")
_ID_ROOM = 1 << 61


def _resources(rows: DataFrame, *ids: str) -> Callable[[str, Column], Column]:
    """How resources are named by kind and id: by whole numbers, or by text where one of the ``ids`` is too large."""
    large = [(F.col(c) < -_ID_ROOM) | (F.col(c) >= _ID_ROOM) for c in ids]
    if rows.filter(reduce(Column.__or__, large)).isEmpty():
        return lambda kind, ident: ident.cast("bigint") * 4 + _KINDS.index(kind)
    return lambda kind, ident: F.concat(F.lit(f"{kind}/"), ident)


def _tight_places(valid: DataFrame, arriving: Column) -> DataFrame:
    """Places, with a flag, that have not room for all that the batch wants to put there; the others refuse nothing."""
    asked = valid.filter(F.col("_to").isNotNull()).groupBy("_to")
    wanted = asked.agg(F.sum(F.greatest(arriving, F.lit(0))).alias("_wanted"), F.min("_to_room").alias("_given"))
    return landed(wanted.filter("_wanted > _given").select("_to", F.lit(True).alias("_tight")), "tight")


def _updated(orders: DataFrame, status: DataFrame, key: str) -> DataFrame:
    """The orders that a command updated, with their new ``status``."""
    return orders.drop("status").join(status, key)


def _with_alerts(
    tables: Tables, changed: dict[str, DataFrame], updated: DataFrame, rule: DelayRule, as_of: When
) -> dict[str, DataFrame]:
    """Puts the alert table into ``changed`` as the ``updated`` orders leave it; returns its changes."""
    if rule.alerts not in tables:
        return {}
    after = alerts_after(tables[rule.alerts], updated, rule, as_of)
    changed[rule.alerts] = after.table
    return {rule.alerts: after.changes}


def _from_made(rows: DataFrame, made_ids: DataFrame) -> DataFrame:
    """``rows`` whose source is a lot of the batch name it in ``source_id``; only these meet ``made_ids``."""
    made = F.col("source_request").isNotNull()
    named = rows.filter(made).join(made_ids, "source_request", "left")
    return rows.filter(~made).unionByName(named.withColumn("source_id", F.col("_made_id")).drop("_made_id"))


def split_inventory(
    tables: Tables, requests: DataFrame, as_of: When, inherit_status: bool = False
) -> Outcome:
    """Move part of a lot to a new lot at another place.

    Requests: request_id, source_id, quantity, operator_id, target_warehouse, target_location, and
    perhaps source_request: the earlier request of the batch whose new lot is the source, instead of source_id, which
    names a stored lot.
    Taking from the lot frees space at its place before the target's space is checked.
    """
    lots = tables["inventory"]
    chained = "source_request" in requests.columns
    made = F.col("source_request").isNotNull() if chained else F.lit(False)
    requests = landed(requests, "splits")
    drawn = (
        requests.filter(~made)
        .groupBy(F.col("source_id").alias("inventory_id"))
        .agg(F.sum(F.greatest("quantity", F.lit(0))).alias("_drawn"))
    )
    if chained:
        requests = _traced(requests)
    else:
        requests = requests.withColumn("root_id", F.col("source_id"))
    # products are met by lots and staff by the requests as asked, before anything makes these wider
    requests = requests.join(
        _known(tables["employees"], "employee_id", "operator_id", "_person"), "operator_id", "left"
    )
    volumes = tables["products"].select("product_id", "volume", *unit_space(tables["products"]))
    sized_lots = lots.join(volumes, "product_id", "left")
    source = sized_lots.join(drawn, "inventory_id", "left").select(
        F.col("inventory_id").alias("root_id"),
        "product_id",
        "volume",
        *[c for c in volumes.columns if c == UNIT_SPACE],
        F.col("warehouse_id").alias("source_warehouse"),
        F.col("storage_location").alias("source_location"),
        F.col("total_quantity").alias("source_total"),
        F.least("available_quantity", "total_quantity").alias("source_available"),
        # a lot that holds all that the batch asks of it refuses nothing
        (F.col("_drawn") <= F.least("available_quantity", "total_quantity")).alias("_ample"),
        "unit",
        "production_date",
        "expiry_date",
        "inventory_status",
    )
    places = landed(free_space(tables).withColumn("_place", F.monotonically_increasing_id()), "places")
    target = places.select(
        F.col("warehouse_id").alias("target_warehouse"),
        F.col("location").alias("target_location"),
        F.col("free_space").alias("target_space"),
        F.col("_place").alias("_to"),
    )
    # nothing can be put at a place that is not known, so it does not matter what leaves it
    origin = places.select(
        F.col("warehouse_id").alias("source_warehouse"),
        F.col("location").alias("source_location"),
        F.col("_place").alias("_from"),
    )
    found = requests.join(source, "root_id", "left")
    if chained:
        # the source is where the earlier request puts it, and holds what that one takes; 0 before it
        lost = F.col("source_warehouse").isNull()
        found = found.withColumns(
            {
                "source_warehouse": F.when(made & ~lost, F.col("made_warehouse")).otherwise(F.col("source_warehouse")),
                "source_location": F.when(made, F.col("made_location")).otherwise(F.col("source_location")),
                "source_total": F.when(made, F.col("made_quantity")).otherwise(F.col("source_total")),
                "source_available": F.when(made, 0).otherwise(F.col("source_available")),
            }
        )
    refusal = f"{NOT_ENOUGH_STOCK} or no space at the target"
    source_names = ("source_id", *(("source_request",) if chained else ()))
    about = ("product_id", "source_warehouse", "source_total", "target_warehouse", "target_location", "operator_id")
    about += ("unit", "production_date", "expiry_date", "inventory_status")
    enriched = (
        found.join(_known(tables["warehouses"], "warehouse_id", "target_warehouse", "_site"), "target_warehouse", "left")
        .join(target, ["target_warehouse", "target_location"], "left")
        .join(origin, ["source_warehouse", "source_location"], "left")
        # what only the reasons look at is neither moved nor landed
        .select(
            "request_id",
            *source_names,
            "quantity",
            *about,
            F.col("source_available").cast("bigint").alias("_room"),
            "_ample",
            space_of(volumes.columns, "quantity").alias("_space"),
            F.when(F.col("volume").isNotNull(), F.col("target_space")).alias("_to_room"),
            "_to",
            "_from",
            first_reason(
                (F.col("source_warehouse").isNull(), NO_SOURCE),
                (F.col("quantity").isNull() | (F.col("quantity") < 0), "quantity missing or negative"),
                (F.col("target_warehouse") == -1, "dropping a lot is a write-off request"),
                (F.col("_site").isNull(), "target warehouse not found"),
                (F.col("target_location").isNotNull() & F.col("_to").isNull(), "target location not found"),
                (F.col("operator_id").isNotNull() & F.col("_person").isNull(), "operator not found"),
                (~made & (F.col("quantity") > F.col("source_available")), refusal),
            ).alias("reason"),
        )
    )
    ranged = in_ranges(enriched, "request_id")
    valid = ranged.filter(F.col("reason").isNull())
    same = F.coalesce(F.col("_from") == F.col("_to"), F.lit(False))
    quantity = F.col("quantity").cast("bigint")
    nothing = F.lit(None).cast("bigint")
    arriving = F.when(same, 0).otherwise(F.col("_space")).cast("bigint")
    resource = _resources(valid, "request_id", *source_names)
    tight = _tight_places(valid, arriving)
    valid = valid.join(tight.toDF("_to", "_to_tight"), "_to", "left").join(tight.toDF("_from", "_from_tight"), "_from", "left")
    lot, room = resource("lot", F.col("source_id")), F.col("_room")
    if chained:
        lot = F.when(made, resource("made", F.col("source_request"))).otherwise(lot)
        # a lot of the batch is there once its request was accepted, which gives one more than it holds
        room = F.when(made, -1).otherwise(room).cast("bigint")
    needs = [
        (made | ~F.coalesce("_ample", F.lit(False)), lot, quantity, room),
        # moving within one place changes nothing there, but the place must not be over-full
        (F.col("_to_tight").isNotNull(), resource("place", F.col("_to")), arriving, F.col("_to_room")),
        (F.col("_from_tight").isNotNull() & ~same, resource("place", F.col("_from")), -F.col("_space"), nothing),
    ]
    wanted, before = [], F.lit(False)
    for asks, *need in needs:
        named = [c.alias(n) for c, n in zip((*need, ~before), ("resource", "amount", "room", "_head"), strict=True)]
        wanted.append(F.when(asks, F.struct(*named)))
        before = before | asks
    demands = valid.select("request_id", F.explode(F.array(*wanted)).alias("w"), "_range").filter("w is not null").select(
        "request_id", "w.*", "_range"
    )
    if chained:
        # what a request makes matters where another one asks for it
        asked = valid.filter(made).select(F.col("source_request").alias("request_id"))
        given = (resource("made", F.col("request_id")), -quantity - 1, nothing, ~before)
        makers = valid.select(
            "request_id", *[c.alias(n) for c, n in zip(given, ("resource", "amount", "room", "_head"), strict=True)], "_range"
        )
        demands = demands.unionByName(makers.join(asked, "request_id", "left_semi"))
    judged = _judged(ranged, demands, refusal, (*source_names, "quantity"))

    last_lot, last_entry = _last_id(lots, "inventory_id"), _last_id(tables["inventory_adjustments"], "adjustment_id")
    placed = landed(position_in_ranges(judged.filter("accepted"), "request_id"), "placed")
    new_ids = placed.select("request_id", (last_lot + F.col("position")).alias("new_id"))
    given = ranged.select("request_id", *about)
    # the log tells what earlier requests left in the source, new lots what later ones leave in them
    logged = running_sums(placed.withColumn("_lot", lot), ["_lot"], "request_id", {"_moved": F.col("quantity")})
    made_lots = placed.withColumn("_left", F.col("quantity"))
    if chained:
        onward = (
            placed.filter(made)
            .groupBy(F.col("source_request").alias("request_id"))
            .agg(F.sum("quantity").alias("_onward"))
        )
        made_lots = placed.join(onward, "request_id", "left").withColumn(
            "_left", F.col("quantity") - F.coalesce("_onward", F.lit(0))
        )
    made_lots = made_lots.join(given, "request_id")
    put = made_lots.select(
        "product_id",
        F.col("target_warehouse").alias("warehouse_id"),
        F.col("target_location").alias("storage_location"),
        F.col("_left").cast("int").alias("total_quantity"),
    )
    if chained:
        # sources of the batch by their new ids
        made_ids = new_ids.select(F.col("request_id").alias("source_request"), F.col("new_id").alias("_made_id"))
        logged, made_lots = _from_made(logged, made_ids), _from_made(made_lots, made_ids)
    ids = logged.join(given, "request_id").withColumns(
        {"new_id": last_lot + F.col("position"), "log_id": last_entry + F.col("position") * 2 - 1}
    )
    old_total = F.col("source_total") - F.col("_moved")
    new_lots = conform(
        made_lots.select(
            (last_lot + F.col("position")).alias("inventory_id"),
            "product_id",
            F.col("target_warehouse").alias("warehouse_id"),
            F.col("target_location").alias("storage_location"),
            F.col("_left").alias("total_quantity"),
            F.col("_left").alias("available_quantity"),
            "unit",
            "production_date",
            "expiry_date",
            (F.col("inventory_status") if inherit_status else F.lit("normal")).alias("inventory_status"),
            F.col("source_id").alias("parent_inventory_id"),
        ),
        schemas.INVENTORY,
        as_of,
    )

    # fixed values: adjustment type and reason texts
    def entry(log_id, warehouse, lot, before, after, change, reason):
        return F.struct(
            log_id.alias("adjustment_id"),
            F.lit("split").alias("adjustment_type"),
            warehouse.alias("warehouse_id"),
            F.col("product_id"),
            lot.alias("inventory_id"),
            before.cast("bigint").alias("before_quantity"),
            after.cast("bigint").alias("after_quantity"),
            change.cast("bigint").alias("quantity_change"),
            reason.alias("adjustment_reason"),
            F.col("operator_id").alias("operator"),
        )

    entries = F.array(
        entry(
            F.col("log_id"),
            F.col("target_warehouse"),
            F.col("new_id"),
            F.lit(0),
            quantity,
            quantity,
            F.concat(F.lit("split from "), F.col("source_id")),
        ),
        entry(
            F.col("log_id") + 1,
            F.col("source_warehouse"),
            F.col("source_id"),
            old_total,
            old_total - quantity,
            -quantity,
            F.concat(F.lit("split to "), F.col("new_id")),
        ),
    )
    new_log = conform(
        ids.select(F.explode(entries).alias("e")).select("e.*"), schemas.INVENTORY_ADJUSTMENTS, as_of
    )
    taken = (
        judged.filter(F.col("accepted") & ~made)
        .groupBy(F.col("source_id").alias("inventory_id"))
        .agg(F.sum("quantity").alias("_taken"))
    )
    remaining = _take_from_lots(lots, taken, None)
    if chained:
        asked = ("request_id", "source_request", "source_id", "accepted", "reason")
        judged = _from_made(_without_source(judged.select(*asked)), made_ids)
    results = judged.select("request_id", "source_id", "accepted", "reason").join(
        new_ids.withColumnRenamed("new_id", "new_inventory_id"), "request_id", "left"
    )
    changed = {
        "inventory": remaining.unionByName(new_lots),
        "inventory_adjustments": append(tables, "inventory_adjustments", new_log),
    }
    held = remaining.select(*put.columns).unionByName(put)
    return Outcome(
        _with_space(tables, changed, put, lots.join(taken, "inventory_id", "left_semi"), held=held),
        results,
        {"inventory": new_lots, "inventory_adjustments": new_log},
    )


def write_off_lots(tables: Tables, requests: DataFrame, as_of: When) -> Outcome:
    """Empty whole lots and log the loss.

    Requests: request_id, inventory_id, operator_id.  A second request for a lot finds it empty.
    """
    lots, log = tables["inventory"], tables["inventory_adjustments"]
    found = lots.select(
        "inventory_id", "product_id", "warehouse_id", "total_quantity", F.lit(True).alias("_lot")
    )
    enriched = (
        requests.join(found, "inventory_id", "left")
        .join(_known(tables["employees"], "employee_id", "operator_id", "_person"), "operator_id", "left")
        .withColumn(
            "reason",
            first_reason(
                (F.col("_lot").isNull(), "lot not found"),
                (F.col("operator_id").isNotNull() & F.col("_person").isNull(), "operator not found"),
            ),
        )
        .withColumn("accepted", F.col("reason").isNull())
    )
    ranged = in_ranges(enriched, "request_id")
    accepted = ranged.filter("accepted")
    first = accepted.groupBy("inventory_id").agg(F.min("request_id").alias("_first"))
    before = F.when(F.col("request_id") == F.col("_first"), F.col("total_quantity")).otherwise(0)
    numbered = position_in_ranges(accepted.join(first, "inventory_id"), "request_id")
    new_log = conform(
        numbered.select(
            (_last_id(log, "adjustment_id") + F.col("position")).alias("adjustment_id"),
            F.lit("write_off").alias("adjustment_type"),
            "warehouse_id",
            "product_id",
            "inventory_id",
            before.alias("before_quantity"),
            F.lit(0).alias("after_quantity"),
            (-before).alias("quantity_change"),
            F.lit("inventory drop").alias("adjustment_reason"),
            F.col("operator_id").alias("operator"),
        ),
        schemas.INVENTORY_ADJUSTMENTS,
        as_of,
    )
    emptied = first.select("inventory_id", F.lit(True).alias("_gone"))
    state = lots.join(emptied, "inventory_id", "left")
    for name in ("total_quantity", "locked_quantity", "available_quantity"):
        state = state.withColumn(name, F.when(F.col("_gone"), 0).otherwise(F.col(name)))
    changed = {
        "inventory": state.select(*lots.columns),
        "inventory_adjustments": append(tables, "inventory_adjustments", new_log),
    }
    return Outcome(
        _with_space(tables, changed, lots.join(emptied, "inventory_id", "left_semi")),
        ranged.select("request_id", "inventory_id", "accepted", "reason"),
        {"inventory_adjustments": new_log},
    )


def _create_orders(
    tables: Tables, table: schemas.Table, guarded: DataFrame, invalid: Column, as_of: When
) -> Outcome:
    """Number the accepted requests after the last order id and add them as pending orders."""
    key = table.key[0]
    judged = guarded.withColumn("reason", F.coalesce(invalid, F.col("rejection"))).withColumn(
        "accepted", F.col("reason").isNull()
    )
    ranged = in_ranges(judged, "request_id")
    numbered = position_in_ranges(ranged.filter("accepted"), "request_id").withColumn(
        key, _last_id(tables[table.name], key) + F.col("position")
    )
    rows = conform(numbered.withColumn("status", F.lit("pending")), table, as_of)
    results = ranged.select("request_id", "accepted", "reason").join(
        numbered.select("request_id", key), "request_id", "left"
    )
    return Outcome(
        ChainMap({table.name: append(tables, table.name, rows)}, tables), results, {table.name: rows}
    )


def _parties(tables: Tables, requests: DataFrame) -> DataFrame:
    return requests.join(
        _known(tables["warehouses"], "warehouse_id", "warehouse_id", "_site_known"), "warehouse_id", "left"
    ).join(_known(tables["products"], "product_id", "product_id", "_product_known"), "product_id", "left")


def _order_problems(kind: str, allowed: tuple[str, ...]) -> list[tuple[Column, str]]:
    return [
        (~F.coalesce(F.col(kind).isin(*allowed), F.lit(False)), "unknown order type"),
        (F.col("_site_known").isNull(), "warehouse not found"),
        (F.col("product_id").isNotNull() & F.col("_product_known").isNull(), "product not found"),
    ]


def create_inbound_orders(tables: Tables, requests: DataFrame, as_of: When) -> Outcome:
    """Add pending inbound orders.

    Requests: request_id, inbound_type, product_id, warehouse_id, expected_quantity, total_items,
    operator, notes.
    """
    known = _parties(tables, requests).join(
        _known(tables["employees"], "employee_id", "operator", "_operator_known"), "operator", "left"
    )
    invalid = first_reason(
        *_order_problems("inbound_type", schemas.INBOUND_TYPES),
        (F.col("_operator_known").isNull(), "operator not found"),
        (F.col("expected_quantity") < 0, "expected quantity is negative"),
    )
    guarded = inbound_operator_guard(tables, known)
    return _create_orders(tables, schemas.INBOUND_ORDERS, guarded, invalid, as_of)


def create_outbound_orders(tables: Tables, requests: DataFrame, as_of: When) -> Outcome:
    """Add pending outbound orders.

    Requests: request_id, outbound_type, product_id, warehouse_id, total_items, total_quantity,
    picker, packer.
    """
    known = (
        _parties(tables, requests)
        .join(_known(tables["employees"], "employee_id", "picker", "_picker_known"), "picker", "left")
        .join(_known(tables["employees"], "employee_id", "packer", "_packer_known"), "packer", "left")
    )
    invalid = first_reason(
        *_order_problems("outbound_type", schemas.OUTBOUND_TYPES),
        (F.col("picker").isNotNull() & F.col("_picker_known").isNull(), "picker not found"),
        (F.col("packer").isNotNull() & F.col("_packer_known").isNull(), "packer not found"),
    )
    guarded = outbound_operator_guard(tables, known)
    return _create_orders(tables, schemas.OUTBOUND_ORDERS, guarded, invalid, as_of)


def complete_inbound(tables: Tables, requests: DataFrame, as_of: When, strict: bool = False) -> Outcome:
    """Receive inbound orders: close them and put the goods away as new lots.

    Requests: request_id, inbound_id, actual_quantity, location.  ``strict`` also refuses orders
    that are closed, or closed by an earlier request; by default receiving again adds stock again.
    """
    orders, lots = tables["inbound_orders"], tables["inventory"]
    order = orders.select("inbound_id", "product_id", "warehouse_id", F.col("status").alias("_status"))
    products = tables["products"].select("product_id", "volume", F.lit(True).alias("_product"))
    places = free_space(tables).withColumn("_place", F.lit(True))
    problems = [
        (F.col("warehouse_id").isNull(), "order not found"),
        (
            F.col("quantity").isNull() | (F.col("quantity") < 0),
            "quantity missing or negative",
        ),
        (F.col("_product").isNull(), "order has no known product"),
        (F.col("_site").isNull(), "warehouse not found"),
        (F.col("location").isNotNull() & F.col("_place").isNull(), "location not found"),
    ]
    if strict:
        problems.append((F.col("_status").isin("completed", "cancelled"), ORDER_CLOSED))
    enriched = (
        requests.withColumnRenamed("actual_quantity", "quantity")
        .join(order, "inbound_id", "left")
        .join(products, "product_id", "left")
        .join(_known(tables["warehouses"], "warehouse_id", "warehouse_id", "_site"), "warehouse_id", "left")
        .join(places, ["warehouse_id", "location"], "left")
        # what only the reasons look at is neither moved nor landed
        .select(
            "request_id",
            "inbound_id",
            "product_id",
            "warehouse_id",
            "location",
            "quantity",
            space_units(F.col("volume") * F.col("quantity")).alias("_space"),
            F.when(F.col("volume").isNotNull(), F.col("free_space")).alias("_room"),
            first_reason(*problems).alias("reason"),
        )
    )
    ranged = in_ranges(enriched, "request_id")
    demands = ranged.filter(F.col("reason").isNull() & F.col("location").isNotNull()).select(
        "request_id",
        place_of("warehouse_id", "location").alias("resource"),
        F.col("_space").alias("amount"),
        F.col("_room").alias("room"),
        "_range",
    )
    refusal = NO_SPACE
    if strict:
        demands = demands.unionByName(_once_per_order(ranged, "inbound_id"))
        refusal = f"{NO_SPACE}, or {ORDER_CLOSED}"
    kept = ("inbound_id", "product_id", "warehouse_id", "location", "quantity")
    judged = _judged(ranged, demands, refusal, kept, single=not strict)
    accepted = judged.filter("accepted")
    numbered = position_in_ranges(accepted, "request_id").withColumn(
        "new_id", _last_id(lots, "inventory_id") + F.col("position")
    )
    new_lots = conform(
        numbered.select(
            F.col("new_id").alias("inventory_id"),
            "product_id",
            "warehouse_id",
            F.col("location").alias("storage_location"),
            F.col("quantity").alias("total_quantity"),
            F.col("quantity").alias("available_quantity"),
        ),
        schemas.INVENTORY,
        as_of,
    )
    last = accepted.groupBy("inbound_id").agg(F.max_by("quantity", "request_id").alias("_received"))
    hit = F.col("_received").isNotNull()
    state = (
        orders.join(last, "inbound_id", "left")
        .withColumns(
            {
                "status": F.when(hit, "completed").otherwise(F.col("status")),
                "actual_quantity": F.coalesce("_received", "actual_quantity").cast("int"),
                "received_time": F.when(hit, stamp(as_of)).otherwise(F.col("received_time")),
            }
        )
        .select(*orders.columns)
    )
    results = judged.select("request_id", "inbound_id", "accepted", "reason").join(
        numbered.select("request_id", F.col("new_id").alias("new_inventory_id")), "request_id", "left"
    )
    changed = {"inbound_orders": state, "inventory": append(tables, "inventory", new_lots)}
    closed = last.select("inbound_id", F.lit("completed").alias("status"))
    alert_changes = _with_alerts(tables, changed, _updated(orders, closed, "inbound_id"), INBOUND, as_of)
    return Outcome(
        _with_space(tables, changed, new_lots),
        results,
        {"inventory": new_lots},
        alert_changes,
    )


def complete_outbound(tables: Tables, requests: DataFrame, as_of: When, strict: bool = False) -> Outcome:
    """Ship outbound orders from given lots.

    Requests: request_id, inventory_id, outbound_id.  ``strict`` also refuses closed orders, orders
    closed by an earlier request, and lots of another product or site.
    """
    orders, lots = tables["outbound_orders"], tables["inventory"]
    order = orders.select(
        "outbound_id",
        F.col("total_quantity").alias("quantity"),
        F.col("status").alias("_status"),
        F.col("product_id").alias("_order_product"),
        F.col("warehouse_id").alias("_order_site"),
        F.lit(True).alias("_order"),
    )
    lot = lots.select(
        "inventory_id",
        F.least("available_quantity", "total_quantity").alias("_available"),
        F.col("product_id").alias("_lot_product"),
        F.col("warehouse_id").alias("_lot_site"),
        F.lit(True).alias("_lot"),
    )
    problems = [
        (F.col("_order").isNull(), "order not found"),
        (F.col("_lot").isNull(), "lot not found"),
        (F.col("quantity").isNull() | (F.col("quantity") < 0), "quantity missing or negative"),
    ]
    if strict:
        problems += [
            (F.col("_status").isin("shipped", "cancelled"), ORDER_CLOSED),
            (~F.col("_order_product").eqNullSafe(F.col("_lot_product")), "lot holds another product"),
            (F.col("_order_site") != F.col("_lot_site"), "lot is at another site"),
        ]
    enriched = (
        requests.join(order, "outbound_id", "left")
        .join(lot, "inventory_id", "left")
        # what only the reasons look at is neither moved nor landed
        .select(
            "request_id", "outbound_id", "inventory_id", "quantity", "_available", first_reason(*problems).alias("reason")
        )
    )
    ranged = in_ranges(enriched, "request_id")
    demands = ranged.filter(F.col("reason").isNull()).select(
        "request_id",
        F.concat(F.lit("lot/"), F.col("inventory_id")).alias("resource"),
        F.col("quantity").cast("bigint").alias("amount"),
        F.col("_available").cast("bigint").alias("room"),
        "_range",
    )
    refusal = NOT_ENOUGH_STOCK
    if strict:
        demands = demands.unionByName(_once_per_order(ranged, "outbound_id"))
        refusal = f"{NOT_ENOUGH_STOCK}, or {ORDER_CLOSED}"
    judged = _judged(ranged, demands, refusal, ("outbound_id", "inventory_id", "quantity"), single=not strict)
    accepted = judged.filter("accepted")
    shipped = accepted.select("outbound_id", F.lit(True).alias("_shipped")).distinct()
    state = (
        orders.join(shipped, "outbound_id", "left")
        .withColumns(
            {
                "status": F.when(F.col("_shipped"), "shipped").otherwise(F.col("status")),
                "shipped_time": F.when(F.col("_shipped"), stamp(as_of)).otherwise(F.col("shipped_time")),
            }
        )
        .select(*orders.columns)
    )
    taken = accepted.groupBy("inventory_id").agg(F.sum("quantity").alias("_taken"))
    changed = {"outbound_orders": state, "inventory": _take_from_lots(lots, taken, stamp(as_of))}
    closed = shipped.select("outbound_id", F.lit("shipped").alias("status"))
    alert_changes = _with_alerts(tables, changed, _updated(orders, closed, "outbound_id"), OUTBOUND, as_of)
    return Outcome(
        _with_space(tables, changed, lots.join(taken, "inventory_id", "left_semi")),
        judged.select("request_id", "outbound_id", "inventory_id", "accepted", "reason"),
        alert_changes=alert_changes,
    )


def update_employee_status(tables: Tables, requests: DataFrame, as_of: When | None = None) -> Outcome:
    """Change staff status; each result names the status before and after.

    Requests: request_id, employee_id, new_status.
    """
    staff = tables["employees"]
    stored = staff.select("employee_id", F.col("employment_status").alias("_stored"), F.lit(True).alias("_person"))
    valid = F.coalesce(F.col("new_status").isin(*schemas.EMPLOYMENT_STATUSES), F.lit(False))
    enriched = requests.join(stored, "employee_id", "left").withColumn(
        "reason",
        first_reason(
            # fixed value: the message for unknown staff
            (F.col("_person").isNull(), "Error: Employee does not exist"),
            (~valid, "unknown status"),
        ),
    ).withColumn("accepted", F.col("reason").isNull())
    ranged = in_ranges(enriched, "request_id")
    changes = previous_value(
        ranged.filter("accepted"), "employee_id", "request_id", "new_status", "_previous"
    )
    # fixed value: the wording, spelled as it is
    message = F.concat(
        F.lit("Change employee status form "),
        F.coalesce("_previous", "_stored"),
        F.lit(" to "),
        F.col("new_status"),
    )
    refused = ranged.filter("not accepted").withColumn("_previous", F.lit(None).cast("string"))
    results = changes.unionByName(refused).select(
        "request_id",
        "employee_id",
        "accepted",
        F.when(F.col("accepted"), message).otherwise(F.col("reason")).alias("message"),
    )
    last = (
        ranged.filter("accepted")
        .groupBy("employee_id")
        .agg(F.max_by("new_status", "request_id").alias("_status"))
    )
    state = (
        staff.join(last, "employee_id", "left")
        .withColumn("employment_status", F.coalesce("_status", "employment_status"))
        .select(*staff.columns)
    )
    return Outcome(ChainMap({"employees": state}, tables), results)
