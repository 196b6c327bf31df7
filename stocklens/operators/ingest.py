"""Adding new rows to tables: defaults, rules and guards, split into accepted and rejected."""

from __future__ import annotations

import datetime as dt
from collections import ChainMap
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stocklens.functions.columns import stamp
from stocklens.functions.scale import in_ranges
from stocklens.operators.admission import admit
from stocklens.operators.guards import (
    free_space,
    inbound_operator_guard,
    outbound_operator_guard,
    place_of,
    space_units,
)
from stocklens.operators.rules import reference_rule, violations, with_orphan_rules
from stocklens.operators.utilization import utilization_on_insert
from stocklens.session import landed
from stocklens.sources import schemas

Tables = Mapping[str, DataFrame]


@dataclass(frozen=True)
class Ingested:
    accepted: DataFrame
    rejected: DataFrame  # the rows plus ``violations``


@dataclass(frozen=True)
class IngestedTables:
    """The state of all tables after an ingest, and the rows of every batch by table."""

    tables: Tables
    accepted: dict[str, DataFrame]
    rejected: dict[str, DataFrame]  # the rows plus ``violations``


def ingest_tables(
    tables: Tables, batches: Mapping[str, DataFrame], as_of: dt.datetime | str
) -> IngestedTables:
    """Add batches of several tables, parents before children, and give the state that they leave.

    Each batch has a unique ``row_order``.  The order of the tables follows their references; a row whose parent is
    neither stored nor accepted is rejected, and so is whatever refers to it.  Lots take space at
    locations of the same ingest too, and the space use of the places they touch is computed anew.  Each
    batch is judged once, over landed rows; a table without a batch is not read unless it is referred to.
    """
    unknown = set(batches) - set(schemas.TABLES)
    if unknown:
        raise ValueError(f"no such tables: {', '.join(sorted(unknown))}")
    state: Tables = ChainMap({}, tables)
    accepted, rejected = {}, {}
    for name in schemas.parents_first(batches):
        done = ingest_batch(state, name, batches[name], as_of, check_references=True)
        accepted[name] = landed(done.accepted, f"accepted-{name}")
        rejected[name] = landed(done.rejected, f"rejected-{name}")
        new = {name: state[name].unionByName(accepted[name].select(*state[name].columns))}
        if name == "inventory":
            after = ChainMap(new, state)
            new["locations"] = landed(utilization_on_insert(after, accepted[name]), "locations")
        state = ChainMap(new, state)
    return IngestedTables(state, accepted, rejected)


def with_defaults(batch: DataFrame, table: schemas.Table, as_of: dt.datetime | str) -> DataFrame:
    """Rows of ``table``: absent columns, and NULLs of columns with a default, are filled."""
    columns = []
    for c in table.columns:
        given = F.col(c.name) if c.name in batch.columns else F.lit(None)
        value = given.cast(c.type)
        if c.default is not None:
            default = stamp(as_of) if c.default == schemas.AS_OF else F.lit(c.default)
            value = F.coalesce(value, default.cast(c.type))
        columns.append(value.alias(c.name))
    return batch.select("row_order", *columns)


def ingest_batch(
    tables: Tables,
    name: str,
    batch: DataFrame,
    as_of: dt.datetime | str,
    check_references: bool = False,
) -> Ingested:
    """Judge ``batch`` (with a unique ``row_order``) as if its rows were added one by one.

    Key and unique values may exist once, so they are resources with room for one; lots also need
    space at their location.  A rejected row neither holds its key nor takes space.
    """
    table = schemas.TABLES[name]
    own = [r for r in table.references if r.parent == name and check_references]
    no_key = [F.when(F.col(c).isNull(), F.lit(f"{c}_required")) for c in table.key]
    broken = F.array_union(violations(table), F.array_compact(F.array(*no_key)))
    rows = with_defaults(batch, table, as_of).withColumn("violations", broken)
    rows = _guarded(tables, name, rows)
    if check_references:
        rows = _with_orphans(tables, table, rows)
    for reference in own:
        rows = _with_own_parents(tables, reference, rows)
    if name == "inventory":
        rows = _with_space(tables, rows)
    ranged = in_ranges(rows.withColumn("request_id", F.col("row_order").cast("bigint")), "request_id")
    # only the keys of valid rows meet the stored ones, not whole rows
    valid = ranged.filter(F.size("violations") == 0)
    for columns in _single_use(table):
        taken = tables[name].select(*columns).distinct().withColumn(_flag(columns), F.lit(True))
        valid = valid.join(taken, list(columns), "left")
    verdicts = admit(landed(_demands(table, valid, own), "demands"))
    refused = F.array(F.lit(f"key_or_unique_value_taken{'_or_no_space' if name == 'inventory' else ''}"))
    judged = ranged.join(verdicts, "request_id", "left")
    fine = F.size("violations") == 0
    for reference in own:
        # rows whose parent was itself refused, or came later, say so
        made = judged.filter(fine & F.coalesce("accepted", F.lit(True)))
        made = made.groupBy(F.col(reference.parent_columns[0]).alias(reference.columns[0]))
        made = made.agg(F.min("request_id").alias("_made_at"))
        judged = judged.join(made, reference.columns[0], "left")
        missing = F.coalesce(F.col("_made_at") >= F.col("request_id"), F.lit(True))
        refused = F.when(F.col(_inner(reference)) & missing, F.array(F.lit(reference_rule(reference)))).otherwise(refused)
    judged = judged.withColumn(
        "violations",
        F.when(fine & ~F.coalesce("accepted", F.lit(True)), refused).otherwise(F.col("violations")),
    )
    good = F.size("violations") == 0
    return Ingested(
        judged.filter(good).select(*table.names),
        judged.filter(~good).select("row_order", *table.names, "violations"),
    )


def _single_use(table: schemas.Table) -> list[tuple[str, ...]]:
    return [table.key, *[(c,) for c in table.unique]]


def _flag(columns: tuple[str, ...]) -> str:
    return "_taken_" + "_".join(columns)


def _guarded(tables: Tables, name: str, rows: DataFrame) -> DataFrame:
    guards = {"inbound_orders": inbound_operator_guard, "outbound_orders": outbound_operator_guard}
    if name not in guards:
        return rows
    checked = guards[name](tables, rows)
    noted = F.array_compact(F.array("rejection"))
    return checked.withColumn("violations", F.concat("violations", noted)).drop("rejection")


def _with_orphans(tables: Tables, table: schemas.Table, rows: DataFrame) -> DataFrame:
    """Add the name of each broken reference; rows may refer to any row of the same batch here."""
    parents = dict(tables)
    for reference in table.references:
        if reference.parent == table.name:
            keys = reference.parent_columns
            parents[table.name] = tables[table.name].select(*keys).union(rows.select(*keys))
    return (
        with_orphan_rules(rows, table, parents)
        .withColumn("violations", F.concat("violations", "broken_references"))
        .drop("broken_references")
    )


def _inner(reference: schemas.Reference) -> str:
    return f"_inner_{reference.columns[0]}"


def _with_own_parents(tables: Tables, reference: schemas.Reference, rows: DataFrame) -> DataFrame:
    """Mark rows whose parent, of the same table, only the batch can hold, and rows that are such a parent."""
    (column,), (key,) = reference.columns, reference.parent_columns
    stored = tables[reference.parent].select(F.col(key).alias(column), F.lit(True).alias("_stored")).distinct()
    other = F.col(column).isNotNull() & ~F.col(column).eqNullSafe(F.col(key))
    marked = rows.join(stored, column, "left").withColumn(_inner(reference), other & F.col("_stored").isNull())
    needed = marked.filter(F.col(_inner(reference))).select(F.col(column).alias(key)).distinct()
    return marked.drop("_stored").join(needed.withColumn(f"_parent{_inner(reference)}", F.lit(True)), key, "left")


def _with_space(tables: Tables, rows: DataFrame) -> DataFrame:
    places = free_space(tables).withColumnRenamed("location", "storage_location")
    return (
        rows.join(tables["products"].select("product_id", "volume"), "product_id", "left")
        .join(places, ["warehouse_id", "storage_location"], "left")
        .withColumn("_space", space_units(F.col("volume") * F.col("total_quantity")))
    )


def _demands(table: schemas.Table, valid: DataFrame, own: list[schemas.Reference]) -> DataFrame:
    demand = "struct<resource:string,amount:bigint,room:bigint>"
    one = F.lit(1).cast("bigint")

    def need(resource: Column, amount: int, room: int | None) -> Column:
        values = (F.lit(v).cast("bigint") for v in (amount, room))
        return F.struct(resource, *values).cast(demand)

    wanted = []
    for columns in _single_use(table):
        text = F.concat_ws("/", F.lit("_".join(columns)), *[F.col(c).cast("string") for c in columns])
        room = F.when(F.col(_flag(columns)), 0).otherwise(1)
        complete = F.lit(True)
        for c in columns:
            complete = complete & F.col(c).isNotNull()
        wanted.append(
            F.when(
                complete, F.struct(text.alias("resource"), one.alias("amount"), room.alias("room")).cast(demand)
            )
        )
    if table.name == "inventory":
        place = place_of("warehouse_id", "storage_location")
        room = F.when(F.col("volume").isNotNull(), F.col("free_space"))
        wanted.append(
            F.when(
                F.col("storage_location").isNotNull(),
                F.struct(place.alias("resource"), F.col("_space").alias("amount"), room.alias("room")).cast(demand),
            )
        )
    for reference in own:
        # a row is there for its children once it was accepted
        there = F.lit(f"there_{reference.columns[0]}/")
        parent = F.concat(there, F.col(reference.columns[0]).cast("string"))
        itself = F.concat(there, F.col(reference.parent_columns[0]).cast("string"))
        wanted.append(F.when(F.col(_inner(reference)), need(parent, 0, -1)))
        wanted.append(F.when(F.col(f"_parent{_inner(reference)}"), need(itself, -1, None)))
    exploded = valid.select("request_id", "_range", F.explode(F.array_compact(F.array(*wanted))).alias("w"))
    return exploded.select("request_id", "w.*", "_range")
