"""What removing or renaming parents does to the rows that refer to them.

``removed`` maps a table name to a DataFrame with the key columns of the rows to remove.
"""

from __future__ import annotations

from collections import ChainMap
from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stocklens.operators.utilization import utilization_on_delete
from stocklens.session import landed
from stocklens.sources.schemas import ALERT_TABLES, TABLES, Reference

Tables = Mapping[str, DataFrame]

_DECLARED = {**TABLES, **ALERT_TABLES}


def _as_child(parent_keys: DataFrame, reference: Reference) -> DataFrame:
    pairs = zip(reference.columns, reference.parent_columns, strict=True)
    return parent_keys.select(*[F.col(p).alias(c) for c, p in pairs])


def _cascades(name: str, gone: Mapping[str, DataFrame]) -> list[Reference]:
    references = _DECLARED[name].references
    return [r for r in references if r.on_delete == "cascade" and r.parent in gone]


def _is_parent(name: str, tables: Tables) -> bool:
    return any(r.parent == name for child in tables for r in _DECLARED[child].references)


def removed_rows(tables: Tables, removed: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """Keys that go, per table others refer to, as removal is passed on along cascading references.

    Keys found on the way are landed: several tables look them up.
    """
    gone: dict[str, DataFrame] = {}
    for name, table in _DECLARED.items():  # parents come first
        if name not in tables or not _is_parent(name, tables):
            continue
        wanted = [removed[name].select(*table.key)] if name in removed else []
        dependents = []
        for reference in _cascades(name, gone):
            keys = _as_child(gone[reference.parent], reference)
            found = tables[name].join(keys, list(reference.columns), "left_semi")
            dependents.append(found.select(*table.key))
        if wanted or dependents:
            keys = reduce(DataFrame.unionByName, wanted + dependents).distinct()
            gone[name] = landed(keys, f"removed-{name}") if dependents else keys
    return gone


def _without(
    tables: Tables, removed: Mapping[str, DataFrame], gone: Mapping[str, DataFrame]
) -> dict[str, DataFrame]:
    """Rows neither removed themselves nor dependent on a removed row.

    Tables others refer to have their own keys in ``gone``; the rest look up their parents' keys.
    """
    kept = {}
    for name, df in tables.items():
        key = list(_DECLARED[name].key)
        if name in gone:
            df = df.join(gone[name], key, "left_anti")
        elif not _is_parent(name, tables):
            if name in removed:
                df = df.join(removed[name].select(*key), key, "left_anti")
            for reference in _cascades(name, gone):
                keys = _as_child(gone[reference.parent], reference)
                df = df.join(keys, list(reference.columns), "left_anti")
        kept[name] = df
    return kept


def cascade_delete(tables: Tables, removed: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """The tables without the removed rows and everything that depends on them.

    Places that lose lots get their space back.
    """
    gone = removed_rows(tables, removed)
    return _freed(tables, _without(tables, removed, gone), gone)


def _freed(before: Tables, after: dict[str, DataFrame], gone: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """``after`` with the space use of the places whose lots went computed anew; lots are in ``gone`` by key."""
    if "inventory" not in gone or not {"inventory", "locations", "products"} <= set(after):
        return after
    lost = before["inventory"].join(gone["inventory"], "inventory_id", "left_semi")
    return {**after, "locations": utilization_on_delete(after, lost)}


def null_on_delete(tables: Tables, gone: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """The tables with optional references to ``gone`` rows set to NULL."""
    result = dict(tables)
    for name, table in _DECLARED.items():
        for reference in table.references:
            if name not in result or reference.on_delete != "null" or reference.parent not in gone:
                continue
            df = result[name]
            keys = _as_child(gone[reference.parent], reference).distinct().withColumn("_gone", F.lit(True))
            column = reference.columns[0]
            result[name] = (
                df.join(keys, column, "left")
                .withColumn(column, F.when(F.col("_gone").isNull(), F.col(column)))
                .select(*df.columns)
            )
    return result


def restrict_delete(tables: Tables, removed: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """Per table, the requested keys that must stay because other rows need them."""
    blocked: dict[str, DataFrame] = {}
    for name, wanted in removed.items():
        key = list(_DECLARED[name].key)
        uses = []
        for child, table in _DECLARED.items():
            for reference in table.references:
                if reference.on_delete == "restrict" and reference.parent == name and child in tables:
                    pairs = zip(reference.columns, reference.parent_columns, strict=True)
                    uses.append(tables[child].select(*[F.col(c).alias(p) for c, p in pairs]).distinct())
        if uses:
            used = reduce(DataFrame.unionByName, uses)
            blocked[name] = wanted.select(*key).distinct().join(used, key, "left_semi")
    return blocked


def delete_rows(
    tables: Tables, removed: Mapping[str, DataFrame]
) -> tuple[dict[str, DataFrame], dict[str, DataFrame]]:
    """Remove rows under all three policies: (tables afterwards, keys that were refused)."""
    refused = restrict_delete(tables, removed)
    allowed = {
        name: keys.join(refused[name], list(_DECLARED[name].key), "left_anti") if name in refused else keys
        for name, keys in removed.items()
    }
    gone = removed_rows(tables, allowed)
    left = null_on_delete(_without(tables, allowed, gone), gone)
    return _freed(tables, left, gone), refused


def cascade_rename_location(tables: Tables, renames: DataFrame) -> Tables:
    """Rename locations, on the locations and on their lots.

    ``renames``: warehouse_id, location, new_location.  Two places may not end under one name: renaming
    to the name of a place that stays, or two places to one name, is an error.  So are two new names for one place.
    """
    locations, lots = tables["locations"], tables["inventory"]
    renames = renames.distinct()
    twice = renames.groupBy("warehouse_id", "location").count().filter("count > 1").first()
    if twice:
        raise ValueError(f"{twice['location']} at {twice['warehouse_id']} has two new names")
    named = (
        locations.select("warehouse_id", "location")
        .join(renames, ["warehouse_id", "location"], "left")
        .groupBy("warehouse_id", F.coalesce("new_location", "location").alias("location"))
        .count()
    )
    clash = named.filter("count > 1").first()
    if clash:
        raise ValueError(f"two locations would be named {clash['location']} at {clash['warehouse_id']}")
    moved = (
        locations.join(renames, ["warehouse_id", "location"], "left")
        .withColumn("location", F.coalesce("new_location", "location"))
        .select(*locations.columns)
    )
    on_lots = renames.withColumnRenamed("location", "storage_location")
    relabelled = (
        lots.join(on_lots, ["warehouse_id", "storage_location"], "left")
        .withColumn("storage_location", F.coalesce("new_location", "storage_location"))
        .select(*lots.columns)
    )
    return ChainMap({"locations": moved, "inventory": relabelled}, tables)
