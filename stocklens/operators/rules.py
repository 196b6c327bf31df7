"""Declared rules as audits: rows that break a rule, with the rule's name.

A check fails only when it is FALSE; an unknown value passes, as SQL constraints have it.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stocklens.functions.columns import not_false
from stocklens.session import landed
from stocklens.sources.schemas import ALERT_TABLES, TABLES, Reference, Table

Tables = Mapping[str, DataFrame]

#: About how many keys a task counts.
KEYS_PER_TASK = 500_000


def key_text(table: Table, columns: Iterable[str] | None = None) -> Column:
    """The key of a row as text; parts joined by ``/``, unknown parts as ``?``."""
    names = list(columns or table.key)
    return F.concat_ws("/", *[F.coalesce(F.col(c).cast("string"), F.lit("?")) for c in names])


def required_rules(table: Table) -> list[tuple[str, Column]]:
    needed = [c.name for c in table.columns if c.required]
    return [(f"{c}_required", F.col(c).isNull()) for c in needed]


def allowed_value_rules(table: Table) -> list[tuple[str, Column]]:
    """A value outside the column's list; NULL passes."""
    return [
        (f"{c.name}_allowed", ~not_false(F.col(c.name).isin(*c.allowed)))
        for c in table.columns
        if c.allowed
    ]


def check_rules(table: Table) -> list[tuple[str, Column]]:
    return [(name, ~not_false(F.expr(condition))) for name, condition in table.checks]


def length_rules(table: Table) -> list[tuple[str, Column]]:
    return [
        (f"{c.name}_length", ~not_false(F.char_length(F.col(c.name)) <= c.max_chars))
        for c in table.columns
        if c.max_chars
    ]


ROW_RULES = {
    "required": required_rules,
    "allowed": allowed_value_rules,
    "checks": check_rules,
    "lengths": length_rules,
}


def violations(table: Table, kinds: Iterable[str] = tuple(ROW_RULES)) -> Column:
    """Names of the row rules a row breaks, all found in one pass."""
    rules = [rule for kind in kinds for rule in ROW_RULES[kind](table)]
    if not rules:
        return F.array().cast("array<string>")
    return F.array_compact(F.array(*[F.when(broken, F.lit(name)) for name, broken in rules]))


def _all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _row_audit(tables: Tables, kind: str) -> DataFrame:
    parts = []
    for name, df in _present(tables, TABLES):
        table = TABLES[name]
        if ROW_RULES[kind](table):
            parts.append(
                df.select(
                    F.lit(name).alias("table_name"),
                    key_text(table).alias("row_key"),
                    F.explode(violations(table, (kind,))).alias("rule"),
                )
            )
    return _all(parts)


def _present(tables: Tables, declared: Mapping[str, Table]):
    return [(name, tables[name]) for name in declared if name in tables]


def audit_not_null(tables: Tables) -> DataFrame:
    """Rows without a required value."""
    return _row_audit(tables, "required")


def audit_enums(tables: Tables) -> DataFrame:
    """Rows with a value outside its list."""
    return _row_audit(tables, "allowed")


def audit_checks(tables: Tables) -> DataFrame:
    """Rows with negative quantities, wrong totals or over-full locations."""
    return _row_audit(tables, "checks")


def audit_lengths(tables: Tables) -> DataFrame:
    """Rows with a text longer than its column allows."""
    return _row_audit(tables, "lengths")


def _repeated(df: DataFrame, table: Table, columns: tuple[str, ...], rule: str) -> DataFrame:
    return (
        df.groupBy(*columns)
        .agg(F.count("*").alias("occurrences"))
        .filter("occurrences > 1")
        .select(
            F.lit(table.name).alias("table_name"),
            key_text(table, columns).alias("row_key"),
            F.lit(rule).alias("rule"),
            "occurrences",
        )
    )


def audit_primary_keys(tables: Tables) -> DataFrame:
    """Keys that occur more than once or are not complete, with how often they occur.

    Keys are landed and counted first, so that there are as many tasks as they need.
    """
    parts = []
    for name, df in _present(tables, TABLES):
        table = TABLES[name]
        missing = reduce(Column.__or__, [F.col(c).isNull() for c in table.key])
        keys = landed(df.select(*table.key), "keys")
        tasks = -(-keys.filter(~missing).count() // KEYS_PER_TASK)
        # many rows may lack the same part: these are summed up before they are moved
        spread = keys.filter(~missing).repartition(max(1, tasks), *table.key)
        for rows, rule, least in ((keys.filter(missing), "key_missing", 1), (spread, "key_repeated", 2)):
            counted = rows.groupBy(*table.key).agg(F.count("*").alias("occurrences"))
            parts.append(
                counted.filter(F.col("occurrences") >= least).select(
                    F.lit(name).alias("table_name"), key_text(table).alias("row_key"), F.lit(rule).alias("rule"), "occurrences"
                )
            )
    return _all(parts)


def audit_unique(tables: Tables) -> DataFrame:
    """Values of unique columns that occur more than once; NULL may repeat."""
    parts = [
        _repeated(df.filter(F.col(c).isNotNull()), TABLES[name], (c,), f"{c}_unique")
        for name, df in _present(tables, TABLES)
        for c in TABLES[name].unique
    ]
    return _all(parts)


def with_orphan_rules(df: DataFrame, table: Table, parents: Mapping[str, DataFrame]) -> DataFrame:
    """``df`` plus ``broken_references``: names of complete references that find no parent.

    All references of a row are looked up in one pass over the table; an incomplete reference
    passes.  Parent keys are made distinct first, so a repeated parent does not repeat rows.
    """
    marks = []
    for number, reference in enumerate(table.references):
        if reference.parent not in parents:
            continue
        pairs = zip(reference.columns, reference.parent_columns, strict=True)
        keys = parents[reference.parent].select(*[F.col(p).alias(c) for c, p in pairs]).distinct()
        found = f"_parent_{number}"
        df = df.join(keys.withColumn(found, F.lit(True)), list(reference.columns), "left")
        complete = reduce(Column.__and__, [F.col(c).isNotNull() for c in reference.columns])
        marks.append((found, F.when(complete & F.col(found).isNull(), reference_rule(reference))))
    noted = F.array_compact(F.array(*[mark for _, mark in marks])).cast("array<string>")
    return df.withColumn("broken_references", noted).drop(*[found for found, _ in marks])


def reference_rule(reference: Reference) -> str:
    return f"{'_and_'.join(reference.columns)}_in_{reference.parent}"


def _target(reference: Reference) -> str:
    return f"{reference.parent}.{'/'.join(reference.parent_columns)}"


#: What tells keys apart: the place of what they refer to, and the key as a number or, if it is none, as text.
_KEY = ["place", "number", "text"]


def _places(tables: Tables) -> dict[str, tuple[int, bool]]:
    """Everything referred to, with a number for it and whether all its keys, here and there, are whole numbers."""
    found: dict[str, bool] = {}
    for name, df in _present(tables, {**TABLES, **ALERT_TABLES}):
        for r in {**TABLES, **ALERT_TABLES}[name].references:
            if r.parent in tables:
                sides = [df.schema[c] for c in r.columns] + [tables[r.parent].schema[c] for c in r.parent_columns]
                whole = len(r.columns) == 1 and all(isinstance(f.dataType, T.IntegerType | T.LongType) for f in sides)
                found[_target(r)] = found.get(_target(r), True) and whole
    return {target: (place, found[target]) for place, target in enumerate(sorted(found))}


def _link(place: tuple[int, bool], columns: Iterable[str], rule: str | None = None) -> Column:
    """What a complete key refers to; NULL where a part of it is missing."""
    names, (number, whole) = list(columns), place
    parts = [
        F.lit(number).alias("place"),
        (F.col(names[0]).cast("bigint") if whole else F.lit(0).cast("bigint")).alias("number"),
        (F.lit("") if whole else F.concat_ws("\x1f", *[F.col(c).cast("string") for c in names])).alias("text"),
    ]
    if rule:
        parts.append(F.lit(rule).alias("rule"))
    return F.when(reduce(Column.__and__, [F.col(c).isNotNull() for c in names]), F.struct(*parts))


def orphan_keys(tables: Tables) -> DataFrame:
    """Every key that some row refers to and no parent has: ``place`` (of :func:`_places`), ``number`` and ``text``.

    Children are reduced to the distinct keys they use, all references in one scan of each table, and parents
    give their keys: rows themselves meet nothing.
    """
    used, given, places = [], {}, _places(tables)
    for name, df in _present(tables, {**TABLES, **ALERT_TABLES}):
        found = [r for r in {**TABLES, **ALERT_TABLES}[name].references if r.parent in tables]
        for r in found:
            link = _link(places[_target(r)], r.parent_columns)
            given[_target(r)] = tables[r.parent].select(link.alias("k")).filter("k is not null").select("k.*")
        if found:
            links = F.array_compact(F.array(*[_link(places[_target(r)], r.columns) for r in found]))
            # distinct within each table first: that much is summed up before anything is shuffled
            used.append(df.select(F.explode(links).alias("k")).select("k.*").distinct())
    return _all(used).distinct().join(_all(list(given.values())), _KEY, "left_anti")


def audit_foreign_keys(tables: Tables) -> DataFrame:
    """Orphans of every reference of the base tables and, when given, the alert tables.

    Orphan keys are found first; only references that have any are looked at by row, so a clean table is
    scanned once for its keys and no more.
    """
    orphans, places = landed(orphan_keys(tables), "orphan-keys"), _places(tables)
    # one row for each kind of parent key
    missed = {r["place"] for r in orphans.select("place").distinct().collect()}
    parts = []
    for name, df in _present(tables, {**TABLES, **ALERT_TABLES}):
        table = {**TABLES, **ALERT_TABLES}[name]
        broken = [r for r in table.references if r.parent in tables and places[_target(r)][0] in missed]
        if broken:
            links = [_link(places[_target(r)], r.columns, reference_rule(r)) for r in broken]
            rows = df.select(key_text(table).alias("row_key"), F.explode(F.array_compact(F.array(*links))).alias("k"))
            met = rows.select("row_key", "k.*").join(orphans, _KEY)
            parts.append(met.select(F.lit(name).alias("table_name"), "row_key", "rule"))
    if not parts:
        return orphans.select(F.lit("").alias("table_name"), F.lit("").alias("row_key"), F.lit("").alias("rule")).limit(0)
    return _all(parts)
