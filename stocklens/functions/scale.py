"""Skew-safe building blocks: dense positions and running values.

Spark's ``row_number``/``sum over`` put one window partition into one task.  The helpers here
give the same answers while a group (or the whole table) stays spread over many tasks: rows are
range partitioned in the wanted order, each range is handled alone, and only one small record per
range travels to combine them.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stocklens.session import landed

#: About how many rows a range holds; there are as many ranges as the rows need.
ROWS_PER_RANGE = 200_000
#: Rows of a key with more than so many ranges of rows are summed range by range; fewer are one sorted group.
HOT_RANGES = 4
#: About how many rows of a whole table a task sorts.
ROWS_PER_SORT = 500_000
#: Keys are counted by so many slots of their hash, to find those with many rows.
SLOTS = 1 << 16
_ROW_BITS = 33  # monotonically_increasing_id keeps the row within its partition in 33 bits


def in_ranges(df: DataFrame, order: str, rows_per_range: int | None = None) -> DataFrame:
    """Land ``df`` with ``_range``: ranges that rise with ``order`` and hold about equal rows.

    Ranges are told by bounds on ``order``, which one pass over the landed rows estimates; so rows are landed once
    and not moved, and a row's range stays the same however often a task is repeated.  Values of
    ``order`` must be unique: a missing or repeated one is an error.
    """
    stored = landed(df, "requests")
    # one pass counts the rows and the values of ``order``, which leave out missing and repeated ones
    rows, given = stored.agg(F.count("*"), F.count_distinct(order)).first()
    if rows != given:
        raise ValueError(f"{order} must be given and unique")
    ranges = -(-rows // (rows_per_range or ROWS_PER_RANGE))
    if ranges <= 1:
        return stored.withColumn("_range", F.lit(0))
    # one bound for each range; an estimate moves a bound by a quarter of a range at most
    shares = [n / ranges for n in range(1, ranges)]
    bounds = sorted({int(b) for b in stored.approxQuantile(order, shares, 1 / (4 * ranges))})
    return stored.withColumn("_range", _bounds_passed(F.col(order), bounds))


def _bounds_passed(value: Column, bounds: Sequence[int], before: int = 0) -> Column:
    """How many of the sorted ``bounds`` lie below ``value``, found by halving them."""
    if not bounds:
        return F.lit(before)
    middle = len(bounds) // 2
    return F.when(
        value > F.lit(bounds[middle]).cast("bigint"),
        _bounds_passed(value, bounds[middle + 1 :], before + middle + 1),
    ).otherwise(_bounds_passed(value, bounds[:middle], before))


def with_position(
    df: DataFrame,
    order: Sequence[str],
    name: str = "position",
    lasting: bool = False,
    together: Sequence[str] = (),
    marks: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Add the dense position (1, 2, …) of each row in ``order`` over the whole table.

    Rows alike in ``together``, the first columns of ``order``, stay in one range, so ``marks``, windows over
    them, move no rows.
    """
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // ROWS_PER_SORT))
    placed = landed(
        df.repartitionByRange(tasks, *(together or order))
        .sortWithinPartitions(*order)
        .withColumns(dict(marks or {}))
        .withColumn("_at", F.monotonically_increasing_id()),
        "positions",
        lasting,
    )
    split = placed.withColumn("_range", F.shiftright("_at", _ROW_BITS)).withColumn(
        "_row", F.col("_at").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    )
    return (
        split.join(_rows_before(split), "_range")
        .withColumn(name, F.col("_before") + F.col("_row") + 1)
        .drop("_at", "_range", "_row", "_before")
    )


def _rows_before(ranged: DataFrame) -> DataFrame:
    """Per range how many rows the ranges before it hold; one record per range, so broadcast."""
    sizes = ranged.groupBy("_range").agg(F.count("*").alias("_n"))
    # the only unpartitioned window: it sees one row per range
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum("_n").over(before), F.lit(0))
    return F.broadcast(sizes.select("_range", offset.alias("_before")))


def position_in_ranges(ranged: DataFrame, order: str, name: str = "position") -> DataFrame:
    """Dense positions (1, 2, …) over a subset of a table from :func:`in_ranges`."""
    place = F.row_number().over(Window.partitionBy("_range").orderBy(order))
    return (
        ranged.join(_rows_before(ranged), "_range")
        .withColumn(name, F.col("_before") + place)
        .drop("_before")
    )


def running_sums(
    ranged: DataFrame, keys: Sequence[str], order: str, sums: dict[str, Column]
) -> DataFrame:
    """Per key, sums over the rows strictly before each row in ``order``.

    ``ranged`` carries ``_range`` from :func:`in_ranges`.  A key with few rows is one sorted group, so its rows move
    once.  A key with many is summed per range; the running total over ranges then works on one record
    per (key, range).
    """
    keys = list(keys)
    hot = _in_hot_slots(ranged, keys)
    group = keys if hot is None else [*keys, "_part"]
    inner = Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0)
    parted = ranged if hot is None else ranged.withColumn("_part", F.when(hot, F.col("_range")).otherwise(0))
    # dealt out before the summed values are computed, so these are not moved
    within = parted.repartition(*group).select(
        "*", *[F.coalesce(F.sum(expr).over(inner), zero).alias(n if hot is None else f"_w_{n}") for n, expr in sums.items()]
    )
    if hot is None:
        return within
    outer = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = parted.filter(hot).groupBy(*keys, "_part").agg(
        *[F.sum(expr).alias(f"_t_{name}") for name, expr in sums.items()]
    )
    carried = totals.select(
        *keys, "_part", *[F.coalesce(F.sum(f"_t_{n}").over(outer), zero).alias(f"_c_{n}") for n in sums]
    )
    joined = within.join(carried, [*keys, "_part"], "left")
    for name in sums:
        joined = joined.withColumn(name, F.col(f"_w_{name}") + F.coalesce(f"_c_{name}", zero))
    return joined.drop("_part", *[f"_{kind}_{n}" for n in sums for kind in ("w", "c")])


def _in_hot_slots(ranged: DataFrame, keys: Sequence[str]) -> Column | None:
    """Which rows may have a key with more than ``HOT_RANGES`` ranges of rows; None if there is no such key.

    Keys are counted by slots of their hash, so a count moves at most one record per slot and task.  A key with many
    rows always fills its slot; the few others in a full slot are only handled like it.
    """
    slot = F.pmod(F.xxhash64(*keys), F.lit(SLOTS)).cast("int")
    # fewer slots than ranges of rows
    full = ranged.groupBy(slot.alias("slot")).count().filter(F.col("count") > HOT_RANGES * ROWS_PER_RANGE).collect()
    return slot.isin([r["slot"] for r in full]) if full else None


def previous_value(ranged: DataFrame, key: str, order: str, value: str, name: str) -> DataFrame:
    """Per key, ``value`` of the row just before in ``order`` (NULL for the first)."""
    inner = Window.partitionBy(key, "_range").orderBy(order)
    outer = Window.partitionBy(key).orderBy("_range")
    last = ranged.groupBy(key, "_range").agg(F.max_by(value, order).alias("_last"))
    carried = last.select(key, "_range", F.lag("_last").over(outer).alias("_carried"))
    within = ranged.withColumn("_inner", F.lag(value).over(inner)).withColumn(
        "_first", F.row_number().over(inner) == 1
    )
    return (
        within.join(carried, [key, "_range"])
        .withColumn(name, F.when(F.col("_first"), F.col("_carried")).otherwise(F.col("_inner")))
        .drop("_inner", "_first", "_carried")
    )
