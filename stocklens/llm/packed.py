"""Helpers of the vector operators: vectors as bytes, blocks of rows, and best entries merged over blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stocklens.session import ship_package

#: Parts in which the candidates of one list are cut before they meet.
_PARTS = 32


def as_bytes(rows: DataFrame, column: str) -> DataFrame:
    """``rows`` with an array of doubles, none of them missing, as the bytes of these doubles."""
    ship_package(rows.sparkSession)
    place = rows.columns.index(column)
    fields = [f"`{f.name}` {'binary' if f.name == column else f.dataType.simpleString()}" for f in rows.schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(place)
            flat = values.flatten().to_numpy(zero_copy_only=False) + 0.0  # also makes -0.0 zero
            cuts = np.cumsum(np.concatenate([[0], values.value_lengths().to_numpy(zero_copy_only=False)])).tolist()
            raw = [flat[i:j].tobytes() for i, j in zip(cuts, cuts[1:], strict=False)]
            columns = [pa.array(raw, pa.binary()) if i == place else c for i, c in enumerate(batch.columns)]
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    return rows.mapInArrow(run, ", ".join(fields))


def matrix(raw: list[bytes]) -> np.ndarray:
    """Vectors of one length as rows of doubles."""
    return np.frombuffer(b"".join(raw), "<f8").reshape(len(raw), -1)


def finite(vector: Column) -> Column:
    """Whether an array is there and holds numbers only."""
    whole = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(whole, F.lit(False))


def merged(found: DataFrame, keys: list[str], most: int) -> DataFrame:
    """``keys`` and ``best``: the first ``most`` entries (``far``, ``vec_id``) of each key.

    Entries are cut per (key, part) first, so a key with candidates from very many blocks gathers few.
    """
    part = F.pmod(F.xxhash64("vec_id"), F.lit(_PARTS)).alias("_part")
    first = lambda entries: F.slice(F.array_sort(entries), 1, most)
    cut = found.groupBy(*keys, part).agg(first(F.collect_list(F.struct("far", "vec_id"))).alias("best"))
    return cut.groupBy(*keys).agg(first(F.flatten(F.collect_list("best"))).alias("best"))


def ranked(group: np.ndarray, far: np.ndarray, ids: np.ndarray, most: int) -> np.ndarray:
    """Places of the first ``most`` entries of each group, by ``far`` and then by id."""
    order = np.lexsort((ids, far, group))
    sorted_group = group[order]
    begins = np.searchsorted(sorted_group, sorted_group, side="left")
    return order[np.arange(len(order)) - begins < most]
