"""A bounded sample of labelled texts to fit a model on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remainder(id_column: str, divisor: int) -> Column:
    """crc32 of the id as text, modulo ``divisor``: which rows a fit may use."""
    return F.pmod(F.crc32(F.col(f"`{id_column}`").cast("string")), F.lit(divisor))


def usable_labels(labels: DataFrame, label: str, divisor: int, left_out: int) -> DataFrame:
    """One row per labelled id that a fit may use: ``doc_id`` and ``label`` 0 or 1.

    Of contradicting rows for an id the larger label counts; other labels and missing ids do not.
    """
    value = F.col(f"`{label}`").cast("int")
    return (
        labels.filter(F.col("doc_id").isNotNull() & value.isin(0, 1))
        .filter(remainder("doc_id", divisor) != left_out)
        .groupBy("doc_id")
        .agg(F.max(value).alias("label"))
    )


#: Parts that a text too long to fit on is cut down to.
PARTS = 16


def spread(text: Column, most: int) -> Column:
    """``text``, or ``PARTS`` parts evenly spread over it, together ``most`` characters, where it is longer."""
    size = most // PARTS
    gap = (F.length(text) - size) / (PARTS - 1)
    parts = [F.substring(text, (gap * k + 1).cast("int"), F.lit(size)) for k in range(PARTS)]
    return F.when(F.length(text) <= most, text).otherwise(F.concat(*parts))


def sample_of(docs: DataFrame, labels: DataFrame, rows: int, max_chars: int) -> DataFrame:
    """Texts with ``label`` of at most ``rows`` labelled ids, taken in order of a hash of the id.

    ``docs`` has ``doc_id`` and ``text``.  Each id gives one row, the first of its texts in order; of a longer
    text than ``max_chars`` it gives parts from all over it.  So the two parameters bound the sample's size, and the
    chosen ids are few enough to broadcast.
    """
    chosen = labels.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    found = docs.join(F.broadcast(chosen), "doc_id")
    single = found.groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    return single.withColumn("text", spread(F.col("text"), max_chars))
