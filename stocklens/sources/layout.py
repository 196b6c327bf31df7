"""A stored layout from which queries read only what they need.

Orders are partitioned by status and by the month in which they were closed, and every large table that names a
product is bucketed by it.  A filter on status leaves whole folders out, a range of months does so too, and sums
per product need no shuffle, as a product's rows lie in one bucket.

Buckets are known to Spark by a table in its catalog.  :func:`open_layout` registers the files of a folder there, so
a layout is written once and opened by any session; nothing about it is kept outside its folder.
"""

from __future__ import annotations

import hashlib
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stocklens.session import landed
from stocklens.sources.schemas import TABLES

Tables = Mapping[str, DataFrame]

#: Tables bucketed by product, and the time at which an order of a table was closed.
BY_PRODUCT = ("inventory", "inbound_orders", "outbound_orders", "supplier_products", "inventory_adjustments")
CLOSED_AT = {"inbound_orders": "received_time", "outbound_orders": "shipped_time"}
#: About how many rows a bucket of the largest table holds, so that it fits an executor core.
ROWS_PER_BUCKET = 1_000_000
#: The month of orders that were not closed.
NOT_CLOSED = "none"
_NOTICE = "buckets int"


def write_layout(tables: Tables, folder: str, buckets: int = 1) -> None:
    """Write ``tables`` below ``folder``, which must be new, in ``buckets`` or more, as the rows need.

    Rows are dealt to buckets before they are written, so every bucket of a partition is one file.  Buckets grow in
    number, not in size: all tables have as many as the largest needs, and a table is landed to be counted.
    """
    session = next(iter(tables.values())).sparkSession
    dealt = {name: landed(df, f"layout-{name}") for name, df in tables.items() if name in BY_PRODUCT}
    most = max([df.count() for df in dealt.values()], default=0)
    buckets = max(buckets, -(-most // ROWS_PER_BUCKET))
    for name, df in tables.items():
        path = f"{folder}/{name}"
        if name not in BY_PRODUCT:
            df.write.parquet(path)
            continue
        df = dealt[name]
        if name in CLOSED_AT:
            df = df.withColumn("closed_month", _month(F.col(CLOSED_AT[name])))
        writer = df.repartition(buckets, "product_id").write.bucketBy(buckets, "product_id").sortBy("product_id")
        if name in CLOSED_AT:
            writer = writer.partitionBy("status", "closed_month")
        writer.option("path", path).saveAsTable(_registered(folder, name))
    session.range(1).select(F.lit(buckets).alias("buckets")).coalesce(1).write.parquet(f"{folder}/_about")


def open_layout(
    spark: SparkSession, folder: str, closed_from: str | None = None, closed_until: str | None = None
) -> dict[str, DataFrame]:
    """The tables of a layout; with months (``YYYY-MM``), of closed orders only those closed from one to the other.

    Orders that were not closed are always there.
    """
    buckets = spark.read.schema(_NOTICE).parquet(f"{folder}/_about").first()["buckets"]
    tables = {}
    for name, table in TABLES.items():
        path = f"{folder}/{name}"
        if name not in BY_PRODUCT:
            tables[name] = spark.read.schema(table.struct_type).parquet(path)
            continue
        known = _registered(folder, name)
        if not spark.catalog.tableExists(known):
            columns = ", ".join(f"`{c.name}` {c.type.simpleString()}" for c in table.columns)
            parted = ""
            if name in CLOSED_AT:
                columns, parted = f"{columns}, closed_month string", "PARTITIONED BY (status, closed_month)"
            spark.sql(
                f"CREATE TABLE {known} ({columns}) USING parquet {parted} CLUSTERED BY (product_id) "
                f"SORTED BY (product_id) INTO {buckets} BUCKETS LOCATION '{path}'"
            )
            if parted:
                spark.sql(f"ALTER TABLE {known} RECOVER PARTITIONS")
        df = spark.table(known)
        if name in CLOSED_AT:
            inside = F.lit(True)
            if closed_from:
                inside &= F.col("closed_month") >= closed_from
            if closed_until:
                inside &= F.col("closed_month") <= closed_until
            df = df.filter(inside | (F.col("closed_month") == NOT_CLOSED))
        tables[name] = df.select(*table.names)
    return tables


def _month(time: Column) -> Column:
    return F.coalesce(F.date_format(time, "yyyy-MM"), F.lit(NOT_CLOSED))


def _registered(folder: str, name: str) -> str:
    return f"layout_{hashlib.sha256(folder.encode()).hexdigest()[:16]}_{name}"
