"""Reading the base tables by their declared schemas."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stocklens.session import landed
from stocklens.sources.schemas import TABLES

_OPTIONS = {"csv": {"header": "true", "mode": "FAILFAST"}, "json": {"mode": "FAILFAST"}}


def read_tables(
    spark: SparkSession, folder: str, fmt: str = "parquet", names: Iterable[str] = tuple(TABLES)
) -> dict[str, DataFrame]:
    """``folder/<table>`` in parquet, orc, csv or json; nothing is inferred.

    Text in a date column may carry a time of day, of which the date is kept.
    """
    tables = {}
    for name in names:
        reader = spark.read.options(**_OPTIONS.get(fmt, {}))
        tables[name] = reader.schema(TABLES[name].struct_type).format(fmt).load(f"{folder}/{name}")
    return tables


@dataclass(frozen=True)
class Loaded:
    """Tables read from text, and the records that are none of their rows."""

    tables: dict[str, DataFrame]
    rejects: DataFrame  # table_name, record, file


def load_tables(
    spark: SparkSession, folder: str, fmt: str = "csv", names: Iterable[str] = tuple(TABLES)
) -> Loaded:
    """``folder/<table>`` in csv or json, where broken records do not end the job.

    A record with too many or too few values, or with a value that is not of its column's type, goes to the
    rejects as it stands in the file.  Every file is parsed once: rows are landed with their mark, and tables and
    rejects are read from there.
    """
    tables, rejects = {}, [spark.createDataFrame([], "table_name string, record string, file string")]
    for name in names:
        schema = TABLES[name].struct_type.add("_record", "string")
        reader = spark.read.schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_record")
        if fmt == "csv":
            # without it, text in unread columns would not be looked at
            reader = reader.option("header", "true").option("columnPruning", "false")
        raw = reader.format(fmt).load(f"{folder}/{name}")
        parsed = landed(raw.withColumn("_file", F.input_file_name()), f"loaded-{name}")
        tables[name] = parsed.filter(F.col("_record").isNull()).drop("_record", "_file")
        broken = parsed.filter(F.col("_record").isNotNull())
        rejects.append(broken.select(F.lit(name).alias("table_name"), F.col("_record").alias("record"), F.col("_file").alias("file")))
    return Loaded(tables, reduce(DataFrame.unionByName, rejects))


def write_tables(tables: dict[str, DataFrame], folder: str, fmt: str = "parquet") -> None:
    """Land tables where :func:`read_tables` finds them; fails if a table is already there."""
    for name, df in tables.items():
        df.write.format(fmt).options(**({"header": "true"} if fmt == "csv" else {})).save(f"{folder}/{name}")


def register_views(tables: dict[str, DataFrame]) -> None:
    """Make the tables available to ``spark.sql``."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
