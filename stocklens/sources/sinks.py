"""Report, alert and snapshot sinks."""

from __future__ import annotations

import datetime as dt
import json
import uuid
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stocklens.functions.columns import month_bounds, stamp
from stocklens.session import exists, remove
from stocklens.sources.schemas import SUPPLIER_MONTHLY_REPORT, TABLES

Tables = Mapping[str, DataFrame]

_NOTICE = "run string, described string, published_at timestamp"


def append_rows(rows: DataFrame, folder: str) -> None:
    """Add rows, such as the accepted part of an ingest, to a stored table."""
    rows.write.mode("append").parquet(folder)


def write_monthly_report(report: DataFrame, folder: str, month: str) -> None:
    """Replace the rows of ``month`` and no other; an empty report clears the month."""
    month_bounds(month)
    rows = report.filter(F.col("report_month") == month).drop("report_month")
    rows.write.mode("overwrite").parquet(f"{folder}/report_month={month}")


def read_monthly_report(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(SUPPLIER_MONTHLY_REPORT.struct_type).parquet(folder)


def write_alerts(alerts: DataFrame, folder: str) -> None:
    """Publish a fresh evaluation of the alert table: one row per late order, closed ones gone.

    It is written to a folder of its own and then announced with its schema, so readers always find a
    whole table, before, during and after.
    """
    session, run = alerts.sparkSession, uuid.uuid4().hex
    alerts.write.partitionBy("direction").parquet(f"{folder}/runs/{run}")
    notice = session.range(1).select(
        F.lit(run).alias("run"),
        F.lit(alerts.schema.json()).alias("described"),
        F.current_timestamp().alias("published_at"),
    )
    notice.write.mode("append").parquet(f"{folder}/published")


def retire_alerts(spark: SparkSession, folder: str, keep: int) -> list[str]:
    """Remove all but the last ``keep`` announced evaluations; the last one always stays.  Gives the removed ones."""
    published = spark.read.schema(_NOTICE).parquet(f"{folder}/published").select("run", "published_at").collect()
    ordered = [r["run"] for r in sorted(published, key=lambda r: (r["published_at"], r["run"]), reverse=True)]
    gone = [run for run in ordered[max(1, keep) :] if exists(spark, f"{folder}/runs/{run}")]
    for run in gone:
        remove(spark, f"{folder}/runs/{run}")
    return gone


def read_alerts(spark: SparkSession, folder: str) -> DataFrame:
    """The alert table announced last, also when it holds no alert."""
    published = spark.read.schema(_NOTICE).parquet(f"{folder}/published")
    last = published.agg(F.max_by(F.struct("run", "described"), F.struct("published_at", "run"))).first()[0]
    schema = T.StructType.fromJson(json.loads(last["described"]))
    return spark.read.schema(schema).parquet(f"{folder}/runs/{last['run']}")


def publish_snapshot(
    tables: Tables, folder: str, run: str, published_at: dt.datetime | str
) -> None:
    """Write the state of the tables after a run to a directory of its own, then announce it.

    Readers find a run only once all of its tables are complete; earlier runs stay untouched.
    """
    session = next(iter(tables.values())).sparkSession
    for name, df in tables.items():
        df.write.parquet(f"{folder}/runs/{run}/{name}")
    notice = session.range(1).select(F.lit(run).alias("run"), stamp(published_at).alias("published_at"))
    notice.write.mode("append").parquet(f"{folder}/published")


def read_snapshot(
    spark: SparkSession, folder: str, names: list[str], run: str | None = None
) -> dict[str, DataFrame]:
    """Tables of ``run``, by default of the latest published run."""
    if run is None:
        published = spark.read.parquet(f"{folder}/published")
        run = published.agg(F.max_by("run", F.struct("published_at", "run"))).first()[0]
    return {
        name: spark.read.schema(TABLES[name].struct_type).parquet(f"{folder}/runs/{run}/{name}")
        for name in names
    }
