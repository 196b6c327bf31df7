"""Snapshots of tables that write only what changed, and can all be read until they are retired.

The rows of a table are dealt to buckets by a hash of their key.  A run computes a digest of each bucket, a sum
of row hashes that does not depend on order, and writes the buckets whose digest differs from the last run's.  Its
manifest names, for every bucket, the run that wrote it last; so bytes written follow the rows that
changed, and an earlier run is read from its own manifest.

A run is announced once its buckets and manifest are complete; readers never see half of one.  One writer publishes
at a time.  Nothing is removed until :func:`retire_runs` is called, by whoever owns the folder.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stocklens.functions.columns import stamp
from stocklens.session import exists, landed, remove
from stocklens.sources.schemas import TABLES

Tables = Mapping[str, DataFrame]

#: About how many rows a bucket holds when its table is first written, and how many buckets there are at least.
ROWS_PER_BUCKET, LEAST_BUCKETS = 250_000, 8
_MANIFEST = "table string, buckets int, bucket int, written_by string, rows bigint, digest decimal(38,0)"
_NOTICE = "run string, published_at timestamp_ntz"


def publish_changes(tables: Tables, folder: str, run: str, published_at: dt.datetime | str) -> None:
    """Publish the state of ``tables`` as ``run``: buckets that changed are written, others are taken over.

    Tables that the last run has and ``tables`` lack are taken over whole.
    """
    session = next(iter(tables.values())).sparkSession
    if run in _published(session, folder):
        raise ValueError(f"run {run} is published already")
    last = last_run(session, folder)
    before = _manifest(session, folder, last) if last else session.createDataFrame([], _MANIFEST)
    counts = {r["table"]: r["buckets"] for r in before.select("table", "buckets").distinct().collect()}
    parts = [before.filter(~F.col("table").isin(list(tables)))]
    for name, df in tables.items():
        df = landed(df, f"state-{name}")  # counted, digested and written from there
        buckets = counts.get(name) or max(LEAST_BUCKETS, -(-df.count() // ROWS_PER_BUCKET))
        placed = df.withColumn("bucket", _bucket(name, buckets))
        digests = placed.groupBy("bucket").agg(
            F.count("*").alias("rows"),
            F.sum(F.xxhash64(*_hashed(df)).cast("decimal(38,0)")).cast("decimal(38,0)").alias("digest"),
        )
        old = before.filter(F.col("table") == name).select(
            "bucket", "written_by", F.col("rows").alias("_rows"), F.col("digest").alias("_digest")
        )
        same = F.col("rows").eqNullSafe(F.col("_rows")) & F.col("digest").eqNullSafe(F.col("_digest"))
        now = digests.join(old, "bucket", "left").select(
            F.lit(name).alias("table"),
            F.lit(buckets).alias("buckets"),
            "bucket",
            F.when(same, F.col("written_by")).otherwise(run).alias("written_by"),
            "rows",
            "digest",
        )
        now = landed(now, "digests")
        changed = [r["bucket"] for r in now.filter(F.col("written_by") == run).select("bucket").collect()]
        if changed:
            fresh = placed.filter(F.col("bucket").isin(changed)).repartition(len(changed), "bucket")
            fresh.write.mode("overwrite").partitionBy("bucket").parquet(_data(folder, name, run))
        parts.append(now)
    whole = reduce(DataFrame.unionByName, parts)
    whole.coalesce(1).write.mode("overwrite").parquet(f"{folder}/manifests/{run}")
    notice = session.range(1).select(F.lit(run).alias("run"), stamp(published_at).alias("published_at"))
    notice.write.mode("append").parquet(f"{folder}/published")


def read_run(spark: SparkSession, folder: str, names: Iterable[str], run: str | None = None) -> dict[str, DataFrame]:
    """Tables of ``run``, by default of the run published last."""
    run = run or last_run(spark, folder)
    if run not in _published(spark, folder):
        raise ValueError(f"run {run} is not there")
    # one row for each bucket; a table has as many as its rows fill
    places: dict[str, dict[str, list[int]]] = {}
    for r in _manifest(spark, folder, run).collect():
        places.setdefault(r["table"], {}).setdefault(r["written_by"], []).append(r["bucket"])
    tables = {}
    for name in names:
        schema = TABLES[name].struct_type
        parts = [spark.createDataFrame([], schema)]
        for writer, buckets in places.get(name, {}).items():
            stored = spark.read.schema(f"{_ddl(name)}, bucket int").parquet(_data(folder, name, writer))
            parts.append(stored.filter(F.col("bucket").isin(buckets)).drop("bucket"))  # by folder
        tables[name] = reduce(DataFrame.unionByName, parts)
    return tables


def last_run(spark: SparkSession, folder: str) -> str | None:
    """The run published last that has not been retired."""
    found = _published(spark, folder)
    return max(found, key=lambda run: (found[run], run)) if found else None


def retire_runs(spark: SparkSession, folder: str, keep: int) -> list[str]:
    """Remove all but the last ``keep`` runs, with every bucket that none of these needs; gives the removed runs.

    Runs are announced as retired first, so a run that is being removed is not read any more.
    """
    found = _published(spark, folder)
    ordered = sorted(found, key=lambda run: (found[run], run), reverse=True)
    kept, gone = ordered[: max(1, keep)], ordered[max(1, keep) :]
    if not gone:
        return []
    notice = spark.createDataFrame([(run,) for run in gone], "run string")
    notice.coalesce(1).write.mode("append").parquet(f"{folder}/retired")
    needed = reduce(DataFrame.unionByName, [_manifest(spark, folder, run) for run in kept])
    wanted = {tuple(r) for r in needed.select("table", "written_by", "bucket").distinct().collect()}
    writers = {(table, writer) for table, writer, _ in wanted}
    for run in gone:
        mine = [(r["table"], r["bucket"]) for r in _manifest(spark, folder, run).filter(F.col("written_by") == run).collect()]
        for table in {t for t, _ in mine}:
            if (table, run) not in writers:
                remove(spark, _data(folder, table, run))
        for table, bucket in mine:
            if (table, run) in writers and (table, run, bucket) not in wanted:
                remove(spark, f"{_data(folder, table, run)}/bucket={bucket}")
        remove(spark, f"{folder}/manifests/{run}")
    return gone


def _bucket(name: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(*TABLES[name].key), F.lit(buckets)).cast("int")


def _hashed(df: DataFrame) -> list[Column]:
    """Columns for a row's hash; a missing value and its place count, as hashing skips what is missing."""
    return [c for name in df.columns for c in (F.col(name), F.isnull(name))]


def _ddl(name: str) -> str:
    return ", ".join(f"`{c.name}` {c.type.simpleString()}" for c in TABLES[name].columns)


def _data(folder: str, name: str, run: str) -> str:
    return f"{folder}/data/{name}/{run}"


def _manifest(spark: SparkSession, folder: str, run: str) -> DataFrame:
    return spark.read.schema(_MANIFEST).parquet(f"{folder}/manifests/{run}")


def _published(spark: SparkSession, folder: str) -> dict[str, dt.datetime]:
    """Runs that are there, with the time they were published."""
    if not exists(spark, f"{folder}/published"):
        return {}
    runs = spark.read.schema(_NOTICE).parquet(f"{folder}/published")
    if exists(spark, f"{folder}/retired"):
        runs = runs.join(spark.read.schema("run string").parquet(f"{folder}/retired"), "run", "left_anti")
    return {r["run"]: r["published_at"] for r in runs.select("run", "published_at").collect()}
