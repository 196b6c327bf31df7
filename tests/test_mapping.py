"""The mapped tables equal their SQL statement, also when one order holds most lines."""

from __future__ import annotations

import duckdb
import pytest
from compare import assert_same
from pyspark.sql import functions as F

from oracles.mapping import MAPPING
from stocklens.sources.schemas import TABLES
from stocklens.sources.star_mapping import star_tables


def statement(name: str) -> str:
    if name.endswith("bound_orders"):
        return f"with line as ({MAPPING['line']}) {MAPPING[name]}"
    return MAPPING[name]


@pytest.mark.parametrize("name", list(TABLES))
def test_table_matches_its_statement(spark, duck, data, name):
    tables = star_tables(spark, data)
    assert assert_same(tables[name], duck, statement(name)) > 0


@pytest.mark.parametrize("name", list(TABLES))
def test_declared_types(spark, data, name):
    mapped = star_tables(spark, data)[name].schema
    declared = {c.name: c.type for c in TABLES[name].columns}
    assert {f.name for f in mapped} == set(declared)
    assert {f.name: f.dataType for f in mapped} == declared


def test_one_order_with_most_lines(spark, data, tmp_path):
    lines = spark.read.parquet(f"{data}/lineitem.parquet")
    hot = F.when(F.col("l_orderkey") % 3 == 0, F.lit(7)).otherwise(F.col("l_orderkey"))
    lines.withColumn("l_orderkey", hot.cast("long")).write.parquet(f"{tmp_path}/lineitem.parquet")
    connection = duckdb.connect()
    for name in ("orders", "customer", "supplier"):
        spark.read.parquet(f"{data}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    for name in ("lineitem", "orders", "customer", "supplier"):
        connection.sql(
            f"create view {name} as select * from read_parquet('{tmp_path}/{name}.parquet/*.parquet')"
        )
    tables = star_tables(spark, str(tmp_path))
    assert_same(tables["inbound_orders"], connection, statement("inbound_orders"))
    assert_same(tables["outbound_orders"], connection, statement("outbound_orders"))
    ids = tables["inbound_orders"].select("inbound_id").union(tables["outbound_orders"].select("outbound_id"))
    assert ids.count() == ids.distinct().count() == lines.count()


def test_numbering_moves_only_what_the_mapping_reads(spark, data, tmp_path):
    lines = spark.read.parquet(f"{data}/lineitem.parquet")
    # every fifth line twice: alike in what orders lines first, apart in price, quantity and flags
    fifth = lines.filter("l_partkey % 5 = 0").withColumns(
        {
            "l_extendedprice": -F.col("l_extendedprice"),
            "l_quantity": F.col("l_quantity") + F.col("l_partkey") % 2,
            "l_linestatus": F.when(F.col("l_linestatus") == "F", "O").otherwise("F"),
        }
    )
    lines.unionByName(fifth).write.parquet(f"{tmp_path}/lineitem.parquet")
    connection = duckdb.connect()
    for name in ("orders", "customer", "supplier"):
        spark.read.parquet(f"{data}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    for name in ("lineitem", "orders", "customer", "supplier"):
        connection.sql(
            f"create view {name} as select * from read_parquet('{tmp_path}/{name}.parquet/*.parquet')"
        )
    tables = star_tables(spark, str(tmp_path))
    assert_same(tables["inbound_orders"], connection, statement("inbound_orders"))
    assert_same(tables["outbound_orders"], connection, statement("outbound_orders"))
    assert not {"l_extendedprice", "l_discount", "l_tax", "l_shipdate"} & set(tables._numbered().columns)
