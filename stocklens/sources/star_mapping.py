"""The ten domain tables derived from the star-schema parquet files.

``star_tables(spark, folder)`` builds all of them lazily; a query that touches two tables plans
only those two.  ``FIXTURES.md`` states the mapping as SQL.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stocklens.functions.columns import day, stamp
from stocklens.functions.scale import with_position
from stocklens.session import landed, modified

#: Columns of the star-schema files; stated so that reading needs no look into the files.
_FILES = {
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "customer": (
        "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"
    ),
    "part": (
        "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, "
        "p_retailprice double"
    ),
    "orders": (
        "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
        "o_orderdate timestamp_ntz, o_orderpriority string"
    ),
    "lineitem": (
        "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
        "l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
        "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz"
    ),
    "events": (
        "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, "
        "props string"
    ),
}

_EPOCH = "1995-01-01 00:00:00"
_LAST_DAY = "2001-07-31 00:00:00"
#: Lot ids leave room for so many suppliers of a product.
_LOT_ROOM = 1_000_000_000
#: Numbered lines by application, file and time of change.
_NUMBERED: dict[tuple[str, str, int], DataFrame] = {}

#: Lines are ordered by the columns that tell nearly all of them apart, then by the others.
_LINE_HEAD = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
_LINE_TAIL = [
    "l_quantity",
    "l_extendedprice",
    "l_discount",
    "l_tax",
    "l_shipdate",
    "l_returnflag",
    "l_linestatus",
]
#: What the mapping reads of the others.
_LINE_READ = ["l_quantity", "l_returnflag", "l_linestatus"]


class StarTables(Mapping[str, DataFrame]):
    """Domain tables by name, each built on first use."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self._spark = spark
        self._folder = folder.rstrip("/")
        self._built: dict[str, DataFrame] = {}
        self._makers: dict[str, Callable[[], DataFrame]] = {
            "warehouses": self._warehouses,
            "locations": self._locations,
            "suppliers": self._suppliers,
            "products": self._products,
            "supplier_products": self._supplier_products,
            "employees": self._employees,
            "inventory": self._inventory,
            "inbound_orders": self._inbound_orders,
            "outbound_orders": self._outbound_orders,
            "inventory_adjustments": self._inventory_adjustments,
        }

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._built:
            self._built[name] = self._makers[name]()
        return self._built[name]

    def __iter__(self) -> Iterator[str]:
        return iter(self._makers)

    def __len__(self) -> int:
        return len(self._makers)

    def _read(self, name: str) -> DataFrame:
        return self._spark.read.schema(_FILES[name]).parquet(f"{self._folder}/{name}.parquet")

    def _rows_in(self, name: str) -> Column:
        return self._read(name).agg(F.count("*")).scalar()

    def _warehouses(self) -> DataFrame:
        key = F.col("n_nationkey")
        return self._read("nation").select(
            key.alias("warehouse_id"),
            F.col("n_name").alias("warehouse_name"),
            F.when(F.col("n_regionkey") == 0, "central")
            .when(F.col("n_regionkey").isin(1, 2), "regional")
            .otherwise("front")
            .alias("warehouse_type"),
            F.concat("n_name", F.lit(" depot road")).alias("address"),
            F.concat(F.lit("contact-"), key).alias("contact_person"),
            F.concat(F.lit("+1-"), F.lpad(key.cast("string"), 7, "0")).alias("phone_number"),
            F.when(key % 8 == 7, "inactive").otherwise("active").alias("status"),
            stamp(_EPOCH).alias("created_time"),
        )

    def _locations(self) -> DataFrame:
        # every warehouse has one location per part size; the sizes are a small code list
        sizes = self._read("part").agg(F.collect_set("p_size")).scalar()
        grid = self._read("nation").select(
            "n_nationkey", self._rows_in("part").alias("parts"), F.explode(sizes).alias("p_size")
        )
        percent = 15 + (F.col("n_nationkey") * 37 + F.col("p_size") * 11) % 60
        return grid.select(
            F.col("n_nationkey").alias("warehouse_id"),
            _location_code().alias("location"),
            (F.col("parts") * percent / F.lit("100.0").cast("decimal(4,1)"))
            .cast("decimal(12,4)")
            .alias("capacity"),
            F.lit(0).cast("decimal(12,4)").alias("utilization"),
        )

    def _suppliers(self) -> DataFrame:
        return self._read("supplier").select(
            F.col("s_suppkey").cast("int").alias("supplier_id"),
            F.col("s_name").alias("supplier_name"),
            F.concat(F.lit("nation "), F.col("s_nationkey")).alias("contact_info"),
            (7 + F.col("s_suppkey") % 52).cast("int").alias("supply_cycle"),
            F.when(F.col("s_acctbal") < 0, "inactive").otherwise("active").alias("status"),
        )

    def _products(self) -> DataFrame:
        key = F.col("p_partkey")
        return self._read("part").select(
            key.cast("int").alias("product_id"),
            F.concat(F.lit("SKU-"), F.lpad(key.cast("string"), 9, "0")).alias("product_sku"),
            F.col("p_name").alias("product_name"),
            F.col("p_brand").alias("product_description"),
            F.col("p_type").alias("category"),
            F.lit("10x10x10").alias("dimensions"),
            ((1 + key % 199) / F.lit("100.0").cast("decimal(4,1)"))
            .cast("decimal(8,2)")
            .alias("volume"),
            F.col("p_size").cast("decimal(8,2)").alias("weight"),
            F.col("p_retailprice").cast("decimal(10,2)").alias("value"),
            F.lit("Box").alias("packaging_info"),
            F.when(key % 20 == 0, "discontinued").otherwise("active").alias("status"),
        )

    def _supplier_products(self) -> DataFrame:
        part, supp = F.col("l_partkey"), F.col("l_suppkey")
        pairs = (
            self._read("lineitem")
            .groupBy("l_suppkey", "l_partkey")
            .agg(F.min("l_quantity").alias("smallest"))
        )
        return pairs.select(
            supp.cast("int").alias("supplier_id"),
            part.cast("int").alias("product_id"),
            F.concat(F.lit("SUP-"), supp, F.lit("-"), part).alias("supplier_sku"),
            (500 + (part * 31 + supp * 17) % 500).cast("decimal(10,2)").alias("supply_price"),
            F.col("smallest").cast("decimal(12,4)").alias("min_order_quantity"),
            (1 + (part + supp) % 30).cast("int").alias("lead_time_days"),
            ((part + supp) % 6 == 0).alias("is_preferred"),
            stamp(_EPOCH).alias("created_time"),
            stamp(_EPOCH).alias("last_updated"),
        )

    def _employees(self) -> DataFrame:
        key, segment = F.col("c_custkey"), F.col("c_mktsegment")
        return self._read("customer").select(
            key.cast("int").alias("employee_id"),
            F.concat(F.lit("EMP"), F.lpad(key.cast("string"), 9, "0")).alias("employee_number"),
            F.col("c_name").alias("employee_name"),
            F.when(segment.isin("MACHINERY", "FURNITURE"), "warehouse_ops")
            .when(segment == "AUTOMOBILE", "order_processing")
            .when(segment == "BUILDING", "quality_control")
            .otherwise("system_admin")
            .alias("department"),
            F.lower(segment).alias("position"),
            F.concat(F.lit("+1-"), F.lpad(key.cast("string"), 9, "0")).alias("contact_phone"),
            F.concat(F.lit("emp"), key, F.lit("@example.com")).alias("email"),
            F.when(key % 17 == 0, "terminated")
            .when(key % 23 == 0, "leave")
            .otherwise("active")
            .alias("employment_status"),
            F.when(key % 40 != 0, F.col("c_nationkey")).alias("warehouse_id"),
            stamp(_EPOCH).alias("created_time"),
        )

    def _lines(self, status: str) -> DataFrame:
        """Order lines of one status with their parties and a unique ``line_id``.

        The status is filtered on the stored lines before anything is joined.  Orders meet customers
        before they meet the lines, so the wide lines shuffle once by supplier (or not at all when
        suppliers are broadcast) and once by order.
        """
        lines = self._numbered().filter(F.col("l_linestatus") == status)
        orders = self._read("orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate")
        customers = self._read("customer").select("c_custkey", "c_nationkey")
        suppliers = self._read("supplier").select("s_suppkey", "s_nationkey")
        owned = orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).drop("c_custkey")
        return (
            lines.join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
            .drop("s_suppkey")
            .join(owned, F.col("l_orderkey") == F.col("o_orderkey"))
            .drop("o_orderkey")
        )

    def _numbered(self) -> DataFrame:
        """All lines with their place in the order of orders and lines, which is unique for any data.

        The numbering sorts by range, so an order may hold any number of lines.  It is stored once per
        application and state of the file, and read by all queries that follow.  Columns that only order lines
        alike in all of ``_LINE_HEAD`` are not moved: such lines, if what is read of them differs, are ordered apart.
        """
        source = f"{self._folder}/lineitem.parquet"
        key = (self._spark.sparkContext.applicationId, source, modified(self._spark, source))
        if key not in _NUMBERED:
            alike, others = Window.partitionBy(*_LINE_HEAD), F.struct(*_LINE_READ)
            differ = ~F.min(others).over(alike).eqNullSafe(F.max(others).over(alike))
            lines = self._read("lineitem")
            order = [*_LINE_HEAD, *_LINE_READ]
            placed = with_position(lines.select(*order), order, "line_id", True, _LINE_HEAD, {"_tied": differ})
            tied, placed = placed.filter("_tied"), placed.filter("not _tied").drop("_tied")
            if not tied.isEmpty():
                placed = placed.unionByName(landed(_untied(lines, tied).select(*placed.columns), "tied", lasting=True))
            _NUMBERED[key] = placed
        return _NUMBERED[key]

    def _inbound_orders(self) -> DataFrame:
        quantity = F.col("l_quantity").cast("int")
        cancelled = F.col("line_id") % 11 == 0
        done = F.col("o_orderstatus") == "F"
        partial = (F.col("o_orderstatus") == "P") & (F.col("l_linenumber") % 2 == 0)
        return (
            self._lines("F")
            .select(
                F.col("line_id").alias("inbound_id"),
                F.col("l_partkey").cast("int").alias("product_id"),
                F.when((F.col("l_returnflag") == "R") & (F.col("l_linenumber") <= 4), "return")
                .when(F.col("l_returnflag") == "N", "transfer")
                .otherwise("purchase")
                .alias("inbound_type"),
                _site().alias("warehouse_id"),
                quantity.alias("expected_quantity"),
                F.when(cancelled, 0)
                .when(done | partial, quantity)
                .otherwise(0)
                .alias("actual_quantity"),
                F.lit(1).alias("total_items"),
                F.when(cancelled, "cancelled")
                .when(done, "completed")
                .when(F.col("o_orderstatus") == "P", "receiving")
                .otherwise("pending")
                .alias("status"),
                _created().alias("created_time"),
                F.when(done & ~cancelled, _handled()).alias("received_time"),
                F.col("o_custkey").cast("int").alias("operator"),
                F.concat(F.lit("Batch "), F.col("line_id")).alias("notes"),
            )
        )

    def _outbound_orders(self) -> DataFrame:
        cancelled = F.col("line_id") % 13 == 0
        status, even = F.col("o_orderstatus"), F.col("l_linenumber") % 2 == 0
        customer = F.col("o_custkey")
        return (
            self._lines("O")
            .select(
                F.col("line_id").alias("outbound_id"),
                F.col("l_partkey").cast("int").alias("product_id"),
                F.when(F.col("l_returnflag") == "A", "sales")
                .when(F.col("l_returnflag") == "N", "transfer")
                .otherwise("return")
                .alias("outbound_type"),
                _site().alias("warehouse_id"),
                F.lit(1).alias("total_items"),
                F.col("l_quantity").cast("int").alias("total_quantity"),
                F.when(cancelled, "cancelled")
                .when(status == "F", "shipped")
                .when(status == "P", F.when(even, "picking").otherwise("packing"))
                .otherwise("pending")
                .alias("status"),
                F.when(status != "O", customer.cast("int")).alias("picker"),
                F.when(
                    status == "F",
                    F.when(even, customer.cast("int")).otherwise(
                        ((customer + 25) % self._rows_in("customer")).cast("int")
                    ),
                ).alias("packer"),
                _created().alias("created_time"),
                F.when((status == "F") & ~cancelled, _handled()).alias("shipped_time"),
            )
        )

    def _inventory(self) -> DataFrame:
        part, supp, units = F.col("l_partkey"), F.col("l_suppkey"), F.col("units")
        stocked = (
            self._read("lineitem")
            .filter((F.col("l_linestatus") == "F") & (F.col("l_returnflag") != "R"))
            .groupBy("l_partkey", "l_suppkey")
            .agg(F.sum("l_quantity").cast("bigint").alias("units"))
        )
        suppliers = self._read("supplier").select("s_suppkey", "s_nationkey")
        parts = self._read("part").select("p_partkey", "p_size")
        return (
            stocked.join(suppliers, supp == F.col("s_suppkey"))
            .join(parts, part == F.col("p_partkey"))
            .select(
                (part * _LOT_ROOM + supp).alias("inventory_id"),
                part.cast("int").alias("product_id"),
                F.col("s_nationkey").alias("warehouse_id"),
                _location_code().alias("storage_location"),
                units.cast("int").alias("total_quantity"),
                (units % 7).cast("int").alias("locked_quantity"),
                (units - units % 7).cast("int").alias("available_quantity"),
                F.lit("pcs").alias("unit"),
                F.date_add(day("2001-01-01"), ((part + supp) % 180).cast("int")).alias(
                    "production_date"
                ),
                F.date_add(day("2001-07-02"), ((part * 7 + supp) % 400).cast("int")).alias(
                    "expiry_date"
                ),
                F.when(supp % 29 == 0, "hold").otherwise("normal").alias("inventory_status"),
                F.lit(None).cast("bigint").alias("parent_inventory_id"),
                stamp(_LAST_DAY).alias("last_updated"),
            )
        )

    def _inventory_adjustments(self) -> DataFrame:
        event, kind = F.col("event_id"), F.col("event_type")
        product = event % self._rows_in("part")
        before = (100 + event % 400).cast("int")
        change = (
            F.when(kind == "error", -F.floor(F.col("value") / 50).cast("int"))
            .when(kind == "view", 0)
            .otherwise((event % 9 - 4).cast("int"))
        )
        return self._read("events").select(
            event.alias("adjustment_id"),
            F.when(kind == "error", "write_off")
            .when(kind == "view", "transfer")
            .when(kind == "purchase", "split")
            .otherwise("count")
            .alias("adjustment_type"),
            (F.col("user_id") % 25).cast("int").alias("warehouse_id"),
            product.cast("int").alias("product_id"),
            (product * _LOT_ROOM + F.col("user_id") % 10).alias("inventory_id"),
            before.alias("before_quantity"),
            (before + change).alias("after_quantity"),
            change.alias("quantity_change"),
            kind.alias("adjustment_reason"),
            F.col("user_id").cast("int").alias("operator"),
            F.col("ts").alias("adjustment_time"),
            F.lit(None).cast("string").alias("notes"),
        )


def star_tables(spark: SparkSession, folder: str, **options: int) -> StarTables:
    return StarTables(spark, folder, **options)


def _untied(lines: DataFrame, tied: DataFrame) -> DataFrame:
    """``tied`` lines, which fill the right places together, each in its own place by all columns."""
    heads = tied.groupBy(*[F.col(c).alias(f"_{c}") for c in _LINE_HEAD]).agg(F.min("line_id").alias("_first"))
    alike = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in _LINE_HEAD]
    place = F.row_number().over(Window.partitionBy(*_LINE_HEAD).orderBy(*_LINE_TAIL))
    return lines.join(heads, alike).withColumn("line_id", F.col("_first") + place - 1)


def _location_code() -> Column:
    return F.concat(F.lit("Z-"), F.lpad(F.col("p_size").cast("string"), 2, "0"))


def _site() -> Column:
    """Tenth products move at the supplier's site, the rest at the customer's."""
    return F.when(F.col("l_partkey") % 10 == 0, F.col("s_nationkey")).otherwise(F.col("c_nationkey"))


def _created() -> Column:
    age = F.make_dt_interval(days=(F.col("l_orderkey") % 20).cast("int"))
    return F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate")).otherwise(
        stamp(_LAST_DAY) - age
    )


def _handled() -> Column:
    return F.col("o_orderdate") + F.make_dt_interval(hours=F.col("l_linenumber") * 10)
