"""Staff views and operation statistics."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Tables = Mapping[str, DataFrame]


def employee_details(tables: Tables, employee_id: int | None = None) -> DataFrame:
    """Active staff with their warehouse; unassigned people are kept."""
    staff = tables["employees"].filter(F.col("employment_status") == "active")
    if employee_id is not None:
        staff = staff.filter(F.col("employee_id") == employee_id)
    sites = tables["warehouses"].select(
        "warehouse_id", "warehouse_name", "warehouse_type", F.col("address").alias("warehouse_address")
    )
    return staff.join(sites, "warehouse_id", "left").select(
        "employee_id",
        "employee_number",
        "employee_name",
        "department",
        "position",
        "contact_phone",
        "email",
        "employment_status",
        "warehouse_id",
        "warehouse_name",
        "warehouse_type",
        "warehouse_address",
        "created_time",
    )


def department_employee_stats(tables: Tables) -> DataFrame:
    status = F.col("employment_status")
    return (
        tables["employees"]
        .groupBy("department")
        .agg(
            F.count("*").alias("total_employees"),
            F.count_if(status == "active").alias("active_employees"),
            F.count_if(status == "terminated").alias("terminated_employees"),
            F.count_if(status == "leave").alias("on_leave_employees"),
        )
        .orderBy(F.desc("total_employees"), "department")
    )


def warehouse_employee_distribution(tables: Tables, warehouse_id: int | None = None) -> DataFrame:
    """Active staff per warehouse and department; warehouses without staff show 0."""
    sites = tables["warehouses"].select("warehouse_id", "warehouse_name", "warehouse_type")
    staff = tables["employees"].filter(F.col("employment_status") == "active")
    if warehouse_id is not None:
        sites = sites.filter(F.col("warehouse_id") == warehouse_id)
        staff = staff.filter(F.col("warehouse_id") == warehouse_id)
    department = F.col("department")
    counts = staff.groupBy("warehouse_id").agg(
        F.count("*").alias("total_employees"),
        F.count_if(department == "warehouse_ops").alias("ops_employees"),
        F.count_if(department == "order_processing").alias("order_employees"),
        F.count_if(department == "quality_control").alias("quality_employees"),
        F.count_if(department == "system_admin").alias("admin_employees"),
    )
    return (
        sites.join(counts, "warehouse_id", "left")
        .na.fill(0, [c for c in counts.columns if c != "warehouse_id"])
        .orderBy(F.desc("total_employees"), "warehouse_id")
    )


def _operations(tables: Tables, employee_id: int | None) -> DataFrame:
    """Active staff with counts and sums of the orders and adjustments they handled.

    Each fact is reduced to one record per person before any join, so the joins never multiply
    rows.  An order picked and packed by the same person counts once.
    """
    staff = tables["employees"].filter(F.col("employment_status") == "active")
    if employee_id is not None:
        staff = staff.filter(F.col("employee_id") == employee_id)
    received = (
        tables["inbound_orders"]
        .groupBy(F.col("operator").alias("employee_id"))
        .agg(F.count("inbound_id").alias("n_in"), F.sum("actual_quantity").alias("q_in"))
    )
    handlers = F.array_distinct(F.array_compact(F.array("picker", "packer")))
    sent = (
        tables["outbound_orders"]
        .select("outbound_id", "total_quantity", F.explode(handlers).alias("employee_id"))
        .groupBy("employee_id")
        .agg(F.count("outbound_id").alias("n_out"), F.sum("total_quantity").alias("q_out"))
    )
    adjusted = (
        tables["inventory_adjustments"]
        .groupBy(F.col("operator").alias("employee_id"))
        .agg(F.count("adjustment_id").alias("n_adj"))
    )
    sites = tables["warehouses"].select("warehouse_id", "warehouse_name")
    return (
        staff.select("employee_id", "employee_name", "department", "warehouse_id")
        .join(sites, "warehouse_id", "left")
        .join(received, "employee_id", "left")
        .join(sent, "employee_id", "left")
        .join(adjusted, "employee_id", "left")
        .na.fill(0, ["n_in", "q_in", "n_out", "q_out", "n_adj"])
    )


def _operation_columns(inbound_quantity, outbound_quantity):
    return [
        "employee_id",
        "employee_name",
        "department",
        "warehouse_name",
        F.col("n_in").alias("total_inbound_operations"),
        F.col("n_out").alias("total_outbound_operations"),
        F.col("n_adj").alias("total_adjustment_operations"),
        inbound_quantity.alias("total_inbound_quantity"),
        outbound_quantity.alias("total_outbound_quantity"),
    ]


def _busiest_first(stats: DataFrame) -> DataFrame:
    operations = F.col("total_inbound_operations") + F.col("total_outbound_operations")
    return stats.orderBy(F.desc(operations), "employee_id")


def employee_operation_stats(tables: Tables, employee_id: int | None = None) -> DataFrame:
    """Operation counts with quantities as a three-way fact join sums them.

    Such a join repeats each receipt once per (shipment, adjustment) of the person; the factors
    reproduce that without building the rows.
    """
    base = _operations(tables, employee_id)

    def times(name):
        return F.greatest(F.col(name), F.lit(1))

    inbound = F.col("q_in") * times("n_out") * times("n_adj")
    outbound = F.col("q_out") * times("n_in") * times("n_adj")
    return _busiest_first(base.select(*_operation_columns(inbound, outbound)))


def employee_operation_stats_exact(tables: Tables, employee_id: int | None = None) -> DataFrame:
    """Operation counts with the true quantities."""
    base = _operations(tables, employee_id)
    return _busiest_first(base.select(*_operation_columns(F.col("q_in"), F.col("q_out"))))


def department_active_count(tables: Tables) -> DataFrame:
    """Active staff per department, largest first, then a TOTAL line."""
    label = F.initcap(F.translate("department", "_", " "))
    counted = (
        tables["employees"]
        .rollup("department")
        .agg(
            F.count_if(F.col("employment_status") == "active").alias("active_employees"),
            F.grouping("department").alias("_total"),
        )
    )
    return (
        counted.withColumn("department", F.when(F.col("_total") == 1, "TOTAL").otherwise(label))
        .orderBy("_total", F.desc("active_employees"), "department")
        .select("department", "active_employees")
    )
