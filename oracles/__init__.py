"""DuckDB statements that state each query a second, independent time."""

from __future__ import annotations

from oracles.build import with_tables
from oracles.commands import COMMANDS
from oracles.moves import MOVES
from oracles.rules import RULES
from oracles.views import VIEWS


# whole numbers that may be missing are compared as text
_AS_TEXT = {
    "employee_details": ("warehouse_id",),
    "outbound_operator_guard": ("picker", "packer"),
    "create_inbound_order": ("actual_quantity",),
    "create_outbound_order": ("picker", "packer"),
    "complete_inbound": ("new_inventory_id",),
    "complete_outbound": ("inventory_id",),
    "null_on_delete": ("first_reference", "second_reference"),
    "query_inventory": ("parent_inventory_id",),
    "inbound_orders_after_receipt": ("actual_quantity",),
    "details_of_one_employee": ("warehouse_id",),
    "split_parts_of_parts": ("source_id", "new_inventory_id"),
    "alerts_cleared_by_shipping": ("delay_days_before", "delay_days_after"),
    "alert_changes_by_sweep": ("delay_days_before", "delay_days_after"),
    "lots_after_parts_of_parts": ("parent_inventory_id",),
}

# the forms for one warehouse, product, ...: the whole query and what they keep of it
_ONE = {
    "inventory_of_one_warehouse": ("warehouse_inventory_overview", "warehouse_id = 3"),
    "suppliers_of_one_product": ("product_suppliers", "product_id = 7"),
    "products_of_one_supplier": ("supplier_products_detail", "supplier_id = 5"),
    "details_of_one_employee": ("employee_details", "employee_id = 11"),
    "operations_of_one_employee": ("employee_operation_stats", "employee_id = 11"),
    "staff_of_one_warehouse": ("warehouse_employee_distribution", "warehouse_id = 3"),
    "stock_of_one_category": ("category_inventory_overview", "category = 'ECONOMY'"),
}


def statements() -> dict[str, str]:
    """The full statement per query name."""
    result = {}
    whole = {**VIEWS, **COMMANDS, **MOVES, **RULES}
    single = {
        name: f"select * from (\n{with_tables(whole[of])}\n) everything where {kept}" for name, (of, kept) in _ONE.items()
    }
    for name, body in {**whole, **single}.items():
        statement = body if name in single else with_tables(body)
        if name in _AS_TEXT:
            casts = ", ".join(f"cast({c} as varchar) as {c}" for c in _AS_TEXT[name])
            statement = f"select * replace ({casts}) from (\n{statement}\n) shown"
        result[name] = statement
    return result
