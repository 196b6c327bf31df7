"""Check statements of the audits and of deletes and renames.  Rules are listed here anew."""

from __future__ import annotations

_CARELESS = """
careless_employees as (
  select case when warehouse_id is null then employee_id - 1 else employee_id end as employee_id,
         case when employment_status = 'terminated' then 'EMP-LEFT' else employee_number end as employee_number,
         case when employment_status <> 'leave' then employee_name end as employee_name,
         case when department = 'quality_control' then 'QUALITY_CONTROL' else department end as department,
         case when department = 'system_admin' then repeat(position, 8) else position end as position,
         contact_phone, email, employment_status, warehouse_id
  from employees),
careless_outbound as (
  select outbound_id, product_id, warehouse_id, picker, packer,
         case when status <> 'cancelled' then outbound_type end as outbound_type,
         case when status = 'packing' then 'boxed' else status end as status
  from outbound_orders),
careless_inventory as (
  select * replace (case when inventory_status = 'hold' then total_quantity else available_quantity end
                    as available_quantity) from inventory),
careless_adjustments as (
  select * replace (case when adjustment_type = 'write_off' then -after_quantity else after_quantity end
                    as after_quantity) from inventory_adjustments)
"""

_SOURCES = {
    "employees": "careless_employees",
    "outbound_orders": "careless_outbound",
    "inventory": "careless_inventory",
    "inventory_adjustments": "careless_adjustments",
}

_KEYS = {
    "warehouses": ["warehouse_id"],
    "locations": ["warehouse_id", "location"],
    "suppliers": ["supplier_id"],
    "products": ["product_id"],
    "supplier_products": ["supplier_id", "product_id"],
    "employees": ["employee_id"],
    "inventory": ["inventory_id"],
    "inbound_orders": ["inbound_id"],
    "outbound_orders": ["outbound_id"],
    "inventory_adjustments": ["adjustment_id"],
}

_REQUIRED = {
    "warehouses": "warehouse_id warehouse_name warehouse_type",
    "locations": "warehouse_id location capacity",
    "suppliers": "supplier_id supplier_name",
    "products": "product_id product_sku product_name",
    "employees": "employee_id employee_number employee_name department",
    "inventory": "inventory_id product_id warehouse_id",
    "inbound_orders": "inbound_id inbound_type warehouse_id operator",
    "outbound_orders": "outbound_id outbound_type warehouse_id",
    "inventory_adjustments": "adjustment_id adjustment_type warehouse_id product_id inventory_id",
}

_LISTS = {
    "warehouses.warehouse_type": "central regional front",
    "warehouses.status": "active inactive",
    "suppliers.status": "active inactive",
    "products.status": "active discontinued",
    "employees.department": "warehouse_ops order_processing quality_control system_admin",
    "employees.employment_status": "active terminated leave",
    "inventory.inventory_status": "normal hold quarantine",
    "inbound_orders.inbound_type": "purchase transfer return",
    "inbound_orders.status": "pending receiving completed cancelled",
    "outbound_orders.outbound_type": "sales transfer return",
    "outbound_orders.status": "pending picking packing shipped cancelled",
    "inventory_adjustments.adjustment_type": "count transfer write_off split",
}

_CHECKS = [
    ("locations", "capacity_positive", "capacity > 0"),
    ("locations", "utilization_within_capacity", "utilization <= capacity"),
    ("inventory", "total_not_negative", "total_quantity >= 0"),
    ("inventory", "locked_not_negative", "locked_quantity >= 0"),
    ("inventory", "available_not_negative", "available_quantity >= 0"),
    ("inventory", "total_is_locked_plus_available", "total_quantity = locked_quantity + available_quantity"),
    ("inbound_orders", "expected_not_negative", "expected_quantity >= 0"),
    ("inbound_orders", "actual_not_negative", "actual_quantity >= 0"),
    ("inventory_adjustments", "before_not_negative", "before_quantity >= 0"),
    ("inventory_adjustments", "after_not_negative", "after_quantity >= 0"),
]

_LENGTHS = {
    "warehouses": {"warehouse_name": 100, "contact_person": 50, "phone_number": 50},
    "locations": {"location": 100},
    "suppliers": {"supplier_name": 200},
    "products": {"product_sku": 50, "product_name": 200, "category": 50, "dimensions": 100, "packaging_info": 200},
    "supplier_products": {"supplier_sku": 50},
    "employees": {"employee_number": 20, "employee_name": 100, "position": 50, "contact_phone": 50, "email": 100},
    "inventory": {"storage_location": 100, "unit": 20},
    "inventory_adjustments": {"adjustment_reason": 200},
}

# table, columns, parent, parent columns
_REFERENCES = [
    ("locations", "warehouse_id", "warehouses", "warehouse_id"),
    ("supplier_products", "supplier_id", "suppliers", "supplier_id"),
    ("supplier_products", "product_id", "products", "product_id"),
    ("employees", "warehouse_id", "warehouses", "warehouse_id"),
    ("inventory", "product_id", "products", "product_id"),
    ("inventory", "warehouse_id", "warehouses", "warehouse_id"),
    ("inventory", "warehouse_id storage_location", "locations", "warehouse_id location"),
    ("inventory", "parent_inventory_id", "inventory", "inventory_id"),
    ("inbound_orders", "warehouse_id", "warehouses", "warehouse_id"),
    ("inbound_orders", "product_id", "products", "product_id"),
    ("inbound_orders", "operator", "employees", "employee_id"),
    ("outbound_orders", "warehouse_id", "warehouses", "warehouse_id"),
    ("outbound_orders", "product_id", "products", "product_id"),
    ("outbound_orders", "picker", "employees", "employee_id"),
    ("outbound_orders", "packer", "employees", "employee_id"),
    ("inventory_adjustments", "warehouse_id", "warehouses", "warehouse_id"),
    ("inventory_adjustments", "product_id", "products", "product_id"),
    ("inventory_adjustments", "inventory_id", "inventory", "inventory_id"),
    ("inventory_adjustments", "operator", "employees", "employee_id"),
]
# the alert tables hold late orders, so their references fail only where the orders' own do
_ALERT_REFERENCES = [
    (f"{direction}_orders", f"{direction}_delay_alerts", f"{direction}_id", columns, parent, parent_columns)
    for direction in ("inbound", "outbound")
    for columns, parent, parent_columns in (
        (f"{direction}_id", f"{direction}_orders", f"{direction}_id"),
        ("warehouse_id", "warehouses", "warehouse_id"),
        ("product_id", "products", "product_id"),
    )
]


def _key(table: str) -> str:
    return " || '/' || ".join(f"coalesce(cast({c} as varchar), '?')" for c in _KEYS[table])


def _rows(table: str, rule: str, broken: str, source: str | None = None) -> str:
    return (
        f"select '{table}' as table_name, {_key(table)} as row_key, '{rule}' as rule "
        f"from {source or _SOURCES.get(table, table)} where {broken}"
    )


def _careless(parts: list[str]) -> str:
    return f"with {_CARELESS.strip()}\n" + "\nunion all\n".join(parts)


def _orphan(table: str, columns: str, parent: str, parent_columns: str) -> str:
    mine, theirs = columns.split(), parent_columns.split()
    complete = " and ".join(f"c.{c} is not null" for c in mine)
    same = " and ".join(f"p.{t} = c.{c}" for c, t in zip(mine, theirs, strict=True))
    key = " || '/' || ".join(f"cast(c.{k} as varchar)" for k in _KEYS[table])
    return (
        f"select '{table}' as table_name, {key} as row_key, '{'_and_'.join(mine)}_in_{parent}' as rule "
        f"from {table} c where {complete} and not exists (select 1 from {parent} p where {same})"
    )


def _alert_orphan(orders, alerts, key, columns, parent, parent_columns) -> str:
    inbound = orders.startswith("inbound")
    states = "'pending', 'receiving'" if inbound else "'pending', 'picking', 'packing'"
    days = 5 if inbound else 3
    return (
        f"select '{alerts}' as table_name, cast(c.{key} as varchar) as row_key, "
        f"'{columns}_in_{parent}' as rule from {orders} c where c.status in ({states}) "
        f"and datediff('day', cast(c.created_time as date), date '2001-08-01') > {days} "
        f"and c.{columns} is not null "
        f"and not exists (select 1 from {parent} p where p.{parent_columns} = c.{columns})"
    )


def _repeats(table: str) -> str:
    columns = ", ".join(_KEYS[table])
    missing = " or ".join(f"{c} is null" for c in _KEYS[table])
    return (
        f"select '{table}' as table_name, {_key(table)} as row_key, "
        f"case when {missing} then 'key_missing' else 'key_repeated' end as rule, "
        f"count(*) as occurrences from {_SOURCES.get(table, table)} group by {columns} "
        f"having count(*) > 1 or {missing}"
    )


def _kept(table: str, gone: str) -> str:
    return f"select '{table}' as table_name, count(*) as rows_kept from {table} x where not ({gone})"


_SITE = "x.warehouse_id in (select warehouse_id from closed)"
_PART = "coalesce(x.product_id in (select product_id from ended), false)"

RULES: dict[str, str] = {
    "audit_primary_keys": _careless([_repeats(t) for t in _KEYS]),
    "audit_unique": _careless(
        [
            f"select '{t}' as table_name, {c} as row_key, '{c}_unique' as rule, count(*) as occurrences "
            f"from {_SOURCES.get(t, t)} where {c} is not null group by {c} having count(*) > 1"
            for t, c in (("products", "product_sku"), ("employees", "employee_number"))
        ]
    ),
    "audit_not_null": _careless(
        [_rows(t, f"{c}_required", f"{c} is null") for t, cs in _REQUIRED.items() for c in cs.split()]
    ),
    "audit_enums": _careless(
        [
            _rows(
                name.split(".")[0],
                f"{name.split('.')[1]}_allowed",
                f"{name.split('.')[1]} not in ({', '.join(repr(v) for v in values.split())})",
            )
            for name, values in _LISTS.items()
        ]
    ),
    "audit_checks": _careless(
        [
            _rows(t, rule, f"not ({condition})", "filled_locations" if t == "locations" else None)
            for t, rule, condition in _CHECKS
        ]
    ),
    "audit_lengths": _careless(
        [_rows(t, f"{c}_length", f"length({c}) > {n}") for t, cs in _LENGTHS.items() for c, n in cs.items()]
    ),
    "audit_foreign_keys": "\nunion all\n".join(
        [_orphan(*r) for r in _REFERENCES] + [_alert_orphan(*r) for r in _ALERT_REFERENCES]
    ),
    "cascade_delete": f"""
with closed as (select warehouse_id from warehouses where status = 'inactive'),
ended as (select product_id from products where status = 'discontinued'),
dropped as (select supplier_id from suppliers where status = 'inactive'),
gone_lots as (select inventory_id from inventory x where {_SITE} or {_PART})
"""
    + "\nunion all\n".join(
        [
            _kept("warehouses", _SITE),
            _kept("locations", _SITE),
            _kept("suppliers", "x.supplier_id in (select supplier_id from dropped)"),
            _kept("products", _PART),
            _kept("supplier_products", f"{_PART} or x.supplier_id in (select supplier_id from dropped)"),
            _kept("employees", "false"),
            _kept("inventory", f"{_SITE} or {_PART}"),
            _kept("inbound_orders", f"{_SITE} or {_PART}"),
            _kept("outbound_orders", f"{_SITE} or {_PART}"),
            _kept(
                "inventory_adjustments",
                f"{_SITE} or {_PART} or x.inventory_id in (select inventory_id from gone_lots)",
            ),
        ]
    ),
    "null_on_delete": """
with closed as (select warehouse_id from warehouses where status = 'inactive'),
former as (select employee_id from employees where employment_status = 'terminated')
select 'employees' as table_name, cast(employee_id as bigint) as row_id,
       case when warehouse_id not in (select warehouse_id from closed) then warehouse_id end
         as first_reference,
       cast(null as int) as second_reference
from employees
union all
select 'outbound_orders', outbound_id,
       case when picker not in (select employee_id from former) then picker end,
       case when packer not in (select employee_id from former) then packer end
from outbound_orders
""",
    "restrict_delete": """
select employee_id from employees e
where employment_status <> 'active'
  and (exists (select 1 from inbound_orders o where o.operator = e.employee_id)
       or exists (select 1 from inventory_adjustments a where a.operator = e.employee_id))
""",
    "cascade_rename_location": """
select i.inventory_id, i.warehouse_id,
       case when w.status = 'inactive' then 'closed-' || i.storage_location
            else i.storage_location end as storage_location
from inventory i join warehouses w on i.warehouse_id = w.warehouse_id
""",
}
