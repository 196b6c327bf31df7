"""Check statements of commands, guards, ingest, sinks and streams.

Ordered admission is stated as a recursion: step k handles the k-th request of every lot or
location, so each step sees what the earlier ones took.
"""

from __future__ import annotations

from oracles.views import VIEWS
from stocklens.sources.schemas import TABLES

_NO_SPACE = "Error: Location capacity is not enough, insertion rejected"
_WRONG_SITE = "Error: Operator does not belong to this warehouse"

_AS_OF = "'2001-08-01 00:00:00'"

_SHIPPING = """
with recursive wanted as materialized (
  select o.outbound_id, f.inventory_id, o.total_quantity as q, l.available_quantity as room,
         row_number() over (partition by f.inventory_id order by o.outbound_id) as k
  from outbound_orders o
  left join (select product_id, min(inventory_id) as inventory_id from inventory group by product_id) f
    on o.product_id = f.product_id
  left join inventory l on f.inventory_id = l.inventory_id
  where o.status in ('pending', 'picking', 'packing')),
served as (
  select outbound_id, inventory_id, k, q <= room as ok, case when q <= room then q else 0 end as used
  from wanted where k = 1 and inventory_id is not null
  union all
  select w.outbound_id, w.inventory_id, w.k, s.used + w.q <= w.room,
         s.used + case when s.used + w.q <= w.room then w.q else 0 end
  from served s join wanted w on w.inventory_id = s.inventory_id and w.k = s.k + 1)
"""

#: Receipts of the open orders, ``{batches}`` times over, at each place in order.
_RECEIVING = """
with recursive wanted as materialized (
  select b.batch, o.inbound_id, o.warehouse_id, f.location, o.expected_quantity,
         o.expected_quantity * p.volume as v, f.capacity - f.utilization as room,
         row_number() over (partition by o.warehouse_id, f.location order by b.batch, o.inbound_id) as k
  from inbound_orders o join products p on o.product_id = p.product_id
  join filled_locations f on f.warehouse_id = o.warehouse_id
    and f.location = 'Z-' || lpad(cast(cast(p.weight as int) as varchar), 2, '0')
  cross join (select unnest(range({batches})) as batch) b
  where o.status in ('pending', 'receiving')),
served as (
  select batch, inbound_id, warehouse_id, location, k, expected_quantity, v <= room as ok,
         cast(case when v <= room then v else 0 end as decimal(28,4)) as used
  from wanted where k = 1
  union all
  select w.batch, w.inbound_id, w.warehouse_id, w.location, w.k, w.expected_quantity, s.used + w.v <= w.room,
         cast(s.used + case when s.used + w.v <= w.room then w.v else 0 end as decimal(28,4))
  from served s join wanted w
    on w.warehouse_id = s.warehouse_id and w.location = s.location and w.k = s.k + 1)
"""

_KNOWN_EXPIRED = """i.expiry_date < date '2001-08-01'
    and exists (select 1 from employees e where e.employee_id = i.product_id)"""

_REQUEST_LOTS = """
lots as (
  select i.*, f.capacity - f.utilization as room,
         i.total_quantity - 3 as q,
         exists (select 1 from employees e where e.employee_id = i.product_id) as known
  from inventory i join filled_locations f
    on i.warehouse_id = f.warehouse_id and i.storage_location = f.location),
numbered as (
  select *, row_number() over (order by inventory_id) as n from lots
  where q >= 0 and known and q <= available_quantity and room >= 0)
"""

#: Lots of every fourth product put away in order into places that hold the others' lots.
_DELIVERY = """
with recursive good_products as (
  select * from products where product_id % 4 = 0 and status <> 'discontinued'),
held as (
  select i.warehouse_id, i.storage_location as location, sum(i.total_quantity * p.volume) as used
  from inventory i join products p on i.product_id = p.product_id
  where i.product_id % 4 <> 0 group by i.warehouse_id, i.storage_location),
wanted as materialized (
  select i.inventory_id, i.warehouse_id, i.storage_location as location, i.total_quantity * p.volume as v,
         l.capacity - cast(coalesce(h.used, 0) as decimal(22,4)) as room,
         row_number() over (partition by i.warehouse_id, i.storage_location order by i.inventory_id) as k
  from inventory i join good_products p on i.product_id = p.product_id
  join locations l on l.warehouse_id = i.warehouse_id and l.location = i.storage_location
  left join held h on h.warehouse_id = i.warehouse_id and h.location = i.storage_location
  where i.inventory_status <> 'hold'),
served as (
  select inventory_id, warehouse_id, location, k, v <= room as ok,
         cast(case when v <= room then v else 0 end as decimal(28,4)) as used
  from wanted where k = 1
  union all
  select w.inventory_id, w.warehouse_id, w.location, w.k, s.used + w.v <= w.room,
         cast(s.used + case when s.used + w.v <= w.room then w.v else 0 end as decimal(28,4))
  from served s join wanted w
    on w.warehouse_id = s.warehouse_id and w.location = s.location and w.k = s.k + 1)
"""

#: Late outbound orders on the day, and what was stored of them.
_LATE_OUTBOUND = VIEWS["outbound_delay_alerts"]

COMMANDS: dict[str, str] = {
    "tables_after_ingest": f"""
{_DELIVERY}
select 'products' as table_name, cast(product_id as bigint) as row_id,
       case when product_id % 4 = 0 and status = 'discontinued' then 'product_name_required' else '' end as violations
from products
union all
select 'inventory', i.inventory_id,
       case when i.product_id % 4 <> 0 then ''
            when p.product_id is null or i.inventory_status = 'hold'
            then concat_ws(',', case when p.product_id is null then 'product_id_in_products' end,
                           case when i.inventory_status = 'hold' then 'warehouse_id_and_storage_location_in_locations' end)
            when s.ok then '' else 'key_or_unique_value_taken_or_no_space' end
from inventory i left join good_products p on i.product_id = p.product_id
left join served s on s.inventory_id = i.inventory_id
""",
    "locations_after_ingest": f"""
{_DELIVERY},
added as (select warehouse_id, location, max(used) as used from served group by warehouse_id, location)
select l.warehouse_id, l.location,
       round(cast(coalesce(h.used, 0) + coalesce(a.used, 0) as double), 4) as utilization
from locations l left join held h on h.warehouse_id = l.warehouse_id and h.location = l.location
left join added a on a.warehouse_id = l.warehouse_id and a.location = l.location
""",
    "alerts_after_receipt": f"""
{_RECEIVING.format(batches=1)}
select a.* from ({VIEWS["inbound_delay_alerts"]}) a
where a.inbound_id not in (select inbound_id from served where ok)
""",
    "alerts_after_shipping": f"""
{_SHIPPING}
select a.* from ({_LATE_OUTBOUND}) a where a.outbound_id not in (select outbound_id from served where ok)
""",
    "alerts_cleared_by_shipping": f"""
{_SHIPPING}
select a.outbound_id, 'cleared' as change, a.alert_level as alert_level_before, a.delay_days as delay_days_before,
       cast(null as varchar) as alert_level_after, cast(null as varchar) as delay_days_after
from ({_LATE_OUTBOUND}) a where a.outbound_id in (select outbound_id from served where ok)
""",
    "stream_lot_states": """
with fresh as (
  select i.warehouse_id, i.storage_location as location, sum(i.locked_quantity * p.volume) as used
  from inventory i join products p on i.product_id = p.product_id
  where i.inventory_status <> 'hold' group by i.warehouse_id, i.storage_location)
select l.warehouse_id, l.location, round(cast(coalesce(f.used, 0) as double), 4) as utilization
from locations l
left join fresh f on l.warehouse_id = f.warehouse_id and l.location = f.location
""",
    "split_inventory": f"""
with {_REQUEST_LOTS},
ids as (
  select n.*, (select max(inventory_id) from inventory) + n.n as new_id,
         (select max(adjustment_id) from inventory_adjustments) + 2 * n.n - 1 as log_id
  from numbered n)
select log_id as adjustment_id, 'split' as adjustment_type, warehouse_id, product_id,
       new_id as inventory_id, 0 as before_quantity, q as after_quantity, q as quantity_change,
       'split from ' || inventory_id as adjustment_reason, product_id as operator,
       {_AS_OF} as adjustment_time, cast(null as varchar) as notes
from ids
union all
select log_id + 1, 'split', warehouse_id, product_id, inventory_id, total_quantity,
       total_quantity - q, -q, 'split to ' || new_id, product_id, {_AS_OF}, null
from ids
""",
    "write_off_lot": f"""
with numbered as (
  select *, row_number() over (order by inventory_id) as n from inventory i
  where expiry_date < date '2001-08-01'
    and exists (select 1 from employees e where e.employee_id = i.product_id))
select (select max(adjustment_id) from inventory_adjustments) + n as adjustment_id,
       'write_off' as adjustment_type, warehouse_id, product_id, inventory_id,
       total_quantity as before_quantity, 0 as after_quantity, -total_quantity as quantity_change,
       'inventory drop' as adjustment_reason, product_id as operator, {_AS_OF} as adjustment_time,
       cast(null as varchar) as notes
from numbered
""",
    "create_inbound_order": f"""
with numbered as (
  select o.*, row_number() over (order by inbound_id) as n
  from inbound_orders o join employees e on o.operator = e.employee_id
  where o.status = 'cancelled' and (e.warehouse_id is null or e.warehouse_id = o.warehouse_id))
select (select max(inbound_id) from inbound_orders) + n as inbound_id, product_id, inbound_type,
       warehouse_id, expected_quantity, cast(null as int) as actual_quantity, total_items,
       'pending' as status, {_AS_OF} as created_time, cast(null as varchar) as received_time,
       operator, notes
from numbered
""",
    "create_outbound_order": f"""
with numbered as (
  select o.*, row_number() over (order by outbound_id) as n
  from outbound_orders o
  left join employees a on o.picker = a.employee_id
  left join employees b on o.packer = b.employee_id
  where o.status = 'cancelled'
    and not coalesce(a.warehouse_id <> o.warehouse_id or b.warehouse_id <> o.warehouse_id, false))
select (select max(outbound_id) from outbound_orders) + n as outbound_id, product_id,
       outbound_type, warehouse_id, total_items, total_quantity, 'pending' as status, picker,
       packer, {_AS_OF} as created_time, cast(null as varchar) as shipped_time
from numbered
""",
    "complete_inbound": f"""
with recursive wanted as materialized (
  select o.inbound_id, o.warehouse_id, f.location, o.expected_quantity * p.volume as v,
         f.capacity - f.utilization as room,
         row_number() over (partition by o.warehouse_id, f.location order by o.inbound_id) as k
  from inbound_orders o join products p on o.product_id = p.product_id
  join filled_locations f on f.warehouse_id = o.warehouse_id
    and f.location = 'Z-' || lpad(cast(cast(p.weight as int) as varchar), 2, '0')
  where o.status in ('pending', 'receiving')),
served as (
  select inbound_id, warehouse_id, location, k, v <= room as ok,
         cast(case when v <= room then v else 0 end as decimal(28,4)) as used
  from wanted where k = 1
  union all
  select w.inbound_id, w.warehouse_id, w.location, w.k, s.used + w.v <= w.room,
         cast(s.used + case when s.used + w.v <= w.room then w.v else 0 end as decimal(28,4))
  from served s join wanted w
    on w.warehouse_id = s.warehouse_id and w.location = s.location and w.k = s.k + 1),
numbered as (
  select inbound_id, row_number() over (order by inbound_id) as n from served where ok)
select s.inbound_id as request_id, s.inbound_id, s.ok as accepted,
       case when not s.ok then '{_NO_SPACE}' end as reason,
       (select max(inventory_id) from inventory) + n.n as new_inventory_id
from served s left join numbered n on s.inbound_id = n.inbound_id
""",
    "complete_outbound": f"""
{_SHIPPING}
select w.outbound_id as request_id, w.outbound_id, w.inventory_id, coalesce(s.ok, false) as accepted,
       case when w.inventory_id is null then 'lot not found'
            when not s.ok then 'not enough available stock' end as reason
from wanted w left join served s on w.outbound_id = s.outbound_id
""",
    "publish_snapshot": f"""
{_SHIPPING},
taken as (
  select s.inventory_id, sum(w.q) as q from served s join wanted w on s.outbound_id = w.outbound_id
  where s.ok group by s.inventory_id)
select i.inventory_id, cast(i.total_quantity - coalesce(t.q, 0) as int) as total_quantity,
       i.locked_quantity, cast(i.available_quantity - coalesce(t.q, 0) as int) as available_quantity,
       case when t.q is null then '2001-07-31 00:00:00' else {_AS_OF} end as last_updated
from inventory i left join taken t on i.inventory_id = t.inventory_id
""",
    "update_employee_status": """
with asked as (
  select a.adjustment_id, a.operator, e.employee_id, e.employment_status,
         case a.adjustment_type when 'write_off' then 'leave' when 'split' then 'active'
              when 'transfer' then 'terminated' else 'on_site' end as new_status
  from inventory_adjustments a left join employees e on a.operator = e.employee_id),
changed as (
  select *, lag(new_status) over (partition by employee_id order by adjustment_id) as earlier
  from asked where employee_id is not null and new_status <> 'on_site')
select q.adjustment_id as request_id, q.operator as employee_id, c.adjustment_id is not null as accepted,
       case when q.employee_id is null then 'Error: Employee does not exist'
            when c.adjustment_id is null then 'unknown status'
            else 'Change employee status form ' || coalesce(c.earlier, c.employment_status) || ' to '
                 || c.new_status end as message
from asked q left join changed c on q.adjustment_id = c.adjustment_id
""",
    "ingest_batch": f"""
with judged as (
  select o.inbound_id, o.status as stored_status,
         case when o.status = 'cancelled' then 'inbound_type_required' end as missing,
         case when e.warehouse_id <> o.warehouse_id then '{_WRONG_SITE}' end as guard
  from inbound_orders o left join employees e on o.operator = e.employee_id)
select inbound_id, stored_status as status,
       case when missing is null and guard is null
            then case when stored_status = 'completed' then 'key_or_unique_value_taken' else '' end
            else concat_ws(',', missing, guard) end as violations
from judged
""",
    "capacity_guard": f"""
with recursive wanted as materialized (
  select i.inventory_id, i.warehouse_id, i.storage_location, i.total_quantity * p.volume as v,
         l.capacity as room,
         row_number() over (partition by i.warehouse_id, i.storage_location order by i.inventory_id) as k
  from inventory i join products p on i.product_id = p.product_id
  join locations l on i.warehouse_id = l.warehouse_id and i.storage_location = l.location),
served as (
  select inventory_id, warehouse_id, storage_location, k, v <= room as ok,
         cast(case when v <= room then v else 0 end as decimal(28,4)) as used
  from wanted where k = 1
  union all
  select w.inventory_id, w.warehouse_id, w.storage_location, w.k, s.used + w.v <= w.room,
         cast(s.used + case when s.used + w.v <= w.room then w.v else 0 end as decimal(28,4))
  from served s join wanted w on w.warehouse_id = s.warehouse_id
    and w.storage_location = s.storage_location and w.k = s.k + 1)
select inventory_id, case when not ok then '{_NO_SPACE}' end as rejection from served
""",
    "inbound_operator_guard": f"""
select o.inbound_id, o.operator, o.warehouse_id,
       case when e.warehouse_id <> o.warehouse_id then '{_WRONG_SITE}' end as rejection
from inbound_orders o left join employees e on o.operator = e.employee_id
""",
    "outbound_operator_guard": f"""
select o.outbound_id, o.picker, o.packer, o.warehouse_id,
       case when a.warehouse_id <> o.warehouse_id or b.warehouse_id <> o.warehouse_id
            then '{_WRONG_SITE}' end as rejection
from outbound_orders o
left join employees a on o.picker = a.employee_id
left join employees b on o.packer = b.employee_id
""",
    "recalculate_utilization": """
select warehouse_id, location, round(cast(capacity as double), 4) as capacity,
       round(cast(utilization as double), 4) as utilization
from filled_locations
""",
    "utilization_on_insert": """
select f.warehouse_id, f.location,
       case when exists (select 1 from inventory i where i.warehouse_id = f.warehouse_id
                         and i.storage_location = f.location and i.inventory_status = 'hold')
            then round(cast(f.utilization as double), 4) else 0 end as utilization
from filled_locations f
""",
    "utilization_on_update": """
with moved as (
  select warehouse_id, storage_location as old_place, product_id, total_quantity,
         inventory_status = 'hold' as held,
         case when inventory_status = 'hold' then 'Z-01' else storage_location end as place
  from inventory),
touched as (
  select warehouse_id, old_place as location from moved where held
  union select warehouse_id, place from moved where held),
fresh as (
  select m.warehouse_id, m.place as location, sum(m.total_quantity * p.volume) as used
  from moved m join products p on m.product_id = p.product_id group by m.warehouse_id, m.place)
select l.warehouse_id, l.location,
       case when t.location is null then 0
            else round(cast(coalesce(f.used, 0) as double), 4) end as utilization
from locations l
left join touched t on l.warehouse_id = t.warehouse_id and l.location = t.location
left join fresh f on l.warehouse_id = f.warehouse_id and l.location = f.location
""",
    "utilization_on_delete": """
with state as (select *, expiry_date < date '2001-08-01' as expired from inventory),
touched as (select distinct warehouse_id, storage_location as location from state where expired),
fresh as (
  select s.warehouse_id, s.storage_location as location, sum(s.total_quantity * p.volume) as used
  from state s join products p on s.product_id = p.product_id
  where not s.expired group by s.warehouse_id, s.storage_location)
select l.warehouse_id, l.location,
       case when t.location is null then 0
            else round(cast(coalesce(f.used, 0) as double), 4) end as utilization
from locations l
left join touched t on l.warehouse_id = t.warehouse_id and l.location = t.location
left join fresh f on l.warehouse_id = f.warehouse_id and l.location = f.location
""",
    "stream_location_utilization": """
with fresh as (
  select i.warehouse_id, i.storage_location as location, sum(i.locked_quantity * p.volume) as used
  from inventory i join products p on i.product_id = p.product_id
  where i.inventory_status <> 'hold' group by i.warehouse_id, i.storage_location)
select l.warehouse_id, l.location, round(cast(coalesce(f.used, 0) as double), 4) as utilization
from locations l
left join fresh f on l.warehouse_id = f.warehouse_id and l.location = f.location
""",
    "read_tables": """
select 'warehouses' as table_name, count(*) as row_count, cast(sum(warehouse_id) as double) as id_sum
from warehouses
union all select 'locations', count(*), cast(sum(warehouse_id) as double) from locations
union all select 'suppliers', count(*), cast(sum(supplier_id) as double) from suppliers
union all select 'products', count(*), cast(sum(product_id) as double) from products
union all select 'supplier_products', count(*), cast(sum(supplier_id) as double) from supplier_products
union all select 'employees', count(*), cast(sum(employee_id) as double) from employees
union all select 'inventory', count(*), cast(sum(inventory_id) as double) from inventory
union all select 'inbound_orders', count(*), cast(sum(inbound_id) as double) from inbound_orders
union all select 'outbound_orders', count(*), cast(sum(outbound_id) as double) from outbound_orders
union all select 'inventory_adjustments', count(*), cast(sum(adjustment_id) as double)
from inventory_adjustments
""",
    "inbound_orders_after_receipt": f"""
{_RECEIVING.format(batches=1)}
select o.inbound_id, case when s.ok then 'completed' else o.status end as status,
       case when s.ok then s.expected_quantity else o.actual_quantity end as actual_quantity,
       case when s.ok then {_AS_OF} else strftime(o.received_time, '%Y-%m-%d %H:%M:%S') end as received_time
from inbound_orders o left join served s on o.inbound_id = s.inbound_id
""",
    "complete_inbound_twice": f"""
{_RECEIVING.format(batches=2)}
select f.warehouse_id, f.location,
       round(cast(f.utilization + coalesce(max(s.used), 0) as double), 4) as utilization
from filled_locations f left join served s on f.warehouse_id = s.warehouse_id and f.location = s.location
group by f.warehouse_id, f.location, f.utilization
""",
    "locations_after_outbound": f"""
{_SHIPPING},
taken as (
  select s.inventory_id, sum(w.q) as q from served s join wanted w on s.outbound_id = w.outbound_id
  where s.ok group by s.inventory_id),
fresh as (
  select i.warehouse_id, i.storage_location as location,
         sum((i.total_quantity - coalesce(t.q, 0)) * p.volume) as used
  from inventory i join products p on i.product_id = p.product_id
  left join taken t on i.inventory_id = t.inventory_id
  group by i.warehouse_id, i.storage_location)
select l.warehouse_id, l.location, round(cast(coalesce(f.used, 0) as double), 4) as utilization
from locations l left join fresh f on l.warehouse_id = f.warehouse_id and l.location = f.location
""",
    "locations_after_split": """
select warehouse_id, location, round(cast(utilization as double), 4) as utilization from filled_locations
""",
    "locations_after_write_off": f"""
with fresh as (
  select i.warehouse_id, i.storage_location as location, sum(i.total_quantity * p.volume) as used
  from inventory i join products p on i.product_id = p.product_id
  where not ({_KNOWN_EXPIRED}) group by i.warehouse_id, i.storage_location)
select l.warehouse_id, l.location, round(cast(coalesce(f.used, 0) as double), 4) as utilization
from locations l left join fresh f on l.warehouse_id = f.warehouse_id and l.location = f.location
""",
    "lots_after_write_off": f"""
select i.inventory_id, case when {_KNOWN_EXPIRED} then 0 else total_quantity end as total_quantity,
       case when {_KNOWN_EXPIRED} then 0 else locked_quantity end as locked_quantity,
       case when {_KNOWN_EXPIRED} then 0 else available_quantity end as available_quantity
from inventory i
""",
    "staff_after_status_changes": """
with asked as (
  select operator, arg_max(case adjustment_type when 'write_off' then 'leave' when 'split' then 'active'
                           else 'terminated' end, adjustment_id) as status
  from inventory_adjustments where adjustment_type in ('write_off', 'split', 'transfer') group by operator)
select e.employee_id, coalesce(a.status, e.employment_status) as employment_status
from employees e left join asked a on e.employee_id = a.operator
""",
    "lots_after_cascade": """
select i.inventory_id, i.product_id, i.warehouse_id from inventory i
where i.warehouse_id not in (select warehouse_id from warehouses where status = 'inactive')
  and i.product_id not in (select product_id from products where status = 'discontinued')
""",
    "locations_after_cascade": """
with fresh as (
  select i.warehouse_id, i.storage_location as location, sum(i.total_quantity * p.volume) as used
  from inventory i join products p on i.product_id = p.product_id
  where p.status <> 'discontinued' group by i.warehouse_id, i.storage_location)
select l.warehouse_id, l.location, round(cast(coalesce(f.used, 0) as double), 4) as utilization
from locations l left join fresh f on l.warehouse_id = f.warehouse_id and l.location = f.location
where l.warehouse_id not in (select warehouse_id from warehouses where status = 'inactive')
""",
}

COMMANDS["publish_changes"] = COMMANDS["publish_snapshot"]
COMMANDS["lots_of_earlier_run"] = """
select inventory_id, total_quantity, locked_quantity, available_quantity, '2001-07-31 00:00:00' as last_updated
from inventory
"""
COMMANDS["load_with_rejects"] = " union all ".join(
    f"""
select '{name}' as table_name, case when {key} % 50 = 0 then 'no-' else '' end || {key} as row_key, {key} % 50 = 0 as rejected
from {name}
"""
    for name, key in (("products", "product_id"), ("suppliers", "supplier_id"))
)


def _row_digest(name: str) -> str:
    shown = ", ".join(f"coalesce(cast({c} as varchar), '?')" for c in TABLES[name].names)
    return f"""
select '{name}' as table_name, count(*) as row_count,
       cast(sum(cast('0x' || substr(md5(concat_ws('|', {shown})), 1, 8) as bigint)) as bigint) as row_digest
from {name}
"""


COMMANDS["read_whole_rows"] = " union all ".join(_row_digest(name) for name in TABLES)
