"""Check statements of splits that move goods: every step handles the next request of each site.

Goods stay in their site, so sites do not depend on each other.  A step holds the space used at the fifty
places of a site, in ten-thousandths, and sees what all earlier steps moved.
"""

from __future__ import annotations

_AS_OF = "'2001-08-01 00:00:00'"

#: Requests of move_every_lot, or of move_parts_of_parts ({parts}: 0 or 0 and 1), with places by number.
_WANTED = """
with recursive lots as (
  select i.*, cast(substr(i.storage_location, 3) as int) as spot, cast(p.volume * 10000 as bigint) as volume,
         exists (select 1 from employees e where e.employee_id = i.product_id) as known
  from inventory i join products p on i.product_id = p.product_id),
wanted as materialized (
  select l.inventory_id * {scale} + x.part as request_id, x.part, l.inventory_id, l.warehouse_id, l.known,
         (l.spot + x.part - 1) % 50 + 1 as here, (l.spot + x.part) % 50 + 1 as there,
         case x.part when 0 then l.total_quantity - 3 else cast(floor((l.total_quantity - 3) / 2.0) as int) end as q,
         l.total_quantity - 3 as made, l.volume, l.available_quantity, l.total_quantity, l.product_id,
         row_number() over (partition by l.warehouse_id order by l.inventory_id, x.part) as k
  from lots l cross join (select unnest({parts}) as part) x),
site as (
  select f.warehouse_id,
         list(cast(round(f.utilization * 10000) as bigint) order by f.location) as used,
         list(cast(round(f.capacity * 10000) as bigint) order by f.location) as room,
         list(cast(substr(f.location, 3) as int) order by f.location) as spots
  from filled_locations f group by f.warehouse_id),
steps as (
  select s.warehouse_id, cast(0 as bigint) as k, cast(null as bigint) as request_id, false as ok, s.used
  from site s
  union all
  select n.warehouse_id, n.k, n.request_id, n.ok,
         case when not n.ok then n.used else list_transform(n.used, lambda u, i:
           u + case when n.spots[i] = n.there then n.size else 0 end - case when n.spots[i] = n.here then n.size else 0 end) end
  from (
    select w.*, s.used, t.spots, w.q * w.volume as size,
           coalesce(w.known and w.q >= 0 and list_contains(t.spots, w.there)
             and case w.part when 0 then w.q <= least(w.available_quantity, w.total_quantity)
                             else s.ok and s.request_id = w.request_id - 1 and w.q <= w.made end
             and s.used[list_position(t.spots, w.there)] + w.q * w.volume <= t.room[list_position(t.spots, w.there)], false) as ok
    from steps s join wanted w on w.warehouse_id = s.warehouse_id and w.k = s.k + 1
    join site t on t.warehouse_id = s.warehouse_id) n),
numbered as (
  select w.*, row_number() over (order by w.request_id) as n
  from steps s join wanted w on w.request_id = s.request_id where s.ok),
placed as (
  select n.*, (select max(inventory_id) from inventory) + n.n as new_id from numbered n),
last_steps as (
  select s.warehouse_id, unnest(t.spots) as spot, unnest(s.used) as used
  from steps s join site t on t.warehouse_id = s.warehouse_id
  where (s.warehouse_id, s.k) in (select (warehouse_id, max(k)) from steps group by warehouse_id))
"""

_MOVES = _WANTED.format(scale=1, parts="[0]")
_PARTS = _WANTED.format(scale=2, parts="[0, 1]")

_SPACE = """
select f.warehouse_id, f.location, round(cast(l.used / 10000.0 as double), 4) as utilization
from filled_locations f join last_steps l
  on l.warehouse_id = f.warehouse_id and f.location = 'Z-' || lpad(cast(l.spot as varchar), 2, '0')
"""

MOVES: dict[str, str] = {
    "move_lots": f"""
{_MOVES}
select (select max(adjustment_id) from inventory_adjustments) + 2 * n - 1 as adjustment_id, warehouse_id,
       new_id as inventory_id, 0 as before_quantity, q as after_quantity,
       'split from ' || inventory_id as adjustment_reason
from placed
union all
select (select max(adjustment_id) from inventory_adjustments) + 2 * n, warehouse_id, inventory_id,
       total_quantity, total_quantity - q, 'split to ' || new_id
from placed
""",
    "locations_after_moves": f"{_MOVES}{_SPACE}",
    "split_parts_of_parts": f"""
{_PARTS}
select w.request_id, case w.part when 0 then w.inventory_id else m.new_id end as source_id,
       p.new_id is not null as accepted,
       case when p.new_id is not null then null
            when w.part = 1 and m.new_id is null then 'source lot not found'
            when w.q < 0 then 'quantity missing or negative'
            when not exists (select 1 from site t where t.warehouse_id = w.warehouse_id and list_contains(t.spots, w.there))
              then 'target location not found'
            when not w.known then 'operator not found'
            else 'not enough available stock or no space at the target' end as reason,
       p.new_id as new_inventory_id
from wanted w left join placed p on p.request_id = w.request_id
left join placed m on w.part = 1 and m.request_id = w.request_id - 1
""",
    "lots_after_parts_of_parts": f"""
{_PARTS}
select i.inventory_id, i.warehouse_id, i.storage_location,
       cast(i.total_quantity - coalesce(p.q, 0) as int) as total_quantity,
       cast(i.available_quantity - coalesce(p.q, 0) as int) as available_quantity, cast(null as bigint) as parent_inventory_id
from inventory i left join placed p on p.inventory_id = i.inventory_id and p.part = 0
union all
select p.new_id, p.warehouse_id, 'Z-' || lpad(cast(p.there as varchar), 2, '0'),
       cast(p.q - coalesce(o.q, 0) as int), cast(p.q - coalesce(o.q, 0) as int),
       case p.part when 0 then p.inventory_id else m.new_id end
from placed p left join placed o on p.part = 0 and o.part = 1 and o.request_id = p.request_id + 1
left join placed m on p.part = 1 and m.request_id = p.request_id - 1
""",
    "locations_after_parts_of_parts": f"{_PARTS}{_SPACE}",
}
