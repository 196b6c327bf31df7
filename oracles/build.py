"""Put the mapped tables a statement names in front of it as common table expressions."""

from __future__ import annotations

import re

from oracles.mapping import MAPPING

#: helper CTEs that statements may name besides the mapped tables
HELPERS: dict[str, str] = {
    "used_volume": """
select i.warehouse_id, i.storage_location as location, sum(p.volume * i.total_quantity) as used
from inventory i join products p on i.product_id = p.product_id
group by i.warehouse_id, i.storage_location
""",
    "filled_locations": """
select l.warehouse_id, l.location, l.capacity,
       cast(coalesce(u.used, 0) as decimal(22,4)) as utilization
from locations l left join used_volume u
  on l.warehouse_id = u.warehouse_id and l.location = u.location
""",
}


def with_tables(body: str) -> str:
    """``body`` preceded by the CTEs it needs, directly or through other CTEs."""
    known = {**MAPPING, **HELPERS}
    order: list[str] = []

    def visit(text: str) -> None:
        for name in known:
            if name not in order and re.search(rf"(from|join|,)\s+{name}\b", text):
                visit(known[name])
                order.append(name)

    visit(body)
    ctes = ",\n".join(f"{n} as ({known[n].strip()})" for n in dict.fromkeys(order))
    body = body.strip()
    if not ctes:
        return body
    if body.startswith("with recursive "):
        return f"with recursive {ctes},\n{body[len('with recursive '):]}"
    if body.startswith("with "):
        return f"with {ctes},\n{body[len('with '):]}"
    return f"with {ctes}\n{body}"
