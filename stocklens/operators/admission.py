"""Ordered admission: which requests of a batch fit, as if they were handled one by one.

Every request asks for amounts of one or more resources (stock of a lot, space of a location, a key
that may exist once).  It is accepted when each limited amount still fits after the accepted
requests before it; a rejected request takes nothing.  Whether a request fits therefore depends on
the verdicts before it, which a running sum alone cannot express.

Most requests are decided by bounds.  For every undecided request two running sums bound what earlier
requests will have taken: all undecided ones accepted, or none.  A request that fits under the first is
accepted, one that does not fit under the second is rejected, and both verdicts are exact.  Rounds of
bounds go on while each leaves at most half of the open requests open.

What is left depends on each other, like goods that move on along a chain of full places.  Resources are
contested if an open request may fail there; requests that meet at contested resources, directly or through
others, form a connected component, and no verdict depends on another component.  Every component is
folded once, in order of arrival, as a sorted stream: a task holds what is taken of one component's
resources, not its requests.  So the number of rounds does not follow the length of a chain.  Only the requests of
one component that bounds cannot decide are handled one after the other, as their verdicts are.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stocklens.functions.components import components
from stocklens.functions.scale import running_sums
from stocklens.session import landed, ship_package

#: Amounts and rooms are whole numbers; volumes are counted in ten-thousandths.
VOLUME_UNIT = 10_000
#: So few open demands are folded in one stream, without looking for their components.
AT_ONCE = 50_000
#: Resources of open demands are marked in so many slots of their hash.
OPEN_SLOTS = 1 << 18


def admit(demands: DataFrame, single: bool = False) -> DataFrame:
    """Verdict per request: ``request_id``, ``accepted``.

    ``demands`` has ``request_id`` (order of arrival), ``resource``, ``amount`` (negative gives
    back, NULL takes nothing), ``room`` (left at the start; NULL means unlimited) and ``_range`` from
    ``in_ranges``; one row per request and resource.  Resources may be of any type that can be sorted; whole numbers
    are the fastest.  ``single`` promises one row per request; ``_head``, if given, is true in one row of each request.
    """
    working = demands.select(
        "request_id",
        "resource",
        F.coalesce(F.col("amount").cast("bigint"), F.lit(0).cast("bigint")).alias("amount"),
        F.col("room").cast("bigint"),
        "_range",
        *(["_head"] if "_head" in demands.columns else []),
        F.lit(None).cast("boolean").alias("accepted"),
    )
    verdicts: list[DataFrame] = []
    before = None
    while True:
        judged = landed(_judge(working, single), "judged")
        verdicts.append(judged.filter("_head and accepted is not null").select("request_id", "accepted"))
        open_ = judged.filter(F.col("accepted").isNull()).count()
        if not open_:
            break
        if open_ <= AT_ONCE or (before is not None and open_ > before / 2):
            verdicts.append(_folded(_settled(judged), open_, single))
            break
        before = open_
        working = _met_by_open(judged).drop("_fits")
    return reduce(DataFrame.unionByName, verdicts)


def _met_by_open(judged: DataFrame) -> DataFrame:
    """Demands that are open, and accepted ones of about the resources that open ones ask for.

    Resources are told apart by slots of their hash: all that matter are there, and a few others, which change nothing.
    """
    slot = F.pmod(F.xxhash64("resource"), F.lit(OPEN_SLOTS)).cast("int")
    slots = judged.filter(F.col("accepted").isNull()).select(slot.alias("_slot")).distinct()
    working = judged.filter(F.coalesce("accepted", F.lit(True))).withColumn("_slot", slot)
    return working.join(F.broadcast(slots), "_slot", "left_semi").drop("_slot")


def _settled(judged: DataFrame) -> DataFrame:
    """Undecided demands whose ``room`` no longer contains what accepted requests before them took."""
    working = _met_by_open(judged)
    taken = F.when(F.col("accepted"), F.col("amount")).otherwise(0)
    return (
        running_sums(working, ["resource"], "request_id", {"taken": taken})
        .filter(F.col("accepted").isNull())
        .withColumn("room", F.col("room") - F.col("taken"))
        .drop("taken")
    )


def _folded(settled: DataFrame, open_: int, single: bool) -> DataFrame:
    """Verdicts of the open requests, one component at a time in order of arrival."""
    settled = landed(settled, "settled")
    # where no open request can fail, none depends on another
    contested = settled.filter("not _fits").select("resource").distinct()
    meeting = settled.join(contested, "resource", "left_semi")
    if single:
        placed = meeting.withColumn("component", F.col("resource"))
    elif open_ <= AT_ONCE:
        placed = meeting.withColumn("component", F.lit(""))
    else:
        placed = _by_component(landed(meeting, "meeting"))
    # everything of a component is one sorted stream, whatever its request ids
    streams = placed.select("component", "request_id", "resource", "amount", "room")
    streams = streams.repartition("component").sortWithinPartitions("component", "request_id")
    ship_package(settled.sparkSession)
    return landed(streams.mapInArrow(_one_by_one, "request_id bigint, accepted boolean"), "folded")


def _by_component(meeting: DataFrame) -> DataFrame:
    """Open demands with the component of their resource: resources of one request are linked in a chain."""
    own = Window.partitionBy("request_id").orderBy("resource")  # a handful of demands each
    links = meeting.select(F.col("resource").alias("a"), F.lead("resource").over(own).alias("b"))
    found = components(links.filter("b is not null")).withColumnRenamed("node", "resource")
    return meeting.join(found, "resource", "left").withColumn("component", F.coalesce("component", "resource"))


def _one_by_one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Requests of sorted components, each judged by what the accepted ones before it have taken."""
    used: dict[str, int] = {}
    component, request, wants = None, None, []
    ids, verdicts = [], []

    def judge() -> None:
        fits = all(room is None or used.get(resource, 0) + amount <= room for resource, amount, room in wants)
        if fits:
            for resource, amount, _ in wants:
                used[resource] = used.get(resource, 0) + amount
        ids.append(request)
        verdicts.append(fits)

    for batch in batches:
        for place, asked, *want in zip(*(column.to_pylist() for column in batch.columns), strict=True):
            if wants and (place, asked) != (component, request):
                judge()
                wants = []
            if place != component:
                used.clear()
            component, request = place, asked
            wants.append(want)
        yield _verdict_rows(ids, verdicts)
        ids, verdicts = [], []
    if wants:
        judge()
        yield _verdict_rows(ids, verdicts)


def _verdict_rows(ids: list[int], verdicts: list[bool]) -> pa.RecordBatch:
    columns = [pa.array(ids, pa.int64()), pa.array(verdicts, pa.bool_())]
    return pa.RecordBatch.from_arrays(columns, ["request_id", "accepted"])


def _judge(working: DataFrame, single: bool) -> DataFrame:
    """Undecided demands with the verdict of their request where this round can tell.

    Their ``room`` no longer contains what requests accepted in earlier rounds took before them.  ``_fits`` marks
    demands that fit whatever the open requests before them get, ``_head`` one demand of each request.
    """
    undecided = F.col("accepted").isNull()
    amount = F.col("amount")
    sums = {
        "taken": F.when(F.col("accepted"), amount).otherwise(0),
        "most": F.when(undecided & (amount > 0), amount).otherwise(0),
        "least": F.when(undecided & (amount < 0), amount).otherwise(0),
    }
    bounded = (
        running_sums(working, ["resource"], "request_id", sums)
        .filter(undecided)
        .withColumn("room", F.col("room") - F.col("taken"))
    )
    fits = F.coalesce(F.col("most") + amount <= F.col("room"), F.lit(True))
    fails = F.coalesce(F.col("least") + amount > F.col("room"), F.lit(False))
    marked = bounded.withColumns({"_fits": fits, "_fails": fails})
    if single:
        any_fails, all_fit, head = F.col("_fails"), F.col("_fits"), F.lit(True)
    else:
        request = Window.partitionBy("request_id")  # a handful of demands each
        any_fails, all_fit = F.bool_or("_fails").over(request), F.bool_and("_fits").over(request)
        # an open request keeps all its demands, so also the one that stands for it
        head = F.col("_head") if "_head" in working.columns else F.row_number().over(request.orderBy("resource")) == 1
    return marked.withColumns(
        {"accepted": F.when(any_fails, F.lit(False)).when(all_fit, F.lit(True)), "_head": head}
    ).select("request_id", "resource", "amount", "room", "_range", "_fits", "accepted", "_head")
