"""Near-duplicate embeddings by NN-descent: a neighbour graph refined through neighbours of neighbours.

Equal vectors are one node from the start.  Nodes are sorted by the signs of random projections, several
times, and each node takes its best neighbours among those next to it.  Then every node introduces its
neighbours, in either direction, to each other; whoever is nearer than a list's last entry enters it.
Very many reverse neighbours are dealt out in blocks.  Rounds go on until one changes almost no list, counted
over all nodes.  An audit then compares a bounded number of vectors with all by brute force, linearly in the
data: as many as it takes to hold enough links.  Where that bound holds too few, it logs that it could not
measure; where it misses links, the search goes on with further projections.

Edges of at least the threshold, computed again in double precision, are the links.  A list whose entries
all reach the threshold is saturated: there may be more links than it holds.  Those inside its component
are found by comparing the component tile by tile; only counts leave the tiles.  Those that leave it have
a saturated list at both ends, as any other list holds all its links.  So nodes with saturated lists
get further lists, of the best nodes in other components, refined in the same way.  What reaches the
threshold joins components, and the search goes on until the outward lists hold no link.

Vectors that are missing, zero, or hold missing or non-finite components link with nothing, and vectors of
different lengths do not link; of equally near neighbours a list keeps those with the smaller id, which changes no
link; a repeated id counts once, with its first vector by value; an empty table
gives an empty result; other columns, labels among them, are not read.
"""

from __future__ import annotations

import logging
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stocklens.llm.components import components
from stocklens.llm.tasks import by_batches
from stocklens.session import landed, ship_package

THRESHOLD = 0.95
NEIGHBOURS = 12
TABLES = 8
#: Neighbours that meet at once, vectors side by side at the start, and vectors of a tile.
BLOCK, CHUNK, TILE = 48, 256, 2_048
#: A round that changes at most this share of all lists is the last one.
STILL = 0.001
#: Vectors of the audit at first and at most, the links it should hold, the share of them that must be
#: known, and how often the search starts anew before too low a share is an error.
AUDITED, AUDITED_MOST, AUDITED_LINKS, RECALL, RESTARTS = 256, 4_096, 256, 0.995, 4
_SLACK = 1e-6
_LOG = logging.getLogger(__name__)


def _matrix(raw: list[bytes]) -> np.ndarray:
    """Unit vectors in double precision."""
    vectors = np.frombuffer(b"".join(raw), "<f8").reshape(len(raw), -1)
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def _by_length(raw: list[bytes]) -> Iterator[np.ndarray]:
    sizes = np.array([len(r) for r in raw])
    for size in np.unique(sizes):
        yield np.flatnonzero(sizes == size)


def usable(embeddings: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """``vec_id`` and ``vector`` (bytes of doubles) of the vectors that can link, one row per id."""
    ship_package(embeddings.sparkSession)
    vector = F.col(f"`{vector_column}`").cast("array<double>")
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    nonzero = F.exists(vector, lambda x: x != 0)
    rows = embeddings.select(F.col(f"`{id_column}`").alias("vec_id"), vector.alias("values"))
    rows = rows.filter(F.col("vec_id").isNotNull() & sound & nonzero)
    kind = embeddings.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(1)
            flat = values.flatten().to_numpy(zero_copy_only=False) + 0.0  # also makes -0.0 zero
            cuts = np.cumsum(np.concatenate([[0], [len(v) for v in values]])).tolist()
            raw = [flat[i:j].tobytes() for i, j in zip(cuts, cuts[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw, pa.binary())], ["vec_id", "vector"])

    plain = rows.mapInArrow(run, f"vec_id {kind}, vector binary")
    return plain.groupBy("vec_id").agg(F.min("vector").alias("vector"))


def _started(nodes: DataFrame, count: int, neighbours: int, seed: int = 0) -> DataFrame:
    """First lists: the best among nodes that sort near each other by signs of projections.

    No list holds a node of the same ``kin``, here and in :func:`_introduced`.
    """
    bits = int(np.clip(np.ceil(np.log2(max(count, 2) / 16)), 3, 30))

    def keys(rows: dict[str, list]) -> dict[str, list]:
        found = np.zeros((len(rows["node"]), TABLES), np.int64)
        for members in _by_length(rows["vector"]):
            unit = _matrix([rows["vector"][i] for i in members])
            for table in range(TABLES):
                random = np.random.default_rng([seed, 1_000 * table + unit.shape[1]] if seed else 1_000 * table + unit.shape[1])
                signs = unit @ random.normal(size=(unit.shape[1], bits)) > 0
                found[members, table] = signs @ (1 << np.arange(bits - 1, -1, -1))
        return {**rows, "keys": found.tolist()}

    kind = nodes.schema["node"].dataType.simpleString()
    keyed = by_batches(
        nodes.select("node", "kin", "vector"), keys, f"node {kind}, kin {kind}, vector binary, keys array<bigint>"
    )
    spread = keyed.select("node", "kin", "vector", F.posexplode("keys").alias("table", "key"))
    # the vector breaks ties, so that a key of very many nodes is spread as well
    ordered = spread.repartitionByRange("table", "key", "vector").sortWithinPartitions("table", "key", "vector")

    def near(rows: dict[str, list]) -> dict[str, list]:
        found = _Pairs()
        for begin in range(0, max(1, len(rows["node"]) - CHUNK // 2), CHUNK // 2):
            chunk = slice(begin, begin + CHUNK)
            nodes_, kin, raw = np.array(rows["node"][chunk]), np.array(rows["kin"][chunk]), rows["vector"][chunk]
            for members in _by_length(raw):
                unit = _matrix([raw[i] for i in members])
                found.best(nodes_[members], kin[members], unit @ unit.T, neighbours)
        return found.rows()

    pairs = by_batches(ordered.select("node", "kin", "vector"), near, f"node {kind}, other {kind}, similarity double")
    return _shortened(pairs.withColumn("fresh", F.lit(True)), neighbours)


class _Pairs:
    """Directed pairs found in a batch."""

    def __init__(self) -> None:
        self.node, self.other, self.similarity = [], [], []

    def best(
        self, nodes: np.ndarray, kin: np.ndarray, similar: np.ndarray, most: int, least: np.ndarray | float = -2.0
    ) -> None:
        """For each node the best ``most`` of those not of its ``kin`` that lie above its ``least``."""
        count = len(nodes)
        if count < 2:
            return
        similar = np.where(kin[:, None] == kin[None, :], -2.0, similar)
        take = min(most, count - 1)
        at = np.argpartition(-similar, take - 1, axis=1)[:, :take]
        values = np.take_along_axis(similar, at, 1)
        keep = values > np.broadcast_to(np.asarray(least).reshape(-1, 1), values.shape)
        row, column = np.nonzero(keep)
        self.node.append(nodes[row])
        self.other.append(nodes[at[row, column]])
        self.similarity.append(values[row, column])

    def rows(self) -> dict[str, np.ndarray]:
        columns = {"node": self.node, "other": self.other, "similarity": self.similarity}
        return {k: np.concatenate(v) if v else np.empty(0) for k, v in columns.items()}


def _shortened(pairs: DataFrame, neighbours: int) -> DataFrame:
    """The best entries of each list; an entry known before stays known.

    Entries are cut per (node, part) first, so a node that very many propose gathers few.
    """
    entry = F.struct((-F.col("similarity")).alias("far"), "other", "fresh")
    single = pairs.groupBy("node", "other").agg(F.max("similarity").alias("similarity"), F.min("fresh").alias("fresh"))
    part = F.pmod(F.xxhash64("other"), F.lit(8))
    cut = single.groupBy("node", part.alias("part")).agg(F.slice(F.array_sort(F.collect_list(entry)), 1, neighbours).alias("some"))
    whole = cut.groupBy("node").agg(F.slice(F.array_sort(F.flatten(F.collect_list("some"))), 1, neighbours).alias("entries"))
    entries = whole.select("node", F.explode("entries").alias("e"))
    return entries.select("node", "e.other", (-F.col("e.far")).alias("similarity"), "e.fresh")


def _introduced(lists: DataFrame, nodes: DataFrame, neighbours: int, beside: DataFrame | None = None) -> DataFrame:
    """Pairs among the neighbours of each node, in either direction, that improve a list.

    Entries of ``beside`` are neighbours as well, of lists that stay as they are.
    """
    last = lists.groupBy("node").agg(F.count("*").alias("n"), F.min("similarity").alias("least"))
    least = F.when(F.col("n") < neighbours, -2.0).otherwise(F.col("least"))
    known = nodes.join(last, "node", "left").select(
        F.col("node").alias("guest"), "kin", "vector", F.coalesce(least, F.lit(-2.0)).alias("least")
    )
    met = lists.select("node", "other", "fresh")
    if beside is not None:
        met = met.unionByName(beside.select("node", "other", F.lit(False).alias("fresh")))
    forward = met.select(F.col("node").alias("host"), F.col("other").alias("guest"), "fresh")
    back = met.select(F.col("other").alias("host"), F.col("node").alias("guest"), "fresh")
    blocks = back.groupBy("host").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    # reverse neighbours are dealt out; the few forward ones go to every block
    dealt = back.join(blocks, "host").withColumn("block", F.pmod(F.xxhash64("guest"), F.col("blocks")).cast("int"))
    everywhere = forward.join(blocks, "host", "left").withColumn(
        "block", F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1))
    )
    meetings = (
        dealt.select("host", "block", "guest", "fresh")
        .unionByName(everywhere.select("host", "block", "guest", "fresh"))
        .groupBy("host", "block", "guest")
        .agg(F.max("fresh").alias("fresh"))
    )
    guests = meetings.join(known, "guest")
    together = guests.groupBy("host", "block").agg(
        F.max("fresh").alias("fresh"), F.collect_list(F.struct("guest", "kin", "vector", "least", "fresh")).alias("guests")
    )
    kind = nodes.schema["node"].dataType.simpleString()

    def run(rows: dict[str, list]) -> dict[str, list]:
        found = _Pairs()
        for guests in rows["guests"]:
            names = np.array([g["guest"] for g in guests])
            unit = _matrix([g["vector"] for g in guests])
            kin = np.array([g["kin"] for g in guests])
            fresh = np.array([g["fresh"] for g in guests])
            similar = np.where(fresh[:, None] | fresh[None, :], unit @ unit.T, -2.0)
            found.best(names, kin, similar, neighbours, np.array([g["least"] for g in guests]))
        return found.rows()

    return by_batches(
        together.filter("fresh").select("guests"), run, f"node {kind}, other {kind}, similarity double"
    )


def _audit(nodes: DataFrame, threshold: float, count: int) -> DataFrame:
    """Links of some nodes by brute force, ``node`` and ``other``: of more and more nodes, until there are enough."""
    kind = nodes.schema["node"].dataType.simpleString()
    wanted, begin, end = None, 0, AUDITED
    while True:
        rows = nodes.orderBy(F.xxhash64("node"), "node").limit(end).collect()[begin:]
        shared = nodes.sparkSession.sparkContext.broadcast([(r["node"], bytes(r["vector"])) for r in rows])

        def run(rows: dict[str, list], shared=shared) -> dict[str, list]:
            found = {"node": [], "other": []}
            for members in _by_length(rows["vector"]):
                raw = [rows["vector"][i] for i in members]
                asked = [(n, v) for n, v in shared.value if len(v) == len(raw[0])]
                if not asked:
                    continue
                similar = _matrix([v for _, v in asked]) @ _matrix(raw).T
                for i, j in zip(*np.nonzero(similar >= threshold), strict=True):
                    node, other = asked[i][0], rows["node"][members[j]]
                    if node != other:
                        found["node"].append(node)
                        found["other"].append(other)
            return found

        some = landed(by_batches(nodes.select("node", "vector"), run, f"node {kind}, other {kind}"), "audit")
        wanted = some if wanted is None else wanted.unionByName(some)
        if end >= min(count, AUDITED_MOST) or wanted.count() >= AUDITED_LINKS:
            return wanted
        begin, end = end, 4 * end


def _descended(lists: DataFrame, nodes: DataFrame, neighbours: int, beside: DataFrame | None = None) -> DataFrame:
    """The lists after rounds of introductions: the last round changed almost none of all lists."""
    count = nodes.count()
    while True:
        found = _introduced(lists, nodes, neighbours, beside).withColumn("fresh", F.lit(True))
        old = lists.withColumn("fresh", F.lit(False))
        lists = landed(_shortened(old.unionByName(found), neighbours), "lists")
        if lists.filter("fresh").select("node").distinct().count() <= STILL * count:
            return lists


def _near(lists: DataFrame, threshold: float) -> DataFrame:
    return lists.filter(F.col("similarity") >= threshold - _SLACK)


def _pairs_of(near: DataFrame) -> DataFrame:
    return near.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct()


def _joined(
    lists: DataFrame, nodes: DataFrame, threshold: float, neighbours: int
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Links that were listed, components over all links, and those ``in_full``: of components with a saturated list."""
    near = _near(lists, threshold)
    links = landed(_exact(_pairs_of(near), nodes, threshold), "links")
    full = landed(near.groupBy("node").agg(F.count("*").alias("n")).filter(F.col("n") >= neighbours), "saturated")
    seed = 0
    while True:
        labels = landed(components(links), "components")
        crowd = labels.join(full, "node", "left_semi")
        in_full = labels.join(crowd.select("component").distinct(), "component", "left_semi")
        if crowd.select("component").distinct().limit(2).count() < 2:
            return links, labels, in_full
        seed += 1
        kin = landed(nodes.join(crowd.withColumnRenamed("component", "kin"), "node").select("node", "kin", "vector"), "kin")
        first = landed(_started(kin, kin.count(), neighbours, seed), "outward")
        outward = _descended(first, kin, neighbours, lists)
        across = landed(_exact(_pairs_of(_near(outward, threshold)), nodes, threshold), "across")
        if across.isEmpty():
            return links, labels, in_full
        links = landed(links.unionByName(across), "links")


def _known_share(wanted: DataFrame, links: DataFrame, in_full: DataFrame) -> float | None:
    """The share of audited links that are listed or lie in a component compared in full; None without any."""
    total = wanted.count()
    if not total:
        return None
    listed = links.select(F.col("a").alias("node"), F.col("b").alias("other"))
    listed = listed.unionByName(links.select(F.col("b").alias("node"), F.col("a").alias("other")))
    first = in_full.select("node", F.col("component").alias("one"))
    second = in_full.select(F.col("node").alias("other"), F.col("component").alias("two"))
    together = wanted.join(first, "node").join(second, "other").filter("one = two").select("node", "other")
    by_list = wanted.join(listed, ["node", "other"], "left_semi")
    return together.unionByName(by_list).distinct().count() / total


def _searched(nodes: DataFrame, threshold: float, neighbours: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """As :func:`_joined`, over lists that hardly change any more and whose links an audit confirms.

    Where the audit misses links, further projections are sorted by, and the search goes on from there.
    """
    own = nodes.select("node", F.col("node").alias("kin"), "vector")
    count = nodes.count()
    lists = _descended(landed(_started(own, count, neighbours), "lists"), own, neighbours)
    wanted = _audit(nodes, threshold, count)
    enough = wanted.count() >= AUDITED_LINKS or count <= AUDITED_MOST
    seed = 0
    while True:
        found = _joined(lists, nodes, threshold, neighbours)
        recall = _known_share(wanted, found[0], found[2])
        if not enough:
            _LOG.warning("recall not measured: %d vectors have fewer than %d links", AUDITED_MOST, AUDITED_LINKS)
        if recall is None or recall >= RECALL:
            return found
        seed += 1
        if seed > RESTARTS:
            raise RuntimeError(f"audited recall is {recall:.3f}: sort by more projections or allow longer lists")
        again = _started(own, count, neighbours, 1_000 + seed)
        lists = landed(_shortened(lists.withColumn("fresh", F.lit(False)).unionByName(again), neighbours), "lists")
        lists = _descended(lists, own, neighbours)


def linked(
    embeddings: DataFrame,
    threshold: float = THRESHOLD,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
) -> DataFrame:
    """``vec_id``, ``n_links`` (vectors linked directly), ``component_id`` (smallest id reachable), ``kept``."""
    vectors = landed(usable(embeddings, id_column, vector_column), "vectors")
    classes = vectors.groupBy("vector").agg(F.min("vec_id").alias("node"), F.count("*").alias("copies"))
    nodes = landed(classes, "nodes")
    members = vectors.join(nodes, "vector").select("vec_id", "node", "copies")
    links, labels, in_full = _searched(nodes, threshold, NEIGHBOURS)
    counted = _counted_in_tiles(in_full.join(nodes, "node"), threshold)
    open_links = links.join(in_full.select(F.col("node").alias("a")), "a", "left_anti")
    both = open_links.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(
        open_links.select(F.col("b").alias("node"), F.col("a").alias("other"))
    )
    sizes = nodes.select(F.col("node").alias("other"), "copies")
    plain = both.join(sizes, "other").groupBy("node").agg(F.sum("copies").alias("others"))
    others = counted.unionByName(plain)
    known = members.join(labels, "node", "left").join(others, "node", "left")
    ids = embeddings.select(F.col(f"`{id_column}`").alias("vec_id")).filter("vec_id is not null").distinct()
    result = ids.join(known, "vec_id", "left")
    component = F.coalesce("component", "node", "vec_id")
    return result.select(
        "vec_id",
        (F.coalesce(F.col("copies") - 1, F.lit(0)) + F.coalesce("others", F.lit(0))).cast("bigint").alias("n_links"),
        component.alias("component_id"),
        (component == F.col("vec_id")).alias("kept"),
    )


def _exact(pairs: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """The pairs that reach the threshold in double precision."""
    first = nodes.select(F.col("node").alias("a"), F.col("vector").alias("first"))
    second = nodes.select(F.col("node").alias("b"), F.col("vector").alias("second"))
    joined = pairs.join(first, "a").join(second, "b").select("a", "b", "first", "second")
    kind = pairs.schema["a"].dataType.simpleString()

    def run(rows: dict[str, list]) -> dict[str, list]:
        keep = np.zeros(len(rows["a"]), bool)
        for some in _by_length(rows["first"]):
            one = _matrix([rows["first"][i] for i in some])
            two = _matrix([rows["second"][i] for i in some])
            keep[some] = (one * two).sum(1) >= threshold
        at = np.flatnonzero(keep)
        return {"a": [rows["a"][i] for i in at], "b": [rows["b"][i] for i in at]}

    return by_batches(joined, run, f"a {kind}, b {kind}")


def _counted_in_tiles(members: DataFrame, threshold: float) -> DataFrame:
    """``node`` and ``others``: vectors of its component it links with, summed over pairs of tiles."""
    sizes = members.groupBy("component").agg(F.ceil(F.count("*") / TILE).cast("int").alias("tiles"))
    tiled = landed(
        members.join(sizes, "component").withColumn("tile", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int")),
        "tiles",
    )
    entry = F.struct("node", "vector", "copies")
    whole = tiled.groupBy("component", "tile", "tiles").agg(F.collect_list(entry).alias("members"))
    left = whole.withColumn("other_tile", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    right = whole.select("component", F.col("tile").alias("other_tile"), F.col("members").alias("others"))
    meeting = left.join(right, ["component", "other_tile"]).select("members", "others")
    kind = members.schema["node"].dataType.simpleString()

    def run(rows: dict[str, list]) -> dict[str, list]:
        nodes, counts = [], []
        for own, others in zip(rows["members"], rows["others"], strict=True):
            similar = _matrix([m["vector"] for m in own]) @ _matrix([m["vector"] for m in others]).T
            names, other_names = np.array([m["node"] for m in own]), np.array([m["node"] for m in others])
            hit = (similar >= threshold) & (names[:, None] != other_names[None, :])
            counts += (hit @ np.array([m["copies"] for m in others], np.int64)).tolist()
            nodes += names.tolist()
        return {"node": nodes, "others": counts}

    found = by_batches(meeting, run, f"node {kind}, others bigint")
    return found.groupBy("node").agg(F.sum("others").alias("others"))
