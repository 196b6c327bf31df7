"""Nearest rows by inner product: low-dimensional stable projections in kd-trees, searched outward.

Of rows of one length, each gets one more component, so that all are as long as the longest, and a query is
scaled to that length with 0 there.  Then the largest inner product is the smallest distance.  Rows and queries
are projected onto a few random normal directions.  The square of a projected distance, over the square
of the true one, follows a chi-square law.  So once the next projected neighbour is so far away that a row as near as
the last one kept would, with the wanted confidence, have come before, a search may stop.

A kd-tree over the projections, cut at the quantiles of a bounded sample, splits the space into cells.  Every row
is indexed: it lies in the block of its cell, cells of many rows (copies, say) have several
blocks, and each block holds a kd-tree of its own.  A query visits blocks outward from its own projection, in
rounds that widen; in a block it visits leaves outward.  Rows of a visited leaf are verified by their
original vectors in double precision.  The stopping test is applied to every cell and every leaf.

An audit compares a bounded number of queries with all rows by brute force; where too few of their
neighbours were found, the search is repeated with a higher confidence.

Vectors that are missing, zero, or hold missing or non-finite components take no part, and vectors of different
lengths do not meet.  A repeated id counts once, with its first vector by value.  Ties go to the smaller id:
equal vectors get equal scores, as scores are sums in one fixed order.  An empty table or query set gives an
empty result; other columns are not read.
"""

from __future__ import annotations

import logging
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stocklens.llm.nn_descent import usable
from stocklens.llm.packed import matrix, merged, ranked
from stocklens.llm.tasks import by_batches
from stocklens.session import landed

_LOG = logging.getLogger(__name__)

NEAREST = 20
#: Projected dimensions (an even number), and how sure a stop has to be that no nearer row is left.
DIMENSIONS, CONFIDENCE = 8, 0.98
#: Rows the cells are cut by, rows of a block and of a leaf, queries that visit a block together, and how many
#: times more blocks each round visits than the one before.
SAMPLE, BLOCK, LEAF, TOGETHER, WIDER = 32_768, 1_024, 64, 1_024, 4
#: Queries of the audit, the share of their neighbours to be found, and how often a search is repeated.
AUDITED, RECALL, REPEATS = 64, 0.95, 3
_SEED = 11
_ENTRY = "array<struct<far:double,vec_id:bigint>>"


def chi_square(x: float, dimensions: int) -> float:
    """The chi-square law's probability of at most ``x``, for an even number of dimensions."""
    half, term, total = x / 2, 1.0, 1.0
    for k in range(1, dimensions // 2):
        term *= half / k
        total += term
    return 1 - math.exp(-half) * total


def reach(confidence: float, dimensions: int) -> float:
    """How large a projected distance's square is, over the true one's, with this confidence at most."""
    low, high = 0.0, 1.0
    while chi_square(high, dimensions) < confidence:
        high *= 2
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if chi_square(middle, dimensions) < confidence else (low, middle)
    return high


def directions(width: int, dimensions: int = DIMENSIONS) -> np.ndarray:
    """Random normal directions for vectors of ``width`` components and the one added."""
    return np.random.default_rng([_SEED, width]).normal(size=(width + 1, dimensions))


def projected(rows: np.ndarray, longest: float) -> np.ndarray:
    """Projections of rows, lengthened to ``longest`` by their added component."""
    added = np.sqrt(np.maximum(longest * longest - (rows * rows).sum(1), 0))
    return np.hstack([rows, added[:, None]]) @ directions(rows.shape[1])


def projected_queries(queries: np.ndarray, longest: float) -> np.ndarray:
    scaled = queries * (longest / np.linalg.norm(queries, axis=1, keepdims=True))
    return scaled @ directions(queries.shape[1])[:-1]


def scored(queries: np.ndarray, i: np.ndarray, rows: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Inner products of pairs, each summed in the same order wherever it stands."""
    parts = [(queries[i[c : c + 4096]] * rows[j[c : c + 4096]]).sum(1) for c in range(0, len(i), 4096)]
    return np.concatenate(parts) if parts else np.empty(0)


class Cells:
    """A kd-tree's cells: half-open boxes that cover the whole space."""

    def __init__(self, points: np.ndarray, most: int) -> None:
        dimensions = points.shape[1]
        #: Per inner node its axis, threshold and children; a child below 0 is the cell ``-1 - child``.
        self.nodes: list[list] = []
        low, high = [], []

        def grow(members: np.ndarray, count: int, box: tuple[np.ndarray, np.ndarray]) -> int:
            own = points[members]
            axis = int(np.argmax(np.ptp(own, axis=0))) if count > 1 else 0
            share = count // 2 / count
            order = np.sort(own[:, axis]) if count > 1 else None
            at = order[int(len(order) * share)] if count > 1 else None
            right = own[:, axis] >= at if count > 1 else None
            if count < 2 or right.all() or not right.any():
                low.append(box[0])
                high.append(box[1])
                return -len(low)
            place = len(self.nodes)
            self.nodes.append([axis, at, 0, 0])
            below, above = (box[0].copy(), box[1].copy()), (box[0].copy(), box[1].copy())
            below[1][axis] = above[0][axis] = at
            self.nodes[place][2] = grow(members[~right], count // 2, below)
            self.nodes[place][3] = grow(members[right], count - count // 2, above)
            return place

        everywhere = np.full(dimensions, -np.inf), np.full(dimensions, np.inf)
        grow(np.arange(len(points)), max(1, most), everywhere)
        self.low, self.high = np.array(low), np.array(high)

    def of(self, points: np.ndarray) -> np.ndarray:
        """The cell of each point."""
        found = np.zeros(len(points), np.int64)
        open_ = [(0, np.arange(len(points)))] if self.nodes else []
        while open_:
            place, members = open_.pop()
            axis, at, *children = self.nodes[place]
            right = points[members, axis] >= at
            for child, some in zip(children, (members[~right], members[right]), strict=True):
                if child < 0:
                    found[some] = -1 - child
                elif len(some):
                    open_.append((child, some))
        return found


def gaps(points: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squares of the distances from points to boxes."""
    total = np.zeros((len(points), len(low)))
    for axis in range(points.shape[1]):
        at = points[:, axis, None]
        total += np.maximum(np.maximum(low[:, axis] - at, at - high[:, axis]), 0) ** 2
    return total


@dataclass
class Space:
    """What every task knows of the vectors of one length."""

    longest: float
    cells: Cells
    #: Blocks of each cell.
    blocks: np.ndarray


def stops(scores: np.ndarray, norms: np.ndarray, longest: float, reached: float) -> np.ndarray:
    """Squares of the projected distances at which queries stop, by the scores of their last neighbours."""
    far = 2 * longest * longest - 2 * longest * scores / norms
    return reached * (np.maximum(far, 0) + 1e-9 * longest * longest)


def _spaces(vectors: DataFrame) -> tuple[DataFrame, dict[int, Space]]:
    """Every vector with its cell and projection, and the spaces by length."""
    sizes = vectors.groupBy("width").agg(F.max("norm").alias("longest"), F.count("*").alias("n"))
    # one row for each length, of which there are no more than the longest vector has components
    lengths = {r["width"]: (r["longest"], r["n"]) for r in sizes.collect()}
    sample = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE)

    def project(rows: dict[str, list]) -> dict[str, list]:
        points = [b""] * len(rows["width"])
        for width, members in _by_width(rows):
            found = projected(matrix([rows["vector"][i] for i in members]), lengths[width][0])
            for i, p in zip(members, found, strict=True):
                points[i] = p.tobytes()
        return {"width": rows["width"], "point": points}

    points: dict[int, list[bytes]] = {width: [] for width in lengths}
    for row in by_batches(sample.select("width", "vector"), project, "width int, point binary").collect():
        points[row["width"]].append(bytes(row["point"]))
    trees = {}
    for width, (_, n) in lengths.items():
        some = matrix(points[width]) if points[width] else np.zeros((1, DIMENSIONS))
        trees[width] = Cells(some, min(-(-n // BLOCK), max(1, len(some) // 8)))

    def place(rows: dict[str, list]) -> dict[str, list]:
        cell, point = [0] * len(rows["vec_id"]), [b""] * len(rows["vec_id"])
        for width, members in _by_width(rows):
            found = projected(matrix([rows["vector"][i] for i in members]), lengths[width][0])
            for i, c, p in zip(members, trees[width].of(found).tolist(), found, strict=True):
                cell[i], point[i] = c, p.tobytes()
        return {**rows, "cell": cell, "point": point}

    schema = "vec_id bigint, width int, vector binary, cell int, point binary"
    placed = landed(by_batches(vectors.select("vec_id", "width", "vector"), place, schema), "placed")
    spaces = {
        width: Space(lengths[width][0], tree, np.zeros(len(tree.low), np.int64)) for width, tree in trees.items()
    }
    # one row for each cell, of which a sample has at most an eighth of its rows
    for row in placed.groupBy("width", "cell").count().collect():
        spaces[row["width"]].blocks[row["cell"]] = -(-row["count"] // BLOCK)
    return placed, spaces


def _by_width(rows: dict[str, list]) -> Iterator[tuple[int, np.ndarray]]:
    widths = np.array(rows["width"])
    for width in np.unique(widths):
        yield int(width), np.flatnonzero(widths == width)


def _indexed(placed: DataFrame, spaces: Broadcast) -> DataFrame:
    """Blocks: ids, vectors and points in the order of the leaves of their own kd-tree, and the leaves' boxes."""

    def deal(rows: dict[str, list]) -> dict[str, list]:
        parts = [int(spaces.value[w].blocks[c]) for w, c in zip(rows["width"], rows["cell"], strict=True)]
        return {**rows, "parts": parts}

    schema = "vec_id bigint, width int, vector binary, cell int, point binary, parts int"
    block = F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int").alias("block")
    gathered = by_batches(placed, deal, schema).groupBy("width", "cell", block)
    members = gathered.agg(F.collect_list(F.struct("vec_id", "vector", "point")).alias("members"))

    def build(rows: dict[str, list]) -> dict[str, list]:
        out = {name: [] for name in ("width", "cell", "block", "ids", "vectors", "sizes", "low", "high")}
        for at, members in enumerate(rows["members"]):
            points = matrix([m["point"] for m in members])
            leaves = Cells(points, -(-len(points) // LEAF)).of(points)
            ids = np.array([m["vec_id"] for m in members], np.int64)
            order = np.lexsort((ids, leaves))
            sizes = np.unique(leaves, return_counts=True)[1]
            cuts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            for name in ("width", "cell", "block"):
                out[name].append(rows[name][at])
            out["ids"].append(ids[order].astype("<i8").tobytes())
            out["vectors"].append(b"".join(members[i]["vector"] for i in order))
            out["sizes"].append(sizes.astype("<i8").tobytes())
            out["low"].append(np.minimum.reduceat(points[order], cuts).tobytes())
            out["high"].append(np.maximum.reduceat(points[order], cuts).tobytes())
        return out

    kind = "width int, cell int, block int, ids binary, vectors binary, sizes binary, low binary, high binary"
    return landed(by_batches(members, build, kind), "index")


def _visits(state: DataFrame, spaces: Broadcast, reached: float, span: tuple[int, int]) -> DataFrame:
    """Blocks that come next for each query, from ``span[0]`` to ``span[1]`` in order of nearness, up to its stop."""

    def run(rows: dict[str, list]) -> dict[str, list]:
        out = {name: [] for name in ("query_id", "width", "cell", "block", "vector", "last", "last_id")}
        for width, members in _by_width(rows):
            space = spaces.value[width]
            queries = matrix([rows["vector"][i] for i in members])
            away = gaps(projected_queries(queries, space.longest), space.cells.low, space.cells.high)
            last = np.array([-np.inf if rows["far"][i] is None else -rows["far"][i] for i in members])
            stop = stops(last, np.linalg.norm(queries, axis=1), space.longest, reached)
            for place, i in enumerate(members):
                order = np.argsort(away[place], kind="stable")
                ends = np.cumsum(space.blocks[order])
                near = order[: np.searchsorted(away[place][order], stop[place], side="right")]
                for cell, end in zip(near, ends, strict=False):
                    begin = end - space.blocks[cell]
                    for unit in range(max(begin, span[0]), min(end, span[1])):
                        values = (rows["query_id"][i], width, cell, unit - begin, rows["vector"][i], rows["far"][i], rows["far_id"][i])
                        for name, value in zip(out, values, strict=True):
                            out[name].append(value)
        return out

    schema = "query_id bigint, width int, cell int, block int, vector binary, last double, last_id bigint"
    known = F.when(F.size("best") >= F.lit(spaces.value["k"]), F.element_at("best", -1))
    asked = state.select("query_id", "width", "vector", known["far"].alias("far"), known["vec_id"].alias("far_id"))
    return by_batches(asked, run, schema)


def _searched(block: dict, members: list[dict], space: Space, width: int, most: int, reached: float) -> tuple:
    """What some queries find in a block: query places, row ids and scores."""
    ids, sizes = np.frombuffer(block["ids"], "<i8"), np.frombuffer(block["sizes"], "<i8")
    rows = np.frombuffer(block["vectors"], "<f8").reshape(len(ids), width)
    low, high = (np.frombuffer(block[n], "<f8").reshape(len(sizes), -1) for n in ("low", "high"))
    ends = np.cumsum(sizes)
    queries = matrix([m["vector"] for m in members])
    own = np.array([m["query_id"] for m in members])
    norms = np.linalg.norm(queries, axis=1)
    slack = 1e-12 * norms * space.longest
    last = np.array([-np.inf if m["last"] is None else -m["last"] for m in members])
    away = gaps(projected_queries(queries, space.longest), low, high)
    order = np.argsort(away, axis=1, kind="stable")
    who, what, score = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    for step in range(len(sizes)):
        leaf = order[:, step]
        near = away[np.arange(len(own)), leaf] <= stops(last, norms, space.longest, reached)
        if not near.any():
            break
        pairs = []
        for one in np.unique(leaf[near]):
            some, begin, end = np.flatnonzero(near & (leaf == one)), ends[one] - sizes[one], ends[one]
            close = queries[some] @ rows[begin:end].T >= (last - slack)[some][:, None]
            i, j = np.nonzero(close & (own[some][:, None] != ids[begin:end][None, :]))
            pairs.append((some[i], begin + j))
        i, j = (np.concatenate(x) for x in zip(*pairs, strict=True))
        if not len(i):
            continue
        who, what = np.concatenate([who, i]), np.concatenate([what, j])
        score = np.concatenate([score, scored(queries, i, rows, j)])
        kept = ranked(who, -score, ids[what], most)
        who, what, score = who[kept], what[kept], score[kept]
        counts = np.bincount(who, minlength=len(own))
        lists = np.flatnonzero(counts >= most)
        last[lists] = np.maximum(last[lists], score[np.cumsum(counts)[lists] - 1])
    # what a full list from other blocks already beats stays here
    better = np.array([m["last"] is None for m in members], bool)[who]
    known = np.array([-np.inf if m["last"] is None else -m["last"] for m in members])[who]
    known_id = np.array([-1 if m["last_id"] is None else m["last_id"] for m in members])[who]
    better |= (score > known) | ((score == known) & (ids[what] < known_id))
    return own[who[better]], ids[what[better]], score[better]


def _found(visits: DataFrame, index: DataFrame, spaces: Broadcast, most: int, reached: float) -> DataFrame:
    """``query_id``, ``vec_id`` and ``far`` of the best rows of every visited block."""
    keys = ["width", "cell", "block"]
    parts = visits.groupBy(*keys).agg(F.ceil(F.count("*") / TOGETHER).cast("int").alias("parts"))
    part = F.pmod(F.xxhash64("query_id"), F.col("parts")).alias("part")
    entry = F.struct("query_id", "vector", "last", "last_id")
    together = visits.join(parts, keys).groupBy(*keys, part).agg(F.collect_list(entry).alias("members"))
    units = together.join(index, keys)

    def run(rows: dict[str, list]) -> dict[str, list]:
        out = {"query_id": [], "vec_id": [], "far": []}
        for at, members in enumerate(rows["members"]):
            block, width = {n: rows[n][at] for n in ("ids", "vectors", "sizes", "low", "high")}, rows["width"][at]
            who, what, score = _searched(block, members, spaces.value[width], width, most, reached)
            out["query_id"] += who.tolist()
            out["vec_id"] += what.tolist()
            out["far"] += (-score).tolist()
        return out

    asked = units.select("width", "members", "ids", "vectors", "sizes", "low", "high")
    return by_batches(asked, run, "query_id bigint, vec_id bigint, far double")


def _search(queries: DataFrame, index: DataFrame, spaces: Broadcast, most: int, confidence: float) -> DataFrame:
    """Every query with its ``best`` rows after all rounds."""
    reached = reach(confidence, DIMENSIONS)
    units = max(int(s.blocks.sum()) for s in spaces.value.values() if isinstance(s, Space))
    state = queries.withColumn("best", F.array().cast(_ENTRY))
    begin, width = 0, 1
    while begin < units:
        visits = landed(_visits(state, spaces, reached, (begin, begin + width)), "visits")
        new = merged(_found(visits, index, spaces, most, reached), ["query_id"], most)
        both = F.concat("best", F.coalesce("_new", F.array().cast(_ENTRY)))
        joined = state.join(new.withColumnRenamed("best", "_new"), "query_id", "left")
        state = landed(joined.withColumn("best", F.slice(F.array_sort(both), 1, most)).drop("_new"), "best")
        begin, width = begin + width, width * WIDER
    return state


def _recall(state: DataFrame, vectors: DataFrame, most: int) -> float:
    """The share of the nearest rows of some queries, by brute force over all rows, that was found."""
    some = state.orderBy(F.xxhash64("query_id"), "query_id").limit(AUDITED).collect()
    asked = [(r["query_id"], bytes(r["vector"])) for r in some]
    found = {r["query_id"]: {e["vec_id"] for e in r["best"]} for r in some}

    def run(rows: dict[str, list]) -> dict[str, list]:
        out = {"query_id": [], "vec_id": [], "far": []}
        ids = np.array(rows["vec_id"], np.int64)
        for width, members in _by_width(rows):
            of_width = [(n, v) for n, v in asked if len(v) == 8 * width]
            if not of_width:
                continue
            queries, names = matrix([v for _, v in of_width]), np.array([n for n, _ in of_width])
            own = matrix([rows["vector"][m] for m in members])
            i, j = np.nonzero(names[:, None] != ids[members][None, :])
            score = scored(queries, i, own, j)
            kept = ranked(i, -score, ids[members][j], most)
            out["query_id"] += names[i[kept]].tolist()
            out["vec_id"] += ids[members][j[kept]].tolist()
            out["far"] += (-score[kept]).tolist()
        return out

    right = merged(by_batches(vectors, run, "query_id bigint, vec_id bigint, far double"), ["query_id"], most)
    wanted = [(r["query_id"], e["vec_id"]) for r in right.collect() for e in r["best"]]
    return sum(v in found[q] for q, v in wanted) / len(wanted) if wanted else 1.0


def nearest(
    embeddings: DataFrame,
    asked: Column | str,
    most: int = NEAREST,
    confidence: float = CONFIDENCE,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id`` and ``score``: the rows nearest to each query, itself apart.

    ``asked`` is a condition on ``vec_id`` (the ids, whole numbers) that chooses the queries.
    """

    def measured(rows: dict[str, list]) -> dict[str, list]:
        norms = [float(np.linalg.norm(np.frombuffer(v, "<f8"))) for v in rows["vector"]]
        return {**rows, "width": [len(v) // 8 for v in rows["vector"]], "norm": norms}

    sound = usable(embeddings, id_column, vector_column).withColumn("vec_id", F.col("vec_id").cast("bigint"))
    vectors = landed(by_batches(sound, measured, "vec_id bigint, vector binary, width int, norm double"), "vectors")
    placed, found = _spaces(vectors)
    queries = landed(placed.filter(asked).select(F.col("vec_id").alias("query_id"), "width", "vector"), "queries")
    if queries.isEmpty():
        state = queries.withColumn("best", F.array().cast(_ENTRY))
    else:
        spaces = embeddings.sparkSession.sparkContext.broadcast({**found, "k": most})
        index = _indexed(placed, spaces)
        for repeat in range(REPEATS + 1):
            state = _search(queries, index, spaces, most, 1 - (1 - confidence) / 8**repeat)
            recall = _recall(state, vectors.select("vec_id", "width", "vector"), most)
            _LOG.info("audited recall %.4f", recall)
            if recall >= RECALL:
                break
        else:
            raise RuntimeError(f"audited recall is {recall:.3f}: project to more dimensions")
    ranks = state.select("query_id", F.posexplode("best").alias("at", "e"))
    return ranks.select(
        "query_id",
        (F.col("at") + 1).cast("int").alias("rank"),
        F.col("e.vec_id").alias("vec_id"),
        (-F.col("e.far")).alias("score"),
    )
