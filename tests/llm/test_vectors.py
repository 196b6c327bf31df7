"""Nearest vectors and hard negatives against brute force."""

from __future__ import annotations

import numpy as np
import pytest
from compare import assert_same
from pyspark.sql import functions as F

from stocklens.llm import queries, segment_filter, stable_projections

EVERY = "vec_id % 5 = 0"


def frame(spark, vectors, kind="double"):
    return spark.createDataFrame(list(vectors.items()), f"vec_id bigint, embedding array<{kind}>")


def sound(vectors):
    good = {i: np.array(v, float) for i, v in vectors.items() if v and None not in v}
    return {i: v for i, v in good.items() if np.isfinite(v).all() and v.any()}


def brute_nearest(vectors, most):
    rows = sound(vectors)
    wanted = {}
    for q in rows:
        if q % 5 == 0:
            others = [(-float((rows[q] * v).sum()), i) for i, v in rows.items() if i != q and len(v) == len(rows[q])]
            wanted[q] = [(i, -far) for far, i in sorted(others)[:most]]
    return wanted


def found_nearest(df):
    lists = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        lists.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(lists[r["query_id"]])
    return lists


def recall(got, wanted):
    total = sum(map(len, wanted.values()))
    return sum(len({i for i, _ in got.get(q, [])} & {i for i, _ in w}) for q, w in wanted.items()) / total


def test_chi_square_law():
    draws = (np.random.default_rng(1).normal(size=(200_000, 8)) ** 2).sum(1)
    for share in (0.1, 0.5, 0.9, 0.98):
        reached = stable_projections.reach(share, 8)
        assert abs(stable_projections.chi_square(reached, 8) - share) < 1e-9
        assert abs((draws <= reached).mean() - share) < 0.005


def test_cells_cover_the_space():
    points = np.random.default_rng(2).normal(size=(3_000, 4))
    cells = stable_projections.Cells(points, 20)
    others = np.random.default_rng(3).normal(size=(2_000, 4)) * 3
    at = cells.of(others)
    assert len(cells.low) == 20
    assert (stable_projections.gaps(others, cells.low, cells.high)[np.arange(2_000), at] == 0).all()
    assert np.bincount(cells.of(points)).max() < 2 * 3_000 / 20
    assert len(stable_projections.Cells(np.ones((500, 4)), 20).low) == 1


def test_nearest_of_whole_table(spark, data):
    df = spark.read.parquet(f"{data}/embeddings.parquet")
    rows = {r["vec_id"]: np.array(r["embedding"], float) for r in df.collect()}
    got = found_nearest(queries.nearest_vectors(spark, data))
    wanted = {
        q: [i for _, i in sorted((-float((rows[q] * v).sum()), i) for i, v in rows.items() if i != q)[:20]]
        for q in rows
        if q % 20 == 0
    }
    assert got.keys() == wanted.keys()
    assert recall(got, {q: [(i, 0) for i in w] for q, w in wanted.items()}) >= 0.97
    for q, best in got.items():
        assert [s for _, s in best] == sorted((s for _, s in best), reverse=True)
        assert all(s == pytest.approx(float(rows[q] @ rows[i]), abs=1e-12) for i, s in best)


@pytest.mark.parametrize("spread", [0.0, 1.5])
def test_many_blocks_of_vectors_of_any_length(spark, monkeypatch, spread):
    """Clusters, norms that differ much, and rounds over many small blocks; the test stops searches early."""
    monkeypatch.setattr(stable_projections, "BLOCK", 40)
    monkeypatch.setattr(stable_projections, "LEAF", 8)
    monkeypatch.setattr(stable_projections, "TOGETHER", 16)
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(25, 24)) * 3
    rows = centres[rng.integers(0, 25, 1_500)] + rng.normal(size=(1_500, 24))
    rows *= np.exp(rng.normal(size=(1_500, 1)) * spread)
    vectors = {i: v.tolist() for i, v in enumerate(rows)}
    got = found_nearest(stable_projections.nearest(frame(spark, vectors), EVERY, 10))
    wanted = brute_nearest(vectors, 10)
    assert got.keys() == wanted.keys() and all(len(v) == 10 for v in got.values())
    assert recall(got, wanted) >= 0.97


def test_search_stops_before_all_is_verified(spark, monkeypatch):
    monkeypatch.setattr(stable_projections, "BLOCK", 40)
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(40, 16)) * 10
    rows = np.repeat(centres, 40, axis=0) + rng.normal(size=(1_600, 16)) * 0.1
    visits = []
    whole = stable_projections._visits

    def counted(*args):
        found = whole(*args)
        visits.append(found.count())
        return found

    monkeypatch.setattr(stable_projections, "_visits", counted)
    vectors = {i: v.tolist() for i, v in enumerate(rows / np.linalg.norm(rows, axis=1, keepdims=True))}
    got = found_nearest(stable_projections.nearest(frame(spark, vectors), EVERY, 10))
    assert recall(got, brute_nearest(vectors, 10)) >= 0.97
    assert sum(visits) < 320 * 40 / 4  # a quarter of all (query, block) meetings


def test_ties_copies_and_odd_vectors(spark, monkeypatch):
    monkeypatch.setattr(stable_projections, "BLOCK", 40)
    rng = np.random.default_rng(8)
    one = rng.normal(size=12).tolist()
    vectors = {i: one for i in range(0, 300)} | {i: rng.normal(size=12).tolist() for i in range(300, 400)}
    vectors |= {500: None, 505: [0.0] * 12, 510: [float("nan")] * 12, 515: [float("inf")] + [1.0] * 11, 520: []}
    vectors |= {525: [1.0, None], 530: [1.0, 2.0, 3.0], 535: [2.0, 4.0, 6.0], 540: [-0.0] * 12}
    got = found_nearest(stable_projections.nearest(frame(spark, vectors), EVERY, 7))
    wanted = brute_nearest(vectors, 7)
    assert {q: [i for i, _ in best] for q, best in got.items()} == {q: [i for i, _ in best] for q, best in wanted.items()}
    assert [i for i, _ in got[0]] == [1, 2, 3, 4, 5, 6, 7]  # equal vectors, smallest ids
    assert [i for i, _ in got[530]] == [535]


def test_repeated_ids_clashing_columns_and_empty_tables(spark):
    rows = [(5, [1.0, 0.0], 1, "a"), (5, [1.0, 0.0], 2, "b"), (6, [0.5, 0.5], 1, "c"), (None, [1.0, 1.0], 1, "d")]
    schema = "vec_id bigint, embedding array<float>, cell int, best string"
    df = spark.createDataFrame(rows, schema)
    assert [tuple(r) for r in stable_projections.nearest(df, EVERY).collect()] == [(5, 1, 6, 0.5)]
    assert stable_projections.nearest(df.limit(0), EVERY).count() == 0
    assert stable_projections.nearest(df, F.col("vec_id") > 99).count() == 0


def brute_negatives(rows, anchors, positives=5, negatives=5):
    """``rows``: id to (label, whole numbers)."""
    wanted = set()
    for a in anchors:
        scored = sorted(
            (-sum(int(x) * int(y) for x, y in zip(rows[a][1], v, strict=True)), i)
            for i, (_, v) in rows.items()
            if i != a and len(v) == len(rows[a][1])
        )
        for far, p in [s for s in scored if rows[s[1]][0] == rows[a][0]][:positives]:
            near = [s for s in scored if rows[s[1]][0] != rows[a][0] and -80 * far <= -100 * s[0] <= -100 * far]
            wanted |= {(a, p, k, n, -far, -score) for k, (score, n) in enumerate(near[:negatives], 1)}
    return wanted


def check_negatives(spark, rows, **more):
    data = [(i, label, [float(x) for x in v]) for i, (label, v) in rows.items()]
    df = spark.createDataFrame(data, "vec_id bigint, label int, vector array<double>")
    found = segment_filter.hard_negatives(df, EVERY, **more)
    names = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    got = [tuple(r[n] for n in names) for r in found.collect()]
    assert len(got) == len(set(got))
    wanted = brute_negatives(rows, [i for i in rows if i % 5 == 0], **more)
    assert set(got) == wanted
    return len(wanted)


def test_hard_negatives_query_equals_its_statement(spark, duck, data):
    assert assert_same(queries.hard_negatives(spark, data), duck, queries.statements()["op12_hard_negatives"])


@pytest.mark.parametrize("width", [1, 2, 3, 7, 40])
def test_hard_negatives_over_many_blocks(spark, monkeypatch, width):
    monkeypatch.setattr(segment_filter, "BLOCK", 64)
    monkeypatch.setattr(segment_filter, "PART", 16)
    rng = np.random.default_rng(width)
    centres = rng.integers(-80, 80, size=(6, width))
    rows = {}
    for i in range(420):
        label = int(rng.choice([0, 0, 0, 1, 2, 3]))  # one label holds half of all rows
        rows[i] = (label, (centres[label] // 2 + rng.integers(-60, 60, size=width)).tolist())
    assert check_negatives(spark, rows)


def test_hard_negatives_land_narrow_rows(spark, monkeypatch):
    """No landed value grows with the rows of a block, which a reader would hold thousands of at once."""
    steps = []

    def landed(df, purpose):
        steps.append(kept(df, purpose))
        return steps[-1]

    kept = segment_filter.landed
    monkeypatch.setattr(segment_filter, "landed", landed)
    rng = np.random.default_rng(5)
    rows = [(i, i % 3, rng.integers(-50, 50, size=8).tolist()) for i in range(700)]
    df = spark.createDataFrame(rows, "vec_id bigint, label int, vector array<int>")
    assert segment_filter.hard_negatives(df, "vec_id % 100 = 0").count()
    for step in steps:
        binary = [F.max(F.octet_length(f.name)) for f in step.schema if f.dataType.typeName() == "binary"]
        assert not binary or max(x or 0 for x in step.agg(*binary).first()) <= 8 * 8


def test_hard_negatives_over_waves_and_batches(spark, monkeypatch):
    monkeypatch.setattr(segment_filter, "WAVE", 20)
    batch = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(batch)
    spark.conf.set(batch, "9")
    rng = np.random.default_rng(2)
    rows = {i: (int(rng.integers(0, 3)), rng.integers(-9, 30, size=2 + i % 2).tolist()) for i in range(300)}
    data = [(i, label, [float(x) for x in v]) for i, (label, v) in rows.items()]
    df = spark.createDataFrame(data, "vec_id bigint, label int, vector array<double>").coalesce(2)
    try:
        got = {tuple(r) for r in segment_filter.hard_negatives(df, EVERY).select("anchor_id", "positive_id", "rank", "negative_id").collect()}
    finally:
        spark.conf.set(batch, before)
    wanted = {w[:4] for w in brute_negatives(rows, [i for i in rows if i % 5 == 0])}
    assert wanted and got == wanted


def test_bounds_hold_and_rule_out(monkeypatch):
    rng = np.random.default_rng(3)
    steps = np.repeat(rng.integers(-200, 200, size=(300, 4)), 16, axis=1) + rng.integers(-3, 4, size=(300, 64))
    rows = segment_filter.Side.of(steps.astype(float))
    anchors = rows.only(slice(0, 20))
    scores = steps[:20] @ steps.T
    for a, x in zip(anchors.levels, rows.levels, strict=True):
        n = a.shape[1] // 2
        middle, spread = a[:, :n] @ x[:, :n].T, a[:, n:] @ x[:, n:].T
        assert (np.abs(scores - middle) <= spread + 1e-6).all()
    low = np.sort(scores, axis=1)[:, -10].astype(float)
    i, j, found = segment_filter.within(anchors, rows, np.ones(scores.shape, bool), low, np.full(20, np.inf))
    assert (found == scores[i, j]).all()
    assert {*zip(i.tolist(), j.tolist(), strict=True)} >= {*zip(*(x.tolist() for x in np.nonzero(scores >= low[:, None])), strict=True)}
    assert len(i) < 0.1 * scores.size  # the rest was ruled out without a full score


def test_ties_and_windows(spark):
    copies = {i: (0, [10, 0]) for i in range(30)}  # all tie, also with the anchors
    others = {i: (1, [8 + i % 4, i % 2]) for i in range(100, 160)}
    below = {i: (2, [-5, 3]) for i in range(200, 210)}
    assert check_negatives(spark, {**copies, **others, **below})
    # negative and zero positives
    assert check_negatives(spark, {0: (0, [1, 0]), 1: (0, [0, 5]), 2: (0, [-3, 0]), 3: (1, [0, 9]), 4: (1, [-3, 1])}) == 1


def test_large_whole_numbers(spark):
    big = 1 << 29
    rows = {i: (i % 2, [big + i, big - 3 * i, 7 * i]) for i in range(30)}
    assert check_negatives(spark, rows)
    with pytest.raises(Exception, match="64 bits"):
        check_negatives(spark, {i: (i % 2, [1 << 40]) for i in range(10)})


def test_hard_negatives_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, 1, [4.0, 0.0], "x"),
        (0, 1, [4.0, 0.0], "y"),
        (1, 1, [3.0, 1.0], "x"),
        (2, 2, [3.0, 0.0], "x"),
        (3, None, [3.0, 0.0], "x"),
        (4, 2, None, "x"),
        (6, 2, [3.0, None], "x"),
        (7, 2, [nan, 1.0], "x"),
        (8, 2, [inf, 1.0], "x"),
        (9, 2, [3.0], "x"),
        (11, 2, [], "x"),
        (None, 2, [3.0, 0.0], "x"),
    ]
    df = spark.createDataFrame(rows, "vec_id bigint, label int, vector array<double>, slot string")
    got = [tuple(r) for r in segment_filter.hard_negatives(df, EVERY).collect()]
    assert got == [(0, 1, 1, 2, 12, 12)]
    assert segment_filter.hard_negatives(df.limit(0), EVERY).count() == 0
