"""Rates reach the target weights, equal a numpy version, and use no Python on the executors."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from stocklens.llm import mixing, queries


@pytest.fixture(scope="module")
def mixture(spark, data):
    docs = queries.table(spark, data, "documents")
    labelled = queries.domains_of_labelled(docs, queries.table(spark, data, "labels"))
    return docs, labelled


def shares(rows, model, rate):
    tokens = rows["n_tokens"].to_numpy()
    totals = np.array([(rate * tokens * rows[f"p{k}"]).sum() for k in range(len(model.domains))])
    return dict(zip(model.domains, totals / totals.sum(), strict=True))


def test_targets_are_met(mixture):
    docs, labelled = mixture
    rated, model = mixing.rated(docs, labelled, queries.MIX)
    rows = rated.toPandas()
    assert len(rows) == docs.count() and (rows["rate"] >= 0).all()
    found = shares(rows, model, rows["rate"].to_numpy())
    assert found == pytest.approx(queries.MIX, abs=0.01)
    assert rows["copies"].sum() == pytest.approx(rows["rate"].sum(), rel=0.1)


def test_posteriors_know_the_domain(mixture):
    docs, labelled = mixture
    rated, _ = mixing.rated(docs, labelled, queries.MIX)
    truth = docs.select("doc_id", "lang")
    right = rated.join(truth, "doc_id").select(F.avg((F.col("domain") == F.col("lang")).cast("int"))).first()[0]
    assert right > 0.9


def least_squares(p, tokens, wanted, floor, rounds=30_000):
    """Rates from the floor upwards nearest to the targets: accelerated projected gradients over every rate."""
    present = tokens @ p
    matrix = (tokens[:, None] * p / present).T  # domain x row, in units of a domain's tokens
    pace = 1 / np.linalg.norm(matrix, 2) ** 2
    rate = ahead = np.ones(len(tokens))
    turn = 1.0
    for _ in range(rounds):
        new = np.maximum(floor, ahead - pace * matrix.T @ (matrix @ ahead - wanted / present))
        following = (1 + (1 + 4 * turn * turn) ** 0.5) / 2
        ahead = new + (turn - 1) / following * (new - rate)
        rate, turn = new, following
    return np.linalg.norm(matrix @ rate - wanted / present)


@pytest.mark.parametrize(
    "overlap, shares, floor",
    [
        (0.05, (0.52, 0.3, 0.18), 0.0),
        (0.05, (0.36, 0.33, 0.31), 0.5),
        (0.05, (0.9, 0.05, 0.05), 0.6),  # out of reach
        (0.01, (0.52, 0.3, 0.18), 0.0),
        (0.5, (0.52, 0.3, 0.18), 1.0),  # nothing may shrink
    ],
)
def test_targets_are_met_wherever_they_can_be(spark, overlap, shares, floor):
    """Posteriors that hardly tell domains apart: as near as an independent solution, and met where it meets them."""
    rng = np.random.default_rng(5)
    p = 1 / 3 + overlap * (rng.dirichlet([0.3] * 3, size=400) - 1 / 3)
    p /= p.sum(1, keepdims=True)
    tokens = rng.integers(1, 300, size=400)
    rows = [(i, int(t), *map(float, q)) for i, (t, q) in enumerate(zip(tokens, p, strict=True))]
    member = spark.createDataFrame(rows, "doc_id bigint, n_tokens bigint, p0 double, p1 double, p2 double")
    model = mixing.DomainModel(("a", "b", "c"), ((), (), ()), (0.0,) * 3, ((0.0,) * 4,) * 3)
    # what these posteriors can do about the present shares, and what they cannot
    present = tokens @ p / tokens.sum()
    wanted = present + (np.array(shares) - present) * min(1.0, 2 * overlap)
    rate = mixing.fitted_rate(member, model, dict(zip("abc", wanted.tolist(), strict=True)), floor)
    found = member.select(rate.alias("rate")).toPandas()["rate"].to_numpy()
    assert (found >= floor).all()
    left = np.linalg.norm(((found * tokens) @ p - wanted * tokens.sum()) / (tokens @ p))
    best = least_squares(p, tokens.astype(float), wanted * tokens.sum(), floor)
    assert left <= max(1e-3, 1.02 * best)


def test_long_texts_are_learned_from(spark):
    word = {"en": "the house is small ", "de": "das haus ist klein "}
    rows = [(i, word[lang] * 3_000, lang) for i in range(20) for lang in [["en", "de"][i % 2]]]
    docs = spark.createDataFrame([*rows, rows[0]], "doc_id bigint, text string, lang string")
    labelled = docs.select("doc_id", F.col("lang").alias("domain"))
    rated, model = mixing.rated(docs, labelled, {"en": 0.5, "de": 0.5})
    assert "house" in model.words[model.domains.index("en")] and "haus" in model.words[model.domains.index("de")]
    got = {r["doc_id"]: r["domain"] for r in rated.collect()}
    assert got == {i: lang for i, _, lang in rows}


def test_only_more_loses_no_row(mixture):
    docs, labelled = mixture
    repeated = mixing.repeated(docs, labelled, {"en": 0.25, "de": 0.25, "fr": 0.25, "es": 0.25})
    assert repeated.columns == docs.columns
    ids = repeated.select("doc_id")
    assert ids.distinct().count() == docs.count() < ids.count()


def test_plan_is_native(mixture):
    docs, labelled = mixture
    repeated = mixing.repeated(docs, labelled, queries.MIX)
    plan = repeated._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow"))


def test_odd_documents(spark, odd_docs, no_docs):
    labelled = odd_docs.select("doc_id", F.col("lang").alias("domain"))
    rated, model = mixing.rated(odd_docs, labelled, {"en": 0.5, "de": 0.5})
    assert rated.count() == odd_docs.count() and "en" in model.domains
    repeated = mixing.repeated(odd_docs, labelled, {"en": 0.5, "de": 0.5})
    assert repeated.columns == odd_docs.columns and repeated.count() >= odd_docs.count()
    assert mixing.repeated(no_docs, labelled.limit(0), {"en": 1.0}).count() == 0
    alone, _ = mixing.rated(odd_docs, labelled.limit(0), {"en": 0.5, "de": 0.5})
    assert alone.count() == odd_docs.count()
