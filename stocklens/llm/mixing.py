"""Mixing to target weights by soft membership, with DataFrame functions only.

*Posteriors.*  From a labelled table the words that speak for each domain are learned: the ones with the
highest log odds there.  A text is then counted per domain's words, and a multinomial model of these
counts gives the probability of each domain.  As words of one text depend on each other, a text counts as
at most ``EVIDENCE`` words.

*Rates.*  Each text gets a rate of at least ``floor``.  The rates minimise the squared distance between
the expected tokens of each domain (sum of rate x tokens x posterior) and its target, each domain in units
of its own tokens, by projected gradient steps.  A gradient is a mix of a text's posteriors, so all steps together
move it along one line per domain, and its rate stays ``greatest(floor, 1 - sum of posterior x lever)``: nothing is stored
per step.  Among rates that are equally near the targets the ones nearest to 1 are wanted, so staying there counts
with a weight of ``STAY``; that makes the optimum unique.  A step is scaled by the products of posteriors summed
over the texts above the floor, which ends at the optimum unless texts reach the floor on the way, and is shortened
where it does not gain enough.  One pass over the texts gives the totals and products, a few numbers per
pair of domains, which is all that comes back to the driver.  Steps end where the targets are met to ``TOLERANCE``, or
where the gradient is gone, as targets may be out of reach above the floor; what is left is logged then.

A missing or empty text has no tokens and the prior as posterior; very long texts are counted whole, and learned from
by parts from all over them above ``FIT_CHARS``; of equal posteriors the first domain is the likeliest.  Missing domains are not learned from;
domains without tokens have no target; repeated rows are texts of their own; an empty table gives an empty
result; without labelled rows every domain of the targets is equally likely.  Other columns are kept by
:func:`repeated` and not read by :func:`rates`.
"""

from __future__ import annotations

import logging
import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stocklens.llm.labelled import spread
from stocklens.session import landed

#: Labelled texts to learn from, words kept per domain, and texts that a word must stand in.
FIT_ROWS, FIT_CHARS, WORDS_PER_DOMAIN, LEAST_TEXTS = 4_000, 40_000, 64, 3
EVIDENCE = 50
#: Passes at most, the distance to each target that ends them, and the weight of rates staying near 1.
STEPS, TOLERANCE, STAY = 60, 1e-4, 1e-6
_LOG = logging.getLogger(__name__)


@dataclass(frozen=True)
class DomainModel:
    """Domains in order, their words, log priors, and log chances [domain][domain whose word, or none]."""

    domains: tuple[str, ...]
    words: tuple[tuple[str, ...], ...]
    priors: tuple[float, ...]
    chances: tuple[tuple[float, ...], ...]


def _words(text: Column) -> Column:
    """Blank-separated words in lower case; a text without any has an empty array."""
    plain = F.lower(F.coalesce(text.cast("string"), F.lit("")))
    for space in ("\n", "\t", "\r"):
        plain = F.replace(plain, F.lit(space), F.lit(" "))
    return F.filter(F.split(plain, " "), lambda w: w != "")


def learned(
    docs: DataFrame,
    labelled: DataFrame,
    domain_column: str = "domain",
    id_column: str = "doc_id",
    text_column: str = "text",
    domains: Sequence[str] = (),
) -> DomainModel:
    """The model of the domains in ``labelled`` (id and domain), or of ``domains`` without any label.

    ``FIT_ROWS`` labelled ids in order of a hash are learned from; they are few enough to broadcast.
    """
    marks = (
        labelled.select(F.col(f"`{id_column}`").alias("id"), F.col(f"`{domain_column}`").cast("string").alias("domain"))
        .filter("id is not null and domain is not null")
        .groupBy("id")
        .agg(F.min("domain").alias("domain"))
        .orderBy(F.xxhash64("id"), "id")
        .limit(FIT_ROWS)
    )
    texts = docs.select(F.col(f"`{id_column}`").alias("id"), F.col(f"`{text_column}`").alias("text"))
    # one row of each id, and of a very long text parts from all over it
    rows = texts.join(F.broadcast(marks), "id").groupBy("id", "domain").agg(F.min("text").alias("text"))
    sample = rows.withColumn("text", spread(F.col("text"), FIT_CHARS))
    sample = landed(sample.select("domain", _words(F.col("text")).alias("words")), "domain-sample")
    per_domain = {
        r["domain"]: (r["texts"], r["tokens"])
        for r in sample.groupBy("domain").agg(F.count("*").alias("texts"), F.sum(F.size("words")).alias("tokens")).collect()
    }
    names = tuple(sorted(per_domain)) or tuple(sorted(domains))
    if not per_domain:
        even = -math.log(max(1, len(names)))
        nothing = tuple((0.0,) * (len(names) + 1) for _ in names)
        return DomainModel(names, ((),) * len(names), (even,) * len(names), nothing)
    texts_total = sum(texts for texts, _ in per_domain.values())
    tokens_total = sum(tokens for _, tokens in per_domain.values())
    counted = (
        sample.select("domain", F.explode("words").alias("word"))
        .groupBy("domain", "word")
        .agg(F.count("*").alias("n"))
    )
    over_all = counted.groupBy("word").agg(F.sum("n").alias("everywhere"))
    sizes = F.create_map(*[F.lit(x) for name in names for x in (name, float(per_domain[name][1]))])
    inside = (F.col("n") + 0.5) / (sizes[F.col("domain")] + 1)
    outside = (F.col("everywhere") - F.col("n") + 0.5) / (F.lit(float(tokens_total)) - sizes[F.col("domain")] + 1)
    weight = F.col("n") * (F.log(inside) - F.log(outside))
    # a bounded sample's words; each domain's share of the ranking is one small window
    rank = F.row_number().over(Window.partitionBy("domain").orderBy(F.desc("weight"), "word"))
    best = (
        counted.filter(F.col("n") >= LEAST_TEXTS)
        .join(over_all, "word")
        .withColumn("weight", weight)
        .filter((F.col("weight") > 0) & (inside > 2 * outside))
        .withColumn("rank", rank)
        .filter(F.col("rank") <= WORDS_PER_DOMAIN)
        .select("domain", "word")
    )
    found: dict[str, list[str]] = {name: [] for name in names}
    taken: set[str] = set()
    for row in sorted(best.collect(), key=lambda r: (r["domain"], r["word"])):
        if row["word"] not in taken:  # odds above two leave a word to one domain, or to the first of few
            taken.add(row["word"])
            found[row["domain"]].append(row["word"])
    words = tuple(tuple(found[name]) for name in names)
    sums = sample.groupBy("domain").agg(*[F.sum(_count(some)).alias(f"n{j}") for j, some in enumerate(words)])
    by_domain = {r["domain"]: [r[f"n{j}"] for j in range(len(names))] for r in sums.collect()}
    chances = []
    for name in names:
        counts, tokens = by_domain[name], per_domain[name][1]
        parts = [*counts, tokens - sum(counts)]
        chances.append(tuple(math.log((c + 1) / (tokens + len(parts))) for c in parts))
    priors = tuple(math.log(per_domain[name][0] / texts_total) for name in names)
    return DomainModel(names, words, priors, tuple(chances))


def _count(some: Sequence[str]) -> Column:
    """How many of the column ``words`` are among ``some``."""
    if not some:
        return F.lit(0)
    return F.size(F.filter(F.col("words"), lambda w: w.isin(list(some))))


def posteriors(
    docs: DataFrame,
    model: DomainModel,
    id_column: str = "doc_id",
    text_column: str = "text",
    whole_rows: bool = False,
) -> DataFrame:
    """``doc_id``, ``n_tokens`` and one probability ``p0``, ``p1``, ... per domain of the model.

    ``whole_rows`` adds the row itself as the struct ``row``.
    """
    count = len(model.domains)
    row = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if whole_rows else []
    kept = ["row"] if whole_rows else []
    split = docs.select(
        *row, F.col(f"`{id_column}`").alias("doc_id"), _words(F.col(f"`{text_column}`")).alias("words")
    )
    counts = split.select(
        *kept,
        "doc_id",
        F.size("words").cast("bigint").alias("n_tokens"),
        *[_count(some).alias(f"c{j}") for j, some in enumerate(model.words)],
    )
    rest = F.col("n_tokens")
    for j in range(count):
        rest = rest - F.col(f"c{j}")
    share = F.least(F.lit(1.0), F.lit(float(EVIDENCE)) / F.greatest(F.col("n_tokens"), F.lit(1)))
    scored = counts.withColumn("rest", rest).withColumn("share", share)
    logs = []
    for k in range(count):
        value = F.lit(0.0)
        for j in range(count):
            value = value + F.col(f"c{j}") * F.lit(model.chances[k][j])
        logs.append(F.lit(model.priors[k]) + F.col("share") * (value + F.col("rest") * F.lit(model.chances[k][count])))
    scored = scored.select(*kept, "doc_id", "n_tokens", *[v.alias(f"s{k}") for k, v in enumerate(logs)])
    top = F.greatest(*[F.col(f"s{k}") for k in range(count)]) if count > 1 else F.col("s0")
    scored = scored.withColumn("top", top)
    scored = scored.select(
        *kept, "doc_id", "n_tokens", *[F.exp(F.col(f"s{k}") - F.col("top")).alias(f"e{k}") for k in range(count)]
    )
    whole = F.lit(0.0)
    for k in range(count):
        whole = whole + F.col(f"e{k}")
    scored = scored.withColumn("whole", whole)
    return scored.select(
        *kept, "doc_id", "n_tokens", *[(F.col(f"e{k}") / F.col("whole")).alias(f"p{k}") for k in range(count)]
    )


def fitted_rate(
    member: DataFrame,
    model: DomainModel,
    weights: Mapping[str, float],
    floor: float = 0.0,
    only_more: bool = False,
) -> Column:
    """The rate as a column over ``member`` (from :func:`posteriors`, landed).

    ``weights`` are the wanted shares of tokens; a domain left out is wanted at its present share.  The
    total stays as it is, or with ``only_more`` becomes just so large that no domain has to shrink.
    """
    count = len(model.domains)
    base = max(1.0, floor)
    present, _, _ = _passed(member, [0.0] * count, 1.0, 0.0)
    wanted = np.array(_targets(model.domains, present.tolist(), weights, only_more))
    unit = np.where(present > 0, present, 1.0)
    stay = STAY * unit * unit / max(1.0, unit.sum())

    def looked(at: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """What the steps make small, its gradient, and its curvature."""
        totals, products, held = _passed(member, at.tolist(), base, floor)
        return held + wanted @ at + at @ (stay * at) / 2, wanted - totals + stay * at, products + np.diag(stay)

    levers = np.zeros(count)
    value, slope, curve = looked(levers)
    passes = 1
    while count and passes < STEPS:
        error = np.abs((slope - stay * levers) / unit).max()
        if error < TOLERANCE or np.abs(slope / unit).max() < TOLERANCE / 10:
            break
        step = -np.linalg.solve(curve, slope)
        length = 1.0
        while True:
            found = looked(levers + length * step)
            passes += 1
            if found[0] <= value + 1e-4 * length * (slope @ step) or passes >= STEPS:
                break
            length /= 4
        levers = levers + length * step
        value, slope, curve = found
    left = float(np.abs((slope - stay * levers) / unit).max(initial=0.0))
    if left >= 10 * TOLERANCE:
        _LOG.warning("targets are out of reach: up to %.4f of a domain's tokens are left", left)
    return _rate(levers.tolist(), base, floor)


def _raw_rate(levers: Sequence[float], base: float) -> Column:
    rate = F.lit(float(base))
    for k, lever in enumerate(levers):
        rate = rate - F.col(f"p{k}") * F.lit(float(lever))
    return rate


def _rate(levers: Sequence[float], base: float, floor: float) -> Column:
    return F.greatest(F.lit(float(floor)), _raw_rate(levers, base))


def likeliest(model: DomainModel) -> Column:
    """The domain of the highest probability, the first of equal ones."""
    columns = [F.col(f"p{k}") for k in range(len(model.domains))]
    best = F.greatest(*columns) if len(columns) > 1 else columns[0]
    domain = F.lit(None).cast("string")
    for name, column in reversed(list(zip(model.domains, columns, strict=True))):
        domain = F.when(column == best, F.lit(name)).otherwise(domain)
    return domain


def _passed(
    member: DataFrame, levers: Sequence[float], base: float, floor: float
) -> tuple[np.ndarray, np.ndarray, float]:
    """Expected tokens of each domain; tokens times both posteriors for each two, over texts not held at the floor;
    and the sum whose gradient the totals are."""
    count = len(levers)
    raw, tokens = _raw_rate(levers, base), F.col("n_tokens")
    free = raw >= floor
    rate = F.when(free, raw).otherwise(F.lit(float(floor)))
    pairs = [(k, j) for k in range(count) for j in range(k, count)]
    sums = [F.sum(tokens * F.when(free, raw * raw / 2).otherwise(floor * raw - floor * floor / 2)).alias("held")]
    sums += [F.sum(rate * tokens * F.col(f"p{k}")).alias(f"t{k}") for k in range(count)]
    sums += [F.sum(F.when(free, tokens * F.col(f"p{k}") * F.col(f"p{j}"))).alias(f"m{k}x{j}") for k, j in pairs]
    held, *found = [float(x or 0.0) for x in member.agg(*sums).first()]
    products = np.zeros((count, count))
    for (k, j), value in zip(pairs, found[count:], strict=True):
        products[k, j] = products[j, k] = value
    return np.array(found[:count]), products, held


def _targets(
    domains: Sequence[str], present: Sequence[float], weights: Mapping[str, float], only_more: bool
) -> list[float]:
    total = sum(present)
    if total <= 0:
        return list(present)
    shares = [weights.get(name, tokens / total) if tokens > 0 else 0.0 for name, tokens in zip(domains, present, strict=True)]
    whole = sum(shares)
    if whole <= 0:
        return list(present)
    shares = [s / whole for s in shares]
    if only_more:
        total = max((t / s for t, s in zip(present, shares, strict=True) if s > 0), default=total)
    return [s * total for s in shares]


def copies() -> Column:
    """A whole number whose mean is the rate: rounded by a hash of the id, so it is repeatable."""
    chance = F.pmod(F.xxhash64("doc_id", F.lit("copies")), F.lit(1 << 20)) / F.lit(float(1 << 20))
    return F.floor(F.col("rate") + chance).cast("int")


def rated(
    docs: DataFrame,
    labelled: DataFrame,
    weights: Mapping[str, float],
    domain_column: str = "domain",
    floor: float = 0.0,
    only_more: bool = False,
) -> tuple[DataFrame, DomainModel]:
    """Per row of ``docs``: ``doc_id``, ``n_tokens``, posteriors, ``domain``, ``rate`` and ``copies``."""
    model = learned(docs, labelled, domain_column, domains=tuple(weights))
    member = landed(posteriors(docs, model), "posteriors")
    rate = fitted_rate(member, model, weights, floor, only_more)
    found = member.withColumn("domain", likeliest(model)).withColumn("rate", rate)
    return found.withColumn("copies", copies()), model


def repeated(
    docs: DataFrame,
    labelled: DataFrame,
    weights: Mapping[str, float],
    domain_column: str = "domain",
    floor: float = 1.0,
    only_more: bool = True,
) -> DataFrame:
    """``docs`` with each row as often as its rate says; by default no row is lost.

    Rows are not joined with their rates: the fitted rate is an expression over the row itself.
    """
    model = learned(docs, labelled, domain_column, domains=tuple(weights))
    member = landed(posteriors(docs, model), "posteriors")
    rate = fitted_rate(member, model, weights, floor, only_more)
    rows = posteriors(docs, model, whole_rows=True).withColumn("rate", rate)
    every = rows.select("row", F.explode(F.array_repeat(F.lit(1), copies())).alias("copy"))
    return every.select("row.*")
