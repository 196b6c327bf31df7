"""Quality rules: an ordered list of threshold conjunctions learned from labelled statistics.

:func:`statistics` gives each text its numbers.  :func:`learned` covers the rows of label 0 one rule at a
time: a rule is grown on two thirds of the rows by the threshold that gains most information, pruned on
the other third, kept if precise enough there, and its rows are set aside.  :func:`expression` writes the
list as one conditional Spark expression, in order, which runs without Python.

Missing and empty texts have no words and all numbers 0; very long texts are counted whole, and learned from up to
``FIT_CHARS``, above it by parts from all over them; of conditions that gain alike the first counts; repeated rows each give their row; an empty table
gives an empty result; without labels of both kinds the list is empty and keeps everything.  Other
columns of the input are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stocklens.llm.labelled import sample_of, usable_labels
from stocklens.llm.tasks import by_batches, text_rows

#: Labelled rows the list is learned from, and characters of a text among them.
FIT_ROWS, FIT_CHARS = 12_000, 1_000_000
WINDOW = 8
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_SYMBOLS = "#*$%&|<>"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: What the learned rules may test; shares are of words or characters, so they do not grow with the text.
FEATURES = (
    "n_words",
    "mean_word",
    "symbol_share",
    "dup_line_share",
    "repeat_share",
    "stutter_share",
    "distinct_share",
    "top_word_share",
    "upper_share",
    "digit_share",
    "bang_share",
)


def repeated_words(words: Sequence[str], window: int = WINDOW) -> int:
    """Words in windows found twice or more, the first one included."""
    count = len(words) - window + 1
    if count < 2:
        return 0
    value = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    rolled = np.zeros(count, np.uint64)
    for j in range(window):
        rolled = rolled * np.uint64(0x9E3779B97F4A7C15) + value[j : j + count]
        rolled ^= rolled >> np.uint64(29)
    order = np.argsort(rolled, kind="stable")
    equal = rolled[order[1:]] == rolled[order[:-1]]
    if not equal.any():
        return 0
    suspects = np.zeros(count, bool)
    suspects[order[1:][equal]] = suspects[order[:-1][equal]] = True
    places = np.flatnonzero(suspects).tolist()
    found = Counter(tuple(words[i : i + window]) for i in places)  # hashes may agree by chance
    covered = np.zeros(len(words) + 1, np.int64)
    for i in places:
        if found[tuple(words[i : i + window])] > 1:
            covered[i] += 1
            covered[i + window] -= 1
    return int((np.cumsum(covered) > 0).sum())


def numbers(text: str) -> tuple:
    """The counts and then the features of one text."""
    words = _WORD.findall(text)
    n = len(words)
    chars = sum(map(len, words))
    symbols = sum(text.count(c) for c in _SYMBOLS)
    lines = [line for line in text.split("\n") if _WORD.search(line)]
    dup_lines = len(lines) - len(set(lines))
    repeats = repeated_words(words)
    if not n:
        return (0, 0, symbols, 0, 0, *[0.0] * len(FEATURES))
    by_word = Counter(words)
    stutter = sum(a == b for a, b in zip(words, words[1:], strict=False))
    upper = sum(map(str.isupper, words))
    digits = sum(w[0].isdigit() for w in words)
    features = (
        float(n),
        chars / n,
        symbols / chars,
        dup_lines / len(lines),
        repeats / n,
        stutter / n,
        len(by_word) / n,
        max(by_word.values()) / n,
        upper / n,
        digits / n,
        text.count("!") / n,
    )
    return (n, chars, symbols, dup_lines, repeats, *features)


def statistics(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id``, the counts and the features of every text."""

    def run(rows: dict[str, list]) -> dict[str, list]:
        columns = list(zip(*map(numbers, rows["text"]), strict=True))
        names = [*COUNTS, *(f"f_{name}" for name in FEATURES)]
        return {"doc_id": rows["doc_id"], **dict(zip(names, map(list, columns), strict=True))}

    kind = docs.schema[id_column].dataType.simpleString()
    schema = [f"doc_id {kind}", *(f"{n} bigint" for n in COUNTS), *(f"f_{n} double" for n in FEATURES)]
    return by_batches(text_rows(docs, id_column, text_column), run, ", ".join(schema))


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def holds(self, values: dict[str, np.ndarray]) -> np.ndarray:
        column = values[self.feature]
        return column > self.threshold if self.above else column <= self.threshold

    def column(self) -> Column:
        column = F.col(f"f_{self.feature}")
        return column > self.threshold if self.above else column <= self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:.6g}"


Rule = tuple[Condition, ...]


def _covered(rule: Sequence[Condition], values: dict[str, np.ndarray]) -> np.ndarray:
    held = np.ones(len(next(iter(values.values()))), bool)
    for condition in rule:
        held &= condition.holds(values)
    return held


def _best(values: dict[str, np.ndarray], bad: np.ndarray) -> tuple[float, Condition | None]:
    """The condition of highest information gain towards the bad rows."""
    total, positive = len(bad), int(bad.sum())
    base = np.log2(positive / total)
    best: tuple[float, Condition | None] = (0.0, None)
    for name, column in values.items():
        order = np.argsort(column, kind="stable")
        ranked, hits = column[order], np.cumsum(bad[order])
        cuts = np.flatnonzero(ranked[1:] > ranked[:-1])
        if not len(cuts):
            continue
        for above in (False, True):
            p = positive - hits[cuts] if above else hits[cuts]
            n = total - cuts - 1 if above else cuts + 1
            gain = np.where(p > 0, p * (np.log2(np.maximum(p, 1) / n) - base), -1)
            i = int(gain.argmax())
            if gain[i] > best[0] + 1e-9:
                threshold = float((ranked[cuts[i]] + ranked[cuts[i] + 1]) / 2)
                best = float(gain[i]), Condition(name, above, threshold)
    return best


def _grown(values: dict[str, np.ndarray], bad: np.ndarray, most: int) -> list[Condition]:
    rule: list[Condition] = []
    held = np.ones(len(bad), bool)
    while len(rule) < most and bad[held].any() and not bad[held].all():
        _, condition = _best({k: v[held] for k, v in values.items()}, bad[held])
        if condition is None:
            break
        rule.append(condition)
        held &= condition.holds(values)
    return rule


def _worth(rule: Sequence[Condition], values: dict[str, np.ndarray], bad: np.ndarray) -> float:
    held = _covered(rule, values)
    p, n = int(bad[held].sum()), int((~bad[held]).sum())
    return (p - n) / (p + n) if p + n else -1.0


def learned(
    values: dict[str, np.ndarray],
    labels: np.ndarray,
    most_rules: int = 12,
    most_conditions: int = 4,
    least_precision: float = 0.95,
    seed: int = 11,
) -> list[Rule]:
    """Rules in order; a row that any of them covers is taken for label 0."""
    bad = np.asarray(labels) == 0
    if not bad.any() or bad.all():
        return []
    random = np.random.default_rng(seed)
    left = np.ones(len(bad), bool)
    rules: list[Rule] = []
    while len(rules) < most_rules and bad[left].any():
        grow = left & (random.random(len(bad)) < 2 / 3)
        prune = left & ~grow
        if not bad[grow].any() or bad[grow].all():
            break
        rule = _grown({k: v[grow] for k, v in values.items()}, bad[grow], most_conditions)
        if not rule:
            break
        held_out = {k: v[prune] for k, v in values.items()}
        while len(rule) > 1 and _worth(rule[:-1], held_out, bad[prune]) >= _worth(rule, held_out, bad[prune]):
            rule = rule[:-1]
        covered = _covered(rule, values) & left
        # precision over both parts, so that a rule for a rare kind of row can be judged
        if not covered.any() or bad[covered].mean() < least_precision or bad[covered].sum() < 3:
            break
        rules.append(tuple(rule))
        left &= ~covered
    return rules


def expression(rules: Sequence[Rule]) -> Column:
    """The ordered list as one conditional: false for what the first matching rule takes out, else true."""
    verdict: Column | None = None
    for rule in rules:
        condition = F.lit(True)
        for part in rule:
            condition = condition & part.column()
        verdict = F.when(condition, False) if verdict is None else verdict.when(condition, False)
    return F.lit(True) if verdict is None else verdict.otherwise(True)


def fit(
    docs: DataFrame, labels: DataFrame, label: str = "quality", divisor: int = 1, left_out: int = 1
) -> list[Rule]:
    """Rules learned on a bounded sample of labelled rows, whose numbers come from Spark."""
    usable = usable_labels(labels, label, divisor, left_out)
    sample = sample_of(text_rows(docs), usable, FIT_ROWS, FIT_CHARS).select("doc_id", "text", "label")
    known = sample.select("doc_id", "label").distinct()
    rows = statistics(sample).join(F.broadcast(known), "doc_id")
    table = rows.select("label", *[f"f_{n}" for n in FEATURES]).toPandas()
    table = table.sort_values(list(table.columns))
    return learned({n: table[f"f_{n}"].to_numpy() for n in FEATURES}, table["label"].to_numpy())


def judged(docs: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """The statistics of every text with ``base_failed`` and ``kept``."""
    n = F.col("n_words")
    failed = (n < 20) | (100 * F.col("n_repeat_words") > 30 * n)
    return (
        statistics(docs)
        .withColumn("base_failed", failed)
        .withColumn("kept", ~F.col("base_failed") & expression(rules))
    )
