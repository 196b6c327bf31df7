"""Token counts without encoding: pieces that are known to be one token are only counted.

Which strings of the vocabulary encode alone as one token is proved beforehand, by merging each of
them under the file's own merge rules.  A piece of the text that is such a string counts one; only the
rest is merged, once per distinct piece and task.  Added special strings inside a text count one each
and split the text, as the library does by default.

Missing and empty texts have no bytes and no tokens; very long texts are counted whole; of merges of one rank the
leftmost comes first; repeated rows each give their row; an empty table
gives an empty result; other columns of the input are not read.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark import Broadcast
from pyspark.sql import DataFrame

from stocklens.llm.merges import MergeTable
from stocklens.llm.pretokens import merge_file_symbols, pieces_of
from stocklens.llm.tasks import by_batches, text_rows

#: Merged pieces whose count one task remembers.
CACHED_PIECES = 400_000


@dataclass(frozen=True)
class MergeRules:
    """The merges, the strings proved to be one token, special strings, and symbols."""

    merges: MergeTable
    whole: frozenset[str]
    special: tuple[str, ...]
    symbols: np.ndarray


def _byte_letters() -> dict[str, int]:
    """The character that stands for each byte in merge files: printable Latin-1 for itself, the rest
    in order from code point 256 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


def read_merge_rules(path: str) -> MergeRules:
    with open(path, encoding="utf-8") as file:
        content = json.load(file)
    letters = _byte_letters()

    def raw(token: str) -> bytes:
        return bytes(letters[c] for c in token)

    vocabulary = {raw(t): i for t, i in content["model"]["vocab"].items() if t not in special_strings(content)}
    pairs = [m.split(" ") if isinstance(m, str) else m for m in content["model"]["merges"]]
    ids = [(raw(a), raw(b)) for a, b in pairs]
    merges = MergeTable(
        ((vocabulary[a], vocabulary[b], rank, vocabulary[a + b]) for rank, (a, b) in enumerate(ids)),
        [vocabulary[bytes([b])] for b in range(256)],
    )
    return MergeRules(merges, proved(list(vocabulary), merges), special_strings(content), merge_file_symbols())


def special_strings(content: dict) -> tuple[str, ...]:
    return tuple(t["content"] for t in content["added_tokens"])


def proved(vocabulary: Sequence[bytes], merges: MergeTable) -> frozenset[str]:
    """The strings of the vocabulary that merging turns into one token."""
    found = []
    for token, tokens in zip(vocabulary, merges.merge(vocabulary), strict=True):
        if len(tokens) == 4:  # the bytes of one
            try:
                found.append(token.decode())
            except UnicodeDecodeError:
                continue  # part of a character: never a piece by itself
    return frozenset(found)


class Counter(dict):
    """Piece to its number of tokens; begins with the proved ones and forgets the others when full."""

    def __init__(self, rules: MergeRules) -> None:
        super().__init__(dict.fromkeys(rules.whole, 1))
        self.rules = rules
        self.limit = CACHED_PIECES + len(rules.whole)

    def learn(self, pieces: list[str]) -> None:
        """Make sure that every piece is known."""
        if len(self) >= self.limit:
            self.clear()
            self.update(dict.fromkeys(self.rules.whole, 1))
        rest = [p for p in set(pieces) if p not in self]
        for piece, tokens in zip(rest, self.rules.merges.merge([p.encode() for p in rest]), strict=True):
            self[piece] = len(tokens) // 4


_COUNTERS: dict[int, Counter] = {}


def _counter(rules: Broadcast) -> Counter:
    key = id(rules.value)
    if key not in _COUNTERS:
        _COUNTERS.clear()
        _COUNTERS[key] = Counter(rules.value)
    return _COUNTERS[key]


def _split(texts: list[str], special: tuple[str, ...]) -> Iterator[tuple[int, list[str], int]]:
    """(number of the text, its ordinary parts, its special strings)."""
    pattern = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True)))) if special else None
    for number, text in enumerate(texts):
        if pattern and pattern.search(text):
            parts = pattern.split(text)
            yield number, [p for p in parts if p], len(parts) - 1
        else:
            yield number, [text], 0


def count_tokens(
    docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """``doc_id``, ``n_bytes`` (UTF-8) and ``n_tokens`` of every text, by the merge file at ``path``."""
    rules = docs.sparkSession.sparkContext.broadcast(read_merge_rules(path))

    def run(rows: dict[str, list]) -> dict[str, list]:
        value, counter = rules.value, _counter(rules)
        totals = [0] * len(rows["text"])
        parts, owners = [], []
        for number, ordinary, specials in _split(rows["text"], value.special):
            totals[number] += specials
            parts += ordinary
            owners += [number] * len(ordinary)
        for pieces, stretches in pieces_of(parts, value.symbols):
            counter.learn(pieces)
            for number, first, last in stretches:
                totals[owners[number]] += sum(map(counter.__getitem__, pieces[first:last]))
        sizes = [len(t.encode()) for t in rows["text"]]
        return {"doc_id": rows["doc_id"], "n_bytes": sizes, "n_tokens": totals}

    kind = docs.schema[id_column].dataType.simpleString()
    return by_batches(
        text_rows(docs, id_column, text_column), run, f"doc_id {kind}, n_bytes bigint, n_tokens bigint"
    )
