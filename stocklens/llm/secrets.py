"""Secret scans: all rules in one pass over the bytes of each text.

The rules become one automaton (:mod:`stocklens.llm.automaton`).  Where it says that a rule ends, the
rule's own backward automaton finds the begin and its forward one the end of the longest match, after
the end of the rule's match before: leftmost matches that do not overlap, per rule.  The earliest end of
a rule must belong to its leftmost match, which holds as no match of these rules nests in the beginning
of another.  A private key goes on over its body, up to the END line or, where there is none, over the
lines of base64 that follow.  A match that is too short for its rule is dropped after it has used up its text.

Missing and empty texts have no spans; very long texts are scanned whole; spans that begin together come in the order
of the rules; repeated rows each give their row; an empty table gives an empty
result; other columns of the input are not read by :func:`find_secrets` and kept by :func:`redact`.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stocklens.llm.automaton import SEPARATOR, Automaton, compiled, states_after
from stocklens.llm.tasks import by_batches, each_text, text_rows


@dataclass(frozen=True)
class Rule:
    """``pattern`` of a kind of secret; after ``head`` at least ``least`` bytes must follow.

    ``sign``, where given, is the beginning that every match has and by which matches are found.
    """

    kind: str
    pattern: str
    least: int = 0
    head: str = ""
    ignore_case: bool = False
    sign: str = ""


_KEYS = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
_PEM = "-----BEGIN ([A-Z]+ )*PRIVATE KEY-----"
#: Lines may be broken, also by an escaped line feed, or stand in one line.
_BREAK = r"([\x20\t\r\n]|\\n|\\r)+"
_PEM_BODY = r"([A-Za-z0-9+/=:,.\\\x20\t\r\n]|-[A-Za-z0-9])*-----END ([A-Z]+ )*PRIVATE KEY-----"
#: Without an END line: lines of headers, then whole lines of base64 and what may be the last one.
_PEM_LINES = rf"({_BREAK}[A-Za-z]+-[A-Za-z]+: [A-Za-z0-9,-]+)*({_BREAK}[A-Za-z0-9+/=]{{16,}})+([\r\n]+[A-Za-z0-9+/=]+)?"
#: The base kinds first, then formats of well-known issuers.
RULES = (
    Rule("assign", _KEYS + "[A-Za-z0-9+/_.=-]+", 8, _KEYS, True),
    Rule("access", "AKIA[A-Z0-9]+", 16),
    Rule("hex", "[0-9a-f]{8,}", 32),  # ends after eight already: fewer states than counting to 32
    Rule("github", "gh[pousr]_[A-Za-z0-9]+", 40),
    Rule("slack", "xox[abprs]-[A-Za-z0-9-]+", 15),
    Rule("google", "AIza[A-Za-z0-9_-]+", 39),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 30),
    Rule("pem", f"{_PEM}({_PEM_BODY}|{_PEM_LINES})?", sign=_PEM),
)


@dataclass(frozen=True)
class Scanner:
    rules: tuple[Rule, ...]
    together: Automaton
    forward: tuple[Automaton, ...]
    backward: tuple[Automaton, ...]
    heads: tuple[Automaton | None, ...]


def scanner(rules: Sequence[Rule] = RULES) -> Scanner:
    alone = [[(r.pattern, r.ignore_case)] for r in rules]
    signs = [[(r.sign or r.pattern, r.ignore_case)] for r in rules]
    return Scanner(
        tuple(rules),
        compiled([a[0] for a in signs], anywhere=True),
        tuple(compiled(a, anywhere=False) for a in alone),
        tuple(compiled(a, anywhere=False, backward=True) for a in signs),
        tuple(compiled([(r.head, r.ignore_case)], anywhere=False) if r.head else None for r in rules),
    )


def spans(texts: Sequence[str], scan: Scanner) -> list[list[tuple[int, int, int]]]:
    """Per text (number of the rule, begin, end) in code points, by begin and then rule."""
    raw = [t.encode() for t in texts]
    data = bytes([SEPARATOR]).join([*raw, b""])
    buffer = np.frombuffer(data, np.uint8)
    ends = np.cumsum([len(r) + 1 for r in raw])
    marks = scan.together.ends[states_after(scan.together, buffer)]
    hits = np.flatnonzero(marks)
    bits = marks[hits]
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for k in range(len(scan.rules)):
        for begin, end in _matches(k, scan, data, hits[bits & (1 << k) != 0], ends):
            found[int(np.searchsorted(ends, begin, side="right"))].append((begin, k, end))
    for i, matches in enumerate(found):
        if matches:
            first = int(ends[i]) - len(raw[i]) - 1
            bounds = np.array([(b - first, e - first) for b, _, e in matches])
            own = buffer[first : int(ends[i]) - 1]
            if len(raw[i]) != len(texts[i]):  # bytes to code points
                before = np.concatenate([[0], np.cumsum((own & 0xC0) != 0x80)])
                bounds = before[bounds]
            rows = zip(bounds.tolist(), matches, strict=True)
            found[i] = [(k, b, e) for b, k, e in sorted((b, k, e) for (b, e), (_, k, _) in rows)]
    return found


def _matches(k: int, scan: Scanner, data: bytes, hits: np.ndarray, ends: np.ndarray):
    rule, after, i = scan.rules[k], 0, 0
    while i < len(hits):
        last = int(hits[i])
        text_end = int(ends[np.searchsorted(ends, last, side="right")]) - 1
        begin = scan.backward[k].longest_back(data, last + 1, after)
        if begin < 0:
            i += 1  # only matches that began before the end of the last one
            continue
        end = scan.forward[k].longest(data, begin, text_end)
        value = scan.heads[k].longest(data, begin, end) if scan.heads[k] else begin
        if end - value >= rule.least:
            yield begin, end
        after = end
        i = int(np.searchsorted(hits, end))


def _shared(df: DataFrame, rules: Sequence[Rule]) -> Broadcast:
    """The compiled rules: their size depends on the rules alone."""
    return df.sparkSession.sparkContext.broadcast(scanner(rules))


def find_secrets(
    docs: DataFrame, rules: Sequence[Rule] = RULES, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """``doc_id`` and ``spans``: kind, begin and end (exclusive) in code points, by begin, then kind as listed."""
    shared = _shared(docs, rules)

    def run(rows: dict[str, list]) -> dict[str, list]:
        scan = shared.value
        result = [
            [{"kind": scan.rules[k].kind, "start": b, "end": e} for k, b, e in some]
            for some in spans(rows["text"], scan)
        ]
        return {"doc_id": rows["doc_id"], "spans": result}

    kind = docs.schema[id_column].dataType.simpleString()
    struct = "array<struct<kind: string, start: bigint, end: bigint>>"
    return by_batches(text_rows(docs, id_column, text_column), run, f"doc_id {kind}, spans {struct}")


def redact(
    docs: DataFrame, rules: Sequence[Rule] = RULES, mark: str = "[secret]", text_column: str = "text"
) -> DataFrame:
    """``docs`` with each secret of the text replaced by ``mark``; all other columns stay, a missing text too."""
    shared = _shared(docs, rules)

    def run(texts: list[str]) -> tuple[list[str], None]:
        found = spans(texts, shared.value)
        return [_without(t, s, mark) if s else t for t, s in zip(texts, found, strict=True)], None

    return each_text(docs, run, text_column)


def _without(text: str, found: list[tuple[int, int, int]], mark: str) -> str:
    parts, after = [], 0
    for _, begin, end in found:
        if begin >= after:
            parts += [text[after:begin], mark]
        after = max(after, end)
    return "".join([*parts, text[after:]])


def count_of(found: str, kind: str) -> Column:
    """How many spans are of a kind, as a column."""
    return F.size(F.filter(found, lambda s: s["kind"] == kind)).cast("bigint")


def kinds_of(found: str, kinds: Sequence[str]) -> Column:
    """The spans of some kinds as ``kind:start:end`` joined by commas, as a column."""
    chosen = F.filter(found, lambda s: s["kind"].isin(*kinds))
    return F.array_join(F.transform(chosen, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
