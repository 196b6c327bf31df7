"""One deterministic automaton for many byte patterns, and a scan that runs it over text side by side.

Patterns are parsed by Python's own parser, become one nondeterministic automaton each, and are joined
by subset construction over byte classes; equal states are merged by partition refinement.  The result
is one transition array and one array of bits: which patterns end after this byte.

Text is scanned in lanes that all begin in the start state.  Where the lane before really ended in
another state, the lane is run again from there until both runs agree, which they soon do.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass
from functools import cached_property

import numpy as np

#: A byte that no UTF-8 text holds; it separates texts and returns every automaton to its start.
SEPARATOR = 0xFF
_WIDTH = 1024


class _Net:
    """A nondeterministic automaton: per state the free moves and the moves by sets of bytes."""

    def __init__(self) -> None:
        self.free: list[list[int]] = []
        self.moves: list[list[tuple[frozenset[int], int]]] = []

    def state(self) -> int:
        self.free.append([])
        self.moves.append([])
        return len(self.free) - 1

    def add(self, tree, begin: int, ignore_case: bool, backward: bool) -> int:
        """The end state of ``tree`` entered at ``begin``; backward reads the pattern from its end."""
        for kind, value in reversed(tree) if backward else tree:
            name = str(kind)
            if name == "LITERAL":
                begin = self._move(begin, _either_case({value}, ignore_case))
            elif name == "IN":
                begin = self._move(begin, _either_case(_members(value), ignore_case))
            elif name == "SUBPATTERN":
                begin = self.add(value[3], begin, ignore_case, backward)
            elif name == "BRANCH":
                end = self.state()
                for option in value[1]:
                    self.free[self.add(option, begin, ignore_case, backward)].append(end)
                begin = end
            elif name == "MAX_REPEAT":
                begin = self._repeat(value, begin, ignore_case, backward)
            else:
                raise ValueError(f"a rule may not use {name}")
        return begin

    def _move(self, begin: int, accepted: frozenset[int]) -> int:
        end = self.state()
        self.moves[begin].append((accepted, end))
        return end

    def _repeat(self, value, begin: int, ignore_case: bool, backward: bool) -> int:
        least, most, tree = value
        for _ in range(least):
            begin = self.add(tree, begin, ignore_case, backward)
        end = self.state()
        self.free[begin].append(end)
        if str(most) == "MAXREPEAT":
            loop = self.state()
            self.free[begin].append(loop)
            self.free[self.add(tree, loop, ignore_case, backward)] += [loop, end]
        else:
            for _ in range(most - least):
                begin = self.add(tree, begin, ignore_case, backward)
                self.free[begin].append(end)
        return end

    def closure(self, states) -> frozenset[int]:
        found, todo = set(), list(states)
        while todo:
            q = todo.pop()
            if q not in found:
                found.add(q)
                todo += self.free[q]
        return frozenset(found)


def _members(items) -> set[int]:
    found: set[int] = set()
    negated = False
    for kind, value in items:
        name = str(kind)
        if name == "NEGATE":
            negated = True
        elif name == "LITERAL":
            found.add(value)
        elif name == "RANGE":
            found.update(range(value[0], value[1] + 1))
        else:
            raise ValueError(f"a rule may not use {name} in a class")
    return set(range(SEPARATOR)) - found if negated else found


def _either_case(values: set[int], ignore_case: bool) -> frozenset[int]:
    if ignore_case:
        values = {ord(c) for v in values for c in (chr(v).lower(), chr(v).upper())}
    return frozenset(values)


def _union(sets) -> int:
    joined = 0
    for one in sets:
        joined |= one
    return joined


@dataclass(frozen=True)
class Automaton:
    """State 0 is dead, ``start`` the first; ``table[state * 256 + byte]``; ``ends[state]`` has a bit per rule."""

    table: np.ndarray
    ends: np.ndarray
    start: int

    @cached_property
    def plain(self) -> tuple[list[int], list[int]]:
        """The arrays as lists, for runs over a few bytes."""
        return self.table.tolist(), self.ends.tolist()

    def longest(self, data: bytes, begin: int, limit: int) -> int:
        """Where the longest match from ``begin`` ends, or -1."""
        table, ends = self.plain
        state, found = self.start, -1
        for i in range(begin, limit):
            state = table[state << 8 | data[i]]
            if not state:
                break
            if ends[state]:
                found = i + 1
        return found

    def longest_back(self, data: bytes, end: int, limit: int) -> int:
        """Where the longest match that ends at ``end`` begins, not before ``limit``, or -1."""
        table, ends = self.plain
        state, found = self.start, -1
        for i in range(end - 1, limit - 1, -1):
            state = table[state << 8 | data[i]]
            if not state:
                break
            if ends[state]:
                found = i
        return found


def compiled(patterns: Sequence[tuple[str, bool]], anywhere: bool, backward: bool = False) -> Automaton:
    """One minimal automaton of (pattern, ignore case) rules.

    ``anywhere`` lets a match begin at any byte; otherwise it begins at the first byte read.
    """
    net = _Net()
    first, last = [], []
    for pattern, ignore_case in patterns:
        begin = net.state()
        first.append(begin)
        last.append(net.add(list(re._parser.parse(pattern)), begin, ignore_case, backward))
    sets = {s for moves in net.moves for s, _ in moves}
    kinds: dict[tuple[bool, ...], list[int]] = {}
    for byte in range(256):
        kinds.setdefault(tuple(byte in s for s in sets), []).append(byte)
    samples = [members[0] for members in kinds.values()]
    # sets of states as bits of a number: what each state reaches by a byte of each kind
    reach = [sum(1 << t for t in net.closure([q])) for q in range(len(net.free))]
    by_kind = [
        [_union(reach[t] for s, t in moves if byte in s) for byte in samples] for moves in net.moves
    ]
    begin = _union(reach[q] for q in first)
    always = begin if anywhere else 0
    numbered: dict[int, int] = {0: 0, begin: 1}
    rows = [[always] * len(samples)]
    todo = [begin]
    for here in todo:
        active = [by_kind[q] for q in range(here.bit_length()) if here >> q & 1 and net.moves[q]]
        row = [_union(reached) | always for reached in zip(*active, strict=True)] or [always] * len(samples)
        for reached in row:
            if reached not in numbered:
                numbered[reached] = len(numbered)
                todo.append(reached)
        rows.append(row)
    steps = np.array([[numbered[r] for r in row] for row in rows], np.int64)
    ends = np.array([sum(1 << k for k, q in enumerate(last) if s >> q & 1) for s in numbered], np.int64)
    group = _refined(steps, ends)
    keep = np.unique(group, return_index=True)[1]
    small = group[steps[keep]]
    table = np.zeros((len(keep), 256), np.uint16)
    for column, members in enumerate(kinds.values()):
        table[:, members] = small[:, column, None]
    table[:, SEPARATOR] = group[1] if anywhere else 0
    return Automaton(table.ravel(), ends[keep].astype(np.uint16), int(group[1]))


def _refined(steps: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The group of each state: states of a group cannot be told apart.  State 0 keeps group 0."""
    group = np.unique(np.where(np.arange(len(ends)) == 0, -1, ends), return_inverse=True)[1]
    while True:
        signature = np.column_stack([group, group[steps]])
        finer = np.unique(signature, axis=0, return_inverse=True)[1].ravel()
        if finer.max() == group.max():
            return group
        group = finer


def states_after(automaton: Automaton, data: np.ndarray) -> np.ndarray:
    """The automaton's state after each byte."""
    table, start = automaton.table, automaton.start
    lanes = max(1, -(-len(data) // _WIDTH))
    padded = np.full(lanes * _WIDTH, SEPARATOR, np.uint8)
    padded[: len(data)] = data
    columns = np.ascontiguousarray(padded.reshape(lanes, _WIDTH).T)
    found = np.empty((_WIDTH, lanes), np.uint16)
    state = np.full(lanes, start, np.uint16)
    for j in range(_WIDTH):
        state = table[state.astype(np.uint32) << 8 | columns[j]]
        found[j] = state
    assumed = np.full(lanes, start, np.uint16)
    while True:
        truth = np.concatenate([np.array([start], np.uint16), found[-1, :-1]])
        wrong = np.flatnonzero(truth != assumed)
        if not len(wrong):
            return found.T.reshape(-1)[: len(data)]
        state = truth[wrong]
        assumed[wrong] = state
        for j in range(_WIDTH):
            state = table[state.astype(np.uint32) << 8 | columns[j, wrong]]
            differs = state != found[j, wrong]
            if not differs.any():
                break
            wrong, state = wrong[differs], state[differs]
            found[j, wrong] = state
