"""Pair merging of many pieces at once, by the merge rules of a byte-level vocabulary.

A piece begins as its bytes; the leftmost pair of lowest rank is replaced by its token until no pair
has a rank.  Pieces of like length stand in one array and are merged in step; very long pieces keep
their pairs in a heap instead, so their cost stays near proportional to their length.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Sequence

import numpy as np

_NONE = np.int64(1) << 40
#: Bytes from which a piece is merged by itself.
LONG = 64
_ROWS = 1 << 14


class MergeTable:
    """Rank and token of each pair of tokens that merges, and the token of each single byte."""

    def __init__(self, pairs: Iterable[tuple[int, int, int, int]], single: Sequence[int]) -> None:
        """``pairs``: left token, right token, rank, token made."""
        table = np.array(list(pairs), np.int64).reshape(-1, 4)
        keys = (table[:, 0] << 32) | table[:, 1]
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], table[order, 2], table[order, 3]
        self.single = np.array(single, np.int64)

    def _find(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (``_NONE`` if the pair does not merge) and place in the table."""
        if not len(self.keys):
            return np.full(left.shape, _NONE), np.zeros(left.shape, np.int64)
        wanted = (left << 32) | right
        place = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        known = (self.keys[place] == wanted) & (left >= 0) & (right >= 0)
        return np.where(known, self.ranks[place], _NONE), place

    def merge(self, pieces: Sequence[bytes]) -> list[bytes]:
        """The tokens of each piece, as little-endian unsigned 32-bit integers."""
        result: list[bytes] = [b""] * len(pieces)
        by_width: dict[int, list[int]] = {}
        for i, piece in enumerate(pieces):
            if len(piece) > LONG:
                result[i] = self._merge_long(piece)
            else:
                by_width.setdefault(-(-len(piece) // 8) * 8, []).append(i)
        for width, members in by_width.items():
            for begin in range(0, len(members), _ROWS):
                some = members[begin : begin + _ROWS]
                for i, tokens in zip(some, self._in_step([pieces[i] for i in some], width), strict=True):
                    result[i] = tokens
        return result

    def _in_step(self, pieces: list[bytes], width: int) -> list[bytes]:
        if not width:
            return [b""] * len(pieces)
        sizes = np.array([len(p) for p in pieces])
        raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(-1, width)
        columns = np.arange(width)
        tokens = np.where(columns < sizes[:, None], self.single[raw], -1)
        ranks, _ = self._find(tokens[:, :-1], tokens[:, 1:])
        done = [b""] * len(pieces)
        rows = np.arange(len(pieces))
        while len(rows):
            at = ranks.argmin(1)
            line = np.arange(len(rows))
            open_ = ranks[line, at] < _NONE
            flat = tokens[~open_].astype("<u4").tobytes()
            ended = zip(rows[~open_].tolist(), (4 * sizes[~open_]).tolist(), strict=True)
            for i, (row, size) in enumerate(ended):
                done[row] = flat[4 * width * i : 4 * width * i + size]
            rows, tokens, ranks, sizes, at = rows[open_], tokens[open_], ranks[open_], sizes[open_], at[open_]
            if not len(rows):
                break
            line = np.arange(len(rows))
            _, place = self._find(tokens[line, at], tokens[line, at + 1])
            moved = columns[None, :] + (columns[None, :] > at[:, None])  # what follows moves up by one
            tokens = np.take_along_axis(np.pad(tokens, ((0, 0), (0, 1)), constant_values=-1), moved, 1)
            ranks = np.take_along_axis(
                np.pad(ranks, ((0, 0), (0, 2)), constant_values=_NONE), moved[:, :-1], 1
            )
            tokens[line, at] = self.made[place]
            sizes = sizes - 1
            before = np.maximum(at - 1, 0)
            again, _ = self._find(tokens[line, before], tokens[line, before + 1])
            ranks[line, before] = again
            inside = at < width - 1
            again, _ = self._find(tokens[line[inside], at[inside]], tokens[line[inside], at[inside] + 1])
            ranks[line[inside], at[inside]] = again
        return done

    def _merge_long(self, piece: bytes) -> bytes:
        tokens = self.single[np.frombuffer(piece, np.uint8)]
        ranks, place = self._find(tokens[:-1], tokens[1:])
        heap = [
            (rank, i, left, right)
            for i, (rank, left, right) in enumerate(
                zip(ranks.tolist(), tokens[:-1].tolist(), tokens[1:].tolist(), strict=True)
            )
            if rank < _NONE
        ]
        heapq.heapify(heap)
        count, alive = len(tokens), tokens.tolist()
        before, after = list(range(-1, count - 1)), list(range(1, count + 1))
        lookup = self._lookup()
        while heap:
            _, i, left, right = heapq.heappop(heap)
            j = after[i]
            if alive[i] != left or j >= count or alive[j] != right:
                continue  # one of the two has been merged meanwhile
            alive[i], alive[j] = lookup[left, right][1], -1
            after[i] = after[j]
            if after[j] < count:
                before[after[j]] = i
            for k in (before[i], i):
                if k >= 0 and after[k] < count:
                    pair = (alive[k], alive[after[k]])
                    if pair in lookup:
                        heapq.heappush(heap, (lookup[pair][0], k, *pair))
        return np.array([t for t in alive if t >= 0], "<u4").tobytes()

    def _lookup(self) -> dict[tuple[int, int], tuple[int, int]]:
        """The table as a dictionary, built when the first long piece needs it."""
        if not hasattr(self, "_by_pair"):
            left, right = (self.keys >> 32).tolist(), (self.keys & 0xFFFFFFFF).tolist()
            values = zip(self.ranks.tolist(), self.made.tolist(), strict=True)
            self._by_pair = dict(zip(zip(left, right, strict=True), values, strict=True))
        return self._by_pair
