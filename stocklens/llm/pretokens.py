"""Pre-tokenisation without regular expressions: where the pattern of the byte-level vocabularies splits.

The pattern is ``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+``.
Each code point becomes a symbol (letter, number, space, ...) by a table lookup, and each symbol is a
function from the states of a small transducer to its states.  Composing functions is associative, and
the functions that can arise are few, so they are numbered and composed by one table.  Blocks of text
are scanned side by side, their totals are combined by doubling, and every position then knows the
state before it.  State and symbol say whether a piece starts here or started one position ago.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache

import numpy as np

# symbols
OTHER_LETTER, ONE_LETTER, LETTER_R, LETTER_V, LETTER_E, LETTER_L = range(6)
NUMBER, QUOTE, OTHER, BLANK, SPACE, END, PADDING = range(6, 13)
_LETTERS = range(6)
#: Letters that end a short form after a quote: 's 't 'm 'd, and the first ones of 're 've 'll.
_SPECIAL = {"s": ONE_LETTER, "t": ONE_LETTER, "m": ONE_LETTER, "d": ONE_LETTER}
_SPECIAL |= {"r": LETTER_R, "v": LETTER_V, "e": LETTER_E, "l": LETTER_L, "'": QUOTE, " ": BLANK}

# states: what the last code point was part of
_START, _WORD, _DIGITS, _SIGNS, _QUOTED, _QUOTE_R, _QUOTE_V, _QUOTE_L, _SHORT, _BLANK, _SPACE = range(11)
_STATES = 11
_HERE, _BEFORE = 1, 2  # a piece starts at this position, at the position before

#: Code points of one scan; longer texts go through in blocks that hand on the state.
BLOCK = 1 << 20
#: Pieces handed out at once.
PIECES = 1 << 17
_WIDTH = 256


def _fresh(symbol: int) -> int:
    """The state after a symbol that opens a piece."""
    if symbol in _LETTERS:
        return _WORD
    return {NUMBER: _DIGITS, QUOTE: _QUOTED, OTHER: _SIGNS, BLANK: _BLANK, SPACE: _SPACE, END: _START}[symbol]


def _step(state: int, symbol: int) -> tuple[int, int]:
    """Next state, and where pieces start."""
    is_letter, is_space = symbol in _LETTERS, symbol in (BLANK, SPACE)
    fresh = _fresh(symbol)
    if symbol == END:
        return _START, _HERE | (_BEFORE if state in (_QUOTE_R, _QUOTE_V, _QUOTE_L) else 0)
    if state == _WORD and is_letter or state == _DIGITS and symbol == NUMBER:
        return state, 0
    if state == _SIGNS and symbol in (QUOTE, OTHER):
        return _SIGNS, 0
    if state == _QUOTED:
        if symbol in (QUOTE, OTHER):
            return _SIGNS, 0
        short = {ONE_LETTER: _SHORT, LETTER_R: _QUOTE_R, LETTER_V: _QUOTE_V, LETTER_L: _QUOTE_L}
        if symbol in short:
            return short[symbol], 0
    if state in (_QUOTE_R, _QUOTE_V, _QUOTE_L):
        if symbol == (LETTER_L if state == _QUOTE_L else LETTER_E):
            return _SHORT, 0
        # no short form after all: the letter before opened a word
        return (_WORD, _BEFORE) if is_letter else (fresh, _BEFORE | _HERE)
    if state in (_BLANK, _SPACE):
        if is_space:
            return fresh, 0
        if state == _SPACE:  # the last space of the run stands alone
            return fresh, _BEFORE | _HERE
        return (_SIGNS if symbol == QUOTE else fresh), _BEFORE  # the blank joins what follows
    return fresh, _HERE


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Element of each symbol, composition of elements, state by (element, state), starts by (state, symbol)."""
    identity = tuple(range(_STATES))
    generators = [tuple(_step(q, x)[0] for q in range(_STATES)) for x in range(END + 1)] + [identity]
    numbered: dict[tuple[int, ...], int] = {}
    todo = list(dict.fromkeys(generators))
    while todo:
        function = todo.pop()
        if function in numbered:
            continue
        numbered[function] = len(numbered)
        todo += [tuple(g[q] for q in function) for g in generators]
    if len(numbered) > 256:
        raise AssertionError("elements must fit a byte")
    elements = list(numbered)
    compose = np.zeros((len(elements), 256), np.uint8)
    for i, first in enumerate(elements):
        for j, second in enumerate(elements):
            compose[i, j] = numbered[tuple(second[q] for q in first)]
    apply = np.zeros((len(elements), 16), np.uint8)
    apply[:, :_STATES] = elements
    starts = np.zeros((16, 16), np.uint8)
    for q in range(_STATES):
        starts[q, : END + 1] = [_step(q, x)[1] for x in range(END + 1)]
    return np.array([numbered[g] for g in generators], np.uint8), compose.ravel(), apply.ravel(), starts.ravel()


def _scan(symbols: np.ndarray, state: int) -> tuple[np.ndarray, int]:
    """Starts by position, and the state after the last symbol."""
    element, compose, apply, starts = _tables()
    lanes = -(-len(symbols) // _WIDTH)
    padded = np.full(lanes * _WIDTH, PADDING, np.uint8)
    padded[: len(symbols)] = symbols
    columns = np.ascontiguousarray(element[padded].reshape(lanes, _WIDTH).T)
    before = np.empty((_WIDTH, lanes), np.uint8)  # composed from the lane's first symbol on
    total = np.full(lanes, element[PADDING], np.uint8)
    for j in range(_WIDTH):
        before[j] = total
        total = compose[(total.astype(np.uint16) << 8) | columns[j]]
    reach = 1
    while reach < lanes:  # doubling: totals become composed from the block's first lane on
        joined = compose[(total[:-reach].astype(np.uint16) << 8) | total[reach:]]
        total = np.concatenate([total[:reach], joined])
        reach *= 2
    after_lane = apply[(total.astype(np.uint16) << 4) | state]
    at_lane = np.concatenate([np.array([state], np.uint8), after_lane[:-1]])
    states = apply[(before.astype(np.uint16) << 4) | at_lane]
    found = starts[(states.T.reshape(-1)[: len(symbols)] << 4) | symbols]
    return found, int(after_lane[-1])


def boundaries(symbols: np.ndarray, state: int = _START) -> np.ndarray:
    """Positions where a piece starts; ``END`` symbols are pieces of their own."""
    parts = []
    for begin in range(0, len(symbols), BLOCK):
        found, state = _scan(symbols[begin : begin + BLOCK], state)
        starts = (found & _HERE).astype(bool)
        starts[:-1] |= (found[1:] & _BEFORE).astype(bool)
        if begin and found[0] & _BEFORE and begin - 1 not in parts[-1][-1:]:
            parts.append(np.array([begin - 1]))
        parts.append(np.flatnonzero(starts) + begin)
    return np.concatenate(parts) if parts else np.empty(0, np.int64)


def symbol_table(letters: np.ndarray, numbers: np.ndarray, spaces: np.ndarray) -> np.ndarray:
    """The symbol of every code point, from the code points of three classes."""
    table = np.full(0x110000, OTHER, np.uint8)
    table[letters], table[numbers], table[spaces] = OTHER_LETTER, NUMBER, SPACE
    for character, symbol in _SPECIAL.items():
        table[ord(character)] = symbol
    return table


def _every_code_point() -> str:
    return "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))


@lru_cache(maxsize=1)
def rank_file_symbols() -> np.ndarray:
    """The table by the character classes of the library for rank files, found by asking it.

    Text outside a pattern's matches is not encoded, so a pattern of one class returns its members.
    """
    import tiktoken

    single = {bytes([i]): i for i in range(256)}

    def members(pattern: str) -> np.ndarray:
        probe = tiktoken.Encoding("probe", pat_str=pattern, mergeable_ranks=single, special_tokens={})
        found = bytes(probe.encode_ordinary(_every_code_point())).decode()
        return np.frombuffer(found.encode("utf-32-le"), np.uint32)

    return symbol_table(members(r"\p{L}"), members(r"\p{N}"), members(r"\s"))


@lru_cache(maxsize=1)
def merge_file_symbols() -> np.ndarray:
    """The table by the character classes of the library for merge files, found by asking it."""
    from tokenizers import Regex, pre_tokenizers

    def members(pattern: str) -> np.ndarray:
        split = pre_tokenizers.Split(Regex(f"(?:{pattern})+"), behavior="removed", invert=True)
        found = "".join(piece for piece, _ in split.pre_tokenize_str(_every_code_point()))
        return np.frombuffer(found.encode("utf-32-le"), np.uint32)

    return symbol_table(members(r"\p{L}"), members(r"\p{N}"), members(r"\s"))


def in_groups(texts: Sequence[str], limit: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Ranges of texts with about ``limit`` code points; a longer text is a group by itself."""
    begin, held = 0, 0
    for i, text in enumerate(texts):
        if held and held + len(text) > limit:
            yield begin, i
            begin, held = i, 0
        held += len(text) + 1
    if begin < len(texts):
        yield begin, len(texts)


def pieces_of(
    texts: Sequence[str], table: np.ndarray
) -> Iterator[tuple[list[str], list[tuple[int, int, int]]]]:
    """Lists of pieces, each with (number of the text, begin, end) of the stretches that are texts'.

    A list holds at most ``PIECES``: short texts share one, a long text comes in several.
    """
    for begin, end in in_groups(texts):
        joined = "\n".join([*texts[begin:end], ""])
        symbols = table[np.frombuffer(joined.encode("utf-32-le"), np.uint32)]
        ends = np.cumsum([len(t) + 1 for t in texts[begin:end]]) - 1
        symbols[ends] = END
        starts = boundaries(symbols)
        del symbols
        cuts = np.searchsorted(starts, ends).tolist()
        number = 0
        for some in range(0, len(starts), PIECES):
            stop = min(some + PIECES, len(starts))
            at = [*starts[some : stop + 1].tolist(), len(joined)][: stop - some + 1]
            pieces = [joined[i:j] for i, j in zip(at, at[1:], strict=False)]
            stretches = []
            first = 0
            while number < len(cuts) and cuts[number] < stop:
                stretches.append((begin + number, first, cuts[number] - some))
                first = cuts[number] - some + 1
                number += 1
            if number < len(cuts) and first < stop - some:
                stretches.append((begin + number, first, stop - some))
            yield pieces, stretches
