"""Toxicity: disguised words are restored by a noisy-channel decoder, then the restored text is scored.

*Restoring.*  Three disguises open a lattice of readings: digits and signs that look like letters, anywhere in a
word or as all of it (``1d10t``, ``a55``, ``@$$``; numbers are none), letters set apart (``i d i o t``), and letters repeated three times or more
(``idiiiot``).  Viterbi finds the reading that is likeliest under a trigram model of characters and the
cost of each disguise.  A word without a disguise has one reading, itself.

*Scoring.*  The features of a word are the word and its beginnings of three to six letters.  Each has the
log odds of standing in toxic rather than other labelled texts; a word counts its strongest feature.  The
three strongest different words and the length of the text go through a logistic model.

The language model is counted over all texts.  Odds and weights are fitted on a bounded sample of labelled rows (``FIT_ROWS``; of
texts above ``FIT_CHARS`` parts from all over them); very long texts are scored whole, and of equally likely readings the first
one met is taken; when a label is given to a text, its own occurrence is taken out of the odds.  Missing
and empty texts have no words and still get a score; repeated texts get equal scores; an empty table
gives an empty result; without labels of both kinds every score is the labels' mean, or 0.  Other columns
of the input are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stocklens.llm.labelled import sample_of, usable_labels
from stocklens.llm.tasks import BYTES, ROWS, by_batches, each_text, enter_stage, small_batches, text_rows
from stocklens.session import ship_package

#: Rows of each label, and characters of a text, that the fit may see.
FIT_ROWS, FIT_CHARS = 5_000, 40_000
#: A feature needs so many toxic texts of the sample.
_LEAST = 3
_LETTERS = 96
_OTHER = _LETTERS - 1
_WHOLE = 14
_SIEVE = 42
_PREFIXES = (3, 4, 5, 6)
#: More different signs, in more places, than a disguised word has.
_MANY_SIGNS = 8
_SPACE_COST, _SIGN_COST, _REPEAT_COST, _KEEP_COST = 0.2, 0.7, 0.4, 4.0
#: Numbers and exclamation marks are usual after a word (``mp3``), so that they stay costs less there.
_USUAL_ENDS, _END_COST = "0123456789!", 2.0

#: The letters a sign may stand for.
LOOKS_LIKE = {
    "0": "o",
    "1": "il",
    "2": "z",
    "3": "e",
    "4": "a",
    "5": "s",
    "6": "g",
    "7": "t",
    "8": "b",
    "9": "g",
    "@": "a",
    "$": "s",
    "!": "i",
    "|": "il",
    "+": "t",
    "€": "e",
}

_SIGNS = re.escape("".join(LOOKS_LIKE))
#: What may stand between letters set apart, and how much of it.
_BETWEEN, _GAP_MOST = " \t.-_*/", 3
_GAPS = re.compile(rf"([{re.escape(_BETWEEN)}]+)")
_NEITHER, _LETTER, _SIGN, _GAP = range(4)


@lru_cache(maxsize=1)
def _kinds() -> np.ndarray:
    """Of every code point: letter, sign that looks like one, gap or neither."""
    found = np.zeros(0x110000, np.uint8)
    found[[i for i in range(0x110000) if chr(i).isalpha()]] = _LETTER
    found[[ord(c) for c in LOOKS_LIKE]] = _SIGN
    found[[ord(c) for c in _BETWEEN]] = _GAP
    return found


def _runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of each stretch that is true."""
    edges = np.diff(mask.view(np.int8), prepend=np.int8(0), append=np.int8(0))
    return np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)


def _suspects(codes: np.ndarray) -> list[tuple[int, int]]:
    """Stretches that may hide a word, found without looking at single words."""
    kinds = _kinds()[codes]
    letter = kinds == _LETTER
    in_run = letter | (kinds == _SIGN)
    begin, end = _runs(in_run)
    thrice = np.flatnonzero(letter[:-2] & (codes[:-2] == codes[1:-1]) & (codes[1:-1] == codes[2:]))
    stretched = np.zeros(len(begin), bool)
    stretched[np.searchsorted(begin, thrice, side="right") - 1] = True
    letters = np.concatenate([[0], np.cumsum(letter)])
    letters = letters[end] - letters[begin]
    marked = stretched | ((letters > 0) & (letters < end - begin))
    # signs alone: neither a number nor one sign repeated
    other_signs = np.concatenate([[0], np.cumsum(in_run & ~letter & ((codes < 48) | (codes > 57)))])
    changes = np.concatenate([[0, 0], np.cumsum(codes[1:] != codes[:-1])])
    bare = (letters == 0) & (end - begin >= 3) & (other_signs[end] > other_signs[begin])
    marked |= bare & (changes[end] > changes[begin + 1])
    found = list(zip(begin[marked].tolist(), end[marked].tolist(), strict=True))
    alone = begin[end - begin == 1]  # single characters with nothing but a short gap in between
    gaps = np.concatenate([[0], np.cumsum(kinds == _GAP)])
    apart = np.diff(alone) - 1
    near = (apart >= 1) & (apart <= _GAP_MOST) & (gaps[alone[1:]] - gaps[alone[:-1] + 1] == apart)
    first, last = _runs(near)
    for i, j in zip(alone[first].tolist(), (alone[last] + 1).tolist(), strict=True):
        if j - i >= 5 and letter[i:j].sum() >= 2:
            found.append((i, j))
    return sorted(found)


@dataclass
class LanguageModel:
    """Log probabilities of a letter after two others; 0 stands for the edge of a word, ``_OTHER`` for all rarer letters."""

    letters: dict[str, int]
    log_odds: np.ndarray

    def __post_init__(self) -> None:
        self.after = lru_cache(maxsize=200_000)(self._after)  # goes when the model goes

    def __reduce__(self) -> tuple:
        return LanguageModel, (self.letters, self.log_odds)

    def _after(self, first: str, second: str, third: str) -> float:
        return float(self.log_odds[self._code(first), self._code(second), self._code(third)])

    def _code(self, letter: str) -> int:
        return self.letters.get(letter, _OTHER if letter.isalpha() else 0)


def _letters_of(texts: Sequence[str]) -> Counter:
    """How often each letter (a code point) stands in lower-case texts."""
    letters: Counter = Counter()
    for codes in _codes(texts):
        found, n = np.unique(codes[_kinds()[codes] == _LETTER], return_counts=True)
        letters.update(dict(zip(found.tolist(), n.tolist(), strict=True)))
    return letters


def _ranked(letters: Mapping[int, int]) -> list[int]:
    """The letters that get a code of their own: those that signs stand for, and the most frequent others."""
    if not letters:
        return []
    read = sorted({ord(c) for readings in LOOKS_LIKE.values() for c in readings})
    others = [code for code, _ in sorted(letters.items(), key=lambda x: (-x[1], x[0])) if code not in read]
    return [*read, *others[: _OTHER - 1 - len(read)]]


def _triples_of(texts: Sequence[str], ranked: Sequence[int]) -> np.ndarray:
    """Counts of letter triples over the words of lower-case texts, a few texts at a time."""
    index = np.full(0x110000, _OTHER, np.int64)
    index[list(ranked)] = np.arange(1, len(ranked) + 1)
    counts = np.zeros(_LETTERS**3, np.int64)
    for codes in _codes(texts):
        inside = np.concatenate([[False, False], _kinds()[codes] == _LETTER, [False]])
        c = np.where(inside, np.concatenate([[0, 0], index[codes], [0]]), 0)
        before = np.where(inside[1:-1], c[:-2], 0)  # nothing of the word before stands before its edge
        of_word = inside[2:] | inside[1:-1]
        triple = (before * _LETTERS + c[1:-1]) * _LETTERS + c[2:]
        found, n = np.unique(triple[of_word], return_counts=True)
        counts[found] += n
    return counts


def _smoothed(ranked: Sequence[int], counts: np.ndarray) -> LanguageModel:
    counts = counts.reshape((_LETTERS,) * 3).astype(float)
    two, one = counts.sum(0), counts.sum((0, 1))
    base = (one + 1) / (one.sum() + _LETTERS)
    mid = (two + 5 * base) / (two.sum(1, keepdims=True) + 5)
    full = (counts + 5 * mid) / (counts.sum(2, keepdims=True) + 5)
    return LanguageModel({chr(code): i for i, code in enumerate(ranked, 1)}, np.log(full))


def language_model(texts: Sequence[str]) -> LanguageModel:
    """Counted over texts that are at hand."""
    ranked = _ranked(_letters_of(texts))
    return _smoothed(ranked, _triples_of(texts, ranked))


def counted_language(docs: DataFrame, text_column: str = "text") -> LanguageModel:
    """Counted over all texts of ``docs``: each partition sums up its own; only a table of fixed size comes back."""
    ship_package(docs.sparkSession)
    small_batches(docs.sparkSession)
    texts = docs.select(F.coalesce(F.col(f"`{text_column}`").cast("string"), F.lit("")).alias("text"))

    def summed(part: Callable[[Sequence[str]], Iterable[tuple[int, int]]]) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            enter_stage()
            total: Counter = Counter()
            for batch in batches:
                step = max(1, min(ROWS, batch.num_rows * BYTES // max(1, batch.nbytes)))
                for begin in range(0, batch.num_rows, step):
                    for key, n in part(batch.column(0).slice(begin, step).to_pylist()):
                        total[key] += n
            columns = [pa.array(list(total), pa.int64()), pa.array(list(total.values()), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["key", "n"])

        return texts.mapInArrow(run, "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n"))

    # the table holds no more letters than these
    letters = summed(lambda some: _letters_of(some).items()).orderBy(F.desc("n"), "key").limit(_OTHER - 1)
    ranked = _ranked({r["key"]: r["n"] for r in letters.collect()})

    def triples(some: Sequence[str]) -> Iterable[tuple[int, int]]:
        counts = _triples_of(some, ranked)
        found = np.flatnonzero(counts)
        return zip(found.tolist(), counts[found].tolist(), strict=True)

    counts = np.zeros(_LETTERS**3, np.int64)
    for r in summed(triples).toLocalIterator():
        counts[r["key"]] = r["n"]
    return _smoothed(ranked, counts)


def _codes(texts: Sequence[str]):
    for begin in range(0, len(texts), 200):
        joined = "\n".join(texts[begin : begin + 200]).lower()
        if joined:
            yield np.frombuffer(joined.encode("utf-32-le"), np.uint32)


def _readings(c: str, keep: float = _KEEP_COST) -> list[tuple[str, float]]:
    if c in LOOKS_LIKE:
        return [(c, keep), *((x, _SIGN_COST) for x in LOOKS_LIKE[c])]
    return [(c, 0.0)]


def _lattice(token: str) -> list[list[tuple[str, float]]]:
    """Per step the readings and their costs; an empty reading leaves the step out."""
    if _GAPS.search(token):
        # a gap between letters is the disguise; two words set apart so are left to the model
        gap = [("", _SPACE_COST), (" ", 2.0)]
        return [gap if i % 2 else _readings(c) for i, c in enumerate(_GAPS.split(token))]
    steps: list[list[tuple[str, float]]] = []
    tail = len(token.rstrip(_USUAL_ENDS))
    for run in re.finditer(r"(.)\1*", token, re.DOTALL):
        c, n = run[1], len(run[0])
        readings = _readings(c, _END_COST if run.start() >= tail else _KEEP_COST)
        if n == 1:
            steps.append(readings)
        elif n == 2:
            steps += [readings, readings]
        else:
            steps.append([(x * k, cost + (_REPEAT_COST if k == 1 else 2 * _REPEAT_COST)) for x, cost in readings for k in (1, 2)])
    return steps


def restored_word(token: str, model: LanguageModel) -> str:
    """The likeliest reading of a disguised word, or of a stretch of any length.

    A state is the last two letters, so the work grows with the length alone; each state points back at
    the reading before.
    """
    best: dict[tuple[str, str], tuple[float, tuple]] = {("", ""): (0.0, ())}
    for readings in _lattice(token):
        reached: dict[tuple[str, str], tuple[float, tuple]] = {}
        for (first, second), (score, before) in best.items():
            for reading, cost in readings:
                value, a, b = score - cost, first, second
                for c in reading:
                    if c == " " or c in LOOKS_LIKE:  # a word ends, or a sign stays as it is and ends it
                        value, a, b = value + (model.after(a, b, "") if b else 0.0), "", ""
                    else:
                        value, a, b = value + model.after(a, b, c), b, c
                if (a, b) not in reached or value > reached[a, b][0]:
                    reached[a, b] = value, (before, reading)
        best = reached
    ended = ((score + (model.after(a, b, "") if b else 0.0), back) for (a, b), (score, back) in best.items())
    _, back = max(ended, key=lambda x: x[0])
    parts = []
    while back:
        back, reading = back
        parts.append(reading)
    return "".join(reversed(parts))


def _is_identifier(token: str) -> bool:
    """A key, digest or number in other digits: digits and letters change places all along, as in no word.

    Of a disguised word most characters are letters, or each sign stands for one of few letters.
    """
    plain = re.sub(r"(.)\1+", r"\1", token, flags=re.DOTALL)
    pieces = len(re.findall(rf"[{_SIGNS}]+", plain))
    return len(set(plain) & set(LOOKS_LIKE)) >= _MANY_SIGNS and pieces >= _MANY_SIGNS


#: Disguised words whose reading one task remembers, and their characters; longer ones are read each time.
_CACHED, _CACHED_CHARS = 50_000, 64


def restored(texts: Sequence[str], model: LanguageModel, cache: dict[str, str]) -> list[str]:
    """The lower-case texts with every disguised word read as the decoder reads it."""
    lower = [t.lower() for t in texts]
    joined = "\n".join([*lower, ""])
    ends = np.cumsum([len(t) + 1 for t in lower])
    changes: dict[int, list[tuple[int, int, str]]] = {}
    for begin, end in _suspects(np.frombuffer(joined.encode("utf-32-le"), np.uint32)):
        token = joined[begin:end]
        if token[1] not in _BETWEEN and _is_identifier(token):
            continue  # which hides no word
        word = cache.get(token)
        if word is None:
            word = restored_word(token, model)
            if len(token) <= _CACHED_CHARS:
                if len(cache) >= _CACHED:
                    cache.clear()
                cache[token] = word
        number = int(np.searchsorted(ends, begin, side="right"))
        first = int(ends[number]) - len(lower[number]) - 1
        changes.setdefault(number, []).append((begin - first, end - first, word))
    for number, found in changes.items():
        parts, after = [], 0
        for begin, end, word in found:
            parts += [lower[number][after:begin], word]
            after = end
        lower[number] = "".join([*parts, lower[number][after:]])
    return lower


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def word_features(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Number of the text of each word, and the word's features as hashes [word, feature]; 0 for none.

    The first feature stands for the word itself (its beginning and its length).
    """
    joined = " ".join([*texts, ""])
    codes = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    begin, end = _runs(_kinds()[codes] == _LETTER)
    text_ends = np.cumsum([len(t) + 1 for t in texts])
    owner = np.searchsorted(text_ends, begin, side="right")
    size = end - begin
    value = np.full(len(begin), 1469598103934665603, np.uint64)
    features = np.zeros((len(begin), 1 + len(_PREFIXES)), np.uint64)
    padded = np.concatenate([codes, np.zeros(_WHOLE, np.uint32)]).astype(np.uint64)
    for j in range(_WHOLE):
        inside = size > j
        grown = (value ^ padded[begin + j]) * np.uint64(1099511628211)
        value = np.where(inside, grown, value)
        if j + 1 in _PREFIXES:
            place = 1 + _PREFIXES.index(j + 1)
            features[:, place] = np.where(inside, _mixed(value + np.uint64(j)) | np.uint64(1), 0)
    features[:, 0] = _mixed(value ^ (size.astype(np.uint64) << np.uint64(40))) & ~np.uint64(1)
    return owner, features


@dataclass
class Model:
    language: LanguageModel
    features: np.ndarray  # hashes in order
    toxic: np.ndarray  # texts of the sample with the feature, by label
    other: np.ndarray
    sizes: tuple[int, int]
    weights: np.ndarray = field(default_factory=lambda: np.zeros(5))
    constant: float | None = None

    def sieve(self) -> np.ndarray:
        """Which leading bits the features have; most words of a text fall through."""
        if not hasattr(self, "_sieve"):
            self._sieve = np.zeros(1 << (64 - _SIEVE), bool)
            self._sieve[(self.features >> np.uint64(_SIEVE)).astype(np.int64)] = True
        return self._sieve


def _evidence(toxic, other, sizes: tuple[int, int]) -> np.ndarray:
    """Log odds, pulled towards none by half a text on both sides; features too rare have none."""
    odds = np.log((toxic + 0.3) / (sizes[0] + 1)) - np.log((other + 0.3) / (sizes[1] + 1))
    return np.where(toxic >= _LEAST - 1, np.maximum(odds, 0), 0)


def text_features(texts: Sequence[str], model: Model, labels: np.ndarray | None = None) -> np.ndarray:
    """Per text: evidence of its three strongest different words, log of its words, 1."""
    result = np.zeros((len(texts), 5))
    result[:, 4] = 1
    owner, features = word_features(texts)
    result[:, 3] = np.log1p(np.bincount(owner, minlength=len(texts))) / 4
    if not len(owner) or not len(model.features):
        return result
    word, which = np.nonzero(model.sieve()[(features >> np.uint64(_SIEVE)).astype(np.int64)])
    wanted = features[word, which]
    at = np.minimum(np.searchsorted(model.features, wanted), len(model.features) - 1)
    known = model.features[at] == wanted
    word, at = word[known], at[known]
    if not len(word):
        return result
    toxic, other = model.toxic[at].astype(float), model.other[at].astype(float)
    if labels is not None:  # without the text itself
        own = labels[owner[word]] == 1
        toxic, other = toxic - own, other - ~own
    evidence = np.zeros(len(owner))
    np.maximum.at(evidence, word, _evidence(toxic, np.maximum(other, 0), model.sizes))
    strong = np.flatnonzero(evidence > 0)
    order = strong[np.lexsort((features[strong, 0], -evidence[strong], owner[strong]))]
    before, seen = -1, set()
    rank = 0
    for i in order.tolist():
        if owner[i] != before:
            before, seen, rank = owner[i], set(), 0
        if rank < 3 and features[i, 0] not in seen:
            seen.add(features[i, 0])
            result[before, rank] = evidence[i]
            rank += 1
    return result


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fitted(
    texts: Sequence[str], labels: Sequence[int], share: float, language: LanguageModel | None = None
) -> Model:
    """``share``: the toxic share of all labelled rows, as the sample holds both labels about evenly.

    Without ``language`` letters are counted over the sample.
    """
    y = np.asarray(labels, int)
    language = language or language_model(texts)
    sizes = (int((y == 1).sum()), int((y == 0).sum()))
    empty = np.empty(0, np.uint64)
    if not all(sizes):
        return Model(language, empty, empty, empty, sizes, constant=float(share))
    cache: dict[str, str] = {}
    read = [r for i in range(0, len(texts), 200) for r in restored(texts[i : i + 200], language, cache)]
    toxic_hashes, toxic_counts = _texts_by_feature([t for t, k in zip(read, y, strict=True) if k == 1], None)
    keep = toxic_counts >= _LEAST
    hashes, toxic_counts = toxic_hashes[keep], toxic_counts[keep]
    found, counts = _texts_by_feature([t for t, k in zip(read, y, strict=True) if k == 0], hashes)
    other_counts = np.zeros(len(hashes), np.int64)
    other_counts[np.searchsorted(hashes, found)] = counts
    useful = _evidence(toxic_counts, other_counts, sizes) > 0.5
    model = Model(language, hashes[useful], toxic_counts[useful], other_counts[useful], sizes)
    x = np.concatenate(
        [text_features(read[i : i + 500], model, y[i : i + 500]) for i in range(0, len(read), 500)]
    )
    weight = np.where(y == 1, share / sizes[0], (1 - share) / sizes[1]) * len(y)
    model.weights = _logistic(x, y, weight)
    return model


def _texts_by_feature(texts: Sequence[str], only: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Features and how many texts have them; ``only`` names those of interest, in order."""
    parts = []
    for i in range(0, len(texts), 500):
        owner, features = word_features(texts[i : i + 500])
        owners = np.repeat(owner, features.shape[1])
        flat = features.ravel()
        keep = flat > 0
        if only is not None:
            place = np.minimum(np.searchsorted(only, flat), max(0, len(only) - 1))
            keep &= only[place] == flat if len(only) else False
        owners, flat = owners[keep], flat[keep]
        order = np.lexsort((owners, flat))
        owners, flat = owners[order], flat[order]
        first = np.ones(len(flat), bool)
        first[1:] = (flat[1:] != flat[:-1]) | (owners[1:] != owners[:-1])
        parts.append(np.unique(flat[first], return_counts=True))
    if not parts:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    hashes, place = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return hashes, np.bincount(place, np.concatenate([p[1] for p in parts])).astype(np.int64)


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.5) -> np.ndarray:
    """Weighted logistic regression by Newton's method with a small ridge."""
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = _sigmoid(x @ w)
        slope = x.T @ (weight * (p - y)) + ridge * w
        bend = (x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + ridge * np.eye(len(w))
        move = np.linalg.solve(bend, slope)
        w = w - np.clip(move, -5, 5)
        if np.abs(move).max() < 1e-6:
            break
    return w


def score(texts: Sequence[str], model: Model, cache: dict[str, str]) -> np.ndarray:
    if model.constant is not None:
        return np.full(len(texts), model.constant)
    result = np.empty(len(texts))
    begin = 0
    while begin < len(texts):
        end, held = begin, 0
        while end < len(texts) and (not held or held + len(texts[end]) <= 1 << 20):
            held += len(texts[end]) + 1
            end += 1
        read = restored(texts[begin:end], model.language, cache)
        result[begin:end] = _sigmoid(text_features(read, model) @ model.weights)
        begin = end
    return result


def fit(
    docs: DataFrame, labels: DataFrame, label: str = "toxic", divisor: int = 4, left_out: int = 2
) -> Model:
    """A model of all letters, fitted on the bounded sample; ids whose remainder is ``left_out`` stay unseen."""
    usable = usable_labels(labels, label, divisor, left_out)
    share = usable.agg(F.avg("label")).first()[0]
    texts = text_rows(docs)
    sample = [
        sample_of(texts, usable.filter(F.col("label") == value), FIT_ROWS, FIT_CHARS)
        .select("doc_id", "text", "label")
        .toPandas()
        for value in (1, 0)
    ]
    rows = [r for s in sample for r in s.sort_values(["doc_id", "text"]).itertuples(index=False)]
    return fitted([r.text for r in rows], [r.label for r in rows], share or 0.0, counted_language(docs))


def scored(
    docs: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """``doc_id`` and ``score`` of every text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(rows: dict[str, list]) -> dict[str, list]:
        return {"doc_id": rows["doc_id"], "score": score(rows["text"], shared.value, {})}

    kind = docs.schema[id_column].dataType.simpleString()
    return by_batches(text_rows(docs, id_column, text_column), run, f"doc_id {kind}, score double")


def without_toxic(docs: DataFrame, model: Model, least: float, text_column: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text scores below ``least``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(texts: list[str]) -> tuple[None, list[bool]]:
        return None, (score(texts, shared.value, {}) < least).tolist()

    return each_text(docs, run, text_column)
