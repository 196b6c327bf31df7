"""Near duplicates by BagMinHash: signatures whose agreement estimates the weighted Jaccard similarity.

A text is the multiset of its runs of five words (a shorter text is one run).  A shingle that stands w
times covers the levels 0 to w-1.  Levels fall into blocks of doubling size, and each (shingle, block) has
a Poisson process of its own whose points carry a level and a slot of the signature: the same points in
every text.  A slot keeps the earliest point whose level the text covers.  Two texts share it with a
probability of exactly their weighted Jaccard similarity.  Points are drawn in order of time only up to
the time by which all slots are surely taken, so a text costs one draw per shingle and a few hundred more.

Slots are joined in bands.  Texts that share a band are compared by their true multisets, and pairs of a
similarity of ``THRESHOLD`` or more are linked.  Nothing is compared all against all: a band's others are
first compared with the text that stands in the most and largest bands, which lies in the middle of its
group.  Where texts of a band are still in different components, further centres follow, until every two
texts of a band are in one component, have been compared, or surely differ in too many shingles to be
linked: a sketch of fixed size holds, of each of ``SKETCH`` classes of shingles, whether a text has an odd number of
them, and two texts differ in a shingle at least of each class in which their sketches differ.  Equal texts are one
class from the start and are never compared.

Texts without a word are never linked; of an id with several rows the one with the smallest text counts; a missing
id gives no row; an empty table gives an empty result; other columns of the input are not read.  Equal weights
are ordered by id.  Very long texts are signed and compared whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from functools import reduce
from operator import add

import numpy as np
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stocklens.llm.components import components
from stocklens.llm.tasks import by_batches, one_row_per_id, text_rows
from stocklens.session import landed

WORDS = 5
THRESHOLD = 0.8
#: A pair at the threshold shares none of the bands with a probability of (1 - 0.8**4)**20 = 3e-5.
BANDS, ROWS = 20, 4
SLOTS = BANDS * ROWS
#: Bits of a sketch.  Texts of more than about twice as many shingles are always compared by their multisets.
SKETCH = 2048
#: Bands of so many texts are compared without sketches.
OUTRIGHT = 24
#: Bits for each wanted id, and in all, by which other texts are left out: 16 MB are sent to the executors at most.
BITS_PER_ID, MOST_BITS = 16, 1 << 27
_CHUNK = 15  # a bitmap of Spark has 2**15 bits
_GOLD = np.uint64(0x9E3779B97F4A7C15)
_BASE = np.uint64(0x5851F42D4C957F2D)
#: Bits of a shingle's hash, which leaves the others for the number of a text in its batch.
_HASH, _TEXTS = np.uint64(52), 1 << 12


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _draw(seed: np.ndarray, count: np.ndarray, purpose: int) -> np.ndarray:
    return _mix(seed + (count * np.uint64(4) + np.uint64(purpose)) * _GOLD)


def shingles(texts: Sequence[bytes], words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Number of the text and hash (52 bits) of each run of words, in order of both."""
    if len(texts) > _TEXTS:
        parts = [(i, shingles(texts[i : i + _TEXTS], words)) for i in range(0, len(texts), _TEXTS)]
        return np.concatenate([o + i for i, (o, _) in parts]), np.concatenate([h for _, (_, h) in parts])
    data = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
    word = ~((data == 0x20) | ((data >= 0x09) & (data <= 0x0D)))
    edges = np.diff(word.view(np.int8), prepend=np.int8(0), append=np.int8(0))
    begin, end = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    if not len(begin):
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    text_ends = np.cumsum([len(t) + 1 for t in texts])
    owner = np.searchsorted(text_ends, begin, side="right")
    # hash of a word: a polynomial of its bytes, from running sums, moved to the word's begin
    power = np.full(len(data) + 1, _BASE)
    power[0] = 1
    power = np.cumprod(power, dtype=np.uint64)
    inverse = np.full(int(begin[-1]) + 1, np.uint64(pow(int(_BASE), -1, 1 << 64)))
    inverse[0] = 1
    inverse = np.cumprod(inverse, dtype=np.uint64)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[:-1], out=sums[1:])
    value = _mix((sums[end] - sums[begin]) * inverse[begin] + (end - begin).astype(np.uint64))
    counts = np.bincount(owner, minlength=len(texts))
    first = np.cumsum(counts) - counts
    place = np.arange(len(owner)) - first[owner]
    held = np.minimum(counts, words)  # words of a shingle of this text
    starts = np.flatnonzero(place <= counts[owner] - held[owner])
    run = np.zeros(len(starts), np.uint64)
    for j in range(words):
        inside = held[owner[starts]] > j
        following = value[np.minimum(starts + j, len(value) - 1)]
        run = np.where(inside, _mix(run * _GOLD + following), run)
    both = np.sort((owner[starts].astype(np.uint64) << _HASH) | (run >> (np.uint64(64) - _HASH)))
    return (both >> _HASH).astype(np.int64), both & ((np.uint64(1) << _HASH) - np.uint64(1))


def signatures(owner: np.ndarray, shingle: np.ndarray, texts: int) -> np.ndarray:
    """The signature of each text [text, slot]; all zeros for a text without shingles."""
    found = np.zeros((texts, SLOTS), np.uint64)
    if not len(owner):
        return found
    first = np.ones(len(owner), bool)
    first[1:] = (owner[1:] != owner[:-1]) | (shingle[1:] != shingle[:-1])
    at = np.flatnonzero(first)
    weight = np.diff(np.append(at, len(owner)))
    owner, shingle = owner[at], shingle[at]
    total = np.bincount(owner, weight, minlength=texts)
    horizon = (np.log(SLOTS) + 3) / np.maximum(total, 1)
    wanted = total > 0
    while wanted.any():
        chosen = wanted[owner]
        slot, value = _earliest(owner[chosen], shingle[chosen], weight[chosen], horizon)
        found.ravel()[slot] = value
        wanted &= (found == 0).any(1)  # a slot without a point: look further in time
        horizon = np.where(wanted, 2 * horizon, horizon)
    return found


def _earliest(
    owner: np.ndarray, shingle: np.ndarray, weight: np.ndarray, horizon: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Slot (over all texts) and value of the earliest point in it, up to the text's horizon."""
    slots, times, values = [], [], []
    low, block = 0, 0  # the block's first level and number; it holds max(1, low) levels
    while len(owner):
        size = max(1, low)
        rate = SLOTS * size
        s = _mix(shingle + np.array([block + 1], np.uint64) * _BASE)
        o, w = owner, np.minimum(weight - low, size)
        # most processes have their first point after the horizon: known without its logarithm
        uniform = _uniform(_draw(s, np.zeros(1, np.uint64), 0))
        near = uniform > np.exp(-rate * horizon)[o]
        o, w, s, time = o[near], w[near], s[near], -np.log(uniform[near]) / rate
        count = np.zeros(len(o), np.uint64)
        while len(o):
            level = (_draw(s, count, 1) % np.uint64(size)).astype(np.int64)
            covered = level < w
            slot = (_draw(s, count, 2) % np.uint64(SLOTS)).astype(np.int64)
            slots.append((o * SLOTS + slot)[covered])
            times.append(time[covered])
            values.append((_draw(s, count, 3) | np.uint64(1))[covered])
            count = count + np.uint64(1)
            time = time - np.log(_uniform(_draw(s, count, 0))) / rate
            near = time < horizon[o]
            o, w, s, time, count = o[near], w[near], s[near], time[near], count[near]
        low += size
        block += 1
        more = weight > low
        owner, shingle, weight = owner[more], shingle[more], weight[more]
    slot, time, value = np.concatenate(slots), np.concatenate(times), np.concatenate(values)
    best = np.full(len(horizon) * SLOTS, np.inf)
    np.minimum.at(best, slot, time)
    first = time == best[slot]
    return slot[first], value[first]


def _uniform(hashed: np.ndarray) -> np.ndarray:
    return ((hashed >> np.uint64(11)).astype(float) + 0.5) * 2.0**-53


def _bands(signature: np.ndarray) -> np.ndarray:
    joined = np.tile(np.arange(1, BANDS + 1, dtype=np.uint64) * _BASE, (len(signature), 1))
    by_band = signature.reshape(-1, BANDS, ROWS)
    for j in range(ROWS):
        joined = _mix(joined * _GOLD + by_band[:, :, j])
    return joined.view(np.int64)


def signed(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id``, ``text_key`` (equal for equal words in order) and ``bands`` of every text.

    A text without a word has neither.
    """

    def run(rows: dict[str, list]) -> dict[str, list]:
        raw = [t.encode() for t in rows["text"]]
        owner, shingle = shingles(raw)
        bands = _bands(signatures(owner, shingle, len(raw)))
        keys = [b" ".join(t.split()) for t in raw]
        return {
            "doc_id": rows["doc_id"],
            "text_key": [hashlib.blake2b(k, digest_size=16).digest() if k else None for k in keys],
            "bands": [b.tolist() if k else [] for b, k in zip(bands, keys, strict=True)],
        }

    rows = text_rows(docs, id_column, text_column).filter(F.col("doc_id").isNotNull())
    kind = docs.schema[id_column].dataType.simpleString()
    return by_batches(rows, run, f"doc_id {kind}, text_key binary, bands array<bigint>")


def packed(docs: DataFrame) -> DataFrame:
    """``doc_id`` and the compressed text, for shuffles."""

    def run(rows: dict[str, list]) -> dict[str, list]:
        compress = zstandard.ZstdCompressor(level=3).compress
        return {"doc_id": rows["doc_id"], "packed": [compress(t.encode()) for t in rows["text"]]}

    kind = docs.schema["doc_id"].dataType.simpleString()
    return by_batches(docs, run, f"doc_id {kind}, packed binary")


def _about(texts: DataFrame, wanted: DataFrame, ids: int) -> DataFrame:
    """The rows of ``texts`` whose ``doc_id`` is in ``wanted``, and a few others; no text is moved.

    Ids, about ``ids`` different ones, are marked in bits by their hash.  An id whose bit another one has set stays,
    which costs only space.
    """
    bits = min(MOST_BITS, 1 << max(_CHUNK, (BITS_PER_ID * ids).bit_length()))
    bit = F.xxhash64("doc_id").bitwiseAND(F.lit(bits - 1))
    chunk, place = F.shiftright(bit, _CHUNK), bit.bitwiseAND(F.lit((1 << _CHUNK) - 1))
    marks = wanted.groupBy(chunk.alias("_chunk")).agg(F.bitmap_construct_agg(place).alias("_marks"))
    byte = F.substring("_marks", F.shiftright("_place", 3).cast("int") + 1, F.lit(1))
    marked = F.conv(F.hex(byte), 16, 10).cast("int").bitwiseAND(F.expr("shiftleft(1, cast(_place & 7 as int))")) != 0
    met = texts.withColumns({"_chunk": chunk, "_place": place}).join(F.broadcast(marks), "_chunk")
    return met.filter(marked).select(*texts.columns)


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Weighted Jaccard similarity of two sorted arrays of hashes."""
    if not len(a) or not len(b):
        return 0.0
    both = np.concatenate([a, b])
    side = np.repeat([0, 1], [len(a), len(b)])
    order = np.argsort(both, kind="stable")
    both, side = both[order], side[order]
    first = np.ones(len(both), bool)
    first[1:] = both[1:] != both[:-1]
    at = np.flatnonzero(first)
    in_b = np.add.reduceat(side, at)
    in_a = np.diff(np.append(at, len(both))) - in_b
    return float(np.minimum(in_a, in_b).sum() / np.maximum(in_a, in_b).sum())


def _verified(pairs: DataFrame, texts: DataFrame, threshold: float, ids: int) -> DataFrame:
    """The pairs whose texts have a similarity of at least ``threshold``."""
    first, second = (
        _about(texts, pairs.select(F.col(side).alias("doc_id")), ids).select(
            F.col("doc_id").alias(side), F.col("packed").alias(f"text_{side}")
        )
        for side in ("a", "b")
    )
    joined = pairs.join(second, "b").join(first, "a").select("a", "b", "text_a", "text_b")

    def run(rows: dict[str, list]) -> dict[str, list]:
        own: dict[object, int] = {}
        raw: list[bytes] = []
        for key, text in [*zip(rows["a"], rows["text_a"], strict=True), *zip(rows["b"], rows["text_b"], strict=True)]:
            if key not in own:
                own[key] = len(raw)
                raw.append(zstandard.ZstdDecompressor().decompress(text))
        owner, shingle = shingles(raw)
        cut = np.searchsorted(owner, np.arange(len(raw) + 1))
        kept = [
            (a, b)
            for a, b in zip(rows["a"], rows["b"], strict=True)
            if similarity(shingle[cut[own[a]] : cut[own[a] + 1]], shingle[cut[own[b]] : cut[own[b] + 1]])
            >= threshold
        ]
        return {"a": [a for a, _ in kept], "b": [b for _, b in kept]}

    kind = pairs.schema["a"].dataType.simpleString()
    return by_batches(joined, run, f"a {kind}, b {kind}")


def near_duplicates(
    docs: DataFrame,
    threshold: float = THRESHOLD,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """``doc_id``, ``class_id`` (smallest id of the group of near duplicates) and ``kept`` (is that id)."""
    needed = docs.select(F.col(f"`{id_column}`"), F.col(f"`{text_column}`"))
    docs = one_row_per_id(needed, id_column, text_column)
    sign = landed(signed(docs, id_column, text_column), "signed")
    keyed = sign.filter(F.col("text_key").isNotNull())
    # equal texts: one class each, known by its smallest id
    classes = keyed.groupBy("text_key").agg(F.min("doc_id").alias("head"))
    members = landed(keyed.select("doc_id", "text_key").join(classes, "text_key").select("doc_id", "head").distinct(), "members")
    heads = members.filter("doc_id = head").select("doc_id")
    rows = sign.join(heads, "doc_id", "left_semi").select("doc_id", F.explode("bands").alias("band")).distinct()
    shared = rows.groupBy("band").agg(F.count("*").alias("n")).filter("n > 1")
    members_of = landed(rows.join(shared, "band"), "bands")  # bands with two texts or more
    # what stands in many large bands is near the middle of its group of near copies
    weight = members_of.groupBy("doc_id").agg(F.sum("n").alias("weight"))
    banded = landed(members_of.drop("n").join(weight, "doc_id"), "bands")
    candidates = landed(banded.select("doc_id").distinct(), "candidates")
    wanted = candidates.count()
    texts = text_rows(docs, id_column, text_column).filter(F.col("doc_id").isNotNull())
    stored = landed(packed(_about(texts, candidates, wanted)), "texts")
    ids = docs.select(F.col(f"`{id_column}`").alias("doc_id")).filter("doc_id is not null").distinct()
    return _labelled(ids, members, _classes(banded, stored, threshold, wanted))


def sketches(owner: np.ndarray, shingle: np.ndarray, texts: int) -> np.ndarray:
    """The sketch of each text [text, 64 bits of it], of what ``shingles`` returns.

    The n-th repetition of a shingle is an element of its own, so sets of elements differ as the
    multisets do.
    """
    first = np.ones(len(owner), bool)
    first[1:] = (owner[1:] != owner[:-1]) | (shingle[1:] != shingle[:-1])
    at = np.flatnonzero(first)
    repetition = np.arange(len(owner)) - np.repeat(at, np.diff(np.append(at, len(owner))))
    element = _mix(shingle + repetition.astype(np.uint64) * _GOLD)
    place, n = np.unique(owner * SKETCH + (element % np.uint64(SKETCH)).astype(np.int64), return_counts=True)
    odd = np.zeros((texts, SKETCH), bool)
    odd.ravel()[place[n % 2 == 1]] = True
    return np.packbits(odd, axis=1).view(np.int64)


def _sketched(texts: DataFrame) -> DataFrame:
    """``doc_id``, ``size`` (shingles, with repetition) and ``sketch`` of packed texts."""

    def run(rows: dict[str, list]) -> dict[str, list]:
        unpack = zstandard.ZstdDecompressor().decompress
        owner, shingle = shingles([unpack(t) for t in rows["packed"]])
        n = len(rows["doc_id"])
        sizes = np.bincount(owner, minlength=n).astype(np.int64)
        return {"doc_id": rows["doc_id"], "size": sizes, "sketch": sketches(owner, shingle, n).tolist()}

    kind = texts.schema["doc_id"].dataType.simpleString()
    return by_batches(texts, run, f"doc_id {kind}, size bigint, sketch array<bigint>")


def _may_link(threshold: float) -> Column:
    """Whether two texts may reach the threshold, by what is known of the elements that only one of them has.

    A few words of the sketches tell most pairs apart; more of them written out are too much code for one compiled method.
    """
    total, longer = F.col("size") + F.col("a_size"), F.abs(F.col("size") - F.col("a_size"))

    def differing(word: Column, other: Column) -> Column:
        return F.bit_count(word.bitwiseXOR(other))

    def enough(apart: Column) -> Column:
        return (total - apart) / (total + apart) >= threshold

    some = reduce(add, (differing(F.col("sketch")[i], F.col("a_sketch")[i]) for i in range(SKETCH // 256)))
    each = F.aggregate(F.zip_with("sketch", "a_sketch", differing), F.lit(0), add)
    unknown = F.col("sketch").isNull() | F.col("a_sketch").isNull()
    return unknown | (enough(longer) & enough(some) & enough(each))


def _with_sketches(placed: DataFrame, texts: DataFrame) -> DataFrame:
    """The rows of still divided bands, with ``size`` and ``sketch`` for the texts of the large ones."""
    large = placed.groupBy("band").agg(F.count("*").alias("n")).filter(F.col("n") > OUTRIGHT)
    docs = placed.join(large, "band").select("doc_id").distinct()
    found = landed(_sketched(texts.join(docs, "doc_id")), "sketches")
    return landed(placed.join(found, "doc_id", "left"), "bands")


def _classes(banded: DataFrame, texts: DataFrame, threshold: float, ids: int) -> DataFrame:
    """``node`` and ``component`` of the texts that are linked with another.

    ``banded`` has a row per band and text, with the text's ``weight``, for about ``ids`` texts.
    """
    heaviest = F.max(F.struct("weight", F.col("doc_id").alias("id")))["id"]
    first = banded.groupBy("band").agg(heaviest.alias("a"))
    met = landed(banded.join(first, "band").withColumn("centre", F.col("doc_id") == F.col("a")), "centres")
    pairs = met.filter("not centre").select("a", F.col("doc_id").alias("b"))
    rows = met.drop("a")
    known, tested = None, None
    wave = 0
    while True:
        pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = landed(pairs, "pairs")
        tested = pairs if tested is None else tested.unionByName(pairs)
        known = _joined(known, landed(_verified(pairs, texts, threshold, ids), "verified"))
        placed = _divided(rows, known)
        if placed.isEmpty():
            return known
        if wave == 0:
            placed = _with_sketches(placed, texts)
        # texts of a band that have not been its centre, and lie in different components
        open_ = placed.filter("not centre")
        main = open_.groupBy("band").agg(F.max(F.struct("weight", F.col("component").alias("of")))["of"].alias("main"))
        centres = landed(_next_centres(open_.join(main, "band"), wave), "centres")
        pairs = _met(placed, centres, threshold)
        now = centres.select("band", F.col("a").alias("doc_id"), F.lit(True).alias("_now"))
        been = F.col("centre") | F.coalesce("_now", F.lit(False))
        rows = placed.drop("component").join(now, ["band", "doc_id"], "left").withColumn("centre", been).drop("_now")
        wave += 1


def _met(placed: DataFrame, centres: DataFrame, threshold: float) -> DataFrame:
    """Centres (``a``) and the texts of their bands (``b``) that they may be linked with, from other components.

    Near copies share many bands; a centre and a text meet in the least of them only.  Without sketches all may be linked.
    """
    by_text, by_centre = Window.partitionBy("doc_id"), Window.partitionBy("a")  # no more rows each than bands
    placed = placed.withColumn("bands", F.collect_list("band").over(by_text))
    centres = centres.withColumn("a_bands", F.collect_list("band").over(by_centre))
    apart = (placed["band"] == centres["band"]) & (F.col("component") != F.col("of"))
    least = F.array_min(F.array_intersect("bands", "a_bands")) == placed["band"]
    may = _may_link(threshold) if "sketch" in placed.columns else F.lit(True)
    met = placed.join(centres, apart & may & least)  # the cheaper test first
    return met.select("a", F.col("doc_id").alias("b"))


def _divided(rows: DataFrame, known: DataFrame) -> DataFrame:
    """The rows of bands that may still hold unknown links, with ``component``.

    ``rows`` has ``centre``: whether a text has been a centre of the band.  Components only grow together and a centre
    remains one, so a band that is not divided any more never will be, and later waves go on with these rows.
    """
    placed = landed(
        rows.join(known.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn(
            "component", F.coalesce("component", "doc_id")
        ),
        "placed",
    )
    split = placed.filter("not centre").groupBy("band").agg(F.min("component").alias("least"), F.max("component").alias("most"))
    return landed(placed.join(split.filter("least <> most").select("band"), "band", "left_semi"), "divided")


def _next_centres(open_: DataFrame, wave: int) -> DataFrame:
    """``band``, ``a`` and its component ``of``: the texts a band's others are compared with next.

    First a few of the main component's heaviest, which most of the others are near to; then the texts
    outside it themselves, more of them in each wave.
    """
    inside = F.col("component") == F.col("main")
    slots = 8 if wave == 0 else 16 ** (wave + 1)
    chosen = open_.filter(inside if wave == 0 else ~inside)
    slot = F.pmod(F.xxhash64("doc_id", "band"), F.lit(slots))
    best = F.max(
        F.struct(
            "weight",
            F.col("doc_id").alias("a"),
            F.col("component").alias("of"),
            F.col("size").alias("a_size"),
            F.col("sketch").alias("a_sketch"),
        )
    )
    found = chosen.groupBy("band", slot.alias("slot")).agg(best.alias("c"))
    return found.select("band", "c.a", "c.of", "c.a_size", "c.a_sketch")


def _joined(known: DataFrame | None, found: DataFrame) -> DataFrame:
    """Components after further links; only the components themselves are joined anew."""
    if known is None:
        return components(found)
    if found.isEmpty():
        return known
    first = known.select(F.col("node").alias("a"), F.col("component").alias("of_a"))
    second = known.select(F.col("node").alias("b"), F.col("component").alias("of_b"))
    raised = found.join(first, "a", "left").join(second, "b", "left")
    raised = raised.select(F.coalesce("of_a", "a").alias("a"), F.coalesce("of_b", "b").alias("b"))
    merged = components(raised)
    moved = known.join(merged.select(F.col("node").alias("component"), F.col("component").alias("to")), "component", "left")
    old = moved.select("node", F.coalesce("to", "component").alias("component"))
    new = merged.join(known.select("node"), "node", "left_anti")
    return landed(old.unionByName(new), "components")


def _labelled(ids: DataFrame, members: DataFrame, linked: DataFrame) -> DataFrame:
    of_head = linked.select(F.col("node").alias("head"), "component")
    placed = members.join(of_head, "head", "left").select(
        "doc_id", F.coalesce("component", "head").alias("class")
    )
    labelled = ids.join(placed, "doc_id", "left")
    return labelled.select(
        "doc_id",
        F.coalesce("class", "doc_id").alias("class_id"),
        (F.coalesce("class", "doc_id") == F.col("doc_id")).alias("kept"),
    )


def one_of_each(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``docs`` with one row of each group of near duplicates, and one row of each id.

    Rows without an id are of no group and stay.
    """
    docs = one_row_per_id(docs, id_column, text_column)
    found = near_duplicates(docs, id_column=id_column, text_column=text_column)
    dropped = found.filter(~F.col("kept")).select(F.col("doc_id").alias(id_column))
    return docs.join(dropped, id_column, "left_anti").select(*docs.columns)
