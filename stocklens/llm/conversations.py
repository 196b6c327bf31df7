"""Conversation repair: the cheapest edits that give a legal order of roles, by Viterbi with survivor coalescence.

A legal conversation is empty, or pairs of user and assistant, after at most one system turn.  Edits: K keeps a row, R
changes its role to user or assistant, D deletes it, I inserts an empty user or assistant turn.  A
blank row or a duplicate has to go; a truncated row costs extra where it stays.  Of equally cheap repairs the one
whose edits read least in ASCII wins.

Four states (nothing yet, system, user, assistant came last) carry one survivor each.  Survivors are leaves of a
tree of back pointers whose nodes count their children.  A survivor that is replaced frees its branch up to
the last node still in use; once the root has a single child, all survivors share it, and its edits
are emitted at once.  So memory holds the part of a conversation on which survivors still differ, and no more.  A
survivor so dear that another one could copy whatever it may still do goes too, or hopeless survivors
would hold the root for ever.

Equally cheap survivors are told apart by their complete unresolved suffixes.  Once two suffixes differ, longer
ones differ alike, so the order of each two survivors is kept, with what one has beyond the other while it is
its beginning; nothing is read again.

Conversations are dealt out by id and sorted inside Spark, and a task reads them as a stream, so a very long one
is not gathered.  Its hash is over its whole text in order, which one task has to do.  First copies
of repeated rows are found by an aggregate and a join before that, which a hot row does not hold up.

Missing ids, turns, roles and texts are defined by :func:`repaired`; rows of one turn follow each other by role and text;
equal rows of one turn are duplicates of each other.  A role is known by its first letter; one that starts otherwise
(an empty one too) cannot be kept.  Very long texts are hashed whole.  An empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stocklens.llm.tasks import arrow_schema
from stocklens.session import ship_package

#: Costs of an edit, and of a truncated row that stays.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: States by what came last.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
#: What may follow a state, by a role's first letter.
_NEXT = (
    {"s": SYSTEM, "u": USER},
    {"u": USER},
    {"a": ASSISTANT},
    {"u": USER},
)
_NAMES = {USER: "user", ASSISTANT: "assistant"}
#: Inserts before a row or at the end that lead from a state to another.
_INSERTED = (
    ((NOTHING, ()), (USER, (USER,)), (ASSISTANT, (USER, ASSISTANT))),
    ((SYSTEM, ()), (USER, (USER,)), (ASSISTANT, (USER, ASSISTANT))),
    ((USER, ()), (ASSISTANT, (ASSISTANT,))),
    ((ASSISTANT, ()), (USER, (USER,))),
)
_ENDS = (NOTHING, ASSISTANT)
#: What it costs the first state at most to copy anything that the second may still do.
_COPY = (
    (0, 0, DELETE, 0),
    (2 * INSERT, 0, INSERT, 2 * INSERT),
    (INSERT, DELETE, 0, INSERT),
    (DELETE, 0, DELETE, 0),
)
_SPACE = " \t\n\x0b\x0c\r"
_STOPS = "[.!?]"


class _Node:
    """One row's edits: the states inserted before it, its letter, and its new state."""

    __slots__ = ("parent", "children", "inserted", "letter", "state")

    def __init__(self, parent: _Node | None, inserted: tuple, letter: str, state: int) -> None:
        self.parent, self.children = parent, []
        self.inserted, self.letter, self.state = inserted, letter, state
        if parent is not None:
            parent.children.append(self)


class Repair:
    """Edits of one conversation, emitted as soon as they are certain.

    :meth:`add` takes a row, :meth:`end` the end.  Both yield ``(inserted, letter, role, row)``: the roles
    inserted before a row, the row's edit, the role it has then, and what was added as the row.
    """

    def __init__(self) -> None:
        self._root = _Node(None, (), "", NOTHING)
        self._leaves: dict[int, _Node] = {NOTHING: self._root}
        self._costs: dict[int, int] = {NOTHING: 0}
        #: For two survivors: what each has beyond their common beginning; "" for one until they differ.
        self._beyond: dict[tuple[int, int], tuple[str, str]] = {}
        self._waiting: deque = deque()
        self.cost = 0

    @property
    def unresolved(self) -> int:
        """Rows whose edits are still open."""
        return len(self._waiting)

    def _suffixes(self, one: int, other: int) -> tuple[str, str]:
        if one == other:
            return "", ""
        if one < other:
            return self._beyond[one, other]
        return self._beyond[other, one][::-1]

    def _less(self, one: tuple, other: tuple) -> bool:
        """Whether a way (cost, state before, edits) comes before another."""
        if one[0] != other[0]:
            return one[0] < other[0]
        first, second = self._suffixes(one[1], other[1])
        return first + one[2] < second + other[2]

    def add(self, initial: str, gone: bool, truncated: bool, row: object) -> Iterator[tuple]:
        self._waiting.append(row)
        best: dict[int, tuple] = {}
        more = TRUNCATED if truncated else 0
        for before, cost in self._costs.items():
            for state, inserted in _INSERTED[before]:
                spent, letters = cost + INSERT * len(inserted), "I" * len(inserted)
                ways = [(state, spent + DELETE, "D")]
                if not gone:
                    kept = _NEXT[state].get(initial)
                    if kept is not None:
                        ways.append((kept, spent + more, "K"))
                    role = ASSISTANT if state == USER else USER
                    ways.append((role, spent + REROLE + more, "R"))
                for after, total, letter in ways:
                    way = (total, before, letters + letter, inserted, letter)
                    if after not in best or self._less(way, best[after]):
                        best[after] = way
        for state in list(best):
            if any(best[state][0] > best[other][0] + _COPY[other][state] for other in best if other != state):
                del best[state]
        self._follow(best)
        return self._certain()

    def _follow(self, best: dict[int, tuple]) -> None:
        beyond = {}
        for one in best:
            for other in best:
                if one < other:
                    first, second = self._suffixes(best[one][1], best[other][1])
                    beyond[one, other] = _apart(first + best[one][2], second + best[other][2])
        leaves = {s: _Node(self._leaves[w[1]], w[3], w[4], s) for s, w in best.items()}
        for leaf in self._leaves.values():
            while not leaf.children and leaf.parent is not None:
                leaf.parent.children.remove(leaf)
                leaf = leaf.parent
        self._beyond, self._leaves, self._costs = beyond, leaves, {s: w[0] for s, w in best.items()}

    def _certain(self) -> Iterator[tuple]:
        while len(self._root.children) == 1:
            child = self._root.children[0]
            child.parent = None
            self._root = child
            row = self._waiting.popleft()
            yield [_NAMES[s] for s in child.inserted], child.letter, _NAMES.get(child.state), row

    def end(self) -> Iterator[tuple]:
        ways = [
            (cost + INSERT * len(inserted), before, "I" * len(inserted), inserted)
            for before, cost in self._costs.items()
            for state, inserted in _INSERTED[before]
            if state in _ENDS
        ]
        last = ways[0]
        for way in ways[1:]:
            if self._less(way, last):
                last = way
        self.cost = last[0]
        path, leaf = [], self._leaves[last[1]]
        while leaf is not self._root:
            path.append(leaf)
            leaf = leaf.parent
        for node in reversed(path):
            yield [_NAMES[s] for s in node.inserted], node.letter, _NAMES.get(node.state), self._waiting.popleft()
        yield [_NAMES[s] for s in last[3]], "", None, None


def _apart(one: str, other: str) -> tuple[str, str]:
    """Two strings from where they differ, or what one has beyond the other."""
    shared = 0
    for a, b in zip(one, other, strict=False):
        if a != b:
            return a, b
        shared += 1
    return one[shared:], other[shared:]


class _Conversation:
    """Counts, edits and hash of one conversation, row by row."""

    def __init__(self, conv_id: object) -> None:
        self.conv_id, self.repair, self.audit, self.hash = conv_id, Repair(), [], hashlib.sha256()
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.first_turn = self.last_turn = self.before = self.initial = None
        self.lines = 0

    def add(self, turn: int | None, role: str, text: str, repeated: bool) -> None:
        repeated |= self.before == (turn, role, text)
        self.before = turn, role, text
        if turn is not None and turn != self.last_turn:
            self.first_turn = turn if self.first_turn is None else self.first_turn
            self.last_turn, self.turns = turn, self.turns + 1
        if self.initial is not None:
            self.illegal += self.initial + role[:1] not in ("su", "ua", "au")
        self.initial = role[:1]
        ink = text.rstrip(_SPACE)
        blank, truncated = not ink, ink[-1:] not in (".", "!", "?")
        self.blank += blank
        self.duplicate += not blank and repeated
        cut = not blank and not repeated and truncated
        self.truncated += cut
        self._emit(self.repair.add(role[:1], blank or repeated, cut, (role, text)))

    def _emit(self, edits: Iterator[tuple]) -> None:
        for inserted, letter, new_role, row in edits:
            for role in inserted:
                self._line(role, "")
            self.audit.append("I" * len(inserted) + letter)
            if letter == "K":
                self._line(*row)
            elif letter == "R":
                self._line(new_role, row[1])

    def _line(self, role: str, text: str) -> None:
        self.hash.update(f"{chr(10) if self.lines else ''}{role}:{text}".encode())
        self.lines += 1

    def ended(self) -> tuple:
        self._emit(self.repair.end())
        gaps = self.last_turn - self.first_turn + 1 - self.turns if self.turns else 0
        counts = (gaps, self.blank, self.duplicate, self.truncated, self.illegal, self.repair.cost)
        return (self.conv_id, *counts, "".join(self.audit), self.hash.hexdigest())


_COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows after a fixed damage by their key: dropped, emptied, cut, repeated or given to the user.

    A row is ``conv_id``, ``turn``, ``role``, ``text`` and ``copies``.  A missing id or turn is a space in the key, a
    missing role or text is a space.
    """
    part = lambda name: F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(" "))
    chance = F.pmod(F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn"))), F.lit(20))
    # the chance is computed once, on the rows as they were
    rows = conversations.select("conv_id", "turn", part("role").alias("role"), part("text").alias("text"), chance.alias("chance"))
    text = F.when(F.col("chance") == 1, "").when(F.col("chance") == 2, F.regexp_replace("text", _STOPS, ""))
    return rows.filter("chance <> 0").select(
        "conv_id",
        "turn",
        F.when(F.col("chance") == 4, "user").otherwise(F.col("role")).alias("role"),
        text.otherwise(F.col("text")).alias("text"),
        F.when(F.col("chance") == 3, 2).otherwise(1).alias("copies"),
    )


def repaired(rows: DataFrame) -> DataFrame:
    """Faults, cost, edits and hash of the repair of every conversation of ``rows``.

    ``rows`` has ``conv_id``, ``turn`` (a whole number), ``role``, ``text`` and ``copies``.  Rows without an id are one
    conversation, rows without a turn come first, a missing role or text is a space.
    """
    ship_package(rows.sparkSession)
    part = lambda name: F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(" "))
    plain = rows.select(
        "conv_id", F.col("turn").cast("bigint"), part("role").alias("role"), part("text").alias("text"), "copies"
    ).withColumn("digest", F.sha2("text", 256))
    # texts that stand in several rows, and the first turn of each; the others need no look-up
    key = [F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("_conv"), F.isnull("conv_id").alias("_none")]
    place = F.struct(F.col("turn").isNotNull().alias("given"), "turn")
    several = (
        plain.groupBy(*key, "role", "digest")
        .agg(F.min(place).alias("first"), F.max(place).alias("last"))
        .filter("first <> last")
        .drop("last")
    )
    marked = plain.select("*", *key).join(several, ["_conv", "_none", "role", "digest"], "left")
    repeated = F.coalesce(place > F.col("first"), F.lit(False)).alias("repeated")
    names = ["conv_id", "turn", "role", "text", "copies"]
    streamed = marked.select(*names, repeated).repartition("conv_id")
    streamed = streamed.sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text")
    kind = rows.schema["conv_id"].dataType.simpleString()
    schema = f"conv_id {kind}, {', '.join(f'{n} bigint' for n in _COUNTS)}, audit string, repaired_sha256 string"
    arrow = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, done = None, []
        for batch in batches:
            for conv_id, turn, role, text, copies, again in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if current is None or conv_id != current.conv_id:
                    done += [current.ended()] if current else []
                    current = _Conversation(conv_id)
                for _ in range(copies):
                    current.add(turn, role, text, again)
            if done:
                yield _batch(done, arrow)
                done = []
        if current:
            yield _batch([*done, current.ended()], arrow)

    return streamed.mapInArrow(run, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def audited(conversations: DataFrame) -> DataFrame:
    """The repair of every conversation after its damage; one that lost all rows has zeros and the hash of nothing."""
    ids = conversations.select("conv_id").distinct()
    found = repaired(damaged(conversations)).withColumnRenamed("conv_id", "_conv")
    joined = ids.join(found, F.col("conv_id").eqNullSafe(F.col("_conv")), "left")
    return joined.select(
        "conv_id",
        *[F.coalesce(n, F.lit(0)).cast("bigint").alias(n) for n in _COUNTS],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"),
    )
