"""Conversation repair against exhaustive search and against its statement."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import duckdb
from compare import assert_same

from stocklens.llm import conversations, queries

SCHEMA = "conv_id bigint, turn bigint, role string, text string"
LEGAL = re.compile(r"(s?(ua)+)?")
NOTHING = hashlib.sha256(b"").hexdigest()


def cheapest(rows):
    """Cost and edits by trying everything; ``rows``: initial, has to go, truncated."""
    best = (2 * len(rows), "D" * len(rows))

    def tried(at, roles, cost, audit, inserts):
        nonlocal best
        if cost > best[0]:
            return
        if at == len(rows):
            if LEGAL.fullmatch(roles):
                best = min(best, (cost, audit))
        else:
            initial, gone, truncated = rows[at]
            more = 5 if truncated else 0
            tried(at + 1, roles, cost + 2, audit + "D", 0)
            if not gone:
                if initial:
                    tried(at + 1, roles + initial, cost + more, audit + "K", 0)
                for role in "ua":
                    tried(at + 1, roles + role, cost + 1 + more, audit + "R", 0)
        if inserts < 2:
            for role in "ua":
                tried(at, roles + role, cost + 5, audit + "I", inserts + 1)

    tried(0, "", 0, "", 0)
    return best


def decoded(rows):
    repair = conversations.Repair()
    edits = [e for at, row in enumerate(rows) for e in repair.add(*row, at)]
    edits += repair.end()
    assert [e[3] for e in edits] == [*range(len(rows)), None]
    return repair.cost, "".join("I" * len(e[0]) + e[1] for e in edits)


def test_edits_equal_exhaustive_search():
    rng = random.Random(1)
    for _ in range(700):
        rows = []
        for _ in range(rng.randrange(7)):
            gone = rng.random() < 0.15
            rows.append((rng.choice(["s", "u", "u", "a", "x", ""]), gone, not gone and rng.random() < 0.25))
        assert decoded(rows) == cheapest(rows), rows


def test_ties_take_the_ascii_least_edits():
    user, helper = ("u", False, False), ("a", False, False)
    assert decoded([user, user, user]) == (3, "DKR")
    assert decoded([helper]) == (2, "D")
    assert decoded([user, user, helper]) == (2, "DKK")


def test_survivors_coalesce():
    rng = random.Random(2)
    repair, most = conversations.Repair(), 0
    for at in range(30_000):
        list(repair.add(rng.choice("uuaas"), rng.random() < 0.05, rng.random() < 0.1, at))
        most = max(most, repair.unresolved)
    assert most < 300
    repair = conversations.Repair()
    for at in range(5_000):
        list(repair.add("ua"[at % 2], False, False, at))
        assert repair.unresolved <= 2


def test_replaced_survivors_free_their_branches():
    repair = conversations.Repair()
    rng = random.Random(3)
    for at in range(2_000):
        list(repair.add(rng.choice("uas"), False, rng.random() < 0.2, at))
        nodes, open_ = 0, [repair._root]
        while open_:
            node = open_.pop()
            nodes += 1
            open_ += node.children
            assert node.children or node in repair._leaves.values()
        assert nodes <= 1 + 4 * (repair.unresolved + 1)


def expected(rows):
    """The whole contract, one conversation after the other."""
    result = {}
    for conv in {r[0] for r in rows}:
        after = []
        for _, turn, role, text in (r for r in rows if r[0] == conv):
            role, text = " " if role is None else role, " " if text is None else text
            key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
            chance = zlib.crc32(key.encode()) % 20
            if chance == 0:
                continue
            text = "" if chance == 1 else re.sub("[.!?]", "", text) if chance == 2 else text
            after += [(turn, "user" if chance == 4 else role, text)] * (2 if chance == 3 else 1)
        after.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, states, blank, duplicate, truncated = set(), [], 0, 0, 0
        for _, role, text in after:
            ink = text.rstrip(" \t\n\x0b\x0c\r")
            again, cut = (role, text) in seen, not ink.endswith((".", "!", "?"))
            seen.add((role, text))
            blank += not ink
            duplicate += bool(ink) and again
            truncated += bool(ink) and not again and cut
            states.append((role[:1], not ink or again, bool(ink) and not again and cut))
        turns = [r[0] for r in after if r[0] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(x[0] + y[0] not in ("su", "ua", "au") for x, y in zip(states, states[1:], strict=False))
        cost, audit = cheapest(states)
        lines, last, at = [], "", 0
        for letter in audit:
            follows = "user" if last in ("", "s", "a") else "assistant"
            if letter == "I":
                lines.append(f"{follows}:")
                last = follows[0]
                continue
            _, role, text = after[at]
            at += 1
            if letter != "D":
                lines.append(f"{role if letter == 'K' else follows}:{text}")
                last = lines[-1][0]
        digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        result[conv] = (gaps, blank, duplicate, truncated, illegal, cost, audit, digest)
    return result


def found(df):
    return {r[0]: tuple(r)[1:] for r in conversations.audited(df).collect()}


def test_query_equals_its_statement(spark, duck, data):
    statement = queries.statements()["op13_conversation_repair"]
    assert assert_same(queries.conversation_repair(spark, data), duck, statement)


def odd_rows():
    rng = random.Random(4)
    texts = ["All well.", "And so on", "What? ", " \t\n", "", None, "é über\n日本!", "x" * 70_000 + ".", "line\nline."]
    rows = []
    for conv in [*range(40), None]:
        for turn in rng.sample([None, -3, 0, 1, 2, 2, 3, 5, 9], rng.randrange(1, 7)):
            rows.append((conv, turn, rng.choice(["user", "assistant", "system", "tool", "", None]), rng.choice(texts)))
    rows += [(900, t, "user", "The same.") for t in range(5)] + [(901, 4, "user", "One row, twice.")] * 2
    return rows


def test_odd_conversations_equal_the_contract(spark):
    rows = odd_rows()
    assert found(spark.createDataFrame(rows, SCHEMA)) == expected(rows)


def test_statement_agrees_on_odd_conversations(spark):
    rows = [r for r in odd_rows() if r[2] != ""]
    df = spark.createDataFrame(rows, SCHEMA)
    connection = duckdb.connect()
    connection.register("conversations", df.toArrow())
    assert_same(conversations.audited(df), connection, queries.statements()["op13_conversation_repair"])


def test_long_conversation_with_a_hot_row(spark):
    rng = random.Random(5)
    rows = [(1, t, rng.choice(["user", "assistant"]), rng.choice(["Yes.", f"Turn {t}.", f"Cut {t}"])) for t in range(6_000)]
    got = found(spark.createDataFrame(rows + [(2, 0, "user", "Hi."), (2, 1, "assistant", "Ho.")], SCHEMA))
    gaps, blank, duplicate, truncated, _, cost, audit, _ = got[1]
    assert duplicate > 1_500 and truncated > 1_500 and gaps > 100 and blank > 100
    assert len(audit.replace("I", "")) == 6_000 - gaps + sum(zlib.crc32(f"1:{t}".encode()) % 20 == 3 for t in range(6_000))
    assert cost >= 2 * (blank + duplicate)


def test_empty_tables_and_other_columns(spark):
    df = spark.createDataFrame([(7, 0, "user", "Hi.", 3, "x")], f"{SCHEMA}, copies int, first string")
    assert found(df).keys() == {7}
    assert conversations.audited(df.limit(0)).count() == 0
    dropped = next(t for t in range(200) if zlib.crc32(f"7:{t}".encode()) % 20 == 0)
    gone = spark.createDataFrame([(7, dropped, "user", "Hi.")], SCHEMA)
    assert found(gone) == {7: (0, 0, 0, 0, 0, 0, "", NOTHING)}
