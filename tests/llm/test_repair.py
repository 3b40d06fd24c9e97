"""Conversation repair against a plain search over edits, and on odd rows."""

import hashlib
import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from gridsight.llm import repair
from gridsight.llm.common import ready

EMPTY = hashlib.sha256(b"").hexdigest()
SCHEMA = "conv_id bigint, turn bigint, role string, text string"
WHOLE = re.compile(r"(s?(ua)+)?")


def plain(turns):
    """Cheapest (cost, audit, text) by a search over places in the grammar, audits as whole strings."""
    after = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
    names = {"u": "user", "a": "assistant"}
    states = {"": (0, "", ())}

    def put(into, state, found):
        if state not in into or found < into[state]:
            into[state] = found
            return True
        return False

    def insert(states):
        states, again = dict(states), True
        while again:
            again = False
            for state, (cost, audit, lines) in list(states.items()):
                for to, new in after[state].items():
                    if to in names:
                        again |= put(states, new, (cost + 2, audit + "I", (*lines, f"{names[to]}:")))
        return states

    for role, text, must_go, cut in turns:
        new = {}
        for state, (cost, audit, lines) in insert(states).items():
            put(new, state, (cost + 3, audit + "D", lines))
            for to, then in after[state].items() if not must_go else ():
                if to == role[:1]:
                    put(new, then, (cost + cut, audit + "K", (*lines, f"{role}:{text}")))
                elif to in names:
                    put(new, then, (cost + 2 + cut, audit + "R", (*lines, f"{names[to]}:{text}")))
        states = new
    return min(found for state, found in insert(states).items() if state in ("", "a"))


def judged(rows):
    """Expected result of one conversation of (turn, role, text, copies) in order."""
    rows = [(turn, role, text) for turn, role, text, copies in rows for _ in range(copies)]
    seen, turns, counts = set(), [], dict.fromkeys(("blank", "duplicate", "truncated"), 0)
    for _, role, text in rows:
        bare = text.rstrip(" \t\n\x0b\x0c\r")
        fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None
        if fault:
            counts[fault] += 1
        seen.add((role, text))
        turns.append((role, text, fault in ("blank", "duplicate"), int(fault == "truncated")))
    known = {turn for turn, _, _ in rows if turn is not None}
    gaps = max(known) - min(known) + 1 - len(known) if known else 0
    illegal = sum(one[1][:1] + two[1][:1] not in ("su", "ua", "au") for one, two in itertools.pairwise(rows))
    cost, audit, lines = plain(turns)
    return (gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def by_conversation(df):
    return {row["conv_id"]: tuple(row)[1:] for row in df.collect()}


def test_stacks_are_told_apart_by_their_top():
    assert len(repair.STACKS) == 5 and all(repair.ENDS[top] == (len(stack) == 1 or stack[-1] == 5) for top, stack in enumerate(repair.STACKS))
    for size in range(6):
        for roles in itertools.product("sua", repeat=size):
            stack = repair.STACKS[0]
            for initial in roles:
                stack = stack and repair.pushed(stack, initial)
            accepted = stack is not None and repair.ENDS[repair.STACKS.index(stack)]
            assert accepted == bool(WHOLE.fullmatch("".join(roles)))


def test_parser_finds_the_cheapest_edits():
    rng = random.Random(5)
    roles = ["system", "user", "assistant", "tool"]
    parser = repair.Parser()
    for _ in range(600):
        turns = [(rng.choice(roles), f"t{n}", rng.random() < 0.2, rng.random() < 0.3) for n in range(rng.randint(0, 9))]
        turns = [(role, text, gone, int(cut and not gone)) for role, text, gone, cut in turns]
        kinds = [repair.kind("suat".index(role[0]), gone, bool(cut)) for role, _, gone, cut in turns]
        front, total, links = parser.run(0, kinds)
        top = repair.finish(front)
        audit = "".join("I" * len(added) + letter for added, letter, _ in repair.traced(links, top)) + "I" * len(repair.closing(top))
        assert (total + front[top][0] + 2 * len(repair.closing(top)), audit) == plain(turns)[:2]
    assert len(parser.steps) < 2000


def conversations():
    rng = random.Random(11)
    rows = []
    for conv in range(40):
        for turn in range(rng.randint(0, 8)):
            text = rng.choice(["Hello there.", "And then", " \t", "", "What?", "No!  ", f"Only {turn}."])
            rows.append((conv, turn * rng.choice([1, 1, 2]), rng.choice(["system", "user", "assistant", "user", "assistant", "tool"]), text))
    # turns of one conversation stand once, so that their order is known
    return [row for place, row in enumerate(rows) if (row[0], row[1]) not in {(one[0], one[1]) for one in rows[:place]}]


@pytest.fixture(scope="module")
def expected():
    found = {}
    for conv, own in itertools.groupby(sorted(conversations()), key=lambda row: row[0]):
        found[conv] = judged([(turn, role, text, 1) for _, turn, role, text in own])
    return found


@pytest.mark.parametrize("chunk_rows", [3, 100_000])
def test_conversations_may_be_cut_anywhere(spark, expected, chunk_rows):
    rows = spark.createDataFrame(conversations(), SCHEMA)
    assert by_conversation(repair.repaired(rows, rows, chunk_rows)) == expected


def test_a_conversation_with_most_rows_is_cut(spark):
    rng = random.Random(2)
    rows = [(1, turn, rng.choice(["user", "assistant", "system"]), rng.choice(["Yes.", "no", "", f"Turn {turn}."])) for turn in range(400)]
    rows += [(2, 1, "user", "Hi."), (None, 1, "user", "Hi."), (None, 2, "assistant", "Ho.")]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    turns = repair.edits(repair.faults(df), 40)[0]
    assert turns.where("conv = '=1'").select("chunk").distinct().count() > 5
    found = by_conversation(repair.repaired(df, df, 40))
    assert found[1] == judged([(*row[1:], 1) for row in rows[:400]])
    assert found[None] == (0, 0, 0, 0, 0, 0, "KK", hashlib.sha256(b"user:Hi.\nassistant:Ho.").hexdigest())


def test_repaired_turns_are_the_hashed_text(spark, expected):
    rows = spark.createDataFrame(conversations(), SCHEMA)
    texts = {}
    for row in sorted(repair.repaired_turns(rows, 7).collect(), key=lambda row: (row["conv"], row["chunk"], row["pos"], row["line"])):
        texts.setdefault(int(row["conv"][1:]), []).append(f"{row['role']}:{row['text']}")
    for conv, result in expected.items():
        assert hashlib.sha256("\n".join(texts.get(conv, [])).encode()).hexdigest() == result[-1]
        roles = "".join(line[0] for line in texts.get(conv, []))
        assert WHOLE.fullmatch(roles)


def test_damage(spark):
    import zlib

    rows = [(conv, turn, "assistant", "One. Two!") for conv in range(30) for turn in range(8)]
    found = {(row["conv_id"], row["turn"]): row for row in repair.damage(spark.createDataFrame(rows, SCHEMA)).collect()}
    for conv, turn, _, text in rows:
        choice, row = zlib.crc32(f"{conv}:{turn}".encode()) % 20, found.get((conv, turn))
        assert (row is None) == (choice == 0)
        if row is not None:
            assert row["text"] == {1: "", 2: "One Two"}.get(choice, text)
            assert row["copies"] == (2 if choice == 3 else 1) and row["role"] == ("user" if choice == 4 else "assistant")


def test_odd_rows(spark):
    """Nulls in any column, ties, repeated rows, long texts and columns with clashing names."""
    ready(spark)
    long = "word " * 50_000 + "."
    rows = [
        (1, None, "user", "First.", 9), (1, 1, None, None, 9), (1, 2, "user", long, 9), (1, 3, "assistant", "é 日.", 9),
        (2, None, None, None, 9), (3, 1, "user", "Same.", 9), (3, 1, "user", "Same.", 9), (3, 1, "user", "Same.", 9), (3, 2, "", "x.", 9),
    ]
    df = spark.createDataFrame(rows, SCHEMA + ", chunk int").withColumn("pos", F.lit("x")).withColumn("mark", F.lit(None).cast("int"))
    found = by_conversation(repair.repaired(df, df))
    assert found[1] == judged([(None, "user", "First.", 1), (1, " ", " ", 1), (2, "user", long, 1), (3, "assistant", "é 日.", 1)])
    assert found[2] == (0, 1, 0, 0, 0, 3, "D", EMPTY)
    assert found[3][:6] == (0, 0, 2, 0, 3, 8) and found[3][6] == "KDDR"
    nothing = df.where("false")
    assert repair.repaired(nothing, nothing).collect() == []
    assert by_conversation(repair.repaired(nothing, df))[1] == (0, 0, 0, 0, 0, 0, "", EMPTY)
    assert repair.repaired_turns(nothing).collect() == []
