"""Conversation structure repair by a generalised LR parser with edits (operator 11).

Grammar of role initials: Talk -> () | Body, Body -> Lead u a | Body u a, Lead -> () | s; as an expression ``(s?(ua)+)?``.

Edits. A turn is kept (K, free), given the role user or assistant (R, 2) or deleted (D, 3; the only way for a blank or
repeated turn); an empty turn of user or assistant may be inserted anywhere (I, 2). A truncated turn that stays adds 1.
The repair is the cheapest sequence of edits whose roles the grammar accepts, the least in ASCII order among equals.

Graph-structured stack. All sequences of edits are parsed at once. A turn takes every stack on by its actions, after any
insertions; stacks with equal tops are merged, and the one with the least (cost, audit) stays. The grammar leaves one
stack below each top, so a front is a cost and a rank for each of five tops. Audits are compared by the rank of what came before and
then by what was added: each ends with the edit of the same turn, so none is the beginning of another. Costs count from
the cheapest top, and a top that is far behind can never catch up and goes; so there are few fronts, and a step from
front to front is worked out once per worker.

Long conversations. Turns are sorted over the cluster and cut into chunks of rows. The conversation at an end of a chunk
may go on in the next: from each top it may be entered with, a chunk says what leaving it by each top costs and in which order the audits are;
these few rows are chained per conversation, and then each chunk is parsed again from the top it is entered with. A
conversation's size matters only where its texts are hashed: a hash is sequential, so they are streamed, in order and in
batches.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, ready, saved

#: Rows of a chunk, about.
CHUNK_ROWS = 20_000

_START, _SYSTEM, _LEAD, _ASKED, _ANSWERED, _BODY, _AGAIN, _AGAIN_ANSWERED = range(8)
_SHIFT = {
    (_START, "s"): _SYSTEM, (_LEAD, "u"): _ASKED, (_ASKED, "a"): _ANSWERED, (_BODY, "u"): _AGAIN, (_AGAIN, "a"): _AGAIN_ANSWERED,
}
#: States that end a rule: the rule's head and its length.
_REDUCE = {_SYSTEM: ("Lead", 1), _ANSWERED: ("Body", 3), _AGAIN_ANSWERED: ("Body", 3)}
_GOTO = {"Lead": _LEAD, "Body": _BODY}
_ACCEPTING = (_START, _BODY)

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
#: A top that costs so much more than the cheapest never wins: one system turn (3) and two insertions (4) make up for any top.
FAR_BEHIND = 12
MOST_INSERTED = 2
_ROLES = {"u": "user", "a": "assistant"}


def pushed(stack: tuple[int, ...], initial: str) -> tuple[int, ...] | None:
    """The stack after a role, or None where the grammar has no place for it."""
    if stack[-1] == _START and initial == "u":
        stack += (_GOTO["Lead"],)  # Lead -> ()
    if (stack[-1], initial) not in _SHIFT:
        return None
    stack += (_SHIFT[stack[-1], initial],)
    while stack[-1] in _REDUCE:
        head, size = _REDUCE[stack[-1]]
        stack = stack[:-size] + (_GOTO[head],)
    return stack


def _stacks() -> list[tuple[int, ...]]:
    found = [(_START,)]
    for stack in found:
        found += [new for new in (pushed(stack, initial) for initial in "sua") if new is not None and new not in found]
    return found


STACKS = _stacks()
assert len({stack[-1] for stack in STACKS}) == len(STACKS)  # merging by top loses no stack
NEXT = [{initial: STACKS.index(new) for initial in "sua" if (new := pushed(stack, initial)) is not None} for stack in STACKS]
ENDS = [stack[-1] in _ACCEPTING for stack in STACKS]


def _inserted(top: int) -> tuple[int, str] | None:
    """The top after an inserted turn and its initial."""
    return next(((new, initial) for initial, new in NEXT[top].items() if initial in _ROLES), None)


def closing(top: int) -> str:
    """Initials of the turns to insert at the end."""
    added = ""
    while not ENDS[top]:
        top, initial = _inserted(top)
        added += initial
    return added


#: What a turn is: its initial as a place in "sua", or 3; whether it must go; whether it is truncated.
def kind(initial: int, must_go: bool, truncated: bool) -> int:
    return initial * 4 + 2 * must_go + truncated


GONE = kind(3, True, False)
Front = tuple[tuple[int, int] | None, ...]


def entered(top: int) -> Front:
    """The front with one stack."""
    return tuple((0, 0) if place == top else None for place in range(len(STACKS)))


class Parser:
    """Steps between fronts, each worked out once.

    A step is the next front, the cost to add, and per top where it came from: the top before, the initials inserted, the
    edit, the initial given.
    """

    def __init__(self):
        self.steps: dict[tuple[Front, int], tuple[Front, int, tuple]] = {}

    def step(self, front: Front, what: int) -> tuple[Front, int, tuple]:
        known = self.steps.get((front, what))
        if known is None:
            known = self.steps[front, what] = self._step(front, what)
        return known

    @staticmethod
    def _step(front: Front, what: int) -> tuple[Front, int, tuple]:
        initial, must_go, truncated = "sua?"[what // 4], what & 2, what & 1
        best: dict[int, tuple] = {}
        for before, held in enumerate(front):
            if held is None:
                continue
            cost, rank = held
            top, added = before, ""
            for _ in range(MOST_INSERTED + 1):
                edits = [(DELETE, "D", top, "")]
                if not must_go:
                    stay = TRUNCATED if truncated else 0
                    edits += [(KEEP + stay, "K", NEXT[top][initial], initial)] if initial in NEXT[top] else []
                    edits += [(REROLE + stay, "R", new, to) for to, new in NEXT[top].items() if to in _ROLES and to != initial]
                for price, letter, new, given in edits:
                    found = (cost + price, rank, "I" * len(added) + letter, before, added, given)
                    if new not in best or found < best[new]:
                        best[new] = found
                top, to = _inserted(top)
                added, cost = added + to, cost + INSERT
        least = min(found[0] for found in best.values())
        best = {top: found for top, found in best.items() if found[0] <= least + FAR_BEHIND}
        ranks = {one: place for place, one in enumerate(sorted({found[1:3] for found in best.values()}))}
        tops = range(len(STACKS))
        new_front = tuple((best[top][0] - least, ranks[best[top][1:3]]) if top in best else None for top in tops)
        links = tuple((best[top][3], best[top][4], best[top][2][-1], best[top][5]) if top in best else None for top in tops)
        return new_front, least, links

    def run(self, top: int, kinds: list[int]) -> tuple[Front, int, list[tuple]]:
        """The last front, its cost, and the links of all turns."""
        front, total, links = entered(top), 0, []
        for what in kinds:
            front, cost, link = self.step(front, what)
            total += cost
            links.append(link)
        return front, total, links


def traced(links: list[tuple], top: int) -> list[tuple[str, str, str]]:
    """Per turn the initials inserted before it, its edit, and the initial given, on the way to a top."""
    found = []
    for link in reversed(links):
        top, added, letter, given = link[top]
        found.append((added, letter, given))
    return found[::-1]


def finish(front: Front) -> int:
    """The top that a conversation ends with, by cost and audit with the insertions at the end."""
    ends = [(held[0] + INSERT * len(closing(top)), held[1], len(closing(top)), top) for top, held in enumerate(front) if held]
    return min(ends)[-1]


SLIM = "chunk int, pos long, conv string, kind int, copies long"
EDITED = "chunk int, pos long, edits string, before array<string>, role string, after array<string>, cost long, illegal long"
ENDS_OF = "conv string, chunk int, first int, last int, costs array<long>, ranks array<int>"
HASHED = "conv string, illegal long, cost long, audit string, repaired_sha256 string"
CHOSEN = "chunk int, conv string, entry int, exit int, ends boolean, previous int"
_LEGAL = {(0, 1), (1, 2), (2, 1)}


def _segments(rows: pd.DataFrame) -> Iterator[tuple[str, pd.DataFrame]]:
    """Conversations of a chunk in order."""
    rows = rows.sort_values("pos")
    starts = (rows["conv"] != rows["conv"].shift()).to_numpy().nonzero()[0].tolist()
    for begin, end in zip(starts, [*starts[1:], len(rows)]):
        yield rows["conv"].iloc[begin], rows.iloc[begin:end]


def _spelled(rows: pd.DataFrame) -> list[int]:
    """Kinds of the turns of a segment; copies after the first must go."""
    out: list[int] = []
    for what, copies in zip(rows["kind"].tolist(), rows["copies"].tolist()):
        out.append(what)
        out.extend([GONE] * (copies - 1))
    return out


def _summarised(rows: pd.DataFrame) -> pd.DataFrame:
    """What the first and the last conversation of a chunk cost from each top to each top."""
    parser, out = Parser(), []
    parts = list(_segments(rows[["chunk", "pos", "conv", "kind", "copies"]]))
    for conv, part in dict([parts[0], parts[-1]]).items():
        kinds, costs, ranks = _spelled(part), [], []
        for top in range(len(STACKS)):
            front, total, _ = parser.run(top, kinds)
            costs += [total + held[0] if held else -1 for held in front]
            ranks += [held[1] if held else -1 for held in front]
        out.append((conv, rows["chunk"].iloc[0], kinds[0] // 4, part["kind"].iloc[-1] // 4, costs, ranks))
    return pd.DataFrame(out, columns=["conv", "chunk", "first", "last", "costs", "ranks"])


def _chained(rows: pd.DataFrame) -> pd.DataFrame:
    """By which tops a conversation enters and leaves its chunks."""
    rows, size = rows.sort_values("chunk"), len(STACKS)
    front, came = entered(0), []
    for costs, ranks in zip(rows["costs"], rows["ranks"]):
        best: dict[int, tuple] = {}
        for entry, held in enumerate(front):
            for leave in range(size):
                if held and costs[entry * size + leave] >= 0:
                    found = (held[0] + int(costs[entry * size + leave]), held[1], int(ranks[entry * size + leave]), entry)
                    if leave not in best or found < best[leave]:
                        best[leave] = found
        order = {one: place for place, one in enumerate(sorted({found[1:3] for found in best.values()}))}
        front = tuple((best[top][0], order[best[top][1:3]]) if top in best else None for top in range(size))
        came.append({top: found[3] for top, found in best.items()})
    top, out = finish(front), []
    for place in reversed(range(len(rows))):
        row = rows.iloc[place]
        previous = int(rows["last"].iloc[place - 1]) if place else -1
        out.append((row["chunk"], row["conv"], came[place][top], top, place == len(rows) - 1, previous))
        top = came[place][top]
    return pd.DataFrame(out, columns=[part.split()[0] for part in CHOSEN.split(", ")])


def _edited(rows: pd.DataFrame, chosen: pd.DataFrame) -> pd.DataFrame:
    """The edits of each row of a chunk."""
    parser, out = Parser(), []
    told = {row.conv: row for row in chosen.itertuples()}
    if not len(rows):
        return pd.DataFrame(columns=[part.split()[0] for part in EDITED.split(", ")])
    for conv, part in _segments(rows):
        choice = told.get(conv)
        kinds = _spelled(part)
        front, _, links = parser.run(choice.entry if choice else 0, kinds)
        top = choice.exit if choice else finish(front)
        edits = iter(traced(links, top))
        previous = choice.previous if choice else -1
        for chunk, pos, what, copies in zip(part["chunk"], part["pos"], part["kind"], part["copies"]):
            added, letter, given = next(edits)
            before, after, audit = list(added), [], "I" * len(added) + letter
            cost = INSERT * len(added) + {"K": KEEP, "R": REROLE, "D": DELETE}[letter] + (TRUNCATED if letter != "D" and what & 1 else 0)
            for _ in range(copies - 1):
                more, again, _ = next(edits)
                after += more
                audit += "I" * len(more) + again
                cost += INSERT * len(more) + DELETE
            illegal = int(previous >= 0 and (previous, what // 4) not in _LEGAL) + copies - 1
            previous = what // 4
            role = letter if letter in "KD" else _ROLES[given]
            out.append([chunk, pos, audit, before, role, after, cost, illegal])
        if choice is None or choice.ends:
            added = closing(top)
            out[-1][2] += "I" * len(added)
            out[-1][5] = out[-1][5] + list(added)
            out[-1][6] += INSERT * len(added)
    for row in out:
        row[3], row[5] = [_ROLES[one] for one in row[3]], [_ROLES[one] for one in row[5]]
    return pd.DataFrame(out, columns=[part.split()[0] for part in EDITED.split(", ")])


def damage(rows: DataFrame) -> DataFrame:
    """Conversations with faults put in by CRC-32 of ``conv_id:turn``, modulo 20: 0 drops a turn, 1 empties its text, 2 takes
    its stops away, 3 repeats it, 4 makes it the user's. Nulls of turn, role and text count as one space; the columns
    are conv_id, turn, role, text and copies, which counts adjacent repeats."""
    spelled = [F.coalesce(F.col(name).cast("string"), F.lit(" ")) for name in ("conv_id", "turn")]
    choice = F.crc32(F.concat_ws(":", *spelled).cast("binary")) % 20
    text, role = (F.coalesce(F.col(name).cast("string"), F.lit(" ")) for name in ("text", "role"))
    changed = F.when(choice == 1, F.lit("")).when(choice == 2, F.translate(text, ".!?", "")).otherwise(text)
    return rows.where(choice != 0).select(
        "conv_id", F.col("turn").cast("long").alias("turn"), F.when(choice == 4, F.lit("user")).otherwise(role).alias("role"),
        changed.alias("text"), F.when(choice == 3, F.lit(2)).otherwise(F.lit(1)).cast("long").alias("copies"),
    )


def _order(turn: str = "turn") -> Column:
    return F.struct(F.col(turn).isNotNull(), F.col(turn))


def faults(rows: DataFrame) -> DataFrame:
    """One row per distinct turn (conversation, turn, role, text): conv, turn, role, text, mark, copies, blank, repeated, truncated.

    ``repeated`` says that the role and text were seen at an earlier turn, copies after the first are repeated anyway.
    Copies are counted before they are moved, so that a turn repeated any number of times is one row. ``conv`` is the
    conversation as text, "=" before it, and empty for a null one.
    """
    conv = F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("")).alias("conv")
    text, role = (F.coalesce(F.col(name), F.lit(" ")).alias(name) for name in ("text", "role"))
    copies = F.col("copies") if "copies" in rows.columns else F.lit(1).cast("long")
    turns = rows.select(conv, F.col("turn").cast("long").alias("turn"), role, text, copies.alias("copies"))
    turns = turns.withColumn("mark", F.sha2(F.col("text").cast("binary"), 256))
    first = turns.groupBy("conv", "role", "mark").agg(F.min(_order()).alias("seen"))
    turns = turns.groupBy("conv", "turn", "role", "mark").agg(F.sum("copies").alias("copies"), F.any_value("text").alias("text"))
    turns = turns.join(first, ["conv", "role", "mark"]).withColumn("repeated", _order() > F.col("seen"))
    last = F.right(F.rtrim(F.col("text"), F.lit(SPACES)), F.lit(1))
    blank = last == ""
    return turns.select(
        "conv", "turn", "role", "text", "mark", "copies", blank.alias("blank"), (~blank & F.col("repeated")).alias("repeated"),
        (~blank & ~F.col("repeated") & ~last.isin(".", "!", "?")).alias("truncated"),
    )


def edits(turns: DataFrame, chunk_rows: int = CHUNK_ROWS) -> tuple[DataFrame, DataFrame]:
    """Turns in order, with chunk and pos, and the edits of each: (chunk, pos, edits, before, role, after, cost, illegal).

    ``before`` and ``after`` are the roles of inserted turns; ``role`` is K where the turn stays, D where it goes, else the
    role it gets.
    """
    size = turns.count()
    initial = F.left("role", F.lit(1))
    code = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    must_go = F.col("blank") | F.col("repeated")
    coded = turns.withColumn("kind", (code * 4 + must_go.cast("int") * 2 + F.col("truncated").cast("int")).cast("int"))
    chunks = max(1, -(-size // chunk_rows))
    key = ["conv", F.col("turn").isNotNull(), "turn", "role", "mark"]
    ordered = coded.repartitionByRange(chunks, *key).sortWithinPartitions(*key)
    ordered = ordered.withColumn("chunk", F.spark_partition_id()).withColumn("pos", F.monotonically_increasing_id())
    ordered = saved(ordered, "repair-ordered")
    slim = ordered.select("chunk", "pos", "conv", "kind", "copies")
    ends = slim.groupBy("chunk").applyInPandas(_summarised, ENDS_OF)  # two rows per chunk at most
    chosen = saved(ends.groupBy("conv").applyInPandas(_chained, CHOSEN), "repair-chosen")
    found = slim.groupBy("chunk").cogroup(chosen.groupBy("chunk")).applyInPandas(_edited, EDITED)
    return ordered, saved(found, "repair-edits")


def _lines(table: DataFrame) -> Column:
    """The turns that a row stands for after repair, as an array of (role, text)."""
    def empty(name):
        return F.transform(name, lambda role: F.struct(role.alias("role"), F.lit("").alias("text")))

    role = F.when(F.col("new_role") == "K", F.col("role")).otherwise(F.col("new_role"))
    own = F.array(F.struct(role.alias("role"), F.col("text").alias("text")))
    return F.concat(empty("before"), F.when(F.col("new_role") == "D", F.slice(own, 1, 0)).otherwise(own), empty("after"))


def _joined(ordered: DataFrame, found: DataFrame) -> DataFrame:
    return ordered.join(found.withColumnRenamed("role", "new_role"), ["chunk", "pos"])


def repaired_turns(rows: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """The repaired conversations, one row per turn: conv (as in ``faults``), chunk, pos, line, role, text; sorted by the first four they
    are in order. Nulls, ties and empty tables as in ``repaired``."""
    ready(rows.sparkSession)
    table = _joined(*edits(faults(rows), chunk_rows))
    table = table.select("conv", "chunk", "pos", F.posexplode(_lines(table)).alias("line", "turn"))
    return table.select("conv", "chunk", "pos", "line", "turn.role", "turn.text")


def _hashed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sums, audit and hash of each conversation of a sorted stream."""
    columns = [part.split()[0] for part in HASHED.split(", ")]
    conv, sums, audit, state, fresh = None, [0, 0], [], hashlib.sha256(), True
    for rows in frames:
        out = []
        for name, illegal, cost, part, text in zip(rows["conv"], rows["illegal"], rows["cost"], rows["edits"], rows["text"]):
            if name != conv:
                if conv is not None:
                    out.append((conv, *sums, "".join(audit), state.hexdigest()))
                conv, sums, audit, state, fresh = name, [0, 0], [], hashlib.sha256(), True
            sums[0] += illegal
            sums[1] += cost
            audit.append(part)
            if text is not None:
                state.update((text if fresh else "\n" + text).encode("utf-8", "surrogatepass"))
                fresh = False
        if out:
            yield pd.DataFrame(out, columns=columns)
    if conv is not None:
        yield pd.DataFrame([(conv, *sums, "".join(audit), state.hexdigest())], columns=columns)


def repaired(rows: DataFrame, conversations: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """One row per conversation of ``conversations``: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    ``rows`` has conv_id, turn, role, text and, where given, copies. Turns go in order, nulls first; turns that tie go by
    role and a hash of the text, equal ones are copies of each other. A null role or text is one space, a role other than
    system, user and assistant cannot stay. Rows of a null conversation are one conversation. A conversation without
    rows has zeros, an empty audit and the hash of nothing; without conversations the result is empty. Other columns
    are not read.
    """
    ready(rows.sparkSession)
    turns = saved(faults(rows), "repair-faults")
    more = F.col("copies") - 1
    counted = turns.groupBy("conv", "turn").agg(
        F.sum(F.when(F.col("blank"), F.col("copies")).otherwise(0)).alias("blank"),
        F.sum(F.when(F.col("blank"), 0).when(F.col("repeated"), F.col("copies")).otherwise(more)).alias("duplicate"),
        F.sum(F.col("truncated").cast("long")).alias("truncated"),
    )
    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).alias("gaps")
    counted = counted.groupBy("conv").agg(gaps, *[F.sum(name).alias(name) for name in ("blank", "duplicate", "truncated")])
    ordered, found = edits(turns, chunk_rows)
    table = _joined(ordered, found)
    lines = F.transform(_lines(table), lambda turn: F.concat(turn["role"], F.lit(":"), turn["text"]))
    text = F.when(F.size(lines) > 0, F.array_join(lines, "\n")).alias("text")
    stream = table.select("conv", "chunk", "pos", "illegal", "cost", "edits", text)
    hashed = stream.repartition("conv").sortWithinPartitions("conv", "chunk", "pos").mapInPandas(_hashed, HASHED)

    conv = F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit(""))
    out = conversations.select("conv_id").distinct().withColumn("conv", conv)
    for part in (counted, hashed):
        out = out.join(part, "conv", "left")
    numbers = [F.coalesce(F.col(name), F.lit(0)).cast("long").alias(name) for name in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    nothing = hashlib.sha256(b"").hexdigest()
    return out.select(
        "conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(nothing)).alias("repaired_sha256")
    )
