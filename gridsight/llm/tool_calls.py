"""Tool-call linking for chat formatting (operator 1).

Calls and results are joined by conversation and call identifier. A call may need the results of others; calls get a
level, one more than the highest level they need, so that ascending (level, position) is a topological order. Arguments
are checked against the schema of the tool, and call and result become one record of canonical JSON: keys sorted by code
point, no white space, no number that JSON lacks.

Levels are found round by round over the table of needs: a call is settled when all it needs is. Where what a call needs waits
for one other call only, the need moves on to that one and keeps the distance, so that a chain takes rounds by the logarithm of its
length. Settled calls leave the table; what is left in the end needs itself. Nothing is gathered per conversation, so a
conversation may be of any length.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from functools import reduce
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import saved, words

RECORD = "conv_id bigint, call_id string, position bigint, name string, level int, status string, errors array<string>, record string"
_KINDS = {
    "string": lambda value: isinstance(value, str),
    "boolean": lambda value: isinstance(value, bool),
    "integer": lambda value: isinstance(value, int) and not isinstance(value, bool) or isinstance(value, float) and value.is_integer(),
    "number": lambda value: isinstance(value, int | float) and not isinstance(value, bool),
    "array": lambda value: isinstance(value, list),
    "object": lambda value: isinstance(value, dict),
    "null": lambda value: value is None,
}


def canonical(value: Any) -> str:
    """JSON in one form: sorted keys, no white space, whole numbers without a fraction."""

    def plain(one: Any) -> Any:
        if isinstance(one, float) and one.is_integer() and abs(one) < 2**53:
            return int(one)
        if isinstance(one, list):
            return [plain(inner) for inner in one]
        return {key: plain(inner) for key, inner in one.items()} if isinstance(one, dict) else one

    return json.dumps(plain(value), sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def problems(value: Any, schema: dict, path: str = "$") -> list[str]:
    """What a value breaks of a schema: type, enum, minimum, maximum, required, properties, additionalProperties, items."""
    found = []
    kinds = schema.get("type")
    kinds = [kinds] if isinstance(kinds, str) else kinds
    if kinds and not any(_KINDS[kind](value) for kind in kinds):
        return [f"{path}: not {'|'.join(kinds)}"]
    if "enum" in schema and value not in schema["enum"]:
        found.append(f"{path}: not in enum")
    if isinstance(value, int | float) and not isinstance(value, bool):
        if "minimum" in schema and value < schema["minimum"]:
            found.append(f"{path}: below minimum")
        if "maximum" in schema and value > schema["maximum"]:
            found.append(f"{path}: above maximum")
    if isinstance(value, dict):
        known = schema.get("properties", {})
        found += [f"{path}.{name}: missing" for name in sorted(schema.get("required", [])) if name not in value]
        for name in sorted(value):
            if name in known:
                found += problems(value[name], known[name], f"{path}.{name}")
            elif schema.get("additionalProperties", True) is False:
                found.append(f"{path}.{name}: unknown")
    if isinstance(value, list) and "items" in schema:
        for place, one in enumerate(value):
            found += problems(one, schema["items"], f"{path}[{place}]")
    return found


def _refused(name: str) -> Any:
    raise ValueError(name)


def _finite(digits: str) -> float:
    value = float(digits)
    return value if math.isfinite(value) else _refused(digits)


def argument_problems(arguments: str | None, schema: dict | None) -> tuple[Any, list[str]]:
    """The arguments as a value, and what is wrong with them.

    Text that is no JSON, or that has no canonical form (numbers beyond a double, half of a surrogate pair, too deep
    nesting), stays text.
    """
    try:
        value = json.loads(arguments or "", parse_constant=_refused, parse_float=_finite)
        canonical({"arguments": value}).encode()
        return value, ["$: unknown tool"] if schema is None else problems(value, schema)
    except (ValueError, RecursionError):
        return arguments, ["$: not JSON"]


def _records(schemas: dict[str, dict]):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in frames:
            out = []
            for row in rows.itertuples(index=False):
                level = None if pd.isna(row.level) else int(row.level)
                position = None if pd.isna(row.position) else int(row.position)
                conv_id = None if pd.isna(row.conv_id) else int(row.conv_id)
                if row.again:
                    value = argument_problems(row.arguments, schemas.get(row.name))[0] if row.called else None
                    status, errors = "duplicate", [f"{'call' if row.called else 'result'} repeats an identifier"]
                elif not row.called:
                    status, errors, value = "orphan", ["result without a call"], None
                else:
                    value, errors = argument_problems(row.arguments, schemas.get(row.name))
                    errors += [f"needs unknown {name}" for name in row.unknown]
                    status = "invalid" if errors else "ok"
                    if level is None:
                        status, errors = "cycle", [*errors, "needs itself"]
                    elif not row.answered:
                        status = "unanswered" if status == "ok" else status
                record = {"arguments": value, "call": row.call_id, "level": level, "name": row.name, "status": status}
                record |= {"result": row.content} if row.answered else {}
                out.append((conv_id, row.call_id, position, row.name, level, status, errors, canonical(record)))
            made = pd.DataFrame(out, columns=[part.split()[0] for part in RECORD.split(", ")])
            yield made.astype({"conv_id": "Int64", "position": "Int64", "level": "Int32"})

    return run


def levels(calls: DataFrame, needs: DataFrame) -> DataFrame:
    """(conv_id, call_id, level) of calls, from needs (conv_id, call_id, need) between known calls; calls of a cycle, and those that need one, are left out.

    A row of the table says that the level of a call is at least ``least`` and at least ``steps`` more than that of ``need``.
    """
    key = ["conv_id", "call_id"]
    size = calls.count()
    edges = saved(needs.select(*key, "need", F.lit(1).alias("steps"), F.lit(0).alias("least")), "call-edges")
    fresh = saved(calls.select(*key).join(edges.select(*key), key, "left_anti").withColumn("level", F.lit(0)), "call-levels")
    found = [fresh]
    while True:
        below = fresh.select("conv_id", F.col("call_id").alias("need"), F.col("level").alias("below"))
        looked = edges.join(below, ["conv_id", "need"], "left")
        reached = F.greatest("least", F.col("steps") + F.col("below"))
        calls_left = looked.groupBy(*key).agg(
            F.max(reached).alias("reached"), F.count_if(F.col("below").isNull()).alias("open"), F.max("steps").alias("most")
        )
        calls_left = saved(calls_left, "call-open")
        fresh = saved(calls_left.where("open = 0").select(*key, F.col("reached").alias("level")), "call-levels")
        found.append(fresh)
        # more steps than there are calls: the call needs itself, or one that does
        waiting = calls_left.where((F.col("open") > 0) & (F.col("most") <= size))
        rest = looked.where("below IS NULL").join(waiting, key)
        rest = rest.withColumn("least", F.greatest("least", F.coalesce("reached", F.lit(0))))
        only = rest.where("open = 1").select(
            "conv_id", F.col("call_id").alias("need"), F.col("need").alias("next"), F.col("steps").alias("further"), F.col("least").alias("floor")
        )
        moved = rest.join(only, ["conv_id", "need"], "left")
        moved = moved.select(
            *key, F.coalesce("next", "need").alias("need"), (F.col("steps") + F.coalesce("further", F.lit(0))).alias("steps"),
            F.greatest("least", F.coalesce(F.col("steps") + F.col("floor"), F.lit(0))).alias("least"), F.col("next").isNotNull().alias("moved"),
        )
        edges = saved(moved, "call-edges")
        if not fresh.limit(1).count() and not edges.where("moved").limit(1).count():
            return reduce(DataFrame.union, found)
        edges = edges.drop("moved")


def link(calls: DataFrame, results: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """One row per call, per result without a call, and per row that repeats an identifier: its level, status, errors and canonical record.

    ``calls`` has conv_id, call_id, position, name, arguments (JSON text) and needs (identifiers); ``results`` has
    conv_id, call_id, position, content. Of calls that share conversation and identifier, and likewise of results, the one with the lowest
    position is linked, then the least by its other columns; each other one is a row of status duplicate without a level, with its
    own arguments or content. Null conversations or identifiers match nothing: such a call is unanswered, such a
    result an orphan, each a row of its own. Status is ok, invalid (arguments break the schema, the tool is unknown, or a need names no call),
    unanswered, cycle, orphan or duplicate. Null or empty arguments are no JSON; arguments may be of any length. Empty tables give an empty one. Extra columns are
    not read.
    """
    calls = calls.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("call_id").cast("string").alias("call_id"),
        F.col("position").cast("long").alias("position"), F.col("name").cast("string").alias("name"),
        F.col("arguments").cast("string").alias("arguments"), F.coalesce("needs", F.array().cast("array<string>")).alias("needs"),
    )
    results = results.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("call_id").cast("string").alias("call_id"),
        F.col("position").cast("long").alias("position"), F.col("content").cast("string").alias("content"),
    )
    named = F.col("conv_id").isNotNull() & F.col("call_id").isNotNull()
    turn = lambda *others: F.row_number().over(
        W.partitionBy("conv_id", "call_id").orderBy(F.col("position").isNull(), "position", *others)
    )
    asks = saved(calls.where(named).withColumn("turn", turn("name", "arguments", "needs")), "calls")
    known = asks.where("turn = 1").drop("turn")
    answers = saved(results.where(named).withColumn("turn", turn("content")), "call-answers")
    repeated = answers.where("turn > 1").drop("turn")
    answers = answers.where("turn = 1").select("conv_id", "call_id", F.col("position").alias("answered_at"), "content", F.lit(True).alias("answered"))

    asked = known.select("conv_id", "call_id", F.explode(F.array_distinct("needs")).alias("need"))
    other = known.select("conv_id", F.col("call_id").alias("need"), F.lit(True).alias("is_call"))
    asked = saved(asked.join(other, ["conv_id", "need"], "left"), "call-needs")
    unknown = asked.where("is_call IS NULL").groupBy("conv_id", "call_id").agg(F.sort_array(F.collect_set("need")).alias("unknown"))
    placed = levels(known, asked.where("is_call").select("conv_id", "call_id", "need"))

    key = ["conv_id", "call_id"]
    rows = known.withColumn("called", F.lit(True)).join(placed, key, "left").join(unknown, key, "left").join(answers, key, "full")
    columns = ["conv_id", "call_id", "position", "name", "arguments", "level", "unknown", "called", "answered", "content"]
    rows = rows.withColumn("position", F.coalesce("position", "answered_at")).select(*columns)
    lost = calls.where(~named).select(
        "conv_id", "call_id", "position", "name", "arguments", F.lit(0).alias("level"), "needs", F.lit(True).alias("called"),
        F.lit(False).alias("answered"), F.lit(None).cast("string").alias("content"),
    ).toDF(*columns)
    uncalled = [
        "conv_id", "call_id", "position", F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(None).cast("int"),
        F.lit(None).cast("array<string>"), F.lit(False), F.lit(True), "content",
    ]
    stray = results.where(~named).select(*uncalled).toDF(*columns)
    later = asks.where("turn > 1").select(
        "conv_id", "call_id", "position", "name", "arguments", F.lit(None).cast("int").alias("level"), "needs", F.lit(True).alias("called"),
        F.lit(False).alias("answered"), F.lit(None).cast("string").alias("content"),
    ).toDF(*columns)
    later = later.unionByName(repeated.select(*uncalled).toDF(*columns)).withColumn("again", F.lit(True))
    rows = later.unionByName(rows.unionByName(lost).unionByName(stray).withColumn("again", F.lit(False)))
    rows = rows.withColumn("unknown", F.coalesce("unknown", F.array().cast("array<string>")))
    rows = rows.withColumn("called", F.coalesce("called", F.lit(False))).withColumn("answered", F.coalesce("answered", F.lit(False)))
    return rows.mapInPandas(_records(schemas), RECORD)


#: The tools of the test binding.
SCHEMAS: dict[str, dict] = {
    "search": {
        "type": "object", "required": ["query", "limit"], "additionalProperties": False,
        "properties": {"query": {"type": "string"}, "limit": {"type": "integer", "minimum": 1, "maximum": 50}},
    },
    "translate": {
        "type": "object", "required": ["query", "to"],
        "properties": {"query": {"type": "string"}, "to": {"type": "string", "enum": ["de", "en", "es", "fr"]}},
    },
    "summarise": {
        "type": "object", "required": ["query"], "properties": {"query": {"type": "string"}, "limit": {"type": "number"}},
    },
}


def conversation_calls(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results read out of plain conversations.

    A user's turn is a call: its tool follows from the length of its text, its arguments are the text, the number of words
    and a language; it needs the user's turn about half-way back to the start. The turn after it is the result. Turns of any other role
    (system, null or unknown) carry neither a call nor a result and give no row.
    """
    rows = turns.select("conv_id", F.col("turn").alias("position"), "role", F.col("text").alias("text"))
    half = F.floor(F.col("position") / 2)
    half = half - F.pmod(F.col("position") - half, F.lit(2))
    ident = lambda place: F.concat(F.lit("call-"), F.col("conv_id").cast("string"), F.lit("-"), place.cast("string"))
    number = F.length(F.coalesce("text", F.lit("")))
    tool = F.element_at(F.array(*map(F.lit, sorted(SCHEMAS))), (F.pmod(number, F.lit(3)) + 1).cast("int"))
    limit = F.size(words(F.col("text")))
    to = F.element_at(F.array(*map(F.lit, ("de", "en", "es", "fr", "xx"))), (F.pmod(number, F.lit(5)) + 1).cast("int"))
    arguments = F.when(
        tool == "search", F.to_json(F.struct(limit.alias("limit"), F.col("text").alias("query")))
    ).otherwise(F.to_json(F.struct(to.alias("to"), limit.alias("limit"), F.col("text").alias("query"))))
    first = half >= 1
    users = rows.where("role = 'user'")
    calls = users.select(
        "conv_id", ident(F.col("position")).alias("call_id"), "position", tool.alias("name"), arguments.alias("arguments"),
        F.when(first & (half < F.col("position")), F.array(ident(half))).otherwise(F.array().cast("array<string>")).alias("needs"),
    )
    results = rows.where("role = 'assistant'").select(
        "conv_id", ident(F.col("position") - 1).alias("call_id"), "position", F.col("text").alias("content")
    )
    return calls, results
