"""Mixing sources to target weights by pivotal dependent rounding (operator 2).

Every document of a source should be taken target / size times, which is a whole number of copies and a fraction. The
fractions are rounded in pairs: words pass at random from one document of a pair to the other until one of the two
holds none or all of its own, with odds that leave each one's expectation as it was. What the pair takes together does
not change, so a source comes within one document of its target. One fractional document is left of a leaf of a few
thousand; these residuals are paired again a level higher, in a tree of fixed fan-in, until each source has one left,
which is drawn by its fraction. What that draw adds or takes is made up for by documents of the last group that were
rounded, the largest first that bring the sum nearer: a source of few documents, one of them long, would else miss its
target by much.
"""

from __future__ import annotations

import random
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import saved, words

LEAF_ROWS = 2048
FAN_IN = 64
#: Fixed value: the weights of the sources in order of their names, repeating.
WEIGHTS = (1, 2, 3)
MOST_COPIES = 3
TINY = 1e-9
STATE = "doc_id bigint, source string, size bigint, node bigint, copies bigint, fraction double"


def source_targets(sizes: DataFrame, most: int = MOST_COPIES) -> DataFrame:
    """Per source its words, rows and target, from a table with source and size.

    Targets share all words by weight. A source is capped at ``most`` times its words, and the excess goes to the others
    by weight: the target of an uncapped source is its weight times one level. Sources in order of cap by weight are
    capped up to the point where the level of the rest no longer exceeds the next one's ratio. The windows run over one
    row per source.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("source_rows"))
    place = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.pmod(place, F.lit(len(WEIGHTS))) + 1).cast("int"))
    caps = totals.withColumn("weight", weight).withColumn("cap", F.col("source_size") * most)
    caps = caps.withColumn("ratio", F.col("cap") / F.col("weight"))
    everything = W.partitionBy()
    lower = W.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(W.unboundedPreceding, -1)
    rest = F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(lower), F.lit(0))
    weights = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(lower), F.lit(0))
    caps = caps.withColumn("level_here", rest / weights).withColumn("level", F.max("level_here").over(everything))
    target = F.least(F.col("cap").cast("double"), F.col("weight") * F.col("level"))
    return caps.select("source", "source_size", "source_rows", "weight", target.alias("target"))


def settle(rows: list[list], rng: random.Random) -> None:
    """Rounds fractions pairwise in place until at most one is left; a row is [size, copies, fraction]."""
    held = None
    for row in rows:
        if not 0.0 < row[2] < 1.0:
            continue
        if held is None:
            held = row
            continue
        (size, _, here), (other, _, there) = held, row
        up = min((1.0 - here) * size, there * other)  # words that can pass to the held document
        down = min(here * size, (1.0 - there) * other)  # words that can pass from it
        if rng.random() * (up + down) < down:
            held[2], row[2] = here + up / size, there - up / other
        else:
            held[2], row[2] = here - down / size, there + down / other
        for one in (held, row):
            if one[2] < TINY or one[2] > 1.0 - TINY:
                one[1], one[2] = one[1] + round(one[2]), 0.0
        held = next((one for one in (held, row) if one[2] > 0.0), None)


def make_up(rows: list[list], before: list[tuple], wanted: float) -> None:
    """Rounds some fractions the other way, so that the words taken come nearer to those wanted; ``before`` has the copies and
    fractions that ``rows``, largest first, were rounded from."""
    missing = wanted - sum(size * copies for size, copies, _ in rows)
    for row, (copies, fraction) in zip(rows, before):
        change = 0 if fraction <= 0.0 else 1 if row[1] == copies else -1
        if abs(missing - change * row[0]) < abs(missing):
            row[1] += change
            missing -= change * row[0]


def _settled(seed: int, level: int, last: bool):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        # large documents first: what is left over at the end is then likely a small one
        rows = rows.sort_values(["size", "doc_id", "copies"], ascending=[False, True, True], kind="stable")
        first = rows.iloc[0]
        rng = random.Random(f"{seed}|{level}|{first['source']!r}|{first['node']}")
        state = [list(one) for one in zip(rows["size"], rows["copies"], rows["fraction"])]
        before, wanted = [(one[1], one[2]) for one in state], sum(one[0] * (one[1] + one[2]) for one in state)
        settle(state, rng)
        if last:
            for one in state:
                if one[2] > 0.0:
                    one[1], one[2] = one[1] + (rng.random() < one[2]), 0.0
            make_up(state, before, wanted)
        return rows.assign(copies=[one[1] for one in state], fraction=[one[2] for one in state])

    return run


def mix(
    docs: DataFrame, seed: int = 17, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source"
) -> DataFrame:
    """Per row of the table: doc_id, source, size, source_size, target, copies, taken.

    The size is the words of the text, none for a null or empty one, which is taken no time. A null source is a source
    of its own, last in order. Texts are used whole, however long. Repeated rows are documents of their own. A null id is a document like others. Results
    depend on the rows and the seed alone, not on how they lie in files. An empty table gives an empty one.
    """
    size = F.size(words(F.col(text_column))).cast("long")
    names = [F.col(id_column).cast("long").alias("doc_id"), F.col(source_column).cast("string").alias("source")]
    sizes = saved(docs.select(*names, size.alias("size")), "mixing-sizes")
    targets = saved(source_targets(sizes), "mixing-targets")  # its size on disk lets Spark decide on a broadcast
    wanted = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    wanted = F.when(F.col("size") > 0, F.least(wanted, F.lit(float(MOST_COPIES)))).otherwise(0.0)
    copies = F.floor(wanted + TINY)
    fraction = F.greatest(wanted - copies, F.lit(0.0))
    fraction = F.when(fraction < TINY, 0.0).otherwise(fraction)
    leaves = F.ceil(F.col("source_rows") / LEAF_ROWS)
    drawn = sizes.join(targets, sizes["source"].eqNullSafe(targets["source"])).select(
        sizes["doc_id"], sizes["source"], "size", F.pmod(F.xxhash64("doc_id", "size"), leaves).alias("node"),
        copies.alias("copies"), fraction.alias("fraction"),
    )
    most = targets.agg(F.max(leaves)).first()[0] or 1
    done, level = [], 0
    while True:
        last = most == 1
        held = saved(drawn.groupBy("source", "node").applyInPandas(_settled(seed, level, last), STATE), "mixing-level")
        done.append(held.where("fraction = 0"))
        if last:
            break
        drawn = held.where("fraction > 0").withColumn("node", F.floor(F.col("node") / FAN_IN))
        most, level = -(-most // FAN_IN), level + 1
    settled = reduce(DataFrame.unionAll, done)
    joined = settled.join(targets, settled["source"].eqNullSafe(targets["source"]))
    return joined.select(
        "doc_id", settled["source"], "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken")
    )


def mixed_documents(docs: DataFrame, seed: int = 17) -> DataFrame:
    """The documents as often as the mix takes them; columns as they were.

    Rows that share an id and a size are interchangeable to the mix: their copies are dealt among them in equal parts.
    """
    taken = mix(docs, seed).where("copies > 0").groupBy("doc_id", "size").agg(F.sum("copies").alias("copies"))
    keyed = docs.withColumn("__mix_size", F.size(words(F.col("text"))).cast("long"))
    taken = taken.select(F.col("doc_id").alias("__mix_id"), F.col("size").alias("__mix_words"), F.col("copies").alias("__mix_copies"))
    same = keyed["doc_id"].cast("long").eqNullSafe(taken["__mix_id"]) & (keyed["__mix_size"] == taken["__mix_words"])
    joined = keyed.join(taken, same)
    alike = W.partitionBy("__mix_id", "__mix_words")
    place = F.row_number().over(alike.orderBy(F.lit(0))) - 1
    rows = F.count(F.lit(1)).over(alike)
    share = joined.withColumn("__mix_rows", rows).withColumn("__mix_place", place)
    times = F.floor((F.col("__mix_copies") + F.col("__mix_rows") - 1 - F.col("__mix_place")) / F.col("__mix_rows"))
    turns = F.when(times > 0, F.sequence(F.lit(1), times.cast("int"))).otherwise(F.array().cast("array<int>"))
    return share.withColumn("__mix_turn", F.explode(turns)).select(*docs.columns)
