"""Quality rules as weak supervision (operator 3); DataFrame functions only.

Each rule looks at one statistic of a text and votes good, bad or abstains. No rule is trusted outright: expectation
maximisation estimates from all votes how often each rule votes how on good and on bad texts, and a text is kept if the
posterior probability that it is good reaches a threshold. A hard base (too few words, too much repetition) goes first.

Votes of a text form a pattern of a few symbols; texts are counted by pattern, so whatever the size of the corpus the
estimation sees at most 3 ** rules rows, and the posterior of a text is looked up by its pattern.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved, words

LEAST_WORDS = 50
MOST_REPEATED_PERCENT = 50
#: Fixed value: the symbols counted.
SYMBOLS = "#*$%&|<>"
KEEP_FROM = 0.5
ROUNDS = 50
#: Pseudo-counts of a good, a bad and no vote on good and on bad texts, and of good and bad texts: where estimation starts
#: and what keeps chances off 0. They say which class is the good one; a bad text of one kind passes most other rules, so a
#: good vote tells little at first.
ON_GOOD, ON_BAD = (10.0, 0.5, 6.0), (6.0, 8.0, 6.0)
CLASSES = (8.0, 2.0)
GOOD, BAD, ABSTAIN = "g", "b", "-"


def _statistics(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), text.alias("body"))
    rows = rows.withColumn("words", words(F.col("body")))
    listed = F.col("words")
    lines = F.filter(F.split("body", "\n"), lambda line: F.length(F.translate(line, " \t\x0b\x0c\r", "")) > 0)
    rows = rows.withColumn("lines", lines)
    windows = F.when(
        F.size(listed) >= 4,
        F.transform(
            F.sequence(F.lit(0), F.size(listed) - 3),
            lambda at: F.xxhash64(F.get(listed, at), F.get(listed, at + 1), F.get(listed, at + 2)),
        ),
    ).otherwise(F.array().cast("array<bigint>"))
    # equal windows become neighbours when sorted by hash; each place of a repeated one covers three words, or as many as
    # lie before the next such place
    rows = rows.withColumn("windows", windows)
    hashes = F.col("windows")
    marked = F.when(
        F.size(F.array_distinct(hashes)) < F.size(hashes),
        F.sort_array(F.transform(hashes, lambda value, at: F.struct(value.alias("h"), at.alias("at")))),
    ).otherwise(F.array().cast("array<struct<h:bigint,at:int>>"))
    rows = rows.withColumn("marked", marked)
    sort = F.col("marked")
    twice = F.filter(
        sort,
        lambda one, at: (F.get(sort, at - 1)["h"] == one["h"]) | (F.get(sort, at + 1)["h"] == one["h"]),
    )
    rows = rows.withColumn("twice", F.sort_array(F.transform(twice, lambda one: one["at"])))
    starts = F.col("twice")
    covered = F.aggregate(
        F.transform(starts, lambda start, at: F.least(F.lit(3), F.coalesce(F.get(starts, at + 1) - start, F.lit(3)))),
        F.lit(0), lambda total, step: total + step,
    )
    length = F.length("body")
    return rows.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.translate("body", " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        (length - F.length(F.translate("body", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        covered.cast("long").alias("n_repeat_words"),
        (length - F.length(F.translate("body", "!", ""))).cast("long").alias("n_shouts"),
        F.size("lines").cast("long").alias("n_lines"),
        F.length(F.regexp_replace("body", r"\P{Lu}+", "")).cast("long").alias("n_capitals"),
        F.length(F.regexp_replace("body", r"\P{L}+", "")).cast("long").alias("n_letters"),
        (length - F.length(F.translate("body", ".?!", ""))).cast("long").alias("n_stops"),
    )


def rules() -> dict[str, tuple[Column, Column]]:
    """Per rule when it votes bad and when it votes good; otherwise it abstains."""
    n, chars, never = F.col("n_words"), F.greatest(F.col("word_chars"), F.lit(1)), F.lit(False)
    share = {name: F.col(name) / F.greatest(n, F.lit(1)) for name in ("n_symbols", "n_repeat_words", "n_shouts", "n_stops")}
    lines = F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1))
    capitals, letters, mean = F.col("n_capitals") / chars, F.col("n_letters") / chars, chars / F.greatest(n, F.lit(1))
    return {
        "symbols": (share["n_symbols"] > 0.3, never),
        "shouts": (share["n_shouts"] > 0.3, never),
        "repeated": (share["n_repeat_words"] > 0.35, share["n_repeat_words"] < 0.1),
        "lines": ((lines > 0.4) & (F.col("n_dup_lines") >= 3), never),
        "capitals": (capitals > 0.4, capitals < 0.15),
        "letters": (letters < 0.75, letters > 0.94),
        "stops": ((share["n_stops"] > 0.5) | ((share["n_stops"] < 0.005) & (n >= 100)), share["n_stops"].between(0.02, 0.3)),
        "length": ((mean < 2) | (mean > 15), mean.between(3, 10)),
    }


def votes() -> Column:
    """The pattern of all rules' votes, one symbol each."""
    return F.concat(*[F.when(bad, BAD).when(good, GOOD).otherwise(ABSTAIN) for bad, good in rules().values()])


def chances(patterns: dict[str, int], weight: dict[str, float], place: int, prior: tuple[float, ...]) -> dict[str, float]:
    """Chance of each vote of one rule on one class, from patterns weighted by how likely they are of that class."""
    seen = dict(zip((GOOD, BAD, ABSTAIN), prior))
    for pattern, count in sorted(patterns.items()):
        seen[pattern[place]] += count * weight[pattern]
    total = sum(seen.values())
    return {vote: amount / total for vote, amount in seen.items()}


def posteriors(patterns: dict[str, int], rounds: int = ROUNDS) -> dict[str, float]:
    """Probability of a good text for each pattern, by expectation maximisation over patterns and their counts."""
    if not patterns:
        return {}
    places, nothing = range(len(next(iter(patterns)))), dict.fromkeys(patterns, 0.0)
    share = CLASSES[0] / sum(CLASSES)
    on_good = [chances(patterns, nothing, place, ON_GOOD) for place in places]
    on_bad = [chances(patterns, nothing, place, ON_BAD) for place in places]
    good = nothing
    for _ in range(rounds):
        good = {}
        for pattern in sorted(patterns):
            odds = math.log(share / (1.0 - share))
            odds += sum(math.log(on_good[place][vote] / on_bad[place][vote]) for place, vote in enumerate(pattern))
            good[pattern] = 1.0 / (1.0 + math.exp(-max(-700.0, min(700.0, odds))))
        bad = {pattern: 1.0 - weight for pattern, weight in good.items()}
        total = sum(patterns.values())
        share = (sum(patterns[pattern] * good[pattern] for pattern in patterns) + CLASSES[0]) / (total + sum(CLASSES))
        on_good = [chances(patterns, good, place, ON_GOOD) for place in places]
        on_bad = [chances(patterns, bad, place, ON_BAD) for place in places]
    return good


def judged(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row of the table: its statistics, base_failed, votes, good (the posterior) and kept.

    A null or empty text has no words and fails the base. Texts that fail the base take no part in the estimation.
    Texts are used whole, however long. Repeated rows count each; a null id stays null; an empty table gives an empty one.
    Other columns are not read.
    """
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words"))
    rows = _statistics(docs, id_column, text_column).withColumn("base_failed", failed).withColumn("votes", votes())
    rows = saved(rows, "weak-rules")
    counted = rows.where("NOT base_failed").groupBy("votes").count().collect()  # at most 3 ** rules rows
    found = posteriors({row["votes"]: row["count"] for row in counted})
    if found:
        table = F.create_map(*[F.lit(part) for pair in sorted(found.items()) for part in pair])
        good = F.try_element_at(table, F.col("votes"))
    else:
        good = F.lit(None).cast("double")
    rows = rows.withColumn("good", F.when(~F.col("base_failed"), good))
    return rows.withColumn("kept", F.coalesce(F.col("good") >= KEEP_FROM, F.lit(False)))
