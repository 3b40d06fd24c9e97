"""The queries of this package and their checks in SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import lexical_search, mixing, naming, packing, parity_join, quality, records, repair, suffix_merge, token_counts, tool_calls, toxicity, weak_rules
from .common import table


def vocabulary() -> str:
    return public_tokenizers.path("byte_bpe_50k.json")


def op1_tool_calls(spark: SparkSession, folder: str) -> DataFrame:
    """Calls of all conversations linked with their results."""
    calls, results = tool_calls.conversation_calls(table(spark, folder, "conversations"))
    return tool_calls.link(calls, results, tool_calls.SCHEMAS)


def op2_mixing(spark: SparkSession, folder: str) -> DataFrame:
    """Words of each document that a mix of the sources takes."""
    return mixing.mix(table(spark, folder, "documents"))


def op3_weak_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Statistics of each document and whether it is kept."""
    return weak_rules.judged(table(spark, folder, "documents"))


def op4_records(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as they are read back from binary records."""
    return records.record_digests(table(spark, folder, "documents"), vocabulary())


def op5_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Bytes and tokens of each document."""
    return token_counts.token_counts(table(spark, folder, "documents"), vocabulary())


def op6_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """Toxicity of each document and where it lies."""
    return toxicity.document_scores(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op7_parity_join(spark: SparkSession, folder: str) -> DataFrame:
    """Components of near duplicates."""
    return parity_join.near_duplicates(table(spark, folder, "documents"))


def op8_packing(spark: SparkSession, folder: str) -> DataFrame:
    """Pieces of documents in sequences of 1024 tokens."""
    return packing.pack(table(spark, folder, "documents"), vocabulary())


def op9_block_naming(spark: SparkSession, folder: str) -> DataFrame:
    """Which document of each group of equal texts stays."""
    found = naming.exact_duplicates(table(spark, folder, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op10_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Quality of each document."""
    return quality.document_scores(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op11_repair(spark: SparkSession, folder: str) -> DataFrame:
    """Damaged conversations with their faults, the cheapest repair and a hash of its text."""
    conversations = table(spark, folder, "conversations")
    return repair.repaired(repair.damage(conversations), conversations)


def op12_repeats(spark: SparkSession, folder: str) -> DataFrame:
    """Bytes of each document that repeat, and a hash of the rest."""
    found = suffix_merge.repeated_spans(table(spark, folder, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op13_range_maxima(spark: SparkSession, folder: str) -> DataFrame:
    """The 20 best documents of each benchmark item."""
    return lexical_search.ranked(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


OP9_SQL = r"""
WITH bodies AS (
  SELECT doc_id, coalesce(text, '') AS whole,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS body
  FROM documents
), placed AS (
  SELECT doc_id, sha256(body) AS text_sha256,
         first_value(doc_id) OVER (PARTITION BY body ORDER BY length(whole) DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY body) AS group_size
  FROM bodies
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM placed
"""

def _op11_sql() -> str:
    """The repair as a recursion over turns: per place in the grammar (o nothing, l system, u user, b pairs) the least
    (cost, audit) with its text."""

    def more(state: str, cost: str, letter: str, line: str = "''") -> str:
        return f"CASE WHEN {state} IS NOT NULL THEN {{'c': {state}.c + {cost}, 'a': {state}.a || {letter}, 't': {state}.t || {line}}} END"

    def least(*states: str) -> str:
        return f"list_sort(list_filter([{', '.join(states)}], lambda x: x IS NOT NULL))[1]"

    def stays(state: str, to: str, role: str) -> str:
        edit = f"CASE WHEN first = '{to}' THEN 'K' ELSE 'R' END"
        line = f"chr(10) || CASE WHEN first = '{to}' THEN role ELSE '{role}' END || ':' || text"
        return f"CASE WHEN NOT must_go THEN {more(state, f"(CASE WHEN first = '{to}' THEN 0 ELSE 2 END) + cut", edit, line)} END"

    user, assistant = "chr(10) || 'user:'", "chr(10) || 'assistant:'"
    kept_system = f"CASE WHEN NOT must_go AND first = 's' THEN {more('o', 'cut', "'K'", "chr(10) || role || ':' || text")} END"
    empty = "CAST(NULL AS STRUCT(c BIGINT, a VARCHAR, t VARCHAR))"
    return rf"""
WITH RECURSIVE keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''),
                        lambda x: CAST(unicode(x) AS BIGINT) + 1) AS codes
  FROM conversations
), dealt AS (
  SELECT conv_id, turn, role, text, xor(4294967295, list_reduce(
           list_prepend(4294967295::BIGINT, flatten(list_transform(codes, lambda x: [x, 0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]))),
           lambda c, x: CASE WHEN x > 0 THEN xor(c, x - 1) WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) % 20 AS choice
  FROM keyed
), damaged AS (
  SELECT conv_id, turn, CASE choice WHEN 4 THEN 'user' ELSE role END AS role,
         CASE choice WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
         unnest(CASE choice WHEN 3 THEN [1, 2] ELSE [1] END) AS copy
  FROM dealt WHERE choice <> 0
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS pos FROM damaged
), judged AS (
  SELECT *, CASE WHEN role = '' THEN ' ' ELSE left(role, 1) END AS first,
         NOT regexp_matches(text, '[^ 	-
]') AS blank,
         row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 AS again,
         lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY pos) AS before_it
  FROM placed
), faulty AS (
  SELECT *, blank OR again AS must_go,
         CASE WHEN NOT blank AND NOT again AND right(rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1)
              NOT IN ('.', '!', '?') THEN 1 ELSE 0 END AS cut
  FROM judged
), counted AS (
  SELECT conv_id, count(*) AS size, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
         sum(CAST(blank AS INTEGER)) AS blank, sum(CASE WHEN again AND NOT blank THEN 1 ELSE 0 END) AS duplicate,
         sum(cut) AS truncated, sum(CASE WHEN before_it || first NOT IN ('su', 'ua', 'au') THEN 1 ELSE 0 END) AS illegal
  FROM faulty GROUP BY conv_id
), parsed AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS pos, {{'c': CAST(0 AS BIGINT), 'a': '', 't': ''}} AS o, {empty} AS l, {empty} AS u, {empty} AS b
  FROM counted
  UNION ALL
  SELECT conv_id, pos, {more("o", "3", "'D'")}, {least(more("l", "3", "'D'"), kept_system)},
         {least(more("u2", "3", "'D'"), stays("o", "u", "user"), stays("l", "u", "user"), stays("b2", "u", "user"))},
         {least(more("b2", "3", "'D'"), stays("u2", "a", "assistant"))}
  FROM (SELECT *, {least("b", more("u2", "2", "'I'", assistant))} AS b2
        FROM (SELECT p.conv_id, f.pos, f.role, f.text, f.first, f.must_go, f.cut, o, l, b,
                     {least("u", more("o", "2", "'I'", user), more("l", "2", "'I'", user), more("b", "2", "'I'", user))} AS u2
              FROM parsed p JOIN faulty f ON p.conv_id IS NOT DISTINCT FROM f.conv_id AND f.pos = p.pos + 1))
), ended AS (
  SELECT conv_id, {least("o", "b", more("u", "2", "'I'", assistant), more("l", "4", "'II'", f"{user} || {assistant}"))} AS best
  FROM parsed JOIN counted USING (conv_id) WHERE pos = size
)
SELECT i.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank,
       CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate, CAST(coalesce(truncated, 0) AS BIGINT) AS truncated,
       CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(coalesce(best.c, 0) AS BIGINT) AS cost,
       coalesce(best.a, '') AS audit, sha256(coalesce(substr(best.t, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) i LEFT JOIN counted USING (conv_id) LEFT JOIN ended USING (conv_id)
"""


OP11_SQL = _op11_sql()
OP13_SQL = r"""
WITH spelled AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[0-9a-z\x{80}-\x{10FFFF}]+') AS terms
  FROM documents
), totals AS (
  SELECT CAST(count(*) AS BIGINT) AS holders, CAST(sum(len(terms)) AS BIGINT) AS total FROM spelled WHERE len(terms) > 0
), sized AS (
  SELECT doc_id, row_number() OVER () AS number, terms, 75 + (25 * len(terms) * holders) // total AS m
  FROM spelled, totals WHERE len(terms) > 0
), postings AS (
  SELECT number, term, count(*) AS tf FROM (SELECT number, unnest(terms) AS term FROM sized) GROUP BY ALL
), asked AS (
  SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+')) AS term
  FROM benchmark
), queried AS (
  SELECT item_id, term, count(*) AS times FROM asked GROUP BY ALL
), weights AS (
  SELECT term, CAST(floor(1000 * ln((2 * holders + 2) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w
  FROM postings, totals WHERE term IN (SELECT term FROM queried) GROUP BY term, holders
), scored AS (
  SELECT item_id, doc_id, number, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score
  FROM queried JOIN weights USING (term) JOIN postings USING (term) JOIN sized USING (number) GROUP BY item_id, doc_id, number
), placed AS (
  SELECT item_id, doc_id, score,
         row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS place
  FROM scored WHERE score > 0
)
SELECT item_id, CAST(place AS INTEGER) AS rank, doc_id, score FROM placed WHERE place <= 20
"""


QUERIES = {
    "op1_tool_calls": op1_tool_calls,
    "op2_mixing": op2_mixing,
    "op3_weak_rules": op3_weak_rules,
    "op4_records": op4_records,
    "op5_token_counts": op5_token_counts,
    "op6_toxicity": op6_toxicity,
    "op7_parity_join": op7_parity_join,
    "op8_packing": op8_packing,
    "op9_block_naming": op9_block_naming,
    "op10_quality": op10_quality,
    "op11_repair": op11_repair,
    "op12_repeats": op12_repeats,
    "op13_range_maxima": op13_range_maxima,
}
ORACLES: dict[str, str] = {"op9_block_naming": OP9_SQL, "op11_repair": OP11_SQL, "op13_range_maxima": OP13_SQL}
