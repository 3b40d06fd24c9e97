"""Every operator on nulls, empty and long texts, repeated rows, empty tables and clashing columns."""

import pytest
from pyspark.sql import functions as F

from gridsight.llm import mixing, naming, packing, parity_join, quality, records, token_counts, tool_calls, toxicity, weak_rules
from gridsight.llm.common import ready
from gridsight.llm.queries import vocabulary
from gridsight.storage import new_folder

LONG = " ".join(f"word{place}" for place in range(30_000))
ROWS = [
    (1, "a b c d e f g", "en", "s1", 13, 7.0, "x"),
    (2, None, None, None, None, None, None),
    (3, "", "en", "s1", 0, 1.0, "x"),
    (4, LONG, "en", "s2", len(LONG), 1.0, "x"),
    (5, "a  b\nc d\te f g", "en", None, 13, 1.0, "x"),
    (5, "a  b\nc d\te f g", "en", None, 13, 1.0, "x"),
    (None, "no id <|endoftext|> here", "en", "s1", 5, 1.0, "x"),
    (7, " \n\t ", "en", "s1", 4, 1.0, "x"),
]
# "size" and "bucket" clash with names the operators use inside
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, size double, bucket string"


@pytest.fixture
def odd(spark):
    ready(spark)
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture
def nothing(spark):
    ready(spark)
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (4, 0, 1), (5, None, None), (None, 1, 1)], "doc_id bigint, quality int, toxic int")


@pytest.fixture
def operators(spark, labels):
    return {
        "mix": mixing.mix,
        "judged": weak_rules.judged,
        "records": lambda docs: records.record_digests(docs, vocabulary()),
        "counts": lambda docs: token_counts.token_counts(docs, vocabulary()),
        "toxicity": lambda docs: toxicity.document_scores(docs, labels),
        "near": parity_join.near_duplicates,
        "naming": naming.exact_duplicates,
        "quality": lambda docs: quality.document_scores(docs, labels),
    }


NAMES = ["mix", "judged", "records", "counts", "toxicity", "near", "naming", "quality"]


@pytest.mark.parametrize("name", NAMES)
def test_one_row_per_row(odd, operators, name):
    found = operators[name](odd)
    assert sorted(str(row["doc_id"]) for row in found.collect()) == sorted(str(row[0]) for row in ROWS)


@pytest.mark.parametrize("name", NAMES)
def test_empty_table(nothing, operators, name):
    assert operators[name](nothing).collect() == []


def test_packing_keeps_every_row(odd, nothing):
    found = packing.pack(odd, vocabulary(), 64).collect()
    assert sum(row["start"] == 0 for row in found) == len(ROWS)
    assert packing.pack(nothing, vocabulary()).collect() == []


def test_stages_keep_columns_and_clean_rows(odd, labels):
    for stage in (lambda docs: toxicity.without_toxic(docs, labels.where("false")), naming.without_duplicates,
                  parity_join.one_per_component, mixing.mixed_documents):
        assert stage(odd).columns == odd.columns
    kept = naming.without_duplicates(odd).select("doc_id").collect()
    assert sorted(str(row[0]) for row in kept) == ["4", "5", "7", "None"]
    assert toxicity.without_toxic(odd, labels.where("false")).count() == len(ROWS)


def test_equal_texts_across_separators(odd):
    found = {row["doc_id"]: row for row in naming.exact_duplicates(odd).where("doc_id < 5").collect()}
    assert found[1]["group_size"] == 3 and found[1]["keep_id"] == 5 and not found[1]["kept"]
    assert found[2]["keep_id"] == 7 and found[2]["group_size"] == 3


CALLS = "conv_id bigint, call_id string, position bigint, name string, arguments string, needs array<string>, level int, turn string"
RESULTS = "conv_id bigint, call_id string, position bigint, content string, called string"


def test_tool_calls_on_odd_rows(spark):
    """Nulls in any column, long arguments, repeated rows, empty tables and columns with clashing names."""
    ready(spark)
    long = '{"query":"' + LONG + '","limit":2}'
    calls = spark.createDataFrame([
        (1, "a", 1, "search", long, [], 9, "x"), (1, "b", None, None, None, None, None, None), (None, "c", 2, "search", "{}", ["a"], 9, "x"),
        (1, None, 3, "search", "", ["a", None], 9, "x"), (2, "d", 1, "search", long, ["d"], 9, "x"), (2, "e", 1, "no tool", "{}", ["e2"], 9, "x"),
        (3, "f", 1, "search", long, [], 9, "x"), (3, "f", 1, "search", long, [], 9, "x"), (3, "f", 1, "search", "{}", [], 9, "x"),
    ], CALLS)
    results = spark.createDataFrame([(1, "a", 5, LONG, "x"), (1, "z", None, None, None), (None, None, 1, "", "x"), (3, "f", 2, None, "x")], RESULTS)
    found = tool_calls.link(calls, results, tool_calls.SCHEMAS).collect()
    assert len(found) == 11
    status = {(row["conv_id"], row["call_id"], row["position"]): row["status"] for row in found if row["status"] != "duplicate"}
    assert status == {
        (1, "a", 1): "ok", (1, "b", None): "invalid", (None, "c", 2): "invalid", (1, None, 3): "invalid", (2, "d", 1): "cycle",
        (2, "e", 1): "invalid", (3, "f", 1): "ok", (1, "z", None): "orphan", (None, None, 1): "orphan",
    }
    assert sum(row["status"] == "duplicate" for row in found) == 2
    nothing = calls.where("false")
    assert tool_calls.link(nothing, results.where("false"), tool_calls.SCHEMAS).collect() == []
    assert tool_calls.link(calls, results.where("false"), tool_calls.SCHEMAS).count() == 9
    assert {row["status"] for row in tool_calls.link(nothing, results, tool_calls.SCHEMAS).collect()} == {"orphan"}


def test_records_reject_damage(spark, odd):
    folder = new_folder(spark, "damage")
    index = records.write_records(odd, vocabulary(), folder)
    assert records.read_records(index).where(F.octet_length("ids") == 4 * F.col("n_tokens")).count() == len(ROWS)
    record = records.frame(b"some ids")
    assert records.unframe(record) == b"some ids"
    for place in range(len(record)):
        with pytest.raises(ValueError):
            records.unframe(record[:place] + bytes([record[place] ^ 1]) + record[place + 1 :])
