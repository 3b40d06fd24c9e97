"""Whole results of the registered queries against plain versions, and held-out accuracy."""

import json
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from gridsight.llm import parity_join, quality, queries, tool_calls, toxicity
from gridsight.llm.common import ready, saved, table

FOLDER, LARGE = "/root/testdata/sf0.001", "/root/testdata/sf0.1"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark):
    return {row["doc_id"]: row for row in table(ready(spark), FOLDER, "documents").collect()}


def targets(sizes):
    """Target of each source: shares of 1, 2, 3, stopped at 3 times the size, the rest shared again."""
    names = sorted((name for name in sizes if name is not None), key=lambda name: [ord(c) for c in name]) + ([None] if None in sizes else [])
    weights = {name: place % 3 + 1 for place, name in enumerate(names)}
    left, open_, found = sum(sizes.values()), set(names), {}
    while open_:
        share = left / sum(weights[name] for name in open_)
        full = {name for name in open_ if weights[name] * share > 3 * sizes[name]}
        if not full:
            return found | {name: weights[name] * share for name in open_}
        for name in full:
            found[name] = 3 * sizes[name]
            left -= found[name]
        open_ -= full
    return found


@pytest.mark.parametrize("folder", [FOLDER, "/root/testdata/sf0.01"])
def test_mixing(spark, folder):
    """Sizes and targets, no more than three copies, and each source near its target."""
    docs = {row["doc_id"]: row for row in table(ready(spark), folder, "documents").collect()}
    found = {row["doc_id"]: row for row in queries.op2_mixing(spark, folder).collect()}
    sizes, taken = Counter(), Counter()
    for doc_id, row in docs.items():
        size = len(WORD.findall(row["text"] or ""))
        assert found[doc_id]["size"] == size and 0 <= found[doc_id]["taken"] <= 3 * size
        sizes[row["source"]] += size
        taken[row["source"]] += found[doc_id]["taken"]
    expected = targets(sizes)
    largest = {}
    for doc_id, row in docs.items():
        largest[row["source"]] = max(largest.get(row["source"], 0), found[doc_id]["size"])
        assert found[doc_id]["source_size"] == sizes[row["source"]]
        assert found[doc_id]["target"] == pytest.approx(expected[row["source"]])
    for source, target in expected.items():
        # what is left open in the end is one copy of one document, and made up for where there are others
        assert abs(taken[source] - target) <= min(largest[source], max(0.05 * target, 100))
    again = {row["doc_id"]: row["taken"] for row in queries.op2_mixing(spark, folder).collect()}
    assert again == {doc_id: row["taken"] for doc_id, row in found.items()}


def test_quality_rules(spark, docs):
    """The statistics and the base of each document."""
    for row in queries.op3_weak_rules(spark, FOLDER).collect():
        text = docs[row["doc_id"]]["text"] or ""
        words = WORD.findall(text)
        windows = defaultdict(list)
        for place in range(len(words) - 2):
            windows[tuple(words[place : place + 3])].append(place)
        inside = {place + shift for places in windows.values() if len(places) > 1 for place in places for shift in range(3)}
        lines = [line for line in text.split("\n") if WORD.search(line)]
        expected = (
            len(words), sum(map(len, words)), sum(text.count(symbol) for symbol in "#*$%&|<>"), len(lines) - len(set(lines)), len(inside),
        )
        assert tuple(row[name] for name in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == expected
        assert row["base_failed"] == (len(words) < 50 or 100 * len(inside) > 50 * len(words))
        assert not (row["base_failed"] and row["kept"])


def test_records(spark, docs):
    library = Tokenizer.from_file(queries.vocabulary())
    found, start = {row["doc_id"]: row for row in queries.op4_records(spark, FOLDER).collect()}, 0
    assert set(found) == set(docs)
    for doc_id in sorted(docs):
        ids = library.encode(docs[doc_id]["text"] or "", add_special_tokens=False).ids + [2]
        row = found[doc_id]
        assert (row["start"], row["n_tokens"], row["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def held_out(spark, build, label, rest):
    labels = {row["doc_id"]: row[label] for row in table(ready(spark), LARGE, "labels").collect() if row[label] is not None}
    rows = [row for row in build(spark, LARGE).collect() if row["doc_id"] in labels]
    assert all(row["held_out"] == (zlib.crc32(str(row["doc_id"]).encode()) % rest[0] == rest[1]) for row in rows)
    return [(labels[row["doc_id"]], row["predicted"]) for row in rows if row["held_out"]]


def test_toxicity_finds_most_and_accuses_few(spark):
    pairs = held_out(spark, queries.op6_toxicity, "toxic", (5, 0))
    caught = sum(one == two == 1 for one, two in pairs)
    assert caught >= 0.9 * sum(one for one, _ in pairs)
    assert caught >= 0.95 * sum(two for _, two in pairs)


def test_quality_is_right_for_most(spark):
    pairs = held_out(spark, queries.op10_quality, "quality", (4, 2))
    assert sum(one == two for one, two in pairs) >= 0.98 * len(pairs)


def near(texts):
    """Groups of near duplicates by every pair."""
    sets = {key: set(parity_join.shingles(text).tolist()) for key, text in texts.items()}
    root = {key: key for key in sets}

    def find(key):
        while root[key] != key:
            key = root[key]
        return key

    keys = sorted(sets)
    for place, one in enumerate(keys):
        for two in keys[place + 1 :]:
            if sets[one] and 100 * len(sets[one] & sets[two]) >= 80 * len(sets[one] | sets[two]):
                low, high = sorted((find(one), find(two)))
                root[high] = low
    return {key: find(key) for key in keys}


def test_stages_of_the_pipeline(spark, docs):
    """What each stage keeps, on what the one before kept."""
    found, kept = table(ready(spark), FOLDER, "documents"), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        found = saved(stage(spark, found, FOLDER), "stage")
        kept[name] = [row["doc_id"] for row in found.collect()]
        assert found.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    model = toxicity.fitted(table(spark, FOLDER, "documents"), table(spark, FOLDER, "labels"))
    words = toxicity.WordWeights(model)
    clean = [doc_id for doc_id, row in docs.items() if toxicity.document_score(row["text"] or "", words, model) < 0.5]
    assert sorted(kept["toxicity"]) == sorted(clean)
    longest = {}
    for doc_id in sorted(clean):
        body = re.sub(r"[\x20\x09-\x0D]", "", docs[doc_id]["text"] or "")
        best = longest.setdefault(body, doc_id)
        longest[body] = max(best, doc_id, key=lambda one: (len(docs[one]["text"] or ""), -one))
    assert sorted(kept["exact_dedup"]) == sorted(longest.values())
    groups = defaultdict(list)
    for doc_id, group in near({doc_id: docs[doc_id]["text"] for doc_id in kept["exact_dedup"]}).items():
        groups[group].append(doc_id)
    assert sorted(kept["near_duplicates"]) == sorted(max(own, key=lambda one: (len(docs[one]["text"] or ""), -one)) for own in groups.values())
    copies = Counter(kept["mixing"])
    assert set(copies) <= set(kept["near_duplicates"]) and max(copies.values()) <= 3
    pieces = corpus_pipeline.run(spark, FOLDER).collect()
    library = Tokenizer.from_file(queries.vocabulary())
    tokens = sum(len(library.encode(docs[doc_id]["text"] or "", add_special_tokens=False).ids) + 1 for doc_id in kept["mixing"])
    assert sum(row["length"] for row in pieces) == tokens


@pytest.mark.parametrize("maker", ["one lead", "no lead"])
def test_a_group_of_near_duplicates_costs_its_size(spark, monkeypatch, maker):
    """Rows that are verified grow like the group, whether or not its members are near to one of them."""
    ready(spark)
    counts, verified = {}, parity_join.verified
    for size in (150, 300):
        rng, rows = random.Random(3), []
        text = [f"w{place}" for place in range(160)]
        for doc_id in range(size):
            own = list(text)
            # without a lead, each text moves a little on from the one before
            for _ in range(2):
                (own if maker == "one lead" else text)[rng.randrange(160)] = f"x{rng.random()}"
            rows.append((doc_id, " ".join(own if maker == "one lead" else text)))
        pairs = []
        monkeypatch.setattr(parity_join, "verified", lambda few, sets: pairs.append(few.count()) or verified(few, sets))
        found = {row["doc_id"]: row["component_id"] for row in parity_join.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
        assert found == near(dict(rows))
        counts[size] = sum(pairs)
    assert counts[300] <= 3 * counts[150] and counts[300] <= 20 * 300


def changed(rng, text, changes):
    text = list(text)
    for _ in range(changes):
        text[rng.randrange(len(text))] = f"x{rng.random()}"
    return " ".join(text)


def test_long_documents_that_are_close_but_not_linked_cost_their_number(spark, monkeypatch):
    """No table that is written grows like the pairs of documents that share keys and are no near duplicates."""
    ready(spark)
    counts = {}
    for size in (80, 160):
        rng = random.Random(5)
        base = [f"w{place}" for place in range(1500)]
        texts = {doc_id: changed(rng, base, 40) for doc_id in range(size)}
        texts[size] = changed(rng, texts[3].split(), 2)
        made = counts[size] = Counter()

        def counted(df, purpose, made=made):
            table = saved(df, purpose)
            made[purpose] += table.count()
            return table

        monkeypatch.setattr(parity_join, "saved", counted)
        found = parity_join.near_duplicates(spark.createDataFrame([*texts.items()], "doc_id bigint, text string")).collect()
        assert {row["doc_id"]: row["component_id"] for row in found} == near(texts) == {**{doc_id: doc_id for doc_id in texts}, size: 3}
    assert not {purpose: rows for purpose, rows in counts[160].items() if rows > 3 * counts[80][purpose] + 10}, counts


@pytest.mark.parametrize("row_pairs", [0, 200])
def test_teams_in_blocks_and_by_key(spark, monkeypatch, row_pairs):
    """Sets on both sides of a width of sketches, groups linked in chains, an id with two texts, blocks of a few documents."""
    ready(spark)
    monkeypatch.setattr(parity_join, "BLOCK_ELEMENTS", 4000)
    monkeypatch.setattr(parity_join, "ROW_PAIRS", row_pairs)
    rng, texts = random.Random(8), {}
    base = [f"w{place}" for place in range(290)]
    for doc_id in range(60):
        base = changed(rng, base, doc_id % 2).split()
        texts[doc_id] = changed(rng, base[: rng.randrange(240, 290)], doc_id % 5)
    texts |= {60 + doc_id: f"a b c d e f {doc_id}" for doc_id in range(20)} | {80: texts[5], 81: "", 82: None}
    rows = [*texts.items(), (81, texts[7])]
    found = parity_join.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    groups = near(texts | {81: texts[7]})
    assert len(set(groups.values())) > 25 and max(Counter(groups.values()).values()) > 5
    assert Counter((row["doc_id"], row["component_id"]) for row in found) == Counter((doc_id, groups[doc_id]) for doc_id, _ in rows)


def test_sketches_of_different_widths():
    rng = random.Random(4)
    one = np.unique(np.array([rng.getrandbits(64) for _ in range(250)], np.uint64))
    other = np.unique(np.concatenate((one[20:], np.array([rng.getrandbits(64) for _ in range(60)], np.uint64))))
    assert len(parity_join.sketch(other)) == 2 * len(parity_join.sketch(one))
    assert 60 < parity_join.sketch_distance(parity_join.sketch(one), parity_join.sketch(other)) <= 80


ODD_ARGUMENTS = {
    '{"x":1e999}': '"{\\"x\\":1e999}"', "[" * 3000 + "]" * 3000: None, '{"x":"\\ud800"}': None, "NaN": '"NaN"', None: "null", "": '""',
    '{"b":1.0,"a":[2,{"d":null,"c":"é"}]}': '{"a":[2,{"c":"é","d":null}],"b":1}', "1" * 5000: None, '{"x":' * 990 + "1" + "}" * 990: None,
}


def test_arguments_that_have_no_canonical_form(spark):
    ready(spark)
    calls = [(1, str(n), n, "any", arguments, []) for n, arguments in enumerate(ODD_ARGUMENTS)]
    calls = spark.createDataFrame(calls, "conv_id bigint, call_id string, position bigint, name string, arguments string, needs array<string>")
    results = spark.createDataFrame([(1, "0", 9, "ok")], "conv_id bigint, call_id string, position bigint, content string")
    found = {row["call_id"]: row for row in tool_calls.link(calls, results, {"any": {}}).collect()}
    for n, (arguments, expected) in enumerate(ODD_ARGUMENTS.items()):
        row = found[str(n)]
        value = json.loads(row["record"])["arguments"]
        if expected is None:
            assert value == arguments and row["status"] == "invalid"
        else:
            assert json.dumps(value, separators=(",", ":"), ensure_ascii=False) == expected
            assert row["status"] == ("unanswered" if arguments and arguments[:3] == '{"b' else "invalid")


def test_levels_of_chains_cycles_and_wide_needs(spark, monkeypatch):
    rng = random.Random(6)
    needs = {(1, f"c{n}"): [f"c{n - 1}"] if n else [] for n in range(300)}  # a long chain
    needs |= {(2, f"c{n}"): rng.sample([f"c{m}" for m in range(n)], min(n, rng.randint(0, 4))) for n in range(60)}
    needs |= {(3, f"c{n}"): [f"c{(n + 1) % 7}"] for n in range(7)} | {(3, "tail"): ["c3"], (3, "own"): ["own"], (3, "free"): []}
    needs |= {(3, "both"): ["free", "tail"]}

    def level(key, seen=()):
        if key in seen:
            return None
        below = [level((key[0], need), (*seen, key)) for need in needs[key]]
        return None if None in below else 1 + max(below, default=-1)

    calls = spark.createDataFrame([(*key, 0, "any", "{}", own) for key, own in needs.items()], "conv_id bigint, call_id string, position bigint, name string, arguments string, needs array<string>")
    known = calls.select("conv_id", "call_id")
    pairs = spark.createDataFrame([(*key, need) for key, own in needs.items() for need in own], "conv_id bigint, call_id string, need string")
    rounds, kept = [], tool_calls.saved
    monkeypatch.setattr(tool_calls, "saved", lambda df, name: rounds.append(name) or kept(df, name))
    found = {(row["conv_id"], row["call_id"]): row["level"] for row in tool_calls.levels(known, pairs).collect()}
    import sys

    sys.setrecursionlimit(5000)
    assert found == {key: value for key in needs if (value := level(key)) is not None}
    assert rounds.count("call-open") < 40
