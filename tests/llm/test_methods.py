"""The operators against brute force and by hand."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from gridsight.llm import components, labelled, mixing, naming, packing, parity_join, quality, token_counts, tool_calls, toxicity, weak_rules
from gridsight.llm.common import ready, table
from gridsight.llm.encoding import Encoder, packed, parts_of
from gridsight.llm.queries import vocabulary

FOLDER = "/root/testdata/sf0.001"
library = Tokenizer.from_file(vocabulary())
encoder = Encoder(vocabulary())
counter = token_counts.Counter(vocabulary())
TEXTS = st.text(alphabet=st.sampled_from("aeét'sLl 1.,!|\n\t　\x1c<|>endoftxé日"), max_size=60)


@settings(max_examples=300, deadline=None)
@given(TEXTS)
def test_ids_and_counts_are_the_librarys(text):
    ids = library.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(encoder.batch([text])[0], "<u4").tolist() == ids
    assert counter.count(text) == len(ids)


def test_counts_of_special_strings_and_long_runs():
    for text in ("a <|endoftext|> b", "<|endoftext|><|endoftext|>", "x  <|endoftext|>", "ab" * 5000, " " * 3000, "a  b   c \n d", "a\n" * 5000, "x.\nY\n\nz", "Êa.\nÉ1,\t\nb"):
        assert counter.count(text) == len(library.encode(text, add_special_tokens=False).ids)
        assert encoder.batch([text])[0] == np.array(library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    assert parts_of("a b  c")[1] == ["b ", "c"]


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 63), st.integers(1, 9), max_size=12))
def test_plan_places_every_tail_once(histogram):
    plan = packing.plan_windows(histogram, 64)
    used = Counter()
    for pattern, times in plan:
        assert sum(length * uses for length, uses in pattern.items()) <= 64
        used.update({length: uses * times for length, uses in pattern.items()})
    assert used == histogram
    rows, sequences = packing.plan_rows(plan)
    assert sequences == sum(times for _, times in plan)
    assert sum(high - low for _, low, high, *_ in rows) == sum(histogram.values())


def test_first_window_is_filled_as_well_as_any_subset_can():
    rng = random.Random(3)
    for _ in range(30):
        lengths = [rng.randint(1, 63) for _ in range(9)]
        pattern, _ = packing.plan_windows(Counter(lengths), 64)[0]
        longest, rest = max(lengths), sorted(lengths)[:-1]
        sums = {0}
        for length in rest:
            sums |= {total + length for total in sums}
        best = min(packing.padding(longest + total, 64) for total in sums if longest + total <= 64)
        assert packing.padding(sum(length * uses for length, uses in pattern.items()), 64) == best


def test_packing_is_gapless_and_reads_back(spark):
    docs = table(spark, FOLDER, "documents")
    ids = {row["doc_id"]: library.encode(row["text"] or "", add_special_tokens=False).ids + [0] for row in docs.collect()}
    sequences = defaultdict(list)
    pieces = Counter()
    for row in packing.pack(docs, vocabulary(), 128).collect():
        cut = ids[row["doc_id"]][row["start"] : row["start"] + row["length"]]
        assert zlib.crc32(np.array(cut, "<u4").tobytes()) == row["ids_crc32"]
        sequences[row["sequence_id"]].append((row["offset"], row["length"]))
        pieces[row["doc_id"]] += row["length"]
    assert pieces == {doc_id: len(one) for doc_id, one in ids.items()}
    for placed in sequences.values():
        end = 0
        for offset, length in sorted(placed):
            assert offset == end
            end += length
        assert end <= 128


def test_settling_keeps_the_sum_of_words():
    rng = random.Random(5)
    rows = [[rng.randint(1, 900), 0, rng.random()] for _ in range(500)]
    before = sum(size * fraction for size, _, fraction in rows)
    mixing.settle(rows, random.Random(1))
    assert sum(0.0 < fraction < 1.0 for _, _, fraction in rows) <= 1
    assert sum(size * (copies + fraction) for size, copies, fraction in rows) == pytest.approx(before)


def test_targets_are_capped_and_share_everything(spark):
    ready(spark)
    sizes = {"a": 1000, "b": 10, "c": 500, None: 90}
    found = {r["source"]: r for r in mixing.source_targets(spark.createDataFrame(list(sizes.items()), "source string, size long")).collect()}
    weights = {"a": 1, "b": 2, "c": 3, None: 1}
    targets, free, left = {}, set(sizes), 1600.0
    while True:  # reshare the excess by weight until none is above its cap
        level = left / sum(weights[name] for name in free)
        over = {name for name in free if weights[name] * level > 3 * sizes[name]}
        if not over:
            break
        for name in over:
            targets[name] = 3.0 * sizes[name]
        free -= over
        left = 1600.0 - sum(targets.values())
    targets |= {name: weights[name] * level for name in free}
    assert {name: row["target"] for name, row in found.items()} == pytest.approx(targets)


def test_mix_repeats_itself(spark):
    docs = table(spark, FOLDER, "documents")
    one = {row["doc_id"]: row["copies"] for row in mixing.mix(docs).collect()}
    assert one == {row["doc_id"]: row["copies"] for row in mixing.mix(docs.repartition(5)).collect()}
    assert mixing.mixed_documents(docs).count() == sum(one.values())


def test_weak_rule_statistics(spark):
    text = "a b c a b c x\n\nline one\nline one\n $$ a b"
    ready(spark)
    row = weak_rules.judged(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert (row["n_words"], row["word_chars"], row["n_symbols"], row["n_dup_lines"]) == (14, 25, 2, 1)
    assert row["n_repeat_words"] == 6 and row["base_failed"] and not row["kept"]


def test_posterior_follows_the_odd_rules():
    found = weak_rules.posteriors({"-gggg": 900, "bgggg": 80, "bbggg": 60, "b-ggg": 10})
    assert found["-gggg"] > 0.9 and found["bbggg"] < 0.1 and found["bbggg"] < found["bgggg"] < found["-gggg"]
    assert weak_rules.posteriors({}) == {}


def test_noisy_or_and_the_offending_sentence(spark):
    rows = [(i, "calm words here. " * 5 + ("you foul clod. " if i % 3 == 0 else "nice day. ")) for i in range(300)]
    ready(spark)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i, _ in rows], "doc_id long, toxic int")
    for row in toxicity.document_scores(docs, labels).collect():
        assert row["predicted"] == int(row["doc_id"] % 3 == 0)
        if row["predicted"]:
            assert row["worst"] == 5 and row["offending"] == [5]
    assert toxicity.noisy_or(np.array([0.0, 0.0])) == pytest.approx(0.75)


def test_long_clean_texts_stay_clean(spark):
    rows = [(i, "calm words here. " * 5 + ("you foul clod. " if i % 3 == 0 else "nice day. ")) for i in range(300)]
    rows += [(1000, "calm words here. nice day. " * 5000), (1001, "quite other words. " * 10_000), (1002, "calm words here. " * 9999 + "you foul clod.")]
    ready(spark)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(300)], "doc_id long, toxic int")
    for known in (labels, labels.where("false"), labels.where("toxic = 0")):
        scores = {row["doc_id"]: row for row in toxicity.document_scores(docs, known).where("doc_id >= 1000").collect()}
        assert scores[1000]["score"] < 0.5 and scores[1001]["score"] < 0.5
        assert scores[1000]["sentences"] == scores[1001]["sentences"] == 10_000
        if known is labels:
            assert scores[1002]["predicted"] == 1 and scores[1002]["offending"] == [9999]
    left = {row["doc_id"] for row in toxicity.without_toxic(docs, labels).select("doc_id").collect()}
    assert {1000, 1001} <= left and 1002 not in left


def test_long_labelled_texts_are_fitted_on(spark):
    calm = "calm words here. " * 8000
    rows = [(i, calm + ("you foul clod. " if i % 2 == 0 else "nice day. ")) for i in range(40)]
    ready(spark)
    docs = spark.createDataFrame([*rows, (1000, "you foul clod."), (1001, "nice day.")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 2 == 0)) for i, _ in rows], "doc_id long, toxic int")
    found = {row["doc_id"]: row["predicted"] for row in toxicity.document_scores(docs, labels).collect()}
    assert found == {i: int(i % 2 == 0) for i in [*range(40), 1000, 1001]}
    assert labelled.sample(docs, labels, "toxic", 5, 0, 3000, all_chars=len(calm) + 100).count() == 2  # the second one crosses


def test_sum_of_squares_identity():
    rng = np.random.default_rng(1)
    inputs, weights, factors = rng.normal(size=(4, 7)), rng.normal(size=7), rng.normal(size=(7, 3))
    pairs = [[x[i] * x[j] * factors[i] @ factors[j] for i in range(7) for j in range(i)] for x in inputs]
    expected = 0.3 + inputs @ weights + np.array([sum(one) for one in pairs])
    assert quality.log_odds(inputs, 0.3, weights, factors) == pytest.approx(expected)


def test_block_names_do_not_depend_on_the_block(spark):
    docs = table(spark, FOLDER, "documents")
    small = naming.exact_duplicates(docs, size=5).select("doc_id", "keep_id").collect()
    assert sorted(small) == sorted(naming.exact_duplicates(docs).select("doc_id", "keep_id").collect())


def test_linked_sets_share_a_key():
    rng = np.random.default_rng(2)
    for size in [*range(1, 40), 77, 200, 555]:
        base = np.unique(rng.integers(0, 2**63, size * 2, dtype=np.uint64))[:size]
        for _ in range(4):
            other = rng.permutation(base)[: size - rng.integers(0, max(size // 9, 1) + 1)]
            extra = rng.integers(0, 2**63, int(rng.integers(0, size // 9 + 1)), dtype=np.uint64)
            other = np.unique(np.concatenate([other, extra]))
            common = len(np.intersect1d(base, other))
            if 100 * common >= 80 * (len(base) + len(other) - common):
                assert np.intersect1d(parity_join.keys_of(base), parity_join.keys_of(other)).size
            flipped = parity_join.sketch_distance(parity_join.sketch(base), parity_join.sketch(other))
            assert flipped <= len(base) + len(other) - 2 * common


def test_new_parts_are_put_together_from_known_ones(monkeypatch):
    encoder = Encoder(vocabulary())
    encoder.batch(["x thinonwhly Reäheble thinonwhly.\nReäheble"])
    asked, tokenize = [], encoder.tokenize
    monkeypatch.setattr(encoder, "tokenize", lambda part: asked.append(part) or tokenize(part))
    texts = ["x thinonwhly.", "x thinonwhly,\nReäheble! thinonwhly|\nReäheble", "x Reäheble.\nReäheble;"]
    assert encoder.batch(texts) == [packed(one.ids) for one in encoder.library.encode_batch(texts, add_special_tokens=False)]
    assert not asked


def test_known_parts_are_bounded():
    encoder = Encoder(vocabulary(), 500)
    for start in range(0, 4000, 100):
        texts = [" ".join(f"w{n}o.\nA{n} the b{n}, W{'e' * (n % 90)}" for n in range(start, start + 100))]
        assert encoder.batch(texts) == [packed(one.ids) for one in encoder.library.encode_batch(texts, add_special_tokens=False)]
        assert len(encoder.known) <= 500 and len(encoder.known.before) <= 500


def test_the_pipeline_packs_with_fewer_known_parts(spark, monkeypatch):
    import corpus_pipeline

    kept, cut = [], packing.cut_documents
    monkeypatch.setattr(packing, "cut_documents", lambda *given: kept.append(given[-1]) or cut(*given))
    docs = spark.createDataFrame([(1, "one two"), (2, None)], "doc_id bigint, text string")
    rows = corpus_pipeline.packed(spark, docs, "")
    assert sorted(tuple(row) for row in rows.collect()) == sorted(tuple(row) for row in packing.pack(docs, vocabulary()).collect())
    assert kept[0] * 3 < kept[1]


def test_near_duplicates_by_brute_force(spark):
    docs = table(spark, FOLDER, "documents")
    sets = {}
    for row in docs.collect():
        words = (row["text"] or "").encode().lower().split()
        sets[row["doc_id"]] = {tuple(words[i : i + 5]) for i in range(max(len(words) - 4, 1))} if words else set()
    label = {doc_id: doc_id for doc_id in sets}
    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) and label[a] != label[b]:
                low, high = sorted((label[a], label[b]))
                label = {doc_id: low if value == high else value for doc_id, value in label.items()}
    found = parity_join.near_duplicates(docs).collect()
    assert {row["doc_id"]: row["component_id"] for row in found} == label
    assert {row["doc_id"]: row["n_shingles"] for row in found} == {doc_id: len(one) for doc_id, one in sets.items()}


def test_rows_that_share_an_id_go_only_for_a_link(spark):
    text = lambda name: " ".join(f"{name}{place}" for place in range(60))
    rows = [(1, text("a")), (1, text("b")), (2, text("a") + " more"), (3, text("b") + " more"), (4, text("c")), (4, text("c")), (None, text("c"))]
    ready(spark)
    left = parity_join.one_per_component(spark.createDataFrame(rows, "doc_id long, text string"))
    assert left.columns == ["doc_id", "text"]
    assert sorted(map(tuple, left.collect()), key=repr) == sorted([rows[2], rows[3], rows[4], rows[6]], key=repr)


def test_components_of_a_chain_and_a_ring(spark):
    ready(spark)
    links = [(i, i + 1) for i in range(20)] + [(30, 31), (31, 32), (32, 30), (40, 40)]
    found = components.components(spark.createDataFrame(links, "a long, b long")).collect()
    assert {row["node"]: row["component"] for row in found} == {i: 0 for i in range(21)} | {30: 30, 31: 30, 32: 30}


def test_tool_calls_by_hand(spark):
    ready(spark)
    calls = spark.createDataFrame(
        [
            (1, "a", 0, "search", '{"query":"q","limit":3.0}', []), (1, "b", 1, "search", '{"limit":99}', ["a"]),
            (1, "c", 2, "search", "no json", ["b", "zz"]), (1, "d", 3, "search", '{"query":"q","limit":1}', ["e"]),
            (1, "e", 4, "search", '{"query":"q","limit":1}', ["d"]), (1, "a", 9, "other", "{}", []), (None, None, None, None, None, None),
        ],
        "conv_id long, call_id string, position long, name string, arguments string, needs array<string>",
    )
    results = spark.createDataFrame([(1, "a", 5, "r"), (1, "x", 6, "stray"), (None, "y", 7, None)], "conv_id long, call_id string, position long, content string")
    found = {row["call_id"]: row for row in tool_calls.link(calls, results, tool_calls.SCHEMAS).collect()}
    assert {name: (row["status"], row["level"]) for name, row in found.items() if name} == {
        "a": ("ok", 0), "b": ("invalid", 1), "c": ("invalid", 2), "d": ("cycle", None), "e": ("cycle", None),
        "x": ("orphan", None), "y": ("orphan", None),
    }
    assert found["b"]["errors"] == ["$.query: missing", "$.limit: above maximum"]
    assert found["c"]["errors"] == ["$: not JSON", "needs unknown zz"]
    assert found["a"]["record"] == (
        '{"arguments":{"limit":3,"query":"q"},"call":"a","level":0,"name":"search","result":"r","status":"ok"}'
    )
    assert found[None]["status"] == "invalid"


def test_repeated_calls_and_results_are_rows(spark):
    ready(spark)
    calls = [(1, "a", 0, "summarise", '{"query":"q"}', []), (1, "a", 9, "other", '{"x":1}', []), (1, "b", 10, "summarise", '{"query":"q"}', ["a"])]
    calls = spark.createDataFrame(calls, "conv_id long, call_id string, position long, name string, arguments string, needs array<string>")
    results = [(1, "a", 5, "r"), (1, "a", 6, "second"), (1, "x", 7, "stray"), (1, "x", 8, "again")]
    results = spark.createDataFrame(results, "conv_id long, call_id string, position long, content string")
    found = {row["position"]: row for row in tool_calls.link(calls, results, tool_calls.SCHEMAS).collect()}
    assert {place: (row["call_id"], row["status"], row["level"]) for place, row in found.items()} == {
        0: ("a", "ok", 0), 6: ("a", "duplicate", None), 7: ("x", "orphan", None), 8: ("x", "duplicate", None),
        9: ("a", "duplicate", None), 10: ("b", "unanswered", 1),
    }
    assert '"x":1' in found[9]["record"] and '"result":"second"' in found[6]["record"] and '"result":"r"' in found[0]["record"]


def test_pipeline_runs(spark):
    import corpus_pipeline

    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "near_duplicates", "mixing", "packing"]
    assert corpus_pipeline.run(spark, FOLDER).count() > 100
