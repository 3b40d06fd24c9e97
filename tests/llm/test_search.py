"""Ranked search against scores of all documents, and on odd rows."""

import math
import random
from collections import Counter

import pytest

from gridsight.llm import lexical_search
from gridsight.llm.common import ready

DOCS, ITEMS = "doc_id bigint, text string", "item_id bigint, text string"


def plain(docs, items, k=20):
    texts = [(doc_id, [term.decode() for term in lexical_search.terms(text)]) for doc_id, text in docs]
    holders, total = sum(bool(own) for _, own in texts), sum(len(own) for _, own in texts)
    df = Counter(term for _, own in texts for term in set(own))
    asked = {}
    for item_id, text in items:
        asked.setdefault(item_id, Counter()).update(term.decode() for term in lexical_search.terms(text))
    found = []
    for item_id, query in asked.items():
        scores = []
        for doc_id, own in texts:
            tf, m = Counter(own), 75 + 25 * len(own) * holders // max(total, 1)
            score = sum(
                times * math.floor(1000 * math.log((2 * holders + 2) / (2 * df[term] + 1))) * (10**9 * tf[term] // (1000 * tf[term] + 12 * m))
                for term, times in query.items() if tf[term]
            )
            if score > 0:
                scores.append((-score, doc_id is None, doc_id or 0))
        found += [(item_id, place, None if nameless else doc_id, -score) for place, (score, nameless, doc_id) in enumerate(sorted(scores)[:k], 1)]
    return sorted(found, key=repr)


def got(docs, items, **options):
    return sorted(map(tuple, lexical_search.ranked(docs, items, **options).collect()), key=repr)


def test_terms():
    assert lexical_search.terms("Ab-Cd9 éÉ x_y日本\x7f") == ["ab".encode(), b"cd9", "éÉ x".encode(), "y日本".encode()]
    assert lexical_search.terms(None) == [] == lexical_search.terms(" .,\n")


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(8)
    words = [f"w{int(rng.paretovariate(0.6))}" for _ in range(4000)]
    docs = [(doc_id, " ".join(rng.choices(words, k=rng.choice([0, 3, 20, 20, 200])))) for doc_id in range(400)]
    docs += [(500 + n, docs[n % 7][1]) for n in range(60)]  # equal scores
    return docs, [(item, " ".join(rng.choices(words, k=rng.randint(1, 25)))) for item in range(25)]


@pytest.mark.parametrize("shard, seeds, block", [(8192, 16, 10**9), (16, 3, 10**9), (50, 0, 300)])
def test_search(spark, corpus, shard, seeds, block):
    """Any size of shards, with and without thresholds, and any number of blocks of queries give the same."""
    ready(spark)
    docs, items = corpus
    spark_docs = spark.createDataFrame(docs, DOCS).repartition(3)
    assert got(spark_docs, spark.createDataFrame(items, ITEMS), seed_share=seeds, block_chars=block, shard_docs=shard) == plain(docs, items)


def test_intervals_that_cannot_win_are_not_scored(corpus):
    """Best-first search over one shard scores few documents."""
    docs, items = corpus
    shard = lexical_search._Shard()
    query = Counter(lexical_search.terms(items[0][1]))
    vocabulary = {term: place for place, term in enumerate(query)}
    for doc_id, text in docs:
        shard.add(doc_id, text, vocabulary)
    columns = [part.split()[0] for part in lexical_search.INDEX.split(", ")]
    row = type("Row", (), dict(zip(columns, shard.row("0"))))
    lists = lexical_search.Lists(row, dict.fromkeys(range(len(vocabulary)), 1000), row.holders, row.terms)
    looked = []
    maxima = lists.maxima
    lists.maxima = lambda begin, end: looked.append(len(begin)) or maxima(begin, end)
    every, _ = lists.best({place: query[term] for term, place in vocabulary.items()}, len(docs), 1)
    whole, looked[:] = sum(looked), []
    few, scores = lists.best({place: query[term] for term, place in vocabulary.items()}, 3, 1)
    assert set(few) <= set(every) and len(few) >= 3 and sum(looked) < whole


def test_odd_rows(spark):
    """Nulls, empty and long texts, ties, repeated rows and ids, columns with clashing names, empty tables."""
    ready(spark)
    long = " ".join(f"word{place}" for place in range(30_000))
    docs = [(1, "a b c"), (2, None), (3, ""), (4, long), (5, "A b"), (5, "A b"), (None, "b a"), (7, "... \n"), (9, "a b"), (8, "a b")]
    items = [(1, "a"), (2, None), (3, ""), (4, "WORD7 word8 word8 nothing"), (None, "b"), (6, "a"), (6, "b"), (7, long[:50_000]), (8, "-")]
    spark_docs = spark.createDataFrame([(*row, 1, "x") for row in docs], DOCS + ", score int, query string")
    spark_items = spark.createDataFrame([(*row, 1) for row in items], ITEMS + ", rank int")
    assert got(spark_docs, spark_items) == plain(docs, items)
    assert got(spark_docs, spark_items, k=2) == plain(docs, items, 2)
    for one, two in ((spark_docs.where("false"), spark_items), (spark_docs, spark_items.where("false")), (spark_docs.where("doc_id = 2"), spark_items)):
        assert got(one, two) == []
