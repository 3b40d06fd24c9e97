"""Repeated passages against a plain look at every window, and on odd rows."""

import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gridsight.llm import suffix_merge
from gridsight.llm.common import ready, table

FOLDER = "/root/testdata/sf0.001"


def plain(rows):
    """Result of each row, windows looked at in the order of documents; rows that share id and text are one document."""
    seen, found = set(), {}
    for key in sorted({(row[0] is None, row[0] or 0, row[1] or "") for row in rows}):
        data = key[2].encode()
        cover = np.zeros(len(data) + 1, int)
        for start in range(len(data) - suffix_merge.WINDOW + 1):
            window = data[start : start + suffix_merge.WINDOW]
            if window in seen:
                cover[start] += 1
                cover[start + suffix_merge.WINDOW] -= 1
            seen.add(window)
        gone = np.cumsum(cover)[:-1] > 0
        kept = bytes(np.frombuffer(data, np.uint8)[~gone])
        spans = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        found[key] = (len(data), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())
    return sorted(((row[0], *found[(row[0] is None, row[0] or 0, row[1] or "")]) for row in rows), key=repr)


def got(docs, **options):
    return sorted((tuple(row)[:5] for row in suffix_merge.repeated_spans(docs, **options).collect()), key=repr)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.text(alphabet="ab", min_size=1, max_size=30).map(str.encode), min_size=1, max_size=5), min_size=1, max_size=4))
def test_merging_shards_gives_the_order_of_all_suffixes(shards):
    """Orders and common prefixes of rotations, to the depth of the merge."""
    depth = suffix_merge.WINDOW
    parts = [suffix_merge.shard_of([one.ljust(depth, b"c") for one in strings]) for strings in shards]
    order, common = suffix_merge.merged([transform for transform, _ in parts])
    rotations = []
    for strings, (_, origin) in zip(shards, parts):
        own = []
        for string in strings:
            whole = string.ljust(depth, b"c") + bytes([suffix_merge.END])
            own += [(whole[place:] + whole[:place])[:depth] for place in range(len(whole))]
        rotations += [own[place] for place in origin]
    placed = [rotations[place] for place in order]
    assert placed == sorted(rotations)
    for one, two, prefix in zip(placed, placed[1:], common[1:]):
        same = next((place for place in range(depth) if one[place] != two[place]), depth)
        assert prefix == same // suffix_merge.STEP * suffix_merge.STEP


def test_least_of_neighbours():
    values = np.random.default_rng(1).integers(0, 1000, 300).astype(np.uint64)
    for width in (1, 2, 7, 53, 64, 69):
        assert suffix_merge.least_of(values, width).tolist() == [min(values[at : at + width]) for at in range(300 - width + 1)]


def test_runs_cover_every_window_once():
    rng = random.Random(4)
    texts = [bytes(rng.choices(b"ab ", k=rng.choice([0, 50, 99, 100, 101, 700]))) for _ in range(12)] + [b"a" * 1000]
    sizes = np.array([len(text) for text in texts])
    for common in (np.empty(0, np.uint64), np.unique(suffix_merge.runs(b"".join(texts), sizes, np.empty(0, np.uint64))[0])[:5]):
        _, starts, counts, _ = suffix_merge.runs(b"".join(texts), sizes, common)
        windows = [place for start, count in zip(starts, counts) for place in range(start, start + count)]
        bases = np.cumsum(sizes) - sizes
        assert windows == [base + place for base, size in zip(bases, sizes) for place in range(max(0, size - 99))]
        assert counts.max() <= suffix_merge.RUN


def test_the_documents(spark):
    ready(spark)
    docs = table(spark, FOLDER, "documents")
    assert got(docs) == plain([(row["doc_id"], row["text"]) for row in docs.collect()])


@pytest.fixture
def passages():
    """Documents that share passages, lines of one character, and a passage that all have."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choices("abcdefgh", k=rng.randint(2, 7)))
    passage = lambda size: " ".join(word() for _ in range(size))
    shared, everywhere = [passage(40) for _ in range(4)], passage(60)
    rows = []
    for doc_id in range(60):
        parts = [passage(rng.randint(0, 60)), rng.choice(shared), everywhere, passage(5), rng.choice(shared)[20:150], "=" * rng.choice([0, 90, 150, 400])]
        rng.shuffle(parts)
        rows.append((doc_id, "\n".join(parts)))
    return rows


@pytest.mark.parametrize("bucket, shard, sample", [(10, 3, 10**9), (7, 2, 1), (5000, 500, 1)])
def test_passages(spark, passages, monkeypatch, bucket, shard, sample):
    """Any size of buckets and shards, and names that count as common, give the same."""
    ready(spark)
    monkeypatch.setattr(suffix_merge, "COMMON_SHARE", sample * 5 / suffix_merge.SAMPLE_DOCS)
    docs = spark.createDataFrame(passages, "doc_id bigint, text string").repartition(4)
    assert got(docs, bucket_strings=bucket, shard_strings=shard) == plain(passages)


def test_odd_rows(spark):
    """Nulls, empty and long texts, rows that share an id, repeated rows, and columns with clashing names."""
    ready(spark)
    long = " ".join(f"word{place}" for place in range(30_000))
    rows = [
        (1, long), (2, None), (3, ""), (4, "x" * 99), (5, "x" * 100), (6, "x" * 300), (None, long[1000:5000]), (7, long[2000:2400] + "é" * 40),
        (8, "a" * 50 + long[:200]), (8, "b" * 50 + long[:200]), (9, long[:150]), (9, long[:150]), (None, None),
    ]
    docs = spark.createDataFrame([(*row, 1, 2, "n") for row in rows], "doc_id bigint, text string, start int, size int, name string")
    assert got(docs) == plain(rows)
    spans = {row["doc_id"]: row["spans"] for row in suffix_merge.repeated_spans(docs).collect() if row["doc_id"] == 7}
    assert [(span["start"], span["size"]) for span in spans[7]] == [(0, 400)]
    assert got(docs.where("false")) == []
