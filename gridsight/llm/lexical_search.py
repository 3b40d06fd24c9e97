"""Ranked lexical search by range maxima over posting lists (operator 13).

Score. A term is a longest run of ASCII letters and digits and of characters beyond ASCII, A-Z in lower case. N documents
hold a term, L terms in all; a document of n terms has m = 75 + (25 n N) div L. A query term that df documents hold weighs
w = floor(1000 ln((2N + 2) / (2 df + 1))), and w * ((10^9 tf) div (1000 tf + 12 m)) is its impact on a document where it
occurs tf times. A score is the sum of impacts over a query's terms, repeats included, in whole numbers.

Index. Tasks cut documents into shards of bounded size, sorted by length, and keep the posting lists of the query terms
as packed arrays; statistics are summed over all shards. Queries come in blocks, so that the terms sent to tasks are
bounded, and an index serves one block.

Search. Over the impacts of all lists of a shard lies one sparse table of the place of the maximum of 2^k neighbours: two
look-ups give the maximum of any range of a list. For a query, an interval of documents is bounded by the sum over its
terms of the range maxima. The best intervals are taken first, a wave at a time; each is split at the document with the
largest impact, which is scored in full, and the two remaining intervals get bounds of their own. An interval whose bound
is below the k-th best score so far is dropped: none of its documents can be among the k best. Equal bounds stay, for
ties go by id.

Thresholds. A share of the shards is searched first; the k-th best score found there is a lower bound for all, so that
most intervals of most shards go at once. Any share gives the same result.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import ready, saved

#: Documents and postings of a shard at most; the document that crosses is whole.
SHARD_DOCS, SHARD_POSTINGS = 8192, 500_000
#: Characters of the queries of a block, about.
BLOCK_CHARS = 2_000_000
#: One shard of so many is searched first, for thresholds.
SEED_SHARE = 16
#: Intervals split at a time.
WAVE = 64

#: Bytes of terms stay, A-Z in lower case, all others part terms.
_TERMS = bytes(
    byte + 32 if 65 <= byte <= 90 else byte if byte >= 128 or chr(byte).isalnum() else 32 for byte in range(256)
)

INDEX = "shard string, holders long, terms long, doc_ids binary, unnamed binary, lengths binary, places binary, starts binary, docs binary, tfs binary"
FOUND = "query int, doc_id long, score long"


def terms(text: str | None) -> list[bytes]:
    """The terms of a text, in order; a null text has none."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_TERMS).split()


class _Shard:
    """Documents met so far and their postings."""

    def __init__(self):
        self.ids: list = []
        self.lengths: list[int] = []
        self.postings: list[tuple[int, int, int]] = []

    def add(self, doc_id, text: str | None, vocabulary: dict[bytes, int]) -> None:
        found = terms(text)
        own = Counter(place for place in map(vocabulary.get, found) if place is not None)
        doc = len(self.ids)
        self.ids.append(doc_id)
        self.lengths.append(len(found))
        self.postings.extend((place, doc, tf) for place, tf in own.items())

    def full(self, docs: int) -> bool:
        return len(self.ids) >= docs or len(self.postings) >= SHARD_POSTINGS

    def row(self, name: str) -> tuple:
        lengths = np.array(self.lengths, np.int64)
        order = np.argsort(lengths, kind="stable")
        moved = np.empty(len(order), np.int64)
        moved[order] = np.arange(len(order))
        unnamed = np.array([doc_id is None for doc_id in self.ids], np.uint8)
        ids = np.array([0 if doc_id is None else doc_id for doc_id in self.ids], np.int64)
        posts = np.array(self.postings, np.int64).reshape(-1, 3)
        posts[:, 1] = moved[posts[:, 1]]
        posts = posts[np.lexsort((posts[:, 1], posts[:, 0]))]
        places, starts = np.unique(posts[:, 0], return_index=True)
        arrays = [
            ids[order], unnamed[order], lengths[order], places.astype("<i4"), np.append(starts, len(posts)).astype("<i4"),
            posts[:, 1].astype("<i4"), posts[:, 2].astype("<i4"),
        ]
        return (name, int((lengths > 0).sum()), int(lengths.sum()), *(array.tobytes() for array in arrays))


def _indexed(vocabulary: dict[bytes, int], shard_docs: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        task, made, shard = TaskContext.get().partitionId(), 0, _Shard()
        columns = [part.split()[0] for part in INDEX.split(", ")]
        for rows in frames:
            for doc_id, text in zip(rows["doc_id"].astype("Int64"), rows["text"]):
                shard.add(None if doc_id is pd.NA else int(doc_id), text, vocabulary)
                if shard.full(shard_docs):
                    yield pd.DataFrame([shard.row(f"{task}-{made}")], columns=columns)
                    made, shard = made + 1, _Shard()
        if shard.ids:
            yield pd.DataFrame([shard.row(f"{task}-{made}")], columns=columns)

    return run


def _frequencies(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """In how many documents of the shards of a task each query term occurs."""
    total: Counter = Counter()
    for rows in frames:
        for places, starts in zip(rows["places"], rows["starts"]):
            total.update(dict(zip(np.frombuffer(places, "<i4").tolist(), np.diff(np.frombuffer(starts, "<i4")).tolist())))
    yield pd.DataFrame({"place": list(total.keys()), "df": list(total.values())}, dtype="int64")


class Lists:
    """Posting lists of a shard with their impacts and the sparse table of places of maxima."""

    def __init__(self, row, weights: dict[int, int], holders: int, total: int):
        self.ids, self.unnamed = np.frombuffer(row.doc_ids, "<i8"), np.frombuffer(row.unnamed, np.uint8)
        m = 75 + (25 * np.frombuffer(row.lengths, "<i8") * holders) // total
        places, self.starts = np.frombuffer(row.places, "<i4"), np.frombuffer(row.starts, "<i4").astype(np.int64)
        self.docs, tf = np.frombuffer(row.docs, "<i4").astype(np.int64), np.frombuffer(row.tfs, "<i4").astype(np.int64)
        weight = np.array([weights[place] for place in places.tolist()], np.int64)
        sizes = np.diff(self.starts)
        self.impacts = np.repeat(weight, sizes) * ((1_000_000_000 * tf) // (1000 * tf + 12 * m[self.docs]))
        self.list_of = {place: number for number, place in enumerate(places.tolist())}
        self.size = len(self.ids)
        # ascending: lists one after another, documents ascending inside; the end stands for no posting
        self.keys = np.append(np.repeat(np.arange(len(places)), sizes) * self.size + self.docs, np.iinfo(np.int64).max)
        self.padded = np.append(self.impacts, 0)
        # row k: the place of the largest of 2^k impacts from each place on
        longest = int(sizes.max()) if len(sizes) else 1
        self.table = np.zeros((longest.bit_length(), len(self.docs)), np.int32)
        self.table[0] = np.arange(len(self.docs))
        for level in range(1, len(self.table)):
            half = 1 << (level - 1)
            left, right = self.table[level - 1, :-half], self.table[level - 1, half:]
            self.table[level, :-half] = np.where(self.impacts[left] >= self.impacts[right], left, right)

    def maxima(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Place of the largest impact of each range of postings; empty ranges get the place after the last."""
        length = end - begin
        some = length > 0
        level = np.frexp(np.maximum(length, 1).astype(np.float64))[1] - 1
        begin = np.where(some, begin, 0)
        if not len(self.impacts):
            return np.zeros_like(begin)
        left, right = self.table[level, begin], self.table[level, np.where(some, end - (1 << level), 0)]
        best = np.where(self.impacts[left] >= self.impacts[right], left, right)
        return np.where(some, best, len(self.impacts))

    def best(self, query: dict[int, int], k: int, least: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents and scores of the ``k`` best of a query that reach ``least``, ties beyond the k-th included."""
        lists = [(self.list_of[place], times) for place, times in query.items() if place in self.list_of]
        found_docs, found_scores = np.empty(0, np.int64), np.empty(0, np.int64)
        if not lists:
            return found_docs, found_scores
        number, times = (np.array(column, np.int64) for column in zip(*lists))
        begin, end = self.starts[number][None, :], self.starts[number + 1][None, :]
        places = self.maxima(begin, end)
        bounds = (self.padded[places] * times).sum(axis=1)
        while True:
            open_ = bounds >= least
            begin, end, places, bounds = begin[open_], end[open_], places[open_], bounds[open_]
            if not len(bounds):
                return found_docs, found_scores
            wave = np.argpartition(-bounds, WAVE)[:WAVE] if len(bounds) > WAVE else np.arange(len(bounds))
            rest = np.ones(len(bounds), bool)
            rest[wave] = False
            b, e, at = begin[wave], end[wave], places[wave]
            widest = (self.padded[at] * times).argmax(axis=1)
            doc = self.docs[at[np.arange(len(wave)), widest]]
            key = number[None, :] * self.size + doc[:, None]
            place = np.searchsorted(self.keys, key)
            hit = self.keys[place] == key
            scores = (self.padded[place] * times * hit).sum(axis=1)
            found_docs, found_scores = np.append(found_docs, doc), np.append(found_scores, scores)
            if len(found_scores) >= k:
                least = max(least, int(np.partition(found_scores, -k)[-k]))
            stay = found_scores >= least
            found_docs, found_scores = found_docs[stay], found_scores[stay]
            # the split document leaves both sides
            new_begin, new_end = np.concatenate((b, place + hit)), np.concatenate((place, e))
            new_places = self.maxima(new_begin, new_end)
            new_bounds = (self.padded[new_places] * times).sum(axis=1)
            begin, end = np.concatenate((begin[rest], new_begin)), np.concatenate((end[rest], new_end))
            places, bounds = np.concatenate((places[rest], new_places)), np.concatenate((bounds[rest], new_bounds))


def _searched(queries: list[dict[int, int]], weights: dict[int, int], holders: int, total: int, k: int, least: list[int]):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in frames:
            for row in rows.itertuples():
                lists = Lists(row, weights, holders, total)
                out = []
                for number, query in enumerate(queries):
                    docs, scores = lists.best(query, k, least[number])
                    nameless = lists.unnamed[docs] > 0
                    order = np.lexsort((lists.ids[docs], nameless, -scores))[:k]
                    for place in order:
                        out.append((number, pd.NA if nameless[place] else int(lists.ids[docs[place]]), int(scores[place])))
                made = pd.DataFrame(out, columns=["query", "doc_id", "score"])
                yield made.astype({"query": "int32", "doc_id": "Int64", "score": "int64"})

    return run


def _searched_block(docs: DataFrame, items: list[tuple], k: int, seed_share: int, shard_docs: int) -> DataFrame | None:
    """The best documents of each shard for a block of items (id, text)."""
    counted: dict = {}
    for item_id, text in items:
        counted.setdefault(item_id, Counter()).update(terms(text))
    names = [item_id for item_id, own in counted.items() if own]
    vocabulary = {term: place for place, term in enumerate(sorted({term for own in counted.values() for term in own}))}
    queries = [{vocabulary[term]: times for term, times in counted[item_id].items()} for item_id in names]
    if not queries:
        return None
    index = saved(docs.mapInPandas(_indexed(vocabulary, shard_docs), INDEX), "lexical-index")
    holders, total = index.agg(F.sum("holders"), F.sum("terms")).first()
    if not total:
        return None
    spread = index.select("places", "starts").mapInPandas(_frequencies, "place long, df long")
    # one row per query term of the block
    frequency = {row["place"]: row["df"] for row in spread.groupBy("place").agg(F.sum("df").alias("df")).collect()}
    weights = {place: math.floor(1000 * math.log((2 * holders + 2) / (2 * df + 1))) for place, df in frequency.items()}

    least = [1] * len(queries)
    if seed_share:
        seeds = index.where(F.pmod(F.xxhash64("shard"), F.lit(seed_share)) == 0)
        seen = seeds.mapInPandas(_searched(queries, weights, holders, total, k, least), FOUND)
        place = F.row_number().over(W.partitionBy("query").orderBy(F.desc("score")))
        kth = seen.select("query", "score", place.alias("place")).where(F.col("place") == k)
        for row in kth.collect():  # one number per query of the block
            least[row["query"]] = max(1, row["score"])
    found = index.mapInPandas(_searched(queries, weights, holders, total, k, least), FOUND)
    named = docs.sparkSession.createDataFrame(list(enumerate(names)), "query int, item_id long")
    return saved(found.join(named, "query").select("item_id", "doc_id", "score"), "lexical-found")


def ranked(
    docs: DataFrame, items: DataFrame, k: int = 20, id_column: str = "doc_id", text_column: str = "text",
    item_column: str = "item_id", item_text: str = "text", block_chars: int = BLOCK_CHARS, seed_share: int = SEED_SHARE,
    shard_docs: int = SHARD_DOCS,
) -> DataFrame:
    """The ``k`` best documents of each item: item_id, rank, doc_id, score; fewer where fewer score above 0.

    Null and empty texts, and those without a term, find nothing and are not found. Texts are used whole, however long.
    Rows that share an item_id, a null one included, are one item with all their terms. Each row of the documents is a document
    of its own, repeated rows too; equal scores go by id, a null id last. Without documents or items the result is
    empty. Other columns are not read.
    """
    spark = ready(docs.sparkSession)
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    asked = items.select(F.col(item_column).cast("long").alias("item_id"), F.col(item_text).cast("string").alias("text"))
    blocks = 1 + (asked.agg(F.sum(F.length("text"))).first()[0] or 0) // block_chars
    block = F.pmod(F.xxhash64("item_id"), F.lit(blocks))
    parts = []
    for number in range(blocks):
        own = [tuple(row) for row in asked.where(block == number).collect()]  # a block of queries, bounded by its characters
        part = _searched_block(rows, own, k, seed_share, shard_docs)
        if part is not None:
            parts.append(part)
    if not parts:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    best = W.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    found = reduce(DataFrame.union, parts).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return found.select("item_id", "rank", "doc_id", "score")
