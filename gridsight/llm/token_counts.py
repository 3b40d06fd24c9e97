"""Token counts without token ids (operator 5).

A text is cut into words the way the byte-level pre-tokenizer does; each word starts as one symbol per UTF-8 byte.
A heap holds the adjacent pairs that may merge, ordered by rank and then by place; a doubly linked list holds the
symbols. The lowest pair is popped, merged and its new neighbours pushed, until no pair is left. The count of a word is
its bytes less its merges. Counts of words and of parts of texts repeat a great deal and are kept in dictionaries of
bounded size, once per worker.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .encoding import byte_characters, parts_of, special_strings, splits_at_spaces

#: Fixed value: how the byte-level pre-tokenizer cuts text.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
KEPT = 600_000
LONGEST_KEPT = 64

_counters: dict[str, Counter] = {}


def merges_of(symbols: list[int], ranks: dict[tuple[int, int], tuple[int, int]]) -> int:
    """How many merges a list of symbols goes through; ``ranks`` maps a pair to its rank and the symbol it becomes."""
    size = len(symbols)
    heap = [(*ranks[pair], place, *pair) for place, pair in enumerate(zip(symbols, symbols[1:])) if pair in ranks]
    if not heap:
        return 0
    heap = [(rank, place, left, right, made) for rank, made, place, left, right in heap]
    heapq.heapify(heap)
    live = symbols[:]
    following = list(range(1, size + 1))
    before = list(range(-1, size - 1))
    merges = 0
    while heap:
        _, place, left, right, made = heapq.heappop(heap)
        after = following[place]
        if live[place] != left or after >= size or live[after] != right:
            continue  # one of the two has merged since
        merges += 1
        live[place], live[after] = made, -1
        after = following[place] = following[after]
        if after < size:
            before[after] = place
            if (found := ranks.get((made, live[after]))) is not None:
                heapq.heappush(heap, (found[0], place, made, live[after], found[1]))
        ahead = before[place]
        if ahead >= 0 and (found := ranks.get((live[ahead], made))) is not None:
            heapq.heappush(heap, (found[0], ahead, live[ahead], made, found[1]))
    return merges


class Counter:
    """Counts of whole texts under one tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            description = json.load(file)
        if not splits_at_spaces(description) or description["model"].get("type", "BPE") != "BPE":
            raise ValueError(f"{path} is not a byte-level byte-pair vocabulary")
        vocabulary = description["model"]["vocab"]
        pairs = (pair if isinstance(pair, list) else pair.split(" ") for pair in description["model"]["merges"])
        self.ranks = {
            (vocabulary[left], vocabulary[right]): (rank, vocabulary[left + right]) for rank, (left, right) in enumerate(pairs)
        }
        shown = byte_characters()
        self.first = [vocabulary[shown[byte]] for byte in range(256)]
        specials = sorted(special_strings(description), key=len, reverse=True)
        self.specials = regex.compile("|".join(map(regex.escape, specials))) if specials else None
        self.find = regex.compile(PATTERN).findall
        self.words: dict[str, int] = {}
        self.parts: dict[str, int] = {}

    def word(self, word: str) -> int:
        """Tokens of one word."""
        found = self.words.get(word)
        if found is None:
            data = word.encode()
            found = len(data) - merges_of([self.first[byte] for byte in data], self.ranks)
            if len(word) <= LONGEST_KEPT:
                self.words[word] = found
        return found

    def part(self, part: str) -> int:
        """Tokens of a part that starts with a space."""
        found = self.parts.get(part)
        if found is None:
            if part.isalpha():
                found = self.word(" " + part)
            else:
                found = sum(map(self.word, self.find(" " + part)))
            if len(part) <= LONGEST_KEPT:
                self.parts[part] = found
        return found

    def ordinary(self, text: str) -> int:
        """Tokens of a text without special strings."""
        if not text:
            return 0
        first, rest = parts_of(text)
        return sum(map(self.word, self.find(first))) + sum(map(self.part, rest))

    def count(self, text: str | None) -> int:
        """Tokens of a text; a special string is one. A null text is empty."""
        if not text:
            return 0
        for kept in (self.words, self.parts):
            if len(kept) > KEPT:
                kept.clear()
        if self.specials is None or self.specials.search(text) is None:
            return self.ordinary(text)
        return sum(map(self.ordinary, self.specials.split(text))) + len(self.specials.findall(text))


def counter(path: str) -> Counter:
    """The counter of a file, made once per worker."""
    if path not in _counters:
        _counters[path] = Counter(path)
    return _counters[path]


def token_counts(
    docs: DataFrame, vocabulary: str, limit: int = 512, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """Bytes and tokens of every text, and whether it has more than ``limit`` tokens.

    One row per row of the table, repeated rows included; a null or empty text has no bytes and no tokens; a null id
    stays null. A text of any length is counted whole. Other columns are not read.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count = counter(vocabulary).count
        for rows in frames:
            n_tokens = pd.Series([count(text) for text in rows["text"]], index=rows.index, dtype="int64")
            n_bytes = rows["n_bytes"].astype("int64")
            doc_id = rows["doc_id"].astype("Int64")
            yield pd.DataFrame({"doc_id": doc_id, "n_bytes": n_bytes, "n_tokens": n_tokens, "over_limit": n_tokens > limit})

    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.octet_length(text).alias("n_bytes"), text.alias("text"))
    return rows.mapInPandas(run, "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean")
