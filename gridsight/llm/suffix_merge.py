"""Removal of passages that repeat, by merged Burrows-Wheeler transforms (operator 12).

A byte goes when a window of 100 bytes that covers it also starts earlier: in a document with a smaller id, or earlier in
the same one.

Where windows meet. Each window is named by the least hash of the 48-byte grams in it, so that equal windows have equal
names wherever they stand. Neighbouring windows of one name form a run, a string of at most ``RUN`` windows. Runs with the
same name meet; other strings cannot share a window. Runs of one name that are equal as a whole are counted once, in
the earliest place, the rest of them repeat it: that is what a collection with equal strings looks like anyway, and it keeps
a passage that very many documents share from growing. Names that very many documents have, as far as a bounded sample shows,
fall apart into single windows, so that no name draws a share of all rows to itself; this changes where windows meet, not
what is found.

Transforms. The strings left, different ones of one name or with a name that occurs twice in them, are cut from their
texts and dealt to buckets by name. A bucket sorts the suffixes of each of its shards, to a depth of 100 bytes, into a
Burrows-Wheeler transform with symbols of five bytes, those before a suffix. The shards are merged by refining their
interleaving: when it is the order of all suffixes by their first k bytes, reading the transforms in that order and
sorting what was read stably gives the order by k + 5. No suffix is sorted again. The round that first tells neighbours
apart gives their common prefix; neighbours still together after 20 rounds share a window, and of such an interval of
the order the earliest window stays.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ready, saved

WINDOW = 100
GRAM = 48
#: Windows of a run at most: as many as can hold one gram.
RUN = WINDOW - GRAM + 1
#: Bytes of texts a worker sends runs of together, and hashes at a time; the text that crosses is whole.
BATCH_BYTES, LOOK_BYTES = 4_000_000, 1 << 18
#: Strings of a bucket, about, and of one of its shards.
BUCKET_STRINGS, SHARD_STRINGS = 2000, 500
#: Bytes that a round of refinement adds.
STEP = 5
#: Documents of the sample that shows which names are common, characters of each of them that are looked at, and the share that makes a name common.
SAMPLE_DOCS, SAMPLE_CHARS, COMMON_SHARE = 2000, 20_000, 0.01
#: Runs whose grams are compared at a time.
TOGETHER = 8192
#: Ends a string in a transform; no byte of UTF-8.
END = 255

_U = np.uint64


def _scrambled(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> _U(27))) * _U(0x94D049BB133111EB)
    return values ^ (values >> _U(31))


def gram_hashes(data: bytes) -> np.ndarray:
    """A hash of the gram at each place of a text."""
    places = len(data) - GRAM + 1
    words = np.empty(len(data) - 7, np.uint64)
    for shift in range(8):
        words[shift::8] = np.frombuffer(data, "<u8", (len(data) - shift) // 8, shift)
    total = np.full(places, GRAM, np.uint64)
    for shift in range(0, GRAM, 8):
        total = (total ^ words[shift : shift + places]) * _U(0x9E3779B97F4A7C15)
        total ^= total >> _U(32)
    return _scrambled(total)


def least_of(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours."""
    size = 1
    while 2 * size <= width:
        values = np.minimum(values[:-size], values[size:])
        size *= 2
    return np.minimum(values[: len(values) - (width - size)], values[width - size :]) if size < width else values


def runs(data: bytes, sizes: np.ndarray, common: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Names, starts, windows, and whether the name occurs twice, of the runs of texts that stand one after another."""
    nothing = np.empty(0, np.int64)
    ends = np.cumsum(sizes)
    long = sizes >= WINDOW
    if not long.any():
        return nothing.view(np.uint64), nothing, nothing, nothing.astype(bool)
    hashes = gram_hashes(data)
    names = least_of(hashes, RUN)
    fresh = np.concatenate(([True], names[1:] != names[:-1]))
    fresh[(ends - sizes)[long]] = True
    # windows that cross the end of a text are none; a run ends before them
    inside = np.zeros(len(names) + 1, np.int8)
    np.add.at(inside, (ends - sizes)[long], 1)
    np.add.at(inside, (ends - WINDOW + 1)[long], -1)
    inside = np.cumsum(inside[:-1], dtype=np.int8) > 0
    fresh &= inside
    stops = np.flatnonzero(np.append(inside[:-1] & (fresh[1:] | ~inside[1:]), inside[-1])) + 1
    starts = np.flatnonzero(fresh)
    counts = stops - starts
    # runs that are too long, and those of common names, fall apart
    most = np.where(np.isin(names[starts], common), 1, RUN)
    pieces = -(-counts // most)
    if pieces.max() > 1:
        number = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        most = np.repeat(most, pieces)
        counts = np.minimum(np.repeat(counts, pieces) - number * most, most)
        starts = np.repeat(starts, pieces) + number * most
    own, last = names[starts], starts + counts - 1
    grams = np.lib.stride_tricks.sliding_window_view(hashes, RUN)
    twice = np.empty(len(starts), bool)
    for begin in range(0, len(starts), TOGETHER):
        part = slice(begin, begin + TOGETHER)
        left = starts[part] + (grams[starts[part]] == own[part, None]).argmax(axis=1)
        right = last[part] + RUN - 1 - (grams[last[part]][:, ::-1] == own[part, None]).argmax(axis=1)
        twice[part] = left != right
    return own, starts, counts, twice & (counts > 1)


#: detail: twice the windows, plus one if the name occurs twice; of a span that is gone, its bytes.
RUNS = "name long, content long, doc_key long, mark long, start int, detail int, gone boolean"
_RUN_COLUMNS = [part.split()[0] for part in RUNS.split(", ")]


def _encoded(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def _joined_spans(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of spans."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    starts, reach = starts[order], np.maximum.accumulate(ends[order])
    fresh = np.flatnonzero(np.concatenate(([True], starts[1:] > reach[:-1])))
    return starts[fresh], reach[np.append(fresh[1:], len(starts)) - 1]


def _batch_runs(docs: list[tuple[int, int, bytes]], common: np.ndarray) -> pd.DataFrame:
    """Runs of a batch of texts; of equal ones the earliest, and what the others cover as spans that are gone."""
    docs = sorted(set(docs), key=lambda doc: doc[:2])  # rows that repeat a document are no repetition of it
    sizes = np.array([len(doc[2]) for doc in docs], np.int64)
    data = b"".join(doc[2] for doc in docs)
    bases = np.cumsum(sizes) - sizes
    cuts = [0, *np.flatnonzero(np.diff(bases // LOOK_BYTES)).tolist(), len(docs)]  # small enough for a processor's cache
    parts = []
    for first, last in zip(cuts, cuts[1:]):
        base = bases[first] if first < len(docs) else len(data)
        end = bases[last] if last < len(docs) else len(data)
        found = runs(data[base:end], sizes[first:last], common)
        parts.append((found[0], found[1] + base, *found[2:]))
    names, places, counts, twice = (np.concatenate(column) for column in zip(*parts))
    if not len(names):
        return pd.DataFrame(columns=_RUN_COLUMNS)
    ends = places + counts + WINDOW - 1
    digest = xxhash.xxh3_64_intdigest
    contents = np.fromiter((digest(data[begin:end]) for begin, end in zip(places.tolist(), ends.tolist())), np.uint64, len(names))
    # a single window of a common name meets its equals by its whole content
    names = np.where((counts == 1) & np.isin(names, common), contents, names)
    doc = np.searchsorted(bases, places, "right") - 1
    doc_keys, marks = (np.array([one[side] for one in docs], np.int64) for side in (0, 1))
    # documents and their runs stand in order, so that a stable sort puts the earliest first
    order = np.lexsort((contents, names))
    again = np.zeros(len(order), bool)
    again[order[1:]] = (names[order[1:]] == names[order[:-1]]) & (contents[order[1:]] == contents[order[:-1]])
    stay = ~again
    left = pd.DataFrame({
        "name": names[stay].view(np.int64), "content": contents[stay].view(np.int64), "doc_key": doc_keys[doc[stay]],
        "mark": marks[doc[stay]], "start": (places - bases[doc])[stay], "detail": (2 * counts + twice)[stay], "gone": False,
    })
    if not again.any():
        return left
    # texts are apart by a place, so that spans of neighbours do not touch
    begin, stop = _joined_spans((places + doc)[again], (ends + doc)[again])
    shifted = bases + np.arange(len(bases))
    doc = np.searchsorted(shifted, begin, "right") - 1
    spans = pd.DataFrame({
        "name": _scrambled(begin.view(np.uint64)).view(np.int64), "content": begin, "doc_key": doc_keys[doc], "mark": marks[doc],
        "start": begin - shifted[doc], "detail": stop - begin, "gone": True,
    })
    return pd.concat([left, spans], ignore_index=True)


def _found_runs(common: np.ndarray):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        docs: list[tuple[int, int, bytes]] = []
        held = 0
        for rows in frames:
            for key, mark, text in zip(rows["doc_key"].tolist(), rows["mark"].tolist(), rows["text"]):
                docs.append((key, mark, _encoded(text)))
                held += len(docs[-1][2])
                if held >= BATCH_BYTES:
                    yield _batch_runs(docs, common)
                    docs, held = [], 0
        if docs:
            yield _batch_runs(docs, common)

    return run


#: gone: a span of bytes that goes; else a string whose windows are still to be compared.
MET = "gone boolean, name long, doc_key long, mark long, start int, size int"


def _met(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of a stream sorted by name, content and place: spans of repeated runs, and runs that meet others of their name."""
    columns = [part.split()[0] for part in MET.split(", ")]
    last = None  # the row before
    pending = None  # the only run of its name so far, as a frame
    for rows in frames:
        gone, detail = rows["gone"].to_numpy(bool), rows["detail"].to_numpy(np.int64)
        rows = rows.assign(size=np.where(gone, detail, detail >> 1))
        out, rows, detail = [rows.loc[gone, columns]], rows[~gone], detail[~gone]
        if len(rows):
            names, contents = rows["name"].to_numpy(), rows["content"].to_numpy()
            fresh_name = np.concatenate(([last is None or last[0] != names[0]], names[1:] != names[:-1]))
            fresh = fresh_name | np.concatenate(([last is None or last[1] != contents[0]], contents[1:] != contents[:-1]))
            places = rows[["doc_key", "mark", "start"]].to_numpy()
            before = np.concatenate((np.array([last[2] if last else (0, 0, -1)]), places[:-1]))
            again = rows[~fresh & (places != before).any(axis=1)]
            out.append(again.assign(gone=True, size=again["size"] + WINDOW - 1)[columns])
            group = np.cumsum(fresh_name)  # 0: the name of the batch before
            kept = np.flatnonzero(fresh)
            number = np.bincount(group[kept], minlength=group[-1] + 1)
            if pending is not None and (number[0] or fresh_name[0]):
                if number[0]:
                    out.append(pending)
                pending = None
            contested = (number[group[kept]] > 1) | (group[kept] == 0) | (detail[kept] % 2 > 0)
            # the last name may go on: its only run waits
            if group[-1] > 0:
                waits = (group[kept] == group[-1]) & ~contested
                if waits.any():
                    pending = rows.iloc[kept[waits]][columns]
            out.append(rows.iloc[kept[contested]][columns])
            last = (names[-1], contents[-1], places[-1])
        yield pd.concat(out, ignore_index=True)


def shard_of(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The transform of a collection of strings, each with its end, and the place each suffix starts at.

    Suffixes are the rotations of a string and its end, sorted to a depth of a window; places count over all strings. The
    transform has the ``STEP`` bytes before each suffix, as a number.
    """
    data = np.frombuffer(b"".join(string + bytes([END]) for string in strings), np.uint8)
    sizes = np.array([len(string) + 1 for string in strings])
    ends = np.repeat(np.cumsum(sizes), sizes)
    sizes = np.repeat(sizes, sizes)
    here = np.arange(len(data))

    def ahead(step: int) -> np.ndarray:
        place = here + step
        return np.where(place >= ends, place - sizes, place)

    packed, near = np.zeros(len(data), np.uint64), None
    for step in range(8):
        packed = (packed << _U(8)) | data[ahead(step)]
        if step == STEP - 1:
            near = packed
    (rank, order), depth = _ranked(packed), 8
    while depth < WINDOW:
        step = min(depth, WINDOW - depth)
        rank, order = _ranked(rank * np.int64(len(data)) + rank[ahead(step)])
        depth += step
    before = order - STEP
    before = np.where(before < (ends - sizes)[order], before + sizes[order], before)
    return near[before], order


def _ranked(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The place of each value among the distinct ones, and an order of the values."""
    order = np.argsort(values)
    ordered = values[order]
    rank = np.empty(len(values), np.int64)
    rank[order] = np.cumsum(np.concatenate(([0], ordered[1:] != ordered[:-1])))
    return rank, order


def merged(transforms: list[np.ndarray], depth: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """The merged order of the suffixes of shards, and the common prefix of each with the one before, in whole steps.

    The order is given as places in the concatenation of the shards. Symbols are the steps before a suffix by rank; where
    these do not fit 16 bits, sorting them is slower and nothing else changes.
    """
    sizes = [len(one) for one in transforms]
    symbols, _ = _ranked(np.concatenate(transforms))
    total = len(symbols)
    symbols = symbols.astype(np.uint16 if symbols.max() < 1 << 16 else np.int64)
    shard = np.repeat(np.arange(len(sizes), dtype=np.uint8 if len(sizes) <= 256 else np.uint16), sizes)
    common = np.full(total, depth, np.int16)
    common[0] = -1
    head = np.zeros(total, bool)
    head[0] = True
    block, read = np.zeros(total, np.int32), np.empty(total, symbols.dtype)
    for known in range(0, depth, STEP):
        read[np.argsort(shard, kind="stable")] = symbols  # each shard in its own order, dealt as the interleaving says
        order = np.argsort(read, kind="stable")
        shard, ordered, came = shard[order], read[order], block[order]
        apart = (ordered[1:] != ordered[:-1]) | (came[1:] != came[:-1])
        apart &= ~head[1:]
        common[1:][apart] = known
        head[1:] |= apart
        block = np.cumsum(head, dtype=np.int32)
    source = np.empty(total, np.int64)
    source[np.argsort(shard, kind="stable")] = np.arange(total)
    return source, common


CUT = "bucket long, doc_key long, mark long, start int, string binary"


def _cut(buckets: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in frames:
            strings: list[bytes] = []
            for text, starts, sizes in zip(rows["text"], rows["starts"], rows["sizes"]):
                data = _encoded(text)
                strings += [data[begin : begin + size + WINDOW - 1] for begin, size in zip(starts.tolist(), sizes.tolist())]
            times = rows["starts"].map(len).to_numpy()
            names, starts = (np.concatenate([*rows[name], np.empty(0, np.int64)]) for name in ("names", "starts"))
            yield pd.DataFrame({
                "bucket": names % buckets, "doc_key": np.repeat(rows["doc_key"].to_numpy(), times),
                "mark": np.repeat(rows["mark"].to_numpy(), times), "start": starts, "string": strings,
            })

    return run


SPANS = "doc_key long, mark long, start int, size int"


def _repeated(shard_strings: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        """Spans of the windows that a bucket holds at an earlier place too."""
        strings = rows["string"].tolist()
        shards = [shard_of(strings[begin : begin + shard_strings]) for begin in range(0, len(strings), shard_strings)]
        order, common = merged([transform for transform, _ in shards])
        # per suffix, in the merged order: its string and where it starts there
        sizes = np.array([len(one) for one in strings])
        begins = np.cumsum(sizes + 1) - sizes - 1
        bases = np.cumsum([0, *[len(origin) for _, origin in shards[:-1]]])
        at = np.concatenate([origin + base for (_, origin), base in zip(shards, bases)])[order]
        string = np.searchsorted(begins, at, "right") - 1
        place = at - begins[string]
        interval = np.cumsum(common < WINDOW)
        whole = place + WINDOW <= sizes[string]
        string, place, interval = string[whole], place[whole], interval[whole]
        keys, marks, starts = (rows[name].to_numpy(np.int64)[string] for name in ("doc_key", "mark", "start"))
        starts = starts + place
        order = np.lexsort((starts, marks, keys, interval))
        keys, marks, starts, interval = keys[order], marks[order], starts[order], interval[order]
        again = np.concatenate(([False], interval[1:] == interval[:-1])) if len(interval) else np.empty(0, bool)
        keys, marks, starts = keys[again], marks[again], starts[again]
        order = np.lexsort((starts, marks, keys))
        keys, marks, starts = keys[order], marks[order], starts[order]
        if not len(keys):
            return pd.DataFrame(columns=["doc_key", "mark", "start", "size"])
        apart = np.concatenate(([True], (keys[1:] != keys[:-1]) | (marks[1:] != marks[:-1]) | (starts[1:] > starts[:-1] + WINDOW)))
        begin = np.flatnonzero(apart)
        stop = np.append(begin[1:], len(keys)) - 1
        return pd.DataFrame({"doc_key": keys[begin], "mark": marks[begin], "start": starts[begin], "size": starts[stop] + WINDOW - starts[begin]})

    return run


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:int,size:int>>"


def _removed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for rows in frames:
        out = []
        for doc_id, text, spans in zip(rows["doc_id"].astype("Int64"), rows["text"], rows["spans"]):
            data = _encoded(text)
            if spans is None or not len(spans):
                out.append((doc_id, len(data), 0, 0, hashlib.sha256(data).hexdigest(), []))
                continue
            starts, sizes = (np.array([one[side] for one in spans], np.int64) for side in ("start", "size"))
            starts, ends = _joined_spans(starts, starts + sizes)
            kept = hashlib.sha256()
            for begin, end in zip([0, *ends.tolist()], [*starts.tolist(), len(data)]):
                kept.update(data[begin:end])
            joined = [{"start": begin, "size": end - begin} for begin, end in zip(starts.tolist(), ends.tolist())]
            out.append((doc_id, len(data), int((ends - starts).sum()), len(starts), kept.hexdigest(), joined))
        made = pd.DataFrame(out, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])
        yield made.astype({"doc_id": "Int64"})


def _sampled_names(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    nothing = np.empty(0, np.uint64)
    for rows in frames:
        texts = [_encoded(text) for text in rows["text"]]
        found = [np.unique(runs(data, np.array([len(data)]), nothing)[0]) for data in texts]
        yield pd.DataFrame({"name": np.concatenate([*found, nothing]).view(np.int64)})


def common_names(rows: DataFrame) -> np.ndarray:
    """Names that a share of a bounded sample of documents has: where the work goes, not what is found, depends on them."""
    size = rows.count()
    sample = rows.select("doc_key", F.substring("text", 1, SAMPLE_CHARS).alias("text"))
    if size > SAMPLE_DOCS:
        sample = sample.where(F.pmod(F.xxhash64("doc_key"), F.lit(size)) < SAMPLE_DOCS)
    names = sample.select("text").mapInPandas(_sampled_names, "name long").groupBy("name").agg(F.count(F.lit(1)).alias("docs"))
    found = names.where(F.col("docs") >= SAMPLE_DOCS * COMMON_SHARE).select("name").collect()
    return np.sort(np.array([row["name"] for row in found], np.int64)).view(np.uint64)


def repeated_spans(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", bucket_strings: int = BUCKET_STRINGS, shard_strings: int = SHARD_STRINGS
) -> DataFrame:
    """One row per row of the table: doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans.

    Spans are the longest runs of bytes that go, in order; the bytes between them are kept. A null or empty text has no bytes, one
    under 100 bytes loses none; texts are used whole, however long. Rows that share an id are documents in the order of a hash
    of their texts; rows that share id and text are one document, with the same result each. A null id comes last. An
    empty table gives an empty one. Other columns are not read.
    """
    ready(docs.sparkSession)
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), text.alias("text"))
    rows = rows.withColumn("doc_key", F.coalesce("doc_id", F.lit((1 << 63) - 1))).withColumn("mark", F.xxhash64("text"))
    keyed = rows.select("doc_key", "mark", "text")
    found = keyed.mapInPandas(_found_runs(common_names(keyed)), RUNS)
    met = found.repartition("name").sortWithinPartitions("name", "content", "doc_key", "mark", "start")
    met = saved(met.mapInPandas(_met, MET), "repeats-met")

    open_ = met.where("NOT gone")
    buckets = max(1, open_.count() // bucket_strings)
    strings = open_.groupBy("doc_key", "mark").agg(*[F.collect_list(name).alias(f"{name}s") for name in ("name", "start", "size")])
    texts = keyed.dropDuplicates(["doc_key", "mark"]).join(strings, ["doc_key", "mark"])
    cut = texts.mapInPandas(_cut(buckets), CUT)
    repeats = saved(cut.groupBy("bucket").applyInPandas(_repeated(shard_strings), SPANS), "repeats-merged")

    spans = met.where("gone").select("doc_key", "mark", "start", "size").union(repeats)
    spans = spans.groupBy("doc_key", "mark").agg(F.collect_list(F.struct("start", "size")).alias("spans"))
    joined = rows.join(spans, ["doc_key", "mark"], "left").select("doc_id", "text", "spans")
    return joined.mapInPandas(_removed, RESULT)
