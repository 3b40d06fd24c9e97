"""Near duplicates by word shingles: a parity-sketch join (operator 7).

A document is the set of hashes of its distinct five-word shingles. Two sets of a and b elements have a Jaccard
similarity of 0.8 or more exactly when they differ in at most d = (a + b) / 9 elements, and then b <= 1.25 a.

Sketch and pigeonhole. A document's sketch is the parity, position by position, of its elements' hashes; each element
that differs flips one position, so the Hamming distance of two sketches is a lower bound of the symmetric difference.
The positions are cut into K bands with K > d, and a band is compared by the XOR of the hashes of its elements. Sets that
differ in at most d elements differ in at most d bands: as sets of K band keys they share K - d, so the first d + 1 keys
of each, in one order for all, have one in common. The order takes bands with many elements first, which chance
rarely makes alike and which empty bands never lead. K follows from the size class of the smaller document; classes grow
by 1.25, so a document takes part in its own class and in the one below.

Join. Keys of a batch of documents travel as packed arrays, one row per bucket of keys. A bucket finds the keys that
several documents share; the smallest document of a key leads it. All documents of the keys that one document leads are a
team, so that two documents meet once per leader they have in common, not once per key. A team is compared in place: first
by sizes and sketches, which leaves the documents that may be linked with any other; then these on whole sets, where a pair
that links already connect is passed over. What comes out of a team are documents, then links that make a forest, so that
rows grow with a team and not with its pairs. Each pair that shares a key is connected or was refused. Documents with the
same set in a task send keys once. Keys that very many documents have, as far as a bounded sample shows, are dealt by
document instead of by key, and their leads found by a combining minimum.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved
from .components import components

SHINGLE = 5
#: Buckets of keys at least, and documents per bucket when there are more.
BUCKETS = 256
BUCKET_DOCS = 4000
#: Documents of the sample that shows which keys are common, characters of each that are looked at, and the share that makes one common.
SAMPLE_DOCS, SAMPLE_CHARS, COMMON_SHARE = 2000, 20_000, 0.01
#: Keys packed together; bounds a worker's memory.
FLUSH_KEYS = 500_000
#: Distinct sets a worker remembers to spot repeats.
REMEMBERED = 200_000
#: Positions of a sketch per element at least, and of any sketch.
SKETCH_ROOM, LEAST_BITS = 2, 64
#: Elements of a team's documents that are compared together, those that a document counts as more, and documents of teams
#: that a slot holds, about.
BLOCK_ELEMENTS, DOC_ELEMENTS, SLOT_DOCS = 2_000_000, 500, 2000
#: Pairs that are compared in the time a row takes.
ROW_PAIRS = 200
#: Bits of the filter that says whose sets are needed.
FILTER_BITS = 1 << 24
KEY_BYTES, SET_BYTES = 5, 6

_U = np.uint64
_ODD = _U(0x9E3779B97F4A7C15)


def scrambled(values: np.ndarray) -> np.ndarray:
    """Hashes of 64-bit integers."""
    values = (values ^ (values >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> _U(27))) * _U(0x94D049BB133111EB)
    return values ^ (values >> _U(31))


def shingles(text: str | None) -> np.ndarray:
    """Sorted hashes of a text's distinct shingles; fewer words than a shingle has make one, no word none."""
    found = (text or "").encode().lower().split()  # on bytes: A-Z and the six separators alone
    if not found:
        return np.empty(0, np.uint64)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found))
    size = min(SHINGLE, len(found))
    total = np.full(len(found) - size + 1, size, np.uint64)
    for place in range(size):
        total = total * _ODD + hashes[place : len(found) - size + 1 + place]
        total ^= total >> _U(29)
    return np.unique(scrambled(total))


def most_different(smaller: int, larger: int) -> int:
    """Elements that two linked sets of these sizes differ in at most."""
    return (smaller + larger) // 9


def class_starts(size: int) -> list[int]:
    """First sizes of the classes up to and beyond a size."""
    starts = [1]
    while starts[-1] <= size:
        starts.append(max(starts[-1] + 1, -(-starts[-1] * 5 // 4)))
    return starts


def bands_of(start: int, end: int) -> int:
    """Bands for pairs whose smaller set has a size from start to before end."""
    least = most_different(end - 1, (end - 1) * 5 // 4) + 1
    return least + -(-least // 4) + 2


def band_keys(elements: np.ndarray, number: int, bands: int, first: int) -> np.ndarray:
    """The first keys of a set in one class of pairs: fullest bands first, then by hash."""
    band = ((elements >> _U(32)) * _U(bands)) >> _U(32)  # nondecreasing, as the elements are
    begins = np.flatnonzero(np.concatenate(([True], band[1:] != band[:-1])))
    counts = np.diff(np.append(begins, len(band))).astype(np.uint64)
    folded = np.bitwise_xor.reduceat(elements, begins)
    names = band[begins]
    if len(begins) < first:  # too few filled bands: empty ones follow
        empty = np.setdiff1d(np.arange(bands, dtype=np.uint64), names)
        names = np.concatenate((names, empty))
        counts = np.concatenate((counts, np.zeros(len(empty), np.uint64)))
        folded = np.concatenate((folded, np.zeros(len(empty), np.uint64)))
    keys = scrambled(folded ^ scrambled(names * _ODD + counts + _U(number << 40)))
    if len(keys) > first:
        keys = keys[np.lexsort((keys, -counts.astype(np.int64)))[:first]]
    return keys


def keys_of(elements: np.ndarray) -> np.ndarray:
    """All keys a set sends."""
    size = len(elements)
    starts = class_starts(size)
    own = len(starts) - 2
    keys = [band_keys(elements, own, bands_of(starts[own], starts[own + 1]), most_different(size, size * 5 // 4) + 1)]
    if own and size <= (starts[own] - 1) * 5 // 4:
        below = most_different(starts[own] - 1, size) + 1
        keys.append(band_keys(elements, own - 1, bands_of(starts[own - 1], starts[own]), below))
    return np.concatenate(keys)


def sketch(elements: np.ndarray) -> bytes:
    """Parity of the elements over positions, a power of two of them that follows the size of the set.

    Positions come from the part of a hash that whole sets are compared by.
    """
    bits = max(LEAST_BITS, 1 << (SKETCH_ROOM * len(elements) - 1).bit_length())
    places = (elements >> _U(64 - 8 * SET_BYTES)) & _U(bits - 1)
    return np.packbits(np.bincount(places.astype(np.int64), minlength=bits) & 1).tobytes()


def folded(marks: np.ndarray, size: int) -> np.ndarray:
    """Sketches (rows of bytes) as they are over fewer positions."""
    while marks.shape[1] > size:
        half = marks.shape[1] // 2
        marks = marks[:, :half] ^ marks[:, half:]
    return marks


def sketch_distance(one: bytes, other: bytes) -> int:
    size = min(len(one), len(other))
    one, other = (folded(np.frombuffer(mark, np.uint8)[None], size) for mark in (one, other))
    return int(np.bitwise_count(one ^ other).sum())


def _packed(doc_ids: np.ndarray, keys: np.ndarray) -> bytes:
    planes = doc_ids.astype("<i8").view(np.uint8).reshape(-1, 8).T
    return planes.tobytes() + keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, 8 - KEY_BYTES :].tobytes()


def _unpacked(payload: bytes) -> tuple[np.ndarray, np.ndarray]:
    size = len(payload) // (8 + KEY_BYTES)
    planes = np.frombuffer(payload, np.uint8, 8 * size).reshape(8, size)
    keys = np.zeros((size, 8), np.uint8)
    keys[:, 8 - KEY_BYTES :] = np.frombuffer(payload, np.uint8, offset=8 * size).reshape(size, KEY_BYTES)
    return np.ascontiguousarray(planes.T).view("<i8").ravel(), keys.view("<u8").ravel()


SENT = "bucket long, doc_id long, n long, same_as long, sketch binary, payload binary"
#: kind 0: a document, its set's size, the document of the same set that sent keys for it and otherwise the sketch; kind 1: a
#: key, a document that has it, the smallest one that has it and how many have it; kind 2: a common key and a document that has it.
FOUND = "kind int, a long, b long, c long, d long, sketch binary"


def _send(buckets: int, common: np.ndarray):
    def flushed(ids: list[np.ndarray], keys: list[np.ndarray]) -> pd.DataFrame:
        doc_ids, all_keys = np.concatenate(ids), np.concatenate(keys)
        place = (all_keys % _U(buckets)).astype(np.int64)
        spread = (scrambled(doc_ids.view(_U)) % _U(buckets)).astype(np.int64) + buckets
        place = np.where(np.isin(all_keys, common), spread, place)
        order = np.argsort(place, kind="stable")
        place, doc_ids, all_keys = place[order], doc_ids[order], all_keys[order]
        begins = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
        ends = np.append(begins[1:], len(place))
        payloads = [_packed(doc_ids[begin:end], all_keys[begin:end]) for begin, end in zip(begins, ends)]
        nothing = pd.array([None] * len(payloads), "Int64")
        return pd.DataFrame({"bucket": place[begins], "doc_id": nothing, "n": nothing, "same_as": nothing, "sketch": None, "payload": payloads})

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[bytes, int] = {}
        ids: list[np.ndarray] = []
        keys: list[np.ndarray] = []
        held = 0
        for rows in frames:
            out = []
            for doc_id, text in zip(rows["doc_id"].astype("Int64"), rows["text"]):
                elements = shingles(text)
                named = doc_id is not pd.NA
                bucket = xxhash.xxh3_64_intdigest(str(doc_id)) % buckets
                if not named or not len(elements):
                    out.append((bucket, doc_id, len(elements), pd.NA, None, None))
                    continue
                doc_id, mark = int(doc_id), xxhash.xxh3_128_digest(elements.tobytes())
                same_as = seen.get(mark)
                if same_as is not None:
                    out.append((bucket, doc_id, len(elements), pd.NA if same_as == doc_id else same_as, None, None))
                    continue
                out.append((bucket, doc_id, len(elements), pd.NA, sketch(elements), None))
                if len(seen) >= REMEMBERED:
                    seen.clear()
                seen[mark] = doc_id
                own = keys_of(elements)
                ids.append(np.full(len(own), doc_id, np.int64))
                keys.append(own)
                held += len(own)
                if held >= FLUSH_KEYS:
                    yield flushed(ids, keys)
                    ids, keys, held = [], [], 0
            made = pd.DataFrame(out, columns=["bucket", "doc_id", "n", "same_as", "sketch", "payload"])
            yield made.astype({"doc_id": "Int64", "same_as": "Int64"})
        if held:
            yield flushed(ids, keys)

    return run


def _meet(buckets: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        documents = rows["payload"].isna()
        bucket = int(rows["bucket"].iloc[0])
        out = [rows.loc[documents, ["doc_id", "n", "same_as", "sketch"]].set_axis(["a", "b", "c", "sketch"], axis=1).assign(kind=0, d=pd.NA)]
        parts = [_unpacked(payload) for payload in rows.loc[~documents, "payload"]]
        if parts and bucket >= buckets:
            # the low bytes of a key are zero: all ones there tell common keys from others
            number = np.concatenate([keys for _, keys in parts]).view(np.int64) ^ ((1 << (64 - 8 * KEY_BYTES)) - 1)
            doc_ids = np.concatenate([ids for ids, _ in parts])
            out.append(pd.DataFrame({"a": number, "b": doc_ids, "c": pd.NA, "d": pd.NA, "sketch": None, "kind": 2}))
        elif parts:
            doc_ids, keys = (np.concatenate(side) for side in zip(*parts))
            order = np.lexsort((doc_ids, keys))
            doc_ids, keys = doc_ids[order], keys[order]
            fresh = np.concatenate(([True], (keys[1:] != keys[:-1]) | (doc_ids[1:] != doc_ids[:-1])))
            doc_ids, keys = doc_ids[fresh], keys[fresh]
            begins = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
            sizes = np.diff(np.append(begins, len(keys)))
            leads, sizes = np.repeat(doc_ids[begins], sizes), np.repeat(sizes, sizes)
            several = sizes > 1
            number = keys[several].view(np.int64) ^ bucket
            shared = {"a": number, "b": doc_ids[several], "c": leads[several], "d": sizes[several]}
            out.append(pd.DataFrame(shared | {"sketch": None, "kind": 1}))
        made = pd.concat([one.astype(dict.fromkeys("abcd", "Int64") | {"sketch": object}) for one in out])
        return made[["kind", "a", "b", "c", "d", "sketch"]]

    return run


def _sampled_keys(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for rows in frames:
        found = [np.unique(keys_of(elements)) for elements in map(shingles, rows["text"]) if len(elements)]
        yield pd.DataFrame({"key": np.concatenate([*found, np.empty(0, np.uint64)]).view(np.int64)})


def common_keys(rows: DataFrame, size: int) -> np.ndarray:
    """Keys that a share of a bounded sample of documents has; they say where keys meet, not which."""
    sample = rows.select("doc_id", F.substring("text", 1, SAMPLE_CHARS).alias("text"))
    if size > SAMPLE_DOCS:
        sample = sample.where(F.pmod(F.xxhash64("doc_id"), F.lit(size)) < SAMPLE_DOCS)
    keys = sample.select("text").mapInPandas(_sampled_keys, "key long").groupBy("key").agg(F.count(F.lit(1)).alias("docs"))
    found = keys.where(F.col("docs") >= SAMPLE_DOCS * COMMON_SHARE).select("key").collect()
    return np.sort(np.array([row["key"] for row in found], np.int64)).view(np.uint64)


def teams(shared: DataFrame) -> DataFrame:
    """Rows (team, doc_id) of rows (key, doc_id, lead, size): documents that share a key have a team in common.

    A team is what a document leads, or one of its keys where these have so few documents in common that fewer pairs
    are worth more rows. Teams whose hashes are equal are one.
    """
    led = shared.groupBy("lead", "doc_id").agg(F.count(F.lit(1)).alias("keys"), F.sum("size").alias("pairs"))
    led = saved(led, "parity-led")
    leads = led.groupBy("lead").agg(F.count(F.lit(1)).cast("double").alias("docs"), F.sum("keys").alias("keys"), F.sum("pairs").alias("pairs"))
    wide = leads.where(F.col("docs") * F.col("docs") + ROW_PAIRS * F.col("docs") > F.col("pairs") + ROW_PAIRS * F.col("keys"))
    wide = saved(wide.select("lead"), "parity-wide")
    whole = led.join(wide, "lead", "left_anti").select(F.xxhash64("lead").alias("team"), "doc_id")
    apart = shared.join(wide, "lead", "left_semi").select(F.xxhash64("lead", "key").alias("team"), "doc_id")
    return saved(whole.union(apart.distinct()), "parity-teams")


def _dealt(members: DataFrame, documents: DataFrame) -> DataFrame:
    """Rows (slot, team, low, high, own, doc_id, n, payload) of members (team, doc_id) and documents (doc_id, n, payload).

    A team with more elements than a block is compared block by block, so that no task holds a whole team of unbounded size.
    """
    sizes = members.join(documents.select("doc_id", "n"), "doc_id")
    sizes = sizes.groupBy("team").agg(F.sum(F.col("n") + DOC_ELEMENTS).alias("elements"))
    large = sizes.where(F.col("elements") > BLOCK_ELEMENTS).select("team", F.ceil(F.col("elements") / BLOCK_ELEMENTS).cast("int").alias("blocks"))
    rows = members.join(large, "team", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("doc_id"), "blocks").cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.withColumn("low", F.least("own", "other")).withColumn("high", F.greatest("own", "other"))
    slots = F.lit(max(BUCKETS, members.count() // SLOT_DOCS))
    rows = rows.withColumn("slot", F.pmod(F.xxhash64("team", "low", "high"), slots)).join(documents, "doc_id")
    # as many tasks as a shuffle has: few bytes may be much work
    tasks = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.select("slot", "team", "low", "high", "own", "doc_id", "n", "payload").repartition(tasks, "slot")


def _blocks(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
    """Parts of a slot that are compared, each by size."""
    rows = rows.sort_values(["team", "low", "high", "n", "doc_id"], ignore_index=True)
    group = rows[["team", "low", "high"]].to_numpy()
    begins = np.flatnonzero(np.concatenate(([True], (group[1:] != group[:-1]).any(axis=1))))
    for begin, end in zip(begins, np.append(begins[1:], len(rows))):
        if end - begin > 1:
            yield rows.iloc[begin:end]


def _open(block: pd.DataFrame, marks: list[bytes]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Places of a block, the places after each that sizes and sketches leave open, and the distances of the sketches."""
    ids, sizes, own = (block[name].to_numpy() for name in ("doc_id", "n", "own"))
    mixed = block["low"].iloc[0] != block["high"].iloc[0]
    stops = np.searchsorted(sizes, sizes * 5 // 4, "right")  # larger sets than 1.25 times differ too much
    widths = np.fromiter(map(len, marks), np.int64, len(marks))
    for width in np.unique(widths):
        # sketches grow with the sets, those of the sets up to 1.25 times are twice as wide at most
        begin, last, end = (np.searchsorted(widths, value, side) for value, side in ((width, "left"), (width, "right"), (2 * width, "right")))
        same, wider = (np.frombuffer(b"".join(part), np.uint8) for part in (marks[begin:last], marks[last:end]))
        table = np.concatenate((same.reshape(-1, width), folded(wider.reshape(-1, 2 * width), width))).view(np.uint64)
        for place in range(begin, last):
            after = slice(place + 1, stops[place])
            if after.start >= after.stop:
                continue
            distances = np.bitwise_count(table[place - begin] ^ table[place + 1 - begin : after.stop - begin]).sum(axis=1, dtype=np.int64)
            near = (distances <= (sizes[place] + sizes[after]) // 9) & (ids[after] != ids[place])
            if mixed:  # pairs inside a block have met there
                near &= own[after] != own[place]
            if near.any():
                found = np.flatnonzero(near)
                yield place, place + 1 + found, distances[found]


def _kept(rows: pd.DataFrame) -> pd.DataFrame:
    """Documents of a slot's teams that sizes and sketches leave open with another one."""
    out = [rows.iloc[:0]]
    for block in _blocks(rows):
        kept = np.zeros(len(block), bool)
        for place, others, _ in _open(block, block["payload"].tolist()):
            kept[place] = kept[others] = True
        out.append(block[kept])
    return pd.concat(out)[["team", "doc_id"]].drop_duplicates()


def candidates(members: DataFrame, marks: DataFrame) -> DataFrame:
    """The members (team, doc_id) that may be linked with others of their team, by sketches (doc_id, n, payload)."""
    return _dealt(members, marks).groupBy("slot").applyInPandas(_kept, "team long, doc_id long").distinct()


def filter_of(ids: DataFrame) -> np.ndarray:
    """Bytes of a filter of documents (doc_id); its size is bounded, so that it may hold others too."""
    place = _place("doc_id")
    found = ids.groupBy(F.bitmap_bucket_number(place).alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits"))
    parts = np.zeros((FILTER_BITS >> 15, 1 << 12), np.uint8)
    for row in found.collect():
        parts[row["part"] - 1] = np.frombuffer(row["bits"], np.uint8)
    return parts.ravel()


def _place(column: str) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(FILTER_BITS)) + 1


def _sets(held: np.ndarray):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in frames:
            place = rows["place"].to_numpy() - 1
            rows = rows[(held[place >> 3] >> (place & 7) & 1).astype(bool)]
            found = [shingles(text) for text in rows["text"]]
            packed = [one.astype("<u8").view(np.uint8).reshape(-1, 8)[:, 8 - SET_BYTES :].tobytes() for one in found]
            yield pd.DataFrame({"doc_id": rows["doc_id"], "n": [len(one) for one in found], "payload": packed})

    return run


def sets_of(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """The sets (doc_id, n, payload) of the texts of some documents, and of few others."""
    named = rows.where("doc_id IS NOT NULL").withColumn("place", _place("doc_id"))
    return named.mapInPandas(_sets(filter_of(ids)), "doc_id long, n long, payload binary")


def _elements(packed: bytes) -> np.ndarray:
    size = len(packed) // SET_BYTES
    wide = np.zeros((size, 8), np.uint8)
    wide[:, 8 - SET_BYTES :] = np.frombuffer(packed, np.uint8).reshape(size, SET_BYTES)
    return wide.view("<u8").ravel()


def linked(left: np.ndarray, right: np.ndarray) -> bool:
    """Whether whole sets are similar enough."""
    common = len(left) + len(right) - len(np.union1d(left, right))
    return 100 * common >= 80 * (len(left) + len(right) - common)


def _links(rows: pd.DataFrame) -> pd.DataFrame:
    """Links of a slot that connect what is linked inside a block, nearest sketches first."""
    found: list[tuple[int, int]] = []
    for block in _blocks(rows):
        ids = block["doc_id"].to_numpy()
        sets = [_elements(packed) for packed in block["payload"]]
        roots = np.unique(ids, return_inverse=True)[1]
        for place, others, distances in _open(block, [sketch(one) for one in sets]):
            others = others[np.argsort(distances, kind="stable")]
            while len(others := others[roots[others] != roots[place]]):
                other, others = others[0], others[1:]
                if linked(sets[place], sets[other]):
                    found.append((min(ids[place], ids[other]), max(ids[place], ids[other])))
                    roots[roots == roots[other]] = roots[place]
    return pd.DataFrame(found, columns=["a", "b"], dtype="int64")


def verified(members: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) that connect all members (team, doc_id) of a team whose sets (doc_id, n, payload) are linked."""
    return _dealt(members, sets).groupBy("slot").applyInPandas(_links, "a long, b long")


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per row of the table: doc_id, n_shingles, component_id.

    The component is the smallest id reachable by links, the document's own included. A text without words has no
    shingle and no link; a null text counts as such. Texts are used whole, however long. Rows that share an id are one document with several texts. A row
    without an id is linked with nothing and has no component. An empty table gives an empty one. Other columns are not
    read.
    """
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    size = rows.count()
    buckets = max(BUCKETS, size // BUCKET_DOCS)
    sent = rows.mapInPandas(_send(buckets, common_keys(rows, size)), SENT)
    found = saved(sent.groupBy("bucket").applyInPandas(_meet(buckets), FOUND), "parity-found")
    members = found.where("kind = 0").select(F.col("a").alias("doc_id"), F.col("b").alias("n"), F.col("c").alias("same_as"), F.col("sketch").alias("payload"))
    shared = found.where("kind = 1").select(F.col("a").alias("key"), F.col("b").alias("doc_id"), F.col("c").alias("lead"), F.col("d").alias("size"))
    common = found.where("kind = 2").select(F.col("a").alias("key"), F.col("b").alias("doc_id"))
    leads = saved(common.groupBy("key").agg(F.min("doc_id").alias("lead"), F.count(F.lit(1)).alias("size")), "parity-common")
    shared = shared.union(common.join(leads, "key").distinct())

    marks = members.where("payload IS NOT NULL").select("doc_id", "n", "payload")
    near = saved(candidates(teams(shared), marks), "parity-near")
    sets = saved(sets_of(rows, near.select("doc_id")), "parity-sets")
    links = saved(verified(near, sets), "parity-links")

    twins = members.where("same_as IS NOT NULL").select("doc_id", "same_as")
    links = links.union(twins)
    joined = components(links)
    out = members.join(joined, members["doc_id"] == joined["node"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def one_per_component(docs: DataFrame) -> DataFrame:
    """The rows that stay when one of each component does, the longest, then the one with the smallest id.

    Columns as they were; rows without an id stay. Rows are linked by their texts alone: each gets an id of its own, which
    is written so that it stays the same, and rows that share a doc_id are told apart.
    """
    rows = saved(docs.where("doc_id IS NOT NULL").withColumn("__row", F.monotonically_increasing_id()), "parity-rows")
    near = near_duplicates(rows, "__row").select(F.col("doc_id").alias("__near_row"), F.col("component_id").alias("__near_group"))
    sizes = rows.select("__row", F.col("doc_id").cast("long").alias("id"), F.coalesce(F.length("text"), F.lit(0)).alias("chars"))
    sizes = sizes.join(near, F.col("__row") == F.col("__near_row"))
    best = F.max(F.struct("chars", (-F.col("id")).alias("minus"), (-F.col("__row")).alias("row")))
    keep = sizes.groupBy("__near_group").agg(best.alias("best")).select((-F.col("best.row")).alias("__row"))
    return rows.join(keep, "__row", "left_semi").select(*docs.columns).unionByName(docs.where("doc_id IS NULL"))
