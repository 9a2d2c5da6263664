"""Document fingerprints that feel the order of a text: order MinHash.

A text is the sequence of its k-mers of code points.  A k-mer's n-th occurrence is an element of its own, so repeats
count.  Each of ``SIZE`` random orders of the elements picks its ``TUPLE`` first ones, puts their k-mers back into text
order and hashes that tuple: one component.  All orders come from one Poisson process per element, whose points fall
into the components: the first elements of all of them lie before a time that falls with the length of the text, so most
elements cost one hash instead of one per order (too early a time is doubled; the result does not depend on it).  Two texts agree in a component when they share the picked
elements *and* their order; the share of equal components falls with the edit distance, also for edits that only
move text.  A text shorter than a k-mer is one k-mer; the empty text has components of its own.

``edited_fingerprints`` needs each document's neighbour in the order of ids.  That order is made in ranges: a pass over
(id, hash of the text) cuts it into parts of about ``PART_BYTES`` and finds the first row of each; the texts are then
shuffled once, by part.  The first row of a part is sent to the part before it as well, as a guest, so that every row
meets its successor inside one sorted stream; a task holds about ``CHUNK`` code points at a time.  Equal rows of a batch travel once:
all but one of them have an equal row as successor, and those are told by their number and spread over all parts.

Defined results: a null text is empty; a null id comes before all others; rows of one id follow each other by a hash of
their text (then by the text), so a repeated row's successor is its repetition; the only row of a table is its own
successor; an empty table gives an empty table.  Only the named columns are read.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ardoise.llm.common import release, texts, to_spark
from ardoise.llm.textdedup import ODD, POWERS, U, mix
from ardoise.sources.workdir import materialise

#: Code points of a k-mer, elements of a tuple, components of a fingerprint.
KMER, TUPLE, SIZE = 8, 2, 64
#: Bytes of text of a part of the order of ids, about; and parts at most, since their bounds travel with the tasks.
PART_BYTES, PARTS = 4 << 20, 16_384
#: Keys that are sampled for a bound between parts.
PER_PART = 16
#: Code points that are hashed together, about; a longer text is hashed alone.
CHUNK = 1 << 16
#: Points of an element that are made at once.
EVERY = 4
#: Points of a component that are looked for at first, on average.
POINTS = 9.0


def elements(many: list[str], kmer: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k-mers of some texts: text number, the k-mer, the hash of its numbered occurrence; in order."""
    lengths = np.fromiter(map(len, many), np.int64, len(many))
    points = np.frombuffer("".join(many).encode("utf-32-le"), np.uint32)
    n = len(points)
    width = np.minimum(lengths, kmer)
    count = np.where(lengths > 0, lengths - width + 1, 0)
    text = np.repeat(np.arange(len(many)), count)
    start = np.cumsum(lengths) - lengths
    at = start[text] + np.arange(len(text)) - (np.cumsum(count) - count)[text]
    up, down = POWERS.of(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((points.astype(np.uint64) + U(1)) * up[:-1], out=sums[1:])
    wide = width[text]
    kmers = (sums[at + wide] - sums[at]) * down[at] + wide.astype(np.uint64)
    key = (kmers + text.astype(np.uint64) * U(0xD1342543DE82EF95)) * ODD
    # Equal k-mers beside each other, by place: the low bits of the key give way to the place.
    place = np.arange(len(kmers))
    bits = U(len(kmers).bit_length())
    packed = np.sort((key >> bits << bits) | place.astype(np.uint64))
    order = (packed & ((U(1) << bits) - U(1))).astype(np.int64)
    same = (packed[1:] ^ packed[:-1]) >> bits == 0
    if (key[order[1:][same]] != key[order[:-1][same]]).any():
        order = np.argsort(key, kind="stable")
        same = key[order[1:]] == key[order[:-1]]
    first = np.concatenate([[0], np.where(same, 0, place[1:])])
    number = np.empty(len(kmers), np.uint64)
    number[order] = place - np.maximum.accumulate(first[: len(kmers)])
    return text, kmers, mix(kmers + number * ODD)


def _points(hashes: np.ndarray, text: np.ndarray, until: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(component, time, element) of all points up to each element's time.

    An element's points are a Poisson process that its hash seeds; each falls into one of the components.  Split by
    component these are independent processes, so the elements' first times order them anew in every component.
    """
    # Most elements have no point at all: their first random number, compared with a bound, tells.
    bound = (np.exp(until * -size - 1e-9) * 2.0**53).astype(np.uint64) << U(11)
    at = np.flatnonzero(hashes >= bound[text])
    time, step = np.zeros(len(at)), 0
    out = []
    while len(at):
        random = mix(hashes[at][:, None] + np.arange(step, step + EVERY, dtype=np.uint64) * ODD)
        if step == 0:
            random[:, 0] = hashes[at]
        gaps = np.log(((random >> U(11)).astype(np.float64) + 0.5) * 2.0**-53) * (-1.0 / size)
        gaps[:, 0] += time
        times = np.cumsum(gaps, 1)
        inside = times <= until[text[at]][:, None]
        which, column = np.nonzero(inside)
        component = (random[which, column] & U(0x7FF)).astype(np.int64) % size
        out.append((component, times[which, column], at[which]))
        go_on = inside[:, -1]
        at, time, step = at[go_on], times[go_on, -1], step + EVERY
    return tuple(np.concatenate(c) for c in zip(*out))


def picked(text: np.ndarray, hashes: np.ndarray, texts_: int, take: int, size: int) -> np.ndarray:
    """(text, component, take): the places of each component's first elements, in text order; -1 where a text has
    fewer elements."""
    result = np.full((texts_, size, take), -1, np.int64)
    count = np.bincount(text, minlength=texts_)
    until = POINTS / np.maximum(count, 1)
    todo = np.flatnonzero(count)
    now = np.arange(len(hashes))
    bits = 62 - (texts_ * size).bit_length()
    while len(todo):
        component, time, element = _points(hashes[now], text[now], until, size)
        element = now[element]
        cell = text[element] * size + component
        # By cell, then by time as a whole number.
        scaled = (time * (2.0**bits / until[text[element]])).astype(np.int64)
        element = element[np.argsort((cell << (bits + 1)) + scaled)]
        end = np.cumsum(np.bincount(cell, minlength=texts_ * size))
        at = np.concatenate([[0], end[:-1]])
        picks = np.full((texts_ * size, take), -1, np.int64)
        for k in range(take):
            # An element's first point in a cell counts.
            while True:
                left = at < end
                picks[:, k] = np.where(left, element[np.minimum(at, len(element) - 1)], -1)
                again = left & (picks[:, :k] == picks[:, k : k + 1]).any(1)
                if not again.any():
                    break
                at += again
            at += left
        picks = picks.reshape(texts_, size, take)
        found = (picks >= 0).sum(2).min(1) >= np.minimum(take, count)
        done = todo[found[todo]]
        result[done] = picks[done]
        todo = todo[~found[todo]]
        until[todo] *= 2
        now = now[~found[text[now]]]
    result.sort(2)
    return result


def fingerprints(many: list[str], kmer: int = KMER, take: int = TUPLE, size: int = SIZE) -> np.ndarray:
    """One row per text: a number below 2**16 per component; ``size`` is a power of two up to 2048."""
    if size & (size - 1) or not 0 < size <= 2048:
        raise ValueError("size must be a power of two up to 2048")
    text, kmers, hashes = elements(many, kmer)
    places = picked(text, hashes, len(many), take, size)
    kmers = np.append(kmers, U(7))
    total = np.zeros((len(many), size), np.uint64)
    for k in range(take):
        total = mix(total * U(0xD1342543DE82EF95) + kmers[places[:, :, k]] + U(1))
    return (total >> U(48)).astype(">u2")


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float(np.mean(a == b))


def edited(text: str, following: str) -> str:
    """The last quarter gives way to as much of the beginning of another text."""
    quarter = len(text) // 4
    return text[: len(text) - quarter] + following[:quarter]


PRINTS = pa.schema(
    [("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
     ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())]
)
TIMED = PRINTS.append(pa.field("times", pa.int64()))


Pair = tuple[int | None, str, str, int]


def _rows(pairs: list[Pair], kmer: int, take: int) -> pa.RecordBatch:
    """Result rows of (id, text, next text, times)."""
    texts_ = [edited(own, following) for _, own, following, _ in pairs]
    place: dict[str, int] = {}
    for _, own, following, _ in pairs:
        place.setdefault(own, len(place))
        place.setdefault(following, len(place))
    for t in texts_:
        place.setdefault(t, len(place))
    prints = fingerprints(list(place), kmer, take)
    digits = [p.tobytes().hex() for p in prints]
    rows = []
    for (doc_id, own, following, times), t in zip(pairs, texts_):
        a, b, c = place[own], place[t], place[following]
        row = (doc_id, len(own), hashlib.sha256(t.encode()).hexdigest(), digits[a], digits[b],
               likeness(prints[a], prints[b]), likeness(prints[a], prints[c]), times)
        rows.append(row)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), TIMED)], schema=TIMED)


KEYS = pa.schema([("id", pa.int64()), ("h", pa.int64()), ("size", pa.int64())])
DEALT = pa.schema([("part", pa.int32()), ("kind", pa.int32()), ("id", pa.int64()), ("h", pa.int64()), ("text", pa.string()), ("times", pa.int64())])
OWN, GUEST, COPIES = 0, 1, 2

Key = tuple[int, int]


def _key(doc_id: int | None, text: bytes) -> Key:
    """Place in the order; a missing id comes first."""
    return (-(1 << 63) - 1 if doc_id is None else doc_id), xxhash.xxh3_64_intdigest(text) - (1 << 63)


def _text_bytes(batch: pa.RecordBatch) -> list[bytes]:
    return [t.as_buffer().to_pybytes() for t in batch["text"]]


def _keys(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in it:
        many = _text_bytes(batch)
        ids = batch["id"].to_pylist()
        columns = [ids, [_key(i, t)[1] for i, t in zip(ids, many)], [len(t) for t in many]]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=KEYS)


def _deal(bounds: list[Key], guests: dict[Key, int]):
    """Rows with their part of the order; ``guests`` names the part before the one that begins with a key."""
    parts = len(bounds) + 1

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, batch in enumerate(it):
            times: dict[tuple, int] = {}
            for doc_id, text in zip(batch["id"].to_pylist(), _text_bytes(batch)):
                times[doc_id, text] = times.get((doc_id, text), 0) + 1
            rows = []
            for (doc_id, text), n in times.items():
                key = _key(doc_id, text)
                rows.append((bisect_right(bounds, key), OWN, doc_id, key[1], text, 1))
                if n > 1:
                    rows.append(((key[1] + number * 7919) % parts, COPIES, doc_id, key[1], text, n - 1))
                if key in guests:
                    rows.append((guests[key], GUEST, doc_id, key[1], text, 1))
            columns = [pa.array(c, pa.binary() if f.name == "text" else f.type) for c, f in zip(zip(*rows), DEALT)]
            columns[4] = columns[4].cast(pa.string())
            yield pa.RecordBatch.from_arrays(columns, schema=DEALT)
        release()

    return run


def _pairs(it: Iterator[pa.RecordBatch]) -> Iterator[Pair]:
    """Sorted parts: each row with its successor's text."""
    waiting: tuple[int | None, str] | None = None
    for batch in it:
        columns = [batch[c].to_pylist() for c in ("kind", "id", "times")]
        for kind, doc_id, times, text in zip(*columns, batch["text"]):
            text = text.as_py()
            if kind == COPIES:
                yield doc_id, text, text, times
                continue
            if waiting is not None:
                yield *waiting, text, 1
            waiting = (doc_id, text) if kind == OWN else None


def _meet(kmer: int, take: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for pair in _pairs(it):
            held.append(pair)
            size += len(pair[1])
            if size >= CHUNK:
                yield _rows(held, kmer, take)
                held, size = [], 0
        if held:
            yield _rows(held, kmer, take)
        release()

    return run


def edited_fingerprints(
    documents: DataFrame, key: str = "doc_id", text: str = "text", kmer: int = KMER, take: int = TUPLE, part_bytes: int = PART_BYTES
) -> DataFrame:
    """Per document: its length, digest of its edited form, both fingerprints, and how alike its own is to that of the
    edited form and to that of the next document."""
    rows = texts(documents, key, text)
    rows = rows.withColumn("id", F.col("id").cast("long"))
    keys = materialise(rows.mapInArrow(_keys, to_spark(KEYS)), "keys")
    n, size = keys.agg(F.count(F.lit(1)), F.sum("size")).first()
    parts = min(PARTS, (size or 0) // part_bytes + 1)
    bounds: list[Key] = []
    if parts > 1:
        some = keys.select("id", "h").sample(fraction=min(1.0, parts * PER_PART / n), seed=1).collect()
        some = sorted((-(1 << 63) - 1 if r.id is None else r.id, r.h) for r in some)
        bounds = sorted({some[len(some) * k // parts] for k in range(1, parts)}) if some else []

    def parted(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The first key of each part that a batch has rows of."""
        schema = pa.schema([("part", pa.int32()), ("id", pa.int64()), ("h", pa.int64())])
        for batch in it:
            low: dict[int, Key] = {}
            for i, h in zip(batch["id"].to_pylist(), batch["h"].to_pylist()):
                k = (-(1 << 63) - 1 if i is None else i), h
                p = bisect_right(bounds, k)
                low[p] = min(low.get(p, k), k)
            columns = [list(low), [i if i >= -(1 << 63) else None for i, _ in low.values()], [h for _, h in low.values()]]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    heads = keys.select("id", "h").mapInArrow(parted, "part int, id bigint, h bigint")
    # A missing id is the smallest of a struct as well.  One row per part.
    heads = heads.groupBy("part").agg(F.min(F.struct("id", "h")).alias("k")).orderBy("part").collect()
    used = [r.part for r in heads]
    first = [(-(1 << 63) - 1 if r.k.id is None else r.k.id, r.k.h) for r in heads]
    guests = {k: used[j - 1] for j, k in enumerate(first)}
    dealt = rows.mapInArrow(_deal(bounds, guests), to_spark(DEALT))
    dealt = dealt.repartition("part").sortWithinPartitions("part", "kind", "id", "h", "text")
    met = dealt.mapInArrow(_meet(kmer, take), to_spark(TIMED))
    # Most rows stand once; equal ones of a batch are told apart again here.
    return met.withColumn("times", F.explode(F.sequence(F.lit(1), F.col("times").cast("int")))).drop("times")
