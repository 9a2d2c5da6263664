"""Best-fit packing of tokenised documents by exact complements.

Documents are tokenised where they lie; only lengths and checksums leave that step, written once.  A plan is
made from the histogram of lengths, which has one count per possible length and so a fixed size: taking the
longest length, it looks for a single, a pair or a triple of other lengths that fills the gap exactly (sums
of one, two and three available lengths are indexed), uses that combination as often as the counts allow,
and where there is none puts the best-fitting length in and looks again.  Each step uses a length up, so the
plan is a bounded table of slots.  Every piece then finds its slot by its length and its rank among pieces of
that length; ranks come from hashed buckets, so a common length is spread over tasks.

Defined results: a null or empty text is the closing token alone.  Documents longer than a sequence are cut
into full pieces; the first piece takes the remainder.  Repeated rows are pieces of their own.  A null key
stays null.  Texts of any length are tokenised whole; only the named columns are read.
"""

from __future__ import annotations

import hashlib
import json
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ardoise.llm.common import texts, to_spark
from ardoise.sources.workdir import materialise

CAPACITY = 2048
#: Remembered words of a worker process; all are forgotten beyond it, to bound the memory.
REMEMBERED = 700_000
#: Pieces of a bucket of one length, about; the ranks of a bucket are numbered by one task.
BUCKET = 50_000

# Tokens

#: Where white space meets a space, words are not independent of each other.
JOINED_SPACE = re.compile(r"\s(?= )| (?=\s)")


class _Words(dict):
    """Ids of a word that follows a space, as bytes."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, word: str) -> bytes:
        out = self[word] = np.array(self.encode(" " + word), "<u4").tobytes()
        return out


class Tokens:
    """Ids of a byte-level BPE vocabulary, the same as the tokenizers library gives.

    Its pattern parts text before a single space between two words whatever else the text holds, so words are
    encoded once and remembered.  Texts with special tokens go to the library as they are.
    """

    def __init__(self, vocabulary: bytes):
        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(vocabulary.decode())
        spec = json.loads(vocabulary)
        self.special = [x["content"] for x in spec["added_tokens"]]
        # Byte-level vocabularies write the bytes without a printable sign as signs from 256 on.
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        sign = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(sorted({*range(256)} - {*plain}))}
        ranks = {bytes(sign[c] for c in k): v for k, v in spec["model"]["vocab"].items() if k not in self.special}
        merges = [x.split(" ") if isinstance(x, str) else x for x in spec["model"]["merges"]]
        in_order = [spec["model"]["vocab"]["".join(x)] for x in merges]
        byte_level = spec["normalizer"] is None and spec["pre_tokenizer"]["type"] == "ByteLevel" and not spec["pre_tokenizer"]["add_prefix_space"]
        if byte_level and in_order == sorted(in_order):
            import public_tokenizers

            fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
            self.encode = fast.encode_ordinary
        else:
            self.encode = None
        self.words = _Words(self.encode)

    def ids(self, text: str) -> bytes:
        """Ids of a text as little-endian 32-bit numbers."""
        if self.encode is None or any(x in text for x in self.special):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        if JOINED_SPACE.search(text):
            return np.array(self.encode(text), "<u4").tobytes()
        first, *rest = text.split(" ")
        if len(self.words) > REMEMBERED:
            self.words.clear()
        return np.array(self.encode(first), "<u4").tobytes() + b"".join(map(self.words.__getitem__, rest))


_TOKENS: dict[bytes, Tokens] = {}


def tokens(vocabulary: bytes) -> Tokens:
    """The vocabulary of this process."""
    key = hashlib.sha256(vocabulary).digest()
    if key not in _TOKENS:
        _TOKENS[key] = Tokens(vocabulary)
    return _TOKENS[key]


PIECES = pa.schema([("id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """Start and length of the pieces of a document of n tokens."""
    first = n % capacity or min(n, capacity)
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def document_pieces(df: DataFrame, vocabulary: bytes, capacity: int, key: str, text: str) -> DataFrame:
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokens(vocabulary)
        for batch in it:
            rows = []
            for key_, x in zip(batch["id"].to_pylist(), batch["text"]):
                ids = memoryview(t.ids(x.as_py()) + b"\0\0\0\0")
                for k, (s, n) in enumerate(cut(len(ids) // 4, capacity)):
                    rows.append((key_, k, s, n, zlib.crc32(ids[4 * s : 4 * (s + n)])))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(zip(*rows), PIECES)] if rows else [pa.array([], f.type) for f in PIECES], schema=PIECES
            )

    return texts(df, key, text).select(F.col("id").cast("long"), "text").mapInArrow(run, to_spark(PIECES))


# Plan


class _Index:
    """Available lengths and which sums two and three of them make, as bits of whole numbers."""

    def __init__(self, count: list[int]):
        self.count = count
        self.one = sum(1 << n for n, c in enumerate(count) if c)
        self.stale, self.two, self.three = True, 0, 0

    def take(self, pattern: Counter, times: int) -> None:
        for n, c in pattern.items():
            self.count[n] -= c * times
            if not self.count[n]:
                self.one &= ~(1 << n)
                self.stale = True

    def times(self, pattern: Counter) -> int:
        return min(self.count[n] // c for n, c in pattern.items())

    def below(self, limit: int) -> Iterator[int]:
        """Available lengths from ``limit`` down."""
        bits = self.one & ((2 << limit) - 1)
        while bits:
            n = bits.bit_length() - 1
            yield n
            bits ^= 1 << n

    def sums(self) -> None:
        if self.stale:
            lengths = list(self.below(len(self.count) - 1))
            mask = (1 << len(self.count)) - 1
            self.two = self.three = 0
            for n in lengths:
                self.two |= self.one << n & mask
            for n in lengths:
                self.three |= self.two << n & mask
            self.stale = False

    def filling(self, gap: int, base: Counter) -> Counter | None:
        """Base with the single, pair or triple that fills the gap exactly and is available; None without one."""
        if self.one >> gap & 1 and self.times(p := base + Counter([gap])):
            return p
        self.sums()
        if self.two >> gap & 1:
            for a in self.below(gap - 1):
                if 2 * a < gap:
                    break
                if self.one >> (gap - a) & 1 and self.times(p := base + Counter([a, gap - a])):
                    return p
        if self.three >> gap & 1:
            for a in self.below(gap - 2):
                if 3 * a < gap:
                    break
                if self.two >> (gap - a) & 1:
                    for b in self.below(min(a, gap - a - 1)):
                        if 2 * b < gap - a:
                            break
                        if self.one >> (gap - a - b) & 1 and self.times(p := base + Counter([a, b, gap - a - b])):
                            return p
        return None


def plan(count: list[int], capacity: int = CAPACITY) -> list[tuple[Counter, int]]:
    """Contents of sequences and how many there are of each.  ``count``: pieces of each length, by length."""
    index, out = _Index([*count, *[0] * (capacity + 1 - len(count))]), []
    while index.one:
        base = Counter([index.one.bit_length() - 1])
        gap = capacity - max(base)
        while gap:
            full = index.filling(gap, base)
            if full:
                base = full
                break
            fit = next((n for n in index.below(gap) if index.times(base + Counter([n]))), 0)
            if not fit:
                break
            base[fit] += 1
            gap -= fit
        times = index.times(base)
        index.take(base, times)
        out.append((base, times))
    return out


def slots(made: list[tuple[Counter, int]]) -> dict[str, np.ndarray]:
    """Where pieces go: a run of ranks of a length, the first sequence of the run, and the place in a sequence."""
    used: Counter = Counter()
    rows, sequence = [], 0
    for pattern, times in made:
        place = 0
        for n in sorted(pattern.elements(), reverse=True):
            rows.append((n, used[n], sequence, place))
            used[n] += times
            place += n
        sequence += times
    rows.sort()
    return {k: np.array([r[i] for r in rows], np.int64) for i, k in enumerate(("length", "rank", "sequence", "offset"))}


PACKED = pa.schema([*PIECES, ("sequence_id", pa.int64()), ("offset", pa.int64())])


def pack(df: DataFrame, vocabulary: bytes, capacity: int = CAPACITY, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece: ``key``, piece, start, length, ids_crc32, sequence_id and offset."""
    pieces = materialise(document_pieces(df, vocabulary, capacity, key, text), "pieces")
    count = [0] * (capacity + 1)
    for n, c in pieces.groupBy("length").count().collect():  # a row per length
        count[n] = c
    where = slots(plan(count, capacity))
    buckets = max(8, sum(count) // BUCKET)
    spread = pieces.withColumn("_bucket", F.pmod(F.xxhash64("id", "piece", "ids_crc32"), F.lit(buckets)))
    inside = Window.partitionBy("length", "_bucket").orderBy("id", "piece")
    before = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = spread.groupBy("length", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    offsets = offsets.select("length", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    ranked = spread.withColumn("_rank", F.row_number().over(inside) - 1).join(offsets, ["length", "_bucket"])
    ranked = ranked.select(*PIECES.names, (F.col("_rank") + F.col("_before")).alias("_rank"))
    names, keys = PIECES.names, where["length"] << 44 | where["rank"]

    def assign(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            rank = batch["_rank"].to_numpy(zero_copy_only=False)
            at = np.searchsorted(keys, batch["length"].to_numpy(zero_copy_only=False) << 44 | rank, "right") - 1
            new = [where["sequence"][at] + rank - where["rank"][at], where["offset"][at]]
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in names), *map(pa.array, new)], schema=PACKED)

    return ranked.mapInArrow(assign, to_spark(PACKED)).withColumnRenamed("id", key)
