"""Periodic runs of words: maximal pairs from the tree of common-prefix intervals.

A run of period q is a stretch whose words q apart are equal and that no neighbouring word extends.  It shows as a
maximal pair: the two places where the stretch without its last q words, and without its first q, begin.  They
share everything up to the stretch's end, differ in the word after it, and differ in the word on their left.
Conversely two places with different left words whose common prefix is exactly l words and whose distance d is
at most l are the ends of a stretch of l + d words with period d.  Nothing has to be extended.

Suffixes of a batch of texts are sorted by doubling; a word is told by its text and itself, so no prefix crosses
texts.  The intervals of common prefixes are closed bottom-up.  A node keeps its places in order, each with its
class, the word on its left.  When a child joins, the smaller list is looked up in the larger one: each of its places
pairs with the places of another class next before and after it.  That is enough for every run, because between two
places of a run's pair lies no other place of the node (a prefix of three periods occurs only at whole periods); and it
bounds the pairs by n log n, where pairs of whole class lists would be quadratic for a common phrase.  A stretch found
with several distances is one run with the smallest.

Only words that begin a prefix of ``shortest`` words that recurs in their text can be in a pair's prefix: all others
are left out of the sorting, with hashes as a filter that can only keep too many.

Defined results: a null text has no words; a null id leaves its text as it is and stands in the result; repeated rows
are texts of their own; an empty table gives an empty table.  Only the named columns are read.
"""

from __future__ import annotations

import hashlib
import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator
from itertools import compress, count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ardoise.llm.common import release, texts, to_spark

#: A run has at least this many words and this many periods.
LEAST, TIMES = 6, 4
#: Words that are sorted together, about; a longer text is sorted alone.
CHUNK = 400_000
#: Places that share a block of a sorted list.
SHIFT = 11

U = np.uint64
RUN = tuple[int, int, int]


class Places:
    """Places in order, in blocks, so that a new one moves only its block."""

    __slots__ = ("keys", "blocks", "size")

    def __init__(self, place: int):
        self.keys = [place >> SHIFT]
        self.blocks = {place >> SHIFT: [place]}
        self.size = 1

    def add(self, place: int) -> None:
        key = place >> SHIFT
        block = self.blocks.get(key)
        if block is None:
            insort(self.keys, key)
            self.blocks[key] = [place]
        else:
            insort(block, place)
        self.size += 1

    def beside(self, place: int) -> tuple[int, int]:
        """The next place before and after one that is not here; -1 where there is none."""
        key = place >> SHIFT
        block = self.blocks.get(key, ())
        at = bisect_left(block, place)
        before = block[at - 1] if at else -1
        after = block[at] if at < len(block) else -1
        # The only block may be another one than the place's.
        if (before < 0 or after < 0) and (len(self.keys) > 1 or self.keys[0] != key):
            k = bisect_left(self.keys, key)
            if before < 0 and k:
                before = self.blocks[self.keys[k - 1]][-1]
            k += k < len(self.keys) and self.keys[k] == key
            if after < 0 and k < len(self.keys):
                after = self.blocks[self.keys[k]][0]
        return before, after

    def __iter__(self) -> Iterator[int]:
        for key in self.keys:
            yield from self.blocks[key]


def suffixes(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of all suffixes and the words each shares with the one before it.

    Doubling; a level sorts only suffixes that others still equal.  The ranks of all levels measure the prefixes.
    """
    n = len(text)
    order = np.argsort(text, kind="stable")
    new = np.concatenate([[True], text[order[1:]] != text[order[:-1]]])
    slot = np.arange(n)

    def ranked(rank: np.ndarray, slots: np.ndarray, new: np.ndarray) -> np.ndarray:
        rank[order[slots]] = np.maximum.accumulate(np.where(new, slots, -1))
        return rank

    levels = [ranked(np.empty(n, np.int32), slot, new)]
    step = 1
    while True:
        lone = np.concatenate([new[1:], [True]]) & new
        slot, rank = slot[~lone], levels[-1]
        if not len(slot):
            break
        at = order[slot]
        second = np.where(at + step < n, rank[np.minimum(at + step, n - 1)], -1).astype(np.int64) + 1
        key = rank[at].astype(np.int64) * (n + 1) + second
        by = np.argsort(key, kind="stable")
        order[slot], key = at[by], key[by]
        new = np.concatenate([[True], key[1:] != key[:-1]])
        levels.append(ranked(rank.copy(), slot, new))
        step *= 2
    shared = np.zeros(n, np.int64)
    if n > 1:
        a, b = order[:-1].copy(), order[1:].copy()
        for k in range(len(levels) - 1, -1, -1):
            inside = (a < n) & (b < n)
            same = inside & (levels[k][np.minimum(a, n - 1)] == levels[k][np.minimum(b, n - 1)])
            add = np.where(same, 1 << k, 0)
            a, b = a + add, b + add
        shared[1:] = a - order[:-1]
    return order, shared


def shortest_prefix(least: int = LEAST, times: int = TIMES) -> int:
    """No pair of a run shares fewer words: at period q it shares the run's length less q."""
    return min(max(least - q, (times - 1) * q) for q in range(1, least + 1))


def _recurring(codes: np.ndarray, text: np.ndarray, width: int) -> np.ndarray:
    """Words to sort: those where a gram begins that recurs in its text, and ``width`` words more."""
    n = len(codes)
    keep = np.zeros(n, bool)
    if n < width:
        return keep
    size = n - width + 1
    gram = text[:size].astype(np.uint64) * U(0x9E3779B97F4A7C15)
    for k in range(width):
        gram = (gram ^ (gram >> U(29))) * U(0xBF58476D1CE4E5B9) + codes[k : k + size].astype(np.uint64)
    gram = (gram ^ (gram >> U(32))) * U(0x94D049BB133111EB)
    gram[text[:size] != text[width - 1 :]] = 0
    by = np.argsort(gram)
    same = gram[by[1:]] == gram[by[:-1]]
    keep[by[1:][same]] = keep[by[:-1][same]] = True
    keep[:size] &= text[:size] == text[width - 1 :]
    upto = np.cumsum(keep)
    near = upto.copy()
    near[width + 1 :] -= upto[: -width - 1]
    return near > 0


def maximal_runs(codes: np.ndarray, text: np.ndarray, least: int = LEAST, times: int = TIMES) -> list[RUN]:
    """(start, length, period) of all runs, by start, then period.

    ``codes`` are the words of some texts as whole numbers, ``text`` (not falling) the text of each word.
    """
    width = shortest_prefix(least, times)
    place = np.flatnonzero(_recurring(codes, text, width))
    if not len(place):
        return []
    # What is left out, and a text's end, is a word of its own.
    cut = np.concatenate([[False], (np.diff(place) > 1) | (np.diff(text[place]) > 0)])
    at = np.arange(len(place)) + np.cumsum(cut)
    word = np.unique(text[place] * (int(codes.max()) + 1) + codes[place], return_inverse=True)[1]
    reduced = np.full(int(at[-1]) + 1, -1, np.int64)
    reduced[at] = word
    own = np.flatnonzero(reduced < 0)
    reduced[own] = len(place) + np.arange(len(own))
    origin = np.zeros(len(reduced), np.int64)
    origin[at] = place
    order, shared = suffixes(reduced)

    # A subtree matters when two of its places are near enough for its longest prefix.
    tree = np.cumsum(shared < width)
    order = origin[order]
    by = np.lexsort((order, tree))
    gap = np.full(tree[-1] + 1, np.iinfo(np.int64).max)
    together = tree[by[1:]] == tree[by[:-1]]
    np.minimum.at(gap, tree[by[1:]][together], (order[by[1:]] - order[by[:-1]])[together])
    longest = np.zeros(tree[-1] + 1, np.int64)
    np.maximum.at(longest, tree, shared)
    matters = (gap <= longest // (times - 1))[tree]
    if not matters.any():
        return []
    left = np.concatenate([[-1], codes[:-1]])
    left[np.concatenate([[True], text[1:] != text[:-1]])] = -1
    left = left[order[matters]].tolist()
    places, prefixes = order[matters].tolist(), np.where(shared < width, 0, shared)[matters].tolist()
    klass = dict(zip(places, left))
    found: dict[tuple[int, int], int] = {}

    def pair(x: int, y: int, length: int) -> None:
        period = y - x
        if period * (times - 1) <= length and length + period >= least and klass[x] != klass[y]:
            end = x + length + period
            if period < found.get((x, end), end):
                found[x, end] = period

    def join(a: Places, b: Places, length: int) -> Places:
        """Close a child: pairs between the two, which share ``length`` words."""
        if a.size < b.size:
            a, b = b, a
        for p in b:
            before, after = a.beside(p)
            if before >= 0:
                pair(before, p, length)
            if after >= 0:
                pair(p, after, length)
        for p in b:
            a.add(p)
        return a

    open_: list[tuple[int, Places]] = []
    last: Places | None = None
    for p, length in zip(places, prefixes):
        while open_ and open_[-1][0] > length:
            value, held = open_.pop()
            last = join(held, last, value)
        if length:
            if open_ and open_[-1][0] == length:
                open_[-1] = (length, join(open_[-1][1], last, length))
            else:
                open_.append((length, last))
        last = Places(p)
    while open_:
        value, held = open_.pop()
        last = join(held, last, value)
    return sorted(((x, end - x, q) for (x, end), q in found.items()), key=lambda r: (r[0], r[2]))


def repeating(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words, of which one text in ten, chosen by its id, repeats a short stretch up to its end."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


DIGESTS = pa.schema(
    [("doc_id", pa.int64()), *((c, pa.int64()) for c in ("n_runs", "start", "length", "period", "exponent_milli")),
     ("runs_sha256", pa.string()), ("collapsed_sha256", pa.string())]
)


def _highest(runs: list[RUN]) -> RUN:
    """The run with the most periods; of equal ones the first, then the one of the smallest period."""
    best = runs[0]
    for r in runs[1:]:
        if r[1] * best[2] > best[1] * r[2]:
            best = r
    return best


def _digests(ids: list, many: list[list[bytes]]) -> Iterator[tuple]:
    """Rows of the result for some texts."""
    ends = np.cumsum([len(w) for w in many])
    text = np.repeat(np.arange(len(many)), [len(w) for w in many])
    numbers: defaultdict = defaultdict(count().__next__)
    flat = [w for words in many for w in words]
    codes = np.fromiter(map(numbers.__getitem__, flat), np.int64, len(flat))
    runs = maximal_runs(codes, text) if len(flat) else []
    of: dict[int, list[RUN]] = defaultdict(list)
    for r in runs:
        of[int(text[r[0]])].append(r)
    for k, (doc_id, words) in enumerate(zip(ids, many)):
        base, kept, mine = int(ends[k]) - len(words), words, of.get(k, [])
        mine = [(s - base, n, q) for s, n, q in mine]
        if mine:
            edge = np.zeros(len(words) + 1, np.int64)
            for s, n, q in mine:
                edge[s + q] += 1
                edge[s + n] -= 1
            kept = compress(words, (np.cumsum(edge[:-1]) == 0).tolist())
        s, n, q = _highest(mine) if mine else (None, None, None)
        lines = "".join(f"{a},{b},{c}\n" for a, b, c in mine)
        yield (doc_id, len(mine), s, n, q, 1000 * n // q if mine else None,
               hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(b" ".join(kept)).hexdigest())


def _digest_batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def out(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), DIGESTS)], schema=DIGESTS)

    for batch in it:
        ids, many, size, rows = [], [], 0, []
        for doc_id, text in zip(batch["id"].to_pylist(), batch["text"]):
            words = repeating(text.as_buffer().to_pybytes().split(), doc_id)
            if ids and size + len(words) > CHUNK:
                rows += _digests(ids, many)
                ids, many, size = [], [], 0
            ids.append(doc_id)
            many.append(words)
            size += len(words)
        if ids:
            rows += _digests(ids, many)
            yield out(rows)
    release()


def run_digests(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: number of runs, the run of the highest exponent, digests of all runs and of the words that stay
    when every run is cut down to its first period."""
    rows = texts(documents, key, text)
    return rows.withColumn("id", rows["id"].cast("long")).mapInArrow(_digest_batches, to_spark(DIGESTS))


def runs_of(documents: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST, times: int = TIMES) -> DataFrame:
    """(key, start, length, period): every run of every text as it stands, one row each."""
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for doc_id, one in zip(batch["id"].to_pylist(), batch["text"]):
                words = one.as_buffer().to_pybytes().split()
                numbers: defaultdict = defaultdict(count().__next__)
                codes = np.fromiter(map(numbers.__getitem__, words), np.int64, len(words))
                runs = maximal_runs(codes, np.zeros(len(words), np.int64), least, times) if words else []
                if runs:
                    columns = [[doc_id] * len(runs), *zip(*runs)]
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=schema)

    rows = texts(documents, key, text)
    rows = rows.withColumn("id", rows["id"].cast("long"))
    return rows.mapInArrow(run, to_spark(schema)).withColumnRenamed("doc_id", key)
