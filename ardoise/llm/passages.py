"""Exact removal of repeated passages with suffix arrays built by induced sorting.

A byte goes when a string of ``LENGTH`` bytes covers it that also starts earlier: in a document of a smaller
key, or earlier in the same one.

Equal strings must meet in one task, so texts are cut by content.  Every such string has an anchor, the gram of
the smallest hash in it, at the same place in all its copies.  All strings that hold one anchor lie in its
surroundings.  Anchors whose surroundings have an equal, earlier copy are repeated altogether; one shuffle by
gram finds them, after each batch has met its own repeats.  What is left are surroundings that share a gram but
differ: the edges of passages.  They go, by a longer core that any common string must hold, to shards; each
shard sorts its suffixes (``suffixes``), takes the lengths of common prefixes, and every run of suffixes that
share ``LENGTH`` bytes keeps its earliest start and gives up the others.

A gram with more than ``MANY`` different surroundings is not held by one task: its strings are compared one by
one through an aggregate of their hashes, which has map-side partials.

Hashes have 64 bits over the compared bytes and their number; surroundings are compared by two of them.

Defined results: a null or empty text has no bytes.  Rows that repeat key and text have equal results, those of
one such row.  Texts of one key are told apart and ordered by a hash of 64 bits.  A null key comes before all others and stays null.
Texts of any length are read whole; one of more than 4 MB is cut into overlapping parts while anchors are
sought.  Only the named columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ardoise.llm.anchors import GRAM, Hashes, anchors
from ardoise.llm.common import join_lookup, release, to_spark
from ardoise.llm.suffixes import common_prefixes, suffix_array
from ardoise.llm.textdedup import ODD, mix
from ardoise.sources.workdir import materialise

LENGTH = 100
#: Bytes of text in which anchors are sought together.
STEP, LARGEST = 512 << 10, 3 << 20
#: Different surroundings of a gram up to which a shard takes them.
MANY = 20_000
#: Bytes of a suffix array, about; one core's surroundings stay together.
SHARD = 1 << 20
NULL = -(1 << 63)

MARKS = pa.schema([("gram", pa.int64()), ("around", pa.int64()), ("id", pa.int64()), ("tie", pa.int64()), ("at", pa.int32()), ("to", pa.int32())])
EDGES = pa.schema([("core", pa.int64()), ("id", pa.int64()), ("tie", pa.int64()), ("at", pa.int32()), ("bytes", pa.binary())])
SPANS = pa.schema([("id", pa.int64()), ("tie", pa.int64()), ("s", pa.int32()), ("e", pa.int32())])
PACKED = pa.schema([("id", pa.int64()), ("tie", pa.int64()), ("packed", pa.binary())])
STRINGS = pa.schema([("h", pa.int64()), ("g", pa.int64()), ("id", pa.int64()), ("tie", pa.int64()), ("at", pa.int32())])


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _parts(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Bytes of about STEP, where each text or part of one ends, its row, and where the part starts in its text."""
    column = batch["text"].cast(pa.binary())
    held, rows, starts, n = [], [], [], 0

    def done():
        ends = np.cumsum([len(x) for x in held])
        return np.frombuffer(b"".join(held), np.uint8), ends, np.array(rows), np.array(starts)

    for row, x in enumerate(column):
        data = x.as_py()
        for at in range(0, max(1, len(data) - 2 * LENGTH), LARGEST):
            # Parts of a very long text overlap by the surroundings of an anchor.
            held.append(data[at : at + LARGEST + 2 * LENGTH])
            rows.append(row)
            starts.append(at)
            n += len(held[-1])
            if n >= STEP:
                yield done()
                held, rows, starts, n = [], [], [], 0
    if held:
        yield done()


def _marks(length: int, reach: int):
    """Anchors of every text with the hashes of gram and surroundings; repeats within a batch as spans at once."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            ids = batch["id"].to_numpy(zero_copy_only=False)
            ties = batch["tie"].to_numpy(zero_copy_only=False)
            found = []
            for data, ends, rows, starts in _parts(batch):
                hashes, place, part, gram = anchors(data, ends, length)
                if not len(place):
                    continue
                begin = np.concatenate([[0], ends[:-1]])[part]
                left, right = np.maximum(begin, place - reach), np.minimum(ends[part], place + length)
                around = hashes.of(left, right) ^ mix((place - left).astype(np.uint64) * ODD + (right - place).astype(np.uint64))
                shift = starts[part] - begin
                found.append((gram, around, rows[part], place + shift, left + shift, right + shift))
            if not found:
                continue
            gram, around, row, place, left, right = (np.concatenate(x) for x in zip(*found))
            order = np.lexsort((place, ties[row], ids[row], around, gram))
            gram, around, row, place, left, right = (x[order] for x in (gram, around, row, place, left, right))
            new = np.concatenate([[True], (gram[1:] != gram[:-1]) | (around[1:] != around[:-1])])
            first = np.flatnonzero(new)[np.cumsum(new) - 1]
            repeat = (place != place[first]) | (ties[row] != ties[row[first]]) | (ids[row] != ids[row[first]])
            once = ~repeat & (new | (first == np.arange(len(new))))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(x) for x in (
                        _signed(gram[once]), _signed(around[once]), ids[row[once]], ties[row[once]],
                        place[once].astype(np.int32), np.full(int(once.sum()), -1, np.int32),
                    )
                ],
                schema=MARKS,
            )
            # Spans of repeats, joined where they touch, go along under hashes of their own.
            r = np.flatnonzero(repeat)
            r = r[np.lexsort((left[r], row[r]))]
            row, left, right = row[r], left[r], right[r]
            if len(r):
                begins = np.concatenate([[True], (row[1:] != row[:-1]) | (left[1:] > np.maximum.accumulate(right + (row << 40))[:-1] - (row[1:] << 40))])
                s = np.flatnonzero(begins)
                tops = np.maximum.reduceat(right, s)
                code = mix((ids[row[s]] * 31 + left[s]).astype(np.uint64) * ODD)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(x) for x in (
                            _signed(code), _signed(mix(code)), ids[row[s]], ties[row[s]], left[s].astype(np.int32), tops.astype(np.int32)
                        )
                    ],
                    schema=MARKS,
                )
        release()

    return run


def _packed(rows: DataFrame) -> DataFrame:
    """id, tie and the compressed bytes of the text, for a shuffle."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=1)
        for batch in it:
            data = [squeeze.compress(x.as_py()) for x in batch["text"].cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([batch["id"], batch["tie"], pa.array(data, pa.binary())], schema=PACKED)
        release()

    return rows.select("id", "tie", "text").mapInArrow(run, to_spark(PACKED))


def _unpacked(column: pa.Array) -> Iterator[bytes]:
    expand = zstandard.ZstdDecompressor()
    for x in column:
        yield expand.decompress(x.as_py())


def _strings(length: int, reach: int):
    """Every string of the surroundings of a document's anchors, by its hashes."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            found = []
            for row, data in enumerate(_unpacked(batch["packed"])):
                place = np.unique(batch["places"][row].values.to_numpy().astype(np.int64))
                hashes = Hashes(np.frombuffer(data, np.uint8))
                at = np.unique((place[:, None] - np.arange(reach + 1)).ravel())
                at = at[(at >= 0) & (at <= len(data) - length)]
                found.append((_signed(hashes.of(at, at + length)), _signed(mix(hashes.of(at, at + length // 2))), np.full(len(at), row), at))
            if found:
                h, g, rows, at = (np.concatenate(x) for x in zip(*found))
                rows = pa.array(rows)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h), pa.array(g), batch["id"].take(rows), batch["tie"].take(rows), pa.array(at.astype(np.int32))], schema=STRINGS
                )
        release()

    return run


def _edges(length: int, reach: int):
    """Surroundings of a document's anchors: the half before and the half after, each with the core all its strings hold."""
    half = reach // 2
    # Strings that start at least ``half`` before the anchor hold [p - half, p + length - reach); the others hold
    # [p, p + length - half).
    halves = ((-reach, -half, -half, length - reach), (-half, 0, 0, length - half))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            core, row_, at_, bytes_ = [], [], [], []
            for row, data in enumerate(_unpacked(batch["packed"])):
                place = np.unique(batch["places"][row].values.to_numpy().astype(np.int64))
                hashes, n = Hashes(np.frombuffer(data, np.uint8)), len(data)
                for first, last, low, high in halves:
                    p = place[(place + low >= 0) & (place + high <= n)]
                    s, e = np.maximum(0, p + first), np.minimum(n, p + last + length)
                    fits = e - s >= length
                    p, s, e = p[fits], s[fits], e[fits]
                    core.append(_signed(hashes.of(p + low, p + high) ^ mix(np.full(len(p), low + length, np.uint64))))
                    row_.append(np.full(len(p), row))
                    at_.append(s)
                    bytes_ += [data[a:b] for a, b in zip(s.tolist(), e.tolist())]
            if bytes_:
                rows = pa.array(np.concatenate(row_))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate(core)), batch["id"].take(rows), batch["tie"].take(rows),
                        pa.array(np.concatenate(at_).astype(np.int32)), pa.array(bytes_, pa.binary()),
                    ],
                    schema=EDGES,
                )
        release()

    return run


def repeated(ids: np.ndarray, ties: np.ndarray, at: np.ndarray, pieces: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of some pieces of documents: which piece, and first and last start of strings that also start earlier among them."""
    sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
    # A byte that no text has parts the pieces.
    text = np.frombuffer(b"\xff".join(pieces) + b"\xff", np.uint8)
    starts = np.cumsum(sizes + 1) - sizes - 1
    hashes = Hashes(text)
    array = suffix_array(text, hashes, length)
    shared = common_prefixes(text, array, hashes, starts)
    piece = np.repeat(np.arange(len(pieces)), sizes + 1)
    offset = np.arange(len(text)) - starts[piece]
    whole = (offset + length <= sizes[piece])[array]
    order = np.lexsort((ties, ids))
    document = np.empty(len(ids), np.int64)
    document[order] = np.cumsum(np.concatenate([[0], (ids[order][1:] != ids[order][:-1]) | (ties[order][1:] != ties[order][:-1])]))
    when = (document[piece] << 32) + at[piece] + offset
    run = np.flatnonzero(np.concatenate([[True], (shared[1:] < length)]))
    when = when[array]
    earliest = np.repeat(np.minimum.reduceat(np.where(whole, when, np.iinfo(np.int64).max), run), np.diff(np.concatenate([run, [len(array)]])))
    late = np.zeros(len(text) + 1, np.int8)
    late[array[whole & (when > earliest)]] = 1
    change = np.diff(late, prepend=0)
    first, last = np.flatnonzero(change == 1), np.flatnonzero(change == -1) - 1
    return piece[first], at[piece[first]] + offset[first], at[piece[first]] + offset[last]


def _shards(length: int):
    """Sorted surroundings, some cores at a time."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def shard() -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(held)
            core = t["core"].to_numpy()
            same = core[1:] == core[:-1]
            shared = np.concatenate([same, [False]]) | np.concatenate([[False], same])
            t = t.filter(pa.array(shared))
            if t.num_rows:
                ids, ties, at = (t[c].to_numpy() for c in ("id", "tie", "at"))
                piece, first, last = repeated(ids, ties, at.astype(np.int64), t["bytes"].to_pylist(), length)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[piece]), pa.array(ties[piece]), pa.array(first.astype(np.int32)), pa.array((last + length).astype(np.int32))], schema=SPANS
                )

        size = 0
        for batch in it:
            if not batch.num_rows:
                continue
            core = batch["core"].to_numpy(zero_copy_only=False)
            sizes = np.cumsum(pa.compute.binary_length(batch["bytes"]).to_numpy(zero_copy_only=False))
            new = np.flatnonzero(np.concatenate([[not held or held[-1]["core"][held[-1].num_rows - 1].as_py() != core[0]], core[1:] != core[:-1]]))
            at = before = 0
            for k in new.tolist():
                if held and size + (sizes[k - 1] if k else 0) - before >= SHARD or k > at and (sizes[k - 1] - before) >= SHARD:
                    if k > at:
                        held.append(batch.slice(at, k - at))
                    yield from shard()
                    held, size, at, before = [], 0, k, sizes[k - 1] if k else 0
            if at < batch.num_rows:
                held.append(batch.slice(at))
                size += sizes[-1] - before
        if held:
            yield from shard()
        held = []
        release()

    return run


def _once(rows: DataFrame) -> DataFrame:
    """One row of each id and tie; rows that are alone in theirs travel nowhere."""
    by = ["id", "tie"]
    again = materialise(rows.groupBy(by).count().where("count > 1").select(by), "again")
    if not again.limit(1).count():
        return rows
    # Copies meet in map-side partials first.
    one = join_lookup(rows, again, by, "left_semi").groupBy(by).agg(F.any_value("text").alias("text"))
    return join_lookup(rows, again, by, "left_anti").unionByName(materialise(one, "once"))


def repeated_spans(rows: DataFrame, length: int = LENGTH, many: int = MANY) -> DataFrame:
    """Spans of repeated strings: id, tie, s, e (bytes); they may overlap.  ``rows``: id, tie, text, each id and tie once."""
    reach = length - GRAM
    # Sorted once for both windows.
    made = rows.mapInArrow(_marks(length, reach), to_spark(MARKS)).repartition("gram").sortWithinPartitions("gram", "around")
    near = Window.partitionBy("gram", "around")
    earliest = F.min(F.struct("id", "tie", "at")).over(near)
    every = Window.partitionBy("gram")
    seen = made.withColumn("late", F.struct("id", "tie", "at") > earliest)
    # Different surroundings of a gram: rows that are the earliest of theirs.
    seen = seen.withColumn("n", F.sum((~F.col("late")).cast("long")).over(every)).withColumn("differ", F.col("n") > 1)
    at = F.col("at")
    span = F.col("to") >= 0
    marks = materialise(
        seen.where(span | F.col("late") | F.col("differ")).select(
            "id", "tie", F.when(span, at).otherwise(F.greatest(at - reach, F.lit(0))).alias("s"),
            F.when(span, F.col("to")).otherwise(at + length).alias("e"), "at",
            (span | F.col("late")).alias("whole"), (F.col("n") > many).alias("much"),
        ),
        "marks",
    )

    def at_edges(much: bool, f, schema: pa.Schema) -> DataFrame:
        wanted = marks.where(~F.col("whole") & (F.col("much") == much)).groupBy("id", "tie").agg(F.collect_list("at").alias("places"))
        joined = _packed(rows).join(wanted, ["id", "tie"]).select("id", "tie", "places", "packed")
        return joined.mapInArrow(f(length, reach), to_spark(schema))

    edges = at_edges(False, _edges, EDGES).repartition("core").sortWithinPartitions("core")
    spans = [marks.where("whole").select("id", "tie", "s", "e"), edges.mapInArrow(_shards(length), to_spark(SPANS))]
    if marks.where(~F.col("whole") & F.col("much")).limit(1).count():
        # All copies of a string share their gram, so either all its surroundings are here or none.
        strings = materialise(at_edges(True, _strings, STRINGS), "strings")
        first = strings.groupBy("h", "g").agg(F.min(F.struct("id", "tie", "at")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
        late = strings.join(first, ["h", "g"]).where(F.struct("id", "tie", "at") > F.col("first"))
        spans.append(late.select("id", "tie", F.col("at").alias("s"), (F.col("at") + length).alias("e")))
    out = spans[0]
    for x in spans[1:]:
        out = out.unionByName(x)
    return out


def merged(spans: list, size: int) -> list[tuple[int, int]]:
    """Maximal runs of the covered bytes."""
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        e = min(e, size)
        if out and s <= out[-1][1]:
            if e > out[-1][1]:
                out[-1] = (out[-1][0], e)
        else:
            out.append((s, e))
    return out


def keep(data: bytes, runs: list[tuple[int, int]]) -> bytes:
    done, out = 0, []
    for s, e in runs:
        out.append(data[done:s])
        done = e
    return b"".join([*out, data[done:]])


def _keyed(df: DataFrame, key: str, text: str) -> DataFrame:
    """id (a null one as the smallest number), tie and text."""
    t = F.coalesce(F.col(text), F.lit(""))
    return df.select(F.coalesce(F.col(key).cast("long"), F.lit(NULL)).alias("id"), F.xxhash64(t).alias("tie"), t.alias("text"))


DIGESTS = pa.schema([("id", pa.int64()), ("tie", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])


def remove_repeats(df: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, many: int = MANY) -> DataFrame:
    """``key``, n_bytes, n_removed, n_spans and the digest of the remaining bytes, for every row."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            rows = []
            for data, spans in zip(_unpacked(batch["packed"]), batch["spans"].to_pylist()):
                runs = merged([(x["s"], x["e"]) for x in spans or ()], len(data))
                rows.append((len(data), sum(e - s for s, e in runs), len(runs), hashlib.sha256(keep(data, runs)).hexdigest()))
            yield pa.RecordBatch.from_arrays(
                [batch["id"], batch["tie"], *(pa.array(c, f.type) for c, f in zip(zip(*rows), list(DIGESTS)[2:]))], schema=DIGESTS
            )
        release()

    every = _keyed(df, key, text)
    rows = _once(every)
    spans = repeated_spans(rows, length, many).groupBy("id", "tie").agg(F.collect_list(F.struct("s", "e")).alias("spans"))
    out = _packed(rows).join(spans, ["id", "tie"], "left").select("id", "tie", "packed", "spans").mapInArrow(run, to_spark(DIGESTS))
    if rows is not every:
        # Digests are short: copies of a row take those of the one that was read.
        out = every.select("id", "tie").join(materialise(out, "digests"), ["id", "tie"])
    return out.select(F.when(F.col("id") != NULL, F.col("id")).alias(key), *DIGESTS.names[2:])


def kept_texts(df: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, many: int = MANY) -> DataFrame:
    """The rows of ``df`` with the repeated bytes taken out of ``text``; a character cut at an edge goes whole."""

    # One text at a time as Python's: a batch holds thousands.
    @F.arrow_udf("binary")
    def squeezed(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        squeeze = zstandard.ZstdCompressor(level=1)
        for part in parts:
            yield pa.array((squeeze.compress(x.as_py()) if x.is_valid else None for x in part.cast(pa.binary())), pa.binary(), size=len(part))
        release()

    @F.arrow_udf("string")
    def cut(parts: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        expand = zstandard.ZstdDecompressor()

        def one(x: pa.Scalar, found: pa.Scalar) -> str | None:
            if not x.is_valid:
                return None
            data = expand.decompress(x.as_py())
            if found.is_valid:
                data = keep(data, merged([(y["s"], y["e"]) for y in found.as_py()], len(data)))
            return data.decode(errors="ignore")

        for packed, spans in parts:
            yield pa.array(map(one, packed, spans), pa.string(), size=len(packed))
        release()

    columns = df.columns
    t = F.coalesce(F.col(text), F.lit(""))
    rows = df.withColumns({"_id": F.coalesce(F.col(key).cast("long"), F.lit(NULL)), "_tie": F.xxhash64(t), "_packed": squeezed(F.col(text))})
    spans = repeated_spans(_once(_keyed(df, key, text)), length, many).groupBy("id", "tie").agg(F.collect_list(F.struct("s", "e")).alias("_spans"))
    spans = spans.withColumnsRenamed({"id": "_id", "tie": "_tie"})
    found = rows.drop(text).join(spans, ["_id", "_tie"], "left").withColumn(text, cut(F.col("_packed"), F.col("_spans")))
    return found.select(*[F.col(f"`{c}`") for c in columns])
