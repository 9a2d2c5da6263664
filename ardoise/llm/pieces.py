"""SentencePiece encoding with the source bytes of every piece, and decoding.

A text is normalised through the model's compiled character map: at each place the longest prefix in the
map's double array is replaced, anything else is kept, and every byte of the result records where its source
begins.  The normalised text falls into segments that no piece of the vocabulary can cross, which are merged
once each by the library and remembered.  The lengths of the pieces, summed over the text and looked up in
the recorded places, give the source span of each piece.

Segments begin at a word-start mark that follows another character.  That is exact for models without a piece
that has such a place inside; for others the whole text is one segment.

Defined results: a null or empty text has no pieces and decodes to the empty text.  Texts of any length are
encoded whole.  Repeated rows and null keys are rows like others; only the named columns are read.  Models
with user-defined symbols are refused.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ardoise.llm.common import texts, to_spark

MARK = "▁"
SEGMENTS = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
CROSSING = re.compile(f"[^{MARK}]{MARK}")
#: Remembered segments of a worker process; all are forgotten beyond it, to bound the memory.
REMEMBERED = 1_000_000
# Kinds of pieces, and the numbers of the fields of a model file.
UNKNOWN, USER_DEFINED, BYTE = 2, 4, 6


def fields(data: bytes) -> Iterator[tuple[int, bytes | int]]:
    """Fields of a serialised protocol message."""

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            b = data[at]
            value |= (b & 127) << shift
            at, shift = at + 1, shift + 7
            if b < 128:
                return value, at

    at = 0
    while at < len(data):
        tag, at = varint(at)
        kind = tag & 7
        if kind == 0:
            value, at = varint(at)
        else:
            n, at = varint(at) if kind == 2 else (8 if kind == 1 else 4, at)
            value, at = data[at : at + n], at + n
        yield tag >> 3, value


def submessage(number: int, body: bytes) -> bytes:
    def varint(n: int) -> bytes:
        out = bytearray()
        while n > 127:
            out.append(n & 127 | 128)
            n >>= 7
        return bytes([*out, n])

    return varint(number << 3 | 2) + varint(len(body)) + body


class CharacterMap:
    """The compiled map: a double array over byte strings, and the replacements it points to."""

    def __init__(self, blob: bytes):
        n = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = struct.unpack_from(f"<{n // 4}I", blob, 4) if n else ()
        self.replacements = blob[4 + n :]

    def longest(self, data: bytes, at: int) -> tuple[int, bytes]:
        """Length of the longest mapped prefix at that place and its replacement; (0, b"") without one."""
        if not self.units:
            return 0, b""
        found, node = (0, 0), 0
        unit = self.units[0]
        for i in range(at, len(data)):
            node ^= (unit >> 10) << ((unit & 512) >> 6)
            node ^= data[i]
            unit = self.units[node] if node < len(self.units) else 0
            if unit & 0x800000FF != data[i]:
                break
            if unit & 256:
                leaf = node ^ (unit >> 10) << ((unit & 512) >> 6)
                found = (i + 1 - at, self.units[leaf] & 0x7FFFFFFF)
        n, place = found
        return (n, self.replacements[place : self.replacements.index(b"\0", place)]) if n else (0, b"")


class Encoder:
    """A model with its normaliser, segment memory and piece lengths."""

    def __init__(self, model: bytes):
        import sentencepiece

        self.names, self.kinds, norm, trainer = [], [], b"", b""
        for k, v in fields(model):
            if k == 1:
                f = dict(fields(v))
                self.names.append(f[1])
                self.kinds.append(f.get(3, 1))
            elif k == 2:
                trainer = v
            elif k == 3:
                norm = v
        if USER_DEFINED in self.kinds:
            raise ValueError("models with user-defined symbols are not supported")
        n, t = dict(fields(norm)), dict(fields(trainer))
        self.map = CharacterMap(n.get(2, b""))
        self.prefix, self.squeeze, self.escape = bool(n.get(3, 1)), bool(n.get(4, 1)), bool(n.get(5, 1))
        self.suffix = bool(t.get(24, 0))
        self.whole = sentencepiece.SentencePieceProcessor(model_proto=model)
        # Later fields of a message override earlier ones: this copy takes normalised text as it is.
        plain = submessage(3, submessage(2, b"") + b"\x18\x00\x20\x00\x28\x01")
        self.plain = sentencepiece.SentencePieceProcessor(model_proto=model + plain)
        self.mark = (MARK if self.escape else " ").encode()
        self.cut = self.escape and not any(CROSSING.search(x.decode()) for x in self.names)
        kinds = np.array(self.kinds)
        self.is_byte, self.is_unknown = kinds == BYTE, kinds == UNKNOWN
        self.sizes = np.array([len(x) for x in self.names], np.int32)
        self.decimal = [str(i) for i in range(len(self.names))]
        self._forget()

    # Normalisation

    def normalise(self, text: str) -> tuple[str, np.ndarray]:
        """The normalised text, and for each of its bytes and its end the byte of the source it comes from."""
        if not text:
            return "", np.zeros(1, np.int32)
        if not self.map.units and not self.squeeze and self.escape and not self.suffix and "\0" not in text:
            return self._kept(text)
        data, out, place, done = text.encode(), bytearray(), [], 0

        def prefix() -> tuple[bytes, int]:
            n, new = self.map.longest(data, done)
            if not n:
                lead = data[done]
                n = 1 if lead < 128 else 2 if lead < 224 else 3 if lead < 240 else 4
                new = data[done : done + n]
            return new, n

        def add(new: bytes) -> None:
            for b in new:
                piece = self.mark if b == 32 else bytes([b])
                out.extend(piece)
                place.extend([done] * len(piece))

        if self.squeeze:
            while done < len(data):
                new, n = prefix()
                if new != b" ":
                    break
                done += n
            if done == len(data):
                return "", np.zeros(1, np.int32)
        if self.prefix and not self.suffix:
            add(b" ")
        after_space = self.squeeze
        while done < len(data):
            new, n = prefix()
            while after_space and new.startswith(b" "):
                new = new[1:]
            if new:
                add(new)
                after_space = new.endswith(b" ")
            done += n
            if not self.squeeze:
                after_space = False
        if self.squeeze:
            while out.endswith(self.mark):
                done = place[len(out) - len(self.mark)]
                del out[-len(self.mark) :], place[len(out) :]
        if self.prefix and self.suffix:
            add(b" ")
        return out.decode(errors="replace"), np.array([*place, done], np.int32)

    def _kept(self, text: str) -> tuple[str, np.ndarray]:
        """The same for an empty map, where only spaces change."""
        new = (MARK if self.prefix else "") + text.replace(" ", MARK)
        source = np.frombuffer(text.encode(), np.uint8)
        width = np.where(source == 32, 3, 1)
        at = np.repeat(np.arange(len(source), dtype=np.int32), width)
        return new, np.concatenate([np.zeros(3 if self.prefix else 0, np.int32), at, np.array([len(source)], np.int32)])

    # Merging

    def _forget(self) -> None:
        self.slots: dict[str, int] = {}
        self.start, self.count = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.flat, self.width = np.zeros(0, np.int32), np.zeros(0, np.int32)

    def _learn(self, segments: list[str]) -> None:
        """Merge new segments and remember their ids and the normalised bytes of each piece."""
        found = self.plain.encode(segments, num_threads=1)
        count = np.fromiter(map(len, found), np.int64, len(found))
        start = np.cumsum(count) - count
        flat = np.fromiter(chain.from_iterable(found), np.int32, int(count.sum()))
        width = self.sizes[flat]
        # Of the byte pieces of a character the last has all its bytes.
        left = 0
        for k in np.flatnonzero(self.is_byte[flat]).tolist():
            if not left:
                lead = int(self.names[flat[k]][3:5], 16)
                size = left = 1 if lead < 128 else 2 if lead < 224 else 3 if lead < 240 else 4
            left -= 1
            width[k] = 0 if left else size
        for k in np.unique(np.searchsorted(start, np.flatnonzero(self.is_unknown[flat]), "right") - 1).tolist():
            pieces = self.plain.encode(segments[k], return_type="proto").pieces
            width[start[k] : start[k] + count[k]] = [len(p.surface.encode()) for p in pieces]
        self.slots.update(zip(segments, range(len(self.start), len(self.start) + len(segments))))
        self.start = np.concatenate([self.start, start + len(self.flat)])
        self.count = np.concatenate([self.count, count])
        self.flat, self.width = np.concatenate([self.flat, flat]), np.concatenate([self.width, width])

    def joined(self, ids: np.ndarray) -> str:
        return ",".join([self.decimal[i] for i in ids.tolist()])

    def encode(self, many: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Of each text the ids, and begin and end of each piece in source bytes."""
        if len(self.slots) > REMEMBERED:
            self._forget()
        whole = []
        for text in many:
            new, place = self.normalise(text)
            if not self.cut:
                cut = [new] if new else []
            elif new.startswith(MARK) and MARK + MARK not in new and not new.endswith(MARK):
                cut = new.replace(MARK, " " + MARK).split(" ")[1:] if " " not in new else SEGMENTS.findall(new)
            else:
                cut = SEGMENTS.findall(new)
            whole.append((cut, place))
        wanted = set().union(*(cut for cut, _ in whole)) - self.slots.keys()
        if wanted:
            self._learn(sorted(wanted))
        for cut, place in whole:
            slots = np.fromiter(map(self.slots.__getitem__, cut), np.int64, len(cut))
            count = self.count[slots]
            ends = np.cumsum(count)
            at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.start[slots] - ends + count, count)
            edges = np.zeros(len(at) + 1, np.int64)
            np.cumsum(self.width[at], out=edges[1:])
            yield self.flat[at], place[np.stack([edges[:-1], edges[1:]], 1)]


_ENCODERS: dict[bytes, Encoder] = {}


def encoder(model: bytes) -> Encoder:
    """The model of this process."""
    key = hashlib.sha256(model).digest()
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(model)
    return _ENCODERS[key]


TOKENS = pa.schema([("id", pa.int64()), ("ids", pa.list_(pa.int32())), ("begin", pa.list_(pa.int32())),
                    ("end", pa.list_(pa.int32())), ("decoded", pa.string())])
DIGESTS = pa.schema([("id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()),
                     ("decoded_sha256", pa.string()), ("spans_sha256", pa.string())])
#: Texts encoded together.
STEP = 256


def _steps(it: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[str]]]:
    for batch in it:
        for at in range(0, batch.num_rows, STEP):
            part = batch.slice(at, STEP)
            yield part["id"], part["text"].to_pylist()


def encode_pieces(df: DataFrame, model: bytes, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ids, begin, end (source bytes) and the decoded text of every row."""

    def run(it):
        e = encoder(model)
        for ids, many in _steps(it):
            rows = [(i, s, e.whole.decode(i.tolist()) if len(i) else "") for i, s in e.encode(many)]
            cols = [ids, [r[0] for r in rows], [r[1][:, 0] for r in rows], [r[1][:, 1] for r in rows], [r[2] for r in rows]]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, TOKENS)], schema=TOKENS)

    out = texts(df, key, text).select(F.col("id").cast("long"), "text").mapInArrow(run, to_spark(TOKENS))
    return out.withColumnRenamed("id", key)


def piece_digests(df: DataFrame, model: bytes, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, n_tokens and digests of ids, decoded text and spans (begin and end as 32-bit numbers) of every row."""

    def sha(x: bytes) -> str:
        return hashlib.sha256(x).hexdigest()

    def run(it):
        e = encoder(model)
        for ids, many in _steps(it):
            rows = [
                (len(i), sha(e.joined(i).encode()), sha(e.whole.decode(i.tolist()).encode() if len(i) else b""), sha(s.astype("<i4").tobytes()))
                for i, s in e.encode(many)
            ]
            cols = [ids, *map(list, zip(*rows))]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, DIGESTS)], schema=DIGESTS)

    out = texts(df, key, text).select(F.col("id").cast("long"), "text").mapInArrow(run, to_spark(DIGESTS))
    return out.withColumnRenamed("id", key)
