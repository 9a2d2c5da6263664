"""Near-duplicate documents: BagMinHash signatures, bands, exact verification of the multiset overlap.

A document is the multiset of its shingles of five words (a shorter one is one shingle).  Every shingle of
weight w owns Poisson processes over the weight axis: one per dyadic block [0, 1), [1, 2), [2, 4), ..., the
last block thinned to the part below w.  Points come in order of time and each goes to a random component of
the signature, which keeps its earliest; generation stops at the latest time a component still has.  Two
signatures agree in a component with a probability of the weighted Jaccard similarity, without bias.

Texts that are equal are one class first.  Bands of the signatures put classes into buckets; within a bucket
signatures are compared and parts whose estimate is not clearly too low stay together.  The clusters so found
are verified: every pair of a cluster, by its exact overlap.  Clusters and buckets beyond a block are cut into
pairs of blocks; no pair leaves its task, only counts and each document's smallest partner.

A pair at similarity 0.8 meets in no band with probability (1 - 0.8**4)**24, 3e-6, and is taken for clearly
different with about the same.

Defined results: words are runs of bytes other than ASCII white space.  A null or empty text, one without
words, and a row with a null key link with nothing, not even each other.  Equal texts are linked.  Rows that
repeat a key and text are equal texts with one key.  Different texts of one key are documents of their own; where
they are near each other, one of them is kept.  An empty table gives an empty table.  Whole texts are
read, whatever their length; only the named columns are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ardoise.llm.blocks import block_pairs, linked, parts, runs
from ardoise.llm.common import join_lookup, release, texts, to_spark
from ardoise.llm.components import components
from ardoise.sources.workdir import materialise

WORDS, LIMIT = 5, 0.8
BANDS, ROWS = 24, 4
#: Signatures that agree in less than this share are clearly below the limit (five standard errors).
CLEARLY = 0.6
#: Documents of a block; a pair of blocks is compared by one task at once.
BLOCK = 1024
#: Bytes of text of a block of documents, about.
BLOCK_BYTES = 3 << 20
#: Bytes of text that are hashed together.
STEP = 1 << 20

U = np.uint64
ODD = U(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """Whole 64-bit numbers, well mixed."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class _Powers:
    """Powers of an odd number and of its inverse."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def of(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            for name, b in (("up", self.base), ("down", self.inverse)):
                x = np.full(n, b, np.uint64)
                x[0] = 1
                setattr(self, name, np.cumprod(x, dtype=np.uint64))
        return self.up[:n], self.down[:n]


POWERS = _Powers(0x5851F42D4C957F2D)
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def shingles(many: list[bytes], words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Text number and hash of every shingle of some texts, in order."""
    data = np.frombuffer(b"\n".join(many) + b"\n", np.uint8)
    space = SPACE[data]
    before = np.concatenate([[True], space[:-1]])
    start, end = np.flatnonzero(before & ~space), np.flatnonzero(~before & space)
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    up, down = POWERS.of(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data + U(1)) * up[:-1], out=sums[1:])
    word = mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64) * ODD)
    lengths = np.fromiter(map(len, many), np.int64, len(many)) + 1
    text = np.searchsorted(np.cumsum(lengths), start, "right")
    count = np.bincount(text, minlength=len(many))
    first = np.cumsum(count) - count
    place = np.arange(len(word)) - first[text]
    left = np.minimum(words, count[text] - place)
    # The starts of shingles: places with enough words left, or the first of a short text.
    at = np.flatnonzero((left == words) | (place == 0))
    total = np.zeros(len(at), np.uint64)
    padded = np.concatenate([word, np.zeros(words, np.uint64)])
    for k in range(words):
        inside = k < left[at]
        total = total * U(0xD1342543DE82EF95) + np.where(inside, padded[at + k], U(0)) + U(1)
    return text[at], mix(total)


def counted(text: np.ndarray, shingle: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different shingles of each text and how often they occur."""
    order = np.lexsort((shingle, text))
    text, shingle = text[order], shingle[order]
    new = np.flatnonzero(np.concatenate([[True], (text[1:] != text[:-1]) | (shingle[1:] != shingle[:-1])])) if len(text) else np.zeros(0, int)
    return text[new], shingle[new], np.diff(np.concatenate([new, [len(text)]]))


def bag_minhash(text: np.ndarray, shingle: np.ndarray, weight: np.ndarray, n: int, size: int) -> np.ndarray:
    """Signatures of ``n`` weighted sets: the earliest time in each of ``size`` components."""
    node = [(np.arange(len(text)), 0.0, 1.0)]
    low = 1.0
    while (inside := np.flatnonzero(weight > low)).size:
        node.append((inside, low, low))
        low *= 2
    at = np.concatenate([x[0] for x in node])
    level = np.repeat(np.arange(len(node)), [len(x[0]) for x in node])
    floor, width = np.array([x[1] for x in node])[level], np.array([x[2] for x in node])[level]
    owner, limit, now = text[at], weight[at].astype(float), np.zeros(len(at))
    state = mix(shingle[at] + ODD * (level + 1).astype(np.uint64))
    best, latest = np.full((n, size), np.inf), np.full(n, np.inf)
    flat = best.reshape(-1)
    while len(owner):
        state = state + ODD
        now = now - np.log(((mix(state) >> U(11)).astype(float) + 1) * 2.0**-53) / (size * width)
        still = now <= latest[owner]
        if not still.all():
            owner, limit, now, state, floor, width = (x[still] for x in (owner, limit, now, state, floor, width))
        draw = mix(state ^ U(0xA0761D6478BD642F))
        here = floor + width * ((draw & U(0xFFFFFFFFFF)).astype(float) * 2.0**-40) < limit
        component = ((draw >> U(40)) % U(size)).astype(np.int64)
        np.minimum.at(flat, (owner * size + component)[here], now[here])
        latest = best.max(1)
    return best


SIGNED = pa.schema([("id", pa.int64()), ("h", pa.int64()), ("g", pa.int32()), ("sig", pa.list_(pa.int32()))])
LINKED = pa.schema([("id", pa.int64()), ("links", pa.int64()), ("root", pa.int64())])


def _pieces(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Parts of a batch of about STEP bytes of text."""
    column = batch["text"].cast(pa.binary())
    lengths = pa.compute.binary_length(column).to_numpy(zero_copy_only=False)
    part = np.cumsum(lengths) // STEP
    edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(part)]
    for s, e in zip(edges, edges[1:]):
        if e > s:
            yield batch.slice(s, e - s), column.slice(s, e - s).to_pylist()


def _sign(size: int, words: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for part, many in _pieces(batch):
                text, shingle, weight = counted(*shingles(many, words))
                best = bag_minhash(text, shingle, weight, len(many), size)
                empty = np.isinf(best[:, 0])
                sig = (mix(best.view(np.uint64)) >> U(32)).astype(np.uint32).view(np.int32)
                signed = pa.array([None if e else s for e, s in zip(empty, sig)], SIGNED.field("sig").type)
                yield pa.RecordBatch.from_arrays([part["id"], part["h"], part["g"], signed], schema=SIGNED)
        release()

    return run


def _links(ids: np.ndarray, times: np.ndarray, link: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    some = link.any(1)
    return ids[some], linked(link, times)[some], parts(link, ids)[some]


def _tasks(by: list[str], link_of):
    """Compare the rows of each pair of blocks with ``link_of``; counts and smallest partners leave."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for group in runs(it, [*by, "first", "second"]):
            if group.num_rows < 2:
                continue
            ids, first = np.unique(group["id"].to_numpy(), return_index=True)
            group = group.take(first)
            link = link_of(group)
            np.fill_diagonal(link, False)
            if group["first"][0].as_py() != group["second"][0].as_py():
                block = group["block"].to_numpy()
                link &= block[:, None] != block[None, :]
            held.append(_links(ids, group["times"].to_numpy(), link))
            n += len(held[-1][0])
            if n > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*held)], schema=LINKED)
                held, n = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*held)], schema=LINKED)
        release()

    return run


def _alike(group: pa.Table) -> np.ndarray:
    """Signatures that may belong together."""
    sig = group["sig"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(group.num_rows, -1)
    same = np.zeros((len(sig), len(sig)), np.int16)
    for c in sig.T:
        same += c[:, None] == c[None, :]
    return same >= CLEARLY * sig.shape[1]


def _verified(limit: float, words: int):
    def link_of(group: pa.Table) -> np.ndarray:
        many = group["text"].cast(pa.binary()).to_pylist()
        text, shingle, weight = counted(*shingles(many, words))
        total = np.bincount(text, weight, len(many))
        # A shingle that occurs w times is w cells, so common cells count the overlap of multisets.
        nth = np.arange(int(weight.sum())) - np.repeat(np.cumsum(weight) - weight, weight)
        text, cell = np.repeat(text, weight), mix(np.repeat(shingle, weight) + nth.astype(np.uint64) * ODD)
        order = np.argsort(cell, kind="stable")
        text, cell = text[order], cell[order]
        new = np.concatenate([[True], cell[1:] != cell[:-1]])
        number = np.cumsum(new) - 1
        shared = np.bincount(number)[number] > 1
        text, number = text[shared], number[shared]
        number = np.unique(number, return_inverse=True)[1]
        overlap = np.zeros((len(many), len(many)), np.float64)
        width = max(1, min(8192, (16 << 20) // len(many)))
        edges = np.searchsorted(number, np.arange(0, (number[-1] + 1 if len(number) else 0) + width, width))
        for k, (s, e) in enumerate(zip(edges, edges[1:])):
            has = np.zeros((len(many), width), np.float32)
            has[text[s:e], number[s:e] - k * width] = 1
            overlap += has @ has.T
        union = total[:, None] + total[None, :] - overlap
        return (overlap >= limit * union) & (total > 0)[:, None]

    return link_of


def _compared(rows: DataFrame, by: list[str], columns: list[str], block: int, link_of, name: str) -> DataFrame:
    order = [*by, "first", "second"]
    bulk = F.octet_length("text") if "text" in columns else None
    cut = block_pairs(rows, by, block, bulk, BLOCK_BYTES).select(*order, "id", "times", "block", *columns)
    found = cut.repartition(*order).sortWithinPartitions(*order).mapInArrow(_tasks(by, link_of), to_spark(LINKED))
    return materialise(found, name)


def _with_roots(links: DataFrame) -> DataFrame:
    """``id`` and ``component`` of all numbers of some links, the smallest ones too."""
    found = components(links.select(F.col("id").alias("a"), F.col("root").alias("b")))
    return found.unionByName(found.select(F.col("component").alias("id"), "component").distinct())


def near_documents(
    df: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    limit: float = LIMIT,
    words: int = WORDS,
    bands: int = BANDS,
    rows: int = ROWS,
    block: int = BLOCK,
) -> DataFrame:
    """``key``, h and g (hashes of the text), class_id (smallest key of the class), n_links and kept, for every row."""
    plain = texts(df, key, text).select(F.col("id").cast("long"), F.xxhash64("text").alias("h"), F.hash("text").alias("g"), "text")
    signed = materialise(plain.mapInArrow(_sign(bands * rows, words), to_spark(SIGNED)), "signed")
    usable = signed.where("sig is not null and id is not null")
    found = usable.groupBy("h", "g").agg(F.min("id").alias("doc"), F.count(F.lit(1)).alias("times"), F.any_value("sig").alias("sig"))
    # A class has a number of its own: several classes may have one smallest key.
    classes = materialise(found.withColumn("id", F.monotonically_increasing_id()), "classes")
    band = [F.xxhash64(F.lit(k), F.slice("sig", k * rows + 1, rows)) for k in range(bands)]
    posted = classes.select("id", F.posexplode(F.array(*band)).alias("band", "key"))
    # Buckets with equal members are compared once.
    member = F.xxhash64("id")
    buckets = posted.groupBy("band", "key").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(member).alias("x"), F.min(member).alias("y")).where("n > 1")
    chosen = buckets.groupBy("n", "x", "y").agg(F.min(F.struct("band", "key")).alias("b")).select("b.*")
    inside = materialise(posted.join(chosen, ["band", "key"]).select("band", "key", "id"), "inside")
    compared = inside.join(classes.select("id", "sig", "times"), "id")
    alike = _compared(compared, ["band", "key"], ["sig"], 2 * block, _alike, "alike")
    members = materialise(_with_roots(alike).join(classes.select("id", "doc", "h", "g", "times"), "id"), "members")
    whole = join_lookup(plain.withColumnRenamed("id", "doc"), members, ["doc", "h", "g"], "inner").select("component", "id", "times", "text")
    links = _compared(whole, ["component"], ["text"], block, _verified(limit, words), "links")
    counts = links.groupBy("id").agg(F.sum("links").alias("links"))
    # The smallest row of each component stands for it.
    parts_ = materialise(_with_roots(links).join(classes.select("id", "doc", "h", "g"), "id"), "parts")
    tops = parts_.groupBy("component").agg(F.min(F.struct("doc", "h", "g")).alias("top"))
    known = classes.select("h", "g", "id", "doc", "times").join(counts, "id", "left").join(parts_.select("id", "component").join(tops, "component"), "id", "left")
    known = known.select(
        "h", "g", F.coalesce("top.doc", "doc").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("times") - 1).alias("n_links"),
        F.coalesce((F.col("top.h") == F.col("h")) & (F.col("top.g") == F.col("g")), F.lit(True)).alias("stands"),
    )
    out = signed.select("id", F.when(F.col("sig").isNotNull() & F.col("id").isNotNull(), F.col("h")).alias("h"), "g", F.col("h").alias("hash"))
    out = out.join(materialise(known, "known"), ["h", "g"], "left").withColumn("class_id", F.coalesce("class_id", "id"))
    return out.select(
        F.col("id").alias(key), F.col("hash").alias("h"), "g", "class_id", F.coalesce("n_links", F.lit(0)).alias("n_links"),
        F.coalesce((F.col("id") == F.col("class_id")) & F.coalesce("stands", F.lit(True)), F.lit(True)).alias("kept"),
    )


def one_of_each(df: DataFrame, key: str = "doc_id", text: str = "text", **parameters) -> DataFrame:
    """The rows of ``df`` with one document of each class; rows without a key stay."""
    columns, by = df.columns, ["_id", "_h", "_g"]
    t = F.coalesce(F.col(text), F.lit(""))
    rows = df.withColumns({"_id": F.col(key).cast("long"), "_h": F.xxhash64(t), "_g": F.hash(t)})
    near = near_documents(df, key, text, **parameters).where(F.col(key).isNotNull())
    near = materialise(near.select(F.col(key).alias("_id"), F.col("h").alias("_h"), F.col("g").alias("_g"), "kept"), "near")
    gone = materialise(near.where(~F.col("kept")).select(by).distinct(), "gone")
    left = join_lookup(rows, gone, by, "left_anti")
    again = materialise(near.where("kept").groupBy(by).count().where("count > 1").select(by), "again")
    if again.limit(1).count():  # the same row several times
        once = left.join(again, by, "left_semi").dropDuplicates(by)
        left = left.join(again, by, "left_anti").unionByName(once)
    return left.select(*[F.col(f"`{c}`") for c in columns])
