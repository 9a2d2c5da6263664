"""Near-duplicate vectors: Euclidean p-stable hashing, then exact cosines.

Each of several tables buckets the normalised vectors by random projections, shifted and cut into equal
steps; near vectors fall into the same step of all projections of some table with near certainty.  Vectors of
a bucket are compared exactly, block by block, in one matrix product.  A pair that meets in several tables
counts where it meets first, so a vector's number of links is a sum of counts and no pair leaves its task;
what leaves is each vector's count and the smallest member of its part of the bucket.  Equal vectors with
equal labels are one class with a multiplicity before that.  A bucket beyond ``BLOCK`` vectors is cut into
blocks whose pairs are tasks of their own.

At cosine 0.93, where it is hardest, a pair is missed with probability (1 - p**WIDTH)**TABLES, about 5e-6 with
these parameters (p = 0.851 is the chance that a step of STEP holds both of two points 0.374 apart).

Defined results: vectors with a null label or id, null or zero vectors and vectors with null or non-finite
components link with nothing; vectors of different length never link.  Equal vectors of one label link with
each other.  Rows that repeat an id are vectors of their own; where different ones are near each other,
one is kept.  An empty table gives an empty table.  Only the
named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ardoise.llm.blocks import block_pairs, parts, runs
from ardoise.llm.common import to_spark
from ardoise.llm.components import components
from ardoise.llm.neighbours import usable
from ardoise.sources.workdir import materialise

LIMIT = 0.93
TABLES, WIDTH, STEP = 38, 8, 2.0
#: Vectors of a block; a pair of blocks is compared by one task at once.
BLOCK = 2048
SEED = 11

HASHED = pa.schema([("label", pa.int64()), ("id", pa.int64()), ("times", pa.int64()), ("v", pa.list_(pa.float64())), ("keys", pa.list_(pa.int32()))])
LINKED = pa.schema([("id", pa.int64()), ("links", pa.int64()), ("root", pa.int64())])


def bucket_keys(unit: np.ndarray, tables: int, width: int, step: float, seed: int = SEED) -> np.ndarray:
    """One 32-bit key per vector and table."""
    rng = np.random.default_rng([seed, unit.shape[1]])
    a = rng.standard_normal((unit.shape[1], tables * width))
    b = rng.uniform(0, step, tables * width)
    mix = rng.integers(1, 2**63, tables * width, dtype=np.uint64) | np.uint64(1)
    cell = np.floor((unit @ a + b) / step).astype(np.int64).astype(np.uint64) * mix
    cell ^= cell >> np.uint64(29)
    return (cell.reshape(len(unit), tables, width).sum(2) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)).astype(np.uint32).view(np.int32)


def _hash(tables: int, width: int, step: float):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            sizes = batch["v"].value_lengths().to_numpy(zero_copy_only=False)
            for n in np.unique(sizes):
                part = batch.filter(pa.array(sizes == n))
                v = part["v"].flatten().to_numpy(zero_copy_only=False).reshape(-1, n)
                keys = bucket_keys(v / np.linalg.norm(v, axis=1, keepdims=True), tables, width, step)
                cols = [part[c] for c in ("label", "id", "times", "v")]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(list(keys), HASHED.field("keys").type)], schema=HASHED)

    return run


def _compare(limit: float):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_out, links_out, root_out, held = [], [], [], 0

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(x) if x else np.zeros(0, np.int64)) for x in (ids_out, links_out, root_out)], schema=LINKED
            )
            for x in (ids_out, links_out, root_out):
                x.clear()
            return out

        for group in runs(it, ["label", "table", "key", "first", "second", "size"]):
            if group.num_rows < 2:
                continue
            get = lambda c: group[c].to_numpy()
            lists = lambda c: group[c].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(group.num_rows, -1)
            ids, times, v, keys, block = get("id"), get("times"), lists("v"), lists("keys"), get("block")
            unit = v / np.linalg.norm(v, axis=1, keepdims=True)
            link = unit @ unit.T >= limit
            np.fill_diagonal(link, False)
            if group["first"][0].as_py() != group["second"][0].as_py():
                link &= block[:, None] != block[None, :]
            i, j = np.nonzero(link)
            if not len(i):
                continue
            table = group["table"][0].as_py()
            new = np.concatenate([~(keys[i[s : s + 65536], :table] == keys[j[s : s + 65536], :table]).any(1) for s in range(0, len(i), 65536)])
            count = np.bincount(i[new], times[j[new]], len(ids)).astype(np.int64)
            some = link.any(1)
            ids_out.append(ids[some])
            links_out.append(count[some])
            root_out.append(parts(link, ids)[some])
            held += int(some.sum())
            if held > 10_000:
                held = 0
                yield flush()
        yield flush()

    return run


def near_vectors(
    df: DataFrame,
    key: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    limit: float = LIMIT,
    tables: int = TABLES,
    width: int = WIDTH,
    step: float = STEP,
    block: int = BLOCK,
) -> DataFrame:
    """``key``, n_links, component_id and kept for every row."""
    takes_part = usable(vector) & F.col(key).isNotNull() & F.col(label).isNotNull()
    rows = df.select(
        F.col(key).cast("long").alias("id"),
        F.when(takes_part, F.col(label).cast("long")).alias("label"),
        F.when(takes_part, F.col(vector).cast("array<double>")).alias("v"),
    ).withColumns({"h": F.xxhash64("v"), "g": F.hash("v")})
    found = rows.where("v is not null").groupBy("label", "h", "g")
    found = found.agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("times"), F.any_value("v").alias("v"))
    # A class has a number of its own: several classes may have one smallest id.
    classes = materialise(found.withColumn("id", F.monotonically_increasing_id()), "classes")
    hashed = classes.select("label", "id", "times", "v").mapInArrow(_hash(tables, width, step), to_spark(HASHED))
    posted = materialise(hashed, "hashed").select("*", F.posexplode("keys").alias("table", "key")).withColumn("size", F.size("v"))
    by = ["label", "table", "key", "size"]
    cut = block_pairs(posted, by, block).select(*by, "id", "times", "v", "keys", "block", "first", "second")
    order = [*by, "first", "second"]
    found = cut.repartition(*order).sortWithinPartitions(*order).mapInArrow(_compare(limit), to_spark(LINKED))
    found = materialise(found, "links")
    counts = found.groupBy("id").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("id").alias("a"), F.col("root").alias("b")))
    roots = roots.unionByName(roots.select(F.col("component").alias("id"), "component").distinct())
    # The smallest row of each component stands for it.
    parts_ = materialise(roots.join(classes.select("id", "rep", "h", "g"), "id"), "parts")
    tops = parts_.groupBy("component").agg(F.min(F.struct("rep", "h", "g")).alias("top"))
    known = classes.select("label", "h", "g", "id", "rep", "times").join(counts, "id", "left")
    known = known.join(parts_.select("id", "component").join(tops, "component"), "id", "left").select(
        "label", "h", "g", F.coalesce("top.rep", "rep").alias("c"), (F.coalesce("links", F.lit(0)) + F.col("times") - 1).alias("n_links"),
        F.coalesce((F.col("top.h") == F.col("h")) & (F.col("top.g") == F.col("g")), F.lit(True)).alias("stands"),
    )
    out = rows.drop("v").join(materialise(known, "known"), ["label", "h", "g"], "left")
    component = F.coalesce("c", "id")
    return out.select(
        F.col("id").alias(key), F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"),
        F.coalesce((F.col("id") == component) & F.coalesce("stands", F.lit(True)), F.lit(True)).alias("kept"),
    )
