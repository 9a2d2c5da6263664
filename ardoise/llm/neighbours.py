"""Approximate nearest neighbours with a permutation index.

Every vector is represented by its nearest pivots in order.  The index is cut into shards by a hash of the id,
so equal vectors spread; a shard's inverted files hold, per pivot, its vectors that have the pivot among their
nearest and at which place.  A block of queries meets every shard: a query reads the files of its own nearest
pivots and ranks the shard's vectors by the footrule distance of the two orders (a pivot that one side lacks
counts as one place behind the last).  The best-ranked share is ranked again by exact distance, and the nearest
of each shard are merged.

Pivots are a bounded sample of the vectors, chosen by a hash; every vector is indexed and every query meets
every shard, so no result is short.

Vectors that are null, zero, of another length than most, or hold null or non-finite components take no part.
Equal distances are ordered by the smaller id.  Rows with the same id are vectors of their own, but never
results of a query of that id.  Fewer candidates than wanted give them all; an empty table gives an empty
table.  Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ardoise.llm.common import to_spark
from ardoise.sources.workdir import materialise

#: Pivots, at most, and how many places of a vector's order are indexed.
PIVOTS, PLACES = 256, 128
#: The share of a shard that a query ranks again by distance, and its least number of vectors.
RERANK, LEAST = 0.07, 256
#: Vectors whose order agrees with the query's this much (1: the same order) are ranked again however many they
#: are: near copies of the query are more than any share, and footrule distances cannot part them.
AGREE = 0.6
#: Vectors of a shard and queries of a block, about.
SHARD, BLOCK = 8192, 4096


def usable(vector: str) -> Column:
    """Neither null nor zero, and all components finite."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    v = F.col(vector)
    return v.isNotNull() & (F.size(v) > 0) & ~F.exists(v, bad) & F.exists(v, lambda x: x != 0)


def vectors(df: DataFrame, key: str, vector: str) -> DataFrame:
    """``id`` and ``v`` (doubles) of the rows that take part."""
    return df.where(usable(vector) & F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))


def matrix(column: pa.Array) -> np.ndarray:
    flat = column.values[column.offsets[0].as_py() : column.offsets[-1].as_py()]
    return flat.to_numpy(zero_copy_only=False).reshape(len(column), -1)


INDEX = pa.schema([("id", pa.int64()), ("v", pa.list_(pa.float64())), ("near", pa.list_(pa.int16()))])
FOUND = pa.schema([("query_id", pa.int64()), ("id", pa.int64()), ("score", pa.float64())])


def choose_pivots(rows: DataFrame, n: int, pivots: int = PIVOTS) -> np.ndarray:
    """Vectors far from each other, out of a bounded sample that a hash chooses."""
    sample = 8 * pivots
    share = F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, 2.0 * sample / max(1, n)))
    found = (rows if n <= 2 * sample else rows.where(share)).orderBy(F.xxhash64("id"), "id").limit(sample).collect()
    v = np.unique(np.array([r["v"] for r in found]), axis=0)
    chosen, apart = [0], ((v - v[0]) ** 2).sum(1)
    while len(chosen) < min(pivots, len(v)):
        chosen.append(int(apart.argmax()))
        apart = np.minimum(apart, ((v - v[chosen[-1]]) ** 2).sum(1))
    return v[chosen]


def build_index(rows: DataFrame, pivots: np.ndarray, places: int = PLACES) -> DataFrame:
    """Every vector with its nearest pivots in order."""
    half, places = (pivots**2).sum(1) / 2, min(places, len(pivots))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                near = np.argsort(half - matrix(part["v"]) @ pivots.T, axis=1, kind="stable")[:, :places].astype(np.int16)
                yield pa.RecordBatch.from_arrays([part["id"], part["v"], pa.array(list(near), INDEX.field("near").type)], schema=INDEX)

    return rows.mapInArrow(run, to_spark(INDEX))


class Shard:
    """Inverted files of some vectors."""

    def __init__(self, ids: np.ndarray, v: np.ndarray, near: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.v, near = ids[order], v[order], near[order]
        self.places = near.shape[1]
        by_pivot = np.argsort(near.ravel(), kind="stable")
        self.rows, self.place = np.divmod(by_pivot, self.places)
        self.starts = np.searchsorted(near.ravel()[by_pivot], np.arange(int(near.max()) + 2 if near.size else 1))

    def nearest(self, query: int, v: np.ndarray, near: np.ndarray, wanted: int, share: float) -> tuple[np.ndarray, np.ndarray]:
        """Ids and distances of the nearest vectors found, nearest first."""
        k, saved = self.places, np.zeros(len(self.ids), np.int32)
        for place, pivot in enumerate(near):
            if pivot + 1 < len(self.starts):
                file = slice(self.starts[pivot], self.starts[pivot + 1])
                # The footrule distance is a constant less what each shared pivot saves.
                saved[self.rows[file]] += 2 * k - self.place[file] - place - np.abs(self.place[file] - place)
        saved[self.ids == query] = -1
        count = min(len(self.ids), max(LEAST, wanted, int(share * len(self.ids)), int((saved >= AGREE * k * (k + 1)).sum())))
        best = np.sort(np.argsort(-saved, kind="stable")[:count])
        best = best[self.ids[best] != query]
        d = np.sqrt(((self.v[best] - v) ** 2).sum(1))
        first = np.argsort(d, kind="stable")[:wanted]
        return self.ids[best[first]], d[first]


def nearest(
    df: DataFrame, is_query: Column, wanted: int = 10, key: str = "vec_id", vector: str = "embedding", share: float = RERANK
) -> DataFrame:
    """For each query (a condition on ``id``) its nearest other rows: query_id, rank, ``key`` and score, the distance."""
    rows = materialise(vectors(df, key, vector), "vectors")
    widths = rows.groupBy(F.size("v").alias("w")).count().orderBy(F.desc("count"), "w").limit(2).collect()
    if not widths:
        return rows.limit(0).selectExpr("id query_id", "cast(0 as int) rank", f"id `{key}`", "0d score")
    if len(widths) > 1:
        rows = rows.where(F.size("v") == widths[0]["w"])
    n, width = widths[0]["count"], widths[0]["w"]
    index = materialise(build_index(rows, choose_pivots(rows, n)), "index")
    queries = index.where(is_query)
    shards, blocks = -(-n // SHARD), max(1, -(-queries.count() // BLOCK))
    number = lambda many, salt: F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(many)).cast("int")
    every = lambda many: F.explode(F.sequence(F.lit(0), F.lit(many - 1)))
    sharded = index.withColumn("shard", number(shards, 1)).withColumn("block", every(blocks))
    asking = queries.withColumn("block", number(blocks, 2)).withColumn("shard", every(shards))

    def ask(_: tuple, mine: pa.Table, asked: pa.Table) -> pa.Table:
        q, i, d = [], [], []
        if mine.num_rows and asked.num_rows:
            cols = [t.combine_chunks() for t in (mine, asked)]
            (ids, v, near), (q_ids, q_v, q_near) = (
                (
                    t["id"].to_numpy(),
                    t["v"].combine_chunks().flatten().to_numpy().reshape(-1, width),
                    t["near"].combine_chunks().flatten().to_numpy().reshape(t.num_rows, -1),
                )
                for t in cols
            )
            shard = Shard(ids, v, near)
            for a, b, c in zip(q_ids.tolist(), q_v, q_near):
                found, distance = shard.nearest(a, b, c, wanted, share)
                q += [a] * len(found)
                i += found.tolist()
                d += distance.tolist()
        return pa.Table.from_pydict({"query_id": q, "id": i, "score": d}, schema=FOUND)

    met = sharded.groupBy("shard", "block").cogroup(asking.groupBy("shard", "block")).applyInArrow(ask, to_spark(FOUND))
    order = Window.partitionBy("query_id").orderBy("score", "id")
    ranked = met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= wanted)
    return ranked.select("query_id", "rank", F.col("id").alias(key), "score")
