"""Groups of any size, compared block by block."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ardoise.llm.common import join_lookup
from ardoise.sources.workdir import materialise


def block_pairs(rows: DataFrame, by: list[str], block: int, bulk: Column | None = None, most: int = 0) -> DataFrame:
    """Deal the rows of each group (``by``) out to tasks that compare one pair of blocks each.

    Adds block (a row's own), first and second (the pair).  A group of up to ``block`` rows, and of up to ``most``
    of their ``bulk`` together, is one block; a row of a larger one goes to as many pairs as the group has blocks.
    Rows need a column ``id``.
    """
    blocks = F.ceil(F.count(F.lit(1)) / block)
    if bulk is not None:
        blocks = F.greatest(blocks, F.ceil(F.sum(bulk) / most))
    large = rows.groupBy(by).agg(blocks.cast("int").alias("blocks")).where("blocks > 1")
    large = materialise(large, "large")
    many = F.coalesce("blocks", F.lit(1))
    cut = join_lookup(rows, large, by).withColumn("block", F.pmod(F.xxhash64("id"), many).cast("int"))
    cut = cut.withColumn("other", F.explode(F.sequence(F.lit(0), many - 1)))
    return cut.withColumns({"first": F.least("block", "other"), "second": F.greatest("block", "other")}).drop("blocks", "other")


def runs(it: Iterator[pa.RecordBatch], by: list[str]) -> Iterator[pa.Table]:
    """Runs of equal ``by`` in sorted batches, small runs of a batch without a copy each."""
    held: list[pa.RecordBatch] = []
    for batch in it:
        if not batch.num_rows:
            continue
        cols = np.stack([batch[c].to_numpy(zero_copy_only=False) for c in by])
        edges = [0, *(np.flatnonzero((cols[:, 1:] != cols[:, :-1]).any(0)) + 1).tolist(), batch.num_rows]
        for s, e in zip(edges, edges[1:]):
            part = batch.slice(s, e - s)
            if held and any(held[-1][c][0].as_py() != part[c][0].as_py() for c in by):
                yield pa.Table.from_batches(held)
                held = []
            held.append(part)
    if held:
        yield pa.Table.from_batches(held)


#: Rows of a matrix that are worked on together.
ROWS = 256


def parts(link: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Smallest id of each vector's connected part."""
    order = np.argsort(ids, kind="stable")
    low = np.empty(len(ids), np.int32)
    low[order] = np.arange(len(ids), dtype=np.int32)
    while True:
        new = low.copy()
        for s in range(0, len(ids), ROWS):
            near = np.where(link[s : s + ROWS], low[None, :], np.int32(len(ids))).min(1)
            new[s : s + ROWS] = np.minimum(low[s : s + ROWS], near)
        if (new == low).all():
            return ids[order][low]
        low = new


def linked(link: np.ndarray, times: np.ndarray) -> np.ndarray:
    """For each row the sum of ``times`` over the rows it is linked with."""
    return np.concatenate([link[s : s + ROWS].astype(np.int64) @ times for s in range(0, len(link), ROWS)])
