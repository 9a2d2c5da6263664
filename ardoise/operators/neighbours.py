"""Exact nearest neighbours among the rows of one table, in Euclidean distance.

Copies are merged first.  A bounded sample gives pivots, which cut the space into cells: a point lies in the cell of its
nearest pivot.  A cell of more than ``block_rows`` points is cut into shells by the distance from its pivot, and a shell
whose points are all equally far is cut by hash, so every block has a greatest size.  The triangle inequality tells
from the distances between a point and the pivots how near the points of a block can be at best:

* no nearer than the point's distance from the pivot lies outside the shell, and
* no nearer than the plane half way between the block's pivot and the point's own (all points of the cell lie behind it).

A point meets its own block first, then the few most promising ones, then exactly those that the bound on its k-th
neighbour cannot rule out by then.  A visit returns at most k candidates within the bound: pairs are never written
out, and both sides of a visit have a fixed greatest size.  Visits are listed without coordinates; these travel a bounded
part at a time, and the shuffle files of a part go before the next one.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ardoise.sources.workdir import materialise

# Workers need not have this package installed: its functions travel by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

BLOCK_ROWS = 2_048
VISITOR_ROWS = 8_192
#: Visitors whose distances from a block are in memory together, and visits that are: numbers of either, at most.
AT_ONCE, VISIT_NUMBERS = 512, 1 << 20
#: Pivots at most, and sampled points for each: the sample is the driver's, whatever the number of points.
PIVOTS, PER_PIVOT = 1_024, 8
#: Shells of a cell at most; what is larger is cut by hash.
SHELLS = 64
#: Blocks that a point meets before all others.
PROMISING = 3
#: Bytes of visiting points that travel before the next ones do.
MOVED = 2 << 30


def block_candidates(visitors: pd.DataFrame, hosts: pd.DataFrame, k: int) -> pd.DataFrame:
    """Up to k nearest host points of every visitor, within the visitor's bound and other than itself."""
    y, host_ids = np.vstack(hosts["x"].to_numpy()), hosts["id"].to_numpy()
    slices = (visitors.iloc[s : s + AT_ONCE] for s in range(0, len(visitors), AT_ONCE))
    return pd.concat([_candidates(v, y, host_ids, k) for v in slices], ignore_index=True)


def _candidates(visitors: pd.DataFrame, y: np.ndarray, host_ids: np.ndarray, k: int) -> pd.DataFrame:
    x, ids, bound = np.vstack(visitors["x"].to_numpy()), visitors["id"].to_numpy(), visitors["bound"].to_numpy()
    square = squares(x, y)
    square[ids[:, None] == host_ids[None, :]] = np.inf
    # The matrix product rounds; a few spare candidates are measured again exactly.
    take = min(k + 4, len(host_ids))
    near = np.argpartition(square, take - 1, axis=1)[:, :take]
    exact = np.sqrt(((x[:, None, :] - y[near]) ** 2).sum(2))
    exact[host_ids[near] == ids[:, None]] = np.inf
    order = np.lexsort((host_ids[near], exact), axis=1)[:, :k]
    near, exact = np.take_along_axis(near, order, 1), np.take_along_axis(exact, order, 1)
    keep = np.isfinite(exact) & (exact <= bound[:, None])
    which = np.repeat(np.arange(len(ids)), keep.sum(1))
    return pd.DataFrame({"id": ids[which], "neighbour": host_ids[near[keep]], "distance": exact[keep]})


CANDIDATE = "id bigint, neighbour bigint, distance double"


def squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return (x**2).sum(1)[:, None] + (y**2).sum(1)[None, :] - 2.0 * x @ y.T


def point(features: Sequence[str]) -> Column:
    """The features as an array; adding zero turns -0.0 into 0.0, so equal points look equal."""
    return F.array(*[F.col(c).cast("double") + F.lit(0.0) for c in features])


def distinct_points(df: DataFrame, key: str, features: Sequence[str]) -> DataFrame:
    """(id, x, copies): each different point once, under the smallest of its keys."""
    return (
        df.select(F.col(key).cast("bigint").alias("id"), point(features).alias("x"))
        .groupBy("x")
        .agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("copies"))
    )


def choose_pivots(points: DataFrame, count: int, wanted: int, rounds: int = 5) -> np.ndarray:
    """Centres of a bounded sample of the points, chosen by a hash of the id: a few rounds of k-means."""
    sample = wanted * PER_PIVOT
    few = points if count <= 2 * sample else points.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int((1 << 30) * 2 * sample / count))
    x = np.array([r["x"] for r in few.orderBy(F.xxhash64("id"), "id").limit(sample).select("x").collect()])
    centres = np.unique(x[:wanted], axis=0)
    for _ in range(rounds):
        own = squares(x, centres).argmin(1)
        n = np.bincount(own, minlength=len(centres))
        total = np.zeros_like(centres)
        np.add.at(total, own, x)
        centres = np.unique(np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], centres), axis=0)
    return centres


@dataclass
class Blocks:
    """Pivots and the shells of their cells: bounded by ``PIVOTS`` times ``SHELLS`` rows."""

    pivots: np.ndarray
    cell: np.ndarray
    shell: np.ndarray
    low: np.ndarray
    high: np.ndarray
    cuts: np.ndarray
    between: np.ndarray = field(default=None, repr=False)

    def nearest(self, x: np.ndarray, own: np.ndarray) -> np.ndarray:
        """Least distance that a point of each block can have from each of ``x``, whose own cells are given."""
        square = np.maximum(squares(x, self.pivots), 0)
        far = np.sqrt(square)
        # What the matrix product may have rounded away.
        slack = 1e-6 * (1 + np.sqrt((x**2).sum(1)))[:, None]
        away = far[:, self.cell]
        shell = np.maximum(away - self.high, self.low - away)
        plane = (square - np.take_along_axis(square, own[:, None], 1)) / (2 * np.maximum(self._between()[own], 1e-3 * slack))
        return np.maximum(np.maximum(shell, plane[:, self.cell]) - slack, 0)

    def _between(self) -> np.ndarray:
        if self.between is None:
            self.between = np.sqrt(np.maximum(squares(self.pivots, self.pivots), 0))
        return self.between


def cut_blocks(points: DataFrame, block_rows: int) -> tuple[Blocks, DataFrame]:
    """The blocks and the written points, numbered, with their place: (no, id, x, cell, shell, cut)."""
    count = points.count()
    pivots = choose_pivots(points, count, int(min(PIVOTS, max(1, 2 * count // block_rows))))

    def place(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in it:
            if len(b):
                x = np.vstack(b["x"].to_numpy())
                b["cell"] = squares(x, pivots).argmin(1).astype(np.int32)
                b["r"] = np.sqrt(((x - pivots[b["cell"].to_numpy()]) ** 2).sum(1))
                yield b

    placed = points.select("id", "x").mapInPandas(place, "id bigint, x array<double>, cell int, r double")
    placed = materialise(placed, "cells")
    steps = ", ".join(f"{j / SHELLS}D" for j in range(1, SHELLS))
    cells = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.expr(f"percentile_approx(r, array({steps}), 1000)").alias("r"))
    # One row per pivot.
    edges = {r["cell"]: sorted(set(r["r"][SHELLS * j // s - 1] for j in range(1, s))) for r in cells.where(F.col("n") > block_rows).collect()
             for s in [min(SHELLS, -(-r["n"] // block_rows))]}

    def shells(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in it:
            b["shell"] = np.array([np.searchsorted(edges.get(c, ()), r, "left") for c, r in zip(b["cell"], b["r"])], np.int32)
            yield b

    shelled = placed.mapInPandas(shells, "id bigint, x array<double>, cell int, r double, shell int") if edges else placed.withColumn("shell", F.lit(0))
    sizes = shelled.groupBy("cell", "shell").agg(
        F.min("r").alias("low"), F.max("r").alias("high"), F.ceil(F.count(F.lit(1)) / F.lit(block_rows)).cast("int").alias("cuts")
    )
    sizes = materialise(sizes, "shells")
    rows = sizes.orderBy("cell", "shell").collect()
    columns = [np.array([r[c] for r in rows]) for c in ("cell", "shell", "low", "high", "cuts")]
    cut = F.pmod(F.xxhash64("id"), F.col("cuts")).cast("int")
    # One row per shell, at most ``PIVOTS`` times ``SHELLS``.
    blocks = shelled.join(F.broadcast(sizes.select("cell", "shell", "cuts")), ["cell", "shell"])
    # Keys may repeat or be missing: a number of its own tells a point from others.
    blocks = materialise(blocks.select(F.monotonically_increasing_id().alias("no"), "id", "x", "cell", "shell", cut.alias("cut")), "blocks")
    return Blocks(pivots, *columns), blocks


PLACE = ("cell", "shell", "cut")


def trips(bounded: DataFrame, blocks: Blocks, first: int | None, k: int) -> DataFrame:
    """(no, id, bound, cell, shell, cut): the blocks that points with a bound go to, other than their own.

    ``first`` chooses the most promising ones; None all others that the bound cannot rule out.  Rows of ``bounded``
    have (no, id, x, cell, shell, cut, bound, before): before is the bound by which the promising ones were chosen.
    """
    # Several matrices of points by blocks; a point may go to every block.
    step = max(1, VISIT_NUMBERS // 4 // max(1, int(blocks.cuts.sum())))

    def visits(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in it:
            for s in range(0, len(whole), step):
                b = whole.iloc[s : s + step]
                least = blocks.nearest(np.vstack(b["x"].to_numpy()), b["cell"].to_numpy())
                own = (blocks.cell == b["cell"].to_numpy()[:, None]) & (blocks.shell == b["shell"].to_numpy()[:, None])
                # All cuts of the own shell but the own one are visited in the first round.
                least[own] = 0
                chosen = least <= b["before"].to_numpy()[:, None]
                rank = np.argsort(np.argsort(np.where(own, -1.0, least), axis=1, kind="stable"), axis=1)
                promising = chosen & (rank <= PROMISING)
                go = promising if first is not None else (least <= b["bound"].to_numpy()[:, None]) & ~promising
                which, block = np.nonzero(go)
                times = blocks.cuts[block]
                which, block = np.repeat(which, times), np.repeat(block, times)
                cut = np.arange(len(which)) - np.repeat(np.cumsum(times) - times, times)
                out = b.drop(columns=["x", "before", *PLACE]).iloc[which].assign(cell=blocks.cell[block], shell=blocks.shell[block], cut=cut)
                at_home = (out["cell"].to_numpy() == b["cell"].to_numpy()[which]) & (out["shell"].to_numpy() == b["shell"].to_numpy()[which])
                out = out[~(at_home & (cut == b["cut"].to_numpy()[which]))]
                piece = max(1, VISIT_NUMBERS // (len(b["x"].iloc[0]) + 1))
                for at in range(0, len(out), piece):
                    yield out.iloc[at : at + piece]

    rows = bounded.select("no", "id", "x", *PLACE, "bound", "before")
    return rows.mapInPandas(visits, "no bigint, id bigint, bound double, cell int, shell int, cut int")


def _away(visiting: DataFrame, points: DataFrame, blocks: DataFrame, k: int) -> DataFrame:
    """Candidates of some visits, whose ``points`` are (no, x)."""
    # A popular block receives its visitors in slices, each with a copy of the block.
    slices = visiting.groupBy(*PLACE).agg(F.ceil(F.count(F.lit(1)) / F.lit(VISITOR_ROWS)).cast("int").alias("slices"))
    visitors = visiting.join(slices, [*PLACE]).withColumn("slice", F.pmod(F.xxhash64("id", F.lit(7)), F.col("slices")).cast("int"))
    visitors = visitors.join(points, "no").select("id", "x", "bound", *PLACE, "slice")
    hosts = blocks.join(slices, [*PLACE]).select(
        *[F.col(c).alias(c) for c in ("id", "x", *PLACE)], F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice")
    )

    def visit(v: pd.DataFrame, h: pd.DataFrame) -> pd.DataFrame:
        if v.empty or h.empty:
            return pd.DataFrame({"id": [], "neighbour": [], "distance": []})
        return block_candidates(v, h, k)

    at = [*PLACE, "slice"]
    return visitors.groupBy(*at).cogroup(hosts.groupBy(*at)).applyInPandas(visit, CANDIDATE)


def nearest_points(points: DataFrame, k: int = 5, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(id, near): the k nearest other points of each distinct point, as (distance, neighbour), nearest
    first.  ``points`` has (id, x) and should be cheap to scan."""
    if points.isEmpty():
        return points.select("id", F.array().cast("array<struct<distance:double,neighbour:bigint>>").alias("near"))
    blocks, rows = cut_blocks(points, block_rows)
    width = blocks.pivots.shape[1]
    infinite = float("inf")

    def best(found: DataFrame) -> DataFrame:
        # Candidates per point: at most k from each visit.
        ordered = F.array_sort(F.collect_list(F.struct("distance", "neighbour")))
        return found.groupBy("id").agg(F.slice(ordered, 1, k).alias("near"))

    def bound(near: DataFrame) -> DataFrame:
        # Fewer than k points so far: no bound yet.  The slack covers rounding.
        last = F.get("near", F.lit(k - 1))["distance"]
        return near.select("id", F.coalesce(last * (1 + 1e-9) + 1e-12, F.lit(infinite)).alias("bound"))

    own = rows.withColumn("bound", F.lit(infinite)).groupBy(*PLACE).applyInPandas(lambda b: block_candidates(b, b, k), CANDIDATE)
    found = materialise(best(own), "near")
    if len(blocks.cell) == 1 and blocks.cuts[0] == 1:
        return found
    start = rows.join(bound(found).withColumnRenamed("bound", "before"), "id", "left")
    start = start.withColumn("before", F.coalesce("before", F.lit(infinite)))
    for first in (PROMISING, None):
        now = start.join(bound(found), "id", "left").withColumn("bound", F.coalesce("bound", F.lit(infinite)))
        visits = materialise(trips(now, blocks, first, k), "visits")
        parts, met = max(1, -(-visits.count() * width * 8 // MOVED)), []
        for r in range(parts):
            mine = F.pmod(F.xxhash64("id", F.lit(11)), F.lit(parts)) == r
            of = rows.where(mine).select("no", "x")
            away = _away(visits.where(mine), of, rows, k)
            met.append(materialise(best(found.where(mine).select("id", F.inline("near")).unionByName(away)), "near"))
        found = reduce(DataFrame.unionByName, met)
        if len(blocks.cell) <= PROMISING + 1:
            break
    return found
