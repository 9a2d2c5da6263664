"""Connected components by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ardoise.sources.workdir import materialise


def _written(edges: DataFrame) -> tuple[DataFrame, tuple]:
    out = materialise(edges.distinct(), "edges")
    row = out.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return out, tuple(row)


def components(edges: DataFrame) -> DataFrame:
    """``id`` and ``component``, its smallest reachable id, for all ids of the edges ``a, b`` but the smallest.

    Each round hangs every node's larger neighbours, then its smaller ones, below the smallest it knows.  The
    smallest neighbour is an aggregate with map-side partials that is joined back, so a node with very many
    neighbours is split like any skewed join.  The rounds are written tables.
    """
    now, state = _written(
        edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    )
    while state[0]:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = materialise(large.distinct(), "edges")
        smallest = large.groupBy("a").agg(F.min("b").alias("m"))
        down = large.join(smallest, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b")
        now, new = _written(down.unionByName(smallest.select("a", F.col("m").alias("b"))))
        if new == state:
            break
        state = new
    return now.select(F.col("a").alias("id"), F.col("b").alias("component"))
