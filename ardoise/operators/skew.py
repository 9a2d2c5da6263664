"""Joins and groups that stay balanced when one key holds a large part of the rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ardoise.functions.aggspec import quoted

# A key is hot when it holds more than one in HOT_SHARE rows; there can be at most HOT_SHARE such keys.
HOT_SHARE = 500


# Values the sketch tracks per hot key sought: its error stays far below the share that makes a key hot.
TRACKED = 20


def hot_keys(df: DataFrame, key: str, share: int = HOT_SHARE) -> list:
    """Keys that hold more than ``1/share`` of the rows: at most ``share`` values, whatever the data;
    ``None`` among them when missing keys are that many.

    One scan of the key column into a frequent-items sketch of fixed size; no key is shuffled.  A wrong
    guess would cost time, never rows.
    """
    top = f"approx_top_k({quoted(key)}, {share}, {share * TRACKED})"
    row = df.agg(F.count(F.lit(1)).alias("n"), F.expr(f"{top} as top")).first()
    # A table of few rows has no skew worth a second join.
    floor = max(row["n"] / share, share)
    return [item["item"] for item in row["top"] or [] if item["count"] > floor]


def skew_join(left: DataFrame, right: DataFrame, key: str, how: str = "inner", share: int = HOT_SHARE,
              hot_in: DataFrame | None = None) -> DataFrame:
    """Equi-join of a large side with a side that is unique on ``key``.

    Rows of hot keys meet their few partners by broadcast, where they already lie; all other rows take
    the ordinary shuffle join.  Missing keys meet nothing; many of them stay out of the shuffle as well.
    No row is dropped, and the broadcast holds at most ``share`` rows.  ``hot_in`` is a table with the same keys that is
    cheaper to scan.
    """
    if how not in ("inner", "left"):
        raise ValueError("how must be 'inner' or 'left'")
    found = hot_keys(left if hot_in is None else hot_in, key, share)
    hot = [k for k in found if k is not None]
    if not found:
        return left.join(right, key, how)
    is_hot = F.col(key).isNull() if None in found else F.lit(False)
    if hot:
        is_hot = is_hot | F.coalesce(F.col(key).isin(hot), F.lit(False))
    partners = right.where(F.col(key).isin(hot)) if hot else right.limit(0)
    parts = [
        left.where(~is_hot).join(right, key, how),
        left.where(is_hot).join(F.broadcast(partners), key, how),
    ]
    return reduce(DataFrame.unionByName, parts)


def cool_and_hot(rows: DataFrame, key: str, hot: Sequence) -> tuple[DataFrame, DataFrame | None]:
    """Rows that have a key, those of ``hot`` keys apart; nothing apart where no key is hot."""
    rows, keys = rows.where(F.col(key).isNotNull()), [k for k in hot if k is not None]
    if not keys:
        return rows, None
    is_hot = F.col(key).isin(keys)
    return rows.where(~is_hot), rows.where(is_hot)


def skew_aggregate(rows: DataFrame, key: str, aggregates: Sequence[Column], hot_in: DataFrame | None = None,
                   hot: Sequence | None = None) -> DataFrame:
    """One row per key with many aggregates; rows without a key are left out.

    Hundreds of partial sums are larger than the few rows they stand for, so rows travel instead and are aggregated
    where they meet.  Rows of hot keys are reduced where they lie, to one row of partial sums per task.  ``hot_in`` is
    a table with the same rows per key that is cheaper to scan; ``hot`` the keys, where they are known.
    """
    if hot is None:
        hot = hot_keys(rows if hot_in is None else hot_in, key)
    few, many = cool_and_hot(rows, key, hot)
    out = few.repartition(key).groupBy(key).agg(*aggregates)
    return out if many is None else out.unionByName(many.groupBy(key).agg(*aggregates))


# Lookup tables up to this many rows are broadcast.
BROADCAST_ROWS = 100_000


def lookup_join(df: DataFrame, table: DataFrame, on: list[str], how: str = "left", hot_in: DataFrame | None = None) -> DataFrame:
    """Join with a lookup table that is unique on ``on``: broadcast when its counted size allows it.

    Beyond the bound the join shuffles; a single-column key then goes through ``skew_join``, with ``hot_in``.
    """
    rows = table.limit(BROADCAST_ROWS + 1).count()
    if rows <= BROADCAST_ROWS:
        return df.join(F.broadcast(table), on, how)
    if len(on) == 1:
        return skew_join(df, table, on[0], how, hot_in=hot_in)
    return df.join(table, on, how)
