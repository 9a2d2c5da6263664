"""Running totals and ranks over a whole table without a one-task window.

The rows are cut into ranges of the ordering column at boundaries taken from its quantiles.  Totals per
range are few and get a plain running sum; within a range an ordinary window does the rest.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ROWS_PER_RANGE = 50_000


def range_bounds(df: DataFrame, column: str, ranges: int | None = None) -> list[float]:
    """Increasing boundaries that cut the rows into about equal parts; constants, so that every later
    pass puts a row in the same range."""
    if ranges is None:
        ranges = df.count() // ROWS_PER_RANGE + 1
    if ranges <= 1:
        return []
    steps = [i / ranges for i in range(1, ranges)]
    return sorted(set(df.approxQuantile(column, steps, 1.0 / (4 * ranges))))


def with_range(df: DataFrame, column: str, bounds: Sequence[float], output: str = "_range") -> DataFrame:
    """Add the number of the range a value lies in: how many boundaries are at or below it."""
    if not bounds:
        return df.withColumn(output, F.lit(0.0))
    splits = [float("-inf"), *bounds, float("inf")]
    return Bucketizer(splits=splits, inputCol=column, outputCol=output).transform(df)


def running_totals(
    df: DataFrame,
    order: str,
    values: Sequence[str],
    by: Sequence[str] = (),
    ranges: int | None = None,
) -> DataFrame:
    """Add ``<value>_upto``: the sum of the value over all rows up to and with this one, in ``order``,
    separately for each ``by`` group.  ``order`` must be unique within a group (aggregate by it first).
    """
    by = list(by)
    bounds = range_bounds(df, order, ranges)
    cut = with_range(df, order, bounds)
    inside = Window.partitionBy(*by, "_range").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    local = cut.withColumns({f"{v}_upto": F.sum(v).over(inside) for v in values})
    if not bounds:
        return local.drop("_range")
    totals = cut.groupBy(*by, "_range").agg(*[F.sum(v).alias(f"_t_{v}") for v in values])
    before = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *by, "_range", *[F.coalesce(F.sum(f"_t_{v}").over(before), F.lit(0)).alias(f"_b_{v}") for v in values]
    )
    joined = local.join(offsets, [*by, "_range"])
    return joined.select(
        *df.columns, *[(F.col(f"{v}_upto") + F.col(f"_b_{v}")).alias(f"{v}_upto") for v in values]
    )
