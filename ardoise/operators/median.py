"""Exact medians of many columns at once, without holding a column in one task.

``median`` keeps every distinct value of a column in one buffer.  Here a sketch narrows each column to a
bracket that surely holds the middle ranks (this is checked), and only values inside the bracket travel.

Both passes take the columns as arrays.  A sketch is evenly spaced values of the sorted rows of a task; those of a
column meet in a group of its own, so no task merges the sketches of all columns.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ardoise.functions.aggspec import quoted

BRACKET_VALUES = 50_000
#: Values of a sketch, at least; and how many times as many a task holds before it thins them.
LEAST_ACCURACY, PIECES = 1_000, 16
SKETCH_NAMES = ["i", "n", "low", "high", "v", "w"]
SKETCH_TYPES = [pa.int32(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.float64()), pa.list_(pa.float64())]
INFINITE = float("inf")


def double_literal(x: float) -> str:
    names = {INFINITE: "Infinity", -INFINITE: "-Infinity"}
    return f"double('{names.get(x, repr(float(x)))}')"


@dataclass
class ColumnStats:
    """First look at a column: filled rows, extremes, bracket around the middle."""

    filled: int
    low: float | None
    high: float | None
    bracket: tuple[float, float] | None


def accuracy_for(rows: int) -> int:
    return int(min(1_000_000, max(LEAST_ACCURACY, rows // BRACKET_VALUES)))


def _values(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The columns as doubles, named by their place."""
    return df.selectExpr(*[f"cast({quoted(c)} as double) as c{i}" for i, c in enumerate(columns)])


def _sorted(cells: pa.Array) -> np.ndarray:
    """Values that are there in Spark's order: NaN is the largest."""
    return np.sort(cells.drop_null().to_numpy(zero_copy_only=False))


def _thinned(values: np.ndarray, weights: np.ndarray, points: int) -> tuple[np.ndarray, np.ndarray]:
    """At most ``points`` of the ascending weighted values, evenly spaced by rank: ranks move by half a space at most."""
    if len(values) <= points:
        return values, weights
    upto = np.cumsum(weights)
    space = upto[-1] / points
    at = np.searchsorted(upto, (np.arange(points) + 0.5) * space)
    return values[at], np.full(points, space)


def _merged(pieces: Sequence[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    values, weights = (np.concatenate(x) for x in zip(*pieces))
    order = np.argsort(values, kind="stable")
    return values[order], weights[order]


def column_stats(df: DataFrame, columns: Sequence[str], accuracy: int = LEAST_ACCURACY, widen: int = 1) -> dict[str, ColumnStats]:
    """One pass over the table for all columns.  Ranks in the sketch are off by less than a share ``2 / accuracy``."""
    delta = min(0.5, 2.0 * widen / accuracy)

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            for i, cells in enumerate(batch.columns):
                x = _sorted(cells)
                if not len(x):
                    continue
                filled, low, high, pieces, size = held.get(i, (0, x[0], x[-1], [], 0))
                # NaN is larger than any number.
                low, high = np.fmin(low, x[0]), np.maximum(high, x[-1])
                pieces.append(_thinned(x, np.ones(len(x)), accuracy))
                size += len(pieces[-1][0])
                if size > PIECES * accuracy:
                    pieces = [_thinned(*_merged(pieces), PIECES * accuracy // 2)]
                    size = len(pieces[0][0])
                held[i] = (filled + len(x), low, high, pieces, size)
        for i, (filled, low, high, pieces, _) in held.items():
            values, weights = _thinned(*_merged(pieces), accuracy)
            cells = [[i], [filled], [low], [high], [values], [weights]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cells, SKETCH_TYPES)], names=SKETCH_NAMES)

    def bracket(pieces: pa.Table) -> pa.Table:
        i, n, low, high, values, weights = (pieces[c].combine_chunks() for c in SKETCH_NAMES)
        values, weights = _merged([(values.flatten().to_numpy(), weights.flatten().to_numpy())])
        upto = np.cumsum(weights)
        a, b = values[np.minimum(np.searchsorted(upto, np.array([0.5 - delta, 0.5 + delta]) * upto[-1]), len(values) - 1)]
        found = [i[0].as_py(), n.to_numpy().sum(), np.fmin.reduce(low.to_numpy()), np.maximum.reduce(high.to_numpy()), a, b]
        types = [*SKETCH_TYPES[:4], pa.float64(), pa.float64()]
        return pa.table([pa.array([x], t) for x, t in zip(found, types)], names=[*SKETCH_NAMES[:4], "a", "b"])

    pieces = _values(df, columns).mapInArrow(sketch, "i int, n bigint, low double, high double, v array<double>, w array<double>")
    found = pieces.groupBy("i").applyInArrow(bracket, "i int, n bigint, low double, high double, a double, b double")
    # One row per column.
    rows = {r["i"]: r for r in found.collect()}
    stats = {}
    for i, c in enumerate(columns):
        r = rows.get(i)
        stats[c] = ColumnStats(0, None, None, None) if r is None else ColumnStats(r["n"], r["low"], r["high"], (r["a"], r["b"]))
    return stats


def exact_medians(
    df: DataFrame, columns: Sequence[str], stats: Mapping[str, ColumnStats] | None = None, accuracy: int | None = None
) -> dict[str, float | None]:
    """Median of each column (mean of the two middle values for an even count); None when all are missing.

    Missing values are NULL; infinite ones must be cleared before.  ``stats`` from an earlier pass saves one.
    """
    columns = list(columns)
    if not columns:
        return {}
    if accuracy is None:
        accuracy = accuracy_for(df.count()) if stats is None else LEAST_ACCURACY
    if stats is None:
        stats = column_stats(df, columns, accuracy)
    result: dict[str, float | None] = {c: None for c in columns if stats[c].filled == 0}
    brackets = {c: stats[c].bracket for c in columns if c not in result}
    widen = 1
    while brackets:
        result.update(_middle_values(df, {c: (stats[c].filled, *b) for c, b in brackets.items()}))
        missed = [c for c in brackets if c not in result]
        widen *= 10
        if widen <= accuracy:
            again = column_stats(df, missed, accuracy, widen) if missed else {}
            brackets = {c: again[c].bracket for c in missed}
        else:
            brackets = {c: (-INFINITE, INFINITE) for c in missed}
    return {c: result[c] for c in columns}


def _middle_values(df: DataFrame, brackets: Mapping[str, tuple[int, float, float]]) -> dict[str, float]:
    """Medians of the columns whose bracket holds the middle ranks.

    One pass: of each column the number of values below its bracket travels, and the values in it with their counts.
    Where both ends are equal, as for flags and mostly-zero columns, that is one value.
    """
    names = list(brackets)
    ends = [brackets[c][1:] for c in names]

    def inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for i, (cells, (low, high)) in enumerate(zip(batch.columns, ends)):
                x = _sorted(cells)
                first, last = np.searchsorted(x, low), np.searchsorted(x, high, "right")
                values, counts = np.unique(x[first:last], return_counts=True)
                # The values below the bracket are a row without a value, which comes first.
                made.append((np.full(len(values) + 1, i), np.append(0.0, values), np.append(first, counts), np.arange(len(values) + 1) == 0))
            at, values, counts, below = (np.concatenate(x) for x in zip(*made))
            cells = [pa.array(at, pa.int32()), pa.array(values, pa.float64(), mask=below), pa.array(counts, pa.int64())]
            yield pa.RecordBatch.from_arrays(cells, names=["i", "v", "k"])

    counts = _values(df, names).mapInArrow(inside, "i int, v double, k bigint").groupBy("i", "v").agg(F.sum("k").alias("k"))
    # A bracket holds a fixed small share of the ranks, so one column's window is bounded.
    upto = F.sum("k").over(Window.partitionBy("i").orderBy(F.asc_nulls_first("v")).rowsBetween(Window.unboundedPreceding, 0))
    ranks = df.sparkSession.createDataFrame(
        [(i, (brackets[c][0] - 1) // 2, brackets[c][0] // 2) for i, c in enumerate(names)], "i int, lo bigint, hi bigint"
    )
    placed = counts.select("i", "v", "k", upto.alias("u")).where("v is not null").join(F.broadcast(ranks), "i")
    last = F.col("u") - 1
    start = last - F.col("k") + 1

    def at(rank: str):
        return F.max(F.when((start <= F.col(rank)) & (F.col(rank) <= last), F.col("v")))

    rows = placed.groupBy("i").agg(at("lo").alias("lo"), at("hi").alias("hi")).collect()
    return {names[r["i"]]: (r["lo"] + r["hi"]) / 2.0 for r in rows if r["lo"] is not None and r["hi"] is not None}
