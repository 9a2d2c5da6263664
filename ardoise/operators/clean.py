"""Cleaning of a wide numeric table.  Statistics are fitted on the training rows once and frozen in a
``Preparation``; applying it is a single projection."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ardoise.functions.aggspec import literal, quoted
from ardoise.operators.median import accuracy_for, column_stats, double_literal, exact_medians

# Columns that are never features.
NOT_FEATURES = ("TARGET", "SK_ID_CURR", "SK_ID_BUREAU", "SK_ID_PREV", "index")
# Fixed value: features filled in less than this percentage of the training rows are dropped.
FILL_LIMIT = 80


def feature_columns(df: DataFrame | Sequence[str], exclude: Sequence[str] = NOT_FEATURES) -> list[str]:
    columns = df.columns if isinstance(df, DataFrame) else df
    return [c for c in columns if c not in exclude]


def finite_sql(column: str) -> str:
    v = f"cast({quoted(column)} as double)"
    return f"case when abs({v}) < double('Infinity') then {v} end"


def clear_infinite(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Infinite values and NaN become missing, all columns in one projection."""
    chosen = set(columns)
    return df.selectExpr(*[f"{finite_sql(c) if c in chosen else quoted(c)} as {quoted(c)}" for c in df.columns])


def long_counts(df: DataFrame, aggregates: Mapping[str, Mapping[str, str]], key: str = "column") -> DataFrame:
    """One pass over the table, then one row per column: ``aggregates[column][measure]`` is SQL."""
    cells = [
        f"named_struct({', '.join([literal(key), literal(c), *[x for n, m in measures.items() for x in (literal(n), m)]])})"
        for c, measures in aggregates.items()
    ]
    return df.agg(F.expr(f"array({', '.join(cells)}) as _all")).select(F.inline("_all"))


def finite_check(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Counts of infinite, NaN and missing values per column: three separate answers."""
    measures = {}
    for c in columns:
        v = f"cast({quoted(c)} as double)"
        measures[c] = {
            "n_inf": f"count_if(abs({v}) = double('Infinity'))",
            "n_nan": f"count_if(isnan({v}))",
            "n_null": f"count_if({v} is null)",
        }
    return long_counts(df, measures)


def fill_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, n_rows, n_filled) for every column, from one aggregate."""
    return long_counts(df, {c: {"n_rows": "count(1)", "n_filled": f"count({quoted(c)})"} for c in columns})


def sparse_columns(fill: DataFrame, limit: int = FILL_LIMIT) -> DataFrame:
    """Columns to drop: filled in less than ``limit`` percent of the rows (in whole numbers)."""
    return fill.where(F.col("n_filled") * F.lit(100) < F.lit(limit) * F.col("n_rows"))


def filled_sql(value: str, fill: float | None) -> str:
    return value if fill is None else f"coalesce({value}, {double_literal(fill)})"


def impute(df: DataFrame, values: Mapping[str, float | None]) -> DataFrame:
    return df.selectExpr(*[f"{filled_sql(quoted(c), values.get(c))} as {quoted(c)}" for c in df.columns])


def scaled_sql(value: str, low: float, high: float) -> str:
    """Min-max scaling with the given range; a constant column is only shifted.  Nothing is clipped."""
    width = high - low
    return f"({value} - {double_literal(low)}) / {double_literal(width if width != 0.0 else 1.0)}"


def minmax_scale(df: DataFrame, ranges: Mapping[str, tuple[float, float]]) -> DataFrame:
    return df.selectExpr(
        *[f"{scaled_sql(quoted(c), *ranges[c]) if c in ranges else quoted(c)} as {quoted(c)}" for c in df.columns]
    )


@dataclass
class Preparation:
    """Frozen result of fitting on the training rows."""

    features: list[str]
    dropped: list[str]
    medians: dict[str, float]
    ranges: dict[str, tuple[float, float]]
    rows: int = 0
    fill: dict[str, int] = field(default_factory=dict)

    def clean(self, df: DataFrame, medians: Mapping[str, float] | None = None) -> DataFrame:
        """Keys, then the kept features in frozen order, without infinite or missing values."""
        keys = [quoted(c) for c in df.columns if c in NOT_FEATURES]
        values = self.medians if medians is None else {**self.medians, **medians}
        have = set(df.columns)
        return df.selectExpr(
            *keys,
            *[f"{filled_sql(finite_sql(c), values[c]) if c in have else '0d'} as {quoted(c)}" for c in self.features],
        )

    def scale(self, df: DataFrame) -> DataFrame:
        return minmax_scale(df, self.ranges)

    def apply(self, df: DataFrame, scaled: bool = True) -> DataFrame:
        out = self.clean(df)
        return self.scale(out) if scaled else out

    def save(self, spark: SparkSession, path: str) -> None:
        """One JSON record; Spark writes it, so any shared file system will do."""
        spark.createDataFrame([(json.dumps(asdict(self)),)], "value string").coalesce(1).write.mode(
            "overwrite"
        ).text(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Preparation:
        record = json.loads(spark.read.text(path).first()["value"])
        record["ranges"] = {c: tuple(r) for c, r in record["ranges"].items()}
        return cls(**record)


def fit_preparation(train: DataFrame, features: Sequence[str] | None = None, limit: int = FILL_LIMIT) -> Preparation:
    """Fit on the training rows: which features to keep, their medians and their ranges.

    Three passes: counts, extremes and brackets of the medians; counts below the brackets; the values in
    them.  Give it a table that is cheap to scan (written or cached).
    """
    features = feature_columns(train) if features is None else list(features)
    cleared = clear_infinite(train.select(*[quoted(c) for c in features]), features)
    rows = train.count()
    accuracy = accuracy_for(rows)
    stats = column_stats(cleared, features, accuracy)
    kept = [c for c in features if stats[c].filled * 100 >= limit * rows and stats[c].filled > 0]
    medians = exact_medians(cleared, kept, stats, accuracy)
    # A median lies between the extremes, so filling with it does not move them.
    ranges = {c: (stats[c].low, stats[c].high) for c in kept}
    fill = {c: stats[c].filled for c in features}
    return Preparation(kept, [c for c in features if c not in set(kept)], medians, ranges, rows, fill)
