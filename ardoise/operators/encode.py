"""Categories to columns.  A list of categories is discovered once, frozen, and applied everywhere, so
that every dataset gets the same columns in the same order."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ardoise.functions.aggspec import dummy_columns, dummy_name
from ardoise.operators.ranges import running_totals
from ardoise.operators.skew import lookup_join

Categories = dict[str, list]


def columns_of_type(df: DataFrame, kind: type[T.DataType]) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, kind)]


def categorical_columns(df: DataFrame) -> list[str]:
    return columns_of_type(df, T.StringType)


def numeric_columns(df: DataFrame) -> list[str]:
    return columns_of_type(df, T.NumericType)


def category_pairs(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Distinct (column, value) pairs of all given columns, in one pass with map-side distinct."""
    if len(columns) == 1:
        pairs = df.select(F.lit(columns[0]).alias("column"), F.col(columns[0]).alias("value"))
    else:
        cells = [F.struct(F.lit(c).alias("column"), F.col(c).alias("value")) for c in columns]
        pairs = df.select(F.inline(F.array(*cells)))
    return pairs.where("value is not null").distinct()


def discover_categories(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    nan_category: bool = True,
    max_categories: int | None = None,
) -> Categories:
    """Sorted categories per column.  With ``nan_category`` each list ends with ``None``, the category of
    missing values, whether or not any value is missing.

    Each category becomes a column of a plan.  A caller who wants to be told when that gets too wide gives
    ``max_categories``: more are an error, never cut.
    """
    columns = categorical_columns(df) if columns is None else list(columns)
    found: Categories = {c: [] for c in columns}
    if columns:
        pairs = category_pairs(df, columns)
        rows = (pairs if max_categories is None else pairs.limit(max_categories + 1)).collect()
        if max_categories is not None and len(rows) > max_categories:
            raise ValueError(
                f"more than {max_categories} categories in {columns}: one column each is too wide; "
                "leave such columns out or raise max_categories"
            )
        for r in rows:
            found[r["column"]].append(r["value"])
    return {c: sorted(v) + ([None] if nan_category else []) for c, v in found.items()}


def dummy_names(categories: Mapping[str, Iterable]) -> list[str]:
    return [dummy_name(c, v) for c, values in categories.items() for v in values]


def one_hot(
    df: DataFrame, categories: Mapping[str, Iterable] | None = None, nan_category: bool = True
) -> tuple[DataFrame, list[str]]:
    """Replace the categorical columns by 0/1 columns, appended in category order; returns the new names.

    Without the missing category, a missing value is zero in every column of its field.
    """
    categories = discover_categories(df, nan_category=nan_category) if categories is None else categories
    kept = [F.col(c) for c in df.columns if c not in categories]
    return df.select(*kept, *dummy_columns(categories)), dummy_names(categories)


def factorize_fit(df: DataFrame, column: str, order: str) -> DataFrame:
    """Code table (value, code): codes count up in the order of first appearance by ``order``.

    The numbering is a window over the distinct values only.  These are cut into ranges of the ordering
    first, so no task numbers more than its range.
    """
    first = (
        df.where(F.col(column).isNotNull())
        .groupBy(F.col(column).alias("value"))
        .agg(F.min(order).alias("_first"))
    )
    numbered = running_totals(first.withColumn("_one", F.lit(1)), "_first", ["_one"])
    return numbered.select("value", (F.col("_one_upto") - 1).cast("int").alias("code"))


def factorize_apply(df: DataFrame, column: str, codes: DataFrame, output: str | None = None) -> DataFrame:
    """Replace the values by their codes; missing and unknown values become -1."""
    output = output or column
    named = codes.select(F.col("value").alias(column), F.col("code").alias("_code"))
    joined = lookup_join(df, named, [column])
    coded = F.coalesce(F.col("_code"), F.lit(-1))
    if output == column:
        return joined.select(*[coded.alias(c) if c == column else F.col(c) for c in df.columns])
    return joined.select(*df.columns, coded.alias(output))


def column_alignment(train: Sequence[str], other: Sequence[str]) -> list[tuple[str, str]]:
    """(column, action) for every column of either side: ``common``, ``add`` (only in train, filled with
    0) or ``ignore`` (unknown to train); sorted by name."""
    a, b = set(train), set(other)
    return [
        (c, "common" if c in a and c in b else "add" if c in a else "ignore") for c in sorted(a | b)
    ]


def align(df: DataFrame, columns: Sequence[str], optional: Sequence[str] = ()) -> DataFrame:
    """The given columns in the given order; absent ones are 0, absent ``optional`` ones are left out."""
    have = set(df.columns)
    return df.select(
        *[F.col(c) if c in have else F.lit(0).alias(c) for c in columns if c in have or c not in optional]
    )
