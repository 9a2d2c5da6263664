"""Data-quality profile and share reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ardoise.functions.aggspec import literal, quoted
from ardoise.functions.exprs import truncate_percent
from ardoise.operators.clean import fill_counts
from ardoise.operators.skew import BROADCAST_ROWS


def profile_columns(df: DataFrame) -> DataFrame:
    """Per column: type, rows, filled and missing cells, fill percentage (cut to whole percent)."""
    types = F.expr("map(" + ", ".join(x for c, t in df.dtypes for x in (literal(c), literal(t))) + ")")
    fill = fill_counts(df, df.columns)
    return fill.select(
        "column",
        types[F.col("column")].alias("data_type"),
        "n_rows",
        "n_filled",
        (F.col("n_rows") - F.col("n_filled")).alias("n_missing"),
        truncate_percent("n_filled", "n_rows").alias("fill_pct"),
    )


def row_fill_percent(columns: Sequence[str]) -> Column:
    """Fill percentage of one row over the given columns."""
    filled = F.expr(" + ".join(f"cast({quoted(c)} is not null as int)" for c in columns))
    return truncate_percent(filled, F.lit(len(columns)))


def profile_summary(df: DataFrame) -> DataFrame:
    """Rows, columns, missing cells, all cells, percentage missing: one row."""
    fill = fill_counts(df, df.columns)
    total = fill.agg(
        F.max("n_rows").alias("n_rows"),
        F.count(F.lit(1)).alias("n_columns"),
        F.sum(F.col("n_rows") - F.col("n_filled")).alias("n_missing"),
        F.sum("n_rows").alias("n_cells"),
    )
    share = F.try_divide(F.col("n_missing").cast("double"), F.col("n_cells").cast("double"))
    return total.withColumn("missing_pct", F.round(share * 100, 3))


def profile_message(df: DataFrame, name: str) -> DataFrame:
    """The summary as the sentence a reader gets."""
    return profile_summary(df).select(
        F.format_string(
            "Le fichier %s comporte %d lignes et %d colonnes, ainsi que %d valeurs manquantes sur %d entrées (%s %%).",
            F.lit(name), "n_rows", "n_columns", "n_missing", "n_cells", F.col("missing_pct").cast("string"),
        ).alias("message")
    )


def duplicate_count(df: DataFrame) -> DataFrame:
    """Rows that repeat an earlier row; missing equals missing.

    Copies meet in map-side counts first, so even a row copied a billion times travels once per task.
    """
    copies = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_n"))
    return copies.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("n_rows"),
        F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("n_duplicates"),
    )


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Count per non-missing value, most frequent first."""
    return (
        df.where(F.col(column).isNotNull())
        .groupBy(F.col(column).alias("value"))
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), "value")
    )


def class_share(df: DataFrame, column: str, above: float = 0.0) -> DataFrame:
    """Count, share among non-missing rows and percentage of all rows, for values with a share above
    the limit."""
    counts = df.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    totals = counts.agg(
        F.sum("n").alias("a"), F.sum(F.when(F.col("value").isNotNull(), F.col("n"))).alias("f")
    ).select(F.struct("a", "f")).scalar()
    shares = counts.where(F.col("value").isNotNull()).select(
        "value",
        "n",
        (F.col("n") / totals["f"]).alias("share"),
        F.round(F.col("n") / totals["a"] * 100, 2).alias("pct_of_rows"),
    )
    return shares.where(F.col("share") > above).orderBy(F.desc("n"), "value")


def top_abs(df: DataFrame, value: str, n: int, name: str) -> DataFrame:
    """The n rows of largest absolute value, ranked; ties by name."""
    return df.orderBy(F.abs(F.col(value)).desc(), F.col(name)).limit(n)


def top_group_mean(df: DataFrame, name: str, value: str, n: int) -> DataFrame:
    """All rows of the n names with the largest mean value, and that mean."""
    means = df.groupBy(name).agg(F.avg(value).alias("mean_value"))
    best = means.orderBy(F.desc("mean_value"), name).limit(n)
    return df.join(F.broadcast(best) if n <= BROADCAST_ROWS else best, name)


def preview(df: DataFrame, key: str, n: int = 5) -> DataFrame:
    """The first n rows by key, the same ones at every call: each task keeps its n smallest."""
    return df.orderBy(key).limit(n)
