"""Splits, folds, weights.  All are functions of the row's key, so they do not depend on partitioning
and come out the same after a lost executor."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ardoise.functions.exprs import hash_bucket

# Share of the training part in percent, folds and repeats of cross-validation.
TRAIN_PERCENT = 80
FOLDS = 5
REPEATS = 1


def add_split(df: DataFrame, key: str, percent: int = TRAIN_PERCENT, output: str = "part") -> DataFrame:
    """Column saying ``train`` or ``valid``, by a hash of the key."""
    chosen = hash_bucket(key, 100) < percent
    return df.withColumn(output, F.when(chosen, F.lit("train")).otherwise(F.lit("valid")))


def split(df: DataFrame, key: str, percent: int = TRAIN_PERCENT) -> tuple[DataFrame, DataFrame]:
    chosen = hash_bucket(key, 100) < percent
    return df.where(chosen), df.where(~chosen)


def stratified_folds(
    df: DataFrame,
    label: str,
    key: str,
    folds: int = FOLDS,
    repeat: int = 0,
    output: str = "fold",
    buckets: int = 4096,
) -> DataFrame:
    """Fold 0..folds-1 of each row; within each class the fold sizes differ by at most one.

    Rows are numbered per class in hash order and dealt out in turn.  A class may hold nearly all rows,
    so it is cut by the leading hash digits first: each (class, bucket) is numbered on its own and starts
    where the buckets before it end.
    """
    order = F.md5(F.concat_ws("|", F.col(key).cast("string"), F.lit(str(repeat))))
    rows = df.withColumn("_h", order).withColumn(
        "_b", (F.conv(F.substring("_h", 1, 4), 16, 10).cast("int") * F.lit(buckets) / F.lit(65536)).cast("int")
    )
    # As text, so that rows without a class are a class too.
    rows = rows.withColumn("_l", F.coalesce(F.col(label).cast("string"), F.lit("")))
    sizes = rows.groupBy("_l", "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("_l").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_l", "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("_l", "_b").orderBy("_h", key)
    numbered = rows.withColumn("_i", F.row_number().over(inside) - 1)
    # Both sides are already laid out by (label, bucket).
    joined = numbered.join(starts, ["_l", "_b"])
    fold = ((F.col("_start") + F.col("_i")) % F.lit(folds)).cast("int")
    return joined.select(*df.columns, fold.alias(output))


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """(label, n, weight) with weight = rows / (classes * rows of the class).  Rows without a label count for
    no class."""
    counts = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").cast("double").alias("t"), F.count(F.lit(1)).alias("k"))
    both = total.select(F.struct("t", "k")).scalar()
    return counts.withColumn("weight", both["t"] / (both["k"] * F.col("n")))


def add_class_weights(df: DataFrame, label: str, output: str = "weight") -> DataFrame:
    """Attach the balanced weight of the row's class; NULL for a row without a label."""
    rows = {r[label]: r["weight"] for r in class_weights(df, label).collect()}
    pairs = [F.lit(x) for value, weight in rows.items() for x in (value, weight)]
    weight = F.create_map(*pairs)[F.col(label)] if pairs else F.lit(None).cast("double")
    return df.withColumn(output, F.when(F.col(label).isNotNull(), weight))


def pick_row(df: DataFrame, key: str) -> DataFrame:
    """One arbitrary but reproducible row: the one whose key has the smallest hash."""
    return df.orderBy(F.md5(F.col(key).cast("string")), key).limit(1)
