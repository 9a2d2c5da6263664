"""Exact medians of a table that grows by deliveries: a new delivery is read once, of the earlier ones only the
values around the middle.

A delivery is kept as its distinct values with their numbers of rows, sorted by column and value and cut into
blocks of ``SIZE`` values, and beside them one row per block with its extremes and its number of rows.  The
blocks alone bound the rank of any value, so they tell between which two values the middle ranks lie; blocks
below are counted without being read, blocks that meet the bracket are read, and the ranks in them are exact.
A value that very many rows share is one row.

Missing, infinite and NaN values do not count; zero of either sign is one value.  A column without values has
no median.  A delivery of a number that is there already is written over, so a job that failed can be repeated;
the order of deliveries does not matter, and an empty one changes nothing.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ardoise.functions.aggspec import literal
from ardoise.operators.clean import finite_sql
from ardoise.operators.median import double_literal

#: Distinct values of a block: what a median reads of each column and delivery is a few of them.
SIZE = 10_000
#: Bytes of a row group, so that a bracket reads few of them.
ROW_GROUP = 8 << 20
VALUES = "name string, value double, k bigint, block bigint"
BLOCKS = "name string, block bigint, low double, high double, k bigint"


def add_delivery(df: DataFrame, columns: Sequence[str], path: str, delivery: int, size: int = SIZE) -> None:
    """Writes the state of one delivery below ``path``: a count with map-side partials and a sort by ranges."""
    cells = [f"named_struct('name', {literal(c)}, 'value', {finite_sql(c)} + 0d)" for c in columns]
    long = df.selectExpr(f"inline(array({', '.join(cells)}))").where("value is not null")
    counted = long.groupBy("name", "value").agg(F.count(F.lit(1)).alias("k"))
    ranged = counted.repartitionByRange("name", "value").sortWithinPartitions("name", "value")
    # The number of a row is its task's number and its place there; so is the number of a block.
    at, places = F.monotonically_increasing_id(), 1 << 33
    place = F.pmod(F.col("at"), F.lit(places))
    numbered = ranged.withColumn("at", at).select("name", "value", "k", (F.col("at") - F.pmod(place, F.lit(size))).alias("block"))
    here = f"{path}/values/delivery={delivery}"
    numbered.write.mode("overwrite").option("parquet.block.size", str(ROW_GROUP)).parquet(here)
    written = df.sparkSession.read.schema(VALUES).parquet(here)
    blocks = written.groupBy("name", "block").agg(F.min("value").alias("low"), F.max("value").alias("high"), F.sum("k").alias("k"))
    blocks.write.mode("overwrite").parquet(f"{path}/blocks/delivery={delivery}")


def _read(spark: SparkSession, path: str, what: str, schema: str) -> DataFrame:
    return spark.read.schema(f"{schema}, delivery bigint").parquet(f"{path}/{what}")


def brackets(blocks: DataFrame) -> DataFrame:
    """Per column the number of its values, the two middle ranks (from 0), values between which they lie, and how
    many values lie in blocks below."""
    totals = blocks.groupBy("name").agg(F.sum("k").alias("filled"))
    totals = totals.select("name", "filled", F.expr("(filled - 1) div 2 as lo"), F.expr("filled div 2 as hi"))

    def summed(end: str) -> DataFrame:
        # Rows of a column: its blocks, not its values.
        upto = F.sum("n").over(Window.partitionBy("name").orderBy(end).rowsBetween(Window.unboundedPreceding, 0))
        ends = blocks.groupBy("name", end).agg(F.sum("k").alias("n"))
        return ends.select("name", end, "n", upto.alias("upto")).join(totals, "name")

    # At least ``upto`` values are at most ``high``; at most ``upto - n`` are less than ``low``.
    top = summed("high").where("upto > hi").groupBy("name").agg(F.min("high").alias("to"))
    bottom = summed("low").where("upto - n <= lo").groupBy("name").agg(F.max("low").alias("from"))
    found = totals.join(bottom, "name").join(top, "name")
    below = blocks.join(found, "name").groupBy("name").agg(F.sum(F.when(F.col("high") < F.col("from"), F.col("k")).otherwise(0)).alias("below"))
    return found.join(below, "name")


def medians(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """(name, filled, median) of each column over all deliveries below ``path``."""
    blocks = _read(spark, path, "blocks", BLOCKS).where(F.col("name").isin(list(columns)))
    # One row per column.
    found = brackets(blocks).collect()
    names = spark.createDataFrame([(c,) for c in columns], "name string")
    if not found:
        return names.select("name", F.lit(0).cast("bigint").alias("filled"), F.lit(None).cast("double").alias("median"))
    ranks = spark.createDataFrame(
        [(r["name"], r["filled"], r["lo"], r["hi"], r["from"], r["to"], r["below"]) for r in found],
        "name string, filled bigint, lo bigint, hi bigint, `from` double, `to` double, below bigint",
    )
    met = blocks.join(F.broadcast(ranks), "name").where("high >= `from` and low <= `to`")
    # The blocks' extremes reach the scan, which skips row groups; the blocks themselves decide.
    spans = met.groupBy("name").agg(F.min("low").alias("a"), F.max("high").alias("b")).collect()
    near = " or ".join(f"name = {literal(r['name'])} and value between {double_literal(r['a'])} and {double_literal(r['b'])}" for r in spans)
    inside = _read(spark, path, "values", VALUES).where(near).join(met.select("delivery", "name", "block"), ["delivery", "name", "block"], "left_semi")
    counts = inside.groupBy("name", "value").agg(F.sum("k").alias("k"))
    # Rows of a column: a few blocks of each delivery.
    upto = F.sum("k").over(Window.partitionBy("name").orderBy("value").rowsBetween(Window.unboundedPreceding, 0))
    placed = counts.select("name", "value", "k", upto.alias("u")).join(F.broadcast(ranks), "name")
    last = F.col("below") + F.col("u") - 1
    first = last - F.col("k") + 1

    def at(rank: str):
        return F.max(F.when((first <= F.col(rank)) & (F.col(rank) <= last), F.col("value")))

    middle = placed.groupBy("name", "filled").agg(((at("lo") + at("hi")) / 2).alias("median"))
    return names.join(F.broadcast(middle), "name", "left").select("name", F.coalesce("filled", F.lit(0).cast("bigint")).alias("filled"), "median")
