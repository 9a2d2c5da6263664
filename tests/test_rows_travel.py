"""Blocks send rows through the shuffle, not their partial sums; hot keys are reduced where they lie."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ardoise.functions.aggspec import AggSpec
from ardoise.operators import skew
from ardoise.plans import blocks
from ardoise.plans.increments import IncrementalBlock
from ardoise.plans.specs import KEY


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_rows_meet_before_they_are_aggregated(spark):
    pos = spark.range(50).selectExpr(
        "id % 9 as SK_ID_CURR", "-id as MONTHS_BALANCE", "cast(id % 4 as double) as SK_DPD", "cast(id % 3 as double) as SK_DPD_DEF",
        "if(id % 2 = 0, 'a', 'b') as NAME_CONTRACT_STATUS",
    )
    lines = _plan(blocks.pos_cash(pos)).splitlines()
    deepest = max(k for k, x in enumerate(lines) if "Aggregate" in x)
    assert any(re.search(r"Exchange hashpartitioning\(SK_ID_CURR", x) for x in lines[deepest + 1 :])


def test_aggregates_with_hot_and_missing_keys(spark):
    key = F.when(F.col("id") % 3 == 0, F.lit(None)).when(F.col("id") % 3 == 1, F.lit(7)).otherwise(F.col("id"))
    rows = spark.range(6000).select(key.alias("k"), (F.col("id") % 10).cast("double").alias("x"))
    parts = [F.sum("x").alias("s"), F.count(F.lit(1)).alias("n"), F.count_distinct("x").alias("d")]
    assert set(skew.hot_keys(rows, "k")) == {7, None}
    got = skew.skew_aggregate(rows, "k", parts)
    want = rows.where("k is not null").groupBy("k").agg(*parts)
    assert got.count() == want.count() == 2001
    assert got.exceptAll(want).isEmpty()
    few = rows.where("k <> 7")
    assert skew.skew_aggregate(few, "k", parts).exceptAll(few.groupBy("k").agg(*parts)).isEmpty()


def test_a_delivery_travels_as_rows(spark):
    key = F.when(F.col("id") % 4 == 0, F.lit(None)).when(F.col("id") % 4 < 3, F.lit(7)).otherwise(F.col("id"))
    rows = spark.range(4000).select(key.alias(KEY), (F.col("id") % 5).cast("double").alias("x"), F.when(F.col("id") % 2 == 0, "a").alias("c"))
    block = IncrementalBlock(AggSpec({"x": ["sum", "var", "nunique"]}), "P_", ["c"])
    few = rows.where(f"{KEY} <> 7")
    for table in (block.state(few).moments, block.state(few).seen):
        lines = _plan(table).splitlines()
        assert any("Exchange hashpartitioning" in x for x in lines[max(k for k, x in enumerate(lines) if "Aggregate" in x) + 1 :])
    state = block.state(rows)
    assert state.moments.where(f"{KEY} = 7").select("rows", "`x|sum`").collect() == [(2001, 4002.0)]
    assert state.moments.count() == 1000
    want = rows.where(f"{KEY} is not null").select(KEY, F.expr("inline(array(named_struct('n', 'c', 'v', c), named_struct('n', 'x', 'v', cast(x + 0d as string))))"))
    assert state.seen.exceptAll(want.toDF(KEY, "name", "value").groupBy(KEY, "name", "value").count()).isEmpty()
