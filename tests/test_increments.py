"""Blocks from merged states against blocks from all rows."""

import math
import random

from pyspark.sql import functions as F

from ardoise.operators.encode import categorical_columns
from ardoise.plans import blocks, specs
from ardoise.plans.increments import IncrementalBlock, State
from ardoise.sources.workdir import fresh_path

COLUMNS = "SK_ID_CURR long, SK_ID_PREV long, NUM_INSTALMENT_VERSION double, DAYS_INSTALMENT int, DAYS_ENTRY_PAYMENT int, AMT_INSTALMENT double, AMT_PAYMENT double, NAME_KIND string"


def rows_of(n, seed):
    r = random.Random(seed)
    out = []
    for i in range(n):
        # One client has a third of the rows; some have one row only, some rows have no client.
        key = r.choice([1, r.randint(2, 40), r.choice([None, *range(100, 400)])])
        maybe = lambda x: None if r.random() < 0.15 else x
        version = r.choice([0.0, -0.0, 1.0, 2.5])
        out.append((key, i, maybe(version), -r.randint(1, 2000), maybe(-r.randint(1, 2000)), maybe(r.choice([0.0, 1e6 + r.randint(1, 500) / 100])), maybe(r.randint(1, 500) / 4), maybe(r.choice(["a", "b", "it's", "", "only late" if i > 0.95 * n else "a"]))))
    return out


def same(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9) or math.isnan(a) and math.isnan(b)
    return a == b


def compare(got, want):
    assert got.columns and sorted(got.columns) == sorted(want.columns)
    a, b = ({r[0]: r for r in x.select("SK_ID_CURR", *sorted(want.columns)).collect()} for x in (got, want))
    assert set(a) == set(b)
    assert [(k, c) for k in a for c in want.columns if not same(a[k][c], b[k][c])] == []


def test_merged_states_make_the_block(spark):
    df = spark.createDataFrame(rows_of(3000, 1), COLUMNS).withColumn("extra|n", F.lit(1))
    rows = blocks.instalment_rows(df.drop("extra|n"), on_zero="null")
    block = IncrementalBlock(specs.INSTALMENTS, "INSTAL_", categorical_columns(rows))
    want = blocks.installments_payments(df.drop("extra|n"), on_zero="null")
    deliveries = [rows.where(c) for c in ("SK_ID_PREV < 2000", "SK_ID_PREV between 2000 and 2900", "false", "SK_ID_PREV > 2900")]
    for order in (deliveries, deliveries[::-1]):
        state = None
        for d in order:
            new = block.state(d)
            path = fresh_path(spark, "state")
            (new if state is None else block.merge(state, new)).save(path)
            state = State.load(spark, path)
        compare(block.block(state), want)
    frozen = {"NAME_KIND": ["a", "gone", None]}
    compare(block.block(state, frozen), blocks.installments_payments(df.drop("extra|n"), frozen, on_zero="null"))


def test_variance_keeps_its_digits(spark):
    values = [(1, 1e9 + x, p) for x, p in ((0.25, 0), (0.5, 0), (0.75, 1), (1.0, 1))]
    df = spark.createDataFrame(values, "SK_ID_CURR long, v double, part int")
    block = IncrementalBlock(specs.AggSpec({"v": ["var", "size", "min"]}), "X_", [])
    state = block.merge(block.state(df.where("part = 0")), block.state(df.where("part = 1")))
    row = block.block(state).first()
    assert abs(row["X_v_VAR"] - 0.3125 / 3) < 1e-9 and row["X_v_SIZE"] == 4 and row["X_v_MIN"] == 1e9 + 0.25


def test_nothing_delivered(spark):
    rows = blocks.instalment_rows(spark.createDataFrame([], COLUMNS))
    block = IncrementalBlock(specs.INSTALMENTS, "INSTAL_", categorical_columns(rows))
    assert block.block(block.merge(block.state(rows), block.state(rows))).count() == 0
