"""Medians over deliveries against NumPy, and what they read."""

import numpy as np
import pytest

from ardoise.operators import medianstate
from ardoise.sources.workdir import fresh_path


@pytest.mark.parametrize("size", [7, medianstate.SIZE])
def test_medians_over_deliveries(spark, size):
    rng, path = np.random.default_rng(3), fresh_path(spark, "medians")
    columns, parts = ["a", "b'c", "few", "hot", "none"], []
    for d, n in enumerate((700, 1, 0, 401)):
        a = rng.normal(d * 0.7, 1, n)
        odd = rng.choice([np.inf, -np.inf, np.nan, -0.0, 0.0, 3.0], n)
        hot = np.where(rng.random(n) < 0.4, 5.0, rng.integers(0, 1000, n))
        few = np.where(rng.random(n) < 0.9, np.nan, a)
        parts.append(np.c_[a, odd, few, hot])
        rows = [(float(x), float(y), None if np.isnan(z) else float(z), float(h), None, "text") for x, y, z, h in parts[-1]]
        df = spark.createDataFrame(rows, "a double, `b'c` double, few double, hot double, none double, name string")
        medianstate.add_delivery(df, columns, path, d, size)
        # A job that is repeated writes the same delivery again.
        medianstate.add_delivery(df, columns, path, d, size)
        got = {r["name"]: (r["filled"], r["median"]) for r in medianstate.medians(spark, path, columns).collect()}
        seen = np.concatenate(parts)
        assert list(got) and set(got) == set(columns) and got["none"] == (0, None)
        for c, v in zip(columns, seen.T):
            v = v[np.isfinite(v)]
            assert got[c][0] == len(v)
            assert got[c][1] == (np.median(v) if len(v) else None)


def test_only_blocks_around_the_middle_are_read(spark):
    path = fresh_path(spark, "medians")
    for d in range(3):
        medianstate.add_delivery(spark.range(d, 30_000, 3).selectExpr("id as v"), ["v"], path, d, 100)
    blocks = medianstate._read(spark, path, "blocks", medianstate.BLOCKS)
    r = medianstate.brackets(blocks).first()
    met = blocks.where((blocks.high >= r["from"]) & (blocks.low <= r["to"])).count()
    assert blocks.count() >= 300 and met <= 9
    assert medianstate.medians(spark, path, ["v"]).first()["median"] == 14999.5


def test_nothing_delivered(spark):
    path = fresh_path(spark, "medians")
    medianstate.add_delivery(spark.range(0), ["id"], path, 0)
    assert [tuple(r) for r in medianstate.medians(spark, path, ["id"]).collect()] == [("id", 0, None)]
