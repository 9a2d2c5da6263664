"""The store of features: what a lookup reads, odd keys, and a stream that goes on after a stop."""

from pyspark.sql import functions as F

from ardoise.sources import store as stores
from ardoise.sources.store import FeatureStore
from ardoise.sources.workdir import fresh_path
from ardoise.streaming import requests


def made(spark, n=5000, rows_per_folder=100):
    df = spark.range(n).select(F.col("id").alias("SK_ID_CURR"), (F.col("id") * 0.5).alias("x"), F.lit("a").alias("FOLDER"))
    return FeatureStore.write(df, fresh_path(spark, "store"), "SK_ID_CURR", rows_per_folder)


def files_read(df):
    """Rows, and files that the scan opened by its own metric."""
    rows = df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    return rows, plan.collectLeaves().head().metrics().apply("numFiles").value()


def test_one_applicant_is_one_file(spark):
    store = made(spark)
    assert store.folders == 50
    rows, files = files_read(store.rows_of(spark.createDataFrame([(4711,), (4711,)], "SK_ID_CURR bigint")))
    assert files == 1 and [tuple(r) for r in rows] == [(4711, 2355.5, "a")]
    assert files_read(store.rows)[1] == 50


def test_many_and_odd_keys(spark, monkeypatch):
    store = made(spark)
    asked = spark.createDataFrame([(k,) for k in (None, -1, 3, 3, 4999, 5000, None)], "SK_ID_CURR bigint")
    assert sorted(r[0] for r in store.rows_of(asked).collect()) == [3, 4999]
    assert store.rows_of(asked.limit(0)).count() == 0
    assert store.rows_of(spark.createDataFrame([(7,)], "SK_ID_CURR int")).count() == 1
    monkeypatch.setattr(stores, "PUSHED", 10)
    assert store.rows_of(spark.range(4000, 6000).toDF("SK_ID_CURR")).count() == 1000
    empty = FeatureStore.write(spark.range(0).toDF("SK_ID_CURR"), fresh_path(spark, "store"), "SK_ID_CURR")
    assert empty.rows_of(asked).count() == 0
    keyless = spark.createDataFrame([(None, 1), (2, 1), (2, 2)], "SK_ID_CURR bigint, x int")
    assert FeatureStore.write(keyless, fresh_path(spark, "store"), "SK_ID_CURR").rows_of(asked.unionByName(spark.range(2, 3).toDF("SK_ID_CURR"))).count() == 2


class Half:
    """A scorer with the probability in a column."""

    threshold = 0.5

    def probabilities(self, wide, *keep):
        return wide.select(*keep, (F.col("x") / 2500).alias("p"))


def test_stream_from_the_store(spark, tmp_path):
    store = made(spark)
    source, out, checkpoint = f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/cp"

    def run():
        stream = requests.request_stream(spark, source, files_per_trigger=1)
        requests.decide_from_store(stream, store, Half(), out, checkpoint).awaitTermination()

    ids = [1, 1, 2500, 4999, 9999, None]
    spark.createDataFrame([(i,) for i in ids], "SK_ID_CURR bigint").coalesce(1).write.mode("append").json(source)
    run()
    spark.createDataFrame([(2,)], "SK_ID_CURR bigint").coalesce(1).write.mode("append").json(source)
    run()
    run()
    got = requests.read_decisions(spark, out).collect()
    want = [(1, "Acceptée", 0.0), (1, "Acceptée", 0.0), (2, "Acceptée", 0.0), (2500, "Acceptée", 0.5), (4999, "Rejetée", 1.0), (9999, "Inconnue", None), (None, "Inconnue", None)]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
