"""Sparse one-hot encoding beside the dense one."""

import os
import re

import pytest
from pyspark.sql import functions as F

from ardoise.operators import encode, skew, sparse
from ardoise.sources.workdir import CLEANUP, fresh_path, materialise

ROWS = [(1, "b", "x", 0.5), (2, None, "x", 1.5), (3, "a", None, 2.5), (4, "a", "z", 3.5), (4, "a", "z", 3.5), (5, "", "y", 4.5), (6, "é", "x", 5.5)]
SCHEMA = "k int, one string, two string, n double"


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def dense(df, numeric=()):
    return sorted((r.k, *r.features.toArray().tolist()) for r in df.select("k", "features").collect())


@pytest.mark.parametrize("missing", [True, False])
def test_equals_the_dense_encoding(spark, rows, missing):
    fitted = sparse.fit_sparse(rows, ["one", "two"], missing)
    path = fresh_path(spark, "sparse")
    fitted.save(path)
    fitted = sparse.SparseCategories.load(spark, path)
    want, names = encode.one_hot(rows.drop("n"), nan_category=missing)
    assert dense(fitted.vectors(rows)) == sorted((r["k"], *[float(r[c]) for c in names]) for r in want.collect())
    with_n = fitted.vectors(rows, numeric=["n"])
    assert with_n.columns == ["k", "n", "features"] and [r.features[0] - r.n for r in with_n.collect()] == [0.0] * len(ROWS)
    assert fitted.sizes() == {"one": 4 + missing, "two": 3 + missing}


def test_unknown_values_are_zero(spark, rows):
    fitted = sparse.fit_sparse(rows.where("k in (1, 3)"), ["one", "two"])
    assert {(r.value, r["index"]) for r in fitted.table.where("column = 'one'").collect()} == {("a", 0), ("b", 1)}
    # one: a, b, missing; two: x, missing.
    assert dense(fitted.vectors(rows)) == [
        (1, 0, 1, 0, 1, 0), (2, 0, 0, 1, 1, 0), (3, 1, 0, 0, 0, 1), (4, 1, 0, 0, 0, 0), (4, 1, 0, 0, 0, 0), (5, 0, 0, 0, 0, 0), (6, 0, 0, 0, 1, 0),
    ]
    long = sorted(map(tuple, fitted.long(rows.where("k < 4"), "k").collect()))
    assert long == [(1, "one", 1), (1, "two", 3), (2, "one", 2), (2, "two", 3), (3, "one", 0), (3, "two", 4)]


def test_nothing_known_and_no_rows(spark, rows):
    fitted = sparse.fit_sparse(rows.limit(0), ["one", "two"])
    assert dense(fitted.vectors(rows.where("k < 3"))) == [(1, 0, 0), (2, 1, 0)]
    assert sparse.fit_sparse(rows.limit(0), ["one"], nan_category=False).sizes() == {"one": 0}
    assert fitted.vectors(rows.limit(0)).count() == 0
    with pytest.raises(ValueError):
        sparse.fit_sparse(rows, [])


def test_many_values_and_a_hot_one(spark):
    # A third of the rows have one value; the others have two hundred thousand.
    df = spark.range(300_000).select("id", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("v"), F.col("id"))).alias("c"))
    fitted = sparse.fit_sparse(df, ["c"])
    got = fitted.indices(df)
    check = got.agg(F.count("c_index"), F.count_distinct("c_index"), F.min("c_index"), F.max("c_index"), F.max(F.when(F.col("c") == "hot", F.col("c_index")))).first()
    assert tuple(check) == (300_000, 200_001, 0, 200_000, 0)
    # Numbers follow the order of the values.
    pairs = fitted.table.orderBy("value").select("index").collect()
    assert [r["index"] for r in pairs] == list(range(200_001))
    vector = fitted.vectors(df).select(F.unwrap_udt("features")["size"].alias("n"), F.size(F.unwrap_udt("features")["indices"]).alias("k"))
    assert vector.distinct().collect() == [(200_002, 1)]


def test_places_are_not_named(spark):
    # A name per place would be millions of them in the driver.
    df = spark.range(50_000).select("id", F.concat(F.lit("v"), F.col("id")).alias("c"), (F.col("id") % 2).alias("n"))
    vectors = sparse.fit_sparse(df, ["c"]).vectors(df, numeric=["n"])
    assert len(vectors.schema.json()) < 1_000
    assert vectors.schema["features"].metadata == {"ml_attr": {"num_attrs": 50_002}}
    row = vectors.where("id = 7").first()
    assert (row.features.size, row.features[0], len(row.features.indices)) == (50_002, 1.0, 2)
    place = 1 + sorted(f"v{i}" for i in range(50_000)).index("v8")
    assert vectors.where("id = 8").first().features.indices.tolist() == [place]


def test_missing_numbers_are_an_error(spark, rows):
    fitted = sparse.fit_sparse(rows, ["one"])
    for bad in (None, float("nan")):
        with pytest.raises(Exception, match="missing value"):
            fitted.vectors(rows.withColumn("n", F.lit(bad).cast("double")), numeric=["n"]).collect()


def test_columns_are_looked_up_a_few_at_a_time(spark, monkeypatch):
    """Each lookup asks the given table for its hot values, not the joins before it; rows are written between them."""
    df = spark.range(3_000).select("id", *[F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit(c), F.col("id"))).alias(c) for c in "abcde"])
    fitted = sparse.fit_sparse(df.where("id % 7 > 0"), list("abcde"))
    want = dense(fitted.vectors(df.withColumnRenamed("id", "k").where("k < 40")))
    asked, written, hot, write = [], [], skew.hot_keys, sparse.materialise
    monkeypatch.setattr(skew, "BROADCAST_ROWS", 10)
    monkeypatch.setattr(sparse, "BROADCAST_ROWS", 10)
    monkeypatch.setattr(skew, "hot_keys", lambda df, *a: asked.append(df.columns) or hot(df, *a))
    monkeypatch.setattr(sparse, "materialise", lambda df, name: written.append(df.columns) or write(df, name))
    got = dense(fitted.vectors(df.withColumnRenamed("id", "k").where("k < 40")))
    assert got == want and asked == [["k", *"abcde"]] * 5
    assert written == [["k", "c", "d", "e", "a_index", "b_index"], ["k", "e", "a_index", "b_index", "c_index", "d_index"]]


def test_shuffle_files_of_a_written_table_go(spark):
    top = os.environ.get("SPARK_LOCAL_DIRS", spark.conf.get("spark.local.dir", "/tmp"))

    def shuffled():
        return {f for _, _, names in os.walk(top) for f in names if re.fullmatch(r"shuffle_.*[.]data", f)}

    before = shuffled()
    table = materialise(spark.range(5_000).repartition(7, "id"), "moved")
    assert not shuffled() - before and spark.conf.get(CLEANUP, None) is None
    assert table.count() == 5_000
    spark.range(5_000).repartition(7, "id").write.parquet(fresh_path(spark, "kept"))
    assert shuffled() - before
