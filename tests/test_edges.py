"""Hand-made rows for what the given tables lack: missing values, infinities, ties, constants."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ardoise.functions import aggspec as A
from ardoise.functions import exprs as E
from ardoise.operators import clean, encode, median, metrics, neighbours, profile, ranges, skew, smote, split
from ardoise.plans import blocks
from ardoise.sources import tables

INF = float("inf")


def column(df, name):
    return [r[name] for r in df.collect()]


def test_division(spark):
    rows = [(1, 1.0, 0.0), (2, -1.0, 0.0), (3, 0.0, 0.0), (4, None, 0.0), (5, 1.0, 2.0), (6, 1.0, -0.0)]
    df = spark.createDataFrame(rows, "i int, n double, d double").orderBy("i")
    assert column(df.select(E.ieee_div("n", "d").alias("q")), "q") == [INF, -INF, None, None, 0.5, -INF]
    assert column(df.select(E.ieee_div("n", "d", "null").alias("q")), "q") == [None, None, None, None, 0.5, None]
    with pytest.raises(ValueError):
        E.ieee_div("n", "d", "zero")


def test_clamp_and_sentinel(spark):
    df = spark.createDataFrame([(None,), (3.0,), (-2.0,), (float("nan"),)], "x double")
    assert column(df.select(E.clamp_zero("x").alias("c")), "c") == [0.0, 3.0, 0.0, 0.0]
    days = spark.createDataFrame([(365243.0,), (-100.0,), (None,)], "x double")
    assert column(days.select(E.null_sentinel("x").alias("c")), "c") == [None, -100.0, None]


def test_labels(spark):
    df = spark.createDataFrame([("PAYMENT_RATE <= 0.46",), ("FLAG_DOCUMENT_6",), ("X" * 40,)], "f string")
    assert column(df.select(E.clean_label("f").alias("l")), "l") == ["PAYMENT_RATE", "FLAG_DOCUMENT_", "X" * 25]


def test_aggregates_of_missing_values(spark):
    rows = [(1, 1.0), (1, INF), (2, None), (2, None), (3, 5.0)]
    df = spark.createDataFrame(rows, "k int, v double")
    spec = A.AggSpec({"v": ["min", "max", "mean", "sum", "var", "size", "nunique"]})
    got = {r["k"]: r for r in df.groupBy("k").agg(*A.aggregate_columns(spec, "")).collect()}
    one, two, three = got[1], got[2], got[3]
    assert (one["v_MIN"], one["v_MAX"], one["v_MEAN"], one["v_SUM"]) == (1.0, INF, INF, INF)
    assert math.isnan(one["v_VAR"])
    assert (two["v_SUM"], two["v_MEAN"], two["v_SIZE"], two["v_NUNIQUE"]) == (0.0, None, 2, 0)
    assert three["v_VAR"] is None
    cleared = clean.clear_infinite(df, ["v"])
    assert cleared.where("v is null").count() == 3


def test_subset_without_rows_and_with_missing_value(spark):
    rows = [(1, "Closed", 4.0), (2, "Active", None), (2, "Closed", 7.0)]
    df = spark.createDataFrame(rows, "k int, s string, v double")
    columns = A.aggregate_columns({"v": ["sum", "size"]}, "ACTIVE_", A.in_category("s", "Active"))
    got = {r["k"]: (r["ACTIVE_v_SUM"], r["ACTIVE_v_SIZE"]) for r in df.groupBy("k").agg(*columns).collect()}
    assert got == {1: (None, None), 2: (0.0, 1)}


def test_missing_key_is_no_group(spark):
    pos = spark.createDataFrame(
        [(1, -1, 0.0, 0.0, "a"), (None, -2, 1.0, 1.0, "b")],
        "SK_ID_CURR bigint, MONTHS_BALANCE int, SK_DPD double, SK_DPD_DEF double, NAME_CONTRACT_STATUS string",
    )
    assert column(blocks.pos_cash(pos), "SK_ID_CURR") == [1]


def test_names_with_quotes(spark):
    df = spark.createDataFrame([(1, "it's \\ `x`"), (1, "b")], "k int, `c d` string")
    categories = encode.discover_categories(df)
    row = df.groupBy("k").agg(*A.category_share(categories, "")).first()
    assert row["c d_it's \\ `x`_MEAN"] == 0.5 and row["c d_nan_MEAN"] == 0.0


def test_one_hot(spark):
    df = spark.createDataFrame([(1, "b"), (2, None), (3, "a")], "i int, c string")
    out, names = encode.one_hot(df)
    assert names == ["c_a", "c_b", "c_nan"]
    assert [tuple(r) for r in out.orderBy("i").collect()] == [(1, 0, 1, 0), (2, 0, 0, 1), (3, 1, 0, 0)]
    bare, names = encode.one_hot(df, nan_category=False)
    assert names == ["c_a", "c_b"] and tuple(bare.where("i = 2").first()) == (2, 0, 0)


def test_too_many_categories_are_refused(spark):
    df = spark.range(50).select(F.col("id").cast("string").alias("c"))
    with pytest.raises(ValueError, match="more than 20"):
        encode.discover_categories(df, max_categories=20)


def test_factorize_and_fallback_without_broadcast(spark, monkeypatch):
    values = ["M", None, "F", "M", "XNA"]
    df = spark.createDataFrame(list(enumerate(values)), "i int, g string")
    codes = encode.factorize_fit(df, "g", "i")
    assert column(encode.factorize_apply(df, "g", codes).orderBy("i"), "g") == [0, -1, 1, 0, 2]
    monkeypatch.setattr(skew, "BROADCAST_ROWS", 1)
    assert column(encode.factorize_apply(df, "g", codes).orderBy("i"), "g") == [0, -1, 1, 0, 2]


def test_align(spark):
    train, test = ["k", "a", "b"], ["k", "b", "c"]
    assert encode.column_alignment(train, test) == [("a", "add"), ("b", "common"), ("c", "ignore"), ("k", "common")]
    df = spark.createDataFrame([(1, 2, 3)], "k int, b int, c int")
    assert [tuple(r) for r in encode.align(df, train).collect()] == [(1, 0, 2)]


def test_median(spark):
    df = spark.createDataFrame([(1.0, 5.0, None), (2.0, 5.0, None), (3.0, 5.0, None), (10.0, -1.0, None)], "a double, b double, c double")
    assert median.exact_medians(df, ["a", "b", "c"]) == {"a": 2.5, "b": 5.0, "c": None}


def test_median_with_a_bad_bracket(spark):
    """Brackets that miss the middle are noticed and widened."""
    rng = np.random.default_rng(1)
    values = rng.normal(size=501)
    df = spark.createDataFrame(pd.DataFrame({"a": values}))
    stats = {"a": median.ColumnStats(501, float(values.min()), float(values.max()), (90.0, 91.0))}
    assert median.exact_medians(df, ["a"], stats)["a"] == np.median(values)


def test_preparation(spark, tmp_path):
    rows = [(i, i % 2, float(i), 5.0, None if i < 30 else 1.0, INF if i == 0 else float(i)) for i in range(100)]
    df = spark.createDataFrame(rows, "SK_ID_CURR bigint, TARGET int, a double, b double, c double, d double")
    p = clean.fit_preparation(df)
    assert (p.features, p.dropped) == (["a", "b", "d"], ["c"])
    assert p.medians["d"] == 50.0 and p.ranges["d"] == (1.0, 99.0)
    out = p.apply(df).toPandas()
    assert out["a"].min() == 0.0 and out["a"].max() == 1.0 and set(out["b"]) == {0.0}
    beyond = spark.createDataFrame([(1, 198.0, 5.0, 1.0)], "SK_ID_CURR bigint, a double, b double, d double")
    assert p.apply(beyond).first()["a"] == 2.0
    p.save(spark, f"{tmp_path}/p")
    assert clean.Preparation.load(spark, f"{tmp_path}/p") == p


def test_fill_limit_is_exact(spark):
    df = spark.range(100).select(*[F.when(F.col("id") < n, 1.0).alias(f"f{n}") for n in (79, 80, 81)])
    fill = clean.fill_counts(df, df.columns)
    assert column(clean.sparse_columns(fill), "column") == ["f79"]


def test_duplicates(spark):
    df = spark.createDataFrame([(1, "x"), (1, "x"), (1, "y"), (None, None), (None, None)], "a int, b string")
    assert tuple(profile.duplicate_count(df).first()) == (5, 2)


def test_finite_check(spark):
    df = spark.createDataFrame([(1.0,), (INF,), (float("nan"),), (None,)], "x double")
    assert tuple(clean.finite_check(df, ["x"]).first()) == ("x", 1, 1, 1)


def test_csv_reading(spark, tmp_path):
    (tmp_path / "t.csv").write_text("SK_ID_CURR,NAME_X,AMT\n1,é,2.5\n2,,\n", encoding="utf-8")
    df = tables.read_csv(spark, str(tmp_path / "t.csv"))
    assert dict(df.dtypes) == {"SK_ID_CURR": "bigint", "NAME_X": "string", "AMT": "double"}
    assert [tuple(r) for r in df.orderBy("SK_ID_CURR").collect()] == [(1, "é", 2.5), (2, None, None)]
    (tmp_path / "u.csv").write_text("CHANNEL_TYPE,N,EMPTY,FEW\nweb,1,,\nshop,2.5,,7\n", encoding="utf-8")
    df = tables.read_csv(spark, str(tmp_path / "u.csv"))
    assert dict(df.dtypes) == {"CHANNEL_TYPE": "string", "N": "double", "EMPTY": "double", "FEW": "bigint"}
    assert [tuple(r) for r in df.orderBy("N").collect()] == [("web", 1.0, None, None), ("shop", 2.5, None, 7)]
    (tmp_path / "u.csv").write_text("CHANNEL_TYPE,N,EMPTY,FEW\nweb,many,,\n", encoding="utf-8")
    with pytest.raises(Exception, match="MALFORMED|FAILFAST"):
        tables.read_csv(spark, str(tmp_path / "u.csv"), df.schema).collect()
    (tmp_path / "d.csv").write_bytes("Row,Description\nA,d\xe9j\xe0\n".encode("latin-1"))
    assert tables.read_dictionary(spark, str(tmp_path / "d.csv")).first()["Description"] == "déjà"


def test_hot_key_join_keeps_all_rows(spark):
    seven = F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id"))
    missing = F.when(F.col("id") % 4 == 1, None)
    plain = spark.range(3000).select(F.col("id").alias("k"), "id")
    hot = spark.range(6000).select(seven.alias("k"), "id")
    both = spark.range(6000).select(missing.otherwise(seven).alias("k"), "id")
    only_missing = spark.range(6000).select(missing.otherwise(F.col("id")).alias("k"), "id")
    right = spark.range(0, 5000).select(F.col("id").alias("k"), (F.col("id") * 10).alias("v"))
    for left, keys in ((plain, set()), (hot, {7}), (both, {7, None}), (only_missing, {None})):
        assert set(skew.hot_keys(left, "k")) == keys
        for how in ("inner", "left"):
            a = skew.skew_join(left, right, "k", how).select("k", "id", "v").orderBy("id").collect()
            assert a == left.join(right, "k", how).select("k", "id", "v").orderBy("id").collect()


def test_folds_keep_rows_without_a_class(spark):
    df = spark.range(200).select("id", F.when(F.col("id") % 10 != 0, F.col("id") % 2).alias("y"))
    out = split.stratified_folds(df, "y", "id").groupBy("y", "fold").count().toPandas()
    assert out["count"].sum() == 200 and out[out.y.isna()]["count"].tolist() == [4] * 5


def test_running_totals_in_ranges(spark):
    rng = np.random.default_rng(0)
    pdf = pd.DataFrame({"g": rng.integers(0, 2, 800), "o": rng.permutation(800), "v": rng.integers(0, 9, 800)})
    got = ranges.running_totals(spark.createDataFrame(pdf), "o", ["v"], ["g"], ranges=13).toPandas()
    want = pdf.sort_values("o").assign(w=lambda d: d.groupby("g")["v"].cumsum()).set_index("o")["w"]
    assert (got.set_index("o")["v_upto"].sort_index() == want.sort_index()).all() and len(got) == 800


def test_fold_sizes(spark):
    df = spark.range(1003).select("id", (F.col("id") % 12 == 0).cast("int").alias("y"))
    sizes = split.stratified_folds(df, "y", "id", buckets=64).groupBy("y", "fold").count().toPandas()
    assert sizes["count"].sum() == 1003
    assert sizes.groupby("y")["count"].agg(lambda s: s.max() - s.min()).max() <= 1


def test_threshold_is_strict(spark):
    scores = [57 * 0.01, 0.57, 0.0, 1.0, 0.29, 29 * 0.01, 0.005, 0.999]
    df = spark.createDataFrame([(s, i % 2) for i, s in enumerate(scores)], "p double, y int")
    got = column(df.select(metrics.thresholds_below(F.col("p")).alias("b")), "b")
    assert got == [sum(s > i * 0.01 for i in range(100)) for s in scores]


def test_auc_with_ties(spark):
    from pyspark.ml.evaluation import BinaryClassificationEvaluator

    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"p": rng.integers(0, 40, 3000) / 40.0, "y": (rng.random(3000) < 0.2).astype(float)})
    df = spark.createDataFrame(pdf)
    evaluator = BinaryClassificationEvaluator(rawPredictionCol="p", labelCol="y", numBins=0)
    for n in (1, 7):
        assert metrics.roc_auc(df, "y", "p", ranges=n).first()["auc"] == pytest.approx(evaluator.evaluate(df), abs=1e-12)
    assert metrics.roc_auc(df.where("y = 1"), "y", "p").first()["auc"] is None


def test_nearest_points_equal_brute_force(spark):
    rng = np.random.default_rng(0)
    x = rng.random((400, 4))
    x[:120] = x[0]
    x[200:280] = rng.integers(0, 3, (80, 4))
    names = list("abcd")
    df = spark.createDataFrame(pd.DataFrame(x, columns=names).assign(k=range(400)))
    points = neighbours.distinct_points(df, "k", names).cache()
    got = {r.id: [e.distance for e in r.near] for r in neighbours.nearest_points(points, 5, block_rows=40).collect()}
    p = points.toPandas()
    y = np.vstack(p.x.to_numpy())
    for i, k in enumerate(p.id):
        d = np.sqrt(((y - y[i]) ** 2).sum(1))
        d[i] = np.inf
        assert np.allclose(got[k], np.sort(d)[:5])


def test_oversampling_evens_out_and_stays_between(spark):
    rng = np.random.default_rng(1)
    x = rng.random((300, 3))
    x[:20] = x[0]
    pdf = pd.DataFrame(x, columns=list("abc")).assign(k=range(300), y=([1] * 60 + [0] * 240))
    df = spark.createDataFrame(pdf)
    new = smote.synthetic_rows(df, "y", "k", list("abc")).toPandas()
    assert len(new) == 180 and set(new.y) == {1} and set(new.k) <= set(range(60))
    low, high = x[:60].min(0), x[:60].max(0)
    assert (new[list("abc")].to_numpy() >= low).all() and (new[list("abc")].to_numpy() <= high).all()
    # Twenty equal rows are their own five nearest neighbours.
    assert np.allclose(new[new.k < 20][list("abc")], x[0])
    again = smote.synthetic_rows(df, "y", "k", list("abc")).toPandas()
    pd.testing.assert_frame_equal(
        new.sort_values(list("abck"), ignore_index=True), again.sort_values(list("abck"), ignore_index=True)
    )


@pytest.mark.parametrize("few,many", [(49, 50), (7, 20), (3, 10)])
def test_oversampling_makes_every_missing_row(spark, few, many):
    rng = np.random.default_rng(few)
    pdf = pd.DataFrame(rng.random((few + many, 2)), columns=list("ab")).assign(k=range(few + many), y=[1] * few + [0] * many)
    assert smote.synthetic_rows(spark.createDataFrame(pdf), "y", "k", list("ab")).count() == many - few


def test_rows_without_a_label_have_no_weight(spark):
    df = spark.createDataFrame([(1, 0), (2, 0), (3, 1), (4, None)], "k int, y int")
    got = {r.k: r.weight for r in split.add_class_weights(df, "y").collect()}
    assert got == {1: 0.75, 2: 0.75, 3: 1.5, 4: None}


def test_medians_of_flags_send_no_values(spark):
    df = spark.range(1000).selectExpr("cast(id % 3 = 0 as int) as flag", "case when id % 7 = 0 then 1.0 else 0.0 end as mostly", "cast(id as double) as x")
    stats = median.column_stats(df, ["flag", "mostly", "x"])
    assert stats["flag"].bracket == (0.0, 0.0) and stats["mostly"].bracket == (0.0, 0.0)
    assert median.exact_medians(df, ["flag", "mostly", "x"]) == {"flag": 0.0, "mostly": 0.0, "x": 499.5}
    assert median._middle_values(df, {"flag": (1000, 0.0, 0.0), "x": (1000, 0.0, 0.0)}) == {"flag": 0.0}


def test_medians_of_many_tasks_meet_by_column(spark, monkeypatch):
    """No aggregate of the whole table: one task would merge the sketches of all columns.  Brackets hold the middle ranks
    however the values lie, and are narrow."""
    rng = np.random.default_rng(5)
    n = 30_000
    pdf = pd.DataFrame({"a": np.sort(rng.normal(size=n)), "b": rng.integers(0, 9, n).astype(float), "c": rng.lognormal(size=n)})
    df = spark.createDataFrame(pdf).repartitionByRange(7, "a").selectExpr(
        "a", "b", "case when a > 0.5 then c end as c", "cast(b * 3 as decimal(9, 1)) as d", "case when a < -1 then double('NaN') else a end as e",
        "cast(null as double) as f")
    want = {"a": np.median(pdf.a), "b": np.median(pdf.b), "c": np.median(pdf.c[pdf.a > 0.5]), "d": np.median(pdf.b * 3), "f": None}
    want["e"] = np.median(np.where(pdf.a < -1, INF, pdf.a))
    monkeypatch.setattr(type(df), "agg", None)
    stats = median.column_stats(df, list("abcdef"))
    assert stats["f"] == median.ColumnStats(0, None, None, None)
    assert (stats["a"].filled, stats["a"].low, stats["a"].high) == (n, pdf.a.min(), pdf.a.max())
    assert stats["c"].filled == (pdf.a > 0.5).sum() and math.isnan(stats["e"].high) and stats["e"].low == pdf.a[pdf.a >= -1].min()
    low, high = stats["a"].bracket
    assert low <= want["a"] <= high and pdf.a.between(low, high).sum() <= 0.01 * n
    assert median.exact_medians(df, list("abcdef")) == want


def test_a_thinned_sketch_keeps_ranks():
    rng = np.random.default_rng(6)
    values = np.sort(rng.normal(size=5000))
    kept, weights = median._thinned(values, np.ones(5000), 100)
    assert len(kept) == 100 and weights.sum() == pytest.approx(5000)
    off = np.abs(np.searchsorted(values, kept) + 0.5 - (np.cumsum(weights) - weights / 2))
    assert off.max() <= 1
