"""Models on a small separable table; batch and stream decisions."""

import tracemalloc

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ardoise.operators import explain, metrics, models
from ardoise.operators.split import add_class_weights, add_split
from ardoise.plans import scoring
from ardoise.plans.prepare import prepare
from ardoise.sources.workdir import fresh_path
from ardoise.streaming import requests

FEATURES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def wide(spark):
    rng = np.random.default_rng(5)
    n = 900
    x = rng.normal(size=(n, 3))
    y = (rng.random(n) < 1 / (1 + np.exp(-(2.5 * x[:, 0] - 1.5 * x[:, 1] - 2)))).astype(int)
    pdf = pd.DataFrame(x, columns=FEATURES).assign(SK_ID_CURR=range(n), TARGET=y, is_train=True)
    pdf.loc[pdf.index % 50 == 0, "c"] = np.inf
    pdf.loc[700:, "is_train"] = False
    return spark.createDataFrame(pdf).select("SK_ID_CURR", "TARGET", "is_train", *FEATURES)


@pytest.fixture(scope="module")
def data(wide):
    return prepare(wide)


@pytest.fixture(scope="module")
def scorer(data):
    return scoring.train_scorer(data)


def test_parts_are_whole_and_clean(data):
    assert data.train.count() + data.valid.count() == 700 and data.test.count() == 200
    assert data.preparation.features == FEATURES
    assert data.train.where("a < 0 or a > 1 or c is null").count() == 0


def test_regularisation_matches_the_sum_of_losses(spark, data):
    """Gradient of C * sum of weighted losses + |w|^2 / 2 vanishes at the fitted coefficients."""
    rows = add_class_weights(data.train, "TARGET")
    model = models.logistic(models.vectors(rows, FEATURES, "TARGET", "weight"), C=0.5)
    pdf = rows.toPandas()
    x, w, y = pdf[FEATURES].to_numpy(), pdf["weight"].to_numpy(), pdf["TARGET"].to_numpy()
    coef = model.coefficients.toArray()
    p = 1 / (1 + np.exp(-(x @ coef + model.intercept)))
    assert np.allclose(0.5 * ((w * (p - y))[:, None] * x).sum(0) + coef, 0, atol=1e-2)
    assert abs((w * (p - y)).sum()) < 1e-2


def test_scores_beat_chance(data, scorer):
    held = models.predict(scorer.pipeline.stages[-1], models.vectors(data.valid, FEATURES, "TARGET"))
    assert metrics.roc_auc(held, "TARGET", "proba").first()["auc"] > 0.8
    best = metrics.best_threshold(metrics.f1_curve(held, "TARGET", "proba")).first()
    assert best["threshold"] == scorer.threshold and best["f1"] > 0.5


@pytest.mark.parametrize("imbalance", ["CW", "SMOTE"])
def test_grid_search(data, imbalance):
    grid = {"C": [0.1, 10.0], "penalty": ["l1", "l2"]} if imbalance == "CW" else {"C": [1.0]}
    folds = models.grid_search(data.train, "LR_clf", grid, "SK_ID_CURR", FEATURES, class_imb=imbalance, n_fold=3).cache()
    n = len(models.combinations(grid))
    assert folds.count() == 3 * n and folds.where("auc < 0.7 or auc > 1").count() == 0
    summary = models.cv_summary(folds).toPandas()
    assert sorted(summary["rank"]) == list(range(1, n + 1))
    assert len(models.best_fold_scores(folds).collect()) == 3
    if imbalance == "CW":
        rows = models.vectors(add_class_weights(data.train, "TARGET"), FEATURES, "TARGET", "weight")
        _, params, seconds = models.refit_best(rows, "LR_clf", grid, folds)
        assert params in models.combinations(grid) and seconds > 0


def test_forest_error_curve_ends_at_the_forest(data):
    rows = models.vectors(add_class_weights(data.train, "TARGET"), FEATURES, "TARGET", "weight")
    model = models.forest(rows, n_estimators=12)
    with pytest.raises(ValueError):
        models.forest(rows, max_depth=models.MAX_DEPTH + 1)
    assert all(len(set(models.rf_grid(n)["max_depth"])) == 3 for n in (6, 40, 228))
    held = models.vectors(data.valid, FEATURES, "TARGET")
    curve = {r["n"]: r["error"] for r in models.tree_error_curve(model, held, [4, 8, 12]).collect()}
    whole = models.predict(model, held).agg(F.avg((F.col("prediction") != F.col("TARGET")).cast("int"))).first()[0]
    assert curve[12] == pytest.approx(whole, abs=0.02) and set(curve) == {4, 8, 12}
    table = explain.importance_table(data.train.sparkSession, FEATURES, model.featureImportances.toArray())
    assert explain.forest_importance(table, 2).count() == 2


def test_saved_scorer_and_stream_equal_batch(spark, wide, data, scorer, tmp_path):
    path = fresh_path(spark, "test-scorer")
    scorer.save(spark, path)
    loaded = scoring.Scorer.load(spark, path)
    batch = {r[0]: (r[1], r[2]) for r in scorer.decisions(wide).collect()}
    assert len(batch) == 900 and {v[0] for v in batch.values()} == {"Rejetée", "Acceptée"}
    for part in (range(0, 300), range(300, 900)):
        spark.createDataFrame([(i,) for i in part], "SK_ID_CURR bigint").write.mode("append").json(f"{tmp_path}/in")
    stream = requests.request_stream(spark, f"{tmp_path}/in", files_per_trigger=4)
    decided = requests.decide_stream(stream, wide, loaded)
    requests.write_decisions(decided, f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    assert {r[0]: (r[1], r[2]) for r in spark.read.parquet(f"{tmp_path}/out").collect()} == batch


def test_pipeline_equals_prepared_rows(data, scorer, wide):
    """Scoring raw rows and scoring prepared rows give the same probability."""
    raw = scorer.probabilities(wide.where("is_train"), "SK_ID_CURR").toPandas().set_index("SK_ID_CURR")["p"]
    rows = models.vectors(data.valid, FEATURES, "SK_ID_CURR")
    ready = models.predict(scorer.pipeline.stages[-1], rows).toPandas().set_index("SK_ID_CURR")["proba"]
    assert np.allclose(raw.loc[ready.index], ready)


def test_surrogate_follows_a_linear_model(data):
    bg = explain.background(data.valid, FEATURES)
    coef = [8.0, 0.0, 0.0]
    out = explain.local_surrogate(data.test, "SK_ID_CURR", FEATURES, bg, coef, -4.0, n=2, samples=800)
    again = explain.local_surrogate(data.test, "SK_ID_CURR", FEATURES, bg, coef, -4.0, n=2, samples=800)
    got = out.toPandas()
    assert len(got) == 400 and set(got["rank"]) == {1, 2}
    first = got[got["rank"] == 1]["feature"]
    # A row in the middle quarters has no strong feature; most rows name the only one that counts.
    assert first.str.contains(r"\ba\b").mean() > 0.7
    assert out.orderBy("SK_ID_CURR", "rank").collect() == again.orderBy("SK_ID_CURR", "rank").collect()


def test_surrogate_of_a_linear_model_is_the_same_by_either_way(data, scorer):
    bg, lr = explain.background(data.valid, FEATURES), scorer.pipeline.stages[-1]
    few = data.test.where("SK_ID_CURR < 730")
    direct = explain.local_surrogate(few, "SK_ID_CURR", FEATURES, bg, lr.coefficients.toArray(), float(lr.intercept), n=3, samples=300)
    scored = explain.model_surrogate(few, "SK_ID_CURR", FEATURES, bg, lr, n=3, samples=300)
    a, b = ({(r.SK_ID_CURR, r.feature): r.contribution for r in x.collect()} for x in (direct, scored))
    assert set(a) == set(b) and len(a) == 3 * few.count()
    assert max(abs(a[k] - b[k]) for k in a) < 1e-9


def test_perturbed_rows_are_never_whole_in_memory():
    """The rows around a linear request: what is drawn of them is a byte a cell, and their regression one copy."""
    rng, d, samples = np.random.default_rng(2), 100, 4000
    bg = {"edges": np.sort(rng.random((d, 3)), 1), "share": rng.dirichlet(np.ones(4), d), "stats": np.tile([0.5, 0.2, 0.0, 1.0], (d, 4, 1))}
    x, coef = rng.random(d), rng.normal(size=d)
    tracemalloc.start()
    chosen, weights = explain.surrogate_weights(x, 7, bg, coef, -0.3, samples, 5)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 3 * 8 * samples * d
    # The same as a plain ridge on whole rows.
    values, same = explain.perturbed(x, 7, bg, samples)
    score, w = 1 / (1 + np.exp(0.3 - values @ coef)), explain.nearness(same)
    z = np.c_[same, np.ones(samples)]
    plain = np.linalg.solve((z * w[:, None]).T @ z + np.diag([1.0] * d + [0.0]), (z * w[:, None]).T @ score)[:d]
    assert chosen.tolist() == np.argsort(-np.abs(plain), kind="stable")[:5].tolist()
    z = z[:, [*chosen, d]]
    plain = np.linalg.solve((z * w[:, None]).T @ z + np.diag([1.0] * 5 + [0.0]), (z * w[:, None]).T @ score)[:5]
    assert np.allclose(weights, plain, atol=1e-9)


def test_background_is_a_recount(spark):
    rng = np.random.default_rng(6)
    pdf = pd.DataFrame({"a": rng.normal(size=700), "b": rng.integers(0, 2, 700).astype(float), "c": 0.1, "d": rng.random(700)})
    pdf.loc[::9, "d"] = np.nan
    df = spark.createDataFrame(pdf).withColumn("d", F.nanvl("d", F.lit(None).cast("double"))).repartition(5)
    bg = explain.background(df, list("abcd"))
    assert bg["share"].shape == (4, 4) and bg["stats"].shape == (4, 4, 4)
    for i, c in enumerate("abcd"):
        v = pdf[c].dropna()
        quarter = (v.to_numpy()[:, None] > bg["edges"][i]).sum(1)
        for j in range(4):
            x = v[quarter == j]
            want = [x.mean(), x.std(ddof=0), x.min(), x.max()] if len(x) else [0.0] * 4
            assert bg["share"][i, j] == pytest.approx(len(x) / len(v)) and bg["stats"][i, j] == pytest.approx(want, abs=1e-12)


def test_surrogate_of_a_forest(spark, data):
    rows = models.vectors(add_class_weights(data.train, "TARGET"), FEATURES, "TARGET", "weight")
    model, bg = models.forest(rows, n_estimators=10, min_samples_leaf=5), explain.background(data.valid, FEATURES)
    few = data.test.where("SK_ID_CURR < 706").select("SK_ID_CURR", *FEATURES)
    odd = few.unionByName(few.where("SK_ID_CURR = 701")).unionByName(few.where("SK_ID_CURR = 702").withColumn("SK_ID_CURR", F.lit(None).cast("bigint")))
    got = explain.model_surrogate(odd, "SK_ID_CURR", FEATURES, bg, model, n=2, samples=200).collect()
    assert len(got) == 2 * odd.count() and sum(r.SK_ID_CURR == 701 for r in got) == 4
    for row in few.collect():
        x = np.array([row[c] for c in FEATURES])
        values, same = explain.perturbed(x, row.SK_ID_CURR, bg, 200)
        made = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(values)], ["i", *FEATURES]).coalesce(1)
        held = models.predict(model, models.vectors(made, FEATURES, "i")).toPandas().sort_values("i")
        w = explain.nearness(same)
        z = np.c_[same, np.ones(len(same))]
        penalty = np.diag([1.0, 1.0, 1.0, 0.0])
        plain = np.linalg.solve((z * w[:, None]).T @ z + penalty, (z * w[:, None]).T @ held["proba"].to_numpy())[:3]
        top = np.argsort(-np.abs(plain), kind="stable")[:2]
        z2 = np.c_[same[:, top], np.ones(len(same))]
        want = np.linalg.solve((z2 * w[:, None]).T @ z2 + np.diag([1.0, 1.0, 0.0]), (z2 * w[:, None]).T @ held["proba"].to_numpy())[:2]
        mine = sorted(r.contribution for r in got if r.SK_ID_CURR == row.SK_ID_CURR and r.rank <= 2)[:: 2 if row.SK_ID_CURR == 701 else 1]
        assert np.allclose(mine, sorted(want), atol=1e-9)
    assert explain.model_surrogate(odd.limit(0), "SK_ID_CURR", FEATURES, bg, model, n=2, samples=200).count() == 0


def test_dummy_and_split(spark, data):
    scored = models.dummy_scores(data.train, data.valid)
    assert metrics.roc_auc(scored, "TARGET", "proba").first()["auc"] == 0.5
    share = add_split(spark.range(5000), "id").where("part = 'train'").count() / 5000
    assert 0.77 < share < 0.83


def test_auto_histogram(data, scorer):
    held = models.predict(scorer.pipeline.stages[-1], models.vectors(data.valid, FEATURES, "TARGET"))
    low, high, bins = metrics.auto_bins(held, "proba")
    values = held.toPandas()["proba"].to_numpy()
    edges = np.histogram_bin_edges(values, "auto")
    assert bins == len(edges) - 1 and (low, high) == (edges[0], edges[-1])
    who = held.withColumn("id", F.monotonically_increasing_id()).toPandas()
    marked = metrics.marked_histogram(held.sparkSession.createDataFrame(who[["id", "proba"]]), "proba", "id", int(who["id"][3])).toPandas()
    for series, v in (("Rejetée", values), ("Acceptée", 1 - values)):
        mine = marked[marked.series == series].set_index("bin")
        counts, edges = np.histogram(v, bins)
        assert {b - 1: n for b, n in mine.n.items()} == {b: n for b, n in enumerate(counts.tolist()) if n}
        own = v[3] if series == "Rejetée" else 1 - who["proba"][3]
        (b,) = mine.index[mine.marked]
        assert edges[b - 1] - 1e-12 <= own <= edges[b] + 1e-12 and abs(mine.low[b] - edges[b - 1]) < 1e-12
    assert metrics.score_histogram(held, "proba", bins).agg(F.sum("n")).first()[0] == 2 * len(values)


def test_histograms_of_odd_scores(spark):
    def made(values):
        return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id bigint, p double")

    assert metrics.exact_quantiles(made([]), "p", [0.5]) == [] and metrics.marked_histogram(made([None]), "p", "id", 0).count() == 0
    assert sorted(map(tuple, metrics.marked_histogram(made([0.5, None, 0.5]), "p", "id", 1).collect())) == [
        ("Acceptée", 1, 0.5, 2, False), ("Rejetée", 1, 0.5, 2, False)]
    values = np.random.default_rng(3).integers(0, 40, 1001) / 40
    shares = [0.0, 0.1, 0.25, 0.333, 0.75, 1.0]
    assert np.allclose(metrics.exact_quantiles(made(values.tolist()), "p", shares), np.quantile(values, shares), atol=1e-12)
    repeated = made([0.1, 0.9]).union(made([0.2, 0.7])).union(made([0.4, 0.45]))
    assert {r.bin for r in metrics.marked_histogram(repeated, "p", "id", 0).where("marked and series = 'Rejetée'").collect()} == {1, 2}
