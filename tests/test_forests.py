"""Forests by their parts, out-of-bag errors, and searches that go on where they stopped."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ardoise.operators import forests, logistic, metrics, models, split
from ardoise.operators.split import add_class_weights
from ardoise.sources.workdir import fresh_path

FEATURES = ["a", "b", "c", "d"]


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 4))
    y = (x[:, 0] - x[:, 1] + rng.normal(size=400) > 0.8).astype(int)
    return spark.createDataFrame(pd.DataFrame(x, columns=FEATURES).assign(k=range(400), TARGET=y))


@pytest.fixture(scope="module")
def packed(rows):
    return models.vectors(add_class_weights(rows, "TARGET"), FEATURES, "k", "TARGET", "weight").cache()


def test_prefix_scores_are_means_of_the_first_trees(packed):
    model = models.forest(packed, n_estimators=7, max_depth=6, min_samples_leaf=2)
    got = {r.k: r.p for r in forests.prefix_scores(model, packed, [1, 4, 7]).select("k", "p").collect()}
    whole = {r.k: r.proba for r in models.predict(model, packed).select("k", "proba").collect()}
    first = {r.k: r.proba for r in models.predict(model.trees[0], packed).select("k", "proba").collect()}
    trees = [{r.k: r.proba for r in models.predict(t, packed).select("k", "proba").collect()} for t in model.trees[:4]]
    for k in got:
        np.testing.assert_allclose(got[k], [first[k], np.mean([t[k] for t in trees]), whole[k]], atol=1e-12)


def test_fits_are_shared_by_forests_of_one_shape():
    params = models.combinations(models.rf_grid(228))
    fits = models.fits_of("RF_clf", params)
    assert len(params) == 27 and len(fits) == 9 and {f["n_estimators"] for f, _ in fits} == {90}
    assert sorted(i for _, sizes in fits for i, _ in sizes) == list(range(27))
    assert all(params[i] == {**f, "n_estimators": n} for f, sizes in fits for i, n in sizes)


@pytest.mark.parametrize("per_bag", [1, 3])
def test_out_of_bag_error_is_a_recount(packed, per_bag):
    bagged = forests.with_bags(packed, "k", 8)
    forest = forests.bagged_forest(bagged, 8, per_bag, max_depth=5)
    sizes = [1, 4, 8 * per_bag]
    curve = {r.n: (r["rows"], r.error) for r in forests.error_curve(forests.left_out_votes(forest, bagged, sizes), sizes).collect()}
    # The same from the stored bags and each single tree's own scores.
    trees = [t for m in forest.models for t in m.trees]
    stored = bagged.select("k", "TARGET", "bags").toPandas().set_index("k")
    for i, t in enumerate(trees):
        stored[i] = models.predict(t, bagged).select("k", "proba").toPandas().set_index("k").proba
    for n in sizes:
        wrong = []
        for _, r in stored.iterrows():
            seen = [r[i] for i in range(n) if r.bags[i // per_bag] == 0]
            if seen:
                wrong.append((np.mean(seen) > 0.5) != (r.TARGET == 1))
        assert curve[n] == (len(wrong), pytest.approx(np.mean(wrong), abs=1e-12))
    # Bags are functions of the key: mean 1, a share 1/e of rows left out, and no tree of fewer bags changes.
    counts = np.vstack(stored.bags.to_numpy())
    assert abs(counts.mean() - 1) < 0.06 and abs((counts == 0).mean() - np.exp(-1)) < 0.04
    few = {r.k: r.bags for r in packed.select("k", forests.bag_counts("k", 3).alias("bags")).collect()}
    assert all(few[k] == list(b[:3]) for k, b in stored.bags.items())


@pytest.mark.parametrize("name,grid", [("LR_clf", {"C": [0.1, 1.0], "penalty": ["l2"]}), ("RF_clf", {"n_estimators": [2, 5], "min_samples_leaf": [2], "max_depth": [3]})])
def test_a_killed_search_goes_on(spark, rows, monkeypatch, name, grid):
    whole = models.grid_search(rows, name, grid, "k", FEATURES, n_fold=3)
    path, fitted, fit = fresh_path(spark, "search"), [], models.FITTERS[name]

    def failing(train, **params):
        if len(fitted) >= 2 * len(models.fits_of(name, models.combinations(grid))):
            raise InterruptedError
        fitted.append(params)
        return fit(train, **params)

    monkeypatch.setitem(models.FITTERS, name, failing)
    with pytest.raises(InterruptedError):
        models.grid_search(rows, name, grid, "k", FEATURES, n_fold=3, results=path, parallelism=1)
    assert {r.fold for r in spark.read.parquet(path).collect()} == {0, 1}
    fitted.clear()
    again = models.grid_search(rows, name, grid, "k", FEATURES, n_fold=3, results=path, parallelism=1)
    assert len(fitted) == len(models.fits_of(name, models.combinations(grid)))
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, whole.collect()))
    # Nothing is left to do; a larger grid fits only what is new.
    fitted.clear()
    models.grid_search(rows, name, grid, "k", FEATURES, n_fold=3, results=path)
    assert fitted == []


def test_score_table_equals_single_rows(spark):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"y": rng.integers(0, 2, 300), "s1": rng.integers(0, 9, 300) / 8, "s2": rng.random(300), "s3": 0.0})
    df = spark.createDataFrame(pdf).selectExpr("*", *[f"cast(s{i} > 0.5 as int) as p{i}" for i in (1, 2, 3)])
    got = {r.model: tuple(r)[1:] for r in metrics.score_table(df, "y", {f"m{i}": (f"s{i}", f"p{i}") for i in (1, 2, 3)}).collect()}
    for i in (1, 2, 3):
        assert got[f"m{i}"] == tuple(metrics.score_row(df, "y", f"s{i}", f"p{i}", "m").first())[1:]
    assert got["m3"] == (0.5, 0.0, 0.0, 0.0)


def test_a_large_logistic_search_fits_all_folds_at_once(spark, rows, monkeypatch):
    """Beyond the bound one pass over the rows serves all combinations and folds: no fit of its own, the same areas."""
    grid = {"C": [0.1, 10.0], "penalty": ["l1", "l2"]}
    alone = {(r.params, r.fold): r.auc for r in models.grid_search(rows, "LR_clf", grid, "k", FEATURES, n_fold=3).collect()}
    monkeypatch.setattr(forests, "LARGE", 10)
    monkeypatch.setitem(models.FITTERS, "LR_clf", None)
    path = fresh_path(spark, "search")
    models.grid_search(rows, "LR_clf", {"C": [0.1], "penalty": ["l1"]}, "k", FEATURES, n_fold=3, results=path)
    joint = models.grid_search(rows, "LR_clf", grid, "k", FEATURES, n_fold=3, results=path).collect()
    assert {(r.params, r.fold): r.auc for r in joint} == {k: pytest.approx(v, abs=2e-3) for k, v in alone.items()}
    assert len(joint) == 12 and spark.read.parquet(path).count() == 12


def test_joint_fits_reach_the_optimum_of_each_alone(rows):
    """Coefficients of one fold's models against Spark ML's, run to the end, and a column without spread."""
    folded = split.stratified_folds(rows.withColumn("flat", F.lit(3.0)), "TARGET", "k", 2)
    packed = models.vectors(folded, [*FEATURES, "flat"], "k", "TARGET", "fold").cache()
    counts = {c: {f: packed.where((F.col("TARGET") == c) & (F.col("fold") == f)).count() for f in (0, 1)} for c in (0, 1)}
    todo = [(f, {"C": c, "penalty": p}) for f in (0, 1) for c in (0.1, 10.0) for p in ("l1", "l2")]
    width = len(FEATURES) + 1
    got = logistic.fit_folds(logistic.row_blocks(packed, "TARGET", width), width, counts, todo, max_iter=500, tol=1e-10)
    for (fold, params), own in zip(todo, got.T):
        weight = models.balanced_weight({c: by[1 - fold] for c, by in counts.items()}, "TARGET")
        model = models.logistic(packed.where(F.col("fold") != fold).select("TARGET", weight.alias("weight"), "features"), max_iter=500, **params)
        assert own[:-1] == pytest.approx(model.coefficients.toArray(), abs=0.02 * max(1.0, np.abs(own).max()))
        assert own[-2] == 0.0
