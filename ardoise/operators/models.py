"""Models on Spark ML: majority class, logistic regression, random forest; grid search with stratified
folds."""

from __future__ import annotations

import time
from collections.abc import Mapping, Sequence
from functools import reduce
from itertools import product
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml.classification import (
    LogisticRegression,
    LogisticRegressionModel,
    RandomForestClassificationModel,
    RandomForestClassifier,
)
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ardoise.operators import forests, logistic as joint, treetable
from ardoise.operators.forests import prefix_scores
from ardoise.operators.metrics import roc_auc
from ardoise.operators.smote import oversample
from ardoise.operators.split import FOLDS, REPEATS, stratified_folds
from ardoise.sources.workdir import fresh_path, materialise

LABEL = "TARGET"
SEED = 42
# Spark's decision trees go no deeper.
MAX_DEPTH = 30

# The grid of the logistic regression.
LR_GRID = {"C": [0.1, 1.0, 10.0, 100.0], "penalty": ["l1", "l2"]}


def rf_grid(n_features: int) -> dict[str, list]:
    """The grid of the random forest; depths follow from the number of features.

    The grid asks for a half, a third and a quarter of that number.  Where a half is deeper than Spark's trees
    go, the three keep their ratios below the deepest tree, so that no two combinations are the same model.
    """
    deepest = max(3, min(n_features // 2, MAX_DEPTH))
    depths = [deepest, deepest * 2 // 3, deepest // 2]
    return {"n_estimators": [50, 70, 90], "min_samples_leaf": [2, 5, 10], "max_depth": depths}


def assembler(features: Sequence[str]) -> VectorAssembler:
    """Feature vector in frozen order; a missing value is an error here, cleaning comes first."""
    return VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="error")


def vectors(df: DataFrame, features: Sequence[str], *keep: str) -> DataFrame:
    return assembler(features).transform(df).select(*keep, "features")


def dummy_scores(train: DataFrame, scored: DataFrame, label: str = LABEL) -> DataFrame:
    """Baseline: every row gets the most frequent training class (the smaller one on a tie)."""
    counts = train.groupBy(F.col(label).cast("int").alias("c")).agg(F.count(F.lit(1)).alias("n"))
    top = counts.agg(F.min_by("c", F.struct((-F.col("n")).alias("n"), "c"))).scalar()
    return scored.withColumn("prediction", top).withColumn("proba", F.col("prediction").cast("double"))


def logistic(rows: DataFrame, C: float = 1.0, penalty: str = "l2", weight: str = "weight", max_iter: int = 100,
             label: str = LABEL) -> LogisticRegressionModel:
    """Weighted logistic regression.  ``C`` is the inverse strength over the *sum* of losses; Spark's
    ``regParam`` is over the weighted mean, hence the division."""
    if penalty not in ("l1", "l2"):
        raise ValueError("penalty must be 'l1' or 'l2'")
    total = rows.agg(F.sum(weight)).first()[0]
    return LogisticRegression(
        labelCol=label, weightCol=weight, maxIter=max_iter, tol=1e-6, standardization=False,
        regParam=1.0 / (C * total), elasticNetParam=1.0 if penalty == "l1" else 0.0,
    ).fit(rows)


def forest(rows: DataFrame, n_estimators: int = 100, min_samples_leaf: int = 1, max_depth: int = MAX_DEPTH,
           weight: str = "weight", label: str = LABEL) -> RandomForestClassificationModel:
    """Weighted random forest with square-root feature subsets.  Spark's trees have a greatest depth; asking
    for a deeper one is an error."""
    if max_depth > MAX_DEPTH:
        raise ValueError(f"max_depth is {max_depth}; Spark's trees are at most {MAX_DEPTH} deep")
    return RandomForestClassifier(
        labelCol=label, weightCol=weight, numTrees=n_estimators, minInstancesPerNode=min_samples_leaf,
        maxDepth=int(max_depth), featureSubsetStrategy="sqrt", seed=SEED,
        maxMemoryInMB=512,
    ).fit(rows)


def forest_of_any_size(rows: DataFrame, n_estimators: int = 100, min_samples_leaf: int = 1, max_depth: int = MAX_DEPTH,
                       weight: str = "weight", label: str = LABEL) -> RandomForestClassificationModel | treetable.TableForest:
    """``forest``; beyond ``forests.LARGE`` rows as a table, with nodes neither in the driver nor grown pass by pass."""
    n = rows.count()
    if n <= forests.LARGE:
        return forest(rows, n_estimators, min_samples_leaf, max_depth, weight, label)
    if max_depth > MAX_DEPTH:
        raise ValueError(f"max_depth is {max_depth}; trees are at most {MAX_DEPTH} deep")
    return treetable.fit(rows.select(label, weight, "features"), n, n_estimators, 1, min_samples_leaf, int(max_depth), weight, label)


FITTERS = {"LR_clf": logistic, "RF_clf": forest_of_any_size}


def predict(model, rows: DataFrame) -> DataFrame:
    """Add ``proba`` (of class 1) and ``prediction`` (0/1); the model's vector columns go."""
    if isinstance(model, treetable.TableForest):
        scored = prefix_scores(model, rows, [len(model.tops)], "_p")
        proba = F.col("_p")[0]
        return scored.select(*rows.columns, proba.alias("proba"), (proba > 0.5).cast("int").alias("prediction"))
    out = model.transform(rows)
    return out.select(
        *rows.columns,
        vector_to_array("probability")[1].alias("proba"),
        F.col("prediction").cast("int").alias("prediction"),
    )


def combinations(grid: Mapping[str, Sequence]) -> list[dict]:
    return [dict(zip(grid, values)) for values in product(*grid.values())]


#: One row per model, combination, repeat and fold.
RESULTS = "model string, params_id int, params string, repeat int, fold int, auc double"


def fits_of(model_name: str, params: Sequence[dict]) -> list[tuple[dict, list[tuple[int, int | None]]]]:
    """What to fit, and which combinations each fit scores: forests that differ by their number of trees only are the
    first trees of one forest."""
    if model_name != "RF_clf":
        return [(p, [(i, None)]) for i, p in enumerate(params)]
    shared: dict[tuple, list[tuple[int, int]]] = {}
    for i, p in enumerate(params):
        rest = tuple((k, v) for k, v in p.items() if k != "n_estimators")
        shared.setdefault(rest, []).append((i, p.get("n_estimators", 100)))
    return [({**dict(rest), "n_estimators": max(n for _, n in sizes)}, sizes) for rest, sizes in shared.items()]


def balanced_weight(counts: Mapping[int, int], label: str) -> Column:
    """Weight that makes all classes equally heavy, from the number of rows of each."""
    present = {c: n for c, n in counts.items() if n}
    total, weight = sum(present.values()), F.lit(None).cast("double")
    for c, n in present.items():
        weight = F.when(F.col(label).cast("int") == c, F.lit(total / (len(present) * n))).otherwise(weight)
    return weight


def _scored_by(rows: DataFrame, model, sizes: Sequence[tuple[int, int | None]], name: str) -> tuple[DataFrame, list]:
    """The rows with the scores of one fit, and a (params_id, proba) for each combination."""
    if sizes[0][1] is None:
        model.setProbabilityCol(name).setRawPredictionCol("").setPredictionCol("")
        rows, scores = model.transform(rows), [vector_to_array(name)[1]]
    else:
        rows = prefix_scores(model, rows, [n for _, n in sizes], name)
        scores = [F.col(name)[j] for j in range(len(sizes))]
    return rows, [F.struct(F.lit(i).alias("params_id"), s.alias("proba")) for (i, _), s in zip(sizes, scores)]


def _kept_results(rows: DataFrame, path: str, model_name: str) -> DataFrame:
    """Results of earlier runs of this search."""
    spark = rows.sparkSession
    try:
        return spark.read.schema(RESULTS).parquet(path).where(F.col("model") == model_name)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], RESULTS)


def _joint_areas(packed: DataFrame, params: Sequence[dict], todo: Mapping[int, set[int]], counts: Mapping[int, Mapping[int, int]],
                 width: int, label: str) -> DataFrame:
    """(fold, params_id, auc) of the logistic combinations still to do, all fitted in the same passes over the rows."""
    cells = [(f, i) for f in sorted(todo) for i in sorted(todo[f])]
    blocks = joint.cached(joint.row_blocks(packed, label, width))
    try:
        fitted = joint.fit_folds(blocks, width, counts, [(f, params[i]) for f, i in cells])
        # ``roc_auc`` writes the scores, so the blocks are not read after this.
        return roc_auc(joint.held_out_scores(blocks, width, cells, fitted, label), label, "proba", ["fold", "params_id"])
    finally:
        blocks.unpersist()


def _forest_areas(train: DataFrame, held: DataFrame, n: int, params: Sequence[dict], todo: set[int], label: str, parallelism: int) -> DataFrame:
    """(params_id, auc) of a fold's forest combinations still to do, with forests as tables.

    Combinations that differ by trees and depth only are scored from one forest: fewer trees are its first ones, and a tree of
    less depth is the upper part of a deeper one.  All forests of a fold start from the same coded rows and bags.
    """
    shapes: dict[tuple, list[tuple[int, int, int]]] = {}
    for i in sorted(todo):
        p = {"n_estimators": 100, "min_samples_leaf": 1, "max_depth": MAX_DEPTH, **params[i]}
        if p["max_depth"] > MAX_DEPTH:
            raise ValueError(f"max_depth is {p['max_depth']}; trees are at most {MAX_DEPTH} deep")
        shapes.setdefault((p["min_samples_leaf"],), []).append((i, p["n_estimators"], int(p["max_depth"])))
    trees = max(size for cells in shapes.values() for _, size, _ in cells)
    training = treetable.Training.of(train, n, trees, 1, "weight", label)
    coded = treetable.coded_rows(held, training.limits, label)

    def scored(shape: tuple[tuple, list[tuple[int, int, int]]]) -> DataFrame:
        (least,), cells = shape
        forest = treetable.fit_coded(training, max(size for _, size, _ in cells), least, max(depth for *_, depth in cells))
        return forest.mean_scores(coded, cells, label)

    with ThreadPool(min(parallelism, len(shapes))) as pool:
        scores = pool.map(inheritable_thread_target(train.sparkSession)(scored), shapes.items())
    return roc_auc(reduce(DataFrame.unionByName, scores), label, "proba", ["params_id"])


def grid_search(
    rows: DataFrame,
    model_name: str,
    grid: Mapping[str, Sequence],
    key: str,
    features: Sequence[str],
    class_imb: str = "CW",
    n_fold: int = FOLDS,
    n_fold_repeats: int = REPEATS,
    label: str = LABEL,
    parallelism: int = 8,
    results: str | None = None,
) -> DataFrame:
    """Area under the curve for every parameter combination and held-out fold.

    Returns (params_id, params, repeat, fold, auc).  ``class_imb`` is ``CW`` (balanced class weights) or
    ``SMOTE`` (synthetic minority rows in the training folds).  Fits run side by side from a few driver
    threads; each is a distributed job.  The rows are packed into vectors once per repeat and filtered by fold.

    The rows of a fold are appended to ``results`` (Parquet) when all its combinations are scored.  A search that is
    started again with the same folder goes on with the folds and combinations that are not there yet: folds are
    functions of the key, so it ends with the table of an undisturbed run.

    Beyond ``forests.LARGE`` rows the logistic combinations of all folds are fitted in the same passes over the rows, which
    are held once; their rows are appended together.  Forests of that many rows are tables, and those that differ by trees and
    depth only are one.
    """
    if class_imb not in ("CW", "SMOTE"):
        raise ValueError("class_imb must be 'CW' or 'SMOTE'")
    fit, params = FITTERS[model_name], combinations(grid)
    spark = rows.sparkSession
    results = results or fresh_path(spark, "results")
    # One row per combination and fold.
    kept = {(r["params"], r["repeat"], r["fold"]) for r in _kept_results(rows, results, model_name).collect()}
    names = [str(p) for p in params]
    for repeat in range(n_fold_repeats):
        todo = {f: {i for i, n in enumerate(names) if (n, repeat, f) not in kept} for f in range(n_fold)}
        if not any(todo.values()):
            continue
        folded = stratified_folds(rows.select(key, label, *features), label, key, n_fold, repeat)
        if class_imb == "SMOTE":
            folded = materialise(folded, "folds")
        # Laid out by key: the bags of a forest depend on where its rows lie, and another run shall draw the same.
        packed = vectors(folded, features, key, label, "fold").repartition(key).sortWithinPartitions(key)
        packed = materialise(packed, "vectors")
        counts: dict[int, dict[int, int]] = {}
        # One row per class and fold.
        for r in packed.groupBy(F.col(label).cast("int").alias("c"), "fold").count().where("c is not null").collect():
            counts.setdefault(r["c"], {})[r["fold"]] = r["count"]
        # Every fold must leave rows of both classes to fit on.
        fair = set(counts) == {0, 1} and all(len(by) > 1 for by in counts.values())
        many = sum(sum(by.values()) for by in counts.values()) > forests.LARGE
        if model_name == "LR_clf" and class_imb == "CW" and fair and many:
            # One row per combination.
            named = F.broadcast(spark.createDataFrame(list(enumerate(names)), "params_id int, params string"))
            areas = _joint_areas(packed, params, todo, counts, len(features), label)
            tags = [F.lit(model_name).alias("model"), "params_id", "params", F.lit(repeat).alias("repeat"), "fold", "auc"]
            areas.join(named, "params_id").select(*tags).coalesce(1).write.mode("append").parquet(results)
            continue
        for fold in (f for f in range(n_fold) if todo[f]):
            if class_imb == "SMOTE":
                train = oversample(folded.where(F.col("fold") != fold), label, key, features)
                train = materialise(vectors(train.withColumn("weight", F.lit(1.0)), features, label, "weight"), "fold")
            else:
                # A projection of the packed rows.  Spark ML caches its own blocks; a copy would only take space.
                weight = balanced_weight({c: sum(n for f, n in by.items() if f != fold) for c, by in counts.items()}, label)
                train = packed.where(F.col("fold") != fold).select(label, weight.alias("weight"), "features")
            held = packed.where(F.col("fold") == fold).select(label, "features")
            n = train.count() if model_name == "RF_clf" else 0
            if n > forests.LARGE:
                areas = _forest_areas(train, held, n, params, todo[fold], label, parallelism)
            else:
                fits = [(p, [s for s in sizes if s[0] in todo[fold]]) for p, sizes in fits_of(model_name, params)]
                fits = [(p, sizes) for p, sizes in fits if sizes]
                with ThreadPool(min(parallelism, len(fits))) as pool:
                    one = inheritable_thread_target(spark)(lambda f, train=train: fit(train, label=label, **f[0]))
                    models = pool.map(one, fits)
                # All models of the fold score its held-out rows in one scan.
                cells = []
                for j, (model, (_, sizes)) in enumerate(zip(models, fits)):
                    held, more = _scored_by(held, model, sizes, f"_p{j}")
                    cells += more
                areas = roc_auc(held.select(label, F.inline(F.array(*cells))), label, "proba", ["params_id"])
            named = spark.createDataFrame([(i, names[i]) for i in sorted(todo[fold])], "params_id int, params string")
            tags = [F.lit(repeat).alias("repeat"), F.lit(fold).alias("fold")]
            out = areas.join(F.broadcast(named), "params_id").select(F.lit(model_name).alias("model"), "params_id", "params", *tags, "auc")
            out.coalesce(1).write.mode("append").parquet(results)
    # The numbers of this grid, should another one have written to the folder.
    number = spark.createDataFrame(list(enumerate(names)), "params_id int, params string")
    done = _kept_results(rows, results, model_name).drop("params_id", "model").where(F.col("repeat") < n_fold_repeats)
    return done.join(F.broadcast(number), "params").select("params_id", "params", "repeat", "fold", "auc")


def cv_summary(folds: DataFrame) -> DataFrame:
    """Mean and (population) standard deviation of the AUC per combination, ranked; rank 1 is refitted."""
    stats = folds.groupBy("params_id", "params").agg(
        F.avg("auc").alias("mean_auc"), F.stddev_pop("auc").alias("std_auc"), F.count(F.lit(1)).alias("n_splits")
    )
    # One row per parameter combination.
    return stats.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("mean_auc"), "params_id")))


def best_fold_scores(folds: DataFrame) -> DataFrame:
    """AUC of every split for the best combination, numbered from 1."""
    best = cv_summary(folds).where(F.col("rank") == 1).select("params_id")
    number = F.row_number().over(Window.orderBy("repeat", "fold"))
    return folds.join(best, "params_id", "left_semi").select(number.alias("Fold"), F.col("auc").alias("AUC"))


def refit_best(rows: DataFrame, model_name: str, grid: Mapping[str, Sequence], folds: DataFrame, label: str = LABEL):
    """(model, parameters, seconds) of the winner, fitted on all rows (vectors with weights)."""
    best = cv_summary(folds).where(F.col("rank") == 1).first()["params_id"]
    params = combinations(grid)[best]
    start = time.perf_counter()
    model = FITTERS[model_name](rows, label=label, **params)
    return model, params, time.perf_counter() - start


def tree_error_curve(
    model: RandomForestClassificationModel | treetable.TableForest, held: DataFrame, sizes: Sequence[int], label: str = LABEL
) -> DataFrame:
    """Error on held-out rows of the first n trees, for each n: one scan, all trees scored side by side."""
    rows = held.select(label, "features")
    if isinstance(model, treetable.TableForest):
        # As ``predict`` adds the trees up.
        return forests.error_curve(prefix_scores(model, rows, sizes, "votes"), sizes, label=label).drop("rows")
    probabilities = []
    for i, tree in enumerate(model.trees[: max(sizes)]):
        tree.setProbabilityCol(f"_p{i}").setRawPredictionCol("").setPredictionCol("")
        rows = tree.transform(rows)
        probabilities.append(vector_to_array(f"_p{i}")[1])
    scored = rows.select(F.col(label).cast("int").alias("y"), F.array(*probabilities).alias("p"))
    # Inside the row: the vote of the first n trees for each n.
    votes = F.expr(
        f"transform(array({', '.join(str(n) for n in sizes)}), n -> named_struct('n', n, 'wrong', "
        "cast((aggregate(slice(p, 1, n), 0d, (a, x) -> a + x) / n > 0.5) <> (y = 1) as int)))"
    )
    return scored.select(F.inline(votes)).groupBy("n").agg(F.avg("wrong").alias("error"))
