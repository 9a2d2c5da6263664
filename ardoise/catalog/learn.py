"""Models, explanations and decisions on the given tables: fitted results, so most have no SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ardoise.catalog.cleaning import FEATURES, WIDE_CTES
from ardoise.catalog.registry import query
from ardoise.catalog.shared import prepared, scorer, vectors_of, wide_table
from ardoise.catalog.sqlgen import q
from ardoise.catalog.standin import load, role, with_roles
from ardoise.functions.exprs import FAVOURABLE, UNFAVOURABLE
from ardoise.operators import clean, explain, forests, metrics, models, smote
from ardoise.operators.models import LABEL
from ardoise.operators.split import add_class_weights
from ardoise.plans import scoring
from ardoise.plans.prepare import parts
from ardoise.plans.specs import KEY
from ardoise.sources import tables
from ardoise.sources.workdir import fresh_path
from ardoise.streaming import requests


def _smote_sql() -> str:
    """Scaled minority rows of the training part as lists, all distances between them, and the same hashes."""
    stats = ", ".join(
        f"count({q(c)}) as {q('n_' + c)}, median({q(c)}) as {q('m_' + c)}, min({q(c)}) as {q('l_' + c)}, max({q(c)}) as {q('h_' + c)}"
        for c in FEATURES
    )
    cells = ", ".join(
        f"case when {q('n_' + c)} * 100 >= 80 * s.n_rows then (coalesce({q(c)}, {q('m_' + c)}) - {q('l_' + c)}) "
        f"/ case when {q('h_' + c)} = {q('l_' + c)} then 1 else {q('h_' + c)} - {q('l_' + c)} end end"
        for c in FEATURES
    )

    def hashed(salt: str) -> str:
        return f"cast(('0x' || substr(md5(source || '|' || n || '|{salt}'), 1, 8)) as bigint) % 1000000007"

    return f"""with {WIDE_CTES}, s as materialized (select count(*) as n_rows, {stats} from cleared where part = 'train'),
      rows_ as materialized (
        select {KEY} as source, row_number() over (order by {KEY}) as i, list_filter([{cells}], lambda v: v is not null) as x
        from cleared, s where part = 'train' and TARGET = 1),
      sizes as (select count(case when TARGET = 1 then 1 end) as few, count(case when TARGET = 0 then 1 end) as many
                from cleared where part = 'train'),
      points as materialized (select x, min(source) as id, count(*) as copies from rows_ group by x),
      near as (
        select a.id, list(b.id order by list_distance(a.x, b.x), b.id)[1:5] as near
        from points a join points b on a.id <> b.id group by a.id),
      used as (
        select r.source, r.x, least(p.copies - 1, 5) as twins, coalesce(near, []) as near,
            unnest(range(1, i * (many - few) // few - (i - 1) * (many - few) // few + 1)) as n
        from rows_ r join points p using (x) left join near on near.id = p.id, sizes where few > 1),
      picked as (
        select *, {hashed('neighbour')} % least(twins + len(near), 5) as pick, {hashed('position')} / 1000000007e0 as u
        from used where twins + len(near) > 0),
      met as (
        select source, n, u, x, case when pick >= twins then near[pick - twins + 1] end as neighbour from picked),
      made as (
        select source, n, neighbour, u,
            list_transform(range(1, len(met.x) + 1), lambda j: met.x[j] + u * (coalesce(p.x, met.x)[j] - met.x[j])) as point
        from met left join points p on p.id = neighbour)
      select source, cast(n as integer) as n, neighbour, round(u, 9) as u, round(list_sum(point), 6) as total,
             round(list_min(point), 7) as lowest, round(list_max(point), 7) as highest from made"""


@query("smote", _smote_sql())
def oversampled(spark: SparkSession, folder: str) -> DataFrame:
    """Synthetic minority rows of the training part: source, use, neighbour, position, and the new point's sum and
    extremes over all features."""
    data = prepared(spark, folder)
    made = smote.synthetic_points(data.train, LABEL, KEY, data.preparation.features)
    if made is None:
        return spark.createDataFrame([], "source bigint, n int, neighbour bigint, u double, total double, lowest double, highest double")
    total = F.aggregate("point", F.lit(0.0), lambda a, x: a + x)
    return made.select(
        "source", "n", "neighbour", F.round("u", 9).alias("u"), F.round(total, 6).alias("total"),
        F.round(F.array_min("point"), 7).alias("lowest"), F.round(F.array_max("point"), 7).alias("highest"),
    )


@query("lr_fit_score")
def lr_fit_score(spark: SparkSession, folder: str) -> DataFrame:
    """Weighted logistic regression, scored on all training and validation rows."""
    data = prepared(spark, folder)
    features = data.preparation.features
    model = models.logistic(vectors_of(spark, folder))
    rows = data.train.withColumn("part", F.lit("train")).unionByName(data.valid.withColumn("part", F.lit("valid")))
    return models.predict(model, models.vectors(rows, features, KEY, "part", LABEL)).drop("features")


@query("rf_fit_score")
def rf_fit_score(spark: SparkSession, folder: str) -> DataFrame:
    data = prepared(spark, folder)
    features = data.preparation.features
    model = models.forest_of_any_size(vectors_of(spark, folder), n_estimators=50, min_samples_leaf=5)
    return models.predict(model, models.vectors(data.valid, features, KEY, LABEL)).drop("features")


@query("grid_cv")
def grid_cv(spark: SparkSession, folder: str) -> DataFrame:
    """All combinations of the logistic grid over five stratified folds: mean and spread of the AUC, ranked."""
    data = prepared(spark, folder)
    folds = models.grid_search(data.train, "LR_clf", models.LR_GRID, KEY, data.preparation.features)
    return models.cv_summary(folds)


@query("rf_grid_cv")
def rf_grid_cv(spark: SparkSession, folder: str) -> DataFrame:
    """All 27 combinations of the forest grid over two stratified folds, from nine forests per fold."""
    data = prepared(spark, folder)
    features = data.preparation.features
    folds = models.grid_search(data.train, "RF_clf", models.rf_grid(len(features)), KEY, features, n_fold=2)
    return models.cv_summary(folds)


@query("best_fold_scores")
def best_fold_scores(spark: SparkSession, folder: str) -> DataFrame:
    """AUC of every split (three folds, twice) for the best combination of the logistic grid, its parameters, and the AUC on
    the validation rows of the model refitted on all training rows."""
    data = prepared(spark, folder)
    features = data.preparation.features
    folds = models.grid_search(data.train, "LR_clf", models.LR_GRID, KEY, features, n_fold=3, n_fold_repeats=2)
    model, params, _ = models.refit_best(vectors_of(spark, folder), "LR_clf", models.LR_GRID, folds)
    held = models.predict(model, models.vectors(data.valid, features, LABEL))
    area = metrics.roc_auc(held, LABEL, "proba").select("auc").scalar()
    return models.best_fold_scores(folds).select("Fold", "AUC", F.lit(str(params)).alias("params"), area.alias("refit_auc"))


@query("model_scores")
def model_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Score table of majority class, logistic regression and forest on the same validation rows, in one pass, written as
    CSV and read again."""
    data = prepared(spark, folder)
    rows = models.dummy_scores(data.train, models.vectors(data.valid, data.preparation.features, KEY, LABEL))
    rows = rows.withColumnsRenamed({"prediction": "dummy_said", "proba": "dummy_p"})
    train = vectors_of(spark, folder)
    for name, model in (("LR", models.logistic(train)), ("RF", models.forest_of_any_size(train, n_estimators=50, min_samples_leaf=5))):
        rows = models.predict(model, rows).withColumnsRenamed({"prediction": f"{name}_said", "proba": f"{name}_p"})
    table = metrics.score_table(rows, LABEL, {f"{n}_clf": (f"{n}_p", f"{n}_said") for n in ("dummy", "LR", "RF")})
    path = fresh_path(spark, "scores")
    tables.write_result(table, path, "csv")
    return tables.read_result(spark, path, "model string, auc double, f1 double, recall double, precision double", "csv")


#: Bags of the error curve, and trees of each.
BAGS, PER_BAG = 20, 10


@query("tree_error_curve")
def tree_error_curve(spark: SparkSession, folder: str) -> DataFrame:
    """Error of the first 10, 20, .. 200 trees of one forest: on the training rows that their bags lack, and on the
    validation rows."""
    data, sizes = prepared(spark, folder), range(PER_BAG, BAGS * PER_BAG + 1, PER_BAG)
    features = data.preparation.features
    bagged = forests.with_bags(models.vectors(add_class_weights(data.train, LABEL), features, KEY, LABEL, "weight"), KEY, BAGS)
    forest = forests.bagged_forest(bagged, BAGS, PER_BAG, parallelism=8)
    out = forests.error_curve(forests.left_out_votes(forest, bagged, sizes), sizes)
    held = forests.error_curve(forests.mean_votes(forest, models.vectors(data.valid, features, LABEL), sizes), sizes)
    return out.withColumnsRenamed({"rows": "left_out_rows", "error": "left_out_error"}).join(held.drop("rows"), "n")


@query("global_importance")
def global_importance(spark: SparkSession, folder: str) -> DataFrame:
    """Ten heaviest coefficients of the fitted scorer."""
    lr = scorer(spark, folder).pipeline.stages[-1]
    features = prepared(spark, folder).preparation.features
    return explain.global_importance(explain.importance_table(spark, features, lr.coefficients.toArray()))


@query("rf_importance")
def rf_importance(spark: SparkSession, folder: str) -> DataFrame:
    data = prepared(spark, folder)
    model = models.forest_of_any_size(vectors_of(spark, folder), n_estimators=50, min_samples_leaf=5)
    table = explain.importance_table(spark, data.preparation.features, model.featureImportances.toArray())
    return explain.forest_importance(table)


@query("local_surrogate")
def local_surrogate(spark: SparkSession, folder: str) -> DataFrame:
    """Ten heaviest features per test request by a local regression around it."""
    data, lr = prepared(spark, folder), scorer(spark, folder).pipeline.stages[-1]
    features = data.preparation.features
    bg = explain.background(data.valid, features)
    return explain.local_surrogate(
        data.test, KEY, features, bg, lr.coefficients.toArray(), float(lr.intercept)
    )


@query("forest_surrogate")
def forest_surrogate(spark: SparkSession, folder: str) -> DataFrame:
    """Ten heaviest features per test request for a forest, from 1,000 perturbed rows around each."""
    data = prepared(spark, folder)
    features = data.preparation.features
    model = models.forest_of_any_size(vectors_of(spark, folder), n_estimators=50, min_samples_leaf=5)
    return explain.model_surrogate(data.test, KEY, features, explain.background(data.valid, features), model, samples=1000)


@query("batch_score")
def batch_score(spark: SparkSession, folder: str) -> DataFrame:
    """Decision and probability for every test request."""
    return scorer(spark, folder).decisions(parts(wide_table(spark, folder))[2])


@query("stream_score")
def stream_score(spark: SparkSession, folder: str) -> DataFrame:
    """The customers file as a stream of requests, decided by the saved scorer."""
    path = fresh_path(spark, "scorer")
    scorer(spark, folder).save(spark, path)
    loaded = scoring.Scorer.load(spark, path)
    stream = requests.request_stream(spark, folder, "c_custkey bigint", "parquet", glob="customer.parquet")
    stream = stream.withColumnRenamed("c_custkey", KEY)
    out, checkpoint = fresh_path(spark, "decisions"), fresh_path(spark, "stream")
    requests.write_decisions(requests.decide_stream(stream, wide_table(spark, folder), loaded), out, checkpoint).awaitTermination()
    return spark.read.schema(f"{KEY} bigint, rep string, proba double").parquet(out)


@query(
    "round_trip",
    f"""{with_roles('application', 'previous')}
    select 'csv' as kind, count(*) as n, count(NAME_INCOME_TYPE) as filled, round(sum(AMT_CREDIT), 2) as total from application
    union all select 'parquet', count(*), count(CNT_PAYMENT), round(sum(AMT_APPLICATION), 2) from previous
    union all select 'json', count(*), count(NAME_HOUSING_TYPE), round(sum(DAYS_BIRTH), 2) from application""",
)
def round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """Tables written and read back as CSV with declared types, as Parquet and as JSON."""
    app, previous = role(spark, folder, "application"), role(spark, folder, "previous")
    csv, parquet, json = (fresh_path(spark, n) for n in ("csv", "parquet", "json"))
    app.write.option("header", True).csv(csv)
    tables.write_dataset(previous, parquet)
    app.write.json(json)

    def summary(df: DataFrame, kind: str, filled: str, total: str) -> DataFrame:
        return df.agg(
            F.lit(kind).alias("kind"), F.count(F.lit(1)).alias("n"), F.count(filled).alias("filled"),
            F.round(F.sum(total), 2).alias("total"),
        )

    back = [
        summary(tables.read_csv(spark, csv), "csv", "NAME_INCOME_TYPE", "AMT_CREDIT"),
        summary(tables.read_table(spark, parquet), "parquet", "CNT_PAYMENT", "AMT_APPLICATION"),
        summary(spark.read.schema(app.schema).json(json), "json", "NAME_HOUSING_TYPE", "DAYS_BIRTH"),
    ]
    return back[0].unionByName(back[1]).unionByName(back[2])


@query(
    "decision_input",
    f"""{with_roles('application')} select SK_ID_CURR, cast(count(*) over () as bigint) as n_requests
        from application where IN_TRAIN = 0""",
)
def decision_input(spark: SparkSession, folder: str) -> DataFrame:
    """Requests to decide, taken back from the saved preparation's test rows: none is lost on the way."""
    path = fresh_path(spark, "preparation")
    data = prepared(spark, folder)
    data.preparation.save(spark, path)
    test = clean.Preparation.load(spark, path).apply(parts(wide_table(spark, folder))[2])
    total = test.agg(F.count(F.lit(1)).alias("n"))
    return test.select(KEY, total.scalar().alias("n_requests"))


# Labels that a hash of the order draws, more often positive the lower its priority, and balanced weights.
DRAWN_SQL = """
    with drawn as (select o_orderkey, cast(substr(o_orderpriority, 1, 1) as integer) as level,
        case when cast(('0x' || substr(md5(cast(o_orderkey as varchar)), 1, 8)) as bigint) % 100
            < 10 + 15 * cast(substr(o_orderpriority, 1, 1) as integer) then 1 else 0 end as y from orders),
    sized as (select y, count(*) as n from drawn group by y),
    weighted as (select level, y, (select sum(n) from sized) / (2e0 * n) as w from drawn join sized using (y)),
    shares as (select level, count(*) as n_rows, sum(case when y = 1 then w else 0 end) / sum(w) as p from weighted group by level)"""
LEVELS = [f"PRIORITY_{k}" for k in range(2, 6)]


def _saturated(spark: SparkSession, folder: str):
    """A logistic regression, hardly penalised, on the one-hot priority of orders: its optimum has a closed form."""
    orders = load(spark, folder, "orders")
    level = F.substring("o_orderpriority", 1, 1).cast("int")
    bucket = F.pmod(F.conv(F.substring(F.md5(F.col("o_orderkey").cast("string")), 1, 8), 16, 10).cast("long"), F.lit(100))
    rows = orders.select(level.alias("level"), (bucket < 10 + 15 * level).cast("int").alias(LABEL))
    rows = rows.withColumns({name: (F.col("level") == k).cast("double") for k, name in enumerate(LEVELS, 2)})
    rows = models.vectors(add_class_weights(rows, LABEL), LEVELS, "level", LABEL, "weight")
    return models.logistic(rows, C=1e6), rows


@query("lr_closed_form", f"{DRAWN_SQL} select level, n_rows, round(p, 3) as proba from shares")
def lr_closed_form(spark: SparkSession, folder: str) -> DataFrame:
    """A fitted model against SQL: with one parameter per group, the probabilities are the groups' weighted shares."""
    model, rows = _saturated(spark, folder)
    scored = models.predict(model, rows)
    return scored.groupBy("level").agg(F.count(F.lit(1)).alias("n_rows"), F.round(F.avg("proba"), 3).alias("proba"))


@query(
    "importance_closed_form",
    f"""{DRAWN_SQL}, base as (select ln(p / (1 - p)) as b from shares where level = 1),
    c as (select 'PRIORITY_' || level as Features, ln(p / (1 - p)) - b as x from shares, base where level > 1)
    select cast(row_number() over (order by abs(x) desc, Features) as integer) as rank, Features, round(x, 2) as Importance,
        left(trim(Features, '<= 0.00 0.46'), 25) as label, case when x > 0 then '{UNFAVOURABLE}' else '{FAVOURABLE}' end as effect from c""",
)
def importance_closed_form(spark: SparkSession, folder: str) -> DataFrame:
    """Coefficients of that model as a table of importance: differences of log odds to the first priority."""
    model, _ = _saturated(spark, folder)
    table = explain.importance_table(spark, LEVELS, model.coefficients)
    return explain.global_importance(table).withColumn("Importance", F.round("Importance", 2))

