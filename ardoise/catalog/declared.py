"""Scoring with declared numbers, files and result tables: what SQL can say about the fitted half."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ardoise.catalog import features
from ardoise.catalog.registry import query
from ardoise.catalog.shared import prepared, vectors_of
from ardoise.catalog.sqlgen import q
from ardoise.catalog.standin import load, role, with_roles
from ardoise.operators import explain, models, smote
from ardoise.operators.clean import Preparation
from ardoise.operators.models import LABEL
from ardoise.plans import scoring
from ardoise.plans.specs import KEY
from ardoise.sources import tables
from ardoise.sources.store import FeatureStore
from ardoise.sources.workdir import fresh_path, materialise
from ardoise.streaming import requests

# Declared scorecard: feature, median, range, coefficient.  No applicant has the last feature's category.
SCORECARD = [
    ("DAYS_BIRTH", -16000.0, -25000.0, -7000.0, 1.5),
    ("AMT_INCOME_TOTAL", 110000.0, 20000.0, 200000.0, -0.75),
    ("AMT_CREDIT", 500000.0, 0.0, 950000.0, 1.25),
    ("AMT_ANNUITY", 27000.0, 2000.0, 52000.0, 0.5),
    ("BURO_CREDIT_ACTIVE_Sold_MEAN", 0.25, 0.0, 1.0, -2.0),
]
INTERCEPT, THRESHOLD = -1.125, 0.52


def declared_scorer(card: list = SCORECARD) -> scoring.Scorer:
    """A scorer whose preparation and model are given numbers."""
    p = Preparation([s[0] for s in card], [], {s[0]: s[1] for s in card}, {s[0]: (s[2], s[3]) for s in card}, 0, {})
    z = " + ".join([str(INTERCEPT), *[f"({s[4]}) * `s_{s[0]}`" for s in card]])
    odds = SQLTransformer(statement=f"select *, 1 / (1 + exp({z})) as _p0, 1 / (1 + exp(-({z}))) as _p1 from __THIS__")
    both = VectorAssembler(inputCols=["_p0", "_p1"], outputCol="probability")
    return scoring.Scorer(scoring.as_pipeline(p, PipelineModel([odds, both])), THRESHOLD)


def _scorecard_sql(rows: str) -> str:
    def scaled(name: str, median: float, low: float, high: float, absent: bool) -> str:
        value = "0e0" if absent else f"coalesce({name}, {median}e0)"
        return f"(({value}) - ({low}e0)) / ({high}e0 - ({low}e0))"

    z = " + ".join([f"({INTERCEPT}e0)", *[f"({c}e0) * {scaled(n, m, lo, hi, n.startswith('BURO'))}" for n, m, lo, hi, c in SCORECARD]])
    return f"""{with_roles('application')},
        scored as (select SK_ID_CURR, IN_TRAIN, 1 / (1 + exp(-({z}))) p from application)
        select SK_ID_CURR, case when p > {THRESHOLD} then 'Rejetée' else 'Acceptée' end rep, round(p, 2) proba from scored {rows}"""


@query("declared_decisions", _scorecard_sql("where IN_TRAIN = 0"))
def declared_decisions(spark: SparkSession, folder: str) -> DataFrame:
    """Decisions of a saved and reloaded scorer with declared numbers; the test table lacks one of its features."""
    path = fresh_path(spark, "scorer")
    declared_scorer().save(spark, path)
    return scoring.Scorer.load(spark, path).decisions(role(spark, folder, "application").where("IN_TRAIN = 0"))


def _monthly_sql() -> str:
    """The scorecard over next month's features of the requests."""
    def scaled(name: str, median: float, low: float, high: float) -> str:
        return f"((coalesce(cast({q(name)} as double), {median}e0)) - ({low}e0)) / ({high}e0 - ({low}e0))"

    z = " + ".join([f"({INTERCEPT}e0)", *[f"({c}e0) * {scaled(n, m, lo, hi)}" for n, m, lo, hi, c in MONTHLY]])
    return f"""with {', '.join(f'{n} as ({s})' for n, s in features.next_month_ctes().items())},
        scored as (select SK_ID_CURR, 1 / (1 + exp(-({z}))) p from wide where not is_train)
        select SK_ID_CURR, case when p > {THRESHOLD} then 'Rejetée' else 'Acceptée' end rep, round(p, 2) proba from scored"""


# Features of the application and of history: coded, one-hot, shares of categories that are gone, came, or stayed.
MONTHLY = SCORECARD[:2] + [
    ("CODE_GENDER", 0.0, -1.0, 2.0, 0.5),
    ("NAME_INCOME_TYPE_MACHINERY", 0.0, 0.0, 1.0, 2.0),
    ("BURO_CREDIT_ACTIVE_Sold_MEAN", 0.25, 0.0, 1.0, -2.0),
    ("BURO_CREDIT_ACTIVE_Active_MEAN", 0.5, 0.0, 1.0, 0.75),
    ("BURO_STATUS_N_MEAN_MEAN", 0.5, 0.0, 1.0, 0.625),
]


@query("monthly_decisions", _monthly_sql())
def monthly_decisions(spark: SparkSession, folder: str) -> DataFrame:
    """Decisions about next month's requests, from raw tables, by one saved and reloaded pipeline with declared numbers."""
    scorer = declared_scorer(MONTHLY)
    pipeline, both = features.saved_encoder(spark, folder, scorer.pipeline.stages)
    return scoring.Scorer(pipeline, scorer.threshold).decisions(both.where("not is_train"))


STREAM_SQL = f"""with known as ({_scorecard_sql("where IN_TRAIN = 0")})
    select c.c_custkey as SK_ID_CURR, coalesce(rep, 'Inconnue') rep, proba
    from customer c left join known on SK_ID_CURR = c_custkey"""


@query("declared_stream", STREAM_SQL)
def declared_stream(spark: SparkSession, folder: str) -> DataFrame:
    """The customers file as a stream of requests: one answer each, also where no features are known."""
    stream = requests.request_stream(spark, folder, "c_custkey bigint", "parquet", glob="customer.parquet")
    wide = role(spark, folder, "application").where("IN_TRAIN = 0")
    answers = requests.decide_stream(stream.withColumnRenamed("c_custkey", KEY), wide, declared_scorer())
    out, checkpoint = fresh_path(spark, "decisions"), fresh_path(spark, "stream")
    requests.write_decisions(answers, out, checkpoint).awaitTermination()
    return spark.read.schema(f"{KEY} bigint, rep string, proba double").parquet(out)


@query("stored_stream", STREAM_SQL)
def stored_stream(spark: SparkSession, folder: str) -> DataFrame:
    """The same requests, answered from a store of the features."""
    stream = requests.request_stream(spark, folder, "c_custkey bigint", "parquet", glob="customer.parquet")
    wide = materialise(role(spark, folder, "application").where("IN_TRAIN = 0"), "wide")
    store = FeatureStore.write(wide, fresh_path(spark, "store"), KEY)
    out, checkpoint = fresh_path(spark, "decisions"), fresh_path(spark, "stream")
    requests.decide_from_store(stream.withColumnRenamed("c_custkey", KEY), store, declared_scorer(), out, checkpoint).awaitTermination()
    return requests.read_decisions(spark, out)


@query(
    "csv_types",
    """select o_orderkey as whole_number, o_totalprice as amount, o_orderstatus as CHANNEL_TYPE,
        nullif(o_orderpriority, '5-LOW') as product_combination, case when o_orderkey % 3 = 0 then o_orderkey % 50 end as sparse,
        case when o_orderkey % 97 = 0 then 'n/a' else cast(o_orderkey % 10 as varchar) end as mixed from orders""",
)
def csv_types(spark: SparkSession, folder: str) -> DataFrame:
    """Columns of any name written as CSV and read back with the types that their values have."""
    orders, path = load(spark, folder, "orders"), fresh_path(spark, "csv")
    orders.selectExpr(
        "o_orderkey as whole_number", "o_totalprice as amount", "o_orderstatus as CHANNEL_TYPE",
        "nullif(o_orderpriority, '5-LOW') as product_combination", "case when o_orderkey % 3 = 0 then o_orderkey % 50 end as sparse",
        "case when o_orderkey % 97 = 0 then 'n/a' else cast(o_orderkey % 10 as string) end as mixed",
    ).write.option("header", True).csv(path)
    return tables.read_csv(spark, path)


@query(
    "result_tables",
    """select 'scores' as kind, o_orderpriority as name, round(avg(o_totalprice), 4) as value from orders group by 2
        union all select 'coefficients', o_orderstatus, round(max(o_totalprice), 4) from orders group by 2""",
)
def result_tables(spark: SparkSession, folder: str) -> DataFrame:
    """Small result tables written and read again: scores as CSV, coefficients as JSON."""
    orders, out = load(spark, folder, "orders"), []
    for kind, by, value, fmt in (("scores", "o_orderpriority", F.avg("o_totalprice"), "csv"), ("coefficients", "o_orderstatus", F.max("o_totalprice"), "json")):
        path = fresh_path(spark, kind)
        tables.write_result(orders.groupBy(F.col(by).alias("name")).agg(F.round(value, 4).alias("value")), path, fmt)
        out.append(tables.read_result(spark, path, "name string, value double", fmt).select(F.lit(kind).alias("kind"), "name", "value"))
    return out[0].unionByName(out[1])


@query(
    "smote_counts",
    f"""{with_roles('application')},
        t as (select TARGET y, count(*) n from application
              where IN_TRAIN = 1 and cast(('0x' || substr(md5(cast(SK_ID_CURR as varchar)), 1, 8)) as bigint) % 100 < 80 group by 1)
        select y, (select max(n) from t) n_rows from t""",
)
def smote_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of each class after oversampling the training part: as many as the larger class has."""
    data = prepared(spark, folder)
    both = smote.oversample(data.train, LABEL, KEY, data.preparation.features)
    return both.groupBy(F.col(LABEL).cast("int").alias("y")).agg(F.count(F.lit(1)).alias("n_rows"))


@query("fit_properties", "select unnest(['forest importances', 'optimal coefficients', 'error curve end']) as property, true as holds")
def fit_properties(spark: SparkSession, folder: str) -> DataFrame:
    """Property checks of the fitted models over all training or validation rows, not an equality.

    The forest's importances sum to 1; no coefficient of the logistic regression can be moved for a smaller loss
    (the gradient is small against its parts); the error curve ends at the error of the whole forest.
    """
    data = prepared(spark, folder)
    features, rows = data.preparation.features, vectors_of(spark, folder)
    forest = models.forest_of_any_size(rows, n_estimators=20, min_samples_leaf=5)
    lr = models.logistic(rows)
    total = rows.agg(F.sum("weight")).first()[0]
    p = models.predict(lr, rows)
    from pyspark.ml.stat import Summarizer

    pull = p.select("features", ((F.col("proba") - F.col(LABEL)) * F.col("weight")).alias("d"))
    up = pull.where("d > 0").select(Summarizer.mean(F.col("features"), F.col("d")), F.sum("d")).first()
    down = pull.where("d <= 0").select(Summarizer.mean(F.col("features"), -F.col("d")), F.sum(-F.col("d"))).first()
    above, below = up[0].toArray() * up[1], down[0].toArray() * down[1]
    slope = (above - below + lr.coefficients.toArray()) / total
    held = models.vectors(data.valid, features, LABEL)
    end = models.tree_error_curve(forest, held, [20]).first()["error"]
    wrong = models.predict(forest, held).agg(F.avg((F.col("prediction") != F.col(LABEL)).cast("int"))).first()[0]
    found = [
        ("forest importances", abs(float(forest.featureImportances.toArray().sum()) - 1) < 1e-9),
        ("optimal coefficients", bool(abs(slope).max() < 2e-3)),
        ("error curve end", abs(end - wrong) < 1e-9),
    ]
    return spark.createDataFrame(found, "property string, holds boolean")
