"""Reports, splits and measures on the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ardoise.catalog.basics import scored, with_scored
from ardoise.catalog.registry import query
from ardoise.catalog.standin import load, role, with_roles
from ardoise.functions.exprs import ascii_upper_name, above, sign_label
from ardoise.operators import explain, metrics, models, profile, split
from ardoise.plans.specs import KEY
from ardoise.sources import tables
from ardoise.sources.workdir import fresh_path

APP = with_roles("application")
MD5_BUCKET = "cast(('0x' || substr(md5(cast({k} as varchar)), 1, 8)) as bigint) % {n}"


@query("value_counts", "select event_type as value, count(*) as n from events group by 1")
def value_counts(spark: SparkSession, folder: str) -> DataFrame:
    return profile.value_counts(load(spark, folder, "events"), "event_type")


@query(
    "class_share",
    """with t as (select nullif(l_returnflag, 'R') as v from lineitem)
       select v as value, count(*) as n, count(*) / (select cast(count(v) as double) from t) as share,
              round(count(*) / (select cast(count(*) as double) from t) * 100, 2) as pct_of_rows
       from t where v is not null group by v""",
)
def class_share(spark: SparkSession, folder: str) -> DataFrame:
    """Shares among known values and among all rows."""
    flag = F.nullif(F.col("l_returnflag"), F.lit("R")).alias("v")
    return profile.class_share(load(spark, folder, "lineitem").select(flag), "v")


@query("distinct_labels", f"{APP} select distinct TARGET, IN_TRAIN from application")
def distinct_labels(spark: SparkSession, folder: str) -> DataFrame:
    return role(spark, folder, "application").select("TARGET", "IN_TRAIN").distinct()


@query("distinct_ids", f"{APP} select distinct SK_ID_CURR from application where IN_TRAIN = 0")
def distinct_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Pick list of the requests to decide."""
    return role(spark, folder, "application").where("IN_TRAIN = 0").select(KEY).distinct()


@query(
    "topk_abs",
    """select row_number() over (order by abs(c_acctbal - 5000e0) desc, c_name) as rank, c_name as name,
              c_acctbal - 5000e0 as deviation,
              case when c_acctbal - 5000e0 > 0 then 'Défavorable' else 'Favorable' end as effect
       from customer order by abs(c_acctbal - 5000e0) desc, c_name limit 10""",
)
def topk_abs(spark: SparkSession, folder: str) -> DataFrame:
    """The ten largest deviations in either direction, ranked."""
    rows = load(spark, folder, "customer").select(
        F.col("c_name").alias("name"), (F.col("c_acctbal") - 5000.0).alias("deviation")
    )
    top = profile.top_abs(rows, "deviation", 10, "name")
    rank = F.row_number().over(Window.orderBy(F.abs("deviation").desc(), "name")).cast("bigint")
    return top.select(rank.alias("rank"), "name", "deviation", sign_label("deviation").alias("effect"))


@query(
    "topk_group_mean",
    """with best as (select p_name, avg(p_retailprice) as mean_value from part group by 1 order by round(avg(p_retailprice), 6) desc, p_name limit 40)
       select p_partkey, p_name, p_retailprice, round(mean_value, 6) as mean_value from part join best using (p_name)""",
)
def topk_group_mean(spark: SparkSession, folder: str) -> DataFrame:
    rows = load(spark, folder, "part").select("p_partkey", "p_name", "p_retailprice")
    top = profile.top_group_mean(rows, "p_name", "p_retailprice", 40)
    return top.withColumn("mean_value", F.round("mean_value", 6))


@query(
    "dictionary_lookup",
    """select l_partkey, cast(count(*) as bigint) as n, p_brand || '_' || upper(first_type) as described
       from lineitem join part on p_partkey = l_partkey
       join (select p_name as pn, arg_min(p_type, p_partkey) as first_type from part group by 1) d on d.pn = p_name
       group by l_partkey, p_brand, first_type""",
)
def dictionary_lookup(spark: SparkSession, folder: str) -> DataFrame:
    """Descriptions attached to many rows; of several entries for a name the first counts."""
    part = load(spark, folder, "part")
    dictionary = part.select(
        F.col("p_partkey").alias("position"), F.col("p_name").alias("Row"), F.col("p_type").alias("Description")
    )
    named = explain.describe(part.select("p_partkey", "p_brand", "p_name"), "p_name", dictionary)
    used = load(spark, folder, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count(F.lit(1)).alias("n"))
    return used.join(named, "p_partkey").select(
        F.col("p_partkey").alias("l_partkey"), "n", ascii_upper_name("p_brand", "Description").alias("described")
    )


@query(
    "dictionary_point",
    """select p_name as "Row", p_type as "Description" from part where p_name = 'small ring' order by p_partkey limit 1""",
)
def dictionary_point(spark: SparkSession, folder: str) -> DataFrame:
    dictionary = load(spark, folder, "part").select(
        F.col("p_partkey").alias("position"), F.col("p_name").alias("Row"), F.col("p_type").alias("Description")
    )
    return explain.look_up(dictionary, "small ring")


_CELLS = "count(*) * 2 - count(CODE_GENDER) - count(NAME_INCOME_TYPE)"


@query(
    "profile_message",
    f"""{APP} select 'Le fichier Test comporte ' || count(*) || ' lignes et 2 colonnes, ainsi que ' || ({_CELLS})
        || ' valeurs manquantes sur ' || count(*) * 2 || ' entrées (' || cast(round(({_CELLS}) / (count(*) * 2e0) * 100, 3) as varchar)
        || ' %).' as message from application""",
)
def profile_message(spark: SparkSession, folder: str) -> DataFrame:
    return profile.profile_message(role(spark, folder, "application").select("CODE_GENDER", "NAME_INCOME_TYPE"), "Test")


@query(
    "split_80_20",
    f"""{APP} select SK_ID_CURR, TARGET, case when {MD5_BUCKET.format(k='SK_ID_CURR', n=100)} < 80 then 'train' else 'valid' end as part
        from application""",
)
def split_80_20(spark: SparkSession, folder: str) -> DataFrame:
    return split.add_split(role(spark, folder, "application").select(KEY, "TARGET"), KEY)


@query(
    "stratified_folds",
    f"""{APP} select SK_ID_CURR, TARGET, cast((row_number() over (partition by TARGET
           order by md5(SK_ID_CURR || '|0'), SK_ID_CURR) - 1) % 5 as integer) as fold from application""",
)
def stratified_folds(spark: SparkSession, folder: str) -> DataFrame:
    return split.stratified_folds(role(spark, folder, "application").select(KEY, "TARGET"), "TARGET", KEY)


@query(
    "class_weights",
    f"""{APP} select TARGET, count(*) as n, (select cast(count(*) as double) from application) / (2 * count(*)) as weight
        from application group by TARGET""",
)
def class_weights(spark: SparkSession, folder: str) -> DataFrame:
    return split.class_weights(role(spark, folder, "application"), "TARGET")


@query("pick_row", f"{APP} select * from application order by md5(cast(SK_ID_CURR as varchar)), SK_ID_CURR limit 1")
def pick_row(spark: SparkSession, folder: str) -> DataFrame:
    return split.pick_row(role(spark, folder, "application"), KEY)


# Three stand-in models: the score, its mirror image, and the digits of the id.
MODELS_SQL = """
    select 'a_score' as model, event_id, event_type, y, p from scored
    union all select 'b_mirror', event_id, event_type, y, 1 - p from scored
    union all select 'c_digits', event_id, event_type, y, event_id % 100 * 0.01e0 from scored"""


def three_models(spark: SparkSession, folder: str) -> DataFrame:
    return spark.sql(MODELS_SQL.replace("from scored", "from {scored}"), scored=scored(spark, folder))


def with_models() -> str:
    return f"{with_scored()}, m as ({MODELS_SQL})"


AUC_SQL = """ties as (select model, p, sum(y) as pos, count(*) - sum(y) as neg from m group by 1, 2),
    cum as (select *, sum(neg) over (partition by model order by p) - neg as below from ties),
    areas as (select model, cast(sum(pos) as bigint) as n_pos, cast(sum(neg) as bigint) as n_neg,
        cast(sum(pos * (2 * below + neg)) as double) / (2 * sum(pos) * sum(neg)) as auc from cum group by 1)"""
RATES_SQL = """rates as (select model, count(case when y = 1 and p > 0.5 then 1 end) as tp,
        count(case when y = 0 and p > 0.5 then 1 end) as fp, count(case when y = 1 and not p > 0.5 then 1 end) as fn,
        count(case when y = 0 and not p > 0.5 then 1 end) as tn from m group by 1)"""


@query("roc_auc", f"{with_models()}, {AUC_SQL} select * from areas")
def roc_auc(spark: SparkSession, folder: str) -> DataFrame:
    """Exact area under the curve of three score columns, in ranges of the score."""
    return metrics.roc_auc(three_models(spark, folder), "y", "p", ["model"], ranges=16)


@query(
    "prf_scores",
    f"""{with_models()}, {AUC_SQL}, {RATES_SQL}
    select model, round(auc, 2) as auc, round(2e0 * tp / (2 * tp + fn + fp), 2) as f1, round(cast(tp as double) / (tp + fn), 2) as recall,
           round(cast(tp as double) / (tp + fp), 2) as precision from rates join areas using (model)""",
)
def prf_scores(spark: SparkSession, folder: str) -> DataFrame:
    rows = three_models(spark, folder).withColumn("said", above("p", 0.5))
    parts = [
        metrics.score_row(rows.where(F.col("model") == m), "y", "p", "said", m) for m in ("a_score", "b_mirror", "c_digits")
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(
    "confusion",
    f"""{with_scored()} select y as actual, count(case when not p > 0.5 then 1 end) as predicted_0,
        count(case when p > 0.5 then 1 end) as predicted_1 from scored group by y""",
)
def confusion(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.confusion_matrix(scored(spark, folder).withColumn("said", above("p", 0.5)), "y", "said")


@query(
    "confusion_norm",
    f"""{with_scored()} select y as actual, count(case when not p > 0.5 then 1 end) / cast(count(*) as double) as predicted_0,
        count(case when p > 0.5 then 1 end) / cast(count(*) as double) as predicted_1 from scored group by y""",
)
def confusion_norm(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.confusion_matrix(scored(spark, folder).withColumn("said", above("p", 0.5)), "y", "said", True)


CURVE_SQL = f"""{with_scored()}, t as (select cast(i as integer) as step, i * 0.01e0 as threshold from range(100) r(i)),
    c as (select step, threshold, count(case when y = 1 and p > threshold then 1 end) as tp,
        count(case when y = 0 and p > threshold then 1 end) as fp, count(case when y = 1 and not p > threshold then 1 end) as fn
        from t cross join scored group by all),
    curve as (select *, case when tp + fn = 0 then 0e0 else cast(tp as double) / (tp + fn) end as recall,
        case when tp + fp = 0 then 0e0 else cast(tp as double) / (tp + fp) end as precision,
        case when 2 * tp + fn + fp = 0 then 0e0 else 2e0 * tp / (2 * tp + fn + fp) end as f1 from c)"""


@query("f1_curve", f"{CURVE_SQL} select * from curve")
def f1_curve(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.f1_curve(scored(spark, folder), "y", "p")


@query("f1_best", f"{CURVE_SQL} select threshold, f1 from curve order by f1 desc, threshold limit 1")
def f1_best(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.best_threshold(metrics.f1_curve(scored(spark, folder), "y", "p"))


@query(
    "share_at_threshold",
    f"""{with_scored()}, f as (select case when p > 0.57 then 1 else 0 end as v from scored)
    select v as value, count(*) as n, count(*) / (select cast(count(*) as double) from f) as share,
           round(count(*) / (select cast(count(*) as double) from f) * 100, 2) as pct_of_rows from f group by v""",
)
def share_at_threshold(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.share_at(scored(spark, folder), "p", 0.57)


@query(
    "score_histogram",
    f"""{with_scored()}, b as (
        select 'Rejetée' as series, p as v from scored union all select 'Acceptée', 1 - p from scored)
    select series, cast(least(floor(v * 20) + 1, 20) as integer) as bin, count(*) as n from b group by 1, 2""",
)
def score_histogram(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.score_histogram(scored(spark, folder), "p", 20)


@query(
    "marked_histogram",
    f"""{with_scored()}, me as (select event_id as who from scored order by md5(cast(event_id as varchar)), event_id limit 1),
    s as (select count(p) as n, min(p) as lo, max(p) as hi, quantile_cont(p, 0.75) - quantile_cont(p, 0.25) as iqr from scored),
    w as (select *, 2e0 * iqr / pow(n, 1e0 / 3) as fd, (hi - lo) / (log2(n) + 1) as sturges from s),
    k as (select lo, hi, ceil((hi - lo) / case when fd > 0 then least(fd, sturges) else sturges end) as bins from w),
    b as (select 'Rejetée' as series, event_id, p as v, lo as a, hi as z, bins from scored, k
          union all select 'Acceptée', event_id, 1 - p, 1 - hi, 1 - lo, bins from scored, k),
    c as (select *, cast(least(floor(bins * (v - a) / (z - a) + 1), bins) as integer) as bin from b)
    select series, bin, round(a + (bin - 1) * ((z - a) / bins), 9) as low, count(*) as n, bool_or(event_id = who) as marked
    from c, me group by series, bin, a, z, bins""",
)
def marked_histogram(spark: SparkSession, folder: str) -> DataFrame:
    """Both class probabilities in automatic bins, with the bins of one individual marked."""
    rows = scored(spark, folder)
    who = split.pick_row(rows, "event_id").first()["event_id"]
    return metrics.marked_histogram(rows, "p", "event_id", who).withColumn("low", F.round("low", 9))


@query("preview", f"{APP} select * from application order by SK_ID_CURR limit 5")
def preview(spark: SparkSession, folder: str) -> DataFrame:
    return profile.preview(role(spark, folder, "application"), KEY)


@query(
    "fbeta_cost",
    f"""{with_models()}, {RATES_SQL} select model, tp, fp, fn, tn, cast(tp as double) / (tp + fn) as recall,
        cast(tp as double) / (tp + fp) as precision, 5e0 * tp / (5e0 * tp + 4e0 * fn + fp) as fbeta from rates""",
)
def fbeta_cost(spark: SparkSession, folder: str) -> DataFrame:
    """Wrong acceptances and rejections and F-beta with recall weighing double."""
    rows = three_models(spark, folder).withColumn("said", above("p", 0.5))
    return metrics.with_rates(metrics.outcome_counts(rows, "y", "said", ["model"]), beta=2.0)


@query(
    "best_per_metric",
    f"""{with_models()}, {AUC_SQL}, {RATES_SQL}, s as (
        select model, auc, cast(tp as double) / (tp + fn) as recall, cast(tp as double) / (tp + fp) as precision
        from rates join areas using (model)), l as (
        select 'auc' as metric, model, auc as value from s union all select 'recall', model, recall from s
        union all select 'precision', model, precision from s)
    select metric, model, value from l qualify row_number() over (partition by metric order by value desc, model) = 1""",
)
def best_per_metric(spark: SparkSession, folder: str) -> DataFrame:
    rows = three_models(spark, folder).withColumn("said", above("p", 0.5))
    rates = metrics.with_rates(metrics.outcome_counts(rows, "y", "said", ["model"]))
    scores = rates.join(metrics.roc_auc(rows, "y", "p", ["model"]), "model")
    return metrics.best_per_metric(scores, ["auc", "recall", "precision"])


@query(
    "dummy_model",
    f"""{APP}, top as (select TARGET as c from application where IN_TRAIN = 1 group by TARGET order by count(*) desc, TARGET limit 1)
    select SK_ID_CURR, TARGET, (select c from top) as prediction, cast((select c from top) as double) as proba from application""",
)
def dummy_model(spark: SparkSession, folder: str) -> DataFrame:
    both = role(spark, folder, "application")
    return models.dummy_scores(both.where("IN_TRAIN = 1"), both.select(KEY, "TARGET"))


COEFFICIENTS = {
    "DAYS_BIRTH": 0.0005, "AMT_CREDIT": -0.000002, "AMT_INCOME_TOTAL": 0.00001, "CNT_FAM_MEMBERS": 0.31, "DAYS_EMPLOYED": -0.0001,
}


@query(
    "local_contrib",
    f"""{APP}, means as (select {', '.join(f'avg({c}) as {c}_m' for c in COEFFICIENTS)} from application),
        long as ({' union all '.join(
            f"select SK_ID_CURR, '{c}' as feature, {w!r}::double * ({c} - {c}_m) as contribution from application, means"
            for c, w in COEFFICIENTS.items())}),
        ranked as (select *, cast(row_number() over (partition by SK_ID_CURR order by abs(contribution) desc, feature) as integer) as rank
            from long)
    select SK_ID_CURR, rank, feature, round(contribution, 9) as contribution, left(trim(feature, '<= 0.00 0.46'), 25) as label,
           case when contribution > 0 then 'Défavorable' else 'Favorable' end as effect from ranked where rank <= 3""",
)
def local_contrib(spark: SparkSession, folder: str) -> DataFrame:
    """The three largest contributions to a linear score, for every request."""
    rows = role(spark, folder, "application")
    means = explain.feature_means(rows, list(COEFFICIENTS))
    out = explain.local_contributions(rows, KEY, COEFFICIENTS, means, 3)
    return out.withColumn("contribution", F.round("contribution", 9))


_FEATURES = ", ".join(f"'{c}'" for c in COEFFICIENTS)
# Entries of a dictionary: a feature by the number of the nation, described by its name; one feature has several.
_ENTRY = f"list_extract([{_FEATURES}], cast(n_nationkey % {len(COEFFICIENTS)} + 1 as integer))"


@query(
    "described_contrib",
    f"""{APP}, means as (select {', '.join(f'avg({c}) as {c}_m' for c in COEFFICIENTS)} from application),
        entries as (select {_ENTRY} as feature, min_by('Libellé « ' || n_name || ' »', n_nationkey) as Description from nation
            where n_nationkey % {len(COEFFICIENTS)} <> 1 group by 1),
        long as ({' union all '.join(
            f"select SK_ID_CURR, '{c}' as feature, {w!r}::double * ({c} - {c}_m) as contribution from application, means"
            for c, w in COEFFICIENTS.items())}),
        ranked as (select *, cast(row_number() over (partition by SK_ID_CURR order by abs(contribution) desc, feature) as integer) as rank
            from long)
    select SK_ID_CURR, rank, ranked.feature, round(contribution, 9) as contribution, Description
    from ranked left join entries using (feature) where rank <= 3""",
)
def described_contrib(spark: SparkSession, folder: str) -> DataFrame:
    """The three largest contributions with the descriptions of a dictionary file in Latin-1; one feature has none."""
    rows, path, names = role(spark, folder, "application"), fresh_path(spark, "dictionary"), list(COEFFICIENTS)
    entry = F.element_at(F.array(*map(F.lit, names)), (F.col("n_nationkey") % len(names) + 1).cast("int"))
    nations = load(spark, folder, "nation").where(F.col("n_nationkey") % len(names) != 1).coalesce(1).sortWithinPartitions("n_nationkey")
    written = nations.select(entry.alias("Row"), F.concat(F.lit("Libellé « "), "n_name", F.lit(" »")).alias("Description"))
    written.write.option("header", True).option("encoding", tables.DICTIONARY_ENCODING).csv(path)
    out = explain.local_contributions(rows, KEY, COEFFICIENTS, explain.feature_means(rows, names), 3)
    named = explain.describe(out, "feature", tables.read_dictionary(spark, path))
    return named.select(KEY, "rank", "feature", F.round("contribution", 9).alias("contribution"), "Description")


_COMPARED = ("AMT_INCOME_TOTAL", "AMT_CREDIT", "DAYS_BIRTH", "CNT_FAM_MEMBERS")


@query(
    "cohort_compare",
    f"""{APP}, me as (select * from application order by md5(cast(SK_ID_CURR as varchar)), SK_ID_CURR limit 1),
        a as (select application.*, application.CODE_GENDER = (select CODE_GENDER from me) as alike from application)
    {' union all '.join(f'''
        select '{c}' as feature, (select {c} from me) as value, round(avg({c}), 6) as mean_all,
               round(avg(case when alike then {c} end), 6) as mean_cohort,
               count(case when {c} < (select {c} from me) then 1 end) / cast(count({c}) as double) as share_below_all,
               count(case when alike and {c} < (select {c} from me) then 1 end) / cast(count(case when alike then {c} end) as double)
                   as share_below_cohort from a''' for c in _COMPARED)}""",
)
def cohort_compare(spark: SparkSession, folder: str) -> DataFrame:
    rows = role(spark, folder, "application")
    out = explain.compare_client(rows, KEY, split.pick_row(rows, KEY), _COMPARED, "CODE_GENDER")
    return out.withColumns({c: F.round(c, 6) for c in ("mean_all", "mean_cohort")})
