"""Expressions and aggregates on the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ardoise.catalog.registry import query
from ardoise.catalog.sqlgen import ratio_sql
from ardoise.catalog.standin import load, payments, role, with_roles
from ardoise.functions import aggspec as A
from ardoise.functions import exprs as E
from ardoise.operators.encode import discover_categories
from ardoise.operators.skew import skew_join

# Scored rows for rules and measures: an event's value squeezed into [0, 1) stands for a probability.
SCORED_SQL = """
    select event_id, user_id, event_type, case when event_type = 'error' then 1 else 0 end as y,
           value / (value + 50e0) as p
    from {events}"""


def scored(spark: SparkSession, folder: str) -> DataFrame:
    return spark.sql(SCORED_SQL, events=load(spark, folder, "events"))


def with_scored() -> str:
    return f"with scored as ({SCORED_SQL.replace('{events}', 'events')})"


@query(
    "ratio_ieee",
    f"""
    with r as (select l_orderkey, {ratio_sql('l_tax', 'l_discount')} as ratio from lineitem)
    select l_orderkey, count(*) as n, count(ratio) as n_ratio,
           count(case when isinf(ratio) then 1 end) as n_infinite,
           case when isfinite(max(ratio)) then max(ratio) end as max_ratio,
           round(case when isfinite(avg(ratio)) then avg(ratio) end, 9) as mean_ratio,
           round(avg(case when l_ok then ratio end), 9) as mean_robust
    from (select *, isfinite(ratio) as l_ok from r) group by l_orderkey""",
)
def ratio_ieee(spark: SparkSession, folder: str) -> DataFrame:
    """Ratios with zero divisors: one infinite ratio marks its order; the robust variant skips it."""
    items = load(spark, folder, "lineitem").select(
        "l_orderkey",
        E.ieee_div("l_tax", "l_discount").alias("ratio"),
        E.ieee_div("l_tax", "l_discount", on_zero="null").alias("robust"),
    )
    return items.groupBy("l_orderkey").agg(
        F.count(F.lit(1)).alias("n"),
        F.count("ratio").alias("n_ratio"),
        F.count_if(F.abs("ratio") == F.lit(E.INFINITY)).alias("n_infinite"),
        E.finite(F.max("ratio")).alias("max_ratio"),
        F.round(E.finite(F.avg("ratio")), 9).alias("mean_ratio"),
        F.round(F.avg("robust"), 9).alias("mean_robust"),
    )


@query(
    "sentinel_null",
    f"""{with_roles('application')}
    select SK_ID_CURR, nullif(DAYS_EMPLOYED, 365243) as DAYS_EMPLOYED,
           case when nullif(DAYS_EMPLOYED, 365243) is null then 1 else 0 end as missing from application""",
)
def sentinel_null(spark: SparkSession, folder: str) -> DataFrame:
    days = E.null_sentinel("DAYS_EMPLOYED")
    return role(spark, folder, "application").select(
        "SK_ID_CURR", days.alias("DAYS_EMPLOYED"), days.isNull().cast("int").alias("missing")
    )


@query(
    "clamp_dpd",
    f"""{with_roles('installments')}
    select SK_ID_CURR, cast(sum(case when d > 0 then d else 0 end) as double) as dpd,
           cast(sum(case when d < 0 then -d else 0 end) as double) as dbd,
           count(*) - count(d) as n_missing
    from (select SK_ID_CURR, DAYS_ENTRY_PAYMENT - DAYS_INSTALMENT as d from installments) group by SK_ID_CURR""",
)
def clamp_dpd(spark: SparkSession, folder: str) -> DataFrame:
    late = F.col("DAYS_ENTRY_PAYMENT") - F.col("DAYS_INSTALMENT")
    return (
        role(spark, folder, "installments")
        .groupBy("SK_ID_CURR")
        .agg(
            F.sum(E.clamp_zero(late)).alias("dpd"),
            F.sum(E.clamp_zero(-late)).alias("dbd"),
            F.count_if(late.isNull()).alias("n_missing"),
        )
    )


@query(
    "decision_label",
    f"""{with_scored()}
    select event_id, case when p > 0.67 then 'Rejetée' else 'Acceptée' end as rep,
           case when p > 0.67 then 1 else 0 end as flag from scored""",
)
def decision_label(spark: SparkSession, folder: str) -> DataFrame:
    return scored(spark, folder).select(
        "event_id", E.decide("p", 0.67).alias("rep"), E.above("p", 0.67).alias("flag")
    )


@query(
    "score_band",
    f"""{with_scored()}
    select case when p < 0.67 then 'low' else 'high' end as band, count(*) as n, min(p) as lowest, max(p) as highest
    from scored group by 1""",
)
def score_band(spark: SparkSession, folder: str) -> DataFrame:
    return (
        scored(spark, folder)
        .groupBy(E.score_band("p", 0.67).alias("band"))
        .agg(F.count(F.lit(1)).alias("n"), F.min("p").alias("lowest"), F.max("p").alias("highest"))
    )


@query(
    "strip_label",
    """
    select p_partkey, trim(name, '<= 0.00 0.46') as stripped, left(trim(name, '<= 0.00 0.46'), 25) as label,
           p_brand || '_' || upper(p_type) as flat_name
    from (select *, '0.00 < ' || p_name || '_' || p_brand || '_' || p_size || ' <= 0.46' as name from part)""",
)
def strip_label(spark: SparkSession, folder: str) -> DataFrame:
    name = F.concat(F.lit("0.00 < "), F.concat_ws("_", "p_name", "p_brand", "p_size"), F.lit(" <= 0.46"))
    return load(spark, folder, "part").select(
        "p_partkey",
        F.btrim(name, F.lit(E.LABEL_STRIP_CHARS)).alias("stripped"),
        E.clean_label(name).alias("label"),
        E.ascii_upper_name("p_brand", "p_type").alias("flat_name"),
    )


@query(
    "round_trunc",
    f"""{with_scored()}
    select event_id, round(p, 2) as p2, round(p, 3) as p3, cast(trunc(p * 64) as integer) as part,
           round_even(trunc(p * 64) / 64, 2) as half_even
    from scored""",
)
def round_trunc(spark: SparkSession, folder: str) -> DataFrame:
    part = (F.col("p") * 64).cast("int")
    return scored(spark, folder).select(
        "event_id",
        F.round("p", 2).alias("p2"),
        F.round("p", 3).alias("p3"),
        part.alias("part"),
        E.round_half_even(part / F.lit(64.0), 2).alias("half_even"),
    )


@query(
    "agg_min_max_mean",
    """select l_orderkey, min(l_quantity) as l_quantity_MIN, max(l_quantity) as l_quantity_MAX,
              cast(sum(l_quantity) as double) / count(l_quantity) as l_quantity_MEAN,
              round(sum(l_extendedprice), 2) / count(*) as l_extendedprice_MEAN
       from lineitem group by l_orderkey""",
)
def agg_min_max_mean(spark: SparkSession, folder: str) -> DataFrame:
    spec = A.AggSpec({"l_quantity": ["min", "max", "mean"], "l_extendedprice": ["mean"]})
    columns = A.aggregate_columns(spec, "", digits={"l_quantity": 0, "l_extendedprice": 2})
    return load(spark, folder, "lineitem").groupBy("l_orderkey").agg(*columns)


@query(
    "agg_sum_null_zero",
    """select l_suppkey, l_linenumber, round(coalesce(sum(case when l_quantity > 45 then l_extendedprice end), 0), 2) as x_SUM,
              count(case when l_quantity > 45 then 1 end) as n
       from lineitem group by l_suppkey, l_linenumber""",
)
def agg_sum_null_zero(spark: SparkSession, folder: str) -> DataFrame:
    """A group with only missing values sums to zero."""
    rows = load(spark, folder, "lineitem").select(
        "l_suppkey", "l_linenumber", F.when(F.col("l_quantity") > 45, F.col("l_extendedprice")).alias("x")
    )
    return rows.groupBy("l_suppkey", "l_linenumber").agg(
        *A.aggregate_columns({"x": ["sum"]}, "", digits={"x": 2}), F.count("x").alias("n")
    )


@query(
    "agg_var",
    """select l_orderkey, round(var_samp(l_quantity), 6) as l_quantity_VAR, count(*) as n
       from lineitem group by l_orderkey""",
)
def agg_var(spark: SparkSession, folder: str) -> DataFrame:
    """Sample variance; missing for a single row."""
    (var,) = A.aggregate_columns({"l_quantity": ["var"]}, "")
    out = load(spark, folder, "lineitem").groupBy("l_orderkey").agg(var, F.count(F.lit(1)).alias("n"))
    return out.withColumn("l_quantity_VAR", F.round("l_quantity_VAR", 6))


@query(
    "agg_size_nunique",
    """select l_orderkey, count(*) as x_SIZE, count(distinct case when l_linenumber > 2 then l_linenumber end) as x_NUNIQUE,
              count(*) as COUNT
       from lineitem group by l_orderkey""",
)
def agg_size_nunique(spark: SparkSession, folder: str) -> DataFrame:
    rows = load(spark, folder, "lineitem").select(
        "l_orderkey", F.when(F.col("l_linenumber") > 2, F.col("l_linenumber")).alias("x")
    )
    columns = A.aggregate_columns({"x": ["size", "nunique"]}, "")
    return rows.groupBy("l_orderkey").agg(*columns, F.count(F.lit(1)).alias("COUNT"))


@query(
    "category_share",
    """select user_id, """
    + ", ".join(
        f"avg(case when event_type = '{v}' then 1 else 0 end) as event_type_{v}_MEAN"
        for v in ("click", "error", "purchase", "view")
    )
    + """, avg(case when event_type is null then 1 else 0 end) as event_type_nan_MEAN
       from (select user_id, nullif(event_type, 'signup') as event_type from events) group by user_id""",
)
def category_share(spark: SparkSession, folder: str) -> DataFrame:
    rows = load(spark, folder, "events").select(
        "user_id", F.nullif(F.col("event_type"), F.lit("signup")).alias("event_type")
    )
    categories = discover_categories(rows)
    return rows.groupBy("user_id").agg(*A.category_share(categories, ""))


@query(
    "mean_of_means",
    """with per_order as (
         select l_orderkey, avg(case when l_returnflag = 'R' then 1 else 0 end) as r,
                avg(case when l_returnflag = 'N' then 1 else 0 end) as n from lineitem group by l_orderkey)
       select o_custkey, round(avg(r), 9) as l_returnflag_R_MEAN_MEAN, round(avg(n), 9) as l_returnflag_N_MEAN_MEAN
       from orders left join per_order on l_orderkey = o_orderkey group by o_custkey""",
)
def mean_of_means(spark: SparkSession, folder: str) -> DataFrame:
    per_order = (
        load(spark, folder, "lineitem")
        .groupBy(F.col("l_orderkey").alias("o_orderkey"))
        .agg(*A.category_share({"l_returnflag": ["N", "R"]}, ""))
    )
    joined = load(spark, folder, "orders").join(per_order, "o_orderkey", "left")
    names = ("l_returnflag_R_MEAN", "l_returnflag_N_MEAN")
    return joined.groupBy("o_custkey").agg(*[F.round(F.avg(n), 9).alias(f"{n}_MEAN") for n in names])


_FIVE = ("l_quantity", "l_discount", "l_tax")


@query(
    "five_agg_all",
    "select l_suppkey, l_returnflag, "
    + ", ".join(
        f"min({c}) + 0e0 as {c}_MIN, max({c}) + 0e0 as {c}_MAX, round(sum({c}), 2) / count(*) as {c}_MEAN, "
        f"round(sum({c}), 2) as {c}_SUM, round(var_samp({c}), 8) as {c}_VAR"
        for c in _FIVE
    )
    + """, min(f) as l_linestatus_O_MIN, max(f) as l_linestatus_O_MAX, avg(f) as l_linestatus_O_MEAN,
          cast(sum(f) as double) as l_linestatus_O_SUM, round(var_samp(f), 8) as l_linestatus_O_VAR
       from (select *, case when l_linestatus = 'O' then 1 else 0 end as f from lineitem) group by l_suppkey, l_returnflag""",
)
def five_agg_all(spark: SparkSession, folder: str) -> DataFrame:
    columns = A.five_numbers(_FIVE, "", {c: 2 for c in _FIVE}) + A.dummy_five({"l_linestatus": ["O"]}, "")
    out = load(spark, folder, "lineitem").groupBy("l_suppkey", "l_returnflag").agg(*columns)
    return out.select(
        *[
            F.round(c, 8).alias(c) if c.endswith("_VAR")
            else (F.col(c) + F.lit(0.0)).alias(c) if c.startswith(_FIVE) and c.endswith(("_MIN", "_MAX"))
            else F.col(c)
            for c in out.columns
        ]
    )


@query(
    "conditional_agg",
    """with every as (select o_custkey, max(o_totalprice) as ALL_o_totalprice_MAX,
                      round(sum(o_totalprice), 2) as ALL_o_totalprice_SUM from orders group by o_custkey),
            part_f as (select o_custkey, max(o_totalprice) as F_o_totalprice_MAX,
                       round(coalesce(sum(case when o_orderpriority <> '1-URGENT' then o_totalprice end), 0), 2) as F_x_SUM,
                       count(*) as F_x_SIZE from orders where o_orderstatus = 'F' group by o_custkey)
       select * from every left join part_f using (o_custkey)""",
)
def conditional_agg(spark: SparkSession, folder: str) -> DataFrame:
    """A subset variant in the pass of the whole: NULL for a client without any row of the subset, zero for
    one whose rows have no value."""
    orders = load(spark, folder, "orders").withColumn(
        "x", F.when(F.col("o_orderpriority") != "1-URGENT", F.col("o_totalprice"))
    )
    money = {"o_totalprice": 2, "x": 2}
    columns = A.aggregate_columns({"o_totalprice": ["max", "sum"]}, "ALL_", digits=money)
    columns += A.aggregate_columns(
        {"o_totalprice": ["max"], "x": ["sum", "size"]}, "F_", A.in_category("o_orderstatus", "F"), money
    )
    return orders.groupBy("o_custkey").agg(*columns)


SPEC = A.AggSpec.parse(
    """
    l_quantity       min max mean sum
    l_extendedprice  max sum
    l_linenumber     nunique size
    l_discount       mean
    """
)


@query(
    "spec_driven_agg",
    """select o_custkey, min(l_quantity) as X_l_quantity_MIN, max(l_quantity) as X_l_quantity_MAX,
              round(sum(l_quantity), 0) / count(*) as X_l_quantity_MEAN, round(sum(l_quantity), 0) as X_l_quantity_SUM,
              max(l_extendedprice) as X_l_extendedprice_MAX, round(sum(l_extendedprice), 2) as X_l_extendedprice_SUM,
              count(distinct l_linenumber) as X_l_linenumber_NUNIQUE, count(*) as X_l_linenumber_SIZE,
              round(sum(l_discount), 2) / count(*) as X_l_discount_MEAN
       from lineitem join orders on l_orderkey = o_orderkey group by o_custkey""",
)
def spec_driven_agg(spark: SparkSession, folder: str) -> DataFrame:
    digits = {"l_quantity": 0, "l_extendedprice": 2, "l_discount": 2}
    return payments(spark, folder).groupBy("o_custkey").agg(*A.aggregate_columns(SPEC, "X_", digits=digits))


@query(
    "left_join_hot_key",
    """select l_orderkey as k, count(*) as n, max(o_custkey) as customer, count(o_custkey) as n_met
       from (select case when l_linenumber <= 3 then 7 else l_orderkey end as l_orderkey from lineitem)
       left join orders on l_orderkey = o_orderkey group by l_orderkey""",
)
def left_join_hot_key(spark: SparkSession, folder: str) -> DataFrame:
    """Left join of facts where one key holds more than a third of the rows."""
    hot = F.when(F.col("l_linenumber") <= 3, F.lit(7).cast("bigint")).otherwise(F.col("l_orderkey"))
    items = load(spark, folder, "lineitem").select(hot.alias("k"))
    orders = load(spark, folder, "orders").select(F.col("o_orderkey").alias("k"), "o_custkey")
    joined = skew_join(items, orders, "k", "left")
    return joined.groupBy("k").agg(
        F.count(F.lit(1)).alias("n"), F.max("o_custkey").alias("customer"), F.count("o_custkey").alias("n_met")
    )
