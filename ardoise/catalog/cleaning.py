"""Encoding and cleaning on the given tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ardoise.catalog import sqlgen
from ardoise.catalog.registry import query
from ardoise.catalog.sqlgen import q
from ardoise.catalog.shared import prepared, wide_table
from ardoise.catalog.standin import applications, load, role, with_roles
from ardoise.functions.aggspec import quoted
from ardoise.operators import clean, encode, median, medianstate, profile, sparse
from ardoise.plans import blocks, prepare, wide
from ardoise.plans.specs import KEY
from ardoise.sources import tables
from ardoise.sources.workdir import fresh_path

APP = with_roles("application")
HOUSING = ("Flat", "House", "Other")
INCOME = ("AUTOMOBILE", "BUILDING", "HOUSEHOLD", "MACHINERY")


def _dummy_sql(column: str, values, missing: bool = True) -> str:
    cells = [f"case when {column} = '{v}' then 1 else 0 end as {q(f'{column}_{v}')}" for v in values]
    if missing:
        cells.append(f"case when {column} is null then 1 else 0 end as {q(f'{column}_nan')}")
    return ", ".join(cells)


@query(
    "one_hot",
    f"""{APP} select SK_ID_CURR, AMT_CREDIT, {_dummy_sql('NAME_INCOME_TYPE', INCOME)},
        {_dummy_sql('NAME_HOUSING_TYPE', HOUSING)} from application""",
)
def one_hot(spark: SparkSession, folder: str) -> DataFrame:
    rows = role(spark, folder, "application").select(KEY, "AMT_CREDIT", "NAME_INCOME_TYPE", "NAME_HOUSING_TYPE")
    return encode.one_hot(rows)[0]


# Texts that have a million values among six hundred thousand line items; a flag that is often missing.
_MANY = {
    "offer": "concat(l_partkey, ':', l_suppkey, ':', l_linenumber)",
    "delivery": "concat(l_orderkey, ':', l_suppkey)",
    "item": "concat(l_partkey, ':', l_suppkey, ':', cast(l_quantity as int))",
    "place": "concat(l_orderkey, ':', l_partkey, ':', l_linenumber)",
    "flag": "case when l_quantity < 3 then null else l_returnflag end",
}
_MANY_KEY = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity"


def _sparse_sql() -> str:
    index = ", ".join(
        f"i_{c} as materialized (select {c}, row_number() over (order by {c}) - 1 as i from (select distinct {c} from many where l_linestatus = 'F' and {c} is not null))"
        for c in _MANY
    )
    sizes = ", ".join(f"(select count(*) from i_{c}) as n_{c}" for c in _MANY)
    places, start = [], "0"
    for c in _MANY:
        places.append(f"case when many.{c} is null then n_{c} else i_{c}.i end + {start}")
        start += f" + n_{c} + 1"
    joins = " ".join(f"left join i_{c} on i_{c}.{c} = many.{c}" for c in _MANY)
    return f"""with many as (select *, {', '.join(f'{sql} as {c}' for c, sql in _MANY.items())} from lineitem),
        {index}, sizes as (select {sizes})
        select {_MANY_KEY}, cast({start} as bigint) as size,
            array_to_string(list_filter([{', '.join(places)}], lambda x: x is not null), ',') as indices
        from many {joins}, sizes"""


@query("sparse_one_hot", _sparse_sql())
def sparse_one_hot(spark: SparkSession, folder: str) -> DataFrame:
    """Sparse vectors of all line items over the values that finished ones have: a million places, no column each."""
    rows = load(spark, folder, "lineitem").withColumns({c: F.expr(sql) for c, sql in _MANY.items()})
    fitted = sparse.fit_sparse(rows.where("l_linestatus = 'F'"), list(_MANY))
    path = fresh_path(spark, "categories")
    fitted.save(path)
    vector = F.unwrap_udt("features")
    # Only what is returned travels and is written on the way.
    rows = rows.select(*_MANY_KEY.split(", "), *_MANY)
    return sparse.SparseCategories.load(spark, path).vectors(rows).select(
        *_MANY_KEY.split(", "), vector["size"].cast("bigint").alias("size"), F.array_join(vector["indices"], ",").alias("indices")
    )


@query(
    "factorize",
    f"""{APP}, codes as (
        select CODE_GENDER as v, row_number() over (order by min(SK_ID_CURR)) - 1 as code
        from application where IN_TRAIN = 1 group by CODE_GENDER),
      flags as (
        select FLAG_OWN_REALTY as v, row_number() over (order by min(SK_ID_CURR)) - 1 as code
        from application where IN_TRAIN = 1 and FLAG_OWN_REALTY is not null group by 1)
      select SK_ID_CURR, cast(coalesce(c.code, -1) as integer) as CODE_GENDER,
             cast(coalesce(f.code, -1) as integer) as FLAG_OWN_REALTY
      from application left join codes c on CODE_GENDER = c.v left join flags f on FLAG_OWN_REALTY = f.v""",
)
def factorize(spark: SparkSession, folder: str) -> DataFrame:
    both = role(spark, folder, "application")
    rows = both.select(KEY, "CODE_GENDER", "FLAG_OWN_REALTY")
    for column in ("CODE_GENDER", "FLAG_OWN_REALTY"):
        rows = encode.factorize_apply(rows, column, encode.factorize_fit(both.where("IN_TRAIN = 1"), column, KEY))
    return rows


_CARD = ("SK_ID_PREV", "SK_ID_CURR", "MONTHS_BALANCE", "AMT_BALANCE", "AMT_DRAWINGS_CURRENT", "CNT_DRAWINGS_CURRENT",
         "NAME_CONTRACT_STATUS")
_CARD_TYPES = ("bigint", "bigint", "bigint", "double", "double", "double", "string")


@query(
    "profile_columns",
    with_roles("card")
    + " union all ".join(
        f"""
        select '{c}' as "column", '{t}' as data_type, count(*) as n_rows, count({c}) as n_filled,
               count(*) - count({c}) as n_missing, cast(count({c}) * 100 // count(*) as integer) as fill_pct from card"""
        for c, t in zip(_CARD, _CARD_TYPES)
    ),
)
def profile_columns(spark: SparkSession, folder: str) -> DataFrame:
    return profile.profile_columns(role(spark, folder, "card"))


@query(
    "profile_summary",
    f"""{with_roles('card')} select count(*) as n_rows, cast(7 as bigint) as n_columns,
        {' + '.join(f'count(*) - count({c})' for c in _CARD)} as n_missing, count(*) * 7 as n_cells,
        round(({' + '.join(f'count(*) - count({c})' for c in _CARD)}) / (count(*) * 7.0) * 100, 3) as missing_pct
        from card""",
)
def profile_summary(spark: SparkSession, folder: str) -> DataFrame:
    return profile.profile_summary(role(spark, folder, "card"))


_ROW = ("CODE_GENDER", "FLAG_OWN_REALTY", "NAME_INCOME_TYPE", "AMT_ANNUITY")


@query(
    "profile_rows",
    f"""{APP} select SK_ID_CURR,
        cast(({' + '.join(f'case when {c} is null then 0 else 1 end' for c in _ROW)}) * 100 // 4 as integer) as fill_pct
        from application""",
)
def profile_rows(spark: SparkSession, folder: str) -> DataFrame:
    return role(spark, folder, "application").select(KEY, profile.row_fill_percent(_ROW).alias("fill_pct"))


@query(
    "duplicate_rows",
    """select cast(sum(n) as bigint) as n_rows, cast(sum(n - 1) as bigint) as n_duplicates from (
         select count(*) as n from lineitem group by l_orderkey, l_linenumber, case when l_quantity > 10 then l_returnflag end)""",
)
def duplicate_rows(spark: SparkSession, folder: str) -> DataFrame:
    flag = F.when(F.col("l_quantity") > 10, F.col("l_returnflag")).alias("flag")
    return profile.duplicate_count(load(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", flag))


_RATIOS = list(sqlgen.specs.APPLICATION_RATIOS)


@query(
    "finite_check",
    f"with {', '.join(f'{n} as ({s})' for n, s in sqlgen.application_block().ctes.items())} "
    + " union all ".join(
        f"""select '{c}' as "column", count(case when isinf({c}) then 1 end) as n_inf,
            count(case when isnan({c}) then 1 end) as n_nan, count(*) - count({c}) as n_null from application_block"""
        for c in _RATIOS
    ),
)
def finite_check(spark: SparkSession, folder: str) -> DataFrame:
    train, test = applications(spark, folder)
    return clean.finite_check(blocks.application(wide.all_applications(train, test)), _RATIOS)


@query(
    "schema_align",
    f"""{APP}, train as (
          select distinct 'NAME_INCOME_TYPE_' || NAME_INCOME_TYPE as c from application where IN_TRAIN = 1 and NAME_INCOME_TYPE is not null
          union select 'NAME_HOUSING_TYPE_' || NAME_HOUSING_TYPE from application where IN_TRAIN = 1),
        test as (
          select distinct 'NAME_INCOME_TYPE_' || NAME_INCOME_TYPE as c from application where IN_TRAIN = 0 and NAME_INCOME_TYPE is not null
          union select 'NAME_HOUSING_TYPE_' || NAME_HOUSING_TYPE from application where IN_TRAIN = 0)
        select coalesce(train.c, test.c) as "column",
               case when train.c is null then 'ignore' when test.c is null then 'add' else 'common' end as action
        from train full join test on train.c = test.c
        union all select 'TARGET', 'add'""",
)
def schema_align(spark: SparkSession, folder: str) -> DataFrame:
    """Which dummy columns the two kinds of application share, and what happens to the others."""
    train, test = applications(spark, folder)
    fields = ("NAME_INCOME_TYPE", "NAME_HOUSING_TYPE")
    names = [encode.dummy_names(encode.discover_categories(d, fields, nan_category=False)) for d in (train, test)]
    pairs = encode.column_alignment([*names[0], "TARGET"], names[1])
    return spark.createDataFrame(pairs, "column string, action string")


@query(
    "aligned_test",
    f"""{APP} select SK_ID_CURR, {_dummy_sql('NAME_HOUSING_TYPE', ('Flat', 'House'), False)},
        {_dummy_sql('NAME_INCOME_TYPE', INCOME, False)}, 0 as NAME_INCOME_TYPE_GONE
        from application where IN_TRAIN = 0""",
)
def aligned_test(spark: SparkSession, folder: str) -> DataFrame:
    """Test applications in the frozen columns of the training ones: an absent column is zero, an unknown
    category leaves no column."""
    train, test = applications(spark, folder)
    fields = ("NAME_HOUSING_TYPE", "NAME_INCOME_TYPE")
    frozen = encode.dummy_names(encode.discover_categories(train, fields, nan_category=False))
    own, _ = encode.one_hot(test.select(KEY, *fields), nan_category=False)
    return encode.align(own, [KEY, *frozen, "NAME_INCOME_TYPE_GONE"])


def _wide_ctes() -> str:
    block = sqlgen.wide_block()
    ctes = [f"{n} as ({s})" for n, s in block.ctes.items()]
    part = f"md5(cast({KEY} as varchar))"
    bucket = "cast(('0x' || substr(" + part + ", 1, 8)) as bigint) % 100"
    ctes.append(f"parted as (select *, case when not is_train then 'test' when {bucket} < 80 then 'train' else 'valid' end as part from wide)")
    features = [n for n in block.names if n not in ("is_train", "TARGET")]
    cells = ", ".join(f"case when isfinite(cast({q(c)} as double)) then cast({q(c)} as double) end as {q(c)}" for c in features)
    ctes.append(f"cleared as materialized (select {KEY}, TARGET, part, {cells} from parted)")
    return ", ".join(ctes)


WIDE_CTES = _wide_ctes()
FEATURES = [n for n in sqlgen.wide_block().names if n not in ("is_train", "TARGET")]


@query(
    "drop_sparse",
    f"with {WIDE_CTES}, long as (unpivot (select {', '.join(f'count({q(c)}) as {q(c)}' for c in FEATURES)} "
    f"from cleared where part = 'train') on columns(*) into name feature value n_filled) "
    """select feature as "column", (select count(*) from cleared where part = 'train') as n_rows, n_filled
       from long where n_filled * 100 < 80 * (select count(*) from cleared where part = 'train')""",
)
def drop_sparse(spark: SparkSession, folder: str) -> DataFrame:
    """Features of the wide table that fewer than 80 % of the training rows fill."""
    train, _, _ = prepare.parts(wide_table(spark, folder))
    features = clean.feature_columns(train)
    return clean.sparse_columns(clean.fill_counts(clean.clear_infinite(train, features), features))


@query(
    "impute_median",
    f"""{with_roles('previous')}, m as (
          select median(AMT_DOWN_PAYMENT) as a, median(CNT_PAYMENT) as b, median(AMT_APPLICATION) as c,
                 median(DAYS_DECISION) as d from previous)
        select SK_ID_CURR, AMT_ANNUITY, coalesce(AMT_DOWN_PAYMENT, (select a from m)) as AMT_DOWN_PAYMENT,
               coalesce(CNT_PAYMENT, (select b from m)) as CNT_PAYMENT,
               AMT_APPLICATION - (select c from m) as over_median, (select d from m) as median_days
        from previous""",
)
def impute_median(spark: SparkSession, folder: str) -> DataFrame:
    rows = role(spark, folder, "previous")
    columns = ["AMT_DOWN_PAYMENT", "CNT_PAYMENT", "AMT_APPLICATION", "DAYS_DECISION"]
    m = median.exact_medians(rows, columns)
    filled = clean.impute(rows.select(KEY, "AMT_ANNUITY", *columns), m)
    return filled.select(
        KEY, "AMT_ANNUITY", "AMT_DOWN_PAYMENT", "CNT_PAYMENT",
        (F.col("AMT_APPLICATION") - F.lit(m["AMT_APPLICATION"])).alias("over_median"),
        F.lit(m["DAYS_DECISION"]).alias("median_days"),
    )


_DELIVERED = ("AMT_DOWN_PAYMENT", "CNT_PAYMENT", "AMT_APPLICATION", "AMT_CREDIT", "DAYS_DECISION")


@query(
    "median_deliveries",
    f"{with_roles('previous')} "
    + " union all ".join(f"select '{c}' as name, count({c}) as filled, median(cast({c} as double)) as median from previous" for c in _DELIVERED),
)
def median_deliveries(spark: SparkSession, folder: str) -> DataFrame:
    """Medians over three deliveries of earlier applications by day, each reduced to its state."""
    rows, path = role(spark, folder, "previous"), fresh_path(spark, "medians")
    first, second = rows.agg(F.percentile_approx("DAYS_DECISION", [0.5, 0.9], 1000)).first()[0]
    part = F.when(F.col("DAYS_DECISION") <= first, 0).when(F.col("DAYS_DECISION") <= second, 1).otherwise(2)
    for k in range(3):
        medianstate.add_delivery(rows.where(part == k), _DELIVERED, path, k)
    return medianstate.medians(spark, path, _DELIVERED)


_SCALED = ("DAYS_BIRTH", "AMT_CREDIT", "CNT_FAM_MEMBERS", "FLAT")


@query(
    "minmax_scale",
    f"""{APP}, a as (select *, 5e0 as FLAT from application),
        f as (select {', '.join(f'min({c}) as {c}_lo, max({c}) as {c}_hi' for c in _SCALED)} from a where IN_TRAIN = 1)
        select SK_ID_CURR, {', '.join(
            f'({c} - {c}_lo) / case when {c}_hi = {c}_lo then 1 else {c}_hi - {c}_lo end as {c}' for c in _SCALED)}
        from a, f""",
)
def minmax_scale(spark: SparkSession, folder: str) -> DataFrame:
    """Ranges from the training applications, applied to all; values outside are not clipped."""
    rows = role(spark, folder, "application").withColumn("FLAT", F.lit(5.0))
    fit = rows.where("IN_TRAIN = 1").agg(*[F.struct(F.min(c), F.max(c)).alias(c) for c in _SCALED]).first()
    ranges = {c: (fit[c][0], fit[c][1]) for c in _SCALED}
    return clean.minmax_scale(rows.select(KEY, *_SCALED), ranges)


def _prepared_sql() -> str:
    """Checks of the whole chain per kept feature and part: count, extremes, mean of the clean values."""
    stats = ", ".join(
        f"count({q(c)}) as {q('n_' + c)}, median({q(c)}) as {q('m_' + c)}, min({q(c)}) as {q('l_' + c)}, max({q(c)}) as {q('h_' + c)}"
        for c in FEATURES
    )
    branches = []
    for c in FEATURES:
        filled = f"coalesce({q(c)}, {q('m_' + c)})"
        scaled = f"({filled} - {q('l_' + c)}) / case when {q('h_' + c)} = {q('l_' + c)} then 1 else {q('h_' + c)} - {q('l_' + c)} end"
        branches.append(
            f"select '{c}' as feature, part, count(*) as n, round(min({scaled}) + 0e0, 9) as lowest, "
            f"round(max({scaled}) + 0e0, 9) as highest, round(avg({scaled}), 7) as mean from cleared, s "
            f"where {q('n_' + c)} * 100 >= 80 * s.n_rows group by part"
        )
    return (
        f"with {WIDE_CTES}, s as materialized (select count(*) as n_rows, {stats} from cleared where part = 'train') "
        + " union all ".join(branches)
    )


def _part_extremes(parts: dict[str, DataFrame], features: list[str]) -> DataFrame:
    """Per part and feature the extremes and mean."""
    rows = reduce(DataFrame.unionByName, [d.select(F.lit(p).alias("part"), *features) for p, d in parts.items()])
    cells = ", ".join(
        f"named_struct('feature', '{c}', 'n', count({quoted(c)}), 'lowest', round(min({quoted(c)}) + 0d, 9), "
        f"'highest', round(max({quoted(c)}) + 0d, 9), 'mean', round(avg({quoted(c)}), 7))"
        for c in features
    )
    wide_stats = rows.groupBy("part").agg(F.expr(f"array({cells}) as cells"))
    return wide_stats.select("part", F.inline("cells"))


@query("prepared_dataset", _prepared_sql())
def prepared_dataset(spark: SparkSession, folder: str) -> DataFrame:
    """The whole cleaning chain; per part and kept feature the extremes and mean of the prepared values."""
    done = prepared(spark, folder)
    return _part_extremes({"train": done.train, "valid": done.valid, "test": done.test}, done.preparation.features)


@query("prepared_files", _prepared_sql())
def prepared_files(spark: SparkSession, folder: str) -> DataFrame:
    """The same from the three parts written as files and read again, with the features of the saved preparation."""
    done, path = prepared(spark, folder), fresh_path(spark, "dataset")
    done.preparation.save(spark, f"{path}/preparation")
    for name in ("train", "valid", "test"):
        tables.write_dataset(getattr(done, name), f"{path}/{name}")
    back = {name: tables.read_table(spark, f"{path}/{name}") for name in ("train", "valid", "test")}
    return _part_extremes(back, clean.Preparation.load(spark, f"{path}/preparation").features)
