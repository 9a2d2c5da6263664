"""Feature blocks: one aggregated row per client from each history table.

Every block is one pass and one exchange on the client key: subset variants (active, closed, approved,
refused) are conditional aggregates of the same pass and dummy columns are never built.  Rows travel rather
than their partial sums, which are larger; a client with very many rows is reduced where its rows lie.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ardoise.functions.aggspec import (
    aggregate_columns,
    category_share,
    dummy_columns,
    dummy_five,
    dummy_name,
    five_numbers,
    in_category,
)
from ardoise.functions.exprs import add_ratios, clamp_zero, null_sentinel
from ardoise.operators.encode import (
    Categories,
    categorical_columns,
    discover_categories,
    factorize_apply,
    factorize_fit,
    numeric_columns,
)
from ardoise.operators.skew import skew_aggregate, skew_join
from ardoise.plans import specs
from ardoise.plans.specs import KEY

Digits = Mapping[str, int]


def fit_codes(train: DataFrame, order: str = KEY, columns: Sequence[str] = specs.CODED) -> dict[str, DataFrame]:
    """Code tables of the coded application columns, from the training applications."""
    return {c: factorize_fit(train, c, order) for c in columns if c in train.columns}


def application(
    df: DataFrame,
    codes: Mapping[str, DataFrame] | None = None,
    categories: Categories | None = None,
    nan_category: bool = False,
    on_zero: str = "ieee",
) -> DataFrame:
    """One row per request: three coded columns, the others one-hot, the employment marker cleared and
    five ratios.  Pass ``codes`` and ``categories`` fitted on the training rows."""
    codes = fit_codes(df) if codes is None else codes
    if categories is None:
        others = [c for c in categorical_columns(df) if c not in codes]
        categories = discover_categories(df, others, nan_category)
    for column, table in codes.items():
        df = factorize_apply(df, column, table)
    kept = [
        null_sentinel("DAYS_EMPLOYED").alias(c) if c == "DAYS_EMPLOYED" else F.col(c)
        for c in df.columns
        if c not in categories
    ]
    return add_ratios(df.select(*kept, *dummy_columns(categories)), specs.APPLICATION_RATIOS, on_zero)


def balance_per_credit(balance: DataFrame, categories: Categories) -> DataFrame:
    """Monthly balances of each bureau credit: extremes, number of months, shares of the status values."""
    return (
        balance.where(F.col("SK_ID_BUREAU").isNotNull())
        .groupBy("SK_ID_BUREAU")
        .agg(*aggregate_columns(specs.BALANCE, ""), *category_share(categories, ""))
    )


def bureau_and_balance(
    bureau: DataFrame,
    balance: DataFrame,
    categories: Categories | None = None,
    balance_categories: Categories | None = None,
    nan_category: bool = True,
    digits: Digits | None = None,
) -> DataFrame:
    """Bureau credits with their balances: ``BURO_*``, ``ACTIVE_*`` and ``CLOSED_*`` per client.

    The balances shrink to one row per credit before they meet the credits.
    """
    categories = discover_categories(bureau, nan_category=nan_category) if categories is None else categories
    if balance_categories is None:
        balance_categories = discover_categories(balance, nan_category=nan_category)
    credits = skew_join(bureau, balance_per_credit(balance, balance_categories), "SK_ID_BUREAU", "left")
    means = [f"{dummy_name(c, v)}_MEAN" for c, values in balance_categories.items() for v in values]
    aggregates = aggregate_columns(specs.BUREAU, "BURO_", digits=digits)
    aggregates += category_share(categories, "BURO_")
    aggregates += [F.avg(m).alias(f"BURO_{m}_MEAN") for m in means]
    for prefix, (column, value) in specs.BUREAU_SUBSETS.items():
        aggregates += aggregate_columns(specs.BUREAU, prefix, in_category(column, value), digits)
    return skew_aggregate(credits, KEY, aggregates, hot_in=bureau)


def previous_applications(
    df: DataFrame,
    categories: Categories | None = None,
    digits: Digits | None = None,
    on_zero: str = "ieee",
) -> DataFrame:
    """Earlier applications: ``PREV_*``, ``APPROVED_*`` and ``REFUSED_*`` per client."""
    categories = discover_categories(df) if categories is None else categories
    marked = [c for c in specs.PREVIOUS_MARKED if c in df.columns]
    rows = add_ratios(
        df.withColumns({c: null_sentinel(c) for c in marked}), specs.PREVIOUS_RATIOS, on_zero
    )
    aggregates = aggregate_columns(specs.PREVIOUS, "PREV_", digits=digits)
    aggregates += category_share(categories, "PREV_")
    for prefix, (column, value) in specs.PREVIOUS_SUBSETS.items():
        aggregates += aggregate_columns(specs.PREVIOUS, prefix, in_category(column, value), digits)
    return skew_aggregate(rows, KEY, aggregates)


def pos_cash(df: DataFrame, categories: Categories | None = None, digits: Digits | None = None) -> DataFrame:
    """Point-of-sale and cash balances: ``POS_*`` per client."""
    categories = discover_categories(df) if categories is None else categories
    aggregates = aggregate_columns(specs.POS, "POS_", digits=digits)
    aggregates += category_share(categories, "POS_")
    return skew_aggregate(df, KEY, [*aggregates, F.count(F.lit(1)).alias("POS_COUNT")])


def instalment_rows(df: DataFrame, on_zero: str = "ieee") -> DataFrame:
    """Instalment payments with what their aggregates need of each row."""
    late = F.col("DAYS_ENTRY_PAYMENT") - F.col("DAYS_INSTALMENT")
    return add_ratios(df, {"PAYMENT_PERC": ("AMT_PAYMENT", "AMT_INSTALMENT")}, on_zero).withColumns(
        {
            "PAYMENT_DIFF": F.col("AMT_INSTALMENT") - F.col("AMT_PAYMENT"),
            "DPD": clamp_zero(late),
            "DBD": clamp_zero(-late),
        }
    )


def installments_payments(
    df: DataFrame,
    categories: Categories | None = None,
    digits: Digits | None = None,
    on_zero: str = "ieee",
) -> DataFrame:
    """Instalment payments: ``INSTAL_*`` per client.  Days past due and before due are never negative, and
    zero when a date is missing."""
    categories = discover_categories(df) if categories is None else categories
    aggregates = aggregate_columns(specs.INSTALMENTS, "INSTAL_", digits=digits)
    aggregates += category_share(categories, "INSTAL_")
    return skew_aggregate(instalment_rows(df, on_zero), KEY, [*aggregates, F.count(F.lit(1)).alias("INSTAL_COUNT")])


def credit_card_balance(
    df: DataFrame, categories: Categories | None = None, digits: Digits | None = None
) -> DataFrame:
    """Card balances: five numbers of every column, ``CC_*`` per client."""
    categories = discover_categories(df) if categories is None else categories
    numeric = [c for c in numeric_columns(df) if c not in (KEY, "SK_ID_PREV")]
    aggregates = [*five_numbers(numeric, "CC_", digits), *dummy_five(categories, "CC_"), F.count(F.lit(1)).alias("CC_COUNT")]
    return skew_aggregate(df, KEY, aggregates)
