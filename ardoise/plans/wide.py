"""The wide table: training and test applications with all feature blocks."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ardoise.operators.encode import Categories, categorical_columns, discover_categories
from ardoise.plans import blocks
from ardoise.plans.specs import CODED, KEY

IS_TRAIN = "is_train"


@dataclass
class LoanTables:
    """The input tables, as DataFrames with the column names of FIXTURES.md."""

    train: DataFrame
    test: DataFrame
    bureau: DataFrame
    bureau_balance: DataFrame
    previous: DataFrame
    pos: DataFrame
    installments: DataFrame
    card: DataFrame
    # Known decimals of money columns, per table.
    digits: Mapping[str, Mapping[str, int]] = field(default_factory=dict)


def all_applications(train: DataFrame, test: DataFrame) -> DataFrame:
    """Both application tables in one, told apart by a flag; TARGET is missing for the test rows."""
    flagged = [
        train.withColumn(IS_TRAIN, F.lit(True)),
        test.withColumn(IS_TRAIN, F.lit(False)),
    ]
    return flagged[0].unionByName(flagged[1], allowMissingColumns=True)


def feature_blocks(
    t: LoanTables, on_zero: str = "ieee", categories: Mapping[str, Categories] | None = None
) -> dict[str, DataFrame]:
    """The five history blocks.  Unused ones cost nothing: a left join onto a unique side that nobody
    reads is removed by the optimizer.  ``categories`` gives the frozen ones of each table by its name."""
    of = (categories or {}).get
    return {
        "bureau": blocks.bureau_and_balance(
            t.bureau, t.bureau_balance, of("bureau"), of("bureau_balance"), digits=t.digits.get("bureau")
        ),
        "previous": blocks.previous_applications(
            t.previous, of("previous"), digits=t.digits.get("previous"), on_zero=on_zero
        ),
        "pos": blocks.pos_cash(t.pos, of("pos"), digits=t.digits.get("pos")),
        "installments": blocks.installments_payments(
            t.installments, of("installments"), digits=t.digits.get("installments"), on_zero=on_zero
        ),
        "card": blocks.credit_card_balance(t.card, of("card"), digits=t.digits.get("card")),
    }


def wide_features(t: LoanTables, on_zero: str = "ieee", categories: Categories | None = None) -> DataFrame:
    """Applications of both kinds with every block joined on: each block is built once, codes and
    categories come from the training rows, and the columns are the same for both kinds."""
    codes = blocks.fit_codes(t.train)
    if categories is None:
        others = [c for c in categorical_columns(t.train) if c not in CODED]
        categories = discover_categories(t.train, others, nan_category=False)
    app = blocks.application(all_applications(t.train, t.test), codes, categories, on_zero=on_zero)
    history = feature_blocks(t, on_zero)
    return reduce(lambda left, block: left.join(block, KEY, "left"), history.values(), app)
