"""From the wide table to the three clean datasets."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ardoise.operators.clean import FILL_LIMIT, Preparation, clear_infinite, feature_columns, fit_preparation
from ardoise.operators.median import exact_medians
from ardoise.operators.split import split
from ardoise.plans.specs import KEY
from ardoise.plans.wide import IS_TRAIN
from ardoise.sources.workdir import materialise


@dataclass
class Prepared:
    train: DataFrame
    valid: DataFrame
    test: DataFrame
    preparation: Preparation


def parts(wide: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Training, validation and test rows of the wide table."""
    known = wide.where(F.col(IS_TRAIN)).drop(IS_TRAIN)
    train, valid = split(known, KEY)
    return train, valid, wide.where(~F.col(IS_TRAIN)).drop(IS_TRAIN, "TARGET")


def prepare(wide: DataFrame, limit: int = FILL_LIMIT, test_own_median: bool = False, scaled: bool = True,
            written: bool = False) -> Prepared:
    """Fit on the training part, apply to all.  The wide table is written once (unless it is a ``written``
    one already); fitting and the three results are scans of the copy.  ``test_own_median`` fills the test
    rows with their own medians."""
    if not written:
        wide = materialise(wide, "wide")
    train, valid, test = parts(wide)
    features = feature_columns(wide, exclude=("TARGET", KEY, "SK_ID_BUREAU", "SK_ID_PREV", "index", IS_TRAIN))
    fitted = fit_preparation(train, features, limit)
    own = None
    if test_own_median:
        cleared = clear_infinite(test, fitted.features)
        own = {c: m for c, m in exact_medians(cleared, fitted.features).items() if m is not None}
    out = [fitted.clean(train), fitted.clean(valid), fitted.clean(test, own)]
    if scaled:
        out = [fitted.scale(d) for d in out]
    return Prepared(*out, fitted)
