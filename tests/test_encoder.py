"""The fitted encoder of all tables: saved, loaded elsewhere, given other tables."""

import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from ardoise.catalog.standin import DIGITS, loan_tables
from ardoise.plans import encoder, wide
from ardoise.plans.specs import KEY
from ardoise.plans.wide import LoanTables
from ardoise.sources.workdir import fresh_path


@pytest.fixture(scope="module")
def tables(spark, folder):
    return loan_tables(spark, folder)


@pytest.fixture(scope="module")
def model(tables):
    encoder.register(tables, "enc_")
    return encoder.LoanEncoder(prefix="enc_", digits=DIGITS).fit(tables.train)


def same(a, b):
    a, b = a.select(*[f"`{c}`" for c in sorted(a.columns)]), b.select(*[f"`{c}`" for c in sorted(b.columns)])
    return a.columns == b.columns and a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def test_equals_the_wide_table(tables, model):
    both = wide.all_applications(tables.train, tables.test)
    assert same(model.transform(both), wide.wide_features(tables))


def test_saved_and_loaded_in_another_session(spark, tables, model):
    path = fresh_path(spark, "encoder")
    PipelineModel([model]).save(path)
    other = spark.newSession()
    loaded = PipelineModel.load(path).stages[0]
    for name in ("schemas", "codes", "categories", "columns", "digits"):
        assert getattr(loaded, name) == getattr(model, name), name
    assert loaded.uid == model.uid and loaded.getOrDefault("prefix") == "enc_"
    for name in encoder.HISTORY:
        # The other session has tables of its own under these names: no history at all.
        empty = getattr(tables, name).limit(0)
        other.createDataFrame([], empty.schema).createOrReplaceTempView(f"enc_{name}")
    rows = other.createDataFrame(tables.test.collect(), tables.test.schema)
    got = loaded.transform(rows)
    assert got.columns == [KEY, *model.columns] and got.count() == tables.test.count()
    assert got.agg(F.count("BURO_AMT_CREDIT_SUM_MEAN")).first()[0] == 0
    # This session still reads its own.
    assert same(loaded.transform(tables.test), model.transform(tables.test))


def test_other_columns_categories_and_types(spark, tables, model):
    later = model.copy({model.prefix: "later_"})
    card = tables.card.drop("AMT_DRAWINGS_CURRENT").withColumn("FURTHER", F.lit(1.0)).withColumn("NAME_NEW", F.lit("x"))
    bureau = tables.bureau.withColumn("CREDIT_ACTIVE", F.lit("Reopened")).drop("CREDIT_TYPE").withColumn("AMT_ANNUITY", F.col("AMT_ANNUITY").cast("int"))
    encoder.register(LoanTables(tables.train, tables.test, bureau, tables.bureau_balance, tables.previous, tables.pos, tables.installments, card), "later_")
    rows = tables.test.drop("AMT_ANNUITY", "NAME_HOUSING_TYPE").withColumns({"CODE_GENDER": F.lit("new"), "NAME_INCOME_TYPE": F.lit("new"), "MORE": F.lit(1)})
    got = later.transform(rows).cache()
    assert got.columns == [KEY, *model.columns] and got.count() == rows.count()
    zero = [c for c in model.columns if c.startswith(("BURO_CREDIT_ACTIVE_", "NAME_INCOME_TYPE_", "NAME_HOUSING_TYPE_")) and "nan" not in c]
    top = got.agg(*[F.max(f"`{c}`").alias(c) for c in [*zero, "CODE_GENDER"]]).first().asDict()
    assert top.pop("CODE_GENDER") == -1 and set(top.values()) == {0}
    shares = got.agg(F.min("BURO_CREDIT_TYPE_nan_MEAN"), F.max("BURO_CREDIT_TYPE_nan_MEAN"), F.count("AMT_ANNUITY"), F.count("CC_AMT_DRAWINGS_CURRENT_MEAN")).first()
    assert tuple(shares) == (1.0, 1.0, 0, 0)


def test_estimator_is_saved_and_categories_are_bounded(spark, tables):
    encoder.register(tables, "enc_")
    path = fresh_path(spark, "unfitted")
    encoder.LoanEncoder(prefix="enc_", onZero="null", digits=DIGITS).save(path)
    again = encoder.LoanEncoder.load(path)
    assert (again.getOrDefault("onZero"), again.getOrDefault("prefix"), again.digits) == ("null", "enc_", DIGITS)
    with pytest.raises(ValueError, match="more than 2"):
        encoder.LoanEncoder(prefix="enc_", maxCategories=2).fit(tables.train)


def test_empty_tables(spark, tables, model):
    encoder.register(LoanTables(tables.train, tables.test, *[getattr(tables, n).limit(0) for n in encoder.HISTORY]), "none_")
    none = model.copy({model.prefix: "none_"})
    assert none.transform(tables.test.limit(0)).count() == 0
    fitted = encoder.LoanEncoder(prefix="none_").fit(tables.train)
    assert "BURO_DAYS_CREDIT_MIN" in fitted.columns and fitted.categories["pos"] == {"NAME_CONTRACT_STATUS": [None]}
