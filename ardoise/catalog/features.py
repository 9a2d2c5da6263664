"""Feature blocks and the wide table on the given tables."""

from __future__ import annotations

import uuid

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ardoise.catalog import sqlgen
from ardoise.catalog.registry import query
from ardoise.catalog.sqlgen import select_block, tidy
from ardoise.catalog.standin import DIGITS, applications, loan_tables, role
from ardoise.operators.encode import categorical_columns, discover_categories
from ardoise.plans import blocks, encoder, wide
from ardoise.plans.increments import IncrementalBlock, State
from ardoise.plans.specs import CODED, INSTALMENTS, KEY, POS
from ardoise.plans.wide import LoanTables
from ardoise.sources.workdir import fresh_path, materialise


@query("application_features", select_block(sqlgen.application_block(), "application_block"))
def application_features(spark: SparkSession, folder: str) -> DataFrame:
    train, test = applications(spark, folder)
    others = [c for c in categorical_columns(train) if c not in CODED]
    categories = discover_categories(train, others, nan_category=False)
    both = wide.all_applications(train, test)
    return tidy(blocks.application(both, blocks.fit_codes(train), categories))


@query("bureau_block", select_block(sqlgen.bureau_block(), "bureau_block"))
def bureau_block(spark: SparkSession, folder: str) -> DataFrame:
    return tidy(
        blocks.bureau_and_balance(
            role(spark, folder, "bureau"), role(spark, folder, "bureau_balance"), digits=DIGITS["bureau"]
        )
    )


@query("previous_block", select_block(sqlgen.previous_block(), "previous_block"))
def previous_block(spark: SparkSession, folder: str) -> DataFrame:
    return tidy(blocks.previous_applications(role(spark, folder, "previous"), digits=DIGITS["previous"]))


@query("pos_block", select_block(sqlgen.pos_block(), "pos_block"))
def pos_block(spark: SparkSession, folder: str) -> DataFrame:
    return tidy(blocks.pos_cash(role(spark, folder, "pos")))


@query("installments_block", select_block(sqlgen.installments_block(), "installments_block"))
def installments_block(spark: SparkSession, folder: str) -> DataFrame:
    return tidy(blocks.installments_payments(role(spark, folder, "installments"), digits=DIGITS["installments"]))


@query("card_block", select_block(sqlgen.card_block(), "card_block"))
def card_block(spark: SparkSession, folder: str) -> DataFrame:
    return tidy(blocks.credit_card_balance(role(spark, folder, "card"), digits=DIGITS["card"]))


@query("wide_features", select_block(sqlgen.wide_block(), "wide"))
def wide_features(spark: SparkSession, folder: str) -> DataFrame:
    """All applications with all blocks."""
    return tidy(wide.wide_features(loan_tables(spark, folder)))


def _from_deliveries(block: IncrementalBlock, rows: DataFrame, day: str) -> DataFrame:
    """The block from three deliveries by day, each reduced to a state that is written, read and merged."""
    spark = rows.sparkSession
    # Written once: the deliveries would make the rows again for each of their scans.
    rows = materialise(rows.select(KEY, *dict.fromkeys([day, *block.spec, *block.categorical])), "history")
    first, second = rows.agg(F.percentile_approx(day, [0.6, 0.9], 1000)).first()[0]
    part = F.when(F.col(day) <= first, 0).when(F.col(day) <= second, 1).otherwise(2)
    state = None
    for k in range(3):
        delivered = block.state(rows.where(part == k))
        path = fresh_path(spark, "state")
        (delivered if state is None else block.merge(state, delivered)).save(path)
        state = State.load(spark, path)
    return tidy(block.block(state))


@query("installments_increments", select_block(sqlgen.installments_block(), "installments_block"))
def installments_increments(spark: SparkSession, folder: str) -> DataFrame:
    rows = blocks.instalment_rows(role(spark, folder, "installments"))
    block = IncrementalBlock(INSTALMENTS, "INSTAL_", categorical_columns(rows), DIGITS["installments"])
    return _from_deliveries(block, rows, "DAYS_INSTALMENT")


@query("pos_increments", select_block(sqlgen.pos_block(), "pos_block"))
def pos_increments(spark: SparkSession, folder: str) -> DataFrame:
    rows = role(spark, folder, "pos")
    return _from_deliveries(IncrementalBlock(POS, "POS_", categorical_columns(rows)), rows, "MONTHS_BALANCE")


# Next month one category of every table is gone and a new one has come: table, column, old, new.
RENAMED = (
    ("application", "NAME_INCOME_TYPE", "MACHINERY", "ROBOTICS"),
    ("application", "CODE_GENDER", "F", "D"),
    ("bureau", "CREDIT_ACTIVE", "Sold", "Settled"),
    ("bureau_balance", "STATUS", "A", "Z"),
    ("previous", "NAME_CONTRACT_STATUS", "Approved", "Granted"),
    ("pos", "NAME_CONTRACT_STATUS", "click", "tap"),
    ("installments", "NAME_KIND", "N", "M"),
    ("card", "NAME_CONTRACT_STATUS", "purchase", "order"),
)


def next_month(name: str, df: DataFrame) -> DataFrame:
    for table, column, old, new in RENAMED:
        if table == name:
            df = df.withColumn(column, F.when(F.col(column) == old, F.lit(new)).otherwise(F.col(column)))
    return df


def next_month_ctes() -> dict[str, str]:
    """The CTEs of the wide table over next month's rows, with the codes of this month."""
    ctes = {}
    for name, sql in sqlgen.wide_block().ctes.items():
        changes = [f"case when {c} = '{old}' then '{new}' else {c} end as {c}" for t, c, old, new in RENAMED if t == name]
        if name == "application":
            ctes["application_fit"] = sql
            sql = "select * from application_fit"
        if name.startswith("code_"):
            sql = sql.replace("from application ", "from application_fit ")
        ctes[name] = f"select * replace ({', '.join(changes)}) from ({sql})" if changes else sql
    return ctes


def saved_encoder(spark: SparkSession, folder: str, stages: list) -> tuple[PipelineModel, DataFrame]:
    """An encoder fitted this month, saved at the head of a pipeline and loaded; next month's applications.

    The views that the pipeline reads are next month's.
    """
    tables, prefix = loan_tables(spark, folder), f"loans_{uuid.uuid4().hex}_"
    encoder.register(tables, prefix)
    fitted = encoder.LoanEncoder(prefix=prefix, digits=DIGITS).fit(tables.train)
    path = fresh_path(spark, "encoder")
    PipelineModel([fitted, *stages]).save(path)
    history = [next_month(n, getattr(tables, n)) for n in encoder.HISTORY]
    encoder.register(LoanTables(tables.train, tables.test, *history), prefix)
    both = next_month("application", wide.all_applications(tables.train, tables.test))
    return PipelineModel.load(path), both


@query(
    "encoded_features",
    f"""with {', '.join(f'{n} as ({s})' for n, s in next_month_ctes().items())}
        select {KEY}, {', '.join(sqlgen.tidy_sql(n) if sqlgen.is_double(n) else sqlgen.q(n) for n in sqlgen.wide_block().names)}
        from wide""",
)
def encoded_features(spark: SparkSession, folder: str) -> DataFrame:
    """Next month's tables, each with a category gone and a new one, in the columns of a saved and loaded encoder."""
    model, both = saved_encoder(spark, folder, [])
    return tidy(model.transform(both))
