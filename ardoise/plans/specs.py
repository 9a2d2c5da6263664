"""Which aggregates each history table contributes, and the derived columns they use."""

from ardoise.functions.aggspec import AggSpec

KEY = "SK_ID_CURR"

# Application columns coded by first appearance.
CODED = ("CODE_GENDER", "FLAG_OWN_CAR", "FLAG_OWN_REALTY")

# Ratios of the application (name: numerator, denominator).
APPLICATION_RATIOS = {
    "DAYS_EMPLOYED_PERC": ("DAYS_EMPLOYED", "DAYS_BIRTH"),
    "INCOME_CREDIT_PERC": ("AMT_INCOME_TOTAL", "AMT_CREDIT"),
    "INCOME_PER_PERSON": ("AMT_INCOME_TOTAL", "CNT_FAM_MEMBERS"),
    "ANNUITY_INCOME_PERC": ("AMT_ANNUITY", "AMT_INCOME_TOTAL"),
    "PAYMENT_RATE": ("AMT_ANNUITY", "AMT_CREDIT"),
}

# Aggregates per bureau credit of its monthly balances.
BALANCE = AggSpec.parse("MONTHS_BALANCE min max size")

# Aggregates of bureau credits per client.
BUREAU = AggSpec.parse(
    """
    DAYS_CREDIT             min max mean var
    DAYS_CREDIT_ENDDATE     min max mean
    DAYS_CREDIT_UPDATE      mean
    CREDIT_DAY_OVERDUE      max mean
    AMT_CREDIT_MAX_OVERDUE  mean
    AMT_CREDIT_SUM          max mean sum
    AMT_CREDIT_SUM_DEBT     max mean sum
    AMT_CREDIT_SUM_OVERDUE  mean
    AMT_CREDIT_SUM_LIMIT    mean sum
    AMT_ANNUITY             max mean
    CNT_CREDIT_PROLONG      sum
    MONTHS_BALANCE_MIN      min
    MONTHS_BALANCE_MAX      max
    MONTHS_BALANCE_SIZE     mean sum
    """
)

# Subsets of bureau credits with aggregates of their own (prefix: column, category).
BUREAU_SUBSETS = {"ACTIVE_": ("CREDIT_ACTIVE", "Active"), "CLOSED_": ("CREDIT_ACTIVE", "Closed")}

# Aggregates of previous applications per client.
PREVIOUS = AggSpec.parse(
    """
    AMT_ANNUITY              min max mean
    AMT_APPLICATION          min max mean
    AMT_CREDIT               min max mean
    APP_CREDIT_PERC          min max mean var
    AMT_DOWN_PAYMENT         min max mean
    AMT_GOODS_PRICE          min max mean
    HOUR_APPR_PROCESS_START  min max mean
    RATE_DOWN_PAYMENT        min max mean
    DAYS_DECISION            min max mean
    CNT_PAYMENT              mean sum
    """
)
PREVIOUS_RATIOS = {"APP_CREDIT_PERC": ("AMT_APPLICATION", "AMT_CREDIT")}
PREVIOUS_SUBSETS = {
    "APPROVED_": ("NAME_CONTRACT_STATUS", "Approved"),
    "REFUSED_": ("NAME_CONTRACT_STATUS", "Refused"),
}
# Day columns of previous applications that hold the "no date" marker.
PREVIOUS_MARKED = (
    "DAYS_FIRST_DRAWING",
    "DAYS_FIRST_DUE",
    "DAYS_LAST_DUE_1ST_VERSION",
    "DAYS_LAST_DUE",
    "DAYS_TERMINATION",
)

# Aggregates of point-of-sale and cash balances per client.
POS = AggSpec.parse(
    """
    MONTHS_BALANCE  max mean size
    SK_DPD          max mean
    SK_DPD_DEF      max mean
    """
)

# Aggregates of instalment payments per client.
INSTALMENTS = AggSpec.parse(
    """
    NUM_INSTALMENT_VERSION  nunique
    DPD                     max mean sum
    DBD                     max mean sum
    PAYMENT_PERC            max mean sum var
    PAYMENT_DIFF            max mean sum var
    AMT_INSTALMENT          max mean sum
    AMT_PAYMENT             min max mean sum
    DAYS_ENTRY_PAYMENT      max mean sum
    """
)
