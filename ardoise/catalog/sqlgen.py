"""Oracle SQL of the feature blocks, written the long way round: dummy columns, one grouped query per
subset, joined back."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame

from ardoise.catalog.standin import DIGITS, role_sql
from ardoise.functions.aggspec import quoted
from ardoise.operators.clean import finite_sql
from ardoise.plans import specs
from ardoise.plans.specs import KEY

# Categories present in the given tables.
STATUS = {"STATUS": ["A", "N", "R", None]}
BUREAU_CATEGORIES = {
    "CREDIT_ACTIVE": ["Active", "Closed", "Sold", None],
    "CREDIT_TYPE": ["1-URGENT", "2-HIGH", "3-MEDIUM", "5-LOW", None],
}
PREVIOUS_CATEGORIES = {
    "NAME_CONTRACT_STATUS": ["Approved", "Canceled", "Refused", None],
    "NAME_CONTRACT_TYPE": ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW", None],
}
POS_CATEGORIES = {"NAME_CONTRACT_STATUS": ["click", "error", "purchase", "signup", "view", None]}
CARD_CATEGORIES = {"NAME_CONTRACT_STATUS": ["click", "error", "purchase", "view", None]}
KIND = {"NAME_KIND": ["A", "N", "R", None]}
APPLICATION_CATEGORIES = {
    "NAME_INCOME_TYPE": ["AUTOMOBILE", "BUILDING", "HOUSEHOLD", "MACHINERY"],
    "NAME_HOUSING_TYPE": ["Flat", "House"],
}


def digits_of(column: str) -> int | None:
    """Decimals that survive a different order of additions; None where sums are exact anyway."""
    if column.endswith("_VAR"):
        # Variances of short decimals end on short decimals: few digits for the large, many for the small.
        return 1 if "AMT_" in column or "PAYMENT_DIFF" in column else 9 if "PERC" in column else 6
    if "PERC" in column or column.endswith("_MEAN_MEAN"):
        return 9
    return None


def tidy(df: DataFrame) -> DataFrame:
    """Infinite results cleared, unstable decimals cut."""
    out = []
    for name, kind in df.dtypes:
        value = quoted(name)
        if kind == "double":
            value = f"{finite_sql(name)} + 0d"
            if digits_of(name) is not None:
                value = f"round({value}, {digits_of(name)})"
        out.append(f"{value} as {quoted(name)}")
    return df.selectExpr(*out)


def tidy_sql(name: str) -> str:
    q = f'"{name}"'
    value = f"(case when isfinite(cast({q} as double)) then {q} end) + 0e0"
    digits = digits_of(name)
    return f"round({value}, {digits}) as {q}" if digits is not None else f"{value} as {q}"


def q(name: str) -> str:
    return f'"{name}"'


def dummies(categories: Mapping[str, Sequence]) -> dict[str, str]:
    out = {}
    for c, values in categories.items():
        for v in values:
            if v is None:
                out[f"{c}_nan"] = f"case when {q(c)} is null then 1 else 0 end"
            else:
                out[f"{c}_{v}"] = f"case when {q(c)} = '{v}' then 1 else 0 end"
    return out


def aggregate(fn: str, c: str, digits: int | None) -> str:
    s = f"coalesce(sum({c}), 0)" if digits is None else f"round(coalesce(sum({c}), 0), {digits})"
    return {
        "min": f"min({c})", "max": f"max({c})", "var": f"var_samp({c})", "size": "count(*)",
        "nunique": f"count(distinct {c})", "sum": f"cast({s} as double)",
        "mean": f"cast({s} as double) / nullif(count({c}), 0)",
    }[fn]


def spec_sql(spec: Mapping[str, Sequence[str]], prefix: str, digits: Mapping[str, int] | None = None) -> list[str]:
    digits = digits or {}
    return [
        f"{aggregate(fn, q(c), digits.get(c))} as {q(f'{prefix}{c}_{fn.upper()}')}" for c, fns in spec.items() for fn in fns
    ]


def mean_sql(columns: Sequence[str], prefix: str) -> list[str]:
    return [f"avg({q(c)}) as {q(f'{prefix}{c}_MEAN')}" for c in columns]


def ratio_sql(n: str, d: str) -> str:
    return (
        f"case when {d} = 0 then case when {n} > 0 then 'Infinity'::double when {n} < 0 then '-Infinity'::double end "
        f"else {n} / {d} end"
    )


def encoded(source: str, categories: Mapping[str, Sequence], extra: Mapping[str, str] | None = None) -> str:
    columns = [f"{sql} as {q(name)}" for name, sql in {**dummies(categories), **(extra or {})}.items()]
    return f"select *, {', '.join(columns)} from {source}"


class Block:
    """CTEs and the column names of one block."""

    def __init__(self, ctes: dict[str, str], names: list[str]):
        self.ctes, self.names = ctes, names


def subset_block(name: str, rows: str, spec, prefix: str, categories, subsets, digits, extra_means=()) -> Block:
    means = mean_sql([*dummies(categories), *extra_means], prefix)
    ctes = {f"{name}_0": f"select {KEY}, {', '.join(spec_sql(spec, prefix, digits) + means)} from {rows} group by {KEY}"}
    names = spec.names(prefix) + [f"{prefix}{c}_MEAN" for c in [*dummies(categories), *extra_means]]
    joins = ""
    for i, (p, (column, value)) in enumerate(subsets.items(), 1):
        ctes[f"{name}_{i}"] = (
            f"select {KEY}, {', '.join(spec_sql(spec, p, digits))} from {rows} where {q(f'{column}_{value}')} = 1 group by {KEY}"
        )
        joins += f" left join {name}_{i} using ({KEY})"
        names += spec.names(p)
    ctes[name] = f"select * from {name}_0{joins}"
    return Block(ctes, names)


def bureau_block() -> Block:
    ctes = {
        "bureau": role_sql("bureau"),
        "bureau_balance": role_sql("bureau_balance"),
        "balance_rows": encoded("bureau_balance", STATUS),
        "balance_agg": "select SK_ID_BUREAU, min(MONTHS_BALANCE) as MONTHS_BALANCE_MIN, max(MONTHS_BALANCE) as MONTHS_BALANCE_MAX, "
        "count(*) as MONTHS_BALANCE_SIZE, " + ", ".join(mean_sql(list(dummies(STATUS)), "")) + " from balance_rows group by SK_ID_BUREAU",
        "bureau_rows": f"select * from ({encoded('bureau', BUREAU_CATEGORIES)}) left join balance_agg using (SK_ID_BUREAU)",
    }
    b = subset_block(
        "bureau_block", "bureau_rows", specs.BUREAU, "BURO_", BUREAU_CATEGORIES, specs.BUREAU_SUBSETS,
        DIGITS["bureau"], [f"{c}_MEAN" for c in dummies(STATUS)],
    )
    return Block({**ctes, **b.ctes}, b.names)


def previous_block() -> Block:
    ctes = {
        "previous": role_sql("previous"),
        "previous_rows": encoded("previous", PREVIOUS_CATEGORIES, {"APP_CREDIT_PERC": ratio_sql("AMT_APPLICATION", "AMT_CREDIT")}),
    }
    b = subset_block(
        "previous_block", "previous_rows", specs.PREVIOUS, "PREV_", PREVIOUS_CATEGORIES, specs.PREVIOUS_SUBSETS,
        DIGITS["previous"],
    )
    return Block({**ctes, **b.ctes}, b.names)


def plain_block(name: str, source: dict[str, str], rows: str, spec, prefix: str, categories, digits, count: str) -> Block:
    columns = spec_sql(spec, prefix, digits) + mean_sql(list(dummies(categories)), prefix) + [f"count(*) as {count}"]
    ctes = {**source, name: f"select {KEY}, {', '.join(columns)} from {rows} group by {KEY}"}
    return Block(ctes, spec.names(prefix) + [f"{prefix}{c}_MEAN" for c in dummies(categories)] + [count])


def pos_block() -> Block:
    source = {"pos": role_sql("pos"), "pos_rows": encoded("pos", POS_CATEGORIES)}
    return plain_block("pos_block", source, "pos_rows", specs.POS, "POS_", POS_CATEGORIES, None, "POS_COUNT")


def installments_block() -> Block:
    late = "DAYS_ENTRY_PAYMENT - DAYS_INSTALMENT"
    extra = {
        "PAYMENT_PERC": ratio_sql("AMT_PAYMENT", "AMT_INSTALMENT"),
        "PAYMENT_DIFF": "AMT_INSTALMENT - AMT_PAYMENT",
        "DPD": f"case when {late} > 0 then {late} else 0e0 end",
        "DBD": f"case when {late} < 0 then -({late}) else 0e0 end",
    }
    source = {"installments": role_sql("installments"), "instal_rows": encoded("installments", KIND, extra)}
    return plain_block(
        "installments_block", source, "instal_rows", specs.INSTALMENTS, "INSTAL_", KIND, DIGITS["installments"], "INSTAL_COUNT"
    )


def card_block() -> Block:
    five = ("min", "max", "mean", "sum", "var")
    columns = ["MONTHS_BALANCE", "AMT_BALANCE", "AMT_DRAWINGS_CURRENT", "CNT_DRAWINGS_CURRENT", *dummies(CARD_CATEGORIES)]
    spec = specs.AggSpec({c: five for c in columns})
    ctes = {
        "card": role_sql("card"),
        "card_rows": encoded("card", CARD_CATEGORIES),
        "card_block": f"select {KEY}, {', '.join(spec_sql(spec, 'CC_', DIGITS['card']))}, count(*) as CC_COUNT from card_rows group by {KEY}",
    }
    return Block(ctes, spec.names("CC_") + ["CC_COUNT"])


def application_block() -> Block:
    ctes = {"application": role_sql("application")}
    joins = ""
    for c in specs.CODED:
        ctes[f"code_{c}"] = (
            f"select {c} as v, row_number() over (order by min({KEY})) - 1 as code from application "
            f"where IN_TRAIN = 1 and {c} is not null group by {c}"
        )
        joins += f" left join code_{c} on application.{c} = code_{c}.v"
    numbers = ["DAYS_BIRTH", "AMT_INCOME_TOTAL", "AMT_CREDIT", "CNT_FAM_MEMBERS", "AMT_ANNUITY"]
    columns = [KEY, "IN_TRAIN = 1 as is_train", "case when IN_TRAIN = 1 then TARGET end as TARGET"]
    columns += [f"cast(coalesce(code_{c}.code, -1) as integer) as {c}" for c in specs.CODED]
    columns += ["nullif(DAYS_EMPLOYED, 365243) as DAYS_EMPLOYED", *numbers]
    columns += [f"{sql} as {q(name)}" for name, sql in dummies(APPLICATION_CATEGORIES).items()]
    ctes["app_coded"] = f"select {', '.join(columns)} from application{joins}"
    ratios = [f"{ratio_sql(n, d)} as {name}" for name, (n, d) in specs.APPLICATION_RATIOS.items()]
    ctes["application_block"] = f"select *, {', '.join(ratios)} from app_coded"
    names = ["is_train", "TARGET", *specs.CODED, "DAYS_EMPLOYED", *numbers, *dummies(APPLICATION_CATEGORIES), *specs.APPLICATION_RATIOS]
    return Block(ctes, names)


_EXACT = {"is_train", "TARGET", *specs.CODED}


def column_sql(name: str, kind: str) -> str:
    return q(name) if kind != "double" else tidy_sql(name)


def is_double(name: str) -> bool:
    """Whether the block column is a double (the others are integers)."""
    if name in _EXACT or name in dummies(APPLICATION_CATEGORIES):
        return False
    if name.endswith(("_COUNT", "_SIZE", "_NUNIQUE")):
        return False
    if name.startswith("CC_NAME_") and name.endswith(("_MIN", "_MAX")):
        return False
    return not name.endswith(("MONTHS_BALANCE_MIN_MIN", "MONTHS_BALANCE_MAX_MAX", "CC_MONTHS_BALANCE_MIN", "CC_MONTHS_BALANCE_MAX", "POS_MONTHS_BALANCE_MAX"))


def select_block(block: Block, name: str) -> str:
    ctes = ",\n".join(f"{n} as ({s})" for n, s in block.ctes.items())
    columns = ", ".join(tidy_sql(n) if is_double(n) else q(n) for n in block.names)
    return f"with {ctes}\nselect {KEY}, {columns} from {name}"


def wide_block() -> Block:
    blocks = {
        "bureau_block": bureau_block(), "previous_block": previous_block(), "pos_block": pos_block(),
        "installments_block": installments_block(), "card_block": card_block(),
    }
    app = application_block()
    ctes, names, joins = dict(app.ctes), list(app.names), ""
    for name, b in blocks.items():
        ctes.update(b.ctes)
        names += b.names
        joins += f" left join {name} using ({KEY})"
    ctes["wide"] = f"select * from application_block{joins}"
    return Block(ctes, names)
