"""Dictionary-driven aggregation: ``{column: [functions]}`` turned into one ``groupBy().agg(...)``.

Everything is algebraic (partial aggregation works on the map side, so a hot key costs one buffer per
task), and parts are shared: a mean is its sum over its count, every size is the same ``count(*)``, and
the share of a category is one conditional count.  Catalyst keeps one buffer for equal aggregates, which
keeps wide feature blocks narrow.

The aggregates are SQL expressions: one call to the JVM each, where composed columns would need a dozen.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

FUNCTIONS = ("min", "max", "mean", "sum", "var", "size", "nunique")
FIVE = ("min", "max", "mean", "sum", "var")


class AggSpec(dict):
    """Column name to list of functions.  ``AggSpec.parse`` reads lines of ``COLUMN fn fn ...``."""

    @classmethod
    def parse(cls, text: str) -> AggSpec:
        spec = cls()
        for line in text.strip().splitlines():
            column, *fns = line.split()
            spec[column] = fns
        return spec.check()

    def check(self) -> AggSpec:
        for column, fns in self.items():
            unknown = [f for f in fns if f not in FUNCTIONS]
            if unknown:
                raise ValueError(f"unknown aggregate {unknown} for {column}; known: {FUNCTIONS}")
        return self

    def names(self, prefix: str) -> list[str]:
        return [f"{prefix}{c}_{f.upper()}" for c, fns in self.items() for f in fns]


def quoted(column: str) -> str:
    return "`" + column.replace("`", "``") + "`"


def literal(value: str) -> str:
    return "'" + str(value).replace("\\", "\\\\").replace("'", "\\'") + "'"


def in_category(column: str, value: str | None) -> str:
    """SQL condition: the row belongs to the category; ``None`` is the category of missing values."""
    return f"{quoted(column)} is null" if value is None else f"{quoted(column)} <=> {literal(value)}"


def matches(column: str, value: str | None) -> Column:
    return F.expr(in_category(column, value))


def dummy_name(column: str, value: str | None) -> str:
    return f"{column}_{'nan' if value is None else value}"


def _sum(value: str, digits: int | None) -> str:
    total = f"coalesce(sum({value}), 0d)"
    # Values with a known number of decimals: rounding the sum to them makes it independent of the
    # order in which partial sums meet.
    return total if digits is None else f"round({total}, {digits})"


def _one(fn: str, column: str, condition: str | None, digits: int | None) -> str:
    value = quoted(column)
    number = f"cast({value} as double)"
    rows = "count(1)"
    if condition is not None:
        value = f"case when {condition} then {value} end"
        number = f"case when {condition} then {number} end"
        rows = f"count(case when {condition} then 1 end)"

    def present(result: str) -> str:
        # A group without any row of the subset has no result at all, not a zero.
        return result if condition is None else f"case when {rows} > 0 then {result} end"

    if fn in ("min", "max"):
        return f"{fn}({value})"
    if fn == "mean":
        return f"try_divide({_sum(number, digits)}, count({number}))"
    if fn == "sum":
        return present(_sum(number, digits))
    if fn == "var":
        return f"var_samp({number})"
    if fn == "size":
        return present(rows)
    if fn == "nunique":
        return present(f"count(distinct {value})")
    raise ValueError(f"unknown aggregate {fn}")


def aggregate_columns(
    spec: Mapping[str, Iterable[str]],
    prefix: str,
    condition: str | None = None,
    digits: Mapping[str, int] | None = None,
) -> list[Column]:
    """Aggregate columns named ``<prefix><COLUMN>_<FN>``.

    ``condition`` (SQL) restricts the aggregates to a subset of the rows without a second pass over them.
    ``digits`` gives the known decimals of a column.
    """
    digits = digits or {}
    return [
        F.expr(f"{_one(fn, c, condition, digits.get(c))} as {quoted(f'{prefix}{c}_{fn.upper()}')}")
        for c, fns in spec.items()
        for fn in fns
    ]


def category_share(categories: Mapping[str, Iterable[str | None]], prefix: str) -> list[Column]:
    """Share of each category in the group: the mean of a dummy column that is never built."""
    return [
        F.expr(
            f"count(case when {in_category(c, v)} then 1 end) / count(1) "
            f"as {quoted(f'{prefix}{dummy_name(c, v)}_MEAN')}"
        )
        for c, values in categories.items()
        for v in values
    ]


def dummy_columns(categories: Mapping[str, Iterable[str | None]]) -> list[Column]:
    """0/1 column of each category."""
    return [
        F.expr(f"cast({in_category(c, v)} as int) as {quoted(dummy_name(c, v))}")
        for c, values in categories.items()
        for v in values
    ]


def five_numbers(columns: Iterable[str], prefix: str, digits: Mapping[str, int] | None = None) -> list[Column]:
    """min, max, mean, sum and sample variance of every numeric column."""
    return aggregate_columns({c: FIVE for c in columns}, prefix, digits=digits)


def dummy_five(categories: Mapping[str, Iterable[str | None]], prefix: str) -> list[Column]:
    """The same five numbers of the 0/1 column of each category, all from one count per category."""
    out = []
    for c, values in categories.items():
        for v in values:
            n, k = "count(1)", f"count(case when {in_category(c, v)} then 1 end)"
            parts = {
                "MIN": f"cast({k} = {n} as int)",
                "MAX": f"cast({k} > 0 as int)",
                "MEAN": f"{k} / {n}",
                "SUM": f"cast({k} as double)",
                "VAR": f"try_divide(cast({k} * ({n} - {k}) as double), cast({n} * ({n} - 1) as double))",
            }
            name = prefix + dummy_name(c, v)
            out += [F.expr(f"{sql} as {quoted(f'{name}_{part}')}") for part, sql in parts.items()]
    return out
