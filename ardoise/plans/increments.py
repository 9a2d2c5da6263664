"""Feature blocks kept up to date: each delivery of history rows becomes a small state, states are merged, and a
block is made from its state without the old rows.

A state is two tables.  ``moments`` has one row per client: the number of rows, and per column the count, sum,
extremes, mean and squared distance from the mean of its values.  ``seen`` has one row per client, column and
value with the number of rows: shares of categories and numbers of distinct values need it, and a client with
very many values is many rows rather than one long list.

Merging is exact for counts, sums with known decimals, extremes and distinct values; variances are merged by the
formula for two samples, which loses no digits to cancellation.  Rows without a client are left out as in the
blocks, a client of one state only keeps its row, and an empty delivery changes nothing.  The order of deliveries
does not matter.  Each row must be delivered once: a state cannot tell a row that comes again.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ardoise.functions.aggspec import AggSpec, dummy_name, literal, quoted
from ardoise.operators.encode import Categories
from ardoise.operators.skew import cool_and_hot, hot_keys, skew_aggregate
from ardoise.plans.specs import KEY

SEEN = f"{KEY} bigint, name string, value string, n bigint"


@dataclass(frozen=True)
class State:
    """Two tables, see above."""

    moments: DataFrame
    seen: DataFrame

    def save(self, path: str) -> None:
        self.moments.write.parquet(f"{path}/moments")
        self.seen.write.parquet(f"{path}/seen")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> State:
        return cls(*(spark.read.parquet(f"{path}/{name}") for name in ("moments", "seen")))


def _part(column: str, what: str) -> str:
    return quoted(f"{column}|{what}")


@dataclass(frozen=True)
class IncrementalBlock:
    """A block by its aggregates, its categorical columns and the names of its results.

    ``digits`` gives the known decimals of a column, as in the blocks; they must be the same in all deliveries.
    """

    spec: AggSpec
    prefix: str
    categorical: Sequence[str]
    digits: Mapping[str, int] = field(default_factory=dict)

    @property
    def _numbers(self) -> list[str]:
        return [c for c, fns in self.spec.items() if set(fns) - {"size", "nunique"}]

    @property
    def _distinct(self) -> list[str]:
        return [c for c, fns in self.spec.items() if "nunique" in fns]

    def _rounded(self, sql: str, column: str) -> str:
        return f"round({sql}, {self.digits[column]})" if column in self.digits else sql

    def state(self, rows: DataFrame) -> State:
        """State of one delivery: two aggregations.  The rows travel once for each, with the columns that it needs."""
        rows = rows.where(F.col(KEY).isNotNull()).withColumn(KEY, F.col(KEY).cast("bigint"))
        parts = ["count(1) as rows"]
        for c in self._numbers:
            x = f"cast({quoted(c)} as double)"
            total = self._rounded(f"coalesce(sum({x}), 0d)", c)
            parts += [
                f"count({x}) as {_part(c, 'n')}", f"{total} as {_part(c, 'sum')}", f"min({quoted(c)}) as {_part(c, 'min')}",
                f"max({quoted(c)}) as {_part(c, 'max')}",
            ]
            if "var" in self.spec[c]:
                parts += [f"avg({x}) as {_part(c, 'mean')}", f"var_pop({x}) * count({x}) as {_part(c, 'far')}"]
        hot = hot_keys(rows, KEY)
        moments = skew_aggregate(rows, KEY, [F.expr(p) for p in parts], hot=hot)
        kinds = dict(rows.dtypes)
        cells = []
        for c in dict.fromkeys([*self.categorical, *self._distinct]):
            # Zero of either sign is one value.
            x = f"{quoted(c)} + 0d" if kinds[c] in ("double", "float") else quoted(c)
            cells.append(f"named_struct('name', {literal(c)}, 'value', cast({x} as string))")
        if not cells:
            return State(moments, rows.sparkSession.createDataFrame([], SEEN))
        values = [F.expr(f"inline(array({', '.join(cells)}))")]
        few, many = cool_and_hot(rows, KEY, hot)
        seen = few.repartition(KEY).select(KEY, *values).groupBy(KEY, "name", "value").agg(F.count(F.lit(1)).alias("n"))
        if many is not None:
            seen = seen.unionByName(many.select(KEY, *values).groupBy(KEY, "name", "value").agg(F.count(F.lit(1)).alias("n")))
        return State(moments, seen)

    def merge(self, old: State, new: State) -> State:
        """State of both deliveries: a join of clients that are unique on both sides, and a sum."""
        out = [f"coalesce(a.{KEY}, b.{KEY}) as {KEY}", "coalesce(a.rows, 0) + coalesce(b.rows, 0) as rows"]
        for c in self._numbers:
            n, total, low, high, mean, far = (_part(c, w) for w in ("n", "sum", "min", "max", "mean", "far"))
            na, nb = f"coalesce(a.{n}, 0)", f"coalesce(b.{n}, 0)"
            both = self._rounded(f"coalesce(a.{total}, 0d) + coalesce(b.{total}, 0d)", c)
            out += [
                f"{na} + {nb} as {n}", f"{both} as {total}", f"least(a.{low}, b.{low}) as {low}",
                f"greatest(a.{high}, b.{high}) as {high}",
            ]
            if "var" in self.spec[c]:
                # A side without values has neither mean nor distance; the other side's then hold as they are.
                share = f"({nb} / ({na} + {nb}))"
                shift = f"(b.{mean} - a.{mean})"
                out += [
                    f"case when {na} = 0 then b.{mean} when {nb} = 0 then a.{mean} else a.{mean} + {shift} * {share} end as {mean}",
                    f"case when {na} = 0 then b.{far} when {nb} = 0 then a.{far} "
                    f"else a.{far} + b.{far} + {shift} * {shift} * {na} * {share} end as {far}",
                ]
        moments = old.moments.alias("a").join(new.moments.alias("b"), F.expr(f"a.{KEY} = b.{KEY}"), "full")
        seen = old.seen.unionByName(new.seen).groupBy(KEY, "name", "value").agg(F.sum("n").alias("n"))
        return State(moments.selectExpr(*out), seen)

    def categories(self, state: State) -> Categories:
        """All categories delivered so far, sorted, each list ended by the one of missing values."""
        found: Categories = {c: [] for c in self.categorical}
        if found:
            named = state.seen.where(F.col("name").isin(list(found)) & F.col("value").isNotNull())
            for r in named.select("name", "value").distinct().collect():
                found[r["name"]].append(r["value"])
        return {c: [*sorted(v), None] for c, v in found.items()}

    def block(self, state: State, categories: Mapping[str, Iterable[str | None]] | None = None) -> DataFrame:
        """The feature block, one row per client, as a pass over all rows ever delivered would give it.

        ``categories`` are the frozen ones of a model, or else all that were delivered.
        """
        categories = self.categories(state) if categories is None else categories
        counts = [
            f"count(case when name = {literal(c)} and value is not null then 1 end) as {_part(c, 'nunique')}" for c in self._distinct
        ]
        shares = []
        for c, values in categories.items():
            for v in values:
                alike = "value is null" if v is None else f"value = {literal(v)}"
                counts.append(f"coalesce(sum(case when name = {literal(c)} and {alike} then n end), 0) as {_part(dummy_name(c, v), 'rows')}")
                shares.append(f"{_part(dummy_name(c, v), 'rows')} / rows as {quoted(f'{self.prefix}{dummy_name(c, v)}_MEAN')}")
        both = state.moments
        if counts:
            both = both.join(state.seen.groupBy(KEY).agg(*map(F.expr, counts)), KEY, "left")
        results = []
        for c, fns in self.spec.items():
            sql = {
                "min": _part(c, "min"), "max": _part(c, "max"), "sum": _part(c, "sum"), "size": "rows", "nunique": _part(c, "nunique"),
                "mean": f"try_divide({_part(c, 'sum')}, {_part(c, 'n')})",
                "var": f"case when {_part(c, 'n')} > 1 then {_part(c, 'far')} / ({_part(c, 'n')} - 1) end",
            }
            results += [f"{sql[fn]} as {quoted(f'{self.prefix}{c}_{fn.upper()}')}" for fn in fns]
        return both.selectExpr(KEY, *results, *shares, f"rows as {quoted(f'{self.prefix}COUNT')}")
