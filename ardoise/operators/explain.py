"""Why a decision came out as it did: global coefficients, contributions per request, a local surrogate,
and a client beside its peers."""

from __future__ import annotations

import sys
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from ardoise.functions.aggspec import literal, quoted
from ardoise.functions.exprs import clean_label, sign_label
from ardoise.operators.clean import long_counts
from ardoise.operators.median import double_literal
from ardoise.operators.profile import top_abs, top_group_mean
from ardoise.operators.skew import lookup_join
from ardoise.operators.treetable import TableForest

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Features shown, forest features shown, perturbed rows and kernel width of the surrogate.
TOP_LOCAL = 10
TOP_FOREST = 40
SURROGATE_SAMPLES = 5000
KERNEL_FACTOR = 0.75
QUARTILES = (0.25, 0.5, 0.75)

#: Requests of a task: few, since each takes tens of milliseconds.
ROWS_PER_TASK = 100


def importance_table(spark: SparkSession, features: Sequence[str], values: Sequence[float]) -> DataFrame:
    """(Features, Importance): one row per feature of a fitted model."""
    return spark.createDataFrame(
        list(zip(features, [float(v) for v in values])), "Features string, Importance double"
    )


def global_importance(table: DataFrame, n: int = TOP_LOCAL) -> DataFrame:
    """The n features of largest absolute coefficient, with rank, cleaned label and direction."""
    top = top_abs(table, "Importance", n, "Features")
    # n rows.
    rank = F.row_number().over(Window.orderBy(F.abs("Importance").desc(), "Features"))
    return top.select(
        rank.alias("rank"), "Features", "Importance",
        clean_label("Features").alias("label"), sign_label("Importance").alias("effect"),
    )


def forest_importance(table: DataFrame, n: int = TOP_FOREST) -> DataFrame:
    return top_group_mean(table, "Features", "Importance", n)


def _top_entries(entries: Column, n: int) -> Column:
    """The n structs (feature, contribution) of largest absolute contribution, inside the row."""
    keyed = F.transform(
        entries,
        lambda e: F.struct((-F.abs(e["contribution"])).alias("k"), e["feature"].alias("feature"),
                           e["contribution"].alias("contribution")),
    )
    return F.slice(F.array_sort(keyed), 1, n)


def _explained(df: DataFrame, keys: Sequence[str], n: int, entries: Column) -> DataFrame:
    # Sorting happens within the row, so the whole explanation needs no shuffle.
    top = df.select(*keys, F.posexplode(_top_entries(entries, n)).alias("i", "e"))
    return top.select(
        *keys, (F.col("i") + 1).alias("rank"), F.col("e.feature").alias("feature"),
        F.col("e.contribution").alias("contribution"),
        clean_label("e.feature").alias("label"), sign_label("e.contribution").alias("effect"),
    )


def local_contributions(
    df: DataFrame, key: str, coefficients: Mapping[str, float], means: Mapping[str, float], n: int = TOP_LOCAL
) -> DataFrame:
    """Exact explanation of a linear score: coefficient times distance from the mean, the n largest."""
    cells = [
        f"named_struct('feature', {literal(f)}, 'contribution', "
        f"{double_literal(w)} * (cast({quoted(f)} as double) - {double_literal(means[f])}))"
        for f, w in coefficients.items()
    ]
    return _explained(df, [key], n, F.expr(f"array({', '.join(cells)})"))


def feature_means(df: DataFrame, features: Sequence[str]) -> dict[str, float]:
    row = df.agg(*[F.avg(c).alias(c) for c in features]).first()
    return {c: row[c] for c in features}


#: What a task found of one feature, by quarter: number, mean, squared distances from it, extremes.
QUARTERS = "i int, n array<double>, mean array<double>, m2 array<double>, low array<double>, high array<double>"
_PLAIN = ("n", "mean", "m2", "low", "high")


def _merged(a: Sequence[np.ndarray], b: Sequence[np.ndarray]) -> tuple[np.ndarray, ...]:
    """Two parts of the same quarters as one; an empty part has no mean and infinite extremes."""
    n = a[0] + b[0]
    with np.errstate(invalid="ignore", divide="ignore"):
        share = np.where(n > 0, b[0] / n, 0.0)
        far = np.where((a[0] > 0) & (b[0] > 0), b[1] - a[1], 0.0)
        mean = np.where(a[0] > 0, a[1] + far * share, b[1])
    return n, mean, a[2] + b[2] + far**2 * a[0] * share, np.minimum(a[3], b[3]), np.maximum(a[4], b[4])


def _quarter_rows(found: Sequence[np.ndarray], names: Sequence[int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(names, pa.int32()), *(pa.array(list(m), pa.list_(pa.float64())) for m in found)], names=["i", *_PLAIN]
    )


def background(df: DataFrame, features: Sequence[str]) -> dict[str, np.ndarray]:
    """What the surrogate needs of the reference rows: quartiles, and per feature and quarter the share,
    mean, spread and extremes.  Two aggregates; its size depends on the number of features only."""
    features = list(features)
    d = len(features)
    q = f"array({', '.join(f'{x}d' for x in QUARTILES)})"
    cuts = df.agg(*[F.expr(f"percentile_approx({quoted(c)}, {q}, 10000) as c{i}") for i, c in enumerate(features)]).first()
    edges = np.array([cuts[f"c{i}"] for i in range(d)], dtype=float)

    def nothing(size: int) -> tuple[np.ndarray, ...]:
        return tuple(np.full((size, 4), x) for x in (0.0, 0.0, 0.0, np.inf, -np.inf))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = nothing(d)
        for batch in batches:
            here = nothing(d)
            for i, name in enumerate(batch.schema.names):
                v = batch[name].drop_null().to_numpy(zero_copy_only=False)
                # As Spark compares: a value that is not a number is above all others.
                quarter = ((v[:, None] > edges[i]) | np.isnan(v)[:, None]).sum(1)
                for j in range(4):
                    x = v[quarter == j]
                    if len(x):
                        mean = x.mean()
                        for measured, value in zip(here, (len(x), mean, ((x - mean) ** 2).sum(), x.min(), x.max())):
                            measured[i, j] = value
            found = _merged(found, here)
        yield _quarter_rows(found, range(d))

    def merge(parts: pa.Table) -> pa.Table:
        whole = nothing(1)
        for row in parts.to_pylist():
            whole = _merged(whole, [np.array([row[m]]) for m in _PLAIN])
        return pa.Table.from_batches([_quarter_rows(whole, [parts["i"][0].as_py()])])

    columns = [F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(features)]
    parts = df.select(*columns).mapInArrow(measure, QUARTERS).groupBy("i").applyInArrow(merge, QUARTERS)
    n, mean, m2, low, high = whole = nothing(d)
    # One row per feature.
    for row in parts.collect():
        for found, m in zip(whole, _PLAIN):
            found[row["i"]] = row[m]
    with np.errstate(invalid="ignore", divide="ignore"):
        share = n / n.sum(1, keepdims=True)
        stats = np.stack([np.where(n > 0, m, 0.0) for m in (mean, np.sqrt(m2 / n), low, high)], 2)
    return {"edges": edges, "share": share, "stats": np.nan_to_num(stats)}


#: Cells of a request that are drawn, looked up and added before the next ones are: they stay in the processor's cache.
CELLS_AT_ONCE = 1 << 15


def _quarters(rng: np.random.Generator, bg: Mapping[str, np.ndarray], samples: int) -> np.ndarray:
    """A quarter of each feature for each perturbed row, drawn by the share of the quarter."""
    d = len(bg["edges"])
    limits = np.ascontiguousarray(bg["share"].cumsum(1).T)
    quarter, step = np.empty((samples, d), np.int8), max(1, CELLS_AT_ONCE // d)
    drawn = np.empty((step, d))
    for at in range(0, samples, step):
        q = quarter[at : at + step]
        u = rng.random(out=drawn[: len(q)])
        np.greater(u, limits[0], out=q.view(bool))
        for limit in limits[1:3]:
            q += u > limit
    return quarter


def _values(rng: np.random.Generator, bg: Mapping[str, np.ndarray], quarter: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Values within the drawn quarters, some rows at a time: the number of the first row, and the values, which the next
    ones replace."""
    samples, d = quarter.shape
    # One look into a flat table per measure: a quarter of a feature has one place.
    mean, spread, low, high = (np.ascontiguousarray(m).ravel() for m in np.moveaxis(bg["stats"], 2, 0))
    first, step = np.arange(0, 4 * d, 4), max(1, CELLS_AT_ONCE // d)
    numbers, places, looked = np.empty((step, d)), np.empty((step, d), np.intp), np.empty((step, d))
    for at in range(0, samples, step):
        q = quarter[at : at + step]
        place, found = np.add(q, first, out=places[: len(q)]), looked[: len(q)]
        # What a normal number of that mean and spread is.
        values = rng.standard_normal(out=numbers[: len(q)])
        # Every place is in the tables; "clip" only skips the check.
        values *= spread.take(place, out=found, mode="clip")
        values += mean.take(place, out=found, mode="clip")
        np.maximum(values, low.take(place, out=found, mode="clip"), out=values)
        np.minimum(values, high.take(place, out=found, mode="clip"), out=values)
        yield at, values


def home_quarters(x: np.ndarray, bg: Mapping[str, np.ndarray]) -> np.ndarray:
    return (x[:, None] > bg["edges"]).sum(1).astype(np.int8)


def _stayed(quarter: np.ndarray, home: np.ndarray) -> np.ndarray:
    """Which features of the perturbed rows are in the quarter of the request, which is the first row."""
    same = quarter == home
    same[0] = True
    return same


def perturbed(x: np.ndarray, seed: int, bg: Mapping[str, np.ndarray], samples: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows around ``x``, itself first, and which of their features are in the quarter of ``x``.

    A perturbed row draws a quarter per feature by the share of the quarter and a value within it.
    """
    rng = np.random.default_rng(seed)
    quarter = _quarters(rng, bg, samples)
    values = np.empty(quarter.shape)
    for at, some in _values(rng, bg, quarter):
        values[at : at + len(some)] = some
    values[0] = x
    return values, _stayed(quarter, home_quarters(x, bg)).astype(float)


def nearness(same: np.ndarray) -> np.ndarray:
    """Weight of each perturbed row: the more features left their quarter, the less."""
    d = same.shape[1]
    return np.sqrt(np.exp(-(d - same.sum(1)) / (KERNEL_FACTOR**2 * d)))


def surrogate_weights(x: np.ndarray, seed: int, bg: Mapping[str, np.ndarray], coef: np.ndarray, intercept: float,
                      samples: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Weighted ridge on perturbed rows around ``x``: (feature positions, local weights).

    The regression sees which features stayed in the quarter of ``x``.
    """
    rng = np.random.default_rng(seed)
    quarter, linear = _quarters(rng, bg, samples), np.empty(samples)
    for at, values in _values(rng, bg, quarter):
        np.dot(values, coef, out=linear[at : at + len(values)])
    linear[0] = x @ coef
    score = 1.0 / (1.0 + np.exp(-(linear + intercept)))
    sums = _Sums(0, None, len(x))
    sums.add(_stayed(quarter, home_quarters(x, bg)), score)
    return sums.weights(n)


def quarter_label(name: str, e: np.ndarray, q: int) -> str:
    if q == 0:
        return f"{name} <= {e[0]:.2f}"
    if q == 3:
        return f"{name} > {e[2]:.2f}"
    return f"{e[q - 1]:.2f} < {name} <= {e[q]:.2f}"


def local_surrogate(
    df: DataFrame, key: str, features: Sequence[str], bg: Mapping[str, np.ndarray], coefficients: Sequence[float],
    intercept: float, n: int = TOP_LOCAL, samples: int = SURROGATE_SAMPLES,
) -> DataFrame:
    """Local explanation of every request by a surrogate regression, the n heaviest features each.

    The perturbed rows of a request live and die inside its task: no shuffle, and memory does not depend
    on the number of requests.
    """
    features = list(features)
    coef = np.asarray(list(coefficients), dtype=float)

    def explain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for k, x in zip(batch["k"], batch["x"]):
                x = np.asarray(x, dtype=float)
                chosen, weights = surrogate_weights(x, int(k) % (1 << 63), bg, coef, intercept, samples, n)
                home = home_quarters(x, bg)
                named = [(quarter_label(features[i], bg["edges"][i], home[i]), float(w)) for i, w in zip(chosen, weights)]
                named.sort(key=lambda e: (-abs(e[1]), e[0]))
                out += [(k, rank, name, w) for rank, (name, w) in enumerate(named, 1)]
            yield pd.DataFrame(out, columns=["k", "rank", "feature", "contribution"])

    rows = df.select(F.col(key).cast("bigint").alias("k"), F.array(*[F.col(c).cast("double") for c in features]).alias("x"))
    # Much work per row: spread the rows, whatever files they came from.  A given number of partitions is
    # not merged again for their small size.
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, df.count() // ROWS_PER_TASK)
    spread = rows.repartition(tasks, "k").mapInPandas(explain, "k bigint, rank int, feature string, contribution double")
    return spread.select(
        F.col("k").alias(key), "rank", "feature", "contribution",
        clean_label("feature").alias("label"), sign_label("contribution").alias("effect"),
    )


class _Sums:
    """Weighted sums of one request's perturbed rows: all that the ridge needs, whatever the number of rows."""

    def __init__(self, request: int, key: int | None, d: int):
        self.request, self.key, self.home = request, key, None
        self.w, self.wy, self.wz, self.wzy, self.wzz = 0.0, 0.0, np.zeros(d), np.zeros(d), np.zeros((d, d))

    def add(self, same: np.ndarray, score: np.ndarray) -> None:
        w = nearness(same)
        # A matrix by its own transpose: half the work of a product of two.
        root = np.sqrt(w)
        scaled = same * root[:, None]
        self.w += w.sum()
        self.wy += w @ score
        self.wz += root @ scaled
        self.wzy += (root * score) @ scaled
        self.wzz += scaled.T @ scaled

    def weights(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """The n features of largest weight, and their weights in a ridge of their own."""
        gram = self.wzz - np.outer(self.wz, self.wz) / self.w
        right = self.wzy - self.wz * (self.wy / self.w)

        def ridge(columns: np.ndarray) -> np.ndarray:
            return np.linalg.solve(gram[np.ix_(columns, columns)] + np.eye(len(columns)), right[columns])

        chosen = np.argsort(-np.abs(ridge(np.arange(len(right)))), kind="stable")[:n]
        return chosen, ridge(chosen)


PERTURBED = pa.schema([("k", pa.int64()), ("request", pa.int64()), ("home", pa.binary()), ("same", pa.binary()), ("x", pa.list_(pa.float64()))])
WEIGHTS = pa.schema([("k", pa.int64()), ("rank", pa.int32()), ("feature", pa.string()), ("contribution", pa.float64())])


def _explained_request(sums: _Sums, features: Sequence[str], bg: Mapping[str, np.ndarray], n: int) -> pa.RecordBatch:
    """The heaviest features of a request, named by their quarters."""
    chosen, weights = sums.weights(n)
    named = [(quarter_label(features[i], bg["edges"][i], sums.home[i]), float(w)) for i, w in zip(chosen, weights)]
    named.sort(key=lambda e: (-abs(e[1]), e[0]))
    return pa.RecordBatch.from_arrays(
        [pa.array([sums.key] * len(named), pa.int64()), pa.array(range(1, len(named) + 1), pa.int32()),
         pa.array([e[0] for e in named], pa.string()), pa.array([e[1] for e in named], pa.float64())],
        schema=WEIGHTS,
    )


#: Requests whose perturbed rows walk the trees together.
REQUESTS_AT_ONCE = 4


def _forest_table_surrogate(
    df: DataFrame, key: str, features: Sequence[str], bg: Mapping[str, np.ndarray], forest: TableForest, n: int, samples: int
) -> DataFrame:
    """``model_surrogate`` for a forest that neither the driver nor a task holds.

    A request travels to every group of trees.  Its perturbed rows are made there from its key and go no further: the
    right side of the ridge is linear in the scores, so each group gives its share of that side, a number per feature.
    """
    d, trees, limits = len(features), len(forest.tops), forest.limits

    def pack(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            x = np.array(batch["x"].to_pylist(), dtype=float).reshape(-1, d)
            keys = [None if k is None else k.to_bytes(8, "little", signed=True) for k in batch["k"].to_pylist()]
            cells = [[r.tobytes() for r in x], keys, [i.to_bytes(8, "little") for i in batch["id"].to_pylist()]]
            yield pa.RecordBatch.from_arrays([pa.array([1] * len(x), pa.int32()), *(pa.array(c, pa.binary()) for c in cells)], names=["i", "a", "b", "c"])

    def seed(k: bytes | None) -> int:
        return (0 if k is None else int.from_bytes(k, "little", signed=True)) % (1 << 63)

    def emit(part: int, walkers: list, visits: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        codes = np.empty((REQUESTS_AT_ONCE * samples, d), np.uint8)
        flat, first = codes.ravel(), np.arange(0, len(codes) * d, d)
        for at in range(0, visits.num_rows, REQUESTS_AT_ONCE):
            some = visits.slice(at, REQUESTS_AT_ONCE)
            ends, kept = range(0, some.num_rows * samples, samples), []
            for lo, x, k in zip(ends, some["a"].to_pylist(), some["b"].to_pylist()):
                values, same = perturbed(np.frombuffer(x), seed(k), bg, samples)
                for j, column in enumerate(np.ascontiguousarray(values.T)):
                    codes[lo : lo + samples, j] = np.searchsorted(limits[j], column)
                kept.append(same)
            total = np.zeros(some.num_rows * samples)
            for _, walker in walkers:
                total += walker.p.take(walker.walk(flat, first[: len(total)])[0])
            right = []
            for lo, same in zip(ends, kept):
                pull = nearness(same) * (total[lo : lo + samples] / trees)
                right.append(np.append(pull @ same, pull.sum()).tobytes())
            cells = [some["c"], pa.array([part] * some.num_rows, pa.int32()), some["b"], some["a"], pa.array(right, pa.binary())]
            yield pa.RecordBatch.from_arrays(cells, names=["id", "part", "k", "x", "right"])

    def fit(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for k, x, parts in zip(batch["k"].to_pylist(), batch["x"].to_pylist(), batch["rights"].to_pylist()):
                x = np.frombuffer(x)
                sums = _Sums(0, None if k is None else int.from_bytes(k, "little", signed=True), d)
                sums.home = home_quarters(x, bg)
                sums.add(_stayed(_quarters(np.random.default_rng(seed(k)), bg, samples), sums.home), np.zeros(samples))
                right = sum(np.frombuffer(p) for p in parts)
                sums.wzy, sums.wy = right[:d], right[d]
                yield _explained_request(sums, features, bg, n)

    x = F.array(*[F.col(c).cast("double") for c in features])
    requests = df.select(F.monotonically_increasing_id().alias("id"), F.col(key).cast("bigint").alias("k"), x.alias("x"))
    requests = requests.mapInArrow(pack, "i int, a binary, b binary, c binary")
    found = forest.visited(requests, emit, "id binary, part int, k binary, x binary, right binary")
    if len(forest.groups()) > 2:
        # One row per group of trees.
        rights = F.transform(F.array_sort(F.collect_list(F.struct("part", "right"))), lambda e: e["right"])
        found = found.groupBy("id").agg(F.first("k").alias("k"), F.first("x").alias("x"), rights.alias("rights"))
    else:
        found = found.select("k", "x", F.array("right").alias("rights"))
    out = found.mapInArrow(fit, from_arrow_schema(WEIGHTS))
    return out.select(
        F.col("k").alias(key), "rank", "feature", "contribution",
        clean_label("feature").alias("label"), sign_label("contribution").alias("effect"),
    )


def model_surrogate(
    df: DataFrame, key: str, features: Sequence[str], bg: Mapping[str, np.ndarray], model,
    n: int = TOP_LOCAL, samples: int = SURROGATE_SAMPLES,
) -> DataFrame:
    """Local explanation of every request for any fitted classifier of Spark ML, the n heaviest features each.

    The perturbed rows are rows of a table: made from their request, scored by ``model.transform`` and summed
    into one matrix per request, all within the request's task.  No shuffle, nothing of the model in a
    closure, and memory depends on the number of features only.  A null key is a request as any other;
    repeated rows give repeated results, an empty table an empty one.  A forest that is a table is visited by the requests.
    """
    features = list(features)
    d = len(features)
    if isinstance(model, TableForest):
        return _forest_table_surrogate(df, key, features, bg, model, n, samples)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        request = 0
        for batch in batches:
            for k, x in zip(batch["k"].to_pylist(), batch["x"].to_pylist()):
                x = np.asarray(x, dtype=float)
                values, same = perturbed(x, (k or 0) % (1 << 63), bg, samples)
                home = (x[:, None] > bg["edges"]).sum(1).astype(np.uint8).tobytes()
                offsets = pa.array(np.arange(0, samples * d + 1, d, dtype=np.int32))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([k] * samples, pa.int64()), pa.array([request] * samples, pa.int64()),
                        pa.array([home] + [None] * (samples - 1), pa.binary()),
                        pa.array([r.tobytes() for r in same.astype(np.uint8)], pa.binary()),
                        pa.ListArray.from_arrays(offsets, pa.array(values.ravel())),
                    ],
                    schema=PERTURBED,
                )
                request += 1

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Rows arrive as they were made: a request's rows one after the other.
        sums = None
        for batch in batches:
            if not batch.num_rows:
                continue
            request, score = batch["request"].to_numpy(), batch["p"].to_numpy()
            same = np.frombuffer(b"".join(batch["same"].to_pylist()), np.uint8).reshape(-1, d).astype(float)
            cuts = [0, *(np.flatnonzero(np.diff(request)) + 1).tolist(), len(request)]
            for lo, hi in zip(cuts, cuts[1:]):
                if sums is None or sums.request != request[lo]:
                    if sums is not None:
                        yield _explained_request(sums, features, bg, n)
                    sums = _Sums(request[lo], batch["k"][lo].as_py(), d)
                    sums.home = np.frombuffer(batch["home"][lo].as_py(), np.uint8)
                sums.add(same[lo:hi], score[lo:hi])
        if sums is not None:
            yield _explained_request(sums, features, bg, n)

    rows = df.select(F.col(key).cast("bigint").alias("k"), F.array(*[F.col(c).cast("double") for c in features]).alias("x"))
    # As above, with as many requests in a task; by all columns, since one key may have many rows.
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, df.count() // ROWS_PER_TASK)
    around = rows.repartition(tasks, "k", "x").mapInArrow(make, from_arrow_schema(PERTURBED))
    scored = model.transform(around.select("k", "request", "home", "same", array_to_vector("x").alias("features")))
    out = scored.select("k", "request", "home", "same", vector_to_array("probability")[1].alias("p")).mapInArrow(
        fit, from_arrow_schema(WEIGHTS)
    )
    return out.select(
        F.col("k").alias(key), "rank", "feature", "contribution",
        clean_label("feature").alias("label"), sign_label("contribution").alias("effect"),
    )


def describe(df: DataFrame, name: str, dictionary: DataFrame) -> DataFrame:
    """Attach the description of a variable; of several entries the first by position counts."""
    first = dictionary.groupBy(F.col("Row").alias(name)).agg(F.min_by("Description", "position").alias("Description"))
    return lookup_join(df, first, [name])


def look_up(dictionary: DataFrame, variable: str) -> DataFrame:
    """Description of one variable: the filter reaches the scan."""
    return dictionary.where(F.col("Row") == variable).orderBy("position").limit(1).select("Row", "Description")


def compare_client(df: DataFrame, key: str, client: DataFrame, features: Sequence[str], cohort: str) -> DataFrame:
    """One client beside all clients and beside its cohort: value, both averages, and the share of clients
    with a smaller value.  ``client`` is a one-row selection of ``df``; one aggregate over all rows."""
    mine = client.select(F.struct(cohort, *features)).scalar()
    tagged = df.select(key, cohort, *features).withColumn("_me", mine)
    alike = f"{quoted(cohort)} <=> _me.{quoted(cohort)}"
    measures = {}
    for c in features:
        x, me = quoted(c), f"_me.{quoted(c)}"
        peer = f"case when {alike} then {x} end"
        measures[c] = {
            "value": f"cast(max({me}) as double)",
            "mean_all": f"avg({x})",
            "mean_cohort": f"avg({peer})",
            "share_below_all": f"try_divide(count_if({x} < {me}), count({x}))",
            "share_below_cohort": f"try_divide(count_if({alike} and {x} < {me}), count({peer}))",
        }
    return long_counts(tagged, measures, key="feature")
